"""Queries of the store, index, tree and text operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ff
from ..functions import listing, locations, locators, sizes
from ..functions.cdc import ChunkSizes
from ..functions.chunk_ids import chunk_key, chunk_key_sql, format_id, store_path
from ..operators import cache, chunking, index, store, tree
from ..operators.eager import sized_items
from ..operators.lookup import attach
from ..operators.order import running_total
from ..operators.snapshots import canonical_path
from . import table

SMALL = ChunkSizes.of(64, 256, 1024)
FIXED = 1024


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("blob_id"), F.encode("text", "utf-8").alias("data"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_items").select("index_id", "pos", "arrival_no", "end_offset", chunk_key("chunk").alias("chunk_id"))


def _stores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "store_chunks").select("store_id", chunk_key("chunk").alias("chunk_id"), "size", "codec").filter(F.col("chunk_id").isNotNull())


def fixed_chunk_totals(spark, d):
    """Chunks of fixed size of all messages: totals, different ones, reuse."""
    return chunking.dedup_totals(chunking.fixed_chunks(_blobs(spark, d), FIXED))


def fixed_chunk_reuse(spark, d):
    """Chunks of each message that are written or reused, in the order of the messages."""
    return chunking.written_or_reused(chunking.fixed_chunks(_blobs(spark, d), FIXED))


def fixed_index(spark, d):
    """The index of all messages in chunks of fixed size."""
    return chunking.index_of(chunking.fixed_chunks(_blobs(spark, d), FIXED))


def payload_digests(spark, d):
    """SHA-256 and size of every message."""
    return _blobs(spark, d).select("blob_id", F.sha2("data", 256).alias("digest"), F.length("data").cast("long").alias("bytes"))


def content_chunk_totals(spark, d):
    """Content-defined chunks of all messages: totals, different ones, reuse."""
    return chunking.dedup_totals(chunking.content_chunks(_blobs(spark, d), SMALL))


def content_index(spark, d):
    """The index of all messages in content-defined chunks."""
    return chunking.index_of(chunking.content_chunks(_blobs(spark, d), SMALL))


def content_index_of_segments(spark, d):
    """The same cuts, of messages that come in segments."""
    return chunking.content_chunks_of_segments(chunking.segments(_blobs(spark, d), 16 << 10), SMALL)


def chunk_size_histogram(spark, d):
    """How many content-defined chunks have which size."""
    return chunking.size_histogram(chunking.content_chunks(_blobs(spark, d), SMALL), SMALL)


def source_stream_digests(spark, d):
    """The digest of each source's messages as one stream, in their order."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.encode("text", "utf-8").alias("data"))
    return chunking.stream_digest(docs, ["source"], "doc_id", algorithm="sha512-256")


def round_trip(spark, d):
    """Messages that are put together again from their chunks: whether all are the same."""
    back = chunking.reassembled(chunking.fixed_chunks(_blobs(spark, d), FIXED)).withColumnRenamed("data", "back")
    return _blobs(spark, d).filter(F.length("data") > 0).join(back, "blob_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("data") == F.col("back")).alias("same"))


def byte_range(spark, d):
    """Bytes 1000 to 2500 of every message, from its chunks."""
    got = index.read_range(chunking.fixed_chunks(_blobs(spark, d), FIXED), 1000, 2500)
    return got.select("blob_id", F.sha2("data", 256).alias("digest"), F.length("data").cast("long").alias("bytes"))


def index_sizes(spark, d):
    """Size of every item of every index."""
    return sized_items(table(spark, d, "index_items")).select("index_id", "pos", format_id(F.col("key")).alias("chunk_id"), "size")


def index_totals(spark, d):
    """Chunks, size of the blob and size of the file of each index."""
    return index.index_totals(table(spark, d, "index_items"))


def index_violations(spark, d):
    """What is wrong with which items."""
    return index.violations(table(spark, d, "index_items"), table(spark, d, "index_meta"))


def chunk_at_offset(spark, d):
    """The chunk at every whole mebibyte of every index."""
    items = table(spark, d, "index_items")
    ends = items.groupBy("index_id").agg(F.max("end_offset").alias("n")).filter("n > 0")
    return index.chunks_at(items, ends.select("index_id", F.explode(F.expr("sequence(0L, n - 1, 1048576L)")).alias("offset")))


def range_of_indices(spark, d):
    """Which parts of which chunks make up bytes 1,000,000 to 2,000,000 of every index."""
    got = index.chunks_in_range(table(spark, d, "index_items"), F.lit(1_000_000), F.lit(2_000_000))
    return got.select("index_id", "pos", "skip", "take")


def collection_usage(spark, d):
    """References of all indices and different chunks."""
    return store.usage(_items(spark, d))


def gc_plan(spark, d):
    """Stored chunks that no index refers to."""
    return store.garbage(_stores(spark, d), _items(spark, d)).select("store_id", format_id(F.col("chunk_id")).alias("chunk_id"), "size")


def gc_totals(spark, d):
    """How many chunks and folders garbage collection would remove."""
    hexed = lambda df: df.select(format_id(F.col("chunk_id")).alias("chunk_id"))
    return store.garbage_totals(hexed(_stores(spark, d)), hexed(_items(spark, d)))


def prefetch(spark, d):
    """Chunks that some index needs and no store holds."""
    return store.lacks(_items(spark, d), _stores(spark, d)).select(format_id(F.col("chunk_id")).alias("chunk_id"))


def present_items(spark, d):
    """Items of indices whose chunk is in a store."""
    return store.has(_items(spark, d).filter(F.col("chunk_id").isNotNull()), _stores(spark, d)).select("arrival_no")


def push_missing(spark, d):
    """Chunks of the indices of each tree that the main store lacks, and how many trees need them."""
    own = attach(_items(spark, d).filter(F.col("chunk_id").isNotNull()), table(spark, d, "index_meta").select("index_id", "tree_id"), ["index_id"]).select("tree_id", "chunk_id").distinct()
    lack = own.join(_stores(spark, d).filter(F.col("store_id") == "default.castr").select("chunk_id").distinct(), "chunk_id", "left_anti")
    return lack.groupBy("tree_id").agg(F.count(F.lit(1)).alias("to_send"))


def store_after_put(spark, d):
    """What putting all chunks of the indices adds to the main store, with the size of the chunk."""
    sized = sized_items(table(spark, d, "index_items")).filter(F.col("key").isNotNull()).select(F.col("key").alias("chunk_id"), "size")
    main = _stores(spark, d).filter(F.col("store_id") == "default.castr")
    return store.put(sized, main).select(format_id(F.col("chunk_id")).alias("chunk_id"), store_path(F.col("chunk_id")).alias("path"))


def store_tombstones(spark, d):
    """The store after the missing chunks have been marked: entries by state."""
    marked = store.mark_missing(_stores(spark, d).select("chunk_id", "size"), _items(spark, d).filter(F.col("chunk_id").isNotNull()))
    return marked.groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


def _sources(spark, d):
    s = _stores(spark, d)
    return [("write-store", s.filter(F.col("store_id") == "default.castr")), ("read-store", s.filter(F.col("store_id") == "extra.castr"))]


def resolve_providers(spark, d):
    """Who serves how many requests and bytes if each item is taken from the first store that holds it."""
    items = sized_items(table(spark, d, "index_items")).select(F.col("key").alias("chunk_id"), "size")
    return store.provider_totals(items, _sources(spark, d))


def resolve_items(spark, d):
    """The provider of every item of every index."""
    return store.resolve(_items(spark, d).filter(F.col("chunk_id").isNotNull()), _sources(spark, d)).select("arrival_no", "provider")


def seed_delta(spark, d):
    """What of each index the index before it of the same tree already provides."""
    from pyspark.sql import Window

    meta = table(spark, d, "index_meta").select("index_id", "tree_id", "made_at")
    order = meta.withColumn("n", F.row_number().over(Window.partitionBy("tree_id").orderBy("made_at", "index_id"))).select("index_id", "tree_id", "n")
    items = attach(sized_items(table(spark, d, "index_items")), order, ["index_id"]).filter(F.col("key").isNotNull())
    earlier = items.select("tree_id", (F.col("n") + 1).alias("n"), "key")
    return index.delta(earlier, items.filter("n > 1").select("tree_id", "n", "key", "size"), ["tree_id", "n"])


def covering_flags(spark, d):
    """Feature flags of the indices of each tree together, in shortest form and by name."""
    per = table(spark, d, "index_meta").groupBy("tree_id").agg(F.bit_or("feature_flags").alias("flags"))
    return per.select("tree_id", "flags", ff.normalize(F.col("flags")).alias("normalized"), ff.time_granularity(F.col("flags")).alias("granularity_ns"))


def flag_names(spark, d):
    """Names of the flags of every index."""
    return table(spark, d, "index_meta").select("index_id", ff.format_features(F.col("feature_flags")).alias("names"))


def locator_classes(spark, d):
    """Class of the locator of every tree, the path behind a file URL, and where the default store lies."""
    loc = F.col("locator")
    return table(spark, d, "trees").select("tree_id", locators.locator_class(loc).alias("class"), locators.strip_file_url(loc).alias("path"))


def locator_siblings(spark, d):
    """Locators of the default stores beside the trees, and which trees are image trees."""
    loc = F.col("locator")
    return table(spark, d, "trees").select("tree_id", locators.default_store(loc).alias("store"), locators.has_suffix(loc, "-img").alias("is_image"))


def size_texts(spark, d):
    """Sizes of locations as short texts."""
    return table(spark, d, "locations").filter(F.col("size").isNotNull()).groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", "n", sizes.format_size(F.col("size")).alias("text"))


def _entries(spark, d):
    """The entries of every snapshot, each path once."""
    rows = attach(table(spark, d, "locations"), table(spark, d, "snapshots").select("snapshot_id").distinct(), ["snapshot_id"], "left_semi").select("snapshot_id", canonical_path("path").alias("path"), "designator", "size", "mtime", "inode", "generation", "start_offset", "delivered_at")
    one = rows.groupBy("snapshot_id", "path").agg(F.max(F.struct("delivered_at", "designator", "size", "mtime", "inode", "generation", "start_offset")).alias("r")).select("snapshot_id", "path", "r.*").drop("delivered_at")
    kind = F.when(F.col("designator") == "e", "dir").otherwise("file")
    mode = F.when(F.col("designator") == "e", 0o040000).otherwise(0o100000).bitwiseOR(F.coalesce(F.pmod("inode", F.lit(4096)), F.lit(0o644)).cast("int"))
    return one.withColumns({"kind": kind, "mode": mode})


def _trees(spark, d):
    """The same, each snapshot being a tree by itself, as the tree operators have it."""
    return _entries(spark, d).withColumnRenamed("snapshot_id", "tree_id")


def _by_snapshot(df):
    return df.withColumnRenamed("tree_id", "snapshot_id")


def list_snapshots(spark, d):
    """The listing of every snapshot; permissions stand for the inode, which the records have, as they have no mode."""
    return _entries(spark, d).select("snapshot_id", "path", listing.list_line(F.col("mode"), F.col("path")).alias("line"))


def manifest_snapshots(spark, d):
    """Manifest lines of the same entries."""
    line = listing.mtree_line(F.col("path"), F.col("mode"), size=F.col("size"), mtime_ns=F.col("mtime"))
    return _entries(spark, d).select("snapshot_id", "path", line.alias("line"))


def entry_violations(spark, d):
    """Entries of all snapshots that no archive could hold."""
    return _by_snapshot(tree.entry_violations(_trees(spark, d).withColumnRenamed("mtime", "mtime_ns")))


EXCLUDES = "*.tmp\n*.gz\n!report*.gz\n/cache/\n/doc/logs/*.py\ndrafts/\n"


def excluded_paths(spark, d):
    """Entries of all snapshots that a set of exclude patterns takes out."""
    return _by_snapshot(tree.excluded(_trees(spark, d), tree.parse_patterns(EXCLUDES)))


def walk_order(spark, d):
    """The place of every entry of every snapshot in the walk of its tree."""
    placed = running_total(_entries(spark, d).select("snapshot_id", "path", tree.tree_order(F.col("path")).alias("key")), ["snapshot_id"], ["key"], name="place")
    return placed.select("snapshot_id", "place", "path")


def folder_tables(spark, d):
    """Names in each folder of every snapshot, and whether its search tree holds them all."""
    entries = _trees(spark, d).select("tree_id", "path", F.coalesce("start_offset", F.lit(0)).alias("start"), F.coalesce("size", F.lit(0)).alias("size"))
    return _by_snapshot(tree.name_tables(entries).select("tree_id", "parent", F.size("items").alias("names")))


def location_texts(spark, d):
    """Every location record as text, and whether reading it back gives the same: all of it, but for a size of 0 and an inode or generation without a time, which the text can't hold."""
    c = F.col
    l = table(spark, d, "locations").withColumn("path", canonical_path("path"))
    text = locations.format_location(c("path"), c("designator"), c("start_offset"), F.nullif(c("size"), F.lit(0)), c("mtime"), c("inode"), c("generation"))
    back = locations.parse_location(text)
    timed = lambda x: F.when(c("mtime").isNotNull(), x)
    kept = {"path": c("path"), "designator": c("designator"), "offset": c("start_offset"), "size": F.nullif(c("size"), F.lit(0)), "mtime": c("mtime"), "inode": timed(F.coalesce(c("inode"), F.lit(0))), "generation": timed(c("generation").cast("long"))}
    same = F.lit(True)
    for n, x in kept.items():
        same = same & back[n].eqNullSafe(x)
    return l.select("snapshot_id", "path", text.alias("text"), same.alias("same"))


def location_ids(spark, d):
    """The cache key of every location record."""
    c = F.col
    return table(spark, d, "locations").select("snapshot_id", "path", format_id(locations.location_id(c("path"), c("designator"), c("start_offset"), None, c("mtime"), c("inode"), c("generation"))).alias("location_id"))


def cache_run(spark, d):
    """Hits, misses and invalidated entries of each snapshot if the one before it filled the cache."""
    from pyspark.sql import Window

    snaps = table(spark, d, "snapshots").withColumn("n", F.row_number().over(Window.partitionBy("tree_id").orderBy("snap_no"))).select("snapshot_id", "tree_id", "n")
    rows = attach(table(spark, d, "locations"), snaps, ["snapshot_id"]).select("tree_id", "n", canonical_path("path").alias("path"), "size", "mtime", "inode", "delivered_at")
    one = rows.groupBy("tree_id", "n", "path").agg(F.max(F.struct("delivered_at", "size", "mtime", "inode")).alias("r")).select("tree_id", "n", "path", "r.size", "r.mtime", "r.inode")
    got = cache.cache_verdicts(one.filter("n > 1"), one.withColumn("n", F.col("n") + 1), ["tree_id", "n", "path"], ["size", "mtime", "inode"])
    return cache.cache_totals(got, ["tree_id", "n"])


def extract_deletes(spark, d):
    """What an extraction over the snapshot before would delete: its paths that the later one lacks."""
    from pyspark.sql import Window

    snaps = table(spark, d, "snapshots").withColumn("n", F.row_number().over(Window.partitionBy("tree_id").orderBy("snap_no"))).select("snapshot_id", "tree_id", "n")
    last = F.max("n").over(Window.partitionBy("tree_id"))
    rows = attach(table(spark, d, "locations"), snaps.withColumn("last", last), ["snapshot_id"]).select("tree_id", "n", "last", canonical_path("path").alias("path"))
    return tree.deleted_names(rows.filter("n < last").select("tree_id", (F.col("n") + 1).alias("n"), "path"), rows.select("tree_id", "n", "path"), ["tree_id", "n"])


def hardlink_groups(spark, d):
    """Messages of equal source and text."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.concat(F.coalesce("source", F.lit("")), F.lit("\n"), F.col("text")), 256).alias("digest"))
    return cache.hardlinks(files)


def reflink_bytes(spark, d):
    """Bytes that the items of an index could share, block by block, with the same chunk at its first place."""
    one = index.spans(table(spark, d, "index_items")).filter(F.col("key").isNotNull())
    first = one.groupBy("key").agg(F.min(F.struct("index_id", "pos", "start")).alias("f"))
    met = attach(one, first, ["key"]).filter((F.col("index_id") != F.col("f.index_id")) | (F.col("pos") != F.col("f.pos")))
    got = cache.reflinked(met.select("index_id", F.col("start").alias("target"), F.col("f.start").alias("source"), (F.col("end") - F.col("start")).alias("size")))
    return got.groupBy("index_id").agg(F.sum("bytes").alias("bytes"))


def codec_report(spark, d):
    """Stored chunks and bytes by codec, and ids held in more than one store."""
    return _stores(spark, d).groupBy("codec").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def make_documents(spark, d):
    """What making an index of every message writes and reuses, with content-defined cuts."""
    from .verbs import Options, make_blobs

    return make_blobs(_blobs(spark, d), options=Options(sizes=SMALL)).report


def _archived(spark, d):
    """What the archives of the snapshots hold: all that the records tell of an entry, with folders that no record stands for."""
    entries = _trees(spark, d).filter((F.col("path") != "") | (F.col("kind") == "dir"))
    return tree.with_folders(entries.select("tree_id", "path", "kind", "mode", F.col("mtime").alias("mtime_ns")))


def tree_archives(spark, d):
    """Size and digest of an archive of every snapshot; the records have no contents, so files are empty in it."""
    from ..sources.archives import archive_parts

    parts = archive_parts(_archived(spark, d))
    return _by_snapshot(chunking.stream_digest(parts, ["tree_id"], "start"))


def archive_round_trip(spark, d):
    """Entries of those archives as they are read back, by kind, and how many have the mode and mtime that went in; unknown ones are stored as 0."""
    from ..sources.archives import archives, unpacked

    entries = _archived(spark, d)
    back = unpacked(archives(entries), with_content=False).select("tree_id", "path", "kind", F.col("mode").alias("__mode"), F.col("mtime_ns").alias("__mtime"))
    stored = lambda c: F.coalesce(F.col(c), F.lit(0))
    same = (F.col("__mode").bitwiseAND(0o7777) == stored("mode").bitwiseAND(0o7777)) & (F.col("__mtime") == stored("mtime_ns"))
    met = back.join(entries.drop("kind"), ["tree_id", "path"], "left")
    return _by_snapshot(met.groupBy("tree_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same")))


_I = f"(SELECT arrival_no, index_id, pos, end_offset, {chunk_key_sql('chunk')} AS k FROM index_items)"
_S = f"(SELECT store_id, size, codec, {chunk_key_sql('chunk')} AS k FROM store_chunks)"
_SIZED = f"""once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_id, pos ORDER BY k IS NULL, end_offset IS NULL, arrival_no) AS rn FROM {_I} WHERE index_id IS NOT NULL AND pos IS NOT NULL) WHERE rn = 1),
  sized AS (SELECT c.index_id, c.pos, c.k, c.end_offset, c.end_offset - CASE WHEN c.pos = 0 THEN 0 ELSE p.end_offset END AS size FROM once c LEFT JOIN once p ON p.index_id = c.index_id AND p.pos = c.pos - 1)"""
_SPANS = f"{_SIZED}, spans AS (SELECT index_id, pos, k, end_offset - size AS a, end_offset AS b FROM sized WHERE size > 0)"
_FIXED = f"""h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE strlen(text) > 0),
  f AS (SELECT doc_id, CAST(unnest(generate_series(0, (len(x) // 2 - 1) // {FIXED})) AS INTEGER) AS pos, x FROM h),
  c AS (SELECT doc_id, pos, sha256(unhex(substr(x, pos * {2 * FIXED} + 1, {2 * FIXED}))) AS chunk_id, len(substr(x, pos * {2 * FIXED} + 1, {2 * FIXED})) // 2 AS size FROM f)"""
#: Content-defined cuts: the number of a byte by its rule, hashes of windows by a moving XOR of turned numbers, candidates, and cut after cut.
_CUTS = f"""WITH RECURSIVE numbers AS (SELECT printf('%02X', b) AS byte, CAST('0x' || substr(sha256(printf('%02x', b)), 1, 8) AS UBIGINT) AS t FROM range(256) r(b)),
  texts AS (SELECT doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
  bytes AS (SELECT doc_id, unnest(regexp_extract_all(x, '..')) AS byte, unnest(range(0, n)) AS i FROM texts),
  turned AS (SELECT doc_id, i, ((t >> CAST(i % 32 AS UBIGINT)) | (t << CAST(32 - i % 32 AS UBIGINT))) & 4294967295 AS r FROM bytes JOIN numbers USING (byte)),
  spans AS (SELECT doc_id, i, bit_xor(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS s FROM turned),
  called AS (SELECT doc_id, list(i + 1 ORDER BY i) AS c FROM spans WHERE i >= 47 AND (((s << CAST(i % 32 AS UBIGINT)) | (s >> CAST(32 - i % 32 AS UBIGINT))) & 4294967295) % {SMALL.discriminator} = {SMALL.discriminator - 1} GROUP BY doc_id),
  steps AS (SELECT doc_id, 0 AS pos, 0 AS a, least(n, {SMALL.max}, coalesce(list_filter(c, lambda v: v >= {SMALL.min})[1], n)) AS b, n, c FROM texts LEFT JOIN called USING (doc_id)
    UNION ALL SELECT doc_id, pos + 1, b, least(n, b + {SMALL.max}, coalesce(list_filter(c, lambda v: v >= b + {SMALL.min})[1], n)), n, list_filter(c, lambda v: v >= b + {SMALL.min}) FROM steps WHERE b < n),
  c AS (SELECT doc_id, pos, a, b, b - a AS size, sha256(unhex(substr(x, 2 * a + 1, 2 * (b - a)))) AS chunk_id FROM steps JOIN texts USING (doc_id))"""
_TOTALS = """u AS (SELECT chunk_id, count(*) AS n, max(size) AS size FROM c GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS unique_bytes, CAST(sum(n) - count(*) AS BIGINT) AS reused,
          CAST((sum(n) - count(*)) * 100 // sum(n) AS BIGINT) AS reused_percent, CAST(sum(n * size) // sum(n) AS BIGINT) AS average_chunk FROM u"""
_BUCKETS, _WIDTH = 16, (SMALL.max + 1 - SMALL.min) / 16
_MAIN, _EXTRA = "SELECT DISTINCT k FROM " + _S + " WHERE store_id = 'default.castr'", "SELECT DISTINCT k FROM " + _S + " WHERE store_id = 'extra.castr'"
_CANON = "array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/')"
_ENTRIES = f"""rec AS (SELECT snapshot_id, {_CANON} AS path, designator, size, mtime, inode, start_offset, delivered_at FROM locations WHERE snapshot_id IN (SELECT snapshot_id FROM snapshots)),
  entries AS (SELECT snapshot_id, path, r.d AS designator, r.s AS size, r.m AS mtime, r.i AS inode, r.o AS start_offset FROM (SELECT snapshot_id, path, arg_max(struct_pack(d := designator, s := size, m := mtime, i := inode, o := start_offset), delivered_at) AS r FROM rec GROUP BY ALL)),
  moded AS (SELECT *, coalesce(inode % 4096, 420) AS perm FROM entries)"""
_LINE = """CASE WHEN designator = 'e' THEN 'd' ELSE '-' END
  || CASE WHEN perm & 256 > 0 THEN 'r' ELSE '-' END || CASE WHEN perm & 128 > 0 THEN 'w' ELSE '-' END
  || CASE WHEN perm & 2048 > 0 THEN CASE WHEN perm & 64 > 0 THEN 's' ELSE 'S' END WHEN perm & 64 > 0 THEN 'x' ELSE '-' END
  || CASE WHEN perm & 32 > 0 THEN 'r' ELSE '-' END || CASE WHEN perm & 16 > 0 THEN 'w' ELSE '-' END
  || CASE WHEN perm & 1024 > 0 THEN CASE WHEN perm & 8 > 0 THEN 's' ELSE 'S' END WHEN perm & 8 > 0 THEN 'x' ELSE '-' END
  || CASE WHEN perm & 4 > 0 THEN 'r' ELSE '-' END || CASE WHEN perm & 2 > 0 THEN 'w' ELSE '-' END
  || CASE WHEN designator = 'e' AND perm & 512 > 0 THEN CASE WHEN perm & 1 > 0 THEN 't' ELSE 'T' END WHEN perm & 1 > 0 THEN 'x' ELSE '-' END"""
_ESCAPED = r"""(SELECT string_agg(CASE WHEN v <= 32 OR v >= 127 OR v IN (92, 35) THEN '\' || (v // 64)::VARCHAR || (v // 8 % 8)::VARCHAR || (v % 8)::VARCHAR ELSE chr(v) END, '' ORDER BY i)
  FROM (SELECT i, CAST('0x' || substr(hex(encode(path)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS v FROM range(0, strlen(path)) t(i)))"""
_RUNS = "ranked AS (SELECT snapshot_id, tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY snap_no) AS n, count(*) OVER (PARTITION BY tree_id) AS last FROM snapshots)"
_GROUP_SQL = {n: v - (1 << 64) if v >> 63 else v for n, v in ff.FEATURES.items()}
_NAMES = "concat_ws(' ', " + ", ".join(f"CASE WHEN feature_flags & {v} <> 0 THEN '{n}' END" for n, v in _GROUP_SQL.items()) + ")"
_UNKNOWN = ~ff.signed(ff.KNOWN)
_F = ff.FEATURES

QUERIES = {
    f.__name__: f
    for f in (
        fixed_chunk_totals, fixed_chunk_reuse, fixed_index, payload_digests, content_chunk_totals, content_index, content_index_of_segments, chunk_size_histogram, source_stream_digests, round_trip, byte_range,
        index_sizes, index_totals, index_violations, chunk_at_offset, range_of_indices, collection_usage, gc_plan, gc_totals, prefetch, present_items, push_missing, store_after_put, store_tombstones,
        resolve_providers, resolve_items, seed_delta, covering_flags, flag_names, locator_classes, locator_siblings, size_texts, list_snapshots, manifest_snapshots, entry_violations, excluded_paths, walk_order,
        folder_tables, location_texts, location_ids, cache_run, extract_deletes, hardlink_groups, reflink_bytes, codec_report, make_documents, tree_archives, archive_round_trip,
    )
}

ORACLE = {
    "fixed_chunk_totals": f"WITH {_FIXED}, {_TOTALS}",
    "content_chunk_totals": f"{_CUTS}, {_TOTALS}",
    "content_index": f"{_CUTS} SELECT doc_id AS index_id, CAST(pos AS INTEGER) AS pos, CAST(b AS BIGINT) AS end_offset, chunk_id FROM c",
    "content_index_of_segments": f'{_CUTS} SELECT doc_id AS blob_id, CAST(pos AS INTEGER) AS pos, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", CAST(size AS BIGINT) AS size FROM c',
    "chunk_size_histogram": f"""{_CUTS}, h AS (SELECT least(greatest(CAST(floor((size - {SMALL.min}) / {_WIDTH}) AS INTEGER) + 1, 1), {_BUCKETS}) AS bucket FROM c)
        SELECT bucket, count(*) AS n, CAST(ceil({SMALL.min} + (bucket - 1) * {_WIDTH}) AS BIGINT) AS low FROM h GROUP BY bucket""",
    "make_documents": f"""{_CUTS}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, pos) AS k FROM c)
        SELECT doc_id AS index_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS archive_size, CAST(sum(size) // count(*) AS BIGINT) AS average_chunk, count_if(k = 1) AS chunks_written, count_if(k > 1) AS chunks_reused,
          CAST(count_if(k > 1) * 100 // count(*) AS BIGINT) AS reused_percent, 104 + 40 * count(*) AS index_size FROM r GROUP BY 1""",
    "fixed_chunk_reuse": f"""WITH {_FIXED}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, pos) AS k FROM c)
        SELECT doc_id AS blob_id, count_if(k = 1) AS chunks_written, count_if(k > 1) AS chunks_reused FROM r GROUP BY 1""",
    "fixed_index": f"WITH {_FIXED} SELECT doc_id AS index_id, pos, CAST(pos * {FIXED} + size AS BIGINT) AS end_offset, chunk_id FROM c",
    "payload_digests": "SELECT doc_id AS blob_id, sha256(encode(text)) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "round_trip": "SELECT count_if(strlen(text) > 0) AS n, count_if(strlen(text) > 0) AS same FROM documents",
    "byte_range": "SELECT doc_id AS blob_id, sha256(unhex(substr(hex(encode(text)), 2001, 3000))) AS digest, CAST(len(substr(hex(encode(text)), 2001, 3000)) // 2 AS BIGINT) AS bytes FROM documents WHERE strlen(text) > 1000",
    "index_sizes": f"WITH {_SIZED} SELECT index_id, pos, k AS chunk_id, size FROM sized",
    "index_totals": "SELECT index_id, count(DISTINCT pos) AS chunks, max(end_offset) AS blob_size, 104 + 40 * count(DISTINCT pos) AS index_size FROM index_items WHERE index_id IS NOT NULL AND pos IS NOT NULL GROUP BY 1",
    "index_violations": f"""WITH {_SIZED} SELECT index_id, pos, 'no_id' AS rule FROM sized WHERE k IS NULL UNION ALL SELECT index_id, pos, 'offset_not_increasing' FROM sized WHERE size <= 0
        UNION ALL SELECT index_id, pos, 'too_large' FROM sized LEFT JOIN (SELECT index_id, min(chunk_max) AS chunk_max FROM index_meta GROUP BY 1) USING (index_id) WHERE size > coalesce(chunk_max, 134217728) UNION ALL SELECT index_id, pos, 'size_unknown' FROM sized WHERE size IS NULL""",
    "chunk_at_offset": f"""WITH {_SPANS}, o AS (SELECT index_id, unnest(range(0, n, 1048576)) AS o FROM (SELECT index_id, max(end_offset) AS n FROM index_items GROUP BY 1) WHERE n > 0)
        SELECT index_id, o AS "offset", pos, o - a AS skip FROM o JOIN spans USING (index_id) WHERE a <= o AND o < b""",
    "range_of_indices": f"WITH {_SPANS} SELECT index_id, pos, greatest(a, 1000000) - a AS skip, least(b, 2000000) - greatest(a, 1000000) AS take FROM spans WHERE a < 2000000 AND b > 1000000",
    "collection_usage": f'SELECT count(k) AS "references", count(DISTINCT k) AS chunks FROM {_I}',
    "gc_plan": f"SELECT store_id, k AS chunk_id, size FROM {_S} WHERE k NOT IN (SELECT k FROM {_I} WHERE k IS NOT NULL)",
    "gc_totals": f"""WITH m AS (SELECT DISTINCT k, k IN (SELECT k FROM {_I} WHERE k IS NOT NULL) AS used FROM {_S}), p AS (SELECT k[1:4] AS dir, count_if(NOT used) AS r, count_if(used) AS kept FROM m GROUP BY 1)
        SELECT CAST(sum(r) AS BIGINT) AS removed, CAST(sum(kept) AS BIGINT) AS kept, count_if(kept = 0) AS folders_emptied FROM p""",
    "prefetch": f"SELECT DISTINCT k AS chunk_id FROM {_I} WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM {_S})",
    "present_items": f"SELECT arrival_no FROM {_I} WHERE k IN (SELECT k FROM {_S})",
    "push_missing": f"SELECT tree_id, count(DISTINCT k) AS to_send FROM {_I} JOIN index_meta USING (index_id) WHERE k IS NOT NULL AND k NOT IN ({_MAIN}) GROUP BY 1",
    "store_after_put": f"SELECT DISTINCT k AS chunk_id, k[1:4] || '/' || k || '.cacnk' AS path FROM {_I} WHERE k IS NOT NULL AND k NOT IN ({_MAIN})",
    "store_tombstones": f"SELECT false AS missing, count(*) AS n FROM {_S} UNION ALL SELECT true, count(DISTINCT k) FROM {_I} WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM {_S})",
    "resolve_providers": f"""WITH {_SIZED}, r AS (SELECT CASE WHEN k IN ({_MAIN}) THEN 'write-store' WHEN k IN ({_EXTRA}) THEN 'read-store' END AS provider, size FROM sized WHERE k IS NOT NULL)
        SELECT provider, count(*) AS requests, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(count(*) * 100 // (SELECT count(*) FROM r) AS BIGINT) AS percent FROM r GROUP BY 1""",
    "resolve_items": f"SELECT arrival_no, CASE WHEN k IN ({_MAIN}) THEN 'write-store' WHEN k IN ({_EXTRA}) THEN 'read-store' END AS provider FROM {_I} WHERE k IS NOT NULL",
    "seed_delta": f"""WITH {_SIZED}, o AS (SELECT index_id, tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY made_at, index_id) AS n FROM index_meta),
        t AS (SELECT tree_id, n, k, max(size) AS size FROM sized JOIN o USING (index_id) WHERE k IS NOT NULL GROUP BY ALL)
        SELECT a.tree_id, CAST(a.n AS INTEGER) AS n, count(*) AS chunks, count(b.k) AS from_seed, count(*) - count(b.k) AS to_fetch, CAST(coalesce(sum(CASE WHEN b.k IS NULL THEN a.size END), 0) AS BIGINT) AS bytes_to_fetch
        FROM t a LEFT JOIN t b ON b.tree_id = a.tree_id AND b.n = a.n - 1 AND b.k = a.k WHERE a.n > 1 GROUP BY ALL""",
    "covering_flags": f"""WITH a AS (SELECT tree_id, bit_or(feature_flags) AS f FROM index_meta GROUP BY 1),
        b AS (SELECT *, CASE WHEN f & {_F['acl']} <> 0 AND f & 7 = 0 THEN f | 6 ELSE f END AS x FROM a), c AS (SELECT *, CASE WHEN x & 2 <> 0 THEN x & ~1 ELSE x END AS y FROM b),
        e AS (SELECT *, CASE WHEN y & 32 <> 0 THEN y & ~88 WHEN y & 16 <> 0 THEN y & ~72 WHEN y & 8 <> 0 THEN y & ~64 ELSE y END AS z FROM c),
        g AS (SELECT *, CASE WHEN z & {_F['acl']} <> 0 THEN z & ~384 WHEN z & 256 <> 0 THEN z & ~128 ELSE z END AS u FROM e),
        h AS (SELECT *, CASE WHEN u < 0 THEN u & ~{_F['flag-nodump']} ELSE u END AS v FROM g)
        SELECT tree_id, f AS flags, CASE WHEN f & {_UNKNOWN} = 0 THEN CASE WHEN v & {_F['subvolume-ro']} <> 0 THEN v | {_F['subvolume']} ELSE v END END AS normalized,
          CASE WHEN f & {_UNKNOWN} <> 0 THEN NULL WHEN f & 32 <> 0 THEN 1 WHEN f & 16 <> 0 THEN 1000 WHEN f & 8 <> 0 THEN 1000000000 WHEN f & 64 <> 0 THEN 2000000000 END AS granularity_ns FROM h""",
    "flag_names": f"SELECT index_id, CASE WHEN feature_flags & {_UNKNOWN} = 0 THEN {_NAMES} END AS names FROM index_meta",
    "locator_classes": rf"""SELECT tree_id, {locators.locator_class_sql('locator')} AS class, CASE WHEN regexp_matches(locator, '^file://(localhost)?/') THEN url_decode(regexp_replace(locator, '^file://(localhost)?', '')) ELSE locator END AS path FROM trees""",
    "locator_siblings": rf"""SELECT tree_id, CASE {locators.locator_class_sql('locator')} WHEN 'url' THEN regexp_replace(regexp_replace(locator, '[;?].*$', ''), '/[^/]*$', '/default.castr')
        WHEN 'ssh' THEN CASE WHEN contains(locator, '/') THEN regexp_replace(locator, '/[^/]*$', '/default.castr') ELSE regexp_replace(locator, ':.*$', ':default.castr') END
        WHEN 'path' THEN CASE WHEN contains(locator, '/') THEN regexp_replace(locator, '/[^/]*$', '/default.castr') ELSE 'default.castr' END END AS store, coalesce(ends_with(locator, '-img'), false) AS is_image FROM trees""",
    "size_texts": """SELECT size, count(*) AS n, CASE WHEN size >= 1073741824 THEN (size // 1073741824)::VARCHAR || '.' || (size * 10 // 1073741824 % 10)::VARCHAR || 'G'
        WHEN size >= 1048576 THEN (size // 1048576)::VARCHAR || '.' || (size * 10 // 1048576 % 10)::VARCHAR || 'M' WHEN size >= 1024 THEN (size // 1024)::VARCHAR || '.' || (size * 10 // 1024 % 10)::VARCHAR || 'K' ELSE size::VARCHAR || 'B' END AS text FROM locations WHERE size IS NOT NULL GROUP BY size""",
    "list_snapshots": f"WITH {_ENTRIES} SELECT snapshot_id, path, {_LINE} || ' ' || CASE WHEN path = '' THEN '.' ELSE {_ESCAPED} END AS line FROM moded",
    "manifest_snapshots": f"""WITH {_ENTRIES} SELECT snapshot_id, path, concat_ws(' ', CASE WHEN path = '' THEN '.' ELSE {_ESCAPED} END, CASE WHEN designator = 'e' THEN 'type=dir' ELSE 'type=file' END, 'mode=' || (perm // 512)::VARCHAR || (perm // 64 % 8)::VARCHAR || (perm // 8 % 8)::VARCHAR || (perm % 8)::VARCHAR,
        CASE WHEN designator <> 'e' THEN 'size=' || size::VARCHAR END, 'time=' || (mtime // 1000000000)::VARCHAR || '.' || lpad((mtime % 1000000000)::VARCHAR, 9, '0')) AS line FROM moded""",
    "entry_violations": f"WITH {_ENTRIES} SELECT snapshot_id, path, 'file_without_payload' AS rule FROM entries WHERE designator <> 'e' AND size IS NULL UNION ALL SELECT snapshot_id, path, 'name_too_long' FROM entries WHERE strlen(regexp_extract(path, '[^/]*$')) > 255 UNION ALL SELECT snapshot_id, path, 'bad_name' FROM entries WHERE regexp_extract(path, '[^/]*$') = '..'",
    "excluded_paths": rf"""WITH {_ENTRIES}, p AS (SELECT snapshot_id, path, designator, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM entries WHERE path <> ''),
        s AS (SELECT snapshot_id, path, array_to_string(string_split(path, '/')[1:k], '/') AS anc, designator = 'e' OR k < len(string_split(path, '/')) AS is_dir FROM p), n AS (SELECT *, regexp_extract(anc, '[^/]*$') AS name FROM s)
        SELECT DISTINCT snapshot_id, path FROM n WHERE (regexp_full_match(name, '[^.].*\.tmp|\.tmp') AND name[1] <> '.' OR regexp_full_match(name, '.*\.gz') AND name[1] <> '.' OR anc = 'cache' AND is_dir OR regexp_full_match(anc, 'doc/logs/[^/]*\.py') AND name[1] <> '.' OR anc = 'drafts' AND is_dir)
          AND NOT regexp_full_match(name, 'report.*\.gz')""",
    "walk_order": f"WITH {_ENTRIES} SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY list_transform(string_split(path, '/'), lambda x: hex(encode(x)))) - 1 AS place, path FROM entries",
    "folder_tables": f"WITH {_ENTRIES} SELECT snapshot_id, regexp_replace(path, '/?[^/]*$', '') AS parent, CAST(count(*) AS INTEGER) AS names FROM entries WHERE path <> '' GROUP BY ALL",
    "location_texts": f"""SELECT snapshot_id, {_CANON} AS path, {_CANON} || '+' || designator || start_offset::VARCHAR || CASE WHEN size > 0 THEN ':' || size::VARCHAR ELSE '' END
        || CASE WHEN mtime IS NULL THEN '' ELSE '@' || coalesce(inode, 0)::VARCHAR || '.' || mtime::VARCHAR || coalesce('.' || (generation::BIGINT & 4294967295)::VARCHAR, '') END AS text, true AS same FROM locations""",
    "location_ids": f"SELECT snapshot_id, path, {locations.location_id_sql('path', 'designator', 'start_offset', None, 'mtime', 'inode', 'generation')} AS location_id FROM locations",
    "cache_run": f"""WITH {_RUNS}, r AS (SELECT tree_id, n, path, arg_max(struct_pack(s := size, m := mtime, i := inode), delivered_at) AS r FROM (SELECT tree_id, n, {_CANON} AS path, size, mtime, inode, delivered_at FROM locations JOIN ranked USING (snapshot_id)) GROUP BY ALL),
        v AS (SELECT a.tree_id, a.n, CASE WHEN b.path IS NULL THEN 'miss' WHEN a.r.s IS NOT DISTINCT FROM b.r.s AND a.r.m IS NOT DISTINCT FROM b.r.m AND a.r.i IS NOT DISTINCT FROM b.r.i THEN 'hit' ELSE 'invalidated' END AS v FROM r a LEFT JOIN r b ON b.tree_id = a.tree_id AND b.n = a.n - 1 AND b.path = a.path WHERE a.n > 1)
        SELECT tree_id, CAST(n AS INTEGER) AS n, count_if(v = 'hit') AS hits, count_if(v = 'miss') AS misses, count_if(v = 'invalidated') AS invalidated, count_if(v <> 'hit') AS added FROM v GROUP BY ALL""",
    "extract_deletes": f"""WITH {_RUNS}, r AS (SELECT DISTINCT tree_id, n, last, {_CANON} AS path FROM locations JOIN ranked USING (snapshot_id))
        SELECT a.tree_id, CAST(a.n + 1 AS INTEGER) AS n, a.path FROM r a WHERE a.n < a.last AND NOT EXISTS (SELECT 1 FROM r b WHERE b.tree_id = a.tree_id AND b.n = a.n + 1 AND b.path = a.path)""",
    "hardlink_groups": """WITH f AS (SELECT doc_id AS id, strlen(text) AS size, sha256(coalesce(source, '') || chr(10) || text) AS digest FROM documents WHERE text IS NOT NULL)
        SELECT digest, min(id) AS id, count(*) AS files, CAST((count(*) - 1) * max(size) AS BIGINT) AS shared_bytes FROM f GROUP BY 1 HAVING count(*) > 1""",
    "reflink_bytes": f"""WITH {_SPANS}, k AS (SELECT * FROM spans WHERE k IS NOT NULL), f AS (SELECT k, arg_min(struct_pack(i := index_id, p := pos, a := a), (index_id, pos)) AS f FROM k GROUP BY k),
        m AS (SELECT k.index_id, k.a AS t, f.a AS s, k.b - k.a AS n FROM k JOIN f USING (k) WHERE k.index_id <> f.i OR k.pos <> f.p)
        SELECT index_id, CAST(sum(CASE WHEN t % 4096 = s % 4096 AND (t + n) // 4096 * 4096 > (t + 4095) // 4096 * 4096 THEN (t + n) // 4096 * 4096 - (t + 4095) // 4096 * 4096 ELSE 0 END) AS BIGINT) AS bytes FROM m GROUP BY 1""",
    "archive_round_trip": f"""WITH {_ENTRIES}, e AS (SELECT DISTINCT snapshot_id, path, CASE WHEN designator = 'e' THEN 'dir' ELSE 'file' END AS kind FROM entries WHERE path <> ''),
        a AS (SELECT DISTINCT snapshot_id, array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT snapshot_id, path, unnest(range(0, len(string_split(path, '/')))) AS k FROM e)),
        u AS (SELECT snapshot_id, path, kind FROM e UNION ALL SELECT snapshot_id, path, 'dir' FROM a ANTI JOIN e USING (snapshot_id, path)) SELECT snapshot_id, kind, count(*) AS n, count(*) AS same FROM u GROUP BY ALL""",
    "codec_report": f"SELECT codec, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM {_S} WHERE k IS NOT NULL GROUP BY 1",
}
