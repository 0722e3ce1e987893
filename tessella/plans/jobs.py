"""Queries of whole jobs: files, stores, archives, codecs and streams, written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ff
from ..functions import listing
from ..functions.chunk_ids import format_id
from ..functions.codecs import PREFERRED, compress, decompress
from ..operators import chunking, store, tree
from ..session import new_path, spread, written
from ..sources import archives, index_files, stores
from ..streaming import chunker, exchange
from . import table, verbs
from .nodes import _NODES
from .reference import _CUTS, _FIXED, _I, _LINE, _MAIN, _S, FIXED, SMALL, _archived, _blobs, _by_snapshot, _items, _stores, _trees

SHA256 = verbs.Options(digest="sha256", sizes=SMALL)


def source_streams(spark, d):
    """SHA-256 of each source's messages as one stream, in their order."""
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.encode("text", "utf-8").alias("data"))
    return chunking.stream_digest(docs, ["source"], "doc_id")


def codec_round_trips(spark, d):
    """Every message in each codec: what its first bytes tell, and the digest of what comes out again."""
    blobs = spread(_blobs(spark, d)).filter("data IS NOT NULL")
    each = None
    for codec in ["none", *PREFERRED]:
        one = blobs.select("blob_id", F.lit(codec).alias("codec"), compress(F.col("data"), codec).alias("packed"))
        each = one if each is None else each.unionByName(one)
    out = each.withColumn("data", decompress(F.col("packed")))
    found = F.when(F.col("codec") != "none", listing.compression_of(F.col("packed")))
    return out.select("blob_id", "codec", found.alias("found"), F.sha2("data", 256).alias("digest"))


PAGE = 16384


def sparse_bytes(spark, d):
    """Bytes that needn't be stored if each message is a file of whole 16 KiB pages, the last filled up with zeros."""
    n = F.octet_length("text")
    padded = table(spark, d, "documents").filter(n > 0).select(F.col("doc_id").alias("blob_id"), F.rpad(F.encode("text", "utf-8"), F.ceil(n / PAGE).cast("int") * PAGE, F.lit(b"\0")).alias("data"))
    return spread(padded).select("blob_id", chunking.hole_bytes(F.col("data")).alias("holes"))


def _damaged_store(spark: SparkSession, d: str) -> DataFrame:
    """A store of the fixed chunks of all messages: those whose id begins with 0 are damaged, those with 1 lost."""
    chunks = chunking.fixed_chunks(_blobs(spark, d), FIXED)
    one = chunks.groupBy("chunk_id").agg(F.any_value("data").alias("data")).filter(~F.col("chunk_id").startswith("1"))
    return written(one.withColumn("data", F.when(F.col("chunk_id").startswith("0"), F.concat("data", F.lit(b"?"))).otherwise(F.col("data"))), "damaged")


def verified_chunks(spark, d):
    """Which stored chunks still have the digest that their id states, as the store tells it and as the receiver of a response does."""
    return store.verified(_damaged_store(spark, d)).select("chunk_id", "intact", exchange.valid_response(F.unhex("chunk_id"), F.col("data")).alias("valid"))


def verified_indices(spark, d):
    """The state of every item of the fixed index against that store."""
    return verbs.verify(chunking.index_of(chunking.fixed_chunks(_blobs(spark, d), FIXED)), _damaged_store(spark, d), SHA256)


def store_after_removal(spark, d):
    """The stores without all chunks that some index needs."""
    return store.remove(_stores(spark, d), _items(spark, d)).select("store_id", format_id(F.col("chunk_id")).alias("chunk_id"), "size")


def made_and_extracted(spark, d):
    """Every message made into an index and a store, and extracted again with that store only as the second provider, the first one being damaged: what came out."""
    made = verbs.make_blobs(_blobs(spark, d), options=SHA256)
    kept = written(made.new_chunks.select("chunk_id", decompress(F.col("data")).alias("data")), "kept")
    bad = kept.select("chunk_id", F.concat("data", F.lit(b"!")).alias("data"))
    blobs, _ = verbs.extract_blobs(made.index, [("seed", bad), ("write-store", kept)], SHA256)
    return blobs.select("blob_id", "complete", F.sha2("data", 256).alias("digest"))


def pulled_messages(spark, d):
    """Who served how much when all messages are pulled by their fixed index: a seed has the chunks whose ids begin with 0 to 7, a store those with 8 to b, only the remote store has all."""
    chunks = written(chunking.fixed_chunks(_blobs(spark, d), FIXED), "pull")
    have = written(chunks.groupBy("chunk_id").agg(F.any_value("data").alias("data")), "have")
    some = lambda digits: have.filter(F.substring("chunk_id", 1, 1).isin(*digits))
    got = verbs.pull(chunking.index_of(chunks), [("seed", some("01234567"))], [("write-store", some("89ab"))], have, SHA256)
    return got.report


def walk_events(spark, d):
    """What a walk over the tree of every snapshot reports, in order."""
    return _by_snapshot(tree.walk_events(_trees(spark, d)))


def dispatched_messages(spark, d):
    """What receivers do with the messages of sessions, one for each index: the hello of a client, a request for each of its items, goodbye, and one more request."""
    items = _items(spark, d).select(F.col("index_id").alias("session"), "arrival_no")
    asked = items.select("session", F.col("arrival_no").alias("seq"), F.lit("request").alias("kind"), F.lit(0).cast("long").alias("flags"))
    heads = items.select("session").distinct()
    extra = lambda seq, kind, flags: heads.select("session", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(flags).cast("long").alias("flags"))
    # Every other session asks for archives only, so its requests for chunks aren't its to send.
    hello = heads.select("session", F.lit(-1).cast("long").alias("seq"), F.lit("hello").alias("kind"), F.when(F.pmod("session", F.lit(2)) == 0, exchange.OPERATIONS["pull-chunks"]).otherwise(exchange.OPERATIONS["pull-archive"]).cast("long").alias("flags"))
    sent = asked.unionByName(hello).unionByName(extra(1 << 40, "goodbye", None)).unionByName(extra((1 << 40) + 1, "request", 0)).withColumn("side", F.lit("client"))
    return exchange.dispatched(sent).groupBy("session", "kind", "action").agg(F.count(F.lit(1)).alias("n"))


def _mail_tree(spark: SparkSession, d: str) -> DataFrame:
    """The messages as a tree: a folder for each thousand of them, a file for each message."""
    docs = table(spark, d, "documents").select((F.expr("doc_id div 1000")).cast("string").alias("dir"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    files = docs.select(F.concat_ws("/", "dir", "doc_id").alias("path"), F.lit("file").alias("kind"), "content", F.lit(0o100644).alias("mode"), (F.col("doc_id") * 1_000_000_007).alias("mtime_ns"))
    none = lambda kind: F.lit(None).cast(kind)
    folders = docs.select(F.col("dir").alias("path")).distinct().unionByName(spark.createDataFrame([("",)], "path string"))
    folders = folders.select("path", F.lit("dir").alias("kind"), none("binary").alias("content"), F.lit(0o040755).alias("mode"), F.lit(5_000_000_000).alias("mtime_ns"))
    return files.unionByName(folders).select(F.lit(1).cast("long").alias("tree_id"), "*", F.length("content").cast("long").alias("size"))


def made_and_extracted_tree(spark, d):
    """That tree made into an archive in parts, cut, stored, resolved and unpacked as its chunks come: every entry as it came out."""
    made = verbs.make_trees(written(_mail_tree(spark, d), "mail-tree"), options=SHA256, segment=1 << 20)
    kept = written(made.new_chunks.select("chunk_id", decompress(F.col("data")).alias("data")), "kept")
    entries, _ = verbs.extract_trees(made.index, [("write-store", kept)], SHA256)
    return entries.select("path", "kind", "mode", "mtime_ns", "size", F.sha2("content", 256).alias("digest"))


def scanned_tree(spark, d):
    """That tree created in a folder and scanned again: kind, mode, time, size and digest of every entry."""
    at = new_path(spark, "mail").removeprefix("file://")
    archives.extract(written(_mail_tree(spark, d), "mail-tree"), at)
    got = archives.scan_tree(spark, at)
    return got.select("path", "kind", "mode", "mtime_ns", "size", F.sha2("content", 256).alias("digest"))


def archive_files(spark, d):
    """That tree written as an archive file and read by the archive source, contents left unread."""
    at = new_path(spark, "archive").removeprefix("file://")
    done = archives.write_archives(archives.archive_parts(written(_mail_tree(spark, d), "mail-tree")), at)
    written(done, "archives")
    return archives.read_archives(spark, at, content=False).select("path", "kind", "mode", "mtime_ns", "size")


def index_file_items(spark, d):
    """The fixed index of all messages written as index files and read again, by the source and by Spark's own functions."""
    at = new_path(spark, "indices").removeprefix("file://")
    items = chunking.index_of(chunking.fixed_chunks(_blobs(spark, d), FIXED)).withColumn("chunk_id", F.unhex("chunk_id"))
    written(index_files.write_indices(items, at, sizes=(FIXED, FIXED, FIXED)), "index-files")
    one = index_files.read_indices(spark, at).select("index_id", "pos", "end_offset", "chunk_id", F.lit("source").alias("reader"))
    two = index_files.read_indices_builtin(spark, f"file://{at}").withColumn("reader", F.lit("functions"))
    return one.unionByName(two).select(F.col("index_id").cast("long").alias("index_id"), "pos", "end_offset", format_id(F.col("chunk_id")).alias("chunk_id"), "reader")


def store_files(spark, d):
    """The fixed chunks of all messages put into a store of files twice, and what is read from it."""
    at = new_path(spark, "store").removeprefix("file://")
    chunks = written(chunking.fixed_chunks(_blobs(spark, d), FIXED).select("chunk_id", "data"), "to-store")
    for _ in range(2):
        written(stores.write_store(chunks, at), "put")
    return stores.read_store(spark, f"file://{at}").select("chunk_id", F.sha2("data", 256).alias("digest"), F.length("data").cast("long").alias("bytes"))


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives of all that is there now, as a table."""
    spark = stream.sparkSession
    at = new_path(spark, name)
    stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", new_path(spark, f"{name}-progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def streamed_index(spark, d):
    """The content-defined chunks of every message, which comes as a stream of parts of 3,000 bytes in no order."""
    pieces = chunking.fixed_chunks(_blobs(spark, d), 3000).select(F.col("blob_id").cast("string").alias("stream_id"), F.col("pos").cast("long").alias("seq"), "data", F.length("data").alias("n"), "end")
    ends = _blobs(spark, d).select(F.col("blob_id").cast("string").alias("stream_id"), F.length("data").cast("long").alias("whole"))
    parts = pieces.join(ends, "stream_id").select("stream_id", "seq", "data", (F.col("end") == F.col("whole")).alias("last"))
    at = new_path(spark, "parts")
    parts.repartition(3, F.xxhash64("stream_id", "seq")).write.parquet(at)
    source = spark.readStream.schema("stream_id string, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(at)
    return _drained(chunker.chunk_stream(source, SMALL), "chunked").select(F.col("stream_id").cast("long").alias("blob_id"), "pos", "start", "end", "size", "chunk_id")


def followed_items(spark, d):
    """Items of indices as they arrive in a folder, followed file by file."""
    at = new_path(spark, "arriving")
    _items(spark, d).select(F.col("index_id").cast("string").alias("index_id"), "pos", "end_offset", format_id(F.col("chunk_id")).alias("chunk_id")).repartition(4).write.parquet(at)
    return _drained(exchange.follow_index(spark, at, 2), "followed").select(F.col("index_id").cast("long").alias("index_id"), "pos", "end_offset", "chunk_id")


def streamed_requests(spark, d):
    """Requests for the chunks of all items as a stream: each passes once as low, and once as high if it is wanted at the head of an index."""
    at = new_path(spark, "requests")
    asked = _items(spark, d).filter("chunk_id IS NOT NULL").select(format_id(F.col("chunk_id")).alias("chunk_id"), (F.col("pos") == 0).alias("high"), F.lit("2018-01-01").cast("timestamp").alias("asked_at"))
    asked.repartition(3, "chunk_id").write.parquet(at)
    source = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(at)
    return _drained(exchange.new_requests(source, "1000 days"), "asked").select("chunk_id", "high")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    wanted = _items(spark, d).filter("chunk_id IS NOT NULL").select("chunk_id", (F.col("pos") == 0).alias("high"), F.col("arrival_no").alias("seq"))
    return exchange.request_queue(wanted)


def request_order(spark, d):
    """The order in which the chunks of all items are asked for: those at the head of an index first."""
    return _queue(spark, d).select(format_id(F.col("chunk_id")).alias("chunk_id"), "high", "place")


def request_frames(spark, d):
    """Those requests as frames of at most 64 KiB, encoded and decoded again: chunks and bytes of each."""
    frames = exchange.request_frames(written(_queue(spark, d), "queue"))
    sent = written(exchange.frame_bytes(frames), "frames")
    return sent.select(F.col("frame_no"), F.length("frame").cast("long").alias("bytes"), F.expr("(length(frame) - 24) div 32").alias("chunks"))


def received_requests(spark, d):
    """What the other side reads from those frames."""
    frames = exchange.frame_bytes(exchange.request_frames(written(_queue(spark, d), "queue")))
    return exchange.read_frames(frames).select("kind", (F.col("flags") == 1).alias("high"), format_id(F.col("chunk_id")).alias("chunk_id"))


def responses(spark, d):
    """The kind of response to every item's request, from the main store."""
    held = _stores(spark, d).filter(F.col("store_id") == "default.castr").select("chunk_id", F.col("chunk_id").alias("data")).distinct()
    asked = _items(spark, d).filter("chunk_id IS NOT NULL")
    return exchange.responses(asked, held).groupBy("chunk_id", "kind").agg(F.count(F.lit(1)).alias("n")).select(format_id(F.col("chunk_id")).alias("chunk_id"), "kind", "n")


def stat_texts(spark, d):
    """The labelled lines about every entry of all snapshots."""
    return _by_snapshot(verbs.stat_block(_trees(spark, d).select("tree_id", "path", "mode", F.col("mtime").alias("mtime_ns"), "size", F.col("start_offset").alias("start"))))


def entry_digest_pairs(spark, d):
    """SHA-256 of the content of every file of the mail tree, and of all records of its entry."""
    return verbs.entry_digests(spread(_mail_tree(spark, d)), algorithm="sha256").select("path", "payload_digest", "hardlink_digest")


def folder_digests(spark, d):
    """Of every snapshot that has a folder doc: whether the digest of that folder within the archive of the snapshot's tree is the one of an archive of the folder alone. Files are empty."""
    full = _archived(spark, d)
    below = full.filter("path = 'doc' OR startswith(path, 'doc/')").withColumn("path", F.when(F.col("path") == "doc", "").otherwise(F.expr("substring(path, 5)")))
    inside = verbs.digests_at(archives.archives(full), full, "doc", "sha256")
    alone = verbs.digests_at(archives.archives(below), below, "", "sha256")
    return _by_snapshot(inside.alias("i").join(alone.alias("a"), "tree_id").select("tree_id", (F.col("i.digest") == F.col("a.digest")).alias("same")))


def snapshot_diffs(spark, d):
    """What a comparison of each snapshot with the one before by size and kind tells."""
    from pyspark.sql import Window

    order = table(spark, d, "snapshots").withColumn("n", F.row_number().over(Window.partitionBy("tree_id").orderBy("snap_no"))).select(F.col("snapshot_id").alias("s"), F.col("tree_id").alias("t"), "n")
    rows = _trees(spark, d).join(order, F.col("tree_id") == F.col("s")).select(F.struct("t", "n").alias("tree_id"), "path", "size", "kind", "t", "n")
    later = order.select(F.col("t"), (F.col("n") + 1).alias("n")).join(order.select("t", "n"), ["t", "n"]).select("t", "n")
    was = rows.withColumn("n", F.col("n") + 1).join(later, ["t", "n"], "left_semi").withColumn("tree_id", F.struct("t", "n"))
    cur = rows.filter("n > 1")
    return verbs.diff(was, cur, ["size", "kind"]).select("tree_id.t", "tree_id.n", "path", "change_kind").withColumnRenamed("t", "tree_id")


QUERIES = {
    f.__name__: f
    for f in (
        source_streams, codec_round_trips, sparse_bytes, verified_chunks, verified_indices, store_after_removal, made_and_extracted, made_and_extracted_tree, scanned_tree, archive_files, index_file_items, store_files,
        pulled_messages, walk_events, dispatched_messages, streamed_index, followed_items, streamed_requests, request_order, request_frames, received_requests, responses, stat_texts, entry_digest_pairs, folder_digests, snapshot_diffs,
    )
}


def _le(x: str, width: int = 8) -> str:
    digits = f"lpad(printf('%x', {x}), 16, '0')"
    return "(" + " || ".join(f"substr({digits}, {16 - 2 * k - 1}, 2)" for k in range(width)) + ")"


def _le_const(v: int) -> str:
    return "'" + (v & (1 << 64) - 1).to_bytes(8, "little").hex() + "'"


_MAIL = """files AS (SELECT (doc_id // 1000)::VARCHAR || '/' || doc_id::VARCHAR AS path, 'file' AS kind, 33188 AS mode, doc_id * 1000000007 AS mtime_ns, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS digest FROM documents),
  tree AS (SELECT * FROM files UNION ALL SELECT DISTINCT (doc_id // 1000)::VARCHAR, 'dir', 16877, CAST(5000000000 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM documents UNION ALL SELECT '', 'dir', 16877, CAST(5000000000 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR))"""
_QUEUE = f"""per AS (SELECT k, bool_or(pos IS NOT NULL AND pos = 0) AS high, min(arrival_no) FILTER (WHERE pos = 0) AS h, min(arrival_no) AS l FROM {_I} WHERE k IS NOT NULL GROUP BY k),
  queue AS (SELECT k AS chunk_id, high, row_number() OVER (ORDER BY high DESC, CASE WHEN high THEN h ELSE l END, k) - 1 AS place FROM per)"""
_FRAMES = f"WITH {_QUEUE}, f AS (SELECT chunk_id, high, row_number() OVER (PARTITION BY high ORDER BY place) - 1 AS own, count_if(high) OVER () AS n_high FROM queue), g AS (SELECT CASE WHEN high THEN own // 2047 ELSE own // 2047 + (n_high + 2046) // 2047 END + 1 AS frame_no, high, chunk_id FROM f)"

ORACLE = {
    "source_streams": "SELECT coalesce(source, '') AS source, sha256(coalesce(string_agg(text, '' ORDER BY doc_id), '')) AS digest, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "codec_round_trips": "SELECT doc_id AS blob_id, codec, CASE WHEN codec <> 'none' THEN codec END AS found, sha256(text) AS digest FROM documents, (VALUES ('none'), ('zstd'), ('gzip'), ('xz')) c(codec) WHERE text IS NOT NULL",
    "sparse_bytes": f"WITH n AS (SELECT doc_id AS blob_id, ({PAGE} - strlen(text) % {PAGE}) % {PAGE} AS pad FROM documents WHERE strlen(text) > 0) SELECT blob_id, CAST(CASE WHEN pad >= 4096 THEN pad ELSE 0 END AS BIGINT) AS holes FROM n",
    "verified_chunks": f"WITH {_FIXED} SELECT DISTINCT chunk_id, chunk_id[1] <> '0' AS intact, chunk_id[1] <> '0' AS valid FROM c WHERE chunk_id[1] <> '1'",
    "verified_indices": f"WITH {_FIXED} SELECT doc_id AS index_id, pos, CASE chunk_id[1] WHEN '0' THEN 'damaged' WHEN '1' THEN 'missing' ELSE 'ok' END AS state FROM c",
    "store_after_removal": f"SELECT store_id, k AS chunk_id, size FROM {_S} WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM {_I} WHERE k IS NOT NULL)",
    "made_and_extracted": "SELECT doc_id AS blob_id, true AS complete, sha256(text) AS digest FROM documents WHERE strlen(text) > 0",
    "pulled_messages": f"""WITH {_FIXED}, p AS (SELECT CASE WHEN chunk_id[1] < '8' THEN 'seed' WHEN chunk_id[1] IN ('8', '9', 'a', 'b') THEN 'write-store' ELSE 'remote' END AS provider, size FROM c)
        SELECT provider, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes, CAST(count(*) * 100 // (SELECT count(*) FROM p) AS BIGINT) AS percent FROM p GROUP BY 1""",
    "walk_events": f"""WITH {_NODES}, w AS (SELECT snapshot_id, path, kind = 'dir' AS is_dir, size, CASE WHEN path = '' THEN [] ELSE list_transform(string_split(path, '/'), lambda x: '0' || hex(encode(x))) END AS k FROM nodes),
        e AS (SELECT snapshot_id, path, 'next-file' AS event, CAST(NULL AS BIGINT) AS bytes, k FROM w UNION ALL SELECT snapshot_id, path, 'payload', size, list_append(k, 'y') FROM w WHERE NOT is_dir AND size IS NOT NULL UNION ALL SELECT snapshot_id, path, 'done-file', NULL, list_append(k, 'z') FROM w)
        SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY k) - 1 AS place, event, path, bytes FROM e""",
    "dispatched_messages": """WITH s AS (SELECT index_id AS session, count(*) AS n FROM index_items GROUP BY 1) SELECT session, 'hello' AS kind, 'begin' AS action, 1 AS n FROM s UNION ALL SELECT session, 'request', CASE WHEN session % 2 = 0 THEN 'take' ELSE 'error' END, n FROM s
        UNION ALL SELECT session, 'goodbye', 'end', 1 FROM s UNION ALL SELECT session, 'request', 'ignore', 1 FROM s""",
    "made_and_extracted_tree": f"WITH {_MAIL} SELECT path, kind, mode, mtime_ns, size, digest FROM tree",
    "scanned_tree": f"WITH {_MAIL} SELECT path, kind, mode, mtime_ns, size, digest FROM tree",
    "archive_files": f"WITH {_MAIL} SELECT path, kind, mode, mtime_ns, size FROM tree",
    "index_file_items": f"WITH {_FIXED} SELECT doc_id AS index_id, pos, CAST(pos * {FIXED} + size AS BIGINT) AS end_offset, chunk_id, reader FROM c, (VALUES ('source'), ('functions')) r(reader)",
    "store_files": f"WITH {_FIXED} SELECT chunk_id, chunk_id AS digest, CAST(max(size) AS BIGINT) AS bytes FROM c GROUP BY chunk_id",
    "streamed_index": f'{_CUTS} SELECT doc_id AS blob_id, CAST(pos AS INTEGER) AS pos, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", CAST(size AS BIGINT) AS size, chunk_id FROM c',
    "followed_items": f"SELECT index_id, pos, end_offset, k AS chunk_id FROM {_I}",
    "streamed_requests": f"SELECT DISTINCT k AS chunk_id, coalesce(pos = 0, false) AS high FROM {_I} WHERE k IS NOT NULL",
    "request_order": f"WITH {_QUEUE} SELECT chunk_id, high, place FROM queue",
    "request_frames": f"{_FRAMES} SELECT frame_no, CAST(24 + 32 * count(*) AS BIGINT) AS bytes, count(*) AS chunks FROM g GROUP BY frame_no",
    "received_requests": f"{_FRAMES} SELECT 'request' AS kind, high, chunk_id FROM g",
    "responses": f"SELECT k AS chunk_id, CASE WHEN k IN ({_MAIN}) THEN 'chunk' ELSE 'missing' END AS kind, count(*) AS n FROM {_I} WHERE k IS NOT NULL GROUP BY ALL",
    "stat_texts": rf"""WITH {_NODES}, m AS (SELECT *, CASE WHEN kind = 'dir' THEN 'e' ELSE 'p' END AS designator, coalesce(inode % 4096, 420) AS perm FROM nodes)
        SELECT snapshot_id, path, concat_ws(chr(10), '    File: ' || CASE WHEN path = '' THEN '.' ELSE (SELECT string_agg(CASE WHEN v <= 32 OR v >= 127 OR v IN (92, 35) THEN '\' || (v // 64)::VARCHAR || (v // 8 % 8)::VARCHAR || (v % 8)::VARCHAR ELSE chr(v) END, '' ORDER BY i)
          FROM (SELECT i, CAST('0x' || substr(hex(encode(path)), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS v FROM range(0, strlen(path)) t(i))) END, '    Mode: ' || {_LINE}, '  Offset: ' || start_offset::VARCHAR,
          '    Time: ' || strftime(make_timestamp(mtime // 1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad((mtime % 1000000000)::VARCHAR, 9, '0'), '    Size: ' || size::VARCHAR) AS text FROM m""",
    "entry_digest_pairs": f"""SELECT (doc_id // 1000)::VARCHAR || '/' || doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS payload_digest,
        sha256(unhex({_le_const(64)} || {_le_const(listing.RECORDS['entry'])} || {_le_const(ff.DEFAULT)} || {_le_const(0o100644)} || {_le_const(0)} || {_le_const(0)} || {_le_const(0)} || {_le('doc_id * 1000000007')}
          || {_le("16 + strlen(coalesce(text, ''))")} || {_le_const(listing.RECORDS['payload'])} || hex(encode(coalesce(text, ''))))) AS hardlink_digest FROM documents""",
    "folder_digests": f"WITH {_NODES} SELECT DISTINCT snapshot_id, true AS same FROM nodes WHERE path = 'doc' OR starts_with(path, 'doc/')",
    "snapshot_diffs": f"""WITH {_NODES}, s AS (SELECT snapshot_id, tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY snap_no) AS n, count(*) OVER (PARTITION BY tree_id) AS last FROM snapshots),
        e AS (SELECT tree_id, n, last, path, size, start_offset, CASE WHEN kind = 'dir' THEN 'dir' ELSE 'file' END AS kind FROM nodes JOIN s USING (snapshot_id)),
        was AS (SELECT tree_id, n + 1 AS n, path, size, kind FROM e WHERE n < last), cur AS (SELECT * FROM e WHERE n > 1)
        SELECT coalesce(a.tree_id, b.tree_id) AS tree_id, CAST(coalesce(a.n, b.n) AS INTEGER) AS n, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM was a FULL OUTER JOIN cur b ON a.tree_id = b.tree_id AND a.n = b.n AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.kind <> b.kind OR a.size <> b.size""",
}
