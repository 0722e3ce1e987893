"""Whole jobs: make, extract, list, manifest, stat, digest, gc, verify and diff."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as ff
from ..functions import listing
from ..functions.cdc import ChunkSizes
from ..functions.codecs import compress
from ..operators import cache, chunking, index, store, tree
from ..operators.lookup import attach
from ..session import written
from ..sources import archives
from ..streaming import exchange

# Suffixes of what can be made.
SUFFIXES = {".catar": "archive", ".caidx": "archive-index", ".caibx": "blob-index"}


@dataclass(frozen=True)
class Options:
    """What a job may be told; the defaults are those of the command line."""

    sizes: ChunkSizes = field(default_factory=ChunkSizes.of)
    digest: str = "sha512-256"
    compression: str = "zstd"
    with_: int = 0
    without: int = 0
    exclude_nodump: bool = True
    exclude_submounts: bool = False
    exclude_file: bool = True
    recursive: bool = True
    dry_run: bool = False
    uid_shift: int | None = None
    uid_range: int = 0x10000
    byte_table: str | None = None

    @property
    def features(self) -> int:
        v = ff.chosen(self.with_, self.without)
        for on, bit in ((self.exclude_nodump, ff.EXCLUDE_NODUMP), (self.exclude_submounts, ff.EXCLUDE_SUBMOUNTS), (self.exclude_file, ff.EXCLUDE_FILE), (self.digest == "sha512-256", ff.SHA512_256)):
            v = v | bit if on else v & ~bit
        return v


def what_to_make(what: str | None, output: str | None, is_dir: bool) -> str:
    """archive, archive-index or blob-index, by what is wanted, or else the suffix of the
    output, or else the input; an error if the input is of the other kind."""
    made = what
    if not made and output and output != "-":
        made = next((w for s, w in SUFFIXES.items() if output.split("?")[0].split(";")[0].endswith(s)), None)
        if not made:
            raise ValueError(f"{output!r} has none of the suffixes {', '.join(SUFFIXES)}")
    made = made or ("archive" if is_dir else "blob-index")
    if made not in SUFFIXES.values() or (made == "blob-index") == is_dir:
        raise ValueError(f"{made} can't be made of {'a folder' if is_dir else 'a blob'}")
    return made


@dataclass
class Made:
    """`index` (index_id, pos, end_offset, chunk_id), `new_chunks` (chunk_id, size, codec, data) to
    append to the store, `report` (one row for each index) and `chunks` as they were cut."""

    index: DataFrame
    new_chunks: DataFrame
    report: DataFrame
    chunks: DataFrame


def filtered(entries: DataFrame, options: Options, patterns: list[tree.Pattern] = ()) -> DataFrame:
    """The entries that an archive with these options holds. Exclude files in the tree are read if the entries have their content; `patterns` hold besides."""
    out = tree.without_nodump(tree.kept_kinds(entries, options.features), options.features) if "flags" in entries.columns else tree.kept_kinds(entries, options.features)
    if options.exclude_submounts and "mount_id" in entries.columns:
        out = tree.without_submounts(out)
    if "fs" in entries.columns:
        out = tree.without_virtual(out)
    if not options.exclude_file:
        return out
    if "content" in entries.columns:
        found = tree.excluded_by_files(out, tree.exclude_patterns(tree.exclude_files(out)))
        out = out.join(found, ["tree_id", "path"], "left_anti")
    return tree.without_excluded(out, list(patterns)) if patterns else out


def make_blobs(blobs: DataFrame, have: DataFrame | None = None, options: Options = Options()) -> Made:
    """Index, chunks to store and statistics of blobs (blob_id, data), given the ids (chunk_id) that the store holds.

    Blobs are cut once; what was cut is kept in the shared folder, from which all three results come."""
    return _made(written(chunking.content_chunks(blobs, options.sizes, options.digest, keep_data=True, table=options.byte_table), "chunks"), have, options)


def _made(cut: DataFrame, have: DataFrame | None, options: Options) -> Made:
    one = cut.select("chunk_id", "size", "data")
    fresh = one.select("chunk_id").distinct()
    if have is not None:
        fresh = fresh.join(have.select("chunk_id").distinct(), "chunk_id", "left_anti")
    new = one.join(fresh, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.any_value("size").alias("size"), F.any_value("data").alias("data"))
    new = new.select("chunk_id", "size", F.lit(options.compression).alias("codec"), compress(F.col("data"), options.compression).alias("data"))
    per = cut.groupBy("blob_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("size").alias("archive_size"))
    reused = chunking.written_or_reused(cut.select("blob_id", "pos", "chunk_id"), have)
    n = F.col("chunks")
    report = per.join(reused, "blob_id").select(F.col("blob_id").alias("index_id"), "chunks", "archive_size", F.try_divide("archive_size", n).cast("long").alias("average_chunk"), "chunks_written", "chunks_reused", F.try_divide(F.col("chunks_reused") * 100, n).cast("long").alias("reused_percent"), index.index_bytes(n).alias("index_size"))
    return Made(chunking.index_of(cut), new, report, cut)


def make_trees(entries: DataFrame, have: DataFrame | None = None, options: Options = Options(), patterns: list[tree.Pattern] = (), segment: int = chunking.SEGMENT) -> Made:
    """The same of trees (tree_id and the columns of an archive's entries).

    An archive may be larger than a value or a task: it is made in parts, which are laid out
    in segments of `segment` bytes, hashed segment by segment, and cut by what the segments called for. What the
    features don't keep isn't archived: modes, times and owners are reduced to them."""
    kept = archived_columns(filtered(entries, options, patterns), options)
    parts = archives.archive_parts(kept, options.features).withColumnRenamed("tree_id", "blob_id")
    segments = written(chunking.segments_of_parts(parts, segment, options.sizes.max), "segments")
    ranges = written(chunking.content_chunks_of_segments(segments, options.sizes, options.byte_table), "cuts")
    return _made(written(chunking.cut_segments(segments, ranges, segment, options.digest), "chunks"), have, options)


def archived_columns(entries: DataFrame, options: Options) -> DataFrame:
    """Entries as an archive with the options' features keeps them: times in its granularity, permissions as
    far as it has them, owners shifted (null below the shift), and null what it doesn't keep at all."""
    flags = F.lit(ff.signed(options.features)).cast("long")
    out = tree.replay_columns(entries, options.features)
    if "mode" in out.columns:
        kinds = F.create_map(*[F.lit(x) for k, v in archives.KIND_MODES.items() for x in (k, v)])
        out = out.withColumn("mode", ff.stored_mode(kinds[F.col("kind")].bitwiseOR(F.coalesce(F.col("mode"), F.lit(0)).bitwiseAND(F.lit(0o7777))), flags))
    if "mtime_ns" in out.columns:
        out = out.withColumn("mtime_ns", ff.floor_time(F.col("mtime_ns"), flags))
    if options.uid_shift is not None:
        out = out.withColumns({c: ff.shifted_uid(F.col(c), options.uid_shift, options.uid_range) for c in ("uid", "gid") if c in out.columns})
    return out


def resolved_parts(items: DataFrame, sources: list[tuple[str, DataFrame]], options: Options = Options()) -> DataFrame:
    """blob_id, pos, start, size, provider, ok, data of each item of indices (index_id, pos, end_offset, chunk_id), from
    providers in their order, each a name and a table of chunk_id and data.

    A chunk counts only if its digest is right and its size that of the index; the first provider with
    such a chunk gives it. Chunks are checked once for each provider; the items meet the chosen ones by a
    join that splits a chunk which very many items ask for."""
    held = None
    for k, (name, rows) in enumerate(sources):
        good = store.verified(rows.select("chunk_id", "data"), options.digest).filter("intact").select("chunk_id", "data", F.lit(k).alias("priority"), F.lit(name).alias("provider"))
        held = good if held is None else held.unionByName(good)
    best = held.groupBy("chunk_id").agg(F.min_by(F.struct("data", "provider"), "priority").alias("r")).select("chunk_id", "r.data", "r.provider")
    met = attach(index.with_starts(items.select("index_id", "pos", "end_offset", "chunk_id")), best, ["chunk_id"], "left")
    ok = F.coalesce(F.length("data") == F.col("size"), F.lit(False))
    return met.select(F.col("index_id").alias("blob_id"), "pos", "start", "size", F.when(ok, F.col("provider")).alias("provider"), ok.alias("ok"), F.when(ok, F.col("data")).alias("data"))


def _providers_report(parts: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    total = parts.groupBy("provider").agg(F.count(F.lit(1)).alias("requests"), F.sum("size").alias("bytes"))
    return total.withColumn("percent", F.floor(F.col("requests") * 100 / F.sum("requests").over(Window.partitionBy())).cast("long"))


def extract_blobs(items: DataFrame, sources: list[tuple[str, DataFrame]], options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(blobs, report) of an index and providers, by `resolved_parts`. blobs: blob_id, data, complete; report: provider, requests,
    bytes, percent. A blob is one value; larger ones are taken from `resolved_parts`."""
    got = written(resolved_parts(items, sources, options), "resolved")
    whole = got.groupBy("blob_id").agg(F.bool_and("ok").alias("complete"))
    blobs = chunking.reassembled(got.filter("ok").select("blob_id", "pos", "data")).join(whole, "blob_id", "right").select("blob_id", F.when(F.col("complete"), F.col("data")).alias("data"), "complete")
    return blobs, _providers_report(got)


def extract_trees(items: DataFrame, sources: list[tuple[str, DataFrame]], options: Options = Options(), with_content: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, report): the same, unpacked as the chunks come; trees that aren't complete give no entries. No archive is ever one value."""
    got = written(resolved_parts(items, sources, options), "resolved")
    broken = got.filter(~F.col("ok")).select("blob_id").distinct()
    parts = attach(got, broken.withColumn("__broken", F.lit(True)), ["blob_id"], "left").filter(F.col("__broken").isNull())
    return archives.unpacked_parts(parts.select(F.col("blob_id").alias("tree_id"), "start", "data"), with_content), _providers_report(got)


@dataclass
class Pulled:
    """What a pull has done: `requests` (chunk_id, high, place) that were sent, `fetched` (chunk_id, data) that came and are right,
    `parts` as `resolved_parts` has them, and `report` by provider."""

    requests: DataFrame
    fetched: DataFrame
    parts: DataFrame
    report: DataFrame


def pull(items: DataFrame, seeds: list[tuple[str, DataFrame]], held: list[tuple[str, DataFrame]], remote: DataFrame, options: Options = Options()) -> Pulled:
    """The steps of an extraction from afar in their order: what the seeds and stores at hand (each a name and a table of chunk_id and data) don't
    have is asked of the remote one, each chunk once, those at the head of an index first; what comes is checked; then all items are resolved, seeds
    first, then stores, then what was fetched, which the caller may put into a store."""
    local = None
    for _, rows in [*seeds, *held]:
        local = rows.select("chunk_id") if local is None else local.unionByName(rows.select("chunk_id"))
    first = items.groupBy("chunk_id").agg(F.min("pos").alias("seq"), F.bool_or(F.col("pos") == 0).alias("high"))
    wanted = first if local is None else first.join(local.distinct(), "chunk_id", "left_anti")
    requests = written(exchange.request_queue(wanted), "requests")
    got = exchange.responses(requests, remote).filter(F.col("kind") == "chunk")
    fetched = written(got.filter(exchange.valid_response(F.unhex("chunk_id"), F.col("data"), options.digest)).select("chunk_id", "data"), "fetched")
    parts = written(resolved_parts(items, [*seeds, *held, ("remote", fetched)], options), "pulled")
    return Pulled(requests, fetched, parts, _providers_report(parts))


def listed(entries: DataFrame, path: str = "", options: Options = Options()) -> DataFrame:
    """tree_id, path, line of a listing of what is at and below a path."""
    return tree.at_path(entries, path, options.recursive).select("tree_id", "path", listing.list_line(F.col("mode"), F.col("path")).alias("line"))


def manifest(entries: DataFrame, options: Options = Options()) -> DataFrame:
    """tree_id, path, line of a manifest, with the digest of each file's content."""
    from ..functions.digests import digest

    c = lambda n: F.col(n) if n in entries.columns else None
    own = listing.chattr_string(F.col("flags")) if "flags" in entries.columns else None
    line = listing.mtree_line(
        F.col("path"), F.col("mode"), size=c("size"), link=c("target"), major=c("major"), minor=c("minor"), uid=c("uid"), gid=c("gid"), user=c("user"), group=c("group"), flags=own, mtime_ns=c("mtime_ns"),
        digest=F.lower(F.hex(digest(F.col("content"), options.digest))) if "content" in entries.columns else None, algorithm=options.digest.replace("-", ""),
    )
    return entries.select("tree_id", "path", line.alias("line"))


def stat_block(entries: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """tree_id, path, text: the labelled lines about each entry; times are shown in the time zone of the session. With
    `digests`, as `entry_digests` has them, files show theirs."""
    if digests is not None:
        entries = entries.join(digests.select("tree_id", "path", "payload_digest", "hardlink_digest"), ["tree_id", "path"], "left")
    c = lambda n: F.col(n) if n in entries.columns else F.lit(None)

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label:>8}: "), value.cast("string"))

    def owner(name: Column, number: Column) -> Column:
        shown = listing.escaped(name.cast("string"))
        return F.when(name.isNotNull() & number.isNotNull(), F.concat(shown, F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(F.coalesce(shown, number.cast("string")))

    ns = c("mtime_ns").cast("long")
    rest = F.pmod(ns, F.lit(1_000_000_000))
    time = F.concat(F.date_format(F.timestamp_seconds((ns - rest) / 1_000_000_000), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"))
    lines = [
        line("File", listing.shown_path(F.col("path"))), line("Mode", listing.mode_string(F.col("mode"))), line("FileAttr", listing.chattr_string(c("flags").cast("long"))), line("Offset", c("start")), line("Time", time), line("Size", c("size")),
        line("User", owner(c("user"), c("uid"))), line("Group", owner(c("group"), c("gid"))), line("ProjID", c("quota_projid")), line("Target", listing.escaped(c("target").cast("string"))), line("Device", F.concat(c("major").cast("string"), F.lit(":"), c("minor").cast("string"))),
    ]
    if "xattrs" in entries.columns:
        pairs = F.transform(F.array_sort(F.map_entries("xattrs")), lambda x: F.concat(F.lit(f"{'XAttr':>8}: "), listing.escaped(x["key"]), F.lit(" → "), listing.escaped(x["value"])))
        lines.append(F.nullif(F.array_join(pairs, "\n"), F.lit("")))
    lines += [line("Digest", c("payload_digest")), line("HLDigest", c("hardlink_digest"))]
    return entries.select("tree_id", "path", F.concat_ws("\n", *lines).alias("text"))


def digests_at(made: DataFrame, entries: DataFrame, path: str = "", algorithm: str = "sha512-256") -> DataFrame:
    """tree_id, kind, digest: of a folder the digest of its part of the archive (tree_id, archive), from its entry to the end of its
    table; of the top that is all. Of a file that of its content. Other kinds are an error; a path that isn't there has no row."""
    from ..functions.digests import digest, digest_bytes

    hexed = lambda c: F.lower(F.hex(digest(F.col(c), algorithm)))
    if not path:
        return made.select("tree_id", F.lit("archive").alias("kind"), hexed("archive").alias("digest"))

    @F.pandas_udf("string")
    def part(archives_: pd.Series) -> pd.Series:
        out = []
        for data in archives_:
            at = archives.node_range(bytes(data), path)
            out.append(digest_bytes(data[at[0] : at[1]], algorithm).hex() if at else None)
        return pd.Series(out, dtype=object)

    content = F.col("content") if "content" in entries.columns else F.lit(b"")
    hit = entries.filter(F.col("path") == path).select("tree_id", "kind", content.alias("content"))
    other = F.raise_error(F.concat(F.lit("a digest is of files and folders, not of a "), F.col("kind")))
    checked = hit.withColumn("kind", F.when(F.col("kind").isin("file", "dir"), F.col("kind")).otherwise(other))
    files = checked.filter(F.col("kind") == "file").select("tree_id", F.lit("payload").alias("kind"), hexed("content").alias("digest"))
    folders = made.join(checked.filter(F.col("kind") == "dir").select("tree_id"), "tree_id", "left_semi").select("tree_id", F.lit("archive").alias("kind"), part("archive").alias("digest"))
    return files.unionByName(folders)


def entry_digests(entries: DataFrame, features: int = ff.DEFAULT, algorithm: str = "sha512-256") -> DataFrame:
    """tree_id, path, payload_digest, hardlink_digest of files: of the content alone, and of all
    records of the entry, by which files can be told that may become one."""
    from ..functions.digests import digest_bytes

    have = [c for c in archives.FIELDS if c in entries.columns]
    kind = entries.schema["tree_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            rows = []
            for e in b.astype(object).where(b.notna(), None).to_dict("records"):
                for c in ("mode", "flags", "uid", "gid", "mtime_ns"):
                    e[c] = int(e[c]) if e.get(c) is not None else None
                rows.append((e["tree_id"], e["path"], digest_bytes(bytes(e.get("content") or b""), algorithm).hex(), digest_bytes(archives.entry_records(e, features), algorithm).hex()))
            yield pd.DataFrame(rows, columns=["tree_id", "path", "payload_digest", "hardlink_digest"])

    return entries.filter(F.col("kind") == "file").select("tree_id", *have).mapInPandas(run, f"tree_id {kind}, path string, payload_digest string, hardlink_digest string")


def collect_garbage(held: DataFrame, used: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) of a store; with dry_run all stays."""
    gone = store.garbage(held, used)
    return (held if options.dry_run else store.remove(held, gone)), gone


def verify(items: DataFrame, held: DataFrame, options: Options = Options()) -> DataFrame:
    """index_id, pos, state of each item of indices against a store with data: ok, missing or damaged."""
    state = store.verified(held.select("chunk_id", "data"), options.digest).groupBy("chunk_id").agg(F.max("intact").alias("intact"))
    met = attach(items, state, ["chunk_id"], "left")
    return met.select("index_id", "pos", F.when(F.col("intact").isNull(), "missing").when(F.col("intact"), "ok").otherwise("damaged").alias("state"))


def diff(earlier: DataFrame, later: DataFrame, columns: list[str] = ("mode", "size", "mtime_ns", "target")) -> DataFrame:
    """tree_id, path, change_kind between two sets of entries of the same trees."""
    from ..operators.snapshots import snapshot_diff

    return snapshot_diff(earlier, later, ["tree_id", "path"], [c for c in columns if c in earlier.columns and c in later.columns])


def cached_make(entries: DataFrame, kept: DataFrame, on: list[str], checked: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what has to be read again, totals) if `kept` remembers an earlier run; see `cache_verdicts`."""
    v = cache.cache_verdicts(entries, kept, on, checked)
    return v.filter(F.col("verdict") != "hit"), cache.cache_totals(v, [])
