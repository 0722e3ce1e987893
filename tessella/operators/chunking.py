"""Cutting blobs into chunks, and what is told from chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cdc import WINDOW, ChunkSizes, byte_table, candidates, chunk_ends_of_many, cuts
from ..functions.chunk_ids import format_id
from ..functions.digests import HASHES, digest
from ..session import spread

#: Bytes of a blob that one task hashes at a time when it is cut in segments.
SEGMENT = 4 << 20


def fixed_chunks(blobs: DataFrame, size: int, algorithm: str = "sha256") -> DataFrame:
    """blob_id, pos, start, end, size, chunk_id, data for chunks of fixed size; the
    last of a blob may be shorter. `blobs` has blob_id and data (BINARY). Empty and
    null blobs have no chunks. JVM only with sha256."""
    n = F.length("data")
    pieces = blobs.filter(n > 0).select("blob_id", "data", F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("pos"))
    start = F.col("pos").cast("long") * size
    cut = pieces.select("blob_id", "pos", start.alias("start"), F.substr("data", (start + 1).cast("int"), F.lit(size)).alias("data"))
    return cut.select("blob_id", "pos", "start", (F.col("start") + F.length("data")).alias("end"), F.length("data").cast("long").alias("size"), format_id(digest(F.col("data"), algorithm)).alias("chunk_id"), "data")


def content_chunks(blobs: DataFrame, sizes: ChunkSizes | None = None, algorithm: str = "sha256", keep_data: bool = False, table: str | None = None) -> DataFrame:
    """The same with content-defined cuts, by one Arrow pass without a shuffle; each blob
    is cut by one task. For blobs larger than a task should hold see
    `content_chunks_of_segments`. Empty and null blobs have no chunks."""
    sizes = sizes or ChunkSizes.of()
    if sizes.fixed:
        out = fixed_chunks(blobs, sizes.max, algorithm)
        return out if keep_data else out.drop("data")
    kind = blobs.schema["blob_id"].dataType.simpleString()
    schema = f"blob_id {kind}, pos int, start long, end long, size long, chunk_id string" + (", data binary" if keep_data else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, new = byte_table(table), HASHES[algorithm]
        for batch in batches:
            blobs_ = batch.column(1).to_pylist()
            some = [b or b"" for b in blobs_]  # the missing have no chunks, like the empty
            starts, ends, counts, digests, pieces = [], [], [], [], []
            for data, own in zip(some, chunk_ends_of_many(some, sizes, numbers)):
                at = [0, *own[:-1]] if own else []
                cut = [data[a:b] for a, b in zip(at, own)]
                digests += [new(x).hexdigest() for x in cut]
                starts += at
                ends += own
                counts.append(len(own))
                if keep_data:
                    pieces += cut
            rows = np.repeat(np.arange(len(counts)), counts)
            pos = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
            start, end = np.array(starts, np.int64), np.array(ends, np.int64)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(pos.astype(np.int32)), pa.array(start), pa.array(end), pa.array(end - start), pa.array(digests, pa.string())]
            if keep_data:
                columns.append(pa.array(pieces, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["blob_id", "pos", "start", "end", "size", "chunk_id", "data"][: len(columns)])

    return spread(blobs.select("blob_id", "data")).mapInArrow(run, schema)


def joined(data: str, order: str) -> Column:
    """An aggregate: the bytes of a group in order, one behind the other."""
    return F.expr(f"listagg(`{data}`) WITHIN GROUP (ORDER BY `{order}`)")


def segments(blobs: DataFrame, length: int = SEGMENT) -> DataFrame:
    """blob_id, seg_no, base_offset, data, halo: a blob in parts, each with the 47 bytes before it."""
    n = F.length("data")
    each = spread(blobs.filter(n > 0)).select("blob_id", "data", n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / length).cast("int"))).alias("seg_no"))
    base = F.col("seg_no").cast("long") * length
    halo = F.least(base, F.lit(WINDOW - 1)).cast("int")
    return each.select("blob_id", "seg_no", base.alias("base_offset"), F.substr("data", (base + 1).cast("int"), F.lit(length)).alias("data"), F.substr("data", (base + 1 - halo).cast("int"), halo).alias("halo"))


def segments_of_parts(parts: DataFrame, length: int = SEGMENT, tail: int = 0) -> DataFrame:
    """The same `segments` of blobs that come as parts (blob_id, start, data) of any size, which
    follow one another by `start`, each with a column `tail` of the `tail` bytes behind it. A part goes to each segment
    that it touches; no task holds more than a segment."""
    low, high, base = F.col("start"), F.col("start") + F.length("data"), F.col("seg_no") * length
    touched = F.sequence(F.expr(f"greatest(start - {tail}, 0L) div {length}"), F.expr(f"(start + length(data) - 1 + {WINDOW - 1}) div {length}"))
    each = parts.filter(F.length("data") > 0).select("blob_id", "start", "data", F.explode(touched).alias("seg_no"))
    bounds = {"data": (base, base + length), "halo": (base - (WINDOW - 1), base), "tail": (base + length, base + length + tail)}

    def cut(of: tuple[Column, Column]) -> Column:
        a, b = F.greatest(low, of[0]), F.least(high, of[1])
        return F.when(b > a, F.substr("data", (a - low + 1).cast("int"), (b - a).cast("int")))

    pieces = each.select("blob_id", "seg_no", "start", *[cut(x).alias(n) for n, x in bounds.items()])
    whole = pieces.groupBy("blob_id", "seg_no").agg(*[F.coalesce(joined(n, "start"), F.lit(b"")).alias(n) for n in bounds])
    return whole.select("blob_id", F.col("seg_no").cast("int").alias("seg_no"), base.alias("base_offset"), *bounds).filter(F.length("data") > 0)


def cut_segments(parts: DataFrame, ranges: DataFrame, length: int, algorithm: str = "sha256") -> DataFrame:
    """blob_id, pos, start, end, size, chunk_id, data of the chunks (blob_id, pos, start, end) of blobs that come
    as `segments_of_parts` of `length` bytes, whose tails are as long as a chunk. Each segment meets the list of the chunks that begin in it."""
    kind = parts.schema["blob_id"].dataType.simpleString()
    lists = ranges.groupBy("blob_id", F.expr(f"cast(start div {length} as int)").alias("seg_no")).agg(F.collect_list(F.struct("pos", "start", "end")).alias("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = HASHES[algorithm]
        for batch in batches:
            for k, (base, data, tail, of) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(1, 5)])):
                data += tail
                cut = [data[r["start"] - base : r["end"] - base] for r in of]
                start, end = pa.array([r["start"] for r in of], pa.int64()), pa.array([r["end"] for r in of], pa.int64())
                columns = [batch.column(0).take(pa.array([k] * len(of))), pa.array([r["pos"] for r in of], pa.int32()), start, end, pa.array([len(x) for x in cut], pa.int64()), pa.array([new(x).hexdigest() for x in cut], pa.string()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["blob_id", "pos", "start", "end", "size", "chunk_id", "data"])

    met = parts.join(lists, ["blob_id", "seg_no"]).select("blob_id", "base_offset", "data", "tail", "of")
    return met.mapInArrow(run, f"blob_id {kind}, pos int, start long, end long, size long, chunk_id string, data binary")


def content_chunks_of_segments(parts: DataFrame, sizes: ChunkSizes | None = None, table: str | None = None) -> DataFrame:
    """blob_id, pos, start, end, size for blobs that come as `segments`.

    Whether the hash calls for a cut depends on 48 bytes only, so all segments of
    a blob are hashed in parallel. Just the sparse candidates of a blob, one in
    about as many bytes as a chunk has on average, meet in one place, where the
    cuts are chosen."""
    sizes = sizes or ChunkSizes.of()
    d = 1 if sizes.fixed else sizes.discriminator
    kind = parts.schema["blob_id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = byte_table(table)
        for b in batches:
            ats = []
            for base, data, halo in zip(b["base_offset"], b["data"], b["halo"]):
                at = np.zeros(0, np.int64) if sizes.fixed else candidates(bytes(halo) + bytes(data), d, numbers)
                ats.append((at + (base - len(halo))).tolist())
            yield pd.DataFrame({"blob_id": b["blob_id"], "seg_no": b["seg_no"], "n": [len(x) for x in b["data"]], "at": ats})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for blob, n, ats in zip(b["blob_id"], b["n"], b["at"]):
                start = 0
                for pos, end in enumerate(cuts(int(n), np.asarray(ats, np.int64), sizes)):
                    rows.append((blob, pos, start, end, end - start))
                    start = end
            yield pd.DataFrame(rows, columns=["blob_id", "pos", "start", "end", "size"])

    found = parts.mapInPandas(hashed, f"blob_id {kind}, seg_no int, n long, at array<bigint>")
    whole = found.groupBy("blob_id").agg(F.sum("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "at"))), lambda x: x["at"])).alias("at"))
    return whole.mapInPandas(choose, f"blob_id {kind}, pos int, start long, end long, size long")


def index_of(chunks: DataFrame) -> DataFrame:
    """index_id, pos, end_offset, chunk_id: the index that describes the chunked blobs."""
    return chunks.select(F.col("blob_id").alias("index_id"), "pos", F.col("end").alias("end_offset"), "chunk_id")


def dedup_totals(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct chunks and bytes, and the shares that reuse saves, in whole per cent."""
    per = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    n, u = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    total, unique = F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))
    return per.agg(n.alias("chunks"), u.alias("unique_chunks"), total.alias("bytes"), unique.alias("unique_bytes"), (n - u).alias("reused"), F.try_divide((n - u) * 100, n).cast("long").alias("reused_percent"), F.try_divide(total, n).cast("long").alias("average_chunk"))


def written_or_reused(chunks: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """blob_id, chunks_written, chunks_reused: the first occurrence of a chunk, by
    blob and position, is written unless the store has it already.

    The first occurrence is a minimum that the map side reduces, so it doesn't
    matter how often the most frequent chunk occurs."""
    at = F.struct("blob_id", "pos")
    first = chunks.groupBy("chunk_id").agg(F.min(at).alias("first"))
    if store is not None:
        first = first.join(store.select("chunk_id").distinct(), "chunk_id", "left_anti")
    wrote = first.groupBy(F.col("first.blob_id").alias("blob_id")).agg(F.count(F.lit(1)).alias("w"))
    per = chunks.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n"))
    w = F.coalesce("w", F.lit(0))
    return per.join(wrote, "blob_id", "left").select("blob_id", w.alias("chunks_written"), (F.col("n") - w).alias("chunks_reused"))


def size_histogram(chunks: DataFrame, sizes: ChunkSizes, buckets: int = 16) -> DataFrame:
    """bucket (1..buckets), low, n: how many chunks have which size between least and greatest."""
    b = F.least(F.greatest(F.width_bucket(F.col("size"), F.lit(float(sizes.min)), F.lit(float(sizes.max) + 1), F.lit(buckets)), F.lit(1)), F.lit(buckets))
    width = (sizes.max + 1 - sizes.min) / buckets
    return chunks.groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.ceil(F.lit(sizes.min) + (F.col("bucket") - 1) * F.lit(width)).cast("long"))


def reassembled(chunks: DataFrame, most: int = 1 << 30) -> DataFrame:
    """blob_id, data: the blobs put together again from `data` by `pos`. A blob is
    one value here; one of more than `most` bytes is an error, and is read by ranges or in parts."""
    size = F.sum(F.length("data").cast("long"))
    error = F.raise_error(F.concat(F.lit("a blob is too large for one value: "), F.col("blob_id").cast("string")))
    return chunks.groupBy("blob_id").agg(F.when(size > most, error.cast("binary")).otherwise(joined("data", "pos")).alias("data"))


def stream_digest(parts: DataFrame, owner: list[str], order: str, data: str = "data", algorithm: str = "sha256") -> DataFrame:
    """owner..., digest, bytes of the parts of each stream in order. SHA isn't
    mergeable, so a stream is digested by one task, which sees it sorted and part by part."""
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in owner)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        name, now, h, n, rows = {"sha256": "sha256", "sha512-256": "sha512_256"}[algorithm], None, None, 0, []
        for b in batches:
            for row in b.itertuples(index=False):
                key = tuple(row[: len(owner)])
                if key != now:
                    if now is not None:
                        rows.append((*now, h.hexdigest(), n))
                    now, h, n = key, hashlib.new(name), 0
                if row[-1] is not None:
                    h.update(row[-1])
                    n += len(row[-1])
            yield pd.DataFrame(rows, columns=[*owner, "digest", "bytes"])
            rows = []
        if now is not None:
            yield pd.DataFrame([(*now, h.hexdigest(), n)], columns=[*owner, "digest", "bytes"])

    placed = parts.select(*owner, order, data).repartition(*owner).sortWithinPartitions(*owner, order)
    return placed.mapInPandas(_dropping(run, len(owner)), f"{kinds}, digest string, bytes long")


def _dropping(run, at: int):
    """Takes the order column, which sits behind the owner columns, out of the batches."""

    def without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(b.drop(columns=b.columns[at]) for b in batches)

    return without


def hole_bytes(data: Column, least: int = 4096) -> Column:
    """Bytes in runs of at least `least` zeros, which a sparse file needn't store."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for b in s:
                if b is None:
                    out.append(None)
                    continue
                zero = np.concatenate(([0], (np.frombuffer(b, np.uint8) == 0).astype(np.int8), [0]))
                edge = np.flatnonzero(np.diff(zero))
                length = edge[1::2] - edge[::2]
                out.append(int(length[length >= least].sum()))
            yield pd.Series(out, dtype="Int64")

    return F.pandas_udf(run, "long")(data)
