"""Indices: totals, checks, offsets and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunk_ids import MAX_CHUNK
from .chunking import joined
from .eager import BLOCK, sized_items
from .lookup import attach

# Fixed values of the index format: bytes of the header, of the table header, of an item and of the tail.
HEADER, TABLE_HEADER, ITEM, TAIL = 48, 16, 40, 40


def index_bytes(items: Column) -> Column:
    """Size of the index file of so many items."""
    return F.lit(HEADER + TABLE_HEADER + TAIL) + items * ITEM


def index_totals(items: DataFrame) -> DataFrame:
    """index_id, chunks, blob_size (the last end offset), index_size of the items of indices, each position once."""
    once = items.dropna(subset=["index_id", "pos"]).groupBy("index_id", "pos").agg(F.max("end_offset").alias("end_offset"))
    return once.groupBy("index_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_offset").alias("blob_size")).withColumn("index_size", index_bytes(F.col("chunks")))


def violations(items: DataFrame, meta: DataFrame | None = None, most: int = MAX_CHUNK) -> DataFrame:
    """index_id, pos, rule of what is wrong with items: no_id, offset_not_increasing, too_large, size_unknown.

    Too large is an item above the `chunk_max` that `meta` (index_id, chunk_max) has of its
    index, or above `most` if there is none."""
    sized, limit = sized_items(items), F.lit(most)
    if meta is not None:
        sized = attach(sized, meta.groupBy("index_id").agg(F.min("chunk_max").alias("chunk_max")), ["index_id"], "left")
        limit = F.coalesce(F.col("chunk_max"), limit)
    rules = F.array_compact(
        F.array(
            F.when(F.col("key").isNull(), "no_id"),
            F.when(F.col("size") <= 0, "offset_not_increasing"),
            F.when(F.col("size") > limit, "too_large"),
            F.when(F.col("size").isNull(), "size_unknown"),
        )
    )
    return sized.select("index_id", "pos", F.explode(rules).alias("rule"))


def spans(items: DataFrame) -> DataFrame:
    """index_id, pos, start, end, key of the items whose size is known and positive."""
    sized = sized_items(items).filter(F.col("size") > 0)
    return sized.select("index_id", "pos", (F.col("end_offset") - F.col("size")).alias("start"), F.col("end_offset").alias("end"), "key")


def with_starts(items: DataFrame) -> DataFrame:
    """`items` (index_id, pos, end_offset, each position once) with `start` and `size`. An index is cut into
    blocks of positions, each of which also gets the last item of the block before."""
    block, last = F.expr(f"pos div {BLOCK}"), F.pmod(F.col("pos"), F.lit(BLOCK)) == BLOCK - 1
    before = F.lag("end_offset", 1, 0).over(Window.partitionBy("index_id", "__block").orderBy("pos"))
    each = items.withColumn("__block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))
    return each.withColumn("start", before).filter(F.col("__block") == block).drop("__block").withColumn("size", F.col("end_offset") - F.col("start"))


def chunks_at(items: DataFrame, offsets: DataFrame, cell: int = 1 << 20) -> DataFrame:
    """index_id, offset, pos, skip: the chunk that holds each asked offset of an index, and how far into it the offset is.

    `offsets` has index_id and offset. Both sides are keyed by index and cell of
    `cell` bytes; a chunk stands in every cell that it touches, so this is an
    equality join that a large index doesn't skew. Offsets beyond the end have no row."""
    held = spans(items).withColumn("cell", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(`end` - 1) div {cell}"))))
    asked = offsets.dropna().distinct().withColumn("cell", F.expr(f"offset div {cell}"))
    met = asked.join(held, ["index_id", "cell"]).filter((F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))
    return met.select("index_id", "offset", "pos", (F.col("offset") - F.col("start")).alias("skip"))


def chunks_in_range(items: DataFrame, low: Column, high: Column) -> DataFrame:
    """index_id, pos, key, skip, take: which part of which chunks makes up the bytes from `low` to before `high`."""
    held = spans(items).filter((F.col("start") < high) & (F.col("end") > low))
    first, last = F.greatest(F.col("start"), low), F.least(F.col("end"), high)
    return held.select("index_id", "pos", "key", (first - F.col("start")).alias("skip"), (last - first).alias("take"))


def read_range(chunks: DataFrame, low: int, high: int) -> DataFrame:
    """blob_id, data of the bytes from `low` to before `high` of each blob, of chunks with start, end and data."""
    held = chunks.filter((F.col("start") < high) & (F.col("end") > low))
    skip = F.greatest(F.lit(low) - F.col("start"), F.lit(0))
    take = F.least(F.col("end"), F.lit(high)) - F.greatest(F.col("start"), F.lit(low))
    cut = held.select("blob_id", "pos", F.substr("data", (skip + 1).cast("int"), take.cast("int")).alias("data"))
    return cut.groupBy("blob_id").agg(joined("data", "pos").alias("data"))


def delta(earlier: DataFrame, later: DataFrame, on: list[str]) -> DataFrame:
    """on..., chunks, from_seed, to_fetch, bytes_to_fetch: what of the chunks of a later
    version a seed, the earlier version, provides. Both have the columns `on`, key and size."""
    seed = earlier.select(*on, "key").dropna().distinct().withColumn("__seed", F.lit(True))
    per = later.dropna(subset=["key"]).groupBy(*on, "key").agg(F.max("size").alias("size"))
    met = per.join(seed, [*on, "key"], "left")
    fetch = F.col("__seed").isNull()
    return met.groupBy(*on).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~fetch).alias("from_seed"), F.count_if(fetch).alias("to_fetch"), F.coalesce(F.sum(F.when(fetch, F.col("size"))), F.lit(0)).alias("bytes_to_fetch"))
