"""A few keys holding most records: eager aggregation through joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunk_ids import chunk_key
from ..session import written

#: Positions of an index that are ordered in one task.
BLOCK = 4096
#: A group is heavy from this share of all rows on, so that there are at most 1000 of them.
HEAVY = 1000


def eager_join_totals(left: DataFrame, right: DataFrame, on: list[str], left_sums: dict[str, str], right_sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Totals of `left` JOIN `right` ON `on` without building that join.

    Each input is first reduced to one state for each join key (and, of the
    right, each value of `by`): a count and the sums. The states are joined, so
    a key that holds most rows is one row on either side; counts multiply, a
    sum of one side is multiplied by the count of the other, and the products
    are rolled up to `by` (none: one row). `left_sums` and `right_sums` map the
    name of a result to a numeric column. Null keys match nothing, null
    values add nothing, an empty input gives no row (without `by`: one row of
    n_rows 0 and null sums). Columns of the same name on both sides don't clash.
    """
    by = by or []
    l = left.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("__nl"), *[F.sum(F.col(c)).alias(f"__l_{name}") for name, c in left_sums.items()])
    r = right.dropna(subset=on).groupBy(*on, *[c for c in by if c not in on]).agg(F.count(F.lit(1)).alias("__nr"), *[F.sum(F.col(c)).alias(f"__r_{name}") for name, c in right_sums.items()])
    totals = [F.coalesce(F.sum(F.col("__nl") * F.col("__nr")), F.lit(0)).alias("n_rows")]
    totals += [F.sum(F.col(f"__l_{name}") * F.col("__nr")).alias(name) for name in left_sums]
    totals += [F.sum(F.col(f"__r_{name}") * F.col("__nl")).alias(name) for name in right_sums]
    return l.join(r, on).groupBy(*by).agg(*totals)


def sized_items(items: DataFrame) -> DataFrame:
    """index_id, pos, key, size and end_offset of each (index_id, pos), taken once.

    The size is the end offset less that of pos - 1 in the same index (less 0 at
    pos 0); null if either is missing. Of an item delivered more than once the
    version that arrived first counts, one with a key and an offset before
    others. An index may hold most rows: it is cut into blocks of positions,
    each of which also gets the last item of the block before, so that one
    shuffle serves for taking items once and for the offset before. Items
    without index or position take no part.
    """
    block = F.expr(f"pos div {BLOCK}")
    last = F.pmod(F.col("pos"), F.lit(BLOCK)) == BLOCK - 1
    order = Window.partitionBy("index_id", "block").orderBy("pos")
    before = F.when(F.col("pos") == 0, F.lit(0).cast("long")).when(F.lag("pos").over(order) == F.col("pos") - 1, F.lag("end_offset").over(order))
    return (
        items.select("index_id", "pos", "end_offset", "arrival_no", chunk_key("chunk").alias("key"))
        .dropna(subset=["index_id", "pos"])
        .withColumn("block", F.explode(F.when(last, F.array(block, block + 1)).otherwise(F.array(block))))
        .repartition("index_id", "block")
        .groupBy("index_id", "block", "pos")
        .agg(F.min(F.struct(F.isnull("key").alias("a"), F.isnull("end_offset").alias("b"), "arrival_no", "end_offset", "key")).alias("r"))
        .select("index_id", "block", "pos", "r.end_offset", "r.key")
        .withColumn("size", F.col("end_offset") - before)
        .filter(F.col("block") == block)
        .select("index_id", "pos", "key", "size", "end_offset")
    )


def size_states(sized: DataFrame) -> DataFrame:
    """Compact states of all items with a key: key, size (null: unknown), n."""
    return sized.filter(F.col("key").isNotNull()).groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"))


def chunk_states(states: DataFrame) -> DataFrame:
    """One row for each chunk: key, items, sized_items, bytes, usual_size.

    The usual size is the one that more than half of the items of known size
    have, else null. Works on `size_states`, so the most frequent chunk costs as
    many rows as it has different sizes."""
    n = F.when(F.col("size").isNotNull(), F.col("n"))
    return (
        states.groupBy("key")
        .agg(F.sum("n").alias("items"), F.coalesce(F.sum(n), F.lit(0)).alias("sized_items"), F.coalesce(F.sum(n * F.col("size")), F.lit(0)).alias("bytes"), F.max(n).alias("most"), F.max_by("size", n).alias("top"))
        .select("key", "items", "sized_items", "bytes", F.when(F.col("most") * 2 > F.col("sized_items"), F.col("top")).alias("usual_size"))
    )


def unusual_items(items: DataFrame) -> DataFrame:
    """index_id, pos, key, size and usual_size of the items whose size differs
    from the usual size of their chunk.

    The two compact states (chunk and size, chunk) are joined and tell which
    sizes differ; only then the items come in again. The groups of one chunk
    and size that hold a thousandth of all rows or more, of which there are at
    most a thousand, are judged by a broadcast of that bounded list; only items
    of smaller groups are shuffled, so no task gets more than its share.
    """
    sized = written(sized_items(items).dropna(subset=["key", "size"]).drop("end_offset"), "sized")
    states = size_states(sized)
    judged = written(states.join(chunk_states(states).select("key", "usual_size"), "key"), "size-states")
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.col("n") * HEAVY >= F.lit(max(total, 1))
    unusual = F.col("size") != F.col("usual_size")
    marked = sized.join(F.broadcast(judged.filter(heavy).select("key", "size", F.col("usual_size").alias("hot_usual"), F.lit(True).alias("hot"))), ["key", "size"], "left")
    hot = marked.filter(F.col("hot") & (F.col("size") != F.col("hot_usual"))).select("index_id", "pos", "key", "size", F.col("hot_usual").alias("usual_size"))
    rest = marked.filter(F.col("hot").isNull()).select("index_id", "pos", "key", "size")
    return hot.unionByName(rest.join(judged.filter(~heavy & unusual).select("key", "size", "usual_size"), ["key", "size"]).select("index_id", "pos", "key", "size", "usual_size"))
