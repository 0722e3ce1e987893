"""Joining a large table with one that is usually small."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

#: Most rows and bytes of values that are ever broadcast.
MAX_ROWS, MAX_BYTES = 500_000, 32 << 20


def fits(small: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether a table is within the bounds, by one pass over at most `max_rows` + 1 of its rows."""
    wide = [f.name for f in small.schema.fields if not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))]
    flat = len(small.columns) - len(wide)
    length = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide]
    size = F.lit(8 * flat)
    for x in length:
        size = size + x
    n, total = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def heavy_hashes(big: DataFrame, on: list[str], groups: int = 64) -> list[int]:
    """Hashes of the keys that hold a hundredth of all rows or more, at most 400 with some of
    fewer rows, in one pass that moves nothing but small sketches.

    Each of `groups` sets of tasks has its sketches of the 200 most frequent keys merged by
    itself, so no task reads those of all. A key that isn't among them holds less than
    a two-hundredth of such a set; with what a sketch may miss, summing up what is known and
    keeping from a four-hundredth on leaves no heavy key out."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    keyed = big.dropna(subset=on).select(h.alias("h"), F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g"))
    parts = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.expr("approx_top_k(h, 200, 4000)").alias("top")).collect()
    total, counts = sum(p.n for p in parts), Counter()
    for p in parts:
        counts.update({x.item: x["count"] for x in p.top})
    return [k for k, n in counts.items() if n * 400 >= total]


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """`big` joined with `small` on the columns `on`; how is inner, left or left_semi.

    `small` is broadcast if it is measured to be within MAX_ROWS and MAX_BYTES.
    Beyond, both are shuffled, and any key of `big` may hold most rows: the keys
    that hold a hundredth of them or more are split over `salts` partitions (as
    many as the session shuffles into, unless given) by a hash of the whole row,
    and the rows of `small` of just these keys are repeated so often. Null keys
    match nothing; an empty side gives the usual result of the join; repeated rows
    of `small` multiply as in any join. Measuring needs `small` more than once and finding
    heavy keys `big`: one that is more than a filtered table is written first.
    """
    small = settled(small, "lookup")
    if fits(small):
        return big.join(F.broadcast(small), on, how)
    big = settled(big, "looked-up")
    salts = salts or max(16, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_hashes(big, on)
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in big.schema.fields if not isinstance(f.dataType, T.MapType)])
    cut = F.when(key.isin(heavy), F.pmod(row, F.lit(salts)).cast("int")).otherwise(0) if heavy else F.lit(0)
    times = F.when(key.isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))) if heavy else F.array(F.lit(0))
    return big.withColumn("__salt", cut).join(small.withColumn("__salt", F.explode(times)), [*on, "__salt"], how).drop("__salt")
