"""Overlap sizes between many large sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def set_overlaps(members: DataFrame) -> DataFrame:
    """set_a, set_b, shared, size_a, size_b for every pair of sets that share a
    member; set_a < set_b. `members` has the columns `set` and `key`; repeated
    rows count once, rows with null in either take no part.

    Members are collapsed to the sorted list of the sets they are in, equal
    lists are counted, and only each different list is expanded into pairs,
    weighted by its count. So a key in half of all rows costs one list, no
    intersection is built, and the numbers are exact. The lists are as long as
    there are sets, never as the sets are large; the map side already merges.
    """
    lists = members.dropna(subset=["set", "key"]).groupBy("key").agg(F.sort_array(F.collect_set("set")).alias("sets")).groupBy("sets").agg(F.count(F.lit(1)).alias("n"))
    # A set paired with itself gives its size in the same pass.
    first = lists.select("sets", "n", F.posexplode("sets").alias("i", "set_a"))
    pairs = first.select("set_a", F.explode(F.expr("slice(sets, i + 1, size(sets))")).alias("set_b"), "n").groupBy("set_a", "set_b").agg(F.sum("n").alias("shared"))
    pairs = written(pairs, "overlaps")
    size = pairs.filter(F.col("set_a") == F.col("set_b"))
    return (
        pairs.filter(F.col("set_a") < F.col("set_b"))
        .join(size.select("set_a", F.col("shared").alias("size_a")), "set_a")
        .join(size.select("set_b", F.col("shared").alias("size_b")), "set_b")
        .select("set_a", "set_b", "shared", "size_a", "size_b")
    )
