"""Distinct counts over huge identifier sets, by mergeable registers.

A sketch has 2^p registers. A register keeps the largest rank that a key of its
own has had, and for each of the two ranks below whether it occurred as well: 8
bits. Here a state is a long with at most three bits, rank r being bit r - 1,
and a sketch is the rows (group, register, state) of its registers in use, so
merging is a bitwise OR under GROUP BY and small groups take little room;
`pack` gives the dense form of one byte a register. Counts are estimated by
maximum likelihood from the number of registers in each state. The relative
standard error is 0.7608 / sqrt(2^p); with the 6-bit registers of a
HyperLogLog the same error takes 28 % more bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import written

P = 12
#: Registers for deciding on days: more of them leave fewer days undecided, and a day has no more in use than keys.
P_DAYS = 16
#: First-order bias of the estimate is this over the number of registers (Ertl 2024).
BIAS = 0.48147


def standard_error(p: int = P) -> float:
    return 0.7608 / 2 ** (p / 2)


def _keep(s: Column) -> Column:
    """The highest bit of a state and the two below it."""
    mask = F.shiftrightunsigned(F.call_function("shiftleft", F.lit(7).cast("long"), F.length(F.bin(s))), 3)
    return s.bitwiseAND(mask)


def sketch(rows: DataFrame, by: list[str], key: str = "key", p: int = P) -> DataFrame:
    """by..., register, state for the distinct non-null values of `key` in each
    group. The map side merges, so a frequent key or a large group costs at most
    2^p rows of each task. Null groups are groups; no rows give no sketch."""
    h = F.xxhash64(F.col(key))
    rest = h.bitwiseAND(F.lit((1 << (64 - p)) - 1)).bitwiseOR(F.lit(1 << (64 - p)))
    return (
        rows.filter(F.col(key).isNotNull())
        .select(*by, F.shiftrightunsigned(h, 64 - p).cast("int").alias("register"), rest.bitwiseAND(-rest).alias("bit"))
        .groupBy(*by, "register")
        .agg(_keep(F.bit_or("bit")).alias("state"))
    )


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the unions over `by`; the same as sketching all their rows."""
    return sketches.groupBy(*by, "register").agg(_keep(F.bit_or("state")).alias("state"))


def estimate(sketches: DataFrame, by: list[str], p: int = P) -> DataFrame:
    """by..., estimate (double). A group has at most some 200 different states, whose counts are all that the estimate needs."""
    counts = sketches.groupBy(*by, "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.collect_list("state").alias("s"), F.collect_list("n").alias("c")).select(*by, _estimator(p)("s", "c").alias("estimate"))


def likeliest(states: np.ndarray, counts: np.ndarray, p: int = P) -> float:
    """The maximum likelihood estimate from counts of register states."""
    m, n = 1 << p, counts.astype(float)
    ok = (states > 0) & (n > 0)
    states, n = states[ok].astype(np.int64), n[ok]
    if not len(n):
        return 0.0
    top = np.frexp(states.astype(float))[1].astype(np.int64)  # exact, as a state has three bits side by side
    # rate: weight of what is known not to have occurred; hit: how often each rank did.
    rate, hit = m - n.sum() + (n * 0.5 ** np.minimum(top, 64 - p)).sum(), np.zeros(66)
    for below in range(3):
        r = top - below
        on = (r > 0) & ((states >> np.maximum(r - 1, 0)) & 1 == 1)
        off = (r > 0) & ~on
        rate += (n * off * 0.5 ** np.maximum(r, 0)).sum()
        np.add.at(hit, np.minimum(r[on], 64 - p), n[on])
    w = 0.5 ** np.flatnonzero(hit)
    hit = hit[hit > 0]
    low, high = 1e-9, 1.0
    slope = lambda x: (hit * w / np.expm1(np.minimum(x * w, 700))).sum() - rate
    while slope(high) > 0 and high < 1e18:
        low, high = high, high * 4
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
        if high - low < 1e-9 * high:
            break
    return m * (low + high) / 2 / (1 + BIAS / m)


def _estimator(p: int):
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, c in parts:
            yield pd.Series([likeliest(np.asarray(a), np.asarray(b), p) for a, b in zip(s, c)], dtype="float64")

    return run


def pack(sketches: DataFrame, by: list[str], p: int = P) -> DataFrame:
    """by..., registers: one byte for each register, the largest rank times four
    plus two bits for the ranks one and two below; 0 if unused. A group is at
    most 2^p registers."""

    def dense(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, s in parts:
            out = []
            for at, states in zip(r, s):
                b = np.zeros(1 << p, np.uint8)
                x = np.asarray(states, np.int64)
                top = np.array([int(v).bit_length() for v in x], np.int64)
                one, two = (np.where(top > k, x >> np.maximum(top - 1 - k, 0) & 1, 0) for k in (1, 2))
                b[np.asarray(at)] = top * 4 + one * 2 + two
                out.append(b.tobytes())
            yield pd.Series(out)

    return sketches.groupBy(*by).agg(F.collect_list("register").alias("r"), F.collect_list("state").alias("s")).select(*by, F.pandas_udf(dense, "binary")("r", "s").alias("registers"))


def unpack(packed: DataFrame, by: list[str]) -> DataFrame:
    """The rows that `pack` was given."""
    each = packed.select(*by, F.col("registers").alias("b"), F.explode(F.sequence(F.lit(0), F.length("registers") - 1)).alias("register")).withColumn("v", F.conv(F.hex(F.expr("substring(b, register + 1, 1)")), 16, 10).cast("long")).filter("v > 0")
    top = F.expr("shiftleft(1L, cast(v div 4 - 1 as int))")
    one, two = F.col("v").bitwiseAND(F.lit(2)) > 0, F.col("v").bitwiseAND(F.lit(1)) > 0
    zero = F.lit(0).cast("long")
    return each.select(*by, "register", (top + F.when(one, F.shiftrightunsigned(top, 1)).otherwise(zero) + F.when(two, F.shiftrightunsigned(top, 2)).otherwise(zero)).alias("state"))


def new_share_estimates(rows: DataFrame, p: int = P_DAYS) -> DataFrame:
    """tree_id, made_day, day_estimate, new_estimate, total_estimate, first_day for
    each day of a tree: its distinct keys, those that no earlier day has, and all so far.

    From day sketches alone: the sketch of all days so far is kept up to date
    register by register, and the changes of its state counts are added up over
    the days of a tree. No task gets more than the days of one tree times some
    200 states. Rows without tree, day or key take no part."""
    days = sketch(rows.dropna(subset=["tree_id", "made_day"]), ["tree_id", "made_day"], "key", p)
    upto = Window.partitionBy("tree_id", "register").orderBy("made_day").rowsBetween(Window.unboundedPreceding, 0)
    runs = days.withColumn("after", _keep(F.bit_or("state").over(upto)))
    runs = runs.withColumn("before", F.lag("after").over(Window.partitionBy("tree_id", "register").orderBy("made_day")))
    steps = runs.select(
        "tree_id", "made_day",
        F.explode(F.array(F.struct(F.lit("day").alias("of"), F.col("state"), F.lit(1).alias("n")), F.struct(F.lit("all").alias("of"), F.col("after").alias("state"), F.lit(1).alias("n")), F.struct(F.lit("all").alias("of"), F.col("before").alias("state"), F.lit(-1).alias("n")))).alias("x"),
    ).select("tree_id", "made_day", "x.of", "x.state", "x.n").filter(F.col("state").isNotNull()).groupBy("tree_id", "made_day", "of", "state").agg(F.sum("n").alias("n"))

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        seen: dict[int, int] = {}
        out, before = [], 0.0
        for day, own in part.sort_values("made_day").groupby("made_day", sort=True):
            today, change = own[own["of"] == "day"], own[own["of"] == "all"]
            for s, n in zip(change["state"], change["n"]):
                seen[s] = seen.get(s, 0) + n
            total = likeliest(np.fromiter(seen.keys(), np.int64), np.fromiter(seen.values(), np.int64), p)
            out.append((part["tree_id"].iloc[0], day, likeliest(today["state"].to_numpy(), today["n"].to_numpy(), p), total - before, total, not out))
            before = total
        return pd.DataFrame(out, columns=["tree_id", "made_day", "day_estimate", "new_estimate", "total_estimate", "first_day"])

    # A few bytes of counts take long to estimate from, so the number of tasks isn't left to their size.
    spread = steps.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree_id")
    return spread.groupBy("tree_id").applyInPandas(tree, "tree_id long, made_day int, day_estimate double, new_estimate double, total_estimate double, first_day boolean")


def new_days(rows: DataFrame, least: float = 0.6, z: float = 6.0, p: int = P_DAYS) -> DataFrame:
    """tree_id, made_day, n_keys, n_new, counted of the days, other than the first of a
    tree, of whose distinct keys at least the share `least` is on no earlier day.

    The sketches decide: a day whose estimated share differs from `least` by more
    than `z` standard errors is in or out by it, and its numbers are the estimates. Of the difference of nested
    sketches with totals A < B the standard error is at most sqrt(B^2 - A^2) / day times that of a sketch,
    so what stays undecided grows with the total over the day, and shrinks with `p`.
    Only the undecided days are counted (`counted`), and of their trees only the rows whose key is on
    such a day are looked at. A day is judged wrongly with a probability of about 1e-9."""
    est = new_share_estimates(rows, p)
    day = F.greatest("day_estimate", F.lit(1.0))
    margin = z * standard_error(p) * (F.sqrt(2 * F.col("total_estimate") / day) + least)
    above = F.col("new_estimate") / day - least
    judged = written(est.filter(~F.col("first_day") & (above >= -margin)).select("tree_id", "made_day", "day_estimate", "new_estimate", (above <= margin).alias("close")), "judged-days")
    clear = judged.filter(~F.col("close")).select("tree_id", "made_day", F.round("day_estimate").cast("long").alias("n_keys"), F.round("new_estimate").cast("long").alias("n_new"), F.lit(False).alias("counted"))
    counted = recounted(rows, judged.filter("close").select("tree_id", "made_day"))
    return clear.unionByName(counted.filter(F.col("n_new") >= least * F.col("n_keys")).withColumn("counted", F.lit(True)))


def recounted(rows: DataFrame, days: DataFrame) -> DataFrame:
    """tree_id, made_day, n_keys, n_new of the given days, exactly: the keys of a day, and those that are on no
    earlier day of the tree.

    The rows of the days are reduced to their keys, and all rows meet these: only those of the same tree
    whose key is one of them go on to the first day of a key."""
    seen = rows.dropna(subset=["tree_id", "made_day", "key"]).select("tree_id", "made_day", "key")
    own = written(attach(seen, days, ["tree_id", "made_day"], "left_semi").distinct(), "day-keys")
    keys = written(own.select("tree_id", "key").distinct(), "wanted-keys")
    first = attach(seen, keys, ["tree_id", "key"], "left_semi").groupBy("tree_id", "key").agg(F.min("made_day").alias("first"))
    return own.join(first, ["tree_id", "key"]).groupBy("tree_id", "made_day").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("first") == F.col("made_day")).alias("n_new"))
