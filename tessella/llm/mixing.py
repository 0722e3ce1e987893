"""Mixing sources to target weights: capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import written

#: Parts of the hash range in which the cut of a fractional repetition is searched.
PARTS = 1 << 14


def source_name(col: Column | str) -> Column:
    """A source as it is compared: without letter case and outer white space, `_` like `-`; empty is null."""
    c = F.col(col) if isinstance(col, str) else col
    name = F.translate(F.lower(F.btrim(c, F.lit(" \t\r\n"))), "_ ", "--")
    return F.when(name != "", name)


def water_fill(weights: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """What each source contributes to `budget`: in proportion to its weight but at
    most its cap. Sources whose part would exceed their cap are clamped to it
    and what they can't take goes to the others in proportion, until it fits or
    all are clamped. Weights not above 0 get nothing."""
    out, open_, left = {k: 0.0 for k in weights}, {k for k, w in weights.items() if w and w > 0}, float(budget)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total >= caps[k]}
        if not full:
            out |= {k: left * weights[k] / total for k in open_}
            break
        out |= {k: float(caps[k]) for k in full}
        left -= sum(caps[k] for k in full)
        open_ -= full
    return out


def exact_budget(weights: dict[str, float], caps: dict[str, float]) -> float:
    """The largest size at which every source that has anything keeps its weight,
    the weights of absent sources being shared out. 0 if all are absent."""
    there = {k: w for k, w in weights.items() if w and w > 0 and caps[k] > 0}
    return min((caps[k] * sum(there.values()) / w for k, w in there.items()), default=0.0)


def mixed(messages: DataFrame, targets: DataFrame, seed: int = 0, epochs: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). uses: mix_name, source, doc_id, n_tokens, uses, one row for
    each message that a mix can draw on. shares: mix_name, source, target_share,
    max_repeats, available_tokens, epochs, planned_tokens, used_tokens, actual_share.

    `messages` has doc_id, message_id, source and n_tokens; `targets` mix_name,
    source, target_share and max_repeats: a short list of settings, which is
    collected. Sources are compared by `source_name`. A message filed under
    several ids (one message_id) is one message: in each mix only the copy
    with the smallest doc_id among the sources of that mix is used, so that it
    isn't repeated more often than allowed. The size of a mix is the largest at
    which the shares still are as wanted (`exact_budget`), or `epochs` times the
    tokens of its sources; `water_fill` divides it, with max_repeats times its
    tokens as cap of a source. Whole repetitions hold for all
    messages of a source; the rest is drawn in the order of a seeded hash until
    the planned tokens are met as nearly as whole messages can. Null or empty
    sources belong to no mix, absent sources give nothing, and null counts
    and targets are 0. The draw of one source is never ordered as a whole: of
    2^14 parts of the hash range only the one that holds the cut is.
    """
    spark = messages.sparkSession
    wanted: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("mix_name", source_name("source").alias("source"), "target_share", "max_repeats").dropna(subset=["mix_name", "source"]).collect():
        wanted.setdefault(r.mix_name, {})[r.source] = (r.target_share or 0.0, max(0, r.max_repeats or 0))
    named = spark.createDataFrame([(m, s) for m, x in wanted.items() for s in x], "mix_name string, source string")
    own = messages.select("doc_id", "message_id", source_name("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    one = F.coalesce("message_id", F.concat(F.lit("\x00"), F.col("doc_id").cast("string")))
    unit = attach(own, named, ["source"]).groupBy("mix_name", one.alias("message")).agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r"))
    unit = written(unit.select("mix_name", "r.*", F.xxhash64(F.lit(seed), "mix_name", "message").alias("draw")).withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int")), "mix")
    parts = written(unit.groupBy("mix_name", "source", "part").agg(F.sum("n_tokens").alias("tokens")), "mix-parts")

    held = {(r.mix_name, r.source): r.tokens for r in parts.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens")).collect()}
    plan = []
    for mix, x in wanted.items():
        have = {s: held.get((mix, s), 0) for s in x}
        weights, caps = {s: w for s, (w, _) in x.items()}, {s: have[s] * n for s, (_, n) in x.items()}
        budget = exact_budget(weights, caps) if epochs is None else epochs * sum(have.values())
        for s, tokens in water_fill(weights, caps, budget).items():
            whole = int(tokens // have[s]) if have[s] else 0
            plan.append((mix, s, float(x[s][0]), x[s][1], have[s], tokens / have[s] if have[s] else 0.0, tokens, whole, tokens - whole * have[s]))
    plan_df = spark.createDataFrame(plan, "mix_name string, source string, target_share double, max_repeats int, available_tokens long, epochs double, planned_tokens double, whole int, rest double")

    order = Window.partitionBy("mix_name", "source").orderBy("part")
    upto = F.sum("tokens").over(order)
    cut = attach(parts, plan_df.select("mix_name", "source", "rest"), ["mix_name", "source"]).withColumn("upto", upto).filter((F.col("upto") - F.col("tokens") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    cuts = [(r.mix_name, r.source, r.part, float(r.rest - (r.upto - r.tokens))) for r in cut.collect()]
    cut_df = spark.createDataFrame(cuts, "mix_name string, source string, cut int, need double")
    settings = plan_df.select("mix_name", "source", "whole", "max_repeats").join(cut_df, ["mix_name", "source"], "left")
    known = attach(unit, settings, ["mix_name", "source"])
    # Without a cut there is nothing left to draw, or whole repetitions have met the plan.
    clear = known.filter(F.col("cut").isNull() | (F.col("part") != F.col("cut"))).withColumn("more", (F.coalesce(F.col("part") < F.col("cut"), F.lit(False))).cast("int"))
    by_draw = Window.partitionBy("mix_name", "source").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    close = known.filter(F.col("part") == F.col("cut")).withColumn("more", (F.sum("n_tokens").over(by_draw) - F.col("n_tokens") / 2 <= F.col("need")).cast("int"))
    uses = clear.unionByName(close).select("mix_name", "source", "doc_id", "n_tokens", F.least(F.col("whole") + F.col("more"), F.col("max_repeats")).alias("uses"))

    used = uses.groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used"))
    shares = plan_df.join(used, ["mix_name", "source"], "left").withColumn("used_tokens", F.coalesce("used", F.lit(0)))
    total = F.sum("used_tokens").over(Window.partitionBy("mix_name"))
    shares = shares.select("mix_name", "source", "target_share", "max_repeats", "available_tokens", "epochs", "planned_tokens", "used_tokens", F.coalesce(F.try_divide("used_tokens", total), F.lit(0.0)).alias("actual_share"))
    return uses, shares
