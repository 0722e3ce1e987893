"""Queries of the problems on identifiers (1, 2, 4) and texts (6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunk_ids import chunk_key, chunk_key_sql
from ..operators.lookup import attach
from ..plans import table
from ..session import spread, written
from .distinct import estimate, merge, new_days, sketch, standard_error
from .ledger import seen_before, wrong_answers
from .mixing import mixed
from .overlap import set_overlaps
from .packing import containers, packed
from .repetition import verdicts
from .tokens import token_count


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_items").select("arrival_no", F.col("arrival_no").alias("order"), chunk_key("chunk").alias("key")).filter(F.col("key").isNotNull())


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "store_chunks").select(chunk_key("chunk").alias("key"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose chunk is in a store or came with an earlier row."""
    return seen_before(_arrivals(spark, d), _stored(spark, d)).filter("seen").select("arrival_no")


def p1_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The share of wrong answers among all rows with a key."""
    return wrong_answers(seen_before(_arrivals(spark, d), _stored(spark, d)), _stored(spark, d))


def utc_day(col: str) -> Column:
    """The UTC date of a timestamp as yyyymmdd, whatever the time zone of the session."""
    micros, day = F.unix_micros(col), F.lit(86_400_000_000)
    date = F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int"))
    return F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)


def _tree_keys(spark: SparkSession, d: str) -> DataFrame:
    """tree_id, made_day and key of every item that has them."""
    meta = table(spark, d, "index_meta").select("index_id", "tree_id", utc_day("made_at").alias("made_day"))
    items = table(spark, d, "index_items").select("index_id", chunk_key("chunk").alias("key")).filter(F.col("key").isNotNull())
    return attach(items, meta, ["index_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of trees that share at least half of the chunks of the one that has fewer."""
    pairs = set_overlaps(_tree_keys(spark, d).select(F.col("tree_id").alias("set"), "key"))
    return pairs.filter(F.col("shared") * 2 >= F.least("size_a", "size_b")).select(F.col("set_a").alias("tree_a"), F.col("set_b").alias("tree_b"))


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Shared and own numbers of chunks of every pair of trees that share any."""
    pairs = set_overlaps(_tree_keys(spark, d).select(F.col("tree_id").alias("set"), "key"))
    return pairs.withColumnsRenamed({"set_a": "tree_a", "set_b": "tree_b"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Days of a tree, but its first, of whose chunks at least 60 % are on no earlier day."""
    return new_days(_tree_keys(spark, d)).select("tree_id", "made_day")


_SETS = [["tree_id", "made_day"], ["tree_id"], ["made_day"], []]


def _rollup(parts: DataFrame, how) -> DataFrame:
    """`how` of the sketches of each tree and day, tree, day, and of all."""
    out = None
    for by in _SETS:
        one = how(parts, by).select(*[F.col(c) if c in by else F.lit(None).cast("long" if c == "tree_id" else "int").alias(c) for c in ("tree_id", "made_day")], "estimate")
        out = one if out is None else out.unionByName(one)
    return out


def p4_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct chunks for each tree and day, tree, day, and of all, from merged sketches of trees and days."""
    parts = written(sketch(_tree_keys(spark, d), ["tree_id", "made_day"]), "sketches")
    return _rollup(parts, lambda s, by: estimate(merge(s, by), by)).withColumn("standard_error", F.lit(standard_error()))


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether each of those estimates is within five standard errors (and a half) of the exact number."""
    rows = _tree_keys(spark, d).distinct()
    exact = None
    for by in _SETS:
        one = rows.select(*by, "key").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_exact")).select(*[F.col(c) if c in by else F.lit(None).cast("long" if c == "tree_id" else "int").alias(c) for c in ("tree_id", "made_day")], "n_exact")
        exact = one if exact is None else exact.unionByName(one)
    a, b = p4_estimates(spark, d).alias("a"), exact.alias("b")
    met = a.join(b, F.col("a.tree_id").eqNullSafe(F.col("b.tree_id")) & F.col("a.made_day").eqNullSafe(F.col("b.made_day")))
    return met.select("a.tree_id", "a.made_day", "n_exact", (F.abs(F.col("estimate") - F.col("n_exact")) <= 5 * F.col("standard_error") * F.col("n_exact") + 0.5).alias("within_bound"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "message_id", "source", "text"))
    return written(docs.select("doc_id", "message_id", "source", token_count("text").alias("n_tokens")), "tokens")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container of each capacity with its messages, tokens and fill."""
    return containers(packed(_sizes(spark, d).select("doc_id", "n_tokens"), table(spark, d, "pack_capacities")))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """For each pack: messages, tokens, containers, the fewest that any packing could need, and the fill."""
    each = p6_containers(spark, d)
    per = each.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum(F.size("messages")).alias("pieces"))
    return per.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each pack: messages that are in it, and how many pieces are there twice, containers are overfull or hold other than they state, messages are divided without need or miss a part."""
    sizes = _sizes(spark, d)
    each = written(containers(packed(sizes.select("doc_id", "n_tokens"), table(spark, d, "pack_capacities"))), "containers")
    inside = F.aggregate("messages", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])
    full = each.groupBy("pack_name").agg(F.count_if((F.col("tokens") > F.col("capacity")) | (F.col("tokens") != inside)).alias("overfull"))
    pieces = each.select("pack_name", "capacity", F.inline("messages")).groupBy("pack_name", "capacity", "doc_id")
    per = pieces.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("piece_no").alias("different"), F.sum("n_tokens").alias("tokens")).join(sizes.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id")
    needed = F.ceil(F.col("whole") / F.col("capacity"))
    found = per.groupBy("pack_name").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("n") != F.col("different")).alias("doubled"), F.count_if(F.col("n") != needed).alias("divided"), F.count_if(F.col("tokens") != F.col("whole")).alias("cut"))
    return found.join(full, "pack_name")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each mix: its sources, messages used more often than allowed, sources off their plan by more than their longest message, and whether the shares sum to 1."""
    targets = table(spark, d, "source_targets")
    uses, shares = mixed(_sizes(spark, d), targets)
    per = uses.join(shares.select("mix_name", "source", "max_repeats"), ["mix_name", "source"]).groupBy("mix_name", "source").agg(F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") < 0)).alias("overused"), F.max("n_tokens").alias("longest"))
    met = shares.join(per, ["mix_name", "source"], "left")
    off = F.abs(F.col("used_tokens") - F.col("planned_tokens")) > F.coalesce("longest", F.lit(0))
    return met.groupBy("mix_name").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("overused"), F.lit(0)).alias("overused"), F.count_if(off).alias("off_plan"), (F.abs(F.sum("actual_share") - 1) < 1e-9).alias("whole"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """How often each mix uses each message of its sources."""
    return mixed(_sizes(spark, d), table(spark, d, "source_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of the sources of each mix."""
    return mixed(_sizes(spark, d), table(spark, d, "source_targets"))[1]


def p7_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """The same if each mix has to be as large as its sources: small ones are clamped and the others take their part."""
    return mixed(_sizes(spark, d), table(spark, d, "source_targets"), epochs=1.0)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose body repeats at least 35 % of its words."""
    return verdicts(table(spark, d, "documents")).filter("fails").select("doc_id")


def p8_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The share of repeated words of each message, and the verdict on its host."""
    return verdicts(table(spark, d, "documents"))


_KEYS = f"SELECT arrival_no, {chunk_key_sql('chunk')} AS k FROM index_items"
_SEEN = f"""WITH a AS (SELECT * FROM ({_KEYS}) WHERE k IS NOT NULL), s AS (SELECT DISTINCT {chunk_key_sql('chunk')} AS k FROM store_chunks),
  f AS (SELECT k, min(arrival_no) AS first_no FROM a GROUP BY k),
  v AS (SELECT arrival_no, arrival_no > first_no OR s.k IS NOT NULL AS seen FROM a JOIN f USING (k) LEFT JOIN s USING (k))"""
_TREES = f"""WITH t AS (SELECT DISTINCT tree_id, CAST(strftime(made_at AT TIME ZONE 'UTC', '%Y%m%d') AS INTEGER) AS made_day, {chunk_key_sql('chunk')} AS k FROM index_items JOIN index_meta USING (index_id)),
  u AS (SELECT DISTINCT tree_id, k FROM t WHERE k IS NOT NULL AND tree_id IS NOT NULL), z AS (SELECT tree_id, count(*) AS n FROM u GROUP BY tree_id),
  o AS (SELECT a.tree_id AS tree_a, b.tree_id AS tree_b, count(*) AS shared FROM u a JOIN u b ON a.k = b.k AND a.tree_id < b.tree_id GROUP BY ALL),
  w AS (SELECT tree_a, tree_b, shared, x.n AS size_a, y.n AS size_b FROM o JOIN z x ON x.tree_id = tree_a JOIN z y ON y.tree_id = tree_b)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_error_rate": p1_error_rate,
    "p2_found": p2_found,
    "p2_overlaps": p2_overlaps,
    "p4_found": p4_found,
    "p4_estimates": p4_estimates,
    "p4_bounds": p4_bounds,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_checks": p6_checks,
    "p7_uses": p7_uses,
    "p7_shares": p7_shares,
    "p7_shares_full": p7_shares_full,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_verdicts": p8_verdicts,
}

ORACLE = {
    "p1_found": f"{_SEEN} SELECT arrival_no FROM v WHERE seen",
    "p1_error_rate": f"{_SEEN} SELECT count(*) AS judged, count_if(seen) AS seen, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS error_rate FROM v",
    "p2_found": f"{_TREES} SELECT tree_a, tree_b FROM w WHERE shared * 2 >= least(size_a, size_b)",
    "p2_overlaps": f"{_TREES} SELECT tree_a, tree_b, shared, size_a, size_b FROM w",
    "p4_found": f"""{_TREES}, f AS (SELECT tree_id, k, min(made_day) AS first_day FROM t WHERE k IS NOT NULL GROUP BY ALL),
        e AS (SELECT t.tree_id, t.made_day, count(*) AS n, count_if(t.made_day = f.first_day) AS fresh FROM t JOIN f USING (tree_id, k) GROUP BY t.tree_id, t.made_day),
        g AS (SELECT tree_id, min(first_day) AS day_one FROM f GROUP BY tree_id)
        SELECT tree_id, made_day FROM e JOIN g USING (tree_id) WHERE made_day > day_one AND fresh >= 0.6 * n""",
    "p6_checks": "SELECT pack_name, count(*) AS messages, 0::BIGINT AS doubled, 0::BIGINT AS divided, 0::BIGINT AS cut, 0::BIGINT AS overfull FROM pack_capacities, documents WHERE strlen(text) > 0 GROUP BY pack_name",
    "p7_checks": "SELECT mix_name, count(DISTINCT replace(replace(lower(trim(source)), '_', '-'), ' ', '-')) AS sources, 0::BIGINT AS overused, 0::BIGINT AS off_plan, true AS whole FROM source_targets GROUP BY mix_name",
    "p4_bounds": f"{_TREES} SELECT tree_id, made_day, count(DISTINCT k) AS n_exact, true AS within_bound FROM t WHERE k IS NOT NULL GROUP BY GROUPING SETS ((tree_id, made_day), (tree_id), (made_day), ())",
}
