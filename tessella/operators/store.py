"""Chunk stores: lookups, puts, tombstones, garbage and the choice among providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import digest
from .lookup import attach

# Fixed value: the order in which providers are asked.
PROVIDERS = ["seed", "write-store", "cache-store", "read-store", "remote"]


def has(items: DataFrame, store: DataFrame, on: str = "chunk_id") -> DataFrame:
    """`items` that a store holds. Tombstones count as missing."""
    return attach(items, _present(store).select(on).dropna().distinct(), [on], "left_semi")


def lacks(items: DataFrame, store: DataFrame, on: str = "chunk_id") -> DataFrame:
    """The distinct ids of `items` that a store doesn't hold: what to fetch, or what a
    receiver has to be sent. Ids are made distinct on the map side before they are moved."""
    return items.select(on).dropna().distinct().join(_present(store).select(on), on, "left_anti")


def _present(store: DataFrame) -> DataFrame:
    return store.filter(~F.coalesce("missing", F.lit(False))) if "missing" in store.columns else store


def put(chunks: DataFrame, store: DataFrame, on: str = "chunk_id") -> DataFrame:
    """The rows to append to a store: of each id that it lacks one row, that of the
    smallest values of the other columns. An id that the store holds in any codec is left alone."""
    rest = [c for c in chunks.columns if c != on]
    one = chunks.filter(F.col(on).isNotNull()).groupBy(on).agg(F.min(F.struct(*rest)).alias("r")).select(on, "r.*")
    return one.join(store.select(on).distinct(), on, "left_anti")


def remove(store: DataFrame, ids: DataFrame, on: str = "chunk_id") -> DataFrame:
    """A store without the given ids, in all codecs."""
    return store.join(ids.select(on).distinct(), on, "left_anti")


def mark_missing(store: DataFrame, ids: DataFrame, on: str = "chunk_id") -> DataFrame:
    """A store with tombstones for the given ids that it doesn't hold."""
    known = store if "missing" in store.columns else store.withColumn("missing", F.lit(False))
    gone = ids.select(on).distinct().join(known.select(on), on, "left_anti").withColumn("missing", F.lit(True))
    return known.unionByName(gone, allowMissingColumns=True)


def verified(store: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """The rows of a store with `intact`: whether the digest of `data` is `chunk_id`,
    by the given algorithm or else by the other one."""
    other = "sha512-256" if algorithm == "sha256" else "sha256"
    given = F.unhex(F.col("chunk_id"))
    first = digest(F.col("data"), algorithm) == given
    return store.withColumn("intact", F.coalesce(first, F.lit(False))).withColumn("intact", F.when(F.col("intact"), True).otherwise(F.coalesce(digest(F.col("data"), other) == given, F.lit(False))))


def garbage(store: DataFrame, used: DataFrame, on: str = "chunk_id") -> DataFrame:
    """The rows of a store that no index refers to; nothing is deleted."""
    return store.join(used.select(on).dropna().distinct(), on, "left_anti")


def garbage_totals(store: DataFrame, used: DataFrame, on: str = "chunk_id") -> DataFrame:
    """One row: chunks that garbage collection removes and keeps, folders by id prefix that it empties."""
    marked = store.select(on).distinct().join(used.select(on).dropna().distinct().withColumn("__used", F.lit(True)), on, "left").withColumn("dir", F.substring(on, 1, 4))
    per = marked.groupBy("dir").agg(F.count_if(F.col("__used").isNull()).alias("r"), F.count_if("__used").alias("k"))
    return per.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("removed"), F.coalesce(F.sum("k"), F.lit(0)).alias("kept"), F.count_if(F.col("k") == 0).alias("folders_emptied"))


def usage(items: DataFrame, on: str = "chunk_id") -> DataFrame:
    """One row: references to chunks and different chunks among them."""
    per = items.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.count(F.lit(1)).alias("chunks"))


def providers(sources: list[tuple[str, DataFrame]], on: str = "chunk_id") -> DataFrame:
    """on, provider, priority: who serves each id, the first of `sources` (name, ids) that holds it."""
    union = None
    for k, (name, ids) in enumerate(sources):
        one = _present(ids).select(on).dropna().distinct().select(on, F.lit(k).alias("priority"), F.lit(name).alias("provider"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy(on).agg(F.min(F.struct("priority", "provider")).alias("r")).select(on, "r.provider", "r.priority")


def provider_totals(items: DataFrame, sources: list[tuple[str, DataFrame]], on: str = "chunk_id") -> DataFrame:
    """provider (null: nobody), requests, bytes and the share of all requests in per cent.

    `items` has the id and size of each request. They are reduced to one row for each id
    before they meet the providers, so a chunk that is asked for most of the time
    is a single row."""
    per = items.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    got = per.join(providers(sources, on), on, "left").groupBy("provider").agg(F.sum("n").alias("requests"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
    return got.withColumn("percent", F.floor(F.col("requests") * 100 / F.sum("requests").over(Window.partitionBy())).cast("long"))


def resolve(items: DataFrame, sources: list[tuple[str, DataFrame]], on: str = "chunk_id") -> DataFrame:
    """`items` with the provider that each is taken from, null if there is none. The
    distinct ids are on the other side, so no row multiplies."""
    return attach(items, providers(sources, on).select(on, "provider"), [on], "left")
