"""The cache from locations to chunks, and files that have the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes of a block that a copy by reference can share.
BLOCK = 4096


def cache_verdicts(current: DataFrame, cache: DataFrame, on: list[str], checked: list[str]) -> DataFrame:
    """`current` with verdict: hit, miss or invalidated.

    `cache` has the columns `on` (unique) and `checked`. What isn't in the cache is a
    miss; what is there with other values in `checked` (null like null) is
    invalidated and has to be read again."""
    known = cache.select(*on, F.struct(*checked).alias("__kept"))
    met = current.join(known, on, "left")
    same = F.lit(True)
    for c in checked:
        same = same & F.col(c).eqNullSafe(F.col(f"__kept.{c}"))
    return met.withColumn("verdict", F.when(F.col("__kept").isNull(), "miss").when(same, "hit").otherwise("invalidated")).drop("__kept")


def chunk_origins(pieces: DataFrame, by: list[str], owner: str, place: str = "place") -> DataFrame:
    """by..., location_id, chunk, origin: what a cache keeps of chunks. `pieces` has the locations that make up the
    chunks (`owner` names one), their location_id and place; the key of a chunk is its first location, its origin
    the list of all."""
    per = pieces.groupBy(*by, owner).agg(F.array_sort(F.collect_list(F.struct(place, "location_id"))).alias("p"))
    ids = F.transform("p", lambda x: x["location_id"])
    return per.select(*by, ids[0].alias("location_id"), F.col(owner).alias("chunk"), ids.alias("origin"))


def verified_lookups(current: DataFrame, cache: DataFrame, by: list[str]) -> DataFrame:
    """`current` (by..., location_id, place: the locations of a tree as it is now, in the order of the walk) with
    chunk and verdict: hit, miss or invalidated.

    A location finds the entry of `chunk_origins` with its id as key. That entry counts only if its whole origin is there
    now: each of its locations, with equal path, offset, time, inode and generation as its id says, one behind the other.
    An entry that doesn't hold any more is invalidated. A key that stands twice in a cache counts once, with the
    smallest chunk."""
    entry = cache.groupBy(*by, "location_id").agg(F.min(F.struct("chunk", "origin")).alias("e")).select(*by, "location_id", "e.chunk", "e.origin")
    need = entry.select(*by, F.col("location_id").alias("__key"), F.posexplode("origin").alias("__k", "location_id"))
    now = current.groupBy(*by, "location_id").agg(F.min("place").alias("__place"))
    begun = F.col("__place") - F.col("__k")
    held = need.join(now, [*by, "location_id"]).groupBy(*by, "__key").agg(F.count(F.lit(1)).alias("__n"), F.min(begun).alias("__low"), F.max(begun).alias("__high"))
    whole = entry.join(held.withColumnRenamed("__key", "location_id"), [*by, "location_id"], "left")
    ok = F.coalesce((F.col("__n") == F.size("origin")) & (F.col("__low") == F.col("__high")), F.lit(False))
    judged = whole.select(*by, "location_id", F.when(ok, F.col("chunk")).alias("chunk"), F.when(ok, "hit").otherwise("invalidated").alias("verdict"))
    return current.join(judged, [*by, "location_id"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("miss")))


def cache_totals(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """by..., hits, misses, invalidated, added: added are the entries that the cache gets anew."""
    v = F.col("verdict")
    return verdicts.groupBy(*by).agg(F.count_if(v == "hit").alias("hits"), F.count_if(v == "miss").alias("misses"), F.count_if(v == "invalidated").alias("invalidated"), F.count_if(v != "hit").alias("added"))


def updated_cache(cache: DataFrame, verdicts: DataFrame, on: list[str], checked: list[str]) -> DataFrame:
    """The cache after a run: invalidated entries are replaced and missing ones added."""
    new = verdicts.filter(F.col("verdict") != "hit").select(*on, *checked)
    return cache.select(*on, *checked).join(new.select(*on), on, "left_anti").unionByName(new)


def hardlinks(files: DataFrame, digest: str = "digest") -> DataFrame:
    """digest, id, files, shared_bytes: files of equal metadata and content, the smallest id
    standing for all. `files` has digest, id and size."""
    per = files.filter(F.col(digest).isNotNull()).groupBy(digest).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("files"), F.max("size").alias("size"))
    return per.filter(F.col("files") > 1).select(digest, "id", "files", ((F.col("files") - 1) * F.col("size")).alias("shared_bytes"))


def reflinked(ranges: DataFrame, block: int = BLOCK) -> DataFrame:
    """`ranges` (target, source, size) with start and bytes of the part that can be shared
    block by block: source and target must be equally far into a block; 0 bytes otherwise."""
    target, source = F.col("target"), F.col("source")
    start = F.ceil(target / block).cast("long") * block
    end = F.floor((target + F.col("size")) / block).cast("long") * block
    ok = (F.pmod(target, F.lit(block)) == F.pmod(source, F.lit(block))) & (end > start)
    return ranges.withColumn("start", F.when(ok, start)).withColumn("bytes", F.when(ok, end - start).otherwise(F.lit(0).cast("long")))
