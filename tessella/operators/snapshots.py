"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import attach


def canonical_path(path: Column | str) -> Column:
    """The shortest relative form of a path: without `.` and empty components and
    without a slash at either end. `..` stays, as only the disk can resolve it.
    Names are bytes: letter case and accents are left alone. Null stays null; a
    path of nothing but dots and slashes gives the empty string."""
    path = F.col(path) if isinstance(path, str) else path
    short = F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), "/")
    plain = ~path.rlike(r"(?:^|/)\.?(?:/|\z)")
    return F.when(plain, path).otherwise(short)


def snapshot_diff(earlier: DataFrame, later: DataFrame, keys: list[str], compared: list[str], units: Mapping[str, str] | None = None) -> DataFrame:
    """Rows added, removed or changed from `earlier` to `later`.

    A full outer join on `keys`; where a side is missing the row was added or
    removed, and where hashes of the canonical rows differ it has changed. In
    the canonical rows of a pair a column of `compared` is left out if either
    side has null, as that says nothing; a column of `units` is first rounded
    down to the unit that the named column of either side states. Both sides
    must be unique on `keys`; a row with null in a key takes no part. Other
    columns, clashing names among them, are ignored. Returns `keys` and
    change_kind; an empty side makes every row of the other added or removed.
    """
    units = units or {}

    def side(df: DataFrame, tag: str) -> DataFrame:
        values = []
        for c in compared:
            v = F.col(c)
            if c in units:
                # Rounding toward minus infinity, for times before the epoch.
                v = v - F.pmod(v, F.greatest(F.coalesce(F.col(units[c]), F.lit(1)), F.lit(1)))
            values.append(v.alias(c))
        return df.dropna(subset=keys).select(*keys, F.struct(*values).alias(tag))

    def canonical(own: str, other: str) -> Column:
        return F.xxhash64(*[F.when(F.col(f"{other}.{c}").isNotNull(), F.col(f"{own}.{c}")) for c in compared])

    joined = side(earlier, "__was").join(side(later, "__is"), keys, "full_outer")
    kind = (
        F.when(F.col("__was").isNull(), "added")
        .when(F.col("__is").isNull(), "removed")
        .when(canonical("__was", "__is") != canonical("__is", "__was"), "changed")
    )
    return joined.select(*keys, kind.alias("change_kind")).filter(F.col("change_kind").isNotNull())


def snapshot_changes(snapshots: DataFrame, locations: DataFrame) -> DataFrame:
    """Changes of every snapshot of a tree against the one with the next smaller
    snap_no, whatever the gap: tree_id, snap_no, path, change_kind.

    The first snapshot of a tree gives nothing; one without records means that
    the tree was empty. A record delivered again counts once, the version
    delivered last being taken. Records without path or of an unknown snapshot,
    and snapshots without tree or number, take no part.
    """
    order = Window.partitionBy("tree_id").orderBy("snap_no")
    pairs = (
        snapshots.select("snapshot_id", "tree_id", "snap_no", F.coalesce("time_granularity_ns", F.lit(1)).cast("long").alias("unit"))
        .dropna(subset=["snapshot_id", "tree_id", "snap_no"])
        .dropDuplicates(["snapshot_id"])
        .withColumn("was_id", F.lag("snapshot_id").over(order))
        .withColumn("unit", F.greatest("unit", F.lag("unit").over(order)))
        .filter(F.col("was_id").isNotNull())
    )
    records = locations.select("snapshot_id", canonical_path("path").alias("path"), "size", "mtime", "inode", "delivered_at").dropna(subset=["snapshot_id", "path"])

    def side(of: str) -> DataFrame:
        chosen = pairs.select(F.col(of).alias("snapshot_id"), "tree_id", "snap_no", "unit")
        latest = F.max(F.struct("delivered_at", "size", "mtime", "inode", "unit")).alias("r")
        return attach(records, chosen, ["snapshot_id"]).groupBy("tree_id", "snap_no", "path").agg(latest).select("tree_id", "snap_no", "path", "r.size", "r.mtime", "r.inode", "r.unit")

    return snapshot_diff(side("was_id"), side("snapshot_id"), ["tree_id", "snap_no", "path"], ["size", "mtime", "inode"], {"mtime": "unit"})
