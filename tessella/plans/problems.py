"""Queries of the two general problems: hot keys (3) and snapshots (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunk_ids import chunk_key, chunk_key_sql, format_id
from ..operators.eager import chunk_states, eager_join_totals, size_states, sized_items, unusual_items
from ..operators.snapshots import snapshot_changes
from . import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose size differs from the usual size of their chunk."""
    return unusual_items(table(spark, d, "index_items")).select("index_id", "pos")


def p3_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Items, bytes and usual size of every chunk."""
    states = chunk_states(size_states(sized_items(table(spark, d, "index_items"))))
    return states.select(format_id(F.col("key")).alias("chunk_id"), "items", "sized_items", "bytes", "usual_size")


def p3_store_traffic(spark: SparkSession, d: str) -> DataFrame:
    """For each store: the item rows that it could serve and the bytes that serving them takes, by joining states and not rows."""
    items = table(spark, d, "index_items").select(chunk_key("chunk").alias("key"))
    stores = table(spark, d, "store_chunks").select(chunk_key("chunk").alias("key"), "store_id", "size")
    return eager_join_totals(items, stores, ["key"], {}, {"bytes": "size"}, by=["store_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records added, removed or changed between one snapshot of a tree and the next."""
    return snapshot_changes(table(spark, d, "snapshots"), table(spark, d, "locations"))


def p5_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes of each kind for every snapshot that has any."""
    return p5_found(spark, d).groupBy("tree_id", "snap_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


_SIZED = f"""
  raw AS (SELECT index_id, pos, end_offset, arrival_no, {chunk_key_sql('chunk')} AS k FROM index_items WHERE index_id IS NOT NULL AND pos IS NOT NULL),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_id, pos ORDER BY k IS NULL, end_offset IS NULL, arrival_no) AS rn FROM raw) WHERE rn = 1),
  sized AS (SELECT c.index_id, c.pos, c.k, c.end_offset - CASE WHEN c.pos = 0 THEN 0 ELSE p.end_offset END AS size
            FROM once c LEFT JOIN once p ON p.index_id = c.index_id AND p.pos = c.pos - 1),
  per AS (SELECT k, size, count(*) AS n FROM sized WHERE k IS NOT NULL AND size IS NOT NULL GROUP BY ALL),
  most AS (SELECT k, arg_max(size, n) AS top, max(n) AS most, sum(n) AS total FROM per GROUP BY k),
  usual AS (SELECT k, top AS usual_size FROM most WHERE most * 2 > total)"""

_CHANGES = """
  pairs AS (SELECT * FROM (SELECT snapshot_id, tree_id, snap_no, lag(snapshot_id) OVER w AS was_id, greatest(time_granularity_ns, lag(time_granularity_ns) OVER w) AS unit
            FROM snapshots WINDOW w AS (PARTITION BY tree_id ORDER BY snap_no)) WHERE was_id IS NOT NULL),
  recs AS (SELECT snapshot_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') AS path, size, mtime, inode, delivered_at FROM locations WHERE path IS NOT NULL),
  once AS (SELECT snapshot_id, path, arg_max(struct_pack(s := size, m := mtime, i := inode), delivered_at) AS r FROM recs GROUP BY ALL),
  was AS (SELECT tree_id, snap_no, unit, path, r FROM pairs JOIN once ON once.snapshot_id = was_id),
  cur AS (SELECT tree_id, snap_no, unit, path, r FROM pairs JOIN once USING (snapshot_id)),
  both_sides AS (SELECT coalesce(a.tree_id, b.tree_id) AS tree_id, coalesce(a.snap_no, b.snap_no) AS snap_no, coalesce(a.path, b.path) AS path,
    CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
      WHEN a.r.s <> b.r.s OR a.r.i <> b.r.i OR a.r.m // a.unit <> b.r.m // a.unit THEN 'changed' END AS change_kind
    FROM was a FULL OUTER JOIN cur b ON a.tree_id = b.tree_id AND a.snap_no = b.snap_no AND a.path = b.path),
  changes AS (SELECT * FROM both_sides WHERE change_kind IS NOT NULL)"""

QUERIES = {
    "p3_found": p3_found,
    "p3_chunk_stats": p3_chunk_stats,
    "p3_store_traffic": p3_store_traffic,
    "p5_found": p5_found,
    "p5_change_counts": p5_change_counts,
}

ORACLE = {
    "p3_found": f"WITH {_SIZED} SELECT index_id, pos FROM sized JOIN usual USING (k) WHERE size <> usual_size",
    "p3_chunk_stats": f"""WITH {_SIZED} SELECT s.k AS chunk_id, count(*) AS items, count(s.size) AS sized_items, CAST(coalesce(sum(s.size), 0) AS BIGINT) AS bytes, any_value(u.usual_size) AS usual_size
        FROM sized s LEFT JOIN usual u USING (k) WHERE s.k IS NOT NULL GROUP BY s.k""",
    "p3_store_traffic": f"""SELECT store_id, count(*) AS n_rows, CAST(sum(s.size) AS BIGINT) AS bytes FROM (SELECT {chunk_key_sql('chunk')} AS k FROM index_items) i
        JOIN (SELECT store_id, size, {chunk_key_sql('chunk')} AS k FROM store_chunks) s USING (k) GROUP BY store_id""",
    "p5_found": f"WITH {_CHANGES} SELECT tree_id, snap_no, path, change_kind FROM changes",
    "p5_change_counts": f"WITH {_CHANGES} SELECT tree_id, snap_no, change_kind, count(*) AS n FROM changes GROUP BY ALL",
}
