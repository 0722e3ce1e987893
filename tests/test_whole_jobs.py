"""Queries over the whole of their tables."""

import pytest
from conftest import SMOKE
from oracle import connect, rows

from tessella.operators import index, tree
from tessella.plans import reference
from tessella.sources import archives

SMALL = "/root/testdata/sf0.01"
KEY = "ab" * 32


def test_items_above_the_size_of_their_own_index(spark, force_shuffle):
    items = spark.createDataFrame([(1, 1, 0, 10, KEY), (2, 1, 1, 21, KEY), (3, 2, 0, 11, KEY), (4, 3, 0, 11, KEY), (5, 3, 1, 50, KEY), (6, 4, 0, 41, KEY)], "arrival_no long, index_id long, pos int, end_offset long, chunk string")
    meta = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "index_id long, chunk_max long")
    assert {tuple(r) for r in index.violations(items, meta, 38).collect()} == {(1, 1, "too_large"), (3, 1, "too_large"), (4, 0, "too_large")}


def test_index_violations_of_too_large_items(spark):
    df = reference.QUERIES["index_violations"](spark, SMALL).filter("rule = 'too_large'").select("index_id", "pos")
    rel = connect(SMALL).sql(f"WITH {reference._SIZED} SELECT index_id, pos FROM sized LEFT JOIN index_meta USING (index_id) WHERE size > coalesce(chunk_max, 134217728)")
    got = rows(df.columns, df.collect())
    assert len(got) == 14 and got == rows(rel.columns, rel.fetchall())


def test_archives_of_every_snapshot(spark):
    made = reference.QUERIES["tree_archives"](spark, SMOKE).select("snapshot_id").collect()
    held = connect(SMOKE).sql("SELECT DISTINCT snapshot_id FROM locations JOIN snapshots USING (snapshot_id)").fetchall()
    assert sorted(r[0] for r in made) == sorted(r[0] for r in held) and len(made) == 40


def test_archives_keep_modes_and_times(spark):
    at = 1516216652243940905
    rows = [(t, p, k, m, x) for t in (1, 2, 3) for p, k, m, x in [("a", "dir", 0o755, at + 2), ("a/f", "file", 0o640 + (t == 2), at + (t == 3)), ("b/g", "file", None, None)]]
    full = tree.with_folders(spark.createDataFrame(rows, "tree_id long, path string, kind string, mode int, mtime_ns long"))
    made = archives.archives(full)
    got = {(r.tree_id, r.path): (r.mode & 0o7777, r.mtime_ns) for r in archives.unpacked(made).collect()}
    assert got == {(t, p): (m or 0, x or 0) for t, p, _, m, x in rows} | {(t, p): (0, 0) for t in (1, 2, 3) for p in ("", "b")}
    whole = {r.tree_id: bytes(r.archive) for r in made.collect()}
    parts = {}
    for r in sorted(archives.archive_parts(full).collect(), key=lambda r: (r.tree_id, r.start)):
        parts[r.tree_id] = parts.get(r.tree_id, b"") + bytes(r.data)
    assert parts == whole and len(set(whole.values())) == 3


def test_round_trip_of_modes_and_times(spark):
    got = reference.QUERIES["archive_round_trip"](spark, SMALL).collect()
    assert got and all(r.same == r.n for r in got)
    read = archives.unpacked(archives.archives(reference._archived(spark, SMOKE)), with_content=False)
    assert read.filter("mtime_ns > 0").count() > 700 and read.filter("mode & 4095 > 0").count() > 700
