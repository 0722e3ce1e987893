"""Keys seen before (1), overlaps of sets (2) and distinct counts (4)."""

import itertools
import random
import re

import numpy as np
import pytest
from conftest import SMOKE
from oracle import compare
from pyspark.sql import functions as F

from tessella.llm import distinct, queries
from tessella.llm.ledger import KeyLedger, seen_before, wrong_answers
from tessella.llm.overlap import set_overlaps
from tessella.session import settings

SQL = sorted(k for k in queries.ORACLE if k[1] in "124")


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    compare(queries.QUERIES[name](spark, SMOKE), queries.ORACLE[name], SMOKE)


def key(k):
    return None if k is None else bytearray(k.to_bytes(32, "big"))


def seen_frames(spark, rows, history):
    r = spark.createDataFrame([(key(k), o, n, "x") for n, (k, o) in enumerate(rows)], "key binary, order long, n long, seen string")
    h = spark.createDataFrame([(key(k), "y") for k in history], "key binary, order string")
    return r, h


def brute_seen(rows, history):
    out = []
    for k, o in rows:
        if k is None:
            out.append(None)
            continue
        late = o is None
        out.append(k in history or any(x == k and y is not None and (late or y < o) for x, y in rows))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_seen_before_by_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([None, 0, 0, 0, *range(1, 30)]), r.choice([None, *range(60)]) if seed else r.randrange(10**15)) for _ in range(200)]
    history = [r.choice([None, *range(20, 40)]) for _ in range(10)] * 2
    a, b = seen_frames(spark, rows, history)
    judged = seen_before(a, b, batches=4, buckets=3)
    got = {x.n: x.seen for x in judged.collect()}
    assert [got[n] for n in range(len(rows))] == brute_seen(rows, set(history))
    one = wrong_answers(judged, b).first()
    assert (one.judged, one.wrong, one.error_rate) == (sum(k is not None for k, _ in rows), 0, 0.0)


def test_wrong_answers_are_counted(spark, force_shuffle):
    a, b = seen_frames(spark, [(1, 1), (1, 2), (2, 3), (3, 4)], [3])
    judged = seen_before(a, b).withColumn("seen", a["n"] == -1)
    one = wrong_answers(judged, b).first()
    assert (one.judged, one.seen, one.wrong, one.error_rate) == (4, 0, 2, 0.5)


def test_nothing_was_seen(spark):
    a, b = seen_frames(spark, [], [])
    assert seen_before(a, b).collect() == []
    assert tuple(wrong_answers(seen_before(a, b), b).first()) == (0, 0, 0, 0.0)
    a, b = seen_frames(spark, [(None, 1), (5, None), (5, None)], [])
    assert {x.n: x.seen for x in seen_before(a, b).collect()} == {0: None, 1: False, 2: False}


def test_ledger_keeps_each_key_once(spark):
    ledger = KeyLedger(spark, buckets=2)
    a, b = seen_frames(spark, [(1, 5), (1, 4), (2, 6)], [2, 2, 9])
    ledger.add_history(b)
    ledger.take_in(a)
    ledger.take_in(seen_frames(spark, [(1, 9), (7, 8), (7, 9)], [])[0])
    held = {int.from_bytes(r.key, "big"): (r.first_order, r.batch) for r in ledger.table().collect()}
    assert held == {2: (None, 0), 9: (None, 0), 1: (4, 1), 7: (8, 2)} and ledger.table().count() == 4
    ledger.drop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def history_side(plan):
    """Lines of a plan that stand above a scan of the ledger within its own branch: (sorts, exchanges)."""
    lines = plan.splitlines()
    depth = lambda x: len(re.match(r"(?:[ :]  )*(?:[+:]- )?", x)[0])
    found = []
    for k, line in enumerate(lines):
        if "FileScan" in line and "ledger" in line:
            at = depth(line)
            for up in reversed(lines[:k]):
                if depth(up) < at:
                    at = depth(up)
                    if "SortMergeJoin" in up:
                        break
                    found.append(up.strip())
    return found


def test_history_is_neither_sorted_nor_shuffled(spark):
    ledger = KeyLedger(spark, buckets=3)
    ledger.add_history(seen_frames(spark, [], range(50))[1])
    for k in range(3):
        ledger.take_in(seen_frames(spark, [(j, 100 * k + j) for j in range(40 * k, 40 * k + 60)], [])[0])
    assert len(ledger.generations) == 4 and all(len(set(f.rsplit("_", 1)[1] for f in spark.table(g.table).inputFiles())) == len(spark.table(g.table).inputFiles()) for g in ledger.generations), "one file to a bucket"
    with ledger._planned(), settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = plan_of(ledger.new_keys(seen_frames(spark, [(7, 900), (500, 901)], [])[0]))
        above = history_side(plan)
        assert plan.count("SortMergeJoin") == 4 and above and not any("Sort " in x or "Exchange" in x for x in above), plan
        # All that is sorted and shuffled is the batch: one exchange, one sort.
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and plan.count("HashAggregate") == 2, plan
    ledger.compact()
    assert len(ledger.generations) < 4
    ledger.drop()


def test_compaction_keeps_all_and_a_ledger_can_be_opened_again(spark, tmp_path):
    at, want = f"file://{tmp_path}/kept", {}
    ledger = KeyLedger(spark, buckets=2, path=at)
    ledger.add_history(seen_frames(spark, [], [1, 2, None])[1])
    want |= {1: (None, 0), 2: (None, 0)}
    for k in range(1, 12):
        rows = [(j, 10 * k + j % 10) for j in range(k, 3 * k + 2)]
        ledger.take_in(seen_frames(spark, rows, [])[0])
        for j, o in sorted(rows, key=lambda r: r[1]):
            want.setdefault(j, (o, k))
        if k == 6:  # a failed batch leaves files behind that no manifest names; another session goes on
            ledger._write(ledger.table().limit(1))
            before = spark.catalog.listTables()
            ledger.close()
            assert not [t for t in spark.catalog.listTables() if t.name in {g.table for g in ledger.generations}] and before
            ledger = KeyLedger(spark, buckets=99, path=at)
            assert (ledger.buckets, ledger.batches) == (2, 6)
    held = [(int.from_bytes(r.key, "big"), (r.first_order, r.batch)) for r in ledger.table().collect()]
    assert dict(held) == want and len(held) == len(want) and len(ledger.generations) <= 8
    assert {r.batch for r in ledger.table(since=10).collect()} == {b for _, b in want.values() if b >= 10}
    ledger.drop()


def test_nothing_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    a, b = seen_frames(spark, [(1, 1), (1, 2), (None, None), (2, None), (2, None)], [3])
    judged = seen_before(a, b)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert {x.n: x.seen for x in judged.collect()} == {0: False, 1: True, 2: None, 3: False, 4: False}


def test_hot_key_without_order_is_split(spark, force_shuffle):
    a, b = seen_frames(spark, [(1, None)] * 3000 + [(k, None) for k in range(2, 40)] + [(2, 5)], [3])
    got = seen_before(a, b).groupBy("seen").count().collect()
    assert {r.seen: r["count"] for r in got} == {True: 2, False: 3037}
    parts = seen_before(a, b).filter("order IS NULL").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 3000


def test_rows_of_one_order_and_key_are_split_at_run_time(spark):
    rows = spark.range(30_000).selectExpr("unhex('01') AS key", "CAST(7 AS BIGINT) AS `order`", "sha2(CAST(id AS STRING), 256) AS pad")
    rows = rows.unionByName(spark.range(3000).selectExpr("unhex(sha2(CAST(id AS STRING), 256)) AS key", "id AS `order`", "'x' AS pad"))
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with settings(spark, small):
        judged = seen_before(rows, rows.select("key").limit(0))
        got = judged.collect()
        assert "skew=true" in plan_of(judged)
    assert len(got) == 33_000 and not any(r.seen for r in got)


def test_overlaps_by_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(8)]), r.choice([None, 0, 0, *range(25)])) for _ in range(400)]
    df = spark.createDataFrame([(s, key(k), "x", 1) for s, k in rows], "`set` long, key binary, sets string, n int")
    sets = {}
    for s, k in rows:
        if s is not None and k is not None:
            sets.setdefault(s, set()).add(k)
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b]}
    got = set_overlaps(df).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert set_overlaps(df.limit(0)).collect() == []


def sketch_rows(spark, pairs):
    return spark.createDataFrame([(g, key(k), "x") for g, k in pairs], "g string, key binary, state string")


def test_merge_is_lossless_and_packing_round_trips(spark):
    rows = sketch_rows(spark, [("a" if k % 3 else None, k % 900) for k in range(3000)] + [("a", None)])
    for p in (4, 8, 12):
        parts = distinct.sketch(rows, ["g"], p=p)
        whole = distinct.sketch(rows, [], p=p)
        assert sorted(map(tuple, distinct.merge(parts, []).collect())) == sorted(map(tuple, whole.collect()))
        packed = distinct.pack(parts, ["g"], p)
        assert {len(x.registers) for x in packed.collect()} == {1 << p}
        assert sorted(map(str, distinct.unpack(packed, ["g"]).select(*parts.columns).collect())) == sorted(map(str, parts.collect()))


def test_estimates_of_small_and_empty_groups(spark):
    rows = sketch_rows(spark, [("one", 1)] * 50 + [("three", k) for k in (1, 2, 3)] + [("none", None)])
    got = {r.g: r.estimate for r in distinct.estimate(distinct.sketch(rows, ["g"]), ["g"]).collect()}
    assert set(got) == {"one", "three"} and abs(got["one"] - 1) < 0.01 and abs(got["three"] - 3) < 0.01
    assert distinct.estimate(distinct.sketch(rows.limit(0), ["g"]), ["g"]).collect() == []


def test_error_is_as_stated():
    """Over simulated sketches of true sizes from 10 to a million the relative error has the stated spread and no bias to speak of."""
    rng, p = np.random.default_rng(1), 8
    m = 1 << p
    for n in (10, 300, 5_000, 1_000_000):
        errors = []
        for _ in range(150):
            reg = rng.integers(0, m, n)
            rank = np.minimum(rng.geometric(0.5, n), 64 - p + 1)
            state = np.zeros(m, np.int64)
            np.bitwise_or.at(state, reg, np.int64(1) << (rank - 1))
            top = np.array([int(s).bit_length() for s in state])
            kept = np.where(top > 0, state & ((np.int64(7) << top) >> 3), 0)
            s, c = np.unique(kept[kept > 0], return_counts=True)
            errors.append(distinct.likeliest(s, c, p) / n - 1)
        assert np.std(errors) < 1.15 * distinct.standard_error(p), n
        assert abs(np.mean(errors)) < 3.5 * max(np.std(errors), 1e-3) / np.sqrt(150), n


def test_estimate_from_spark_is_close(spark):
    rows = spark.range(200_000).selectExpr("unhex(sha2(cast(id as string), 256)) AS key", "id % 2 AS g")
    parts = distinct.sketch(rows, ["g"])
    both = distinct.estimate(distinct.merge(parts, []), []).first().estimate
    assert abs(both / 200_000 - 1) < 4 * distinct.standard_error()


def days_frame(spark, rows):
    return spark.createDataFrame([(t, d, key(k), "x") for t, d, k in rows], "tree_id long, made_day int, key binary, n_keys string")


def test_new_days(spark, force_shuffle):
    rows = [(1, 1, k) for k in range(100)] + [(1, 2, k) for k in range(95, 105)] + [(1, 3, k) for k in range(200, 400)] + [(1, 4, k) for k in (*range(4), *range(900, 906))]
    rows += [(2, 5, 1), (2, 6, 1), (None, 1, 1), (3, None, 1), (3, 1, None), (2, 7, 2)] * 3
    exact = {(1, 3): (200, 200), (1, 4): (10, 6), (2, 7): (1, 1)}
    got = distinct.new_days(days_frame(spark, rows)).collect()
    assert {(r.tree_id, r.made_day) for r in got} == set(exact) and len(got) == 3
    for r in got:
        n, new = exact[r.tree_id, r.made_day]
        off = 0 if r.counted else 6 * distinct.standard_error(distinct.P_DAYS) * 700
        assert abs(r.n_keys - n) <= off and abs(r.n_new - new) <= off
    assert {(r.tree_id, r.made_day) for r in got if r.counted} >= {(1, 4)}, "a day at the limit is counted"
    every = [(t, d) for t in (1, 2) for d in range(1, 8)]
    counts = {tuple(r) for r in distinct.recounted(days_frame(spark, rows), spark.createDataFrame(every, "tree_id long, made_day int")).collect()}
    assert counts == {(1, 1, 100, 100), (1, 2, 10, 5), (1, 3, 200, 200), (1, 4, 10, 6), (2, 5, 1, 1), (2, 6, 1, 0), (2, 7, 1, 1)}
    assert distinct.new_days(days_frame(spark, rows).limit(0)).collect() == []


def test_few_days_of_a_long_history_are_counted(spark):
    """200 days of a tree, mostly kept chunks: the sketches alone decide on all but the few days near the limit."""
    df = spark.range(200).selectExpr("CAST(1 AS BIGINT) AS tree_id", "CAST(id AS INT) AS made_day", "CASE WHEN id % 40 = 39 THEN 0.9 WHEN id % 40 = 20 THEN 0.6 ELSE 0.08 END AS share")
    rows = df.selectExpr("*", "explode(sequence(0, 1999)) AS k").selectExpr("tree_id", "made_day", "unhex(sha2(concat(CASE WHEN made_day = 0 OR k < round(2000 * share) THEN concat(made_day, '-') ELSE '0-' END, k), 256)) AS key")
    got = distinct.new_days(rows).collect()
    assert {r.made_day for r in got} == {d for d in range(200) if d % 40 in (20, 39)}
    assert {r.made_day for r in got if r.counted} <= {d for d in range(200) if d % 40 == 20}


def test_new_shares_from_sketches_alone(spark):
    rows = [(1, d, d * 3000 + k) for d in range(3) for k in range(5000)]
    got = sorted((r.made_day, r.day_estimate, r.new_estimate, r.first_day) for r in distinct.new_share_estimates(days_frame(spark, rows)).collect())
    for (day, own, new, first), want in zip(got, (5000, 3000, 3000)):
        assert abs(own / 5000 - 1) < 0.06 and abs(new / want - 1) < 0.12 and first == (day == 0)


def test_utc_day(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            rows = spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (1514764799999999), (1514764800000000), (-1), (0), (null) AS v(x)")
            assert [r.d for r in rows.select(queries.utc_day("t").alias("d")).collect()] == [20171231, 20180101, 19691231, 19700101, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
