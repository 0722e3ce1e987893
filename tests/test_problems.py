"""Hot keys (3) and snapshots (5): exact results, and the odd inputs."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from conftest import SMOKE
from oracle import compare

from tessella.operators.eager import BLOCK, chunk_states, eager_join_totals, size_states, sized_items, unusual_items
from tessella.operators.lookup import attach, fits
from tessella.operators.snapshots import canonical_path, snapshot_changes, snapshot_diff
from tessella.plans import problems

ITEMS = "arrival_no long, index_id long, pos int, end_offset long, chunk string, size string, key string"
K = [f"{k:02x}" * 32 for k in range(40)]


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ITEMS)


@pytest.mark.parametrize("name", sorted(problems.QUERIES))
def test_against_sql(spark, name):
    compare(problems.QUERIES[name](spark, SMOKE), problems.ORACLE[name], SMOKE)


def brute_unusual(rows):
    once = {}
    for n, i, p, e, c in rows:
        if i is None or p is None:
            continue
        key = c.strip().lower().removeprefix("0x") if c else None
        key = key if key and len(key) == 64 else None
        rank = (key is None, e is None, n if n is not None else -1)
        if (i, p) not in once or rank < once[i, p][0]:
            once[i, p] = (rank, e, key)
    size, per = {}, defaultdict(Counter)
    for (i, p), (_, e, k) in once.items():
        before = 0 if p == 0 else once.get((i, p - 1), (0, None))[1]
        if k and e is not None and before is not None:
            size[i, p] = (k, e - before)
            per[k][e - before] += 1
    usual = {k: next((s for s, n in c.items() if n * 2 > sum(c.values())), None) for k, c in per.items()}
    return {at for at, (k, s) in size.items() if usual[k] is not None and s != usual[k]}


def random_items(seed, n=600):
    r = random.Random(seed)
    rows, no = [], 0
    for index in range(5):
        end = 0
        for pos in range(n // 5):
            k = 0 if r.random() < 0.4 else r.randrange(1, 9)
            end += 100 + k if r.random() < 0.9 else r.randrange(1, 300)
            c = K[k]
            c = r.choice([c, c, c, c.upper(), f" {c}\n", "0x" + c, None, "", c[:60], "nothing"])
            for _ in range(1 + (r.random() < 0.1)):
                rows.append((no, r.choice([index, index, index, None]) if r.random() < 0.05 else index, pos if r.random() > 0.02 else None, end if r.random() > 0.03 else None, c))
                no += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_unusual_items_by_brute_force(spark, seed):
    rows = random_items(seed)
    got = unusual_items(items_of(spark, rows)).select("index_id", "pos").collect()
    assert len(got) == len(set(got)) and {tuple(g) for g in got} == brute_unusual(rows)


def test_sizes_across_blocks(spark):
    rows = [(p, 1, p, (p + 1) * 10, K[p % 3]) for p in range(2 * BLOCK + 5)]
    got = {r.pos: r.size for r in sized_items(items_of(spark, rows)).collect()}
    assert got == {p: 10 for p in range(2 * BLOCK + 5)}


def test_spans_of_items_delivered_again(spark):
    from tessella.operators import index

    rows = [(0, 1, 0, 100, K[0]), (1, 1, 1, 999, "broken"), (2, 1, 1, 300, K[1]), (3, 1, 2, None, K[2]), (4, 1, 3, 500, K[3]), (5, 1, 2, 400, "broken")]
    got = {(r.pos, r.start, r.end) for r in index.spans(items_of(spark, rows)).collect()}
    assert got == {(0, 0, 100), (1, 100, 300)}


def test_unusual_items_of_nothing(spark):
    assert unusual_items(items_of(spark, [])).collect() == []
    only_broken = [(1, 1, 0, 5, None), (2, None, None, None, K[1]), (3, 2, 1, 5, K[1])]
    assert unusual_items(items_of(spark, only_broken)).collect() == []


def test_usual_size_needs_a_majority(spark):
    rows = [(k, k, 0, size, K[0]) for k, size in enumerate([5, 5, 7, 9])]
    state = chunk_states(size_states(sized_items(items_of(spark, rows)))).collect()[0]
    assert (state.items, state.bytes, state.usual_size) == (4, 26, None)


def test_hot_unusual_size_is_found(spark):
    rows = [(k, k, 0, 5 if k % 3 else 8, K[0]) for k in range(300)]
    assert {r.index_id for r in unusual_items(items_of(spark, rows)).collect()} == {k for k in range(300) if k % 3 == 0}


def test_eager_join_totals_equal_the_join(spark):
    r = random.Random(4)
    left = [(r.choice([None, "hot", "hot", "a", "b"]), r.choice([1, 2, None]), "x") for _ in range(200)]
    right = [(r.choice([None, "hot", "a", "c"]), r.choice([10, 20, None]), r.choice(["s", "t", None])) for _ in range(60)]
    l = spark.createDataFrame(left, "k string, v long, g string")
    rt = spark.createDataFrame(right, "k string, v long, g string")
    got = {x.g: (x.n_rows, x.lv, x.rv) for x in eager_join_totals(l, rt, ["k"], {"lv": "v"}, {"rv": "v"}, by=["g"]).collect()}
    want = {}
    for a, v, _ in left:
        for b, w, g in right:
            if a is not None and a == b:
                n, x, y = want.get(g, (0, None, None))
                want[g] = (n + 1, x if v is None else (x or 0) + v, y if w is None else (y or 0) + w)
    assert got == want
    empty = eager_join_totals(l.limit(0), rt, ["k"], {"lv": "v"}, {}).collect()
    assert [tuple(x) for x in empty] == [(0, None)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_is_the_join(spark, how, monkeypatch):
    big = spark.createDataFrame([(k % 4 if k % 7 else None, k, "v") for k in range(100)], "k long, n long, v string")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d"), (None, "e")], "k long, w string")
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert fits(small) and not fits(small, max_rows=4)
    assert sorted(map(str, attach(big, small, ["k"], how).collect())) == want
    from tessella.operators import lookup

    monkeypatch.setattr(lookup, "fits", lambda *a, **k: False)
    assert sorted(map(str, attach(big, small, ["k"], how).collect())) == want
    assert attach(big, small.limit(0), ["k"], "inner").count() == 0 and attach(big.limit(0), small, ["k"], how).count() == 0


def test_heavy_keys_are_split(spark, force_shuffle):
    from tessella.operators.lookup import heavy_hashes

    big = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS n", "cast(null AS string) AS v")
    assert len(heavy_hashes(big, ["k"])) == 1
    small = spark.range(30_000).selectExpr("id AS k", "id * 2 AS w")
    joined = attach(big, small, ["k"], salts=8)
    assert joined.count() == 20_000 and joined.filter("w <> k * 2").count() == 0


@pytest.mark.parametrize(
    "path, want",
    [("a/b", "a/b"), ("./a//b/", "a/b"), ("/a/./././b", "a/b"), ("a/../b", "a/../b"), (".a/..b/c.", ".a/..b/c."), ("A/a", "A/a"), ("é", "é"), ("é", "é"), ("a/.", "a"), ("a\n", "a\n"), ("a/\n", "a/\n"), (".", ""), ("", ""), ("//", ""), (None, None), ("x" * 100_000 + "/./y", "x" * 100_000 + "/y")],
)
def test_canonical_path(spark, path, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(canonical_path("path")).first()[0] == want


def diff(spark, a, b, **k):
    schema = "k long, v long, t long, unit long, other string, change_kind string"
    return {r.k: r.change_kind for r in snapshot_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], ["v", "t"], {"t": "unit"}).collect()}


def test_snapshot_diff(spark):
    a = [(1, 5, 1999, 1000, "x", "c"), (2, 5, 1, 1, "x", "c"), (3, None, 7, 1, "x", "c"), (4, 1, 1, 1, "x", "c"), (None, 1, 1, 1, "x", "c"), (6, 1, -1, 1000, "x", "c")]
    b = [(1, 5, 1000, 1000, "y", "d"), (2, 6, 1, 1, "y", "d"), (3, 9, 7, None, "y", "d"), (5, 1, 1, 1, "y", "d"), (None, 2, 2, 1, "y", "d"), (6, 1, -1000, 1000, "y", "d")]
    assert diff(spark, a, b) == {2: "changed", 4: "removed", 5: "added"}
    assert diff(spark, a, []) == {k: "removed" for k in (1, 2, 3, 4, 6)}
    assert diff(spark, [], []) == {}


def test_snapshot_changes(spark, force_shuffle):
    t = datetime.datetime(2018, 1, 1)
    snaps = [(1, 7, 1, 1), (2, 7, 3, 1000), (3, 7, 4, None), (3, 7, 4, None), (4, None, 1, 1), (5, 8, None, 1), (6, 7, 9, 1)]
    loc = [
        (1, "./a", 1, 1500, 9, t), (1, "b", 2, 10, 9, t), (1, "gone", 2, 10, 9, t), (1, None, 2, 10, 9, t),
        (2, "a", 1, 1000, 9, t), (2, "a", 1, 1000, 9, t), (2, "b/", None, 10, None, t), (2, "new", 1, 1, 1, t), (2, "A", 1, 1, 1, t),
        (6, "a", 1, 1, 1, t), (6, "a", 2, 1, 1, t + datetime.timedelta(1)), (99, "z", 1, 1, 1, t),
    ]
    s = spark.createDataFrame([(*x, "extra") for x in snaps], "snapshot_id long, tree_id long, snap_no int, time_granularity_ns long, path string")
    l = spark.createDataFrame([(*x, 1) for x in loc], "snapshot_id long, path string, size long, mtime long, inode long, delivered_at timestamp, tree_id long")
    got = {tuple(r) for r in snapshot_changes(s, l).collect()}
    assert got == {(7, 3, "gone", "removed"), (7, 3, "new", "added"), (7, 3, "A", "added"), (7, 4, "a", "removed"), (7, 4, "b", "removed"), (7, 4, "new", "removed"), (7, 4, "A", "removed"), (7, 9, "a", "added")}
    assert snapshot_changes(s.limit(0), l).collect() == [] and snapshot_changes(s, l.limit(0)).collect() == []
