"""Operators of stores, indices, trees, caches and chunks; queries against SQL."""

import hashlib
import random

import pytest
from conftest import SMOKE
from oracle import compare
from pyspark.sql import functions as F

from tessella.functions import features as ff
from tessella.functions.cdc import ChunkSizes, chunk_ends
from tessella.operators import cache, chunking, index, store, tree
from tessella.plans import reference

S = ChunkSizes.of(64, 256, 1024)


@pytest.mark.parametrize("name", sorted(reference.QUERIES))
def test_query(spark, name):
    df = reference.QUERIES[name](spark, SMOKE)
    if name in reference.ORACLE:
        compare(df, reference.ORACLE[name], SMOKE)
    else:
        assert df.count() > 0


def blobs(spark, data):
    return spark.createDataFrame([(k, d, "x") for k, d in enumerate(data)], "blob_id long, data binary, pos string")


DATA = [b"", None, b"x", random.Random(1).randbytes(48), random.Random(2).randbytes(5000), b"\0" * 9000, random.Random(3).randbytes(200_000)]


def test_content_chunks(spark):
    got = chunking.content_chunks(blobs(spark, DATA), S, "sha512-256", keep_data=True).collect()
    for k, d in enumerate(DATA):
        own = sorted((r for r in got if r.blob_id == k), key=lambda r: r.pos)
        assert [r.end for r in own] == (chunk_ends(d, S) if d else [])
        assert b"".join(bytes(r.data) for r in own) == (d or b"")
        assert all(r.chunk_id == hashlib.new("sha512_256", bytes(r.data)).hexdigest() and r["size"] == r.end - r.start for r in own)


@pytest.mark.parametrize("length", [50, 777, 1 << 20])
def test_chunks_of_segments_are_the_same(spark, length):
    b = blobs(spark, DATA)
    cut = lambda df: sorted((r.blob_id, r.pos, r.start, r.end) for r in df.collect())
    assert cut(chunking.content_chunks_of_segments(chunking.segments(b, length), S)) == cut(chunking.content_chunks(b, S))


def test_fixed_chunks_and_round_trip(spark):
    b = blobs(spark, DATA)
    fixed = chunking.fixed_chunks(b, 1000)
    assert sorted(fixed.groupBy("blob_id").count().collect()) == [(k, -(-len(d) // 1000)) for k, d in enumerate(DATA) if d]
    for chunks in (fixed, chunking.content_chunks(b, S, keep_data=True)):
        assert {r.blob_id: bytes(r.data) for r in chunking.reassembled(chunks).collect()} == {k: d for k, d in enumerate(DATA) if d}
        part = {r.blob_id: bytes(r.data) for r in index.read_range(chunks, 30, 4001).collect()}
        assert part == {k: d[30:4001] for k, d in enumerate(DATA) if d and len(d) > 30}
    assert chunking.dedup_totals(fixed.limit(0)).first().chunks == 0


def test_reuse_and_histogram(spark):
    d = random.Random(4).randbytes(20_000)
    c = chunking.content_chunks(blobs(spark, [d, d, d[:9000]]), S).cache()
    n = len(chunk_ends(d, S))
    got = {r.blob_id: (r.chunks_written, r.chunks_reused) for r in chunking.written_or_reused(c).collect()}
    assert got[0] == (n, 0) and got[1] == (0, n) and got[2][0] <= 1
    assert {r.blob_id: r.chunks_written for r in chunking.written_or_reused(c, c).collect()} == {0: 0, 1: 0, 2: 0}
    h = chunking.size_histogram(c, S, 8).collect()
    assert sum(r.n for r in h) == c.count() and all(1 <= r.bucket <= 8 for r in h)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_total(spark, by, force_shuffle):
    from tessella.operators.order import running_total

    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "hot", "x", None]), k, r.choice([None, 1, 5])) for k in r.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {x.k: x.before for x in running_total(df, by, ["k"], F.col("v")).collect()}
    want = {k: sum(v2 or 0 for g2, k2, v2 in rows if k2 < k and (not by or g2 == g)) for g, k, _ in rows if not by or g}
    assert got == want
    assert sorted(x.place for x in running_total(df, [], ["k"], name="place").collect()) == list(range(500))
    assert running_total(df.limit(0), by, ["k"]).collect() == []


def test_stream_digest_and_holes(spark):
    parts = spark.createDataFrame([("a", 2, b"bar"), ("a", 1, b"foo"), ("b", 1, None), ("a", 3, b"")], "s string, n int, data binary")
    got = {r.s: (r.digest, r.bytes) for r in chunking.stream_digest(parts, ["s"], "n").collect()}
    assert got == {"a": (hashlib.sha256(b"foobar").hexdigest(), 6), "b": (hashlib.sha256(b"").hexdigest(), 0)}
    sparse = b"\0" * 4096 + b"r" * 4096 + b"\0" * 8192 + b"r" * 3000 + b"\0" * 13
    df = spark.createDataFrame([(sparse,), (b"",), (None,), (b"\0" * 4095,)], "data binary")
    assert [r[0] for r in df.select(chunking.hole_bytes(F.col("data"))).collect()] == [12288, 0, None, 0]


def ids(spark, rows, schema="chunk_id string, size long"):
    return spark.createDataFrame(rows, schema)


def test_store_operators(spark):
    held = ids(spark, [("a", 1), ("b", 2), ("b", 3)])
    want = ids(spark, [("b", 9), ("c", 5), ("c", 4), (None, 1), ("b", 9)])
    names = lambda df: sorted(r.chunk_id for r in df.collect())
    assert names(store.has(want, held)) == ["b", "b"] and names(store.lacks(want, held)) == ["c"]
    assert [tuple(r) for r in store.put(want, held).collect()] == [("c", 4)]
    assert names(store.remove(held, want)) == ["a"] and names(store.garbage(held, want)) == ["a"]
    marked = store.mark_missing(held, want.dropna())
    assert {(r.chunk_id, r.missing) for r in marked.collect()} == {("a", False), ("b", False), ("c", True)}
    assert names(store.lacks(want, marked)) == ["c"] and names(store.has(want, marked)) == ["b", "b"]
    assert tuple(store.garbage_totals(held, want).first()) == (1, 1, 1) and tuple(store.usage(want).first()) == (4, 2)
    got = {r.provider: (r.requests, r.bytes, r.percent) for r in store.provider_totals(want, [("seed", ids(spark, [("x", 1)])), ("write-store", held), ("read-store", want)]).collect()}
    assert got == {"write-store": (2, 18, 50), "read-store": (2, 9, 50)}
    assert {r.chunk_id: r.provider for r in store.resolve(want, [("write-store", marked)]).collect()} == {"b": "write-store", "c": None, None: None}
    empty = held.limit(0)
    assert store.put(empty, held).count() == 0 and store.lacks(empty, empty).count() == 0 and tuple(store.usage(empty).first()) == (0, 0) and tuple(store.garbage_totals(empty, empty).first()) == (0, 0, 0)


def test_verified(spark):
    rows = [(hashlib.sha256(b"a").hexdigest(), b"a"), (hashlib.new("sha512_256", b"b").hexdigest(), b"b"), ("00" * 32, b"c"), ("00" * 32, None)]
    got = [r.intact for r in store.verified(spark.createDataFrame(rows, "chunk_id string, data binary")).collect()]
    assert got == [True, True, False, False]


KEY = "ab" * 32


def test_index_operators(spark):
    items = spark.createDataFrame([(1, 1, 0, 10, KEY), (2, 1, 1, 25, KEY), (3, 1, 2, 20, None), (4, 1, 4, 40, KEY), (5, 2, 0, None, "bad"), (6, None, 0, 5, KEY), (7, 1, 1, 25, KEY)], "arrival_no long, index_id long, pos int, end_offset long, chunk string")
    assert {(r.index_id, r.pos, r.rule) for r in index.violations(items).collect()} == {(1, 2, "no_id"), (1, 2, "offset_not_increasing"), (1, 4, "size_unknown"), (2, 0, "no_id"), (2, 0, "size_unknown")}
    assert {tuple(r) for r in index.index_totals(items).collect()} == {(1, 4, 40, 264), (2, 1, None, 144)}
    at = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 24), (1, 25), (2, 0), (None, 1), (1, None)], "index_id long, offset long")
    for cell in (4, 1 << 20):
        assert {tuple(r) for r in index.chunks_at(items, at, cell).collect()} == {(1, 0, 0, 0), (1, 9, 0, 9), (1, 10, 1, 0), (1, 24, 1, 14)}
    assert {(r.pos, r.skip, r.take) for r in index.chunks_in_range(items, F.lit(5), F.lit(12)).collect()} == {(0, 5, 5), (1, 0, 2)}
    assert index.chunks_at(items.limit(0), at).count() == 0


ENTRIES = "tree_id long, path string, kind string, size long, mount_id long, fs string, flags long"


def entries(spark, rows):
    return spark.createDataFrame([(1, p, k, s, m, f, a) for p, k, s, m, f, a in rows], ENTRIES)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_tree_filters(spark):
    e = entries(spark, [("", "dir", None, 1, "ext4", 0), ("a", "dir", None, 1, "ext4", 0), ("a/f", "file", 5, 1, "ext4", 0x40), ("a-b", "file", 5, 1, "ext4", None), ("m", "dir", None, 2, "proc", 0), ("m/x", "file", 7, 2, "proc", 0), ("m/y/z", "file", 7, 2, "proc", 0), ("l", "link", None, 1, "ext4", 0), ("s", "socket", None, 1, "ext4", 0)])
    assert paths(tree.kept_kinds(e, ff.bits("symlinks"))) == ["", "a", "a-b", "a/f", "l", "m", "m/x", "m/y/z"]
    assert tree.kept_kinds(e, ff.GROUPS["all"]).count() == 9
    assert "a/f" not in paths(tree.without_nodump(e, ff.DEFAULT)) and tree.without_nodump(e, 0).count() == 9
    assert paths(tree.without_submounts(e)) == ["", "a", "a-b", "a/f", "l", "s"]
    assert paths(tree.without_virtual(e)) == ["", "a", "a-b", "a/f", "l", "m", "s"]
    order = [r.path for r in e.orderBy(tree.tree_order(F.col("path"))).collect()]
    assert order == ["", "a", "a/f", "a-b", "l", "m", "m/x", "m/y/z", "s"]
    assert paths(tree.at_path(e, "m")) == ["m", "m/x", "m/y/z"] and paths(tree.at_path(e, "m", recursive=False)) == ["m", "m/x"] and paths(tree.at_path(e, "", recursive=False)) == ["", "a", "a-b", "l", "m", "s"]
    assert [r.a for r in e.select(tree.ancestors(F.col("path")).alias("a")).filter("size(a) = 3").collect()] == [["m", "m/y", "m/y/z"]]
    listed = spark.createDataFrame([(1, "", "b", 0), (1, "", "a", 1), (1, "", "c", 2), (1, "", "c", 3)], "tree_id long, parent string, name string, seq int")
    assert sorted(r.name for r in tree.out_of_order(listed).collect()) == ["a", "c"]


PATTERNS = "# c\n*.txt\n!foobar.txt\n/quux\n\n/miepf/mupf\n/miepf/zumm*kuck\n/miepf/miepf/miepf\n!/knurx/knurx/\n/*.puff/\n"


@pytest.mark.parametrize(
    "path, kind, out",
    [
        ("test1.txt", "file", True), ("test1.txt", "dir", True), ("foobar.txt", "file", False), ("huhu", "file", False), ("quux", "file", True), ("quux", "dir", True), ("miepf", "dir", False),
        ("a/b/t.txt", "file", True), ("a/quux", "file", False), ("quux/x/y", "file", True), ("miepf/mupf", "file", True), ("miepf/zummXkuck", "file", True), ("miepf/miepf/miepf", "file", True), ("a.puff", "file", False), ("a.puff", "dir", True), ("a.puff/q", "file", True), (".txt", "file", False), ("a/.x.txt", "file", False),
    ],
)
def test_exclude_patterns(spark, path, kind, out):
    e = entries(spark, [(path, kind, 1, 1, "ext4", 0)])
    assert tree.excluded(e, tree.parse_patterns(PATTERNS)).count() == out


def test_exclude_scopes_and_errors(spark):
    e = entries(spark, [(p, "file", 1, 1, "e", 0) for p in ("d/x.o", "x.o", "d/k/x.o", "d/a[1]", "d/b?", "d/c1")])
    pats = tree.parse_patterns("*.o\n", "d") + tree.parse_patterns("a\\[1\\]\nb\\?\n[!ab]1\n", "d")
    assert paths(tree.excluded(e, pats)) == ["d/a[1]", "d/b?", "d/c1", "d/k/x.o", "d/x.o"] and paths(tree.without_excluded(e, pats)) == ["x.o"]
    for bad in ("/", "a/../b", "./a", "!."):
        with pytest.raises(ValueError):
            tree.parse_patterns(bad)
    assert tree.merged_patterns(tree.parse_patterns("b\na\nb\n")) == tree.merged_patterns(tree.parse_patterns("a\nb\n"))
    assert tree.excluded(e, []).count() == 0 and tree.excluded(e.limit(0), pats).count() == 0


def test_entry_violations(spark):
    rows = [("", "file", 1), ("a/..", "dir", None), ("x" * 300, "dir", None), ("l", "link", None), ("f", "file", None), ("ok", "dir", None), ("b", "block", None)]
    got = {(r.path[:5], r.rule) for r in tree.entry_violations(entries(spark, [(p, k, s, 1, "e", 0) for p, k, s in rows])).collect()}
    assert got == {("", "root_not_dir"), ("a/..", "bad_name"), ("xxxxx", "name_too_long"), ("l", "link_without_target"), ("f", "file_without_payload"), ("b", "device_without_number")}


def test_deleted_and_replayed(spark):
    a, b = entries(spark, [("x", "file", 1, 1, "e", 3), ("y", "file", 1, 1, "e", 3)]), entries(spark, [("y", "file", 1, 1, "e", 3)])
    assert paths(tree.deleted_names(a, b, ["tree_id"])) == ["x"]
    assert [r.flags for r in tree.replay_columns(a, 0).collect()] == [None, None] and [r.flags for r in tree.replay_columns(a, ff.DEFAULT).collect()] == [3, 3]


def test_cache(spark):
    schema = "k long, v long, w string"
    old, new = spark.createDataFrame([(1, 1, "a"), (2, None, "a"), (3, 3, "a")], schema), spark.createDataFrame([(1, 1, "b"), (2, None, "b"), (3, 4, "b"), (4, 4, "b"), (None, 1, "b")], schema)
    v = cache.cache_verdicts(new, old, ["k"], ["v"])
    assert {r.k: r.verdict for r in v.collect()} == {1: "hit", 2: "hit", 3: "invalidated", 4: "miss", None: "miss"}
    assert tuple(cache.cache_totals(v, []).first()) == (2, 2, 1, 3)
    warm = cache.updated_cache(old, v.dropna(subset=["k"]), ["k"], ["v"])
    assert {r.verdict for r in cache.cache_verdicts(new.dropna(subset=["k"]), warm, ["k"], ["v"]).collect()} == {"hit"}


def test_links(spark):
    files = spark.createDataFrame([(3, 5, "d"), (1, 5, "d"), (2, 5, "d"), (4, 1, "e"), (5, 1, None), (6, 1, None)], "id long, size long, digest string")
    assert [tuple(r) for r in cache.hardlinks(files).collect()] == [("d", 1, 3, 10)]
    ranges = spark.createDataFrame([(0, 4096, 8192), (100, 4196, 9000), (1, 0, 9000), (0, 0, 100)], "target long, source long, size long")
    assert [r.bytes for r in cache.reflinked(ranges).collect()] == [8192, 4096, 0, 0]


def test_seed_delta(spark):
    rows = lambda xs: spark.createDataFrame([("g", k, s) for k, s in xs], "g string, key string, size long")
    assert [tuple(r) for r in index.delta(rows([("a", 1), (None, 2)]), rows([("a", 1), ("b", 2), ("b", 2), (None, 9)]), ["g"]).collect()] == [("g", 2, 1, 1, 2)]
