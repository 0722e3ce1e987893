"""The queries of nodes and of whole jobs against their SQL, and the operators behind them on small inputs."""

import hashlib
import random

import pytest
from conftest import SMOKE
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from tessella.functions import cdc
from tessella.functions import features as ff
from tessella.functions.cdc import ChunkSizes, chunk_ends
from tessella.operators import cache, chunking, index, tree
from tessella.plans import jobs, nodes, verbs
from tessella.sources import archives
from tessella.streaming import exchange

BOTH = nodes.QUERIES | jobs.QUERIES


@pytest.mark.parametrize("name", sorted(BOTH))
def test_against_sql(spark, name):
    compare(BOTH[name](spark, SMOKE), (nodes.ORACLE | jobs.ORACLE)[name], SMOKE)


@pytest.mark.parametrize("seed", range(3))
def test_segments_of_parts(spark, seed):
    r = random.Random(seed)
    blobs = {k: r.randbytes(n) for k, n in ((1, 9000), (2, 1), (3, 4096), (4, 30))}
    parts = []
    for k, d in blobs.items():
        at = 0
        while at < len(d):
            n = r.choice([1, 7, 30, 700, 5000])
            parts.append((k, at, d[at : at + n]))
            at += n
    parts.append((5, 0, b""))
    r.shuffle(parts)
    s = ChunkSizes.of(64, 256, 1024)
    df = spark.createDataFrame(parts, "blob_id long, start long, data binary")
    got = chunking.segments_of_parts(df, 1000, s.max)
    want = {(k, j): (d[j * 1000 : (j + 1) * 1000], d[max(0, j * 1000 - 47) : j * 1000], d[(j + 1) * 1000 : (j + 1) * 1000 + 1024]) for k, d in blobs.items() for j in range(-(-len(d) // 1000))}
    assert {(x.blob_id, x.seg_no): (bytes(x.data), bytes(x.halo), bytes(x.tail)) for x in got.collect()} == want
    ranges = chunking.content_chunks_of_segments(got, s)
    for algorithm, name in (("sha256", "sha256"), ("sha512-256", "sha512_256")):
        rows = chunking.cut_segments(got, ranges, 1000, algorithm).collect()
        for k, d in blobs.items():
            own = sorted((x for x in rows if x.blob_id == k), key=lambda x: x.pos)
            assert [x.end for x in own] == chunk_ends(d, s) and b"".join(bytes(x.data) for x in own) == d
            assert all(x.chunk_id == hashlib.new(name, bytes(x.data)).hexdigest() and x.size == len(x.data) for x in own)


def test_reassembled_is_bounded(spark):
    df = spark.createDataFrame([(1, 1, b"cd"), (1, 0, b"ab")], "blob_id long, pos int, data binary")
    assert [bytes(r.data) for r in chunking.reassembled(df).collect()] == [b"abcd"]
    with pytest.raises(Exception, match="too large for one value"):
        chunking.reassembled(df, 3).collect()


def test_starts_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    df = spark.createDataFrame([(i, p, 10 * (p + 1) + i) for i in (1, 2) for p in range(11)], "index_id long, pos int, end_offset long")
    assert {(r.index_id, r.pos, r.start, r.size) for r in index.with_starts(df).collect()} == {(i, p, 10 * p + i if p else 0, 10 + (0 if p else i)) for i in (1, 2) for p in range(11)}


@given(st.lists(st.integers(1, 200), max_size=40), st.randoms())
@settings(max_examples=30, deadline=None)
def test_archives_are_read_from_parts(cuts, r):
    rows = [{"path": "", "kind": "dir"}, {"path": "a", "kind": "file", "content": b"x" * 500}, {"path": "d", "kind": "dir"}, {"path": "d/l", "kind": "link", "target": "a"}, {"path": "z", "kind": "file", "content": b""}]
    data = b"".join(archives.encode_tree(rows))
    for content in (True, False):
        parts, at = [], 0
        for n in [*cuts, len(data)]:
            parts.append(data[at : at + n])
            at += n
        assert list(archives.decode_archive(parts, content)) == list(archives.decode_archive(data, content))
    with pytest.raises(ValueError):
        list(archives.decode_archive([data[:40], data[40:-1]]))


def test_hot_chunks_and_damage_in_parts(spark, force_shuffle):
    blob = b"".join([b"\0" * 1024] * 200 + [bytes([k]) * 1024 for k in range(1, 20)])
    made = verbs.make_blobs(spark.createDataFrame([(1, blob), (2, b"y" * 3000)], "blob_id long, data binary"), options=verbs.Options(digest="sha256", sizes=ChunkSizes.of(1024, 1024, 1024)))
    from tessella.functions.codecs import decompress

    kept = made.new_chunks.select("chunk_id", decompress(F.col("data")).alias("data"))
    parts = verbs.resolved_parts(made.index, [("a", kept)], verbs.Options(digest="sha256"))
    got = sorted((r.blob_id, r.start, bytes(r.data)) for r in parts.collect())
    assert b"".join(d for b, _, d in got if b == 1) == blob and b"".join(d for b, _, d in got if b == 2) == b"y" * 3000
    asked = exchange.responses(made.index, kept).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in asked} == {"chunk": 222}


def test_trees_as_options_keep_them(spark):
    rows = [(1, "", "dir", 0o755, 7, None, 1_999_999_999, None, "u"), (1, "f", "file", 0o4600, 70005, 3, 2_000_000_001, b"abc", "v"), (1, "r", "file", 0o444, 6, 3, None, b"", None)]
    df = spark.createDataFrame(rows, "tree_id long, path string, kind string, mode int, uid long, gid long, mtime_ns long, content binary, user string").withColumn("size", F.length("content").cast("long"))
    opt = verbs.Options(digest="sha256", sizes=ChunkSizes.of(64, 256, 1024), with_=ff.bits("sec-time", "read-only", "32bit-uids"), uid_shift=5, uid_range=65536)
    made = verbs.make_trees(df, options=opt, segment=128)
    from tessella.functions.codecs import decompress

    back, _ = verbs.extract_trees(made.index, [("s", made.new_chunks.select("chunk_id", decompress(F.col("data")).alias("data")))], opt)
    got = {r.path: (r.mode & 0o7777, r.uid, r.gid, r.mtime_ns, r.user) for r in back.collect()}
    assert got == {"": (0o777, 2, 0, 1_000_000_000, None), "f": (0o666, 70000 % 65536, 0, 2_000_000_000, None), "r": (0o444, 1, 0, 0, None)}


def test_exclude_files_in_the_tree(spark):
    rows = [("", "dir", None), (".caexclude", "file", b"*.o\n!keep.o\n/top/\n"), ("a", "dir", None), ("a/x.o", "file", b""), ("a/keep.o", "file", b""), ("a/top", "file", b""), ("top", "dir", None), ("top/y", "file", b""), ("top/.caexclude", "file", b"!y\n"), ("a/.caexclude", "file", b"# only here\nb\n!x.o\n"), ("a/b", "dir", None), ("a/b/c", "file", b""), ("b", "file", b""), ("z.o", "file", b"")]
    df = spark.createDataFrame([(t, *r) for t in (1, 2) for r in rows if t == 1 or r[0] != ".caexclude"], "tree_id long, path string, kind string, content binary").withColumn("size", F.length("content").cast("long"))
    kept = {(r.tree_id, r.path) for r in verbs.filtered(df, verbs.Options()).collect()}
    gone = {(1, p) for p in ("top", "top/y", "top/.caexclude", "a/b", "a/b/c", "z.o")} | {(2, "a/b"), (2, "a/b/c"), (2, ".caexclude")}
    assert kept == {(t, r[0]) for t in (1, 2) for r in rows} - gone
    assert verbs.filtered(df, verbs.Options(exclude_file=False)).count() == df.count()
    assert tree.excluded_by_files(df, tree.exclude_patterns(tree.exclude_files(df.limit(0)))).count() == 0


def test_cached_chunks_count_only_whole(spark):
    was = spark.createDataFrame([(1, k, k // 3, i) for k, i in enumerate("abcdefgh")], "t long, place long, chunk long, location_id string")
    kept = cache.chunk_origins(was, ["t"], "chunk")
    assert {(r.location_id, r.chunk, tuple(r.origin)) for r in kept.collect()} == {("a", 0, ("a", "b", "c")), ("d", 1, ("d", "e", "f")), ("g", 2, ("g", "h"))}
    now = spark.createDataFrame([(1, k, i) for k, i in enumerate("xabcdeyfgh")], "t long, place long, location_id string")
    got = {r.location_id: (r.verdict, r.chunk) for r in cache.verified_lookups(now, kept, ["t"]).collect()}
    assert got["a"] == ("hit", 0) and got["d"] == ("invalidated", None) and got["g"] == ("hit", 2) and got["x"] == ("miss", None)
    assert cache.verified_lookups(now.limit(0), kept, ["t"]).count() == 0


def test_violations_of_lists_devices_and_times(spark):
    schema = "tree_id long, path string, kind string, mtime_ns long, size long, major long, minor long, user string, acl array<struct<tag:string,id:long,name:string,perm:int>>"
    acl = lambda *tags: [(t, 1, "n", 7) for t in tags]
    rows = [
        (1, "a", "dir", 1000, None, None, None, "bob", acl("default-user")), (1, "b", "dir", 1000, None, None, None, None, acl("default-user", "default-mask")), (1, "c", "char", 1500, None, 1, 3, None, None),
        (1, "d", "block", 0, None, 4096, 0, None, None), (1, "e", "block", 0, None, None, None, None, None), (1, "f", "file", 0, 1, 1, 1, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    plain = {("a", "default_acl_without_mask"), ("d", "number_out_of_range"), ("e", "device_without_number"), ("f", "number_on_other")}
    assert {(r.path, r.rule) for r in tree.entry_violations(df).collect()} == plain
    assert {(r.path, r.rule) for r in tree.entry_violations(df, ff.bits("usec-time")).collect()} == plain | {("a", "owner_name_without_flag"), ("c", "time_not_granular")}
    assert ("c", "time_not_granular") not in {(r.path, r.rule) for r in tree.entry_violations(df, ff.bits("nsec-time", "user-names")).collect()}


def test_chunk_sizes_as_columns(spark):
    r = random.Random(4)
    rows = [tuple(r.choice([None, 0, r.randrange(1, 1 << 20)]) for _ in range(3)) for _ in range(300)] + [(None, None, None), (16384, None, 262144), (0, 1 << 27, 0), (1, 1, 1 << 28)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k long, a long, b long, c long").select("k", cdc.resolved("a", "b", "c").alias("r"))
    for x in df.collect():
        try:
            s = ChunkSizes.of(*rows[x.k])
            want = (s.min, s.avg, s.max, s.discriminator)
        except ValueError:
            want = (None,) * 4
        assert tuple(x.r) == want, rows[x.k]


def test_roles_as_columns(spark):
    r = random.Random(5)
    pairs = [(r.randrange(1 << 14), r.randrange(1 << 14)) for _ in range(500)] + [(0x40, 0x1), (0, 0), (0x1, 0x40), (0xE00, 0xA)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", exchange.compatible_roles(F.col("a"), F.col("b")).alias("ok")).collect()
    assert all(x.ok == exchange.compatible(x.a, x.b) for x in got) and any(x.ok for x in got)


def test_digests_of_folders(spark):
    rows = [(1, "", "dir", None, None), (1, "d", "dir", None, None), (1, "d/f", "file", b"abc", None), (1, "d/l", "link", None, "f"), (1, "e", "file", b"", None)]
    df = spark.createDataFrame(rows, "tree_id long, path string, kind string, content binary, target string")
    alone = df.filter("path = 'd' OR path LIKE 'd/%'").withColumn("path", F.expr("substring(path, 3)"))
    made = archives.archives(df)
    assert verbs.digests_at(made, df, "d").collect() == verbs.digests_at(archives.archives(alone), alone).collect()
    assert verbs.digests_at(made, df, "none").count() == 0 and verbs.digests_at(made, df, "d/f", "sha256").first().digest == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(Exception, match="not of a link"):
        verbs.digests_at(made, df, "d/l").collect()
    d = verbs.entry_digests(df)
    text = {r.path: r.text for r in verbs.stat_block(df.withColumn("mode", F.lit(0o100644)), d).collect()}
    assert text["d/f"].endswith(f"  Digest: {hashlib.new('sha512_256', b'abc').hexdigest()}\nHLDigest: {d.filter(d.path == 'd/f').first().hardlink_digest}") and "Digest" not in text["d"]
