"""Whole jobs on small trees and blobs; the same result by different ways."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import features as ff
from tessella.functions import locations
from tessella.functions.cdc import ChunkSizes
from tessella.functions.codecs import decompress
from tessella.operators.tree import parse_patterns
from tessella.plans import verbs

OPT = verbs.Options(sizes=ChunkSizes.of(64, 256, 1024))
R = random.Random(5)
FILES = {"a/one": R.randbytes(9000), "a/two": R.randbytes(5000), "b": b"", "c.txt": R.randbytes(3000)}


def tree_rows(files, tree=1):
    rows = [(tree, "", "dir", 0o40755, None, None, 1), (tree, "a", "dir", 0o40700, None, None, 2), (tree, "l", "link", 0o120777, None, "a/one", 3)]
    return rows + [(tree, p, "file", 0o100644, d, None, 4) for p, d in files.items()]


def trees(spark, *rows):
    df = spark.createDataFrame([r for x in rows for r in x], "tree_id long, path string, kind string, mode int, content binary, target string, mtime_ns long")
    return df.withColumn("size", F.length("content").cast("long"))


def unpacked_store(made):
    return made.new_chunks.select("chunk_id", decompress(F.col("data")).alias("data"))


def test_make_and_extract(spark):
    e = trees(spark, tree_rows(FILES), tree_rows(FILES | {"a/two": FILES["a/two"] + b"!"}, 2))
    made = verbs.make_trees(e, options=OPT)
    rep = {r.index_id: r for r in made.report.collect()}
    assert rep[1].chunks_written == rep[1].chunks and rep[2].chunks_reused > rep[2].chunks // 2 and rep[1].index_size == 104 + 40 * rep[1].chunks
    back, report = verbs.extract_trees(made.index, [("write-store", unpacked_store(made))], OPT)
    got = {(r.tree_id, r.path): (r.kind, r.target, r.content and bytes(r.content)) for r in back.collect()}
    want = {(r.tree_id, r.path): (r.kind, r.target, (r.content and bytes(r.content)) if r.kind == "file" else None) for r in e.collect()}
    assert {k: (a, b, c or None) for k, (a, b, c) in got.items()} == {k: (a, b, c or None) for k, (a, b, c) in want.items()}
    assert [(r.provider, r.percent) for r in report.collect()] == [("write-store", 100)]
    again = verbs.make_trees(e, have=unpacked_store(made), options=OPT)
    assert again.new_chunks.count() == 0 and {r.chunks_written for r in again.report.collect()} == {0}


def test_providers_in_order_and_damage(spark):
    blobs = spark.createDataFrame([(1, FILES["a/one"]), (2, FILES["a/two"])], "blob_id long, data binary")
    made = verbs.make_blobs(blobs, options=OPT)
    good = unpacked_store(made)
    first = good.orderBy("chunk_id").limit(3)
    bad = first.withColumn("data", F.lit(b"damaged"))
    blobs_back, report = verbs.extract_blobs(made.index, [("seed", bad), ("write-store", first), ("read-store", good)], OPT)
    assert {r.blob_id: bytes(r.data) for r in blobs_back.collect()} == {1: FILES["a/one"], 2: FILES["a/two"]}
    assert {r.provider: r.requests for r in report.collect()}["write-store"] == 3 and "seed" not in {r.provider for r in report.collect()}
    lost, rep = verbs.extract_blobs(made.index, [("seed", bad)], OPT)
    assert {r.complete for r in lost.collect()} == {False} and {r.provider for r in rep.collect()} == {None}
    states = {r.state for r in verbs.verify(made.index, bad.unionByName(good.join(first, "chunk_id", "left_anti").limit(1)), OPT).collect()}
    assert states == {"ok", "missing", "damaged"}


def test_garbage(spark):
    made = verbs.make_blobs(spark.createDataFrame([(1, FILES["a/one"]), (2, FILES["a/two"])], "blob_id long, data binary"), options=OPT)
    live = made.index.filter("index_id = 1")
    stays, goes = verbs.collect_garbage(made.new_chunks, live)
    assert stays.count() == live.select("chunk_id").distinct().count() and goes.count() == made.new_chunks.count() - stays.count()
    assert verbs.collect_garbage(made.new_chunks, live, verbs.Options(dry_run=True))[0].count() == made.new_chunks.count()


def test_listings_and_digests(spark):
    e = trees(spark, tree_rows(FILES))
    assert {r.line for r in verbs.listed(e, "a").collect()} == {"drwx------ a", "-rw-r--r-- a/one", "-rw-r--r-- a/two"}
    assert {r.path for r in verbs.listed(e, "", verbs.Options(recursive=False)).collect()} == {"", "a", "l", "b", "c.txt"}
    lines = {r.path: r.line for r in verbs.manifest(e).collect()}
    assert lines["l"] == "l type=link mode=0777 link=a/one time=0.000000003" and lines["b"].endswith("sha512256digest=" + hashlib.new("sha512_256", b"").hexdigest())
    text = {r.path: r.text for r in verbs.stat_block(e).collect()}
    assert text["a/one"] == "    File: a/one\n    Mode: -rw-r--r--\n    Time: 1970-01-01 00:00:00.000000004\n    Size: 9000"
    from tessella.sources.archives import archives

    made = archives(e)
    whole = bytes(made.first().archive)
    assert verbs.digests_at(made, e).first().digest == hashlib.new("sha512_256", whole).hexdigest()
    assert verbs.digests_at(made, e, "a/one", "sha256").first().digest == hashlib.sha256(FILES["a/one"]).hexdigest()
    at = whole.index(b"a\0") + 2
    assert verbs.digests_at(made, e, "a").first().digest in {hashlib.new("sha512_256", whole[at:k]).hexdigest() for k in range(at, len(whole) + 1)}
    d = {r.path: (r.payload_digest, r.hardlink_digest) for r in verbs.entry_digests(trees(spark, tree_rows(FILES | {"a/copy": FILES["a/one"]}))).collect()}
    assert d["a/copy"] == d["a/one"] and d["b"] != d["a/two"]


def test_filters_and_diff(spark):
    e = trees(spark, tree_rows(FILES))
    kept = {r.path for r in verbs.filtered(e, OPT, parse_patterns("*.txt\n/a/\n")).collect()}
    assert kept == {"", "l", "b"} and verbs.filtered(e, verbs.Options(exclude_file=False), parse_patterns("*.txt")).count() == e.count()
    later = trees(spark, tree_rows({k: v for k, v in FILES.items() if k != "b"} | {"new": b"x", "c.txt": b""}))
    assert {(r.path, r.change_kind) for r in verbs.diff(e, later).collect()} == {("b", "removed"), ("new", "added"), ("c.txt", "changed")}
    again, totals = verbs.cached_make(later, e, ["tree_id", "path"], ["size", "mtime_ns"])
    assert {r.path for r in again.collect()} == {"new", "c.txt"} and tuple(totals.first()) == (5, 1, 1, 2)


def test_what_to_make():
    assert verbs.what_to_make(None, "x.caidx", True) == "archive-index" and verbs.what_to_make(None, None, False) == "blob-index" and verbs.what_to_make("archive", "-", True) == "archive"
    for bad in ((None, "x.zip", True), (None, "x.caibx", True), ("archive", None, False), ("nothing", None, True)):
        with pytest.raises(ValueError):
            verbs.what_to_make(*bad)
    assert verbs.Options().features == ff.DEFAULT and not verbs.Options(digest="sha256").features & ff.SHA512_256


def test_origin_prefix(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 1, 5), ("x", 2, 7), ("y", 0, None), ("y", 1, 5)], "o string, n int, size long")
    got = sorted((r.o, r.n, r["size"]) for r in locations.origin_prefix(df, ["o"], "n", 12).collect())
    assert got == [("x", 0, 10), ("x", 1, 2)]
    s = spark.createDataFrame([((1, None), (1, None)), ((1, 2), (1, None))], "a struct<p:int,q:int>, b struct<p:int,q:int>")
    assert [r[0] for r in s.select(locations.same_location(F.col("a"), F.col("b"), ["p", "q"])).collect()] == [True, False]
