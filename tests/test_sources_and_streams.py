"""Files of the formats, stores, trees and streams."""

import hashlib
import http.server
import os
import random
import struct
import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import session
from tessella.functions.cdc import ChunkSizes, chunk_ends
from tessella.sources import archives, index_files, stores
from tessella.streaming import chunker, exchange


def index_rows(spark):
    rows, chunks = [], {}
    for i in ("one", "two"):
        end = 0
        for pos in range(300):
            end += 1 + (pos * 37) % 5000
            chunks[i, pos] = (end, hashlib.sha256(f"{i}{pos}".encode()).digest())
            rows.append((i, pos, *chunks[i, pos]))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "index_id string, pos int, end_offset long, chunk_id binary"), chunks


def test_index_files(spark, tmp_path):
    items, chunks = index_rows(spark)
    at = str(tmp_path / "idx")
    assert {(r.index_id, r["items"]) for r in index_files.write_indices(items, at, ".caibx", features=1 << 61).collect()} == {("one", 300), ("two", 300)}
    assert os.path.getsize(f"{at}/one.caibx") == 48 + 16 + 40 * 300 + 40
    spark.dataSource.register(index_files.IndexSource)
    for step in (7, 1 << 20):
        got = spark.read.format("index-file").option("items_per_task", step).load(at).collect()
        assert {(r.index_id, r.pos): (r.end_offset, bytes(r.chunk_id)) for r in got} == chunks and {r.feature_flags for r in got} == {1 << 61}
    same = index_files.read_indices_builtin(spark, at).collect()
    assert {(r.index_id, r.pos): (r.end_offset, bytes(r.chunk_id)) for r in same} == chunks


def test_many_small_index_files(spark, tmp_path):
    """Files of no, one and two items and a larger one: whole and right from both readers, without a task for each file or for a few of them."""
    at, ids, want = tmp_path / "idx", [hashlib.sha256(b"%d" % k).digest() for k in range(70_000)], set()
    at.mkdir()
    for i in range(1500):
        n, odd = 70_000 if i == 700 else i % 3, i % 2
        ends = [(odd + 1) * (pos + 1) for pos in range(n)]
        (at / f"{i}.caibx").write_bytes(index_files.encode_index(odd << 63, (1, 1, odd + 1), ends, ids[:n]))
        want |= {(str(i), pos, ends[pos], ids[pos], -(odd << 63), odd + 1) for pos in range(n)}
    source, builtin = index_files.read_indices(spark, str(at)), index_files.read_indices_builtin(spark, str(at))
    assert source.rdd.getNumPartitions() <= 8 and builtin.rdd.getNumPartitions() <= 8
    got = [(r.index_id, r.pos, r.end_offset, bytes(r.chunk_id), r.feature_flags, r.chunk_max) for r in source.collect()]
    assert len(got) == len(want) and set(got) == want
    same = [(r.index_id, r.pos, r.end_offset, bytes(r.chunk_id)) for r in builtin.collect()]
    assert len(same) == len(want) and set(same) == {x[:4] for x in want}
    (at / "1499.caibx").write_bytes(index_files.encode_index(0, (1, 1, 1), [1, 3], ids[:2]))
    with pytest.raises(Exception, match="1499"):
        source.collect()


def test_broken_index_files(spark, tmp_path):
    good = index_files.encode_index(0, (1, 2, 9), [5, 9], [b"a" * 32, b"b" * 32])
    for k, bad in enumerate([good[:-1], b"x" * len(good), good[:-8] + b"y" * 8, index_files.encode_index(0, (1, 2, 9), [5, 5], [b"a" * 32] * 2), index_files.encode_index(0, (1, 2, 3), [5, 9], [b"a" * 32] * 2)]):
        at = tmp_path / f"bad{k}.caibx"
        at.write_bytes(bad)
        with pytest.raises(Exception):
            index_files.read_indices(spark, str(at)).collect()
    empty = tmp_path / "empty.caibx"
    empty.write_bytes(index_files.encode_index(0, (1, 2, 3), [], []))
    assert index_files.read_indices(spark, str(empty)).collect() == []


TREE = [
    {"path": "", "kind": "dir", "mode": 0o755},
    {"path": "a", "kind": "dir", "mode": 0o700, "xattrs": {"user.z": b"1", "user.a": b"\0\1"}, "acl": [("default-user-obj", None, None, 7), ("user", 5, "bob", 6), ("group-obj", None, None, 4)]},
    {"path": "a/b", "kind": "file", "mode": 0o644, "content": b"hello", "user": "bob", "group": "staff", "uid": 5, "gid": 6, "mtime_ns": 123456789, "fcaps": b"\1", "selinux": "u:r", "quota_projid": 4},
    {"path": "a/empty", "kind": "file", "content": b""},
    {"path": "a-b", "kind": "link", "target": "a/b"},
    {"path": "c", "kind": "char", "major": 1, "minor": 3},
    {"path": "f #\\", "kind": "fifo"},
    {"path": "s", "kind": "socket"},
]


def test_archive_round_trip():
    data = b"".join(archives.encode_tree(TREE))
    got = list(archives.decode_archive(data))
    assert [e["path"] for e in got] == [e["path"] for e in TREE]
    for a, b in zip(TREE, got):
        for k, v in a.items():
            if k == "mode":
                assert b[k] & 0o7777 == v
            elif k == "acl":
                assert sorted(map(str, b[k])) == sorted(map(str, v))
            else:
                assert b[k] == v, (a["path"], k)
    assert b"".join(archives.encode_tree(got)) == data, "what was read gives the same bytes"
    light = list(archives.decode_archive(data, with_content=False))
    assert [e["size"] for e in light] == [e["size"] for e in got] and all(e["content"] is None for e in light)
    at = next(e for e in got if e["path"] == "c")["start"]
    assert struct.unpack("<2Q", data[at : at + 16]) == (64, archives.RECORDS["entry"])


def test_lookup_table_finds_names():
    data = b"".join(archives.encode_tree(TREE))
    back, size, marker = struct.unpack("<3Q", data[-24:])
    assert marker == archives.TAIL_MARKER and back == len(data) - size
    here = len(data) - size
    items = [struct.unpack("<3Q", data[here + 16 + 24 * k : here + 40 + 24 * k]) for k in range((size - 40) // 24)]
    for name in (b"a", b"a-b", b"c", b"s"):
        h, i = int(archives.siphash24([name])[0]), 0
        while items[i][2] != h:
            i = 2 * i + (1 if h < items[i][2] else 2)
        at = here - items[i][0]
        assert data[at + 16 : at + 16 + len(name) + 1] == name + b"\0"


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_damaged_archives_are_refused_or_read(data):
    good = bytearray(b"".join(archives.encode_tree(TREE)))
    at = data.draw(st.integers(0, len(good) - 1))
    good[at] ^= data.draw(st.integers(1, 255))
    try:
        list(archives.decode_archive(bytes(good)))
    except (ValueError, UnicodeDecodeError, struct.error):
        pass
    with pytest.raises(ValueError):
        list(archives.decode_archive(bytes(good[: data.draw(st.integers(1, len(good) - 1))])))


def test_archives_of_tables(spark, tmp_path):
    df = spark.createDataFrame([("t", e["path"], e["kind"], e.get("mode"), e.get("content"), e.get("target"), e.get("major"), e.get("minor")) for e in reversed(TREE)], "tree_id string, path string, kind string, mode int, content binary, target string, major long, minor long")
    made = archives.archives(df)
    back = archives.unpacked(made).collect()
    assert [r.path for r in back] == [e["path"] for e in TREE] and {r.path: r.content and bytes(r.content) for r in back}["a/b"] == b"hello"
    (tmp_path / "t.catar").write_bytes(bytes(made.first().archive))
    for content in (True, False):
        rows = archives.read_archives(spark, str(tmp_path), content).collect()
        assert [r.path for r in rows] == [e["path"] for e in TREE] and rows[2]["size"] == 5 and (rows[2].content is not None) == content


def test_archive_parts_are_the_archive(spark, tmp_path, force_shuffle):
    rows = [(t, e["path"], e["kind"], e.get("mode"), e.get("content"), e.get("target"), e.get("major"), e.get("minor")) for t in (1, 2) for e in TREE if t == 1 or not e["path"].startswith("a/")]
    rows += [(2, f"a/{k}/{j}" if j else f"a/{k}", "file" if j else "dir", 0o644, b"%d" % j, None, None, None) for k in range(9) for j in range(6)]
    df = spark.createDataFrame(rows, "tree_id long, path string, kind string, mode int, content binary, target string, major long, minor long")
    want = {r.tree_id: bytes(r.archive) for r in archives.archives(df).collect()}
    parts = archives.archive_parts(df)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r.tree_id, r.start)):
        assert r.start == len(got.get(r.tree_id, b""))
        got[r.tree_id] = got.get(r.tree_id, b"") + bytes(r.data)
    assert got == want
    assert {r.tree_id: r.bytes for r in archives.write_archives(parts, str(tmp_path)).collect()} == {t: len(d) for t, d in want.items()}
    assert (tmp_path / "2.catar").read_bytes() == want[2]


def test_tree_walk_and_extract(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a" / "deep").mkdir(parents=True)
    (src / "a-b").write_bytes(b"1")
    (src / "a" / "deep" / "f").write_bytes(b"22")
    (src / "a" / "e").write_bytes(b"")
    (src / "l").symlink_to("a/e")
    os.mkfifo(src / "p")
    os.chmod(src / "a" / "e", 0o640)
    os.utime(src / "a", ns=(5 * 10**9, 7 * 10**9 + 1))
    got = archives.scan_tree(spark, str(src))
    rows = {r.path: r for r in got.collect()}
    assert set(rows) == {"", "a", "a/deep", "a/deep/f", "a/e", "a-b", "l", "p"} and bytes(rows["a/deep/f"].content) == b"22" and rows["l"].target == "a/e"
    assert {r.path: r["size"] for r in archives.scan_tree(spark, str(src), content=False).collect() if r.kind == "file"} == {"a/deep/f": 2, "a/e": 0, "a-b": 1}
    out = tmp_path / "out"
    assert {r.state for r in archives.extract(got, str(out)).collect()} == {"made"}
    again = {r.path: r for r in archives.scan_tree(spark, str(out)).collect()}
    for p, r in rows.items():
        assert (again[p].kind, again[p].content, again[p].target) == (r.kind, r.content, r.target)
        if r.kind in ("file", "dir"):
            assert (again[p].mode, again[p].mtime_ns) == (r.mode, r.mtime_ns)


def chunk_rows(spark, n=20):
    data = [os.urandom(100 + k) for k in range(n)]
    return {hashlib.sha256(d).hexdigest(): d for d in data}, spark.createDataFrame([(hashlib.sha256(d).hexdigest(), d) for d in data * 2], "chunk_id string, data binary")


@pytest.mark.parametrize("codec", ["none", "xz", "gzip", "zstd"])
def test_store_folder(spark, tmp_path, codec):
    want, df = chunk_rows(spark)
    at = str(tmp_path / "store")
    assert tuple(stores.write_store(df, at, codec).first()) == (20, 0) and tuple(stores.write_store(df, at, "xz").first()) == (0, 20)
    assert {r.chunk_id: bytes(r.data) for r in stores.read_store(spark, at).collect()} == want
    assert stores.read_store(spark, at, content=False).count() == 20
    assert stores.delete_from_store(df.limit(1), at).first().removed == 1 and stores.read_store(spark, at, content=False).count() == 19


def test_fetch(spark, tmp_path):
    want, df = chunk_rows(spark, 5)
    stores.write_store(df, str(tmp_path / "s"), "zstd").collect()
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/s"
    ids = df.unionByName(spark.createDataFrame([("0" * 64, b"")], df.schema))
    got = {r.chunk_id: r for r in stores.fetch_chunks(ids, url).collect()}
    server.shutdown()
    assert {k: bytes(r.data) for k, r in got.items() if not r.missing} == want and got["0" * 64].missing
    assert stores.fetch(spark.createDataFrame([("http://127.0.0.1:9/none",), (None,)], "url string")).collect()[0].status == 0


S = ChunkSizes.of(64, 256, 1024)


def drain(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streamed_chunks_equal_batch(spark, tmp_path):
    r = random.Random(9)
    whole = {"a": r.randbytes(30_000), "b": b"\0" * 5000, "c": r.randbytes(10), "d": b""}
    schema, at, rows = "stream_id string, seq long, data binary, last boolean", tmp_path / "in", []
    for s, d in whole.items():
        places = sorted(r.sample(range(len(d) + 1), min(len(d), 12)))
        parts = [d[i:j] for i, j in zip([0, *places], [*places, len(d)])]
        rows.append([(s, k, p, k + 1 == len(parts)) for k, p in enumerate(parts)])
    for k in range(5):
        batch = [x for stream in rows for x in stream[k * 3 : k * 3 + 3]]
        batch = batch + batch[:2]  # delivered twice
        if batch:
            r.shuffle(batch)
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(at))
            time.sleep(0.02)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
    got = drain(spark, chunker.chunk_stream(source, S), "chunked", tmp_path)
    for s, d in whole.items():
        own = sorted((x for x in got if x.stream_id == s), key=lambda x: x.pos)
        assert [x.end for x in own] == chunk_ends(d, S) and [x.pos for x in own] == list(range(len(own)))
        assert all(x.chunk_id == hashlib.sha256(d[x.start : x.end]).hexdigest() for x in own)


@pytest.mark.parametrize("seed", range(2))
def test_parts_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    whole = {"a": r.randbytes(12_000), "b": b"\0" * 3000, "c": r.randbytes(50)}
    rows = []
    for s, d in whole.items():
        places = sorted(r.sample(range(len(d) + 1), 7))
        rows += [(s, k, d[i:j], j == len(d) and k == 7) for k, (i, j) in enumerate(zip([0, *places], [*places, len(d)]))]
    # The order of the probe first: 0, 2, 1, 3 in four batches; then any order, parts delivered again between and after.
    batches = [[x for x in rows if x[1] == k] for k in (0, 2, 1, 3)] + [[x for x in rows if x[1] > 3]] if seed == 0 else []
    if not batches:
        mixed = rows + r.sample(rows, 6)
        r.shuffle(mixed)
        batches = [mixed[k : k + 5] for k in range(0, len(mixed), 5)]
    batches.append([x for x in rows if x[3]])  # the last parts once more
    at = tmp_path / "in"
    for b in batches:
        spark.createDataFrame(b, "stream_id string, seq long, data binary, last boolean").coalesce(1).write.mode("append").parquet(str(at))
        time.sleep(0.02)
    source = spark.readStream.schema("stream_id string, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(at))
    got = drain(spark, chunker.chunk_stream(source, S), f"ordered{seed}", tmp_path)
    for s, d in whole.items():
        own = sorted((x for x in got if x.stream_id == s), key=lambda x: x.pos)
        assert [x.end for x in own] == chunk_ends(d, S) and sum(x.size for x in own) == len(d)
        assert all(x.chunk_id == hashlib.sha256(d[x.start : x.end]).hexdigest() for x in own)


@pytest.mark.parametrize("bad", [[("a", None, b"x", False)], [("a", 0, b"x", True), ("a", 1, b"y", False)]])
def test_parts_without_a_place_are_errors(spark, tmp_path, bad):
    spark.createDataFrame(bad, "stream_id string, seq long, data binary, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, seq long, data binary, last boolean").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="has no number|behind its last"):
        drain(spark, chunker.chunk_stream(source, S), f"bad{len(bad)}", tmp_path)


def test_frames():
    cid = bytes(range(32))
    frames = [exchange.encode_frame("hello", 0x41), exchange.encode_frame("index", data=b"abc"), exchange.encode_frame("index-eof"), exchange.encode_frame("request", 1, cid + cid), exchange.encode_frame("chunk", 1, cid, b"d"), exchange.encode_frame("missing", chunk=cid), exchange.encode_frame("abort", 2, data=b"why\0"), exchange.encode_frame("goodbye")]
    got = list(exchange.decode_frames(b"".join(frames)))
    assert [g[0] for g in got] == ["hello", "index", "index-eof", "request", "chunk", "missing", "abort", "goodbye"]
    assert got[1][3] == b"abc" and got[3][1:3] == (1, cid + cid) and got[4] == ("chunk", 1, cid, b"d")
    for bad in (frames[0][:-1], b"x" * 16, exchange.encode_frame("request", 0, b"short"), exchange.encode_frame("request", 7, cid), exchange.encode_frame("missing", chunk=cid[:5]), exchange.encode_frame("chunk", 0, cid)):
        with pytest.raises(ValueError):
            list(exchange.decode_frames(bad))
    with pytest.raises(ValueError):
        exchange.encode_frame("index", data=bytes(16 << 20))


def test_roles():
    o, s = exchange.OPERATIONS, exchange.SERVICES
    assert exchange.compatible(o["pull-chunks"], s["readable-store"]) and not exchange.compatible(o["pull-chunks"], s["readable-index"])
    assert not exchange.compatible(s["readable-store"], s["readable-store"]) and not exchange.compatible(o["pull-chunks"], 1 << 13 | s["readable-store"])
    push = o["push-index"] | o["push-chunks"] | o["push-index-chunks"]
    assert exchange.compatible(push, s["writable-index"] | s["writable-store"]) and not exchange.compatible(o["push-index-chunks"] | o["push-index"], s["writable-index"])


def test_request_queue(spark):
    rows = [("a", False, 1), ("b", None, 2), ("c", True, 3), ("a", True, 4), ("b", False, 5), (None, True, 6), ("d", True, 7), ("c", False, 0)]
    q = exchange.request_queue(spark.createDataFrame(rows, "chunk_id string, high boolean, seq long"))
    got = sorted(q.collect(), key=lambda r: r.place)
    assert [(r.chunk_id, r.high) for r in got] == [("c", True), ("a", True), ("d", True), ("b", False)]
    frames = exchange.request_frames(q, most=24 + 2 * 32).orderBy("frame_no").collect()
    assert [(r.high, r.chunks) for r in frames] == [(True, ["c", "a"]), (True, ["d"]), (False, ["b"])]
    assert exchange.request_queue(q.select("chunk_id", "high", F.lit(1).alias("seq")).limit(0)).count() == 0


def test_streamed_requests(spark, tmp_path):
    schema, at = "chunk_id string, high boolean, asked_at timestamp", tmp_path / "req"
    t = "2018-01-01 00:00:0"
    for batch in ([("a", False, t + "0"), ("a", False, t + "1"), ("b", True, t + "1")], [("a", True, t + "2"), ("b", True, t + "3"), ("b", None, t + "4")]):
        spark.createDataFrame(batch, "chunk_id string, high boolean, asked string").selectExpr("chunk_id", "high", "cast(asked AS timestamp) asked_at").coalesce(1).write.mode("append").parquet(str(at))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))
    listener = exchange.Progress()
    spark.streams.addListener(listener)
    got = drain(spark, exchange.new_requests(source), "asked", tmp_path)
    spark.streams.removeListener(listener)
    assert sorted((r.chunk_id, r.high) for r in got) == [("a", False), ("a", True), ("b", False), ("b", True)]
    store = spark.createDataFrame([("a", b"x")], "chunk_id string, data binary")
    asked = spark.createDataFrame([("a",), ("z",)], "chunk_id string")
    assert {(r.chunk_id, r.kind) for r in exchange.responses(asked, store).collect()} == {("a", "chunk"), ("z", "missing")}


def test_valid_response_and_followed_index(spark, tmp_path):
    rows = [(hashlib.sha256(b"a").digest(), b"a"), (hashlib.new("sha512_256", b"b").digest(), b"b"), (bytes(32), b"c"), (bytes(32), None)]
    df = spark.createDataFrame(rows, "chunk_id binary, data binary")
    assert [r[0] for r in df.select(exchange.valid_response(F.col("chunk_id"), F.col("data"))).collect()] == [True, True, False, False]
    items = spark.createDataFrame([("i", k, k + 1, "x") for k in range(9)], "index_id string, pos int, end_offset long, chunk_id string")
    items.repartition(3).write.parquet(str(tmp_path / "items"))
    assert len(drain(spark, exchange.follow_index(spark, str(tmp_path / "items"), 1), "followed", tmp_path)) == 9


def test_growing_index_file(spark, tmp_path):
    ends, ids = [10, 25, 40, 41, 90], [bytes([k]) * 32 for k in range(5)]
    whole = index_files.encode_index(0, (1, 20, 60), ends, ids)
    at = tmp_path / "one.caibx"
    q = exchange.follow_index_file(spark, str(at)).writeStream.format("memory").queryName("growing").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for n in (30, 64 + 40 * 2 + 11, 64 + 40 * 4, len(whole)):
            at.write_bytes(whole[:n])
            q.processAllAvailable()
            have = max(0, min(5, (n - 64) // 40))
            assert sorted((r.pos, r.end_offset, bytes(r.chunk_id)) for r in spark.table("growing").collect()) == [(k, ends[k], ids[k]) for k in range(have)]
    finally:
        q.stop()


def test_dispatch(spark):
    o, s = exchange.OPERATIONS, exchange.SERVICES
    a, b = o["pull-chunks"] | o["pull-index"], s["readable-store"] | s["readable-index"]
    rows = [
        (1, "client", 1, "hello", a, "begin"), (1, "client", 2, "request", 1, "take"), (1, "client", 3, "chunk", 0, "error"), (1, "client", 4, "goodbye", None, "end"), (1, "client", 5, "request", 0, "ignore"),
        (1, "server", 1, "hello", b, "begin"), (1, "server", 2, "index", None, "take"), (1, "server", 3, "index-eof", None, "take"), (1, "server", 4, "index", None, "error"), (1, "server", 5, "missing", None, "take"), (1, "server", 6, "hello", b, "error"),
        (2, "client", 1, "request", 0, "error"), (2, "client", 2, "abort", 1, "end"),
    ]
    got = exchange.dispatched(spark.createDataFrame([r[:5] for r in rows], "session long, side string, seq long, kind string, flags long")).collect()
    assert {(r.session, r.side, r.seq): r.action for r in got} == {r[:3]: r[5] for r in rows}


def test_what_is_required_has_to_be_there(spark):
    with pytest.raises(Exception, match="can't be fetched"):
        stores.fetch(spark.createDataFrame([("http://127.0.0.1:9/none",)], "url string"), rate_bytes=1000, required=True).collect()


def test_access_lists():
    raw = struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *x) for x in ((1, 7, archives.NO_ID), (2, 6, 5), (4, 5, archives.NO_ID), (8, 4, 9), (16, 7, archives.NO_ID), (32, 1, archives.NO_ID)))
    acl = archives.read_acl(raw, archives.LIST_TAGS)
    assert acl == [("user", 5, None, 6), ("group-obj", None, None, 5), ("group", 9, None, 4)]
    assert archives.write_acl([dict(zip(("tag", "id", "name", "perm"), x)) for x in acl], archives.LIST_TAGS, 0o771) == raw
    both = archives.read_acl(raw, archives.DEFAULT_TAGS)
    assert archives.write_acl([dict(zip(("tag", "id", "name", "perm"), x)) for x in both], archives.DEFAULT_TAGS, 0) == raw
    assert archives.read_acl(b"", archives.LIST_TAGS) == [] and archives.write_acl([], archives.LIST_TAGS, 0) is None


def test_walk_depth_owners_and_labels(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a" / "b" / "c").mkdir(parents=True)
    (src / "a" / "b" / "f").write_bytes(b"x")
    (src / "z").write_bytes(b"y")
    try:
        os.setxattr(src / "z", "user.note", b"kept")
    except OSError:
        pass
    one = {r.path: r for r in archives.scan_tree(spark, str(src)).collect()}
    for depth in (0, 2, 5):
        got = archives.scan_tree(spark, str(src), depth=depth).collect()
        assert {r.path: r for r in got} == one and len(got) == len(one) == 6
    with session.settings(spark, {"spark.sql.python.filterPushdown.enabled": "true"}):
        tree = lambda depth: archives.scan_tree(spark, str(src), depth=depth)
        for depth in (0, 1, 3):
            assert {r.path for r in tree(depth).filter("path LIKE 'a/b%'").collect()} == {"a/b", "a/b/c", "a/b/f"}
            assert [r.path for r in tree(depth).filter("path = 'a/b/f'").collect()] == ["a/b/f"] and tree(depth).filter("path = 'a/x'").count() == 0
            assert [r.path for r in tree(depth).filter("path = ''").collect()] == [""]
        assert tree(1).filter("path = 'z'").rdd.getNumPartitions() == 1 and tree(1).rdd.getNumPartitions() == 2
    out = str(tmp_path / "out")
    archives.extract(archives.scan_tree(spark, str(src)), out).collect()
    again = {r.path: r for r in archives.scan_tree(spark, out).collect()}
    assert {p: (r.uid, r.gid, r.user, r.group, r.flags, r.xattrs, r.acl) for p, r in again.items()} == {p: (r.uid, r.gid, r.user, r.group, r.flags, r.xattrs, r.acl) for p, r in one.items()}
