"""Golden vectors and properties of the column functions."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import cdc, codecs, digests, listing, locations, locators, sizes
from tessella.functions import features as ff
from tessella.functions.chunk_ids import chunk_key, format_id, is_null_id, parse_id, store_path, valid_chunk_length


def values(spark, rows, kind, col):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.y for r in df.select("k", col(F.col("x")).alias("y")).orderBy("k").collect()]


ID = "a3233d49a24e47712398214f03a871928e50b022e3dc5e7fb9c06d5da61b46c1"


def test_chunk_key(spark):
    good = [ID, ID.upper(), f" {ID}\n", f"\t{ID}", f"0x{ID}", f"0X{ID}", f"sha512-256:{ID}", f"SHA256:{ID}", f"a323/{ID}.cacnk", f"store/a323/{ID}.CACNK", ":".join(ID[k : k + 16] for k in range(0, 64, 16)), "-".join(ID[k : k + 16] for k in range(0, 64, 16))]
    bad = [None, "", " ", "-", "null", "unknown", ID[:-1], ID + "7", ID[:-1] + "g", ID[:32], ID + ID, ID[:20] + "?" + ID[21:], "x" * 200_000]
    assert [bytes(v).hex() for v in values(spark, good, "string", chunk_key)] == [ID] * len(good)
    assert values(spark, bad, "string", chunk_key) == [None] * len(bad)


def test_ids(spark):
    assert values(spark, [bytes.fromhex(ID), None], "binary", format_id) == [ID, None]
    assert values(spark, [ID.upper(), ID, "aa"], "string", lambda c: format_id(parse_id(c))) == [None, ID, None]
    assert values(spark, [bytes.fromhex(ID)], "binary", store_path) == [f"a323/{ID}.cacnk"]
    assert values(spark, [bytes(32), bytes(31) + b"\1", b"\0"], "binary", is_null_id) == [True, False, False]
    assert values(spark, [0, 1, 128 << 20, (128 << 20) + 1], "long", valid_chunk_length) == [False, True, True, False]


# Published digests of the empty text and of foobar.
@pytest.mark.parametrize(
    "algorithm, data, want",
    [
        ("sha256", b"", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
        ("sha256", b"foobar", "c3ab8ff13720e8ad9047dd39466b3c8974e592c2fa383d4a3960714caef0c4f2"),
        ("sha512-256", b"", "c672b8d1ef56ed28ab87c3622c5114069bdd3ad7b8f9737498d0c01ecef0967a"),
        ("sha512-256", b"foobar", "d014c752bc2be868e16330f47e0c316a5967bcbc9c286a457761d7055b9214ce"),
    ],
)
def test_digests(spark, algorithm, data, want):
    assert digests.digest_bytes(data, algorithm).hex() == want
    assert [None if v is None else bytes(v).hex() for v in values(spark, [data, None], "binary", lambda c: digests.digest(c, algorithm))] == [want, None]


def test_siphash(spark):
    # Vectors of the SipHash paper: key 00..0f, messages 00..(n-1).
    key = bytes(range(16))
    got = digests.siphash24([bytes(range(n)) for n in (0, 1, 8, 15)], key)
    assert [int(x) for x in got] == [0x726FDB47DD0E0E31, 0x74F839C593DC67FD, 0x93F5F5799A932462, 0xA129CA6149BE45E5]
    assert digests.siphash24([]).tolist() == []
    assert values(spark, [b"a", None], "binary", digests.name_hash)[1] is None


# Published cases of chunk sizes and what they resolve to.
@pytest.mark.parametrize("given, want", [((1024, 0, 0), (1024, 4096, 16384)), ((0, 0, 16384), (1024, 4096, 16384)), ((0, 4096, 0), (1024, 4096, 16384)), ((0, 4096, 16384), (1024, 4096, 16384)), ((1024, 4096, 16384), (1024, 4096, 16384)), ((1024, 4096, 0), (1024, 4096, 16384)), ((1024, 0, 16384), (1024, 4096, 16384)), ((128 << 10, 0, 512 << 10), (128 << 10, 256 << 10, 512 << 10)), ((0, 0, 0), (16 << 10, 64 << 10, 256 << 10))])
def test_chunk_sizes(given, want):
    s = cdc.ChunkSizes.of(*given)
    assert (s.min, s.avg, s.max) == want


def test_chunk_size_texts():
    assert cdc.ChunkSizes.parse("auto") == cdc.ChunkSizes.of() and cdc.ChunkSizes.parse("1K:4K:16K") == cdc.ChunkSizes(1024, 4096, 16384)
    assert cdc.ChunkSizes.parse("64K").discriminator == 49535 and cdc.ChunkSizes.parse("4K").discriminator == 3075
    for bad in ("1K:2K", "4K:2K:1K", "0", "x"):
        with pytest.raises(ValueError):
            cdc.ChunkSizes.parse(bad)


CUTS = [cdc.ChunkSizes(*x) for x in ((64, 256, 1024), (16, 64, 256), (48, 192, 768), (100, 100, 100), (200, 300, 5000), (1, 4, 16))]


@pytest.mark.parametrize("s", CUTS, ids=str)
def test_cuts_equal_the_plain_definition(s):
    rng = random.Random(5)
    for n in (0, 1, 47, 48, 49, 63, 64, 1000, 9000):
        for data in (rng.randbytes(n), b"\0" * n, b"abc" * (n // 3)):
            assert cdc.chunk_ends(data, s) == cdc.chunk_ends_one_by_one(data, s)


def test_cuts_across_slices(monkeypatch):
    data = random.Random(6).randbytes(20_000)
    want = cdc.chunk_ends(data, CUTS[0])
    monkeypatch.setattr(cdc, "SLICE", 777)
    assert cdc.chunk_ends(data, CUTS[0]) == want


def test_chunks_are_within_bounds_and_survive_an_insertion():
    data = random.Random(7).randbytes(400_000)
    s = cdc.ChunkSizes.of(1024, 4096, 16384)
    ends = cdc.chunk_ends(data, s)
    steps = np.diff([0, *ends])
    assert (steps[:-1] >= 1024).all() and (steps <= 16384).all() and 0.8 < steps.mean() / 4096 < 1.25

    def hashes(d):
        at = [0, *cdc.chunk_ends(d, s)]
        return {hashlib.sha256(d[a:b]).digest() for a, b in zip(at, at[1:])}

    assert len(hashes(data[:200_000] + b"!" + data[200_000:]) - hashes(data)) <= 4


def test_table_of_another_program(tmp_path):
    at = tmp_path / "numbers"
    at.write_text(",\n".join(hex(int(x)) for x in cdc.byte_table()))
    assert (cdc.byte_table(str(at)) == cdc.byte_table()).all()
    at2 = tmp_path / "few"
    at2.write_text("1 2 3")
    with pytest.raises(ValueError):
        cdc.byte_table(str(at2))


def test_size_texts(spark):
    for text, want in (("1", 1), ("64K", 65536), ("1.5M", 1572864), ("1M512K", 1572864), ("1 M 1K", 1049600), ("10.M", 10 << 20), ("2B", 2)):
        assert sizes.parse_size(text) == want
    for bad in ("", "K", "1K1M", "-1", "1X", "99999999999E"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    assert values(spark, [0, 1023, 1024, 1536, (1 << 20) - 1, 3 << 30, (1 << 63) - 1, None], "long", sizes.format_size) == ["0B", "1023B", "1.0K", "1.5K", "1023.9K", "3.0G", "7.9E", None]
    spans = [0, 1, 1500, 1_500_000_000, 61_000_000_000, 90_061_000_000_001, None]
    assert values(spark, spans, "long", sizes.format_timespan) == ["0", "1ns", "1.500us", "1.500000000s", "1min 1s", "1d 1h 1min 1.000000001s", None]
    assert values(spark, [1_500_000_000, 61_000_000_001], "long", lambda c: sizes.format_timespan(c, 1_000_000)) == ["1.500s", "1min 1.000s"]


# Published cases of locators with their results.
SUFFIX = [("foo", "", True), ("", "foo", False), (None, "foo", False), ("foo.bar", ".bar", True), ("foo.bar", "r", True), ("foo.bar", "foo", False), ("foo.bar", "foo.bar", False), ("http://foobar.com/foo.bar", ".bar", True), ("http://foobar.com/foo.bar", ".qux", False), ("http://foobar.com/foo.bar?miep=.qux", ".bar", True), ("http://foobar.com/foo.bar?miep=.qux", ".qux", False), ("http://foobar.com/foo.bar;miep=.qux", ".bar", True), ("http://foobar.com/foo.bar;miep=.qux", ".qux", False)]
STRIP = [("/foo/bar", "/foo/bar"), ("", ""), ("file:///foobar.txt", "/foobar.txt"), ("file:///foo%20bar.txt", "/foo bar.txt"), ("file:///foo bar.txt", "/foo bar.txt"), ("file:///foo%%xyz.txt", "/foo%%xyz.txt"), ("file:///a+b%2", "/a+b%2"), ("file://localhost/piff.txt", "/piff.txt"), ("file://elsewhere/piff.txt", "file://elsewhere/piff.txt"), ("http://online.com/piff.txt", "http://online.com/piff.txt"), (None, None)]
CLASSES = [(None, None), ("", None), ("x", "path"), (".", "path"), ("..", "path"), ("./", "path"), ("/", "path"), ("/foo", "path"), ("./foo", "path"), ("http://foobar.com/xyz.txt", "url"), ("http://user@foobar.com/xyz.txt?piff=paff", "url"), ("http://user@localhost:1234/x?p", "url"), ("http://[::]:1234/xyz.txt", "url"), ("http://user@foobar.com", "url"), ("foobar:quux.txt", "ssh"), ("someone@foobar:quux.txt", "ssh"), ("localhost:", "path"), ("HTTP://x/y", "ssh")]
PATCH = [("", None), ("foo", "quux"), ("./miepf", "./quux"), ("../miepf", "../quux"), ("some/thing/miepf", "some/thing/quux"), ("/some/thing/miepf", "/some/thing/quux"), ("localhost:", "quux"), ("localhost:miepf", "localhost:quux"), ("localhost:miepf/waldo", "localhost:miepf/quux"), ("localhost:/miepf", "localhost:/quux"), ("localhost:/miepf/waldo", "localhost:/miepf/quux"), ("http://example.com", "http://example.com/quux"), ("http://example.com?foo", "http://example.com/quux"), ("http://example.com/?foo", "http://example.com/quux"), ("http://example.com/miepf?foo", "http://example.com/quux"), ("http://example.com/miepf/more?foo", "http://example.com/miepf/quux")]


def test_locators(spark):
    for suffix in {s for _, s, _ in SUFFIX}:
        own = [(p, w) for p, s, w in SUFFIX if s == suffix]
        assert values(spark, [p for p, _ in own], "string", lambda c: locators.has_suffix(c, suffix)) == [w for _, w in own]
    assert values(spark, [a for a, _ in STRIP], "string", locators.strip_file_url) == [b for _, b in STRIP]
    assert values(spark, [a for a, _ in CLASSES], "string", locators.locator_class) == [b for _, b in CLASSES]
    assert values(spark, [a for a, _ in PATCH], "string", lambda c: locators.patch_last_component(c, "quux")) == [b for _, b in PATCH]
    assert values(spark, ["a.b", ".b", "b.", "ab", "", None, "a." + "x" * 254], "string", locators.xattr_name_valid) == [True, False, False, False, False, False, False]
    assert values(spark, [{"user.a": b"1", "security.x": b"2", "trusted.q": b"3", "user.": b"4"}], "map<string,binary>", locators.stored_xattrs) == [{"user.a": b"1", "trusted.q": b"3"}]


def test_modes(spark):
    modes = [0o100644, 0o040755, 0o120777, 0o104755, 0o104655, 0o042770, 0o041777, 0o101777, 0o041776, 0o060600, 0o020600, 0o010600, 0o140600, 0o000644]
    assert values(spark, modes, "int", listing.mode_string) == ["-rw-r--r--", "drwxr-xr-x", "lrwxrwxrwx", "-rwsr-xr-x", "-rwSr-xr-x", "drwxrws---", "drwxrwxrwt", "-rwxrwxrwx", "drwxrwxrwT", "brw-------", "crw-------", "prw-------", "srw-------", None]
    assert values(spark, [0, 0x18, 0xFFFFFFFF], "long", listing.chattr_string) == ["-" * 10, "S-i-------", "SDiadAcNCP"]
    assert values(spark, [0, 0x22, 7], "int", listing.fat_string) == ["---", "h-a", "hs-"]


def test_escapes_and_names(spark):
    assert values(spark, ["a/b", "a b", "a\\#", "é", "\x7f", "", None], "string", listing.escaped) == ["a/b", "a\\040b", "a\\134\\043", "\\303\\251", "\\177", "", None]
    assert values(spark, ["", "x"], "string", listing.shown_path) == [".", "x"]
    sniffed = [bytes.fromhex("fd377a585a00") + b"x", bytes.fromhex("1f8b0000000000"), bytes.fromhex("28b52ffd000000"), b"abc", b"abcdefg", None]
    assert values(spark, sniffed, "binary", listing.compression_of) == ["xz", "gzip", "zstd", "again", "unknown", None]
    assert values(spark, [0x1396FABCEA5BBB51, ff.signed(0xDFD35C5E8327C403), 5], "long", listing.record_name) == ["entry", "goodbye", None]


def test_mtree_line(spark):
    df = spark.createDataFrame([("a b", 0o100644, 5, 1_000_000_007, "ff", None), ("", 0o040755, 5, 1, "ff", None)], "p string, m int, s long, t long, d string, l string")
    c = F.col
    got = [r[0] for r in df.select(listing.mtree_line(c("p"), c("m"), size=c("s"), mtime_ns=c("t"), digest=c("d"), link=c("l"))).collect()]
    assert got == ["a\\040b type=file mode=0644 size=5 time=1.000000007 sha512256digest=ff", ". type=dir mode=0755 time=0.000000001"]


def plain_normalize(v):
    b = ff.bits
    if v & ~ff.KNOWN:
        return None
    if v & b("acl") and not v & b("16bit-uids", "32bit-uids", "user-names"):
        v |= b("32bit-uids", "user-names")
    for on, off in ff.DROPS:
        if v & b(*on):
            v &= ~b(*off)
    if v & ff.EXCLUDE_NODUMP:
        v &= ~b("flag-nodump")
    return v | b("subvolume") if v & b("subvolume-ro") else v


def test_features(spark):
    rng = random.Random(3)
    flags = [0, ff.DEFAULT, ff.KNOWN, *[1 << k for k in range(64)], *[rng.getrandbits(64) & ff.KNOWN for _ in range(200)]]
    raw = [ff.signed(v) for v in flags]
    got = values(spark, raw, "long", ff.normalize)
    assert got == [None if n is None else ff.signed(n) for n in map(plain_normalize, flags)]
    good = [v for v in got if v is not None]
    assert values(spark, good, "long", ff.is_normalized) == [True] * len(good), "normalizing again changes nothing"
    for g, v in ff.GROUPS.items():
        assert v & ~ff.KNOWN == 0 and ff.parse_feature(g) == v
    names = values(spark, raw, "long", ff.format_features)
    for v, text in zip(flags, names):
        assert (text is None) == bool(v & ~ff.KNOWN)
        if text:
            assert ff.bits(*text.split()) == v & ff.GROUPS["all"]
    assert values(spark, [0x28, 0x18, 0x48, 0x40, 0, 1 << 40], "long", ff.time_granularity) == [1, 1000, 10**9, 2 * 10**9, None, None]
    assert values(spark, [ff.bits("acl"), ff.bits("32bit-uids"), None], "long", ff.normalize_mask) == [ff.bits("acl", "permissions", "read-only"), 3, None]
    assert ff.chosen(0, ff.bits("acl")) == ff.DEFAULT & ~ff.bits("acl")
    both = values(spark, [0, ff.GROUPS["chattr"]], "long", lambda c: ff.from_chattr(ff.to_chattr(c)))
    assert both == [0, ff.GROUPS["chattr"]] and values(spark, [ff.GROUPS["fat-attrs"]], "long", lambda c: ff.from_fat(ff.to_fat(c))) == [ff.GROUPS["fat-attrs"]]


def test_stored_metadata(spark):
    perm, ro, none = (F.lit(ff.bits(x)).cast("long") for x in ("permissions", "read-only", "symlinks"))
    for flags, want in ((perm, [0o100640, 0o040700, 0o120777]), (ro, [0o100666, 0o040777, 0o120777]), (none, [0o100666, 0o040777, 0o120777])):
        assert values(spark, [0o100640, 0o040700, 0o120700], "int", lambda c: ff.stored_mode(c, flags)) == want
    assert values(spark, [0o100440, 0o040500], "int", lambda c: ff.stored_mode(c, ro)) == [0o100444, 0o040555]
    assert values(spark, [1_999_999_999, -1, None], "long", lambda c: ff.floor_time(c, F.lit(8).cast("long"))) == [10**9, -(10**9), None]
    assert values(spark, [1, 0x10005, 65540], "long", lambda c: ff.shifted_uid(c, 5)) == [None, 0, 65535]


LOC = "path string, d string, o long, s long, m long, i long, g int, a long, nt string"


def test_location_texts(spark):
    c = F.col
    rows = [("foo/quux", "p", 4711, 333, 1517231408 * 10**9, 123456, 2345, 87654, None), ("", "e", 0, None, None, None, None, None, "O0H70S0Xa"), ("a+b:c@d", "g", 1, 2, 3, None, -1, None, None)]
    df = spark.createDataFrame(rows, LOC)
    text = locations.format_location(c("path"), c("d"), c("o"), c("s"), c("m"), c("i"), c("g"), F.lit(ff.signed(ff.DEFAULT)).cast("long"), c("a"), c("nt"))
    got = [r.t for r in df.select(text.alias("t")).collect()]
    assert got[0] == f"foo/quux+p4711:333@123456.1517231408000000000.2345%{ff.DEFAULT:x}#87654" and got[1] == f"+e0%{ff.DEFAULT:x}$O0H70S0Xa" and got[2].startswith("a+b:c@d+g1:2@0.3.4294967295%")
    back = values(spark, got, "string", locations.parse_location)
    assert [(b.path, b.designator, b.offset, b.size, b.mtime, b.archive_offset, b.name_table) for b in back] == [(r[0], r[1], r[2], r[3], r[4], r[7], r[8]) for r in rows]
    bad = ["", "foo", "/abs+p1", "a+z1", "a+p", "a+p1:0", "a+v1", "a+p99999999999999999999", "a+p9223372036854775807:9", None]
    assert values(spark, bad, "string", locations.parse_location) == [None] * len(bad)


def test_location_id(spark):
    c = F.col
    df = spark.createDataFrame([("foo", "p", 3, 5, 7, 9, 11, None, None), ("", "e", 0, None, None, 9, 11, None, None)], LOC)
    got = [bytes(r.x).hex() for r in df.select(locations.location_id(c("path"), c("d"), c("o"), c("s"), c("m"), c("i"), c("g"), F.lit(-1).cast("long")).alias("x")).collect()]
    le = lambda v, n=8: v.to_bytes(n, "little")
    assert got[0] == hashlib.sha256(b"foop" + le(3) + le(5) + le(7) + le(9) + le(11, 4) + b"\xff" * 8).hexdigest()
    assert got[1] == hashlib.sha256(b"e" + le(0) + b"\xff" * 8).hexdigest()


def test_origins(spark):
    rows = [("x", 0, "foo", "e", 0, 22), ("x", 1, "foo", "p", 0, 55), ("x", 2, "foo", "p", 55, 77), ("x", 3, "quux", "e", 0, 33), ("y", 0, "foo", "p", 5, None), ("y", 1, "foo", "p", 5, 6)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], "owner string, n int, path string, designator string, offset long, size long, mtime long, inode long, generation int")
    got = sorted((r.owner, r.piece, r.path, r.offset, r["size"]) for r in locations.merged_origins(df, ["owner"], "n").collect())
    assert got == [("x", 0, "foo", 0, 22), ("x", 1, "foo", 0, 132), ("x", 2, "quux", 0, 33), ("y", 0, "foo", 5, None), ("y", 1, "foo", 5, 6)]
    s = spark.createDataFrame([((10, 5, None),)], "l struct<offset:long,size:long,archive_offset:long>")
    a, b = s.select(locations.advance(F.col("l"), F.lit(3)), locations.advance(F.col("l"), F.lit(5))).first()
    assert (a.offset, a["size"], b) == (13, 2, None)


def test_name_tables(spark):
    items = "array<struct<hash:long,start:long,end:long>>"
    df = spark.createDataFrame([(1, [(0xA0, 1, 2), (0xA1, 2, 5), (-1, 5, 9)])], f"o long, i {items}")
    text = df.select(locations.format_name_table(F.col("o"), F.col("i"))).first()[0]
    assert text == "O1Ha0S1X2Ha1S2X5HffffffffffffffffS5X9"
    back = values(spark, [text + "O0H70S0Xa", "O", "H1", None], "string", locations.parse_name_table)
    assert [(t.entry_offset, [tuple(i) for i in t["items"]]) for t in back[0]] == [(1, [(0xA0, 1, 2), (0xA1, 2, 5), (-1, 5, 9)]), (0, [(0x70, 0, 10)])] and back[1:] == [None] * 3
    order = values(spark, [[(-1, 0, 1), (1, 5, 6), (1, 2, 3), (5, 0, 1)]], items, locations.sorted_names)[0]
    assert [(x.hash, x.start) for x in order] == [(1, 2), (1, 5), (5, 0), (-1, 0)]


def test_search_trees(spark):
    trees = values(spark, [list(range(n)) for n in range(0, 140)], "array<int>", locations.as_search_tree)
    for n, t in enumerate(trees):
        assert sorted(t) == list(range(n))
        assert all(t[locations.search_tree_find(t, v)] == v for v in range(n)) and all(locations.search_tree_find(t, v) is None for v in (-2, -1, n, n + 1))
    from tessella.sources.archives import search_tree_places

    assert [search_tree_places(n) for n in range(140)] == trees
    for n in (1000, 4095, 4096, 9998):
        t = search_tree_places(n)
        assert all(t[2 * i + 1] < t[i] for i in range(n) if 2 * i + 1 < n) and all(t[2 * i + 2] > t[i] for i in range(n) if 2 * i + 2 < n)


@pytest.mark.parametrize("codec", ["none", "xz", "gzip", "zstd"])
def test_codecs(spark, codec):
    data = random.Random(1).randbytes(1 << 18)
    assert codecs.decompress_bytes(codecs.compress_bytes(data, codec)) == data
    got = values(spark, [data, b"", None], "binary", lambda c: codecs.decompress(codecs.compress(c, codec)))
    assert [None if g is None else bytes(g) for g in got] == [data, b"", None]
    with pytest.raises(ValueError):
        codecs.decompress_bytes(codecs.compress_bytes(b"x" * 100, codec), most=10)


@given(st.binary(max_size=60))
@settings(max_examples=50, deadline=None)
def test_broken_compressed_data(data):
    for magic in (b"\xfd7zXZ\x00", b"\x1f\x8b", b"\x28\xb5\x2f\xfd"):
        try:
            codecs.decompress_bytes(magic + data)
        except Exception as e:
            assert not isinstance(e, MemoryError)
