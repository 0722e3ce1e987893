"""Queries of nodes, locations, flags and texts over the test tables.

The records of the snapshots have no kinds, attributes, mounts or owners. Where an operator needs them they
are told from the inode (0 if it is unknown), in the queries and in their SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cdc, listing, locations, locators, sizes
from ..functions import features as ff
from ..functions.digests import name_hash
from ..operators import cache, index, tree
from ..operators.lookup import attach
from ..operators.order import running_total
from ..operators.snapshots import canonical_path
from ..streaming import exchange
from . import table
from .reference import _CANON, _ENTRIES, _LINE, _SPANS, _by_snapshot, _trees

KINDS = ["file", "link", "block", "char", "fifo", "socket", "file"]


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all snapshots with kind, flags, mount_id and fs told from the inode."""
    q = F.coalesce("inode", F.lit(0))
    kind = F.when(F.col("designator") == "e", "dir").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(q, F.lit(7)) + 1).cast("int")))
    made = _trees(spark, d).withColumns({"kind": kind, "flags": q.bitwiseAND(F.lit(0xFC)), "mount_id": F.when(F.pmod(q, F.lit(20)) == 0, 1).otherwise(0), "fs": F.when(F.pmod(q, F.lit(9)) == 0, "proc").otherwise("ext4"), "q": q})
    return made.withColumnRenamed("mtime", "mtime_ns")


_NODES = f"""{_ENTRIES}, nodes AS (SELECT snapshot_id, path, CASE WHEN designator = 'e' THEN 'dir' ELSE {KINDS}[q % 7 + 1] END AS kind, q & 252 AS flags, CASE WHEN q % 20 = 0 THEN 1 ELSE 0 END AS mount_id,
  CASE WHEN q % 9 = 0 THEN 'proc' ELSE 'ext4' END AS fs, size, mtime, q, inode, start_offset FROM (SELECT *, coalesce(inode, 0) AS q FROM entries))"""
_UP = "regexp_replace(path, '/?[^/]*$', '')"
_NAME = "regexp_extract(path, '[^/]*$')"
#: Every path with the folders above it, and the path itself.
_ABOVE = "above AS (SELECT snapshot_id, path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))) AS at FROM nodes)"


def nodes_of_kinds(spark, d):
    """Nodes whose kind an archive with symbolic links and pipes, but no devices and sockets, keeps."""
    return _by_snapshot(tree.kept_kinds(_nodes(spark, d), ff.bits("symlinks", "fifos")).select("tree_id", "path", "kind"))


def nodes_without_nodump(spark, d):
    """Nodes without the attribute that keeps them out of dumps."""
    return _by_snapshot(tree.without_nodump(_nodes(spark, d), ff.DEFAULT).select("tree_id", "path", "flags"))


def nodes_on_one_mount(spark, d):
    """Nodes that are reached without crossing a mount."""
    return _by_snapshot(tree.without_submounts(_nodes(spark, d)).select("tree_id", "path"))


def nodes_without_virtual(spark, d):
    """Nodes left when what lies in virtual file systems is emptied, with the size that counts."""
    return _by_snapshot(tree.without_virtual(_nodes(spark, d)).select("tree_id", "path", "kind", "size"))


def replayed_columns(spark, d):
    """What an extraction without times and attributes restores of each node."""
    mask = ff.bits("permissions", "xattrs")
    out = tree.replay_columns(_nodes(spark, d).withColumn("permissions", F.col("mode")).select("tree_id", "path", "mode", "mtime_ns", "flags"), mask)
    return _by_snapshot(out)


def replayed_flags(spark, d):
    """Flags of every index that are restored under a mask of weaker ones, and those of its normal form."""
    f, mask = F.col("feature_flags"), F.lit(ff.bits("16bit-uids", "sec-time", "2sec-time", "read-only", "symlinks", "xattrs")).cast("long")
    return table(spark, d, "index_meta").select("index_id", ff.normalize_mask(f).alias("wide"), ff.replayed(f, mask).alias("restored"), ff.is_normalized(f).alias("is_normal"))


EXCLUDE_TEXT = "# sources stay\n*.gz\n!report*.gz\n/keys/\nlogs/*.conf\n"


def excluded_by_files(spark, d):
    """Nodes that the exclude files of their folders take out, a file of the same text lying in every folder whose inode is a multiple of 3."""
    nodes = _nodes(spark, d)
    folders = nodes.filter((F.col("kind") == "dir") & (F.pmod("q", F.lit(3)) == 0))
    files = folders.select("tree_id", F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), F.lit(tree.EXCLUDE_NAME)).alias("path"), F.encode(F.lit(EXCLUDE_TEXT), "utf-8").alias("content"))
    return _by_snapshot(tree.excluded_by_files(nodes, tree.exclude_patterns(files)))


def exclude_pattern_sets(spark, d):
    """The patterns of those files, equal ones once and in order."""
    nodes = _nodes(spark, d).filter((F.col("kind") == "dir") & (F.pmod("q", F.lit(3)) == 0))
    files = nodes.select("tree_id", F.lit(tree.EXCLUDE_NAME).alias("path"), F.encode(F.lit("*\n!b\n/a/\n*\n"), "utf-8").alias("content"))
    return _by_snapshot(tree.pattern_order(tree.exclude_patterns(files)).select("tree_id", "place", "negative", "dirs_only"))


def nodes_at_path(spark, d):
    """What is at and below the folder doc of every snapshot."""
    return _by_snapshot(tree.at_path(_nodes(spark, d), "doc").select("tree_id", "path"))


def children_at_path(spark, d):
    """The same, only one level down, as a listing that goes from sibling to sibling has it."""
    return _by_snapshot(tree.at_path(_nodes(spark, d), "doc", recursive=False).select("tree_id", "path"))


def names_out_of_order(spark, d):
    """Names that a folder lists behind a greater one, if it lists them by inode."""
    listed = _nodes(spark, d).filter(F.col("path") != "").select("tree_id", tree.parent_path(F.col("path")).alias("parent"), tree.base_name(F.col("path")).alias("name"), F.struct("q", "path").alias("seq"))
    return _by_snapshot(tree.out_of_order(listed))


def name_hashes(spark, d):
    """SipHash of every name under the format's key, as signed number."""
    names = table(spark, d, "locations").select(tree.base_name(canonical_path("path")).alias("name")).filter(F.col("name") != "").distinct()
    return names.select("name", name_hash(F.col("name").cast("binary")).alias("hash"))


def _siphash_sql() -> str:
    from ..functions.digests import NAME_HASH_KEY

    k0, k1 = (int.from_bytes(NAME_HASH_KEY[k : k + 8], "little") for k in (0, 8))
    m = (1 << 64) - 1
    big = lambda x: f"CAST({x} AS HUGEINT)"
    rot = lambda x, r: f"((({x} << {r}) | ({x} >> {64 - r})) & {big(m)})"
    word = lambda s: "CAST(CAST('0x' || " + " || ".join(f"substr(x, CAST(16 * ({s}) + {2 * k + 1} AS BIGINT), 2)" for k in range(7, -1, -1)) + " AS UBIGINT) AS HUGEINT)"
    init = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]
    return f"""WITH RECURSIVE t AS (SELECT DISTINCT regexp_extract({_CANON}, '[^/]*$') AS name FROM locations), w AS (SELECT name, strlen(name) AS n, strlen(name) // 8 + 1 AS words FROM t WHERE name <> ''),
      p AS (SELECT name, words, hex(encode(name)) || repeat('00', CAST(words * 8 - n - 1 AS BIGINT)) || printf('%02X', n % 256) AS x FROM w),
      r AS (SELECT name, words, x, 0 AS s, {big(init[0])} AS v0, {big(init[1])} AS v1, {big(init[2])} AS v2, {big(init[3])} AS v3 FROM p
        UNION ALL SELECT name, words, x, s + 1, CASE WHEN s < 2 * words AND s % 2 = 1 THEN xor(a3, m) ELSE a3 END, b2, {rot('c2', 32)}, d2 FROM (
          SELECT *, xor({rot('d1', 21)}, a3) AS d2, xor({rot('b1', 17)}, c2) AS b2 FROM (SELECT *, ({rot('a1', 32)} + d1) & {big(m)} AS a3, (c1 + b1) & {big(m)} AS c2 FROM (
            SELECT *, xor({rot('v1', 13)}, a1) AS b1, xor({rot('y3', 16)}, c1) AS d1 FROM (SELECT *, (v0 + v1) & {big(m)} AS a1, (y2 + y3) & {big(m)} AS c1 FROM (
              SELECT *, CASE WHEN s < 2 * words AND s % 2 = 0 THEN xor(v3, m) ELSE v3 END AS y3, CASE WHEN s = 2 * words THEN xor(v2, {big(255)}) ELSE v2 END AS y2 FROM (
                SELECT *, CASE WHEN s < 2 * words THEN {word('s // 2')} END AS m FROM r WHERE s < 2 * words + 4))))))),
      h AS (SELECT name, xor(xor(v0, v1), xor(v2, v3)) AS h FROM r WHERE s = 2 * words + 4)
      SELECT name, CAST(CASE WHEN h >= {big(1 << 63)} THEN h - {big(1 << 64)} ELSE h END AS BIGINT) AS hash FROM h"""


def search_tree_ranks(spark, d):
    """For folders of every size that there is: the rank of the name at each place of their search tree."""
    per = _nodes(spark, d).filter(F.col("path") != "").groupBy("tree_id", tree.parent_path(F.col("path"))).agg(F.count(F.lit(1)).alias("names")).select("names").distinct()
    return per.select("names", F.posexplode(locations.as_search_tree(F.sequence(F.lit(0).cast("long"), F.col("names") - 1))).alias("place", "rank"))


def name_lookups(spark, d):
    """Where the table of its folder says that each node begins and how long it is, found by the hash of its name."""
    nodes = _nodes(spark, d).select("tree_id", "path", F.col("q").alias("start"), F.coalesce("size", F.lit(0)).alias("size"))
    found = tree.looked_up(tree.name_tables(nodes), nodes.filter(F.col("path") != "").select("tree_id", "path"))
    return _by_snapshot(found.select("tree_id", "path", "start", "size"))


def name_table_texts(spark, d):
    """The name table of each folder as text, hashes being inodes, and whether reading it gives the same table."""
    rows = _nodes(spark, d).filter(F.col("path") != "").select("tree_id", tree.parent_path(F.col("path")).alias("parent"), F.struct(F.col("q").alias("hash"), F.octet_length("path").cast("long").alias("start"), (F.octet_length("path") + F.coalesce("size", F.lit(0))).cast("long").alias("end")).alias("i"))
    items = rows.groupBy("tree_id", "parent").agg(locations.sorted_names(F.array_sort(F.collect_list("i"))).alias("items"))
    text = locations.format_name_table(F.octet_length("parent").cast("long"), F.col("items"))
    back = locations.parse_name_table(text)
    return _by_snapshot(items.select("tree_id", "parent", text.alias("text"), ((F.size(back) == 1) & (back[0]["items"] == F.col("items"))).alias("same")))


def advanced_locations(spark, d):
    """Every payload location moved on by a third of its size, which leaves the rest of it."""
    at = F.struct(F.col("start_offset").alias("offset"), F.col("size"), F.col("inode").alias("archive_offset"))
    moved = locations.advance(at, F.coalesce(F.expr("size div 3"), F.lit(1)))
    return table(spark, d, "locations").select("snapshot_id", "path", "delivered_at", moved["offset"].alias("offset"), moved["size"].alias("size"), moved["archive_offset"].alias("archive_offset"))


def origin_runs(spark, d):
    """Origins of every 16 MiB of each index: neighbouring items that continue one another, put together."""
    none = lambda kind: F.lit(None).cast(kind)
    spans = index.spans(table(spark, d, "index_items")).select("index_id", F.expr("start div 16777216").alias("cell"), "pos", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("size"))
    pieces = spans.select("*", F.lit("blob").alias("path"), F.lit("p").alias("designator"), none("long").alias("mtime"), none("long").alias("inode"), none("int").alias("generation"))
    return locations.merged_origins(pieces, ["index_id", "cell"], "pos").select("index_id", "cell", "piece", "offset", "size")


def origin_prefixes(spark, d):
    """The items that make up the first 100,000 bytes of each 16 MiB of an index, the last one cut."""
    spans = index.spans(table(spark, d, "index_items")).select("index_id", F.expr("start div 16777216").alias("cell"), "pos", (F.col("end") - F.col("start")).alias("size"))
    return locations.origin_prefix(spans, ["index_id", "cell"], "pos", 100_000)


def attribute_texts(spark, d):
    """Attributes of every inode as letters, as a Unix and as a FAT file system shows them, and as feature flags and back."""
    bits = table(spark, d, "locations").select(F.coalesce("inode", F.lit(0)).alias("inode")).distinct().withColumn("a", (F.col("inode") * 40503).bitwiseAND(F.lit(0x3FFFFFFF)))
    flags = ff.from_chattr(F.col("a"))
    return bits.select("inode", listing.chattr_string(F.col("a")).alias("chattr"), listing.fat_string(F.col("a")).alias("fat"), flags.alias("flags"), ff.to_chattr(flags).alias("back"), ff.from_fat(F.col("a")).alias("fat_flags"), ff.to_fat(ff.from_fat(F.col("a"))).alias("fat_back"))


XATTRS = ["{}", "user.{}", "trusted.{}", "security.{}", "user.", ".{}", "user.{}."]


def stored_attributes(spark, d):
    """Which of some extended attributes, named after each name, an archive keeps, and which names are valid at all."""
    names = table(spark, d, "locations").select(tree.base_name(canonical_path("path")).alias("name")).filter(F.col("name") != "").distinct()
    all_ = [F.concat(F.lit(x.split("{}")[0]), F.col("name"), F.lit(x.split("{}")[1])) if "{}" in x else F.lit(x) for x in XATTRS]
    made = F.map_from_arrays(F.array_distinct(F.array(*all_)), F.transform(F.array_distinct(F.array(*all_)), lambda x: F.lit(1)))
    kept = F.array_join(F.array_sort(F.map_keys(locators.stored_xattrs(made))), "|")
    return names.select("name", kept.alias("kept"), locators.xattr_name_valid(F.col("name")).alias("valid"))


def span_texts(spark, d):
    """Every known size as a span of time, taken as nanoseconds, as thousands of them and as seconds."""
    per = table(spark, d, "locations").filter("size IS NOT NULL").select("size").distinct()
    return per.select("size", *[sizes.format_timespan(F.col("size") * F.lit(u)).alias(n) for n, u in (("as_ns", 1), ("as_us", 1_000_003), ("as_s", 1_000_000_000))])


def record_names(spark, d):
    """Names of the record types that the format has, and of numbers that are none."""
    known = [(v - (1 << 64) if v >> 63 else v,) for v in listing.RECORDS.values()]
    return spark.createDataFrame([*known, (0,), (-1,), (12345,)], "magic long").select("magic", listing.record_name(F.col("magic")).alias("name"))


def sniffed_chunks(spark, d):
    """The compression of every stored chunk, told from bytes that begin as its codec's do."""
    head = F.lit(b"")
    for name, magic in listing.MAGICS:
        head = F.when(F.col("codec") == name, F.unhex(F.lit(magic))).otherwise(head)
    stored = table(spark, d, "store_chunks").select("store_id", "chunk", "codec", F.concat(head, F.encode(F.substring("chunk", 1, 40), "utf-8")).alias("data"))
    return stored.select("store_id", "chunk", listing.compression_of(F.col("data")).alias("found"))


def resolved_chunk_sizes(spark, d):
    """The chunk sizes of every index, missing ones told from the others, with the number at which the hash calls for a cut."""
    return table(spark, d, "index_meta").select("index_id", cdc.resolved("chunk_min", "chunk_avg", "chunk_max").alias("r")).select("index_id", "r.*")


def role_pairs(spark, d):
    """Whether two sides whose roles are told from each index's numbers can work with one another."""
    m = table(spark, d, "index_meta").select("index_id", F.pmod(F.col("index_id") * 2654435761, F.lit(8192)).alias("a"), F.pmod(F.col("tree_id") * 40503 + F.col("index_id"), F.lit(64)).alias("b"))
    pairs = m.select("index_id", F.inline(F.array(*[F.struct(F.lit(n).alias("pair"), a.alias("local"), b.alias("remote")) for n, a, b in (("own", F.col("a"), F.col("b")), ("pull", F.lit(0x40).cast("long"), F.col("b")), ("push", F.lit(0xE00).cast("long"), F.col("b")), ("idle", F.col("b"), F.col("b")))])))
    return pairs.select("*", exchange.compatible_roles(F.col("local"), F.col("remote")).alias("compatible"))


def node_violations(spark, d):
    """What is wrong with nodes to which targets, owners, devices and lists of permissions were given by their inode."""
    q = F.col("q")
    at = lambda k, n: F.pmod(q, F.lit(n)) == k
    some = _nodes(spark, d).withColumns(
        {
            "mode": F.when(at(0, 11), 0o200000).otherwise(0o644), "uid": F.when(at(1, 11), 0xFFFF).otherwise(5).cast("long"), "gid": F.lit(6).cast("long"), "user": F.when(at(2, 11), "root").when(at(3, 11), F.repeat(F.lit("u"), 300)),
            "group": F.lit(None).cast("string"), "target": F.when(at(4, 11), "there").when(at(5, 11), F.repeat(F.lit("t"), 5000)), "major": F.when(at(6, 11), 1).when(at(7, 11), 5000).cast("long"), "minor": F.lit(3).cast("long"),
            "fcaps": F.when(at(8, 11), F.lit(b"x")), "quota_projid": F.when(at(9, 11), 4), "xattrs": F.when(at(10, 11), F.create_map(F.lit("user.a"), F.lit(b"1"))),
            "acl": F.when(at(0, 5), F.array(_acl("user"), _acl("group-obj"))).when(at(1, 5), F.array(_acl("user"))).when(at(2, 5), F.array(_acl("default-user"), _acl("default-mask"))).when(at(3, 5), F.array(_acl("default-group"))),
        }
    )
    return _by_snapshot(tree.entry_violations(some, ff.bits("usec-time", "16bit-uids")))


def _acl(tag: str):
    return F.struct(F.lit(tag).alias("tag"), F.lit(1).cast("long").alias("id"), F.lit("n").alias("name"), F.lit(7).alias("perm"))


def cache_by_location(spark, d):
    """Hits, misses and invalidated entries of each snapshot, every location of which is looked up in a cache that the one before it
    filled: chunks of four locations, in the order of the walk, that count only if all of them are there again side by side."""
    from pyspark.sql import Window

    snaps = table(spark, d, "snapshots").withColumn("n", F.row_number().over(Window.partitionBy("tree_id").orderBy("snap_no"))).select(F.col("snapshot_id").alias("tree_id"), F.col("tree_id").alias("tree"), "n")
    none = F.lit(None).cast("long")
    nodes = _trees(spark, d)
    placed = running_total(nodes.select("tree_id", "path", "designator", "mtime", "inode", tree.tree_order(F.col("path")).alias("key")), ["tree_id"], ["key"], name="place")
    ids = locations.location_id(F.col("path"), F.col("designator"), F.lit(0).cast("long"), None, F.col("mtime"), F.col("inode"), none)
    rows = attach(placed, snaps, ["tree_id"]).select("tree", "n", "place", ids.alias("location_id"))
    kept = cache.chunk_origins(rows.withColumn("chunk", F.expr("place div 4")), ["tree", "n"], "chunk").withColumn("n", F.col("n") + 1)
    got = cache.verified_lookups(rows.filter("n > 1"), kept, ["tree", "n"])
    return cache.cache_totals(got, ["tree", "n"]).withColumnRenamed("tree", "tree_id")


QUERIES = {
    f.__name__: f
    for f in (
        nodes_of_kinds, nodes_without_nodump, nodes_on_one_mount, nodes_without_virtual, replayed_columns, replayed_flags, excluded_by_files, exclude_pattern_sets, nodes_at_path, children_at_path, names_out_of_order, name_hashes,
        search_tree_ranks, name_lookups, name_table_texts, advanced_locations, origin_runs, origin_prefixes, attribute_texts, stored_attributes, span_texts, record_names, sniffed_chunks, resolved_chunk_sizes, role_pairs, node_violations, cache_by_location,
    )
}

_F = {n: ff.signed(v) for n, v in ff.FEATURES.items()}


def _wide_sql(f: str) -> str:
    """A mask with every weaker flag, in SQL."""
    out = f"({f} & {ff.signed(ff.KNOWN)})"
    for on, also in ((3, 3), (120, 120), (_F["permissions"], _F["read-only"]), (_F["acl"], _F["permissions"] | _F["read-only"]), (_F["subvolume-ro"], _F["subvolume"])):
        out += f" | CASE WHEN {f} & {on} <> 0 THEN {also} ELSE 0 END"
    return f"({out})"


def _normal_sql(source: str, f: str) -> str:
    """CTEs that end in `normal` with the columns of `source` and v, the normal form of f; null if a bit is unknown."""
    return f"""n1 AS (SELECT *, CASE WHEN {f} & {_F['acl']} <> 0 AND {f} & 7 = 0 THEN {f} | 6 ELSE {f} END AS x1 FROM {source}), n2 AS (SELECT *, CASE WHEN x1 & 2 <> 0 THEN x1 & ~1 ELSE x1 END AS x2 FROM n1),
      n3 AS (SELECT *, CASE WHEN x2 & 32 <> 0 THEN x2 & ~88 WHEN x2 & 16 <> 0 THEN x2 & ~72 WHEN x2 & 8 <> 0 THEN x2 & ~64 ELSE x2 END AS x3 FROM n2),
      n4 AS (SELECT *, CASE WHEN x3 & {_F['acl']} <> 0 THEN x3 & ~384 WHEN x3 & 256 <> 0 THEN x3 & ~128 ELSE x3 END AS x4 FROM n3), n5 AS (SELECT *, CASE WHEN x4 < 0 THEN x4 & ~{_F['flag-nodump']} ELSE x4 END AS x5 FROM n4),
      normal AS (SELECT *, CASE WHEN {f} & {~ff.signed(ff.KNOWN)} = 0 THEN CASE WHEN x5 & {_F['subvolume-ro']} <> 0 THEN x5 | {_F['subvolume']} ELSE x5 END END AS v FROM n5)"""


def _letters_sql(col: str, letters) -> str:
    return " || ".join(f"CASE WHEN {col} & {b} <> 0 THEN '{c}' ELSE '-' END" for b, c in letters)


def _map_sql(col: str, pairs) -> str:
    return "(" + " | ".join(f"CASE WHEN {col} & {a} <> 0 THEN {b} ELSE 0 END" for a, b in pairs) + ")"


def _span_sql(x: str) -> str:
    low = " ".join(f"WHEN l >= {u} THEN (l // {u})::VARCHAR || CASE WHEN l % {u} > 0 AND {u} > 1 THEN '.' || lpad((l % {u})::VARCHAR, {len(str(u)) - 1}, '0') ELSE '' END || '{n}'" for n, u in sizes.SPANS[6:])
    # Each larger unit is what is left by the ones before it.
    steps, rest = [], x
    for n, u in sizes.SPANS[:6]:
        steps.append(f"CASE WHEN {rest} >= {u} THEN ({rest} // {u})::VARCHAR || '{n}' END")
        rest = f"({rest} % {u})"
    return f"CASE WHEN {x} = 0 THEN '0' ELSE concat_ws(' ', {', '.join(steps)}, (SELECT CASE {low} END FROM (SELECT {rest} AS l))) END"


_PAIRS = [(v, ff.FEATURES[n]) for n, v in ff.CHATTR.items()]
_FATS = [(v, ff.FEATURES[n]) for n, v in ff.FAT.items()]
_BACK = lambda pairs: [(b, a) for a, b in pairs]
_MAGIC = {"xz": "FD377A585A00", "gzip": "1F8B", "zstd": "28B52FFD"}
_SHOWN_XATTRS = ", ".join("name" if x == "{}" else "'" + x.split("{}")[0] + "'" + (" || name || '" + x.split("{}")[1] + "'" if "{}" in x else "") for x in XATTRS)
_VALID = lambda x: f"(strlen({x}) <= 255 AND instr({x}, '.') > 1 AND instr({x}, '.') < length({x}))"
_LOC = locations.location_id_sql("path", "designator", "0", None, "mtime", "inode", "NULL")

ORACLE = {
    "nodes_of_kinds": f"WITH {_NODES} SELECT snapshot_id, path, kind FROM nodes WHERE kind IN ('dir', 'file', 'link', 'fifo')",
    "nodes_without_nodump": f"WITH {_NODES} SELECT snapshot_id, path, flags FROM nodes WHERE flags & 64 = 0",
    "nodes_on_one_mount": f"""WITH {_NODES}, {_ABOVE}, tops AS (SELECT c.snapshot_id, c.path FROM nodes c JOIN nodes p ON p.snapshot_id = c.snapshot_id AND p.path = regexp_replace(c.path, '/?[^/]*$', '') WHERE c.path <> '' AND c.mount_id <> p.mount_id)
        SELECT snapshot_id, path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM above a JOIN tops t ON t.snapshot_id = a.snapshot_id AND t.path = a.at WHERE a.snapshot_id = n.snapshot_id AND a.path = n.path)""",
    "nodes_without_virtual": f"""WITH {_NODES}, {_ABOVE}, gone AS (SELECT DISTINCT a.snapshot_id, a.path FROM above a JOIN nodes t ON t.snapshot_id = a.snapshot_id AND t.path = a.at WHERE t.kind = 'dir' AND t.fs = 'proc' AND a.path <> a.at)
        SELECT snapshot_id, path, kind, CASE WHEN fs = 'proc' AND kind = 'file' THEN 0 ELSE size END AS size FROM nodes ANTI JOIN gone USING (snapshot_id, path)""",
    "replayed_columns": f"WITH {_NODES} SELECT snapshot_id, path, CAST((CASE WHEN kind = 'dir' THEN 16384 ELSE 32768 END) | coalesce(inode % 4096, 420) AS INTEGER) AS mode, CAST(NULL AS BIGINT) AS mtime_ns, CAST(NULL AS BIGINT) AS flags FROM nodes",
    "replayed_flags": f"""WITH m AS (SELECT index_id, feature_flags AS f, {_wide_sql('feature_flags')} AS wide FROM index_meta), w AS (SELECT *, wide & {ff.bits('16bit-uids', 'sec-time', '2sec-time', 'read-only', 'symlinks', 'xattrs')} AS g FROM m),
        {_normal_sql('w', 'g')}, k AS (SELECT index_id, f, wide, v AS restored FROM normal), {_normal_sql('k', 'f').replace('n1', 'o1').replace('n2', 'o2').replace('n3', 'o3').replace('n4', 'o4').replace('n5', 'o5').replace('normal', 'plain')}
        SELECT index_id, wide, restored, v = f AS is_normal FROM plain""",
    "excluded_by_files": f"""WITH {_NODES}, {_ABOVE}, files AS (SELECT snapshot_id, path AS scope FROM nodes WHERE kind = 'dir' AND q % 3 = 0), names AS (SELECT snapshot_id, path, kind, {_NAME} AS name FROM nodes WHERE path <> ''),
        met AS (SELECT n.snapshot_id, n.path, n.kind, n.name, f.scope, CASE WHEN f.scope = '' THEN n.path ELSE substr(n.path, length(f.scope) + 2) END AS below FROM names n JOIN files f ON f.snapshot_id = n.snapshot_id AND (f.scope = '' OR starts_with(n.path, f.scope || '/'))),
        j AS (SELECT snapshot_id, path, bool_or(name[1] <> '.' AND ends_with(name, '.gz') OR kind = 'dir' AND below = 'keys' OR regexp_full_match(below, 'logs/[^./][^/]*\\.conf')) AS gone, bool_or(starts_with(name, 'report') AND ends_with(name, '.gz')) AS stays FROM met GROUP BY ALL)
        SELECT DISTINCT a.snapshot_id, a.path FROM above a JOIN j ON j.snapshot_id = a.snapshot_id AND j.path = a.at WHERE gone AND NOT stays""",
    "exclude_pattern_sets": f"""WITH {_NODES} SELECT DISTINCT snapshot_id, place, negative, dirs_only FROM nodes, (VALUES (0, false, false), (1, false, true), (2, true, false)) v(place, negative, dirs_only) WHERE kind = 'dir' AND q % 3 = 0""",
    "nodes_at_path": f"WITH {_NODES} SELECT snapshot_id, path FROM nodes WHERE path = 'doc' OR starts_with(path, 'doc/')",
    "children_at_path": f"WITH {_NODES} SELECT snapshot_id, path FROM nodes WHERE path = 'doc' OR regexp_full_match(path, 'doc/[^/]+')",
    "names_out_of_order": f"""WITH {_NODES}, l AS (SELECT snapshot_id, {_UP} AS parent, {_NAME} AS name, lag({_NAME}) OVER (PARTITION BY snapshot_id, {_UP} ORDER BY q, path) AS before FROM nodes WHERE path <> '')
        SELECT snapshot_id, parent, name FROM l WHERE before >= name""",
    "name_hashes": _siphash_sql(),
    "search_tree_ranks": f"""WITH RECURSIVE {_NODES}, z AS (SELECT DISTINCT count(*) AS names FROM nodes WHERE path <> '' GROUP BY snapshot_id, {_UP}),
        shape AS (SELECT names, names AS s, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS place FROM z
          UNION ALL SELECT names, CASE WHEN side = 0 THEN l ELSE s - 1 - l END, CASE WHEN side = 0 THEN first ELSE first + l + 1 END, 2 * place + 1 + side FROM (
            SELECT *, CAST(least(s - (2 ^ h - 1), 2 ^ h / 2) + 2 ^ h / 2 - 1 AS BIGINT) AS l FROM (SELECT *, floor(log2(s)) AS h FROM shape WHERE s > 1)), (VALUES (0), (1)) v(side) WHERE CASE WHEN side = 0 THEN l ELSE s - 1 - l END > 0)
        SELECT names, CAST(place AS INTEGER) AS place, first + CASE WHEN s > 1 THEN CAST(least(s - (2 ^ floor(log2(s)) - 1), 2 ^ floor(log2(s)) / 2) + 2 ^ floor(log2(s)) / 2 - 1 AS BIGINT) ELSE 0 END AS rank FROM shape""",
    "name_lookups": f"WITH {_NODES} SELECT snapshot_id, path, q AS start, coalesce(size, 0) AS size FROM nodes WHERE path <> ''",
    "name_table_texts": f"""WITH {_NODES}, i AS (SELECT snapshot_id, {_UP} AS parent, q, strlen(path) AS a, strlen(path) + coalesce(size, 0) AS b FROM nodes WHERE path <> '')
        SELECT snapshot_id, parent, 'O' || printf('%x', any_value(strlen(parent))) || string_agg('H' || printf('%x', q) || 'S' || printf('%x', a) || 'X' || printf('%x', b), '' ORDER BY q, a, b) AS text, true AS same FROM i GROUP BY ALL""",
    "advanced_locations": "SELECT snapshot_id, path, delivered_at, CASE WHEN size IS NULL THEN start_offset + 1 WHEN size // 3 < size THEN start_offset + size // 3 END AS \"offset\", CASE WHEN size // 3 < size THEN size - size // 3 END AS size, CASE WHEN size IS NULL THEN inode + 1 WHEN size // 3 < size THEN inode + size // 3 END AS archive_offset FROM locations",
    "origin_runs": f"""WITH {_SPANS}, c AS (SELECT index_id, a // 16777216 AS cell, pos, a, b FROM spans), g AS (SELECT *, CASE WHEN lag(b) OVER w = a THEN 0 ELSE 1 END AS begins FROM c WINDOW w AS (PARTITION BY index_id, cell ORDER BY pos)),
        r AS (SELECT *, sum(begins) OVER (PARTITION BY index_id, cell ORDER BY pos) - 1 AS piece FROM g) SELECT index_id, cell, CAST(piece AS BIGINT) AS piece, min(a) AS "offset", CAST(sum(b - a) AS BIGINT) AS size FROM r GROUP BY ALL""",
    "origin_prefixes": f"""WITH {_SPANS}, c AS (SELECT index_id, a // 16777216 AS cell, pos, b - a AS n FROM spans), g AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY index_id, cell ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT index_id, cell, pos, CAST(least(n, 100000 - before) AS BIGINT) AS size FROM g WHERE before < 100000""",
    "attribute_texts": f"""WITH a AS (SELECT DISTINCT coalesce(inode, 0) AS inode, (coalesce(inode, 0) * 40503) & 1073741823 AS a FROM locations), b AS (SELECT *, {_map_sql('a', _PAIRS)} AS flags, {_map_sql('a', _FATS)} AS fat_flags FROM a)
        SELECT inode, {_letters_sql('a', listing.CHATTR_LETTERS)} AS chattr, {_letters_sql('a', listing.FAT_LETTERS)} AS fat, CAST(flags AS BIGINT) AS flags, CAST({_map_sql('flags', _BACK(_PAIRS))} AS BIGINT) AS back, CAST(fat_flags AS BIGINT) AS fat_flags, CAST({_map_sql('fat_flags', _BACK(_FATS))} AS BIGINT) AS fat_back FROM b""",
    "stored_attributes": f"""WITH t AS (SELECT DISTINCT regexp_extract({_CANON}, '[^/]*$') AS name FROM locations), x AS (SELECT name, unnest(list_distinct([{_SHOWN_XATTRS}])) AS x FROM t WHERE name <> '')
        SELECT name, coalesce(string_agg(x, '|' ORDER BY x) FILTER (WHERE {_VALID('x')} AND (starts_with(x, 'user.') OR starts_with(x, 'trusted.'))), '') AS kept, {_VALID('name')} AS valid FROM x GROUP BY name""",
    "span_texts": f"WITH z AS (SELECT DISTINCT size FROM locations WHERE size IS NOT NULL), y AS (SELECT size, size * 1000003 AS b, size * 1000000000 AS c FROM z) SELECT size, {_span_sql('size')} AS as_ns, {_span_sql('b')} AS as_us, {_span_sql('c')} AS as_s FROM y",
    "record_names": "SELECT * FROM (VALUES " + ", ".join(f"({v - (1 << 64) if v >> 63 else v}, '{n}')" for n, v in listing.RECORDS.items()) + ", (0, NULL), (-1, NULL), (12345, NULL)) v(magic, name)",
    "sniffed_chunks": "SELECT store_id, chunk, CASE WHEN chunk IS NULL THEN NULL WHEN strlen(substr(chunk, 1, 40)) + " + "CASE codec WHEN 'xz' THEN 6 WHEN 'gzip' THEN 2 WHEN 'zstd' THEN 4 ELSE 0 END < 6 THEN 'again' WHEN codec IN ('xz', 'gzip', 'zstd') THEN codec ELSE 'unknown' END AS found FROM store_chunks",
    "resolved_chunk_sizes": """WITH a AS (SELECT index_id, nullif(chunk_min, 0) AS mn, nullif(chunk_avg, 0) AS av, nullif(chunk_max, 0) AS mx FROM index_meta),
        b AS (SELECT *, CASE WHEN mn IS NULL AND av IS NULL AND mx IS NULL THEN 65536 WHEN av IS NOT NULL THEN av WHEN mn IS NOT NULL AND mx IS NOT NULL THEN CAST(round_even(pow(2, (log2(mn) + log2(mx)) / 2), 0) AS BIGINT) WHEN mn IS NOT NULL THEN mn * 4 ELSE mx // 4 END AS av2 FROM a),
        c AS (SELECT *, coalesce(mn, greatest(av2 // 4, 1)) AS mn2, coalesce(mx, least(av2 * 4, 134217728)) AS mx2 FROM b)
        SELECT index_id, CASE WHEN ok THEN mn2 END AS min, CASE WHEN ok THEN av2 END AS avg, CASE WHEN ok THEN mx2 END AS max, CASE WHEN ok THEN least(greatest(CAST(floor(av2 / (-1.42888852e-7::DOUBLE * av2 + 1.33237515::DOUBLE)) AS BIGINT), mn2), mx2) END AS discriminator
        FROM (SELECT *, 1 <= mn2 AND mn2 <= av2 AND av2 <= mx2 AND mx2 <= 134217728 AS ok FROM c)""",
    "role_pairs": """WITH m AS (SELECT index_id, index_id * 2654435761 % 8192 AS a, (tree_id * 40503 + index_id) % 64 AS b FROM index_meta),
        p AS (SELECT index_id, 'own' AS pair, a AS local, b AS remote FROM m UNION ALL SELECT index_id, 'pull', 64, b FROM m UNION ALL SELECT index_id, 'push', 3584, b FROM m UNION ALL SELECT index_id, 'idle', b, b FROM m),
        s AS (SELECT *, unnest([1, 2]) AS side FROM p), x AS (SELECT index_id, pair, local, remote, CASE side WHEN 1 THEN local ELSE remote END AS own, CASE side WHEN 1 THEN remote ELSE local END AS other FROM s),
        v AS (SELECT *, (own & 64 <> 0 AND other & 1 = 0) OR (own & 128 <> 0 AND other & 4 = 0) OR (own & 256 <> 0 AND other & 16 = 0) OR (own & 512 <> 0 AND other & 2 = 0) OR (own & 1024 <> 0 AND other & 8 = 0) OR (own & 4096 <> 0 AND other & 32 = 0)
          OR (own & 2048 <> 0 AND own & 1536 <> 1536) OR own >= 8192 AS bad FROM x)
        SELECT index_id, pair, local, remote, NOT bool_or(bad) AND bool_or(own & 6080 <> 0) AS compatible FROM v GROUP BY ALL""",
    "node_violations": f"""WITH {_NODES}, m AS (SELECT *, q % 11 AS e, q % 5 AS f, {_NAME} AS name FROM nodes), r AS (
          SELECT snapshot_id, path, 'bad_mode' AS rule FROM m WHERE e = 0 UNION ALL SELECT snapshot_id, path, 'bad_uid' FROM m WHERE e = 1 UNION ALL SELECT snapshot_id, path, 'root_name' FROM m WHERE e = 2 UNION ALL SELECT snapshot_id, path, 'name_of_owner_too_long' FROM m WHERE e = 3
          UNION ALL SELECT snapshot_id, path, 'owner_name_without_flag' FROM m WHERE e IN (2, 3) UNION ALL SELECT snapshot_id, path, 'target_on_other' FROM m WHERE e IN (4, 5) AND kind <> 'link' UNION ALL SELECT snapshot_id, path, 'target_too_long' FROM m WHERE e = 5
          UNION ALL SELECT snapshot_id, path, 'link_without_target' FROM m WHERE kind = 'link' AND e NOT IN (4, 5) UNION ALL SELECT snapshot_id, path, 'device_without_number' FROM m WHERE kind IN ('block', 'char') AND e NOT IN (6, 7)
          UNION ALL SELECT snapshot_id, path, 'number_on_other' FROM m WHERE kind NOT IN ('block', 'char') AND e IN (6, 7) UNION ALL SELECT snapshot_id, path, 'number_out_of_range' FROM m WHERE e = 7 UNION ALL SELECT snapshot_id, path, 'fcaps_on_other' FROM m WHERE e = 8 AND kind <> 'file'
          UNION ALL SELECT snapshot_id, path, 'projid_on_other' FROM m WHERE e = 9 AND kind NOT IN ('file', 'dir') UNION ALL SELECT snapshot_id, path, 'xattrs_on_link' FROM m WHERE e = 10 AND kind = 'link' UNION ALL SELECT snapshot_id, path, 'flags_on_other' FROM m WHERE flags <> 0 AND kind NOT IN ('file', 'dir')
          UNION ALL SELECT snapshot_id, path, 'acl_on_link' FROM m WHERE f < 4 AND kind = 'link' UNION ALL SELECT snapshot_id, path, 'acl_without_group' FROM m WHERE f = 1 UNION ALL SELECT snapshot_id, path, 'default_acl_on_other' FROM m WHERE f IN (2, 3) AND kind <> 'dir'
          UNION ALL SELECT snapshot_id, path, 'default_acl_without_mask' FROM m WHERE f = 3 UNION ALL SELECT snapshot_id, path, 'file_without_payload' FROM m WHERE kind = 'file' AND size IS NULL UNION ALL SELECT snapshot_id, path, 'root_not_dir' FROM m WHERE path = '' AND kind <> 'dir'
          UNION ALL SELECT snapshot_id, path, 'bad_nsec' FROM m WHERE mtime < 0 UNION ALL SELECT snapshot_id, path, 'time_not_granular' FROM m WHERE mtime % 1000 <> 0 UNION ALL SELECT snapshot_id, path, 'bad_name' FROM m WHERE name IN ('.', '..') UNION ALL SELECT snapshot_id, path, 'name_too_long' FROM m WHERE strlen(name) > 255)
        SELECT * FROM r""",
    "cache_by_location": f"""WITH {_ENTRIES}, s AS (SELECT snapshot_id, tree_id, row_number() OVER (PARTITION BY tree_id ORDER BY snap_no) AS n FROM snapshots),
        l AS (SELECT tree_id, n, row_number() OVER (PARTITION BY snapshot_id ORDER BY list_transform(string_split(path, '/'), lambda x: hex(encode(x)))) - 1 AS place, {_LOC} AS id FROM entries JOIN s USING (snapshot_id)),
        o AS (SELECT tree_id, n + 1 AS n, place // 4 AS chunk, list(id ORDER BY place) AS origin FROM l GROUP BY ALL), k AS (SELECT tree_id, n, origin[1] AS id, origin FROM o),
        u AS (SELECT tree_id, n, id, arg_min(origin, chunk) AS origin FROM (SELECT *, origin[1] AS id FROM o) GROUP BY ALL), c AS (SELECT tree_id, n, id, min(place) AS place FROM l GROUP BY ALL),
        h AS (SELECT tree_id, n, k.id, len(any_value(origin)) AS want, count(c.place) AS have, min(c.place - i) AS low, max(c.place - i) AS high FROM (SELECT tree_id, n, id, origin, unnest(origin) AS piece, unnest(range(0, len(origin))) AS i FROM u) k
          LEFT JOIN c USING (tree_id, n) WHERE c.id = k.piece GROUP BY tree_id, n, k.id),
        v AS (SELECT l.tree_id, l.n, CASE WHEN u.id IS NULL THEN 'miss' WHEN h.have = h.want AND h.low = h.high THEN 'hit' ELSE 'invalidated' END AS v FROM l LEFT JOIN u USING (tree_id, n, id) LEFT JOIN h USING (tree_id, n, id) WHERE l.n > 1)
        SELECT tree_id, CAST(n AS INTEGER) AS n, count_if(v = 'hit') AS hits, count_if(v = 'miss') AS misses, count_if(v = 'invalidated') AS invalidated, count_if(v <> 'hit') AS added FROM v GROUP BY ALL""",
}
