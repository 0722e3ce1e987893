"""Locations of data in a tree: text form, identity and algebra; name tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import digest, unsigned

# What a location can point at (entry, payload, file name, goodbye record, void).
DESIGNATORS = "epngv"
_LOCATION = r"(?s)^(.*)\+([a-z])(\d+)(?::(\d+))?(?:@(\d+)\.(\d+)(?:\.(\d+))?)?(?:%([0-9a-f]+))?(?:#(\d+))?(?:\$(O[0-9a-f]+.*))?\z"
MAX_U64 = (1 << 64) - 1


def _opt(prefix: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(prefix), value.cast("string")), F.lit(""))


def hex64(col: Column) -> Column:
    """Hex digits of a BIGINT's 64 bits, without leading zeros."""
    return F.lower(F.conv(F.when(col < 0, F.lit(str(1 << 64)).cast("decimal(20,0)") + col.cast("decimal(20,0)")).otherwise(col.cast("decimal(20,0)")).cast("string"), 10, 16))


def format_location(path: Column, designator: Column, offset: Column, size: Column, mtime: Column, inode: Column, generation: Column, features: Column | None = None, archive_offset: Column | None = None, name_table: Column | None = None) -> Column:
    """`path+d<offset>:size@inode.mtime.generation%features#offset$table`; unknown (null) parts
    are left out, with the time go inode and generation. Path null counts as the top."""
    stamp = F.when(mtime.isNotNull(), F.concat(F.lit("@"), F.coalesce(inode, F.lit(0)).cast("string"), F.lit("."), mtime.cast("string"), _opt(".", F.pmod(generation.cast("long"), F.lit(1 << 32)))))
    parts = [F.coalesce(path, F.lit("")), F.lit("+"), designator, offset.cast("string"), _opt(":", size), F.coalesce(stamp, F.lit(""))]
    if features is not None:
        parts.append(_opt("%", hex64(features)))
    if archive_offset is not None:
        parts.append(_opt("#", archive_offset))
    if name_table is not None:
        parts.append(_opt("$", name_table))
    return F.concat(*parts)


def parse_location(text: Column) -> Column:
    """A struct of the parts, null for what isn't a location: absolute paths, a size
    of 0, offsets that overflow, an unknown designator, a void with a path."""
    part = lambda k: F.nullif(F.regexp_extract(text, _LOCATION, k), F.lit(""))
    number = lambda k: part(k).try_cast("long")
    path, kind, offset, size = F.regexp_extract(text, _LOCATION, 1), part(2), number(3), number(4)
    ok = kind.isin(*DESIGNATORS) & offset.isNotNull() & ~path.startswith("/") & (part(4).isNull() | (size > 0)) & ((kind != "v") | (path == ""))
    ok = ok & F.coalesce(offset.cast("decimal(20,0)") + size.cast("decimal(20,0)") < F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(True))
    features = F.conv(part(8), 16, -10).cast("long")
    return F.when(
        ok,
        F.struct(
            path.alias("path"), kind.alias("designator"), F.when(kind == "v", F.lit(0).cast("long")).otherwise(offset).alias("offset"), size.alias("size"), number(6).alias("mtime"), number(5).alias("inode"),
            number(7).cast("long").alias("generation"), features.alias("features"), number(9).alias("archive_offset"), part(10).alias("name_table"),
        ),
    )


def little_endian(col: Column, width: int = 8) -> Column:
    """The last `width` bytes of a BIGINT, lowest first."""
    digits = F.substring(F.lpad(F.hex(col), 16, "0"), 17 - 2 * width, 2 * width)
    return F.unhex(F.concat(*[F.substring(digits, 2 * (width - k) - 1, 2) for k in range(width)]))


def location_id(path: Column, designator: Column, offset: Column, size: Column | None, mtime: Column, inode: Column, generation: Column, features: Column | None = None, algorithm: str = "sha256") -> Column:
    """The key of a location in a cache: the digest of its known parts as bytes."""
    none = F.lit(b"")
    parts = [F.coalesce(path.cast("binary"), none), designator.cast("binary"), little_endian(offset)]
    if size is not None:
        parts.append(F.coalesce(little_endian(size), none))
    stamp = F.concat(little_endian(mtime), little_endian(F.coalesce(inode, F.lit(0))), F.coalesce(little_endian(generation.cast("long"), 4), none))
    parts.append(F.coalesce(stamp, none))
    if features is not None:
        parts.append(F.coalesce(little_endian(features), none))
    return digest(F.concat(*parts), algorithm)


def location_id_sql(path: str, designator: str, offset: str, size: str | None, mtime: str, inode: str, generation: str) -> str:
    """The same in DuckDB's SQL, as hex digits."""

    def le(x: str, width: int = 8) -> str:
        d = f"lpad(printf('%x', {x}), 16, '0')"
        return " || ".join(f"substr({d}, {16 - 2 * k - 1}, 2)" for k in range(width))

    stamp = f"CASE WHEN {mtime} IS NULL THEN '' ELSE {le(mtime)} || {le(f'coalesce({inode}, 0)')} || coalesce({le(f'CAST({generation} AS BIGINT)', 4)}, '') END"
    sized = f" || coalesce({le(size)}, '')" if size else ""
    return f"sha256(unhex(lower(hex(encode(coalesce({path}, '')))) || lower(hex(encode({designator}))) || {le(offset)}{sized} || {stamp}))"


def advance(location: Column, by: Column) -> Column:
    """A location (struct of offset, size and archive_offset among others) moved on by a number of bytes; null beyond its end."""
    size = location["size"]
    moved = location.withField("offset", location["offset"] + by).withField("size", size - by)
    moved = moved.withField("archive_offset", location["archive_offset"] + by)
    return F.when(size.isNull() | (by < size), moved)


def merged_origins(pieces: DataFrame, owner: list[str], order: str) -> DataFrame:
    """Neighbouring pieces of an origin that continue one another, put together.

    `pieces` has the columns `owner` and `order`, and path, designator, offset,
    size, mtime, inode and generation. A piece is joined to the one before it in
    `order` if all but offset and size are equal (null like null) and it begins
    where that ends; a piece of unknown size is never continued. Returns owner,
    piece (from 0) and the location columns. An owner with very many pieces is
    one window, as an origin is a list that one archive position refers to."""
    same = ["path", "designator", "mtime", "inode", "generation"]
    w = Window.partitionBy(*owner).orderBy(order)
    joins = (F.lag("offset").over(w) + F.lag("size").over(w)).eqNullSafe(F.col("offset"))
    for c in same:
        joins = joins & F.lag(c).over(w).eqNullSafe(F.col(c))
    start = F.when(F.lag("offset").over(w).isNotNull() & joins, 0).otherwise(1)
    runs = pieces.withColumn("__start", start).withColumn("piece", F.sum("__start").over(w) - 1)
    unknown = F.count_if(F.col("size").isNull()) > 0
    return runs.groupBy(*owner, "piece", *same).agg(F.min("offset").alias("offset"), F.when(~unknown, F.sum("size")).alias("size"))


def format_name_table(entry_offset: Column, items: Column) -> Column:
    """`O<offset>` and `H<hash>S<start>X<end>` of each item of an array of structs (hash, start, end)."""
    each = F.transform(items, lambda i: F.concat(F.lit("H"), hex64(i["hash"]), F.lit("S"), hex64(i["start"]), F.lit("X"), hex64(i["end"])))
    return F.concat(F.lit("O"), hex64(entry_offset), F.array_join(each, ""))


def parse_name_table(text: Column) -> Column:
    """An array of tables (entry_offset, items), the innermost first; null if the text is no name table."""
    number = lambda c, k, r: F.conv(F.regexp_extract(c, r, k), 16, -10).cast("long")
    item = "H([0-9a-f]+)S([0-9a-f]+)X([0-9a-f]+)"
    table = lambda t: F.struct(
        number(t, 1, "^O([0-9a-f]+)").alias("entry_offset"),
        F.transform(F.regexp_extract_all(t, F.lit(f"({item})"), 1), lambda i: F.struct(number(i, 1, item).alias("hash"), number(i, 2, item).alias("start"), number(i, 3, item).alias("end"))).alias("items"),
    )
    ok = text.rlike(r"^(O[0-9a-f]+(H[0-9a-f]+S[0-9a-f]+X[0-9a-f]+)*)+\z")
    return F.when(ok, F.transform(F.regexp_extract_all(text, F.lit("(O[^O]+)"), 1), table))


def as_search_tree(items: Column, key=lambda x: x) -> Column:
    """A sorted array as an implicit binary search tree: of the item at i the one at
    2i+1 is smaller and the one at 2i+2 larger. Every place has a known rank in the
    perfect tree; the ranks of the places in use, in order, take the sorted items."""
    n = F.size(items)
    depth = lambda i: F.floor(F.log2(i + F.lit(1))).cast("int")
    rank = lambda i: (i + 1 - F.pow(F.lit(2.0), depth(i))) * 2 + 1
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((rank(i) / F.pow(F.lit(2.0), depth(i) + 1)).alias("r"), i.alias("i")))
    placed = F.zip_with(F.array_sort(places), items, lambda p, x: F.struct(p["i"].alias("i"), x.alias("x")))
    return F.when(n == 0, items).otherwise(F.transform(F.array_sort(placed, lambda a, b: a["i"] - b["i"]), lambda p: p["x"]))


def sorted_names(items: Column) -> Column:
    """Name table items in the order of their unsigned hash, then of their start."""
    return F.array_sort(items, lambda a, b: F.when(unsigned(a["hash"]) < unsigned(b["hash"]), -1).when(unsigned(a["hash"]) > unsigned(b["hash"]), 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def search_tree_find(items: list, wanted) -> int | None:
    """The place of an item in such a tree, by descending it; for tests and point reads."""
    i = 0
    while i < len(items):
        if items[i] == wanted:
            return i
        i = 2 * i + (1 if wanted < items[i] else 2)
    return None


def origin_prefix(pieces: DataFrame, owner: list[str], order: str, n_bytes: int) -> DataFrame:
    """The pieces of each origin that make up its first `n_bytes`, the last one cut. Pieces of
    unknown size end an origin."""
    w = Window.partitionBy(*owner).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = pieces.withColumn("__before", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("__gap", F.coalesce(F.max(F.col("size").isNull()).over(w), F.lit(False)))
    kept = known.filter((F.col("__before") < n_bytes) & ~F.col("__gap") & F.col("size").isNotNull())
    return kept.withColumn("size", F.least(F.col("size"), F.lit(n_bytes) - F.col("__before"))).drop("__before", "__gap")


def same_location(a: Column, b: Column, parts: list[str]) -> Column:
    """Whether two locations (structs) agree in the given parts, unknown like unknown."""
    out = F.lit(True)
    for p in parts:
        out = out & a[p].eqNullSafe(b[p])
    return out
