"""Feature flags of archives and indices, as signed BIGINT of the same 64 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format.
FEATURES = {
    "16bit-uids": 0x1,
    "32bit-uids": 0x2,
    "user-names": 0x4,
    "sec-time": 0x8,
    "usec-time": 0x10,
    "nsec-time": 0x20,
    "2sec-time": 0x40,
    "read-only": 0x80,
    "permissions": 0x100,
    "symlinks": 0x200,
    "device-nodes": 0x400,
    "fifos": 0x800,
    "sockets": 0x1000,
    "flag-hidden": 0x2000,
    "flag-system": 0x4000,
    "flag-archive": 0x8000,
    "flag-append": 0x10000,
    "flag-noatime": 0x20000,
    "flag-compr": 0x40000,
    "flag-nocow": 0x80000,
    "flag-nodump": 0x100000,
    "flag-dirsync": 0x200000,
    "flag-immutable": 0x400000,
    "flag-sync": 0x800000,
    "flag-nocomp": 0x1000000,
    "flag-projinherit": 0x2000000,
    "subvolume": 0x4000000,
    "subvolume-ro": 0x8000000,
    "xattrs": 0x10000000,
    "acl": 0x20000000,
    "selinux": 0x40000000,
    "fcaps": 0x80000000,
    "quota-projid": 0x100000000,
}
EXCLUDE_FILE, SHA512_256, EXCLUDE_SUBMOUNTS, EXCLUDE_NODUMP = 1 << 60, 1 << 61, 1 << 62, 1 << 63
CHATTR = {"flag-append": 0x20, "flag-noatime": 0x80, "flag-compr": 0x4, "flag-nocow": 0x800000, "flag-nodump": 0x40, "flag-dirsync": 0x10000, "flag-immutable": 0x10, "flag-sync": 0x8, "flag-nocomp": 0x400, "flag-projinherit": 0x20000000}
FAT = {"flag-hidden": 0x2, "flag-system": 0x4, "flag-archive": 0x20}


def bits(*names: str) -> int:
    out = 0
    for n in names:
        out |= FEATURES.get(n) or GROUPS[n]
    return out


_UIDS, _TIMES, _NODES = ("16bit-uids", "32bit-uids", "user-names"), ("sec-time", "usec-time", "nsec-time", "2sec-time"), ("symlinks", "device-nodes", "fifos", "sockets")
GROUPS: dict[str, int] = {}
GROUPS["all"] = bits(*FEATURES)
GROUPS["chattr"], GROUPS["fat-attrs"] = bits(*CHATTR), bits(*FAT)
GROUPS["best"] = GROUPS["all"] & ~bits("16bit-uids", "sec-time", "usec-time", "2sec-time", "read-only", "permissions")
GROUPS["unix"] = bits("16bit-uids", "permissions", "sec-time", *_NODES)
GROUPS["fat"] = bits("2sec-time", "read-only", "fat-attrs")
GROUPS["privileged"] = bits(*_UIDS, "device-nodes", "flag-system", "flag-append", "flag-immutable", "subvolume", "subvolume-ro", "acl", "selinux", "fcaps", "quota-projid")
GROUPS["fuse"] = bits("16bit-uids", "32bit-uids", *_TIMES, "read-only", "permissions", *_NODES, "fat-attrs", "chattr", "xattrs")
ORDERED_GROUPS = ["best", "unix", "fat", "chattr", "fat-attrs", "privileged", "fuse", "all"]
DEFAULT = GROUPS["best"] & ~FEATURES["flag-nodump"] | EXCLUDE_NODUMP | EXCLUDE_FILE | SHA512_256
KNOWN = GROUPS["all"] | EXCLUDE_NODUMP | EXCLUDE_SUBMOUNTS | EXCLUDE_FILE | SHA512_256

#: If any of the first is on, the second are dropped.
DROPS = [
    (("32bit-uids",), ("16bit-uids",)),
    (("nsec-time",), ("usec-time", "sec-time", "2sec-time")),
    (("usec-time",), ("sec-time", "2sec-time")),
    (("sec-time",), ("2sec-time",)),
    (("acl",), ("permissions", "read-only")),
    (("permissions",), ("read-only",)),
]
#: If any of the first is on, so are the second.
IMPLIES = [
    (("16bit-uids", "32bit-uids"), ("16bit-uids", "32bit-uids")),
    (_TIMES, _TIMES),
    (("permissions",), ("read-only",)),
    (("acl",), ("permissions", "read-only")),
    (("subvolume-ro",), ("subvolume",)),
]
GRANULARITY = [("nsec-time", 1), ("usec-time", 1_000), ("sec-time", 1_000_000_000), ("2sec-time", 2_000_000_000)]


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _lit(v: int) -> Column:
    return F.lit(signed(v)).cast("long")


def has(col: Column, mask: int) -> Column:
    return col.bitwiseAND(_lit(mask)) != 0


def _without(col: Column, mask: int) -> Column:
    return col.bitwiseAND(_lit(~mask & (1 << 64) - 1))


def known(col: Column) -> Column:
    return _without(col, KNOWN) == 0


def normalize(col: Column) -> Column:
    """The fewest flags that say the same: of overlapping ones only the strongest.
    Null if a bit is unknown."""
    with_uids = has(col, bits("acl")) & ~has(col, bits(*_UIDS))
    x = col.bitwiseOR(F.when(with_uids, _lit(bits("32bit-uids", "user-names"))).otherwise(_lit(0)))
    # What a stronger flag drops doesn't depend on what others drop, so that all of it is told from the flags as they came.
    off = F.when(has(col, EXCLUDE_NODUMP), _lit(FEATURES["flag-nodump"])).otherwise(_lit(0))
    for on, drop in DROPS:
        off = off.bitwiseOR(F.when(has(col, bits(*on)), _lit(bits(*drop))).otherwise(_lit(0)))
    out = x.bitwiseAND(F.bitwise_not(off)).bitwiseOR(F.when(has(col, FEATURES["subvolume-ro"]), _lit(FEATURES["subvolume"])).otherwise(_lit(0)))
    return F.when(known(col), out)


def is_normalized(col: Column) -> Column:
    return normalize(col) == col


def normalize_mask(col: Column) -> Column:
    """A mask with every weaker flag that its flags imply; null (no mask) stays null."""
    x = col.bitwiseAND(_lit(KNOWN))
    for on, also in IMPLIES:
        x = x.bitwiseOR(F.when(has(col, bits(*on)), _lit(bits(*also))).otherwise(_lit(0)))
    return x


def replayed(stream: Column, mask: Column) -> Column:
    """The flags of a stream that are restored under a mask."""
    return normalize(normalize_mask(stream).bitwiseAND(mask))


def chosen(with_: int, without: int) -> int:
    """The flags of an archive to be made; `with_` 0 means the default."""
    return (with_ or DEFAULT) & ~without


def time_granularity(col: Column) -> Column:
    """Nanoseconds; null if no time is kept or a bit is unknown."""
    out = F.lit(None).cast("long")
    for name, ns in reversed(GRANULARITY):
        out = F.when(has(col, FEATURES[name]), F.lit(ns).cast("long")).otherwise(out)
    return F.when(known(col), out)


def format_features(col: Column) -> Column:
    """Names of the flags in order, parted by spaces; null if a bit is unknown."""
    names = [F.when(has(col, v), F.lit(n)) for n, v in FEATURES.items()]
    return F.when(known(col), F.concat_ws(" ", *names))


def parse_feature(name: str) -> int:
    """The bits of a flag or group."""
    if name not in FEATURES and name not in GROUPS:
        raise ValueError(f"unknown feature {name!r}")
    return bits(name)


def _mapped(col: Column, pairs: list[tuple[int, int]], kind: str) -> Column:
    zero, out = F.lit(0).cast(kind), F.lit(0).cast(kind)
    for a, b in pairs:
        out = out.bitwiseOR(F.when(col.bitwiseAND(F.lit(a)) != 0, F.lit(b).cast(kind)).otherwise(zero))
    return F.when(col.isNotNull(), out)


def from_chattr(col: Column) -> Column:
    return _mapped(col, [(v, FEATURES[n]) for n, v in CHATTR.items()], "long")


def to_chattr(col: Column) -> Column:
    return _mapped(col, [(FEATURES[n], v) for n, v in CHATTR.items()], "long")


def from_fat(col: Column) -> Column:
    return _mapped(col, [(v, FEATURES[n]) for n, v in FAT.items()], "long")


def to_fat(col: Column) -> Column:
    return _mapped(col, [(FEATURES[n], v) for n, v in FAT.items()], "long")


def floor_time(ns: Column, flags: Column) -> Column:
    """A time in the granularity of an archive; 0 if it keeps none."""
    unit = time_granularity(flags)
    return F.coalesce(ns - F.pmod(ns, unit), F.when(ns.isNotNull(), F.lit(0).cast("long")))


def stored_mode(mode: Column, flags: Column) -> Column:
    """Type and permission bits as archived: symbolic links 0777; all bits with
    permissions or ACL; else only whether the owner may write, if that is kept."""
    kind, folder, link = mode.bitwiseAND(F.lit(0o170000)), 0o040000, 0o120000
    writable = mode.bitwiseAND(F.lit(0o200)) != 0
    wide, narrow = F.when(kind == folder, 0o777).otherwise(0o666), F.when(kind == folder, 0o555).otherwise(0o444)
    low = F.when(has(flags, bits("permissions", "acl")), mode.bitwiseAND(F.lit(0o7777))).when(has(flags, bits("read-only")) & ~writable, narrow).otherwise(wide)
    return kind.bitwiseOR(F.when(kind == link, F.lit(0o777)).otherwise(low))


def shifted_uid(uid: Column, shift: int, range_: int = 0x10000) -> Column:
    """(uid - shift) % range; null for ids below the shift."""
    return F.when(uid >= shift, F.pmod(uid - F.lit(shift), F.lit(range_)))
