"""Texts of listings: modes, attributes, escaped paths, record and compression names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of listings and formats.
TYPES = {0o140000: "s", 0o040000: "d", 0o100000: "-", 0o060000: "b", 0o020000: "c", 0o120000: "l", 0o010000: "p"}
TYPE_NAMES = {0o140000: "socket", 0o040000: "dir", 0o100000: "file", 0o060000: "block", 0o020000: "char", 0o120000: "link", 0o010000: "fifo"}
CHATTR_LETTERS = [(0x8, "S"), (0x10000, "D"), (0x10, "i"), (0x20, "a"), (0x40, "d"), (0x80, "A"), (0x4, "c"), (0x400, "N"), (0x800000, "C"), (0x20000000, "P")]
FAT_LETTERS = [(0x2, "h"), (0x4, "s"), (0x20, "a")]
MAGICS = [("xz", "FD377A585A00"), ("gzip", "1F8B"), ("zstd", "28B52FFD")]
RECORDS = {
    "entry": 0x1396FABCEA5BBB51,
    "user": 0xF453131AAEEACCB3,
    "group": 0x25EB6AC969396A52,
    "xattr": 0xB8157091F80BC486,
    "acl-user": 0x297DC88B2EF12FAF,
    "acl-group": 0x36F2ACB56CB3DD0B,
    "acl-group-obj": 0x23047110441F38F3,
    "acl-default": 0xFE3EEDA6823C8CD0,
    "acl-default-user": 0xBDF03DF9BD010A91,
    "acl-default-group": 0xA0CB1168782D1F51,
    "fcaps": 0xF7267DB0AFED0629,
    "quota-projid": 0x161BAF2D8772A72B,
    "selinux": 0x46FAF0602FD26C59,
    "symlink": 0x664A6FB6830E0D6C,
    "device": 0xAC3DACE369DFE643,
    "payload": 0x8B9E1D93D6DCFFC9,
    "filename": 0x6DBB6EBCB3161F0B,
    "goodbye": 0xDFD35C5E8327C403,
    "index": 0x96824D9C7B129FF9,
    "table": 0xE75B9E112F17417D,
}


def _on(col: Column, bit: int) -> Column:
    return col.bitwiseAND(F.lit(bit)) != 0


def mode_string(mode: Column) -> Column:
    """`drwxr-xr-x`; null for an unknown type. The sticky bit shows on folders only."""
    kind = mode.bitwiseAND(F.lit(0o170000))
    first = F.lit(None).cast("string")
    for k, letter in TYPES.items():
        first = F.when(kind == k, letter).otherwise(first)
    parts = [first]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        runs, extra = _on(mode, 1 << shift), _on(mode, special)
        if special == 0o1000:
            extra = extra & (kind == 0o040000)
        parts += [F.when(_on(mode, 4 << shift), "r").otherwise("-"), F.when(_on(mode, 2 << shift), "w").otherwise("-")]
        parts.append(F.when(extra & runs, letter).when(extra, letter.upper()).when(runs, "x").otherwise("-"))
    return F.concat(*parts)


def type_name(mode: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, name in TYPE_NAMES.items():
        out = F.when(mode.bitwiseAND(F.lit(0o170000)) == k, name).otherwise(out)
    return out


def _letters(col: Column, table: list[tuple[int, str]]) -> Column:
    return F.when(col.isNotNull(), F.concat(*[F.when(_on(col, b), c).otherwise("-") for b, c in table]))


def chattr_string(col: Column) -> Column:
    return _letters(col, CHATTR_LETTERS)


def fat_string(col: Column) -> Column:
    return _letters(col, FAT_LETTERS)


def escaped(path: Column) -> Column:
    """A path (BINARY or text) with white space, control and non-ASCII bytes, `\\` and `#` as `\\ooo`."""
    raw = path.cast("binary")
    each = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substr(raw, i, F.lit(1))), 16, 10).cast("int"))
    octal = lambda b: F.concat(F.lit("\\"), F.lpad(F.conv(b.cast("string"), 10, 8), 3, "0"))
    text = F.array_join(F.transform(each, lambda b: F.when((b <= 32) | (b >= 127) | b.isin(92, 35), octal(b)).otherwise(F.char(b))), "")
    return F.when(F.length(raw) == 0, raw.cast("string")).when(path.cast("string").rlike(r"^[!\"$-\[\]-~]+\z"), path.cast("string")).otherwise(text)


def shown_path(path: Column) -> Column:
    """The path of a listing; the top is a dot."""
    return F.when(path == "", ".").otherwise(escaped(path))


def list_line(mode: Column, path: Column) -> Column:
    return F.concat(mode_string(mode), F.lit(" "), shown_path(path))


def compression_of(data: Column) -> Column:
    """xz, gzip or zstd by the first bytes; `again` if there are too few to tell, `unknown` otherwise."""
    head = F.hex(F.substring(data, 1, 6))
    out = F.when(F.length(data) < 6, "again").otherwise("unknown")
    for name, magic in reversed(MAGICS):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return F.when(data.isNotNull(), out)


def record_name(magic: Column) -> Column:
    """The name of a record type, by its number as signed BIGINT; null if unknown."""
    out = F.lit(None).cast("string")
    for name, v in RECORDS.items():
        out = F.when(magic == F.lit(v - (1 << 64) if v >> 63 else v), name).otherwise(out)
    return out


def mtree_line(path: Column, mode: Column, *, size: Column | None = None, link: Column | None = None, major: Column | None = None, minor: Column | None = None, uid: Column | None = None, gid: Column | None = None, user: Column | None = None, group: Column | None = None, flags: Column | None = None, mtime_ns: Column | None = None, digest: Column | None = None, algorithm: str = "sha512256") -> Column:
    """One line of a manifest; keywords whose value is null are left out, and size and digest are for files only."""
    is_file = mode.bitwiseAND(F.lit(0o170000)) == 0o100000

    def word(name: str, value: Column | None, when: Column | None = None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        text = F.concat(F.lit(f"{name}="), value.cast("string"))
        return text if when is None else F.when(when, text)

    low = F.lpad(F.conv(mode.bitwiseAND(F.lit(0o7777)).cast("string"), 10, 8), 4, "0")
    device = None if major is None else F.concat(F.lit("linux,"), major.cast("string"), F.lit(","), minor.cast("string"))
    time = None
    if mtime_ns is not None:
        rest = F.pmod(mtime_ns, F.lit(1_000_000_000))
        time = F.concat(((mtime_ns - rest) / 1_000_000_000).cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"))
    return F.concat_ws(
        " ", shown_path(path), word("type", type_name(mode)), word("mode", low), word("size", size, is_file), word("link", None if link is None else escaped(link)), word("device", device),
        word("uid", uid), word("gid", gid), word("uname", None if user is None else escaped(user)), word("gname", None if group is None else escaped(group)), word("flags", flags), word("time", time), word(f"{algorithm}digest", digest, is_file),
    )
