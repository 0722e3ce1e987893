"""Archives of trees: encoding and decoding of their records, as source and sink."""

from __future__ import annotations

import fcntl
import grp
import itertools
import os
import pwd
import stat
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions import features as ff
from ..functions.digests import siphash24
from ..functions.listing import RECORDS
from ..session import written

# Fixed values of the archive format.
TAIL_MARKER = 0x57446FA533702943
KIND_MODES = {"dir": 0o040000, "file": 0o100000, "link": 0o120000, "block": 0o060000, "char": 0o020000, "fifo": 0o010000, "socket": 0o140000}
ACL_TAGS = {"user": "acl-user", "group": "acl-group", "default-user": "acl-default-user", "default-group": "acl-default-group"}
MAX_MAJOR, MAX_MINOR = 1 << 12, 1 << 20
KEPT_FLAGS = sum(ff.CHATTR.values())

ENTRIES = (
    "path string, kind string, mode int, flags long, uid long, gid long, user string, `group` string, mtime_ns long, size long, target string, major long, minor long, xattrs map<string,binary>, "
    "acl array<struct<tag:string,id:long,name:string,perm:int>>, selinux string, fcaps binary, quota_projid int, content binary, start long"
)
FIELDS = ["path", "kind", "mode", "flags", "uid", "gid", "user", "group", "mtime_ns", "size", "target", "major", "minor", "xattrs", "acl", "selinux", "fcaps", "quota_projid", "content", "start"]
_NAMES = {v: k for k, v in RECORDS.items()}


def _record(kind: str, body: bytes = b"") -> bytes:
    return struct.pack("<2Q", 16 + len(body), RECORDS[kind]) + body


def _name(path: str) -> bytes:
    """Names are bytes; those that aren't UTF-8 are carried as escapes of single bytes."""
    return path.encode("utf-8", "surrogateescape")


def entry_records(e: dict, features: int) -> bytes:
    """The records of one node: its entry, owners, attributes, lists, labels and what its kind needs."""
    head = struct.pack("<6Q", features & (1 << 64) - 1, KIND_MODES[e["kind"]] | ((e.get("mode") or 0) & 0o7777), e.get("flags") or 0, e.get("uid") or 0, e.get("gid") or 0, e.get("mtime_ns") or 0)
    out = [_record("entry", head)]
    for key, kind in (("user", "user"), ("group", "group")):
        if e.get(key):
            out.append(_record(kind, _name(e[key]) + b"\0"))
    for name, value in sorted(dict(e.get("xattrs") or {}).items()):
        out.append(_record("xattr", _name(name) + b"\0" + bytes(value)))
    acl = [a if isinstance(a, dict) else dict(zip(("tag", "id", "name", "perm"), a)) for a in (e.get("acl") if e.get("acl") is not None else [])]

    def listed(tag: str) -> list[bytes]:
        own = sorted((a for a in acl if a["tag"] == tag), key=lambda a: (a["id"] or 0, a["name"] or "", a["perm"]))
        return [_record(ACL_TAGS[tag], struct.pack("<2Q", a["id"] or 0, a["perm"]) + _name(a["name"] or "") + b"\0") for a in own]

    one = {a["tag"]: a["perm"] for a in acl}
    out += listed("user") + listed("group")
    if "group-obj" in one:
        out.append(_record("acl-group-obj", struct.pack("<Q", one["group-obj"])))
    defaults = ["default-user-obj", "default-group-obj", "default-other", "default-mask"]
    if any(d in one for d in defaults):
        out.append(_record("acl-default", struct.pack("<4Q", *[one.get(d, (1 << 64) - 1) for d in defaults])))
    out += listed("default-user") + listed("default-group")
    if e.get("selinux"):
        out.append(_record("selinux", _name(e["selinux"]) + b"\0"))
    if e.get("fcaps"):
        out.append(_record("fcaps", bytes(e["fcaps"])))
    if e.get("quota_projid"):
        out.append(_record("quota-projid", struct.pack("<Q", e["quota_projid"])))
    if e["kind"] == "file":
        out.append(_record("payload", bytes(e.get("content") or b"")))
    elif e["kind"] == "link":
        out.append(_record("symlink", _name(e["target"]) + b"\0"))
    elif e["kind"] in ("block", "char"):
        out.append(_record("device", struct.pack("<2Q", e["major"], e["minor"])))
    return b"".join(out)


def search_tree_places(n: int) -> list[int]:
    """For each place of a search tree of n items the rank of the item there."""
    out, stack, at, rank = [0] * n, [], 0, 0
    while stack or at < n:
        while at < n:
            stack.append(at)
            at = 2 * at + 1
        at = stack.pop()
        out[at], rank, at = rank, rank + 1, 2 * at + 2
    return out


def _goodbye(names: list[tuple[bytes, int, int]], entry_start: int, here: int) -> bytes:
    hashes = siphash24([n for n, _, _ in names])
    ordered = sorted(zip((int(h) for h in hashes), ((s, e) for _, s, e in names)))
    items = b"".join(struct.pack("<3Q", here - ordered[k][1][0], ordered[k][1][1] - ordered[k][1][0], ordered[k][0]) for k in search_tree_places(len(ordered)))
    size = 16 + len(items) + 24
    return struct.pack("<2Q", size, RECORDS["goodbye"]) + items + struct.pack("<3Q", here - entry_start, size, TAIL_MARKER)


def encode_tree(entries: Iterable[dict], features: int = ff.DEFAULT) -> Iterator[bytes]:
    """The archive of entries that come in the order of the walk, the top first, piece by piece."""
    open_: list[tuple[str, int, list[tuple[bytes, int, int]], int]] = []  # path, start of entry, names, start of its own name
    at = 0

    def close() -> bytes:
        nonlocal at
        path, start, names, own = open_.pop()
        end = _goodbye(names, start, at)
        at += len(end)
        if open_:
            open_[-1][2].append((_name(path.rpartition("/")[2]), own, at))
        return end

    for e in entries:
        path = e["path"]
        while open_ and open_[-1][0] and not path.startswith(open_[-1][0] + "/"):
            yield close()
        begun, name = at, _name(path.rpartition("/")[2])
        if path:
            if not open_ or path.rpartition("/")[0] != open_[-1][0]:
                raise ValueError(f"{path!r} comes without its folder")
            piece = _record("filename", name + b"\0")
            at += len(piece)
            yield piece
        start, piece = at, entry_records(e, features)
        at += len(piece)
        yield piece
        if e["kind"] == "dir":
            open_.append((path, start, [], begun))
        elif open_:
            open_[-1][2].append((name, begun, at))
    while open_:
        yield close()


class _Whole:
    """Bytes that are there as one value."""

    def __init__(self, data):
        self.view, self.at = memoryview(data), 0

    def ended(self) -> bool:
        return self.at >= len(self.view)

    def read(self, n: int) -> bytes:
        if n > len(self.view) - self.at:
            raise ValueError("the archive is cut off")
        self.at += n
        return bytes(self.view[self.at - n : self.at])

    def skip(self, n: int) -> None:
        if n > len(self.view) - self.at:
            raise ValueError("the archive is cut off")
        self.at += n


class _Parts:
    """Bytes that come in parts, of which only what a record needs is held."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.held, self.off, self.at = iter(parts), b"", 0, 0

    def _more(self) -> bool:
        for part in self.parts:
            if part:
                self.held, self.off = bytes(part), 0
                return True
        return False

    def ended(self) -> bool:
        return self.off >= len(self.held) and not self._more()

    def _take(self, n: int) -> Iterator[memoryview]:
        self.at += n
        while n:
            if self.ended():
                raise ValueError("the archive is cut off")
            piece = memoryview(self.held)[self.off : self.off + n]
            self.off += len(piece)
            n -= len(piece)
            yield piece

    def read(self, n: int) -> bytes:
        return b"".join(self._take(n))

    def skip(self, n: int) -> None:
        for _ in self._take(n):
            pass


def decode_archive(data, with_content: bool = True) -> Iterator[dict]:
    """The entries of an archive, folders before what is in them; a ValueError for what the format doesn't allow.
    `data` is the archive, or an iterable of its parts in order."""
    source = _Whole(data) if isinstance(data, (bytes, bytearray, memoryview)) else _Parts(data)
    try:
        yield from _decoded(source, with_content)
    except (struct.error, IndexError) as e:
        raise ValueError("a record is too short") from e


def node_range(data: bytes, path: str) -> tuple[int, int] | None:
    """Where in an archive a folder's records lie, from its entry to the end of its table; null if there is no such folder."""
    ends: dict[str, int] = {}
    starts = {e["path"]: e["start"] for e in _decoded(_Whole(data), False, ends)}
    return (starts[path], ends[path]) if path in ends else None


def _decoded(source, with_content: bool, ends: dict[str, int] | None = None) -> Iterator[dict]:
    stack, name, features = [], None, None
    e: dict | None = None

    def text(b: bytes) -> str:
        if not b.endswith(b"\0") or b.count(b"\0") != 1 or len(b) < 2:
            raise ValueError("a text isn't ended, or empty")
        return b[:-1].decode("utf-8", "surrogateescape")

    def finish(e: dict) -> dict:
        if e["kind"] == "link" and e["target"] is None or e["kind"] in ("block", "char") and e["major"] is None or e["kind"] == "file" and e["size"] is None:
            raise ValueError(f"{e['path']!r} lacks what a {e['kind']} needs")
        return e

    while not source.ended():
        at = source.at
        size, kind = struct.unpack("<2Q", source.read(16))
        what = _NAMES.get(kind)
        if what is None or size < 16:
            raise ValueError(f"no record at {at}")
        body = b""
        if what != "payload" or with_content:
            body = source.read(size - 16)
        else:
            source.skip(size - 16)
        if what in ("filename", "goodbye") and e is not None:
            yield finish(e)
            e = None
        if what == "filename":
            if not stack:
                raise ValueError("a name outside of any folder")
            name = text(body)
            if name in (".", "..") or "/" in name:
                raise ValueError(f"{name!r} is no name")
        elif what == "goodbye":
            folder, start = stack.pop()
            back, again, marker = struct.unpack("<3Q", body[-24:])
            if (back, again, marker) != (at - start, size, TAIL_MARKER) or (len(body) - 24) % 24:
                raise ValueError(f"the table of {folder!r} is wrong")
            name = None
            if ends is not None:
                ends[folder] = at + size
        elif what == "entry":
            flags, mode, attrs, uid, gid, mtime = struct.unpack("<6Q", body)
            if features not in (None, flags):
                raise ValueError("entries differ in their features")
            features = flags
            kinds = [k for k, v in KIND_MODES.items() if v == mode & 0o170000]
            if not kinds or mode & ~0o177777:
                raise ValueError(f"bad mode {mode:o}")
            if not stack and (at or kinds[0] != "dir"):
                raise ValueError("the top isn't a folder")
            folder = stack[-1][0] if stack else None
            path = "" if folder is None else f"{folder}/{name}" if folder else name
            e = dict.fromkeys(FIELDS) | {"path": path, "kind": kinds[0], "mode": mode, "flags": attrs, "uid": uid, "gid": gid, "mtime_ns": mtime, "xattrs": {}, "acl": [], "start": at}
            if kinds[0] == "dir":
                stack.append((path, at))
        elif e is None:
            raise ValueError(f"a {what} record without entry")
        elif what in ("user", "group", "selinux"):
            e[what] = text(body)
        elif what == "xattr":
            key, _, value = body.partition(b"\0")
            if e["xattrs"] and key.decode() <= max(e["xattrs"]):
                raise ValueError("attributes aren't in order")
            e["xattrs"][key.decode("utf-8", "surrogateescape")] = value
        elif what == "fcaps":
            e["fcaps"] = body
        elif what == "quota-projid":
            e["quota_projid"] = struct.unpack("<Q", body)[0]
        elif what == "acl-group-obj":
            e["acl"].append(("group-obj", None, None, struct.unpack("<Q", body)[0]))
        elif what == "acl-default":
            for tag, perm in zip(("default-user-obj", "default-group-obj", "default-other", "default-mask"), struct.unpack("<4Q", body)):
                if perm != (1 << 64) - 1:
                    e["acl"].append((tag, None, None, perm))
        elif what.startswith("acl"):
            owner, perm = struct.unpack("<2Q", body[:16])
            e["acl"].append(({v: k for k, v in ACL_TAGS.items()}[what], owner, body[16:-1].decode() or None, perm))
        elif what == "symlink":
            e["target"] = text(body)
        elif what == "device":
            e["major"], e["minor"] = struct.unpack("<2Q", body)
            if e["major"] >= MAX_MAJOR or e["minor"] >= MAX_MINOR:
                raise ValueError("a device number is out of range")
        elif what == "payload":
            e["size"], e["content"] = size - 16, body if with_content else None
    if stack or e is not None:
        raise ValueError("the archive is cut off")


def archive_parts(entries: DataFrame, features: int = ff.DEFAULT) -> DataFrame:
    """tree_id, start, data: the archive of each tree in parts that follow one another by `start`.

    The same bytes as `archives`, but no task holds more than a node's records or the
    table of one folder. The size of every part is known before its bytes: a table's from the
    number of names. So the starts are running totals in the order of the walk, in which a
    folder's table comes behind all that is below it, and the tables are made of the starts."""
    from ..operators.order import running_total
    from ..operators.tree import base_name, parent_path

    have = [c for c in FIELDS if c in entries.columns]
    kind = entries.schema["tree_id"].dataType.simpleString()

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for e in _plain_rows(b):
                name = _name(e["path"].rpartition("/")[2])
                first = _record("filename", name + b"\0") if e["path"] else b""
                rows.append((e["tree_id"], e["path"], e["kind"], len(first), first + entry_records(e, features)))
            yield pd.DataFrame(rows, columns=["tree_id", "path", "kind", "entry_at", "data"])

    nodes = written(_whole_numbers(entries.select("tree_id", *have)).mapInPandas(records, f"tree_id {kind}, path string, kind string, entry_at long, data binary"), "records")
    step = F.transform(F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")), lambda x: F.struct(F.lit(0).alias("last"), x.cast("binary").alias("name")))
    names = nodes.filter(F.col("path") != "").groupBy("tree_id", parent_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("names"))
    tables = nodes.filter(F.col("kind") == "dir").join(names, ["tree_id", "path"], "left").select("tree_id", "path", "kind", F.lit(True).alias("table"), (F.coalesce("names", F.lit(0)) * 24 + 40).alias("size"), F.lit(0).cast("long").alias("entry_at"), F.concat(step, F.array(F.struct(F.lit(1).alias("last"), F.lit(b"").alias("name")))).alias("key"))
    own = nodes.select("tree_id", "path", "kind", F.lit(False).alias("table"), F.length("data").cast("long").alias("size"), "entry_at", step.alias("key"))
    placed = written(running_total(own.unionByName(tables), ["tree_id"], ["key"], F.col("size"), "start").drop("key"), "placed")

    at = placed.filter(~F.col("table"))
    end = placed.filter(F.col("table")).select("tree_id", "path", (F.col("start") + F.col("size")).alias("end"))
    child = at.filter(F.col("path") != "").join(end, ["tree_id", "path"], "left")
    items = child.groupBy("tree_id", parent_path(F.col("path")).alias("path")).agg(F.collect_list(F.struct(base_name(F.col("path")).alias("name"), "start", F.coalesce("end", F.col("start") + F.col("size")).alias("end"))).alias("items"))
    folders = placed.filter(F.col("table")).select("tree_id", "path", "start").join(at.select("tree_id", "path", (F.col("start") + F.col("entry_at")).alias("entry_start")), ["tree_id", "path"]).join(items, ["tree_id", "path"], "left")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = []
            for start, entry, found in zip(b["start"], b["entry_start"], b["items"]):
                data.append(_goodbye([(_name(x["name"]), x["start"], x["end"]) for x in (found if found is not None else [])], int(entry), int(start)))
            yield pd.DataFrame({"tree_id": b["tree_id"], "start": b["start"], "data": data})

    ends = folders.select("tree_id", "start", "entry_start", "items").mapInPandas(made, f"tree_id {kind}, start long, data binary")
    return at.select("tree_id", "path", "start").join(nodes.select("tree_id", "path", "data"), ["tree_id", "path"]).select("tree_id", "start", "data").unionByName(ends)


def _whole_numbers(entries: DataFrame) -> DataFrame:
    """Nulls as the 0 that they are stored as: beside nulls pandas takes numbers as floats, which lose the last digits of times."""
    return entries.withColumns({c: F.coalesce(c, F.lit(0).cast(entries.schema[c].dataType)) for c in ("mode", "flags", "uid", "gid", "mtime_ns") if c in entries.columns})


def _plain_rows(b: pd.DataFrame) -> list[dict]:
    rows = b.astype(object).where(b.notna(), None).to_dict("records")
    for r in rows:
        for c in ("mode", "flags", "uid", "gid", "mtime_ns", "major", "minor", "quota_projid"):
            if r.get(c) is not None:
                r[c] = int(r[c])
    return rows


def write_archives(parts: DataFrame, folder: str) -> DataFrame:
    """Writes `archive_parts` into one file for each tree and returns tree_id, path, bytes. The
    parts of a tree pass through one task, in order, and aren't held; a file appears under
    its name when it is whole."""
    kind = parts.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        os.makedirs(folder, exist_ok=True)
        now, f, temp, done = None, None, "", []

        def close() -> None:
            n = f.tell()
            f.close()
            path = os.path.join(folder, f"{now}.catar")
            os.replace(temp, path)
            done.append((now, path, n))

        for b in batches:
            for tree, data in zip(b["tree_id"], b["data"]):
                if tree != now:
                    if now is not None:
                        close()
                    now, temp = tree, os.path.join(folder, f"{tree}.{uuid.uuid4().hex}.tmp")
                    f = open(temp, "wb")
                f.write(data)
        if now is not None:
            close()
        yield pd.DataFrame(done, columns=["tree_id", "path", "bytes"])

    return parts.select("tree_id", "start", "data").repartition("tree_id").sortWithinPartitions("tree_id", "start").mapInPandas(run, f"tree_id {kind}, path string, bytes long")


def archives(entries: DataFrame, features: int = ff.DEFAULT) -> DataFrame:
    """tree_id, archive: the archive of each tree as one value. `entries` has tree_id and the
    columns of ENTRIES. For trees that fit into a value; for others see `archive_parts`."""
    kind = entries.schema["tree_id"].dataType.simpleString()
    have = [c for c in FIELDS if c in entries.columns]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = _plain_rows(part[have])
        rows.sort(key=lambda r: [_name(x) for x in r["path"].split("/")] if r["path"] else [])
        return pd.DataFrame({"tree_id": [part["tree_id"].iloc[0]], "archive": [b"".join(encode_tree(rows, features))]})

    return _whole_numbers(entries.select("tree_id", *have)).groupBy("tree_id").applyInPandas(run, f"tree_id {kind}, archive binary")


def unpacked(archives: DataFrame, with_content: bool = True) -> DataFrame:
    """tree_id and the columns of ENTRIES of archives (tree_id, archive)."""
    kind = archives.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tree, data in zip(b["tree_id"], b["archive"]):
                yield _entries_frame(tree, list(decode_archive(data, with_content)))

    return archives.select("tree_id", "archive").mapInPandas(run, f"tree_id {kind}, {ENTRIES}")


def unpacked_parts(parts: DataFrame, with_content: bool = True) -> DataFrame:
    """The same of archives that come in parts (tree_id, start, data). An archive can only be read from its
    beginning, so its parts pass through one task in order; what is held is one record at a time."""
    kind = parts.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for b in batches for x in zip(b["tree_id"], b["data"]))
        for tree, own in itertools.groupby(rows, lambda x: x[0]):
            entries = decode_archive((bytes(d) for _, d in own if d is not None), with_content)
            while some := list(itertools.islice(entries, 256)):
                yield _entries_frame(tree, some)

    placed = parts.select("tree_id", "start", "data").repartition("tree_id").sortWithinPartitions("tree_id", "start")
    return placed.mapInPandas(run, f"tree_id {kind}, {ENTRIES}")


def _entries_frame(tree, rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FIELDS)
    out.insert(0, "tree_id", tree)
    return out.astype({c: "Int64" for c in ("flags", "uid", "gid", "mtime_ns", "size", "major", "minor", "start")} | {"quota_projid": "Int32"})


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArchiveSource(DataSource):
    """`spark.read.format("tree-archive").load(folder or file)`: tree_id (file name without
    suffix) and the columns of ENTRIES, one task for each archive. Option content=false leaves payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "tree-archive"

    def schema(self) -> str:
        return f"tree_id string, {ENTRIES}"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.content = options["path"].removeprefix("file://"), str(options.get("content", "true")).lower() != "false"

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, f)) for d, _, fs in sorted(os.walk(self.path)) for f in sorted(fs) if f.endswith(".catar")]

    def read(self, part: _File) -> Iterator[tuple]:
        import mmap

        with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data, memoryview(data) as view:
            tree = os.path.basename(part.path).rsplit(".", 1)[0]
            for e in decode_archive(view, self.content):
                yield (tree, *[e[c] for c in FIELDS])


# Fixed values of the kernel's interfaces: requests for attributes and projects, and tags of access lists.
GETFLAGS, SETFLAGS, GETXATTR = 0x80086601, 0x40086602, 0x801C581F
LIST_TAGS = {0x02: "user", 0x04: "group-obj", 0x08: "group"}
DEFAULT_TAGS = {0x01: "default-user-obj", 0x02: "default-user", 0x04: "default-group-obj", 0x08: "default-group", 0x10: "default-mask", 0x20: "default-other"}
NO_ID = 0xFFFFFFFF


def read_acl(data: bytes, tags: dict[int, str]) -> list[tuple]:
    """(tag, id, name, perm) of the entries of an access list as the kernel has it, those that an archive keeps."""
    if len(data) < 4 or (len(data) - 4) % 8 or struct.unpack("<I", data[:4])[0] != 2:
        return []
    out = []
    for tag, perm, owner in struct.iter_unpack("<HHI", data[4:]):
        if tag in tags:
            out.append((tags[tag], None if owner == NO_ID else owner, None, perm))
    return out


def write_acl(acl: list, tags: dict[int, str], mode: int) -> bytes | None:
    """The same the other way; of an access list the owner's, the others' and the mask's permissions come from the mode."""
    back = {v: k for k, v in tags.items()}
    rows = [(back[a["tag"]], a["perm"], NO_ID if a["id"] is None or a["tag"] in ("group-obj",) or a["tag"].endswith(("-obj", "-mask", "-other")) else a["id"]) for a in acl if a["tag"] in back]
    if not rows:
        return None
    if tags is LIST_TAGS:
        if 0x04 not in [t for t, _, _ in rows]:
            rows.append((0x04, mode >> 3 & 7, NO_ID))
        rows += [(0x01, mode >> 6 & 7, NO_ID), (0x10, mode >> 3 & 7, NO_ID), (0x20, mode & 7, NO_ID)]
    return struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *r) for r in sorted(rows, key=lambda r: (r[0], r[2])))


def _attributes(full: str, kind: str) -> tuple[int, int | None]:
    """Attributes and project of a file or folder; 0 and null where the file system has none."""
    if kind not in ("file", "dir"):
        return 0, None
    try:
        fd = os.open(full, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError:
        return 0, None
    try:
        flags, project = 0, None
        try:
            flags = struct.unpack("<I", fcntl.ioctl(fd, GETFLAGS, bytes(8))[:4])[0] & KEPT_FLAGS
        except OSError:
            pass
        try:
            project = struct.unpack("<5I8x", fcntl.ioctl(fd, GETXATTR, bytes(28)))[3] or None
        except OSError:
            pass
        return flags, project
    finally:
        os.close(fd)


def _owner(find, number: int) -> str | None:
    """The name of an owner; root's is never kept, an unknown one has none."""
    if number == 0:
        return None
    try:
        return find(number)[0]
    except KeyError:
        return None


class _Folder(InputPartition):
    def __init__(self, root: str, below: str, deep: bool):
        self.root, self.below, self.deep = root, below, deep


class TreeSource(DataSource):
    """`spark.read.format("tree-walk").load(folder)`: the columns of ENTRIES of a folder on a
    file system that all executors see. One task for each folder at the level `depth` (1) below the top, and
    one for each folder above; option content=false leaves files unread, and then only their metadata is
    touched. Names, attributes, labels, capabilities, access lists and projects are null where the file system has none.
    With the option prune=true, for sessions with spark.sql.python.filterPushdown.enabled, a filter on `path` keeps folders
    that can't hold it from being listed."""

    @classmethod
    def name(cls) -> str:
        return "tree-walk"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return (_PruningTreeReader if str(self.options.get("prune", "false")).lower() == "true" else _TreeReader)(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.content = options["path"].removeprefix("file://"), str(options.get("content", "true")).lower() != "false"
        self.depth = int(options.get("depth", 1))
        self.path, self.start = None, ""

    def _wanted(self, path: str) -> bool:
        return path.startswith(self.start) and self.path in (None, path)

    def _met(self, path: str) -> bool:
        """Whether something wanted may be at or below a path."""
        folder = f"{path}/" if path else ""
        return all(x.startswith(folder) or x == path for x in ([self.path] if self.path is not None else [])) and (self.start.startswith(folder) or path.startswith(self.start))

    def partitions(self) -> list[InputPartition]:
        parts, level = [], [""]
        for k in range(self.depth + 1):
            level = [f for f in level if self._met(f)]
            parts += [_Folder(self.root, f, k == self.depth) for f in level]
            level = [f"{f}/{e.name}" if f else e.name for f in level for e in sorted(os.scandir(os.path.join(self.root, f)), key=lambda e: os.fsencode(e.name)) if e.is_dir(follow_symlinks=False)] if k < self.depth else []
        return parts

    def read(self, part: _Folder) -> Iterator[tuple]:
        def node(path: str) -> tuple:
            full = os.path.join(part.root, path) if path else part.root
            st = os.lstat(full)
            kind = next(k for k, v in KIND_MODES.items() if v == stat.S_IFMT(st.st_mode))
            held = {}
            if kind != "link":
                try:
                    held = {x: os.getxattr(full, x) for x in sorted(os.listxattr(full))}
                except OSError:
                    pass
            xattrs = {x: v for x, v in held.items() if x.startswith(("user.", "trusted."))}
            acl = read_acl(held.get("system.posix_acl_access", b""), LIST_TAGS)
            acl = (acl if any(a[0] != "group-obj" for a in acl) else []) + read_acl(held.get("system.posix_acl_default", b""), DEFAULT_TAGS)
            label = held.get("security.selinux", b"").rstrip(b"\0").decode("utf-8", "replace") or None
            flags, project = _attributes(full, kind)
            content = None
            if kind == "file" and self.content:
                with open(full, "rb") as f:
                    content = f.read()
            device = (os.major(st.st_rdev), os.minor(st.st_rdev)) if kind in ("block", "char") else (None, None)
            return (path, kind, st.st_mode, flags, st.st_uid, st.st_gid, _owner(pwd.getpwuid, st.st_uid), _owner(grp.getgrgid, st.st_gid), st.st_mtime_ns, st.st_size if kind == "file" else None, os.readlink(full) if kind == "link" else None, *device, xattrs, acl, label, held.get("security.capability"), project, content, None)

        todo = [part.below]
        while todo:
            path = todo.pop()
            full = os.path.join(part.root, path) if path else part.root
            if self._wanted(path):
                yield node(path)
            if (path == part.below or part.deep) and os.path.isdir(full) and not os.path.islink(full):
                names = sorted(os.listdir(full), key=os.fsencode, reverse=True)
                below = [f"{path}/{n}" if path else n for n in names]
                if not part.deep:
                    below = [x for x in below if os.path.islink(os.path.join(part.root, x)) or not os.path.isdir(os.path.join(part.root, x))]
                todo += [x for x in below if self._met(x)]


class _PruningTreeReader(_TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A path, or the beginning of one, keeps all folders out that can't hold it; Spark still tests each row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, EqualTo):
                    self.path = f.value
                elif isinstance(f, StringStartsWith) and len(f.value) > len(self.start):
                    self.start = f.value
            yield f


def scan_tree(spark: SparkSession, path: str, content: bool = True, depth: int = 1) -> DataFrame:
    """The entries of a folder; filters on `path` prune the walk if spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(TreeSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("tree-walk").option("content", str(content).lower()).option("depth", str(depth)).option("prune", prune).load(path)


def read_archives(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tree-archive").option("content", str(content).lower()).load(path)


def extract(entries: DataFrame, target: str, flags: int = ff.DEFAULT) -> DataFrame:
    """Creates entries below `target`, a folder that all executors see, and returns path, state
    (made, skipped). Folders first, level by level, then all else in parallel; a file appears
    under its name when it is whole. Owners, modes, access lists, labels, capabilities, attributes and times are restored as far as
    `flags` say and the file system and the rights of the process allow; sockets, and devices where they may not be made, are skipped."""
    have = [c for c in FIELDS if c in entries.columns]
    restored = sum(v for n, v in ff.CHATTR.items() if flags & ff.FEATURES[n])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for b in batches:
            done = []
            for e in b.to_dict("records"):
                full, kind = os.path.join(target, e["path"]) if e["path"] else target, e["kind"]
                ok = True
                if kind == "dir":
                    os.makedirs(full, exist_ok=True)
                elif kind == "file":
                    temp = f"{full}.{uuid.uuid4().hex}.tmp"
                    with open(temp, "wb") as f:
                        f.write(e["content"] or b"")
                    os.replace(temp, full)
                elif kind == "link":
                    if os.path.lexists(full):
                        os.unlink(full)
                    os.symlink(e["target"], full)
                elif kind == "fifo":
                    if not os.path.lexists(full):
                        os.mkfifo(full)
                elif kind in ("block", "char"):
                    ok = os.path.lexists(full) or device(full, kind, e)
                else:
                    ok = False
                if ok and kind == "link":
                    owners(full, e)
                if ok and kind not in ("link", "dir"):
                    restore(full, e)
                done.append((e["path"], "made" if ok else "skipped"))
            yield pd.DataFrame(done, columns=["path", "state"])

    def device(full: str, kind: str, e: dict) -> bool:
        try:
            os.mknod(full, 0o600 | (stat.S_IFBLK if kind == "block" else stat.S_IFCHR), os.makedev(int(e["major"]), int(e["minor"])))
            return True
        except OSError:
            return False

    def owners(full: str, e: dict) -> None:
        if flags & ff.bits("16bit-uids", "32bit-uids", "user-names") and os.geteuid() == 0 and not pd.isna(e.get("uid")) and not pd.isna(e.get("gid")):
            os.chown(full, int(e["uid"]), int(e["gid"]), follow_symlinks=False)

    def restore(full: str, e: dict) -> None:
        owners(full, e)
        mode = None if pd.isna(e.get("mode")) else int(e["mode"]) & 0o7777
        if flags & ff.bits("permissions", "acl", "read-only") and mode is not None:
            os.chmod(full, mode)
        extra = {}
        if flags & ff.bits("acl"):
            acl = [a.asDict() if hasattr(a, "asDict") else dict(a) for a in (e.get("acl") if e.get("acl") is not None else [])]
            extra |= {"system.posix_acl_access": write_acl(acl, LIST_TAGS, mode or 0), "system.posix_acl_default": write_acl(acl, DEFAULT_TAGS, 0)}
        if flags & ff.bits("selinux") and e.get("selinux"):
            extra["security.selinux"] = e["selinux"].encode() + b"\0"
        if flags & ff.bits("fcaps") and e.get("fcaps"):
            extra["security.capability"] = bytes(e["fcaps"])
        for name, value in extra.items():
            try:
                if value:
                    os.setxattr(full, name, value)
            except OSError:
                pass
        if flags & ff.bits("xattrs"):
            for name, value in dict(e.get("xattrs") or {}).items():
                try:
                    os.setxattr(full, name, bytes(value))
                except OSError:
                    pass
        if flags & ff.bits(*ff._TIMES) and not pd.isna(e.get("mtime_ns")):
            os.utime(full, ns=(int(e["mtime_ns"]), int(e["mtime_ns"])))
        kept = 0 if pd.isna(e.get("flags")) else int(e["flags"]) & restored
        if kept and stat.S_IFMT(os.lstat(full).st_mode) in (stat.S_IFREG, stat.S_IFDIR):
            try:
                fd = os.open(full, os.O_RDONLY | os.O_NOFOLLOW)
                try:
                    fcntl.ioctl(fd, SETFLAGS, struct.pack("<Q", struct.unpack("<I", fcntl.ioctl(fd, GETFLAGS, bytes(8))[:4])[0] | kept))
                finally:
                    os.close(fd)
            except OSError:
                pass

    light = entries.select(*[c for c in have if c != "content"]).filter(F.col("kind") == "dir")
    folders = written(light.withColumn("content", F.lit(None).cast("binary")).mapInPandas(make, "path string, state string"), "folders")
    files = written(entries.select(*have).filter(F.col("kind") != "dir").mapInPandas(make, "path string, state string"), "files")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for e in b.to_dict("records"):
                restore(os.path.join(target, e["path"]) if e["path"] else target, e)
            yield b[["path"]]

    written(light.mapInPandas(finish, "path string"), "folder-times")
    return folders.unionByName(files)
