"""Trees: entries, order, filters, exclude patterns and checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as ff
from .lookup import attach
from .order import running_total

# Fixed values of the archive format.
EXCLUDE_NAME = ".caexclude"
MAX_MAJOR, MAX_MINOR = 1 << 12, 1 << 20
MAX_NAME, MAX_TARGET, MAX_USER, MAX_LABEL = 255, 4095, 255, 4095
VIRTUAL = ["proc", "sysfs", "cgroup", "cgroup2", "tmpfs-dev", "devpts", "securityfs", "selinuxfs", "debugfs", "tracefs", "bpf", "efivarfs", "pstore", "configfs", "fusectl", "mqueue", "hugetlbfs", "binfmt_misc"]
KINDS = {"link": "symlinks", "block": "device-nodes", "char": "device-nodes", "fifo": "fifos", "socket": "sockets"}


def tree_order(path: Column) -> Column:
    """A key under which paths sort as a tree is walked: by components, each by its
    bytes, a folder before what is in it. As a string `a-b` would come before `a/b`."""
    return F.transform(F.split(path, "/"), lambda x: x.cast("binary"))


def parent_path(path: Column) -> Column:
    """The path of the folder; of a name at the top the empty string."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def at_path(entries: DataFrame, path: str, recursive: bool = True) -> DataFrame:
    """The entry at a path and what is below it; without `recursive` only one level of that."""
    col = F.col("path")
    below = col.startswith(path + "/") if path else F.lit(True)
    hit = entries.filter((col == path) | below)
    return hit if recursive else hit.filter(depth(col) <= (path.count("/") + 2 if path else 1))


def out_of_order(entries: DataFrame, by: str = "tree_id") -> DataFrame:
    """by, parent, name of names that don't come strictly after the one before them in
    `seq`, the order in which their folder lists them."""
    from pyspark.sql import Window

    w = Window.partitionBy(by, "parent").orderBy("seq")
    raw = F.col("name").cast("binary")
    return entries.withColumn("__before", F.lag(raw).over(w)).filter(F.col("__before") >= raw).select(by, "parent", "name")


def walk_events(entries: DataFrame) -> DataFrame:
    """tree_id, place, event, path, bytes: what a job reports that walks trees, in the order of the walk: next-file as an entry is
    reached, payload with the bytes of a file of known size, done-file when all below an entry is done."""
    step = F.transform(F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")), lambda x: F.struct(F.lit(0).alias("rank"), x.cast("binary").alias("name")))
    mark = lambda rank: F.array(F.struct(F.lit(rank).alias("rank"), F.lit(b"").alias("name")))
    size = F.when(F.col("kind") == "file", F.col("size"))
    each = F.array(
        F.struct(F.lit("next-file").alias("event"), F.lit(None).cast("long").alias("bytes"), step.alias("key")),
        F.struct(F.when(size.isNotNull(), "payload").alias("event"), size.alias("bytes"), F.concat(step, mark(1)).alias("key")),
        F.struct(F.lit("done-file").alias("event"), F.lit(None).cast("long").alias("bytes"), F.concat(step, mark(2)).alias("key")),
    )
    events = entries.select("tree_id", "path", F.inline(each)).filter(F.col("event").isNotNull())
    return running_total(events, ["tree_id"], ["key"], name="place").select("tree_id", "place", "event", "path", "bytes")


def kept_kinds(entries: DataFrame, flags: int) -> DataFrame:
    """Entries whose kind the flags keep; files and folders always are."""
    gone = [k for k, f in KINDS.items() if not flags & ff.FEATURES[f]]
    return entries.filter(~F.col("kind").isin(gone)) if gone else entries


def without_nodump(entries: DataFrame, flags: int) -> DataFrame:
    """Drops entries with the no-dump attribute if the flags say so."""
    return entries.filter(F.coalesce(F.col("flags").bitwiseAND(F.lit(ff.CHATTR["flag-nodump"])), F.lit(0)) == 0) if flags & ff.EXCLUDE_NODUMP else entries


def without_submounts(entries: DataFrame) -> DataFrame:
    """Drops entries on another mount than their folder, and all that is below them.
    Everything below an entry carries its path as prefix, so dropping is a join with the
    few entries at which a mount begins, by the ancestors of each path."""
    folders = entries.select("tree_id", F.col("path").alias("up"), F.col("mount_id").alias("up_mount"))
    below = entries.filter(F.col("path") != "").select("tree_id", F.col("path").alias("root"), "mount_id", parent_path(F.col("path")).alias("up"))
    start = below.join(folders, ["tree_id", "up"]).filter(~F.col("mount_id").eqNullSafe(F.col("up_mount"))).select("tree_id", "root")
    return _without_below(entries, start, "root")


def without_virtual(entries: DataFrame) -> DataFrame:
    """Empties virtual file systems: their top stays as an entry, what is below it
    goes and files count 0 bytes."""
    virtual = F.col("fs").isin(VIRTUAL)
    tops = entries.filter(virtual & (F.col("kind") == "dir")).select("tree_id", F.col("path").alias("root"))
    left = _without_below(entries, tops, "root", keep_root=True)
    return left.withColumn("size", F.when(virtual & (F.col("kind") == "file"), F.lit(0).cast("long")).otherwise(F.col("size")))


def ancestors(path: Column, own: bool = True) -> Column:
    """The path itself, if wanted, and all folders above it but the top."""
    parts = F.split(path, "/")
    n = F.size(parts) if own else F.size(parts) - 1
    return F.when((path == "") | (n < 1), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def _without_below(entries: DataFrame, roots: DataFrame, root: str, keep_root: bool = False) -> DataFrame:
    hit = entries.select("tree_id", "path", F.explode(ancestors(F.col("path"), not keep_root)).alias(root)).join(roots.distinct(), ["tree_id", root], "left_semi").select("tree_id", "path").distinct()
    return entries.join(hit, ["tree_id", "path"], "left_anti")


@dataclass(frozen=True)
class Pattern:
    """One line of an exclude file in the folder `scope`: a regular expression for the path
    below `scope`, whether it only holds for folders, and whether it lets names pass."""

    scope: str
    regex: str
    dirs_only: bool
    negative: bool


def glob_regex(name: str) -> str:
    """A shell pattern of one name as regular expression. A leading dot has to be written out."""
    out, i = "", 0
    while i < len(name):
        c = name[i]
        i += 1
        dot = r"(?!\.)" if not out else ""
        if c == "*":
            out += dot + "[^/]*"
        elif c == "?":
            out += dot + "[^/]"
        elif c == "[" and (end := name.find("]", i + (name[i : i + 1] in ("!", "^")) + 1)) > 0:
            inside = name[i:end]
            negated = inside[:1] in ("!", "^")
            out += dot + "[" + ("^" if negated else "") + re.sub(r"([\\\[&^])", r"\\\1", inside[negated:]) + "]"
            i = end + 1
        elif c == "\\" and i < len(name):
            out += re.escape(name[i])
            i += 1
        else:
            out += re.escape(c)
    return out


def parse_patterns(text: str, scope: str = "") -> list[Pattern]:
    """The patterns of an exclude file. Blank lines and those that begin with # are
    skipped, ! lets names pass, a slash anywhere binds a pattern to the file's own
    folder, one at the end means folders only. Empty components, . and .. are errors."""
    found = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negative = line.startswith("!")
        body = line[negative:]
        anchored, dirs = "/" in body, body.endswith("/")
        parts = [p for p in body.strip("/").split("/")] if body.strip("/") else [""]
        parts = [p for k, p in enumerate(parts) if p or k == 0]
        if any(p in ("", ".", "..") for p in parts):
            raise ValueError(f"bad component in {line!r}")
        regex = "/".join(glob_regex(p) for p in parts)
        found.append(Pattern(scope, ("" if anchored else "(?:.*/)?") + regex, dirs, negative))
    return list(dict.fromkeys(found))


def excluded(entries: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """tree_id, path of entries that exclude patterns take out, with all below them.

    A name is taken out if a pattern matches and none that lets it pass does, in
    whatever order they stand. Patterns of an exclude file that lies in a folder
    which is itself taken out have no effect on anything that would stay. Every
    path is tested with all its ancestors, so no level has to wait for the one above."""
    step = entries.select("tree_id", "path", "kind", F.posexplode(ancestors(F.col("path"))).alias("k", "at"))
    is_dir = (F.col("at") != F.col("path")) | (F.col("kind") == "dir")

    def any_of(of: list[Pattern]) -> Column:
        hit = F.lit(False)
        for p in of:
            below = F.col("at") if not p.scope else F.when(F.col("at").startswith(p.scope + "/"), F.substr(F.col("at"), F.lit(len(p.scope) + 2)))
            one = below.rlike(rf"^(?:{p.regex})\z")
            hit = hit | F.coalesce(one & is_dir if p.dirs_only else one, F.lit(False))
        return hit

    out = any_of([p for p in patterns if not p.negative]) & ~any_of([p for p in patterns if p.negative])
    return step.filter(out).select("tree_id", "path").distinct()


def exclude_patterns(files: DataFrame) -> DataFrame:
    """tree_id, scope, regex, dirs_only, negative: the patterns in exclude files (tree_id, path, content), each of which
    holds below its own folder. A file that is no UTF-8 is read as far as it is; bad lines are an error."""
    kind = files.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for of, path, content in zip(b["tree_id"], b["path"], b["content"]):
                text = bytes(content).decode("utf-8", "replace") if content is not None else ""
                rows += [(of, x.scope, x.regex, x.dirs_only, x.negative) for x in parse_patterns(text, path.rpartition("/")[0])]
            yield pd.DataFrame(rows, columns=["tree_id", "scope", "regex", "dirs_only", "negative"])

    return files.select("tree_id", "path", F.col("content").cast("binary").alias("content")).mapInPandas(run, f"tree_id {kind}, scope string, regex string, dirs_only boolean, negative boolean")


def exclude_files(entries: DataFrame) -> DataFrame:
    """The exclude files among entries with content."""
    return entries.filter((F.col("kind") == "file") & (base_name(F.col("path")) == EXCLUDE_NAME)).select("tree_id", "path", "content")


def excluded_by_files(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """tree_id, path of entries that the patterns of their folders' exclude files (`exclude_patterns`) take out, with all below them.

    Each name meets the patterns of all folders above it; those that let it pass win over those that
    take it out, whichever file they stand in. Patterns below a folder that is itself taken out change nothing, as
    all below it goes with it."""
    at, scope = F.col("at"), F.col("scope")
    own = entries.filter(F.col("path") != "").select("tree_id", F.col("path").alias("at"), (F.col("kind") == "dir").alias("is_dir"))
    names = own.groupBy("tree_id", "at").agg(F.bool_or("is_dir").alias("is_dir"))
    rules = patterns.distinct().groupBy("tree_id", "scope").agg(F.collect_list(F.struct("regex", "dirs_only", "negative")).alias("rules"))
    met = attach(names.withColumn("scope", F.explode(F.concat(F.array(F.lit("")), ancestors(at, own=False)))), rules, ["tree_id", "scope"])
    below = F.when(scope == "", at).otherwise(F.substr(at, F.length(scope) + 2))
    hit = lambda negative: F.exists("rules", lambda r: (r["negative"] == F.lit(negative)) & (~r["dirs_only"] | F.col("is_dir")) & F.rlike(below, F.concat(F.lit("^(?:"), r["regex"], F.lit(r")\z"))))
    judged = met.select("tree_id", "at", hit(False).alias("out"), hit(True).alias("in")).groupBy("tree_id", "at").agg(F.bool_or("out").alias("out"), F.bool_or("in").alias("in"))
    tops = judged.filter(F.col("out") & ~F.col("in")).select("tree_id", "at")
    return entries.select("tree_id", "path", F.explode(ancestors(F.col("path"))).alias("at")).join(tops, ["tree_id", "at"], "left_semi").select("tree_id", "path").distinct()


def pattern_order(patterns: DataFrame) -> DataFrame:
    """Equal patterns of a tree once, with their place in a fixed order: those that take out first, then by scope, text and kind. Two sets mean the same if these are equal."""
    return running_total(patterns.distinct(), ["tree_id"], ["negative", "scope", "regex", "dirs_only"], name="place")


def without_excluded(entries: DataFrame, patterns: list[Pattern]) -> DataFrame:
    return entries.join(excluded(entries, patterns), ["tree_id", "path"], "left_anti")


def merged_patterns(patterns: list[Pattern]) -> list[Pattern]:
    """Equal patterns once, in a fixed order; two lists mean the same if these are equal."""
    return sorted(set(patterns), key=lambda p: (p.negative, p.scope, p.regex, p.dirs_only))


def deleted_names(present: DataFrame, archived: DataFrame, by: list[str]) -> DataFrame:
    """by..., path of what lies in a target but isn't in the archive."""
    return present.select(*by, "path").distinct().join(archived.select(*by, "path").distinct(), [*by, "path"], "left_anti")


def entry_violations(entries: DataFrame, features: int | None = None) -> DataFrame:
    """tree_id, path, rule of entries that no archive may hold, or none with the given features.

    Columns that `entries` lacks count as null. Rules: of names (bad_name,
    name_too_long), modes (bad_mode), owners (bad_uid, root_name), times
    (bad_nsec), links (link_without_target, target_too_long, target_on_other),
    devices (device_without_number, number_on_other, number_out_of_range), files (file_without_payload)
    and of what only certain kinds may have (fcaps_on_other, projid_on_other,
    flags_on_other, xattrs_on_link, acl_on_link, default_acl_on_other,
    acl_without_group, default_acl_without_mask, root_not_dir); with `features` also owner_name_without_flag and
    time_not_granular."""
    c = lambda name, kind: F.col(name).cast(kind) if name in entries.columns else F.lit(None).cast(kind)
    kind, path, name = c("kind", "string"), c("path", "string"), base_name(F.col("path"))
    mode, target, user, group = c("mode", "int"), c("target", "string"), c("user", "string"), c("group", "string")
    tags = entries.schema["acl"].dataType if "acl" in entries.columns else None
    acl = F.transform(F.coalesce(F.col("acl"), F.array()), lambda x: x["tag"]) if tags else F.array().cast("array<string>")
    some_acl = F.size(acl) > 0
    major, minor = (F.col("rdev.major"), F.col("rdev.minor")) if "rdev" in entries.columns else (c("major", "long"), c("minor", "long"))
    rdev = major.isNotNull() & minor.isNotNull()
    xattrs = F.coalesce(F.size("xattrs") > 0, F.lit(False)) if "xattrs" in entries.columns else F.lit(False)
    rules = [
        ("bad_name", name.isin(".", "..") | (name == "") & (path != "") | (F.instr(name, "\x00") > 0)),
        ("name_too_long", F.octet_length(name) > MAX_NAME),
        ("bad_mode", mode.bitwiseAND(F.lit(~0o177777)) != 0),
        ("bad_uid", c("uid", "long").isin(0xFFFF, 0xFFFFFFFF) | c("gid", "long").isin(0xFFFF, 0xFFFFFFFF)),
        ("root_name", (user == "root") | (group == "root")),
        ("name_of_owner_too_long", (F.octet_length(user) > MAX_USER) | (F.octet_length(group) > MAX_USER)),
        ("bad_nsec", c("mtime_ns", "long") < 0),
        ("link_without_target", (kind == "link") & (target.isNull() | (target == ""))),
        ("target_too_long", F.octet_length(target) > MAX_TARGET),
        ("target_on_other", target.isNotNull() & (kind != "link")),
        ("device_without_number", kind.isin("block", "char") & ~rdev),
        ("number_on_other", rdev & ~kind.isin("block", "char")),
        ("number_out_of_range", (major < 0) | (major >= MAX_MAJOR) | (minor < 0) | (minor >= MAX_MINOR)),
        ("file_without_payload", (kind == "file") & c("size", "long").isNull()),
        ("fcaps_on_other", c("fcaps", "binary").isNotNull() & (kind != "file")),
        ("projid_on_other", c("quota_projid", "int").isNotNull() & ~kind.isin("file", "dir")),
        ("flags_on_other", (c("flags", "long") != 0) & ~kind.isin("file", "dir")),
        ("xattrs_on_link", xattrs & (kind == "link")),
        ("acl_on_link", some_acl & (kind == "link")),
        ("default_acl_on_other", F.exists(acl, lambda t: t.startswith("default")) & (kind != "dir")),
        ("acl_without_group", F.exists(acl, lambda t: t.isin("user", "group")) & ~F.array_contains(acl, "group-obj")),
        ("default_acl_without_mask", F.exists(acl, lambda t: t.isin("default-user", "default-group")) & ~F.array_contains(acl, "default-mask")),
        ("root_not_dir", (path == "") & (kind != "dir")),
    ]
    if features is not None:
        unit = next((ns for name, ns in ff.GRANULARITY if features & ff.FEATURES[name]), None)
        off = c("mtime_ns", "long") != 0 if unit is None else F.pmod(c("mtime_ns", "long"), F.lit(unit)) != 0
        rules.append(("time_not_granular", off))
        if not features & ff.FEATURES["user-names"]:
            rules.append(("owner_name_without_flag", user.isNotNull() | group.isNotNull()))
    return entries.select("tree_id", "path", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules]))).alias("rule"))


def replay_columns(entries: DataFrame, flags: int) -> DataFrame:
    """Entries with the columns nulled that the flags don't restore."""
    needs = {"mode": ff.bits("permissions", "acl", "read-only"), "flags": ff.bits("chattr", "fat-attrs"), "uid": ff.bits("16bit-uids", "32bit-uids"), "gid": ff.bits("16bit-uids", "32bit-uids"), "user": ff.bits("user-names"), "group": ff.bits("user-names"), "mtime_ns": ff.bits(*ff._TIMES), "xattrs": ff.bits("xattrs"), "acl": ff.bits("acl"), "selinux": ff.bits("selinux"), "fcaps": ff.bits("fcaps"), "quota_projid": ff.bits("quota-projid")}
    return entries.withColumns({c: F.lit(None).cast(entries.schema[c].dataType) for c, mask in needs.items() if c in entries.columns and not flags & mask})


def name_tables(entries: DataFrame) -> DataFrame:
    """tree_id, parent, items: the lookup table of every folder, of the SipHash, offset and
    size of each name, as the search tree that a point read descends. `entries` has
    tree_id, path, start and size of the archived entry."""
    from ..functions.digests import name_hash
    from ..functions.locations import as_search_tree, sorted_names

    hashed = entries.filter(F.col("path") != "").select("tree_id", parent_path(F.col("path")).alias("parent"), name_hash(base_name(F.col("path")).cast("binary")).alias("hash"), "start", (F.col("start") + F.col("size")).alias("end"))
    return hashed.groupBy("tree_id", "parent").agg(F.collect_list(F.struct("hash", "start", "end")).alias("items")).select("tree_id", "parent", as_search_tree(sorted_names(F.col("items"))).alias("items"))


def looked_up(tables: DataFrame, wanted: DataFrame) -> DataFrame:
    """tree_id, path, start, size of each wanted path (tree_id, path) that the table of its folder (`name_tables`) holds, found by descending the search tree.

    Names whose hashes are equal stand beside one another in the order of a table; all of them are given, and the
    name that is stored where they point decides. Folders are descended in parallel, all wanted names of a folder at once."""
    from ..functions.digests import siphash24

    kind = wanted.schema["tree_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for of, parent, items, names in zip(b["tree_id"], b["parent"], b["items"], b["names"]):
                keys = [int(x["hash"]) & (1 << 64) - 1 for x in items]
                for name, want in zip(names, siphash24([n.encode("utf-8", "surrogateescape") for n in names])):
                    todo = [0]
                    while todo:
                        i = todo.pop()
                        if i >= len(keys):
                            continue
                        if keys[i] == want:
                            rows.append((of, f"{parent}/{name}" if parent else name, items[i]["start"], items[i]["end"] - items[i]["start"]))
                        # An equal hash may stand on either side.
                        if want <= keys[i]:
                            todo.append(2 * i + 1)
                        if want >= keys[i]:
                            todo.append(2 * i + 2)
            yield pd.DataFrame(rows, columns=["tree_id", "path", "start", "size"])

    asked = wanted.filter(F.col("path") != "").groupBy("tree_id", parent_path(F.col("path")).alias("parent")).agg(F.collect_set(base_name(F.col("path"))).alias("names"))
    return tables.join(asked, ["tree_id", "parent"]).mapInPandas(run, f"tree_id {kind}, path string, start long, size long")


def with_folders(entries: DataFrame) -> DataFrame:
    """The entries with the folders, and the top, that paths imply but no entry stands for; other columns of these are null."""
    above = F.concat(F.array(F.lit("")), ancestors(F.col("path"), own=False))
    implied = entries.select("tree_id", F.explode(above).alias("path")).distinct().join(entries.select("tree_id", "path"), ["tree_id", "path"], "left_anti")
    return entries.unionByName(implied.withColumn("kind", F.lit("dir")), allowMissingColumns=True)
