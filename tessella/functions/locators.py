"""Locators of archives, indices and stores: paths, SSH specifications and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which characters the parts of a locator may have.
HOST = "[A-Za-z0-9_.%-]"
PATH_RE = r"^(/|\.\z|\./|\.\.\z)"
URL_RE = r"^[a-z][a-z0-9+.-]*://[A-Za-z0-9_.%@:\[\]-]+([/;?]|\z)"
SSH_RE = rf"^{HOST}+(@{HOST}+)?:(?s:.)"


def locator_class(col: Column) -> Column:
    """url, ssh or path; null for null and empty text. What begins like a path of the file system is one."""
    return (
        F.when(col.isNull() | (col == ""), F.lit(None).cast("string"))
        .when(col.rlike(PATH_RE), "path")
        .when(col.rlike(URL_RE), "url")
        .when(col.rlike(SSH_RE), "ssh")
        .otherwise("path")
    )


def locator_class_sql(col: str) -> str:
    return rf"""CASE WHEN {col} IS NULL OR {col} = '' THEN NULL WHEN regexp_matches({col}, '^(/|\.$|\./|\.\.$)') THEN 'path'
      WHEN regexp_matches({col}, '^[a-z][a-z0-9+.-]*://[A-Za-z0-9_.%@:\[\]-]+([/;?]|$)') THEN 'url'
      WHEN regexp_matches({col}, '^[A-Za-z0-9_.%-]+(@[A-Za-z0-9_.%-]+)?:.') THEN 'ssh' ELSE 'path' END"""


def _is_url(col: Column) -> Column:
    return ~col.rlike(PATH_RE) & col.rlike(URL_RE)


def has_suffix(col: Column, suffix: str) -> Column:
    """Whether a locator ends in `suffix`: of a URL what precedes its last `?`, or
    else its last `;`; of others the last component, which must be longer than the suffix."""
    if not suffix:
        return F.lit(True)
    bare = F.when(F.instr(col, "?") > 0, F.regexp_extract(col, r"(?s)^(.*)\?[^?]*\z", 1)).when(F.instr(col, ";") > 0, F.regexp_extract(col, r"(?s)^(.*);[^;]*\z", 1)).otherwise(col)
    last = F.substring_index(col, "/", -1)
    return F.coalesce(F.when(_is_url(col), bare.endswith(suffix)).otherwise(last.endswith(suffix) & (last != suffix)), F.lit(False)) & (col != "")


def patch_last_component(col: Column, name: str) -> Column:
    """The locator of a sibling: the last component replaced by `name`. Arguments
    of a URL are dropped; what has no folder part becomes `name` behind its host."""
    host = F.regexp_extract(col, r"^([^/]*://[^/;?]*)", 1)
    rest = F.regexp_extract(F.substr(col, F.length(host) + 1), r"(?s)^([^;?]*)", 1)
    folder = F.regexp_extract(rest, r"(?s)^(.*/)[^/]*\z", 1)
    url = F.concat(host, F.when(folder == "", "/").otherwise(folder), F.lit(name))

    def sibling(path: Column) -> Column:
        trimmed = F.regexp_replace(path, r"(?<=[^/])/+\z", "")
        up = F.regexp_replace(F.regexp_extract(trimmed, r"(?s)^(.*/)[^/]+\z", 1), r"(?<=[^/])/+\z", "")
        base = F.when(trimmed.rlike(r"^/+\z"), "/").when(up == "", ".").otherwise(up)
        return F.when(F.instr(path, "/") > 0, F.concat(base, F.when(base.endswith("/"), "").otherwise("/"), F.lit(name))).otherwise(F.lit(name))

    ssh = F.concat(F.substring_index(col, ":", 1), F.lit(":"), sibling(F.regexp_extract(col, r"(?s)^[^:]*:(.*)\z", 1)))
    kind = locator_class(col)
    return F.when(kind == "url", url).when(kind == "ssh", ssh).when(kind == "path", sibling(col))


def strip_file_url(col: Column) -> Column:
    """The path of a file URL without host or of localhost; all else is left as it
    is. `%` followed by two hex digits is a byte, any other `%` and `+` stand for themselves."""
    path = F.regexp_extract(col, r"(?s)^file://(?:localhost)?(/.*)\z", 1)
    # A form that url_decode reads as meant: stray % and + are themselves encoded first.
    safe = F.replace(F.regexp_replace(path, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(path != "", F.coalesce(F.try_url_decode(safe), path)).otherwise(col)


def default_store(col: Column, explicit: str | None = None, environment: str | None = None) -> Column:
    """The store of an index: the one given, else that of the environment, else `default.castr` beside it."""
    given = explicit or environment
    return F.lit(given) if given else patch_last_component(col, "default.castr")


def xattr_name_valid(col: Column) -> Column:
    """At most 255 bytes, with a first dot that is neither first nor last."""
    dot = F.instr(col, ".")
    return F.coalesce((F.octet_length(col) <= 255) & (dot > 1) & (dot < F.length(col)), F.lit(False))


def stored_xattrs(col: Column) -> Column:
    """A map of extended attributes without those that aren't archived."""
    return F.map_filter(col, lambda k, _: xattr_name_valid(k) & (k.startswith("user.") | k.startswith("trusted.")))
