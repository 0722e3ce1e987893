"""Chunk ids: parsing, formatting and store paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the storage format.
CHUNK_SUFFIX = ".cacnk"
ID_BYTES = 32
MIN_CHUNK, MAX_CHUNK = 1, 128 * 1024 * 1024

_SPACE = " \t\r\n\f\x0b"
#: An optional store path, digest name or 0x, then hex digits that may be grouped, then an optional file suffix.
_WRITTEN = r"^(?:(?:[^/]*/)*(?=[0-9a-f]{64}\.cacnk$)|sha[0-9]+(?:[-_/][0-9]+)?:|0x)?([0-9a-f][0-9a-f:_\s-]+?)(?:\.cacnk)?$"


def chunk_key(col: Column | str) -> Column:
    """The 32 bytes that a written chunk id stands for, as BINARY.

    Understood are 64 hex digits in any letter case, with white space around
    them, after `0x` or the name of a digest, in groups parted by `:`, `-`, `_`
    or a space, and as the path of a chunk in a store. Null, empty and broken
    values, and those of another length, give null. Plain ids, which are nearly
    all, never reach the regular expression.
    """
    c = F.col(col) if isinstance(col, str) else col
    tidy = F.lower(F.btrim(c, F.lit(_SPACE)))
    digits = F.regexp_replace(F.regexp_extract(tidy, _WRITTEN, 1), r"[:_\s-]", "")
    return F.when(F.length(c) == 64, F.unhex(c)).when(F.length(digits) == 64, F.unhex(digits))


def chunk_key_sql(col: str) -> str:
    """The same as lower-case hex digits, in DuckDB's SQL."""
    tidy = f"lower(trim({col}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    bare = rf"regexp_replace(regexp_replace({tidy}, '^(([^/]*/)*|sha[0-9]+([-_/][0-9]+)?:|0x)([0-9a-f]{{64}})\.cacnk$', '\4'), '^(sha[0-9]+([-_/][0-9]+)?:|0x)', '')"
    plain = rf"regexp_replace({bare}, '[:_\s-]', '', 'g')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9a-f]{{64}}') THEN {plain} END"


def format_id(key: Column) -> Column:
    """Lower-case hex digits of a key."""
    return F.lower(F.hex(key))


def parse_id(text: Column) -> Column:
    """Strict form: exactly 64 lower-case hex digits, else null."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text))


def store_path(key: Column, suffix: str = CHUNK_SUFFIX) -> Column:
    """Path of a chunk in a store: its first four digits as folder, then the id."""
    digits = format_id(key)
    return F.concat(F.substring(digits, 1, 4), F.lit("/"), digits, F.lit(suffix))


def is_null_id(key: Column) -> Column:
    """Whether all 32 bytes are zero."""
    return key == F.unhex(F.lit("00" * ID_BYTES))


def valid_chunk_length(size: Column) -> Column:
    return size.between(MIN_CHUNK, MAX_CHUNK)
