"""Compression of chunks. The codec of stored bytes is told from their first ones."""

from __future__ import annotations

import gzip
import lzma
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunk_ids import MAX_CHUNK

# Fixed value: the codec used where none is named, the first that is there.
PREFERRED = ["zstd", "gzip", "xz"]


def _zstd():
    import zstandard

    return zstandard


def compress_bytes(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "xz":
        return lzma.compress(data)
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    if codec == "zstd":
        return _zstd().ZstdCompressor().compress(data)
    raise ValueError(f"unknown codec {codec!r}")


def sniff(data: bytes) -> str:
    for name, magic in (("xz", b"\xfd7zXZ\x00"), ("gzip", b"\x1f\x8b"), ("zstd", b"\x28\xb5\x2f\xfd")):
        if data.startswith(magic):
            return name
    return "none"


def decompress_bytes(data: bytes, codec: str | None = None, most: int = MAX_CHUNK) -> bytes:
    """The chunk in `data`; an error if it is larger than a chunk may be."""
    codec = codec or sniff(data)
    if codec == "none":
        out = data
    elif codec == "xz":
        out = lzma.LZMADecompressor().decompress(data, most + 1)
    elif codec == "gzip":
        with gzip.GzipFile(fileobj=__import__("io").BytesIO(data)) as f:
            out = f.read(most + 1)
    elif codec == "zstd":
        with _zstd().ZstdDecompressor().stream_reader(data) as f:
            out = f.read(most + 1)
    else:
        raise ValueError(f"unknown codec {codec!r}")
    if len(out) > most:
        raise ValueError("a compressed chunk is too large")
    return out


def _each(f: Callable[[bytes], bytes | None], col: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else f(bytes(b)))

    return F.pandas_udf(run, "binary")(col)


def compress(col: Column, codec: str = "zstd") -> Column:
    return _each(lambda b: compress_bytes(b, codec), col)


def decompress(col: Column, codec: str | None = None) -> Column:
    """The chunks in compressed bytes; null for what is broken."""

    def one(b: bytes) -> bytes | None:
        try:
            return decompress_bytes(b, codec)
        except Exception:
            return None

    return _each(one, col)
