"""Digests: SHA-256 in the JVM, SHA-512/256 and SipHash by Arrow UDF."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the archive format: the key under which file names are hashed.
NAME_HASH_KEY = bytes.fromhex("b3841d0f2b447485c12ec2d130ed3627")

HASHES = {"sha256": hashlib.sha256, "sha512-256": functools.partial(hashlib.new, "sha512_256")}


def digest_bytes(data: bytes, algorithm: str = "sha512-256") -> bytes:
    return HASHES[algorithm](data).digest()


def sha512_256(col: Column) -> Column:
    """SHA-512/256 of a BINARY column. It starts from other constants than SHA-512, so `sha2(col, 512)` can't stand in."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: None if b is None else hashlib.new("sha512_256", b).digest())

    return F.pandas_udf(run, "binary")(col)


def digest(col: Column, algorithm: str = "sha256") -> Column:
    """32 bytes; null stays null. Only sha512-256 leaves the JVM."""
    if algorithm not in HASHES:
        raise ValueError(f"unknown digest {algorithm!r}; known are {', '.join(HASHES)}")
    return F.unhex(F.sha2(col, 256)) if algorithm == "sha256" else sha512_256(col)


def siphash24(messages: list[bytes], key: bytes = NAME_HASH_KEY) -> np.ndarray:
    """SipHash-2-4 of many messages at once, as uint64."""
    n = len(messages)
    if not n:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(m) for m in messages])
    words = sizes // 8 + 1
    block = np.zeros((n, int(words.max()) * 8), np.uint8)
    for i, m in enumerate(messages):
        block[i, : len(m)] = np.frombuffer(m, np.uint8)
    block = block.view("<u8").astype(np.uint64)
    # The last word of a message carries its length in the top byte.
    block[np.arange(n), words - 1] |= (sizes.astype(np.uint64) & np.uint64(255)) << np.uint64(56)
    k0, k1 = np.frombuffer(key, "<u8").astype(np.uint64)
    v = [np.full(n, x, np.uint64) for x in (k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573)]
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def rounds(v: list[np.ndarray], times: int) -> list[np.ndarray]:
        a, b, c, d = v
        for _ in range(times):
            a, c = a + b, c + d
            b, d = rot(b, 13) ^ a, rot(d, 16) ^ c
            a, c = rot(a, 32) + d, c + b
            d, b = rot(d, 21) ^ a, rot(b, 17) ^ c
            c = rot(c, 32)
        return [a, b, c, d]

    for w in range(block.shape[1]):
        on, m = w < words, block[:, w]
        mixed = rounds([v[0], v[1], v[2], v[3] ^ m], 2)
        mixed[0] = mixed[0] ^ m
        v = [np.where(on, x, y) for x, y in zip(mixed, v)]
    v[2] = v[2] ^ np.uint64(255)
    a, b, c, d = rounds(v, 4)
    return a ^ b ^ c ^ d


def name_hash(col: Column) -> Column:
    """SipHash of a file name (BINARY) as a signed BIGINT of the same 64 bits; order it with `unsigned`."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            have = s.notna()
            out = pd.Series(pd.NA, index=s.index, dtype="Int64")
            if have.any():
                out[have] = siphash24([bytes(b) for b in s[have]]).view(np.int64)
            yield out

    return F.pandas_udf(run, "long")(col)


def unsigned(col: Column) -> Column:
    """A signed BIGINT whose order is the unsigned order of `col`."""
    return col.bitwiseXOR(F.lit(-(1 << 63)))
