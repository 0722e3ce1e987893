"""Content-defined cuts: parameters, rolling hash and choice of cuts."""

from __future__ import annotations

import functools
import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunk_ids import MAX_CHUNK

WINDOW = 48
MIN, AVG, MAX = 16 << 10, 64 << 10, 256 << 10
#: Bytes whose hashes are held at once.
SLICE = 1 << 20


@dataclass(frozen=True)
class ChunkSizes:
    """Least, average and greatest size. Missing ones (0 or None) follow from the
    others: the average is their geometric mean, or four times the least, or a
    quarter of the greatest; least and greatest are a quarter and four times the
    average. All equal means chunks of fixed size."""

    min: int
    avg: int
    max: int

    @classmethod
    def of(cls, min: int | None = None, avg: int | None = None, max: int | None = None) -> ChunkSizes:
        if not (min or avg or max):
            return cls(MIN, AVG, MAX)
        if not avg:
            avg = round(2 ** ((math.log2(min) + math.log2(max)) / 2)) if min and max else min * 4 if min else max // 4
        low, high = min or (avg // 4 or 1), max or avg * 4
        if high > MAX_CHUNK and not max:
            high = MAX_CHUNK
        if not 1 <= low <= avg <= high <= MAX_CHUNK:
            raise ValueError(f"chunk sizes {low}:{avg}:{high} aren't in order or not in 1..{MAX_CHUNK}")
        return cls(low, avg, high)

    @classmethod
    def parse(cls, text: str) -> ChunkSizes:
        """`auto`, `AVG` or `MIN:AVG:MAX`, sizes with units as in `4K`."""
        from .sizes import parse_size

        if text == "auto":
            return cls.of()
        parts = text.split(":")
        if len(parts) not in (1, 3):
            raise ValueError(f"chunk size {text!r} is neither AVG nor MIN:AVG:MAX")
        sizes = [parse_size(x) for x in parts]
        if 0 in sizes:
            raise ValueError(f"chunk size {text!r} has a size of 0")
        return cls.of(avg=sizes[0]) if len(sizes) == 1 else cls.of(*sizes)

    @property
    def fixed(self) -> bool:
        return self.min == self.avg == self.max

    @property
    def discriminator(self) -> int:
        # The fit of the real average to the wanted one, for min = avg / 4 and max = 4 avg.
        d = int(self.avg / (-1.42888852e-7 * self.avg + 1.33237515))
        return min(max(d, self.min), self.max)

    @property
    def first_test(self) -> int:
        """The size at which a chunk may first be cut by content."""
        return max(self.min, WINDOW)


def resolved(low: str, avg: str, high: str) -> Column:
    """The same of columns: a struct of min, avg, max and discriminator; null parts if the sizes aren't in order or out of range."""
    given = [F.nullif(F.col(c), F.lit(0)).cast("long") for c in (low, avg, high)]
    a, b, c = given
    mean = F.rint(F.pow(F.lit(2.0), (F.log2(a) + F.log2(c)) / 2)).cast("long")
    mid = F.when(a.isNull() & b.isNull() & c.isNull(), AVG).when(b.isNotNull(), b).when(a.isNotNull() & c.isNotNull(), mean).when(a.isNotNull(), a * 4).otherwise(F.floor(c / 4))
    least, most = F.coalesce(a, F.greatest(F.floor(mid / 4), F.lit(1))), F.coalesce(c, F.least(mid * 4, F.lit(MAX_CHUNK)))
    ok = (least >= 1) & (least <= mid) & (mid <= most) & (most <= MAX_CHUNK)
    d = F.floor(mid / (F.lit(-1.42888852e-7) * mid + F.lit(1.33237515)))
    parts = {"min": least, "avg": mid, "max": most, "discriminator": F.least(F.greatest(d, least), most)}
    return F.struct(*[F.when(ok, x.cast("long")).alias(n) for n, x in parts.items()])


@functools.lru_cache(maxsize=8)
def byte_table(path: str | None = None) -> np.ndarray:
    """256 numbers of 32 bits, one for each byte. By rule: the first four bytes of
    the SHA-256 of the byte's two hex digits. Cuts that agree with those of another program
    need its numbers: `path` names a file of 256 numbers, parted by white space or commas."""
    if path:
        with open(path) as f:
            numbers = [int(x, 0) for x in f.read().replace(",", " ").split()]
        if len(numbers) != 256:
            raise ValueError(f"{path} has {len(numbers)} numbers, not 256")
        return np.array(numbers, np.uint32)
    return np.array([int(hashlib.sha256(b"%02x" % b).hexdigest()[:8], 16) for b in range(256)], np.uint32)


def _rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return (x << by) | (x >> ((np.uint32(32) - by) & np.uint32(31)))


def window_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash of the 48 bytes that end at each byte; meaningless for the first 47.

    The numbers, turned back by their place, are XORed up; the difference of two
    prefixes, turned forward, is the hash that rolling byte by byte would give."""
    turn = (np.arange(len(data), dtype=np.uint32)) & np.uint32(31)
    prefix = np.bitwise_xor.accumulate(_rotate(table[data], (np.uint32(32) - turn) & np.uint32(31)))
    span = prefix.copy()
    span[WINDOW:] ^= prefix[:-WINDOW]
    return _rotate(span, turn)


def candidates(data: bytes | np.ndarray, d: int, table: np.ndarray) -> np.ndarray:
    """Offsets behind the bytes at which the hash calls for a cut, in ascending order."""
    a = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    found = []
    for start in range(0, max(len(a) - WINDOW + 1, 0), SLICE):
        part = a[start : start + SLICE + WINDOW - 1]
        h = window_hashes(part, table)[WINDOW - 1 :]
        found.append(np.flatnonzero(h % np.uint32(d) == d - 1) + start + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(n: int, at: Sequence[int], sizes: ChunkSizes) -> list[int]:
    """Ends of the chunks of a stream of n bytes with the candidates `at`. A cut depends only on the bytes since the one before it."""
    if sizes.fixed:
        return [*range(sizes.max, n, sizes.max), n] if n else []
    at = at.tolist() if isinstance(at, np.ndarray) else at
    least, most, m = sizes.first_test, max(sizes.max, WINDOW), len(at)
    out, last, k = [], 0, 0
    while last < n:
        k = bisect_left(at, last + least, k)
        end = min(last + most, n)
        if k < m and at[k] < end:
            end = at[k]
        out.append(end)
        last = end
    return out


def chunk_ends_of_many(blobs: Sequence[bytes], sizes: ChunkSizes, table: np.ndarray) -> Iterator[list[int]]:
    """`chunk_ends` of each blob; small ones are hashed together, as a hash sees 48 bytes only."""
    first = 0
    while first < len(blobs):
        last, held = first, 0
        while last < len(blobs) and (not held or held + len(blobs[last]) <= SLICE):
            held += len(blobs[last])
            last += 1
        group = blobs[first:last]
        at = [] if sizes.fixed else candidates(b"".join(group) if len(group) > 1 else group[0], sizes.discriminator, table).tolist()
        begin = 0
        for blob in group:
            # Those whose window lies within the blob.
            own = at[bisect_left(at, begin + WINDOW) : bisect_right(at, begin + len(blob))]
            yield cuts(len(blob), [x - begin for x in own] if begin else own, sizes)
            begin += len(blob)
        first = last


def chunk_ends(data: bytes, sizes: ChunkSizes, table: np.ndarray | None = None) -> list[int]:
    return cuts(len(data), np.zeros(0, np.int64) if sizes.fixed else candidates(data, sizes.discriminator, byte_table() if table is None else table), sizes)


def chunk_ends_one_by_one(data: Iterable[int], sizes: ChunkSizes, table: np.ndarray | None = None) -> list[int]:
    """The plain definition, byte after byte; for tests."""
    t = [int(x) for x in (byte_table() if table is None else table)]
    rol = lambda x, k: ((x << k % 32) | (x >> (32 - k % 32))) & 0xFFFFFFFF
    out, size, end, held = [], 0, 0, []
    for b in data:
        size, end = size + 1, end + 1
        held = [*held[-(WINDOW - 1) :], b]
        if sizes.fixed:
            cut = size >= sizes.max
        else:
            h = 0
            if size >= sizes.first_test:
                for k, x in enumerate(reversed(held)):
                    h ^= rol(t[x], k)
            cut = size >= sizes.first_test and (size >= sizes.max or h % sizes.discriminator == sizes.discriminator - 1)
        if cut:
            out.append(end)
            size, held = 0, []
    return [*out, end] if size else out
