"""Index files: a header, items of 40 bytes, a tail."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.chunk_ids import MAX_CHUNK
from ..session import settings

# Fixed values of the index format.
INDEX_TYPE, TABLE_TYPE, TAIL_MARKER = 0x96824D9C7B129FF9, 0xE75B9E112F17417D, 0x4B4F050E5549ECD1
HEADER, ITEM, ANY_SIZE = 48, 40, (1 << 64) - 1
_ITEM = np.dtype([("offset", "<u8"), ("chunk", "V32")])
#: Opening a file counts as reading so many items when files are dealt out to tasks; items read at once.
OPENING, BATCH = 1024, 1 << 16


def encode_index(features: int, sizes: tuple[int, int, int], offsets: np.ndarray, chunks: list[bytes]) -> bytes:
    head = struct.pack("<6Q", HEADER, INDEX_TYPE, features & ANY_SIZE, *sizes) + struct.pack("<2Q", ANY_SIZE, TABLE_TYPE)
    body = np.zeros(len(chunks), _ITEM)
    body["offset"] = offsets
    if chunks:
        body["chunk"] = np.frombuffer(b"".join(chunks), "V32")
    return head + body.tobytes() + struct.pack("<5Q", 0, 0, HEADER, 16 + ITEM * len(chunks) + ITEM, TAIL_MARKER)


def read_header(data: bytes, length: int, path: str = "") -> tuple[int, tuple[int, int, int], int]:
    """Features, chunk sizes and number of items, from the first 64 bytes; an error for what isn't an index."""
    if len(data) < 64 or length < 64 + ITEM or (length - 64) % ITEM:
        raise ValueError(f"{path} is cut off or no index")
    size, kind, features, low, avg, high = struct.unpack("<6Q", data[:48])
    table_size, table = struct.unpack("<2Q", data[48:64])
    if (size, kind, table_size, table) != (HEADER, INDEX_TYPE, ANY_SIZE, TABLE_TYPE):
        raise ValueError(f"{path} isn't an index")
    if not 0 < low <= avg <= high <= MAX_CHUNK:
        raise ValueError(f"the chunk sizes of {path} are out of range")
    return features, (low, avg, high), (length - 64) // ITEM - 1


def check_tail(tail: bytes, items: int, path: str = "") -> None:
    if struct.unpack("<5Q", tail) != (0, 0, HEADER, 16 + ITEM * items + ITEM, TAIL_MARKER):
        raise ValueError(f"the tail of {path} is wrong")


def check_items(offsets: np.ndarray, before: int, most: int, path: str = "") -> None:
    step = np.diff(offsets.astype(np.int64), prepend=before)
    if (step <= 0).any() or (step > most).any():
        raise ValueError(f"the offsets of {path} don't increase, or by more than a chunk")


class _Part(InputPartition):
    """What a task reads: whole files, or of one file a first item, a number of items and whether they are its last.
    The paths, below the source's, are one text, as there may be very many of them."""

    def __init__(self, paths: list[str], piece: tuple[int, int, bool] | None = None):
        self.paths, self.piece = "\0".join(paths), piece


class IndexSource(DataSource):
    """`spark.read.format("index-file").load(folder or file)`: index_id (file name without
    suffix), pos, end_offset, chunk_id, feature_flags and chunk sizes. Items have a fixed
    width, so a large file is read by several tasks (option items_per_task); small files
    share a task. Files must be reachable from all executors by their path."""

    @classmethod
    def name(cls) -> str:
        return "index-file"

    def schema(self) -> str:
        return "index_id string, pos int, end_offset long, chunk_id binary, feature_flags long, chunk_min long, chunk_avg long, chunk_max long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"].removeprefix("file://"), int(options.get("items_per_task", 1 << 20))

    def _files(self) -> Iterator[str]:
        if os.path.isfile(self.path):
            yield self.path
        else:
            for d, folders, files in os.walk(self.path):
                folders.sort()
                yield from (os.path.join(d, f) for f in sorted(files) if f.endswith((".caidx", ".caibx")))

    def partitions(self) -> list[InputPartition]:
        parts, held, room = [], [], self.step
        for p in self._files():
            n, below = max(0, (os.path.getsize(p) - 64) // ITEM - 1), p[len(self.path) :]
            if n > self.step:
                parts += [_Part([below], (k, min(self.step, n - k), k + self.step >= n)) for k in range(0, n, self.step)]
                continue
            if held and n + OPENING > room:
                parts.append(_Part(held))
                held, room = [], self.step
            held.append(below)
            room -= n + OPENING
        return parts + ([_Part(held)] if held else [])

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for below in part.paths.split("\0"):
            for x in _read_file(self.path + below, part.piece):
                held.append(x)
                rows += len(x[-1])
                if rows >= BATCH:
                    yield _batch(held)
                    held, rows = [], 0
        if held:
            yield _batch(held)


def _read_file(path: str, piece: tuple[int, int, bool] | None) -> Iterator[tuple]:
    """Index, features, chunk sizes, first item and items, checked, of a file or a piece of it, BATCH items at once."""
    with open(path, "rb") as f:
        length = os.fstat(f.fileno()).st_size
        features, sizes, total = read_header(f.read(64), length, path)
        first, n, last = piece or (0, total, True)
        if last:
            f.seek(64 + total * ITEM)
            check_tail(f.read(ITEM), total, path)
        before = 0
        if first:
            f.seek(64 + (first - 1) * ITEM)
            before = struct.unpack("<Q", f.read(8))[0]
        name = os.path.basename(path).rsplit(".", 1)[0]
        signed = features - (1 << 64) if features >> 63 else features
        for k in range(first, first + n, BATCH):
            f.seek(64 + k * ITEM)
            items = np.frombuffer(f.read(min(BATCH, first + n - k) * ITEM), _ITEM)
            check_items(items["offset"], before, sizes[2], path)
            before = int(items["offset"][-1])
            yield name, signed, sizes, k, items


def _batch(held: list[tuple]) -> pa.RecordBatch:
    names, features, sizes, first, items = zip(*held)
    m = np.array([len(x) for x in items])
    each = lambda values: np.repeat(np.array(values, np.int64), m)
    both = np.concatenate(items)
    pos = np.arange(len(both)) - each(np.cumsum(m) - m) + each(first)
    ends = np.arange(len(both) + 1, dtype=np.int32) * 32
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(each(range(len(m))))), pa.array(pos.astype(np.int32)), pa.array(both["offset"].astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(both), [None, pa.py_buffer(ends), pa.py_buffer(both["chunk"].tobytes())]), pa.array(each(features)), *[pa.array(each(x)) for x in zip(*sizes)]],
        names=["index_id", "pos", "end_offset", "chunk_id", "feature_flags", "chunk_min", "chunk_avg", "chunk_max"],
    )


def read_indices(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(IndexSource)
    return spark.read.format("index-file").load(path)


#: The driver holds a listing of all files: without the places of their blocks, which tasks of many files can't follow, and not in a cache beyond the query.
_LISTING = {"spark.sql.sources.ignoreDataLocality": "true", "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}


def _packed(files: DataFrame, at_once: int = 256) -> DataFrame:
    """`files` in no more tasks than cores, their bytes or `at_once` files to a task ask for. Spark
    counts opening a file as 4 MB, so that a task would read but a few small ones."""
    spark = files.sparkSession
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    listed = files._jdf.queryExecution().analyzed().relation().location().allFiles().size()  # inputFiles() would make a text of each
    return files.coalesce(max(spark.sparkContext.defaultParallelism, size // part, listed // at_once))


def read_indices_builtin(spark: SparkSession, path: str) -> DataFrame:
    """index_id, pos, end_offset, chunk_id from any file system that Spark reads, without Python.
    Each file is one value, so for files beyond a gigabyte `read_indices` is the way."""
    with settings(spark, _LISTING):
        files = _packed(spark.read.format("binaryFile").option("pathGlobFilter", "*.{caidx,caibx}").option("recursiveFileLookup", "true").load(path))
    n = ((F.length("content") - 64) / ITEM).cast("int") - 1
    magic = struct.pack("<Q", INDEX_TYPE).hex().upper()
    each = files.filter((n > 0) & (F.hex(F.substring("content", 9, 8)) == magic))
    at = F.lit(65) + F.col("pos") * ITEM
    item = each.select(F.regexp_extract("path", r"([^/]+)\.ca[ib][a-z]*$", 1).alias("index_id"), "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")).select("index_id", "pos", F.substr("content", at, F.lit(ITEM)).alias("i"))
    digits = F.hex(F.substring("i", 1, 8))
    offset = F.conv(F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(8, 0, -1)]), 16, -10).cast("long")
    return item.select("index_id", "pos", offset.alias("end_offset"), F.substring("i", 9, 32).alias("chunk_id"))


def write_indices(items: DataFrame, folder: str, suffix: str = ".caibx", features: int = 0, sizes: tuple[int, int, int] = (16384, 65536, 262144)) -> DataFrame:
    """Writes a file for each index_id of `items` (index_id, pos, end_offset, chunk_id BINARY) and
    returns index_id, path, items. A file appears under its name only when it is whole; writing
    it again gives the same bytes, so a task that is repeated does no harm."""
    import pandas as pd  # not in the processes of the source

    kind = items.schema["index_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        now, offsets, chunks, done = None, [], [], []

        def close() -> None:
            path = os.path.join(folder, f"{now}{suffix}")
            temp = f"{path}.{uuid.uuid4().hex}.tmp"
            with open(temp, "wb") as f:
                f.write(encode_index(features, sizes, np.array(offsets, np.uint64), chunks))
            os.replace(temp, path)
            done.append((now, path, len(chunks)))

        for b in batches:
            for index, end, chunk in zip(b["index_id"], b["end_offset"], b["chunk_id"]):
                if now is not None and index != now:
                    close()
                    offsets, chunks = [], []
                now = index
                offsets.append(end)
                chunks.append(bytes(chunk))
        if now is not None:
            close()
        yield pd.DataFrame(done, columns=["index_id", "path", "items"])

    placed = items.select("index_id", "pos", "end_offset", "chunk_id").repartition("index_id").sortWithinPartitions("index_id", "pos")
    return placed.mapInPandas(run, f"index_id {kind}, path string, items int")
