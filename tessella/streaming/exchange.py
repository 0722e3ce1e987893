"""The exchange of requests and chunks: frames, roles, and the queue of requests."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.lookup import attach
from ..operators.order import running_total
from ..sources.index_files import ITEM, check_tail, read_header

# Fixed values of the protocol.
FRAMES = {
    "hello": 0x3C71D0948CA5FBEE,
    "index": 0xB32A91DD2B3E27F8,
    "index-eof": 0x4F0932F1043718F5,
    "archive": 0x95D6428A69EDDCC5,
    "archive-eof": 0x450BEF663F24CBAD,
    "request": 0x8AB427E0F89D9210,
    "chunk": 0x5213DD180A84BC8C,
    "missing": 0xD010F9FAC82B7B6C,
    "goodbye": 0xAD205DBF1A3686C3,
    "abort": 0xE7D9136B7EFEA352,
}
SERVICES = {"readable-store": 0x1, "writable-store": 0x2, "readable-index": 0x4, "writable-index": 0x8, "readable-archive": 0x10, "writable-archive": 0x20}
OPERATIONS = {"pull-chunks": 0x40, "pull-index": 0x80, "pull-archive": 0x100, "push-chunks": 0x200, "push-index": 0x400, "push-index-chunks": 0x800, "push-archive": 0x1000}
SERVED_BY = {"pull-chunks": "readable-store", "pull-index": "readable-index", "pull-archive": "readable-archive", "push-chunks": "writable-store", "push-index": "writable-index", "push-archive": "writable-archive"}
MAX_FRAME, REQUEST_BYTES, HIGH_PRIORITY, COMPRESSED = 16 << 20, 64 << 10, 1, 1
_NAMES = {v: k for k, v in FRAMES.items()}


def encode_frame(kind: str, flags: int | None = None, chunk: bytes = b"", data: bytes = b"") -> bytes:
    body = (b"" if flags is None else struct.pack("<Q", flags)) + chunk + data
    if 16 + len(body) > MAX_FRAME:
        raise ValueError("a frame would be too large")
    return struct.pack("<2Q", 16 + len(body), FRAMES[kind]) + body


def decode_frames(data: bytes) -> Iterator[tuple[str, int | None, bytes, bytes]]:
    """Kind, flags, chunk ids and data of the frames in `data`; an error for what is none."""
    at = 0
    while at < len(data):
        if len(data) - at < 16:
            raise ValueError("a frame is cut off")
        size, kind = struct.unpack("<2Q", data[at : at + 16])
        name, body = _NAMES.get(kind), data[at + 16 : at + size]
        if name is None or not 16 <= size <= MAX_FRAME or at + size > len(data):
            raise ValueError(f"no frame at {at}")
        flags = None
        if name in ("hello", "request", "chunk", "abort"):
            if len(body) < 8:
                raise ValueError(f"a {name} frame is too short")
            flags, body = struct.unpack("<Q", body[:8])[0], body[8:]
        if name == "request":
            if not body or len(body) % 32 or flags > HIGH_PRIORITY:
                raise ValueError("a request is malformed")
            yield name, flags, body, b""
        elif name in ("chunk", "missing"):
            if len(body) < 32 + (name == "chunk") or name == "missing" and len(body) != 32:
                raise ValueError(f"a {name} frame is malformed")
            yield name, flags, body[:32], body[32:]
        else:
            yield name, flags, b"", body
        at += size


def compatible(local: int, remote: int) -> bool:
    """Whether two sides can work with one another: each operation of one is a service
    of the other, there is one, nothing is unknown, and chunks of an index are only
    pushed along with the index."""
    known = sum(SERVICES.values()) | sum(OPERATIONS.values())
    if (local | remote) & ~known:
        return False
    for own, other in ((local, remote), (remote, local)):
        if any(own & OPERATIONS[o] and not other & SERVICES[s] for o, s in SERVED_BY.items()):
            return False
        both = OPERATIONS["push-index"] | OPERATIONS["push-chunks"]
        if own & OPERATIONS["push-index-chunks"] and own & both != both:
            return False
    return bool((local | remote) & sum(OPERATIONS[o] for o in SERVED_BY))


def compatible_roles(local: Column, remote: Column) -> Column:
    """The same as a column, of two columns of flags."""
    on = lambda c, mask: c.bitwiseAND(F.lit(mask)) != 0
    known = sum(SERVICES.values()) | sum(OPERATIONS.values())
    bad = on(local.bitwiseOR(remote), ~known)
    both = OPERATIONS["push-index"] | OPERATIONS["push-chunks"]
    for own, other in ((local, remote), (remote, local)):
        for o, s in SERVED_BY.items():
            bad = bad | on(own, OPERATIONS[o]) & ~on(other, SERVICES[s])
        bad = bad | on(own, OPERATIONS["push-index-chunks"]) & (own.bitwiseAND(F.lit(both)) != both)
    return ~bad & on(local.bitwiseOR(remote), sum(OPERATIONS[o] for o in SERVED_BY))


def request_queue(requests: DataFrame) -> DataFrame:
    """chunk_id, high, place: each wanted chunk once, in the order in which to ask for it.

    `requests` has chunk_id, high and seq. A chunk that is asked for again is high as soon
    as one request is, and keeps the place of the first request of that priority. High
    ones come first, each kind in the order of asking."""
    high = F.coalesce("high", F.lit(False))
    one = requests.filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max(high).alias("high"), F.min(F.when(high, F.col("seq"))).alias("h"), F.min("seq").alias("l"))
    seq = F.when(F.col("high"), F.col("h")).otherwise(F.col("l"))
    asked = one.select("chunk_id", "high", (~F.col("high")).alias("later"), seq.alias("seq"))
    return running_total(asked, [], ["later", "seq", "chunk_id"], name="place").select("chunk_id", "high", "place")


def request_frames(queue: DataFrame, most: int = REQUEST_BYTES) -> DataFrame:
    """frame_no, high, chunks: requests put together into frames of at most `most` bytes, none with mixed priorities. `queue` has binary ids."""
    per = (most - 24) // 32
    n_high = queue.filter("high").count()
    high, low = F.floor(F.col("place") / per), F.floor((F.col("place") - n_high) / per) + -(-n_high // per)
    placed = queue.withColumn("frame_no", F.when(F.col("high"), high).otherwise(low) + 1)
    return placed.groupBy("frame_no", "high").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))


def new_requests(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A stream of requests (chunk_id, high, asked_at) without those that ask again with the
    same priority: a chunk passes once as low and once more if it becomes high. State is
    dropped `watermark` after the time of a request."""
    return requests.withColumn("high", F.coalesce("high", F.lit(False))).withWatermark("asked_at", watermark).dropDuplicatesWithinWatermark(["chunk_id", "high"])


def responses(requests: DataFrame, store: DataFrame) -> DataFrame:
    """chunk_id, kind (chunk or missing), data of each request, by joining a request table with a store. A
    chunk that is asked for very often is split over many tasks; a stream of requests is joined
    as it is, as `new_requests` lets a chunk pass twice at most."""
    asked, held = requests.select("chunk_id"), store.select("chunk_id", "data")
    met = asked.join(held, "chunk_id", "left") if requests.isStreaming else attach(asked, held, ["chunk_id"], "left")
    return met.select("chunk_id", F.when(F.col("data").isNull(), "missing").otherwise("chunk").alias("kind"), "data")


def valid_response(chunk_id: Column, data: Column, algorithm: str = "sha256") -> Column:
    """Whether received data has the digest that its id states, by the given algorithm or the other one."""
    from ..functions.digests import digest

    other = "sha512-256" if algorithm == "sha256" else "sha256"
    return F.coalesce(digest(data, algorithm) == chunk_id, F.lit(False)) | F.coalesce(digest(data, other) == chunk_id, F.lit(False))


class Progress(StreamingQueryListener):
    """Keeps what each micro-batch did: (batch, rows in, state rows)."""

    def __init__(self) -> None:
        self.steps: list[tuple[int, int, int]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.steps.append((p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def frame_bytes(frames: DataFrame) -> DataFrame:
    """`request_frames` (frame_no, high, chunks of binary ids) with `frame`, the bytes that go over the wire."""
    kind = frames.schema["frame_no"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [encode_frame("request", HIGH_PRIORITY if h else 0, b"".join(map(bytes, c))) for h, c in zip(b["high"], b["chunks"])]
            yield pd.DataFrame({"frame_no": b["frame_no"], "frame": made})

    return frames.mapInPandas(run, f"frame_no {kind}, frame binary")


def read_frames(frames: DataFrame) -> DataFrame:
    """kind, flags, chunk_id, data of received bytes (`frame`); a request of many chunks gives a row for each. Bytes that are no frame are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data in b["frame"]:
                for kind, flags, ids, rest in decode_frames(bytes(data)):
                    for k in range(0, max(len(ids), 1), 32):
                        rows.append((kind, flags, ids[k : k + 32] or None, rest or None))
            out = pd.DataFrame(rows, columns=["kind", "flags", "chunk_id", "data"])
            yield out.astype({"flags": "Int64"})

    return frames.select("frame").mapInPandas(run, "kind string, flags long, chunk_id binary, data binary")


def follow_index(spark, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Items of indices as their Parquet files arrive in a folder: a stream of index_id, pos, end_offset, chunk_id."""
    reader = spark.readStream.schema("index_id string, pos int, end_offset long, chunk_id string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


class GrowingIndex(DataSource):
    """`spark.readStream.format("index-growing").load(file)`: the items of an index file as it is written or downloaded: index_id, pos,
    end_offset, chunk_id. Each micro-batch takes what is whole by then; a header that isn't one, an offset that doesn't
    increase and a tail that doesn't fit are errors. Nothing comes behind the tail."""

    @classmethod
    def name(cls) -> str:
        return "index-growing"

    def schema(self) -> str:
        return "index_id string, pos int, end_offset long, chunk_id binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _GrowingReader(self.options)


class _GrowingReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")

    def initialOffset(self) -> dict:
        return {"items": 0}

    def _items(self, first: int, last: int | None) -> tuple[list[tuple], int]:
        """Items from number `first` to before `last` (none: as many as are there)."""
        rows: list[tuple] = []
        if not os.path.exists(self.path):
            return rows, first
        name = os.path.basename(self.path).rsplit(".", 1)[0]
        with open(self.path, "rb") as f:
            head = f.read(64)
            if len(head) < 64:
                return rows, first
            most = read_header(head, 64 + ITEM, self.path)[1][2]
            f.seek(64 + max(first - 1, 0) * ITEM)
            before = struct.unpack("<Q", f.read(ITEM)[:8])[0] if first else 0
            at = first
            while (last is None or at < last) and len(item := f.read(ITEM)) == ITEM:
                end = struct.unpack("<Q", item[:8])[0]
                if end == 0:  # the tail
                    check_tail(item, at, self.path)
                    break
                if not before < end <= before + most:
                    raise ValueError(f"the offsets of {self.path} don't increase, or by more than a chunk")
                rows.append((name, at, end, item[8:]))
                before, at = end, at + 1
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self._items(start["items"], None)
        return iter(rows), {"items": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._items(start["items"], end["items"])[0])


def follow_index_file(spark, path: str) -> DataFrame:
    spark.dataSource.register(GrowingIndex)
    return spark.readStream.format("index-growing").load(path)


#: What a side may send, by what it serves or asks for; hello, goodbye and abort are everybody's.
_SENDERS = {"index": ["readable-index", "push-index"], "index-eof": ["readable-index", "push-index"], "archive": ["readable-archive", "push-archive"], "archive-eof": ["readable-archive", "push-archive"], "request": ["pull-chunks", "writable-store", "writable-index"], "chunk": ["readable-store", "push-chunks"], "missing": ["readable-store", "push-chunks"]}


def dispatched(messages: DataFrame) -> DataFrame:
    """`messages` (session, side, seq, kind, flags of the frames that the sides of sessions sent, in their order) with
    `action`: what the receiver does with each.

    begin for the first message of a side, which has to be its hello; take for one that the side's roles, as its hello
    states them, let it send; end for goodbye and abort; ignore for what comes after these; error for a second or missing
    hello, a message that isn't the side's to send, and what follows the end of an index or archive."""
    kind, seq = F.col("kind"), F.col("seq")
    at = lambda *kinds: F.min(F.when(kind.isin(*kinds), seq))
    hello = F.when(kind == "hello", seq)
    # What is told of a side are a few numbers, so a session may have most of all messages.
    per = messages.groupBy("session", "side").agg(F.min("seq").alias("__first"), F.min(hello).alias("__hello"), F.min_by("flags", hello).alias("__roles"), at("goodbye", "abort").alias("__end"), at("index-eof").alias("__index"), at("archive-eof").alias("__archive"))
    may = F.lit(False)
    for k, of in _SENDERS.items():
        mask = sum((SERVICES | OPERATIONS)[r] for r in of)
        may = may | (kind == k) & (F.col("__roles").bitwiseAND(F.lit(mask)) != 0)
    late = kind.isin("index", "index-eof") & (seq > F.col("__index")) | kind.isin("archive", "archive-eof") & (seq > F.col("__archive"))
    action = (
        F.when(seq > F.col("__end"), "ignore")
        .when(seq == F.col("__first"), F.when(kind == "hello", "begin").otherwise("error"))
        .when(kind.isin("goodbye", "abort"), "end")
        .when((seq > F.col("__hello")) & may & ~F.coalesce(late, F.lit(False)), "take")
        .otherwise("error")
    )
    return attach(messages, per, ["session", "side"]).select(*messages.columns, action.alias("action"))
