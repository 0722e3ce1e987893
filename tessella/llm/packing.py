"""Filling fixed-capacity containers with items: shortest pack first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def fill_plan(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(length, first rank, number, first container) of every placement, and the
    number of containers, for `lengths`: how many items of each length there are.

    Lengths are placed longest first. A pattern is a run of containers that are
    filled alike, kept under its free room. Items go to the pattern with the
    most room, that is the shortest pack, one into each of its containers;
    a run is cut where the items end, and what finds no room starts new
    containers. Everything here depends on the histogram, which has at most
    `capacity` lengths, and not on the number of items.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    placed: list[tuple[int, int, int, int]] = []
    used = 0

    def keep(room: int, start: int, n: int) -> None:
        if room > 0:
            if room not in runs:
                runs[room] = []
                heapq.heappush(rooms, -room)
            runs[room].append((start, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                start, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    heapq.heappop(rooms)
                take = min(n, left)
                if take < n:
                    keep(room, start + take, n - take)
            else:
                # As few containers as these items alone need, one item in each to begin with.
                room, start, take = capacity, used, -(-left // (capacity // length))
                used += take
            placed.append((length, rank, take, start))
            keep(room - length, start, take)
            rank, left = rank + take, left - take
    return placed, used


def pieces_of(sizes: DataFrame, packs: dict[str, int]) -> DataFrame:
    """pack_name, capacity, doc_id, piece_no, first_token, n_tokens: for each pack,
    each message whole, or cut at the capacity if it alone exceeds it."""
    settings = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(c).cast("long").alias("capacity")) for name, c in sorted(packs.items())]) if packs else F.expr("cast(array() as array<struct<pack_name: string, capacity: bigint>>)")
    each = sizes.filter(F.col("n_tokens") > 0).select("doc_id", "n_tokens", F.inline(settings))
    cut = each.withColumn("piece_no", F.explode(F.expr("sequence(0L, cast((n_tokens - 1) div capacity as bigint))")))
    return cut.select("pack_name", "capacity", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), F.least("capacity", F.col("n_tokens") - F.col("piece_no") * F.col("capacity")).cast("int").alias("n_tokens"))


def packed(sizes: DataFrame, packs: DataFrame, splits: int | None = None) -> DataFrame:
    """`pieces_of` with container_id, which counts from 0 in each pack.

    `sizes` has doc_id (unique) and n_tokens, `packs` pack_name and
    capacity_tokens: a short list of settings, which is collected. Messages
    without tokens (none, empty or missing text) need no room and take no part;
    packs without name or positive capacity likewise; of a name given twice the
    larger capacity counts. The length histogram goes
    to the driver, at most one row for each token of capacity. A piece learns
    its rank among those of its length, and the placement that covers this rank
    names its container. A length may hold most pieces: ranks are
    counted within `splits` parts of each length, to which the numbers of the
    parts before are added.
    """
    spark = sizes.sparkSession
    splits = splits or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = packs.filter((F.col("capacity_tokens") > 0) & F.col("pack_name").isNotNull()).groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    pieces = pieces_of(sizes, {r.pack_name: r.capacity for r in chosen.collect()}).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(splits)).cast("int"))
    per_part = written(pieces.groupBy("pack_name", "capacity", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in per_part.groupBy("pack_name", "capacity", "n_tokens").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault((r.pack_name, r.capacity), {})[r.n_tokens] = r.n
    # All placements behind one another: a piece is found by the ranks before its pack and length plus its own.
    base, starts, firsts, before = {}, [], [], 0
    for (name, capacity), lengths in sorted(histogram.items()):
        for length, rank, n, container in fill_plan(lengths, capacity)[0]:
            base.setdefault((name, length), before - rank)
            starts.append(before)
            firsts.append(container)
            before += n
    shared = spark.sparkContext.broadcast((base, np.array(starts, np.int64), np.array(firsts, np.int64)))

    @F.pandas_udf("long")
    def container(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        base, starts, firsts = shared.value
        for names, lengths, ranks in parts:
            at = np.fromiter((base[k] for k in zip(names, lengths)), np.int64, len(names)) + ranks.to_numpy()
            k = np.searchsorted(starts, at, "right") - 1
            yield pd.Series(firsts[k] + at - starts[k])

    order = Window.partitionBy("pack_name", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("pack_name", "n_tokens", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    own = Window.partitionBy("pack_name", "n_tokens", "part").orderBy("doc_id", "piece_no")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["pack_name", "n_tokens", "part"])
    return ranked.select("pack_name", "capacity", container("pack_name", "n_tokens", F.col("rank") + F.col("offset")).alias("container_id"), "doc_id", "piece_no", "first_token", "n_tokens")


def containers(pieces: DataFrame) -> DataFrame:
    """One row for each container: its messages (doc_id, piece_no, n_tokens), tokens
    and fill. A container has at most as many messages as its capacity."""
    return (
        pieces.groupBy("pack_name", "container_id")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece_no", "n_tokens"))).alias("messages"), F.sum("n_tokens").alias("tokens"), F.first("capacity").alias("capacity"))
        .withColumn("fill", F.col("tokens") / F.col("capacity"))
    )
