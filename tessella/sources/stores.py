"""Chunk stores as folders of files, and chunks behind URLs."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunk_ids import CHUNK_SUFFIX
from ..functions.codecs import compress_bytes, decompress

# Attempts of a fetch and the pause before each further one, in seconds times its number.
ATTEMPTS, PAUSE = 9, 0.1


def read_store(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """chunk_id, size of the file, and data, decompressed. Only files whose name is an id and
    that lie in the folder of their prefix count; without `content` no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", rf"/([0-9a-f]{{4}})/(\1[0-9a-f]{{60}})(?:{CHUNK_SUFFIX.replace('.', '[.]')})?$", 2)
    rows = files.withColumn("chunk_id", name).filter(F.col("chunk_id") != "")
    if not content:
        return rows.select("chunk_id", F.col("length").alias("size"))
    return rows.select("chunk_id", F.col("length").alias("size"), decompress(F.col("content")).alias("data"))


def write_store(chunks: DataFrame, folder: str, codec: str = "zstd") -> DataFrame:
    """Writes chunks (chunk_id, data) into a store and returns written and present: how many were
    new and how many there already. A chunk appears under its name when it is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = old = 0
            for cid, data in zip(b["chunk_id"], b["data"]):
                at = os.path.join(folder, cid[:4], cid)
                if os.path.lexists(at) or os.path.lexists(at + CHUNK_SUFFIX):
                    old += 1
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                temp = f"{at}.{uuid.uuid4().hex}.tmp"
                with open(temp, "wb") as f:
                    f.write(compress_bytes(bytes(data), codec))
                os.replace(temp, at if codec == "none" else at + CHUNK_SUFFIX)
                new += 1
            yield pd.DataFrame({"written": [new], "present": [old]})

    done = chunks.select("chunk_id", "data").dropDuplicates(["chunk_id"]).mapInPandas(run, "written long, present long")
    return done.agg(F.coalesce(F.sum("written"), F.lit(0)).alias("written"), F.coalesce(F.sum("present"), F.lit(0)).alias("present"))


def delete_from_store(ids: DataFrame, folder: str) -> DataFrame:
    """Removes chunks (chunk_id) in either form and returns removed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = 0
            for cid in b["chunk_id"]:
                for name in (cid, cid + CHUNK_SUFFIX):
                    try:
                        os.unlink(os.path.join(folder, cid[:4], name))
                        n += 1
                    except FileNotFoundError:
                        pass
            yield pd.DataFrame({"removed": [n]})

    return ids.select("chunk_id").distinct().mapInPandas(run, "removed long").agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))


def fetch(urls: DataFrame, rate_bytes: int | None = None, required: bool = False) -> DataFrame:
    """`url` with data and status: of each URL what it holds, null if it isn't there. A failed
    connection is tried up to nine times with growing pauses; any answer other than 200 is final, and an error
    if what is fetched is `required`, as an index or archive is. `rate_bytes` limits all tasks together to so many bytes a
    second: the URLs are spread over as many tasks as there are cores, and each gets its part."""
    tasks = urls.sparkSession.sparkContext.defaultParallelism
    urls = urls.select("url").dropna()
    if rate_bytes:
        urls, rate_bytes = urls.repartition(tasks), max(1, rate_bytes // tasks)

    def one(url: str) -> tuple[bytes | None, int]:
        for k in range(ATTEMPTS):
            try:
                with urllib.request.urlopen(url, timeout=30) as r:
                    return r.read(), r.status
            except urllib.error.HTTPError as e:
                return None, e.code
            except (urllib.error.URLError, OSError):
                if k + 1 < ATTEMPTS:
                    time.sleep(PAUSE * (k + 1))
        return None, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url in b["url"]:
                began = time.monotonic()
                data, status = one(url)
                if rate_bytes and data:
                    time.sleep(max(0.0, len(data) / rate_bytes - (time.monotonic() - began)))
                if required and data is None:
                    raise FileNotFoundError(f"{url} can't be fetched: status {status}")
                out.append((url, data, status))
            yield pd.DataFrame(out, columns=["url", "data", "status"])

    return urls.mapInPandas(run, "url string, data binary, status int")


def fetch_chunks(ids: DataFrame, store_url: str, rate_bytes: int | None = None) -> DataFrame:
    """chunk_id, data, missing of chunks behind the URL of a store."""
    url = F.concat(F.lit(store_url.rstrip("/") + "/"), F.substring("chunk_id", 1, 4), F.lit("/"), F.col("chunk_id"), F.lit(CHUNK_SUFFIX))
    got = fetch(ids.select("chunk_id").distinct().select(url.alias("url")), rate_bytes)
    cid = F.regexp_extract("url", r"/([0-9a-f]{64})\.[a-z]+$", 1)
    return got.select(cid.alias("chunk_id"), decompress(F.col("data")).alias("data"), F.col("data").isNull().alias("missing"))
