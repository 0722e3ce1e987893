"""Repetition inside a single document."""

from __future__ import annotations

import binascii
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import spread, written

RUN = 5
LEAST = 0.35
#: Words that are compared at once, for bounded memory; a longer message is compared by itself.
AT_ONCE = 400_000

_FIELD = re.compile(r"([!-9;-~]+)[ \t]*:(.*)", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_PARAM = {p: re.compile(rf';\s*{p}\s*=\s*(?:"([^"]*)"|([^\s;]+))', re.I) for p in ("boundary", "charset")}
_ADDRESS = re.compile(r"@([\w.-]+)")


def _split(text: str) -> tuple[dict[str, str], str]:
    """Header fields (the first of each name) and the rest. A line that can't belong to a header ends it."""
    head: dict[str, str] = {}
    at, name = 0, ""
    if text.startswith("From "):
        at = text.find("\n") + 1 or len(text)
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if name and line[:1] in (" ", "\t"):
            head[name] += " " + line.strip()
        elif not line.strip():
            return head, text[end + 1 :]
        elif m := _FIELD.fullmatch(line):
            name = m[1].lower()
            if name in head:
                name += "*"
            head[name] = m[2].strip()
        else:
            break
        at = end + 1
    return head, text[at:]


def _param(value: str, name: str) -> str:
    m = _PARAM[name].search(value)
    return (m[1] or m[2] or "") if m else ""


def _decoded(body: str, head: dict[str, str]) -> str:
    """A body with its transfer encoding undone. Bytes that aren't of the stated
    character set are read as UTF-8 or else as Latin-1."""
    how = head.get("content-transfer-encoding", "").lower()
    if "quoted-printable" in how:
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    elif "base64" in how:
        data = re.sub(r"[^A-Za-z0-9+/]", "", body)
        data = data[: len(data) - (len(data) % 4 == 1)]
        raw = binascii.a2b_base64(data + "=" * (-len(data) % 4))
    else:
        return body
    for charset in (_param(head.get("content-type", ""), "charset") or "utf-8", "utf-8"):
        try:
            return raw.decode(charset)
        except (LookupError, ValueError):
            continue
    return raw.decode("latin-1")


def _plain(head: dict[str, str], rest: str) -> list[str]:
    """The plain parts of a message in their order, however deep they are nested."""
    found: list[str] = []
    todo = [(head, rest, False)]
    while todo:
        head, rest, inner = todo.pop()
        kind = head.get("content-type", "text/plain").lower()
        boundary = _param(head.get("content-type", ""), "boundary")
        if kind.startswith("multipart/") and boundary:
            marks = list(re.finditer(rf"^--{re.escape(boundary)}(--)?[ \t]*$", rest, re.M))
            last = next((k for k, m in enumerate(marks) if m[1]), len(marks))
            if marks:
                for k in reversed(range(last)):
                    end = marks[k + 1].start() if k + 1 < len(marks) else len(rest)
                    todo.append((*_split(rest[marks[k].end() + 1 : end]), True))
                continue
        if not inner or kind.strip().startswith("text/plain") and not head.get("content-disposition", "").lower().startswith("attachment"):
            found.append(_decoded(rest, head))
    return found


def body_of(text: str | None) -> tuple[str, str]:
    """The body of a raw mail message and the domain of its sender ("" if none)."""
    head, rest = _split((text or "").replace("\r\n", "\n").replace("\r", "\n"))
    sender = _ADDRESS.findall(head.get("from", ""))
    return "\n".join(_plain(head, rest)), sender[-1].lower() if sender else ""


def words_of(body: str) -> list[str]:
    """Runs of letters in lower case; a letter and its accents are one letter however they are written."""
    if not body.isascii():
        body = unicodedata.normalize("NFC", body)
    return _WORD.findall(body.lower())


def repeated_words(codes: np.ndarray, docs: np.ndarray, run: int = RUN) -> np.ndarray:
    """Whether each word lies in a run of `run` words that began earlier in the
    same document. `codes` are 64-bit hashes of the words, `docs` the documents
    they are in, in order."""
    out = np.zeros(len(codes), bool)
    n = len(codes) - run + 1
    if n < 2:
        return out
    h = docs[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(run):
        x = codes[k : k + n].view(np.uint64) if codes.dtype == np.int64 else codes[k : k + n]
        h = (h ^ x) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(docs[:n] == docs[run - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    again = order[1:][(h[order[1:]] == h[order[:-1]]) & (docs[order[1:]] == docs[order[:-1]])]
    for k in range(run):
        out[again + k] = True
    return out


def _measure(texts: list[str | None], run: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    lists: list[np.ndarray] = []
    hosts: list[str] = []
    held = 0

    def flush() -> tuple[list[int], list[int], list[str]]:
        sizes = np.array([len(x) for x in lists])
        docs = np.repeat(np.arange(len(lists)), sizes)
        codes = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        repeated = np.bincount(docs[repeated_words(codes, docs, run)], minlength=len(lists))
        return sizes.tolist(), repeated.tolist(), list(hosts)

    for text in texts:
        body, host = body_of(text)
        words = words_of(body)
        if held and held + len(words) > AT_ONCE:
            yield flush()
            lists, hosts, held = [], [], 0
        lists.append(np.fromiter(map(hash, words), np.int64, len(words)))
        hosts.append(host)
        held += len(words)
    if lists:
        yield flush()


def measured(documents: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, host, words, repeated, share of each message.

    The body is the text/plain part, or all after the headers of a message that
    isn't multipart, with its transfer encoding undone. A word is repeated if it
    lies in a run of `run` words that already began earlier in the body; only
    letters count. Missing and empty texts have no words and the share 0. The
    host is the domain of the sender, or else of the mailbox, or null.
    """

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, repeated, hosts = [], [], []
            for a, b, c in _measure(part["text"].tolist(), run):
                sizes += a
                repeated += b
                hosts += c
            fallback = part["mailbox"].fillna("").str.lower().str.rpartition("@")[2]
            host = pd.Series(hosts, index=part.index, dtype=object)
            host = host.where(host != "", fallback)
            yield pd.DataFrame({"doc_id": part["doc_id"], "host": host.where(host != "", None), "words": sizes, "repeated": repeated})

    got = spread(documents.select("doc_id", "text", "mailbox")).mapInPandas(go, "doc_id long, host string, words int, repeated int")
    return got.withColumn("share", F.coalesce(F.try_divide("repeated", "words"), F.lit(0.0)))


def verdicts(documents: DataFrame, least: float = LEAST, run: int = RUN, host_factor: float = 2.0) -> DataFrame:
    """`measured` with fails, host_documents, host_rate and host_fails.

    A message fails if at least the share `least` of its words is repeated. The
    rates of failures by host are shrunk toward their common mean by a beta
    prior, whose strength is fitted to the hosts' rates by their moments; a host
    fails if its shrunk rate exceeds `host_factor` times the mean, and its
    verdict is joined back to its messages. Messages without host have null there.
    """
    each = written(measured(documents, run).withColumn("fails", (F.col("words") > 0) & (F.col("repeated") >= least * F.col("words"))), "repetition")
    hosts = each.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("fails").alias("f"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("f") / F.sum("n"), F.sum(F.col("f") * F.col("f") / F.col("n")), F.count(F.lit(1))).first()
    alpha, beta, mean = beta_prior(*total) if total.n else (1.0, 1.0, 0.5)
    rate = (F.col("f") + alpha) / (F.col("n") + alpha + beta)
    judged = hosts.select("host", F.col("n").alias("host_documents"), rate.alias("host_rate"), (rate > host_factor * mean).alias("host_fails"))
    return attach(each, judged, ["host"], "left").select("doc_id", "host", "words", "repeated", "share", "fails", "host_documents", "host_rate", "host_fails")


def beta_prior(n: float, f: float, mean: float, squares: float, hosts: int) -> tuple[float, float, float]:
    """(alpha, beta, mean) from the totals of messages and failures, and the sum of
    f^2 / n over the hosts. Without spread among hosts the prior is as strong as all messages."""
    mean = min(max(mean, 1e-9), 1 - 1e-9)
    spread = max(squares / n - mean * mean, 0.0)
    chance = mean * (1 - mean) * hosts / n
    between = spread - chance
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), n) if between > 0 else n
    return mean * strength, (1 - mean) * strength, mean
