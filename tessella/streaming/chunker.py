"""Content-defined chunking of streams that grow."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cdc import ChunkSizes, byte_table, candidates, cuts
from ..functions.digests import digest_bytes

OUT = "stream_id string, pos int, start long, end long, size long, chunk_id string"
STATE = "carry binary, start long, pos int, next_seq long, early binary, ended boolean"
_PART = struct.Struct("<qq?")


def _pack(parts: dict[int, tuple[bytes, bool]]) -> bytes:
    return b"".join(_PART.pack(seq, len(data), last) + data for seq, (data, last) in sorted(parts.items()))


def _unpack(held: bytes) -> dict[int, tuple[bytes, bool]]:
    out, at = {}, 0
    while at < len(held):
        seq, n, last = _PART.unpack_from(held, at)
        at += _PART.size
        out[seq] = (held[at : at + n], last)
        at += n
    return out


def chunk_stream(parts: DataFrame, sizes: ChunkSizes | None = None, algorithm: str = "sha256", table: str | None = None) -> DataFrame:
    """Chunks of streams as they grow. `parts` is a streaming DataFrame of stream_id, seq, data
    and last (whether the stream ends with this part); the parts of a stream are
    numbered from 0 without gaps.

    Parts may arrive in any order, in one batch or in many: what comes before its turn is
    kept until the parts before it are there, and what was taken in already (delivered
    again) is passed over. A cut depends only on the bytes since the one before it, so what
    is kept of a stream besides early parts are the bytes behind its last cut, at most
    the greatest chunk. Chunks come out as soon as they are certain; the rest of a stream
    does when all parts up to the last are there. The result is the same as that
    of chunking the whole stream at once, however it was cut into parts and
    whatever their order. A part without number or below 0, and one behind the last, is an error.

    Of a stream that has ended a few bytes are kept, by which parts delivered again are known."""
    sizes = sizes or ChunkSizes.of()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        numbers = byte_table(table)
        carry, start, pos, turn, early, ended = state.get if state.exists else (b"", 0, 0, 0, b"", False)
        waiting = _unpack(bytes(early))
        for b in batches:
            for seq, data, last in zip(b["seq"], b["data"], b["last"]):
                if pd.isna(seq) or seq < 0:
                    raise ValueError(f"a part of stream {key[0]!r} has no number")
                if seq >= turn and ended:
                    raise ValueError(f"part {seq} of stream {key[0]!r} comes behind its last one")
                if seq >= turn and seq not in waiting:
                    waiting[int(seq)] = (b"" if data is None else bytes(data), bool(last) if not pd.isna(last) else False)
        pieces = [bytes(carry)]
        while turn in waiting and not ended:
            data, ended = waiting.pop(turn)
            pieces.append(data)
            turn += 1
        if ended and waiting:
            raise ValueError(f"part {min(waiting)} of stream {key[0]!r} comes behind its last one")
        rows, at, data = [], 0, b"".join(pieces)
        if len(pieces) > 1:
            ends = cuts(len(data), candidates(data, sizes.discriminator, numbers) if not sizes.fixed else [], sizes)
            if ends and not ended:
                # The end of the data so far is no cut unless the greatest size or the hash calls for it.
                before = ends[-2] if len(ends) > 1 else 0
                full = ends[-1] - before >= sizes.max
                called = not sizes.fixed and ends[-1] - before >= sizes.first_test and ends[-1] in set(candidates(data[before:], sizes.discriminator, numbers) + before)
                if not (full or called):
                    ends.pop()
            for end in ends:
                rows.append((key[0], pos, start + at, start + end, end - at, digest_bytes(data[at:end], algorithm).hex()))
                pos, at = pos + 1, end
        state.update((data[at:], start + at, pos, turn, _pack(waiting), ended))
        if rows:
            yield pd.DataFrame(rows, columns=["stream_id", "pos", "start", "end", "size", "chunk_id"])

    return parts.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
