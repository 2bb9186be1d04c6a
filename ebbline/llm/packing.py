"""Packing token sequences into fixed windows by online sum-of-squares."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The byte-level BPE of a rank file; a special token's text gives its id, as in the JSON form of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(enc, text: str, end_id: int) -> np.ndarray:
    special = any(token in text for token in SPECIAL)
    ids = enc.encode(text, allowed_special="all") if special else enc.encode_ordinary(text)
    ids.append(end_id)
    return np.array(ids, dtype="<u4")


class Levels:
    """Open windows by fill level, and the counts whose squares are kept small.

    count[h] is the number of open windows filled to h. Putting s tokens on a window at level h
    changes the sum of squares by 2 * (count[h + s] - count[h]) + 2; a full window is not counted.
    """

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple, size: int) -> list | None:
        """Puts a piece into the level of least cost, the fullest of equals; gives the window if it is full now."""
        w, count = self.window, self.count
        levels = np.flatnonzero(count[1 : w - size + 1]) + 1
        best, least = 0, 2 * int(count[size]) + 1
        if len(levels):
            after = count[levels + size]
            cost = np.where(levels + size == w, 1, 2 * after + 2) - 2 * count[levels]
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= least:
                best = int(levels[k])
        if best:
            pieces = self.open[best].pop()
            count[best] -= 1
        else:
            pieces = []
        pieces.append((*piece, best))
        if best + size == w:
            return pieces
        count[best + size] += 1
        self.open.setdefault(best + size, []).append(pieces)
        return None

    def drain(self) -> Iterator[list]:
        """Closes what is left without padding, moving as little as it can.

        A window filled to a power of two stays as it is. Two windows whose levels add up to a full one are put together whole. Of the rest the
        fullest keep their pieces, in place, and what they lack is cut from the emptiest ones; the last remainder is cut into powers of two.
        """
        w = self.window
        for level in sorted(self.open):
            if level & (level - 1) == 0:
                yield from self.open.pop(level)
        for level in sorted(self.open, reverse=True):
            other = self.open.get(w - level)
            while level > w - level and other and self.open[level]:
                base, more = self.open[level].pop(), other.pop()
                yield base + [(doc, start, ids, n, level + offset) for doc, start, ids, n, offset in more]
        rest = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        first, last, spare = 0, len(rest), []

        def cut(size: int, at: int) -> Iterator[tuple]:
            """Pieces of `size` tokens in all, to lie from `at` on, from the emptiest windows that are left."""
            nonlocal last
            while size:
                if not spare:
                    last -= 1
                    spare.extend(p[:-1] for p in reversed(rest[last][1]))
                doc, start, ids, n = spare.pop()
                if len(ids) > size:
                    spare.append((doc, start + size, ids[size:], n))
                    ids = ids[:size]
                yield doc, start, ids, n, at
                size, at = size - len(ids), at + len(ids)

        held = sum(level for level, _ in rest)
        while first < last:
            level, pieces = rest[first]
            # what stands between this window and the last one, the spare pieces included, must fill it
            behind = held - level
            if behind < w - level:
                break
            first, held = first + 1, behind - (w - level)
            yield pieces + list(cut(w - level, level))
        total = held
        for size in [w] * (total // w) + [1 << b for b in range(w.bit_length(), -1, -1) if (total % w) >> b & 1]:
            yield list(cut(size, 0))


def pack(docs: DataFrame, ranks_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of all documents (doc_id, text), laid into windows of at most `window` tokens.

    One row per piece: its document's id, place and count of tokens, the ids as little-endian
    32-bit values, the window's id and the offset there. A document longer than a window is cut
    into full windows and a rest; the rests are placed one after another (sum-of-squares). Each task
    packs its own partition: there is no shuffle, state is one level array and the windows still
    open, and a task that runs again gives the same windows. Window ids carry the task's partition.
    Windows still open at a task's end are closed as drain() says: nearly all tokens stay where sum-of-squares put them.

    A very long text is cut into full windows as it is encoded, whole. Null texts are empty: they hold the end id alone. A null doc_id stays null. Repeated rows are
    packed once each. No rows give no windows. Other columns are ignored.
    """
    window, end_id = int(window), int(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, levels = encoder(ranks_path), Levels(window)
        base, made, rows, held = TaskContext.get().partitionId() << 40, 0, [], 0

        def emit(pieces):
            nonlocal made, held
            for doc, start, ids, n, offset in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), n, base + made, offset))
                held += 4 * len(ids)
            made += 1

        def flush():
            nonlocal held
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            held = 0
            return out

        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = seen.get(text)
                if ids is None:
                    ids = seen[text] = encode(enc, text, end_id)
                n = len(ids)
                cut = n - n % window
                for at in range(0, cut, window):
                    emit([(doc, at, ids[at : at + window], n, 0)])
                if cut < n and (full := levels.place((doc, cut, ids[cut:], n), n - cut)):
                    emit(full)
                if held >= 16 << 20:
                    yield flush()
        for pieces in levels.drain():
            emit(pieces)
        yield flush()

    return small_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, PIECES)
