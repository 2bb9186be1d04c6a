"""Repeated passages: run-length Burrows-Wheeler indexes over fragments dealt by content."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped_after, written
from .minhash import mix64

U = np.uint64
#: Bytes of the content key's grams; windows in one fragment; bytes of text handled at once; bytes in one index.
GRAM, MOST_WINDOWS, PIECE, INDEX = 32, 256, 1 << 20, 2 << 20
#: How many levels of finer keys there are below the first.
LEVELS = 3


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes (a power of two) from each place on, by doubling."""
    h, width, c = mix64(data.astype(U) + U(1)), 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * U(c) + h[width:]
        width, c = 2 * width, (c * c + 2) % 2**64
    return mix64(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = h
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def close_keys(grams: np.ndarray, key: np.ndarray, reach: int) -> np.ndarray:
    """Keys whose gram stands at two places less than `reach` apart: a fragment with both may hold one window twice."""
    width = len(grams) - len(key) + 1
    edge = np.zeros(width - 1, U)
    # a place's gram is the least of some window over it if the largest key of those windows is the gram
    place = np.flatnonzero(~sliding_min(~np.concatenate([edge, key, edge]), width) == grams)
    order = np.argsort(grams[place], kind="stable")
    value, at = grams[place][order], place[order]
    return np.unique(value[1:][(value[1:] == value[:-1]) & (at[1:] - at[:-1] < reach)])


def finer_keys(grams: np.ndarray, place: np.ndarray, length: int, level: int) -> np.ndarray:
    """Keys of the windows that start at `place`: of the least gram hashes of their halves (level 1), their quarters (2), or of all their bytes (3)."""
    if level == LEVELS:
        at = [*range(0, length - GRAM, GRAM), length - GRAM]
        least = grams
    else:
        part = length // (1 << level)
        at = [*range(0, length - part - part // 2, part), length - part]
        least = sliding_min(grams, part - GRAM + 1)
    key = np.full(len(place), level, U)
    for k in at:
        key = mix64(key * U(0xD6E8FEB86659FD93) + least[place + k])
    return key


def fragments(data: np.ndarray, ends: list[int], length: int, hot: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, close) of runs of neighbouring windows of `length` bytes that share a key, in joined texts that end at `ends`.

    A window's key is the least gram hash in it (or that of `level`); one among `hot` (sorted), which very many
    texts have, gives way to a key of the next level, up to one of all the window's bytes. All follow from the window's bytes alone, so equal windows have
    equal keys, wherever they are. Each window inside one text is in one fragment: the bytes from `start` on, length + windows - 1 of them.
    """
    none = np.zeros(0, "i8")
    if len(data) < length:
        return none.astype(U), none, none, none.astype(bool)
    grams = gram_hashes(data)
    key = sliding_min(grams, length - GRAM + 1)
    close = np.isin(key, near) if len(near := close_keys(grams, key, length + MOST_WINDOWS)) else np.zeros(len(key), bool)
    if level:
        key = finer_keys(grams, np.arange(len(key)), length, level)
    place = np.arange(len(key))
    for finer in range(level + 1, LEVELS + 1) if len(hot) else ():
        place = place[hot[np.minimum(np.searchsorted(hot, key[place]), len(hot) - 1)] == key[place]]
        if not len(place):
            break
        key[place] = finer_keys(grams, place, length, finer)
    inside = np.ones(len(key), bool)
    for end in ends:
        inside[max(0, end - length + 1) : end] = False
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | ~inside[:-1]])
    head = np.flatnonzero(fresh & inside)
    if not len(head):
        return none.astype(U), none, none, none.astype(bool)
    stop = np.flatnonzero(np.concatenate([inside[:-1] & (fresh[1:] | ~inside[1:]), [inside[-1]]])) + 1
    size = stop - head
    parts = -(-size // MOST_WINDOWS)
    within = MOST_WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    start = np.repeat(head, parts) + within
    return key[start], start, np.minimum(np.repeat(size, parts) - within, MOST_WINDOWS), close[start]


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of about PIECE bytes of (place, hash, offset, bytes): texts of `length` bytes or more, the longest in parts that overlap by length - 1."""
    out, held = [], 0
    for batch in batches:
        for place, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for low in range(0, len(raw) - length + 1, PIECE):
                out.append((place, name, low, raw[low : low + PIECE + length - 1]))
                held += len(out[-1][3])
                if held >= PIECE:
                    yield out
                    out, held = [], 0
    if out:
        yield out


FRAGMENTS = "place long, hash long, at long, windows int, key long, close boolean, twice boolean"


def cut(docs: DataFrame, length: int, hot: np.ndarray, fold: bool = True) -> DataFrame:
    """The fragments of docs (place, hash, text): offset, count of windows, key, whether one may repeat in itself, and whether it was found twice.

    Of fragments with the same bytes that a task sees in one stretch, one stands for all where keys meet; the rest have no
    key, and all are known to be found twice: their bytes are compared. So a passage that very many texts share meets its key a few times from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in pieces(batches, length):
            held.append(fragments_of(piece))
            size += len(held[-1][2])
            if size >= 200_000:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    def fragments_of(piece):
        import xxhash

        raw = b"".join(x[3] for x in piece)
        ends = np.cumsum([len(x[3]) for x in piece])
        key, start, windows, close = fragments(np.frombuffer(raw, np.uint8), ends.tolist(), length, hot)
        content = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + windows + length - 1).tolist(), strict=True)], U) if fold else np.zeros(len(key), U)
        row = np.searchsorted(ends, start, side="right")
        first, low = (ends - [len(x[3]) for x in piece]), np.array([x[2] for x in piece])
        return np.array([x[0] for x in piece])[row], np.array([x[1] for x in piece])[row], start - first[row] + low[row], windows, key, close, content, start, raw

    def told(held) -> pa.RecordBatch:
        place, name, at, windows, key, close, content = (np.concatenate([h[k] for h in held]) for k in range(7))
        start = np.concatenate([h[7] + base for h, base in zip(held, np.cumsum([0, *[len(h[8]) for h in held[:-1]]]), strict=True)])
        first, twice = np.ones(len(key), bool), np.zeros(len(key), bool)
        if fold and len(key):
            raw = memoryview(b"".join(h[8] for h in held))
            order = np.lexsort((content, key))
            k, c = key[order], content[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            again = np.flatnonzero(~new)
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[again]]
            size = windows + length - 1
            for i, j in zip(order[again].tolist(), lead.tolist(), strict=True):
                if size[i] == size[j] and raw[start[i] : start[i] + size[i]] == raw[start[j] : start[j] + size[j]]:
                    first[i], twice[i], twice[j] = False, True, True
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(name, pa.int64()), pa.array(at, pa.int64()), pa.array(windows, pa.int32()), pa.array(key.view("i8"), mask=~first), pa.array(close), pa.array(twice)], ["place", "hash", "at", "windows", "key", "close", "twice"])

    return docs.select("place", "hash", "text").mapInArrow(run, FRAGMENTS)


def hot_keys(docs: DataFrame, length: int, sampled: int = 64, share: float = 0.002) -> np.ndarray:
    """Keys, of all levels, that over `share` of the texts of a sample have: only how work is dealt depends on them, never what is found.

    There are at most as many as a text has keys, in the mean, over `share`: a number that doesn't grow with the table.
    """
    some = docs.filter(F.pmod(F.xxhash64("place"), F.lit(sampled)) == 0)
    least, hot = max(50, int(some.count() * share)), np.zeros(0, U)
    for _ in range(LEVELS):
        seen = cut(some, length, hot).filter("key IS NOT NULL").groupBy("key").agg(F.count_distinct("place").alias("n"))
        more = np.array([r["key"] for r in seen.filter(F.col("n") >= least).select("key").collect()], "i8").view(U)
        more = np.setdiff1d(more, hot)
        if not len(more):
            break
        hot = np.union1d(hot, more)
    return hot


def sorted_suffixes(text: np.ndarray, deep: int = 1024) -> np.ndarray:
    """The suffix array, sorted to a depth of `deep` bytes or more: the sorted depth doubles, and only suffixes not yet told apart are sorted again.

    Keys carry the place in their low bits, so that plain numbers are sorted, which is much faster than sorting places by keys.
    """
    n = len(text)
    if not n:
        return np.zeros(0, "i8")
    bits = n.bit_length()
    depth = (64 - bits) // 8
    padded = np.concatenate([text, np.zeros(depth, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for k in range(depth):
        key = (key << U(8)) | padded[k : k + n]
    key = np.sort((key << U(bits)) | np.arange(n, dtype=U))
    order = (key & U((1 << bits) - 1)).astype("i8")
    key >>= U(bits)
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, "i8")
    while True:
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = first
        open_ = np.flatnonzero(~head | ~np.append(head[1:], True))
        if not len(open_) or depth >= deep:
            return order
        at, group = order[open_], np.cumsum(head[open_]) - 1
        beyond = at + depth
        after = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        small = max(1, len(open_).bit_length())
        if 2 * small + bits + 1 <= 64:
            key = np.sort((group.astype(U) << U(small + bits + 1)) | (after.astype(U) << U(small)) | np.arange(len(open_), dtype=U))
            moved = (key & U((1 << small) - 1)).astype("i8")
        else:
            moved = np.lexsort((after, group))
        order[open_] = at[moved]
        group, after = group[moved], after[moved]
        head[open_] = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        depth *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes from each pair of places on, up to `most`, eight at a time."""
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    out, live = np.zeros(len(a), "i8"), np.arange(len(a))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = 0
    while len(live) and at < most:
        same = eight[a[live] + at] == eight[b[live] + at]
        n = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        out[live] += n
        live = live[n == 8]
        at += 8
    return np.minimum(out, most)


@dataclass(frozen=True)
class RunLengthIndex:
    """The Burrows-Wheeler transform of joined parts (a separator after each) in runs of one letter, with the text sampled at the ends of runs alone.

    letters, lengths: the runs. head, tail: where in the text the first and the last suffix of each run start; head_match,
    tail_match: how far these agree with the suffix before the run, and with the one after it. ends: where parts end. repeated: whether a part stands for
    two or more equal ones, whose suffixes would lie beside its own in the same runs.
    """

    letters: np.ndarray
    lengths: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    head_match: np.ndarray
    tail_match: np.ndarray
    ends: np.ndarray
    repeated: np.ndarray

    @classmethod
    def of(cls, parts: list[bytes], most: int, repeated: list[bool] | None = None) -> RunLengthIndex:
        """The index of distinct parts; matches are told apart up to `most` bytes. The suffixes' order is needed here alone."""
        text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)  # which no byte of UTF-8 is
        n = len(text)
        suffix = sorted_suffixes(text, most)
        letter = text[suffix - 1].astype("i2")
        letter[suffix == 0] = -1  # what precedes the whole text is like no letter
        change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        first, last = np.concatenate([[0], change]), np.concatenate([change, [n]]) - 1
        first, last = (first, last) if n else (first[:0], last[:0])
        above, below = np.concatenate([[-1], suffix])[first], np.concatenate([suffix, [-1]])[last + 1]
        match = [np.zeros(len(first), "i8") for _ in range(2)]
        for out, own, other in ((match[0], suffix[first], above), (match[1], suffix[last], below)):
            has = other >= 0
            out[has] = common_prefix(text, own[has], other[has], most)
        ends = np.cumsum([len(p) + 1 for p in parts], dtype="i8") - 1
        return cls(letter[first], last - first + 1, suffix[first], suffix[last], *match, ends, np.array(repeated if repeated is not None else [False] * len(parts), bool))

    def matching_statistics(self) -> np.ndarray:
        """For each place of the joined parts, how far it matches some other place, up to the part's end.

        Inside a run, a suffix and its neighbour are preceded by the same letter, so the match one place to the left
        is longer by one; only at a run's head (for the smaller neighbour) and tail (for the larger) can matches begin anew. So statistics
        stream along the text from the samples: each place not sampled matches one byte less than the place before it.
        """
        n = int(self.lengths.sum())
        best = np.zeros(n, "i8")
        for sampled, match in ((self.head, self.head_match), (self.tail, self.tail_match)):
            reach = np.full(n, -1, "i8")
            reach[sampled] = sampled + match  # where the match ends; it only moves to the right
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(n))
        size = np.diff(np.concatenate([[-1], self.ends]))
        left = np.repeat(self.ends, size) - np.arange(n)
        return np.where(np.repeat(self.repeated, size), left, np.minimum(best, left))

    def marks(self, length: int) -> list[np.ndarray]:
        """Of each part, the starts of its windows of `length` bytes that are found again."""
        best, out, start = self.matching_statistics(), [], 0
        for end in self.ends:
            out.append(np.flatnonzero(best[start:end] >= length))
            start = end + 1
        return out


def runs_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """[begin, end) of the bytes that windows from sorted `starts` on cover."""
    if not len(starts):
        return []
    head = np.flatnonzero(np.concatenate([[True], np.diff(starts) > length]))
    return list(zip(starts[head].tolist(), (np.append(starts[head[1:] - 1], starts[-1]) + length).tolist(), strict=True))


MARKED = "place long, hash long, spans array<struct<begin:long,end:long>>"


def deep_fragments(rows: DataFrame, told: DataFrame, length: int, most: int) -> DataFrame:
    """told, with fragments of slots that hold over `most` bytes cut again by finer keys, level by level, until none holds more.

    Fragments that are alone in a finer slot go. The finest key is of all bytes of a window, so that such a slot holds one content.
    """
    out = None
    for level in range(1, LEVELS + 1):
        large = told.groupBy("slot").agg(F.sum(F.col("windows") + length - 1).alias("bytes")).filter(F.col("bytes") > most).select("slot")
        large = written(large, "repeat-large")
        if large.isEmpty():
            break
        kept = told.join(large, "slot", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        fetched = _fetched(rows, told.join(large, "slot", "left_semi"), length)
        finer = fetched.mapInArrow(lambda batches, level=level: _finer(batches, length, level), "place long, hash long, at long, windows int, slot long, close boolean, twice boolean")
        told = written(_met(finer), f"repeat-level-{level}")
    return told if out is None else out.unionByName(told)


def _met(cuts: DataFrame) -> DataFrame:
    """The fragments that share their slot, or may repeat in themselves."""
    n = F.count("*").over(Window.partitionBy("slot"))
    return cuts.withColumn("n", n).filter("n > 1 OR (close AND NOT twice)").drop("n")


def _fetched(rows: DataFrame, told: DataFrame, length: int) -> DataFrame:
    """told with the bytes of each fragment. Equal rows have the same fragments: each is wanted once, as found twice, and a task sends it once."""
    again = F.bool_or("twice") | (F.count("*") > 1)
    once = told.groupBy("place", "hash", "at", "windows", "slot").agg(F.bool_or("close").alias("close"), again.alias("twice"))
    by_text = once.groupBy("place", "hash").agg(F.collect_list(F.struct("at", "windows", "slot", "close", "twice")).alias("wanted"))  # of one text
    met = rows.select("place", "hash", "text").join(written(by_text, "repeat-wanted"), ["place", "hash"])
    return met.mapInArrow(lambda batches: _fetch(batches, length), FETCHED)


def remove_repeats(docs: DataFrame, *, length: int = 200, index_bytes: int = INDEX, fold: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans (removed, [begin, end) in bytes of UTF-8) and kept (the other bytes) of every row of docs (doc_id, text).

    A byte goes if a string of `length` bytes over it starts at another place too, in the same
    text or another row's. Texts are cut into fragments of windows under a content key, so that equal
    windows meet. Keys only deal fragments out: one that is alone under its key, and can't repeat in itself, is
    dropped; fragments whose bytes a task has seen twice in one stretch are repeats (`fold`; without it, all are left to the indexes). All others are
    brought together, with their bytes, in run-length indexes of bounded size, which tell the windows that they
    share. Slots of over `index_bytes` are dealt again by finer keys.

    Null texts are empty; texts shorter than `length` stay whole; equal rows are copies of
    one another, and lose all if they are long enough. A null doc_id stays null. No rows give no rows. Other columns are ignored.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length must be {4 * GRAM} or more")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), F.xxhash64("text").alias("hash"), "text")
    with dropped_after(docs.sparkSession):
        # a fragment without a key is found twice and has another to stand for it: it meets nothing, and its slot only deals it out
        cuts = cut(rows, length, hot_keys(rows, length), fold).withColumn("slot", F.coalesce("key", F.xxhash64("place", "at")))
        n = F.count("*").over(Window.partitionBy("slot"))
        told = cuts.withColumn("meets", F.col("key").isNotNull() & ((n > 1) | (F.col("close") & ~F.col("twice")))).filter("meets OR twice")
        # equal rows have the same fragments, which are found again in each other: one stands for all of them
        again = F.bool_or("twice") | (F.count("*") > 1)
        told = written(told.groupBy("place", "hash", "at", "windows", "slot").agg(F.bool_or("close").alias("close"), again.alias("twice"), F.bool_or("meets").alias("meets")), "repeat-fragments")
        deep = deep_fragments(rows, told.filter("meets").drop("meets"), length, index_bytes)
        total = deep.agg(F.sum(F.col("windows") + length - 1)).first()[0] or 0
        fetched = _fetched(rows, deep, length).withColumn("bucket", F.pmod(F.xxhash64("slot"), F.lit(max(8, total // index_bytes + 1))))
        found = fetched.groupBy("bucket").applyInArrow(lambda t: _index(t, length), MARKED)
        whole = told.filter("twice").select("place", "hash", F.struct(F.col("at").alias("begin"), (F.col("at") + F.col("windows") + length - 1).alias("end")).alias("span"))
        spans = whole.unionByName(found.select("place", "hash", F.explode("spans").alias("span"))).groupBy("place", "hash").agg(F.collect_set("span").alias("spans"))
        spans = written(spans, "repeat-spans", outer=True)
    return rows.join(spans, ["place", "hash"], "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


#: Texts that a task remembers to have sent; those that it forgets, it may send again, which changes nothing.
KNOWN = 1_000_000
FETCHED = "place long, hash long, at long, slot long, close boolean, twice boolean, part binary"


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in FETCHED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    sent: set[tuple[int, int]] = set()
    for batch in batches:
        rows, held = [], 0
        for place, name, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if (place, name) in sent:  # an equal row
                continue
            if len(sent) >= KNOWN:
                sent.clear()
            sent.add((place, name))
            raw = text.as_py().encode("utf-8", "surrogatepass")
            for w in wanted.as_py():
                part = raw[w["at"] : w["at"] + w["windows"] + length - 1]
                rows.append((place, name, w["at"], w["slot"], w["close"], w["twice"], part))
                held += len(part)
            if held >= 4 * PIECE:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)


def _finer(batches: Iterator[pa.RecordBatch], length: int, level: int) -> Iterator[pa.RecordBatch]:
    """The fragments of fetched parts under the keys of a level; one found twice is so in all its windows."""
    for batch in batches:
        parts = batch.column("part").to_pylist()
        ends = np.cumsum([len(p) for p in parts])
        key, start, windows, _ = fragments(np.frombuffer(b"".join(parts), np.uint8), ends.tolist(), length, np.zeros(0, U), level)
        row = np.searchsorted(ends, start, side="right")
        own = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False))[row] for c in ("place", "hash", "at", "close", "twice")]
        at = own[2] + start - (ends - [len(p) for p in parts])[row]
        yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(at, pa.int64()), pa.array(windows, pa.int32()), pa.array(key.view("i8")), pa.array(own[3], pa.bool_()), pa.array(own[4], pa.bool_())], ["place", "hash", "at", "windows", "slot", "close", "twice"])


def _index(table: pa.Table, length: int) -> pa.Table:
    """The repeated spans of a bucket's fragments. Each content is in its index once; one alone in its slot matches its equals at most, and needs no sorting."""
    place, name, at, slot, close, twice, parts = (table.column(c).to_pylist() for c in ("place", "hash", "at", "slot", "close", "twice", "part"))
    own: dict[bytes, list] = {}  # by content: its slot, how often it is found, whether it may repeat in itself
    for k, part in enumerate(parts):
        seen = own.setdefault(part, [slot[k], 0, False])
        seen[1], seen[2] = seen[1] + 1 + twice[k], seen[2] or close[k]
    held = Counter(s for s, _, _ in own.values())
    mixed = [p for p, (s, _, c) in own.items() if held[s] > 1 or c]
    index = RunLengthIndex.of(mixed, 2 * (length + MOST_WINDOWS) + 16, [own[p][1] > 1 for p in mixed])
    spans = {p: runs_of(starts, length) for p, starts in zip(mixed, index.marks(length), strict=True)}
    out = []
    for k, part in enumerate(parts):
        runs = spans[part] if part in spans else [(0, len(part))] if own[part][1] > 1 else []
        if runs:
            out.append((place[k], name[k], [{"begin": at[k] + a, "end": at[k] + b} for a, b in runs]))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], span)], names=["place", "hash", "spans"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n, removed, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            raw, out, merged, here = text.as_py().encode("utf-8", "surrogatepass"), [], [], 0
            if spans.is_valid:
                begin, end = (np.asarray(spans.values.field(k)) for k in range(2))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                head = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                merged = list(zip(begin[head].tolist(), end[np.append(head[1:] - 1, len(end) - 1)].tolist(), strict=True))
            for a, b in merged:
                out.append(raw[here:a])
                here = b
            out.append(raw[here:])
            n.append(len(raw))
            removed.append([{"begin": a, "end": b} for a, b in merged])
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])
