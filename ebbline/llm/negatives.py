"""Hard negatives of labelled vectors by a threshold algorithm over sorted lists of each dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .topk import best

#: Bytes of vectors in a block of candidates, anchors in a block of anchors, depth of the first step down the lists.
BLOCK, ANCHORS, STEP = 8 << 20, 256, 32
FOUND = "anchor_id long, positive_score long, vec_id long, score long"


def blocked(rows: DataFrame, dims: int, most: int, kind: str) -> DataFrame:
    """rows (vec_id, label, v, windows) of each partition, in their order, in blocks of at most `most`: (block, own: its distinct labels, ids, labels, vectors, sizes, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, base = [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal made
            m = np.zeros((len(held), dims), kind)
            for k, (_, _, v, _) in enumerate(held):
                m[k, : len(v)] = v
            labels = [h[1] for h in held]
            windows = [np.array(h[3] or [], "<i8") for h in held]
            cells = [np.array([h[0] for h in held], "<i8").tobytes(), np.array(labels, "<i8").tobytes(), m.tobytes(), np.array([len(w) for w in windows], "<i4").tobytes(), b"".join(w.tobytes() for w in windows)]
            out = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([sorted(set(labels))], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in cells]], ["block", "own", "ids", "labels", "vectors", "sizes", "windows"])
            made += 1
            held.clear()
            return out

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (v.values.to_numpy() for v in batch.column(2)), batch.column(3).to_pylist(), strict=True):
                held.append(row)
                if len(held) == most:
                    yield flush()
        if held:
            yield flush()

    return rows.select("vec_id", "label", "v", "windows").mapInArrow(run, "block long, own array<long>, ids binary, labels binary, vectors binary, sizes binary, windows binary")


class Lists:
    """A block of candidates with its rows in rising order of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype("i4").copy()

    def search(self, a: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k highest scores of each window (least and most, whole numbers) among the rows that fit, ties to the smaller id.

        Each dimension's list is read from the end that its sign in the anchor favours. What is met is scored at once by its whole vector. No
        row that isn't met yet can score above the threshold, which is the anchor's product with the lists' present values: once it is
        strictly below the kth score of each window, or below the window's least score, nothing better or equal is left. The depth doubles from step to step.
        """
        n = len(self.ids)
        none = np.zeros(0, "i8")
        found = [(none, none)] * len(windows)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, at, step = np.zeros(n, bool), 0, STEP
        a = a.astype("i8")
        while at < n:
            to = min(n, at + step) if len(up) or len(down) else n
            met = np.zeros(n, bool)
            if len(up) or len(down):
                met[self.order[up, n - to : n - at].ravel()] = True
                met[self.order[down, at:to].ravel()] = True
            else:
                met[:] = True  # no list tells anything apart: every score is 0
            new = np.flatnonzero(met & ~seen & fits)
            seen |= met
            scores = self.vectors[new].astype("i8") @ a
            for j, (least, most) in enumerate(windows):
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                ids, got = np.concatenate([found[j][0], self.ids[new[inside]]]), np.concatenate([found[j][1], scores[inside]])
                top = best(ids, got, k)
                found[j] = (ids[top], got[top])
            ends = np.concatenate([self.vectors[self.order[up, n - to], up], self.vectors[self.order[down, to - 1], down]]).astype("i8")
            threshold = int(ends @ np.concatenate([a[up], a[down]]))
            if all(threshold < least or (len(got) == k and threshold < got[-1]) for (least, _), (_, got) in zip(windows, found, strict=True)):
                break
            at, step = to, step * 2
        return found


def searched(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, dims: int, kind: str, k: int, same: bool, percent: tuple[int, int]) -> DataFrame:
    """The finds of each pair (asked, block): a block of candidates is read once and the anchors that it must answer pass by.

    same: the best of an anchor's own label; else, for each of its windows (scores of positives), the best of other labels that lie in it.
    """
    anchors = pairs.join(asked.select(F.col("block").alias("asked"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "vectors", "sizes", "windows")]), "asked").drop("asked").withColumn("kind", F.lit(1))
    stream = blocks.select("block", "ids", "labels", "vectors", F.lit(0).alias("kind")).unionByName(anchors, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    low, high = percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, raw = None, None
        read = lambda b, kind="<i8": np.frombuffer(b.as_py(), kind)
        for batch in batches:
            col = {name: batch.column(name) for name in batch.schema.names}
            for r in range(len(batch)):
                if col["kind"][r].as_py() == 0:
                    lists, raw = None, [col[c][r] for c in ("ids", "labels", "vectors")]
                    continue
                if lists is None:  # the lists are sorted once an anchor asks for them
                    lists = Lists(read(raw[0]), read(raw[1]), read(raw[2], kind).reshape(-1, dims))
                ids, labels, q = read(col["q_ids"][r]), read(col["q_labels"][r]), read(col["q_vectors"][r], kind).reshape(-1, dims)
                ends = np.concatenate([[0], np.cumsum(read(col["q_sizes"][r], "<i4"))])
                windows, out = read(col["q_windows"][r]), []
                for j in range(len(ids)):
                    fits = (lists.labels == labels[j]) if same else (lists.labels != labels[j])
                    if not fits.any():
                        continue
                    fits &= lists.ids != ids[j]
                    keys = [0] if same else [int(s) for s in windows[ends[j] : ends[j + 1]] if low * s <= high * s]
                    spans = [(-(1 << 62), 1 << 62)] if same else [(-(-low * s // 100), high * s // 100) for s in keys]
                    for key, (got, scores) in zip(keys, lists.search(q[j], fits, spans, k) if keys else [], strict=True):
                        out += [(int(ids[j]), key, int(x), int(s)) for x, s in zip(got, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["anchor_id", "positive_score", "vec_id", "score"])

    return stream.select("block", "kind", "ids", "labels", "vectors", "q_ids", "q_labels", "q_vectors", "q_sizes", "q_windows").mapInArrow(run, FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its positives, the hardest rows of other labels.

    vectors: (vec_id, label, v) with whole components. A row's score is its inner product with the anchor; higher scores come first, ties go to the smaller
    vec_id. An anchor's positives are the first `positives` other rows of its label; a positive's negatives the first `negatives` rows of other
    labels whose score is from percent[0] to percent[1] hundredths of the positive's (none if that is negative).

    Rows with a null vec_id, label or vector take no part; short vectors count as padded with zeros; other columns are ignored. Rows with the
    anchor's own vec_id aren't its candidates; an anchor's id that comes twice is asked once, with its smallest label and vector. Repeated candidates each count, so
    a positive or a negative may come several times. No rows, one label or no anchors give no rows.

    Candidates are sorted by label and cut into blocks of bounded bytes, so that a label of any size lies in as many blocks as it needs, and blocks of anchors pass by
    them twice: those of labels that an anchor block holds tell its positives, then all tell the negatives within its windows. A block sorts its rows by each
    dimension once and answers by the threshold algorithm (Lists.search); it gives a bounded number of rows an anchor, whose best are taken over all blocks. Components whose scores might leave 64 bits are an error.
    """
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v")
    n, dims, size = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    dims, size = max(1, dims or 1), size or 0
    if size * size * dims >= 1 << 63:
        raise ValueError("components are too large for scores of 64 bits")
    kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<i8"
    spark = vectors.sparkSession
    fit = max(1, min(BLOCK // (dims * int(kind[-1])), max(1024, -(-n // spark.sparkContext.defaultParallelism))))
    none = F.lit(None).cast("array<long>").alias("windows")
    blocks = written(blocked(rows.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").select("*", none), dims, fit, kind), "negatives-blocks")
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    asked = written(blocked(anchors.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").select("*", none), dims, ANCHORS, kind), "negatives-anchors")
    labels_of = lambda df, name: df.select(F.col("block").alias(name), F.explode("own").alias("label"))
    of_label = labels_of(asked, "asked").join(labels_of(blocks, "block"), "label").select("asked", "block").distinct()
    near = searched(of_label, asked, blocks, dims, kind, positives, True, percent)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = written(near, "negatives-positives")
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("windows"))  # at most `positives` an anchor
    widened = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "v", "windows")
    asked = written(blocked(widened.repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id"), dims, ANCHORS, kind), "negatives-windows")
    one = lambda df, name: df.select(F.col("block").alias(name), F.when(F.size("own") == 1, F.get("own", F.lit(0))).alias(f"{name}_only"))
    # a stated set of anchors against all rows, in blocks; not those that hold one and the same label
    every = one(asked, "asked").crossJoin(one(blocks, "block")).filter("asked_only IS NULL OR block_only IS NULL OR asked_only <> block_only").select("asked", "block")
    far = searched(every, asked, blocks, dims, kind, negatives, False, percent)
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
