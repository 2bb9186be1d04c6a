"""Exact top-k inner products over buckets of vectors of like length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block long, n int, most double, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score long"
#: From this local cosine threshold a bucket is cut by coordinates, below it by length.
COORDINATES_FROM = 0.4
#: Bytes of vectors in a bucket; streams that a block of queries is dealt to, each over its part of the buckets.
BUCKET, LANES = 1 << 20, 4


def as_integers(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, or null where a component is null or not finite."""
    wide = vector.cast("array<double>")
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def norm_blocks(vectors: DataFrame, dims: int, rows: int, kind: str) -> DataFrame:
    """vectors (vec_id, v), sorted by falling length over all tasks and cut into blocks of at most `rows`, padded with zeros to `dims`, as numbers of a numpy kind."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    ranged = vectors.select("vec_id", "v", F.sqrt(squares).alias("norm")).repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, made, base = [], [], 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal made
            m = np.zeros((len(held), dims), dtype=kind)
            for k, v in enumerate(held):
                m[k, : len(v)] = v
            most = float(np.sqrt((m.astype("f8") ** 2).sum(1).max()))
            out = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([most], pa.float64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["block", "n", "most", "ids", "vectors"])
            made += 1
            ids.clear()
            held.clear()
            return out

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(vec_id)
                held.append(v.values.to_numpy())
                if len(ids) == rows:
                    yield flush()
        if ids:
            yield flush()

    return ranged.select("vec_id", "v").mapInArrow(run, BLOCK)


def block_of(ids: bytes, vectors: bytes, dims: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), dims).astype("i8")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where it is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[-1])
    if largest < 2.0**52:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return a @ b.T


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    place = np.arange(len(ids))
    if len(ids) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def search_bucket(q_ids, q, theta, c_ids, c, k: int):
    """(query id, ids, scores) of each query's best in one bucket, none below its threshold theta.

    The bucket is sorted by falling length. A query's threshold over its own length and the
    bucket's largest gives a local cosine threshold: over 1, the bucket is passed by; if high, a
    candidate's direction must lie within bounds in the query's largest coordinates; else only as
    many candidates are taken as are long enough. All products of the rest are then verified.
    """
    slack = 1e-9
    norm_c, norm_q = np.sqrt((c.astype("f8") ** 2).sum(1)), np.sqrt((q.astype("f8") ** 2).sum(1))
    need = np.where(theta > 0, theta / np.maximum(norm_q, 1e-300), -np.inf)  # of a candidate's length
    local = need / max(norm_c[0], 1e-300)
    unit = None
    by_length = np.flatnonzero(local < COORDINATES_FROM)
    for at in range(0, len(by_length), 256):
        some = by_length[at : at + 256]
        long_enough = int(np.searchsorted(-norm_c, -need[some].min() * (1 - slack), side="right"))
        scores = products(q[some], c[:long_enough])
        for row, j in enumerate(some):
            ok = np.flatnonzero((scores[row] >= theta[j]) & (c_ids[:long_enough] != q_ids[j]))
            top = ok[best(c_ids[ok], scores[row][ok], k)]
            yield q_ids[j], c_ids[top], scores[row][top]
    for j in np.flatnonzero((local >= COORDINATES_FROM) & (local <= 1 + slack)):
        if unit is None:
            unit = np.ascontiguousarray((c / np.maximum(norm_c, 1e-300)[:, None]).T)
        direction, t = q[j] / norm_q[j], min(local[j], 1.0)
        ok = np.arange(int(np.searchsorted(-norm_c, -need[j] * (1 - slack), side="right")))
        for f in np.argsort(-np.abs(direction))[:3]:
            x = direction[f]
            reach = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - t * t)) + 1e-7
            # with a cosine of t or more, the coordinate lies within `reach` of x * t, or beyond it on x's side as far as x allows
            low, high = x * t - reach, x * t + reach
            if abs(x) >= t:
                low, high = (low, 1.0) if x > 0 else (-1.0, high)
            ok = ok[(unit[f][ok] >= low) & (unit[f][ok] <= high)]
        scores = products(q[j : j + 1], c[ok])[0]
        fits = (scores >= theta[j]) & (c_ids[ok] != q_ids[j])
        ok, scores = ok[fits], scores[fits]
        top = best(c_ids[ok], scores, k)
        yield q_ids[j], c_ids[ok[top]], scores[top]


class Running:
    """The best k of each query of a block so far, and the score that a further candidate must reach."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q.astype("f8") ** 2).sum(1))
        self.row = {int(x): j for j, x in enumerate(ids)}
        self.found = [np.zeros((0, 2), "i8") for _ in ids]
        self.theta = np.full(len(ids), -np.inf)

    def meet(self, most: float, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Takes a bucket into account; queries that its longest vector can't help pass it by."""
        live = np.flatnonzero((self.theta <= 0) | (most * self.norm * (1 + 1e-9) >= self.theta))
        if not len(live):
            return
        for query, ids, scores in search_bucket(self.ids[live], self.q[live], self.theta[live], c_ids, c, self.k):
            j = self.row[int(query)]
            both = np.concatenate([self.found[j], np.column_stack([ids, scores])])
            self.found[j] = both[best(both[:, 0], both[:, 1], self.k)]
            if len(self.found[j]) == self.k:
                self.theta[j] = max(self.theta[j], float(self.found[j][-1, 1]))

    def rows(self) -> pa.RecordBatch:
        n = [len(f) for f in self.found]
        every = np.concatenate(self.found) if n else np.zeros((0, 2), "i8")
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n), pa.int64()), pa.array(every[:, 0], pa.int64()), pa.array(every[:, 1], pa.int64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, bucket: int | None = None, query_block: int | None = None, lanes: int = LANES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query among all vectors but its own.

    vectors and queries: (vec_id, v) with whole components; null vectors take no part, short
    ones count as padded with zeros, and rows with a query's own vec_id aren't its candidates. A
    query id that comes twice is asked once, with its smallest vector. Repeated candidates each
    count. Ties go to the smaller vec_id; no vectors or no queries give no rows; other columns are ignored.

    Vectors are sorted by length and cut into buckets of BUCKET bytes (`bucket` vectors), queries likewise into blocks of a quarter of that. The bucket of
    the longest vectors, which is bounded in bytes and so is broadcast, gives each query a first threshold; a block of queries then
    meets the other buckets that its thresholds don't rule out, as streams from the longest down: each of `lanes` streams has
    every so-manieth bucket, keeps the best k of each query, and so raises thresholds as it goes on. What a stream gives is k rows a query, whatever
    it met. Components are stored in the narrowest whole numbers that hold all of them.
    """
    vectors = vectors.filter("v IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "v")
    queries = queries.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    largest = lambda df: df.select(F.size("v").alias("n"), F.array_max(F.transform("v", lambda x: F.abs(x))).alias("x"))
    dims, size = largest(vectors).unionByName(largest(queries)).agg(F.max("n"), F.max("x")).first()
    dims, size = max(1, dims or 1), size or 0
    kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<i8"
    fit = max(1, BUCKET // (dims * int(kind[-1])))
    from .common import written

    buckets = written(norm_blocks(vectors, dims, bucket or fit, kind), "topk-buckets")
    heads = buckets.select("block", "most")
    first = heads.agg(F.min("block").alias("block"))
    longest = buckets.join(F.broadcast(first), "block").select(F.col("ids").alias("c_ids"), F.col("vectors").alias("c"))

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            theta, floor = [], []
            for ids, vectors, c_ids, c in zip(*(batch.column(n) for n in ("ids", "vectors", "c_ids", "c")), strict=True):
                (qi, q), (ci, cv) = block_of(ids.as_py(), vectors.as_py(), dims, kind), block_of(c_ids.as_py(), c.as_py(), dims, kind)
                t = np.full(len(qi), -np.inf)
                for at in range(0, len(qi), 256):
                    s = products(q[at : at + 256], cv)
                    for r in range(len(s)):
                        own = s[r][ci != qi[at + r]]
                        if len(own) >= k:
                            t[at + r] = np.partition(own, len(own) - k)[len(own) - k]
                n = np.sqrt((q.astype("f8") ** 2).sum(1))
                theta.append(t.astype("<f8").tobytes())
                floor.append(float(np.where(t > 0, t / np.maximum(n, 1e-300), -np.inf).min()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ids"), batch.column("vectors"), pa.array(theta, pa.binary()), pa.array(floor, pa.float64())], ["block", "ids", "vectors", "theta", "floor"])

    asked = norm_blocks(queries, dims, query_block or max(1, fit // 4), kind)
    seeded = asked.join(F.broadcast(longest)).mapInArrow(thresholds, "block long, ids binary, vectors binary, theta binary, floor double")
    seeded = written(seeded, "topk-queries")
    every = heads.agg(F.sort_array(F.collect_list(F.struct("block", "most"))).alias("heads"))
    reached = F.filter(F.transform("heads", lambda h, i: F.struct(h["block"].alias("block"), h["most"].alias("most"), (i % lanes).alias("lane"))), lambda h: h["most"] * (1 + 1e-9) >= F.col("floor"))
    pairs = seeded.select(F.col("block").alias("asked"), "floor").join(F.broadcast(every)).select("asked", F.explode(reached).alias("h")).select("asked", "h.*")
    met = pairs.join(buckets.select("block", "ids", "vectors"), "block")
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    start = seeded.select(F.col("block").alias("asked"), lane, F.lit(-1).cast("long").alias("block"), F.lit(0.0).alias("most"), "ids", "vectors", "theta")
    stream = start.unionByName(met, allowMissingColumns=True).repartition("asked", "lane").sortWithinPartitions("asked", "lane", "block")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = None
        for batch in batches:
            for block, most, ids, vectors, theta in zip(*(batch.column(n) for n in ("block", "most", "ids", "vectors", "theta")), strict=True):
                ids, v = block_of(ids.as_py(), vectors.as_py(), dims, kind)
                if block.as_py() < 0:
                    if running is not None:
                        yield running.rows()
                    running = Running(ids, v, k)
                    running.theta = np.frombuffer(theta.as_py(), "<f8").copy()
                else:
                    running.meet(most.as_py(), ids, v)
        if running is not None:
            yield running.rows()

    found = stream.select("block", "most", "ids", "vectors", "theta").mapInArrow(verify, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
