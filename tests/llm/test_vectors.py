"""Hard negatives and whitening against brute force."""

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import negatives, registry, whitening
from ebbline.llm.common import table


def _hard(rows, anchors, positives=5, negatives_=5, low=80, high=100):
    """rows: (vec_id, label, vector) without nulls; anchors: ids."""
    dims = max((len(v) for _, _, v in rows), default=0)
    pad = [(i, label, np.array([*v, *[0] * (dims - len(v))], "i8")) for i, label, v in rows]
    asked = {}
    for i, label, v in pad:
        if i in anchors:
            asked[i] = min(asked.get(i, (label, v.tolist())), (label, v.tolist()))
    out = Counter()
    for a, (label, q) in asked.items():
        scored = sorted((-int(v @ np.array(q)), i, of) for i, of, v in pad if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            for rank, (t, i, _) in enumerate(fits, 1):
                out[(a, p, rank, i, -s, -t)] += 1
    return out


def _frame(spark, rows, dims="array<long>"):
    return spark.createDataFrame(rows, f"vec_id long, label long, v {dims}, block long, score long, windows string")


def _found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_hard_negatives_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "STEP", 2)
    rng = np.random.default_rng(5)
    centre = rng.integers(-20, 20, (4, 6))
    # a label with half of all rows, ties, and vectors of zeros
    labels = np.where(rng.random(600) < 0.5, 0, rng.integers(0, 4, 600))
    vectors = np.where(rng.random((600, 1)) < 0.05, 0, centre[labels] + rng.integers(-12, 12, (600, 6)))
    rows = [(int(i), int(label), v.tolist()) for i, (label, v) in enumerate(zip(labels, vectors, strict=True))]
    rows += rows[:40] + [(900, 1, [5]), (901, 2, []), (20, 3, [1, 1, 1, 1, 1, 1])]
    got = negatives.hard_negatives(_frame(spark, [(*r, 1, 2, "w") for r in rows]), F.col("vec_id") % 20 == 0)
    want = _hard(rows, {i for i, *_ in rows if i % 20 == 0})
    assert len(want) > 100 and _found(got) == want


def test_hard_negatives_edges(spark):
    rows = [(0, 1, [3, 1]), (1, 1, [3, 0]), (2, 2, [3, 0]), (3, 2, [2, 2]), (4, None, [9, 9]), (None, 2, [3, 1]), (5, 2, None), (100, 7, [1, 1])]
    df = _frame(spark, [(*r, 1, 2, "w") for r in rows])
    none = lambda d: negatives.hard_negatives(d, F.col("vec_id") % 100 == 0).count()
    assert _found(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == Counter({(0, 1, 1, 2, 9, 9): 1, (0, 1, 2, 3, 9, 8): 1})
    assert none(df.filter("false")) == 0 and none(df.filter("label = 1")) == 0 and none(df.filter("vec_id = 3")) == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(_frame(spark, [(0, 1, [1 << 40], 1, 2, "w")]), F.lit(True))


def test_the_threshold_stops_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 6, (4000, 4)).astype("i2")
    vectors[7] = [100, 100, -100, 100]
    lists = negatives.Lists(np.arange(4000), np.zeros(4000, "i8"), vectors)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                read.append(len(at))
            return np.ndarray.__getitem__(self, at)

    lists.vectors = vectors.view(Counted)
    ((ids, scores),) = lists.search(np.array([1, 1, -1, 1]), np.ones(4000, bool), [(-100, 1000)], 1)
    assert ids.tolist() == [7] and scores.tolist() == [400] and sum(read) < 400


def test_op11_sees_nulls_and_odd_values(spark, tmp_path):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 3) + (k % 3)], k % 3) for k in range(400)]
    rows += [(500, None, 1), (600, [1.0, None, 1.0], 1), (700, [nan, 1.0, 1.0], 1), (800, [inf, 1.0, 1.0], 1), (900, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows[:400]]
    assert _found(registry.op11_hard_negatives(spark, str(tmp_path))) == _hard(good, {0, 100, 200, 300})


def _covariance(x):
    """Exact covariance of whole-numbered rows, by fractions."""
    n, cols = len(x), list(zip(*x, strict=True))
    mean = [Fraction(sum(c), n) for c in cols]
    return mean, np.array([[float(sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / n) for b, mb in zip(cols, mean, strict=True)] for a, ma in zip(cols, mean, strict=True)])


@pytest.mark.parametrize("far", [0, 10**6, 10**14])
def test_whitening_by_brute_force(spark, far):
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 40, (300, 5)) @ rng.normal(0, 1, (5, 5))).astype("i8") + far  # far from 0, sums of plain products would lose digits
    rows = [(k, [int(c) for c in v]) for k, v in enumerate(x)] + [(1000 + k, [int(c) for c in x[0]]) for k in range(50)] + [(None, [int(c) for c in x[1]]), (7, None)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, v array<long>, n int, component string")).collect()
    fitted = sorted({tuple(v) for _, v in rows if v})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted, strict=True)]
    mean, cov = _covariance(fitted)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == 4 * 351 and {r.n for r in got} == {n}
    assert all(r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    vector = {k: w for k, w in rows if w}
    signs = {}
    for r in got:
        w = vector[r.vec_id]
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(w, sums, strict=True))
        want = float(sum(float(c - m) * v[d, r.component - 1] for d, (c, m) in enumerate(zip(w, mean, strict=True))) / np.sqrt(e[r.component - 1]))
        if abs(want) > 0.1:
            sign = signs.setdefault(r.component, np.sign(want * r.whitened))
            assert r.whitened * sign == pytest.approx(want, rel=1e-6, abs=1e-7)


def test_squares_add_up_exactly():
    rng = np.random.default_rng(4)
    z = rng.integers(-(1 << 53) + 1, 1 << 53, (whitening.ROWS, 3))
    want = [sum(int(c) ** 2 for c in z[:, d]) for d in range(3)]
    assert [whitening.joined(*map(int, p)) for p in whitening.square_parts(z)] == want
    assert [whitening.joined(*p) for p in whitening.square_parts(z.astype(object) * 1000)] == [w * 10**6 for w in want]


def test_whitening_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None)])).count() == 0 and whitening.whiten(make([(1, [])])).count() == 0
    one = whitening.whiten(make([(1, [3, 4]), (2, [3, 4])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(make([(k, [k, 2 * k]) for k in range(10)] + [(99, [5])])).collect()
    assert len(line) == 22 and all(r.whitened is not None for r in line)
    flat = whitening.whiten(make([(k, [k, 2 * k, 0]) for k in range(10)])).collect()
    assert Counter((r.component, r.whitened is None) for r in flat) == Counter({(1, False): 10, (2, True): 10, (3, True): 10})
    assert flat[0].identity_error < 1e-9


def test_op12(spark, sf):
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, "f8")).astype("i8")) for r in table(spark, sf, "embeddings").collect()]
    got = defaultdict(dict)
    for r in registry.op12_embedding_whitening(spark, sf).collect():
        got[r.vec_id][r.component] = r
    x = np.array(sorted({tuple(v) for _, v in rows}))
    assert len(got) == len(rows) and next(iter(got.values()))[1].n == len(x)
    y = np.array([[got[i][c].whitened for c in range(1, 5)] for i, _ in rows])
    if len(x) == len(rows):
        assert np.abs(np.cov(y.T, bias=True) - np.eye(4)).max() < 1e-4
    for i, v in rows[:50]:
        assert got[i][1].deviation == sum((len(x) * int(c) - int(s)) ** 2 for c, s in zip(v, x.sum(0), strict=True))
