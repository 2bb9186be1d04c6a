"""Pairs that move together against all pairs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators import pairs
from ebbline.operators import stats as st


def _series(spark, values):
    start = dt.date(2020, 1, 1)
    rows = [(f"i{k:04d}", start + dt.timedelta(days=t), float(x)) for k, v in enumerate(values) for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "item string, period date, value double")


def _walks(seed, items=120, length=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (6, length)).cumsum(1)
    return [rng.choice([-1, 1]) * base[k % 6] * rng.uniform(1, 9) + rng.normal(0, rng.choice([0.01, 0.5, 5]), length) + 100 for k in range(items)]


def _all(values):
    r = np.corrcoef(np.array(values))
    return {(f"i{a:04d}", f"i{b:04d}"): r[a, b] for a in range(len(values)) for b in range(a + 1, len(values))}


@pytest.mark.parametrize("least", [0.999, 0.95, 0.3])
def test_strong_pairs_against_all(spark, least, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 7)
    values = _walks(1)
    want = {k: r for k, r in _all(values).items() if abs(r) >= least}
    got = {(x.a, x.b): x.r for x in pairs.strong_pairs(_series(spark, values), least).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("most", [1, 6, 40])
def test_strongest_pairs_against_all(spark, most):
    values = _walks(2)
    want = sorted(_all(values).items(), key=lambda x: (-abs(x[1]), x[0]))[:most]
    got = pairs.strongest_pairs(_series(spark, values), most).collect()
    assert [(x.a, x.b) for x in got] == [k for k, _ in want] and all(x.n == 24 for x in got)


def test_constant_equal_and_few_items(spark):
    ramp = np.arange(8.0)
    values = [ramp, -2 * ramp, np.full(8, 3.0), ramp]
    got = pairs.strong_pairs(_series(spark, values), 1 - 1e-12).collect()
    assert {(x.a, x.b, round(x.r)) for x in got} == {("i0000", "i0001", -1), ("i0000", "i0003", 1), ("i0001", "i0003", -1)}
    assert len(pairs.strongest_pairs(_series(spark, values), 10).collect()) == 3
    assert pairs.strongest_pairs(_series(spark, values).filter("item IS NULL"), 3).collect() == []
    assert st.uniform_growth(_series(spark, values)).first().asDict() == {"pairs": 3, "strong": 3, "uniform": True}


def test_unlike_items_do_not_meet(spark):
    """Only pairs of near cells are formed: far fewer than all."""
    items = pairs.kept(pairs._with_angles(pairs.unit_vectors(_series(spark, _walks(3, 300)))), "t")
    met = pairs._near(items, np.arccos(0.999)).count()
    assert met < 300 * 299 / 2 / 10
    plan = pairs._near(items, np.arccos(0.999))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
