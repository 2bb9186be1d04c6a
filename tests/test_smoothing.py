"""Fitted forecasts: against the same recursion in Python, and against the repeat of the last cycle on planted series."""

import datetime as dt
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from ebbline.operators import grouped
from ebbline.operators.smoothing import DRIFTS, LEVELS, SEASONS, fitted_forecasts


def _series(spark, values):
    rows = [(item, dt.date(2015 + t // 12, t % 12 + 1, 1), None if x is None else float(x)) for item, v in values.items() for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "item string, period date, value double")


def _smooth(x, a, b, c):
    if len(x) < 24:
        level, drift, wave, at = x[0], 0.0, [0.0] * 12, 1
    else:
        first = np.mean(x[:12])
        drift = (np.mean(x[12:24]) - first) / 12
        level, wave, at = first + drift * 5.5, [x[k] - first - drift * (k - 5.5) for k in range(12)], 12
    sse = 0.0
    for t in range(at, len(x)):
        k = t % 12 if at == 12 else (t - 1) % 12
        sse += (x[t] - level - drift - wave[k]) ** 2
        new = a * (x[t] - wave[k]) + (1 - a) * (level + drift)
        drift, wave[k] = b * (new - level) + (1 - b) * drift, c * (x[t] - new) + (1 - c) * wave[k]
        level = new
    return sse, level, drift, wave


def _planted(seed, n=60):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 200 + rng.uniform(-1, 2) * t + 40 * np.sin(2 * np.pi * t / 12 + seed) + rng.normal(0, 12, n)


def test_recursion(spark):
    values = {"long": _planted(1), "short": _planted(2, 20), "odd": _planted(3, 43), "still": np.full(36, 5.0), "few": _planted(4, 17)}
    got = {}
    for r in fitted_forecasts(_series(spark, values)).orderBy("item", "period").collect():
        got.setdefault(r.item, []).append(r)
    assert set(got) == {"long", "short", "odd", "still"}
    for item, rows in got.items():
        v = values[item]
        train = int(len(v) * 0.8)
        grid = product(LEVELS, DRIFTS, SEASONS) if train >= 24 else product(LEVELS, (0.0,), (0.0,))
        (sse, *_), a, b, c = min((((fit := _smooth(v[:train], *w))[0], 0), *w) for w in grid)
        _, level, drift, wave = _smooth(v[:train], a, b, c)
        want = [level + (h + 1) * drift + wave[(train + h) % 12 if train >= 24 else 0] for h in range(len(v) - train)]
        assert np.allclose([r.forecast for r in rows], want)
        assert [(r.alpha, r.beta, r.gamma) for r in rows] == [(a, b, c)] * len(rows)
    assert all(r.forecast == 5.0 and not r.miss for r in got["still"])


def test_beats_the_repeat_of_the_last_cycle(spark):
    series = _series(spark, {f"i{k}": _planted(k) for k in range(40)})
    fitted = fitted_forecasts(series).agg(F.avg("abs_variance_pct")).first()[0]
    repeated = grouped.holdout_forecasts(series).agg(F.avg("abs_variance_pct")).first()[0]
    assert fitted < 0.85 * repeated


def test_nulls_and_empty(spark):
    s = _series(spark, {"a": [None, *_planted(5, 30)], None: _planted(6, 30)})
    assert {r.item for r in fitted_forecasts(s).collect()} == {"a"}
    assert fitted_forecasts(s.limit(0)).collect() == []
    assert fitted_forecasts(s, steps=3).count() == 3
