"""Routines per series that SQL can't express, run by Spark on each group of rows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import f_upper

def _explained(groups: list[np.ndarray], n: np.ndarray, s: np.ndarray) -> float:
    """What terms explain together about cells' sums (about a mean of 0): groups has, for each term, the number of each cell's group.

    The normal equations have a value for each group of each term, and are solved by conjugate gradients; nothing is larger than the cells.
    """
    if not groups:
        return 0.0
    sums = lambda v: np.concatenate([np.bincount(g, v) for g in groups])
    ends = np.cumsum([g.max() + 1 for g in groups])[:-1]
    cells = lambda x: np.sum([part[g] for part, g in zip(np.split(x, ends), groups)], axis=0)
    count, right = sums(n), sums(s)
    x, left = np.zeros(len(right)), right.copy()
    p = left / count
    size = start = float(left @ p)
    for _ in range(20 * len(right) + 50):
        if size <= start * 1e-26 or size == 0:
            break
        q = sums(n * cells(p))
        along = float(p @ q)
        if along <= 0:
            break
        x, left = x + size / along * p, left - size / along * q
        z = left / count
        size, old = float(left @ z), size
        p = z + size / old * p
    return float(x @ right)


#: A prime below 2^31: products of two remainders fit in 63 bits, and sums of 4 million of them are exact as doubles.
PRIME = 2147483647


def _recurrence(values: list[int]) -> tuple[int, bool]:
    """Length of the shortest linear recurrence of a sequence modulo PRIME, and whether its last coefficient is 0."""
    seq = np.array(values, dtype=np.int64)
    now, old = np.zeros(len(seq) + 2, np.int64), np.zeros(len(seq) + 2, np.int64)
    now[0] = old[0] = 1
    length, shift, last = 0, 1, 1
    for i in range(len(seq)):
        d = int((now[: length + 1] * seq[i - length : i + 1][::-1] % PRIME).sum() % PRIME)
        if d == 0:
            shift += 1
            continue
        c = d * pow(last, -1, PRIME) % PRIME
        kept = now.copy()
        now[shift:] = (now[shift:] - c * old[: len(now) - shift] % PRIME) % PRIME
        if 2 * length <= i:
            length, old, last, shift = i + 1 - length, kept, d, 1
        else:
            shift += 1
    return length, bool(now[length] == 0)


def _two_way_rank(a: np.ndarray, b: np.ndarray) -> int:
    """Levels of both, less one for each part of the table that no cell joins to another."""
    mark_a, mark_b = np.arange(a.max() + 1), np.full(b.max() + 1, a.max() + 1)
    while True:
        np.minimum.at(mark_b, b, mark_a[a])
        new = mark_a.copy()
        np.minimum.at(new, a, mark_b[b])
        if (new == mark_a).all():
            return len(mark_a) + len(mark_b) - len(np.unique(mark_a))
        mark_a = new


def _rank(groups: list[np.ndarray]) -> int:
    """Rank of the terms' 0/1 design on the cells, found modulo a prime without a matrix.

    A cell alone in a group adds 1, and goes with it; what is left takes time with the square of its groups.
    With random weights of cells and groups, the least recurrence of a vector under the weighted normal equations is as long as their rank (and
    one longer where they are singular); a bad draw can only make it shorter, so the greatest length that comes twice is taken.
    """
    if len(groups) < 2:
        return int(groups[0].max()) + 1 if groups else 1
    if len(groups) == 2:
        return _two_way_rank(*groups)
    gone = 0
    while (lone := np.any([np.bincount(g)[g] == 1 for g in groups], axis=0)).any():
        gone += int(lone.sum())
        if lone.all():
            return gone
        groups = [np.unique(g[~lone], return_inverse=True)[1] for g in groups]
    sizes = [int(g.max()) + 1 for g in groups]
    width, ends = sum(sizes), np.cumsum(sizes)[:-1]
    rng, seen = np.random.default_rng(7), []
    while not seen or seen.count(max(seen)) < 2:
        draw = lambda k: rng.integers(1, PRIME, k)
        by_group, by_cell, u, v = draw(width), draw(len(groups[0])), draw(width), draw(width)
        values = []
        for _ in range(2 * width + 2):
            values.append(int((u * v % PRIME).sum() % PRIME))
            parts = np.split(by_group * v % PRIME, ends)
            there = by_cell * (np.sum([p[g] for p, g in zip(parts, groups)], axis=0) % PRIME) % PRIME
            v = by_group * (np.concatenate([np.bincount(g, there) for g in groups]).astype(np.int64) % PRIME) % PRIME
        length, singular = _recurrence(values)
        seen.append(length - singular)
    return gone + max(seen)


def two_way(df: DataFrame, a: str, b: str, value: str, interaction: bool = True) -> DataFrame:
    """Type II sums of squares of two factors and their interaction, with shares of the total, F and p.

    Spark reduces the table to its cells' counts, sums and squares. Each factor alone and the cells have closed forms; only the
    additive model is solved, in one task, over the list of cells. Rows without a factor count as a level of their own.
    """
    cells = df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(value).alias("n"), F.sum(value).cast("double").alias("s"), F.sum(F.col(value).cast("double") * F.col(value).cast("double")).alias("ss")).filter("n > 0")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].to_numpy("f8"), pdf["s"].to_numpy("f8")
        ca, cb = (pd.factorize(pdf[c], sort=True, use_na_sentinel=False)[0] for c in "ab")
        mean = s.sum() / n.sum()
        total, s = float(pdf["ss"].sum() - n.sum() * mean * mean), s - n * mean
        alone = lambda c: float((np.bincount(c, s) ** 2 / np.bincount(c, n)).sum())
        both, rank = _explained([ca, cb], n, s), _two_way_rank(ca, cb)
        cell = float((s * s / n).sum())
        left, rest = total - (cell if interaction else both), n.sum() - (len(n) if interaction else rank)
        terms = [(a, both - alone(cb), rank - cb.max() - 1), (b, both - alone(ca), rank - ca.max() - 1)] + ([(f"{a}:{b}", cell - both, len(n) - rank)] if interaction else [])
        out = []
        for name, ss, d in terms:
            f = ss / d / (left / rest) if d > 0 and rest > 0 and left > 0 else np.nan
            out.append((name, ss, float(d), ss / total if total else 0.0, f, float(f_upper(f, d, rest)) if f == f else np.nan))
        return pd.DataFrame([*out, ("residual", left, float(rest), left / total if total else 0.0, np.nan, np.nan)], columns=["term", "sum_sq", "df", "eta_squared", "f", "p_value"])

    schema = "term string, sum_sq double, df double, eta_squared double, f double, p_value double"
    return cells.groupBy().applyInPandas(solve, schema)


def multi_way(df: DataFrame, factors: tuple[str, ...], value: str, interactions: bool = True) -> DataFrame:
    """Type II sums of squares of any number of factors and all their pairwise interactions, with shares, F and p.

    A term is fitted after all terms that don't contain it; shares are of the sum of all terms and the residual. Rows without
    a factor are left out, a null value is 0. Spark reduces the table to cells of all factors; one task solves over the list of
    cells, whatever the number of levels: sums of squares by conjugate gradients, degrees of freedom from the levels if every combination
    has a cell, else by the rank of the design. An empty table gives no rows.
    """
    y = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    rows = df.dropna(subset=list(factors)).select(*[F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(factors)], y.alias("y"))
    keys = [f"f{k}" for k in range(len(factors))]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    terms = [(k,) for k in range(len(factors))] + (list(combinations(range(len(factors)), 2)) if interactions else [])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].to_numpy("f8"), pdf["s"].to_numpy("f8")
        total_n, mean = n.sum(), s.sum() / n.sum()
        total, s = float(pdf["ss"].sum() - total_n * mean * mean), s - n * mean
        codes = [pd.factorize(pdf[k], sort=True)[0].astype(np.int64) for k in keys]
        levels = [int(c.max()) + 1 for c in codes]
        complete = len(pdf) == np.prod([float(k) for k in levels])
        of = {t: codes[t[0]] if len(t) == 1 else np.unique(codes[t[0]] * levels[t[1]] + codes[t[1]], return_inverse=True)[1] for t in terms}
        fits: dict[frozenset, tuple[float, int]] = {}

        def fit(kept: list) -> tuple[float, int]:
            """What the terms explain about the mean, and the rank of their design."""
            key = frozenset(kept)
            if key not in fits:
                # a factor alone is in the span of its pairs
                groups = [of[t] for t in kept if not any(set(t) < set(u) for u in kept)]
                rank = 1 + sum(int(np.prod([levels[k] - 1 for k in t])) for t in kept) if complete else _rank(groups)
                fits[key] = _explained(groups, n, s), rank
            return fits[key]

        whole, rank = fit(terms)
        left, rest = max(total - whole, 0.0), float(total_n - rank)
        out = []
        for t in terms:
            others = [u for u in terms if not set(t) <= set(u)]
            (r1, d1), (r0, d0) = fit([*others, t]), fit(others)
            ss, d = max(r1 - r0, 0.0), d1 - d0
            f = ss / d / (left / rest) if d > 0 and rest > 0 and left > 0 else np.nan
            out.append((":".join(factors[k] for k in t), ss, float(d), f, float(f_upper(f, d, rest)) if f == f else np.nan))
        out.append(("residual", left, rest, np.nan, np.nan))
        result = pd.DataFrame(out, columns=["term", "sum_sq", "df", "f", "p_value"])
        every = result["sum_sq"].sum()
        result["eta_squared"] = result["sum_sq"] / every if every else 0.0
        return result[["term", "sum_sq", "df", "eta_squared", "f", "p_value"]]

    return cells.groupBy().applyInPandas(solve, "term string, sum_sq double, df double, eta_squared double, f double, p_value double")


def granger(series: DataFrame, lags: int = 2) -> DataFrame:
    """Whether a leader's past helps to predict a follower beyond its own: series is (leader, follower, period_idx, x, y).

    F, p and lag of the number of lags from 1 to `lags` with the least p; of equal ones, the fewest. Null where no number leaves degrees of freedom.
    """

    def test(x: np.ndarray, y: np.ndarray, k: int) -> tuple[float, float, int] | None:
        n = len(y) - k
        rest = n - 2 * k - 1
        if rest <= 0:
            return None
        past = lambda v: np.column_stack([v[k - j : len(v) - j] for j in range(1, k + 1)])
        own = np.column_stack([np.ones(n), past(y)])
        target = y[k:]
        sse = lambda m: float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum())
        r0, r1 = sse(own), sse(np.column_stack([own, past(x)]))
        f = (r0 - r1) / k / (r1 / rest) if r1 > 0 else np.inf
        return float(f_upper(f, k, rest)), f, k

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values("period_idx")
        x, y = pdf["x"].to_numpy("f8"), pdf["y"].to_numpy("f8")
        found = [t for k in range(1, lags + 1) if (t := test(x, y, k))]
        p, f, k = min(found, key=lambda t: (t[0], t[2])) if found else (np.nan, np.nan, None)
        return pd.DataFrame([(*key, f, p, k)], columns=["leader", "follower", "f", "p_value", "lags"])

    return series.groupBy("leader", "follower").applyInPandas(one, "leader string, follower string, f double, p_value double, lags int")


def cheapest_cuts(v: np.ndarray, penalty: float, least: int) -> list[int]:
    """Where the cheapest cut of a series into segments of `least` values or more starts new ones: squared distances from the segments' means, and a penalty a segment.

    The cost of the values so far is kept as a function of the last segment's level: for each range of levels, the start that is cheapest there. A start that is
    cheapest for no level can't come back, for all starts gain the same by a further value. What is left are a few ranges, so the work grows with the length, not with its square.
    Of equal costs, the earlier start is taken.
    """
    n = len(v)
    y = (v - v.mean()).tolist() if n else []
    one, two = [0.0], [0.0]
    for x in y:
        one.append(one[-1] + x)
        two.append(two[-1] + x * x)
    best, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    ranges: list[tuple[float, float, int]] = []  # levels from, to, and the start that is cheapest there
    low, high = (min(y), max(y)) if n else (0.0, 0.0)
    for end in range(least, n + 1):
        r = end - least
        if best[r] < np.inf:  # the start r joins: it takes the levels where it is cheaper than what was there
            kept, free, at = [], [], low
            for lo, hi, s in ranges:
                # cost of s over cost of r, without what both gain from r on, is a * x^2 + b * x + c
                a, b, c = r - s, -2 * (one[r] - one[s]), two[r] - two[s] + best[s] - best[r]
                disc = b * b - 4 * a * c
                if disc >= 0:
                    root = disc**0.5
                    left, right = max(lo, (-b - root) / (2 * a)), min(hi, (-b + root) / (2 * a))
                    if left <= right:
                        if left > at:
                            free.append((at, left, r))
                        kept.append((left, right, s))
                        at = right
            if at < high or not kept:
                free.append((at, high, r))
            ranges = sorted(kept + free)
        cheapest = None
        for lo, hi, s in ranges:
            size, total = end - s, one[end] - one[s]
            level = min(max(total / size, lo), hi)
            cost = best[s] + two[end] - two[s] + level * (size * level - 2 * total)
            if cheapest is None or cost < cheapest[0] or (cost == cheapest[0] and s < cheapest[1]):
                cheapest = (cost, s)
        best[end], back[end] = cheapest[0] + penalty, cheapest[1]
    cuts, end = [], n
    while end > 0 and (end := back[end]) > 0:
        cuts.append(end)
    return cuts[::-1]


CHANGE = "item string, period date, change_point_index int, before_mean double, after_mean double, magnitude_dollar double, magnitude_pct double, confidence_score double, periods_before int, periods_after int"


def change_points(series: DataFrame, least: int = 12, segment: int = 3, most: int | None = None) -> DataFrame:
    """Where an item's mean changes: the cheapest cut into segments, with a penalty of 3 * variance * log(n) a cut. All changes of an item, or its `most` largest.

    The means, periods and the deviation that confidence is measured by are those of all values before and of all values from the change on; without a deviation before, confidence is 0.
    """

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        v, out = pdf["value"].to_numpy("f8"), []
        n = len(v)
        for cut in cheapest_cuts(v, 3 * max(np.var(v), 1e-12) * np.log(n), segment) if n >= least else []:
            before, after = v[:cut], v[cut:]
            step, sd = after.mean() - before.mean(), before.std()
            out.append((key[0], pdf["period"].iloc[cut], int(cut), before.mean(), after.mean(), step, step / abs(before.mean()) * 100 if before.mean() else 0.0, float(min(abs(step) / sd, 10.0)) if sd > 0 else 0.0, len(before), len(after)))
        return pd.DataFrame(sorted(out, key=lambda r: -abs(r[5]))[:most], columns=[c.split()[0] for c in CHANGE.split(", ")])

    return series.select("item", "period", "value").groupBy("item").applyInPandas(one, CHANGE)


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """One row: items, forecasts, misses, items with misses, the percentage of misses and the mean absolute percentage error."""
    return forecasts.agg(F.count_distinct("item").alias("items_analyzed"), F.count("*").alias("total_forecasts"), F.count_if("miss").alias("total_forecast_misses"), F.count_distinct(F.when(F.col("miss"), F.col("item"))).alias("items_with_misses"), F.coalesce(100 * F.avg(F.col("miss").cast("double")), F.lit(0.0)).alias("miss_rate_pct"), F.coalesce(F.avg("abs_variance_pct"), F.lit(0.0)).alias("mape"))


def holdout_forecasts(series: DataFrame, season: int = 12, least: int = 18) -> DataFrame:
    """The last fifth of each series of 18 values or more, forecast from the rest.

    The forecast repeats the last cycle with the drift between the last two; a series without two
    cycles to learn from repeats its mean. misses are over 10 percent off.
    """
    columns = ["item", "period", "actual", "forecast", "variance_dollar", "variance_pct", "abs_variance_pct", "miss"]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        v = pdf["value"].to_numpy("f8")
        train = int(len(v) * 0.8)
        if len(v) < least or train < 12:
            return pd.DataFrame(columns=columns)
        known, steps = v[:train], len(v) - train
        if train >= 2 * season:
            drift = (known[-season:].mean() - known[-2 * season : -season].mean())
            forecast = np.array([known[train - season + h % season] + drift * (h // season + 1) for h in range(steps)])
        else:
            forecast = np.full(steps, known.mean())
        actual = v[train:]
        pct = np.where(forecast != 0, (actual - forecast) / np.where(forecast == 0, 1, np.abs(forecast)) * 100, 0.0)
        return pd.DataFrame({"item": key[0], "period": pdf["period"].iloc[train:].to_numpy(), "actual": actual, "forecast": forecast, "variance_dollar": actual - forecast, "variance_pct": pct, "abs_variance_pct": np.abs(pct), "miss": np.abs(pct) > 10})[columns]

    return series.select("item", "period", "value").groupBy("item").applyInPandas(one, "item string, period date, actual double, forecast double, variance_dollar double, variance_pct double, abs_variance_pct double, miss boolean")
