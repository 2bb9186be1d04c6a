"""Forecasts by exponential smoothing whose weights are searched on each item's own history: folds over sorted values, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights that are tried for level, drift and season.
LEVELS, DRIFTS, SEASONS = (0.05, 0.2, 0.4, 0.6, 0.8), (0.0, 0.05, 0.2), (0.1, 0.3, 0.6)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _start(season: int) -> Column:
    """The state after the first cycle: its mean carried to its end, the drift to the second cycle, and what the seasons add. Too short for two cycles: the first value alone."""
    known = F.col("known")
    first = _mean(F.slice(known, 1, season))
    drift = (_mean(F.slice(known, season + 1, season)) - first) / season
    middle = (season - 1) / 2
    seasons = F.transform(F.slice(known, 1, season), lambda x, k: x - first - drift * (k - F.lit(middle)))
    state = lambda level, b, s: F.struct(level.alias("level"), b.alias("drift"), s.alias("seasons"), F.lit(0.0).alias("sse"))
    return F.when(F.col("cycles"), state(first + drift * middle, drift, seasons)).otherwise(state(known[0], F.lit(0.0), F.array_repeat(F.lit(0.0), season)))


def _step(s: Column, x: Column, season: int) -> Column:
    """One value later. `seasons` begins with the next value's season, so each step takes its first and appends it anew."""
    drift, wave = s["drift"], s["seasons"][0]
    error = x - (s["level"] + drift + wave)
    level = F.col("alpha") * (x - wave) + (1 - F.col("alpha")) * (s["level"] + drift)
    turned = F.array_append(F.slice(s["seasons"], 2, season - 1), F.col("gamma") * (x - level) + (1 - F.col("gamma")) * wave)
    return F.struct(level.alias("level"), (F.col("beta") * (level - s["level"]) + (1 - F.col("beta")) * drift).alias("drift"), turned.alias("seasons"), (s["sse"] + error * error).alias("sse"))


def fitted_forecasts(series: DataFrame, season: int = 12, least: int = 18, steps: int | None = None) -> DataFrame:
    """The last fifth of each series of `least` values or more (or its last `steps`), forecast from the rest by smoothing of level, drift and season.

    Weights are those of the grid with the least squared one-step errors within the history (ties: the smallest). With less than two
    cycles of history there is no drift and no season. Null values and null items take no part; a series as short as its hold-out has no row.
    Columns: item, period, alpha, beta, gamma, actual, forecast, variance_dollar, variance_pct (0 where the forecast is 0), abs_variance_pct,
    miss (over 10 percent). A series is one row of an array: its periods, not its items, bound a task's memory.
    """
    lists = series.filter("item IS NOT NULL AND value IS NOT NULL").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("period", F.col("value").cast("double").alias("value")))).alias("s"))
    size = F.size("s")
    train = F.floor(size * 0.8).cast("int") if steps is None else size - F.lit(steps)
    kept = lists.filter(size >= least).withColumn("train", train).filter("train > 0")
    known = kept.withColumn("known", F.transform(F.slice("s", F.lit(1), F.col("train")), lambda x: x["value"])).withColumn("cycles", F.col("train") >= 2 * season)
    grid = lambda values: F.explode(F.when(F.col("cycles"), F.array(*[F.lit(x) for x in values])).otherwise(F.array(F.lit(0.0))))
    tried = known.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in LEVELS]))).withColumn("beta", grid(DRIFTS)).withColumn("gamma", grid(SEASONS))
    begun = tried.withColumn("start", _start(season))
    rest = F.slice("known", F.when(F.col("cycles"), season + 1).otherwise(2), F.size("known"))
    fits = begun.withColumn("state", F.aggregate(rest, F.col("start"), lambda s, x: _step(s, x, season)))
    weights = ("alpha", "beta", "gamma")
    best = fits.groupBy("item").agg(F.min_by(F.struct(*weights, "state"), F.struct(F.col("state.sse"), *weights)).alias("fit"))
    ahead = kept.join(best, "item").select("item", "fit.*", F.posexplode(F.slice("s", F.col("train") + 1, F.size("s"))).alias("h", "x"))
    out = ahead.select("item", F.col("x.period").alias("period"), *weights, F.col("x.value").alias("actual"), (F.col("state.level") + (F.col("h") + 1) * F.col("state.drift") + F.get("state.seasons", F.col("h") % season)).alias("forecast"))
    out = out.withColumn("variance_dollar", F.col("actual") - F.col("forecast"))
    pct = F.coalesce(100 * F.col("variance_dollar") / F.nullif(F.abs("forecast"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("variance_pct", pct).withColumn("abs_variance_pct", F.abs("variance_pct")).withColumn("miss", F.col("abs_variance_pct") > 10)
