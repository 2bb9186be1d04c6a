"""Ranked slices, tier filters and cumulative shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .ordered import first_of_each, numbered, with_totals


def ranked_slice(df: DataFrame, value: str, levels: tuple[str, ...], tops: tuple[int, ...]) -> DataFrame:
    """The keys of the top parents by sum, the top children of each, and so on; ties by name."""
    keys: list[str] = []
    kept = df
    for level, top in zip(levels, tops, strict=True):
        totals = kept.groupBy(*keys, level).agg(F.sum(value).alias("_t"))
        order = (F.desc_nulls_last("_t"), F.col(level))
        if keys:
            best = first_of_each(totals, (*keys,), top, *order)
        else:
            best = totals.orderBy(*order).limit(top)
        keys.append(level)
        best = best.select(*keys)
        kept = df.join(best, keys, "left_semi")
    return best


def sliced(df: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of a slice. Spark broadcasts it if it is small when it is known."""
    return df.join(keep, keep.columns, "left_semi")


@dataclass(frozen=True)
class Tier:
    level: str
    mode: str
    value: float
    within: str | None = None


def parse_tiers(text: str) -> list[Tier]:
    """`level:mode:value[@dimension]`, comma-separated; mode is top_n or top_pct."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        head, _, within = part.partition("@")
        level, mode, value = head.split(":")
        if mode not in ("top_n", "top_pct"):
            raise ValueError(f"unknown mode in {part}")
        out.append(Tier(level, mode, float(value), within or None))
    return out


def tier_keys(df: DataFrame, tier: Tier, value: str) -> DataFrame:
    """The entities that a tier keeps: the first n, or the fewest whose share reaches value percent (all, if the total is 0)."""
    groups = [tier.within] if tier.within else []
    totals = df.groupBy(*groups, tier.level).agg(F.sum(F.abs(value)).alias("_t"))
    order = (F.desc("_t"), F.col(tier.level))
    if tier.mode == "top_n":
        best = first_of_each(totals, (*groups,), int(tier.value), *order) if groups else totals.orderBy(*order).limit(int(tier.value))
        return best.select(*groups, tier.level)
    placed = numbered(totals, *order, by=(*groups,), totals={"total": "_t"}, before="_t")
    return placed.filter((F.col("before") < F.col("total") * tier.value / 100) | (F.col("total") == 0)).select(*groups, tier.level)


def tier_filtered(df: DataFrame, tier: Tier, value: str) -> DataFrame:
    keep = tier_keys(df, tier, value)
    return df.join(keep, keep.columns, "left_semi")


def with_rank(df: DataFrame, by: str, name: str, *groups: str) -> DataFrame:
    """rank by falling size of `by` (in each group, if there are some), and the cumulative percentage of its absolute sum; ties by name."""
    placed = numbered(df.withColumn("_x", F.abs(by)), F.desc("_x"), F.col(name), by=groups, totals={"_total": "_x"}, _before="_x")
    cumulative = F.when(F.col("_total") > 0, (F.col("_before") + F.col("_x")) / F.col("_total") * 100).otherwise(F.lit(0.0))
    return placed.withColumn("rank", F.col("row").cast("int")).withColumn("cumulative_pct", cumulative).drop("row", "_before", "_total", "_x")


def major_shares(df: DataFrame, item: str, value: str, least: float = 0.05) -> DataFrame:
    """Each item's share of the total, and whether it is a major one."""
    totals = kept(df.groupBy(item).agg(F.sum(value).cast("double").alias("v")), "shares")
    out = with_totals(totals, total=F.sum("v")).withColumn("share", F.col("v") / F.nullif("total", F.lit(0.0)))
    return out.select(item, "share", (F.col("share") >= least).alias("is_major"))


def persistent_movers(series: DataFrame, top: int = 5, share: float = 0.5) -> DataFrame:
    """How often each item is among the `top` largest moves of a period, of how many periods, and whether that is over the share of them."""
    moves = series.withColumn("move", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("item").orderBy("period")))).filter("move IS NOT NULL")
    hits = first_of_each(moves, ("period",), top, F.desc("move"), F.col("item"))
    n = series.agg((F.count_distinct("period") - 1).alias("periods"))
    out = hits.groupBy("item").agg(F.count("*").alias("times")).crossJoin(F.broadcast(n))
    return out.withColumn("persistent", F.col("times") > share * F.col("periods"))


def similar_history(moves: DataFrame, item: str, value: str, now, last: int = 3, top: int = 2, like: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Of each item's `last` periods before `now`, the latest `top` whose value is half to twice the present one."""
    back = Window.partitionBy(item).orderBy(F.desc("period"))
    present = moves.filter(F.col("period") == F.lit(now)).select(item, F.col(value).alias("_now"))
    recent = moves.filter(F.col("period") < F.lit(now)).withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= last).drop("_r")
    near = recent.join(present, item).filter((F.col(value) / F.nullif("_now", F.lit(0.0))).between(*like)).drop("_now")
    return near.withColumn("_k", F.row_number().over(back)).filter(F.col("_k") <= top).drop("_k")


def rank_of(df: DataFrame, item: str, value: str, named: str) -> DataFrame:
    """One row: the named item's total and its rank among all by sum; ties by name. Larger totals are counted, not sorted."""
    totals = kept(df.groupBy(item).agg(F.sum(value).alias("total")), "rank-of")
    own = totals.filter(F.col(item) == named).select(F.col("total").alias("own"))
    ahead = totals.crossJoin(F.broadcast(own)).agg((F.count_if((F.col("total") > F.col("own")) | ((F.col("total") == F.col("own")) & (F.col(item) < named)) | (F.col("own").isNull() & F.col("total").isNotNull())) + 1).alias("rank"))
    return totals.filter(F.col(item) == named).crossJoin(F.broadcast(ahead))


def first_of(df: DataFrame, keys: tuple[str, ...], *order) -> DataFrame:
    """The first row of each key."""
    return first_of_each(df, keys, 1, *order, name="_r").drop("_r")


def top_entities(df: DataFrame, entity: str, order: str, value: str, top: int = 20) -> DataFrame:
    """The entities with the largest sums: orders, the amount an order, and the share of all entities' sum in percent."""
    t = df.groupBy(entity, order).agg(F.sum(value).alias("_v")).groupBy(entity).agg(F.sum("_v").alias("_v"), F.count(order).alias("orders"))
    t = kept(t, "entities")
    every = t.agg(F.sum("_v").cast("double").alias("_all"))
    first = t.withColumn("total", F.col("_v").cast("double")).orderBy(F.desc("total"), entity).limit(top).crossJoin(F.broadcast(every))
    return first.select(entity, "total", "orders", (F.col("total") / F.nullif("orders", F.lit(0))).alias("per_order"), (100 * F.col("total") / F.nullif("_all", F.lit(0.0))).alias("share_pct"))


def moved_entities(cells: DataFrame, entity: str) -> DataFrame:
    """Of cells (entity, current, prior): how much moved in each entity, either way, and its largest percent change; most first."""
    d = F.col("current") - F.col("prior")
    out = cells.groupBy(entity).agg(F.sum(F.abs(d)).alias("moved"), (100 * F.max(F.abs(d / F.nullif("prior", F.lit(0.0))))).alias("most_pct"))
    return out.orderBy(F.desc("moved"), F.desc_nulls_last("most_pct"), entity)


def entity_sets(df: DataFrame, entity: str, now, then) -> DataFrame:
    """Each entity of two periods as new (in the first alone), lost (in the second alone) or same, from one pass over both; null is none."""
    at = lambda p: F.bool_or(F.col("period") == F.lit(p))
    seen = df.filter(F.col("period").isin(F.lit(now), F.lit(then)) & F.col(entity).isNotNull()).groupBy(entity).agg(at(now).alias("_now"), at(then).alias("_then"))
    return seen.select(F.when(~F.col("_then"), "new").when(~F.col("_now"), "lost").otherwise("same").alias("kind"), entity)
