"""Pairs of items whose series move together, found without forming all pairs.

The angle between the lines of two centred series, acos |r|, is a metric. So the angles of an item to three pivot items bound its angle to
any other from below: two items within an angle have angles to each pivot that differ by no more. Items are put in cells as wide as that
angle, and only neighbouring cells meet, by an equi-join; what is left is multiplied out. Full cells are cut in tiles, so that no task
holds one whole. Where series are alike in nothing, the angle is wide and cells are few: the result stays exact, the work grows to that of
all pairs, whose rows are multiplied where they meet and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .ordered import numbered

SLACK = 1e-6  #: angles near 0 are known to the square root of a double's precision
TILE = 1024  #: items of a cell that meet in one group of rows
PIVOTS = 3


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(r: Column) -> Column:
    return F.acos(F.least(F.abs(r), F.lit(1.0)))


def unit_vectors(series: DataFrame) -> DataFrame:
    """item, n and v: the values of each item of a dense series in the order of periods, centred and of length 1. Items that don't vary are left out.

    Every item must have a value for each period: vectors of unlike length have no product. Null values and null items take no part.
    """
    known = series.filter("item IS NOT NULL AND value IS NOT NULL")
    lists = known.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("period", F.col("value").cast("double").alias("value")))).alias("s"), F.avg("value").alias("m"), F.count("*").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    centred = lists.filter("hi > lo").select("item", "n", F.transform("s", lambda x: x["value"] - F.col("m")).alias("c"))
    return centred.withColumn("length", F.sqrt(_dot("c", "c"))).select("item", "n", F.transform("c", lambda x: x / F.col("length")).alias("v"))


def _with_angles(vectors: DataFrame) -> DataFrame:
    """vectors with d, their angles to pivots: any item, then each time the one farthest from the pivots before. One vector a pivot comes to the driver."""
    out = vectors.withColumn("d", F.array().cast("array<double>"))
    for k in range(PIVOTS):
        far = F.min_by("v", "item") if k == 0 else F.max_by("v", F.struct(F.array_min("d"), "item"))
        pivot = out.agg(far).first()[0]
        if pivot is None:
            return out.withColumn("d", F.array_repeat(F.lit(0.0), PIVOTS))
        out = out.withColumn("d", F.array_append("d", _angle(_dot("v", F.array(*[F.lit(x) for x in pivot])))))
    return out


def _near(items: DataFrame, angle: float) -> DataFrame:
    """a, b, r, n of all pairs of items within an angle, a before b (and some beyond it)."""
    wide, last = angle + SLACK, math.floor(math.pi / 2 / (angle + SLACK))
    cell = lambda k: F.least(F.floor(F.col("d")[k] / wide), F.lit(last))
    cells = items.withColumn("cell", F.array(*[cell(k) for k in range(PIVOTS)]))
    tiles = cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    own = lambda name: F.pmod(F.xxhash64("item"), F.col("tiles")).alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias(name)
    beside = lambda k: F.filter(F.array(*[F.col("cell")[k] + F.lit(s) for s in (-1, 0, 1)]), lambda c: (c >= 0) & (c <= last))
    left = cells.withColumn("x", F.explode(beside(0))).withColumn("y", F.explode(beside(1))).withColumn("z", F.explode(beside(2))).withColumn("cell", F.array("x", "y", "z"))
    left = left.join(tiles, "cell").select("cell", F.col("item").alias("a"), F.col("v").alias("va"), F.col("d").alias("da"), own("ta"), every("tb"))
    right = cells.join(tiles, "cell").select("cell", F.col("item").alias("b"), F.col("v").alias("vb"), F.col("d").alias("db"), "n", own("tb"), every("ta"))
    close = F.forall(F.zip_with("da", "db", lambda x, y: F.abs(x - y)), lambda x: x <= wide)
    met = left.join(right, ["cell", "ta", "tb"]).filter((F.col("a") < F.col("b")) & close)
    return met.select("a", "b", _dot("va", "vb").alias("r"), "n")


def strong_pairs(series: DataFrame, least: float) -> DataFrame:
    """a, b, r, n of every pair of items of a dense series with |r| >= least (above 0), a before b."""
    items = kept(_with_angles(kept(unit_vectors(series), "vectors")), "angles")
    return _near(items, math.acos(min(least, 1.0))).filter(F.abs("r") >= least)


def strongest_pairs(series: DataFrame, most: int) -> DataFrame:
    """The `most` pairs of items of a dense series with the largest |r| (all, if fewer), ties by a and b.

    Items next to each other in the order of the first pivot's angles give `most` pairs to begin with; no pair that is weaker than the last
    of these can be among the strongest.
    """
    items = kept(_with_angles(kept(unit_vectors(series), "vectors")), "angles")
    order = numbered(items.select("item", "v", F.col("d")[0].alias("d0")), F.col("d0"), F.col("item"))
    ahead = order.select(F.col("v").alias("w"), F.explode(F.array(*[F.col("row") - k for k in range(1, most + 1)])).alias("row"))
    known = [abs(r[0]) for r in order.join(ahead, "row").select(_dot("v", "w").alias("r")).orderBy(F.desc(F.abs("r"))).limit(most).collect()]
    angle = math.acos(min(known[-1], 1.0)) if len(known) == most else math.pi / 2
    return _near(items, angle).orderBy(F.desc(F.abs("r")), "a", "b").limit(most)
