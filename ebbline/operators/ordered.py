"""Totals, ranks and running sums over all rows or over the rows of a group, without a task that holds them all."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates of all its rows: one row of totals, joined to each. df is read twice; keep it first if it is costly."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))


def numbered(df: DataFrame, *order: Column, by: tuple[str, ...] = (), totals: dict[str, str] | None = None, size: str | None = None, **sums: str) -> DataFrame:
    """df with `row`, its place in the order of its group (`by`; all rows, if there is none) from 1 on.

    For each name of `sums`, the sum of that column over the rows before; for each name of `totals`, the sum over the whole group; `size`
    names the group's number of rows. The order must tell all rows of a group apart. Nulls in `by` make a group of their own.

    Rows are dealt by ranges of group and order and written. Each range counts and sums what it has of each group, and these cells, of which a group has
    one a range, tell what lies before. So a group of any size is split over as many tasks as it needs, and no order of all its rows is ever in one task.
    """
    totals = totals or {}
    columns = df.columns
    ranged = kept(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ordered")
    cell = ranged.groupBy("_range", *by).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()], *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    every = Window.partitionBy(*by) if by else Window.partitionBy()  # a row a range of each group
    before = every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cells = cell.select(
        F.col("_range").alias("_at"), *[F.col(c).alias(f"_k_{c}") for c in by],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in ("_n", *[f"_b_{n}" for n in sums])],
        *[F.sum(f"_t_{n}").over(every).alias(n) for n in totals], *([F.sum("_n").over(every).alias(size)] if size else []),
    )
    same = reduce(and_, [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]])
    here = Window.partitionBy("_range", *by).orderBy(*order)
    out = ranged.join(cells if by else F.broadcast(cells), same)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        *columns, *totals, *([size] if size else []), (F.col("_n_0") + F.row_number().over(here)).alias("row"),
        *[(F.col(f"_b_{n}_0") + F.coalesce(F.sum(c).over(earlier), F.lit(0))).alias(n) for n, c in sums.items()],
    )


def quantiles(df: DataFrame, by: tuple[str, ...], value: str, **shares: float) -> DataFrame:
    """One row a group of `by` (one row, if there is none): for each name of `shares` the exact quantile, interpolated between its two neighbours.

    Neighbours are picked by their ranks (`numbered`), so that no buffer holds the distinct values of a group, as exact percentiles of one
    aggregation do. Null values don't count; a group of nulls alone has no row, and without groups an empty table gives nulls.
    """
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    places = numbered(known, F.col("_v"), by=by, size="_n")
    at = {n: (F.col("_n") - 1) * F.lit(float(q)) for n, q in shares.items()}  # places from 0
    picked = places.filter(reduce(or_, [F.col("row").isin(F.floor(x) + 1, F.ceil(x) + 1) for x in at.values()]))
    low = lambda x: F.max(F.when(F.col("row") == F.floor(x) + 1, F.col("_v")))
    high = lambda x: F.max(F.when(F.col("row") == F.ceil(x) + 1, F.col("_v")))
    between = lambda x: F.max(F.ceil(x) - x) * low(x) + F.max(x - F.floor(x)) * high(x)
    # equal neighbours are taken as they are: a place without a second neighbour, and infinite ones
    return picked.groupBy(*by).agg(*[F.when(low(x) == high(x), low(x)).otherwise(between(x)).alias(n) for n, x in at.items()])


def carried(df: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """df with `name`: the last value other than null of a column up to each row, in an order of all rows (an as-of merge, where the rows are a union of two tables).

    Rows are dealt by ranges of the order; each range carries its own values on, and a row a range tells what the ranges before end with.
    """
    columns = df.columns
    ranged = kept(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "carried")
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_in", F.last(value, ignorenulls=True).over(here))
    numbered_in = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).filter(F.col(value).isNotNull())
    ends = numbered_in.groupBy("_range").agg(F.max_by(value, "_r").alias("_end"))
    every = ranged.select("_range").distinct().join(ends, "_range", "left")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = every.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_from"))
    return inside.join(F.broadcast(starts), "_range").select(*columns, F.coalesce("_in", "_from").alias(name))


def first_of_each(df: DataFrame, by: tuple[str, ...], top: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first `top` rows of each group, numbered from 1. A task keeps no more of a group than that before anything is shuffled."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= top)
