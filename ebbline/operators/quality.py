"""Checks of a table against its contract, and profiles that propose one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import distinct_periods, gaps
from ..sources.sinks import kept

#: Formats that a date column may have.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy-MM", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MMM yyyy")

#: What a text must look like for a format to read it, and for a cast to see a number in it. Parsers throw where they fail, which costs a hundred times a look;
#: so a text that can't be read isn't tried. Whether one that looks right is read, the parser says.
_PARTS = {"yyyy": "[+-]?[0-9]{4,}", "MMM": "[^0-9]+", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}"}
NUMBER_LIKE = r"^[\x00-\x20]*[+-]?(?:(?:[iI][nN][fF]|[nN][aA][nN]|0[xX])[\s\S]*|[0-9]*\.?[0-9]*(?:[eE][+-]?[0-9]+)?[fFdD]?[\x00-\x20]*)$"


def date_like(date_format: str) -> str | None:
    """A pattern that all texts match which the format reads; None for a format of other parts than those known here."""
    out = ""
    for whole in re.finditer(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']", date_format):
        x = whole[0]
        if x[0] == "'":
            out += re.escape(x[1:-1])
        elif x[0].isalpha():
            if x not in _PARTS:
                return None
            out += _PARTS[x]
        else:
            out += re.escape(x)
    return f"^(?i:{out})$"


def readable(text: Column, date_format: str) -> Column:
    """Whether a format reads a text; null or false if not."""
    read, like = F.try_to_timestamp(text, F.lit(date_format)).isNotNull(), date_like(date_format)
    return read if like is None else text.rlike(like) & read


def profile(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows, filled and distinct values, least, largest, mean and deviation of numeric columns, in one pass."""
    one = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(c).alias("filled"), F.count_distinct(F.col(c)).alias("distinct"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd")) for c in columns]
    return df.agg(F.array(*one).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def duplicate_rows(df: DataFrame, grain: tuple[str, ...]) -> DataFrame:
    """One row: the rows beyond the first of each grain key."""
    return df.groupBy(*grain).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))


def date_share(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> dict[str, Column]:
    """The share of filled values that each format reads."""
    text = c.cast("string")
    return {f: F.avg(F.when(text.isNotNull(), readable(text, f).cast("double"))) for f in formats}


def numeric_share(c: Column) -> Column:
    return F.avg(F.when(c.isNotNull(), number(c).isNotNull().cast("double")))


def frequency(df: DataFrame, day: str) -> DataFrame:
    """One row: the median positive gap in days, and the frequency it means."""
    g = gaps(distinct_periods(df, day)).agg(F.percentile("gap", F.lit(0.5)).alias("gap"))
    name = F.when(F.col("gap") <= 1, "daily").when(F.col("gap").between(5, 8), "weekly").when(F.col("gap").between(25, 35), "monthly").when(F.col("gap").between(85, 100), "quarterly").when(F.col("gap").between(350, 380), "yearly").otherwise("irregular")
    return g.withColumn("frequency", name)


def dependencies(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(child, parent) pairs where each child value has one parent and there are more children than parents; nulls tell nothing.

    Each combination of values counts once for each of its values, and each value of each column keeps the least and the largest value of
    every other column, which are equal where there is but one. Extremes of texts are found by sorting, so combinations come first: a task sends and sorts no more of them than it has seen.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "child string, parent string, children long, parents long")
    text = [F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(columns)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("v")) for k in range(len(columns))])).alias("e")
    seen = df.select(*text).distinct().select("*", each).filter("e.v IS NOT NULL").groupBy("e.k", "e.v").agg(*[f(f"_{k}").alias(f"{n}{k}") for k in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))])
    one = [F.struct(F.lit(p).alias("parent"), F.lit(k).alias("p"), F.bool_and(F.col(f"lo{k}").eqNullSafe(F.col(f"hi{k}"))).alias("one")) for k, p in enumerate(columns)]
    found = kept(seen.groupBy("k").agg(F.count("*").alias("children"), F.array(*one).alias("parents")), "dependencies")  # a row a column
    sizes = found.select(F.col("k").alias("p"), F.col("children").alias("parents"))
    pairs = found.select("k", "children", F.explode("parents").alias("p")).select("k", "children", "p.*").filter("one AND k <> p")
    return pairs.join(sizes, "p").filter("children > parents").select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("k") + 1).alias("child"), "parent", "children", "parents")


#: Words in names of columns that number things, and in names of money and of rates.
IDENTIFIER_NAMES = ("id", "code", "key", "fips", "zip", "sku", "num")


def numbers_in(c: Column) -> Column:
    return number(c)


def ratio_rule(x: Column) -> Column:
    """Whether a column's numbers are rates: all within [0, 1.01], or within [0, 100] and close together."""
    return (F.min(x) >= 0) & ((F.max(x) <= 1.01) | ((F.max(x) <= 100) & (F.stddev_samp(x) < 30)))


def identifier_rule(c: Column, name: str) -> Column:
    """Whether a column's numbers name rows: whole, hardly ever repeated, none negative, and either called so or within a narrow range."""
    x = numbers_in(c)
    named = F.lit(any(h in name.lower() for h in IDENTIFIER_NAMES))
    return F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)) & (F.approx_count_distinct(x, 0.02) > 0.95 * F.count(x)) & (F.min(x) >= 0) & (named | (F.max(x) - F.min(x) <= 1000))


def symbol_hints(c: Column) -> dict[str, Column]:
    """The shares of values with a currency sign before them, and with a percent sign after them."""
    share = lambda x: F.avg(x.cast("double"))
    return {"currency": share(c.startswith("$")), "percentage": share(c.endswith("%"))}


def categories(df: DataFrame, column: str, samples: int = 10) -> DataFrame:
    """One row: how many values a column has, and the first of them."""
    kinds = kept(df.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n")).filter("kind IS NOT NULL"), "categories")
    first = kinds.orderBy("kind").limit(samples).agg(F.sort_array(F.collect_list("kind")).alias("samples"))
    return kinds.agg(F.count("*").alias("cardinality")).crossJoin(F.broadcast(first))


def number(c: Column) -> Column:
    """A text as number, without currency signs, thousands' commas, percent signs and spaces; null if it isn't one."""
    text = F.translate(c.cast("string"), "$,% ", "")
    return F.when(text.rlike(NUMBER_LIKE), text.try_cast("double"))


def unreadable_dates(c: Column, date_format: str) -> Column:
    """How many values a date format doesn't read, nulls among them."""
    return F.count_if(F.try_to_timestamp(c, F.lit(date_format)).isNull())


def not_numeric(c: Column) -> Column:
    """How many values are no numbers, nulls among them."""
    return F.count_if(number(c).isNull())


def rollup_integrity(parents: DataFrame, children: DataFrame, key: str, value: str, tolerance: float = 0.0001) -> DataFrame:
    """By key: the parents' sum, that of their children, and whether they agree within the tolerance; a key on one side alone doesn't."""
    one = lambda df, name: df.groupBy(key).agg(F.sum(value).cast("double").alias(name))
    both = one(parents, "parent").join(one(children, "children"), key, "full")
    close = F.abs(F.col("parent") - F.col("children")) <= tolerance * F.abs("parent")
    return both.withColumn("adds_up", F.coalesce(close, F.lit(False)))


def row_budget(df: DataFrame, most: int = 250_000) -> DataFrame:
    """One row: the rows of a table, and whether they are within the budget of an analysis."""
    return df.agg(F.count("*").alias("rows"), (F.count("*") <= most).alias("within_budget"))


def best_format(df: DataFrame, column: str, least: float = 0.8) -> DataFrame:
    """The date format that reads most of a column, its share, and whether that makes it a time column; no row if none reads any."""
    shares = date_share(F.col(column))
    rows = df.agg(F.array(*[F.struct(F.lit(f).alias("format"), c.alias("share")) for f, c in shares.items()]).alias("s"))
    best = rows.select(F.explode("s").alias("s")).select("s.*").filter("share > 0").orderBy(F.desc("share"), "format").limit(1)
    return best.withColumn("is_time", F.col("share") > least)


def number_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: the share of a column that reads as numbers, their least, largest, negative and distinct ones."""
    x = df.select(F.col(column).alias("_c"), number(F.col(column)).alias("_x"))
    return x.agg(numeric_share(F.col("_c")).alias("share"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.count_if(F.col("_x") < 0).alias("negatives"), F.count_distinct("_x").alias("distinct"))


def suggestions(df: DataFrame, value: str, day: str, share: float = 0.05) -> DataFrame:
    """One row: the amount that a contract may take as material (a share of the mean), and the months that the table spans."""
    d = F.to_date(day)
    return df.agg((share * F.avg(value)).alias("materiality"), F.round(F.datediff(F.max(d), F.min(d)) / 30).cast("int").alias("months"))
