"""Loading tables by configuration: read text, reshape, clean, filter, aggregate, project."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import BUCKETS
from ..plans.contract import checked
from ..operators.filters import in_set, metric_filter


@dataclass(frozen=True)
class Cleaning:
    """Characters to strip, texts that mean null, and whether the rest becomes a number (else null)."""

    strip: str = "$,% "
    nulls: tuple[str, ...] = ("", "-", "N/A", "null")
    numeric: bool = True


@dataclass(frozen=True)
class LoaderConfig:
    separator: str = ","
    encoding: str = "UTF-8"
    unpivot: tuple[tuple[str, ...], str, str] | None = None  # id columns, name of the period, name of the value
    partial: tuple[str, ...] = ()  # periods known to be incomplete
    cleaning: dict[str, Cleaning] = field(default_factory=dict)
    date: tuple[str, str, str] | None = None  # source column, its format, output column
    rename: dict[str, str] = field(default_factory=dict)
    output: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()


def read_text(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all columns as text. Files in UTF-16 are read whole: their line ends aren't single bytes."""
    return spark.read.option("multiLine", encoding.upper().startswith("UTF-16")).option("header", True).option("sep", separator).option("encoding", encoding).csv(path)


def unpivot(df: DataFrame, ids: tuple[str, ...], period: str, value: str) -> DataFrame:
    """All columns but ids as rows of period and value."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], period, value)


def without_periods(df: DataFrame, period: str, known: tuple[str, ...]) -> DataFrame:
    return df.filter(~F.col(period).cast("string").isin(*known)) if known else df


def cleaned(c: Column, rule: Cleaning) -> Column:
    text = F.trim(F.translate(c.cast("string"), rule.strip, ""))
    text = F.when(text.isin(*rule.nulls), F.lit(None)).otherwise(text)
    return text.try_cast("double") if rule.numeric else text


def parsed_dates(df: DataFrame, source: str, pattern: str, output: str) -> DataFrame:
    """Rows whose date can be read, with the date."""
    return df.withColumn(output, F.to_date(F.try_to_timestamp(F.col(source), F.lit(pattern)))).filter(F.col(output).isNotNull())


def projected(df: DataFrame, rename: dict[str, str], output: tuple[str, ...], sort: tuple[str, ...] = ()) -> DataFrame:
    df = df.withColumnsRenamed(rename)
    df = df.select(*output) if output else df
    return df.orderBy(*sort) if sort else df


def load(df: DataFrame, config: LoaderConfig, *, filters: dict[str, object] | None = None, metrics: object = None, metric_column: str = "metric", exclude_partial: bool = True) -> DataFrame:
    """The steps of a configuration over an all-text table, then dimension and metric filters."""
    if config.unpivot:
        df = unpivot(df, *config.unpivot)
        if exclude_partial:
            df = without_periods(df, config.unpivot[1], config.partial)
    df = df.withColumns({c: cleaned(F.col(c), rule) for c, rule in config.cleaning.items() if c in df.columns})
    if config.date:
        df = parsed_dates(df, *config.date)
    df = projected(df, config.rename, config.output, config.sort)
    df = in_set(df, filters or {})
    return metric_filter(df, metric_column, metrics)


def weekly_report(spark: SparkSession, path: str, ids: tuple[str, ...], pattern: str = "M/d/yyyy", known_partial: tuple[str, ...] = ()) -> DataFrame:
    """A wide report, comma-separated UTF-8 or else tab-separated UTF-16, as long rows of ids, period and value."""
    df = read_text(spark, path)
    if len(df.columns) < len(ids) + 1:
        df = read_text(spark, path, "\t", "UTF-16")
    config = LoaderConfig(unpivot=(ids, "week", "value"), partial=known_partial, cleaning={"value": Cleaning()}, date=("week", pattern, "period"))
    return load(df, config).drop("week")


def period_aggregate(df: DataFrame, date: str, grain: str, keys: tuple[str, ...], sums: tuple[str, ...] = (), averages: tuple[str, ...] = (), distincts: tuple[str, ...] = (), derived: dict[str, str] | None = None) -> DataFrame:
    """Sums, means and distinct counts per period and keys, then expressions over them: arithmetic and known functions of known columns alone. Filters placed before it reach the scan."""
    aggregates = [*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(f"avg_{c}") for c in averages], *[F.count_distinct(c).alias(f"n_{c}") for c in distincts]]
    out = df.groupBy(BUCKETS[grain](F.col(date)).alias("period"), *keys).agg(*aggregates)
    for name, expression in (derived or {}).items():
        out = out.withColumn(name, checked(expression, out.columns))
    return out


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, from the files' footers alone."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def distinct_values(df: DataFrame, column: str, most: int = 500) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most)


def open_source(spark: SparkSession, source: dict[str, str]) -> DataFrame:
    """The table of a contract's data source: csv or text files, or any format that Spark reads."""
    kind, path = source.get("type", "csv").lower(), source["path"]
    if kind in ("csv", "text", "tsv"):
        return read_text(spark, path, source.get("separator", "\t" if kind == "tsv" else ","), source.get("encoding", "UTF-8"))
    return spark.read.format({"extract": "parquet"}.get(kind, kind)).load(path)
