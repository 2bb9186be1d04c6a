"""Looks that spare the parsers failing texts, and dependencies from combinations."""

import time

import pytest
from pyspark.sql import functions as F

from ebbline.operators import quality as qa

TEXTS = [
    "2024-02-29", "2023-02-29", "2024-2-29", "+12024-01-01", "-2024-01-01", "0000-01-01", "2024/01/31", "01/31/2024", "31/01/2024", "31-01-2024", "01-31-2024", "2024-01", "20240131", "120240131", "2024-01-31 23:59:59", "2024-01-31 24:00:00",
    "2024-01-31T10:11:12", "2024-01-31t10:11:12", "Jan 2024", "jan 2024", "JAN 2024", "Sept 2024", "January 2024", "Jan  2024", "Jan +12024", "Jan 24", " 2024-01-31", "2024-01-31 ", "2024-01-31\n", "٢٠٢٤-٠١-٣١", "", " ", None,
    "1", "-1.5", "+.5", "5.", ".", "1e5", "1E-5", "1e", "1d", "1f", "1L", "0x1p3", "0X1.8p1", "0x", "NaN", "nan", "-NaN", "inf", "-inf", "+Infinity", "infinity", "Infinityx", "INF", "nation", "$1,234.50", "12 %", "\t7\n", " 7", "--1", "1-2", "1 2", "1_0", "九", "Infinity ", " nan ",
]


def test_looks_change_no_reading(spark):
    """Texts that don't look right are those that the parsers can't read, for every format and for numbers."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    cleaned = F.translate("t", "$,% ", "")
    plain = [F.coalesce(F.try_to_timestamp("t", F.lit(f)).isNotNull(), F.lit(False)) for f in qa.DATE_FORMATS]
    looked = [F.coalesce(qa.readable(F.col("t"), f), F.lit(False)) for f in qa.DATE_FORMATS]
    rows = df.select("t", F.array(*plain).alias("a"), F.array(*looked).alias("b"), cleaned.try_cast("double").cast("string").alias("x"), qa.number(F.col("t")).cast("string").alias("y")).collect()
    assert [(r.t, r.a, r.x) for r in rows] == [(r.t, r.b, r.y) for r in rows]
    assert all(any(r.a[k] for r in rows) for k in range(len(qa.DATE_FORMATS))) and sum(r.x is not None for r in rows) > 15


@pytest.mark.parametrize("columns", [("top", "mid", "leaf"), ("leaf", "mid", "top")])
def test_dependencies_of_repeated_combinations(spark, columns):
    df = spark.range(0, 3000).select((F.col("id") % 2).cast("string").alias("top"), (F.col("id") % 6).cast("string").alias("mid"), F.when(F.col("id") % 24 > 0, F.col("id") % 24).cast("string").alias("leaf"))
    found = {tuple(r) for r in qa.dependencies(df, columns).select("child", "parent", "children", "parents").collect()}
    assert found == {("mid", "top", 6, 2), ("leaf", "top", 23, 2), ("leaf", "mid", 23, 6)}


def test_texts_that_no_format_reads_are_not_tried(spark):
    """Names of nations take the formats no more than a few times what a look takes."""
    df = spark.range(0, 200_000, 1, 1).select(F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("t"))

    def seconds(*columns):
        df.agg(*columns).collect()
        began = time.time()
        df.agg(*columns).collect()
        return time.time() - began

    look = seconds(*[F.avg(F.col("t").rlike(f"^{k}[0-9]{{2}}$").cast("double")) for k in range(len(qa.DATE_FORMATS))])
    assert seconds(*qa.date_share(F.col("t")).values()) < 5 * look + 0.5
