"""Small helpers that the operators share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the documents: a longest run of characters other than these blanks.
BLANKS = r"[\x20\x09-\x0D]+"

#: Bytes of rows that a Python worker gets at once, where a session sets nothing else (Spark's default is 64 MB, which each task holds several times over).
BATCH = 4 << 20

#: Scratch paths of the innermost open `dropped_after`, if any.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, of whose rows Python workers from now on get about BATCH bytes at once, however long its texts are; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH))
    return df


def shared_top(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a session on one machine may do without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def scratch(spark: SparkSession, name: str, *, outer: bool = False) -> str:
    """A new path below the shared folder; with `outer`, it outlives the innermost dropped_after."""
    path = f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_open) > outer:
        _open[-1 - outer].append(path)
    return path


def written(df: DataFrame, name: str, *, outer: bool = False) -> DataFrame:
    """df, written once as a table in the shared folder and read again: cuts lineage.

    A join of such tables on a key that many rows share can also be split by adaptive execution, which a join on
    an aggregation of the same stage can't.
    """
    path = scratch(df.sparkSession, name, outer=outer)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the scratch tables that the block made. What is read later must have been written with `outer`, or by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once even where body names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A parameter's rows as a table, from one literal: no Python data in the plan, which is as large for many rows as for few. schema: `name:type,...`"""
    return spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
