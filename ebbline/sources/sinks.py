"""Writing tables and results where all executors can read them again."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Scratch paths of the open `dropped_after` blocks, the innermost last.
_open: list[list[str]] = []

_COMMIT = "number long, folder string, form string, options map<string,string>, by array<string>, schema string, rows long"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the session shares with its executors; only a session on one machine may do without the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, whatever the block has put below the shared folder, also where it fails. What is read later must be written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at, files = _at(spark, path)
            files.delete(at, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once below the shared folder and read again: for aggregated rows that several steps use."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """All rows as delimited text with a header, in a new folder."""
    df.write.option("header", True).csv(path)


def write_results(df: DataFrame, path: str, by: str = "metric") -> None:
    """Structured results as JSON, a folder for each value of `by`, in a new folder that any reader understands. `commit` is for those that reruns replace."""
    df.write.partitionBy(by).json(path)


def commit(df: DataFrame, path: str, *, form: str = "parquet", by: tuple[str, ...] = (), **options: str) -> Row:
    """Writes df as the table at `path`, in place of what it held, and returns the commit.

    Rows go to a folder of their own, and only when all of them are written does one line in `path`/commits name that folder (one small
    file that appears at once, so object stores need no rename of data). A run that fails, or loses its driver, leaves the table as it was,
    and its folder is removed by `vacuum`. Of two that commit at the same moment one wins, for all readers alike. df may read the table
    that it replaces. Columns of `by` become folders; null is kept, an empty text reads as null.
    """
    spark, top = df.sparkSession, path.rstrip("/")
    before, rows = latest_commit(spark, top), Observation()
    folder = f"data/{uuid.uuid4().hex}"
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).format(form).options(**options).save(f"{top}/{folder}")
    entry = {"number": before.number + 1 if before else 1, "folder": folder, "form": form, "options": options, "by": list(by), "schema": df.schema.json(), "rows": rows.get["rows"]}
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(entry)).alias("value")).write.mode("append").text(f"{top}/commits")
    return latest_commit(spark, top)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits of the table at `path`; none where there is no table."""
    at, files = _at(spark, f"{path.rstrip('/')}/commits")
    if not files.exists(at):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.text(f"{path.rstrip('/')}/commits").select(F.from_json("value", _COMMIT).alias("c")).select("c.*").filter("number IS NOT NULL")


def latest_commit(spark: SparkSession, path: str) -> Row | None:
    return commits(spark, path).orderBy(F.desc("number"), F.desc("folder")).limit(1).first()


def committed(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table at `path` as last committed, or as of commit `number`, as long as `vacuum` hasn't removed that."""
    found = latest_commit(spark, path) if number is None else commits(spark, path).filter(F.col("number") == number).orderBy(F.desc("folder")).first()
    if found is None:
        raise ValueError(f"nothing is committed at {path}")
    schema = StructType.fromJson(json.loads(found.schema))
    for field in schema.fields:
        field.nullable = True
    df = spark.read.schema(schema).format(found.form).options(**found.options).load(f"{path.rstrip('/')}/{found.folder}")
    return df.select(*[F.col(f"`{n}`") for n in schema.names])


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes what failed and earlier runs have left: every folder but that of the last commit. Returns their number. Not while a run writes or reads them."""
    last = latest_commit(spark, path)
    at, files = _at(spark, f"{path.rstrip('/')}/data")
    old = [f.getPath() for f in (files.listStatus(at) if files.exists(at) else []) if last is None or f"data/{f.getPath().getName()}" != last.folder]
    for folder in old:
        files.delete(folder, True)
    return len(old)
