"""URL rules by a sort-merge range join over canonical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse order, each with a dot after it: a host's subdomains are the keys that start with its own."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def prefix_stacks(points: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """points (key, tie, ...) with `stack`: all of `prefixes` (prefix, distinct) that start their key, shortest first.

    A prefix stands for the interval of keys that start with it, and two intervals are nested or
    disjoint. Starts of intervals and points are sorted together by range, so that a key shared by
    many rows spreads over tasks (`tie` splits it); each start carries the stack of intervals open
    there. A sweep hands the last start's stack to each point, which keeps what it lies in. Into
    each block of the sort order comes the last start of the blocks before it: one row a block.
    """
    outer = prefixes.select(F.col("prefix").alias("of"), F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("n"))
    outer = outer.select("of", F.expr("substring(of, 1, n)").alias("prefix"))
    stacks = outer.join(prefixes, "prefix").groupBy("of").agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix"))).alias("stack"))
    starts = stacks.select(F.col("of").alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), F.col("stack.prefix").alias("stack"))
    rest = [c for c in points.columns if c not in ("key", "tie")]
    row = F.struct(*rest) if rest else F.struct(F.lit(0))
    events = points.select("key", F.lit(1).alias("kind"), "tie", F.lit(None).cast("array<string>").alias("stack"), row.alias("row"))
    events = events.unionByName(starts, allowMissingColumns=True)
    blocks = written(events.repartitionByRange("key", "kind", "tie").withColumn("block", F.spark_partition_id()), name)
    last = blocks.groupBy("block").agg(F.max(F.when(F.col("kind") == 0, F.struct("key", "stack"))).alias("last"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("block", F.last("last", ignorenulls=True).over(before).alias("last")).select("block", F.lit("").alias("key"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.col("last.stack").alias("stack"))
    swept = blocks.unionByName(carried, allowMissingColumns=True)
    so_far = Window.partitionBy("block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("stack", F.last("stack", ignorenulls=True).over(so_far)).filter(F.col("kind") == 1)
    opened = F.coalesce(F.filter("stack", lambda p: F.col("key").startswith(p)), F.array().cast("array<string>"))
    return swept.select("key", "tie", *[F.col("row")[c].alias(c) for c in rest], opened.alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url, ...).

    rules (host, path, verdict): a rule fits its host and all subdomains, if the url's path starts
    with the rule's. The longest fitting rule wins, counted in characters of host and path together;
    of equals the one with the longer host, and of two verdicts for one rule, block. Hosts are swept
    first: each page gets the stack of rules' hosts that it lies under. Each of those makes a key with the
    page's path, and a second sweep finds the rules' paths that start it. Null urls have an empty
    host and path, and meet rules like any other. No rule, or no rules: null and the default verdict.
    Repeated rows are judged once each; other columns are ignored.
    """
    rules = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({"under": host_key(F.col("host")), "rule": F.concat("host", "path")}).withColumn("prefix", F.concat("under", "path"))
    judged = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = prefix_stacks(judged.withColumns({"key": host_key(F.col("host")), "tie": F.xxhash64("path", "page_id")}), rules.select(F.col("under").alias("prefix")).distinct(), "url-hosts")
    found = hosts.withColumn("row_id", F.monotonically_increasing_id())
    found = written(found, "url-found").drop("key", "tie")
    keys = found.select("row_id", "path", F.explode("stack").alias("under")).select("row_id", F.concat("under", "path").alias("key"), F.col("row_id").alias("tie"))
    fits = prefix_stacks(keys, rules.select("prefix"), "url-paths").select("row_id", F.explode("stack").alias("prefix"))
    fits = fits.join(rules.select("prefix", "rule", "verdict", F.struct(F.length("rule").alias("n"), F.length("host").alias("h")).alias("rank")), "prefix")
    best = fits.groupBy("row_id").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    return found.join(best, "row_id", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
