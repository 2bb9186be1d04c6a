"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, let, written

#: Items that one task folds at once; each round leaves one of so many.
FOLD = 64


def size_of(text: Column) -> Column:
    """Words of a text: its pieces between blanks, less an empty one at either end."""

    def count(p: Column) -> Column:
        ends = (F.element_at(p, 1) == "").cast("int") + (F.element_at(p, -1) == "").cast("int")
        return F.greatest(F.size(p) - ends, F.lit(0)).cast("long")

    return let(F.split(F.coalesce(text, F.lit("")), BLANKS), count)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of all sizes by weight, none above `most` times its size.

    Weights repeat over the sources by code point, null last. What a cap frees goes to the others by
    weight, until none is above: the level at which the shares add up is found on the sources
    sorted by the level at which each reaches its cap. There is a row a source here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.withColumn("weight", F.get(w, (F.row_number().over(order) - 1) % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source whose level is below its own cap; past it the formula means nothing
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", (-F.col("level")).alias("less")))).over(every)
    return rows.withColumn("share", -first["less"] * F.col("weight")).select("source", "source_size", F.least("cap", F.coalesce("share", "cap")).alias("target"))


def chance(*of) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") / float(1 << 52)


def fold(items: Column, seed: int, round_no: int) -> Column:
    """(left, done) of items (a, id, x): pairs are settled one after another, the largest first.

    Of two items with parts x and sizes a, one is raised and the other lowered so that a * x keeps its
    sum, up to where one is 0 or 1; which of the two is drawn so that both keep their expectation.
    The one that is settled goes to `done`; the other meets the next item. A large item is settled
    by the smaller ones that follow it, so that what is left at the end, the source's error, is small.
    """
    kind = "struct<a:double,id:struct<h:bigint,d:bigint>,x:double>"
    item = lambda i, x: F.struct(i["a"].alias("a"), i["id"].alias("id"), x.alias("x"))

    def step(s: Column, j: Column) -> Column:
        i = s["left"]
        up = F.least(1 - i["x"], j["x"] * j["a"] / i["a"])
        down = F.least(i["x"], (1 - j["x"]) * j["a"] / i["a"])
        raised = chance(i["id"], j["id"], F.lit(seed), F.lit(round_no)) * (up + down) < down
        # raising i ends with i at 1 or j at 0; lowering it with i at 0 or j at 1
        i_ends = F.when(raised, (1 - i["x"]) <= j["x"] * j["a"] / i["a"]).otherwise(i["x"] <= (1 - j["x"]) * j["a"] / i["a"])
        ends = F.when(raised, F.when(i_ends, 1.0).otherwise(0.0)).otherwise(F.when(i_ends, 0.0).otherwise(1.0))
        moved_i = F.when(raised, i["x"] + up).otherwise(i["x"] - down)
        moved_j = F.when(raised, j["x"] - up * i["a"] / j["a"]).otherwise(j["x"] + down * i["a"] / j["a"])
        clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        settled = F.when(i_ends, item(i, ends)).otherwise(item(j, ends))
        left = F.when(i_ends, item(j, clip(moved_j))).otherwise(item(i, clip(moved_i)))
        first = i.isNull()
        return F.struct(F.when(first, j).otherwise(left).alias("left"), F.when(first, s["done"]).otherwise(F.concat(s["done"], F.array(settled))).alias("done"))

    start = F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, step)


def round_parts(parts: DataFrame, seed: int) -> DataFrame:
    """(id, x) with each x 0 or 1, from (source, id, a, x) with 0 < x < 1 and distinct ids.

    The sum of a * x of each source is kept to within half an item: the last one goes to the nearer side. Items are dealt to groups of about FOLD by a hash
    of their id, each group is folded in one row, and what is left of each goes to the next round,
    so that a round has about 1/FOLD of the rows of the one before, however large a source is.
    """
    done, round_no = None, 0
    left = parts.select("source", F.struct("a", "id", "x").alias("item"))
    while True:
        counts = left.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("n"))
        groups = F.ceil(F.col("n") / FOLD)
        dealt = left.join(counts, F.col("source").eqNullSafe(F.col("_source"))).select("source", "item", groups.alias("groups"))
        dealt = dealt.withColumn("group", F.pmod(F.xxhash64("item.id", F.lit(seed), F.lit(round_no)), F.col("groups")))
        folded = dealt.groupBy("source", "group").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"), F.max("groups").alias("groups"))
        folded = written(folded.select("source", "groups", fold(F.col("items"), seed, round_no).alias("f")), f"mix-round-{round_no}")
        settled = folded.select(F.explode("f.done").alias("d")).select("d.id", F.col("d.x"))
        done = settled if done is None else done.unionByName(settled)
        more = folded.filter("groups > 1 AND f.left IS NOT NULL")
        last = folded.filter("groups = 1 AND f.left IS NOT NULL").select("f.left.*")
        done = done.unionByName(last.select("id", (F.col("x") >= 0.5).cast("double").alias("x")))
        if more.isEmpty():
            return done
        left, round_no = more.select("source", F.col("f.left").alias("item")), round_no + 1


def identity() -> Column:
    """Tells items apart: rows of one id, source and text are one item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text, F.col("source").cast("string")).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"))


def copies_due(docs: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """A row an item: doc_id, source, size, id, rows, source_size, target, and total, the copies of all its rows together."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), identity().alias("id"))
    items = written(rows.groupBy("doc_id", "source", "size", "id").agg(F.count("*").alias("rows")), "mix-items")
    goals = written(targets(items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most), "mix-targets")
    due = items.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    due = due.withColumn("due", F.when(F.col("size") == 0, 0.0).otherwise(F.col("rows") * F.col("target") / F.col("source_size"))).withColumn("whole", F.floor("due")).withColumn("x", F.col("due") - F.col("whole"))
    rounded = round_parts(due.filter("x > 0").select("source", "id", F.col("size").cast("double").alias("a"), "x"), seed)
    total = F.col("whole") + F.coalesce(F.col("up"), F.lit(0.0)).cast("long")
    return due.join(rounded.select("id", F.col("x").alias("up")), "id", "left").withColumn("total", total).drop("due", "whole", "x", "up")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and copies for each row of docs (doc_id, text, source).

    Each document is due target / source_size copies: the whole ones, and one more with the rest as its chance,
    rounded so that each source's words stay at its target. Equal rows (id, source and text) are one item that is due as many
    times the copies; its copies are dealt over its rows, and differ by one at most. Documents without words get no copies.
    Draws hash ids and texts, so a rerun agrees, however the rows are dealt. Null texts have no words; null sources are one source; null ids are told apart by their texts.
    """
    due = copies_due(docs, weights, most, seed)
    each = due.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row"))
    copies = F.floor(F.col("total") / F.col("rows")) + F.when(F.col("row") <= F.col("total") % F.col("rows"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def take(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of the mix, with all columns of docs: each document as many times as mix() gives it copies."""
    due = written(copies_due(docs, weights, most, seed).select("id", "rows", "total"), "mix-copies")
    # the rows go through as one column, whatever names their own columns have
    rows = docs.select(identity().alias("_item"), F.struct(*docs.columns).alias("row"))
    if not due.filter("rows > 1").isEmpty():
        rows = rows.dropDuplicates(["_item"])
    taken = rows.join(due.filter("total > 0").select(F.col("id").alias("_item"), "total").hint("shuffle_hash"), "_item")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total")))).select("row.*")
