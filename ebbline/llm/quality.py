"""Quality rules whose cutoffs carry a guarantee on falsely rejected documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, let, words_of, written

WINDOW = 8


def covered_words(words: Column) -> Column:
    """How many words lie in 8-word windows that are found twice or more among the words.

    Most texts repeat no window, which the count of distinct window hashes tells. The others'
    windows are sorted as strings with their places; a window equal to a neighbour is repeated.
    """
    starts = F.sequence(F.lit(1), F.size(words) - WINDOW + 1)

    def exact(w: Column) -> Column:
        places = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("s"), i.alias("i"))))
        again = let(places, lambda a: F.filter(a, lambda x, k: (F.get(a, k - 1)["s"] == x["s"]).eqNullSafe(True) | (F.get(a, k + 1)["s"] == x["s"]).eqNullSafe(True)))
        at = F.array_sort(F.transform(again, lambda x: x["i"]))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(a, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x))

    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    repeats = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).when(repeats, exact(words)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """The counts of each document of docs (text, ...); all other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))
    counts = let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), covered_words(w).alias("n_repeat_words")),
    )
    line_counts = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    rest = [c for c in docs.columns if c != "text"]
    out = docs.select(
        *rest,
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        counts.alias("_w"),
        line_counts.alias("_l"),
    )
    return out.select(*rest, "word_chars", "n_symbols", "_w.n_words", "_w.n_repeat_words", "_l.n_dup_lines", "_l.n_lines")


#: Score by name, higher is worse: whole parts in a thousand, so that any engine computes the same.
SCORES = {
    "symbols": "CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols * 1000 DIV word_chars END",
    "repeats": "CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 1000 DIV n_words END",
    "dup_lines": "CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 1000 DIV n_lines END",
    "long_words": "CASE WHEN n_words = 0 THEN 0 ELSE least(1000, word_chars * 10 DIV n_words) END",
}
#: Candidate cutoffs of each score, in thousandths (long_words: tenths of a character a word).
CUTOFFS = {
    "symbols": [5, 10, 20, 50, 100, 200, 300, 500],
    "repeats": [20, 50, 100, 150, 200, 250, 300],
    "dup_lines": [50, 100, 200, 300, 400, 500],
    "long_words": [70, 80, 90, 100, 120, 150, 200, 300],
}


def tail_at_most(n: Column, k: Column, risk: float, level: Column) -> Column:
    """Whether P(Binomial(n, risk) <= k) <= level: the exact (Clopper-Pearson) upper bound is at most risk.

    Terms are added by their logarithms, so that large n doesn't underflow; k of n * risk or more fails.
    """
    odds = F.log(F.lit(risk / (1 - risk)))
    zero = n.cast("double") * F.log(F.lit(1 - risk))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    first = F.struct(zero.alias("term"), zero.alias("total"))
    ks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k.cast("double") >= n.cast("double") * risk, F.lit(False)).otherwise(F.aggregate(ks, first, step, lambda s: s["total"]) <= F.log(level))


def certified_cutoffs(labelled: DataFrame, strata: str, risk: float, error: float) -> DataFrame:
    """(stratum, score, cutoff): the lowest cutoff of each score whose false rejections are bounded.

    labelled: features of good holdout documents that the base rules keep, by stratum. A cutoff
    passes if the exact binomial bound on the part of good documents scoring at or above it is at
    most risk / (number of scores), with the error split over all strata, scores and cutoffs
    (Bonferroni): with probability 1 - error no stratum loses over `risk` of its good documents.
    """
    tests = [(s, c) for s, cs in CUTOFFS.items() for c in cs]
    counted = labelled.groupBy(F.col(strata).alias("stratum")).agg(F.count("*").alias("n"), *[F.count(F.when(F.expr(SCORES[s]) >= c, 1)).alias(f"{s}_{c}") for s, c in tests])
    counted = counted.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))  # a row a stratum
    rows = counted.select("stratum", "strata", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{s}_{c}").alias("k")) for s, c in tests])).alias("t")).select("stratum", "strata", "n", "t.*")
    level = F.lit(error) / (F.col("strata") * len(tests))
    passed = rows.filter(tail_at_most(F.col("n"), F.col("k"), risk / len(CUTOFFS), level))
    return passed.groupBy("stratum", "score").agg(F.min("cutoff").alias("cutoff"))


BASE = {"floor": 20, "repeat_percent": 30}


def base_failed(floor: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < floor) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def calibrated(done: DataFrame, labels: DataFrame, strata: str, risk: float, error: float) -> DataFrame:
    """A row a stratum with the certified cutoff of each score, or null, from features of all documents and labels (doc_id, quality)."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    cutoffs = certified_cutoffs(done.filter(~base_failed(**BASE)).join(good, "doc_id", "left_semi"), strata, risk, error)
    return cutoffs.groupBy("stratum").agg(*[F.min(F.when(F.col("score") == s, F.col("cutoff"))).alias(f"_{s}") for s in SCORES])


def verdicts(done: DataFrame, cutoffs: DataFrame, strata: str) -> DataFrame:
    """done with base_failed and kept."""
    joined = done.join(cutoffs, F.col(strata).eqNullSafe(F.col("stratum")), "left").withColumn("base_failed", base_failed(**BASE))
    rejected = F.lit(False)
    for s in SCORES:
        rejected = rejected | F.coalesce(F.expr(SCORES[s]) >= F.col(f"_{s}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", *[f"_{s}" for s in SCORES])


def judge(docs: DataFrame, labels: DataFrame, *, strata: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, features and verdict of every row of docs (doc_id, text, and a column of strata). Other columns are ignored.

    Base rules reject texts of under 20 words or with over 30 percent of words in
    repeated windows. Others are kept unless a score reaches its stratum's certified cutoff; a
    stratum with too few labelled good documents to certify any cutoff rejects nothing more. A
    document labelled more than once is good if any label says so. Null texts are empty and fail;
    a null stratum is a stratum of its own; repeated rows are judged once each; with no labels the
    base rules alone decide. The counts are made once, over whole texts, and written as a narrow table.
    """
    done = written(features(docs.select("doc_id", "text", strata)), "quality")
    return verdicts(done, calibrated(done, labels, strata, risk, error), strata)


def keep_good(docs: DataFrame, labels: DataFrame, *, strata: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps.

    The counts are made once and written beside the rows: texts are read twice, counted once, and never shuffled.
    """
    # the rows go through as one column, whatever names their own columns have
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.col(strata).alias("stratum_"))
    done = written(features(whole), "quality-rows")
    cutoffs = written(calibrated(done.drop("row"), labels, "stratum_", risk, error), "quality-cutoffs")
    return verdicts(done, cutoffs, "stratum_").filter("kept").select("row.*")
