"""Words and wildcards by their rarest grams, against trying all."""

import random

from pyspark.sql import functions as F

from ebbline.operators import alerts as al
from ebbline.operators import patterns as pt


def _names(rng, n, letters="abAB1é*?"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(n)]


def test_words_against_all(spark):
    rng = random.Random(1)
    for words in (_names(rng, 12), [w for w in _names(rng, 40) if w], ["a", None, "é1"], []):
        texts = [*_names(rng, 150), None, "ΑΣΒ Brand#1"]
        got = pt.texts_with_words(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(w,) for w in words], "word string"))
        want = sorted({t for t in texts if t is not None and any(w is not None and w in t for w in words)})
        assert sorted(r.text for r in got.collect()) == want


def _slow(rows, rules):
    return rows.join(rules, al.fits_rule(F.col("item"), F.col("target"), F.col("period"), F.col("score")), "left_semi").select("id")


def test_rules_against_all(spark):
    rng = random.Random(2)
    globs = lambda: rng.choice([None, [], ["*"], ["??*"], ["?"], [g + "*" for g in _names(rng, 2)], ["*" + g for g in _names(rng, 1)], [None, "a*b"], ["*", "b*"], ["A?1"]])
    rules = [(globs(), globs(), rng.choice([None, [], ["p1"], ["p1", "p2"]]), rng.choice([None, 0.3, 0.8])) for _ in range(40)]
    rows = [(k, rng.choice([None, *_names(rng, 1, "abAB1é")]), rng.choice([None, *_names(rng, 1, "abAB1é")]), rng.choice([None, "p1", "p2", "p3"]), rng.choice([None, 0.1, 0.5, 0.9])) for k in range(300)]
    rows = spark.createDataFrame(rows, "id int, item string, target string, period string, score double")
    for k in range(0, 40, 4):
        some = spark.createDataFrame(rules[k : k + 4], al.RULES)
        got = al.fitting(rows, some, ("id",), "item", "target", "period", "score")
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in _slow(rows, some).collect())
    assert al.fitting(rows, some.limit(0), ("id",), "item", "target", "period", "score").count() == 0


def test_many_words_meet_by_an_equal_key(spark):
    """100,000 words against 200,000 texts; no join without a key but that of one row at most."""
    texts = spark.range(200000).select(F.concat(F.lit("Brand#"), F.col("id")).alias("text"))
    words = spark.range(100000).select(F.concat(F.lit("d#"), F.col("id") * 7 + 100000, F.lit("")).alias("word"))
    found = pt.met(texts, words.select(F.col("word").alias("pattern")), F.array(F.col("pattern")))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert pt.texts_with_words(texts.filter("text LIKE '%00'"), words.filter("word LIKE '%00'")).count() > 0
