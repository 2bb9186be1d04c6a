"""The noisy channel and the classifier of toxic documents."""

import random
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import registry, toxicity
from ebbline.llm.common import table

LEET = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return toxicity.character_model(toxicity.character_counts(docs))


def test_counts_by_brute_force(spark, odd_docs, no_docs):
    want = np.zeros((toxicity.SIZE,) * 4)
    for r in odd_docs.select("text").collect():
        back = (0, 0, 0)
        for ch in f" {(r.text or '').lower()} ":
            code = toxicity.CODE.get(ch, toxicity.OTHER)
            want[(*back, code)] += 1
            back = (*back[1:], code) if code else (0, 0, 0)
    assert (toxicity.character_counts(odd_docs) == want).all() and want.sum() > 100_000
    assert toxicity.character_counts(no_docs).sum() == 0
    assert np.exp(-toxicity.character_model(want).reshape(-1, toxicity.SIZE)).sum(1) == pytest.approx(1.0, abs=1e-4)


def _cheapest(token, model):
    """The best of all ways through the lattice of a token without blanks, one by one."""
    def ways(k, ch):
        same = 0
        while k - same - 1 >= 0 and token[k - same - 1] == ch:
            same += 1
        if ch.isalpha():
            return [(toxicity.CODE.get(ch, toxicity.OTHER), 0.0, ch)] + ([(None, toxicity.TWICE if same == 1 else toxicity.MORE, "")] if same else [])
        out = [(toxicity.OTHER, 0.0, " "), (0, toxicity.PUT_IN if ch.isdigit() else 0.0, " "), *[(toxicity.CODE[x], toxicity.SWAP, x) for x in toxicity.LEET.get(ch, "")]]
        single = (k < 2 or not token[k - 2].isalnum()) and (k + 2 >= len(token) or not token[k + 2].isalnum())
        return out if ch.isdigit() else [*out, (None, toxicity.APART if single else toxicity.PUT_IN, "")]

    best, cube = (np.inf, ""), model.reshape((toxicity.SIZE,) * 4)
    for way in product(*[ways(k, ch) for k, ch in enumerate(token)]):
        back, cost = (0, 0, 0), 0.0
        for code, price, _ in [*way, (0, 0.0, "")]:
            cost += price
            if code is not None:
                if code or back != (0, 0, 0):
                    cost += float(cube[(*back, code)])
                back = (*back[1:], code) if code else (0, 0, 0)
        best = min(best, (cost, "".join(text for *_, text in way)))
    return best[1]


def test_restoration_is_the_cheapest_way(model):
    rnd = random.Random(3)
    for _ in range(300):
        token = "".join(rnd.choice("aeott1i0$!-s3ß") for _ in range(rnd.randrange(1, 8)))
        assert toxicity.restore(token, model).split() == _cheapest(token, model).split(), token


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("idiooot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("tr@5h!!", "trash"), ("l-o-s-e-r,", "loser"), ("cllown", "clown"), ("d1sgu5ting", "disgusting"), ("the###", "the")])
def test_disguises_are_taken_off(model, token, word):
    assert toxicity.words_of(token, model) == (word,)


def test_clean_words_stay(model):
    for token in ("ththe", "anntha", "réeuxre", "achlichkeit", "the", "and"):
        assert toxicity.words_of(token, model) == (token,)
    assert toxicity.words_of("2001-07-31", model) == () and toxicity.words_of("the,and", model) == ("the", "and") and toxicity.words_of("", model) == ()
    assert toxicity.tokens_of("so a b c d, x y") == {"so": 1, "a b c": 1, "d,": 1, "x": 1, "y": 1}


def _disguised(text, insults, rnd):
    def one(w):
        if w.strip(".,!").lower() not in insults:
            return w
        how = rnd.randrange(4)
        return "".join(LEET.get(c, c) for c in w) if how == 0 else " ".join(w) if how == 1 else ".".join(w) if how == 2 else "".join(c * (3 if k == 2 else 1) for k, c in enumerate(w))

    return " ".join(one(w) for w in text.split(" "))


def test_held_out_documents(spark):
    """Fitted on three quarters of the labels: held-out documents, as they are and with their insults disguised."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    fitted = toxicity.fit(docs, labels.filter(~held), most_rows=3000)
    rows = docs.join(labels.filter("toxic IS NOT NULL"), "doc_id").filter(held).select("doc_id", "text", "toxic").collect()
    insults = {x for x in fitted.terms if not x.startswith("^") and x.isascii() and x.isalpha() and fitted.terms[x][1] == 0}
    assert {"idiot", "clown", "moron"} <= insults
    rnd = random.Random(1)
    for change in (lambda t: t, lambda t: _disguised(t, insults, rnd)):
        scorer = toxicity.Scorer(fitted)
        z = [(r.toxic, float(fitted.weights[0] + ((np.array(scorer.vector(change(r.text or ""))) - fitted.mean) / fitted.deviation) @ fitted.weights[1:])) for r in rows]
        caught = sum(y == 1 and s >= np.log(0.3 / 0.7) for y, s in z)
        wrong = sum(y == 0 and s >= np.log(0.3 / 0.7) for y, s in z)
        assert caught >= 0.9 * sum(y for y, _ in z) and wrong <= 0.01 * sum(1 - y for y, _ in z), (caught, wrong)


def test_labels_held_out_tell_nothing(spark, sf, tmp_path):
    """Turning the held-out labels round, or making other columns anew, changes no score."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs.withColumn("lang", F.lit("xx")).withColumn("source", F.reverse("source")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/labels.parquet")
    scores = lambda at: {r.doc_id: (r.held_out, r.score, r.predicted) for r in registry.op13_toxicity(spark, str(at)).collect()}
    one, two = scores(sf), scores(tmp_path)
    assert one.keys() == two.keys() and all(one[d] == pytest.approx(two[d], abs=1e-9) for d in one)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= s <= 1 and p == (s >= 0.3) for d, (h, s, p) in one.items())


def test_own_labels_are_taken_out():
    """A term that one document alone has tells nothing about that document."""
    fitted = toxicity.Toxicity(toxicity.character_model(np.zeros((toxicity.SIZE,) * 4)), {"zebra": (1, 0), "ox": (4, 1)}, 10, 90, np.zeros(6), np.zeros(5), np.ones(5))
    assert toxicity.Scorer(fitted, 1).odds["zebra"] == pytest.approx(toxicity.odds(0, 0, 9, 90)) and toxicity.Scorer(fitted).odds["zebra"] > 3
    assert toxicity.Scorer(fitted, 0).odds["ox"] == pytest.approx(toxicity.odds(4, 0, 10, 89))


def test_short_cuts_change_nothing(model):
    """Tokens that aren't restored for want of a term give what restoring them would."""
    terms = {x: (9, 0) for w in ("idiot", "moron", "réeux", "aals") for x in toxicity.features_of(w)}
    fitted = toxicity.Toxicity(model, terms, 10, 90, np.zeros(6), np.zeros(5), np.ones(5))
    rnd, scorer = random.Random(8), toxicity.Scorer(fitted)
    for _ in range(3000):
        token = "".join(rnd.choice("idiotmrnaels1!.,é") for _ in range(rnd.randrange(1, 9)))
        words = toxicity.words_of(token, model)
        hits = sum(any(x in terms for x in toxicity.features_of(w)) for w in words)
        assert scorer.token(token)[1] == hits, token


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (77, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    fitted = toxicity.fit(odd_docs, labels)
    scored = toxicity.score(odd_docs.withColumn("score", F.lit("s")), fitted)
    assert scored.count() == odd_docs.count() and scored.columns == [*odd_docs.columns, "score"] and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.score(no_docs, fitted).count() == 0
    for some in (labels.filter("false"), labels.filter("toxic = 0"), labels.filter("doc_id = 77")):
        assert {round(r.score, 9) for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, some)).collect()} == {round(1 / (1 + np.exp(-float(toxicity.fit(odd_docs, some).weights[0]))), 9)}
    toxicity.fit(no_docs, labels)
    long = spark.createDataFrame([(1, "a1" * 100_000 + " i d i o t" * 30_000)], "doc_id long, text string")
    assert toxicity.score(long, fitted).count() == 1
