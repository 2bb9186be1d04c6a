"""Toxic documents: disguised words are restored by a noisy channel, then the restored text is scored."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import written

#: Letters that the character model knows; all other characters but blanks are one symbol to it. Its tables have (len(LETTERS) + 2) ** 4 cells at most.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçñáíóú"
BOUNDARY, OTHER = 0, len(LETTERS) + 1
SIZE = len(LETTERS) + 2
#: Letters that a digit or a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: What the channel does, in nats: a sign for a letter, a sign or blank put between single characters, a sign put in elsewhere, a letter repeated once, and once more.
SWAP, APART, PUT_IN, TWICE, MORE = 1.0, 0.5, 5.0, 4.5, 0.3
#: Three or more single characters with single blanks between them: a word that may have been spaced out.
SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
PLAIN = re.compile(r"[^\W\d_]+")
DOUBLED = re.compile(r"([^\W\d_])\1")
REPEATED = re.compile(r"(.)\1+")
#: Letters, and after them signs alone, none of which looks like a letter or stands before another letter.
STARTS = re.compile(r"([^\W\d_]{3,})[^\w]*$")
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Restored tokens and counts that a task holds before it starts anew.
HELD = 200_000


class Toxicity(NamedTuple):
    """The character model (logarithms by three characters before and one), the terms with their odds, and the weights of a document's features (with their means and deviations)."""

    model: np.ndarray
    terms: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


CODE = {c: k for k, c in enumerate(LETTERS, 1)} | dict.fromkeys(" \t\n\r\x0b\x0c\xa0", BOUNDARY)
_CODES = np.full(1 << 16, OTHER, "u1")
for _c, _k in CODE.items():
    _CODES[ord(_c)] = _k


def codes(text: str) -> np.ndarray:
    """The symbols of a lower-cased text's characters."""
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CODES[np.where(at < 1 << 16, at, 0xFFFF)]


def grams(c: np.ndarray) -> np.ndarray:
    """The number of each place's symbol with the three before it; nothing before a boundary counts."""
    wide = np.concatenate([np.zeros(3, "i8"), c])
    back = [wide[3 - k : 3 - k + len(c)].copy() for k in (1, 2, 3)]
    back[1][back[0] == BOUNDARY] = BOUNDARY
    back[2][back[1] == BOUNDARY] = BOUNDARY
    return ((back[2] * SIZE + back[1]) * SIZE + back[0]) * SIZE + c


def character_counts(texts: DataFrame) -> np.ndarray:
    """How often each four symbols in a row come in all texts (text). What a task holds, and what comes to the driver, is bounded by the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(SIZE**4, "i8"), [], 0

        def add() -> None:
            nonlocal counts, held, size
            if held:
                counts += np.bincount(np.concatenate(held), minlength=SIZE**4)
            held, size = [], 0

        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = codes(f" {(text or '').lower()} ")
                for at in range(0, len(c), 1 << 20):  # long texts in pieces, with what comes before each
                    lead = min(3, at)
                    g = grams(c[at - lead : at + (1 << 20)])[lead:]
                    held.append(g)
                    size += len(g)
                    if size >= 1 << 22:
                        add()
        add()
        there = np.flatnonzero(counts)
        for at in range(0, len(there), 1 << 16):
            some = there[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["gram", "n"])

    found = texts.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**4, "f8")
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out.reshape((SIZE,) * 4)


def character_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log of the chance of a symbol after three others, in the order of grams; rare contexts lean on shorter ones, with `weight` counts."""
    p = np.full(SIZE, 1.0 / SIZE)
    for n in (counts.sum((0, 1, 2)), counts.sum((0, 1)), counts.sum(0), counts):
        p = (n + weight * p) / (n.sum(-1, keepdims=True) + weight)
    return (-np.log(p)).astype("f4").ravel()


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest original of a lower-cased token: the cheapest way through the lattice of what each character may stand for (Viterbi).

    A letter is itself, or nothing if it repeats the one before; a digit or sign is itself, one of the letters that look like it, nothing, or the end of a word; a
    blank inside is nothing or the end of a word. Symbols that stay themselves part words. States are the last three symbols.
    """
    chance, keep = model.item, SIZE * SIZE
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # the last three symbols as one number
    before, run = "", 0
    for k, ch in enumerate(token):
        run = run + 1 if ch == before else 1
        code, nothing = CODE.get(ch, OTHER), None
        if ch.isalpha():
            ways = ((code, 0.0, ch),)
            nothing = (TWICE if run == 2 else MORE) if run > 1 else None
        elif ch == " ":
            ways, nothing = ((BOUNDARY, 0.0, " "),), APART
        else:
            ways = ((OTHER, 0.0, " "), (BOUNDARY, PUT_IN if ch.isdigit() else 0.0, " "), *[(CODE[x], SWAP, x) for x in LEET.get(ch, "")])
            nothing = None if ch.isdigit() else APART if not token[max(0, k - 2) : max(0, k - 1)].isalnum() and not token[k + 2 : k + 3].isalnum() else PUT_IN
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for symbol, price, text in ways:
                to = state % keep * SIZE + symbol if symbol else 0
                total = cost + price + (chance(state * SIZE + symbol) if symbol or state else 0.0)
                if to not in new or total < new[to][0]:
                    new[to] = (total, (text, path))
            if nothing is not None and (state not in new or cost + nothing < new[state][0]):
                new[state] = (cost + nothing, path)
        states, before = new, ch
    ends = {s: cost + chance(s * SIZE) if s else cost for s, (cost, _) in states.items()}
    out, path = [], states[min(ends, key=ends.get)][1]
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


def words_of(token: str, model: np.ndarray) -> tuple[str, ...]:
    """The words of a lower-cased token, restored where it holds anything but letters within, or letters that repeat."""
    core = token.strip(".,;:?'\"&*#%-_<>[]{}=~/\\^`")
    if core.isalpha() and not DOUBLED.search(core):
        return (core,)
    if not any(ch.isalpha() for ch in core):
        return ()
    return tuple(PLAIN.findall(restore(core, model)))


def tokens_of(text: str) -> Counter:
    """The tokens of a text, lower-cased, with their counts; words spaced out to single characters are one token each."""
    text = text.lower()
    counts: Counter = Counter()
    if SPACED.search(text):
        counts.update(m.group() for m in SPACED.finditer(text))
        text = SPACED.sub(" ", text)
    counts.update(text.split())
    return counts


def features_of(word: str) -> list[str]:
    """A word, and its beginnings, told apart by a sign."""
    return [word, *[f"^{word[:k]}" for k in BEGINNINGS if len(word) >= k]]


def odds(t: int, c: int, toxic: int, clean: int) -> float:
    """The logarithm of how much more often toxic documents have a term than clean ones."""
    return math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))


def squeezed(letters: str) -> str:
    """A word without repetitions of a letter: no restoration of letters alone changes that."""
    return REPEATED.sub(r"\1", letters)


class Scorer:
    """Features of documents by the terms. Known tokens are kept, so that each is looked at once in a while only; own is the label of the document itself, whose part in the counts is taken out."""

    def __init__(self, fitted: Toxicity, own: int | None = None):
        self.fitted, self.known = fitted, {}
        toxic, clean = fitted.toxic - (own == 1), fitted.clean - (own == 0)
        self.odds = {x: odds(t - (own == 1), max(0, c - (own == 0)), toxic, clean) for x, (t, c) in fitted.terms.items()}
        self.heads = {squeezed(x.lstrip("^"))[:3] for x in fitted.terms}
        self.dull: set[str] = set()  # three letters that differ, with which no term starts

    def token(self, token: str) -> tuple[int, int, float, float]:
        """Words, words with a toxic term, their odds' sum and the largest.

        A token of letters and then signs starts as it starts, however it is restored: where no term starts like that, there is nothing to restore it for.
        """
        first = STARTS.match(token)
        if first and (start := squeezed(first.group(1))[:3]) not in self.heads:
            if token.startswith(start) and len(start) == 3:
                self.dull.add(start)
            return 1, 0, 0.0, 0.0
        words, hits, total, most = words_of(token, self.fitted.model), 0, 0.0, 0.0
        for w in words:
            best = max([0.0, *[self.odds[x] for x in features_of(w) if x in self.odds]])
            hits, total, most = hits + (best > 0), total + best, max(most, best)
        return len(words), hits, total, most

    def vector(self, text: str | None) -> list[float]:
        n, hits, total, most = 0, 0, 0.0, 0.0
        known, dull = self.known, self.dull
        for token, k in tokens_of(text or "").items():
            if token[:3] in dull and token.isalpha():
                n += k
                continue
            if (found := known.get(token)) is None:
                if len(known) >= HELD:
                    known.clear()
                found = known[token] = self.token(token)
            n += k * found[0]
            if found[1]:
                hits, total, most = hits + k * found[1], total + k * found[2], max(most, found[3])
        return [math.log1p(total), math.log1p(hits), most, math.log1p(100 * total / (n + 20)), math.log1p(n)]


def terms_of(labelled: DataFrame, model: np.ndarray) -> DataFrame:
    """(term, t, c): how many toxic and how many clean documents (text, toxic) have each restored word or beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = {}, defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([v[k] for v in counts.values()], pa.int64()) for k in (0, 1)]], ["term", "t", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = set()
                for token in tokens_of(text or ""):
                    if token not in known:
                        if len(known) >= HELD:
                            known.clear()
                        known[token] = [x for w in words_of(token, model) for x in features_of(w)]
                    terms.update(known[token])
                for x in terms:
                    counts[x][0 if toxic else 1] += 1
                if len(counts) >= HELD:
                    yield flush()
        yield flush()

    return labelled.select("text", "toxic").mapInArrow(run, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the first is the constant) of a logistic regression with a ridge on all but the constant, by Newton's steps."""
    z = np.column_stack([np.ones(len(x)), x])
    keep = np.diag([1e-6, *[ridge] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = 10_000, most_terms: int = 5000, least_docs: int = 3) -> Toxicity:
    """A classifier of docs (doc_id, text) from labels (doc_id, toxic: 1 or 0).

    The character model counts all texts of docs. The classifier is fitted on at most `most_rows` labelled documents, those whose ids have the smallest hashes: a document
    counts as toxic if any of its labels says so; null labels and labels of unknown documents tell nothing. Terms are restored words and their beginnings that `least_docs`
    toxic documents have, far more often than clean ones (by the likelihood ratio at one in a thousand), the `most_terms` that tell most. A document's
    features are the odds of its terms (sum, largest, share) and its length; for their weights, each fitted document's own part is taken out of its terms' counts.
    Without toxic or without clean labels there are no terms, and all documents score alike. Other columns are ignored.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    labelled = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "toxicity-labelled")
    model = character_model(character_counts(docs))
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    total = F.lit(float(toxic + clean))

    def part(o: Column, of: int, all_of: Column) -> Column:
        """A cell's part of the likelihood ratio: what is observed against what the margins let expect."""
        return F.when(o > 0, 2 * o * F.log(o * total / (F.lit(float(of)) * all_of))).otherwise(0.0)

    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    ratio = part(t, toxic, t + c) + part(c, clean, t + c) + part(F.lit(float(toxic)) - t, toxic, total - t - c) + part(F.lit(float(clean)) - c, clean, total - t - c)
    told = terms_of(labelled, model).filter((t >= least_docs) & ((t + 0.5) * (clean + 1) > 2.7 * (c + 0.5) * (toxic + 1)))
    found = told.withColumn("g", ratio).filter("g >= 10.83").orderBy(F.desc("g"), "term").limit(most_terms).collect() if toxic and clean else []
    terms = {r["term"]: (r["t"], r["c"]) for r in found}
    width = 5
    blank = Toxicity(model, terms, toxic, clean, np.array([np.log((toxic + 0.5) / (clean + 0.5)), *[0.0] * width]), np.zeros(width), np.ones(width))
    if not terms:
        return blank._replace(weights=np.array([np.log((toxic + 0.5) / (clean + 9.5)), *[0.0] * width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(blank, own) for own in (0, 1)]
        for batch in batches:
            y = batch.column(1).to_pylist()
            x = [scorers[own].vector(text) for text, own in zip(batch.column(0).to_pylist(), y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "y"])

    rows = sorted((tuple(r["x"]), r["y"]) for r in labelled.select("text", "toxic").mapInArrow(run, "x array<double>, y int").collect())
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    mean, deviation = x.mean(0), np.maximum(x.std(0), 1e-9)
    return blank._replace(weights=logistic((x - mean) / deviation, y), mean=mean, deviation=deviation)


def score(docs: DataFrame, fitted: Toxicity) -> DataFrame:
    """docs with `score`, the chance of being toxic, from each whole text; a null or empty text scores as one without terms. No rows give no rows; a column named score is replaced."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fitted)  # the character table (11 MB) and at most most_terms terms
    docs = docs.drop("score")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        scorer = Scorer(fitted)
        for batch in batches:
            x = np.array([scorer.vector(text) for text in batch.column(at).to_pylist()]).reshape(-1, len(fitted.mean))
            z = fitted.weights[0] + ((x - fitted.mean) / fitted.deviation) @ fitted.weights[1:]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
