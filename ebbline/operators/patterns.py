"""Very many words and wildcards against very many texts: an equi-join on the rarest piece of each pattern.

Every pattern with a letter in it names one gram (three characters; a shorter literal as it is) that each text it fits must have: that
of its grams which the fewest texts have. Texts are exploded to the grams that they have, and meet a pattern only there; what meets is
verified. Texts are names and labels, each cut to grams in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from ..sources.sinks import kept

GRAM = 3


def _folded(text: Column) -> Column:
    """A-Z lower-cased, as patterns see them; letter by letter, so that a piece of a text stays a piece of it."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _grams(text: Column, size: int) -> Column:
    ends = F.length(text) - (size - 1)
    return F.when(ends >= 1, F.transform(F.sequence(F.lit(1), ends), lambda k: F.substring(text, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _needed(pieces: Column) -> Column:
    """Grams that a text must have to hold all pieces: those of the long pieces, else the longest pieces themselves."""
    long = F.flatten(F.transform(pieces, lambda p: _grams(p, GRAM)))
    most = F.array_max(F.transform(pieces, F.length))
    return F.when(most >= GRAM, long).otherwise(F.filter(pieces, lambda p: (F.length(p) == most) & (most > 0)))


def literals(glob: Column) -> Column:
    """The pieces of a wildcard pattern that stand for themselves."""
    return F.filter(F.split(_folded(glob), r"[*?]+"), lambda p: p != "")


def met(texts: DataFrame, patterns: DataFrame, pieces: Column) -> DataFrame:
    """(text, pattern) of all distinct texts and patterns where the text has the pattern's rarest gram. texts has `text`, patterns `pattern`; pieces are the
    literals of a pattern. Nulls meet nothing, nor do patterns without a literal: `bare` tells them."""
    each = F.explode(F.array_distinct(F.flatten(F.array(*[_grams(_folded(F.col("text")), k) for k in range(1, GRAM + 1)])))).alias("gram")
    known = patterns.filter("pattern IS NOT NULL").select("pattern").distinct()
    needs = kept(known.select("pattern", F.explode(F.array_distinct(_needed(pieces))).alias("gram")), "needs")
    seen = kept(texts.filter("text IS NOT NULL").select("text").distinct().select("text", each).join(needs.select("gram").distinct(), "gram", "left_semi"), "grams")
    counts = seen.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = needs.join(counts, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    return seen.join(rarest, "gram").select("text", "pattern")


def bare(glob: Column) -> Column:
    """Whether a wildcard pattern has no literal."""
    return F.size(literals(glob)) == 0


def texts_with_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct texts (`text`) that contain one of the words (`word`), case and all. An empty word is in every text, a null one in none."""
    found = met(texts, words.select(F.col("word").alias("pattern")), F.array(_folded(F.col("pattern")))).filter(F.contains("text", "pattern")).select("text")
    every = texts.filter("text IS NOT NULL").select("text").crossJoin(F.broadcast(words.filter("word = ''").limit(1).select("word"))).select("text")  # of one row at most
    return found.unionByName(every).distinct()


def texts_with_globs(texts: DataFrame, globs: DataFrame) -> DataFrame:
    """(text, pattern) of the distinct texts that fit a wildcard pattern with a literal, and each that fits."""
    return met(texts, globs, literals(F.col("pattern"))).filter(F.rlike("text", glob_pattern(F.col("pattern"))))
