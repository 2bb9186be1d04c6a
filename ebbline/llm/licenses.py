"""License scans: phrases in place, and an exact containment join of text blocks with notice templates."""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, literal_rows, written

#: Phrases of words with their labels, and sentences of public licenses and of the notices that they ask for.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = (
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-header", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-terms", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-terms", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
)
#: A notice may stand anywhere in a run of this many times its own words, wherever the lines end.
ROOM = 2
#: Characters between words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words with one space between two, and one before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, BETWEEN, " ")), F.lit(" "))


def n_words(s: Column) -> Column:
    return F.when(s == "  ", F.lit(0)).otherwise(F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1).cast("long")


def _next_place(size: int):
    def step(a: Column, gap: Column) -> Column:
        # as many words stand before a match as spaces do, less the leading one
        at = a["at"] + gap
        return F.struct((at + size - 1).alias("at"), F.concat(a["out"], F.array(at)).alias("out"))

    return step


def phrase_places(s: Column, phrases: dict[str, str]) -> Column:
    """(start, label) of each place of each phrase in the spaced words, by start."""
    every = []
    for phrase, label in phrases.items():
        pattern = f"(?i)(?<= ){phrase}(?= )"
        gaps = F.transform(F.split(s, pattern, -1), lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
        size = len(phrase.split(" "))
        first = F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out"))

        starts = F.aggregate(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), first, _next_place(size), lambda a: a["out"])
        found = F.transform(starts, lambda x: F.struct(x.alias("start"), F.lit(label).alias("label")))
        every.append(found)
    hit = s.rlike("(?i) (?:" + "|".join(phrases) + ") ")
    return F.when(hit, F.array_sort(F.concat(*every))).otherwise(F.array().cast("array<struct<start:int,label:string>>"))


def needed(words, threshold: float) -> int:
    return math.ceil(len(set(words)) * threshold - 1e-9)


class Index(NamedTuple):
    """Templates by the words that a match can't lack: rows of (template, label, words as ranks, spelt, room, need), ranks by word, and the words of all prefixes."""

    rows: list[dict]
    ranks: dict[str, int]
    prefixes: list[str]


def prefix_index(counts: dict[str, int], templates: tuple, threshold: float) -> Index:
    """The prefix index of templates whose words stand in `counts` documents.

    Words are ordered from the rarest in the corpus. A block that holds `need` of a template's n words has one of its first n - need + 1 in that
    order: its prefix.
    """
    ranks = {w: k for k, w in enumerate(sorted({w for _, text in templates for w in text.split(" ")}, key=lambda w: (counts.get(w, 0), w)))}
    rows, prefixes = [], set()
    for k, (label, text) in enumerate(templates):
        spelt, need = sorted(set(text.split(" ")), key=ranks.__getitem__), needed(text.split(" "), threshold)
        rows.append({"template": k, "label": label, "words": [ranks[w] for w in spelt], "spelt": spelt, "room": ROOM * len(text.split(" ")), "need": need})
        prefixes.update(spelt[: len(spelt) - need + 1])
    return Index(rows, ranks, sorted(prefixes))


def listed(words: list[str]) -> Column:
    """Words without spaces as an array, from one literal."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def template_matches(blocks: DataFrame, index: Index) -> DataFrame:
    """(key, label, containment) of blocks (key, tokens: distinct words of the templates' vocabulary, run: null or words in order) that hold enough of a template's words.

    A block with a run must hold them within ROOM times as many words in a row as the template has; the run's tokens bound that from above.

    A block meets the templates in whose prefix one of its words is (prefix filter), if it has `need` words itself
    (length filter), and enough words after and before the common one in both orders (positional
    filter). The survivors' overlap is counted. The index is a parameter's size and is broadcast.
    """
    spark = blocks.sparkSession
    rows = literal_rows(spark, index.rows, "template:int,label:string,words:array<int>,spelt:array<string>,room:int,need:int")
    ranks = F.from_json(F.lit(json.dumps(index.ranks)), "map<string,int>")
    prefix = rows.select("template", "label", "need", "words", "spelt", "room", F.posexplode(F.slice("words", 1, F.size("words") - F.col("need") + 1)).alias("tp", "token"))
    probe = blocks.select("key", "run", F.array_sort(F.transform("tokens", lambda t: ranks[t])).alias("own")).select("key", "run", "own", F.posexplode("own").alias("bp", "token"))
    own, words = F.size("own"), F.size("words")
    after = F.least(own - F.col("bp") - 1, words - F.col("tp") - 1)
    before = F.least("bp", "tp")
    pairs = probe.join(F.broadcast(prefix), "token").filter((own >= F.col("need")) & (after + before + 1 >= F.col("need")))
    pairs = pairs.filter(F.size(F.array_intersect("own", "words")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("run") - F.col("room") + 1, F.lit(1)))
    within = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("run", k, F.col("room")), "spelt"))))
    overlap = F.when(F.col("run").isNull(), F.size(F.array_intersect("own", "words"))).otherwise(within)
    kept = pairs.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    return kept.select("key", "label", (F.col("overlap") / words).alias("containment"))


def scan_licenses(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: tuple = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, places (start, label) of phrases, and matches (label, containment) of templates, for each row of docs.

    Blocks are the \\n-split lines of a text, as sets of words, and runs of words across its lines: a
    template may stand in any ROOM * n words in a row, n being its own words, so that notices are found however they are wrapped.
    Runs are cut twice as long as the largest template's room, each overlapping the next by half, so every such stretch lies in one;
    only those that hold a word of some template's prefix are kept, whose words are looked up in the prefix index and nowhere else: the work doesn't grow with
    templates that a block has no rare word of, and the plan doesn't grow with templates at all. A first pass over the texts counts in how many documents each of the
    templates' words stands, which orders them; a second counts words, finds phrases and cuts blocks.
    Null texts are empty; repeated rows give a row each; other columns are ignored. No templates give no matches.
    """
    vocabulary = sorted({w for _, text in templates for w in text.split(" ")})
    least = min([needed(text.split(" "), threshold) for _, text in templates], default=1)
    room = ROOM * max([len(text.split(" ")) for _, text in templates], default=1)
    text = F.coalesce(F.col("text"), F.lit(""))
    known = listed(vocabulary)
    lowered = lambda c: F.translate(c, UPPER, LOWER)
    tokens = lambda s: F.array_intersect(F.split(lowered(F.trim(s)), " "), known)
    counted = docs.select(F.explode(tokens(spaced(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = prefix_index({r["token"]: r["n"] for r in counted.collect()}, templates, threshold)  # of the templates' words alone
    prefixes = listed(index.prefixes)
    promising = lambda t: (F.size(t) >= least) & F.arrays_overlap(t, prefixes)
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("hash"))
    rows = rows.select("doc_id", "hash", let(spaced(F.col("text")), lambda s: F.struct(n_words(s).alias("n"), phrase_places(s, phrases).alias("places"), tokens(s).alias("known"))).alias("s"), "text")
    whole = lambda t: F.struct(t.alias("tokens"), F.lit(None).cast("array<string>").alias("run"))
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x: tokens(spaced(x))), promising), whole)
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - room, F.lit(1)), F.lit(room)), lambda k: F.slice(w, k, 2 * room))
    runs = let(F.split(lowered(F.trim(spaced(F.col("text")))), " "), cut)
    runs = F.transform(runs, lambda r: F.struct(F.array_intersect(r, known).alias("tokens"), r.alias("run")))
    runs = F.filter(runs, lambda b: promising(b["tokens"]))
    rows = rows.select("doc_id", "hash", F.col("s.n").alias("n_words"), "s.places", F.when(promising(F.col("s.known")), F.concat(lines, runs)).otherwise(F.array().cast("array<struct<tokens:array<string>,run:array<string>>>")).alias("blocks"))
    rows = written(rows, "licenses")
    key = F.struct("doc_id", "hash").alias("key")
    blocks = rows.filter(F.size("blocks") > 0).select(key, F.explode("blocks").alias("b")).select("key", "b.tokens", "b.run")
    found = template_matches(blocks, index).groupBy("key", "label").agg(F.max("containment").alias("containment"))
    found = found.groupBy(F.col("key.doc_id").alias("_d"), F.col("key.hash").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("label", "containment"))).alias("matches"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_d"]) & (rows["hash"] == found["_h"]), "left")
    return joined.select("doc_id", "n_words", "places", F.coalesce("matches", F.array().cast("array<struct<label:string,containment:double>>")).alias("matches"))
