"""The operators' queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, minhash, mixing, negatives, packing, quality, repeats, secrets, topk, toxicity, url_filter, warc, whitening
from .common import literal_rows, table
from .oracles import SQL as SQL

#: Fixed values of the query's contract: host, path, verdict.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, [dict(zip(("host", "path", "verdict"), r, strict=True)) for r in URL_RULES], "host:string,path:string,verdict:string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.as_integers(F.col("embedding")).alias("v"))
    return topk.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, ledger = secrets.scan_in_loads(table(spark, sf_dir, "documents"))
    found = secrets.findings(paths, ledger)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    own = F.transform("matches", lambda m: m["label"])
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["start"].cast("long").alias("first_word"),
        F.when(F.size("places") > 0, F.element_at("places", -1)["start"]).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"), score.alias("score"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), topk.as_integers(F.col("embedding"), 256.0).alias("v"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.as_integers(F.col("embedding"), 256.0).alias("v"))
    return whitening.whiten(vectors).withColumn("deviation", F.col("deviation").cast("long"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality_rules, op3_repeated_passages, op4_warc, op5_near_duplicates, op6_topk_search, op7_secret_scan, op8_license_scan, op9_mixing, op10_packing,
        op11_hard_negatives, op12_embedding_whitening, op13_toxicity,
    )
}
