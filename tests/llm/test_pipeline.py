import tracemalloc
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa

from ebbline.llm import minhash, mixing, packing
from ebbline.llm.common import table


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = table(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert docs.filter("text LIKE '%[secret]%'").count() > 0
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert max(ids.values()) <= 3


def test_run_agrees_with_its_stages(spark, sf):
    """The packed rows hold each taken document whole, as often as the mix takes it."""
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"brute-{name}")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    tokens, total = defaultdict(int), {}
    for r in corpus_pipeline.run(spark, sf).collect():
        tokens[r.doc_id] += r.length
        total[r.doc_id] = r.doc_tokens
    assert {d: tokens[d] // total[d] for d in tokens} == copies and all(tokens[d] % total[d] == 0 for d in tokens)
    assert np.all(np.array(list(copies.values())) <= 3)


def _run_over(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_run_over_odd_rows(spark, odd_docs, tmp_path):
    """Null ids and texts, repeated rows, a very long text and clashing names go through all stages."""
    rows = _run_over(spark, odd_docs, tmp_path / "odd")
    ids = {r.doc_id for r in rows}
    assert ids and ids <= {1, 2, 6, 7, 8, 9, 10, None} and not {3, 4, 5} & ids
    own = [r for r in rows if r.doc_id == 1]
    assert sum(r.length for r in own) % own[0].doc_tokens == 0
    stages = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = corpus_pipeline.written(stage(spark, stages, str(tmp_path / "odd")), f"odd-{name}")
        assert stages.columns == odd_docs.columns


def test_run_over_no_rows(spark, no_docs, tmp_path):
    assert _run_over(spark, no_docs, tmp_path / "none") == []


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_workers_get_texts_in_small_batches(spark, tmp_path):
    """40 MB of texts in one partition reach Python a few MB at a time, once a stage that runs Python is built."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 10_000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 4000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"])

    for build in (lambda: minhash.sign(minhash.addressed(texts)), lambda: packing.pack(texts, "unused")):
        spark.conf.unset(name)
        build()
        assert max(r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()) < 6 << 20
    spark.conf.set(name, "1m")
    minhash.sign(minhash.addressed(texts))
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_signatures_take_bounded_memory():
    """A worker's arrays stay small beside 4 MB of texts."""
    texts = pa.array([" ".join(f"w{k * 31 + j * j % 997}" for j in range(700)) for k in range(1000)])
    tracemalloc.start()
    for start, end in minhash.chunks(texts):
        part = texts.slice(start, end - start)
        doc, s = minhash.shingles(part)
        _, doc, s, count = minhash.counted(doc, s)
        minhash.bag_signatures(doc, s, count.astype("f8"), len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20
