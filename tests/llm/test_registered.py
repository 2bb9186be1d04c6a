"""The registered queries without SQL, as the driver calls them, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from test_free import _classes, _covered

from ebbline.llm import registry
from ebbline.llm.common import table


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_op3(spark, sf, documents):
    raws = [(t or "").encode() for _, t in documents]
    want = Counter()
    for (doc, _), raw, cov in zip(documents, raws, _covered(raws), strict=True):
        runs = int((np.diff(np.concatenate([[0], cov.astype(int)])) == 1).sum())
        want[(doc, len(raw), int(cov.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cov])).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op3_repeated_passages(spark, sf).collect())
    assert got == want


def test_op5(spark, sf, documents):
    assert Counter((r.doc_id, r.class_id) for r in registry.op5_near_duplicates(spark, sf).collect()) == _classes(documents)


def test_op9(spark, sf, documents):
    rows = registry.op9_mixing(spark, sf).collect()
    size = Counter()
    for d, t in documents:
        size[d] += len((t or "").split())
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in documents)
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in rows)
    source = {r.doc_id: r.source for r in table(spark, sf, "documents").select("doc_id", "source").collect()}
    target = {source[r.doc_id]: r.target for r in rows}
    assert sum(r.size for r in rows) == sum(size.values()) == pytest.approx(sum(target.values()), rel=1e-9)
    for name, aim in target.items():
        own = [r for r in rows if source[r.doc_id] == name]
        assert {(r.target, r.source_size) for r in own} == {(aim, sum(r.size for r in own))}
        assert abs(sum(r.taken for r in own) - aim) <= max(r.size for r in own)
    assert sorted(rows) == sorted(registry.op9_mixing(spark, sf).collect())


def test_op10(spark, sf, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for d, x in documents}
    assert len(ids) == len(documents)
    held = Counter()
    for r in registry.op10_packing(spark, sf).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        held[r.doc_id] += r.length
    assert held == {d: len(x) for d, x in ids.items()}
