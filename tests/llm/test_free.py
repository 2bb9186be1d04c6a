import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbline.llm import minhash, packing, repeats, topk, warc
from ebbline.llm.common import scratch, table


def _covered(raws, length=200):
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i] += 1
                mark[i + length] -= 1
        out.append(np.cumsum(mark[:-1]) > 0)
    return out


def _check_repeats(docs, **options):
    rows = docs.select("doc_id", "text").collect()
    raws = [(r.text or "").encode() for r in rows]
    want = Counter()
    for r, raw, cov in zip(rows, raws, _covered(raws), strict=True):
        runs = int((np.diff(np.concatenate([[0], cov.astype(int)])) == 1).sum())
        want[(r.doc_id, len(raw), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cov])).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(docs, **options).collect())
    assert got == want


def test_repeats_by_brute_force(spark, sf, odd_docs):
    _check_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    _check_repeats(odd_docs.filter("doc_id IS NULL OR doc_id <> 6"))


def test_repeats_of_hard_texts(spark, no_docs):
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(97, 123, 700)))
    rows = [(1, text), (2, text[100:420] + "é" * 40), (3, "ab" * 300), (4, "é" * 99), (5, "z" * 200), (6, "z" * 201), (7, text[:199]), (8, text[300:500] + text[:200]), (9, "a" + "ab" * 150), (10, "\x00" * 250), (11, "q" + text[250:449])]
    _check_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert repeats.remove_repeats(no_docs).count() == 0


def test_hot_keys_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    line = "".join(map(chr, rng.integers(97, 123, 80)))
    rows = [(k, "".join(map(chr, rng.integers(97, 123, 300))) + line + "".join(map(chr, rng.integers(97, 123, 300)))) for k in range(30)] + [(99, "")]
    rows += [(200, rows[3][1]), (201, rows[4][1][100:450])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = np.sort(repeats.gram_hashes(np.frombuffer(line.encode(), np.uint8)))
    monkeypatch.setattr(repeats, "hot_keys", lambda docs, length: grams)
    _check_repeats(docs)
    # keys of finer levels can be hot too
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    key, *_ = repeats.fragments(data, [len(data)], 200, grams)
    monkeypatch.setattr(repeats, "hot_keys", lambda docs, length: np.union1d(grams, key))
    _check_repeats(docs)


@pytest.mark.parametrize("index_bytes", [300, 3000])
def test_large_slots_are_dealt_again(spark, index_bytes):
    """A passage of under 200 bytes that all texts share puts them under one key."""
    rng = np.random.default_rng(6)
    random = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    line = random(150)
    rows = [(k, random(260) + line + random(260)) for k in range(40)]
    rows += [(100, rows[3][1][120:]), (101, rows[4][1][150:400] + random(20)), (102, rows[5][1]), (103, "ab" * 400), (104, "ab" * 130 + line)]
    _check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), index_bytes=index_bytes)


def test_indexes_alone_find_everything(spark, sf):
    _check_repeats(table(spark, sf, "documents").select("doc_id", "text"), fold=False)


def test_suffixes_are_sorted():
    rng = np.random.default_rng(8)
    for text in (rng.integers(97, 99, 500), np.full(300, 97), rng.integers(0, 255, 2000), np.tile(rng.integers(97, 123, 70), 9), np.zeros(1, int), np.zeros(0, int)):
        raw = bytes(text.astype(np.uint8))
        assert repeats.sorted_suffixes(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])


def test_runs_give_the_text_back():
    """The runs are the whole transform: a walk through them spells the text."""
    rng = np.random.default_rng(9)
    part = bytes(rng.integers(97, 101, 90).astype(np.uint8))
    index = repeats.RunLengthIndex.of([part, part[20:70] + b"zz", b"q"], 1000)
    text = part + b"\xff" + part[20:70] + b"zz\xff" + b"q\xff"
    letters = np.concatenate([[text[-1]], np.repeat(index.letters, index.lengths)])  # the empty suffix is preceded by the last letter
    assert len(letters) == len(text) + 1 > len(index.letters)
    after, first = np.argsort(letters, kind="stable"), np.sort(letters)
    row, out = after[0], []
    for _ in text:
        out.append(int(first[row]))
        row = after[row]
    assert bytes(out) == text


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for letters in (2, 4):
        parts = [bytes(rng.integers(97, 97 + letters, n).astype(np.uint8)) for n in (5, 60, 30, 1, 80)]
        parts[2] = parts[1][10:40]
        index = repeats.RunLengthIndex.of(parts, 1000)
        best, ends = index.matching_statistics(), index.ends
        text = b"\xff".join(parts) + b"\xff"
        for i in range(len(text)):
            end = min(e for e in ends if e >= i)
            want = max((n for n in range(end - i, 0, -1) if text.find(text[i : i + n]) != i or text.find(text[i : i + n], i + 1) > 0), default=0)
            assert best[i] == want


def test_warc_round_trip_and_seeks(spark, sf):
    pages = table(spark, sf, "pages")
    extra = spark.createDataFrame([(900_000 + k, u, h) for k, (u, h) in enumerate([(None, None), ("http://a/%0A\n", ""), ("http://b", "y" * 100), ("http://c", "y" * 100), ("http://d", "z" * 99), ("http://e", "z" * 99), ("http://f", "é" * 400_000)])] + [(None, "http://n", "y" * 100)], pages.select("page_id", "url", "html").schema)
    pages = pages.select("page_id", "url", "html").unionByName(extra)
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages, folder, frame_bytes=1 << 14, bundle_bytes=1 << 17)
    records = {(r.page_id, r.url): r for r in warc.listed(warc.read_archives(spark, folder), index).collect()}
    rows = pages.collect()
    first = {}
    for r in rows:
        raw = (r.html or "").encode()
        if len(raw) >= 100 and r.page_id is not None:
            first[raw] = min(first.get(raw, r.page_id), r.page_id)
    assert len(records) == len(rows)
    for r in rows:
        raw, got = (r.html or "").encode(), records[(r.page_id, r.url)]
        revisit = len(raw) >= 100 and first[raw] != r.page_id
        assert got.record_type == ("revisit" if revisit else "response") and got.refers_to == (first[raw] if revisit else None)
        assert got.payload_digest == hashlib.sha256(raw).hexdigest() and bytes(got.payload) == (b"" if revisit else raw)
    some = index.filter(F.pmod(F.xxhash64("record_id"), F.lit(7)) == 0)
    fetched = {r.record_id: bytes(r.payload) for r in warc.fetch_records(spark, folder, some).collect()}
    everything = {r.record_id: bytes(r.payload) for r in records.values()}
    assert fetched == {r.record_id: everything[r.record_id] for r in some.collect()} and fetched


def test_warc_ids_urls_and_references(spark):
    urls = ["http://a/%41%0A", "http://b/x y", "http://c/\r\nX: 1", "", None, "http://d/\u00e9"]
    rows = [(k, u, "p" * 150) for k, u in enumerate(urls)] + [(None, None, "q" * 150)] * 3 + [(7, "http://r", "z" * 150)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages, folder).collect()
    records = warc.read_archives(spark, folder).collect()
    assert len({r.record_id for r in index}) == len(rows) == len({(r.bundle, r.frame, r.offset) for r in index})
    assert Counter((r.page_id, r.url) for r in records) == Counter((p, u) for p, u, _ in rows)
    assert {r.record_id for r in records} == {r.record_id for r in index}
    first = next(r.record_id for r in records if r.page_id == 0)
    assert {r.refers_to_record for r in records if r.record_type == "revisit"} == {first}
    again = warc.write_archives(pages, scratch(spark, "warc-test")).collect()
    assert {r.record_id for r in again} == {r.record_id for r in index}  # a rerun gives the same


def test_warc_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0
    same = spark.createDataFrame([(5, "u", "p" * 200, "x")] * 3 + [(None, "u", "p" * 200, "x"), (7, None, "p" * 200, "x")], "page_id long, url string, html string, digest string")
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(same).collect())
    assert got == {(5, "response", None, 200): 3, (None, "revisit", 5, 200): 1, (7, "revisit", 5, 200): 1}


def _bag(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 40, 300))]
    for keep in (0.9, 0.7, 0.4):
        w = docs[0].split(" ")
        docs.append(" ".join(w[: int(300 * keep)] + [f"v{x}" for x in rng.integers(0, 5, 300 - int(300 * keep))]))
    doc, s, = minhash.shingles(pa.array(docs))
    _, doc, s, c = minhash.counted(doc, s)
    sig = minhash.bag_signatures(doc, s, c.astype("f8"), len(docs), 4096)
    bags = [_bag(t) for t in docs]
    for k in range(1, len(docs)):
        a, b = bags[0], bags[k]
        true = sum((a & b).values()) / sum((a | b).values())
        assert (sig[0] == sig[k]).mean() == pytest.approx(true, abs=0.03)


def _classes(rows):
    bags = [_bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, b in enumerate(bags):
        for g in b:
            inverted[g].append(i)
    pairs = {(i, j) for ids in inverted.values() for i in ids for j in ids if i < j}
    for i, j in pairs:
        if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()) - 1e-9:
            parent[root(j)] = root(i)
    texts = {}
    for i, (_, t) in enumerate(rows):
        k = texts.setdefault(t or "", i)
        parent[root(i)] = root(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, least.get(root(i))) for i, (d, _) in enumerate(rows))


def test_near_duplicates_by_brute_force(spark, sf, odd_docs, no_docs):
    for docs in (table(spark, sf, "documents"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
        assert got == _classes(rows)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[6] == 1 and minhash.one_of_each(no_docs).count() == 0


def test_a_text_of_one_word_repeated(spark):
    """Counts of a shingle beyond 2^16, and texts that differ in nothing but such a count."""
    rows = [(1, "a " * 70_000), (2, "a " * 69_000), (3, "a " * 40_000), (4, "b " * 70_000), (5, "a")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_a_hub_joins_copies_that_are_unlike_each_other(spark):
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        w = list(base)
        w[(k * 5) % 195] = f"edit{k}"
        w[(k * 5 + 97) % 195] = f"edited{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in minhash.near_duplicates(docs).collect()} == {0}


@pytest.mark.parametrize("unit", [8192, 100])
def test_blocks_find_the_links_of_large_buckets(spark, monkeypatch, unit):
    monkeypatch.setattr(minhash, "UNIT", unit)
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        w = list(rows[int(rng.integers(0, k))][1].split(" "))
        for p in rng.integers(0, 120, 3):
            w[p] = f"edit{k}x{p}"
        rows.append((k, " ".join(w + ["tail tail tail tail tail tail"] * (k % 3))))
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = _classes(rows)
    assert sum((got & want).values()) >= 0.95 * len(rows) and len({c for _, c in got}) < len(rows)


def _top(vectors, queries, k):
    out = Counter()
    for q, x in queries.items():
        s = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in vectors if i != q)
        out.update((q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k]))
    return out


def test_search_by_brute_force(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", topk.as_integers(F.col("embedding")).alias("v"))
    rows = [(r.vec_id, r.v) for r in v.collect() if r.v is not None]
    want = _top(rows, {i: x for i, x in rows if i % 20 == 0}, 20)
    for bucket in (8192, 64):
        got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(v, v.filter("vec_id % 20 = 0"), bucket=bucket, query_block=8).collect())
        assert got == want


def test_search_does_not_shuffle_more_for_large_groups(spark):
    """Many equal vectors: each stream gives k rows a query, however many tie."""
    rows = [(k, [3, 4] if k % 3 else [k % 7, 1]) for k in range(600)]
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, v array<long>, block string, n int")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(v, v.filter("vec_id % 20 = 0"), bucket=16, query_block=8, lanes=3).collect())
    assert got == _top(rows, {i: x for i, x in rows if i % 20 == 0}, 20)
    wide = spark.createDataFrame([(k, [(1 << 40) + k, -k]) for k in range(50)], "vec_id long, v array<long>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(wide.withColumn("v", F.transform("v", lambda x: x % (1 << 30))), wide.withColumn("v", F.transform("v", lambda x: x % (1 << 30))).filter("vec_id % 20 = 0")).collect())
    assert sum(got.values()) == 3 * 20


def test_search_edges(spark):
    rng = np.random.default_rng(0)
    scale = rng.lognormal(0, 2, 300)
    rows = [(k, [int(x) for x in np.floor(64 * scale[k] * rng.normal(size=8))]) for k in range(300)]
    rows += [(1000 + k, [1] * 8) for k in range(60)] + [(2000, [0] * 8), (2020, [0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>").unionByName(spark.createDataFrame([(5000, None)], "vec_id long, v array<long>"))
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(v, v.filter("vec_id % 20 = 0"), bucket=32, query_block=4).collect())
    assert got == _top(rows, {i: x for i, x in rows if i % 20 == 0}, 20)
    empty = v.filter("false")
    assert topk.search(empty, empty).count() == 0 and topk.search(v, empty).count() == 0
    odd = spark.createDataFrame([(1, [1.0, float("nan")]), (2, None), (3, [0.5, None]), (4, [float("inf"), 1.0]), (5, [-0.01, 0.5])], "vec_id int, e array<double>")
    assert [r.v for r in odd.orderBy("vec_id").select(topk.as_integers(F.col("e")).alias("v")).collect()] == [None, None, None, None, [-1, 32]]


def test_packing_round_trip(spark, sf, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(77, "a <|endoftext|> b", "en", "a")], "doc_id long, text string, lang string, source string")
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text").filter("doc_id > 2")).unionByName(special.select("doc_id", "text")).withColumn("doc_id", F.monotonically_increasing_id())
    texts = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, path).collect():
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == texts[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(texts[r.doc_id]) and len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    total = padding = 0
    for ids in (pieces, windows):
        for key, parts in ids.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            if ids is pieces:
                assert at == len(texts[key])
            else:
                assert at <= 2048
                total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    assert set(pieces) == set(texts) and padding <= 0.01 * total
    assert packing.pack(no_docs, path).count() == 0 and packing.pack(odd_docs, path).filter("doc_id IS NULL AND start = 0").count() == 2


def test_most_tokens_stay_where_sum_of_squares_put_them(spark):
    """Also in small tasks: 32 of some 300 documents each."""
    import public_tokenizers

    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", F.substring("text", 1, 12_000).alias("text"))
    parts = [[r.n for r in docs.repartition(32).withColumn("p", F.spark_partition_id()).filter(F.col("p") == k).select((F.length("text") % 2048).alias("n")).collect()] for k in (0, 17)]
    for sizes in parts:
        levels, stay, total = packing.Levels(2048), 0, 0
        for k, size in enumerate(x for x in sizes if x):
            full = levels.place((k, 0, np.zeros(size, "<u4"), size), size)
            stay, total = stay + (2048 if full else 0), total + size
        at = {p[0]: (p[4], len(p[2])) for ws in levels.open.values() for w in ws for p in w}
        for window in levels.drain():
            assert (sum(len(p[2]) for p in window) & (sum(len(p[2]) for p in window) - 1)) == 0
            stay += sum(len(p[2]) for p in window if at[p[0]] == (p[4], len(p[2])))
        assert stay >= 0.93 * total
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert packing.pack(docs.repartition(32).limit(0), path).count() == 0


def test_drain_of_hard_levels():
    for sizes in ([9] * 37, [5], [], [8, 8, 4], [15, 1, 1], [7, 9, 3, 3], list(range(1, 16)) * 3):
        levels, out = packing.Levels(16), []
        for k, size in enumerate(sizes):
            if full := levels.place((k, 0, np.arange(size, dtype="<u4"), size), size):
                out.append(full)
        out += list(levels.drain())
        pieces = defaultdict(list)
        for window in out:
            at = 0
            for doc, start, ids, _, offset in window:
                assert offset == at and len(ids) and ids.tolist() == list(range(start, start + len(ids)))
                at += len(ids)
                pieces[doc].append((start, len(ids)))
            assert at & (at - 1) == 0
        assert {d: sum(n for _, n in p) for d, p in pieces.items()} == dict(enumerate(sizes))


def test_encoders_agree_on_odd_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    enc, slow = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(11)
    ranges = [(32, 127), (0, 32), (160, 1000), (0x4E00, 0x4F00), (0x1F300, 0x1F600), (0x0600, 0x0700), (0x2000, 0x2070)]
    for _ in range(400):
        text = "".join(chr(int(rng.integers(*ranges[rng.integers(len(ranges))]))) for _ in range(int(rng.integers(0, 60))))
        assert packing.encode(enc, text, 1).tolist() == slow.encode(text, add_special_tokens=False).ids + [1]


def test_sum_of_squares_takes_the_cheapest_level():
    levels = packing.Levels(16)
    for k in range(200):
        size = (k * 7) % 15 + 1
        before = levels.count.copy()
        open_at = [h for h in range(1, 16 - size + 1) if before[h]]

        def cost(h, before=before, size=size):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            return int((c**2).sum())

        best = min([cost(h) for h in [0, *open_at]])
        levels.place((k, 0, np.zeros(size, "<u4"), size), size)
        assert int((levels.count**2).sum()) == best


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\x00\x00\x00")


def test_equal_rows_are_wanted_once(spark, odd_docs):
    """400 equal rows give what brute force gives, in about the time of 100; so do the odd rows with their long text."""
    import random
    import time

    rnd = random.Random(6)
    text = " ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(1000))
    other = "x" * 50 + text[2000:2600]
    seconds = {}
    for n in (100, 400, 100, 400):
        rows = [(None if k % 2 else 7, text) for k in range(n)] + [(9, other)]
        began = time.time()
        got = Counter((r.doc_id, r.n_bytes, len(r.kept)) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect())
        seconds[n] = time.time() - began  # the second time, with all warm
        assert got == Counter({(None, len(text), 0): n // 2, (7, len(text), 0): n // 2, (9, 650, 50): 1})
    assert seconds[400] < 1.5 * seconds[100] + 2
    docs = odd_docs.select("doc_id", "text").filter("doc_id = 6").unionByName(odd_docs.select("doc_id", "text").filter("doc_id = 1"))
    raws = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = {d: bytes(np.frombuffer(raw, np.uint8)[~c]) for (d, raw), c in zip(raws, _covered([raw for _, raw in raws]), strict=True)}
    assert {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs).collect()} == want
