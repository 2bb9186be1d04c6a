"""Near-duplicate documents: BagMinHash signatures, bands, and verified multiset overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped_after, small_batches, written

SHINGLE, HASHES, ROWS = 5, 64, 4
U = np.uint64
#: Texts in a bucket up to which single pairs are compared, and in a block of a larger one, where a text counts once for each UNIT bytes.
SMALL, BLOCK, UNIT = 64, 256, 8192
#: Texts are handled in pieces of about so many bytes; the arrays of a piece take some thirty times as much.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype("f8") + 0.5) * 2.0**-53


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of a text column of about `most` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start, held = 0, 0
    for k, n in enumerate(sizes):
        held += int(n)
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, hash) of each shingle: `width` words in a row, or all words of a shorter text."""
    raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, "i8")
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(start):
        return np.zeros(0, "i8"), np.zeros(0, U)
    length = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]])) - start
    doc = np.searchsorted(ends, start, side="right")
    word = np.zeros(len(start), U)
    pieces = np.unique(np.append(np.searchsorted(start, np.arange(0, len(data), CHUNK)), len(start)))
    for low, high in zip(pieces[:-1], pieces[1:], strict=True):
        begin, end = start[low], start[high] if high < len(start) else len(data)
        own = start[low:high] - begin
        place = np.arange(end - begin) - np.repeat(own, np.diff(np.append(own, end - begin)))
        here, gap = data[begin:end].astype(U) + U(1), blank[begin:end]
        place[gap], here[gap] = 0, 0
        power = np.cumprod(np.concatenate([[U(1)], np.full(int(length[low:high].max()), 0x9E3779B97F4A7C15, U)]), dtype=U)
        word[low:high] = mix64(np.add.reduceat(here * power[place], own) + length[low:high].astype(U))
    n = np.bincount(doc, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    # a text of fewer words than `width` has one shingle, of its words and zeros
    padded = np.concatenate([word, np.zeros(width, U)])
    in_doc = np.arange(len(word)) - first[doc]
    left = n[doc] - in_doc
    keep = (left >= width) | (in_doc == 0)
    total = np.zeros(len(word), U)
    for k in range(width):
        total = total * U(0xD6E8FEB86659FD93) + np.where(left > k, padded[k : k + len(word)], U(0))
    return doc[keep], mix64(total[keep])


def counted(doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, shingle) pairs: a key of both, the text, the shingle and its count."""
    key = mix64(s + mix64(doc.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "i8")
    return key[head], doc[order][head], s[order][head], np.diff(np.append(head, len(key)))


def bag_signatures(doc: np.ndarray, s: np.ndarray, weight: np.ndarray, n_docs: int, hashes: int = HASHES) -> np.ndarray:
    """(n_docs, hashes) of times; two texts agree in a place with the weighted Jaccard similarity as its chance.

    The weight axis of each shingle is cut into [0, 1), [1, 2), [2, 4), [4, 8), ...: the same for every text. Each
    interval has a Poisson process of points in time at the rate of its width. A point has a
    component of the signature and a place in its interval, and counts if the place is below the text's
    weight; all follow from the shingle, so equal weight gives equal points. A component
    keeps its earliest point. Processes run in order of time, and only up to a time by which all
    components are likely filled: texts with one left run again for twice as long.
    """
    out = np.full((n_docs, hashes), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    span = np.where(total > 0, (np.log(hashes) + 3) * hashes / np.maximum(total, 1), 0.0)
    octave = np.ceil(np.log2(np.maximum(weight, 1))).astype("i8")
    redo = np.ones(n_docs, bool)
    while True:
        for o in range(int(octave.max(initial=-1)) + 1):
            rate, low = (1.0, 0.0) if o == 0 else (2.0 ** (o - 1), 2.0 ** (o - 1))
            at = np.flatnonzero((octave >= o) & redo[doc])
            state = mix64(s[at] + U((o + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            time = np.zeros(len(at))
            while len(at):
                state = state + U(0x9E3779B97F4A7C15)
                time = time - np.log(uniform(mix64(state))) / rate
                live = time <= span[doc[at]]
                at, state, time = at[live], state[live], time[live]
                point = mix64(state ^ U(0x5851F42D4C957F2D))
                inside = low + rate * uniform(mix64(point)) < weight[at]
                np.minimum.at(out, (doc[at][inside], (point % U(hashes)).astype("i8")[inside]), time[inside])
        redo = (total > 0) & np.isinf(out).any(axis=1)
        if not redo.any():
            return out
        span = span * 2


#: Stands for a null doc_id, so that it comes after all others.
NO_ID = (1 << 63) - 1
SIGNED = "place long, node binary, n long, bands array<long>"


def addressed(docs: DataFrame) -> DataFrame:
    """docs with place (doc_id, or NO_ID) and node (a 128-bit hash of the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"place": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "node": F.unhex(F.md5(text.cast("binary")))})


def sign(docs: DataFrame, *, shingle: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """place, node, count of shingles and the bands' hashes of addressed docs; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch.column(2)):
                texts = batch.column(2).slice(start, end - start)
                doc, s = shingles(texts, shingle)
                _, doc, s, count = counted(doc, s)
                bits = bag_signatures(doc, s, count.astype("f8"), len(texts), hashes).view(U)
                bands = np.zeros((len(texts), hashes // rows), U)
                for r in range(rows):
                    bands = mix64(bands + bits[:, r::rows])
                bands = mix64(bands + np.arange(hashes // rows, dtype=U)).view("i8")
                n = np.bincount(doc, weights=count, minlength=len(texts)).astype("i8")
                lists = [b if h else [] for b, h in zip(bands, n > 0, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, end - start) for k in (0, 1)), pa.array(n), pa.array(lists, pa.list_(pa.int64()))], ["place", "node", "n", "bands"])

    return small_batches(docs.select("place", "node", F.col("text").cast("string"))).mapInArrow(run, SIGNED)


def overlap(a: pa.Array, b: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(common, all) of each pair of texts: the sums of the smaller and of the larger counts of each shingle."""
    (ka, da, _, ca), (kb, db, _, cb) = (counted(*shingles(x, shingle)) for x in (a, b))
    sizes = np.bincount(da, weights=ca, minlength=len(a)) + np.bincount(db, weights=cb, minlength=len(a))
    place = np.searchsorted(kb, ka)
    same = np.flatnonzero((place < len(kb)) & (kb[np.minimum(place, max(len(kb) - 1, 0))] == ka)) if len(kb) else np.zeros(0, "i8")
    common = np.bincount(da[same], weights=np.minimum(ca[same], cb[place[same]]), minlength=len(a))
    return common, sizes - common


def distances(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(a, b, gap): the weighted Jaccard distance of each pair of nodes, counted on their texts (node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch.column("text_a"), CHUNK // 2):
                part = batch.slice(start, end - start)
                common, every = overlap(part.column("text_a"), part.column("text_b"), shingle)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(1 - common / np.maximum(every, 1))], ["a", "b", "gap"])

    return small_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")).mapInArrow(run, "a binary, b binary, gap double")


def mixed_buckets(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The members, with their root, of buckets that hold more than one class."""
    here = written(members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{name}-rooted")
    mixed = written(here.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket"), f"{name}-buckets")
    return written(here.join(mixed, "bucket"), name)


def blocks_of(here: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """here (bucket, node, root, n, gap) with a block of bounded count and bytes (in the mean of a hash, and but for one very long text): bucket, size, far, part.

    size and far are classes of the count of shingles and of the distance from the bucket's first text, as wide as
    a link can span: linked texts are at most one class apart in both.
    """
    size = F.floor(F.log(F.greatest("n", F.lit(1))) / math.log(1 / threshold) + 1e-9)
    far = F.floor(F.col("gap") / (1 - threshold + 1e-9) + 1e-9)
    units = (F.floor(F.col("bytes") / UNIT) + 1).alias("units")
    sized = written(here.join(texts.select("node", "bytes"), "node").select("bucket", "node", "root", "n", "gap", size.alias("size"), far.alias("far"), units), "near-sized")
    cell = ["bucket", "size", "far"]
    parts = written(sized.groupBy(*cell).agg(F.ceil(2 * F.sum("units") / BLOCK).alias("parts")), "near-cells")
    return sized.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts", "units")


def block_links(here: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(a, b): links that join the classes of texts within a bucket, found block by block.

    Each pair of blocks that isn't of one class, and whose ranges of shingle counts and of distances from the bucket's first
    text allow a link, goes to one group of rows; before that, only these ranges are sent about. No pair of texts becomes a row: a group's
    products tell all its links, and one for each class that they join is returned.
    """
    key = ["bucket", "size", "far", "part"]
    numbered = written(blocks_of(here, texts, threshold), "near-blocks")
    heads = written(numbered.groupBy(*key).agg(*[f(c).alias(f"{c}_{e}") for c in ("root", "n", "gap") for f, e in ((F.min, "lo"), (F.max, "hi"))]), "near-heads")
    ranges = [f"{c}_{e}" for c in ("root", "n", "gap") for e in ("lo", "hi")]
    # a block looks for others in its own cell and in half of the cells around it, which look for it no more
    around = F.explode(F.array(*[F.struct((F.col("size") + i).alias("size"), (F.col("far") + j).alias("far")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    asks = heads.select("bucket", F.struct("size", "far", "part").alias("i"), *[F.col(c).alias(f"i_{c}") for c in ranges], around.alias("at"))
    asks = asks.select("bucket", "i", *[f"i_{c}" for c in ranges], F.col("at.size").alias("size"), F.col("at.far").alias("far"))
    one_class = (F.col("root_lo") == F.col("root_hi")) & (F.col("i_root_lo") == F.col("i_root_hi")) & (F.col("root_lo") == F.col("i_root_lo"))
    counts = (F.col("n_hi") >= threshold * F.col("i_n_lo") - 1e-6) & (F.col("i_n_hi") >= threshold * F.col("n_lo") - 1e-6)
    reach = 1 - threshold + 1e-9
    near = (F.col("gap_lo") - F.col("i_gap_hi") <= reach) & (F.col("i_gap_lo") - F.col("gap_hi") <= reach)
    met = asks.join(heads, ["bucket", "size", "far"]).select("bucket", "i", F.struct("size", "far", "part").alias("j"), (~one_class & counts & near).alias("may"))
    met = met.filter((F.col("i.size") < F.col("j.size")) | (F.col("i.far") != F.col("j.far")) | (F.col("i.part") <= F.col("j.part"))).filter("may")
    sides = met.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side")).select("bucket", "i", "j", "side.*")
    rows = written(sides, "near-sides").join(numbered, key).select("bucket", "i", "j", "node", "root").join(texts.drop("bytes"), "node").select("bucket", "i", "j", "node", "root", "text")

    def run(table: pa.Table) -> pa.Table:
        texts, nodes = table.column("text").combine_chunks(), table.column("node").to_pylist()
        n = len(nodes)
        doc, s = shingles(texts, shingle)
        _, doc, s, count = counted(doc, s)
        size = np.bincount(doc, weights=count, minlength=n)
        # the k-th copy of a shingle is an element of its own, so that common counts add up as sets do
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        doc, element = np.repeat(doc, count), mix64(np.repeat(s, count) + nth.astype(U))
        _, at, times = np.unique(element, return_inverse=True, return_counts=True)
        shared = times[at] > 1
        doc, at = doc[shared], np.unique(at[shared], return_inverse=True)[1]
        order = np.argsort(at, kind="stable")
        doc, at = doc[order], at[order]
        common, width = np.zeros((n, n)), 4096
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            a, b = np.searchsorted(at, [low, low + width])
            m = np.zeros((n, width), "f4")
            m[doc[a:b], at[a:b] - low] = 1
            common += m @ m.T
        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
        linked &= (size > 0)[:, None]
        root, roots = np.arange(n), table.column("root").to_pylist()
        first: dict[bytes, int] = {}
        for k, r in enumerate(roots):
            linked[k, first.setdefault(r, k)] = linked[first[r], k] = True
        while True:
            least = np.where(linked, root[None, :], n).min(axis=1)
            least = np.minimum(least, root)
            if (least == root).all():
                break
            root = least
        out = [(nodes[k], nodes[int(r)]) for k, r in enumerate(root) if r != k and roots[k] != roots[int(r)]]
        return pa.table([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): the smallest node of each connected component.

    Every label hooks onto its smallest neighbour, chains are halved, and edges inside one label go: rounds
    grow with the logarithm of the longest chain. Each round's tables are written, and all joins are of such tables, so
    that a label that very many nodes share is split.
    """
    live = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-edges")
    labels = live.select(F.col("u").alias("node")).union(live.select("v")).distinct().withColumn("root", F.col("node"))
    while True:
        both = live.union(live.select("v", "u"))
        parent = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), f"{name}-hooks")
        for _ in range(2):
            above = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = parent.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        parent = written(parent, f"{name}-parents")
        labels = written(labels.join(parent.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), f"{name}-labels")
        live = live.join(parent.withColumnRenamed("p", "pu"), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        live = written(live.filter("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), f"{name}-edges")
        if live.isEmpty():
            return labels


def node_classes(rows: DataFrame, signed: DataFrame, *, threshold: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """(node, place, class_place, class_node) of each node of addressed rows and their signatures: the smallest place of the node, and the smallest place and node of its class.

    The result is a written table; all that led to it is dropped.
    """
    with dropped_after(rows.sparkSession):
        roots = written(_roots(rows, signed, threshold, shingle), "near-roots")
        classes = written(roots.groupBy("root").agg(F.min(F.struct("place", "node")).alias("least")), "near-least")
        out = roots.join(classes, "root").select("node", "place", F.col("least.place").alias("class_place"), F.col("least.node").alias("class_node"))
        return written(out, "near-classes", outer=True)


def _roots(rows: DataFrame, signed: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(node, place, root): the smallest node of each node's class."""
    nodes = written(signed.groupBy("node").agg(F.min("place").alias("place"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows"), F.count_distinct("place").alias("places")), "near-nodes")
    banded = written(nodes.select("node", "n", F.explode("bands").alias("bucket")), "near-bands")
    sizes = written(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "near-sizes")
    shared = written(banded.join(sizes, "bucket"), "near-shared")
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    # a bucket's first text is the one that shares most buckets with others
    weighed = written(shared.join(weight, "node"), "near-weighed")
    first = written(weighed.groupBy("bucket").agg(F.min_by("node", F.struct(-F.col("weight"), "node")).alias("a")), "near-first")
    members = written(weighed.join(first, "bucket").select("bucket", "size", "node", "n", "a"), "near-members")
    wanted = nodes.join(weight.select("node"), "node", "left_semi").select("place", "node")
    texts = rows.select("place", "node", "text").join(wanted.hint("shuffle_hash"), ["place", "node"], "left_semi").select("node", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    if not nodes.filter("rows > places").isEmpty():
        texts = texts.dropDuplicates(["node"])
    texts = written(texts, "near-texts")
    reach = 1 - threshold + 1e-9
    pairs = written(members.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "near-pairs-1")
    tested = written(distances(pairs, texts, shingle), "near-tested-1")
    edges = tested.filter(F.col("gap") <= reach).select("a", "b")
    labels = components(edges, "near")
    # each text's distance from the first of its bucket
    known = members.join(tested.select("a", F.col("b").alias("node"), "gap"), ["a", "node"], "left")
    members = written(known.select("bucket", "size", "node", "n", (F.col("node") == F.col("a")).alias("is_first"), F.coalesce("gap", F.lit(0.0)).alias("gap")), "near-measured")
    here = mixed_buckets(members, labels, "near-mixed-small").filter(F.col("size") <= SMALL)
    counts = F.least("n", "a_n") >= threshold * F.greatest("n", "a_n") - 1e-6
    unlike = (F.col("node") > F.col("a")) & (F.col("root") != F.col("a_root")) & (F.abs(F.col("gap") - F.col("a_gap")) <= reach) & counts
    rest = here.filter("NOT is_first")
    left = rest.select("bucket", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("gap").alias("a_gap"), F.col("n").alias("a_n"))
    pairs = rest.select(F.col("bucket").alias("b_bucket"), "node", "root", "gap", "n").join(left, (F.col("b_bucket") == F.col("bucket")) & unlike)
    pairs = written(pairs.select("a", F.col("node").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs-2")
    edges = edges.unionByName(written(distances(pairs, texts, shingle).filter(F.col("gap") <= reach).select("a", "b"), "near-edges-2"))
    labels = components(edges, "near")
    here = mixed_buckets(members.filter(F.col("size") > SMALL), labels, "near-mixed-large")
    if not here.isEmpty():
        edges = edges.unionByName(written(block_links(here, texts, threshold, shingle), "near-edges-3"))
        labels = components(edges, "near")
    return nodes.select("node", "place").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, shingle: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id of every row of docs (doc_id, text): the smallest doc_id of its class.

    Classes are the connected components of pairs whose word-shingle multisets have a weighted Jaccard
    similarity of `threshold` or more; equal texts are one class to begin with. Texts that share a
    band's hash form a bucket. First a bucket compares all its texts with one, that which shares
    most buckets with others: this joins a large group of copies with a few comparisons a text. In
    buckets that still hold several classes, texts of different classes are compared: in small
    buckets pair by pair, but for those whose distances from the bucket's first differ by more than
    a link may span (distance obeys the triangle inequality) or whose counts of shingles are too far apart; in large ones block by block, each
    pair of blocks for which these two bounds allow a link in one product of their shingle counts. No other pair in one bucket is left out.

    The processes of bag_signatures run side by side, one for each doubling of the weight, thinned by a point's place where a text's weight ends inside one; none is split further.

    A text without words is in a class with its equals alone; null texts are empty. A null doc_id gets its class's
    smallest id, null if there is none. Repeated rows give a row each. No rows give no rows.
    """
    addresses = addressed(docs)
    signed = written(sign(addresses, shingle=shingle, hashes=hashes, rows=rows), "near-signed")
    classes = node_classes(addresses, signed, threshold=threshold, shingle=shingle).select("node", "class_place")
    some = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return signed.select("place", "node").join(classes, "node").select(some("place").alias("doc_id"), some("class_place").alias("class_id"))


def one_of_each(docs: DataFrame, *, threshold: float = 0.8, shingle: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that stand for a class: that of the smallest doc_id (null last), once if it is repeated."""
    # the rows go through as one column, whatever names their own columns have
    addresses = addressed(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    signed = written(sign(addresses, shingle=shingle, hashes=hashes, rows=rows), "near-signed")
    classes = node_classes(addresses, signed, threshold=threshold, shingle=shingle)
    stay = classes.filter("node = class_node").select("place", "node")  # one row a class
    kept = addresses.select("place", "node", "row").join(stay.hint("shuffle_hash"), ["place", "node"], "left_semi")
    if signed.count() > signed.select("place", "node").distinct().count():
        kept = kept.dropDuplicates(["place", "node"])
    return kept.select("row.*")
