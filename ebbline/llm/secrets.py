"""Secret scans of every version of a text, each content scanned once per rule version."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written


@dataclass(frozen=True)
class Rule:
    """pattern's leftmost non-overlapping matches whose `group` has `least` characters or more; `hint` is true wherever one can be."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


#: Fixed values. A run of 16 or more hex digits, and of 14 or more capitals and digits after AKIA, is a longest run of that length, so the least length stands in the pattern.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "contains(text, ':') OR contains(text, '=')", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", "contains(text, 'AKIA')"),
    Rule("hex", 1, r"[0-9a-f]{16,}", "text RLIKE '[0-9a-f]{16}'"),
)
SPANS = "array<struct<start:int,end:int>>"


def in_runs(items: Column, run: Callable[[Column], Column]) -> Column:
    """run of each stretch of items, in order, of about as many items as there are stretches: folds over one stretch, and then over the stretches, stay far from the square of the items."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / wide).cast("int"), F.lit(0))), lambda k: let(F.slice(items, k * wide + 1, wide), run))


def spans_of(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of each match that passes: the pieces between matches tell where they are."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x)).alias("n"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x)).alias("held"),
    )
    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    moved = lambda spans, by: F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end")))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        span = F.array(F.struct(at.alias("start"), (at + x["n"]).alias("end")))
        return F.struct((at + F.coalesce(x["n"], F.lit(0))).alias("at"), F.when(x["held"] >= rule.least, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    def join(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x["at"]).alias("at"), F.concat(s["spans"], moved(x["spans"], s["at"])).alias("spans"))

    # spans of each run of matches from the run's own start on, then of all
    spans = let(found, lambda f: F.aggregate(in_runs(f, lambda part: F.aggregate(part, start, step)), start, join, lambda s: s["spans"]))
    return F.when(F.expr(rule.hint), spans).otherwise(none)


def hinted(rules: tuple[Rule, ...]) -> Column:
    """Whether any rule's hint holds in `text`: where none does, there is nothing to find."""
    return reduce(or_, [F.coalesce(F.expr(r.hint), F.lit(False)) for r in rules])


def scan_new_blobs(history: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): every version with its content's address, and the ledger with what was not yet scanned added.

    history (doc_id, text): a row is a version of the path doc_id. A content's address is its SHA-256;
    the ledger (blob, kind, version, spans) has a row for each content and rule version scanned,
    with or without findings. Only pairs of content and rule version that it lacks are scanned, each content where its
    smallest doc_id has it; of those, contents whose rule can't match by its hint are entered without a look at the whole text, and
    without being shuffled. A null text is empty; a null doc_id is a path like any other; equal
    rows are scanned once; an empty history leaves the ledger as it is.
    """
    rows = history.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hints = F.array(*[F.coalesce(F.expr(r.hint), F.lit(False)) for r in rules]).alias("hints")
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place"), F.sha2("text", 256).alias("blob"), hints, "text")
    paths = written(rows.select("doc_id", "place", "blob", "hints"), "secret-paths")
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.get("hints", F.lit(k)).alias("hint")) for k, r in enumerate(rules)])
    unseen = paths.groupBy("blob").agg(F.min("place").alias("place"), F.first("hints").alias("hints")).select("blob", "place", F.explode(pairs).alias("pair")).select("blob", "place", "pair.*")
    if ledger is not None:
        unseen = unseen.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    unseen = written(unseen, "secret-unseen")
    silent = unseen.filter(~F.col("hint")).select("blob", "kind", "version", F.array().cast(SPANS).alias("spans"))
    asked = unseen.filter("hint").groupBy("blob", "place").agg(F.collect_set(F.struct("kind", "version")).alias("asked"))
    todo = rows.filter(F.array_contains("hints", True)).select("place", "blob", "text").join(asked, ["blob", "place"])
    is_asked = lambda r: F.exists("asked", lambda x: (x["kind"] == r.kind) & (x["version"] == r.version))
    each = F.array(*[F.when(is_asked(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))) for r in rules])
    scanned = todo.select("blob", F.filter(each, lambda x: x.isNotNull()).alias("found"))
    fresh = scanned.dropDuplicates(["blob"]).select("blob", F.explode("found").alias("f")).select("blob", "f.*")
    fresh = written(fresh.unionByName(silent), "secret-ledger")
    return paths.select("doc_id", "blob"), fresh if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(fresh)


def scan_in_loads(history: DataFrame, loads: int = 2, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger) of a history that arrives in loads: equal ranges of doc_id, those without an id first. Each load is scanned against the ledger of the ones before."""
    least, most = history.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    load = F.lit(0)
    if least is not None and most > least:
        share = (F.col("doc_id").cast("double") - float(least)) / (float(most) - float(least))
        load = F.coalesce(F.least(F.floor(share * loads), F.lit(loads - 1)), F.lit(0))
    paths = ledger = None
    for k in range(loads):
        part, ledger = scan_new_blobs(history.filter(load == k), ledger, rules)
        paths = part if paths is None else paths.unionByName(part)
    return paths, ledger


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every version with all spans of its content by the given rules, by start and then by the rules' order."""
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
    spans = ledger.filter(F.size("spans") > 0).withColumn("rank", rank[F.concat_ws(":", "kind", "version")]).filter("rank IS NOT NULL")
    spans = spans.select("blob", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind")))).alias("span"))
    # written, so that the join can split the paths of a content that very many have
    by_blob = written(spans.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans")), "secret-spans")
    return paths.join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with each span, or run of overlapping spans, replaced by the mask. Spans are ordered by start."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def stretch(s: Column, part: Column) -> Column:
        """Masks one run of spans within the piece of text from where the last run ended."""

        def within(piece: Column) -> Column:
            def step(t: Column, x: Column) -> Column:
                lead = F.substring(piece, t["at"] - s["at"] + 1, F.greatest(x["start"] - t["at"], F.lit(0)))
                out = F.when(x["start"] < t["at"], t["out"]).otherwise(F.concat(t["out"], lead, F.lit(mask)))
                return F.struct(F.greatest(t["at"], x["end"]).alias("at"), out.alias("out"))

            return F.aggregate(part, F.struct(s["at"].alias("at"), F.lit("").alias("out")), step)

        ends = F.array_max(F.transform(part, lambda x: x["end"]))
        done = let(F.substring(text, s["at"] + 1, F.greatest(ends - s["at"], F.lit(0))), within)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], d["out"]).alias("out")))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(in_runs(spans, lambda part: part), empty, stretch, rest))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """All rows of docs, with their columns, and every span of the rules masked in text; n_chars, where there is one, follows.

    Rows in which no rule's hint holds pass by as they are; the rest meet the spans of their contents.
    """
    paths, ledger = scan_new_blobs(docs, rules=rules)
    hits = ledger.filter(F.size("spans") > 0).select("blob").distinct()
    found = findings(hits, ledger, rules).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    # the rows go through as one column, whatever names their own columns have
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = hinted(rules)
    quiet = rows.filter(~some).select("row.*")
    loud = rows.filter(some).select("row", F.sha2("text", 256).alias("_blob")).join(found, "_blob", "left")
    clean = F.when(F.col("_spans").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("_spans"), mask)).alias("text")
    out = [clean if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        out[at] = F.when(F.col("_spans").isNull(), F.col("row.n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return quiet.unionByName(loud.select(*out))
