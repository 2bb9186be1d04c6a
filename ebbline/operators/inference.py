"""A contract proposed from a table of text columns: profiles over the whole table, decided on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.contract import Contract, Dimension, Metric
from .quality import DATE_FORMATS, IDENTIFIER_NAMES, date_share, dependencies, frequency, number, numeric_share

#: Words in names of areas, from the widest down; names beside each other are as wide.
AREAS = (("continent",), ("region",), ("country", "nation"), ("state", "province"), ("county", "district"), ("city", "metro"), ("zip", "postal"))


def area_rank(name: str) -> int | None:
    """How wide an area a column's name speaks of; None if of none."""
    return next((k for k, words in enumerate(AREAS) if any(w in name.lower() for w in words)), None)


def chains(columns: list[str], sizes: dict[str, int], links: set[tuple[str, str]], levels: int = 4) -> dict[str, tuple[str, ...]]:
    """Hierarchies by name, each from its widest level down, of at most `levels` levels; a column is in one hierarchy only.

    links: (child, parent) pairs. From each column that no chain has yet, the one with fewest values first, a chain goes down
    to the child with fewest values that hangs on all levels above it. Without any link, columns whose names speak of areas make one chain, from the
    widest area down; without two of these, the three columns with fewest values do.
    """
    order = sorted(columns, key=lambda c: (sizes[c], c))
    out, used = {}, set()
    for top in order:
        if top in used:
            continue
        chain = [top]
        for child in order:
            if len(chain) < levels and child not in used and child not in chain and all((child, above) in links for above in chain):
                chain.append(child)
        if len(chain) > 1:
            out[f"by_{top}".lower().replace(" ", "_")] = tuple(chain)
            used.update(chain)
    if not out:
        areas = sorted((c for c in order if area_rank(c) is not None), key=lambda c: area_rank(c))[:levels]
        flat = areas if len(areas) > 1 else order[:3] if len(order) > 1 else []
        if flat:
            out[f"by_{flat[0]}".lower().replace(" ", "_")] = tuple(flat)
    return out


def profiles(df: DataFrame) -> dict[str, dict]:
    """What decides each column's role, from one aggregation over all columns."""
    one = []
    for c in df.columns:
        text = number(F.col(c))
        one += [
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("filled"), F.approx_count_distinct(c, 0.02).alias("distinct"), numeric_share(F.col(c)).alias("numeric"), F.min(text).alias("lo"), F.max(text).alias("hi"), F.stddev_samp(text).alias("sd"), F.avg(text).alias("mean"),
                F.coalesce(F.bool_and(text == F.floor(text)), F.lit(False)).alias("whole"), F.lit(any(h in c.lower() for h in IDENTIFIER_NAMES)).alias("named"), F.avg(F.col(c).cast("string").contains("%").cast("double")).alias("percent"), F.array(*date_share(F.col(c)).values()).alias("dates"),
            )
        ]
    row = df.agg(F.array(*one).alias("p"), F.count("*").alias("rows")).first()
    return {p["column"]: p.asDict() | {"rows": row["rows"]} for p in row["p"]}


def propose(df: DataFrame, name: str, *, most_values: int = 1000, levels: int = 4) -> tuple[Contract, dict[str, str]]:
    """A contract for df, and the role that each column got: time, identifier, metric, ratio or dimension.

    A column is time if four in five of its values read in one date format; a number likewise. Numbers within [0, 1.01], or within
    [0, 100] and close together, or with percent signs, are ratios. Whole numbers that hardly repeat identify rows. All other columns
    are dimensions; those of 2 to `most_values` values can be levels of a hierarchy, of at most `levels` levels. See chains.
    """
    found, roles, formats = profiles(df), {}, {}
    for c, p in found.items():
        best = max(range(len(DATE_FORMATS)), key=lambda k: p["dates"][k] or 0.0)
        if (p["numeric"] or 0) > 0.8:
            span = p["lo"] >= 0 and (p["hi"] <= 1.01 or (p["hi"] <= 100 and (p["sd"] or 0) < 30 and not p["whole"]))
            roles[c] = "identifier" if p["whole"] and p["distinct"] > 0.95 * p["filled"] and p["lo"] >= 0 and (p["named"] or p["hi"] - p["lo"] <= 1000) else "ratio" if span or (p["percent"] or 0) > 0.3 else "metric"
        elif (p["dates"][best] or 0) > 0.8:
            roles[c], formats[c] = "time", DATE_FORMATS[best]
        else:
            roles[c] = "dimension"
    times = [c for c, r in roles.items() if r == "time"]
    dims = [c for c, r in roles.items() if r == "dimension"]
    sizes = {c: found[c]["distinct"] for c in dims}
    tied = [c for c in dims if 2 <= sizes[c] <= most_values]
    links = {(r["child"], r["parent"]) for r in dependencies(df, tuple(tied)).select("child", "parent").collect()} if len(tied) > 1 else set()
    grain = "monthly"
    if times:
        dated = df.select(F.to_date(F.try_to_timestamp(F.col(times[0]).cast("string"), F.lit(formats[times[0]]))).alias("d"))
        grain = frequency(dated, "d").first()["frequency"]
    numbers = [c for c, r in roles.items() if r in ("metric", "ratio")]
    first = next((c for c in numbers if roles[c] == "metric"), None)
    metrics = tuple(Metric(c, type="additive" if roles[c] == "metric" else "ratio") for c in numbers)
    return Contract(name, times[0] if times else "", grain, metrics, tuple(Dimension(c) for c in dims), chains(tied, sizes, links, levels), (), 5.0, 0.05 * abs(found[first]["mean"]) if first else 50_000.0), roles
