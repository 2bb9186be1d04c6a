"""One metric's analysis, composed from the operators and written as structured results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import periods as per
from ..operators import stats as st
from ..operators import variance as var
from ..sources.sinks import commit, dropped_after, kept, write_results
from .contract import Contract


def analyse(fact: DataFrame, contract: Contract, metric: str, hierarchy: str, comparison: str = "yoy") -> dict[str, DataFrame]:
    """Level statistics, cards, item profiles and scored alerts of an additive metric.

    fact has the contract's time column as `period` and the hierarchy's columns. It is rolled up to
    periods and the hierarchy's keys once; all else runs on that. The drill-down is a filter on the
    levels' cards, not a loop.
    """
    m, levels = contract.metric(metric), contract.hierarchies[hierarchy]
    rolled = kept(fact.groupBy("period", *levels).agg(F.sum(m.column or m.name).alias("value")), "rolled")
    days = per.observed(rolled)
    now = per.current(days, contract.effective_lag(metric))
    then = per.prior(days, now, per.comparison_kind(rolled, comparison))
    levelled = var.level_statistics(rolled, levels, "value", now, then, pct=contract.variance_pct, absolute=contract.variance_absolute)
    cards = al.hierarchy_cards(levelled)
    reached = al.drilled(cards).filter("reached").select("level")
    series = per.dense(rolled.filter(F.col("period") <= F.lit(now)), levels[-1], "value")
    odd = st.z_anomalies(series)
    found = al.anomaly_alerts(odd)
    found = found.join(al.item_shares(series, "item", "value"), "item").join(odd.groupBy("item").agg(F.count("*").alias("periods")), "item")
    return {"level_statistics": levelled, "cards": cards.join(reached, "level", "left_semi"), "profiles": st.item_profiles(series), "alerts": al.scored(found)}


def save(results: dict[str, DataFrame], metric: str, folder: str) -> None:
    """Each result as JSON below the folder, by metric."""
    for name, df in results.items():
        write_results(df.withColumn("metric", F.lit(metric)), f"{folder}/{name}")


def run(fact: DataFrame, contract: Contract, metric: str, hierarchy: str, folder: str, comparison: str = "yoy") -> None:
    """`analyse`, each result committed below the folder in place of an earlier run's (read it by `sinks.committed`), and no scratch table left, also where it fails."""
    with dropped_after(fact.sparkSession):
        for name, df in analyse(fact, contract, metric, hierarchy, comparison).items():
            commit(df.withColumn("metric", F.lit(metric)), f"{folder}/{metric}/{name}", form="json")
