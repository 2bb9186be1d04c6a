"""Every query with SQL against DuckDB on the smallest tables; the rest give rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from ebbline.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(df: pd.DataFrame):
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return f"{x + 0.0:.7g}".replace("-0", "0", 1) if isinstance(x, float) and x == 0 else f"{x:.7g}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got.convert_dtypes(convert_floating=False)) == rows(want.convert_dtypes(convert_floating=False))
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(SQL) <= set(QUERIES)


def test_run(spark):
    from ebbline.plans import facts, run
    from ebbline.plans.contract import SALES
    from ebbline.plans.contract_file import parse_contract
    from ebbline.sources.sinks import shared_path

    results = run.analyse(facts.sales(spark, SF, "region", "nation"), SALES, "revenue", "geography")
    assert results["level_statistics"].filter("level = 0").count() == 1 and results["profiles"].count() > 0
    folder = shared_path(spark, "run")
    run.save(results, "revenue", folder)
    assert spark.read.json(f"{folder}/level_statistics").filter("metric = 'revenue'").count() == results["level_statistics"].count()
    c = parse_contract("name: x\ntime: {column: d, frequency: weekly}\nmetrics: [{name: m, type: ratio, depends_on: [a]}]\nhierarchies: [{name: h, children: [p, q]}]\nderived_kpis: [{name: k, numerator: m, subtract: s}]")
    assert c.hierarchies == {"h": ("p", "q")} and c.kpis[0].subtract == ("s",) and c.metrics[0].type == "ratio"
    with pytest.raises(ValueError):
        parse_contract("name: x")
