"""All builders' cards from few passes over the line items."""

from ebbline.plans import alert_queries, facts
from ebbline.plans.stats_queries import metrics
from ebbline.plans.variance_queries import monthly


def test_line_items_meet_customers_once(spark, sf, monkeypatch):
    """Two passes over all months, one over two months; what is rolled up equals what its own pass gives."""
    reads, table = [], facts.table
    monkeypatch.setattr(facts, "table", lambda spark, sf_dir, name: reads.append(name) or table(spark, sf_dir, name))
    alert_queries.every_card(spark, sf)
    assert reads.count("lineitem") == 3
    now = facts.latest(spark, sf)[0]
    fact = alert_queries.geography(spark, sf, now)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    own = metrics(spark, sf, "region").select("region", "period", "revenue", "quantity", "lines")
    assert rows(fact.groupBy("region", "period").agg({"revenue": "sum", "quantity": "sum", "lines": "sum"}).selectExpr("region", "period", "double(`sum(revenue)`)", "double(`sum(quantity)`)", "double(`sum(lines)`)")) == rows(own)
    cells = monthly(spark, sf, "nation", "segment", until=now).select("period", "nation", "segment", "revenue")
    assert rows(fact.groupBy("period", "nation", "segment").sum("revenue")) == rows(cells)
