"""Contracts from YAML text."""

from __future__ import annotations

from .contract import Contract, Dimension, Kpi, Metric


def parse_contract(text: str) -> Contract:
    """A contract with name, time (column, frequency), metrics, dimensions, hierarchies, derived_kpis and materiality."""
    import yaml

    d = yaml.safe_load(text)
    missing = [k for k in ("name", "time", "metrics") if not d.get(k)]
    if missing:
        raise ValueError(f"the contract lacks {', '.join(missing)}")
    listed = lambda x: tuple(x) if isinstance(x, (list, tuple)) else (x,) if x else ()
    metric = lambda m: Metric(m["name"], m.get("column"), m.get("type", "additive"), m.get("optimization", "maximize"), listed(m.get("tags")), m.get("pvm_role"), m.get("formula"), listed(m.get("depends_on")), int(m.get("lag_periods", 0)))
    kpi = lambda k: Kpi(k["name"], k["numerator"], listed(k.get("subtract")), k.get("add"), k.get("denominator"), k.get("divide_by"), k.get("multiply"))
    limits = d.get("materiality") or {}
    return Contract(
        d["name"], d["time"]["column"], d["time"].get("frequency", "monthly"), tuple(map(metric, d["metrics"])), tuple(Dimension(x["name"], x.get("column"), x.get("role", "primary"), listed(x.get("tags"))) for x in d.get("dimensions") or ()),
        {h["name"]: listed(h.get("children") or h.get("levels")) for h in d.get("hierarchies") or ()}, tuple(map(kpi, d.get("derived_kpis") or ())), float(limits.get("variance_pct", 5.0)), float(limits.get("variance_absolute", 50_000)),
    )
