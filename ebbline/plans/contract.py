"""A dataset contract: what a table's time, metrics, dimensions and hierarchies are, compiled to Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES, ROLES, GOALS = ("additive", "non_additive", "ratio", "derived"), ("primary", "secondary", "time", "auxiliary"), ("maximize", "minimize", "neutral")
#: Words of an expression that aren't columns.
FUNCTIONS = {"abs", "sum", "avg", "min", "max", "nullif", "coalesce", "case", "when", "then", "else", "end", "and", "or", "not", "null", "is", "in", "between", "cast", "as", "double"}


@dataclass(frozen=True)
class Metric:
    name: str
    column: str | None = None
    type: str = "additive"
    goal: str = "maximize"
    tags: tuple[str, ...] = ()
    pvm_role: str | None = None
    formula: str | None = None
    depends_on: tuple[str, ...] = ()
    lag_periods: int = 0

    def __post_init__(self):
        if self.type not in TYPES or self.goal not in GOALS or self.lag_periods < 0:
            raise ValueError(f"metric {self.name}: type, goal or lag isn't valid")


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str | None = None
    role: str = "primary"
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        if self.role not in ROLES:
            raise ValueError(f"dimension {self.name}: unknown role {self.role}")


@dataclass(frozen=True)
class Kpi:
    """numerator, less subtract, plus add, over denominator and divide_by, times multiply."""

    name: str
    numerator: str
    subtract: tuple[str, ...] = ()
    add: str | None = None
    denominator: str | None = None
    divide_by: str | float | None = None
    multiply: str | float | None = None


@dataclass(frozen=True)
class Contract:
    name: str
    time: str
    frequency: str
    metrics: tuple[Metric, ...]
    dimensions: tuple[Dimension, ...] = ()
    hierarchies: dict[str, tuple[str, ...]] = field(default_factory=dict)
    kpis: tuple[Kpi, ...] = ()
    variance_pct: float = 5.0
    variance_absolute: float = 50_000.0

    def metric(self, name: str) -> Metric:
        return next(m for m in self.metrics if m.name == name)

    def effective_lag(self, name: str, seen: frozenset = frozenset()) -> int:
        """A metric's own lag, or else the largest of those it depends on; cycles end the search."""
        if name in seen or all(m.name != name for m in self.metrics):
            return 0
        m = self.metric(name)
        return m.lag_periods or max((self.effective_lag(d, seen | {name}) for d in m.depends_on), default=0)

    def filters(self, asked: dict[str, object]) -> dict[str, list[str]]:
        """Column filters from a request: keys are names, columns or tags; 'all ...' asks for everything."""
        out: dict[str, list[str]] = {}
        for key, value in asked.items():
            values = [str(v).strip() for v in (value if isinstance(value, (list, tuple, set)) else [value])]
            values = [v for v in values if v and not re.match(r"(?i)all\b", v)]
            d = next((d for d in self.dimensions if key.lower() in {d.name.lower(), (d.column or d.name).lower(), *(t.lower() for t in d.tags)}), None)
            if d and values:
                out[d.column or d.name] = values
        return out

    def levels(self, hierarchy: str, fixed: dict[str, list[str]] | None = None) -> list[str]:
        """The levels below the total; one that a filter fixes to a single value repeats its parent and is skipped."""
        return [k for k in self.hierarchies[hierarchy] if len((fixed or {}).get(k, ["", ""])) > 1]


def columns_in(expression: str) -> set[str]:
    """The column names of an expression."""
    return {w for w in re.findall(r"\b[A-Za-z_]\w*\b(?!\s*\()", re.sub(r"'[^']*'", "", expression)) if w.lower() not in FUNCTIONS}


def checked(expression: str, columns: list[str]) -> Column:
    """The expression as a Column, if it names known columns and holds arithmetic and known functions alone."""
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", expression))
    unknown = {w for w in words if w not in columns and w.lower() not in FUNCTIONS}
    if unknown or not re.fullmatch(r"[\w\s+\-*/().,<>=!']*", expression):
        raise ValueError(f"not allowed in a formula: {sorted(unknown) or expression}")
    return F.expr(expression)


def kpi_formula(kpi: Kpi, by_name: dict[str, Kpi], period_days: int = 1, seen: tuple[str, ...] = ()) -> str:
    """A KPI over base columns alone: KPIs that it names are expanded; a cycle is an error."""
    numerator, denominator = kpi_parts(kpi, by_name, period_days, seen)
    return f"({numerator}) / nullif({denominator}, 0)" if denominator != "1" else f"({numerator})"


def kpi_parts(kpi: Kpi, by_name: dict[str, Kpi], period_days: int = 1, seen: tuple[str, ...] = ()) -> tuple[str, str]:
    """(numerator, denominator) to aggregate apart and divide last. The token period_days is the days of a period, wherever it stands."""
    if kpi.name in seen:
        raise ValueError(f"KPIs name each other: {' > '.join((*seen, kpi.name))}")

    def of(x: object) -> str:
        if x == "period_days":
            return str(period_days)
        return kpi_formula(by_name[x], by_name, period_days, (*seen, kpi.name)) if x in by_name else str(x)

    numerator = of(kpi.numerator) + "".join(f" - {of(s)}" for s in kpi.subtract) + (f" + {of(kpi.add)}" if kpi.add else "")
    if kpi.multiply is not None:
        numerator = f"({numerator}) * {of(kpi.multiply)}"
    below = [of(x) for x in (kpi.denominator, kpi.divide_by) if x is not None]
    return numerator, " * ".join(f"({b})" for b in below) or "1"


def aggregate_of(metric: Metric) -> str:
    """How a metric is rolled up: additive by sum, or by max if it is cumulative; rates by mean."""
    if metric.type == "additive":
        return "max" if "cumulative" in metric.tags else "sum"
    return "avg" if metric.type in ("ratio", "non_additive") else "sum"


def rolled(metric: Metric) -> Column:
    return {"sum": F.sum, "max": F.max, "avg": F.avg}[aggregate_of(metric)](metric.column or metric.name).alias(metric.name)


def ratio_config(metric: str, explicit: dict[str, dict[str, str]], contract: Contract) -> tuple[str, str] | None:
    """(numerator, denominator) of a ratio metric: from an explicit table first, then from its own formula in the contract."""
    if metric in explicit:
        return explicit[metric]["numerator"], explicit[metric]["denominator"]
    kpi = {k.name: k for k in contract.kpis}
    if metric in kpi and (kpi[metric].denominator or kpi[metric].divide_by):
        return kpi_parts(kpi[metric], kpi)
    m = next((m for m in contract.metrics if m.name == metric and m.formula), None)
    parts = re.fullmatch(r"\s*(?:100\s*\*\s*)?(\w+)\s*/\s*(\w+)\s*", m.formula) if m else None
    return (parts[1], parts[2]) if parts else None


def chosen_grain(*, aggregated: str | None = None, declared: str | None = None, override: str | None = None, environment: str | None = None, detected: str | None = None, median_gap: float | None = None) -> str:
    """The grain of an analysis: of its aggregation, else declared, asked for, set outside, detected, or monthly. Daily data with gaps of five to eight days is weekly."""
    names = (aggregated, declared, override, environment, detected if detected != "unknown" else None)
    grain = next((g for g in names if g), "monthly")
    return "weekly" if grain == "daily" and median_gap is not None and 5 <= median_gap <= 8 else grain


#: The contract that queries over the supplied tables use.
SALES = Contract(
    name="sales", time="period", frequency="monthly",
    metrics=(
        Metric("revenue", pvm_role="total", lag_periods=1), Metric("quantity", pvm_role="volume", lag_periods=1),
        Metric("price", type="ratio", formula="revenue / quantity", depends_on=("revenue", "quantity"), pvm_role="price", goal="neutral"), Metric("discount", type="non_additive", goal="minimize"),
    ),
    dimensions=(Dimension("region", tags=("area",)), Dimension("nation"), Dimension("brand"), Dimension("ptype"), Dimension("segment", role="auxiliary")),
    hierarchies={"geography": ("region", "nation"), "product": ("brand", "ptype")},
    kpis=(Kpi("net", "revenue", subtract=("cost",)), Kpi("net_per_unit", "net", denominator="quantity"), Kpi("revenue_per_day", "revenue", divide_by="period_days")),
)
