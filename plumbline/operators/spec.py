"""The one public description of a metric."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

SCOPES = ("GLOBAL", "DIMENSIONAL", "TEMPORAL")
TEMPLATES = ("SUM", "MEAN", "COUNT", "RATIO", "GROWTH", "PERCENT_CHANGE", "RATE")
DENOMINATOR_SCOPES = ("SAME_ROW", "DIMENSIONAL", "GLOBAL_SUM", "GROUP_SUM")
AGGREGATIONS = ("SUM", "MEAN", "LAST", "MAX", "MIN", "DISTINCT_COUNT")
GRAINS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


@dataclass(frozen=True)
class Guardrail:
    """A rule on one column, applied before anything is computed.

    ``invert`` turns a rank where low is good into max+1−x; ``transformation`` is LOG or
    SQRT; ``filter_condition`` is a SQL predicate that rows must meet.
    """

    column: str
    invert: bool = False
    transformation: str | None = None
    filter_condition: str | None = None


@dataclass(frozen=True)
class MetricSpec:
    """What to compute: numerator, optional denominator, template, scope and grouping.

    Without ``template`` a spec is RATIO when it has a denominator and MEAN when it has
    none. With ``numerator_agg``/``denominator_agg`` it is a KPI of two aggregations.
    """

    name: str
    numerator: str
    denominator: str | None = None
    template: str | None = None
    scope: str = "GLOBAL"
    denominator_scope: str | None = None
    dims: tuple[str, ...] = ()
    time: str | None = None
    grain: str | None = None
    numerator_agg: str | None = None
    denominator_agg: str | None = None
    guardrail: Guardrail | None = None
    filter: str | None = None
    motif: str | None = None
    title: str = ""
    priority: int = 1
    sanitized: bool = field(default=True)

    def __post_init__(self) -> None:
        object.__setattr__(self, "dims", tuple(self.dims))
        if self.scope not in SCOPES:
            raise ValueError(f"scope must be one of {SCOPES}")
        if self.template is not None and self.template not in TEMPLATES:
            raise ValueError(f"template must be one of {TEMPLATES}")
        for agg in (self.numerator_agg, self.denominator_agg):
            if agg is not None and agg not in AGGREGATIONS:
                raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
        if self.scope == "TEMPORAL" and (self.time is None or self.grain not in GRAINS):
            raise ValueError(f"a TEMPORAL spec names its time column and a grain of {tuple(GRAINS)}")
        if self.scope == "DIMENSIONAL" and not self.dims:
            raise ValueError("a DIMENSIONAL spec names its dimensions")
        if "LAST" in (self.numerator_agg, self.denominator_agg) and self.time is None:
            raise ValueError("LAST needs a time column")

    @property
    def kind(self) -> str:
        """The template in force."""
        if self.template is not None and not (self.template == "RATIO" and self.denominator is None):
            return self.template
        return "RATIO" if self.denominator is not None else "MEAN"

    @property
    def share_of(self) -> str:
        """The denominator scope in force; anything unknown counts as SAME_ROW."""
        known = self.denominator_scope in DENOMINATOR_SCOPES
        return self.denominator_scope if known else "SAME_ROW"

    @property
    def is_kpi(self) -> bool:
        return self.numerator_agg is not None

    @property
    def columns(self) -> tuple[str, ...]:
        """Columns that must hold a value for a row to count."""
        used = [self.numerator] + ([self.denominator] if self.denominator else [])
        return tuple(dict.fromkeys(used))

    def formula(self) -> str:
        """Short readable form of what is computed."""
        n, d = self.numerator, self.denominator
        if self.is_kpi:
            top = f"{self.numerator_agg}({n})"
            return f"{top} / {self.denominator_agg or 'SUM'}({d})" if d else top
        if self.kind == "RATIO":
            return {
                "SAME_ROW": f"MEAN({n} / {d})",
                "DIMENSIONAL": f"SUM({n}) / SUM({d})",
                "GLOBAL_SUM": f"SUM({n}) / TOTAL({d})",
                "GROUP_SUM": f"SUM({n}) / PARENT({d})",
            }[self.share_of]
        return f"{self.kind}({n})"


def deduplicate(specs: Iterable[MetricSpec]) -> list[MetricSpec]:
    """One spec per (metric, dims in any order, scope, grain, motif or title start).

    The lower priority number wins; among equals the first.
    """
    kept: dict[tuple, MetricSpec] = {}
    for spec in specs:
        signature = (spec.name, tuple(sorted(spec.dims)), spec.scope, spec.grain, spec.motif or spec.title[:15])
        if signature not in kept or spec.priority < kept[signature].priority:
            kept[signature] = spec
    return list(kept.values())


def by_dims(spec: MetricSpec, *dims: str) -> MetricSpec:
    """The same metric grouped by ``dims``."""
    return replace(spec, scope="DIMENSIONAL", dims=dims)
