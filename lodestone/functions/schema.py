"""Declared constraints of a table, read from YAML or a mapping; malformed parts are skipped."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

INTEGER_NAMES, REAL_NAMES, STRING_NAMES = ("int", "integer"), ("float", "decimal", "real"), ("str", "string")


@dataclass(frozen=True)
class FunctionalDependency:
    determinant: tuple[str, ...]
    dependent: str


@dataclass(frozen=True)
class DomainBound:
    column: str
    low: float | None = None
    high: float | None = None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class AggregateDependency:
    source: str
    target: str
    aggregate: str
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    columns: dict[str, str] = field(default_factory=dict)
    dependencies: tuple[FunctionalDependency, ...] = ()
    pii: frozenset[str] = frozenset()
    bounds: tuple[DomainBound, ...] = ()
    aggregates: tuple[AggregateDependency, ...] = ()

    def kind(self, column: str) -> str:
        """'integer', 'real', 'string' or 'unknown'; undeclared columns are strings."""
        name = self.columns.get(column, "str")
        return "integer" if name in INTEGER_NAMES else "real" if name in REAL_NAMES else "string" if name in STRING_NAMES else "unknown"

    @property
    def sources(self) -> frozenset[str]:
        return frozenset(a.source for a in self.aggregates)


def _strings(value) -> tuple[str, ...] | None:
    value = [value] if isinstance(value, str) else value
    return tuple(value) if isinstance(value, list) and value and all(isinstance(x, str) and x for x in value) else None


def _number(value) -> float | None:
    return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def schema_from_mapping(found: dict) -> Schema:
    """Keys columns, functional_dependencies, pii_columns, domain_bounds, aggregate_dependencies."""
    if not isinstance(found, dict):
        raise ValueError("a schema is a mapping")
    part = lambda key, kind: found.get(key) if isinstance(found.get(key), kind) else kind()
    fds = [FunctionalDependency(det, x["dependent"]) for x in part("functional_dependencies", list) if isinstance(x, dict) and (det := _strings(x.get("determinant"))) and isinstance(x.get("dependent"), str)]
    bounds = [DomainBound(c, _number(x.get("min")), _number(x.get("max")), bool(x.get("inclusive_min", True)), bool(x.get("inclusive_max", True))) for c, x in part("domain_bounds", dict).items() if isinstance(x, dict)]
    sums = [AggregateDependency(x["source_column"], x["target_column"], x["aggregate"], _strings(x.get("group_by")) or ()) for x in part("aggregate_dependencies", list) if isinstance(x, dict) and x.get("aggregate") in ("sum", "avg") and isinstance(x.get("source_column"), str) and isinstance(x.get("target_column"), str)]
    return Schema({str(k): str(v) for k, v in part("columns", dict).items()}, tuple(fds), frozenset(c for c in part("pii_columns", list) if isinstance(c, str)), tuple(bounds), tuple(sums))


def load_schema(path: str | Path | None) -> Schema | None:
    import yaml

    return None if path is None else schema_from_mapping(yaml.safe_load(Path(path).read_text()) or {})
