"""Declarative safety rules over candidate fixes, compiled to one CASE expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import Schema
from .detect import ROW


class PolicyError(ValueError):
    """A policy file that is malformed or names unknown rules."""


@dataclass(frozen=True)
class Context:
    """What the operator allows and has confirmed."""

    allow_pii: bool = False
    confirm_pii: bool = False
    confirm_escalations: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    description: str
    tier: str
    scope: str
    name: str
    override_flag: str | None = None
    confirm_flag: str | None = None


#: Predicates are column builders, looked up by name; a policy can't hold code.
PREDICATES: dict[str, Callable[[Schema | None], Column]] = {
    "pii_overwrite": lambda s: F.col("column").isin(*sorted(s.pii)) if s and s.pii else F.lit(False),
    "row_delete": lambda s: F.col("operation") == "delete_row",
    "aggregate_sensitive": lambda s: F.col("column").isin(*sorted(s.sources)) if s and s.sources else F.lit(False),
}
BATCH_PREDICATES: dict[str, Callable[[DataFrame], DataFrame]] = {"conflicting_cell_writes": lambda fixes: conflicting_writes(fixes)}
SCORERS: dict[str, Callable[[], Column]] = {"minimal_edit_distance": lambda: F.levenshtein("old_value", "new_value")}

# The default policy's ids, predicates and flags.
DEFAULT = {
    "hard_never": [
        {"id": "NO_PII_OVERWRITE", "description": "Personal columns stay as they are, unless a change is both allowed and confirmed.", "predicate": "pii_overwrite", "override_flag": "allow_pii", "confirm_flag": "confirm_pii"},
        {"id": "NO_ROW_DELETE", "description": "Fixes change cells; they never remove rows.", "predicate": "row_delete"},
        {"id": "NO_CONFLICTING_CELL_WRITES", "description": "Two fixes of a batch must not give one cell different values.", "predicate": "conflicting_cell_writes", "scope": "batch"},
    ],
    "soft_require_confirm": [{"id": "NO_AGGREGATE_BREAK", "description": "A column that feeds an aggregate is changed only after confirmation.", "predicate": "aggregate_sensitive", "confirm_flag": "confirm_escalations"}],
    "soft_prefer": [{"id": "MINIMAL_EDIT", "description": "Of several sound fixes the one of fewest edits is taken.", "scorer": "minimal_edit_distance"}],
}


def compile_policy(found: dict) -> tuple[Rule, ...]:
    """Rules in file order, the hard tier first; unknown predicates, scorers and flags are errors."""
    rules = []
    for tier in ("hard_never", "soft_require_confirm", "soft_prefer"):
        for x in found.get(tier) or []:
            if not isinstance(x, dict) or not x.get("id") or not x.get("description"):
                raise PolicyError(f"a rule of {tier} needs an id and a description")
            scope = "prefer" if tier == "soft_prefer" else x.get("scope", "single")
            known = {"prefer": SCORERS, "batch": BATCH_PREDICATES, "single": PREDICATES}.get(scope, {})
            name = x.get("scorer" if scope == "prefer" else "predicate")
            if name not in known:
                raise PolicyError(f"{x['id']}: unknown rule {name!r}")
            flags = [x.get("override_flag"), x.get("confirm_flag")]
            if any(f is not None and f not in Context.__dataclass_fields__ for f in flags):
                raise PolicyError(f"{x['id']}: unknown flag")
            rules.append(Rule(x["id"], x["description"], tier, scope, name, *flags))
    return tuple(rules)


@cache
def load_policy(path: str | None = None) -> tuple[Rule, ...]:
    """The policy of a YAML file, or the default one."""
    import yaml

    return compile_policy(DEFAULT if path is None else yaml.safe_load(Path(path).read_text()) or {})


def evaluate(fixes: DataFrame, schema: Schema | None, context: Context | None = None, policy: tuple[Rule, ...] | None = None) -> DataFrame:
    """``fixes`` with verdict (ALLOW, ESCALATE, DENY), rule_id and the verdict's reason; the first rule that holds decides."""
    context, chain = context or Context(), []
    for r in policy or load_policy():
        if r.scope != "single":
            continue
        flag = lambda name: bool(name and getattr(context, name))
        if r.tier == "hard_never" and flag(r.override_flag):
            if not r.confirm_flag or flag(r.confirm_flag):
                continue
            verdict, said = "ESCALATE", f"{r.rule_id}: {r.description} Confirmation is required."
        elif r.tier == "hard_never":
            verdict, said = "DENY", f"{r.rule_id}: {r.description}"
        elif flag(r.confirm_flag):
            continue
        else:
            verdict, said = "ESCALATE", f"{r.rule_id}: {r.description}"
        chain.append((PREDICATES[r.name](schema), verdict, r.rule_id, said))
    last = (F.lit("ALLOW"), F.lit(None).cast("string"), F.lit("All proposed fixes passed the constitutional safety gate."))
    out = F.struct(*(c.alias(n) for c, n in zip(last, ("verdict", "rule_id", "safety_reason"), strict=True)))
    for holds, verdict, rule, said in reversed(chain):
        out = F.when(holds, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule_id"), F.lit(said).alias("safety_reason"))).otherwise(out)
    return fixes.withColumn("_safety", out).select(*fixes.columns, "_safety.*")


def conflicting_writes(fixes: DataFrame) -> DataFrame:
    """Cells to which a batch writes different values."""
    return fixes.groupBy(ROW, "column").agg(F.countDistinct("new_value").alias("n_values")).where("n_values > 1")


def evaluate_batch(fixes: DataFrame, policy: tuple[Rule, ...] | None = None) -> tuple[str, str | None]:
    """('DENY', rule id) if a batch rule finds anything, else ('ALLOW', None)."""
    for r in policy or load_policy():
        if r.scope == "batch" and BATCH_PREDICATES[r.name](fixes).take(1):
            return "DENY", r.rule_id
    return "ALLOW", None
