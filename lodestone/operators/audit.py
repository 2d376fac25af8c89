"""Audit sessions: actions against known issues, rewards and scores."""

from __future__ import annotations

import math
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .detect import ROW

WHOLE_ROW = "_row"

# Rewards, penalties and the score's weights.
DIAGNOSE, TYPE_BONUS, FIX, PARTIAL_FIX, JUSTIFIED, EXPLORE = 0.10, 0.05, 0.15, 0.075, 0.05, 0.01
FALSE_POSITIVE, WRONG_FIX, LATE, INVALID, REINSPECT = -0.05, -0.08, -0.02, -0.01, -0.01
LEAST_SCORE, MOST_SCORE = 0.0001, 0.9999
DETECTION_WEIGHT, FIX_WEIGHT, FALSE_POSITIVE_RATE = 0.40, 0.60, 0.05
LATE_SHARE, CLOSE, SIMILAR = 0.8, 0.01, 0.85
STEPS = {"task_1_format_fixer": 30, "task_2_duplicate_detective": 50, "task_3_integrity_auditor": 65}

#: Sessions of more steps are replayed by blocks of so many.
SHORT, BLOCK = 1000, 2048

EPISODE = "episode bigint, step int, result string, delta double, cumulative double, found int, fixed int, false_positives int, done boolean"


def match_truth(actions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each action's first known issue (by ``ord``) on its row and column, or on its whole row.

    An equi-join on the row with the column condition left over, so it never becomes a nested loop.
    """
    t = truth.select(F.col(ROW), F.col("column").alias("truth_column"), F.col("type").alias("truth_type"), "expected", "ord")
    joined = actions.join(t, ROW, "left").withColumn("hit", (F.col("column") == F.col("truth_column")) | (F.col("truth_column") == WHOLE_ROW))
    best = joined.withColumn("rn", F.row_number().over(Window.partitionBy("action_id").orderBy(F.desc(F.coalesce("hit", F.lit(False))), "ord"))).where("rn = 1")
    matched = F.coalesce("hit", F.lit(False))
    return best.select(*actions.columns, matched.alias("matched"), *(F.when(matched, F.col(c)).alias(c) for c in ("truth_column", "truth_type", "expected", "ord")))


def diagnosis_rewards(matched: DataFrame) -> DataFrame:
    """The reward of each first diagnosis: the issue's, with a bonus for its type, or the penalty."""
    hit = DIAGNOSE + F.when(F.col("issue_type") == F.col("truth_type"), TYPE_BONUS).otherwise(0.0)
    return matched.withColumn("reward", F.round(F.when(F.col("matched"), hit).otherwise(FALSE_POSITIVE), 4))


def final_scores(totals: DataFrame) -> DataFrame:
    """``score`` from found, fixed, truths, fixable and false_positives.

    The rate of false positives doubles once findings and false positives exceed twice the truths.
    """
    rate = F.when(F.col("found") + F.col("false_positives") > 2 * F.col("truths"), 2 * FALSE_POSITIVE_RATE).otherwise(FALSE_POSITIVE_RATE)
    found = F.col("found") / F.nullif(F.col("truths"), F.lit(0))
    fixed = F.coalesce(F.col("fixed") / F.nullif(F.col("fixable"), F.lit(0)), F.lit(0.0))
    raw = DETECTION_WEIGHT * found + FIX_WEIGHT * fixed - F.col("false_positives") * rate
    return totals.withColumn("score", F.when(F.col("truths") == 0, LEAST_SCORE).otherwise(F.round(F.least(F.greatest(raw, F.lit(LEAST_SCORE)), F.lit(MOST_SCORE)), 4)))


def clamped(c: Column) -> Column:
    """To four places within the scores' open range; not-a-number is the least."""
    return F.when(c.isNull() | F.isnan(c), LEAST_SCORE).otherwise(F.round(F.least(F.greatest(c, F.lit(LEAST_SCORE)), F.lit(MOST_SCORE)), 4))


def grader_diagnostics(totals: DataFrame, rows: int, most_steps: int) -> DataFrame:
    """``totals`` (found, fixed, truths, fixable, false_positives, steps, inspected) with the parts of the
    score: rates, penalty and raw score, and issues a step, coverage and use of the steps, all clamped."""
    n = lambda c: F.col(c).cast("double")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    found, fixed = share(n("found"), n("truths")), share(n("fixed"), n("fixable"))
    rate = F.when((n("truths") > 0) & (n("found") + n("false_positives") > 2 * n("truths")), 2 * FALSE_POSITIVE_RATE).otherwise(FALSE_POSITIVE_RATE)
    penalty = n("false_positives") * rate
    parts = {
        "detection_rate": found,
        "fix_rate": fixed,
        "fp_penalty_rate": rate,
        "fp_penalty_total": penalty,
        "raw_score": found * DETECTION_WEIGHT + fixed * FIX_WEIGHT - penalty,
        "issues_per_step": share(n("found"), n("steps")),
        "exploration_coverage": share(n("inspected"), F.lit(float(rows))),
        "step_utilization": share(n("steps"), F.lit(float(most_steps))),
    }
    return totals.withColumns({k: clamped(c) for k, c in parts.items()}).withColumn("detection_only", F.col("truths") - F.col("fixable"))


def issue_flags(truth: DataFrame, found: DataFrame, fixed: DataFrame) -> DataFrame:
    """``truth`` (episode, _row, column, type, expected) with ``fixable``, ``detected`` and ``fixed``: whether
    a finding (episode, _row, column, truth_column) names it, and for fixable ones whether its row has a fix
    (episode, _row). Findings and fixes are first counted by cell, so a session's joins are by row."""
    key = ["episode", ROW]
    named = found.groupBy(*key).agg(F.collect_set("column").alias("_columns"), F.collect_set("truth_column").alias("_truths"))
    done = fixed.groupBy(*key).agg(F.lit(True).alias("_done"))
    hit = F.col("_columns").isNotNull() & (F.array_contains("_columns", F.col("column")) | F.array_contains("_truths", F.col("column")) | (F.col("column") == WHOLE_ROW))
    joined = truth.join(named, key, "left").join(done, key, "left")
    fixable = F.col("expected").isNotNull()
    return joined.select(*truth.columns, fixable.alias("fixable"), F.coalesce(hit, F.lit(False)).alias("detected"), F.when(fixable, F.coalesce("_done", F.lit(False))).alias("fixed"))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, its plan cut short: plans that nest fill the driver. A checkpoint where
    ``spark.checkpoint.dir`` is set, a local one in a session of one JVM, else persisted."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    return df.localCheckpoint() if context.master.split("[")[0] == "local" else df.persist(StorageLevel.DISK_ONLY)


def heuristic_actions(issues: DataFrame, rows: int, most_steps: int, first_column: str, related: tuple[str, ...] = ()) -> DataFrame:
    """The actions of an audit by rules, one session: inspect all rows by tens and the ``related`` tables,
    then for each cell's surest issue (_row, column, type, fix, confidence, emit_ord) a diagnosis and, where
    a fix is known, the fix, surest first, and finish. Actions beyond the budget aren't made.

    A step's number is the steps of all surer issues: those of earlier ranges of the order are one sum a
    range, those of its own range one window. So a session may have as many steps as its table has rows.
    """
    from .rules import best_confidence

    spark, batches = issues.sparkSession, -(-rows // 10)
    looks, tables = min(batches, most_steps), related[: max(0, most_steps - batches)]
    seen, i = looks + len(tables), F.col("id")
    inspect = lambda step, listed, name: (step.cast("int").alias("step"), F.lit("inspect").alias("action_type"), listed.alias("rows"), name.cast("string").alias("table"))
    look = spark.range(looks).select(*inspect(i + 1, F.sequence(10 * i, F.least(10 * i + 9, F.lit(rows - 1))), F.lit(None)))
    if tables:
        name = F.element_at(F.array(*map(F.lit, tables)), (i + 1).cast("int"))
        look = look.unionByName(spark.range(len(tables)).select(*inspect(batches + 1 + i, F.array(F.lit(0).cast("bigint")), name)))
    order = [F.desc("confidence"), F.asc("emit_ord"), F.asc(ROW), F.asc("column")]
    cost = F.when(F.coalesce(F.col("fix"), F.lit("")) != "", 2).otherwise(1).cast("bigint")
    best = best_confidence(issues).select(ROW, "column", "type", "fix", "confidence", "emit_ord", cost.alias("cost"))
    cut = settled(settled(best).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))  # sampled for its ranges first
    sums = cut.groupBy("part").agg(F.sum("cost").alias("sum"))
    starts = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum") + seen).alias("start"))  # a row a range
    placed = cut.join(starts, "part").withColumn("before", F.col("start") + F.sum("cost").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("cost"))
    column = F.when(F.col("column") == WHOLE_ROW, first_column).otherwise(F.col("column"))
    gone, none = F.col("fix") == "DELETE_ROW", F.lit(None).cast("string")
    made = lambda at, kind, *rest: F.struct((F.col("before") + at).alias("step"), F.lit(kind).alias("action_type"), *(c.alias(n) for n, c in zip(("issue_type", "new_value", "fix_type", "justification"), rest, strict=True)))
    diagnose = made(1, "diagnose", F.col("type"), none, none, none)
    fix = made(2, "fix", none, F.when(~gone, F.col("fix")), F.when(gone, "delete_row").otherwise("correct_value"), F.lit("by rule"))
    acts = placed.select(ROW, column.alias("column"), F.explode(F.when(F.col("cost") == 2, F.array(diagnose, fix)).otherwise(F.array(diagnose))).alias("x")).select("x.*", ROW, "column")
    end = sums.agg((F.coalesce(F.sum("sum"), F.lit(0)) + seen + 1).alias("step")).withColumn("action_type", F.lit("finalize"))
    within = [df.where(F.col("step") <= most_steps).withColumn("step", F.col("step").cast("int")) for df in (acts, end)]
    every = look.unionByName(within[0].select("step", "action_type", ROW, "column", "issue_type", "new_value", "fix_type", "justification"), True).unionByName(within[1], True)
    return every.withColumn("episode", F.lit(0).cast("bigint"))


def remaining_hint(remaining: Column) -> Column:
    return F.when(remaining <= 0, "none").when(remaining <= 2, "few").when(remaining <= 5, "some").otherwise("many")


def late_penalty(step: Column, most_steps: int) -> Column:
    return F.when(step > int(most_steps * LATE_SHARE), LATE).otherwise(0.0)


def floored_totals(deltas: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """(key, total): each key's deltas added in order, never falling below LEAST_SCORE on the way.

    A stretch of such a walk is known by its sum and the lowest point of its free sum, and stretches
    compose; so the table is cut into ranges of (key, order), each range is one stretch a key, and a
    key's few stretches are put together. A key with many steps spans many ranges.
    """
    cut = deltas.select(key, F.col(order).alias("o"), F.col(delta).cast("double").alias("d")).repartitionByRange(key, "o").withColumn("part", F.spark_partition_id())
    free = cut.withColumn("free", F.sum("d").over(Window.partitionBy(key, "part").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    stretches = free.groupBy(key, "part").agg(F.sum("d").alias("sum"), F.min("free").alias("low"))
    listed = F.array_sort(F.collect_list(F.struct("part", "sum", "low")))
    floor = F.lit(LEAST_SCORE)
    return stretches.groupBy(key).agg(F.aggregate(listed, floor, lambda a, s: a + s["sum"] + F.greatest(F.lit(0.0), floor - (a + s["low"]))).alias("total"))


def floored_totals_closed(deltas: DataFrame, key: str, order: str, delta: str) -> DataFrame:
    """The same by one window a key, for keys of few steps: a walk that is held at a floor equals its
    free sum less the lowest point that the free sum reached below the floor."""
    w = Window.partitionBy(key).orderBy(order)
    free = deltas.select(key, F.col(order).alias("o"), (F.sum(F.col(delta).cast("double")).over(w) + LEAST_SCORE).alias("free"))
    ends = free.groupBy(key).agg(F.max_by("free", "o").alias("last"), F.min("free").alias("lowest"))
    return ends.select(key, (F.col("last") - F.least(F.col("lowest") - LEAST_SCORE, F.lit(0.0))).alias("total"))


def newly_inspected(inspections: DataFrame) -> DataFrame:
    """Inspections (episode, step, _row) with ``new``: the step that sees the row first."""
    return inspections.withColumn("new", F.col("step") == F.min("step").over(Window.partitionBy("episode", ROW)))


def exploration_bonus(inspections: DataFrame, truth: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """(episode, step, bonus): a share for each issue in newly seen rows without a finding so far, and
    for coverage, falling as it grows; a penalty where nothing was new. ``found``: (episode, step, _row)."""
    seen = newly_inspected(inspections.distinct())
    per_row = truth.groupBy(ROW).agg(F.count("*").alias("issues"))
    first_found = found.groupBy("episode", ROW).agg(F.min("step").alias("found_at"))
    full = seen.join(per_row, ROW, "left").join(first_found, ["episode", ROW], "left")
    open_ = F.when(F.col("new") & (F.col("found_at").isNull() | (F.col("found_at") >= F.col("step"))), F.coalesce("issues", F.lit(0))).otherwise(0)
    steps = full.groupBy("episode", "step").agg(F.sum(open_).alias("undiscovered"), F.count_if("new").alias("n_new"))
    covered = F.sum("n_new").over(Window.partitionBy("episode").orderBy("step")) / F.lit(rows)
    bonus = F.when(F.col("n_new") == 0, REINSPECT).otherwise(F.col("undiscovered") * EXPLORE + F.col("n_new") * EXPLORE * 0.5 * (1 - covered))
    return steps.select("episode", "step", F.round(bonus, 9).alias("bonus"))


def action_summary(log: DataFrame) -> DataFrame:
    """By episode: actions of each kind, wasted steps (no gain, but for finishing) and efficiency."""
    kind = F.col("action_type")
    wasted = F.count_if((F.col("delta") <= 0) & (kind != "finalize"))
    return log.groupBy("episode").agg(*(F.count_if(kind == k).alias(k) for k in ("inspect", "diagnose", "fix", "finalize")), wasted.alias("wasted"), F.round(1 - wasted / F.count("*"), 4).alias("efficiency"))


def action_errors(actions: DataFrame) -> DataFrame:
    """Actions with ``error``: what their kind lacks, null if nothing."""
    kind, deletes = F.col("action_type"), F.coalesce(F.col("fix_type") == "delete_row", F.lit(False))
    located = F.col(ROW).isNotNull() & F.col("column").isNotNull()
    error = (
        F.when(~kind.isin("inspect", "diagnose", "fix", "finalize"), "unknown action")
        .when(kind.isin("diagnose", "fix") & ~located, "a row and a column are needed")
        .when((kind == "fix") & ~deletes & F.col("new_value").isNull(), "a new value is needed")
        .when((kind == "fix") & deletes & F.col("new_value").isNotNull(), "a deletion has no new value")
    )
    return actions.withColumn("error", error)


# Other names of the actions' fields and kinds.
ALIASES = {"row": "row_index", "col": "column_name", "column": "column_name", "value": "new_value", "table": "related_table", "type": "issue_type"}


def sanitize_keys(actions: DataFrame) -> DataFrame:
    """Action columns under their canonical names."""
    return actions.select(*(F.col(c).alias(ALIASES.get(c, c)) for c in actions.columns))


def credit_of(provided: str, expected: str) -> float:
    """What a fix is worth: equal, or near as a number or as a text."""
    if provided.lower() == expected.lower():
        return FIX
    try:
        p, e = float(provided), float(expected)
        if abs(p - e) / (abs(e) or 1.0) < CLOSE:
            return PARTIAL_FIX
    except ValueError:
        pass
    return PARTIAL_FIX if SequenceMatcher(None, provided.lower(), expected.lower()).ratio() >= SIMILAR else 0.0


def score_of(found: int, fixed: int, false_positives: int, truths: int, fixable: int) -> float:
    if not truths:
        return LEAST_SCORE
    rate = FALSE_POSITIVE_RATE * (2 if found + false_positives > 2 * truths else 1)
    raw = DETECTION_WEIGHT * found / truths + FIX_WEIGHT * (fixed / fixable if fixable else 0.0) - false_positives * rate
    return round(max(LEAST_SCORE, min(MOST_SCORE, raw)), 4)


@dataclass
class Session:
    """One session's state; ``act`` plays an action. ``truth`` may hold only the issues on the rows that
    the session touches, if ``truths`` and ``fixable`` count all."""

    truth: list[dict]
    rows: int
    most_steps: int
    truths: int | None = None
    fixable: int | None = None

    def __post_init__(self):
        if self.truths is None:
            self.truths, self.fixable = len(self.truth), sum(t.get("expected") is not None for t in self.truth)
        self.by_row: dict[int, list[dict]] = {}
        for t in self.truth:
            self.by_row.setdefault(t["row"], []).append(t)
        self.found: list[dict] = []
        self.found_in: dict[int, list[dict]] = {}
        self.fixed: set[tuple[int, str]] = set()
        self.seen: set[int] = set()
        self.false_positives, self.steps, self.total, self.done = 0, 0, LEAST_SCORE, False

    def _truth(self, row: int, column: str) -> dict | None:
        return next((t for t in self.by_row.get(row, ()) if t["column"] in (column, WHOLE_ROW)), None)

    def _find(self, row: int, column: str, truth: str) -> None:
        self.found.append({"row": row, "column": column, "truth": truth})
        self.found_in.setdefault(row, []).append(self.found[-1])

    def _inspect(self, a: dict) -> tuple[float, str]:
        listed = a.get("rows")
        asked = {r for r in list(listed)[:10] if 0 <= r < self.rows} if listed is not None else None
        if asked is None and not a.get("columns") and not a.get("table"):
            asked = set(range(min(5, self.rows)))
        if not asked:
            return 0.0, "initial"
        new, self.seen = asked - self.seen, self.seen | asked
        if not new:
            return REINSPECT, "initial"
        near = sum(len(self.by_row.get(r, ())) for r in new if r not in self.found_in)
        return near * EXPLORE + len(new) * EXPLORE * 0.5 * (1 - len(self.seen) / self.rows), "initial"

    def _diagnose(self, a: dict) -> tuple[float, str]:
        row, column = a.get("row"), a.get("column")
        if row is None or column is None or not 0 <= row < self.rows:
            return INVALID, "error"
        if any(f["column"] in (column, WHOLE_ROW) or f["truth"] == WHOLE_ROW for f in self.found_in.get(row, ())):
            return LEAST_SCORE, "already_found"
        t = self._truth(row, column)
        if t is None:
            self.false_positives += 1
            return FALSE_POSITIVE, "incorrect"
        self._find(row, column, t["column"])
        return DIAGNOSE + TYPE_BONUS * (a.get("issue_type") is not None and a["issue_type"] == t["type"]), "correct"

    def _fix(self, a: dict) -> tuple[float, str]:
        row, column, deletes = a.get("row"), a.get("column"), a.get("fix_type") == "delete_row"
        if row is None or column is None or (not deletes and a.get("new_value") is None) or not 0 <= row < self.rows:
            return INVALID, "error"
        if (row, column) in self.fixed:
            return LEAST_SCORE, "already_found"
        t = self._truth(row, column)
        if t is None:
            return WRONG_FIX, "incorrect"
        if t.get("expected") is None:
            return LEAST_SCORE, "partial"
        if t["expected"] == "DELETE_ROW":
            credit = FIX if deletes else 0.0
        else:
            credit = credit_of(str(a.get("new_value")).strip(), str(t["expected"]))
        if not credit:
            return WRONG_FIX, "incorrect"
        self.fixed.add((row, column))
        if not any(f["column"] == column or f["truth"] == WHOLE_ROW for f in self.found_in.get(row, ())):
            self._find(row, column, t["column"])
        return credit + JUSTIFIED * bool(a.get("justification")), "correct" if credit == FIX else "partial"

    def score(self) -> float:
        return score_of(len(self.found), len(self.fixed), self.false_positives, self.truths, self.fixable)

    def act(self, a: dict) -> tuple[str, float, float]:
        """(result, delta, total) of an action; both numbers lie strictly between 0 and 1."""
        self.steps += 1
        if a["action_type"] == "finalize":
            delta, self.total, self.done = self.score() - self.total, self.score(), True
            return "complete", max(LEAST_SCORE, min(MOST_SCORE, delta)), self.total
        play = {"inspect": self._inspect, "diagnose": self._diagnose, "fix": self._fix}.get(a["action_type"])
        delta, result = play(a) if play else (INVALID, "error")
        if self.steps > int(self.most_steps * LATE_SHARE):
            delta += LATE
        self.total = max(LEAST_SCORE, self.total + delta)
        if self.steps >= self.most_steps:
            self.total, self.done = max(self.total, self.score()), True
        self.total = max(LEAST_SCORE, min(MOST_SCORE, self.total))
        return result, max(LEAST_SCORE, min(MOST_SCORE, delta)), self.total


def replay(actions: DataFrame, truth: DataFrame, rows: int, most_steps: int) -> DataFrame:
    """Every step of every session (EPISODE columns).

    A session ends after ``most_steps`` actions, so only its first ones are read and its fold is one
    small group. It meets the issues on the rows that it touches alone, which join it by row; their
    total number and that of the fixable ones are two counts. Sessions that may have more than SHORT
    steps are replayed by ``replay_long``.
    """
    if most_steps > SHORT:
        return replay_long(actions, truth, rows, most_steps)
    first = actions.withColumn("_n", F.row_number().over(Window.partitionBy("episode").orderBy("step"))).where(F.col("_n") <= most_steps).drop("_n")
    asked = F.col("rows") if "rows" in actions.columns else F.lit(None).cast("array<bigint>")
    start = F.when((F.col("action_type") == "inspect") & asked.isNull(), F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))
    touched = first.select("episode", F.explode(F.filter(F.concat(F.coalesce(asked.cast("array<bigint>"), start, F.array().cast("array<bigint>")), F.array(F.col(ROW).cast("bigint"))), lambda r: r.isNotNull())).alias(ROW)).distinct()
    known = truth.select(ROW, F.col("column").alias("truth_column"), F.col("type").alias("truth_type"), "expected", "ord")
    near = touched.withColumnRenamed("episode", "session").join(known, ROW)
    total = truth.agg(F.count("*").alias("n"), F.count("expected").alias("fixable")).first()
    truths, fixable = total["n"], total["fixable"]

    def fold(group: pd.DataFrame, issues: pd.DataFrame) -> pd.DataFrame:
        listed = [{"row": r[ROW], "column": r["truth_column"], "type": r["truth_type"], "expected": r["expected"]} for r in issues.sort_values("ord").to_dict("records")]
        s, out = Session(listed, rows, most_steps, truths, fixable), []
        for a in group.sort_values("step").to_dict("records"):
            if s.done:
                break
            a = {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in a.items()}
            a["row"] = None if a.get(ROW) is None else int(a[ROW])
            result, delta, total = s.act(a)
            out.append((a["episode"], a["step"], result, delta, total, len(s.found), len(s.fixed), s.false_positives, s.done))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EPISODE.split(", ")])

    return first.groupBy("episode").cogroup(near.groupBy("session")).applyInPandas(fold, EPISODE)


@F.pandas_udf(T.DoubleType())
def credits(provided: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([0.0 if e is None else credit_of(p.strip(), e) for p, e in zip(provided, expected, strict=True)], dtype=float)


def _numbered(actions: DataFrame, most_steps: int) -> DataFrame:
    """The actions that are played, with ``n``, their number in the session: by blocks of steps, whose
    sizes are summed first."""
    raw, last = actions.withColumn("_b", F.floor(F.col("step") / BLOCK)), F.col("action_type") == "finalize"
    earlier = Window.partitionBy("episode").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    spans = raw.groupBy("episode", "_b").agg(F.count("*").alias("size"), F.max(last).alias("ends"))
    spans = spans.select("episode", "_b", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("ends").over(earlier), F.lit(False)).alias("over"))
    block = Window.partitionBy("episode", "_b")
    n = F.col("before") + F.row_number().over(block.orderBy("step"))
    placed = raw.join(spans.where(~F.col("over") & (F.col("before") < most_steps)), ["episode", "_b"]).withColumn("n", n).where(F.col("n") <= most_steps)
    placed = placed.withColumn("_end", F.min(F.when(last, F.col("n"))).over(block))
    return placed.where(F.col("_end").isNull() | (F.col("n") <= F.col("_end"))).drop("_b", "before", "over", "_end")


def _outcomes(acts: DataFrame, truth: DataFrame, rows: int) -> DataFrame:
    """(episode, step, n, result, base, new, near, found, fixed, wrong) of numbered actions: what each does
    to its rows, which no other row's history changes. ``base`` is its reward but for inspections, of which
    ``new`` and ``near`` count the rows not seen before and the unfound issues there.

    A row's history is known by a few first times: when it is first seen, when a cell is first named or
    fixed, and when an issue of the whole row is. An action's result follows from its place among them.
    """
    kind, n, whole = F.col("action_type"), F.col("n"), F.col("t.column") == WHOLE_ROW
    deletes = F.coalesce(F.col("fix_type") == "delete_row", F.lit(False))
    located = kind.isin("diagnose", "fix") & F.col(ROW).isNotNull() & F.col("column").isNotNull() & F.col(ROW).between(0, rows - 1)
    located = F.coalesce(located & ((kind == "diagnose") | deletes | F.col("new_value").isNotNull()), F.lit(False))
    start = F.array(*(F.lit(r).cast("bigint") for r in range(min(5, rows))))
    blank = lambda c: F.coalesce(F.size(c) == 0 if c == "columns" else F.col(c) == "", F.lit(True))
    listed = F.array_distinct(F.filter(F.slice("rows", 1, 10), lambda r: (r >= 0) & (r < rows)))
    asked = F.when(F.col("rows").isNotNull(), listed).when(blank("columns") & blank("table"), start)
    asked = F.when(kind == "inspect", F.coalesce(asked, F.array().cast("array<bigint>")))

    key, zero = ["episode", "step", "n"], F.lit(0).cast("bigint")
    counts = lambda **c: [c.get(k, zero).cast("bigint").alias(k) for k in ("new", "near", "found", "fixed", "wrong")]
    plain = acts.where(~located).select(*key, F.when(kind == "inspect", "initial").when(kind == "finalize", "complete").otherwise("error").alias("result"), F.when(kind == "inspect", F.when(F.size(asked) == 0, 0.0)).otherwise(INVALID).alias("base"), *counts())

    seen = acts.where(kind == "inspect").select(*key, F.explode(asked).alias(ROW)).groupBy("episode", ROW).agg(F.min(F.struct("n", "step")).alias("x")).select("episode", "x.step", "x.n", ROW, F.lit("inspect").alias("action_type"))
    named = acts.where(located).select(*key, ROW, "action_type", "column", "issue_type", deletes.alias("deletes"), "new_value", (F.coalesce("justification", F.lit("")) != "").alias("justified"))
    known = truth.groupBy(F.col(ROW).cast("bigint").alias(ROW)).agg(F.array_sort(F.collect_list(F.struct("ord", "column", "type", "expected"))).alias("_t"))
    touch = named.unionByName(seen, True).join(known, ROW, "left").withColumn("t", F.get(F.filter("_t", lambda x: x["column"].isin(WHOLE_ROW) | (x["column"] == F.col("column"))), F.lit(0)))
    touch = touch.withColumn("issues", F.coalesce(F.when(F.col("_t").isNotNull(), F.size("_t")), F.lit(0))).drop("_t")

    hit, fixes, expected = F.col("t").isNotNull(), kind == "fix", F.col("t.expected")
    compared = F.when(fixes & hit & (expected != "DELETE_ROW"), expected)
    touch = touch.withColumn("credit", credits(F.coalesce("new_value", F.lit("None")), compared))
    touch = touch.withColumn("credit", F.when(fixes & hit & (expected == "DELETE_ROW") & F.col("deletes"), FIX).otherwise(F.col("credit")))
    good = fixes & hit & (F.col("credit") > 0)
    able = ((kind == "diagnose") & hit) | good
    cell, row = Window.partitionBy("episode", ROW, "column"), Window.partitionBy("episode", ROW)
    first = lambda when, w: F.min(F.when(when, n)).over(w)
    touch = touch.select("*", first(able, cell).alias("_cell"), first(good, cell).alias("_fix"), first(able & whole, row).alias("_whole"), first(able, row).alias("_any"))
    before = lambda c: F.coalesce(n > c, F.lit(False))
    named_before, fixed_before = before(F.least("_cell", "_whole")), before(F.col("_fix"))
    finds = (kind != "inspect") & able & (n == F.col("_cell")) & ~before(F.col("_whole"))
    said = lambda result, base: F.struct(result.alias("result"), base.alias("base"))
    diagnosis = (
        F.when(named_before, said(F.lit("already_found"), F.lit(LEAST_SCORE)))
        .when(hit, said(F.lit("correct"), F.lit(DIAGNOSE) + F.when(F.col("issue_type") == F.col("t.type"), TYPE_BONUS).otherwise(0.0)))
        .otherwise(said(F.lit("incorrect"), F.lit(FALSE_POSITIVE)))
    )
    repair = (
        F.when(fixed_before, said(F.lit("already_found"), F.lit(LEAST_SCORE)))
        .when(hit & expected.isNull(), said(F.lit("partial"), F.lit(LEAST_SCORE)))
        .when(~good, said(F.lit("incorrect"), F.lit(WRONG_FIX)))
        .otherwise(said(F.when(F.col("credit") == FIX, "correct").otherwise("partial"), F.col("credit") + F.when(F.col("justified"), JUSTIFIED).otherwise(0.0)))
    )
    one = lambda c: F.when(c, 1).otherwise(0)
    done = touch.withColumn("o", F.when(kind == "diagnose", diagnosis).when(fixes, repair))
    looks = kind == "inspect"
    done = done.select(*key, "o.result", "o.base", *counts(new=one(looks), near=F.when(looks & ~before(F.col("_any")), F.col("issues")).otherwise(0), found=one(finds), fixed=one(good & (n == F.col("_fix"))), wrong=one((kind == "diagnose") & ~hit)))
    return done.unionByName(plain).groupBy(*key).agg(F.max("result").alias("result"), F.max("base").alias("base"), *(F.sum(c).alias(c) for c in ("new", "near", "found", "fixed", "wrong")))


def replay_long(actions: DataFrame, truth: DataFrame, rows: int, most_steps: int) -> DataFrame:
    """``replay`` for sessions of any length; no task holds more of one than a block.

    What an action does to its rows is found by row. The running counts, and the total held between its
    limits, are carried on from block to block: a block's walk is known by its sum and by where it ends
    from the least and from the most total, and such walks compose. Where a block ends alike from both,
    as nearly always, the next one starts from the very number that a fold of single actions gives;
    otherwise rounding may differ. Intermediate tables are ``settled``.
    """
    wanted = {"rows": "array<bigint>", "columns": "array<string>", "table": "string", "new_value": "string", "fix_type": "string", "justification": "string", "issue_type": "string"}
    every = actions.select("episode", "step", "action_type", F.col(ROW).cast("bigint").alias(ROW), "column", *((F.col(c) if c in actions.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()))
    total = truth.agg(F.count("*").alias("n"), F.count("expected").alias("fixable")).first()
    truths, fixable = total["n"], total["fixable"]
    acts = settled(_numbered(every, most_steps))
    parts = settled(_outcomes(acts, truth, rows).withColumn("block", F.floor((F.col("n") - 1) / BLOCK)))
    key, late = ["episode", "block"], int(most_steps * LATE_SHARE)

    sums = parts.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("new", "found", "fixed", "wrong")))
    order = Window.partitionBy("episode").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*key, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("new", "found", "fixed", "wrong")), F.lead("block").over(order).isNotNull().alias("goes_on"))
    steps = parts.join(starts, key)

    def deltas(g: pd.DataFrame) -> np.ndarray:
        near, new = g["near"].to_numpy(float), g["new"].to_numpy(float)
        covered = (g["new_before"] + g["new"].cumsum()).to_numpy(float)
        looked = np.where(new > 0, near * EXPLORE + new * EXPLORE * 0.5 * (1 - covered / max(rows, 1)), REINSPECT)
        base = g["base"].to_numpy(float)
        return np.where(np.isnan(base), looked, base) + np.where(g["n"].to_numpy() > late, LATE, 0.0)

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        d = deltas(g.sort_values("n")).tolist()
        low, high = LEAST_SCORE, MOST_SCORE
        for x in d:
            low = max(LEAST_SCORE, min(MOST_SCORE, low + x))
            high = max(LEAST_SCORE, min(MOST_SCORE, high + x)) if high != low else low
        return pd.DataFrame([(g["episode"].iloc[0], g["block"].iloc[0], math.fsum(d), low, high)], columns=["episode", "block", "sum", "low", "high"])

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        g, x, out = g.sort_values("block"), LEAST_SCORE, []
        for s, low, high in zip(g["sum"], g["low"], g["high"], strict=True):
            x = min(high, max(low, x + s))
            out.append(x)
        return pd.DataFrame({"episode": g["episode"], "block": g["block"] + 1, "start": out})

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        first = g["start"].iloc[0]
        total, out = LEAST_SCORE if math.isnan(first) else first, []
        found, fixed, wrong = ((g[f"{c}_before"] + g[c].cumsum()).tolist() for c in ("found", "fixed", "wrong"))
        for i, (n, d, result) in enumerate(zip(g["n"].tolist(), deltas(g).tolist(), g["result"], strict=True)):
            if result == "complete":
                after = score_of(found[i], fixed[i], wrong[i], truths, fixable)
                d = after - total
            else:
                after = max(LEAST_SCORE, total + d)
                if n >= most_steps:
                    after = max(after, score_of(found[i], fixed[i], wrong[i], truths, fixable))
                after = max(LEAST_SCORE, min(MOST_SCORE, after))
            total = after
            out.append((max(LEAST_SCORE, min(MOST_SCORE, d)), total, result == "complete" or n >= most_steps))
        delta, cumulative, done = zip(*out, strict=True)
        return pd.DataFrame({"episode": g["episode"].to_numpy(), "step": g["step"].to_numpy(), "result": g["result"].to_numpy(), "delta": delta, "cumulative": cumulative, "found": found, "fixed": fixed, "false_positives": wrong, "done": done})

    walks = steps.where("goes_on").groupBy(*key).applyInPandas(ends, "episode bigint, block bigint, sum double, low double, high double")
    begun = walks.groupBy("episode").applyInPandas(chain, "episode bigint, block bigint, start double")  # a row a block
    return steps.join(begun, key, "left").groupBy(*key).applyInPandas(fold, EPISODE)


def informed_actions(truth: DataFrame) -> DataFrame:
    """The actions of an agent that knows the truth: diagnose every issue, fix those with a value, finish."""
    t = truth.select(ROW, "column", "type", "expected", "ord")
    diagnose = t.select(F.lit(0).cast("bigint").alias("episode"), (3 * F.col("ord") + 1).cast("int").alias("step"), F.lit("diagnose").alias("action_type"), ROW, "column", F.col("type").alias("issue_type"), F.lit(None).cast("string").alias("new_value"), F.lit(None).cast("string").alias("fix_type"), F.lit(None).cast("string").alias("justification"))
    gone = F.col("expected") == "DELETE_ROW"
    fix = t.where("expected is not null").select(F.lit(0).cast("bigint").alias("episode"), (3 * F.col("ord") + 2).cast("int").alias("step"), F.lit("fix").alias("action_type"), ROW, "column", F.lit(None).cast("string").alias("issue_type"), F.when(~gone, F.col("expected")).alias("new_value"), F.when(gone, "delete_row").otherwise("correct_value").alias("fix_type"), F.lit("known").alias("justification"))
    return diagnose.unionAll(fix)


def random_actions(spark, episodes: int, steps: int, rows: int, columns: list[str], types: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Seeded sessions: about 40 % inspections, 30 % diagnoses, 20 % fixes and 10 % endings, by hash."""
    base = spark.range(episodes * steps).select(F.floor(F.col("id") / steps).alias("episode"), (F.col("id") % steps + 1).cast("int").alias("step"), F.col("id"))
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    word = lambda salt, words: F.element_at(F.array(*map(F.lit, words)), (draw(salt, len(words)) + 1).cast("int"))
    kind = F.when(draw("kind", 10) < 4, "inspect").when(draw("kind", 10) < 7, "diagnose").when(draw("kind", 10) < 9, "fix").otherwise("finalize")
    out = base.withColumn("action_type", F.when(F.col("step") == steps, "finalize").otherwise(kind))
    located = F.col("action_type").isin("diagnose", "fix")
    return out.select("episode", "step", "action_type", F.when(located, draw("row", rows)).alias(ROW), F.when(located, word("column", columns)).alias("column"), F.when(F.col("action_type") == "diagnose", word("type", types)).alias("issue_type"), F.when(F.col("action_type") == "fix", F.lit("random")).alias("new_value"), F.lit(None).cast("string").alias("fix_type"), F.lit(None).cast("string").alias("justification"))


def next_uninspected(rows: DataFrame, inspected: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows not inspected yet: what an agent without a better idea looks at."""
    return rows.select(ROW).join(inspected.select(ROW).distinct(), ROW, "left_anti").orderBy(ROW).limit(n)


def fallback_action(step: int, most_steps: int, task: str, seen_products: bool, seen_rules: bool) -> str:
    """'finalize' near the budget's end, then what the order task needs first, else 'inspect'."""
    if step >= 0.9 * most_steps:
        return "finalize"
    if task == "task_3_integrity_auditor" and not seen_products:
        return "products"
    return "business_rules" if task == "task_3_integrity_auditor" and not seen_rules else "inspect"
