"""Replies, contexts, diagnostics, gates and audits by rules, on small cases and against plain Python."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import noisy_rows
from lodestone.operators import agents, audit, detect, generate, rules

ROW = detect.ROW


def test_replies_become_actions(spark):
    replies = [
        '{"action_type": "FIX", "row_index": "3", "column_name": "a", "new_value": 5, "fix_type": "Delete-Row", "extra": 1, "row_indices": [1]}',
        'text {"action_type": "detect", "row_index": 2.0, "issue_type": "dup", "note": "a } brace"} more {"x": 1}',
        '{"action_type": "inspect", "row_indices": ["x"], "column_names": ["a", "b"]}',
        "[1, 2]",
        '{"a": "unclosed {"action_type": "end"}',
        None,
        "",
    ]
    got = agents.parse_actions(spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "i int, text string"), "text").orderBy("i").collect()
    assert [r["action_type"] for r in got] == ["fix", "diagnose", "inspect", "inspect", "finalize", "inspect", "inspect"]
    assert (got[0]["row_index"], got[0]["new_value"], got[0]["fix_type"], got[0]["row_indices"]) == (3, "5", "delete_row", None)
    assert (got[1]["row_index"], got[1]["issue_type"]) == (2, "duplicate")
    assert got[2]["row_indices"] == got[3]["row_indices"] == [0, 1, 2, 3, 4] and got[2]["column_names"] == ["a", "b"]
    assert [r["readable"] for r in got] == [True, True, True, False, True, False, False]


def plain_truncation(texts, most):
    cost = [4 + len(t) // 4 for t in texts]
    budget, tail = int(most * 0.75), 4 if most < 32_000 else 8
    if sum(cost) <= budget or len(texts) <= 9:
        return set(range(len(texts)))
    keep, left = {0, *range(len(texts) - tail, len(texts))}, budget - len(texts[0]) // 4 - sum(cost[-tail:]) - 100
    for i in range(len(texts) - tail - 1, 0, -1):
        if cost[i] > left:
            break
        keep.add(i)
        left -= cost[i]
    return keep


@pytest.mark.parametrize("most", [400, 900, 40_000])
def test_truncated_like_a_loop(spark, most):
    r = np.random.default_rng(most)
    talks = {k: ["x" * int(r.integers(0, 400 if most < 40_000 else 30_000)) for _ in range(int(r.integers(1, 25)))] for k in range(30)}
    df = spark.createDataFrame([(k, i, t) for k, ts in talks.items() for i, t in enumerate(ts)], "k long, turn int, text string").repartition(3)
    got = {}
    for x in agents.truncated(df, "k", "turn", "text", most).collect():
        got.setdefault(x["k"], set()).add(x["turn"])
        assert x["dropped"] == len(talks[x["k"]]) - len(plain_truncation(talks[x["k"]], most))
    assert got == {k: plain_truncation(ts, most) for k, ts in talks.items()}


def test_observations_as_text(spark):
    rows = [(0, 30, "initial", 0.0, 0.0001, 0, "many", 0, 50, "Hello", "a:int"), (15, 30, "correct", 0.15, 0.25, 2, "few", 50, 50, None, "a:int")]
    df = spark.createDataFrame(rows, "step int, most_steps int, result string, delta double, cumulative double, found int, hint string, inspected int, rows int, message string, schema string")
    first, second = (r["t"].split("\n") for r in df.select(agents.observation_text(df).alias("t")).collect())
    assert first == ["Step 0/30 (0% used)", "Issues found: 0 | Remaining: many", "Row coverage: 0/50 inspected (50 remaining)", "Environment: Hello", "Schema: a:int"]
    assert second[1:] == ["Last action: correct (reward: +0.150, cumulative: 0.2500)", "Issues found: 2 | Remaining: few", "Row coverage: all 50 rows inspected"]
    notes = spark.createDataFrame([(0,), (3,)], "n int").select(agents.truncation_note(F.col("n")).alias("t")).collect()
    assert notes[0]["t"] is None and notes[1]["t"].startswith("3 earlier")


def test_flags_of_issues(spark):
    truth = spark.createDataFrame([(1, 0, "a", "t", "v"), (1, 1, "_row", "t", "DELETE_ROW"), (1, 2, "b", "t", None), (2, 0, "a", "t", "v")], f"episode long, {ROW} bigint, column string, type string, expected string")
    found = spark.createDataFrame([(1, 0, "x", "a"), (1, 1, "z", "_row"), (1, 2, "q", "q")], f"episode long, {ROW} bigint, column string, truth_column string")
    fixed = spark.createDataFrame([(1, 0), (1, 2)], f"episode long, {ROW} bigint")
    got = {(r["episode"], r[ROW]): (r["fixable"], r["detected"], r["fixed"]) for r in audit.issue_flags(truth, found, fixed).collect()}
    assert got == {(1, 0): (True, True, True), (1, 1): (True, True, False), (1, 2): (False, False, None), (2, 0): (True, False, False)}


def test_diagnostics_are_clamped(spark):
    t = spark.createDataFrame([(4, 2, 8, 4, 1, 20, 10), (0, 0, 0, 0, 0, 0, 0), (1, 0, 2, 1, 9, 65, 5)], "found long, fixed long, truths long, fixable long, false_positives long, steps long, inspected long")
    got = [r.asDict() for r in audit.grader_diagnostics(t, 50, 65).collect()]
    assert got[0]["detection_rate"] == 0.5 and got[0]["raw_score"] == pytest.approx(0.45) and got[0]["exploration_coverage"] == 0.2
    assert got[1]["raw_score"] == got[1]["issues_per_step"] == audit.LEAST_SCORE
    assert got[2]["fp_penalty_rate"] == 0.1 and got[2]["raw_score"] == audit.LEAST_SCORE and got[2]["step_utilization"] == audit.MOST_SCORE
    assert all(0 < v < 1 for r in got for k, v in r.items() if isinstance(v, float) and not math.isnan(v))


def test_an_audit_by_rules_end_to_end(spark):
    dirty, planted = generate.episode_table(spark, "task_1_format_fixer")
    types = {c: "string" for c in detect.cells(dirty)} | {"signup_date": "date"}
    found = rules.broken(dirty, rules.null_checks(detect.cells(dirty)) + rules.format_checks(types))
    acts = audit.heuristic_actions(found, dirty.count(), 60, "customer_id")
    plan = acts.orderBy("step").collect()
    assert [a["step"] for a in plan] == list(range(1, len(plan) + 1)) and plan[-1]["action_type"] == "finalize"
    assert [a["rows"] for a in plan[:5]] == [list(range(i, i + 10)) for i in range(0, 50, 10)]
    truth = planted.select(ROW, "column", "type", "expected", "ord")
    out = audit.replay(acts, truth, dirty.count(), 60).orderBy("step").toPandas()
    known = [r.asDict() for r in truth.withColumnRenamed(ROW, "row").orderBy("ord", "row").collect()]
    alone = audit.Session(known, dirty.count(), 60)
    for a in plan:
        alone.act({**a.asDict(), "row": a[ROW]})
    assert out["done"].iloc[-1] and out["cumulative"].iloc[-1] == pytest.approx(alone.score()) and out["cumulative"].iloc[-1] > 0.2
    short = audit.heuristic_actions(found, dirty.count(), 7, "customer_id").count()
    assert short <= 7


def test_gates_and_traps(spark):
    dirty, planted = generate.episode_table(spark, "task_3_integrity_auditor")
    clean = generate.trap_rows(generate.clean_orders(spark, generate.clean_products(spark)))
    gates = {r["gate"]: r["failures"] for r in generate.truth_gates(planted, clean, 32, 29).collect()}
    assert set(gates) == {"total", "fixable", "type", "expected", "decimal", "repeated", "trap"} and not any(gates.values())
    bad = planted.limit(3).withColumn("type", F.lit("odd")).unionByName(planted.limit(1))
    worse = {r["gate"]: r["failures"] for r in generate.truth_gates(bad, clean, 32).collect()}
    assert worse["total"] == 28 and worse["type"] == 3
    found = rules.broken(dirty, rules.cross_field_checks())
    assert generate.traps(clean).join(found.select(ROW, "column"), [ROW, "column"], "left_semi").count() == 0


def test_noisy_views_change_single_cells(spark):
    t = spark.range(4000).selectExpr(f"id as {ROW}", "concat('name', id) as name", "cast(id + 1 as string) as n")
    both = t.select("*", *(c.alias(f"{k}_seen") for k, c in noisy_rows(["name", "n"], 3, F.col(ROW)).items())).toPandas()
    name, n = both["name"] != both["name_seen"], both["n"] != both["n_seen"]
    assert not (name & n).any() and 0.10 < (name | n).mean() < 0.18
    moved = both[n]
    assert (abs(moved["n_seen"].astype(float) / moved["n"].astype(float) - 1) <= 0.0201).all()
    assert all(a.swapcase() == b or a.startswith(b) for a, b in both[name][["name", "name_seen"]].itertuples(index=False))


def test_sessions_from_subsets_of_truth(spark):
    """A session that meets only its rows' issues scores as one that holds them all."""
    r = np.random.default_rng(1)
    truth = [(i, str(r.choice(["a", "b", "_row"])), "t", None if i % 3 else "v", i) for i in range(200)]
    acts = [(e, s + 1, str(r.choice(["diagnose", "fix", "inspect"])), int(r.integers(0, 60)), str(r.choice(["a", "b"])), "t", "v", "correct_value", None, None if s % 2 else [int(x) for x in r.integers(0, 220, 4)]) for e in range(4) for s in range(30)]
    a = spark.createDataFrame(acts, f"episode long, step int, action_type string, {ROW} bigint, column string, issue_type string, new_value string, fix_type string, justification string, rows array<bigint>")
    t = spark.createDataFrame(truth, f"{ROW} bigint, column string, type string, expected string, ord int")
    got = audit.replay(a, t, 200, 25).toPandas()
    full = [{"row": x[0], "column": x[1], "type": x[2], "expected": x[3]} for x in truth]
    for e in range(4):
        s = audit.Session(full, 200, 25)
        want = [s.act({"action_type": x[2], "row": x[3], "column": x[4], "issue_type": x[5], "new_value": x[6], "fix_type": x[7], "rows": x[9]}) for x in acts if x[0] == e][:25]
        mine = got[got["episode"] == e].sort_values("step")
        assert mine["result"].tolist() == [w[0] for w in want] and np.allclose(mine["cumulative"], [w[2] for w in want])
    assert isinstance(got, pd.DataFrame) and json.dumps(got["step"].max().item())


def test_long_sessions_like_one_fold(spark, monkeypatch):
    """Sessions replayed by blocks give what one fold of their actions gives, in every step."""
    monkeypatch.setattr(audit, "BLOCK", 7)
    r = np.random.default_rng(5)
    truth = [(int(r.integers(0, 40)), str(r.choice(["a", "b", "_row"], p=[0.5, 0.4, 0.1])), str(r.choice(["t", "u"])), [None, "v", "10", "DELETE_ROW"][int(r.integers(0, 4))], i) for i in range(60)]
    kinds, maybe = ["diagnose", "fix", "inspect", "dance"], lambda v: v if r.random() < 0.9 else None
    acts = []
    for e in range(5):
        for s in range(200):
            kind = str(r.choice(kinds, p=[0.35, 0.35, 0.25, 0.05])) if (e, s) != (3, 101) else "finalize"
            listed = [int(x) for x in r.integers(-3, 60, 14)] if r.random() < 0.7 else None
            acts.append((e, 2 * s + 1, kind, maybe(int(r.integers(-2, 52))), maybe(str(r.choice(["a", "b", "c", "_row"]))), maybe(str(r.choice(["t", "u"]))), maybe(str(r.choice(["v", " V", "10.05", "x"]))), str(r.choice(["correct_value", "delete_row"])), maybe("why"), listed, None if r.random() < 0.8 else "products"))
    a = spark.createDataFrame(acts, f"episode long, step int, action_type string, {ROW} bigint, column string, issue_type string, new_value string, fix_type string, justification string, rows array<bigint>, `table` string").repartition(3)
    t = spark.createDataFrame(truth, f"{ROW} bigint, column string, type string, expected string, ord int")
    for most in (150, 1000):
        got = audit.replay_long(a, t, 50, most).toPandas()
        for e in range(5):
            s, want = audit.Session([{"row": x[0], "column": x[1], "type": x[2], "expected": x[3]} for x in truth], 50, most), []
            for x in acts:
                if x[0] == e and not s.done:
                    result, delta, total = s.act({"action_type": x[2], "row": x[3], "column": x[4], "issue_type": x[5], "new_value": x[6], "fix_type": x[7], "justification": x[8], "rows": x[9], "table": x[10]})
                    want.append((x[1], result, len(s.found), len(s.fixed), s.false_positives, s.done, delta, total))
            mine = got[got["episode"] == e].sort_values("step")
            assert list(zip(*(mine[c] for c in ("step", "result", "found", "fixed", "false_positives", "done")), strict=True)) == [w[:6] for w in want]
            assert np.allclose(mine[["delta", "cumulative"]].to_numpy(), [w[6:] for w in want], rtol=0, atol=1e-12)


def test_long_audits_are_dealt_over_tasks(spark):
    """A session of as many steps as its table has rows isn't one group, and its plan is neither sorted nor
    numbered in one task; the steps are those of the surest issues in order."""
    n = 30_000
    issues = spark.range(n).selectExpr(f"id as {ROW}", "'a' as column", "'t' as type", "if(id % 3 = 0, 'v', null) as fix", "double(id % 7) / 7 as confidence", "int(id % 2) as emit_ord").repartition(5)
    acts = audit.heuristic_actions(issues, n, n, "a", ("products",))
    plan = acts._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and f"Range (0, {n // 10}" in plan
    got = acts.where("action_type = 'diagnose'").orderBy("step").toPandas()
    want, step = [], n // 10 + 1
    for i in sorted(range(n), key=lambda i: (-(i % 7), i % 2, i)):
        if step + 1 <= n:
            want.append((step + 1, i))
        step += 1 + (i % 3 == 0)
    assert list(zip(got["step"], got[ROW], strict=True)) == want
    truth = issues.selectExpr(ROW, "column", "type", "fix as expected", "1 as ord").where(f"{ROW} % 2 = 0")
    out = audit.replay(acts, truth, n, n)
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    last = out.orderBy(F.desc("step")).first()
    assert last["step"] == n and last["done"] and out.count() == n
    assert last["found"] == sum(i % 2 == 0 for _, i in want) and last["false_positives"] == sum(i % 2 for _, i in want)
