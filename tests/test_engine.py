"""Detectors, repairs, verification and scores on the documented small cases."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.schema import DomainBound, FunctionalDependency, Schema, schema_from_mapping
from lodestone.functions.text import general, half_even, similarity, strip, to_double
from lodestone.operators import apply, audit, bench, detect, generate, policy, repair, rules, score, verify
from lodestone.sources import journal, tables

ROW = detect.ROW

HOSPITAL = [
    ("1", "General Hospital", "217-555-0101", "4.5"), ("2", "Mercy", "217-555-0102", "4.1"), ("1", "Springfield Medical", "217-555-0103", "3.9"), ("3", "Lakeside", "217-555-0104", "4.4"),
    ("4", "Hill", "not available", "4.2"), ("5", "Bay", "217-555-0106", "45.0"), ("6", "Elm", "217-555-0107", "4.0"), ("7", "Oak", "217-555-0108", "4.3"),
]
FD = Schema(dependencies=(FunctionalDependency(("id",), "name"),))


def frame(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} bigint, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def hospital(spark):
    return frame(spark, HOSPITAL, ["id", "name", "phone", "rating"]).select(ROW, "id", "name", F.regexp_replace("phone", "^217-", "").alias("phone"), "rating")


def test_detect_all_orders_unsafe_first(spark, hospital):
    got = [(r[ROW], r["column"], r["issue_type"], r["severity"], r["expected"]) for r in detect.sort_issues(detect.detect_all(hospital, FD)).collect()]
    assert got[:2] == [(0, "name", "fd_violation", "UNSAFE", None), (2, "name", "fd_violation", "UNSAFE", None)]
    assert (5, "rating", "decimal_shift", "REVIEW", "4.5") in got


def test_fd_reason_lists_values_in_first_seen_order(spark, hospital):
    reason = detect.detect_fd_violation(hospital, FD).where(f"{ROW} = 2").first()["reason"]
    assert reason == "Functional dependency ('id',) -> name violated: id='1' maps to multiple values: {'General Hospital', 'Springfield Medical'}"


def test_type_mismatch_and_sentinel_repair(spark):
    t = frame(spark, [("1",), ("2",), ("3",), ("N/A",), ("4",), ("",)], ["v"])
    i = detect.detect_type_mismatch(t)
    r = i.collect()
    assert [(x[ROW], x["confidence"], x["reason"]) for x in r] == [(3, 0.88, "Value 'N/A' is non-numeric in predominantly numeric column 'v'")]
    assert [(x["old_value"], x["new_value"]) for x in repair.repair_type_mismatch(i, t).collect()] == [("N/A", "")]


def test_mixed_columns_and_small_ones_stay_silent(spark):
    assert detect.detect_type_mismatch(frame(spark, [("1",), ("a",)], ["v"])).count() == 0
    assert detect.detect_decimal_shift(frame(spark, [("1",), ("10",), ("1",), ("1",)], ["v"])).count() == 0
    assert detect.detect_decimal_shift(frame(spark, [("1",), ("nan",), ("1",), ("10",), ("1",), ("1",)], ["v"])).count() == 0


def test_decimal_shift_reason_and_expected(spark):
    t = frame(spark, [(v,) for v in ("100", "105", "98", "1020", "103", "0.99")], ["amount"])
    got = {r[ROW]: (r["expected"], r["reason"]) for r in detect.detect_decimal_shift(t).collect()}
    assert got[3] == ("102", "Value 1020 in column 'amount' appears to be ~10x the typical value (median ~101.5)")
    assert got[5] == ("99", "Value 0.99 in column 'amount' appears to be ~100x too small compared to the typical value (median ~101.5)")


def test_python_exact_text_functions(spark):
    t = spark.createDataFrame([(1234567.0, 0.845, "  12\n", "1_000"), (102.0, 0.785, "x\x1c", "1d"), (1e-5, 0.825, " ", "nan")], "v double, r double, s string, n string")
    got = t.select(general("v").alias("g"), half_even("r", F.lit(2)).alias("r"), strip(F.col("s")).alias("s"), to_double(F.col("n")).alias("n")).collect()
    assert [x["g"] for x in got] == [f"{v:g}" for v in (1234567.0, 102.0, 1e-5)]
    assert [x["r"] for x in got] == [round(v, 2) for v in (0.845, 0.785, 0.825)]
    assert [x["s"] for x in got] == ["12", "x", ""]
    assert got[0]["n"] == 1000.0 and got[1]["n"] is None and got[2]["n"] != got[2]["n"]
    assert spark.range(1).select(similarity(F.lit("electronics"), F.lit("electronic")).alias("s")).first()["s"] > 0.9


def test_pii_rows_and_aggregates_are_guarded(spark):
    fixes = spark.createDataFrame([(0, "phone", "a", "b", "update"), (1, "amount", "a", "b", "update"), (2, "x", "a", "b", "delete_row"), (3, "x", "a", "b", "update")], f"{ROW} bigint, column string, old_value string, new_value string, operation string")
    schema = schema_from_mapping({"pii_columns": ["phone"], "aggregate_dependencies": [{"source_column": "amount", "target_column": "total", "aggregate": "sum"}, {"source_column": "x", "target_column": "y", "aggregate": "max"}]})
    verdicts = lambda c: [r["verdict"] for r in policy.evaluate(fixes, schema, c).orderBy(ROW).collect()]
    assert verdicts(None) == ["DENY", "ESCALATE", "DENY", "ALLOW"]
    assert verdicts(policy.Context(allow_pii=True)) == ["ESCALATE", "ESCALATE", "DENY", "ALLOW"]
    assert verdicts(policy.Context(True, True, True)) == ["ALLOW", "ALLOW", "DENY", "ALLOW"]
    assert policy.evaluate_batch(fixes)[0] == "ALLOW"
    assert policy.evaluate_batch(fixes.unionAll(fixes.withColumn("new_value", F.lit("c")))) == ("DENY", "NO_CONFLICTING_CELL_WRITES")
    with pytest.raises(policy.PolicyError):
        policy.compile_policy({"hard_never": [{"id": "X", "description": "x", "predicate": "os.system"}]})


def test_verifier_verdicts(spark):
    t = frame(spark, [("A", "Alpha", "5"), ("A", "Alpha", "6"), ("A", "Beta", "7"), ("B", "Gamma", "8")], ["code", "name", "n"])
    schema = Schema(columns={"n": "int"}, dependencies=(FunctionalDependency(("code",), "name"),), bounds=(DomainBound("n", 0, 10),))
    cand = [(2, "name", "Beta", "Alpha"), (3, "name", "Gamma", "X"), (0, "name", "Alpha", "Y"), (3, "n", "8", "11"), (3, "n", "8", ""), (9, "n", "1", "2"), (3, "code", "B", "A")]
    fixes = spark.createDataFrame([(*c, "update") for c in cand], f"{ROW} bigint, column string, old_value string, new_value string, operation string")
    got = {(r[ROW], r["new_value"]): (r["verification"], r["unsat_core"]) for r in verify.verify(t, fixes, schema).collect()}
    assert got[2, "Alpha"] == ("ACCEPT", []) and got[3, "X"] == ("ACCEPT", [])
    assert got[0, "Y"] == ("REJECT", ["fd::code::name::row::0"])
    assert got[3, "11"] == ("REJECT", ["domain::n::max::row::3"])
    assert got[3, ""][0] == "UNKNOWN" and got[9, "2"] == ("REJECT", [])
    assert got[3, "A"] == ("REJECT", ["fd::code::name::row::3"])


def test_repair_applies_only_what_passes(spark):
    t = frame(spark, [("A", "Alpha"), ("A", "Alpha"), ("A", "Beta"), ("B", "X"), ("B", "Y"), ("C", "P"), ("C", "P"), ("C", "P"), ("C", "Q"), ("C", "R")], ["code", "name"])
    schema = Schema(dependencies=(FunctionalDependency(("code",), "name"),))
    after, fixes = apply.repair(t, schema)
    assert [(r[ROW], r["new_value"]) for r in fixes.collect()] == [(2, "Alpha")]
    assert {r[ROW]: r["name"] for r in after.collect()}[2] == "Alpha"
    status = {(r[ROW]): r["status"] for r in apply.attempts(t, detect.detect_all(t, schema), schema).collect()}
    assert status[8] == "rejected" and status[3] == "attempts_not_fixed"


def test_scores(spark):
    truth = spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "a", "z")], f"{ROW} bigint, column string, clean_value string")
    pred = spark.createDataFrame([(0, "a", "x"), (1, "a", "bad"), (9, "a", "q")], f"{ROW} bigint, column string, new_value string")
    r = score.rates(score.counted(truth, pred)).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 2, 2, 0.3333, 0.3333, 0.3333)
    with pytest.raises(ValueError):
        score.estimated_calls(["llm_react"], [1000, 2376, 2410], 9)


def test_a_session_that_knows_the_truth_scores_highest(spark):
    dirty, planted = generate.episode_table(spark, "task_3_integrity_auditor")
    truth = planted.select(ROW, "column", "type", "expected")
    truth = truth.withColumn("ord", F.row_number().over(Window.orderBy(ROW, "column")) - 1)
    actions = audit.informed_actions(truth)
    last = actions.agg(F.max("step") + 1).first()[0]
    end = spark.createDataFrame([(0, last, "finalize", None, None, None, None, None, None)], ", ".join(f"`{c}` {t}" for c, t in actions.dtypes))
    out = audit.replay(actions.unionAll(end), truth, dirty.count(), 500).orderBy("step").collect()
    assert out[-1]["cumulative"] == 0.9999 and out[-1]["done"]
    assert out[-1]["false_positives"] == 0
    assert generate.truth_faults(truth, dirty, dirty.columns).count() == 0


def test_session_penalties():
    s = audit.Session([{"row": 0, "column": "a", "type": "t", "expected": "10"}, {"row": 1, "column": "_row", "type": "duplicate", "expected": "DELETE_ROW"}], 10, 30)
    act = lambda **a: s.act(a)[:2]
    assert act(action_type="diagnose", row=5, column="a") == ("incorrect", 0.0001)
    assert act(action_type="diagnose", row=0, column="a", issue_type="t") == ("correct", pytest.approx(0.15))
    assert act(action_type="diagnose", row=0, column="a") == ("already_found", 0.0001)
    assert act(action_type="fix", row=0, column="a", new_value="10.05") == ("partial", pytest.approx(0.075))
    assert act(action_type="fix", row=1, column="x", new_value="v") == ("incorrect", 0.0001)
    assert act(action_type="fix", row=1, column="x", fix_type="delete_row", justification="copy") == ("correct", pytest.approx(0.20))
    assert act(action_type="inspect", rows=[2, 3]) == ("initial", pytest.approx(0.008))
    assert s.score() == 0.95


def test_generated_errors_are_found(spark):
    dirty, planted = generate.episode_table(spark, "task_3_integrity_auditor", 7)
    assert dirty.count() == 250
    found = rules.broken(dirty, rules.cross_field_checks() + rules.business_checks(rules.BusinessRules(50, 1, 100, 0.01, (2020, 2024))))
    hit = planted.where("type in ('cross_field', 'business_rule', 'referential_integrity') and column <> 'product_category'").select(ROW).distinct()
    assert hit.join(found.select(ROW).distinct(), ROW, "left_anti").count() == 0
    assert {r["type"]: r["total"] for r in generate.truth_census(planted).collect()}["cross_field"] >= 15


def test_duplicates_near_entities_and_people(spark):
    t = frame(spark, [("Ann Lee", "a@x.org", "1-2"), ("Lee Ann", "b@x.org", "99"), ("Bob", "A@x.org", "12"), ("Bob", None, "7")], ["name", "email", "phone"])
    assert {(r["a"], r["b"], r["why"]) for r in rules.same_person(t, "name", "email", "phone").collect()} == {(0, 1, "name"), (0, 2, "email"), (0, 2, "phone"), (2, 3, "name")}
    assert [(r[ROW], r["dup_of"]) for r in rules.duplicates(t, ["name"]).collect()] == [(3, 2)]


def test_csv_keeps_strings(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b\n01,"x, ""y""\nz"\n,  pad \n')
    t = tables.read_csv(spark, str(p))
    assert [(r[ROW], r["a"], r["b"]) for r in t.orderBy(ROW).collect()] == [(0, "01", 'x, "y"\nz'), (1, "", "  pad ")]
    assert tables.read_csv_bytes(spark, p.read_bytes()).count() == 2


def test_envelope_keeps_json_types(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps({"_meta": {}, "schema": {"q": "integer"}, "rows": [{"q": 5}, {"q": "5"}, {"q": None}]}))
    t, types, _ = tables.read_envelope(spark, str(p))
    got = rules.broken(t, rules.format_checks(types, {"q": F.col("q__type")})).collect()
    assert [r[ROW] for r in got] == [1]


def test_numbering_is_dense_over_partitions(spark):
    t = tables.numbered(spark.range(1000).repartition(7).select("id"))
    assert sorted(r[ROW] for r in t.collect()) == list(range(1000))


def test_journal_refuses_stale_fixes_and_changed_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,v\n1,a\n2,b\n")
    with pytest.raises(journal.JournalError):
        journal.apply(spark, str(p), [journal.CellFix(0, "v", "zzz", "c", "x")])
    txn = journal.apply(spark, str(p), [journal.CellFix(0, "v", "a", "c", "x")])
    assert p.read_text() == "id,v\n1,c\n2,b\n"
    p.write_text("id,v\n9,9\n")
    with pytest.raises(journal.JournalError):
        journal.revert(txn.txn_id, tmp_path)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=st.lists(st.text(st.characters(codec="utf-8", exclude_characters='\r\n"\x00', exclude_categories=("Cs", "Cc", "Zl", "Zp")), max_size=8), min_size=2, max_size=5), new=st.sampled_from(["", "x", "é,1"]))
def test_revert_restores_bytes(spark, tmp_path_factory, cells, new):
    p = tmp_path_factory.mktemp("j") / "t.csv"
    p.write_text("id,v\r\n" + "".join(f'{i},"{c}"\r\n' for i, c in enumerate(cells)), newline="")
    before = p.read_bytes()
    txn = journal.apply(spark, str(p), [journal.CellFix(0, "v", cells[0], new, "x")])
    assert journal.load(journal.find(txn.txn_id, p.parent)).applied
    assert journal.revert(txn.txn_id, p.parent).reverted_at
    assert p.read_bytes() == before


def test_bench_skips_methods_without_provider(spark):
    clean = frame(spark, [(str(100 + i),) for i in range(12)], ["v"])
    dirty = clean.withColumn("v", F.when(F.col(ROW) == 3, "1030").otherwise(F.col("v")))
    records = bench.run(spark, {"tiny": (dirty, score.cell_diff(dirty, clean))}, ["heuristic", "random", "llm_react"], 2)
    got = {r["method"]: r for r in score.aggregate_runs(records).collect()}
    assert got["heuristic"]["f1_mean"] == 1.0 and got["llm_react"]["status"] == "skipped"
    text = bench.replace_block("# R\n", bench.markdown(records))
    assert bench.replace_block(text, bench.markdown(records)).count(bench.BEGIN) == 1


def test_stream_of_rules(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(0, "bad mail"), (1, "a@b.co")], f"{ROW} bigint, email string").write.parquet(str(src))
    from lodestone.streaming.rules import broken_in_stream

    rows = spark.readStream.schema(f"{ROW} bigint, email string").parquet(str(src))
    q = broken_in_stream(rows, rules.format_checks({"email": "string"})).writeStream.format("memory").queryName("issues").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("issues").count() == 1
