"""The commands' exit codes, the reports, and agents without knowledge."""

import json

from pyspark.sql import functions as F

from lodestone import __main__ as cli
from lodestone.operators import audit, detect, generate, report
from lodestone.sources import tables

CSV = "code,name,amount\nA,Alpha,100\nA,Alpha,105\nA,Beta,98\nB,Gamma,1020\nB,Gamma,103\n"


def test_profile_repair_and_revert(spark, tmp_path, capsys):
    p, s = tmp_path / "t.csv", tmp_path / "s.yaml"
    p.write_text(CSV)
    s.write_text("columns: {amount: float}\nfunctional_dependencies: [{determinant: [code], dependent: name}]\ndomain_bounds: {amount: {min: 0, max: 5000}}\n")
    assert cli.main(["profile", str(p)]) == 0
    assert cli.main(["profile", str(p), "--schema", str(s)]) == 1
    assert cli.main(["repair", str(p)]) == 2
    assert cli.main(["repair", str(p), "--schema", str(s), "--apply"]) == 0
    assert p.read_text() == CSV.replace("Beta", "Alpha").replace("1020", "102")
    txn = capsys.readouterr().out.split()[-1]
    assert cli.main(["revert", txn, "--root", str(tmp_path)]) == 0
    assert p.read_text() == CSV
    assert cli.main(["revert", txn, "--root", str(tmp_path)]) == 2
    assert cli.main(["profile", str(tmp_path / "none.csv")]) == 2


def test_pii_is_denied(spark, tmp_path):
    p, s = tmp_path / "t.csv", tmp_path / "s.yaml"
    p.write_text("id,phone\n1,5550101\n2,5550102\n3,not available\n4,5550104\n")
    s.write_text("pii_columns: [phone]\n")
    assert cli.main(["repair", str(p), "--schema", str(s), "--dry-run"]) == 1
    assert cli.main(["repair", str(p), "--schema", str(s), "--dry-run", "--allow-pii", "--confirm-pii"]) == 0


def test_json_contract(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("v\n1\n2\nx\n3\n4\ny\n5\n6\n")
    got = [json.loads(r["json"]) for r in report.issues_json(detect.detect_all(tables.read_csv(spark, str(p)))).collect()]
    assert got == [{"column": "v", "issue_type": "type_mismatch", "severity": "REVIEW", "row_indices": [2, 5], "count": 2}]


def test_agents_without_knowledge_score_low(spark):
    dirty, planted = generate.episode_table(spark, "task_1_format_fixer")
    truth = planted.select("_row", "column", "type", "expected", "ord")
    actions = audit.random_actions(spark, 3, 12, dirty.count(), ["name", "email", "phone"], generate.ISSUE_TYPES)
    out = audit.replay(actions, truth, dirty.count(), 30)
    last = out.groupBy("episode").agg(F.max_by("cumulative", "step").alias("s")).collect()
    assert len(last) == 3 and all(0.0001 <= r["s"] < 0.5 for r in last)
    assert report.session_lines(out, "t").first()["line"].startswith("[STEP] task=t step=1")
    seen = spark.createDataFrame([(0,), (2,)], "_row bigint")
    assert [r["_row"] for r in audit.next_uninspected(dirty, seen, 3).collect()] == [1, 3, 4]
    assert audit.fallback_action(60, 65, "task_3_integrity_auditor", True, True) == "finalize"
