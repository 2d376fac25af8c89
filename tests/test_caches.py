"""Read-through caches, seeded samples, and confirmation of escalated fixes."""

import json

import pytest

from lodestone import __main__ as cli
from lodestone.operators import detect, profile
from lodestone.sources import cache


def test_pairs_are_fetched_once_and_whole(spark, tmp_path):
    asked = []

    def fetch(name, part):
        asked.append((name, part))
        return b"a,b\n1,x\n2,y\n" if part == "clean" else b"a,b\n1,x\n2,z\n"

    with pytest.raises(FileNotFoundError, match="dirty.csv and clean.csv"):
        cache.cached_pair(spark, "tiny", str(tmp_path))
    for _ in range(2):
        _, _, truth = cache.cached_pair(spark, "tiny", str(tmp_path), fetch)
        assert [(r["_row"], r["column"], r["dirty_value"], r["clean_value"]) for r in truth.collect()] == [(1, "b", "z", "y")]
    assert asked == [("tiny", "dirty"), ("tiny", "clean")]

    def broken(name, part):
        if part == "clean":
            raise OSError("no network")
        return b"a\n1\n"

    with pytest.raises(OSError):
        cache.cached_pair(spark, "half", str(tmp_path), broken)
    assert not (tmp_path / "half").exists()


def test_answers_are_kept_by_prompt_and_model(tmp_path):
    one, other = cache.AnswerCache(str(tmp_path), "vendor/model"), cache.AnswerCache(str(tmp_path), "b")
    assert one.resolve("p") is None
    assert one.resolve("p", lambda p: "not json") is None and one.get("p") is None
    assert one.resolve("p", lambda p: json.dumps({"chosen_value": 5})) == ("5", "llm_live")
    assert one.resolve("p", lambda p: "unused") == ("5", "llm_cache") and other.get("p") is None
    kept = json.loads(one.path("p").read_text())
    assert kept["model"] == "vendor/model" and "/" not in one.path("p").name and kept["chosen_value"] == "5"
    one.path("p").write_text("{")
    assert one.get("p") is None


def test_seeded_samples_repeat(spark):
    t = spark.range(500).withColumnRenamed("id", detect.ROW)
    rows = lambda df, seed: [r[detect.ROW] for r in profile.seeded_sample(df, 10, seed).collect()]
    first = rows(t, 1)
    assert len(first) == 10 and first == sorted(first) == rows(t.repartition(7), 1) != rows(t, 2)
    assert rows(t.limit(4), 1) == [0, 1, 2, 3]


@pytest.mark.parametrize("answer,code,text", [("y", 0, "3,\n"), ("", 1, "3,not available\n")])
def test_escalated_fixes_are_confirmed_one_by_one(spark, tmp_path, monkeypatch, answer, code, text):
    p, s = tmp_path / "t.csv", tmp_path / "s.yaml"
    p.write_text("id,phone\n1,5550101\n2,5550102\n3,not available\n4,5550104\n")
    s.write_text("pii_columns: [phone]\n")
    asked = []
    monkeypatch.setattr("builtins.input", lambda said: asked.append(said) or answer)
    assert cli.main(["repair", str(p), "--schema", str(s), "--apply", "--allow-pii", "--interactive"]) == code
    assert len(asked) == 1 and "NO_PII_OVERWRITE" in asked[0] and text in p.read_text()
