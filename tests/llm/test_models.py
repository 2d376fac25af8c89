"""Toxicity and language models: held-out accuracy, brute-force counts, and defined cases."""

import math
import os
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import langid, toxicity

DIR = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@needs_tables
def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 500
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    wrong = sum(r["predicted"] != r["toxic"] for r in out)
    assert wrong <= 0.03 * len(out)


@needs_tables
def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = langid.identify(docs, langid.training_text(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)


def plain_running(text):
    return " " + "".join(f"{w} " for w in re.findall(r"[^\W\d_]+", text.lower()))


def brute_phrases(word, texts):
    n, i = 0, 0
    while i < len(word):
        j = i
        while j < len(word) and any(word[i : j + 1] in t for t in texts):
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def brute_predict(text, taught):
    """Language by the definition: phrases by substring search, in bits a letter."""
    if not any(map(str.isalpha, text or "")):
        return "und"
    rows = {n: [plain_running(t) for t in ts] for n, ts in taught.items()}
    return min(sorted(rows), key=lambda n: brute_phrases(plain_running(text), rows[n]) * math.log2(max(2, sum(map(len, rows[n])))))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc é", min_size=1, max_size=30).filter(str.strip), min_size=1, max_size=3), st.lists(st.text("abcdé Ö1.", min_size=1, max_size=40), min_size=1, max_size=6))
def test_phrases_equal_substring_search(taught, texts):
    m = langid.Model({"x": taught, "y": ["bca cab"]})
    found = sorted([t for t in texts if any(map(str.isalpha, t))], key=lambda t: -len(plain_running(t)))
    assert [len(langid.running(t)) for t in found] == [len(plain_running(t)) for t in found]
    if found:
        got = m.phrases([langid.running(t) for t in found])
        for row, rows in zip(got, (taught, ["bca cab"]), strict=True):
            assert row.tolist() == [brute_phrases(plain_running(t), [plain_running(x) for x in rows]) for t in found]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("the catsmle pi r", max_size=60), max_size=8))
def test_predictions_equal_brute_force(texts):
    taught = {"en": ["the cat sat on the mat", "this is it"], "fr": ["le chat est sur le tapis", "petit pas"], "de": ["die katze ist da"]}
    assert [p[0] for p in langid.Model(taught).predict([*texts, None])] == [brute_predict(t, taught) for t in [*texts, None]]


def test_groups_of_lanes_change_nothing(monkeypatch):
    m = langid.Model({"en": ["the cat sat on the mat"], "fr": ["le chat est sur le tapis"]})
    texts = ["the cat " * k + "le" for k in range(1, 30)] + [None, "tapis"]
    want = m.predict(texts)
    monkeypatch.setattr(langid, "LANES", 4)
    monkeypatch.setattr(langid, "LETTERS", 60)
    assert m.predict(texts) == want


def test_texts_without_letters_and_empty_models():
    m = langid.Model({"en": ["the cat sat on the mat"], "fr": ["le chat est sur le tapis"]})
    assert [p[0] for p in m.predict([None, "", "123 !!", "the mat", "le tapis", "the " * 50_000])] == ["und", "und", "und", "en", "fr", "en"]
    assert langid.Model({}).predict(["text"]) == [("und", 0.0)]


def test_toxicity_defined_cases():
    assert toxicity.fit([], []).score("x") < 0.01
    assert toxicity.fit(["a", "b"], [1, 1]).score(None) > 0.99
    m = toxicity.fit(["you idiot go"] * 20 + ["a fine day here"] * 20, [1] * 20 + [0] * 20)
    assert m.score("IDIOT!!") > 0.7 > m.score("a fine day") and 0 <= m.score(None) <= 1


def test_models_on_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string"
    empty = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "the cat", None, None, None, 0.5, "x"), (1, "the cat", None, None, None, 0.5, "x")], schema)
    assert toxicity.score_toxicity(odd, toxicity.train(odd, labels)).count() == 3
    assert [r["lang_pred"] for r in langid.identify(odd, langid.training_text(odd)).collect()] == ["und"] * 3
    assert langid.keep_determined(odd, {}).count() == 2


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 3)
    monkeypatch.setattr(langid, "ROW_CHARS", 10)
    rows = [(i, f"short {i % 10}", "en") for i in range(20)] + [(i, "x" * 50 + "middle" + "y" * 50, "de") for i in range(20)] + [(1, None, "en"), (2, "123", "en"), (3, "a", ""), (None, "null id", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_text(docs)
    assert sorted(got) == ["de", "en"] and all(len(t) <= 10 for ts in got.values() for t in ts)
    assert len(got["en"]) == len(got["de"]) == 3 and "middle" in got["de"][0]
    assert langid.training_text(docs.repartition(5)) == got


def test_toxicity_score_equals_brute_force():
    r = random.Random(4)
    vocab = ["idiot", "scum", "fool", "Fine", "day", "house", "tree", "garden", "fish,", "run"]
    texts = [" ".join(r.choices(vocab[:4] if i % 2 else vocab[3:], k=6)) for i in range(120)]
    m = toxicity.fit(texts, [i % 2 for i in range(120)])
    for t in [*texts[:20], "An IDIOT's day!", "", None]:
        words = re.sub(r"[^0-9a-z]+", " ", (t or "").lower()).split()
        grams = {f" {w} "[i : i + n] for w in words for n in toxicity.SIZES for i in range(len(w) + 3 - n)}
        z = m.intercept + sum(m.weights.get(g, 0.0) for g in grams)
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    ratio = {}
    for g in m.weights:
        has = lambda y, g=g: sum(g in toxicity.grams(toxicity.normal(t)) for i, t in enumerate(texts) if i % 2 == y)
        ratio[g] = math.log((has(1) + 1) / 62) - math.log((has(0) + 1) / 62)
    assert all(m.weights[g] * ratio[g] > 0 for g in m.weights)  # a feature speaks for the class whose log count ratio it has
