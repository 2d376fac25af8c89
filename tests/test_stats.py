"""Exact medians and means against plain Python, also where bounds must be narrowed or taken back."""

import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.operators import audit, detect, rules

ROW = detect.ROW


@pytest.mark.parametrize("listed", [100_000, 50])
def test_medians_are_exact(spark, monkeypatch, listed):
    monkeypatch.setattr(stats, "MOST_LISTED", listed)
    r = np.random.default_rng(5)
    columns = {"normal": r.normal(size=5001).tolist(), "even": r.integers(0, 10**9, 5000).tolist(), "equal": [3.5] * 4000 + [9.0] * 1001, "few": [1.0, 2.0, 8.0, 9.0], "one": [7.0], "none": [], "ends": [0.0] * 2000 + [1.0] * 2000}
    rows = [(c, float(v)) for c, vs in columns.items() for v in vs]
    df = spark.createDataFrame(rows, "c string, v double").repartition(4)
    got = stats.exact_medians(df, {c: F.when(F.col("c") == c, F.col("v")) for c in columns})
    want = {c: statistics.median(v) if v else None for c, v in columns.items()}
    assert got == want
    value = {c: F.when(F.col("c") == c, F.col("v")) for c in columns}
    sketch = df.agg(*(stats.sketched_middle(v).alias(c) for c, v in value.items())).first()
    known = {c: (len(v), *sketch[c]) for c, v in columns.items() if v}
    assert stats.exact_medians(df, value, known) == want
    wrong = {c: (n, low - 1000, low - 500) for c, (n, low, _) in known.items()}
    assert stats.medians_within(df, value, wrong) == {} and stats.exact_medians(df, value, wrong) == want


def test_means_do_not_depend_on_order(spark):
    values = [0.49, 0.4925] * 400 + [0.01 * (i % 100) for i in range(1000)]
    exact = sum(Fraction(str(round(v, 4))) for v in values) / len(values)
    want = float(int(exact * 10_000 + Fraction(1, 2))) / 10_000
    for n in (1, 3, 7):
        df = spark.createDataFrame([(float(round(v, 4)),) for v in values], "v double").repartition(n)
        assert df.agg(stats.exact_mean(F.col("v")).alias("m")).first()["m"] == want
    odd = spark.createDataFrame([(float("inf"),), (1.0,), (None,)], "v double")
    assert odd.agg(stats.exact_mean(F.col("v")).alias("m")).first()["m"] == float("inf")
    assert odd.where("v is null").agg(stats.exact_mean(F.col("v")).alias("m")).first()["m"] is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_entities_are_all_pairs_of_few_edits(spark):
    r = np.random.default_rng(7)
    words = {"", "a", "ab", "abc"} | {"".join(r.choice(list("abcd"), int(r.integers(1, 9)))) for _ in range(150)}
    texts = sorted(words) + ["abc", "dcba"]
    got = {(x["a"], x["b"]): x["distance"] for x in rules.similar_entities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], f"{ROW} bigint, t string"), "t").collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want = {(min(i, j), max(i, j)): d for a, i in first.items() for b, j in first.items() if i < j and 1 <= (d := edits(a, b)) <= 2}
    assert got == want


@pytest.mark.parametrize("parts", [1, 5])
def test_floored_walks(spark, parts):
    r = np.random.default_rng(parts)
    rows = [(int(k), i, float(round(d, 3))) for i, (k, d) in enumerate(zip(r.choice([0, 0, 0, 1, 2], 600), r.normal(-0.05, 1, 600), strict=True))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, "k long, o long, d double").repartition(3)
    want = {}
    for k, _, d in rows:
        want[k] = max(audit.LEAST_SCORE, want.get(k, audit.LEAST_SCORE) + d)
    for f in (audit.floored_totals, audit.floored_totals_closed):
        got = {x["k"]: x["total"] for x in f(df, "k", "o", "d").collect()}
        assert got == pytest.approx(want)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_dependencies_without_lists(spark):
    rows = [(0, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", None), (5, "c", "p"), (6, "c", "q")]
    df = spark.createDataFrame(rows, f"{ROW} bigint, code string, name string")
    from lodestone.functions.schema import FunctionalDependency, Schema

    schema = Schema(dependencies=(FunctionalDependency(("code",), "name"),))
    short = detect.detect_fd_violation(df, schema, listed=False)
    assert {(r[ROW], r["reason"].rsplit(" maps", 1)[1]) for r in short.collect()} == {(i, " to 2 values") for i in (0, 1, 2, 4, 5, 6)}
    report = {(r["k0"], r["value"], r["first"], r["rows"]) for r in detect.dependency_report(df, ("code",), "name").collect()}
    assert report == {("a", "x", 0, 2), ("a", "y", 2, 1), ("c", "p", 5, 1), ("c", "q", 6, 1)}
