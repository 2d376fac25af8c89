"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, ASCII punctuation splits it into words, and its features are the distinct
n-grams of its words with their boundaries marked. Each feature is scaled by its smoothed
log-count ratio between the classes; logistic regression with an L2 penalty learns a weight for
every scaled feature. Features are kept if enough training rows hold them and their ratio is
large and several standard errors from none, so noise of long texts doesn't add up. The kept
n-grams form one Aho-Corasick automaton, which reads each text once.

Training reads at most PER_CLASS rows of each label, those of least hashed id, and TRAIN_CHARS
characters of each: these bounds are the only sample, and apply before texts reach the driver;
scoring reads every whole text.

Defined cases: null or empty texts have no features and get the score of the intercept; very long
texts are scored whole; without rows of both labels every score is the share of label 1 (0 without
labels); labels other than 0 and 1 are ignored; of repeated label rows the largest counts, of
repeated documents the first text in their order; a score at the threshold (a tie) is rejected;
rows with a null id are scored and held_out is null there; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow

PER_CLASS, TRAIN_CHARS = 1500, 20_000
SIZES = (3, 4, 5, 6)
MIN_ROWS, MIN_RATIO, MIN_SIGMA, SMOOTH, L2, STEPS = 4, 1.5, 1.5, 1.0, 0.02, 300
REJECT = 0.7

_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> str:
    """Lower case, ASCII punctuation and white space as single spaces, which mark word boundaries."""
    if not text:
        return ""
    return f" {b' '.join(text.lower().encode('utf-8', 'surrogatepass').translate(_SPLIT).split()).decode('utf-8', 'surrogatepass')} "


def grams(text: str) -> set[str]:
    """Distinct n-grams of a normal text that don't cross a word boundary."""
    out: set[str] = set()
    for word in set(text.split()):
        w = f" {word} "
        out.update([w[i : i + n] for n in SIZES for i in range(len(w) - n + 1)])
    return out


class Model:
    """Weight of each kept n-gram (ratio times coefficient), and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.finder = matcher(weights)

    def score(self, text: str | None) -> float:
        z = self.intercept + math.fsum(self.weights[g] for g in found(self.finder, normal(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def matcher(names) -> ahocorasick.Automaton | None:
    """Finds every occurrence of every name in one pass."""
    out = ahocorasick.Automaton()
    for g in names:
        out.add_word(g, g)
    if not len(out):
        return None
    out.make_automaton()
    return out


def found(finder: ahocorasick.Automaton | None, text: str) -> set[str]:
    return {g for _, g in finder.iter(text)} if finder and text else set()


def fit(texts: list[str | None], labels: list[int]) -> Model:
    y = np.array(labels, float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, math.log((share + 1e-9) / (1 - share + 1e-9)))
    texts = [normal(t) for t in texts]
    count = (Counter(), Counter())
    for t, label in zip(texts, labels, strict=True):
        count[label].update(grams(t))
    ratio = {}
    for g in count[0].keys() | count[1].keys():
        c1, c0 = count[1][g], count[0][g]
        if c1 + c0 >= MIN_ROWS:
            r = math.log((c1 + SMOOTH) / (n1 + 2 * SMOOTH)) - math.log((c0 + SMOOTH) / (n0 + 2 * SMOOTH))
            if abs(r) >= MIN_RATIO and abs(r) >= MIN_SIGMA * math.sqrt(1 / (c1 + SMOOTH) + 1 / (c0 + SMOOTH)):
                ratio[g] = r
    del count
    names = sorted(ratio)
    index, finder = {g: i for i, g in enumerate(names)}, matcher(names)
    r = np.array([ratio[g] for g in names])
    at = [np.array(sorted(index[g] for g in found(finder, t)), np.int64) for t in texts]
    cols = np.concatenate(at)
    doc = np.repeat(np.arange(len(at)), [len(a) for a in at])
    x = r[cols]
    share = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(doc, x * w[cols], len(at))
        err = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.append(np.bincount(cols, x * err[doc], len(names)) + L2 * w / max(1, len(names)) ** 0.5, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model({g: float(w[i] * r[i]) for g, i in index.items() if abs(w[i] * r[i]) > 1e-6}, float(b))


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most PER_CLASS rows of each label outside the held-out third."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out(F.col("id")) & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    spark = docs.sparkSession
    least = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS)
    chosen = spark.createDataFrame([tuple(r) for r in least(0).collect() + least(1).collect()], "id long, y int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.substring(F.col(text_col).cast("string"), 1, TRAIN_CHARS).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["id"])
    return fit([r["text"] for r in rows], [r["y"] for r in rows])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def rows(blocks):
        local = Model(*shared.value)
        for block in blocks:
            scores = [local.score(t) for t in block["text"]]
            yield {"doc_id": block["id"], "score": scores, "predicted": [int(s >= REJECT) for s in scores]}

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(docs, ["id", "text"], "doc_id long, score double, predicted int", rows)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def build():
        local = Model(*shared.value)
        return lambda texts: [local.score(t) < REJECT for t in texts]

    return keep_rows(docs, text_col, build)
