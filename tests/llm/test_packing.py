"""Packing: ids equal the tokenizer's, sequences are gapless and few."""

import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "a", "word", "Été", "don't", "'s", "12", ",", "...", " ", "　", "漢字", "😀", "<|endoftext|>", "\x1c", "_", "ñ", "x.\nY", "\né", "é,", "б:", "\n\n", "½", "ª", "\u0301", "\u052f", "\u0531"]), max_size=12).map("".join))
def test_ids_equal_the_tokenizers(text):
    e = packing.encoder(packing.default_tokenizer())
    want = e.tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert np.frombuffer(e(text), "<u4").tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_is_gapless(sizes):
    s = np.array(sizes, np.int64)
    where, offset, used = packing.best_fit(s, 64)
    for b in range(len(used)):
        mine = sorted(zip(offset[where == b].tolist(), s[where == b].tolist(), strict=True))
        assert [o for o, _ in mine] == np.cumsum([0] + [n for _, n in mine])[:-1].tolist()
        assert sum(n for _, n in mine) == used[b] <= 64
    assert sum(u <= 32 for u in used.tolist()) <= 1


def test_pack_whole_tables(spark):
    rows = [(i, ("word " * (i * 37 % 3000)).strip() or None, "x") for i in range(120)] + [(7, "same", "x"), (7, "same", "x"), (None, "no id", "x"), (500, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string").repartition(7)
    out = packing.pack(docs).toPandas()
    e = packing.encoder(packing.default_tokenizer())
    assert out["length"].sum() == sum(len(e(t)) // 4 for _, t, _ in rows)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]]
        assert g["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 3
    long = out[out["doc_id"] == 81].sort_values("piece")
    ids = np.frombuffer(e(rows[81][1]), "<u4")
    assert (long["length"].iloc[1:] == 2048).all()
    assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(long["start"], long["length"], strict=True)] == long["ids_crc32"].tolist()


@pytest.mark.parametrize("partitions", [12, 70])
def test_pack_meets_in_one_root(spark, partitions):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(3 * partitions)], "doc_id long, text string").repartition(partitions)
    out = packing.pack(docs).toPandas()
    assert len(out) == 3 * partitions and out["sequence_id"].nunique() == 1
    out = out.sort_values("offset")
    assert out["offset"].tolist() == [0, *out["length"].cumsum()[:-1]]


def test_pack_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def global_fit(sizes):
    return len(packing.best_fit(np.array(sizes, np.int64))[2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_counted_fit_equals_one_by_one(sizes):
    used = []
    for n in sorted(sizes, reverse=True):
        fits = [u for u in used if u + n <= 64]
        if fits:
            used[used.index(max(fits))] += n
        else:
            used.append(n)
    assert sorted(packing.best_fit(np.array(sizes, np.int64), 64)[2].tolist()) == sorted(used)


@pytest.mark.parametrize("mix", ["halves", "thirds", "lognormal"])
def test_sorted_tables_pack_like_one_leaf(spark, mix):
    r = np.random.default_rng(2)
    n = 24_000
    words = {"halves": np.where(r.random(n) < 0.5, r.integers(900, 1700, n), r.integers(20, 500, n)), "thirds": r.choice([300, 700, 1200], n), "lognormal": np.minimum(2000, r.lognormal(5.5, 1, n).astype(int) + 1)}[mix]
    words.sort()
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "n": words})).selectExpr("doc_id", "repeat(' a', cast(n as int)) as text").repartitionByRange(16, "doc_id")
    out = packing.pack(docs, leaf_rows=1000).toPandas()
    assert out["length"].sum() == (words + 1).sum() and len(out) == n
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    places = out.sort_values(["sequence_id", "offset"])
    ends = places.groupby("sequence_id")["length"].cumsum()
    assert (places["offset"] == ends - places["length"]).all()
    assert out["sequence_id"].nunique() <= 1.01 * global_fit(words + 1)


def test_equal_lengths_are_no_task_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(' a', 699) as text").repartition(6)
    out = packing.pack(docs, leaf_rows=100).toPandas()
    assert len(out) == 4000 and out["sequence_id"].nunique() == 2000
    assert sorted(out["offset"]) == [0] * 2000 + [700] * 2000
