"""SentencePiece ids and decoding equal the library's."""

import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import spm

sentencepiece = pytest.importorskip("sentencepiece")


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([" ", "   ", "\n", "the", "The", "ing", "internationalisation", "Élan", "don't", "12", "...", "▁", "漢字", "😀", "<s>", "<0x0A>", "\x00", "zq", "ß"]), max_size=14).map("".join) | st.text("abcdefst hing", max_size=40))
def test_ids_and_text_equal_the_librarys(text):
    m = spm.model(spm.default_model())
    ids, normal = m.encode([text])
    got = np.frombuffer(ids[0], "<u4").tolist()
    assert got == m.lib.encode(text)
    assert m.decode(ids[0]) == m.lib.decode(got) == m.plain_text(normal[0])


def test_unigram_states_maximise_scores():
    m = spm.Model(spm.default_model())
    m.bpe, m.pieces = False, {"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -1.5), "abc": (3, -9.0), "c": (4, -1.0)}
    m.longest, m.floor, m.byte, m.unknown = 3, -20.0, None, 9
    m.data = {p: i.to_bytes(4, "little") for p, (i, _) in m.pieces.items()}
    known = m.learn({"abc", "ab", "abx", "ba"})
    assert {w: np.frombuffer(b, "<u4").tolist() for w, b in known.items()} == {"abc": [2, 4], "ab": [2], "abx": [2, 9], "ba": [1, 0]}


def test_tables(spark):
    rows = [(1, "hello  world", "x"), (1, "hello  world", "x"), (2, None, "x"), (3, "", "x"), (None, "z" * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = spm.digests(spm.encode_documents(docs)).collect()
    m = spm.model(spm.default_model())
    want = [np.array(m.lib.encode(t or ""), "<u4").tobytes() for _, t, _ in rows]
    assert sorted((r["n_tokens"], r["ids_crc32"], r["round_trip"]) for r in out) == sorted((len(w) // 4, zlib.crc32(w), True) for w in want)
    assert {r["text"] for r in spm.decode_documents(spm.encode_documents(docs)).collect()} == {"hello  world", "", "z" * 3000}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["▁", "▁▁", "the", "ing", "a", "e", "st", "Élan", "zz"]), max_size=30).map("".join))
def test_heap_merges_like_plain_bpe(word):
    m = spm.model(spm.default_model())
    old, spm.SHORT = spm.SHORT, len(word)
    plain, spm.SHORT = m.merge(word), old
    assert m._merge_long(word) == plain


def test_long_runs_of_blanks_are_quick():
    m = spm.Model(spm.default_model())
    text = "a" + " " * 200_000 + "b"
    began = time.process_time()
    (ids,), _ = m.encode([text])
    assert time.process_time() - began < 4
    small = "a" + " " * 2000 + "b"
    assert np.frombuffer(m.encode([small])[0][0], "<u4").tolist() == m.lib.encode(small)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spm.digests(spm.encode_documents(empty)).count() == spm.decode_documents(spm.encode_documents(empty)).count() == 0
