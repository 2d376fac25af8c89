"""Language identification by cross-parsing entropy.

Labelled text of each language feeds a suffix automaton. A text, as its running letters with single
blanks between words, is parsed from its first letter to its last into the longest phrases that
occur in a language's training text; few phrases mean a close match. Phrases run over word
boundaries. Their number is normalised by the bits that a phrase costs in that language (log2 of its
training length), and the language with the fewest normalised phrases a letter wins.

All texts of a batch are parsed in step, a letter at a time, against all languages at once: a step
is one lookup in the joined transition tables. A letter that can't continue a phrase ends it and is
read again from the start, which the table holds as one entry with a mark.

Training reads at most TRAIN_ROWS labelled rows of a language, those of least hashed id, first
among rows of at most ROW_CHARS characters, which teach whole; only a language with fewer such rows
learns from the middle ROW_CHARS characters of longer ones. These bounds are the only sample, and
are applied before anything reaches the driver. Every text is parsed whole.

Defined cases: texts that are null or hold no letter, and all texts if nothing is learned, give
'und' with score 0; very long texts are parsed whole, beside others of their length; ties go to the
alphabetically first language; a null or empty lang teaches nothing; repeated rows give one row
each; a null id is predicted with held_out null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow

TRAIN_ROWS, ROW_CHARS = 32, 1500
UNDETERMINED = "und"
#: Texts parsed in step, and letters held for them.
LANES, LETTERS = 1024, 1 << 22
_LETTER = re.compile(r"[^\W\d_]")


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    out[[m.start() for m in _LETTER.finditer("".join(map(chr, range(0x110000))))]] = True
    return out


def running(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, with one blank between words and at both ends."""
    if not text:
        return np.empty(0, np.uint32)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the place after a word is its blank
    keep[0] = True
    return np.where(letter, c, 32)[keep].astype(np.uint32)


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """The automata of all languages, in alphabetical order, as one table of transitions.

    An entry is four times the offset of the next state's row and the number of phrases that the
    letter ends: none if it continues the phrase; else the phrase before it, if any, and the letter
    itself if no phrase starts with it.
    """

    def __init__(self, texts: dict[str, list[str]]):
        rows = {n: [r for t in ts if len(r := running(t))] for n, ts in texts.items()}
        self.names = sorted(n for n, r in rows.items() if r)
        known = np.unique(np.concatenate([c for n in self.names for c in rows[n]])) if self.names else np.empty(0, np.int64)
        self.code = np.zeros(0x110000, np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        self.bits = np.array([math.log2(max(2, sum(map(len, rows[n])))) for n in self.names])
        width, tables, start = len(known) + 1, [], 0
        self.starts = np.zeros((len(self.names), 1), np.int64)
        for i, n in enumerate(self.names):
            # no phrase runs from row to row, as no text holds the letter between them
            step = suffix_automaton("".join(chr(0x10FFFF) + "".join(map(chr, r.tolist())) for r in rows[n]))
            table = np.zeros((len(step), width), np.int64)
            size = np.array([len(d) for d in step])
            codes = self.code[np.frombuffer("".join([c for d in step for c in d]).encode("utf-32-le", "surrogatepass"), "<u4")]
            table[np.repeat(np.arange(len(step)), size), codes] = [t for d in step for t in d.values()]
            del step
            table[:, 0] = 0
            again = np.broadcast_to(table[0], table.shape)
            ended = (again == 0) + (np.arange(len(table)) > 0)[:, None].astype(np.int64)
            table = np.where(table > 0, 4 * (table * width + start), 4 * (again * width + start) + ended)
            tables.append(table.ravel().astype(np.int32 if 4 * (start + table.size) < 1 << 31 else np.int64))
            self.starts[i] = start
            start += table.size
        self.table = np.concatenate(tables) if tables else None

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text, a row a language. Texts aren't empty and come longest first."""
        size = np.array([len(t) for t in texts])
        codes = self.code[np.concatenate(texts)]
        at, done = np.cumsum(size) - size, 0
        state = np.repeat(self.starts, len(texts), axis=1)
        count = np.zeros(state.shape, np.int64)
        for stop in np.unique(size).tolist():
            n = int(np.searchsorted(-size, -stop, "right"))
            place, here, ends = at[:n], state[:, :n], count[:, :n]
            for _ in range(stop - done):
                got = self.table.take(here + codes.take(place))
                ends += got & 3
                np.right_shift(got, 2, out=here)
                place += 1
            done = stop
        return count + (state != self.starts)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.names:
            return out
        found = [(i, r) for i, t in enumerate(texts) if len(r := running(t)) and any(map(str.isalpha, t))]
        found.sort(key=lambda x: -len(x[1]))
        while found:
            n, letters = 0, 0
            while n < min(LANES, len(found)) and (not n or letters + len(found[n][1]) <= LETTERS):
                letters += len(found[n][1])
                n += 1
            total = self.phrases([r for _, r in found[:n]])
            cost = total * self.bits[:, None] / np.array([len(r) for _, r in found[:n]])
            for (i, _), c in zip(found[:n], cost.T, strict=True):
                best = int(np.argmin(c))
                rest = np.delete(c, best)
                out[i] = self.names[best], min(1.0, 0.5 + (float(1 - c[best] / rest.min()) if len(rest) else 0.5))
            found = found[n:]
        return out


def held_out(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2


def training_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Up to TRAIN_ROWS texts a language, each of at most ROW_CHARS characters, outside the held-out quarter."""
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    known = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), lang.alias("lang")).where(~held_out(F.col("id")) & (F.col("lang") != "") & F.col("text").rlike(r"\p{L}"))
    known = known.select("id", "lang", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy(F.col("n") > ROW_CHARS, F.xxhash64("id"), "id", "h")
    chosen = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TRAIN_ROWS).select("id", "lang", "h", "rank").collect()
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "id long, lang string, h long, rank int")
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - ROW_CHARS) / 2).cast("int"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("h")).join(F.broadcast(ids), ["id", "lang", "h"]).groupBy("lang", "rank").agg(F.min(F.substring("text", middle, F.lit(ROW_CHARS))).alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, texts: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def rows(blocks):
        model = Model(shared.value)
        for block in blocks:
            got = model.predict(block["text"])
            yield {"doc_id": block["id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(docs, ["id", "text"], "doc_id long, lang_pred string, score double", rows, LANES)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_determined(docs: DataFrame, texts: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is undetermined; all columns stay. If nothing was
    learned, no text is rejected but those without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)

    def build():
        model = Model(shared.value)
        return lambda block: [p[0] != UNDETERMINED or (not model.names and any(map(str.isalpha, t or ""))) for p, t in zip(model.predict(block), block, strict=True)]

    return keep_rows(docs, text_col, build, LANES)
