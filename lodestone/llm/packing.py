"""Best-fit packing of tokenized documents into fixed-length sequences.

Hierarchical residual packing. Documents are tokenized and cut where they lie; their pieces (a few
numbers each) are dealt evenly over leaves, so a table sorted by length or source packs like a mixed
one. Each leaf packs its pieces best-fit decreasing and emits the bins that are nearly full. All its
other bins go up a tree as items: FAN_IN neighbours' bins meet and are packed again, best-fit
decreasing, nearly full bins are emitted, and so on up to one root.

Items of one length are interchangeable, so a node of the tree sees only how many bins of each
length its children hand up, at most ``capacity`` numbers a child, whatever the table's size, and
packs equal ones together. It puts out ranges: the bins number lo to hi of a child and length go to
the sequences from a number on, at an offset. A bin that moves takes its pieces along. Ranges and
bins meet in blocks of BLOCK numbers, so no length, however common, is one task's.

A document's ids are those of the tokenizer file with special strings read as ordinary text,
then END. Documents longer than a sequence are cut into full pieces, of which only the first may
be shorter; pieces of full length are sequences of their own.

Words are tokenized once and cached: byte-level BPE never merges over a boundary of its
pre-tokenizer, and a space before a non-space character always is one. The caches end with their
task.

Defined cases: null and empty texts are one piece holding END alone; very long texts are read whole
and give as many pieces as they need; pieces of equal length are ties, which are numbered in the
order of their leaf, so any of them may be the one that moves; repeated rows are packed each for
itself; a null id is packed with its id null; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import sys
import zlib
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, settle, staged

CAPACITY, END = 2048, 0
NEARLY_FULL, FAN_IN = 8, 8
#: Pieces of a leaf, and bins of a block of ranges.
LEAF_ROWS, BLOCK = 400_000, 4096
CACHE_PARTS, CACHE_WORDS = 500_000, 100_000
#: White space next to a split, which the plain split would cut differently.
_TIGHT = re.compile(r"\s \s|\s \Z")
_SAFE = re.compile(r" (?=\S)")
#: From here on classes of letters depend on the Unicode version.
UNSURE = "\u0530"


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.tokenize, self.parts, self.word_ids = self.tokenizer.model.tokenize, Recent(CACHE_PARTS, self._part), Recent(CACHE_WORDS, self._ids)
        self.close, self.line = {c: self._ids(c) for c in ".,;:!?"}, self._ids("\n")

    def _ids(self, word: str) -> bytes:
        """Ids of a word that the pre-tokenizer leaves whole."""
        shown = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return _bytes([t.id for t in self.tokenize(shown)])

    def _text(self, text: str) -> bytes:
        if not text.isascii() and max(text) >= UNSURE:
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(text)))

    def _part(self, part: str) -> bytes:
        """Ids of a space and ``part``: one word, a word and a mark, two lines' ends, or whatever the pattern finds."""
        if "\n" in part:
            head, _, tail = part.partition("\n")
            if head and tail and not head[-1].isspace() and not tail[0].isspace():
                return self.parts[head] + self.line + (self.word_ids[tail] if tail.isascii() and tail.isalpha() else self._text(tail))
        plain = part.isascii()
        if part and (plain or max(part) < UNSURE):
            if part.isalpha():
                return _bytes([t.id for t in self.tokenize(f"\u0120{part}")]) if plain else self._ids(f" {part}")
            if part[-1] in self.close and part[:-1].isalpha():
                return self.parts[part[:-1]] + self.close[part[-1]]
        return self._text(f" {part}")

    def __call__(self, text: str | None) -> bytes:
        """The document's ids, ended by END."""
        if not text:
            return _bytes([END])
        first, *rest = _SAFE.split(text) if _TIGHT.search(text) else text.split(" ")
        return b"".join([self._text(first) if first else b"", *map(self.parts.__getitem__, rest), _bytes([END])])


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


@cache
def encoder(path: str) -> Encoder:
    """One for this process; tasks make their own, which ends with them."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing of counted items, equal ones at once.

    Gives runs (size, first, n, bin, offset): the items of that size numbered first to first + n go
    to the n bins from ``bin`` on; and ranges (bin, n, used) of the bins, in order.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free length -> ranges (bin, n)
    some, bins = 0, 0  # bit f is set if a bin has f free
    for size in sorted(counts, reverse=True):
        first, left = 0, counts[size]
        while left:
            fits = some >> size
            if fits:
                f = size + (fits & -fits).bit_length() - 1
                start, n = free[f].pop()
                if not free[f]:
                    some &= ~(1 << f)
            else:
                f, start, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            each = min(f // size, left)
            full = min(n, left // each)
            for k in range(each):
                runs.append((size, first + k * full, full, start, capacity - f + k * size))
            first, left = first + each * full, left - each * full
            put = [(f - each * size, start, full)]
            rest = n - full
            if rest and 0 < left < each:  # the last of this size, one bin
                for k in range(left):
                    runs.append((size, first + k, 1, start + full, capacity - f + k * size))
                put.append((f - left * size, start + full, 1))
                first, left, rest = first + left, 0, rest - 1
            if rest:
                put.append((f, start + n - rest, rest))
            for room, b, m in put:
                free.setdefault(room, []).append((b, m))
                if room:
                    some |= 1 << room
    ranges = sorted((b, n, capacity - f) for f, at in free.items() for b, n in at)
    return runs, ranges


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's used length."""
    order = np.argsort(-sizes, kind="stable")
    kinds, starts, counts = np.unique(-sizes[order], return_index=True, return_counts=True)
    runs, ranges = plan({-int(k): int(c) for k, c in zip(kinds, counts, strict=True)}, capacity)
    at = {-int(k): int(s) for k, s in zip(kinds, starts, strict=True)}
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for size, first, n, b, off in runs:
        items = order[at[size] + first : at[size] + first + n]
        where[items], offset[items] = np.arange(b, b + n), off
    used = np.concatenate([np.full(n, u, np.int64) for _, n, u in ranges]) if ranges else np.empty(0, np.int64)
    return where, offset, used


def _numbered(used: np.ndarray) -> np.ndarray:
    """Each bin's number among those of its length."""
    order = np.argsort(used, kind="stable")
    start = np.searchsorted(used[order], used[order])
    out = np.empty(len(used), np.int64)
    out[order] = np.arange(len(used)) - start
    return out


def _pieces(path: str, capacity: int):
    """A partition's documents, tokenized and cut."""

    def run(batches):
        encode = Encoder(path)
        gc.disable()  # nothing here is cyclic, and passes over the caches cost a tenth
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, ids, parts = batch.slice(at, 512), [], []
                for i, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    data = encode(text)
                    n, start, piece = len(data) // 4, 0, 0
                    while start < n:
                        size = (n - 1) % capacity + 1 if not piece else capacity
                        ids.append(i)
                        parts.append((piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)])))
                        piece, start = piece + 1, start + size
                p = np.array(parts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p[:, 0], pa.int32()), *(pa.array(p[:, k]) for k in (1, 2, 3))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del encode
        gc.enable()
        settle()

    return run


def _leaves(capacity: int):
    """A leaf's pieces, packed; ``size`` and ``number`` name a bin that goes up, at its first piece."""

    def run(batches):
        from pyspark import TaskContext

        leaf, found = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found)
            where, offset, used = best_fit(table["length"].to_numpy(), capacity)
            size, number = np.where(used <= capacity - NEARLY_FULL, used, 0), _numbered(used)
            head = np.where(offset == 0, size[where], 0)
            more = {"leaf": np.full(len(where), leaf, np.int64), "bin": (leaf << 32) + where, "offset": offset, "size": head, "number": number[where]}
            for name, column in more.items():
                table = table.append_column(name, pa.array(column))
            yield from table.to_batches(max_chunksize=65_536)

    return run


RANGES = "child long, size long, lo long, hi long, node long, shift long, up long, number long, seq long"


def _merge(capacity: int, level: int, root: bool):
    """The ranges of a node, from its children's counts (child, size, n).

    A range's bins go to bins that stay, from the sequence number ``seq`` on, or to bins that go
    up (seq is -1), numbered from ``number`` on among the node's of length ``up``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "child"], ignore_index=True)
        node, rows = int(group["child"].iloc[0]) // FAN_IN, []
        counts = {int(k): int(n) for k, n in group.groupby("size")["n"].sum().items()}
        spans: dict[int, list[tuple[int, int, int]]] = {}  # size -> (child, start, end) in the node's numbering
        for child, size, n in zip(group["child"].tolist(), group["size"].tolist(), group["n"].tolist(), strict=True):
            at = spans.setdefault(size, [])
            start = at[-1][2] if at else 0
            at.append((child, start, start + n))
        runs, ranges = plan(counts, capacity)
        bins, ups = np.array([b for b, _, _ in ranges], np.int64), {}
        out = []
        for b, n, used in ranges:
            up = 0 if root or used > capacity - NEARLY_FULL else used
            out.append((b, n, up, ups.get(up, 0)))
            ups[up] = ups.get(up, 0) + n
        for size, first, n, b, off in runs:
            for child, start, end in spans[size]:
                lo, hi = max(first, start), min(first + n, end)
                while lo < hi:
                    to = b + lo - first
                    begin, count, up, number = out[int(np.searchsorted(bins, to, "right")) - 1]
                    stop = min(hi, lo + begin + count - to)
                    rows.append((child, size, lo - start, stop - start, node, off, up, number + to - begin, -1 if up else ((level << 26) + node << 32) + to))
                    lo = stop
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RANGES.split(", ")], dtype="int64")

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = staged(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), kept), "pieces")
    leaves = max(1, -(-pieces.count() // leaf_rows))
    packed = staged(pieces.repartition(leaves).mapInArrow(_leaves(capacity), f"{kept}, leaf long, bin long, offset long, size long, number long"), "packed")
    last = packed.agg(F.max("leaf")).first()[0]
    live = packed.where("size > 0").select("bin", F.col("leaf").alias("child"), "size", "number", F.lit(0).cast("long").alias("shift"))
    done, nodes, level = [], (last or 0) + 1, 1
    while True:
        nodes = -(-nodes // FAN_IN)
        # a bin that went up holds other bins, of which only the first, at shift 0, counts
        counts = live.where("shift = 0").groupBy("child", "size").agg(F.count("*").alias("n"))
        ranges = staged(counts.groupBy(F.expr(f"child div {FAN_IN}")).applyInPandas(_merge(capacity, level, nodes == 1), RANGES), "ranges")
        blocks = ranges.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}")))).withColumnRenamed("shift", "more").withColumnRenamed("number", "to")
        found = live.withColumn("block", F.expr(f"number div {BLOCK}")).join(blocks, ["child", "size", "block"]).where("number >= lo and number < hi")
        moved = staged(found.select("bin", "node", "up", (F.col("to") + F.col("number") - F.col("lo")).alias("number"), F.when(F.col("seq") >= 0, F.col("seq") + F.col("number") - F.col("lo")).alias("seq"), (F.col("shift") + F.col("more")).alias("shift")), "moved")
        done.append(moved.where("seq is not null").select("bin", "seq", "shift"))
        if nodes == 1:
            break
        live, level = moved.where("seq is null").select("bin", F.col("node").alias("child"), F.col("up").alias("size"), "number", "shift"), level + 1
    place = done[0]
    for more in done[1:]:
        place = place.unionAll(more)
    return packed.join(place, "bin", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("seq", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
