"""Near-duplicate documents: circulant MinHash signatures, banding, exact Jaccard.

A document's set holds its distinct five-word shingles (words are runs without ASCII white
space, A-Z lower-cased); with fewer words the whole sequence is one shingle; without words the
set is empty and links with nothing. Two documents link if 100 * |A & B| >= 85 * |A | B|.

Signatures take two permutations only: ``sigma`` scatters the shingles' cells over a ring and
``pi``, circularly shifted by k, gives coordinate k. Bands of ROWS coordinates make buckets.
With 28 bands of 6 a pair at the threshold is missed with probability (1 - 0.85**6)**28, below
2e-6. Every pair that a bucket proposes is either confirmed on its full sets, already joined
through other confirmed links, or excluded by the sets' sizes or by the whole signatures: of the
168 coordinates, four bits of each kept, a pair at the threshold differs in 24 on average and in
more than SKETCH_DIFFER with probability below 1e-7. No bucket is capped.

Texts are what links; ids only name them. Rows of one id with different texts are different
documents, each with the component of its own text.

Defined cases: null, empty or blank texts have an empty set, their own id as component and are
kept; equal sets form one class, so exact copies are never paired; texts of any length are read
whole; a component's smallest id is no tie, and hubs, which are ties between equal buckets, don't
show in results; repeated rows give one result row each; a null id links with nothing and has a
null component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import connected_components, is_empty, map_arrow, settle, staged

WORDS, CELLS, BANDS, ROWS = 5, 1 << 20, 28, 6
PERCENT = 85
SKETCH_DIFFER, SKETCH_LONGS = 49, -(-BANDS * ROWS // 16)
CACHE_WORDS, CHUNK, BLOCK = 400_000, 1 << 17, 512

_rng = np.random.default_rng(20_231_104)
_MULT = _rng.integers(1, 1 << 62, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 62, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES: list[np.ndarray] = []


def permutations() -> list[np.ndarray]:
    """sigma, and pi followed by its own beginning so that shifts need no remainder."""
    if not _TABLES:
        rng = np.random.default_rng(7)
        sigma, pi = (rng.permutation(CELLS).astype(np.int32) for _ in range(2))
        _TABLES.extend([sigma, np.concatenate([pi, pi[: BANDS * ROWS]])])
    return _TABLES


class _Words(dict):
    """Eight hash bytes of a word; bounded, so memory doesn't follow the vocabulary."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_digest(word)
        return got


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.frombuffer(b"".join([_words[x] for x in words]), "<u8")
    n = max(1, len(w) - WORDS + 1)
    if len(w) < WORDS:
        got = (w * _MULT[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _MULT[WORDS:] * np.full(1, len(w), np.uint64)
    else:
        got = w[:n] * _MULT[0]
        for i in range(1, WORDS):
            got += w[i : i + n] * _MULT[i]
    return np.unique(_mix(got))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS * ROWS coordinates for each non-empty set."""
    sigma, pi = permutations()
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    at = sigma[(np.concatenate(sets) >> np.uint64(64 - 20)).astype(np.int64)].astype(np.int64)
    out = np.empty((BANDS * ROWS, len(sets)), np.int32)
    got = np.empty(len(at), np.int32)
    for k in range(BANDS * ROWS):
        np.take(pi[k : k + CELLS], at, out=got, mode="clip")
        out[k] = np.minimum.reduceat(got, starts)
    return out.T


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return _mix((s * _BAND[None, :, :ROWS]).sum(axis=2, dtype=np.uint64) + _BAND[None, :, ROWS]).view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """The low four bits of every coordinate, 16 to a long."""
    bits = np.zeros((len(sig), SKETCH_LONGS * 16), np.uint64)
    bits[:, : sig.shape[1]] = sig & 15
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (bits.reshape(len(sig), SKETCH_LONGS, 16) << shift).sum(axis=2, dtype=np.uint64).view(np.int64)


def _features(blocks):
    for block in blocks:
        sets = [shingles(t) for t in block["text"]]
        keys: list = [None] * len(sets)
        marks: list = [None] * len(sets)
        group, size = [], 0
        for i, s in enumerate(sets):
            if len(s):
                group.append(i)
                size += len(s)
            if group and (size >= CHUNK or i == len(sets) - 1):
                sig = signatures([sets[j] for j in group])
                for j, key, mark in zip(group, band_keys(sig), sketches(sig), strict=True):
                    keys[j], marks[j] = key, mark
                group, size = [], 0
        yield {"id": block["id"], "n": [len(s) for s in sets], "fp": [_print(s) for s in sets], "bands": keys, "sketch": marks}
    _words.clear()  # the worker's next task may need the memory for something else


def _print(s: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(s.tobytes()) if len(s) else None


def _sets(blocks):
    for block in blocks:
        sets = [shingles(t) for t in block["text"]]
        yield {"fp": [_print(s) for s in sets], "s": [s.view(np.int64) for s in sets]}
    _words.clear()


def _sizes_allow(na, nb):
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def _linked(common, na, nb):
    return 100 * common >= PERCENT * (na + nb - common)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (rep, hub) with both sets, s and hub_s."""
    return pairs.join(sets, "rep").join(sets.select(F.col("rep").alias("hub"), F.col("s").alias("hub_s")), "hub")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    return _grouped(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of smallest id, and of smallest
    fingerprint among several texts of that id, once. Rows without words or without an id stay.

    An id that one row has needs no look at its text again; rows of repeated ids are told apart by
    their fingerprints.
    """
    found = staged(_grouped(docs, id_col, text_col).where("doc_id is not null"), "near-duplicates")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("c"), F.bool_or("kept").alias("kept"))
    away = ids.where("c > 1 or not kept").select(F.col("doc_id").alias("__id"))
    again = ids.where("c > 1").select(F.col("doc_id").alias("__id"))
    key = F.col(id_col).cast("long")
    single = docs.join(away.hint("merge"), key == F.col("__id"), "left_anti")
    held = found.where("kept and fp is not null").join(again, F.col("doc_id") == F.col("__id"), "left_semi")
    best = held.groupBy("root").agg(F.min("doc_id").alias("__id"), F.min(F.hex("fp")).alias("fp")).select("__id", F.unhex("fp").alias("__best"))
    several = _with_prints(docs.join(again.hint("merge"), key == F.col("__id"), "left_semi"), text_col)
    blank = several.where("__fp is null").drop("__fp")
    chosen = several.join(best, (key == F.col("__id")) & (F.col("__fp") == F.col("__best")), "left_semi")
    return single.unionByName(blank).unionByName(chosen.withColumn("__key", key).dropDuplicates(["__key", "__fp"]).drop("__key", "__fp"))


def _with_prints(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` and the fingerprint ``__fp`` of each text's set, null where that is empty."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield part.append_column("__fp", pa.array([_print(shingles(t)) for t in part.column(at).to_pylist()], pa.binary()))
        _words.clear()
        settle()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__fp", BinaryType())]))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, fp, root) for every row.

    Classes are numbered by their first row, ``rep``; ``least`` is a class's smallest id, ``root``
    the number of a component.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = staged(map_arrow(docs, ["id", "text"], "id long, n long, fp binary, bands array<long>, sketch array<long>", _features).withColumn("row", F.monotonically_increasing_id()), "shingle-features")
    known = feats.where("id is not null and n > 0")
    classes = staged(known.groupBy("fp").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "classes")

    keys = classes.select("rep", "n", F.explode("bands").alias("h"))
    hubs = keys.groupBy("h").agg(F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = staged(keys.join(hubs, "h"), "bucket-members")
    named = classes.select("rep", "fp", "least").join(members.select("rep").distinct(), "rep", "left_semi")
    ids = named.select(F.col("least").alias("id")).distinct().hint("merge")
    # a row of the smallest id may also hold another text, which the fingerprints leave out
    sets = staged(map_arrow(docs.join(ids, "id", "left_semi"), ["id", "text"], "fp binary, s array<long>", _sets, 256).join(named.select("fp", "rep"), "fp").dropDuplicates(["fp"]).select("rep", "s"), "shingle-sets")
    starred = members.where((F.col("rep") != F.col("hub")) & _sizes_allow(F.col("n"), F.col("hub_n"))).select("rep", "hub", "n", "hub_n").distinct()
    common = F.size(F.array_intersect("s", "hub_s")).cast("long")
    links = staged(_with_sets(staged(starred, "pairs"), sets).where(_linked(common, F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")), "hub-links")
    comps = connected_components(links)

    more = staged(_across(members, comps, classes.select("rep", "sketch"), sets), "more-links")
    if not is_empty(more):
        comps = connected_components(links.unionAll(more))

    least = classes.select("rep", "least").join(comps.withColumnRenamed("id", "rep"), "rep").groupBy("component").agg(F.min("least").alias("first"))
    named = classes.select("fp", "rep", "least").join(comps.join(least, "component").select(F.col("id").alias("rep"), "component", "first"), "rep", "left").select("fp", F.coalesce("first", "least").alias("name"), F.coalesce("component", "rep").alias("root"))
    out = feats.select("id", "n", "fp").join(named, "fp", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("name", "id")).alias("component_id"), "fp", "root")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(members: DataFrame, comps: DataFrame, marks: DataFrame, sets: DataFrame) -> DataFrame:
    """Further links (a, b) between members of one bucket in different components so far.

    Members meet under their bucket's hub. One side holds only members outside the hub's component,
    so a large group of near copies, which joins its hub, isn't paired with itself. A member carries
    only what its set differs from the hub's in, from which two members' exact intersection follows:
    the join itself confirms links and puts out nothing else. A hub's strays are dealt over blocks of
    about BLOCK, each of which meets the hub's members by itself, so no hub is one task's.
    """
    of = comps.select(F.col("id").alias("rep"), F.col("component").alias("c"))
    hub_of = comps.select(F.col("id").alias("hub"), F.col("component").alias("hc"))
    m = members.join(of, "rep", "left").join(hub_of, "hub", "left").where("rep <> hub").select("h", "rep", "n", "hub", F.coalesce("c", "rep").alias("c"), F.coalesce("hc", "hub").alias("hc"))
    open_buckets = m.groupBy("h").agg(F.max(F.col("c") != F.col("hc")).alias("strays"), (F.min("c") != F.max("c")).alias("several")).where("strays and several").select("h")
    m = staged(m.join(open_buckets, "h", "left_semi").select("rep", "n", "hub", "c", "hc").distinct().join(marks, "rep"), "open-members")
    apart = F.concat(F.array_except("s", "hub_s"), F.array_except("hub_s", "s"))
    m = staged(_with_sets(m, sets).select("rep", "n", "hub", "c", "hc", "sketch", apart.alias("d")), "differences")
    blocks = m.where("c <> hc").groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    m = m.join(blocks, "hub")
    x = m.where("c <> hc").select("hub", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "hc", *(F.col(k).alias(f"{k}1") for k in ("rep", "n", "c", "sketch", "d")))
    y = m.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *(F.col(k).alias(f"{k}2") for k in ("rep", "n", "c", "sketch", "d")))
    n1, n2 = F.col("n1"), F.col("n2")
    common = (n1 + n2 - F.size("d1") - F.size("d2") + 2 * F.size(F.array_intersect("d1", "d2"))) / 2
    once = (F.col("c2") == F.col("hc")) | (F.col("rep1") < F.col("rep2"))
    wanted = (F.col("c1") != F.col("c2")) & once & _sizes_allow(n1, n2) & (_differing(F.col("sketch1"), F.col("sketch2")) <= SKETCH_DIFFER) & _linked(common, n1, n2)
    return x.join(y, ["hub", "block"]).where(wanted).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct()


def _differing(a, b):
    """How many coordinates' four bits differ."""
    total = F.lit(0)
    for i in range(SKETCH_LONGS):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total
