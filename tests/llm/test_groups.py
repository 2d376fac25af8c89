"""Near duplicates of texts and vectors, search and archives against brute force, and odd tables."""

import gzip
import os
import pathlib
import re

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import ann, minhash, vecdedup, warc
from lodestone.llm.common import connected_components, new_path

rng = np.random.default_rng(1)


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_documents_against_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(12):
        base = list(rng.choice(words, 120))
        for k in range(10):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(120))] = "new" + str(rng.integers(1000))
            texts[100 * g + k] = " ".join(t)
    texts |= {9000: None, 9001: "", 9002: " \t ", 9003: "one two", 9004: "ONE  two", 9005: "one two three", 9006: texts[0], 9007: "x " * 30_000, 9008: "Ärger über é x y"}
    rows = [(i, t, 1, "c") for i, t in texts.items()] + [(9003, "one two", 1, "c"), (None, texts[0], 1, "c")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string").repartition(5)).collect()
    s = {i: sets_of(t) for i, t in texts.items()}
    ids = sorted(s)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = components(ids, links)
    assert len(links) > 50 and len(out) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None} == {(i, len(s[i]), want[i], want[i] == i) for i in ids}
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}


def vectors(spark):
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:140] = x[5] + 0.05 * rng.normal(size=(40, 24))
    x[200] = 3 * x[7]
    x[201:205] = x[8]
    rows = [(i, [float(v) for v in x[i]], "l") for i in range(600)]
    odd = [(700, None, "l"), (701, [0.0] * 24, "l"), (702, [float("nan")] * 24, "l"), (703, [None] + [1.0] * 23, "l"), (704, [], "l"), (705, [1.0, 2.0], "l"), (None, rows[0][1], "l")]
    return x.astype(float), spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, v string")


def test_vectors_against_brute_force(spark):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    links = [(a, b) for a in range(600) for b in range(a + 1, 600) if s[a, b] >= 0.95]
    want = components(range(600), links)
    out = {r["vec_id"]: r for r in vecdedup.near_duplicates(df).collect() if r["vec_id"] is not None}
    assert len(out) == 606 and len(links) > 100
    assert {i: out[i]["component_id"] for i in range(600)} == want
    counts = np.zeros(706, int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    assert sum(out[i]["n_links"] for i in out) >= 0.99 * counts.sum()
    assert all(out[i]["kept"] and out[i]["n_links"] == 0 for i in range(700, 706))


def shard_frame(x, start=0):
    return pd.DataFrame({"row": start + np.arange(len(x)), "w": 1, "v": list(x)})


def test_sparse_links_of_vectors_are_audited():
    r = np.random.default_rng(9)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, q = vecdedup.planted(x, 0.95)
    assert len(rows) == vecdedup.PLANTED and np.allclose(np.einsum("bd,bd->b", x[rows], q), 0.95, atol=1e-5)
    rows, q, lone = rows[:200], q[:200], r.normal(size=(10_000, 64))
    index = vecdedup.shard_index(shard_frame(x), 0.95)
    assert index["audited"] >= vecdedup.PLANTED and index["recall"] >= vecdedup.RECALL
    out = pd.concat(vecdedup.shard_links(index, [shard_frame(np.concatenate([lone, q]), 10_000_000)], 0.95))
    assert (out["count"] & (out["a"] >= 10_010_000)).sum() >= 0.99 * len(rows)


def test_audits_leave_out_a_rows_own_entry():
    r = np.random.default_rng(11)
    x = vecdedup.unit_rows(r.normal(size=(300, 16)))
    x[7] = vecdedup.unit_rows((x[3] + 0.01 * r.normal(size=16))[None])[0]
    audit = vecdedup.Audit(x, 0.95)
    real = sum(len(w) for w in audit.wanted[300:])
    assert len(audit.queries) == 300 + min(300, vecdedup.AUDITED) and real == 2 and audit.links == 302


def test_failed_audits_compare_exactly(monkeypatch):
    r = np.random.default_rng(10)
    x = r.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, q = vecdedup.planted(x, 0.95)
    monkeypatch.setattr(vecdedup.Graph, "within", lambda self, q, least, width: [np.empty(0, np.int64)] * len(q))
    index = vecdedup.shard_index(shard_frame(x), 0.95)
    assert index["width"] == 0
    out = pd.concat(vecdedup.shard_links(index, [shard_frame(q, 500)], 0.95))
    assert out["b"][out["count"]].sum() == (q @ x.T >= 0.95).sum() >= len(q)


def test_filed_graphs_answer_alike(monkeypatch):
    monkeypatch.setattr(vecdedup, "PLACE_ROWS", 1)
    r = np.random.default_rng(12)
    x = vecdedup.unit_rows(r.normal(size=(900, 12)))
    index = vecdedup.shard_index(shard_frame(x), 0.95)
    assert index["width"] > 0
    graph, q = vecdedup.Graph(np.arange(900), x), vecdedup.planted(x, 0.95)[1]
    again = vecdedup.Graph.loaded(index, x)
    for a, b in zip(graph.within(q, 0.95, 24), again.within(q, 0.95, 24), strict=True):
        assert np.array_equal(a, b)


def test_vectors_of_all_dimensions_and_repeated_ids(spark):
    rows = [(i, [1.0, 0.01 * i, 0.0]) for i in range(5)] + [(8, [1.0, 0.01]), (9, [1.0, 0.02]), (7, [0.0, 1.0]), (5, None), (5, [0.0, 1.0, 0.0]), (6, [0.0, 1.0, 0.01]), (6, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for layout in (df.repartition(5), df.coalesce(1), df.orderBy("vec_id")):
        out = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in vecdedup.near_duplicates(layout).collect())
        assert out == sorted([(i, 4, 0) for i in range(5)] + [(8, 1, 8), (9, 1, 8), (7, 0, 7), (5, 0, 5), (5, 1, 5), (6, 1, 5), (6, 1, 6), (6, 1, 6), (-1, 0, -1)])


def test_search_in_all_dimensions(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=3 if i % 3 else 5)]) for i in range(40)] + [(100, [1.0]), (None, [1.0, 2.0, 3.0])]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 20 == 0).collect()
    for q in (0, 20, 100):
        mine = dict(rows)[q]
        best = sorted((-float(np.dot(mine, v)), i) for i, v in rows if i not in (q, None) and len(v) == len(mine))[:20]
        got = sorted((x["rank"], x["vec_id"]) for x in out if x["query_id"] == q)
        assert got == [(n + 1, i) for n, (_, i) in enumerate(best)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_search_reranks_a_small_share(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found, reports = ann.candidates(df, lambda i: i % 20 == 0)
    got = found.toPandas()
    pdf = df.toPandas()
    ids, x = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = part.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"][:20]
        hits, total = hits + len(set(mine) & set(best)), total + 20
    share = got.drop_duplicates(["query_id", "ranked"]).groupby("query_id")["ranked"].sum().mean() / len(ids)
    print("recall", hits / total, "share", share, reports.collect())
    assert hits >= 0.9 * total and share <= 0.15


def test_search_against_brute_force(spark):
    x, df = vectors(spark)
    out = ann.search(df, lambda i: i % 20 == 0, 20).collect()
    s = x @ x.T
    hits = total = 0
    for q in range(0, 600, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in {m[1] for m in mine}
        assert all(abs(m[2] - s[q, m[1]]) < 1e-9 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        best = [i for i in np.lexsort((np.arange(600), -s[q])) if i != q][:20]
        hits, total = hits + len({m[1] for m in mine} & set(best)), total + 20
    assert hits >= 0.9 * total


def test_search_with_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few, lambda i: i == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(none, lambda i: i == 0).count() == 0 and vecdedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [15, 40, 100])
def test_search_returns_all_of_few_candidates(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "vec_id long, embedding array<float>")
    out = ann.search(df, lambda i: i % 5 == 0).collect()
    s = x.astype(float) @ x.astype(float).T
    for q in range(0, n, 5):
        best = [i for i in np.lexsort((np.arange(n), -s[q])) if i != q][:20]
        mine = [r["vec_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == best


def test_hadamard_keeps_lengths():
    x = rng.normal(size=(5, 24))
    assert np.allclose(np.linalg.norm(ann.rotations(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_archive_round_trip(spark):
    html = "<p>é</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a.org/x y\n", html, 0), (1, None, html, 0), (2, "u", None, 0), (4, "v", "", 0), (5, "w", "z" * 300_000, 0), (5, "w", "z" * 300_000, 0), (None, "n", "n", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    root = new_path(spark, "archive")
    manifest = warc.write(df, root, roll_bytes=200, shards=2)
    read = warc.read(spark, root, strict=True).collect()
    out = {r["page_id"]: r for r in read}
    assert len(read) == len(rows) and set(out) == {1, 2, 3, 4, 5, None} and all(r["intact"] for r in read)
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in out.items()} == {1: ("response", None, len(html.encode())), 3: ("revisit", 1, len(html.encode())), 2: ("response", None, 0), 4: ("revisit", 2, 0), 5: ("response", None, 300_000), None: ("response", None, 1)}
    assert out[3]["payload_digest"] == warc.digest(html.encode()) and "\n" not in out[3]["url"]
    again = warc.write(df.repartition(3), new_path(spark, "archive"), roll_bytes=200, shards=2)
    assert again == manifest
    assert len(manifest["files"]) >= 3 and sum(f["records"] for f in manifest["files"]) == len(rows)
    folder = root.removeprefix("file://")
    assert gzip.open(f"{folder}/{manifest['files'][0]['name']}").read(8) == b"WARC/1.1"


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "a", "same"), (2, "b", "same")], "page_id long, url string, html string")
    root = new_path(spark, "archive")
    warc.write(df, root, min_revisit=100, shards=2)
    assert {r["record_type"] for r in warc.read(spark, root).collect()} == {"response"}


def test_empty_archive(spark):
    root = new_path(spark, "archive")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), root, shards=2)
    assert warc.read(spark, root).count() == 0


def test_pipeline_on_a_fixture(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = " ".join(f"word{i}" for i in range(60))
    clean = [f"the cat number {i} sat on the mat and looked at bird {i} near the old house {i}" for i in range(40)]
    toxic = [f"you idiot fool number {i} are a scum and nobody likes thing {i} here" for i in range(40)]
    rows = [(i, t, "en", "s", len(t), "x") for i, t in enumerate(clean + toxic)]
    rows += [(100, base, "en", "s", 1, "x"), (101, base + " end", "en", "s", 1, "x"), (102, "12345 !!!", "en", "s", 1, "x"), (103, 'key token = "0123456789abcdef0123456789abcdef" the end of it', "en", "s", 1, "x"), (104, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(out["doc_id"]) == {*range(40), 100, 103}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.redact(spark, docs, "").where("doc_id = 103").first()["text"] == 'key [SECRET]" the end of it'
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def row_components(rows):
    """Smallest id reachable of every row, by brute force over rows."""
    s = [sets_of(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    of = components(range(len(rows)), links)
    least = {}
    for i, c in of.items():
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return of, [least[of[i]] for i in range(len(rows))]


def repeated_ids():
    text = lambda g, k: " ".join([f"g{g}w{i}" for i in range(56)] + [f"end{k}"])
    rows = [(1, text(0, 0)), (1, text(1, 0)), (2, text(0, 1)), (3, text(1, 1)), (5, text(2, 0)), (5, text(3, 0)), (5, text(2, 0)), (4, text(2, 1)), (9, text(4, 0)), (9, text(4, 1)), (8, ""), (8, ""), (8, text(5, 0)), (7, None)]
    return rows + [(6, text(5, 1))]


@pytest.mark.parametrize("sort", [True, False])
def test_repeated_ids_of_different_texts(spark, sort):
    rows = repeated_ids()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.repartitionByRange(3, "doc_id") if sort else df.repartition(4)
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    _, want = row_components(rows)
    assert out == sorted((i, len(sets_of(t)), c) for (i, t), c in zip(rows, want, strict=True))


def test_drop_copies_loses_no_text(spark):
    rows = repeated_ids() + [(None, "no id here"), (None, "no id here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(3)
    out = minhash.drop_copies(df)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect())
    of, least = row_components(rows[:-2])
    groups = {}
    for (i, t), c, first in zip(rows, of.values(), least, strict=False):
        if sets_of(t):
            groups.setdefault(c, set()).update([(i, t)] if i == first else [])
    blank = [(i, t or "") for i, t in rows if not sets_of(t)]
    assert len(got) == len(groups) + len(blank) + 2
    for options in groups.values():
        assert len(options & set(got)) == 1
    assert all(b in got for b in blank)


def test_archive_of_repeated_and_missing_ids(spark):
    rows = [(1, "a", "p"), (1, "b", "q"), (1, "b", "q"), (2, "c", "p"), (2, "d", "q"), (2, "e", "r"), (None, None, "q"), (None, "f", "s"), (None, "f", "s"), (3, "g", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shards in (1, 3):
        root = new_path(spark, "archive")
        warc.write(df.repartition(3), root, shards=shards)
        got = sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.read(spark, root, strict=True).collect())
        first = {h: min(i for i, _, x in rows if x == h and i is not None) for _, _, h in rows}
        assert got == sorted((str(i), warc.digest(h.encode()), "response" if i == first[h] else "revisit", 0 if i == first[h] else first[h]) for i, _, h in rows)
        names = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(gzip.open(f).read() for f in sorted(pathlib.Path(root.removeprefix("file://")).glob("*.gz"))))
        assert len(names) == len(set(names)) == len(rows)


def test_corrupt_archives_are_refused(spark):
    root = new_path(spark, "archive")
    warc.write(spark.createDataFrame([(1, "a", "payload")], "page_id long, url string, html string"), root)
    file = next(pathlib.Path(root.removeprefix("file://")).glob("*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"payload\r\n", b"PAYLOAD\r\n")))
    assert [r["intact"] for r in warc.read(spark, root).collect()] == [False]
    with pytest.raises(Exception, match="a digest fails"):
        warc.read(spark, root, strict=True).collect()


def test_one_template_against_brute_force(spark, monkeypatch):
    """Pages of one template (Jaccard 0.6 to 0.85) share buckets with few links; no link is lost, nor any made up."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = np.random.default_rng(6)
    template, pages = [f"t{i}" for i in range(400)], []
    for g in range(260):
        own = [f"g{g}x{i}" for i in range(int(r.integers(40, 110)))]
        for k in range(int(r.integers(1, 4))):
            words = template + own
            for at in r.integers(400, len(words), int(r.integers(0, 12))):
                words = [*words[:at], f"n{g}-{k}-{at}", *words[at + 1 :]]
            pages.append(" ".join(words))
    order = r.permutation(len(pages)).tolist()
    rows = [(i, pages[j]) for i, j in enumerate(order)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    index, sizes = {}, []
    for i, t in rows:
        s = sets_of(t)
        sizes.append(len(s))
        for g in s:
            index.setdefault(g, len(index))
    has = np.zeros((len(rows), len(index)), np.float32)
    for i, t in rows:
        has[i, [index[g] for g in sets_of(t)]] = 1
    both, n = (has @ has.T).round().astype(int), np.array(sizes)
    linked = np.argwhere(np.triu(100 * both >= 85 * (n[:, None] + n[None, :] - both), 1))
    alike = both / (n[:, None] + n[None, :] - both)
    assert ((alike > 0.6) & (alike < 0.85)).mean() > 0.5 and len(linked) > 100
    assert got == components(range(len(rows)), linked.tolist())


def test_no_pair_at_the_threshold_is_dropped_by_its_sketch():
    """Pairs just at 0.85: the signature's sketches never differ by more than SKETCH_DIFFER allows."""
    r = np.random.default_rng(8)
    for n in (40, 300):
        most = 0
        for _ in range(400):
            common = -(-85 * 2 * n // 185)
            s = r.integers(1, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(s[:n]), np.unique(s[n - common :])
            marks = minhash.sketches(minhash.signatures([a, b])).view(np.uint64)
            x = marks[0] ^ marks[1]
            most = max(most, sum(sum((int(v) >> (4 * i)) & 15 != 0 for i in range(16)) for v in x))
        assert most <= minhash.SKETCH_DIFFER
