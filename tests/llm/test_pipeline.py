"""The pipeline against a plain Python version on a fixture, and on odd tables."""

import math
import re
import zlib

import numpy as np
import pytest
import tokenizers

from lodestone.llm import langid, packing, secrets, toxicity
from tests.llm.test_groups import row_components, sets_of
from tests.llm.test_models import brute_predict

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string"


def fixture_rows():
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    rows = []
    for i in range(60):
        rows.append((i, f"the {word()} sat on the {word()} near house number {i} and saw {word()} again", "en"))
        rows.append((100 + i, f"le {word()} est sur la {word()} pres de la maison {i} et voit {word()} encore", "fr"))
        rows.append((200 + i, f"you idiot {word()} are scum and nobody likes {word()} or {i}", "en"))
    base = " ".join(f"page {k} of the old house" for k in range(20))
    rows += [(300, base, "en"), (301, base + " more", "en"), (302, base, "fr"), (303, "12345 !!! 678", "en"), (304, None, None), (305, "", "en"), (306, " \n ", "fr")]
    rows += [(307, "key token = \"0123456789abcdef0123456789abcdef\" and the end of it", "en"), (308, "the key ghp_" + "aB3" * 12 + " is here", None), (309, " ".join(word() for _ in range(3000)), "en")]
    rows += [(310, base + " one two", "en"), (310, "a very different text under the same number", "en"), (310, "a very different text under the same number", "en"), (None, "no number on the mat", "en"), (None, "no number on the mat", "en")]
    return [(i, t, lang, "s", None if t is None else len(t), "x", None) for i, t, lang in rows]


def brute(rows, labels):
    """(id, text) of the documents that reach packing; sets of choices where one of a group stays."""
    crc = lambda i: zlib.crc32(str(i).encode())
    known = sorted((i, y) for i, y in labels if crc(i) % 3 != 1)
    first = {i: min(t for j, t, *_ in rows if j == i) for i, _ in known if any(j == i for j, *_ in rows)}
    model = toxicity.fit([first[i] for i, _ in known], [y for _, y in known])

    def score(text):
        words = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (text or "").lower()).split()
        grams = {f" {w} "[i : i + n] for w in words for n in toxicity.SIZES for i in range(len(w) + 3 - n)}
        return 1 / (1 + math.exp(-(model.intercept + sum(model.weights.get(g, 0.0) for g in grams))))

    left = [x for x in rows if score(x[1]) < toxicity.REJECT]
    taught = {}
    for i, t, lang, *_ in left:
        if i is not None and crc(i) % 4 != 2 and lang and t and re.search(r"[^\W\d_]", t):
            taught.setdefault(lang, []).append(t)
    left = [x for x in left if brute_predict(x[1], {k: v[:2] for k, v in taught.items()}) != "und"]
    named = [x for x in left if x[0] is not None]
    of, least = row_components([x[:2] for x in named])
    groups, free = {}, [x[:2] for x in left if x[0] is None]
    for k, x in enumerate(named):
        if not sets_of(x[1]):
            free.append(x[:2])
        elif x[0] == least[k]:
            groups.setdefault(of[k], set()).add(x[:2])
    return free, list(groups.values())


def clean(text):
    return secrets.redact(text, secrets.scan([text])[1][0])


@pytest.mark.parametrize("layout", [1, 5])
def test_pipeline_equals_brute_force(spark, tmp_path, layout):
    rows = fixture_rows()
    labels = [(x[0], int(200 <= x[0] < 260)) for x in rows if x[0] is not None and x[0] < 300]
    spark.createDataFrame(rows, SCHEMA).repartition(layout).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path)).toPandas()
    free, groups = brute(rows, labels)
    token = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    ids = lambda t: [*token.encode(t or "", add_special_tokens=False).ids, 0]
    crc = lambda t: zlib.crc32(np.array(ids(t)[:2048] if len(ids(t)) <= 2048 else ids(t)[: (len(ids(t)) - 1) % 2048 + 1], "<u4").tobytes())
    got = sorted((-1 if math.isnan(i) else int(i), int(c)) for i, c, p in zip(out["doc_id"].astype(float), out["ids_crc32"], out["piece"], strict=True) if p == 0)
    pick = lambda g: (next(iter(g))[0], {crc(clean(t)) for _, t in g})
    want_free = sorted((-1 if i is None else i, crc(clean(t))) for i, t in free)
    for x in want_free:
        got.remove(x)
    assert len(got) == len(groups)
    for i, choices in map(pick, groups):
        hit = [x for x in got if x[0] == i and x[1] in choices]
        assert hit, i
        got.remove(hit[0])
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048
    assert out["length"].sum() == sum(len(ids(clean(t))) for _, t in free) + sum(max(len(ids(clean(t))) for _, t in g) for g in groups)
    assert not set(range(200, 260)) & set(out["doc_id"].dropna()) and {*range(60), *range(100, 160), 300, 307, 308, 309, 310} <= set(out["doc_id"].dropna())


def test_pipeline_on_empty_and_null_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None,) * 7] * 3), ("blank", [(1, "", None, None, 0, None, None), (2, "...", "en", None, None, "x", "y")])):
        d = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        docs = spark.read.parquet(str(d / "documents.parquet"))
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(d))
            assert out.columns == docs.columns
            out.count()
        assert pipeline.run(spark, str(d)).count() == 0


def test_runs_leave_other_results_alone(spark, tmp_path):
    """A second run deletes neither the first one's result nor another query's staged tables."""
    from lodestone.llm.minhash import near_duplicates

    rows = fixture_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    other = near_duplicates(spark.read.parquet(str(tmp_path / "documents.parquet")))
    first = pipeline.run(spark, str(tmp_path))
    second = pipeline.run(spark, str(tmp_path))
    assert first.count() == second.count() and other.count() == len(rows)


def test_a_cluster_needs_a_shared_folder():
    from lodestone.llm import common

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_language_model_is_bounded():
    assert langid.TRAIN_ROWS * langid.ROW_CHARS <= 64_000
