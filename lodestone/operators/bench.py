"""Benchmark runs of repair methods over dirty/clean pairs."""

from __future__ import annotations

import random
import time
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import ROW, cells, detect_all
from .repair import propose
from .score import across_datasets, aggregate_runs, counted, estimated_calls, rates

METHODS = ("random", "heuristic", "llm_zeroshot", "llm_react")
RECORD = "method string, dataset string, seed int, status string, skip_reason string, precision double, recall double, f1 double, avg_steps double, quota_units double, runtime_s double"
LEAST_PICKS, MOST_PICKS = 25, 200


def heuristic_repairs(dirty: DataFrame) -> DataFrame:
    """Detectors and deterministic repairers, without safety or verification."""
    return propose(detect_all(dirty), dirty).select(ROW, "column", "new_value")


def random_repairs(dirty: DataFrame, rows: int, n_truth: int, seed: int) -> DataFrame:
    """Seeded picks of a cell and another value of its column; the number of picks is bounded."""
    rng, names = random.Random(seed), cells(dirty)
    picks = min(MOST_PICKS, max(LEAST_PICKS, ceil(n_truth / 10)))
    chosen = [(i, rng.randrange(rows), rng.choice(names), rng.randrange(rows)) for i in range(picks)]
    spark = dirty.sparkSession
    frame = F.broadcast(spark.createDataFrame(chosen, "seq int, _row bigint, column string, other bigint"))
    values = F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"`{c}`"))))
    other = dirty.select(F.col(ROW).alias("other"), values.alias("v"))
    last = frame.groupBy(ROW, "column").agg(F.max_by("other", "seq").alias("other"))
    return last.join(other, "other").select(ROW, "column", F.element_at("v", F.col("column")).alias("new_value"))


def run(spark: SparkSession, pairs: dict[str, tuple[DataFrame, DataFrame]], methods: list[str], seeds: int, allow_more: bool = False) -> DataFrame:
    """Seed records of every method on every pair (dirty table, truth cells). Methods that need a model
    provider are recorded as skipped; unknown methods and oversized runs are errors."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    sizes = {name: dirty.count() for name, (dirty, _) in pairs.items()}
    estimated_calls(methods, list(sizes.values()), seeds, allow_more)
    records = []
    for name, (dirty, truth) in pairs.items():
        n_truth = truth.count()
        for method in methods:
            for seed in range(seeds):
                if method.startswith("llm_"):
                    records.append((method, name, seed, "skipped", "no provider configured", None, None, None, None, 0.0, 0.0))
                    continue
                began = time.monotonic()
                fixes = heuristic_repairs(dirty) if method == "heuristic" else random_repairs(dirty, sizes[name], n_truth, seed)
                got = rates(counted(truth, fixes)).first()
                steps = 1.0 + got["tp"] + got["fp"]
                records.append((method, name, seed, "ok", None, got["precision"], got["recall"], got["f1"], steps, 0.0, time.monotonic() - began))
    return spark.createDataFrame(records, RECORD)


BEGIN, END = "<!-- benchmark:begin -->", "<!-- benchmark:end -->"


def markdown(records: DataFrame) -> str:
    """A table by method and dataset, and one of means across datasets."""
    runs = aggregate_runs(records)
    cell = lambda r, c: "skipped" if r["status"] == "skipped" else f"{r[f'{c}_mean']:.4f} ± {r[f'{c}_std']:.4f}"
    out = ["| method | dataset | precision | recall | F1 |", "|-|-|-|-|-|"]
    out += [f"| {r['method']} | {r['dataset']} | " + " | ".join(cell(r, c) for c in ("precision", "recall", "f1")) + " |" for r in runs.orderBy("dataset", "method").collect()]
    out += ["", "| method | precision | recall | F1 |", "|-|-|-|-|"]
    out += [f"| {r['method']} | " + ("skipped | skipped | skipped" if r["status"] == "skipped" else f"{r['precision']:.4f} | {r['recall']:.4f} | {r['f1']:.4f}") + " |" for r in across_datasets(runs).collect()]
    return "\n".join(out) + "\n"


def latex(records: DataFrame) -> str:
    rows = aggregate_runs(records).where("status = 'ok'").orderBy("method", "dataset").collect()
    body = "".join(f"{r['method']} & {r['dataset']} & {r['precision_mean']:.4f} & {r['recall_mean']:.4f} & {r['f1_mean']:.4f} \\\\\n" for r in rows)
    return "\\begin{tabular}{llrrr}\nmethod & dataset & P & R & F1 \\\\\n\\hline\n" + body + "\\end{tabular}\n"


def replace_block(text: str, block: str) -> str:
    """The text with the marked block replaced, or added at the end; doing it twice changes nothing."""
    whole = f"{BEGIN}\n{block}{END}"
    if BEGIN in text and END in text:
        return text[: text.index(BEGIN)] + whole + text[text.index(END) + len(END) :]
    return f"{text.rstrip()}\n\n{whole}\n"
