"""String-preserving tables from CSV, JSON envelopes and Parquet, with stable row numbers."""

from __future__ import annotations

import csv
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "_row"
#: The bundled samples that may be asked for by name.
SAMPLES = ("hospital_10rows", "flights_10rows", "beers_10rows")


def numbered(df: DataFrame) -> DataFrame:
    """With ``_row`` from 0 in file order: partitions are counted once and numbered in parallel, so no
    single task sorts the table."""
    spark, name = df.sparkSession, "_within"
    tagged = df.withColumn(name, F.monotonically_increasing_id())
    part = F.shiftright(F.col(name), 33)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts.append((p, total))
        total += counts[p]
    start = spark.createDataFrame(starts or [(0, 0)], "p bigint, start bigint")
    joined = tagged.withColumn("p", part).join(F.broadcast(start), "p")
    return joined.select((F.col("start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).alias(ROW), *(F.col(f"`{c}`") for c in df.columns))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every cell a string; blanks are empty strings, not nulls."""
    raw = spark.read.options(header=True, multiLine=True, escape='"', quote='"', mode="PERMISSIVE", inferSchema=False).csv(path)
    return numbered(raw.na.fill(""))


def read_csv_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """The same from memory: uploads are small, so the driver parses them."""
    rows = list(csv.reader(data.decode("utf-8-sig").splitlines(keepends=True)))
    if not rows:
        raise ValueError("the upload is empty")
    head, body = rows[0], [r for r in rows[1:] if r]
    width = len(head)
    fitted = [(i, *(r + [""] * width)[:width]) for i, r in enumerate(body)]
    return spark.createDataFrame(fitted, f"{ROW} bigint, " + ", ".join(f"`{c}` string" for c in head))


def from_columns(df: DataFrame, key: str) -> DataFrame:
    """A typed table as string cells under its own key as row number."""
    return df.select(F.col(key).cast("bigint").alias(ROW), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns if c != key))


def read_envelope(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str], dict]:
    """(rows, schema, business rules) of a JSON envelope {_meta, schema, rows, business_rules}, or of a
    bare list. Cells become strings; ``<column>__type`` keeps each cell's JSON type, so that 5 and
    "5" stay apart."""
    found = json.loads(Path(path).read_text())
    envelope = found if isinstance(found, dict) else {"rows": found}
    rows = envelope.get("rows", [])
    names = list(envelope.get("schema") or dict.fromkeys(k for r in rows for k in r))
    kind = lambda v: None if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    flat = [(i, *(text(r.get(c)) for c in names), *(kind(r.get(c)) for c in names)) for i, r in enumerate(rows)]
    ddl = f"{ROW} bigint, " + ", ".join([f"`{c}` string" for c in names] + [f"`{c}__type` string" for c in names])
    return spark.createDataFrame(flat, ddl), dict(envelope.get("schema") or {}), dict(envelope.get("business_rules") or {})


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(_row, column, type, expected, ord) of {_meta, issues} or a bare list."""
    found = json.loads(Path(path).read_text())
    issues = found.get("issues", []) if isinstance(found, dict) else found
    return spark.createDataFrame([(x["row"], x["column"], x.get("type"), x.get("expected"), i) for i, x in enumerate(issues)], f"{ROW} bigint, column string, type string, expected string, ord int")


def read_pair(spark: SparkSession, dirty: str, clean: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dirty, clean, truth) of a benchmark pair: the clean header wins, rows match by number."""
    from ..operators.score import aligned, cell_diff

    c = read_csv(spark, clean)
    d = aligned(read_csv(spark, dirty), c)
    return d, c, cell_diff(d, c)


def read_sample(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A bundled sample; other names are refused."""
    if name not in SAMPLES:
        raise KeyError(name)
    return read_csv(spark, f"{folder}/{name}.csv")


def read_results(path: str) -> dict:
    return json.loads(Path(path).read_text())


def write_csv(df: DataFrame, path: str) -> None:
    """One file in row order with line feeds, replaced in one step; rows stream through the driver, so
    memory doesn't grow with the table."""
    target = Path(path)
    handle, temp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    names = [c for c in df.columns if c != ROW]
    with os.fdopen(handle, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(names)
        for r in df.orderBy(ROW).select(*(F.col(f"`{c}`") for c in names)).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    os.replace(temp, target)


def write_envelope(df: DataFrame, path: str, types: dict[str, str], meta: dict, rules: dict | None = None) -> None:
    """A generated table as a JSON envelope."""
    rows = [{c: r[c] for c in df.columns if c != ROW} for r in df.orderBy(ROW).toLocalIterator()]
    Path(path).write_text(json.dumps({"_meta": meta, "schema": types, "rows": rows} | ({"business_rules": rules} if rules else {}), indent=1))
