"""Column expressions for string cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell patterns and the words that stand for a missing value.
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}[-/]\d{2}[-/]\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
SENTINELS = ("n/a", "na", "null", "none", "nan", "not available", "unknown", "-", "")

#: White space of any script: control characters, and the separators of Unicode.
_BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script, not only spaces."""
    return F.btrim(c, F.lit(_BLANKS))


def classify(c: Column) -> Column:
    """'numeric', 'date' or 'string' by the stripped value's form."""
    s = strip(c)
    return F.when(s.rlike(NUMERIC), "numeric").when(s.rlike(DATE), "date").otherwise("string")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def to_double(c: Column) -> Column:
    """The number that a cell spells, null for none; 'nan', 'inf' and digit groups by '_' are numbers."""
    s = strip(c)
    special = F.lower(F.regexp_replace(s, r"^[+-]", ""))
    sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(s.rlike(_FLOAT), F.regexp_replace(s, "_", "").try_cast("double"))
        .when(special == "nan", F.lit(float("nan")))
        .when(special.isin("inf", "infinity"), sign * F.lit(float("inf")))
    )


def to_integer(c: Column) -> Column:
    """The whole number that a cell spells (38 digits), null for none."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(s, "_", "").try_cast("decimal(38,0)"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.when(F.isnan(c), F.lit(low)).otherwise(c), F.lit(low)), F.lit(high))


@F.pandas_udf(T.StringType())
def general(v: pd.Series) -> pd.Series:
    """Six significant digits as C's %g; Java's differs. For issue rows only, which are few."""
    return v.map(lambda x: None if x is None else f"{x:g}")


@F.pandas_udf(T.DoubleType())
def half_even(v: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounded to even on the exact binary value, which no built-in does. For issue rows only."""
    return pd.Series([None if pd.isna(x) else round(float(x), int(d)) for x, d in zip(v, digits, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two strings from 0 to 1, which no built-in has. For matched rows only."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def quoted(c: Column) -> Column:
    """As a quoted literal: single quotes unless only double quotes avoid an escape."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def email_repair(c: Column) -> Column:
    """The lower-cased address without blanks and doubled dots if that is valid, else null."""
    fixed = F.replace(F.replace(F.lower(strip(c)), F.lit(" "), F.lit("")), F.lit(".."), F.lit("."))
    return F.when(fixed.rlike(EMAIL), fixed)


def noisy(c: Column, seed: int, key: Column, share: float = 0.15) -> Column:
    """About ``share`` of the cells with a cut end, swapped case or, for numbers, up to 2 % jitter."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    pick = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(4))
    swapped = F.transform(F.split(c, ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x)))
    number = to_double(c)
    jitter = number * (0.98 + 0.04 * F.pmod(F.xxhash64(key, F.lit(seed + 2)), F.lit(10_000)) / 10_000)
    text = F.when(pick < 3, F.expr("cast(null as string)")).otherwise(F.array_join(swapped, ""))
    cut = F.substring(c, F.lit(1), F.length(c) - 1 - pick.cast("int"))
    changed = F.when(number.isNotNull() & (number != 0), F.round(jitter, 4).cast("string")).when(F.length(c) > 3, F.coalesce(text, cut)).otherwise(c)
    return F.when(draw < share, changed).otherwise(c)


def noisy_rows(columns: list[str], seed: int, key: Column, share: float = 0.15) -> dict[str, Column]:
    """Cells of a noisy view: about ``share`` of the rows have one cell changed as by ``noisy``."""
    row = F.pmod(F.xxhash64(key, F.lit(seed + 3)), F.lit(10_000)) / 10_000 < share
    pick = F.pmod(F.xxhash64(key, F.lit(seed + 4)), F.lit(max(1, len(columns))))
    return {c: F.when(row & (pick == i), noisy(F.col(f"`{c}`").cast("string"), seed, key, 1.1)).otherwise(F.col(f"`{c}`").cast("string")) for i, c in enumerate(columns)}


def first_json_object(c: Column) -> Column:
    """The first balanced {...} of a text, by scanning depths outside quoted strings; null for none."""

    @F.pandas_udf(T.StringType())
    def find(v: pd.Series) -> pd.Series:
        import json

        def one(s: str | None) -> str | None:
            decoder, at = json.JSONDecoder(), s.find("{") if s else -1
            while at >= 0:
                try:
                    return s[at : decoder.raw_decode(s, at)[1]]
                except ValueError:
                    at = s.find("{", at + 1)
            return None

        return v.map(one)

    return find(c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)
