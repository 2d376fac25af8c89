"""Row-local and cross-table rules of an audited table, with their repairs.

Every rule is a generated expression over one pass; a row yields one issue for each rule it breaks.
Text that should be a number is parsed without failing, and a cell that doesn't parse breaks no
numeric rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EMAIL, ISO_DATE, email_repair, to_double, to_integer
from .detect import ROW

# Columns in which a blank counts, and columns that identify an entity.
IMPORTANT = ("email", "name", "first_name", "last_name", "phone", "address", "order_total", "unit_price", "quantity")
IDENTITY = ("customer_id", "product_id", "order_date", "email", "name", "first_name")
LEAST_ID, MOST_ID = 0, 9000
TOTAL_SLACK = 1.0


@dataclass(frozen=True)
class BusinessRules:
    """Limits of an order table; None, and 0 for quantities, switch a rule off."""

    max_discount_pct: float | None = None
    min_quantity: int | None = None
    max_quantity: int | None = None
    min_unit_price: float | None = None
    valid_order_year_range: tuple[int, int] | None = None


def issue(holds: Column, column: str, kind: str, confidence, fix: Column | None = None) -> Column:
    """A struct where the rule is broken, else null."""
    score = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    value = fix if fix is not None else F.lit(None)
    return F.when(holds, F.struct(F.lit(column).alias("column"), F.lit(kind).alias("type"), value.cast("string").alias("fix"), score.alias("confidence")))


def broken(df: DataFrame, checks: list[Column]) -> DataFrame:
    """(_row, column, type, fix, confidence, emit_ord) of every broken rule."""
    if not checks:
        return df.sparkSession.createDataFrame([], "_row bigint, column string, type string, fix string, confidence double, emit_ord int")
    tagged = F.array(*(F.struct(c.alias("i"), F.lit(k).alias("emit_ord")) for k, c in enumerate(checks)))
    return df.select(ROW, F.explode(tagged).alias("x")).where("x.i is not null").select(ROW, "x.i.*", "x.emit_ord")


#: Types whose cells are numbers already and need no parsing.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


#: What follows a column's name in that of its number.
PARSED = "_as_number"


def with_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the numbers that the columns spell beside them, so that each cell is parsed once for all checks."""
    return df.withColumns({c + PARSED: to_double(F.col(c).cast("string")) for c in columns})


def number(column: str, types: dict[str, str] | None = None) -> Column:
    """A cell's number; ``types``, as of ``df.dtypes``, say which columns hold numbers rather than text,
    and which have theirs beside them (``with_numbers``)."""
    if types and types.get(column + PARSED) == "double":
        return F.col(column + PARSED)
    plain = types and types.get(column, "").split("(")[0] in NUMBERS
    return F.col(column).cast("double") if plain else to_double(F.col(column).cast("string"))


def null_checks(columns: list[str]) -> list[Column]:
    return [issue(F.col(c).isNull() | (F.col(c).cast("string") == ""), c, "missing_value", 0.9) for c in columns if c in IMPORTANT]


def format_checks(types: dict[str, str], tags: dict[str, Column] | None = None) -> list[Column]:
    """Checks by declared type. ``tags`` gives a column's JSON type, where it is known ('number' in a
    phone column and anything but 'integer' in an integer column are issues); without tags an integer
    column's cell must spell a whole number."""
    out, tags = [], tags or {}
    for c, kind in types.items():
        v = F.col(c).cast("string")
        known = F.col(c).isNotNull()
        if kind == "string" and "email" in c.lower():
            out.append(issue(known & ~v.rlike(EMAIL), c, "format_error", 0.85, email_repair(v)))
        if kind == "date":
            out.append(issue(known & ~v.rlike(ISO_DATE), c, "type_mismatch", 0.9))
        if kind == "string" and "phone" in c.lower() and c in tags:
            out.append(issue(known & (tags[c] == "number"), c, "type_mismatch", 0.9))
        if kind == "integer":
            wrong = tags[c] != "integer" if c in tags else to_integer(v).isNull()
            out.append(issue(known & wrong, c, "type_mismatch", 0.9))
    return out


def cross_field_checks(category: Column | None = None, types: dict[str, str] | None = None, only: tuple[str, ...] = ()) -> list[Column]:
    """Total against quantity, price and discount; shipping before ordering; the looked-up category;
    ids out of range. ``category`` is the joined product's category; ``only`` names the columns to check."""
    n = lambda c: number(c, types)
    total = F.round(n("quantity") * n("unit_price") * (1 - n("discount_pct") / 100), 2)
    diff = F.abs(n("order_total") - total)
    order, ship, pid = F.col("order_date").cast("string"), F.col("ship_date").cast("string"), n("product_id")
    out = {
        "order_total": issue(diff > TOTAL_SLACK, "order_total", "cross_field", F.least(F.lit(1.0), diff / 10), F.format_string("%.2f", total)),
        "ship_date": issue((order != "") & (ship != "") & (ship < order), "ship_date", "cross_field", 0.95, order),
        "product_id": issue((pid < LEAST_ID) | (pid > MOST_ID), "product_id", "referential_integrity", 1.0),
    }
    if category is not None:
        out["product_category"] = issue((category != "") & (F.col("product_category") != "") & (category != F.col("product_category")), "product_category", "cross_field", 0.98, category)
    return [out[c] for c in ("order_total", "ship_date", "product_category", "product_id") if c in out and (not only or c in only)]


def business_checks(rules: BusinessRules, types: dict[str, str] | None = None) -> list[Column]:
    """Clamps to the limits that the rules give; for ``types`` see ``number``."""
    n, out = lambda c: number(c, types), []
    if rules.max_discount_pct is not None:
        out += [issue(n("discount_pct") > rules.max_discount_pct, "discount_pct", "business_rule", 1.0, F.lit(str(rules.max_discount_pct))), issue(n("discount_pct") < 0, "discount_pct", "business_rule", 1.0, F.lit("0"))]
    whole = F.when(n("quantity") >= 0, F.floor(n("quantity"))).otherwise(F.ceil(n("quantity")))
    if rules.max_quantity:
        out.append(issue(whole > rules.max_quantity, "quantity", "business_rule", 1.0, F.lit(str(rules.max_quantity))))
    if rules.min_quantity:
        out.append(issue(whole < rules.min_quantity, "quantity", "business_rule", 1.0, F.lit(str(rules.min_quantity))))
    if rules.min_unit_price is not None:
        out.append(issue(n("unit_price") < rules.min_unit_price, "unit_price", "business_rule", 1.0, F.lit(f"{rules.min_unit_price:.2f}")))
    if rules.valid_order_year_range:
        date, last = F.col("order_date").cast("string"), rules.valid_order_year_range[1]
        out.append(issue(F.substring(date, 1, 4).try_cast("int") > last, "order_date", "business_rule", 1.0, F.concat(F.lit(str(last)), F.substring(date, F.lit(5), F.length(date)))))
    return out


def with_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with the category of their product; of products with one id the last row counts."""
    one = products.groupBy("product_id").agg(F.max_by("category", ROW).alias("real_category"))
    return orders.join(one, "product_id", "left")


def orphans(orders: DataFrame, products: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no row of the other table."""
    return orders.join(products.select(key).distinct(), key, "left_anti")


def identity_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c in IDENTITY] or columns[:3]


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows after the first of their key, with that first row; nulls equal each other.

    One aggregate and a join, so that a key with many rows isn't sorted in one task.
    """
    k = [F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(f"k{i}") for i, c in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(ROW, *k)
    first = rows.groupBy(*names).agg(F.min(ROW).alias("dup_of"), F.count("*").alias("n")).where("n > 1").drop("n")
    hit = rows.join(first, names).where(F.col(ROW) > F.col("dup_of"))
    return hit.select(ROW, F.lit("_row").alias("column"), F.lit("duplicate").alias("type"), F.lit("DELETE_ROW").alias("fix"), F.lit(0.95).alias("confidence"), "dup_of")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): the keys of more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def similar_entities(df: DataFrame, text: str, most: int = 2) -> DataFrame:
    """(a, b, distance) of rows whose texts differ by 1 to ``most`` edits; equal texts are met once, by
    their first row.

    Exact without comparing all pairs: of ``most`` + 1 pieces that a text is cut into, edits leave one
    intact, which stands in the other text at most ``most`` places further or back. So texts meet by
    (length, piece number, piece), and only those that share one are compared.
    """
    one = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.min(ROW).alias("r")).withColumn("n", F.length("t"))
    cut = lambda i, n: F.floor(n * i / F.lit(most + 1)).cast("int")
    piece = lambda i: F.struct(F.lit(i).alias("i"), F.substring(F.col("t"), cut(i, F.col("n")) + 1, cut(i + 1, F.col("n")) - cut(i, F.col("n"))).alias("piece"))
    pieces = one.select("t", "r", F.col("n").alias("length"), F.explode(F.array(*(piece(i) for i in range(most + 1)))).alias("x")).select("t", "r", "length", "x.*")
    spans = F.array(*(F.struct((F.col("n") + d).alias("length"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d in range(-most, most + 1) for i in range(most + 1) for s in range(-most, most + 1)))
    other = one.select(F.col("t").alias("u"), F.col("r").alias("q"), "n", F.explode(spans).alias("x")).select("u", "q", "n", "x.*")
    start, stop = F.floor(F.col("length") * F.col("i") / (most + 1)).cast("int"), F.floor(F.col("length") * (F.col("i") + 1) / (most + 1)).cast("int")
    other = other.withColumn("at", start + F.col("shift")).withColumn("size", stop - start).where("length >= 0 and at >= 0 and at + size <= n")
    other = other.select("u", "q", "length", "i", F.substring("u", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    met = pieces.join(other, ["length", "i", "piece"]).where("r < q").select("t", "r", "u", "q").distinct()
    return met.withColumn("distance", F.levenshtein("t", "u")).where((F.col("distance") >= 1) & (F.col("distance") <= most)).select(F.col("r").alias("a"), F.col("q").alias("b"), "distance")


def same_person(df: DataFrame, name: str, email: str, phone: str) -> DataFrame:
    """(a, b, why): rows after the first that share an e-mail, the digits of a phone number, or a name
    with its words in any order."""
    digits = F.regexp_replace(F.col(phone), "[^0-9]", "")
    words = F.array_join(F.array_sort(F.split(F.lower(F.col(name)), r"\s+")), " ")
    keyed = df.select(ROW, F.explode(F.array(F.struct(F.lit("email").alias("why"), F.lower(F.col(email)).alias("k")), F.struct(F.lit("phone").alias("why"), digits.alias("k")), F.struct(F.lit("name").alias("why"), words.alias("k")))).alias("x")).select(ROW, "x.*").where("k <> ''")
    first = keyed.groupBy("why", "k").agg(F.min(ROW).alias("a"))
    return keyed.join(first, ["why", "k"]).where(F.col(ROW) > F.col("a")).select("a", F.col(ROW).alias("b"), "why")


def best_confidence(issues: DataFrame, order: str = "emit_ord") -> DataFrame:
    """One issue a cell: the surest, the earlier on ties."""
    return issues.withColumn("rn", F.row_number().over(Window.partitionBy(ROW, "column").orderBy(F.desc("confidence"), order))).where("rn = 1").drop("rn")


def within_budget(issues: DataFrame, steps: int) -> DataFrame:
    """The surest issues for which an audit's step budget suffices: a diagnosis and, with a fix, a repair
    each, and one step to finish. A top-k report, so one ordered pass over the issues alone."""
    cost = F.when(F.col("fix").isNotNull(), 2).otherwise(1)
    order = Window.orderBy(F.desc("confidence"), "emit_ord", ROW, "column")
    top = issues.orderBy(F.desc("confidence"), "emit_ord", ROW, "column").limit(steps)
    return top.withColumn("spent", F.sum(cost).over(order)).where(F.col("spent") <= steps - 1)
