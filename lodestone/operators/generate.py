"""Seeded audit tables with planted, labelled errors.

Rows come from ``range`` and hash expressions, so any size is generated in parallel and the same seed
gives the same table. Errors are overlays keyed by row: an overlay frame (_row, column, new_value,
type, expected) corrupts a clean table and is its ground truth.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import ROW, cells

#: The published issue types, in their order.
ISSUE_TYPES = ("missing_value", "format_error", "type_mismatch", "duplicate", "near_duplicate", "cross_field", "business_rule", "referential_integrity", "outlier")
WHOLE_ROW = "_row"
TRUTH = "_row bigint, column string, type string, expected string, original string, new_value string, ord int"

# Word lists of the generated entities.
FIRST = ("Alice", "Bruno", "Carla", "David", "Elena", "Farid", "Grace", "Hugo", "Ines", "Jonas")
LAST = ("Smith", "Garcia", "Meyer", "Rossi", "Novak", "Silva", "Khan", "Olsen", "Tanaka", "Brown")
CITIES = ("Lyon", "Porto", "Graz", "Turin", "Leeds", "Ghent", "Malmo", "Brno")
CATEGORIES = ("electronics", "home", "garden", "sports", "toys", "books")


def pick(words: tuple[str, ...], seed: int, salt: str) -> Column:
    """A word for each row, by hash."""
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(ROW, F.lit(seed), F.lit(salt)), F.lit(len(words))) + 1).cast("int"))


def draw(low: int, high: int, seed: int, salt: str) -> Column:
    """A whole number from ``low`` to ``high`` for each row, by hash."""
    return F.pmod(F.xxhash64(ROW, F.lit(seed), F.lit(salt)), F.lit(high - low + 1)) + low


def day(seed: int, salt: str, span: int = 360) -> Column:
    return F.date_add(F.lit("2023-01-01").cast("date"), draw(0, span, seed, salt).cast("int"))


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", ROW)


def clean_customers(spark: SparkSession, seed: int = 42, n: int = 50) -> DataFrame:
    first, last = pick(FIRST, seed, "first"), pick(LAST, seed, "last")
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), F.col(ROW).cast("string"), F.lit("@example.com"))
    return _rows(spark, n).select(ROW, (F.col(ROW) + 1).cast("string").alias("customer_id"), F.concat_ws(" ", first, last).alias("name"), email.alias("email"), F.format_string("+1-555-%03d-%04d", draw(100, 999, seed, "area"), draw(0, 9999, seed, "line")).alias("phone"), day(seed, "signup").cast("string").alias("signup_date"), pick(CITIES, seed, "city").alias("city"))


def clean_contacts(spark: SparkSession, seed: int = 42, n: int = 120) -> DataFrame:
    base = clean_customers(spark, seed + 1, n)
    name = F.split("name", " ")
    return base.select(ROW, F.col("customer_id").alias("contact_id"), name[0].alias("first_name"), name[1].alias("last_name"), "email", "phone", "city", F.col("signup_date").alias("created"))


def clean_products(spark: SparkSession, seed: int = 42, n: int = 42) -> DataFrame:
    return _rows(spark, n).select(ROW, (F.col(ROW) + 100).cast("string").alias("product_id"), pick(CATEGORIES, seed, "category").alias("category"), F.format_string("%.2f", draw(500, 50_000, seed, "price") / 100).alias("price"))


def clean_orders(spark: SparkSession, products: DataFrame, seed: int = 42, n: int = 250, n_products: int = 42) -> DataFrame:
    base = _rows(spark, n).withColumn("product_id", (draw(0, n_products - 1, seed, "product") + 100).cast("string"))
    joined = base.join(F.broadcast(products.select("product_id", F.col("category").alias("product_category"), F.col("price").alias("unit_price"))), "product_id")
    quantity, discount, ordered = draw(1, 20, seed, "qty"), draw(0, 6, seed, "disc") * 5, day(seed, "ordered")
    total = F.round(quantity * F.col("unit_price").cast("double") * (1 - discount / 100), 2)
    return joined.select(ROW, (F.col(ROW) + 1).cast("string").alias("order_id"), (draw(1, 50, seed, "customer")).cast("string").alias("customer_id"), "product_id", "product_category", quantity.cast("string").alias("quantity"), "unit_price", discount.cast("string").alias("discount_pct"), F.format_string("%.2f", total).alias("order_total"), ordered.cast("string").alias("order_date"), F.date_add(ordered, draw(1, 14, seed, "ship").cast("int")).cast("string").alias("ship_date"))


@dataclass(frozen=True)
class Pattern:
    """An error: the share of rows it hits (one in ``every``, at offset ``at``), the column, the bad
    value and, where a repair is known, the expected one."""

    column: str
    kind: str
    bad: Column
    expected: Column | None = None
    every: int = 40
    at: int = 0


def _hits(patterns: list[Pattern]) -> list[Column]:
    """For each pattern whether it keeps a row's cell: it hits the row, and no earlier one hits the cell."""
    hit = [F.pmod(F.col(ROW), F.lit(p.every)) == p.at for p in patterns]
    return [reduce(lambda a, b: a & ~b, (hit[j] for j in range(i) if patterns[j].column == p.column), hit[i]) for i, p in enumerate(patterns)]


def overlay(clean: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(_row, column, type, expected, original, new_value, ord) of the planted errors; the first
    pattern to hit a cell keeps it. One narrow pass: patterns depend on their row alone."""
    parts = []
    for i, (p, hit) in enumerate(zip(patterns, _hits(patterns), strict=True)):
        expected = p.expected if p.expected is not None else F.lit(None)
        parts.append(F.when(hit, F.struct(F.lit(p.column).alias("column"), F.lit(p.kind).alias("type"), expected.cast("string").alias("expected"), F.col(p.column).cast("string").alias("original"), p.bad.cast("string").alias("new_value"), F.lit(i).alias("ord"))))
    every = clean.select(ROW, F.explode(F.array(*parts)).alias("x")).where("x is not null").select(ROW, "x.*")
    return every.where(~F.col("new_value").eqNullSafe(F.col("original")))


def overlaid(clean: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """``corrupt(clean, overlay(clean, patterns))`` in one narrow pass, without joining the two."""
    found, cell = _hits(patterns), {c: F.col(c) for c in cells(clean)}
    for p, hit in zip(patterns, found, strict=True):
        cell[p.column] = F.when(hit, p.bad.cast("string")).otherwise(cell[p.column])
    return clean.select(ROW, *(c.alias(name) for name, c in cell.items()))


def corrupt(clean: DataFrame, planted: DataFrame) -> DataFrame:
    """The table with the overlay's cells; a null new_value makes a null cell."""
    maps = planted.where(F.col("column") != WHOLE_ROW).groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct(F.col("new_value").alias("v"))))).alias("_o"))
    joined = clean.join(maps, ROW, "left")
    return joined.select(ROW, *(F.when(F.element_at("_o", c).isNotNull(), F.element_at("_o", c)["v"]).otherwise(F.col(c)).alias(c) for c in cells(clean)))


def customer_patterns() -> list[Pattern]:
    return [
        Pattern("email", "format_error", F.replace(F.col("email"), F.lit("@"), F.lit(" @")), F.col("email"), 25, 3),
        Pattern("email", "missing_value", F.lit(""), None, 25, 7),
        Pattern("signup_date", "format_error", F.replace(F.col("signup_date"), F.lit("-"), F.lit("/")), F.col("signup_date"), 25, 11),
        Pattern("phone", "type_mismatch", F.regexp_replace("phone", "[^0-9]", ""), None, 25, 15),
        Pattern("name", "missing_value", F.lit(None), None, 50, 19),
    ]


def contact_patterns() -> list[Pattern]:
    return [
        Pattern("email", "near_duplicate", F.replace(F.col("email"), F.lit("example"), F.lit("exmaple")), F.col("email"), 30, 4),
        Pattern("phone", "near_duplicate", F.replace(F.col("phone"), F.lit("-"), F.lit(" ")), F.col("phone"), 30, 9),
        Pattern("first_name", "near_duplicate", F.concat(F.substring("first_name", 1, 2), F.substring(F.col("first_name"), F.lit(2), F.lit(20))), F.col("first_name"), 30, 14),
    ]


def order_patterns() -> list[Pattern]:
    qty, price, total = F.col("quantity").cast("int"), F.col("unit_price").cast("double"), F.col("order_total").cast("double")
    money = lambda c: F.format_string("%.2f", c)
    return [
        Pattern("quantity", "business_rule", (-qty).cast("string"), F.lit("1"), 50, 1),
        Pattern("order_total", "cross_field", money(total * 3.7), F.col("order_total"), 50, 5),
        Pattern("unit_price", "outlier", money(price * 10), F.col("unit_price"), 50, 9),
        Pattern("order_total", "cross_field", F.lit("0.00"), F.col("order_total"), 50, 13),
        Pattern("discount_pct", "business_rule", F.lit("95"), F.lit("50"), 50, 17),
        Pattern("ship_date", "cross_field", F.date_sub(F.col("order_date").cast("date"), 5).cast("string"), F.col("order_date"), 50, 21),
        Pattern("product_id", "referential_integrity", F.lit("9999"), None, 50, 25),
        Pattern("product_category", "cross_field", F.lit("misc"), F.col("product_category"), 50, 29),
        Pattern("quantity", "type_mismatch", F.concat(F.col("quantity"), F.lit(" pcs")), F.col("quantity"), 50, 33),
        Pattern("order_date", "format_error", F.replace(F.col("order_date"), F.lit("-"), F.lit("/")), F.col("order_date"), 50, 37),
        Pattern("customer_id", "missing_value", F.lit(None), None, 50, 41),
    ]


def with_duplicates(df: DataFrame, every: int, at: int, first_new: int) -> tuple[DataFrame, DataFrame]:
    """The table with copies of one row in ``every`` appended, and their truth."""
    copied = df.where(F.pmod(F.col(ROW), F.lit(every)) == at).withColumn("_old", F.col(ROW)).withColumn(ROW, F.floor(F.col(ROW) / every).cast("bigint") + first_new)
    truth = copied.select(ROW, F.lit(WHOLE_ROW).alias("column"), F.lit("duplicate").alias("type"), F.lit("DELETE_ROW").alias("expected"), F.col("_old").cast("string").alias("original"), F.lit(None).cast("string").alias("new_value"), F.lit(1000).alias("ord"))
    return df.unionByName(copied.drop("_old")), truth


def episode_table(spark: SparkSession, task: str, seed: int = 42, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrupted table, truth) of an audit task, of its own size or of ``rows``; an unknown task is the first."""
    if task == "task_3_integrity_auditor":
        clean, patterns = trap_rows(clean_orders(spark, clean_products(spark, seed), seed, rows or 250)), order_patterns()
    elif task == "task_2_duplicate_detective":
        clean, patterns = clean_contacts(spark, seed, rows or 120), contact_patterns()
    else:
        clean, patterns = clean_customers(spark, seed, rows or 50), customer_patterns()
    planted = overlay(clean, patterns)
    dirty = overlaid(clean, patterns)
    if task == "task_2_duplicate_detective":
        dirty, copies = with_duplicates(dirty, 24, 2, rows or 120)
        planted = planted.unionByName(copies)
    return dirty, planted


def truth_faults(truth: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Truth rows that break a rule: an unknown row, column or type, or a cell named twice; none if sound."""
    from pyspark.sql import Window

    known = rows.select(F.col(ROW).alias("_known"))
    joined = truth.join(known, truth[ROW] == F.col("_known"), "left")
    twice = F.count("*").over(Window.partitionBy(ROW, "column")) > 1
    fault = F.when(F.col("_known").isNull(), "row").when(~F.col("column").isin(*columns, WHOLE_ROW), "column").when(~F.col("type").isin(*ISSUE_TYPES), "type").when(twice, "repeated")
    return joined.withColumn("fault", fault).where("fault is not null").drop("_known")


def truth_gates(truth: DataFrame, clean: DataFrame, least_total: int = 1, least_fixable: int = 1) -> DataFrame:
    """(gate, failures) of a generated truth: enough issues and fixable ones, known types, no cell named
    twice, expected values that aren't empty, totals with a decimal point, and traps (clean rows that only
    look wrong, which the truth must not name)."""
    total = F.col("type").isin(*ISSUE_TYPES)
    money = (F.col("type") == "cross_field") & (F.col("column") == "order_total") & F.col("expected").isNotNull()
    one = truth.agg(
        F.greatest(F.lit(least_total) - F.count("*"), F.lit(0)).alias("total"),
        F.greatest(F.lit(least_fixable) - F.count("expected"), F.lit(0)).alias("fixable"),
        F.count_if(~total).alias("type"),
        F.count_if(F.col("expected") == "").alias("expected"),
        F.count_if(money & ~F.col("expected").contains(".")).alias("decimal"),
    )
    twice = truth.groupBy(ROW, "column").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    trapped = traps(clean).join(truth.select(ROW, "column"), [ROW, "column"], "left_semi").agg(F.count("*").alias("trap"))
    wide = one.crossJoin(twice).crossJoin(trapped)  # three single rows
    names = [c for c in wide.columns]
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("gate"), F.col(c).cast("bigint").alias("failures")) for c in names))).alias("x")).select("x.*")


#: One row in so many is a trap: sound, but close to a limit or of an unusual look.
TRAP_EVERY, TRAP_AT = 50, 45


def trap_rows(orders: DataFrame) -> DataFrame:
    """Orders whose trap rows look wrong and are sound: shipped on the day of the order, and a total that
    departs from its formula by less than a rounded cent."""
    at = F.pmod(F.col(ROW), F.lit(TRAP_EVERY)) == TRAP_AT
    return orders.withColumns({"ship_date": F.when(at, F.col("order_date")).otherwise(F.col("ship_date")), "order_total": F.when(at, F.format_string("%.2f", F.col("order_total").cast("double") + 0.004)).otherwise(F.col("order_total"))})


def traps(clean: DataFrame) -> DataFrame:
    """(_row, column) of the cells of trap rows."""
    at = clean.where(F.pmod(F.col(ROW), F.lit(TRAP_EVERY)) == TRAP_AT)
    return at.select(ROW, F.explode(F.array(F.lit("ship_date"), F.lit("order_total"))).alias("column"))


def truth_census(truth: DataFrame) -> DataFrame:
    """By type: issues, those with a known repair and those to be detected only."""
    return truth.groupBy("type").agg(F.count("*").alias("total"), F.count("expected").alias("fixable"), F.count_if(F.col("expected").isNull()).alias("detection_only"))


def month_end(text: Column) -> Column:
    """An ISO date with a day past its month's end moved to that end."""
    p = F.split(text, "-")
    first = F.try_to_date(F.concat_ws("-", p[0], p[1], F.lit("01")))
    return F.coalesce(F.try_to_date(text), F.last_day(first)).cast("string")
