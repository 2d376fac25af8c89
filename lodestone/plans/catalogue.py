"""The engine's operators as queries over the star-schema tables, each with its SQL equivalent.

Errors that the clean tables lack are overlaid by key arithmetic, written alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import AggregateDependency, DomainBound, FunctionalDependency, Schema
from ..functions.text import classify, is_blank, similarity
from ..operators import apply, audit, detect, policy, profile, repair, rules, score, verify
from ..operators.detect import ROW

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    return F.col(c).cast("decimal(15,2)").cast("string")


# Text tables: a key, string cells, and planted errors.

ORDERS = """o AS (SELECT o_orderkey AS _row, CAST(o_custkey AS VARCHAR) AS custkey, o_orderstatus AS status,
  CASE WHEN o_orderkey % 101 = 0 THEN 'N/A' ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS price,
  CASE WHEN o_orderkey % 97 = 5 THEN strftime(o_orderdate, '%Y%m%d-x') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS odate,
  o_orderpriority AS priority FROM orders)"""


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.when(k % 101 == 0, "N/A").otherwise(money("o_totalprice"))
    date = F.when(k % 97 == 5, F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-x"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(k.alias(ROW), F.col("o_custkey").cast("string").alias("custkey"), F.col("o_orderstatus").alias("status"), price.alias("price"), date.alias("odate"), F.col("o_orderpriority").alias("priority"))


PARTS = """p AS (SELECT p_partkey AS _row, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS VARCHAR) AS size,
  CAST(CAST(CASE WHEN p_partkey % 89 = 1 THEN p_retailprice * 10 WHEN p_partkey % 89 = 2 THEN p_retailprice * 100 WHEN p_partkey % 89 = 3 THEN p_retailprice / 10 ELSE p_retailprice END AS DECIMAL(15,2)) AS VARCHAR) AS price FROM part)"""


def parts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("p_partkey") % 89, F.col("p_retailprice")
    price = F.when(k == 1, v * 10).when(k == 2, v * 100).when(k == 3, v / 10).otherwise(v)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("size"), price.cast("decimal(15,2)").cast("string").alias("price"))


NAME_KIND = Schema(dependencies=(FunctionalDependency(("name",), "kind"),))
BRAND_SIZE_KIND = Schema(dependencies=(FunctionalDependency(("brand", "size"), "kind"),))

NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}[-/]\d{2}[-/]\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?$"
CLASS = f"CASE WHEN regexp_matches(v, '{NUM}') THEN 'numeric' WHEN regexp_matches(v, '{DATE}') THEN 'date' ELSE 'string' END"


# Detection


@query(f"WITH {ORDERS}, u AS (UNPIVOT o ON custkey, status, price, odate, priority INTO NAME col VALUE v) SELECT col AS \"column\", {CLASS} AS class, count(*) AS n FROM u WHERE v <> '' GROUP BY ALL")
def type_class_counts(spark, sf_dir):
    o = orders_text(spark, sf_dir)
    u = o.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in detect.cells(o)))).alias("x")).select("x.*").where(~is_blank(F.col("v")))
    return u.groupBy("column", classify(F.col("v")).alias("class")).agg(F.count("*").alias("n"))


MISMATCH = f"""WITH {ORDERS}, u AS (UNPIVOT o ON custkey, status, price, odate, priority INTO NAME col VALUE v), c AS (SELECT *, {CLASS} AS k FROM u WHERE v <> ''),
  n AS (SELECT col, k, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT col, sum(n) AS total, max(n) AS most, arg_max(k, n) AS main FROM n GROUP BY col)
  SELECT _row, col AS "column", v AS actual, round(least(0.95, most / total + 0.1 * (1 - (total - most) / total)), 2) AS confidence,
  CASE WHEN main = 'numeric' AND k = 'string' THEN 'Value ''' || v || ''' is non-numeric in predominantly numeric column ''' || col || ''''
    WHEN main = 'string' AND k = 'numeric' THEN 'Value ''' || v || ''' looks numeric in predominantly string column ''' || col || ''''
    WHEN main = 'string' AND k = 'date' THEN 'Value ''' || v || ''' looks like a date in predominantly string column ''' || col || ''''
    ELSE 'Value ''' || v || ''' (type: ' || k || ') conflicts with dominant type ''' || main || ''' in column ''' || col || '''' END AS reason
  FROM c JOIN t USING (col) WHERE total >= 2 AND most / total >= 0.65 AND k <> main"""


@query(MISMATCH)
def detect_type_mismatch(spark, sf_dir):
    return detect.detect_type_mismatch(orders_text(spark, sf_dir)).select(ROW, "column", "actual", "confidence", "reason")


SHIFT = """, f AS (SELECT _row, TRY_CAST(price AS DOUBLE) AS v, price FROM {t}), m AS (SELECT median(v) AS med, count(v) AS n FROM f),
  s AS (SELECT *, round(log10(abs(v / med))) AS k, log10(abs(v / med)) AS lg FROM f, m WHERE n >= 5 AND abs(med) >= 1e-10 AND abs(v) >= 1e-10)
  SELECT _row, 'price' AS "column", price AS actual, printf('%g', v / power(10.0, k)) AS expected, round(least(0.95, greatest(0.70, 1 - 2 * abs(lg - k))), 2) AS confidence
  FROM s WHERE abs(k) BETWEEN 1 AND 3 AND abs(lg - k) < 0.15"""


@query(f"WITH {ORDERS}" + SHIFT.format(t="o"))
def detect_decimal_shift(spark, sf_dir):
    return detect.detect_decimal_shift(orders_text(spark, sf_dir).select(ROW, "price")).select(ROW, "column", "actual", "expected", "confidence")


@query(f"WITH {PARTS}" + SHIFT.format(t="p"))
def decimal_shift_injected(spark, sf_dir):
    return detect.detect_decimal_shift(parts_text(spark, sf_dir).select(ROW, "price")).select(ROW, "column", "actual", "expected", "confidence")


@query(f"WITH {PARTS}, g AS (SELECT name FROM p GROUP BY name HAVING count(DISTINCT kind) > 1) SELECT _row, 'kind' AS \"column\", kind AS actual, 'UNSAFE' AS severity, 0.95::DOUBLE AS confidence FROM p SEMI JOIN g USING (name)")
def detect_fd_violation(spark, sf_dir):
    return detect.detect_fd_violation(parts_text(spark, sf_dir), NAME_KIND).select(ROW, "column", "actual", "severity", "confidence")


@query(f"WITH {PARTS}, d AS (SELECT brand, size, kind, min(_row) AS seen FROM p GROUP BY ALL), g AS (SELECT brand, size, string_agg('''' || kind || '''', ', ' ORDER BY seen) AS vals FROM d GROUP BY ALL HAVING count(*) > 1) SELECT _row, kind AS actual, 'Functional dependency (''brand'', ''size'') -> kind violated: brand=''' || brand || ''', size=''' || size || ''' maps to multiple values: {{' || vals || '}}' AS reason FROM p JOIN g USING (brand, size)".replace("{{", "{").replace("}}", "}"))
def detect_fd_violation_composite(spark, sf_dir):
    return detect.detect_fd_violation(parts_text(spark, sf_dir), BRAND_SIZE_KIND).select(ROW, "actual", "reason")


ALL = (
    f"WITH {PARTS}"
    + SHIFT.format(t="p").replace("SELECT _row, 'price' AS \"column\"", ", x AS (SELECT _row, 'price' AS \"column\"").rstrip()
    + """ UNION ALL SELECT _row, 'kind', kind, NULL, 0.95 FROM p WHERE name IN (SELECT name FROM p GROUP BY name HAVING count(DISTINCT kind) > 1)),
  i AS (SELECT *, CASE WHEN "column" = 'kind' THEN 'fd_violation' ELSE 'decimal_shift' END AS issue_type, CASE WHEN "column" = 'kind' THEN 'UNSAFE' ELSE 'REVIEW' END AS severity FROM x)"""
)


def _part_issues(spark, sf_dir):
    return detect.detect_all(parts_text(spark, sf_dir).select(ROW, "name", "kind", "price"), NAME_KIND)


@query(ALL + " SELECT _row, \"column\", issue_type, severity, confidence, expected FROM i")
def detect_all_sorted(spark, sf_dir):
    return detect.sort_issues(_part_issues(spark, sf_dir)).select(ROW, "column", "issue_type", "severity", "confidence", "expected")


@query(ALL + " SELECT \"column\", issue_type, severity, count(DISTINCT _row) AS n, min(_row) AS first_row, max(_row) AS last_row FROM i GROUP BY ALL")
def issue_summary(spark, sf_dir):
    return detect.summarize(_part_issues(spark, sf_dir)).select("column", "issue_type", "severity", "n", "first_row", "last_row")


@query(ALL + " SELECT severity, count(*) AS n FROM i GROUP BY severity")
def severity_counts(spark, sf_dir):
    return detect.severity_counts(_part_issues(spark, sf_dir))


@query(ALL + " SELECT bool_or(severity = 'UNSAFE') AS unsafe FROM i")
def profile_exit_status(spark, sf_dir):
    return detect.has_unsafe(_part_issues(spark, sf_dir))


# Repair

EVENTS = "e AS (SELECT event_id AS _row, CAST(user_id AS VARCHAR) AS usr, event_type AS kind FROM events)"
USER_KIND = Schema(dependencies=(FunctionalDependency(("usr",), "kind"),))


def events_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias(ROW), F.col("user_id").cast("string").alias("usr"), F.col("event_type").alias("kind"))


MAJORITY = f"WITH {EVENTS}, n AS (SELECT usr, kind, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY usr ORDER BY n DESC) AS rk, count(*) OVER (PARTITION BY usr) AS d FROM n), w AS (SELECT usr, min(kind) AS majority, count(*) AS winners FROM r WHERE rk = 1 AND d > 1 GROUP BY usr)"


@query(MAJORITY + " SELECT _row, kind AS old_value, majority AS new_value FROM e JOIN w USING (usr) WHERE winners = 1 AND kind <> majority")
def fd_majority_repair(spark, sf_dir):
    e = events_text(spark, sf_dir)
    return repair.repair_fd_violation(detect.detect_fd_violation(e, USER_KIND).where("true"), e, USER_KIND).select(ROW, "old_value", "new_value")


@query(MAJORITY + " SELECT usr FROM w WHERE winners > 1")
def fd_tied_groups(spark, sf_dir):
    return repair.majorities(events_text(spark, sf_dir), ("usr",), "kind").where("majority is null").select(F.col("k0").alias("usr"))


@query(f"WITH {PARTS}" + SHIFT.format(t="p").replace("SELECT _row, 'price' AS \"column\", price AS actual, printf('%g', v / power(10.0, k)) AS expected, round(least(0.95, greatest(0.70, 1 - 2 * abs(lg - k))), 2) AS confidence", "SELECT _row, price AS old_value, printf('%g', v / power(10.0, k)) AS new_value") + " AND price <> printf('%g', v / power(10.0, k))")
def repair_decimal_shift(spark, sf_dir):
    p = parts_text(spark, sf_dir).select(ROW, "price")
    return repair.repair_decimal_shift(detect.detect_decimal_shift(p), p).select(ROW, "old_value", "new_value")


@query(f"WITH {ORDERS} SELECT _row, 'price' AS \"column\", price AS old_value, '' AS new_value FROM o WHERE lower(trim(price)) IN ('n/a', 'na', 'null', 'none', 'nan', 'not available', 'unknown', '-')")
def repair_sentinel(spark, sf_dir):
    o = orders_text(spark, sf_dir).select(ROW, "price", "priority")
    return repair.repair_type_mismatch(detect.detect_type_mismatch(o), o).select(ROW, "column", "old_value", "new_value")


PROPOSED = (
    f"WITH {PARTS}"
    + SHIFT.format(t="p").replace("SELECT _row, 'price' AS \"column\", price AS actual, printf('%g', v / power(10.0, k)) AS expected, round(least(0.95, greatest(0.70, 1 - 2 * abs(lg - k))), 2) AS confidence", ", c AS (SELECT _row, 'price' AS \"column\", price AS old_value, printf('%g', v / power(10.0, k)) AS new_value")
    + """ AND price <> printf('%g', v / power(10.0, k))), n AS (SELECT name, kind, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY name ORDER BY n DESC) AS rk, count(*) OVER (PARTITION BY name) AS d FROM n),
  w AS (SELECT name, min(kind) AS majority, count(*) AS winners FROM r WHERE rk = 1 AND d > 1 GROUP BY name), x AS (SELECT * FROM c UNION ALL SELECT _row, 'kind', kind, majority FROM p JOIN w USING (name) WHERE winners = 1 AND kind <> majority)"""
)


def _part_fixes(spark, sf_dir):
    p = parts_text(spark, sf_dir).select(ROW, "name", "kind", "price")
    return repair.propose(detect.detect_all(p, NAME_KIND), p, NAME_KIND)


@query(PROPOSED + " SELECT * FROM x")
def propose_fixes_dedup(spark, sf_dir):
    return _part_fixes(spark, sf_dir).select(ROW, "column", "old_value", "new_value")


# Safety and verification

FIXES = """f AS (SELECT o_orderkey AS _row, CASE o_orderkey % 4 WHEN 0 THEN 'phone' WHEN 1 THEN 'amount' WHEN 2 THEN 'note' ELSE 'city' END AS "column",
  o_orderstatus AS old_value, o_orderpriority AS new_value, CASE WHEN o_orderkey % 10 = 7 THEN 'delete_row' ELSE 'update' END AS operation FROM orders)"""
GUARDED = Schema(pii=frozenset({"phone"}), aggregates=(AggregateDependency("amount", "total", "sum"),))


def fixes_of_orders(spark, sf_dir):
    k = F.col("o_orderkey")
    column = F.when(k % 4 == 0, "phone").when(k % 4 == 1, "amount").when(k % 4 == 2, "note").otherwise("city")
    return table(spark, sf_dir, "orders").select(k.alias(ROW), column.alias("column"), F.col("o_orderstatus").alias("old_value"), F.col("o_orderpriority").alias("new_value"), F.when(k % 10 == 7, "delete_row").otherwise("update").alias("operation"))


def _verdicts(pii: str, confirm: bool) -> str:
    first = {"deny": "WHEN \"column\" = 'phone' THEN 'DENY:NO_PII_OVERWRITE'", "ask": "WHEN \"column\" = 'phone' THEN 'ESCALATE:NO_PII_OVERWRITE'", "skip": ""}[pii]
    last = "" if confirm else "WHEN \"column\" = 'amount' THEN 'ESCALATE:NO_AGGREGATE_BREAK'"
    return f"WITH {FIXES}, v AS (SELECT _row, CASE {first} WHEN operation = 'delete_row' THEN 'DENY:NO_ROW_DELETE' {last} ELSE 'ALLOW:' END AS x FROM f) SELECT _row, split_part(x, ':', 1) AS verdict, nullif(split_part(x, ':', 2), '') AS rule_id FROM v"


@query(_verdicts("deny", False))
def safety_verdicts(spark, sf_dir):
    return policy.evaluate(fixes_of_orders(spark, sf_dir), GUARDED).select(ROW, "verdict", "rule_id")


@query(_verdicts("ask", True))
def safety_verdicts_unconfirmed_override(spark, sf_dir):
    return policy.evaluate(fixes_of_orders(spark, sf_dir), GUARDED, policy.Context(allow_pii=True, confirm_escalations=True)).select(ROW, "verdict", "rule_id")


@query(_verdicts("skip", True))
def safety_verdicts_confirmed_override(spark, sf_dir):
    return policy.evaluate(fixes_of_orders(spark, sf_dir), GUARDED, policy.Context(True, True, True)).select(ROW, "verdict", "rule_id")


@query("SELECT l_orderkey AS _row, 'flag' AS \"column\", count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def batch_conflicts(spark, sf_dir):
    return policy.conflicting_writes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(ROW), F.lit("flag").alias("column"), F.col("l_returnflag").alias("new_value")))


@query("""WITH c AS (SELECT p_partkey AS _row, p_name AS old_value, p_brand AS new_value, 0 AS seq FROM part UNION ALL SELECT p_partkey, p_name, p_type, 1 FROM part),
  s AS (SELECT *, levenshtein(old_value, new_value) AS distance FROM c) SELECT _row, new_value, CAST(distance AS INTEGER) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY _row ORDER BY distance, seq) = 1""")
def minimal_edit_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = lambda c, i: p.select(F.col("p_partkey").alias(ROW), F.lit("name").alias("column"), F.col("p_name").alias("old_value"), F.col(c).alias("new_value"), F.lit(i).alias("seq"))
    return repair.prefer_minimal_edit(one("p_brand", 0).unionAll(one("p_type", 1))).select(ROW, "new_value", "distance")


def _candidates(p: DataFrame, column: str, new) -> DataFrame:
    return p.select(ROW, F.lit(column).alias("column"), F.col(column).alias("old_value"), new.alias("new_value"), F.lit("update").alias("operation"))


@query("""WITH c AS (SELECT p_partkey AS _row, CAST(CAST(p_size + 10 AS INTEGER) AS VARCHAR) AS new_value FROM part)
  SELECT _row, new_value, CASE WHEN CAST(new_value AS INTEGER) BETWEEN 12 AND 49 THEN 'ACCEPT' ELSE 'REJECT' END AS verification,
  CASE WHEN CAST(new_value AS INTEGER) < 12 THEN 'Row ' || _row || ' would violate the minimum bound for column ''size''.' WHEN CAST(new_value AS INTEGER) > 49 THEN 'Row ' || _row || ' would violate the maximum bound for column ''size''.' END AS explanation FROM c""")
def verify_domain_bounds(spark, sf_dir):
    p = parts_text(spark, sf_dir).select(ROW, "size")
    schema = Schema(columns={"size": "int"}, bounds=(DomainBound("size", 12, 50, True, False),))
    got = verify.verify(p, _candidates(p, "size", (F.col("size").cast("int") + 10).cast("string")), schema)
    return got.select(ROW, "new_value", "verification", F.when(F.col("verification") == "REJECT", verify.explain(F.col("unsat_core"))).alias("explanation"))


@query(f"""WITH {PARTS}, c AS (SELECT _row, name, brand, size, CASE WHEN _row % 2 = 0 THEN kind ELSE 'ECONOMY' END AS new_value FROM p)
  SELECT c._row, new_value, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q._row <> c._row AND q.brand = c.brand AND q.size = c.size AND q.kind <> c.new_value) THEN 'REJECT' ELSE 'ACCEPT' END AS verification FROM c""")
def verify_fd(spark, sf_dir):
    p = parts_text(spark, sf_dir)
    return verify.verify(p, _candidates(p, "kind", F.when(F.col(ROW) % 2 == 0, F.col("kind")).otherwise("ECONOMY")), BRAND_SIZE_KIND).select(ROW, "new_value", "verification")


@query(f"""WITH {PARTS}, c AS (SELECT _row, kind, size, 'Brand#' || (_row % 25 + 1) AS new_value FROM p)
  SELECT c._row, new_value, CASE WHEN EXISTS (SELECT 1 FROM p q WHERE q._row <> c._row AND q.brand = c.new_value AND q.size = c.size AND q.kind <> c.kind) THEN 'REJECT' ELSE 'ACCEPT' END AS verification FROM c""")
def verify_fd_determinant(spark, sf_dir):
    p = parts_text(spark, sf_dir)
    new = F.concat(F.lit("Brand#"), (F.col(ROW) % 25 + 1).cast("string"))
    return verify.verify(p, p.select(ROW, F.lit("brand").alias("column"), F.col("brand").alias("old_value"), new.alias("new_value"), F.lit("update").alias("operation")), BRAND_SIZE_KIND).select(ROW, "new_value", "verification")


@query(f"""WITH {ORDERS}, b AS (SELECT count(*) FILTER (TRY_CAST(price AS DOUBLE) IS NULL) AS bad FROM o)
  SELECT _row, CASE WHEN (SELECT bad FROM b) - CASE WHEN TRY_CAST(price AS DOUBLE) IS NULL THEN 1 ELSE 0 END + 0 > 0 THEN 'UNKNOWN' ELSE 'ACCEPT' END AS verification FROM o""")
def verify_types(spark, sf_dir):
    o = orders_text(spark, sf_dir).select(ROW, "price")
    return verify.verify(o, _candidates(o, "price", F.lit("12.50")), Schema(columns={"price": "float"})).select(ROW, "verification")


GROUPS = """t AS (SELECT p_partkey AS _row, 'g' || (p_partkey // 10) AS grp, CASE WHEN (p_partkey // 10) % 3 = 0 AND p_partkey % 10 = 4 THEN 'odd' WHEN (p_partkey // 10) % 3 = 1 AND p_partkey % 10 IN (4, 5) THEN 'odd' ELSE 'even' END AS val FROM part)"""


@query(f"WITH {GROUPS}, c AS (SELECT grp, val, count(*) AS n FROM t GROUP BY grp, val), n AS (SELECT *, sum(n) OVER (PARTITION BY grp) AS total FROM c), w AS (SELECT grp, val AS majority FROM n WHERE total - n = 1 AND n > 1) SELECT _row, val AS old_value, majority AS new_value FROM t JOIN w USING (grp) WHERE val <> majority")
def repair_accept_pipeline(spark, sf_dir):
    k = F.col("p_partkey")
    grp, pos = F.floor(k / 10), k % 10
    val = F.when((grp % 3 == 0) & (pos == 4), "odd").when((grp % 3 == 1) & pos.isin(4, 5), "odd").otherwise("even")
    t = table(spark, sf_dir, "part").select(k.alias(ROW), F.concat(F.lit("g"), grp.cast("string")).alias("grp"), val.alias("val"))
    schema = Schema(dependencies=(FunctionalDependency(("grp",), "val"),))
    return apply.accepted(t, detect.detect_fd_violation(t, schema), schema).select(ROW, "old_value", "new_value")


# Apply and score


@query("SELECT o_orderkey AS _row, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 AND o_orderpriority = '5-LOW' THEN 'none' ELSE o_orderpriority END AS priority FROM orders")
def apply_fixes(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    fixes = t.where(F.col(ROW) % 3 == 0).select(ROW, F.lit("status").alias("column"), F.col("status").alias("old_value"), F.lit("F").alias("new_value"))
    stale = t.where(F.col(ROW) % 5 == 0).select(ROW, F.lit("priority").alias("column"), F.lit("5-LOW").alias("old_value"), F.lit("none").alias("new_value"))
    return apply.apply_fixes(t, fixes.unionAll(stale))


@query("SELECT o_orderkey AS _row, 'priority' AS \"column\", o_orderpriority AS current_value FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority <> '5-LOW'")
def stale_fixes(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_orderpriority").alias("priority"))
    fixes = t.where(F.col(ROW) % 5 == 0).select(ROW, F.lit("priority").alias("column"), F.lit("5-LOW").alias("old_value"), F.lit("none").alias("new_value"))
    return apply.stale_fixes(t, fixes).select(ROW, "column", "current_value")


def _dirty_clean(spark, sf_dir):
    clean = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ROW), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), money("c_acctbal").alias("balance"))
    k = F.col(ROW)
    dirty = clean.select(ROW, F.when(k % 11 == 2, F.lower("name")).otherwise(F.col("name")).alias("name"), F.when(k % 13 == 3, "").otherwise(F.col("segment")).alias("segment"), F.when(k % 17 == 4, F.concat("balance", F.lit("0"))).otherwise(F.col("balance")).alias("balance"))
    return dirty, clean


TRUTH = """c AS (SELECT c_custkey AS _row, c_name AS name, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS balance FROM customer),
  truth AS (SELECT _row, 'name' AS "column", lower(name) AS dirty_value, name AS clean_value FROM c WHERE _row % 11 = 2 AND lower(name) <> name
  UNION ALL SELECT _row, 'segment', '', segment FROM c WHERE _row % 13 = 3 UNION ALL SELECT _row, 'balance', balance || '0', balance FROM c WHERE _row % 17 = 4)"""


@query(f"WITH {TRUTH} SELECT * FROM truth")
def cell_diff_truth(spark, sf_dir):
    return score.cell_diff(*_dirty_clean(spark, sf_dir))


PREDICTED = TRUTH + """, pred AS (SELECT _row, "column", CASE WHEN _row % 2 = 0 THEN clean_value ELSE 'x' END AS new_value FROM truth WHERE _row % 3 <> 0
  UNION ALL SELECT _row, 'name', 'y' FROM c WHERE _row % 29 = 1 AND _row % 11 <> 2),
  j AS (SELECT coalesce(t."column", p."column") AS "column", t._row IS NOT NULL AS it, p._row IS NOT NULL AS ip, coalesce(t.clean_value = p.new_value, false) AS good FROM truth t FULL JOIN pred p ON t._row = p._row AND t."column" = p."column"),
  k AS (SELECT {g} count(*) FILTER (good) AS tp, count(*) FILTER (ip AND NOT good) AS fp, count(*) FILTER (it AND NOT good) AS fn FROM j {by}),
  r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM k)
  SELECT {g} tp, fp, fn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r"""


def _predictions(spark, sf_dir):
    dirty, clean = _dirty_clean(spark, sf_dir)
    truth, k = score.cell_diff(dirty, clean), F.col(ROW)
    good = truth.where(k % 3 != 0).select(ROW, "column", F.when(k % 2 == 0, F.col("clean_value")).otherwise("x").alias("new_value"))
    return truth, good.unionAll(clean.where((k % 29 == 1) & (k % 11 != 2)).select(ROW, F.lit("name"), F.lit("y")))


@query("WITH " + PREDICTED.format(g="", by=""))
def score_repairs(spark, sf_dir):
    return score.rates(score.counted(*_predictions(spark, sf_dir)))


@query("WITH " + PREDICTED.format(g='"column",', by="GROUP BY ALL"))
def score_by_group(spark, sf_dir):
    truth, predicted = _predictions(spark, sf_dir)
    both = score.counted(truth.withColumn("g", F.col("column")), predicted.withColumn("g", F.col("column")), ["g"])
    return score.rates(both).withColumnRenamed("g", "column")


@query("SELECT event_type, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, min(value) AS min, max(value) AS max, median(value) AS median, count(value) AS n FROM events GROUP BY event_type")
def stats_summary(spark, sf_dir):
    return score.summary(table(spark, sf_dir, "events"), "value", ["event_type"])


RUNS = "r AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, CASE WHEN o_orderpriority = '5-LOW' OR o_orderkey % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN o_orderpriority = '5-LOW' OR o_orderkey % 7 = 0 THEN 'no provider' END AS skip_reason, (o_orderkey % 100) / 100.0 AS f1, (o_orderkey % 50) / 50.0 AS recall FROM orders)"


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    skipped = (F.col("o_orderpriority") == "5-LOW") | (k % 7 == 0)
    zero = F.lit(0.0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("dataset"), F.when(skipped, "skipped").otherwise("ok").alias("status"), F.when(skipped, "no provider").alias("skip_reason"), zero.alias("precision"), ((k % 50) / 50.0).alias("recall"), ((k % 100) / 100.0).alias("f1"), zero.alias("avg_steps"), zero.alias("quota_units"), zero.alias("runtime_s"))


@query(f"WITH {RUNS} SELECT method, dataset, CASE WHEN count(*) FILTER (status = 'ok') > 0 THEN 'ok' ELSE 'skipped' END AS status, count(*) FILTER (status = 'ok') AS seeds_completed, round(avg(f1) FILTER (status = 'ok'), 4) AS f1_mean, round(stddev_samp(f1) FILTER (status = 'ok'), 4) AS f1_std, CASE WHEN count(*) FILTER (status = 'ok') = 0 THEN min(skip_reason) END AS skip_reason FROM r GROUP BY ALL")
def aggregate_runs(spark, sf_dir):
    return score.aggregate_runs(_runs(spark, sf_dir)).select("method", "dataset", "status", "seeds_completed", "f1_mean", "f1_std", "skip_reason")


@query(f"WITH {RUNS}, a AS (SELECT method, dataset, round(avg(f1) FILTER (status = 'ok'), 4) AS f, round(avg(recall) FILTER (status = 'ok'), 4) AS q FROM r GROUP BY ALL) SELECT method, CASE WHEN count(f) > 0 THEN 'ok' ELSE 'skipped' END AS status, round(avg(f), 4) AS f1, round(avg(q), 4) AS recall FROM a GROUP BY method")
def across_datasets(spark, sf_dir):
    return score.across_datasets(score.aggregate_runs(_runs(spark, sf_dir))).select("method", "status", "f1", "recall")


@query("SELECT o_orderkey, round(greatest((o_orderkey % 700) / 1000, floor(o_totalprice / 10) * 10 / 100000), 4) AS quota FROM orders")
def quota_units(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", score.quota_units(F.col("o_orderkey") % 700, F.floor(F.col("o_totalprice") / 10) * 10).alias("quota"))


@query("SELECT l_orderkey AS _row, l_returnflag AS \"column\", max(l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey) AS seq FROM lineitem GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    seq = F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return apply.last_writes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(ROW), F.col("l_returnflag").alias("column"), seq.alias("seq")).distinct()).select(ROW, "column", "seq")


@query("SELECT user_id AS _row, event_type AS \"column\", value AS confidence, event_id AS emit_ord FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def best_confidence(spark, sf_dir):
    return rules.best_confidence(table(spark, sf_dir, "events").select(F.col("user_id").alias(ROW), F.col("event_type").alias("column"), F.col("value").alias("confidence"), F.col("event_id").alias("emit_ord")))


@query("WITH n AS (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS size FROM orders) SELECT o_orderkey // size AS chunk, count(*) AS n, min(o_orderkey) AS first FROM orders, n GROUP BY ALL")
def chunk_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW))
    return score.with_chunks(o, o.count()).groupBy("chunk").agg(F.count("*").alias("n"), F.min(ROW).alias("first"))


def _profile_sql(columns: list[str]) -> str:
    one = lambda c: f"SELECT '{c}' AS \"column\", count(*) AS total, count(nullif({c}, '')) AS non_null, count(*) - count(nullif({c}, '')) AS null_count, count(DISTINCT nullif({c}, '')) AS unique_count, min(TRY_CAST({c} AS DOUBLE)) AS min, max(TRY_CAST({c} AS DOUBLE)) AS max, round(avg(TRY_CAST({c} AS DOUBLE)), 4) AS mean FROM d"
    return " UNION ALL ".join(map(one, columns))


DIRTY = "c AS (SELECT c_custkey AS _row, c_name AS name, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS balance FROM customer), d AS (SELECT _row, name, CASE WHEN _row % 13 = 3 THEN '' ELSE segment END AS segment, balance FROM c)"


@query(f"WITH {DIRTY} {_profile_sql(['name', 'segment', 'balance'])}")
def column_profile(spark, sf_dir):
    return profile.column_profile(_dirty(spark, sf_dir)).drop("type")


def _dirty(spark, sf_dir):
    _, clean = _dirty_clean(spark, sf_dir)
    return clean.withColumn("segment", F.when(F.col(ROW) % 13 == 3, "").otherwise(F.col("segment")))


@query(f"WITH {DIRTY} SELECT 'segment' AS \"column\", count(nullif(segment, '')) AS non_empty_count, count(DISTINCT nullif(segment, '')) AS unique_count, round(median(TRY_CAST(segment AS DOUBLE)), 4) AS median FROM d UNION ALL SELECT 'balance', count(balance), count(DISTINCT balance), round(median(TRY_CAST(balance AS DOUBLE)), 4) FROM d")
def bench_column_statistics(spark, sf_dir):
    return profile.bench_statistics(_dirty(spark, sf_dir), ["segment", "balance"])


@query(f"WITH {DIRTY} SELECT _row, segment AS value FROM d WHERE segment <> '' ORDER BY _row LIMIT 5")
def sample_values(spark, sf_dir):
    return profile.sample_values(_dirty(spark, sf_dir), "segment")


# Rules

PEOPLE = """t AS (SELECT c_custkey AS _row, CASE WHEN c_custkey % 31 = 1 THEN '' WHEN c_custkey % 31 = 2 THEN NULL ELSE c_name END AS name,
  CASE c_custkey % 7 WHEN 0 THEN 'User ' || c_custkey || '@Mail..example.com' WHEN 1 THEN 'no at sign' ELSE 'u' || c_custkey || '@example.com' END AS email,
  CASE WHEN c_custkey % 19 = 4 THEN '2024/01/02' ELSE '2024-01-02' END AS joined, CASE WHEN c_custkey % 23 = 5 THEN 'twelve' ELSE CAST(c_nationkey AS VARCHAR) END AS visits FROM customer)"""


def people(spark, sf_dir):
    k, c = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(k % 31 == 1, "").when(k % 31 == 2, F.lit(None)).otherwise(F.col("c_name"))
    email = F.when(k % 7 == 0, F.concat(F.lit("User "), c, F.lit("@Mail..example.com"))).when(k % 7 == 1, "no at sign").otherwise(F.concat(F.lit("u"), c, F.lit("@example.com")))
    return table(spark, sf_dir, "customer").select(k.alias(ROW), name.alias("name"), email.alias("email"), F.when(k % 19 == 4, "2024/01/02").otherwise("2024-01-02").alias("joined"), F.when(k % 23 == 5, "twelve").otherwise(F.col("c_nationkey").cast("string")).alias("visits"))


@query(f"WITH {PEOPLE} SELECT _row, 'name' AS \"column\", 'missing_value' AS type, 0.9::DOUBLE AS confidence FROM t WHERE name IS NULL OR name = ''")
def detect_nulls(spark, sf_dir):
    return rules.broken(people(spark, sf_dir), rules.null_checks(["name", "email", "visits"])).select(ROW, "column", "type", "confidence")


EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}$"


@query(
    f"WITH {PEOPLE}, f AS (SELECT *, replace(replace(lower(trim(email)), ' ', ''), '..', '.') AS fixed FROM t) SELECT _row, 'email' AS \"column\", 'format_error' AS type, CASE WHEN regexp_matches(fixed, '{EMAIL}') THEN fixed END AS fix, 0.85::DOUBLE AS confidence FROM f WHERE NOT regexp_matches(email, '{EMAIL}')"
    " UNION ALL SELECT _row, 'joined', 'type_mismatch', NULL, 0.9 FROM t WHERE NOT regexp_matches(joined, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') UNION ALL SELECT _row, 'visits', 'type_mismatch', NULL, 0.9 FROM t WHERE TRY_CAST(visits AS INTEGER) IS NULL"
)
def detect_format_errors(spark, sf_dir):
    t = people(spark, sf_dir)
    return rules.broken(t, rules.format_checks({"email": "string", "joined": "date", "visits": "integer"})).select(ROW, "column", "type", "fix", "confidence")


@query("SELECT doc_id AS _row, min(doc_id) OVER (PARTITION BY text) AS dup_of FROM documents QUALIFY doc_id > min(doc_id) OVER (PARTITION BY text)")
def detect_exact_duplicates(spark, sf_dir):
    return rules.duplicates(table(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), "text"), ["text"]).select(ROW, "dup_of")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_line_keys(spark, sf_dir):
    return rules.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH t AS (SELECT min(p_partkey) AS r, CASE WHEN p_partkey % 9 = 0 THEN replace(p_name, 'e', '') ELSE p_name END AS t FROM part GROUP BY ALL)
  SELECT x.r AS a, y.r AS b, CAST(levenshtein(x.t, y.t) AS INTEGER) AS distance FROM t x JOIN t y ON x.r < y.r WHERE abs(length(x.t) - length(y.t)) <= 2 AND levenshtein(x.t, y.t) BETWEEN 1 AND 2""")
def detect_near_duplicates(spark, sf_dir):
    t = F.when(F.col("p_partkey") % 9 == 0, F.replace(F.col("p_name"), F.lit("e"), F.lit(""))).otherwise(F.col("p_name"))
    return rules.similar_entities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias(ROW), t.alias("t")), "t")


LINES = """t AS (SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS _row, l_partkey AS product_id, l_quantity AS quantity, round(l_extendedprice / l_quantity, 2) AS unit_price, l_discount * 100 AS discount_pct,
  CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice * 2 ELSE round(l_quantity * round(l_extendedprice / l_quantity, 2) * (1 - l_discount * 100 / 100), 2) END AS order_total, strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(l_shipdate, '%Y-%m-%d') AS ship_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def lines(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    price, disc = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_discount") * 100
    total = F.when(F.col("l_partkey") % 5 == 0, F.col("l_extendedprice") * 2).otherwise(F.round(F.col("l_quantity") * price * (1 - disc / 100), 2))
    key = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return j.select(key.alias(ROW), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), price.alias("unit_price"), disc.alias("discount_pct"), total.alias("order_total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"))


@query(f"WITH {LINES}, f AS (SELECT _row, round(quantity * unit_price * (1 - discount_pct / 100), 2) AS want, order_total FROM t) SELECT _row, round(least(1.0, abs(order_total - want) / 10), 4) AS confidence FROM f WHERE abs(order_total - want) > 1.0")
def cross_field_formula(spark, sf_dir):
    t = lines(spark, sf_dir)
    got = rules.broken(t, rules.cross_field_checks(types=dict(t.dtypes), only=("order_total",)))
    return got.select(ROW, F.round("confidence", 4).alias("confidence"))


@query(f"WITH {LINES} SELECT _row, order_date AS fix FROM t WHERE ship_date < order_date")
def temporal_order(spark, sf_dir):
    return rules.broken(lines(spark, sf_dir), rules.cross_field_checks(only=("ship_date",))).select(ROW, "fix")


@query("WITH t AS (SELECT c_custkey AS _row, c_nationkey AS k, CASE WHEN c_custkey % 6 = 1 THEN 'NATION_0' ELSE 'NATION_' || c_nationkey END AS cat FROM customer) SELECT _row, n_name AS fix FROM t JOIN nation ON k = n_nationkey WHERE n_name <> cat")
def category_lookup(spark, sf_dir):
    k = F.col("c_custkey")
    orders = table(spark, sf_dir, "customer").select(k.alias(ROW), F.col("c_nationkey").cast("string").alias("product_id"), F.when(k % 6 == 1, "NATION_0").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).alias("product_category"))
    products = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias(ROW), F.col("n_nationkey").cast("string").alias("product_id"), F.col("n_name").alias("category"))
    joined = rules.with_category(orders, products)
    for c in ("quantity", "unit_price", "discount_pct", "order_total", "order_date", "ship_date"):
        joined = joined.withColumn(c, F.lit(None).cast("string"))
    return rules.broken(joined, rules.cross_field_checks(F.col("real_category"), only=("product_category",))).select(ROW, "fix")


@query("SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 53 = 7 THEN o_custkey + 100000000 ELSE o_custkey END NOT IN (SELECT c_custkey FROM customer)")
def referential_integrity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 53 == 7, F.col("o_custkey") + 100_000_000).otherwise(F.col("o_custkey")).alias("c_custkey"))
    return rules.orphans(o, table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey")


LIMITS = rules.BusinessRules(max_discount_pct=9, min_quantity=3, max_quantity=45, min_unit_price=1000.0, valid_order_year_range=(1992, 1997))


@query(
    f"WITH {LINES} SELECT _row, 'discount_pct' AS \"column\", '9' AS fix FROM t WHERE discount_pct > 9 UNION ALL SELECT _row, 'discount_pct', '0' FROM t WHERE discount_pct < 0"
    " UNION ALL SELECT _row, 'quantity', '45' FROM t WHERE quantity > 45 UNION ALL SELECT _row, 'quantity', '3' FROM t WHERE quantity < 3"
    " UNION ALL SELECT _row, 'unit_price', '1000.00' FROM t WHERE unit_price < 1000 UNION ALL SELECT _row, 'order_date', '1997' || substr(order_date, 5) FROM t WHERE CAST(left(order_date, 4) AS INTEGER) > 1997"
)
def business_rules(spark, sf_dir):
    t = lines(spark, sf_dir)
    return rules.broken(t, rules.business_checks(LIMITS, dict(t.dtypes))).select(ROW, "column", "fix")


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey > 9000 OR l_partkey < 0 GROUP BY l_partkey")
def id_range(spark, sf_dir):
    t = lines(spark, sf_dir).withColumn(ROW, F.col("product_id"))
    got = rules.broken(t, rules.cross_field_checks(types=dict(t.dtypes), only=("product_id",)))
    return got.groupBy(F.col(ROW).alias("l_partkey")).agg(F.count("*").alias("n"))


# Audit sessions: actions synthesised from events

ACTIONS = "a AS (SELECT event_id AS action_id, user_id AS episode, event_id * 7 % (SELECT count(*) FROM events) AS _row, CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'name' END AS \"column\", event_type AS issue_type, event_id AS step FROM events), t AS (SELECT event_id AS _row, CASE WHEN event_id % 5 = 0 THEN '_row' WHEN event_id % 2 = 0 THEN 'email' ELSE 'phone' END AS \"column\", event_type AS type, CASE WHEN event_id % 4 <> 0 THEN 'v' || event_id END AS expected, CAST(event_id AS INTEGER) AS ord FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'phone', 'click', NULL, CAST(event_id + 1000000000 AS INTEGER) FROM events WHERE event_id % 10 = 0)"


def actions_of_events(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    a = e.select(k.alias("action_id"), F.col("user_id").alias("episode"), (k * 7 % e.count()).alias(ROW), F.when(k % 3 == 0, "email").when(k % 3 == 1, "phone").otherwise("name").alias("column"), F.col("event_type").alias("issue_type"), k.alias("step"))
    first = e.where(k % 2 == 0).select(k.alias(ROW), F.when(k % 5 == 0, "_row").when(k % 2 == 0, "email").otherwise("phone").alias("column"), F.col("event_type").alias("type"), F.when(k % 4 != 0, F.concat(F.lit("v"), k.cast("string"))).alias("expected"), k.cast("int").alias("ord"))
    more = e.where(k % 10 == 0).select(k, F.lit("phone"), F.lit("click"), F.lit(None).cast("string"), (k + 1_000_000_000).cast("int"))
    return a, first.unionAll(more)


MATCHED = f"WITH {ACTIONS}, m AS (SELECT action_id, min(ord) AS ord FROM a JOIN t ON a._row = t._row AND (a.\"column\" = t.\"column\" OR t.\"column\" = '_row') GROUP BY action_id)"


@query(MATCHED + " SELECT a.action_id, m.ord IS NOT NULL AS matched, t.\"column\" AS truth_column, t.type AS truth_type, m.ord FROM a LEFT JOIN m USING (action_id) LEFT JOIN t ON t.ord = m.ord AND t._row = a._row")
def action_match(spark, sf_dir):
    return audit.match_truth(*actions_of_events(spark, sf_dir)).select("action_id", "matched", "truth_column", "truth_type", "ord")


@query(MATCHED + " SELECT a.action_id, CASE WHEN m.ord IS NULL THEN -0.05 WHEN a.issue_type = t.type THEN 0.15 ELSE 0.1 END::DOUBLE AS reward FROM a LEFT JOIN m USING (action_id) LEFT JOIN t ON t.ord = m.ord AND t._row = a._row")
def diagnosis_rewards(spark, sf_dir):
    return audit.diagnosis_rewards(audit.match_truth(*actions_of_events(spark, sf_dir))).select("action_id", "reward")


SCORES = MATCHED + """, s AS (SELECT episode, count(DISTINCT m.ord) AS found, count(DISTINCT m.ord) FILTER (t.expected IS NOT NULL AND action_id % 2 = 0) AS fixed, count(*) FILTER (m.ord IS NULL) AS false_positives FROM a LEFT JOIN m USING (action_id) LEFT JOIN t ON t.ord = m.ord AND t._row = a._row GROUP BY episode),
  z AS (SELECT *, (SELECT count(*) FROM t) AS truths, (SELECT count(expected) FROM t) AS fixable FROM s)"""


def _totals(spark, sf_dir):
    a, t = actions_of_events(spark, sf_dir)
    m = audit.match_truth(a, t)
    s = m.groupBy("episode").agg(F.countDistinct("ord").alias("found"), F.countDistinct(F.when(F.col("expected").isNotNull() & (F.col("action_id") % 2 == 0), F.col("ord"))).alias("fixed"), F.count_if(~F.col("matched")).alias("false_positives"))
    n = t.agg(F.count("*").alias("truths"), F.count("expected").alias("fixable"))
    return s.join(F.broadcast(n))


@query(SCORES + " SELECT episode, round(least(greatest(0.4 * found / truths + 0.6 * fixed / fixable - false_positives * CASE WHEN found + false_positives > 2 * truths THEN 0.1 ELSE 0.05 END, 0.0001), 0.9999), 4) AS score FROM z")
def episode_score(spark, sf_dir):
    return audit.final_scores(_totals(spark, sf_dir)).select("episode", "score")


@query(SCORES + " SELECT episode, truths - found AS remaining, CASE WHEN truths - found <= 0 THEN 'none' WHEN truths - found <= 2 THEN 'few' WHEN truths - found <= 5 THEN 'some' ELSE 'many' END AS hint FROM z")
def remaining_hint(spark, sf_dir):
    left = F.col("truths") - F.col("found")
    return _totals(spark, sf_dir).select("episode", left.alias("remaining"), audit.remaining_hint(left).alias("hint"))


@query(f"WITH {ACTIONS}, i AS (SELECT episode, step, _row, min(step) OVER (PARTITION BY episode, _row) = step AS new FROM a), p AS (SELECT _row, count(*) AS issues FROM t GROUP BY _row), s AS (SELECT episode, step, sum(CASE WHEN new THEN coalesce(issues, 0) ELSE 0 END) AS u, count(*) FILTER (new) AS n FROM i LEFT JOIN p USING (_row) GROUP BY ALL) SELECT episode, step, round(CASE WHEN n = 0 THEN -0.01 ELSE u * 0.01 + n * 0.01 * 0.5 * (1 - sum(n) OVER (PARTITION BY episode ORDER BY step) / (SELECT count(*) FROM events)) END, 9) AS bonus FROM s")
def exploration_bonus(spark, sf_dir):
    a, t = actions_of_events(spark, sf_dir)
    return audit.exploration_bonus(a.select("episode", "step", ROW), t, a.where("false").select("episode", "step", ROW), table(spark, sf_dir, "events").count())


@query("WITH f AS (SELECT user_id, event_id, value, sum(CAST(value AS DECIMAL(12,2)) - 10) OVER (PARTITION BY user_id ORDER BY event_id) + 0.0001 AS free FROM events), e AS (SELECT user_id, arg_max(free, event_id) AS last, min(free) AS low FROM f GROUP BY user_id) SELECT user_id, round(CAST(last - least(low - 0.0001, 0) AS DOUBLE), 4) AS total FROM e")
def running_reward_floor(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value").cast("decimal(12,2)") - 10).alias("delta"))
    return audit.floored_totals(d, "user_id", "event_id", "delta").select("user_id", F.round("total", 4).alias("total"))


@query(SQL["running_reward_floor"])
def running_reward_floor_windowed(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value").cast("decimal(12,2)") - 10).alias("delta"))
    return audit.floored_totals_closed(d, "user_id", "event_id", "delta").select("user_id", F.round("total", 4).alias("total"))


@query()
def string_similarity_credit(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("-other"))).alias("b"))
    return p.withColumn("credit", F.when(similarity("a", "b") >= audit.SIMILAR, audit.PARTIAL_FIX).otherwise(audit.WRONG_FIX)).select("p_partkey", "credit")


@query("SELECT percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS value FROM events")
def latency_p95(spark, sf_dir):
    return score.nearest_rank(table(spark, sf_dir, "events"), "value", 0.95)


@query("SELECT user_id AS episode, count(*) FILTER (event_type = 'click') AS inspect, count(*) FILTER (event_type = 'view') AS diagnose, count(*) FILTER (event_type = 'purchase') AS fix, count(*) FILTER (event_type = 'signup') AS finalize, count(*) FILTER (value <= 5 AND event_type <> 'signup') AS wasted, round(1 - count(*) FILTER (value <= 5 AND event_type <> 'signup') / count(*), 4) AS efficiency FROM events GROUP BY user_id")
def action_distribution(spark, sf_dir):
    kind = reduce(lambda c, kv: c.when(F.col("event_type") == kv[0], kv[1]), [("click", "inspect"), ("view", "diagnose"), ("purchase", "fix"), ("signup", "finalize")], F.when(F.lit(False), "")).otherwise("other")
    return audit.action_summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), kind.alias("action_type"), (F.col("value") - 5).alias("delta")))


LOGGED = "a AS (SELECT event_id AS action_id, CASE event_type WHEN 'click' THEN 'fix' WHEN 'view' THEN 'diagnose' WHEN 'purchase' THEN 'inspect' ELSE event_type END AS action_type, CASE WHEN event_id % 6 <> 0 THEN event_id % 500 END AS _row, CASE WHEN event_id % 7 <> 0 THEN 'email' END AS \"column\", CASE WHEN event_id % 4 = 0 THEN 'delete_row' END AS fix_type, CASE WHEN event_id % 5 <> 0 THEN 'v' END AS new_value FROM events)"


def logged_actions(spark, sf_dir):
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "click", "fix").when(t == "view", "diagnose").when(t == "purchase", "inspect").otherwise(t)
    return table(spark, sf_dir, "events").select(k.alias("action_id"), kind.alias("action_type"), F.when(k % 6 != 0, k % 500).alias(ROW), F.when(k % 7 != 0, "email").alias("column"), F.when(k % 4 == 0, "delete_row").alias("fix_type"), F.when(k % 5 != 0, "v").alias("new_value"))


@query(f"WITH {LOGGED}, e AS (SELECT action_id, CASE WHEN action_type NOT IN ('inspect', 'diagnose', 'fix', 'finalize') THEN 'unknown action' WHEN action_type IN ('diagnose', 'fix') AND (_row IS NULL OR \"column\" IS NULL) THEN 'a row and a column are needed' WHEN action_type = 'fix' AND fix_type IS NULL AND new_value IS NULL THEN 'a new value is needed' WHEN action_type = 'fix' AND fix_type IS NOT NULL AND new_value IS NOT NULL THEN 'a deletion has no new value' END AS error FROM a) SELECT * FROM e WHERE error IS NOT NULL")
def action_validation(spark, sf_dir):
    return audit.action_errors(logged_actions(spark, sf_dir)).where("error is not null").select("action_id", "error")


@query("WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) SELECT event_id, step, CASE WHEN step > 24 THEN -0.02 ELSE 0 END::DOUBLE AS penalty FROM s")
def late_penalties(spark, sf_dir):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("event_id", step.cast("bigint").alias("step")).withColumn("penalty", audit.late_penalty(F.col("step"), audit.STEPS["task_1_format_fixer"]))


@query(f"WITH {ACTIONS} SELECT type, count(*) AS total, count(expected) AS fixable, count(*) - count(expected) AS detection_only FROM t GROUP BY type")
def truth_census(spark, sf_dir):
    from ..operators.generate import truth_census

    return truth_census(actions_of_events(spark, sf_dir)[1])


@query(f"WITH {ACTIONS}, r AS (SELECT *, count(*) OVER (PARTITION BY _row, \"column\") AS n FROM t) SELECT ord, CASE WHEN _row % 3 = 0 THEN 'row' WHEN \"column\" = 'phone' THEN 'column' WHEN type NOT IN ('missing_value', 'format_error', 'type_mismatch', 'duplicate', 'near_duplicate', 'cross_field', 'business_rule', 'referential_integrity', 'outlier') THEN 'type' ELSE 'repeated' END AS fault FROM r")
def truth_validation(spark, sf_dir):
    from ..operators.generate import truth_faults

    rows = table(spark, sf_dir, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias(ROW))
    return truth_faults(actions_of_events(spark, sf_dir)[1], rows, ["email", "name"]).select("ord", "fault")


@query("SELECT o_orderkey AS _row FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY 1 LIMIT 10")
def uninspected_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW))
    return audit.next_uninspected(rows, rows.where(F.col(ROW) % 3 == 0))


@query("SELECT o_orderkey AS _row, o_orderstatus FROM orders WHERE o_orderkey IN (7, 3, 11)")
def inspected_rows(spark, sf_dir):
    return profile.rows_at(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), "o_orderstatus"), [7, 3, 11, -1])


@query("""WITH k AS (SELECT c_custkey AS r, 'email' AS why, lower('U' || (c_custkey // 3) || '@x.org') AS k FROM customer UNION ALL SELECT c_custkey, 'phone', CAST(5550000 + c_custkey // 5 AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'name', 'a' || (c_custkey // 7) || ' b' FROM customer), f AS (SELECT why, k, min(r) AS a FROM k GROUP BY ALL) SELECT a, r AS b, why FROM k JOIN f USING (why, k) WHERE r > a""")
def same_person_pairs(spark, sf_dir):
    k = F.col("c_custkey")
    third, fifth, seventh = (F.floor(k / n).cast("string") for n in (3, 5, 7))
    name = F.when(k % 2 == 0, F.concat(F.lit("A"), seventh, F.lit(" b"))).otherwise(F.concat(F.lit("B a"), seventh))
    phone = F.concat_ws("-", F.lit("+"), F.substring((F.floor(k / 5) + 5550000).cast("string"), 1, 3), F.substring((F.floor(k / 5) + 5550000).cast("string"), 4, 9))
    t = table(spark, sf_dir, "customer").select(k.alias(ROW), name.alias("name"), F.concat(F.when(k % 2 == 0, "U").otherwise("u"), third, F.lit("@X.org")).alias("email"), phone.alias("phone"))
    return rules.same_person(t, "name", "email", "phone")


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    from ..functions.text import token_estimate

    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("SELECT o_orderkey, CAST(least(make_date(2023, CAST(1 + o_orderkey % 12 AS BIGINT), 1) + CAST(o_orderkey % 31 AS INTEGER), last_day(make_date(2023, CAST(1 + o_orderkey % 12 AS BIGINT), 1))) AS DATE)::VARCHAR AS day FROM orders")
def month_end_dates(spark, sf_dir):
    from ..operators.generate import month_end

    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", month_end(F.format_string("2023-%02d-%02d", 1 + k % 12, 1 + k % 31)).alias("day"))


@query()
def episode_replay(spark, sf_dir):
    a, t = actions_of_events(spark, sf_dir)
    step = F.row_number().over(Window.partitionBy("episode").orderBy("action_id"))
    kind = F.when(F.col("action_id") % 4 == 3, "fix").otherwise("diagnose")
    acts = a.select("episode", step.alias("step"), kind.alias("action_type"), ROW, "column", "issue_type", F.concat(F.lit("v"), F.col(ROW).cast("string")).alias("new_value"), F.lit("correct_value").alias("fix_type"), F.lit(None).cast("string").alias("justification"))
    return audit.replay(acts, t, table(spark, sf_dir, "events").count(), audit.STEPS["task_3_integrity_auditor"])


@query()
def generated_orders(spark, sf_dir):
    from ..operators.generate import episode_table

    return episode_table(spark, "task_3_integrity_auditor", rows=table(spark, sf_dir, "orders").count())[0]


# Around sessions: what a grader reports, what an agent writes and reads


FOUND = "x AS (SELECT user_id AS episode, event_id AS _row, CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE '_row' END AS \"column\", CASE WHEN event_id % 4 <> 0 THEN 'v' END AS expected FROM events), f AS (SELECT user_id AS episode, event_id AS _row, 'email' AS \"column\", CASE WHEN event_id % 10 < 5 THEN 'phone' ELSE 'email' END AS truth_column FROM events WHERE event_type = 'click'), d AS (SELECT user_id AS episode, event_id AS _row FROM events WHERE event_type = 'view')"


@query(f"WITH {FOUND} SELECT x.episode, x._row, x.\"column\", expected IS NOT NULL AS fixable, coalesce(f._row IS NOT NULL AND (f.\"column\" = x.\"column\" OR f.truth_column = x.\"column\" OR x.\"column\" = '_row'), false) AS detected, CASE WHEN expected IS NOT NULL THEN d._row IS NOT NULL END AS fixed FROM x LEFT JOIN f ON x.episode = f.episode AND x._row = f._row LEFT JOIN d ON x.episode = d.episode AND x._row = d._row")
def issue_flags(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    cell = [F.col("user_id").alias("episode"), k.alias(ROW)]
    truth = e.select(*cell, F.when(k % 3 == 0, "email").when(k % 3 == 1, "phone").otherwise("_row").alias("column"), F.when(k % 4 != 0, "v").alias("expected"))
    found = e.where("event_type = 'click'").select(*cell, F.lit("email").alias("column"), F.when(k % 10 < 5, "phone").otherwise("email").alias("truth_column"))
    return audit.issue_flags(truth, found, e.where("event_type = 'view'").select(*cell)).drop("expected")


GRADED = "g AS (SELECT user_id AS episode, count(*) FILTER (event_type = 'click')::DOUBLE AS found, count(*) FILTER (event_type = 'view')::DOUBLE AS fixed, 40::DOUBLE AS truths, 30::DOUBLE AS fixable, count(*) FILTER (event_type = 'purchase')::DOUBLE AS fp, count(*)::DOUBLE AS steps FROM events GROUP BY user_id), r AS (SELECT *, found / truths AS dr, fixed / fixable AS fr, CASE WHEN found + fp > 2 * truths THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS rate FROM g)"


def _clamp_sql(e: str, name: str) -> str:
    return f"round(least(greatest({e}, 0.0001::DOUBLE), 0.9999::DOUBLE), 4) AS {name}"


@query(f"WITH {GRADED} SELECT episode, {_clamp_sql('dr', 'detection_rate')}, {_clamp_sql('fr', 'fix_rate')}, {_clamp_sql('rate', 'fp_penalty_rate')}, {_clamp_sql('fp * rate', 'fp_penalty_total')}, {_clamp_sql('dr * 0.4::DOUBLE + fr * 0.6::DOUBLE - fp * rate', 'raw_score')}, {_clamp_sql('steps / 500', 'step_utilization')}, 10::BIGINT AS detection_only FROM r")
def grader_diagnostics(spark, sf_dir):
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    g = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(of("click").alias("found"), of("view").alias("fixed"), F.lit(40).cast("bigint").alias("truths"), F.lit(30).cast("bigint").alias("fixable"), of("purchase").alias("false_positives"), F.count("*").alias("steps"), F.count("*").alias("inspected"))
    return audit.grader_diagnostics(g, 1000, 500).select("episode", "detection_rate", "fix_rate", "fp_penalty_rate", "fp_penalty_total", "raw_score", "step_utilization", "detection_only")


@query("""WITH k AS (SELECT o_orderkey AS k, o_orderkey % 6 AS m FROM orders)
  SELECT k AS o_orderkey, CASE m WHEN 0 THEN 'diagnose' WHEN 1 THEN 'fix' WHEN 2 THEN 'inspect' WHEN 3 THEN 'finalize' ELSE 'inspect' END AS action_type,
  CASE WHEN m IN (0, 1) THEN k END AS row_index, CASE m WHEN 0 THEN CASE WHEN k % 4 = 0 THEN 'format_error' WHEN k % 4 = 1 THEN 'near_duplicate' WHEN k % 4 = 2 THEN 'outlier' ELSE 'format_error' END END AS issue_type,
  CASE m WHEN 1 THEN CASE WHEN k % 5 = 0 THEN 'delete_row' ELSE 'correct_value' END END AS fix_type, CASE m WHEN 1 THEN 'v' || k END AS new_value,
  CASE m WHEN 2 THEN '1,2' WHEN 4 THEN '0,1,2,3,4' END AS row_indices, m <> 4 AS readable FROM k""")
def parsed_actions(spark, sf_dir):
    from ..operators import agents

    k = F.col("o_orderkey")
    issue = F.when(k % 4 == 0, "format").when(k % 4 == 1, "Near-Duplicate").when(k % 4 == 2, "an outlier here").otherwise("strange")
    text = (
        F.when(k % 6 == 0, F.format_string('{"action_type": "Report", "row_index": "%d", "column_name": "c", "issue_type": "%s", "new_value": "x"}', k, issue))
        .when(k % 6 == 1, F.format_string('I would {"action_type": "repair", "row_index": %d, "column_name": "a } b", "fix_type": "%s", "new_value": "v%d"} so.', k, F.when(k % 5 == 0, "delete row").otherwise("magic"), k))
        .when(k % 6 == 2, F.lit('{"action_type": "look", "row_indices": [1, "2"], "row_index": 4}'))
        .when(k % 6 == 3, F.lit('{{broken {"action_type": "submit"}'))
        .when(k % 6 == 4, F.lit("no object at all"))
        .otherwise(F.lit('{"action_type": "dance"}'))
    )
    got = agents.parse_actions(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text")
    return got.select("o_orderkey", "action_type", "row_index", "issue_type", "fix_type", "new_value", F.array_join(F.col("row_indices").cast("array<string>"), ",").alias("row_indices"), "readable")


@query("SELECT p_partkey, p_partkey AS row, 'size' AS \"column\", 'v' || p_size AS new_value, CASE WHEN p_partkey % 2 = 0 THEN 'said' ELSE 'LLM repair' END AS reason FROM part UNION ALL SELECT p_partkey, 7, 'b', '', 'LLM repair' FROM part WHERE p_partkey % 3 = 0")
def payload_repairs(spark, sf_dir):
    from ..functions.text import first_json_object
    from ..operators import agents

    k = F.col("p_partkey")
    first = F.format_string('{"row": %d, "column": "size", "new_value": "v%d"%s}', k, "p_size", F.when(k % 2 == 0, ', "reason": "said"').otherwise(""))
    more = F.when(k % 3 == 0, ', {"row": 7, "column": "b", "new_value": ""}').when(k % 3 == 1, ', {"row": "7", "column": "b", "new_value": "x"}, 5').otherwise(', {"row": 1, "column": "b", "new_value": 3}')
    text = F.concat(F.lit('Here {it is}: ```json\n{"repairs": ['), first, more, F.lit("]}\n``` done"))
    replies = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return agents.payload_repairs(replies, "text", first_json_object(F.col("text")))


@query("""WITH m AS (SELECT *, 4 + length(coalesce(text, '')) // 4 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id) AS total, sum(cost) OVER (PARTITION BY conv_id ORDER BY back) AS since, max(CASE WHEN back = n THEN cost - 4 END) OVER (PARTITION BY conv_id) AS head FROM m),
  k AS (SELECT *, total <= 150 OR n <= 9 OR back <= 4 OR back = n OR since <= 150 - head - 100 AS kept FROM s),
  d AS (SELECT *, count(*) FILTER (NOT kept) OVER (PARTITION BY conv_id) AS dropped FROM k) SELECT conv_id, turn, dropped FROM d WHERE kept""")
def truncated_conversations(spark, sf_dir):
    from ..operators import agents

    return agents.truncated(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 200).select("conv_id", "turn", "dropped")


@query()
def heuristic_audit(spark, sf_dir):
    """An audit by rules of a generated table of as many rows as there are orders, end to end."""
    from ..operators.generate import episode_table

    dirty, planted = episode_table(spark, "task_3_integrity_auditor", rows=table(spark, sf_dir, "orders").count())
    limits = rules.BusinessRules(50, 1, 100, 0.01, (2020, 2024))
    parsed = rules.with_numbers(dirty, ["quantity", "unit_price", "discount_pct", "order_total", "product_id"])
    types = dict(parsed.dtypes)
    broken = rules.broken(parsed, rules.null_checks(detect.cells(dirty)) + rules.cross_field_checks(types=types) + rules.business_checks(limits, types))
    rows = dirty.count()
    acts = audit.heuristic_actions(broken, rows, rows, "order_id", ("products", "business_rules"))
    return audit.replay(acts, planted.select(ROW, "column", "type", "expected", "ord"), rows, rows)
