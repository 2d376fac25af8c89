"""What a text-writing agent needs around a session: its replies read, its context kept short, its view written out."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .generate import ISSUE_TYPES

# Kinds of actions and the fields of each, other names of kinds, kinds of fixes, defaults,
# and the shares and sizes by which a context is cut.
FIELDS = {
    "inspect": ("row_indices", "column_names", "related_table", "metadata"),
    "diagnose": ("row_index", "column_name", "issue_type", "related_table", "metadata"),
    "fix": ("row_index", "column_name", "new_value", "fix_type", "justification", "related_table", "metadata"),
    "finalize": ("metadata",),
}
KINDS = {
    "inspect": ("investigate", "examine", "check", "look", "view", "show"),
    "diagnose": ("detect", "report", "identify", "flag", "find"),
    "fix": ("repair", "correct", "update", "change"),
    "finalize": ("complete", "done", "finish", "end", "submit"),
}
FIX_TYPES = ("correct_value", "delete_row", "impute", "standardize")
DEFAULT_ROWS, DEFAULT_ISSUE, DEFAULT_FIX, DEFAULT_REASON = (0, 1, 2, 3, 4), "format_error", "correct_value", "LLM repair"
BUDGET_SHARE, OVERHEAD, NOTE_TOKENS, WIDE_CONTEXT, KEPT_ALWAYS = 0.75, 4, 100, 32_000, 9


def balanced_object(text: str) -> str | None:
    """From the first brace to the one that closes it, outside quoted strings."""
    start, depth, at = text.find("{"), 0, 0
    if start < 0:
        return None
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[{}"]', re.S).finditer(text, start):
        if m[0] == '"':
            return None  # a string that never ends
        depth, at = depth + (m[0] == "{") - (m[0] == "}"), m.end()
        if not depth:
            return text[start:at]
    return None


def _object(text: str | None) -> str | None:
    """A reply's JSON object: the whole reply, else its first balanced braces, else its first plain ones."""
    plain = re.search(r"\{[^{}]+\}", text, re.S) if text else None
    for part in (text, balanced_object(text) if text else None, plain and plain[0]):
        try:
            if part and isinstance(json.loads(part), dict):
                return part.strip()
        except ValueError:
            pass
    return None


@F.pandas_udf(T.StringType())
def reply_object(v: pd.Series) -> pd.Series:
    return v.map(_object)


def _word(c: Column) -> Column:
    return F.replace(F.replace(F.trim(F.lower(c)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def parse_actions(replies: DataFrame, text: str) -> DataFrame:
    """``replies`` with the action that each text spells: ``action_type``, the fields that its kind has,
    and ``readable``. An unreadable reply inspects the first rows; unknown kinds inspect; unknown issue
    types become one that they contain or that contains them, else a format error."""
    raw = replies.withColumn("_m", F.from_json(reply_object(F.col(text)), "map<string,string>"))
    field = lambda k: F.element_at("_m", k)
    said = F.trim(F.lower(F.coalesce(field("action_type"), F.lit("inspect"))))
    kind = F.lit("inspect")
    for name, others in KINDS.items():
        kind = F.when(said.isin(name, *others), name).otherwise(kind)
    has = lambda k: F.col("action_type").isin(*(a for a, fields in FIELDS.items() if k in fields))
    number = lambda c: F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
    listed = F.transform(F.from_json(field("row_indices"), "array<string>"), number)
    start = F.array(*map(F.lit, DEFAULT_ROWS)).cast("array<bigint>")
    rows = F.when(F.col("_m").isNull(), start).when(F.map_contains_key("_m", F.lit("row_indices")), F.when(F.forall(listed, lambda x: x.isNotNull()), listed).otherwise(start))
    issue, found = _word(field("issue_type")), F.lit(DEFAULT_ISSUE)
    for name in reversed(ISSUE_TYPES):
        found = F.when(F.lit(name).contains(issue) | issue.contains(name), name).otherwise(found)
    found = F.when(issue.isin(*ISSUE_TYPES), issue).when(issue.isNotNull(), found)
    fix = F.when(_word(field("fix_type")).isin(*FIX_TYPES), _word(field("fix_type"))).when(field("fix_type").isNotNull(), DEFAULT_FIX)
    plain = {"row_indices": rows, "column_names": F.from_json(field("column_names"), "array<string>"), "row_index": number(field("row_index")), "issue_type": found, "fix_type": fix} | {k: field(k) for k in ("column_name", "related_table", "new_value", "justification")}
    typed = raw.withColumn("action_type", kind)
    return typed.select(*replies.columns, "action_type", *(F.when(has(k), c).alias(k) for k, c in plain.items()), F.col("_m").isNotNull().alias("readable"))


def payload_repairs(replies: DataFrame, text: str, first_object: Column) -> DataFrame:
    """The repairs that replies list, a row each: ``row``, ``column``, ``new_value`` and ``reason``.
    ``first_object`` is the reply's first JSON object; entries whose row isn't a whole number, or whose
    column or value isn't a string, are passed over."""
    listed = replies.withColumn("_r", F.explode(F.from_json(F.get_json_object(first_object, "$.repairs"), "array<string>"))).drop(text)
    v = F.try_parse_json("_r")
    part = lambda k, kind: F.try_variant_get(v, f"$.{k}", kind)
    typed = lambda k: F.schema_of_variant(part(k, "variant"))
    sound = (typed("row") == "BIGINT") & (typed("column") == "STRING") & (typed("new_value") == "STRING")
    rest = [c for c in replies.columns if c != text]
    return listed.where(sound).select(*rest, part("row", "bigint").alias("row"), part("column", "string").alias("column"), part("new_value", "string").alias("new_value"), F.coalesce(part("reason", "string"), F.lit(DEFAULT_REASON)).alias("reason"))


def tokens(c: Column) -> Column:
    """About four letters each."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def truncated(messages: DataFrame, key: str, order: str, text: str, most_tokens: int) -> DataFrame:
    """``messages`` that fit a context, by conversation, and ``dropped``, how many middle ones went.

    The first message and the last few always stay; of those between, the newest that fit. A
    conversation within BUDGET_SHARE of the context, or of KEPT_ALWAYS messages, stays whole.
    """
    budget, tail = int(most_tokens * BUDGET_SHARE), 4 if most_tokens < WIDE_CONTEXT else 8
    whole, newest = Window.partitionBy(key), Window.partitionBy(key).orderBy(F.desc(order))
    cost = OVERHEAD + tokens(F.col(text))
    m = messages.select("*", cost.alias("_cost"), F.count("*").over(whole).alias("_n"), F.row_number().over(newest).alias("_back"), F.sum(cost).over(whole).alias("_total"), F.sum(cost).over(newest.rowsBetween(Window.unboundedPreceding, 0)).alias("_since"))
    first = F.max(F.when(F.col("_back") == F.col("_n"), F.col("_cost") - OVERHEAD)).over(whole)
    fits = (F.col("_total") <= budget) | (F.col("_n") <= KEPT_ALWAYS)
    always = (F.col("_back") <= tail) | (F.col("_back") == F.col("_n"))
    m = m.withColumn("_kept", fits | always | (F.col("_since") <= budget - first - NOTE_TOKENS))
    return m.withColumn("dropped", F.count_if(~F.col("_kept")).over(whole)).where("_kept").select(*messages.columns, "dropped")


def truncation_note(dropped: Column) -> Column:
    """What stands in for dropped messages; null for none."""
    return F.when(dropped > 0, F.concat(dropped.cast("string"), F.lit(" earlier messages were left out to fit the context; the latest follow.")))


def observation_text(states: DataFrame) -> Column:
    """A session's state in lines: budget, last result, issues, coverage, and what is in view.

    ``states`` has step, most_steps, result, delta, cumulative, found, hint, inspected and rows, and may
    have message, schema and visible, which stand in lines of their own where given.
    """
    share = F.when(F.col("most_steps") > 0, F.floor(100 * F.col("step") / F.col("most_steps"))).otherwise(0)
    left = F.col("rows") - F.col("inspected")
    given = lambda c, said: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(said), F.col(c))) if c in states.columns else F.lit(None).cast("string")
    return F.concat_ws(
        "\n",
        F.format_string("Step %d/%d (%d%% used)", "step", "most_steps", share),
        F.when(F.col("result") != "initial", F.format_string("Last action: %s (reward: %+.3f, cumulative: %.4f)", "result", "delta", "cumulative")),
        F.format_string("Issues found: %d | Remaining: %s", "found", "hint"),
        F.when(left > 0, F.format_string("Row coverage: %d/%d inspected (%d remaining)", "inspected", "rows", left)).otherwise(F.format_string("Row coverage: all %d rows inspected", "rows")),
        given("message", "Environment: "),
        F.when(F.col("step") == 0, given("schema", "Schema: ")),
        given("visible", "Visible rows: "),
    )
