"""Exact means and medians that need no single task to hold a column's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals whose sums are exact; a sketch's accuracy; values that the driver may choose a median from.
EXACT = "decimal(38,12)"
ACCURACY, MOST_LISTED = 10_000, 100_000


def exact_mean(value: Column, digits: int = 4, weight: Column | None = None) -> Column:
    """The mean as an aggregate, from an exact decimal sum, rounded half up. Sums of doubles depend on
    their order and may fall on either side of a half. Only values beyond decimals (over 26 digits
    before the point, or not finite) take the floating mean."""
    exact, n = value.try_cast(EXACT), F.count(value)
    floating = F.avg(value)
    if weight is not None:
        exact, n = F.try_multiply(exact, weight.cast("decimal(18,0)")).try_cast(EXACT), F.sum(F.when(value.isNotNull(), weight))
        floating = F.sum(value * weight) / n
    mean = F.when(F.count(value) == F.count(exact), F.try_divide(F.try_sum(exact), n.cast("decimal(20,0)")))
    return F.coalesce(F.round(mean, digits).cast("double"), F.round(floating, digits))


def sketched_middle(value: Column) -> Column:
    """Two values that most likely enclose the median, as an aggregate."""
    return F.percentile_approx(value, [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY], ACCURACY)


def medians_within(df: DataFrame, values: dict[str, Column], known: dict[str, tuple[int, float, float]]) -> dict[str, float]:
    """The exact medians that lie within known bounds (number of values, low, high): one pass counts the
    values within by value, and those below as one. Medians that lie elsewhere are left out, as are
    columns of so many values that too many might lie within."""
    tried = [c for c, (n, *_) in known.items() if n and n * 4 / ACCURACY <= MOST_LISTED]
    if not tried:
        return {}
    rows = df.select(*(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(tried)))

    def cell(i: int, low: float, high: float) -> Column:
        v = F.col(f"v{i}")
        return F.when(v <= high, F.struct(F.lit(i).alias("i"), F.when(v >= low, v).alias("v")))

    cells = F.array(*(cell(i, *known[c][1:]) for i, c in enumerate(tried)))
    counts = rows.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    at, found = [0] * len(tried), [[] for _ in tried]
    for r in counts.orderBy("i", F.asc_nulls_first("v")).toLocalIterator():
        i, n = r["i"], known[tried[r["i"]]][0]
        if r["v"] is not None:
            found[i] += [r["v"]] * sum(at[i] <= k < at[i] + r["n"] for k in ((n - 1) // 2, n // 2))
        at[i] += r["n"]
    return {c: sum(m) / 2 for c, m in zip(tried, found, strict=True) if len(m) == 2}


def exact_medians(df: DataFrame, values: dict[str, Column], known: dict[str, tuple[int, float, float]] | None = None) -> dict[str, float | None]:
    """The exact median of each column of numbers, which hold no NaN; None for an empty one. ``known``
    gives bounds that an earlier pass has sketched, as for ``medians_within``.

    A pass sketches two bounds around each median whose range still holds many values, and the next
    counts what lies below and within, so a pass leaves about 1 in 2,500. Bounds that miss the median
    are taken back. What lies within is then counted by value and read in order.
    """
    done = medians_within(df, values, known) if known else {}
    names = [c for c in values if c not in done]
    rows = df.select(*(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    bounds = {i: (float("-inf"), float("inf")) for i in range(len(names))}
    last, settled, total = dict(bounds), set(), {}
    within = lambda i: F.when(F.col(f"v{i}").between(*bounds[i]), F.col(f"v{i}"))
    sketched = lambda i, share: F.percentile_approx(within(i), [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)], ACCURACY).alias(f"p{i}")
    while bounds:
        first = [] if total else [sketched(i, 0.5) for i in bounds]
        got = rows.agg(*(x for i in bounds for x in (F.count(within(i)).alias(f"n{i}"), F.count_if(F.col(f"v{i}") < bounds[i][0]).alias(f"b{i}"))), *first).first()
        total = total or {i: got[f"n{i}"] for i in bounds}
        bounds = {i: b for i, b in bounds.items() if total[i]}
        lost = {i for i in bounds if not got[f"b{i}"] <= (total[i] - 1) // 2 <= total[i] // 2 < got[f"b{i}"] + got[f"n{i}"]}
        if lost:
            bounds, settled = bounds | {i: last[i] for i in lost}, settled | lost
            continue
        wide = [i for i in bounds if i not in settled and got[f"n{i}"] > MOST_LISTED]
        if not wide:
            break
        last, middle = dict(bounds), {i: ((total[i] - 1) / 2 - got[f"b{i}"]) / got[f"n{i}"] for i in wide}
        sketch = got if first else rows.agg(*(sketched(i, middle[i]) for i in wide)).first()
        for i in wide:
            settled |= {i} if tuple(sketch[f"p{i}"]) == bounds[i] else set()
            bounds[i] = tuple(sketch[f"p{i}"])
    found: dict[int, list[float]] = {i: [] for i in bounds}
    if bounds:
        cells = F.array(*(F.struct(F.lit(i).alias("i"), within(i).alias("v")) for i in bounds))
        counts = rows.select(F.explode(F.filter(cells, lambda x: x["v"].isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
        at = {i: got[f"b{i}"] for i in bounds}
        for r in counts.orderBy("i", "v").toLocalIterator():
            i = r["i"]
            found[i] += [r["v"]] * sum(at[i] <= k < at[i] + r["n"] for k in ((total[i] - 1) // 2, total[i] // 2))
            at[i] += r["n"]
    return done | {c: sum(found[i]) / 2 if found.get(i) else None for i, c in enumerate(names)}
