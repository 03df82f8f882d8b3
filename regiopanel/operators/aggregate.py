"""Aggregations (A1, A2, A4, A5, A7) and exact distributed quantiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.session import small_frame


def mean_by(df: DataFrame, keys, value: str, alias: str) -> DataFrame:
    """A1/A2: mean of ``value`` per key (collapses duplicate loads). Partial aggregation per task
    bounds the shuffle to one row per key and task, also for a hot key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.avg(F.col(value)).alias(alias))


def distinct_values(df: DataFrame, column: str, sort: bool = True) -> DataFrame:
    """A4: distinct values of a column (optionally sorted)."""
    out = df.select(column).distinct()
    return out.orderBy(column) if sort else out


def min_sample_gate(df: DataFrame, keys, required, threshold: int = 10) -> DataFrame:
    """A5: complete rows per group and whether the group has enough to fit a model.

    Rows count as complete when none of ``required`` is null or NaN. Skipped groups stay in the
    result (``eligible = false``), so the gate doubles as the skipped-model report.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    complete = df.na.drop(how="any", subset=list(required))
    return (complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("eligible", F.col("n_rows") >= F.lit(threshold)))


# --------------------------------------------------------------------------------------------
# Exact quantiles without gathering a column into one task.
#
# A global ``percentile`` aggregate keeps every distinct value of the column in one buffer.
# Instead: (1) one pass gets, for every column, the count, min, max and approximate quantiles at
# q +/- margin: a value bracket [lo, hi] for each wanted rank; (2) one pass counts, per bracket,
# the rows < lo, <= lo, < hi and <= hi. That verifies the bracket (a miss widens it to the min /
# max), answers ranks that fall in the run of values equal to lo or hi (heavy duplicates end
# here), and sizes the interior; (3) one pass narrows every large interior with approximate
# quantiles of the rows strictly inside it, so each round strictly shrinks the bracket; (4) one
# job reads the ranks inside all small interiors (at most ``max_bracket`` rows each) with a
# window partitioned by bracket. Every pass is a distributed scan with per-task partial
# aggregation, shared by all columns; no task ever holds more than one small bracket.
# --------------------------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, column: str, probs, accuracy: int = 10_000,
                    max_bracket: int = 200_000) -> dict[float, float | None]:
    """Linear-interpolated quantiles (``percentile`` / ``quantile_cont`` semantics) of a column.

    Exact, but never collects the column: see the comment above. Returns ``{p: value}``.
    """
    return multi_quantiles(df, [column], probs, accuracy, max_bracket)[0][column]


def multi_quantiles(df: DataFrame, columns, probs, accuracy: int = 10_000, max_bracket: int = 200_000,
                    extra=None):
    """Exact quantiles of several columns at once; every pass serves all columns.

    Which values come from a narrowed bracket and which from reading one of at most ``max_bracket`` rows doesn't
    change the result. After 200 rounds without an answer an error is raised, never a wrong value returned.

    ``extra(c)`` may return more aggregates for column expression ``c`` (named ``<name>__<i>``
    by the caller's choice) to ride along in the first pass. Returns ``(quantiles, first_row)``
    with ``quantiles[column][p]``.
    """
    columns = list(columns)
    probs = list(probs)
    doubles = {name: F.col(f"`{name}`").cast("double") for name in columns}
    cols = {name: F.when(~F.isnan(c), c) for name, c in doubles.items()}  # NaN is no value, like null
    margin = 3.0 / accuracy
    bracket_probs = [x for q in probs for x in (max(0.0, q - margin), min(1.0, q + margin))]
    first_aggs = []
    for i, name in enumerate(columns):
        c = cols[name]
        first_aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
                       F.percentile_approx(c, bracket_probs, accuracy).alias(f"a{i}")]
        if extra is not None:
            first_aggs += list(extra(c, i))
    first = df.agg(*first_aggs).first()

    # every wanted order statistic: (column index, 0-based rank) -> [low, high] value bracket
    wanted: dict[tuple, tuple] = {}
    brackets: dict[tuple, list] = {}
    result: dict[str, dict] = {name: {} for name in columns}
    for i, name in enumerate(columns):
        n = first[f"n{i}"]
        for j, q in enumerate(probs):
            if n == 0:
                result[name][q] = None
                continue
            h = (n - 1) * q
            r_lo = int(math.floor(h))
            r_hi = min(r_lo + 1, n - 1)
            wanted[(i, q)] = (r_lo, r_hi, h - r_lo)
            approx = first[f"a{i}"]
            for r in (r_lo, r_hi):
                brackets.setdefault((i, r), [approx[2 * j], approx[2 * j + 1]])
    value: dict[tuple, float] = {}

    for _ in range(200):
        if not brackets:
            break
        items = list(brackets.items())
        aggs = []
        for k, ((i, _), (lo, hi)) in enumerate(items):
            c = cols[columns[i]]
            aggs += [F.count(F.when(c < F.lit(lo), F.lit(1))).alias(f"a{k}"),
                     F.count(F.when(c <= F.lit(lo), F.lit(1))).alias(f"b{k}"),
                     F.count(F.when(c < F.lit(hi), F.lit(1))).alias(f"c{k}"),
                     F.count(F.when(c <= F.lit(hi), F.lit(1))).alias(f"d{k}")]
        counts = df.agg(*aggs).first()
        small, narrow = [], []
        for k, (key, (lo, hi)) in enumerate(items):
            i, r = key
            lt_lo, le_lo, lt_hi, le_hi = (counts[f"{x}{k}"] for x in "abcd")
            if r < lt_lo:  # the approximation missed low: widen down to the minimum
                brackets[key][0] = first[f"lo{i}"]
            elif r >= le_hi:  # missed high: widen up to the maximum
                brackets[key][1] = first[f"hi{i}"]
            elif r < le_lo:  # inside the run of values equal to the low end
                value[key] = lo
                del brackets[key]
            elif r >= lt_hi:  # inside the run of values equal to the high end
                value[key] = hi
                del brackets[key]
            elif lt_hi - le_lo <= max_bracket:  # few rows strictly between: read the rank
                small.append((key, i, lo, hi, r - le_lo + 1))
                del brackets[key]
            else:  # many rows strictly between: narrow to a strictly smaller bracket
                narrow.append((key, i, lo, hi, (r - le_lo) / (lt_hi - le_lo - 1)))
        if narrow:  # one pass narrows every large bracket with approx quantiles of its interior
            naggs = []
            for m, (_, i, lo, hi, p) in enumerate(narrow):
                c = cols[columns[i]]
                inside = F.when((c > F.lit(lo)) & (c < F.lit(hi)), c)
                naggs.append(F.percentile_approx(
                    inside, [max(0.0, p - margin), min(1.0, p + margin)], accuracy).alias(f"s{m}"))
            sub = df.agg(*naggs).first()
            for m, (key, _, lo, hi, _) in enumerate(narrow):
                brackets[key] = [sub[f"s{m}"][0], sub[f"s{m}"][1]]
        if small:
            got = _read_ranks(df, cols, columns, [(i, lo, hi, rank) for _, i, lo, hi, rank in small])
            for b, (key, _, _, _, rank) in enumerate(small):
                value[key] = got[(b, rank)]
    if brackets:
        raise RuntimeError("exact quantile search did not converge")
    for (i, q), (r_lo, r_hi, frac) in wanted.items():
        a, z = value[(i, r_lo)], value[(i, r_hi)]
        result[columns[i]][q] = a if frac == 0 or a == z else a + frac * (z - a)
    return result, first


def _read_ranks(df: DataFrame, cols: dict, columns: list, wanted) -> dict:
    """Values at 1-based ranks among the values strictly inside small brackets, in ONE job.

    ``wanted`` holds ``(column index, low, high, rank)``. Each row emits one (bracket, value) pair
    per bracket its column value falls strictly inside (brackets may overlap); a window
    partitioned by bracket ranks the values (each bracket holds at most ``max_bracket`` rows) and
    only the wanted ranks are kept.
    """
    tags = []
    for b, (i, lo, hi, _) in enumerate(wanted):
        c = cols[columns[i]]
        tags.append(F.when((c > F.lit(lo)) & (c < F.lit(hi)), F.struct(F.lit(b).alias("bid"), c.alias("v"))))
    pairs = df.select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("t")).select("t.*")
    ranked = pairs.withColumn("rk", F.row_number().over(Window.partitionBy("bid").orderBy("v")))
    keep = F.lit(False)
    for b, (_, _, _, rank) in enumerate(wanted):
        keep = keep | ((F.col("bid") == F.lit(b)) & (F.col("rk") == F.lit(rank)))
    return {(r["bid"], r["rk"]): r["v"] for r in ranked.filter(keep).collect()}


def describe(df: DataFrame, columns, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles and max per numeric column.

    Returns one row per described column: ``column, count, mean, std, min, p25, p50, p75, max``.
    NaN is skipped like null. The input is read by several passes (four or more), so materialise a costly one first.
    All columns share the passes of :func:`multi_quantiles` (moments ride in its first pass), so
    describing twelve variables costs about as many scans as describing one.
    """
    spark = df.sparkSession
    columns = [columns] if isinstance(columns, str) else list(columns)
    q, m = multi_quantiles(df, columns, probs, extra=lambda c, i: (F.avg(c).alias(f"mean{i}"),
                                                                  F.stddev_samp(c).alias(f"std{i}")))
    rows = [(c, m[f"n{i}"], m[f"mean{i}"], m[f"std{i}"], m[f"lo{i}"], *[q[c][p] for p in probs], m[f"hi{i}"])
            for i, c in enumerate(columns)]
    qnames = [f"p{int(round(p * 100))}" for p in probs]
    schema = ("column string, count bigint, mean double, std double, min double, "
              + ", ".join(f"{x} double" for x in qnames) + ", max double")
    return small_frame(spark, rows, schema)
