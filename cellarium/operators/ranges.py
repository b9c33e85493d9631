"""Spreadsheet aggregates and lookups where a range is a whole column: grouped aggregates, windows and joins.

The array forms in functions/ serve ranges within a row; these serve tables of any size. Aggregates combine on the map side.
What needs an order (quantiles, ranks, k-th values, trimmed means, approximate lookups) takes it in ranges of rows, a task each,
so one group may hold all rows of a table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions.criteria import meets
from cellarium.session import cut


def ranked(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with the place of each row, from 1, in this order, which should be total. Rows are sorted in ranges, a task each, and
    a range's places follow those of the ranges before; what is ordered in one task is a row a range."""
    # Ranges are cut, as the places depend on how rows are dealt.
    ranges = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = ranges.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    out = ranges.join(F.broadcast(before), F.shiftright("_id", 33) == F.col("_p"))
    return out.withColumn(name, F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_p", "_b")


def _use(df: DataFrame, criteria: dict[str, object]) -> Column:
    kinds, out = dict(df.dtypes), F.lit(True)
    for name, criterion in criteria.items():
        text = kinds[name] == "string"
        n = F.lit(None).cast("double") if text else F.col(name).cast("double")
        out = out & meets(n, F.col(name) if text else F.lit(None).cast("string"), criterion)
    return out


def count_ifs(df: DataFrame, criteria: dict[str, object]) -> Column:
    return F.count_if(_use(df, criteria))


def sum_ifs(df: DataFrame, value: str, criteria: dict[str, object]) -> Column:
    return F.coalesce(F.sum(F.when(_use(df, criteria), F.col(value))), F.lit(0.0))


def average_ifs(df: DataFrame, value: str, criteria: dict[str, object]) -> Column:
    return F.coalesce(F.avg(F.when(_use(df, criteria), F.col(value))), F.lit(0.0))


def max_ifs(df: DataFrame, value: str, criteria: dict[str, object]) -> Column:
    return F.coalesce(F.max(F.when(_use(df, criteria), F.col(value))), F.lit(0.0))


def min_ifs(df: DataFrame, value: str, criteria: dict[str, object]) -> Column:
    return F.coalesce(F.min(F.when(_use(df, criteria), F.col(value))), F.lit(0.0))


def sum_product(*columns: str) -> Column:
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.sum(out)


def dispersion(value: str) -> dict[str, Column]:
    c, n = F.col(value), F.count(value)
    return {"stdev": F.coalesce(F.stddev_samp(c), F.lit(0.0)), "stdevp": F.stddev_pop(c), "var": F.coalesce(F.var_samp(c), F.lit(0.0)), "varp": F.var_pop(c), "devsq": F.var_pop(c) * n}


def shape(value: str) -> dict[str, Column]:
    """Sample skewness and excess kurtosis, from the population ones."""
    c, n = F.col(value), F.count(value).cast("double")
    return {
        "skew": F.skewness(c) * F.try_divide(F.sqrt(n * (n - 1)), n - 2), "kurt": F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6),
        "geomean": F.exp(F.avg(F.ln(c))), "harmean": F.try_divide(n, F.sum(F.try_divide(F.lit(1.0), c))),
    }


def regression(y: str, x: str) -> dict[str, Column]:
    n = F.regr_count(y, x)
    return {
        "slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "rsq": F.regr_r2(y, x), "correl": F.corr(y, x), "covar_p": F.covar_pop(y, x), "covar_s": F.covar_samp(y, x),
        "steyx": F.sqrt(F.try_divide(F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x)), n - 2)),
    }


def _count(value: str, kind: str | None = None) -> Column:
    """Numbers only: of a text column none, as a spreadsheet counts text that looks like a number as text."""
    return F.count_if(F.lit(False)) if kind == "string" else F.count(value)


def _count_all(value: str, kind: str | None = None) -> Column:
    """All that isn't empty, of any kind."""
    return F.count_if(F.col(value).isNotNull() & (F.col(value) != "")) if kind == "string" else F.count(value)


#: SUBTOTAL codes.
SUBTOTALS: dict[int, object] = {
    1: F.avg, 2: _count, 3: _count_all, 4: F.max, 5: F.min, 6: F.product, 7: F.stddev_samp, 8: F.stddev_pop, 9: F.sum, 10: F.var_samp, 11: F.var_pop,
}


def subtotal(code: int, value: str, kind: str | None = None) -> Column:
    """The aggregate of a column, whose type is kind (only `string` matters, to the two counts)."""
    make = SUBTOTALS[code % 100]
    return make(value, kind) if code % 100 in (2, 3) else make(value)


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and what right adds where all keys are equal, null with null."""
    right = right.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(right[f"_key{i}"]) for i, k in enumerate(keys)]
    joined = left.join(right, reduce(Column.__and__, same), how)
    return joined.drop(*(f"_key{i}" for i in range(len(keys))))


def placed(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """The distinct values of each group with `_n` (their rows), `_before` (the group's rows with a smaller value) and `_total`
    (the group's rows with a value). Nulls take no part.

    Values are counted before they are shuffled, dealt to ranges in the order of group and value, and summed up within ranges; the
    rows of earlier ranges come from a small table with a row a range and group in it. So no task holds a whole group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count(F.lit(1)).alias("_n"))
    # Cut, as places depend on how values are dealt.
    ranges = cut(counts.repartitionByRange(*within, value).withColumn("_p", F.spark_partition_id()))
    group, earlier = Window.partitionBy(*within), (Window.unboundedPreceding, -1)
    sums = ranges.groupBy(*within, "_p").agg(F.sum("_n").alias("_s"))
    first = F.coalesce(F.sum("_s").over(group.orderBy("_p").rowsBetween(*earlier)), F.lit(0))
    sums = sums.select(*within, "_p", first.alias("_first"), F.sum("_s").over(group).alias("_total"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*within, "_p").orderBy(value).rowsBetween(*earlier)), F.lit(0))
    found = _matched(ranges.withColumn("_before", inside), sums, [*within, "_p"])
    return found.select(*within, value, "_n", (F.col("_first") + F.col("_before")).alias("_before"), "_total")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], within: list[str], size: str | None = None) -> DataFrame:
    """A row a group with the exact quantiles (0 to 1) of its values under the names given, as PERCENTILE.INC interpolates them, and
    with the count of values under the name `size`. Nulls take no part; a group without values has no row."""
    if not all(0 <= k <= 1 for k in shares.values()):
        raise ValueError("quantiles lie between 0 and 1")
    rows = placed(df.select(*within, F.col(value).cast("double").alias("_value")), "_value", within)
    picked, out = {}, {}
    for i, (name, k) in enumerate(shares.items()):
        at = (F.col("_total") - 1) * F.lit(float(k))
        for side, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
            picked[f"_{side}{i}"] = F.max(F.when(here, F.col("_value")))
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        out[name] = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    ends = rows.groupBy(*within).agg(F.max("_total").alias("_total"), *(c.alias(k) for k, c in picked.items()))
    counted = [F.col("_total").alias(size)] if size else []
    return ends.select(*within, *(c.alias(k) for k, c in out.items()), *counted)


def ranks(df: DataFrame, value: str, within: list[str], down: bool = True) -> DataFrame:
    """df with rank_eq and rank_avg of the value within its group. Empty cells have no rank and count in none."""
    first = 1 + (F.col("_total") - F.col("_before") - F.col("_n") if down else F.col("_before"))
    found = placed(df, value, within).select(*within, value, first.alias("rank_eq"), (first + (F.col("_n") - 1) / 2).alias("rank_avg"))
    return _matched(df, found, [*within, value], "left")


def nth(df: DataFrame, value: str, k: int, within: list[str], largest: bool = True) -> DataFrame:
    """The k-th largest (or smallest) value of each group; groups with fewer have none."""
    before = F.col("_total") - F.col("_before") - F.col("_n") if largest else F.col("_before")
    return placed(df, value, within).filter((before < k) & (k <= before + F.col("_n"))).select(*within, F.col(value).alias("value"))


def trimmed_mean(df: DataFrame, value: str, share: float, within: list[str]) -> DataFrame:
    """The mean of each group without the share of its values that are outermost, half at each end and rounded down. Of a value
    that occurs often only some of its rows may be left out."""
    off = F.floor(F.col("_total") * share / 2)
    last = F.least(F.col("_before") + F.col("_n"), F.col("_total") - off)
    rows = placed(df, value, within).withColumn("_kept", last - F.greatest(F.col("_before"), off)).filter("_kept > 0")
    return rows.groupBy(*within).agg((F.sum(F.col(value) * F.col("_kept")) / F.sum("_kept")).alias("trimmed_mean"))


def frequency(df: DataFrame, value: str, bins: list[float], within: list[str]) -> DataFrame:
    """FREQUENCY: the values of each group up to each bin's upper bound (`up_to`; null for what is above the last), zero counts
    included. Bins are sorted; a bound given twice counts nothing the second time, so it is kept once. Nulls take no part."""
    bounds = sorted({float(b) for b in bins})
    x = F.col(value).cast("double")
    tests, low = [], None
    for bound in [*bounds, None]:
        here = F.lit(True) if low is None else x > low
        here = here if bound is None else here & (x <= bound)
        tests.append(F.struct(F.lit(bound).cast("double").alias("up_to"), F.count_if(x.isNotNull() & here).alias("n")))
        low = bound
    return df.groupBy(*within).agg(F.array(*tests).alias("_bins")).select(*within, F.inline("_bins"))


FIT = "coefficients array<double>, intercept double, errors array<double>, intercept_error double, r2 double, se double, f double, df long, n long"


def linear_fit(df: DataFrame, y: str, xs: list[str], within: list[str], exponential: bool = False) -> DataFrame:
    """LINEST with any number of regressors (LOGEST, if exponential): a row a group with `coefficients` in the order of xs, `intercept`,
    their standard errors, `r2`, `se`, `f`, degrees of freedom `df` and `n`. Rows with a null among y and xs (or a y that has no
    logarithm) take no part.

    Means and covariances are gathered in one aggregate, which combines on the map side; what is left is a row a group, whose equations
    are solved in Arrow batches. Regressors that depend on others get the coefficients of least length, and df counts
    independent ones only, as do the figures that are based on it; their errors are null."""
    y_ = F.col(y).cast("double")
    y_ = F.when(y_ > 0, F.ln(y_)) if exponential else y_
    rows = df.select(*within, y_.alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs))).dropna(subset=["_y", *(f"_x{i}" for i in range(len(xs)))])
    names = ["_y", *(f"_x{i}" for i in range(len(xs)))]
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"), F.array(*(F.avg(c) for c in names)).alias("_mean"), F.array(*pairs).alias("_cov"))

    def solve(n: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_solved(*r, exponential) for r in zip(n, mean, cov, strict=True)], columns=[c.split()[0] for c in FIT.split(", ")])

    fit = F.pandas_udf(solve, f"struct<{', '.join(c.replace(' ', ':', 1) for c in FIT.split(', '))}>")
    return sums.select(*within, fit("_n", "_mean", "_cov").alias("_fit")).select(*within, "_fit.*")


def _solved(n: int, mean: list[float], cov: list[float], exponential: bool) -> tuple:
    """The figures of FIT of one group, from means and the upper triangle of covariances."""
    k = len(mean) - 1
    full = np.zeros((k + 1, k + 1))
    full[np.triu_indices(k + 1)] = cov
    sxx, sxy, syy, centre = n * (full + np.triu(full, 1).T)[1:, 1:], n * full[0, 1:], n * full[0, 0], np.asarray(mean)
    # In units of each regressor's spread, so that no one decides which count as dependent.
    unit = np.sqrt(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0))
    inverse = np.linalg.pinv(sxx / np.outer(unit, unit), rcond=1e-12, hermitian=True) / np.outer(unit, unit)
    rank = int(np.linalg.matrix_rank(sxx / np.outer(unit, unit), tol=1e-12 * k, hermitian=True)) if k else 0
    b = inverse @ sxy
    a, explained, df = centre[0] - b @ centre[1:], float(b @ sxy), int(n) - 1 - rank
    rest = max(syy - explained, 0.0)
    variance = rest / df if df > 0 else None
    known = variance is not None and rank == k
    errors = np.sqrt(variance * np.diag(inverse)).tolist() if known else None
    spread = float(np.sqrt(variance * (1 / n + centre[1:] @ inverse @ centre[1:]))) if known else None
    if exponential:
        b, a = np.exp(b), np.exp(a)
    r2 = explained / syy if syy > 0 else None
    f = explained / rank / variance if variance and rank else None
    return b.tolist(), float(a), errors, spread, r2, variance**0.5 if variance is not None else None, f, df, int(n)


def fitted(rows: DataFrame, fit: DataFrame, xs: list[str], within: list[str], name: str = "trend", exponential: bool = False) -> DataFrame:
    """TREND (GROWTH, if exponential): rows with the value that their group's linear_fit gives for their xs; null without a fit."""
    found = fit.select(*within, F.col("coefficients").alias("_b"), F.col("intercept").alias("_a"))
    out = _matched(rows, found, within, "left") if within else rows.join(F.broadcast(found), how="left")  # without groups, one row
    trend = F.col("_a")
    for i, x in enumerate(xs):
        c = F.col("_b")[i]
        trend = trend * F.pow(c, F.col(x).cast("double")) if exponential else trend + c * F.col(x).cast("double")
    return out.withColumn(name, trend).drop("_a", "_b")


def mode(df: DataFrame, value: str, within: list[str]) -> DataFrame:
    """The most frequent value of each group, the least of several."""
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*within).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("mode"), F.max("n").alias("times"))


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str | None = None, missing: object = None) -> DataFrame:
    """Exact lookup: rows with the value of the first table row with its key (by `order`), else `missing`."""
    first = F.min_by(value, order) if order else F.first(value)
    firsts = table.filter(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias(key)).agg(first.alias("found"), F.lit(True).alias("_hit"))
    out = rows.join(firsts, key, "left")
    return out.withColumn("found", F.when(F.col("_hit"), F.col("found")).otherwise(F.lit(missing))).drop("_hit")


def lookup_sorted(rows: DataFrame, at: str, table: DataFrame, table_at: str, value: str, by: list[str]) -> DataFrame:
    """Approximate lookup: rows with the value of the last table row at or before them, within the key columns `by`.

    Both sides are dealt together to ranges in the order of key and place, so a key that holds most rows is many tasks. The last value
    within a range is a window's; the one that a range begins with comes from a small table with a row a range and key in it."""
    left = rows.withColumns({"_at": F.col(at), "_table": F.lit(False), "_value": F.lit(None).cast(dict(table.dtypes)[value])})
    right = table.select(*by, F.col(table_at).alias("_at"), F.lit(True).alias("_table"), F.col(value).alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_id", F.monotonically_increasing_id())  # splits ties
    dealt = both.repartitionByRange(*by, F.asc("_at"), F.desc("_table"), "_id").drop("_id")
    ranges = cut(dealt.withColumn("_p", F.spark_partition_id()))  # as the ranges depend on a sample
    ends = ranges.groupBy(*by, "_p").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_at"))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_p", F.last("_end", ignorenulls=True).over(earlier).alias("_in"))
    w = Window.partitionBy(*by, "_p").orderBy("_at", F.desc("_table")).rowsBetween(Window.unboundedPreceding, 0)
    found = ranges.withColumn("found", F.last("_value", ignorenulls=True).over(w)).filter("NOT _table")
    found = _matched(found, ends, [*by, "_p"]).withColumn("found", F.coalesce("found", "_in"))
    return found.drop("_at", "_table", "_value", "_p", "_in")
