"""Fits with several regressors and counts in bins over tables, and their SQL in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.catalog.audit import read
from cellarium.operators import ranges as R

PRICE, BY_PRICE = "l_extendedprice", ["l_quantity", "l_discount"]


def _figures(fit: DataFrame, by: str) -> DataFrame:
    def figure(c: Column, places: int) -> Column:
        return F.round(c, places)

    b, e = F.col("coefficients"), F.col("errors")
    named = {"b1": b[0], "b2": b[1], "a": F.col("intercept"), "e1": e[0], "e2": e[1], "ea": F.col("intercept_error")}
    named |= {"r2": F.col("r2"), "se": F.col("se")}
    return fit.select(by, "n", "df", F.round("f", 1).alias("f"), *(figure(c, 6).alias(k) for k, c in named.items()))


def linest_fit(s: SparkSession, d: str) -> DataFrame:
    return _figures(R.linear_fit(read(s, d, "lineitem"), PRICE, BY_PRICE, ["l_returnflag"]), "l_returnflag")


def logest_fit(s: SparkSession, d: str) -> DataFrame:
    return _figures(R.linear_fit(read(s, d, "lineitem"), PRICE, BY_PRICE, ["l_linestatus"], exponential=True), "l_linestatus")


def trend_values(s: SparkSession, d: str) -> DataFrame:
    rows, xs = read(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_size", "p_partkey"]
    out = R.fitted(rows, R.linear_fit(rows, "p_retailprice", xs, ["p_brand"]), xs, ["p_brand"])
    return out.select("p_partkey", F.round("trend", 4).alias("trend"))


def frequency_bins(s: SparkSession, d: str) -> DataFrame:
    return R.frequency(read(s, d, "lineitem"), "l_quantity", [30, 10, 20, 20, 45.5], ["l_returnflag"])


QUERIES = {"linest_fit": linest_fit, "logest_fit": logest_fit, "trend_values": trend_values, "frequency_bins": frequency_bins}


def _sums(table: str, by: str, y: str, x1: str, x2: str) -> str:
    """Common table expressions: means, sums of squares and the two coefficients of each group."""
    return f"""c AS (SELECT {by}, count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, count(*) * covar_pop({y}, {y}) AS syy,
  count(*) * covar_pop({x1}, {x1}) AS s11, count(*) * covar_pop({x1}, {x2}) AS s12, count(*) * covar_pop({x2}, {x2}) AS s22,
  count(*) * covar_pop({x1}, {y}) AS s1, count(*) * covar_pop({x2}, {y}) AS s2 FROM {table} GROUP BY 1),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS b2 FROM c),
a AS (SELECT *, my - b1 * m1 - b2 * m2 AS a, b1 * s1 + b2 * s2 AS ex, (syy - b1 * s1 - b2 * s2) / (n - 3) AS v FROM b)"""


def _fit(by: str, y: str, wrap: str) -> str:
    shown = ", ".join(f"round({wrap}({c}), 6) AS {c}" for c in ("b1", "b2", "a"))
    return f"""WITH {_sums("lineitem", by, y, *BY_PRICE)}
SELECT {by}, n, n - 3 AS df, round(ex / 2 / v, 1) AS f, {shown}, round(sqrt(v * s22 / det), 6) AS e1, round(sqrt(v * s11 / det), 6) AS e2,
  round(sqrt(v * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 6) AS ea, round(ex / syy, 6) AS r2, round(sqrt(v), 6) AS se FROM a"""


ORACLE_SQL = {
    "linest_fit": _fit("l_returnflag", PRICE, ""),
    "logest_fit": _fit("l_linestatus", f"ln({PRICE})", "exp"),
    "trend_values": f"""WITH {_sums("part", "p_brand", "p_retailprice", "p_size", "p_partkey")}
SELECT p_partkey, round(a + b1 * p_size + b2 * p_partkey, 4) AS trend FROM part JOIN a USING (p_brand)""",
    "frequency_bins": """WITH b(low, up_to) AS (VALUES (-1e300::DOUBLE, 10::DOUBLE), (10, 20), (20, 30), (30, 45.5), (45.5, NULL))
SELECT l_returnflag, up_to, count(*) FILTER (l_quantity > low AND l_quantity <= coalesce(up_to, 1e300)) AS n FROM lineitem, b GROUP BY 1, 2""",
}
