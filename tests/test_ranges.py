"""Operators that need an order, and fits, against numpy and plain Python on small tables with nulls, ties and hot groups."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cellarium.operators import ranges as R


def _rows(seed: int = 5) -> list[tuple[str | None, float | None, int]]:
    """A group with two thirds of the rows, a null group, ties, nulls, one group of a single row and one of nulls only."""
    pick = random.Random(seed)
    rows = [("hot", float(pick.randint(-40, 40)) / 4, i) for i in range(2000)]
    rows += [(None, pick.gauss(0, 1), i) for i in range(2000, 2300)]
    rows += [("few", pick.choice([None, 1.0, 1.0, 2.5, -0.0, 0.0, 1e300, -1e300]), i) for i in range(2300, 2400)]
    return [*rows, ("one", 7.0, 2400), ("none", None, 2401), ("none", None, 2402)]


def _groups(rows: list) -> dict:
    out: dict = {}
    for g, v, _ in rows:
        out.setdefault(g, []).extend([] if v is None else [v])
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), "g string, v double, id int").repartition(7)


def test_quantiles(table):
    shares = {"least": 0.0, "q1": 0.25, "mid": 0.5, "p97": 0.97, "most": 1.0}
    found = {r.g: r for r in R.quantiles(table, "v", shares, ["g"], size="n").collect()}
    expected = {g: v for g, v in _groups(_rows()).items() if v}
    assert found.keys() == expected.keys()
    for g, values in expected.items():
        assert found[g].n == len(values)
        for name, k in shares.items():
            assert math.isclose(found[g][name], np.quantile(values, k), rel_tol=1e-12, abs_tol=1e-12), (g, name)


def test_quantiles_of_all_rows_and_of_none(spark, table):
    values = [v for _, v, _ in _rows() if v is not None]
    assert math.isclose(R.quantiles(table, "v", {"mid": 0.5}, []).first().mid, np.median(values))
    assert R.quantiles(table.limit(0), "v", {"mid": 0.5}, ["g"]).count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        R.quantiles(table, "v", {"x": 1.5}, ["g"])


@pytest.mark.parametrize("down", [True, False])
def test_ranks(table, down):
    groups = _groups(_rows())
    found = R.ranks(table, "v", ["g"], down).collect()
    assert len(found) == len(_rows())
    for r in found:
        if r.v is None:
            assert r.rank_eq is None and r.rank_avg is None
            continue
        before = sum((x > r.v) if down else (x < r.v) for x in groups[r.g])
        assert r.rank_eq == before + 1
        assert r.rank_avg == before + 1 + (groups[r.g].count(r.v) - 1) / 2


@pytest.mark.parametrize("largest", [True, False])
def test_nth(table, largest):
    for k in (1, 2, 150):
        expected = {g: sorted(v, reverse=largest)[k - 1] for g, v in _groups(_rows()).items() if len(v) >= k}
        assert {r.g: r.value for r in R.nth(table, "v", k, ["g"], largest).collect()} == expected


def test_trimmed_mean(table):
    table = table.filter("g IS NULL OR g <> 'few'")
    expected = {}
    for g, values in _groups(_rows()).items():
        off = math.floor(len(values) * 0.3 / 2)
        if values and g != "few":
            expected[g] = float(np.mean(sorted(values)[off : len(values) - off]))
    found = {r.g: r.trimmed_mean for r in R.trimmed_mean(table, "v", 0.3, ["g"]).collect()}
    assert found.keys() == expected.keys()
    assert all(math.isclose(found[g], expected[g], rel_tol=1e-9, abs_tol=1e-12) for g in expected)


def test_a_hot_group_is_many_tasks(spark):
    """One group holds all rows; its places hold without ranges being put together."""
    df = spark.range(0, 50_000, numPartitions=8).selectExpr("'x' AS g", "CAST(id * 7919 % 50000 AS DOUBLE) AS v")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = R.placed(df, "v", ["g"])
        assert placed.filter("_before = v AND _n = 1 AND _total = 50000").count() == 50_000
        assert R.quantiles(df, "v", {"mid": 0.5}, ["g"]).first().mid == 24_999.5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_lookup_sorted(spark):
    pick = random.Random(8)
    table = [("hot" if i % 3 else f"k{i % 5}", t, i if i % 4 else None) for i, t in enumerate(pick.sample(range(5000), 900))]
    rows = [(i, pick.choice(["hot", "hot", "k0", "k3", "absent", None]), pick.choice([None, *range(-5, 5000, 7)])) for i in range(3000)]
    found = R.lookup_sorted(spark.createDataFrame(rows, "id int, k string, at int").repartition(5), "at", spark.createDataFrame(table, "k string, t int, v int"), "t", "v", ["k"])
    assert found.columns == ["id", "k", "at", "found"]
    got = {r.id: r.found for r in found.collect()}
    assert len(got) == len(rows)
    for i, k, at in rows:
        earlier = [(t, v) for key, t, v in table if key == k and at is not None and t <= at and v is not None]
        assert got[i] == (max(earlier)[1] if earlier else None), (i, k, at)


def test_frequency(spark, table):
    bins = [2.5, -1.0, 0.0, 2.5]
    found = {(r.g, r.up_to): r.n for r in R.frequency(table, "v", bins, ["g"]).collect()}
    for g, values in _groups(_rows()).items():
        edges = [-math.inf, -1.0, 0.0, 2.5, math.inf]
        for low, up in zip(edges, edges[1:], strict=False):
            assert found[g, None if up == math.inf else up] == sum(low < v <= up for v in values)
    assert {r.n for r in R.frequency(table, "v", [], ["g"]).collect()} == {len(v) for v in _groups(_rows()).values()}


def _points(seed: int = 3) -> list[tuple]:
    pick = random.Random(seed)
    rows = []
    for i in range(400):
        a, b, c = pick.uniform(1e6, 1e6 + 50), pick.gauss(0, 1), float(i % 7)
        rows.append(("a" if i % 4 else None, 3 * a - 2 * b + 0.5 * c + 40 + pick.gauss(0, 0.3), a, b, None if i % 29 == 0 else c))
    return rows


def test_linear_fit_against_least_squares(spark):
    points = _points()
    df = spark.createDataFrame(points, "g string, y double, a double, b double, c double").repartition(6)
    found = {r.g: r for r in R.linear_fit(df, "y", ["a", "b", "c"], ["g"]).collect()}
    for g in ("a", None):
        rows = np.array([p[1:] for p in points if p[0] == g and p[4] is not None])
        x, y = np.c_[rows[:, 1:] - rows[:, 1:].mean(0), np.ones(len(rows))], rows[:, 0]  # centred, so that it is well conditioned
        b, rest, _, _ = np.linalg.lstsq(x, y, rcond=None)
        r = found[g]
        assert (r.n, r.df) == (len(rows), len(rows) - 4)
        assert np.allclose(r.coefficients, b[:3], rtol=1e-7)
        assert math.isclose(r.intercept, b[3] - b[:3] @ rows[:, 1:].mean(0), rel_tol=1e-6)
        variance = float(rest[0]) / r.df
        assert math.isclose(r.se, variance**0.5, rel_tol=1e-6)
        assert np.allclose(r.errors, np.sqrt(variance * np.diag(np.linalg.inv(x.T @ x))[:3]), rtol=1e-6)
        assert math.isclose(r.r2, 1 - float(rest[0]) / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    trend = R.fitted(df, R.linear_fit(df, "y", ["a", "b", "c"], ["g"]), ["a", "b", "c"], ["g"])
    assert trend.count() == len(points) and trend.filter("c IS NOT NULL AND abs(trend - y) > 2").count() == 0
    assert trend.filter("c IS NULL AND trend IS NOT NULL").count() == 0


def test_linear_fit_of_awkward_groups(spark):
    rows = [("twice", 2.0 * i + 1, float(i), 3.0 * i) for i in range(6)] + [("flat", 5.0, float(i), 0.0) for i in range(4)] + [("one", 1.0, 2.0, 3.0), ("null", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double, q double")
    found = {r.g: r for r in R.linear_fit(df, "y", ["p", "q"], ["g"]).collect()}
    assert found.keys() == {"twice", "flat", "one"}  # a group without whole rows has no fit
    b = found["twice"].coefficients
    assert math.isclose(b[0] + 3 * b[1], 2) and found["twice"].errors is None and found["twice"].df == 4
    assert found["flat"].r2 is None and np.allclose(found["flat"].coefficients, 0) and found["flat"].intercept == 5
    assert found["one"].intercept == 1 and found["one"].se is None and found["one"].coefficients == [0, 0]
    assert R.linear_fit(df.limit(0), "y", ["p"], ["g"]).count() == 0


def test_exponential_fit(spark):
    df = spark.createDataFrame([(float(x), 2.0 * 1.5**x * 0.5**z, float(z)) for x in range(5) for z in range(4)] + [(1.0, -3.0, 1.0)], "x double, y double, z double")
    fit = R.linear_fit(df, "y", ["x", "z"], [], exponential=True)
    r = fit.first()
    assert np.allclose([*r.coefficients, r.intercept], [1.5, 0.5, 2.0]) and r.n == 20
    out = R.fitted(df, fit, ["x", "z"], [], "growth", exponential=True)
    assert out.filter("y > 0 AND abs(growth - y) > 1e-9").count() == 0 and out.count() == 21
