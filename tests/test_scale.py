"""What must hold of large tables, shown on small ones."""

import random
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from cellarium.catalog.ledgers import filled, sheet
from cellarium.catalog.spreadsheet import by_formulas
from cellarium.functions.library_stats import inverse, t_cdf
from cellarium.functions.registry import python_number
from cellarium.operators import audit as A
from cellarium.operators import graph as G
from cellarium.operators import runs as R
from cellarium.operators.thresholds import Thresholds
from cellarium.plans import recalc
from cellarium.session import cut


def test_formulas_are_spread_over_tasks(spark):
    rows = spark.range(1000).coalesce(1).select("id", F.col("id").cast("double").alias("x"))
    out = by_formulas(rows, "id", ["id", "x"], {"y": "=B1*2"})
    assert out.select(F.spark_partition_id()).distinct().count() == 4
    assert out.agg(F.sum("y")).first()[0] == 999_000


def test_inverse_stops_where_no_number_is_left():
    calls = []

    def f(x):
        calls.append(x)
        return t_cdf(x, 3)

    assert abs(t_cdf(inverse(f, 0.975, -1e6, 1e6), 3) - 0.975) < 1e-12 and len(calls) < 120


def test_arguments_that_recur_are_computed_once(spark):
    called = spark.sparkContext.accumulator(0)

    def f(x: float) -> float:
        called.add(1)
        return 1 / x if x else 0.0

    got = spark.range(1000).coalesce(1).select(F.sum(python_number(f)(F.col("id") % 4))).first()[0]
    assert got == pytest.approx(250 * (1 + 1 / 2 + 1 / 3)) and called.value == 4


@pytest.mark.parametrize("name", ["churn", "leaks_by_product", "product_trends", "rfm_champions", "service_decomposition"])
def test_sales_are_read_once(spark, name):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, schema=b.schema)

    rows = [(f"p{i % 3}", f"c{i % 5}", float(i), i) for i in range(60)]
    sales = spark.createDataFrame(rows, "product string, customer string, value double, i long")
    sales = sales.select(
        F.expr("timestamp_ntz'2023-01-01' + make_interval(0, 0, 0, cast(i * 7 as int))").alias("date"),
        "product", "customer", "value", F.lit(1.0).alias("quantity"), F.lit(0.5).alias("entry_cost"), F.lit("A").alias("category"), F.lit("s").alias("store"), F.lit("v").alias("salesperson"),
        F.lit("x").alias("payment_method"), F.lit("f").alias("source_file"), F.col("i").alias("source_row"),
    )
    getattr(A, name)(sales.mapInArrow(counted, sales.schema), Thresholds()).collect()
    assert read.value == 60


def test_stretches_over_tiles(spark, monkeypatch):
    """Against plain stretches, with tiles of four cells; every group that is ordered has few rows."""
    monkeypatch.setattr(R, "LONG", 2)
    draw = random.Random(3)
    cells = [("f", "s", r, c, draw.choice("AAAAAB")) for c in (1, 2) for r in range(1, 60) if draw.random() < 0.9]
    frame = spark.createDataFrame(cells, "file string, sheet string, row int, col int, template string")
    got = {(r.row, r.col): (r.a, r.b) for r in R._stretches(frame, "col", "row").collect()}
    there = {(r, c): t for _, _, r, c, t in cells}
    for (r, c), t in there.items():
        a = b = r
        while there.get((a - 1, c)) == t:
            a -= 1
        while there.get((b + 1, c)) == t:
            b += 1
        assert got[r, c] == (a, b)
    assert len(got) == len(there)


def test_cells_are_not_broadcast_by_estimate(spark, monkeypatch):
    """Cells that explode from few rows look small to estimates; their joins must not go through the driver."""
    plans, checkpoint = [], DataFrame.checkpoint

    def seen(df, eager=True):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, eager)

    monkeypatch.setattr(DataFrame, "checkpoint", seen)
    rows = spark.range(20).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(5))))
    cells = sheet(rows, {1: F.col("r")}, {}, {2: filled("=A{r}*2")}, F.col("id").cast("string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert cut(R.placed(G.parsed(cells))).count() == 100
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_shuffle_files_go_with_what_needed_them(spark):
    """They don't wait for the driver to collect garbage, which a large disk's worth of them may come before."""
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for at in places for f in Path(at).rglob("shuffle_*.data")}
    before = files()
    frame = cut(spark.range(1000).repartition(5, "id"))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and frame.count() == 1000


def test_parts_make_up_ranges(spark, monkeypatch):
    """Each range is its rows, each once, in few parts, however many tiles it reaches over."""
    monkeypatch.setattr(recalc, "TILE", 2)
    heights = recalc.heights_of(90)
    ranges = [(t, b) for t in (1, 2, 4, 5, 16, 17, 30) for b in (*range(t, 91, 3), None)]
    df = spark.createDataFrame(ranges, "t int, b int").select("t", "b", recalc._parts_of(F.col("t"), F.col("b"), heights).alias("parts"))
    for r in df.collect():
        rows = []
        for p in r.parts:
            tile = p.k >> 2 << 2
            units = {recalc.FROM: range(p.k, tile + 4), recalc.TO: range(tile, p.k + 1), recalc.WITHIN: range(p.k << p.h, p.k + 1 << p.h)}[p.kind]
            rows += [u * 4**p.level + i + 1 for u in units for i in range(4**p.level)]
        assert sorted(rows) == list(range(r.t, (r.b or 1 << heights - 1) + 1))
        assert len(r.parts) <= recalc._tiles_over(heights) * (1 if r.t == 1 else 2)
