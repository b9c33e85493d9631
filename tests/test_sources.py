"""The xlsx data source, saved plans and functions of the user's own."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellarium.functions import registry as R
from cellarium.functions import user
from cellarium.operators import graph as G
from cellarium.operators import ranges
from cellarium.plans import dashboard as D
from cellarium.plans import workbook as W
from cellarium.sources import workbook_source, xlsx


@pytest.fixture
def books(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.written({"One": [[1, "=A1*2", "text", True], [None, "=B1+1"]], "Two": [[i, f"=A{i}"] for i in range(1, 301)]}, hidden=("Two",)))
    (tmp_path / "b.xlsx").write_bytes(xlsx.written({"One": [["x"]]}))
    (tmp_path / "c.xlsx").write_bytes(b"")
    (tmp_path / "d.xlsx").write_bytes(b"nothing" * 100)
    (tmp_path / "notes.txt").write_bytes(b"no workbook")
    workbook_source.register(spark)
    return str(tmp_path)


def test_source_equals_whole_files(spark, books):
    name = F.substring_index("file", "/", -1).alias("file")
    got = spark.read.format("xlsx").load(books).select(name, *(c for c in ("sheet", "row", "col", "coord", "num", "txt", "bool", "err", "formula")))
    want = xlsx.cells(spark, f"{books}/[ab].xlsx").select(name, *got.columns[1:])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 606
    assert got.rdd.getNumPartitions() == 3  # a sheet each
    assert sorted(map(str, spark.read.format("xlsx").load(f"{books}/a.*").select("row").distinct().collect())) == sorted(f"Row(row={i})" for i in range(1, 301))


def test_source_options(spark, books):
    read = lambda **o: spark.read.format("xlsx").options(**o).load(books)
    assert read(sheet="One").count() == 6 and read().filter("sheet = 'Two'").count() == 600 and read(sheet="None").count() == 0
    assert read(sheet="Two").rdd.getNumPartitions() == 1
    assert {r.formula for r in read(mode="formulas", sheet="One").collect()} == {"=A1*2", "=B1+1"}
    assert {(r.sheet, r.position, r.state) for r in read(mode="sheets").collect()} == {("One", 0, "visible"), ("Two", 1, "hidden")}
    refused = {r.file.rsplit("/", 1)[-1]: r.reason for r in read(mode="refused").collect()}
    assert refused == {"c.xlsx": "no zip file", "d.xlsx": "no zip file"}
    assert {r.file.rsplit("/", 1)[-1] for r in read(mode="refused", ratio="2").collect()} > {"a.xlsx"} and read(largest="10").count() == 0
    with pytest.raises(Exception, match="mode 'x' is none of"):
        read(mode="x").count()


def test_dashboard_from_a_workbook(spark, tmp_path):
    rows = [["region", "amount"], ["north", 10], ["south", 5.5], ["north", 2]]
    (tmp_path / "s.xlsx").write_bytes(xlsx.written({"Hidden": [["x"]], "Sales": rows, "Other": [["region", "amount"], ["west", 1]]}, hidden=("Hidden",)))
    (tmp_path / "s.csv").write_text("\n".join(",".join(map(str, r)) for r in rows))
    book, text = D.dashboard_from_xlsx(spark, f"{tmp_path}/s.xlsx"), D.dashboard_from_csv(spark, f"{tmp_path}/s.csv")
    assert book["data_views"] == text["data_views"] and book["components"] == text["components"]
    other = D.dashboard_from_xlsx(spark, f"{tmp_path}/s.xlsx", "Other")
    assert other["data_views"] != book["data_views"]
    with pytest.raises(ValueError, match="no sheet"):
        D.dashboard_from_xlsx(spark, f"{tmp_path}/s.xlsx", "Nowhere")


def test_books_written_by_tasks(spark, tmp_path):
    workbook_source.register(spark)
    df = spark.range(6).select((F.col("id") % 2).alias("k"), "id")
    files = xlsx.write_books(df, "k", f"{tmp_path}/out", lambda g: {"S": [[int(x), f"=A{i}+1"] for i, x in enumerate(sorted(g["id"]), 1)]})
    assert {r.file.rsplit("/", 1)[-1] for r in files.collect()} == {"0.xlsx", "1.xlsx"}
    got = spark.read.format("xlsx").load(f"{tmp_path}/out").filter("num IS NOT NULL")
    assert sorted(r.num for r in got.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_saved_plans(spark, tmp_path):
    rows = [("f", "S", i, 1, f"A{i}", float(i), None, None, None, None) for i in range(1, 6)] + [("f", "S", i, 2, f"B{i}", None, None, None, None, f"=B{i - 1}+A{i}" if i > 1 else "=A1") for i in range(1, 6)]
    cells = spark.createDataFrame(rows, xlsx.CELLS)
    W.planned(cells).save(f"{tmp_path}/plan")
    plan = W.Plan.load(spark, f"{tmp_path}/plan")
    changes = spark.createDataFrame([("s", "S", 3, 1, 10.0)], "scenario string, sheet string, row int, col int, num double")
    assert {r.row: r.value.n for r in plan.values(changes).filter("col = 2").collect()} == {1: 1.0, 2: 3.0, 3: 13.0, 4: 17.0, 5: 22.0}
    steps = spark.read.schema(W.STEPS).json(f"{tmp_path}/plan/steps").withColumn("version", F.lit(99))
    steps.write.json(f"{tmp_path}/other/steps")
    with pytest.raises(ValueError, match="version"):
        W.Plan.load(spark, f"{tmp_path}/other")


def test_functions_of_the_user(spark):
    user.add("triple", "ARITHMETIC", 1, columns=lambda x: x * 3)
    user.add("LENGTHS", "ARITHMETIC", 1, arrow=lambda xs: pa.array([None if x is None else float(len(str(int(x)))) for x in xs.to_pylist()]))
    user.add("LAST", "AGGREGATION", 1, 5, columns=lambda xs: F.try_element_at(xs, F.size(xs)), ranges=True)
    try:
        assert user.added() == ["LAST", "LENGTHS", "TRIPLE"] and R.classify(["TRIPLE"]) == "ARITHMETIC"
        made = {(1, 1): 5.0, (2, 1): 120.0, (1, 2): "=TRIPLE(A1)", (2, 2): "=TRIPLE(B1)+LENGTHS(A2)", (3, 2): "=LAST(A1:A2)", (4, 2): "=TRIPLE(1,2)", (5, 2): '=TRIPLE("x")'}
        made |= {(1, 3): 1.0} | {(i, 3): f"=LENGTHS(C{i - 1})*10" for i in range(2, 6)}  # a chain with a Python function goes cell by cell
        cells = spark.createDataFrame([("f", "S", r, c, "", None if isinstance(v, str) else v, None, None, None, v if isinstance(v, str) else None) for (r, c), v in made.items()], xlsx.CELLS)
        got = {(r.row, r.col): r.value.n if r.value.e is None else r.value.e for r in W.evaluate(cells).collect()}
        assert [got[i, 2] for i in range(1, 6)] == [15.0, 48.0, 120.0, "#VALUE!", "#VALUE!"] and [got[i, 3] for i in range(1, 6)] == [1.0, 10.0, 20.0, 20.0, 20.0]
        assert not [r for r in G.risks(cells, G.parsed(cells), G.edges(cells, G.parsed(cells))).filter("kind = 'unresolved'").collect()]
        for bad in (("SUM", "ARITHMETIC"), ("NEW", "NOSUCHCLASS")):
            with pytest.raises(ValueError):
                user.add(*bad, 1, columns=lambda x: x)
        with pytest.raises(ValueError):
            user.add("NEW", "ARITHMETIC", 1)
    finally:
        for name in user.added():
            user.remove(name)
    assert "TRIPLE" not in R.FUNCTIONS and user.added() == []
    user.remove("SUM")
    assert "SUM" in R.FUNCTIONS


def test_subtotals_of_text(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("",)], "t string")
    assert tuple(df.agg(*(ranges.subtotal(k, "t", "string") for k in (2, 3, 102, 103))).first()) == (0, 2, 0, 2)
