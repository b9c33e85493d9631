"""Cleaning, long tables, dashboards, workbooks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from cellarium.operators import cleaning as C
from cellarium.operators import graph as G
from cellarium.operators import longform as L
from cellarium.plans import dashboard as D
from cellarium.plans import workbook as W
from cellarium.sources import tables, xlsx
from cellarium.streaming import windows


def test_money(spark):
    cases = {"R$ 1.500,00": 1500.0, "1,234.56": 1234.56, "1.234.567": 1234567.0, "1.234": 1234.0, "12.5": 12.5, "7,5": 7.5, "€ 3": 3.0, "n/d": None, "": None, None: None, "-5": -5.0, "NaN": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.m for r in df.select(C.money(F.col("t")).alias("m")).collect()] == list(cases.values())


def test_dates(spark):
    df = spark.createDataFrame([("25/03/2024",), ("03/25/2024",)], "d string")
    with pytest.raises(C.AmbiguousDates):
        C.date_style(df, "d")
    assert C.date_style(df, "d", "mdy") == "MDY"
    good = spark.createDataFrame([("25/03/2024",), ("31/13/2024",), ("1/2/2024 10:30",), (None,)], "d string")
    assert C.date_style(good, "d") == "DMY"
    assert [str(r.x) for r in good.select(C.dates(F.col("d"), "DMY").alias("x")).collect()] == ["2024-03-25 00:00:00", "None", "2024-02-01 10:30:00", "None"]


def test_sales_are_accounted_for(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Data Emissão,Produto,Cliente,Valor,Qtd\n01/02/2024,P,,\"R$ 1.000,50\",2\n31/13/2024,P,C,1,1\n02/02/2024,,C,5,1\n02/02/2024,P,C,x,1\n")
    (tmp_path / "b.csv").write_text("foo,bar\n1,2\n")
    loaded, skipped = tables.sales_folder(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    row = loaded.accepted.first()
    assert (row.value, row.customer, row.source_row, row.quantity) == (2001.0, "SEM_CADASTRO", 2, 2.0)
    assert {r.reason: r.rows for r in loaded.summary().collect()} == {None: 1, "data_invalida": 1, "valor_nao_numerico": 1, "produto_ausente": 1}
    assert [p.endswith("b.csv") for p, _ in skipped] == [True]
    with pytest.raises(C.MissingRole):
        C.roles(["x"], C.STOCK_ROLES, C.REQUIRED["stock"])


def grid(spark, rows):
    n = len(rows[0])
    body = [(i + 2, *r) for i, r in enumerate(rows[1:])]
    return spark.createDataFrame(body, "row_no long, " + ", ".join(f"c{i} string" for i in range(n))), rows[0]


def test_wide_table(spark):
    g, h = grid(spark, [["city", "new", "old"], ["A", "1", "2,5"], ["", "", ""], ["B", "", "3"], ["Total Geral", "9", "9"], ["C", None, ""]])
    long = L.long_table(g, h)
    assert long.kind == "wide" and long.closure(5)
    assert [(r.city, r.status, r.quantidade, r.origin_cells["quantidade"]) for r in long.rows.orderBy("origin_row", "status").collect()] == [("A", "new", 1.0, "B2"), ("A", "old", 2.5, "C2"), ("B", "old", 3.0, "C4")]
    assert sorted((r.origin_row, r.reason) for r in long.discarded.collect()) == [(3, "empty"), (5, "grand_total"), (6, "no_measures")]


@pytest.mark.parametrize("stretch", [100_000, 2])
def test_nested_table(spark, monkeypatch, stretch):
    """The carried group is the same when it passes from stretch to stretch."""
    monkeypatch.setattr(L, "STRETCH", stretch)
    g, h = grid(spark, [["area", "n"], ["North", ""], ["a", "1"], ["b", "2"], ["Subtotal", "3"], ["South", None], ["c", "4"], ["South", "4"], ["Grand total", "7"]])
    long = L.long_table(g, h)
    assert long.kind == "pivot_hierarchical" and long.closure(8)
    assert [(r.area, r.subgrupo, r.quantidade) for r in long.rows.orderBy("origin_row").collect()] == [("North", "a", 1.0), ("North", "b", 2.0), ("South", "c", 4.0)]
    assert sorted(r.reason for r in long.discarded.collect()) == ["grand_total", "subtotal", "subtotal"]


def test_dashboard_from_a_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("CPF,aprovado,negado\n1,10,1\n2,20,2\n3,5,0\n")
    spec = D.dashboard_from_csv(spark, f"{tmp_path}/t.csv")
    assert [c["id"] for c in spec["components"]][0] == "summary_kpis"
    flat = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 1.0), ("c", "y", 0.0)], "id string, status string, quantidade double")
    spec = D.dashboard_spec(flat, flat.columns)
    assert [c["id"] for c in spec["components"]] == ["summary_kpis", "status_distribution", "entity_ranking"]
    assert spec["anomalies"][0]["metric"] == "x_rate" and spec["layout"] == [["summary_kpis"], ["status_distribution", "entity_ranking"]]
    numbers = spark.createDataFrame([("a_rate", 0.256), ("b_rate", 1.0), ("t", 1234.5), ("t", 1234567.0), ("t", -0.125), ("t", 0.0)], "metric string, value double")
    assert [r[0] for r in numbers.select(D.display(F.col("metric"), F.col("value"))).collect()] == ["25,6%", "100,0%", "1.234,50", "1.234.567", "-0,12", "0"]
    assert json.loads(tables.artifact({"k": flat}))["k"][0]["id"] == "a" and "<th>id</th>" in tables.page("t", {"k": flat})
    with pytest.raises(ValueError):
        D.check({"components": [{"id": "a"}], "data_views": {}, "layout": []})


def test_workbook(spark, tmp_path):
    book = {
        "In": [[1, 2, "x"], [3, 4, True], [None, 5]],
        "Calc": [["=In!A1+In!B1", "=SUM(In!A1:B3)", "=A1*B1"], ["=In!A2+In!B2", "=A3", "=VLOOKUP(3,In!A1:B2,2,FALSE)"], ["=B2", "=1/0", '=IFERROR(B3,"ok")'], ["=[Other.xlsx]S!A1", "=NOSUCH(1)", "=Calc!C4"]],
    }
    (tmp_path / "b.xlsx").write_bytes(xlsx.written(book))
    cells = xlsx.cells(spark, f"{tmp_path}/b.xlsx")
    found = {(r.sheet, r.row, r.col): r.value for r in W.evaluate(cells).collect()}
    value = lambda r, c: next((x for x in found["Calc", r, c] if x is not None), None)
    assert (value(1, 1), value(1, 2), value(1, 3), value(2, 1), value(2, 3), value(3, 3)) == (3.0, 15.0, 45.0, 7.0, 4.0, "ok")
    assert (value(2, 2), value(3, 1), value(3, 2), value(4, 1), value(4, 2), value(4, 3)) == ("#CYCLE!", "#CYCLE!", "#DIV/0!", "#EXT!", "#NAME?", "#CYCLE!")
    out = W.diagnose(spark, f"{tmp_path}/b.xlsx")
    assert {(r.name, r.kind) for r in out["cycles"].collect()} == {("Calc!B2", "direct"), ("Calc!A3", "direct"), ("Calc!C4", "self")}
    assert out["compatibility"].first().verdict == "restricted"
    assert {r.kind for r in out["risks"].collect()} == {"external_ref", "unresolved", "orphan_cell", "hardcoded_value"}
    assert {r.name: r.role for r in out["roles"].collect()}["In!A1"] == "input"
    changes = spark.createDataFrame([("s1", "In", 1, 1, 100.0), ("s2", "Calc", 1, 1, 7.0)], "scenario string, sheet string, row int, col int, num double")
    got = {(r.scenario, r.row, r.col): r.value.n for r in W.evaluate(cells, changes).filter("sheet = 'Calc' AND row = 1").collect()}
    assert got["s1", 1, 3] == 102 * 114 and got["s2", 1, 3] == 7 * 15
    assert xlsx.missing_cache(cells).count() == 12
    assert xlsx.sheets(spark, f"{tmp_path}/b.xlsx").count() == 2 and xlsx.named_ranges(spark, f"{tmp_path}/b.xlsx").count() == 0
    g, h = xlsx.grid(cells, "In", 3)
    assert h == ["1", "2", "x"] and g.count() == 2
    with pytest.raises(xlsx.Refused):
        xlsx.opened(b"no zip")


def test_parity_and_seal(spark):
    cells = spark.createDataFrame([("f", "S", 1, 1, "A1", 2.0, None, None, None, None), ("f", "S", 1, 2, "B1", 4.0 + 1e-9, None, None, None, "=A1*2"), ("f", "S", 1, 3, "C1", 9.0, None, None, None, "=A1"), ("f", "S", 1, 4, "D1", None, None, None, None, "=A1")], xlsx.CELLS)
    results = W.parity(W.evaluate(cells), cells)
    assert {r.col: r.status for r in results.collect()} == {2: "PASSED", 3: "FAILED", 4: "SKIPPED_NO_CACHE"}
    assert tuple(W.parity_score(results).first()) == (1, 2, 0.5, "PARTIAL")
    assert W.seal({"b": 1, "a": [2]}) == W.seal({"a": [2], "b": 1}) != W.seal({"a": [1]})


def test_levels_of_diamonds_and_chains(spark):
    df = spark.createDataFrame([("f", "a", "b"), ("f", "a", "c"), ("f", "b", "d"), ("f", "c", "d"), ("f", "d", "e")], "file string, source string, target string")
    order, left = G.levels(df)
    assert {r.name: r.level for r in order.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3} and left.count() == 0
    with pytest.raises(ValueError, match="levels"):
        G.levels(df, most=1)
    nodes, links = G.staged(df, 3)
    assert [r.name for r in nodes.collect()] == ["e", "a", "b"] and [tuple(r) for r in links.select("source", "target").collect()] == [("a", "b")]


def test_levels_have_no_limit(spark, monkeypatch):
    chain = [(f"C{i}", f"C{i + 1}") for i in range(1, 1001)] + [(f"B{i}", f"C{i}") for i in range(2, 1002)] + [("X", "Y"), ("Y", "X"), ("Y", "Z")]
    links = lambda rows: spark.createDataFrame([("f", *r) for r in rows], "file string, source string, target string")
    order, left = G.levels(links(chain))
    found = {r.name: r.level for r in order.collect()}
    assert found == {f"B{i}": 0 for i in range(2, 1002)} | {f"C{i}": i - 1 for i in range(1, 1002)}
    assert {tuple(r)[1:] for r in left.collect()} == {("X", "Y"), ("Y", "X"), ("Y", "Z")}
    monkeypatch.setattr(G, "FEW", 0)  # in rounds of joins
    order, left = G.levels(links([r for r in chain if r[1] in ("C2", "C3", "C4", "X", "Y", "Z")]))
    assert {r.name: r.level for r in order.collect()} == {"B2": 0, "B3": 0, "B4": 0, "C1": 0, "C2": 1, "C3": 2, "C4": 3}
    assert {(r.source, r.target) for r in left.collect()} == {("X", "Y"), ("Y", "X"), ("Y", "Z")}


def test_cycles_are_strong_components(spark, monkeypatch):
    """Cycles that a path joins are apart, what lies between or after is on none, and files are apart; on the driver and in rounds."""
    import random

    random.seed(4)
    links = {(random.randrange(30), random.randrange(30)) for _ in range(45)}
    reach = {a: {a} for a in range(30)}
    for _ in range(30):
        for a, b in links:
            for r in reach.values():
                if a in r:
                    r.add(b)
    name = lambda i: f"N{i:02d}"
    want = {(name(a), name(min(b for b in reach[a] if a in reach[b])), sum(a in reach[b] for b in reach[a])) for a in range(30) if sum(a in reach[b] for b in reach[a]) > 1}
    rows = [("f", name(a), name(b)) for a, b in links] + [("g", "N01", "N02"), ("g", "N02", "N03")]
    df = spark.createDataFrame(rows, "file string, source string, target string")
    for few in (50_000, 0):
        monkeypatch.setattr(G, "FEW", few)
        found = G.cycles(G.levels(df)[1]).collect()
        assert {(r.name, r.cycle, r.size) for r in found if r.kind != "self"} == want and {r.file for r in found} == {"f"}
        assert {r.name for r in found if r.kind == "self"} == {name(a) for a, b in links if a == b}


def test_daily_stream_equals_daily_table(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts, id % 5 AS user_id, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS event_type, id * 1.0D AS value, '{}' AS props FROM range(100)").write.parquet(f"{tmp_path}/e")
    query = windows.daily(windows.stream(spark, f"{tmp_path}/e")).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(spark.table("daily").collect()) == sorted(windows.daily(spark.read.parquet(f"{tmp_path}/e")).collect())


def test_files_with_equal_sheet_names_are_apart(spark):
    rows = [("f", "S", 1, 1, "A1", None, None, None, None, "=B1+1"), ("f", "S", 1, 2, "B1", 2.0, None, None, None, None), ("g", "S", 1, 2, "B1", None, None, None, None, "=A1*2"), ("g", "S", 1, 1, "A1", 5.0, None, None, None, None)]
    cells = spark.createDataFrame(rows, xlsx.CELLS)
    found = {(r.file, r.col): r.value.n for r in W.evaluate(cells).collect()}
    assert found == {("f", 1): 3.0, ("f", 2): 2.0, ("g", 2): 10.0, ("g", 1): 5.0}
    changes = spark.createDataFrame([("s", "g", "S", 1, 1, 7.0), ("t", None, "S", 1, 1, 1.0)], "scenario string, file string, sheet string, row int, col int, num double")
    found = {(r.scenario, r.file, r.col): r.value.n for r in W.evaluate(cells, changes).collect()}
    assert found["s", "g", 2] == 14.0 and found["s", "f", 1] == 3.0 and found["t", "g", 2] == 2.0 and found["t", "f", 1] == 1.0


def test_certification(spark):
    rows = [("base", "f", "S", 1, 1, "=1", "1", "1", "PASSED"), ("base", "f", "S", 1, 2, "=1", "1", "2", "PASSED"), ("base", "f", "S", 1, 3, "=1", "#N/A", "#N/A", "PASSED"), ("base", "f", "S", 1, 4, "=1", "2", "2.0000000001", "FAILED"), ("base", "f", "S", 1, 5, "=1", None, "9", "SKIPPED_NO_CACHE")]
    results = spark.createDataFrame(rows, "scenario string, file string, sheet string, row int, col int, formula string, expected string, actual string, status string")
    assert {(r.kind, r.col) for r in W.certification_gate(results, "PASSED").collect()} == {("status", None), ("flag", 2), ("flag", 4), ("error_in_passed", 3)}
    assert W.certification_gate(results.filter("col = 1"), "PASSED").count() == 0
    assert W.verify_seal({"a": 1}, W.seal({"a": 1})) and not W.verify_seal({"a": 2}, W.seal({"a": 1}))
