"""Runs, scans, blocks and differences of recalculation, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cellarium.functions import formula as X
from cellarium.operators import graph as G
from cellarium.plans import chains, recalc
from cellarium.plans import workbook as W
from cellarium.sources import xlsx


def sheet(spark, places, file="f", name="S"):
    """Cells from {"A1": value or formula}."""
    rows = []
    for at, v in places.items():
        r = X.parse_ref(at)
        f = v if isinstance(v, str) and v.startswith("=") else None
        rows.append((file, name, r.top, r.left, at, float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, v if isinstance(v, str) and f is None else None, v if isinstance(v, bool) else None, None, f))
    return spark.createDataFrame(rows, xlsx.CELLS)


def values(df):
    """{"A1": number, text or error} of one scenario."""
    from cellarium.operators.longform import column_letters

    return {f"{column_letters(r.col - 1)}{r.row}": r.value.n if r.value.n is not None else r.value.t if r.value.t is not None else r.value.e for r in df.collect()}


def test_templates_of_fixed_sides():
    same = lambda a, b, down, right: X.template(X.parse(a), 1, 1) == X.template(X.parse(b), 1 + down, 1 + right)
    assert same("=SUM($A$1:A1)", "=SUM($A$1:A4)", 3, 0) and same("=$B$7*C1", "=$B$7*C4", 3, 0) and same("=$B1", "=$B4", 3, 2) and same("=B$1", "=D$1", 3, 2)
    assert not same("=B$1", "=B$4", 3, 0) and not same("=A1:A1", "=$A$1:A1", 0, 0)
    assert X.parse_ref("$A$1:A1").single is False and X.parse_ref("A5").single and X.parse_ref("$A$1").single


def test_runs_and_levels(spark):
    cells = sheet(spark, {f"A{i}": i for i in range(1, 9)} | {f"B{i}": f"=A{i}*2" for i in range(1, 9)} | {"C1": "=A1"} | {f"C{i}": f"=C{i - 1}+B{i}" for i in range(2, 9)} | {c + "10": f"={b}10+1" for b, c in zip("ABCDE", "BCDEF")} | {"H1": "=SUM(C1:C8)"})
    rows = {(r.row, r.col): r for r in W.planned(cells).formulas.collect()}
    assert {r.run for r in rows.values()} == {"1,2!S", "1,3!S", "2,3!S", "10,2!S", "1,8!S"}
    assert rows[5, 3].level == 1 and rows[5, 3].shape and rows[5, 3].ahead and rows[1, 3].level == 0 and rows[1, 8].level == 2
    assert rows[10, 4].shape and not rows[10, 4].down and rows[3, 2].shape is None
    got = values(W.evaluate(cells))
    assert got["C8"] == 1 + 2 * sum(range(2, 9)) and got["F10"] == 5.0 and got["H1"] == sum(1 + 2 * sum(range(2, k + 1)) for k in range(1, 9))


def plain_balance(n, x):
    out = {}
    for i in range(2, n + 1):
        prior = lambda c: out.get((c, i - 1), 0.0)  # noqa: B023, E731
        out["B", i] = prior("B") + x[i]
        out["C", i] = max(0.0, prior("C") + x[i])
        out["D", i] = 0.0 if x[i] > 4 else prior("D") * 2 - 1
        out["E", i] = round(prior("E") / 3 + x[i], 2)
        out["G", i] = prior("G") + prior("G") * 0.1 - x[i] / 2
        out["I", i] = out.get(("I", i - 1), 0.0) + out.get(("J", i - 1), 0.0) + x[i]
        out["J", i] = out["I", i] * 0.5 - out.get(("J", i - 1), 0.0)
        out["K", i] = out.get(("K", i - 1), 0.0) + (out.get(("K", i - 3), 0.0) if i > 3 else 0.0) * 0.01 + 1
    return out


def test_scans_against_plain(spark, monkeypatch):
    """Composed and folded scans over several blocks and segments; headers are text or blank."""
    monkeypatch.setattr(chains, "BLOCK", 7)
    monkeypatch.setattr(chains, "FOLDED", 4)
    monkeypatch.setattr(chains, "SEGMENT", 16)
    random.seed(2)
    n = 45
    x = {i: random.choice([-3.5, -1.0, 0.25, 2.0, 6.0]) for i in range(1, n + 1)}
    at = {f"A{i}": x[i] for i in range(2, n + 1)} | {"A1": "amount", "F1": "most"}
    for i in range(2, n + 1):
        p = i - 1
        at |= {f"B{i}": f"=SUM(B{p},A{i})", f"C{i}": f"=MAX(0,C{p}+A{i})", f"D{i}": f"=IF(A{i}>4,0,D{p}*2-1)", f"E{i}": f"=ROUND(E{p}/3+A{i},2)", f"F{i}": f"=MIN(5,MAX(F{p},A{i}))", f"G{i}": f"=G{p}+G{p}*10%-A{i}/2"}
        at |= {f"I{i}": f"=I{p}+J{p}+A{i}", f"J{i}": f"=I{i}*0.5-J{p}", f"K{i}": f"=K{p}+K{i - 3}*0.01+1" if i > 3 else f"=K{p}+1"}
    got = values(W.evaluate(sheet(spark, at)))
    want = plain_balance(n, x)
    # MAX of a text header and a number is the number, and not that of a blank and the number.
    most = x[2]
    for i in range(2, n + 1):
        most = min(5.0, max(most, x[i]))
        want["F", i] = most
    bad = {k: (got[f"{k[0]}{k[1]}"], v) for k, v in want.items() if got[f"{k[0]}{k[1]}"] != pytest.approx(v, rel=1e-9, abs=1e-9)}
    assert not bad


def test_scans_of_errors_texts_and_other_ways(spark, monkeypatch):
    monkeypatch.setattr(chains, "BLOCK", 3)
    at = {"A1": 1, "A2": 2, "A3": "x", "A4": 0, "A5": 5, "A6": 6, "A7": 7, "A8": 8}
    at |= {f"B{i}": f"=B{i - 1}+A{i}" for i in range(2, 9)}  # an error stays
    at |= {f"C{i}": f"=C{i - 1}+1/A{i}" for i in range(4, 9)}
    at |= {f"D{i}": f'=IF(A{i}=5,"",D{i - 1}+A{i})' for i in range(4, 9)}  # "" and then a sum with it
    at |= {f"E{i}": f"=E{i + 1}*2+A{i}" for i in range(8, 3, -1)} | {"E9": 100}  # upward
    at |= {f"{c}12": f"={b}12&A5" for b, c in zip("ABCDEF", "BCDEFG")} | {"A12": ">"}  # across, texts
    at |= {"G1": "=G1+1", "H1": "=I1", "I1": "=H1", "J1": "=I1*2"} | {f"K{i}": f"=K{i + 1}+K{i - 1}" for i in range(2, 5)}
    at |= {"M1": 1} | {f"M{i}": f"=SUM(M$1:M{i - 1})" for i in range(2, 8)}  # uses all before it: cell by cell
    got = values(W.evaluate(sheet(spark, at)))
    assert [got[f"B{i}"] for i in range(2, 9)] == [2.0, *["#VALUE!"] * 6]
    assert [got[f"C{i}"] for i in range(4, 9)] == ["#DIV/0!"] * 5
    assert [got[f"D{i}"] for i in range(4, 9)] == [0.0, "", "#VALUE!", "#VALUE!", "#VALUE!"]
    e = 100.0
    for i, a in zip(range(8, 3, -1), (8, 7, 6, 5, 0)):
        e = e * 2 + a
        assert got[f"E{i}"] == e
    assert got["G12"] == ">555555" and {got[k] for k in ("G1", "H1", "I1", "J1", "K2", "K3", "K4")} == {"#CYCLE!"}
    assert [got[f"M{i}"] for i in range(2, 8)] == [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]


def test_large_ranges_against_plain(spark, monkeypatch):
    """Totals of blocks: anchored, moving and open ranges, errors, texts, criteria of all kinds, values beside."""
    monkeypatch.setattr(recalc, "SMALL", 4)
    random.seed(6)
    n = 60
    a = {i: random.choice([1, 2, 3, "x", "X", "yes", 2.5, True, None]) for i in range(1, n + 1)}
    b = {i: random.choice([10, 20, -5, "t", None]) for i in range(1, n + 1)}
    at = {f"A{i}": v for i, v in a.items() if v is not None} | {f"B{i}": v for i, v in b.items() if v is not None}
    for i in range(1, n + 1):
        at |= {f"C{i}": f"=SUM($B$1:B{i})", f"D{i}": f"=AVERAGE(B{i}:B{i + 9},7)", f"E{i}": f"=MAX($B$1:B{i})-MIN(B{i}:$B$60)", f"F{i}": f"=COUNT(A:A)+COUNTA($A$1:A{i})+COUNT($A$1:$B${n})"}
        at |= {f"G{i}": f"=SUMIF($A$1:A{i},A{i},$B$1:B{i})", f"H{i}": f'=COUNTIF($A$1:A{i},">"&B{i}/10)', f"I{i}": f'=AVERAGEIF(A:A,"<3",B:B)+SUMIF($A$1:A{i},"Y*",$B$1:B{i})', f"J{i}": f"=SUM($L$1:L{i})"}
    at |= {"L9": "=1/0", "L20": 3}
    got = values(W.evaluate(sheet(spark, at)))
    num = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    for i in range(1, n + 1):
        up = [b[j] for j in range(1, i + 1) if num(b[j])]
        assert got[f"C{i}"] == sum(up)
        near = [b[j] for j in range(i, min(n, i + 9) + 1) if num(b[j])] + [7]
        assert got[f"D{i}"] == pytest.approx(sum(near) / len(near))
        rest = [b[j] for j in range(i, n + 1) if num(b[j])]
        assert got[f"E{i}"] == max(up, default=0) - min(rest, default=0)
        assert got[f"F{i}"] == sum(map(num, a.values())) + sum(a[j] is not None for j in range(1, i + 1)) + sum(map(num, [*a.values(), *b.values()]))
        want = a[i]
        if want is not None and not isinstance(want, bool):
            same = [j for j in range(1, i + 1) if (a[j] == want if num(want) and num(a[j]) else isinstance(a[j], str) and isinstance(want, str) and a[j].lower() == want.lower())]
            assert got[f"G{i}"] == sum(b[j] for j in same if num(b[j]))
        if not isinstance(b[i], str):
            assert got[f"H{i}"] == sum(num(a[j]) and a[j] > (b[i] or 0) / 10 for j in range(1, i + 1))
        low = [b[j] for j in range(1, n + 1) if num(a[j]) and a[j] < 3 and num(b[j])]
        assert got[f"I{i}"] == pytest.approx(sum(low) / len(low) + sum(b[j] for j in range(1, i + 1) if a[j] == "yes" and num(b[j])))
        assert got[f"J{i}"] == (0 if i < 9 else "#DIV/0!")


def test_other_large_ranges_are_gathered_once(spark, monkeypatch):
    monkeypatch.setattr(recalc, "SMALL", 4)
    at = {f"A{i}": i for i in range(1, 13)} | {f"B{i}": i * i for i in range(1, 13)} | {f"C{i}": f"=VLOOKUP({i},$A$1:$B$12,2)+MEDIAN($A$1:$A$12)" for i in range(1, 13)} | {"D1": "=SUM(A:A)+MEDIAN(B:B)"}
    got = values(W.evaluate(sheet(spark, at)))
    assert [got[f"C{i}"] for i in range(1, 13)] == [i * i + 6.5 for i in range(1, 13)] and got["D1"] == 78 + 42.5


def test_scenarios_are_differences(spark, monkeypatch):
    """Equal to a workbook with the changed inputs, and only what uses them is computed."""
    monkeypatch.setattr(recalc, "SMALL", 4)
    at = {f"A{i}": i for i in range(1, 21)} | {f"B{i}": f"=A{i}*2" for i in range(1, 21)} | {"C1": "=B1"} | {f"C{i}": f"=C{i - 1}+B{i}" for i in range(2, 21)}
    at |= {f"D{i}": f"=SUM($B$1:B{i})" for i in range(1, 21)} | {f"E{i}": f"=E{i - 1}*0.5+ROUND(B{i}/3,1)" for i in range(2, 21)} | {"G1": "=SUM(A1:A3)", "G2": "=COUNT(B5:B20)"}
    changes = {"s": {"A15": 100.0}, "t": {"B18": -1.0, "A2": 9.0}, "u": {"C10": 0.0}, "v": {"Z9": 1.0}}
    rows = [(s, "S", X.parse_ref(k).top, X.parse_ref(k).left, v) for s, some in changes.items() for k, v in some.items()]
    df = spark.createDataFrame(rows, "scenario string, sheet string, row int, col int, num double")
    cells = sheet(spark, at)
    got = W.evaluate(cells, df).persist()
    books = None  # the changed workbooks, as files
    for s, some in changes.items():
        one = sheet(spark, at | {k: v for k, v in some.items() if k in at}, file=s)
        books = one if books is None else books.unionByName(one)
    want = W.evaluate(books).persist()
    for s in changes:
        assert values(got.filter(F.col("scenario") == s)) == pytest.approx(values(want.filter(F.col("file") == s)))
    done = W.recomputed(cells, df).groupBy("scenario", "col").count().collect()
    count = {(r.scenario, r["col"]): r["count"] for r in done}
    assert {k: v for k, v in count.items() if k[0] == "s"} == {("s", 1): 1, ("s", 2): 1, ("s", 3): 6, ("s", 4): 6, ("s", 5): 6, ("s", 7): 1}
    assert {k: v for k, v in count.items() if k[0] == "u"} == {("u", 3): 11} and not any(k[0] == "v" for k in count)


def test_many_templates_and_files(spark, monkeypatch):
    monkeypatch.setattr(recalc, "AT_ONCE", 3)
    one = sheet(spark, {"A1": 1} | {f"B{i}": f"={'A1+' * i}{i}" for i in range(1, 9)})
    two = sheet(spark, {"A1": 5, "B1": "=A1*A1", "B2": "=B1/", "B3": "=SUM(B1,B2)"}, file="g")
    got = values(W.evaluate(one.unionByName(two)).filter("file = 'f'"))
    assert all(got[f"B{i}"] == 2 * i for i in range(1, 9))
    assert values(W.evaluate(two)) == {"A1": 5.0, "B1": 25.0, "B2": "#NAME?", "B3": "#NAME?"}
    assert W.evaluate(one.limit(0)).count() == 0


def test_cycles_of_graph_without_links(spark):
    none = spark.createDataFrame([], "file string, source string, target string")
    assert G.cycles(none).count() == 0
