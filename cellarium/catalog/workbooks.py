"""Graph and workbook queries over cells made from tables, and their SQL.

The sheet `calc` has a row for each of the first nations' suppliers' totals: inputs in A and B, formulas in C to E that were
filled down, and totals in G. A second file has a sheet of the same name, with other formulas in the same places and cycles
that a path joins. SQL says what the formulas must give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.catalog.audit import read
from cellarium.operators import graph as G
from cellarium.plans import workbook as W
from cellarium.session import cut, shared_dir
from cellarium.streaming import windows


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A: nation key, B: its suppliers, C = A*2+B, D = IF(C>40, C-B, B), E = D/A (an error at 0), G1..G3: totals."""
    n, s = read(spark, d, "nation"), read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    rows = n.join(s, n.n_nationkey == s.s_nationkey, "left").select((F.col("n_nationkey") + 1).alias("r"), F.col("n_nationkey").cast("double").alias("a"), F.coalesce("n", F.lit(0)).cast("double").alias("b"))
    r = F.col("r").cast("string")
    made = [(1, F.col("a"), None), (2, F.col("b"), None), (3, None, F.concat(F.lit("=A"), r, F.lit("*2+B"), r)), (4, None, F.concat(F.lit("=IF(C"), r, F.lit(">40,C"), r, F.lit("-B"), r, F.lit(",B"), r, F.lit(")"))),
            (5, None, F.concat(F.lit("=D"), r, F.lit("/A"), r))]
    null = lambda kind: F.lit(None).cast(kind)
    grid = rows.select("r", F.inline(F.array(*(F.struct(F.lit(c).alias("col"), (v if v is not None else null("double")).alias("num"), (f if f is not None else null("string")).alias("formula")) for c, v, f in made))))
    total = spark.sql("SELECT * FROM VALUES (1, 7, '=SUM(C1:C25)'), (2, 7, '=SUMIF(D:D,\">10\")+G1'), (3, 7, '=SUM(IFERROR(E1,0),E2:E25)'), (4, 7, '=UNKNOWN.FN(A1)'), (5, 7, '=G6+1'), (6, 7, '=G5*2'), (7, 7, '=[Other.xlsx]S!A1') t(r, col, formula)")
    other = spark.sql("SELECT * FROM VALUES (1, 1, '=B1+1'), (1, 3, '=A1*2'), (1, 9, '=I2'), (2, 9, '=I1'), (3, 9, '=I2+1'), (4, 9, '=I3+I5'), (5, 9, '=I4'), (6, 9, '=I6+1'), (7, 9, '=I8'), (8, 9, '=I9'), (9, 9, '=I7'), (10, 9, '=I3*2') t(r, col, formula)")
    other = other.withColumn("num", null("double")).unionByName(spark.sql("SELECT 1 AS r, 2 AS col, CAST(NULL AS STRING) AS formula, 2D AS num"))
    all_rows = grid.unionByName(total.withColumn("num", null("double"))).withColumn("file", F.lit("book")).unionByName(other.withColumn("file", F.lit("other")))
    return all_rows.select("file", F.lit("calc").alias("sheet"), F.col("r").cast("int").alias("row"), "col", "num", null("string").alias("txt"), null("boolean").alias("bool"), null("string").alias("err"), "formula")


def _values(df: DataFrame) -> DataFrame:
    return df.select("scenario", "file", "row", "col", F.round("value.n", 6).alias("num"), F.col("value.e").alias("err"))


def workbook_values(s: SparkSession, d: str) -> DataFrame:
    return _values(W.evaluate(cells(s, d)))


def _changes(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES ('low', 'book', 'calc', 2, 1, 5D), ('high', 'book', 'calc', 2, 1, 500D), ('high', 'book', 'calc', 3, 3, 7D) t(scenario, file, sheet, row, col, num)")


def scenario_recalc(s: SparkSession, d: str) -> DataFrame:
    return _values(W.evaluate(cells(s, d), _changes(s)))


def saved_plan(s: SparkSession, d: str) -> DataFrame:
    """The scenarios from a plan that was saved and loaded."""
    path = f"{shared_dir(s)}/plan-{uuid.uuid4().hex}"
    W.planned(cells(s, d)).save(path)
    return _values(W.Plan.load(s, path).values(_changes(s)))


def override_trail(s: SparkSession, d: str) -> DataFrame:
    return W.override_trail(cells(s, d), _changes(s)).drop("sheet")


def certification_gate(s: SparkSession, d: str) -> DataFrame:
    """Parity results that claim too much: the status PASSED, and a pass for what failed in row 2."""
    claimed = _parity(s, d).withColumn("status", F.when(F.col("row") == 2, F.regexp_replace("status", "FAILED", "PASSED")).otherwise(F.col("status")))
    return W.certification_gate(claimed, "PASSED").drop("sheet")


def _links(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    return cut(G.edges(c, G.parsed(c)))


def dag_edges(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    return G.edges(c, G.parsed(c))


def dag_levels(s: SparkSession, d: str) -> DataFrame:
    return G.levels(_links(s, d))[0]


def dag_cycles(s: SparkSession, d: str) -> DataFrame:
    return G.cycles(G.levels(_links(s, d))[1])


def dag_roles(s: SparkSession, d: str) -> DataFrame:
    return G.roles(_links(s, d))


def risk_findings(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    f = cut(G.parsed(c))
    return G.risks(c, f, G.edges(c, f)).select("kind", "file", "name")


def pattern_classes(s: SparkSession, d: str) -> DataFrame:
    return W.pattern_classes(G.parsed(cells(s, d))).select("file", "row", "col", "class", "rule", "matched", F.round("density", 4).alias("density"))


def _parity(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    return W.parity(W.evaluate(c), c.withColumn("num", F.when(F.col("col") == 3, F.lit(50.0)).otherwise(F.col("num"))))


def parity_join(s: SparkSession, d: str) -> DataFrame:
    return _parity(s, d).select("file", "row", "col", "status")


def parity_score(s: SparkSession, d: str) -> DataFrame:
    return W.parity_score(_parity(s, d)).withColumn("score", F.round("score", 6))


def pattern_pivot(s: SparkSession, d: str) -> DataFrame:
    """Formulas of each class by what parity says of them."""
    classes = W.pattern_classes(G.parsed(cells(s, d)))
    return W.pattern_breakdown(classes, _parity(s, d)).select("class", "PASSED", "FAILED", "SKIPPED_NO_CACHE", "SKIPPED_EXTERNAL_REF")


QUERIES = {
    "workbook_values": workbook_values, "scenario_recalc": scenario_recalc, "saved_plan": saved_plan, "dag_edges": dag_edges, "dag_levels": dag_levels, "dag_cycles": dag_cycles, "risk_findings": risk_findings,
    "pattern_classes": pattern_classes, "parity_join": parity_join, "parity_score": parity_score, "override_trail": override_trail, "certification_gate": certification_gate, "pattern_pivot": pattern_pivot, "dag_roles": dag_roles, "daily_events": lambda s, d: windows.daily(read(s, d, "events")).withColumn("value", F.round("value", 4)),
}

_X = """q(s, v, w) AS (VALUES ('base', NULL, NULL), ('low', 5, NULL), ('high', 500, 7)), x AS (SELECT s, w, n_nationkey AS k, CASE WHEN n_nationkey = 1 THEN coalesce(v, 1) ELSE n_nationkey END AS a,
(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS b FROM nation, q), c AS (SELECT *, CASE WHEN k = 2 THEN coalesce(w, a * 2 + b) ELSE a * 2 + b END AS c FROM x), e AS (SELECT *, CASE WHEN c > 40 THEN c - b ELSE b END AS d FROM c)"""
_ALL = f"""WITH {_X}, t AS (SELECT s, sum(c) AS g1, sum(c) + coalesce(sum(d) FILTER (d > 10), 0) AS g2, sum(d::DOUBLE / a) FILTER (k > 0) AS g3 FROM e GROUP BY s), v AS (
SELECT s AS scenario, 'book' AS file, k + 1 AS row, 1 AS col, a::DOUBLE AS num, NULL AS err FROM e UNION ALL SELECT s, 'book', k + 1, 2, b, NULL FROM e UNION ALL SELECT s, 'book', k + 1, 3, c, NULL FROM e UNION ALL SELECT s, 'book', k + 1, 4, d, NULL FROM e
UNION ALL SELECT s, 'book', k + 1, 5, d::DOUBLE / nullif(a, 0), CASE WHEN a = 0 THEN '#DIV/0!' END FROM e UNION ALL SELECT s, 'book', 1, 7, g1, NULL FROM t UNION ALL SELECT s, 'book', 2, 7, g2, NULL FROM t UNION ALL SELECT s, 'book', 3, 7, g3, NULL FROM t
UNION ALL SELECT s, f, r, c, n, e FROM q, (VALUES ('book', 4, 7, NULL, '#NAME?'), ('book', 5, 7, NULL, '#CYCLE!'), ('book', 6, 7, NULL, '#CYCLE!'), ('book', 7, 7, NULL, '#EXT!'), ('other', 1, 1, 3, NULL), ('other', 1, 2, 2, NULL), ('other', 1, 3, 6, NULL)) o(f, r, c, n, e)
UNION ALL SELECT s, 'other', i, 9, NULL, '#CYCLE!' FROM q, range(1, 11) r(i))"""
_EDGES = """WITH k AS (SELECT (n_nationkey + 1)::VARCHAR AS r FROM nation), b AS (SELECT 'calc!A' || r AS source, 'calc!C' || r AS target FROM k UNION ALL SELECT 'calc!B' || r, 'calc!C' || r FROM k UNION ALL SELECT 'calc!C' || r, 'calc!D' || r FROM k
UNION ALL SELECT 'calc!B' || r, 'calc!D' || r FROM k UNION ALL SELECT 'calc!D' || r, 'calc!E' || r FROM k UNION ALL SELECT 'calc!A' || r, 'calc!E' || r FROM k UNION ALL SELECT 'calc!C' || r, 'calc!G1' FROM k UNION ALL SELECT 'calc!D' || r, 'calc!G2' FROM k
UNION ALL SELECT 'calc!G1', 'calc!G2' UNION ALL SELECT 'calc!E' || r, 'calc!G3' FROM k UNION ALL SELECT 'calc!A1', 'calc!G4' UNION ALL SELECT 'calc!G6', 'calc!G5' UNION ALL SELECT 'calc!G5', 'calc!G6'),
g AS (SELECT 'book' AS file, source, target FROM b UNION ALL SELECT 'other', 'calc!' || s, 'calc!' || t FROM (VALUES ('B1', 'A1'), ('A1', 'C1'), ('I2', 'I1'), ('I1', 'I2'), ('I2', 'I3'), ('I3', 'I4'), ('I5', 'I4'), ('I4', 'I5'), ('I6', 'I6'), ('I8', 'I7'), ('I9', 'I8'), ('I7', 'I9'), ('I3', 'I10')) o(s, t))"""
_FORMULAS = """WITH k AS (SELECT n_nationkey + 1 AS row, n_nationkey * 2 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS c FROM nation), f AS (SELECT 'book' AS file, row, 3 AS col, 'ARITHMETIC' AS class, CASE WHEN c = 50 THEN 'PASSED' ELSE 'FAILED' END AS status FROM k
UNION ALL SELECT 'book', row, 4, 'CONDITIONAL', 'SKIPPED_NO_CACHE' FROM k UNION ALL SELECT 'book', row, 5, 'ARITHMETIC', 'SKIPPED_NO_CACHE' FROM k UNION ALL SELECT 'book', i, 7, 'AGGREGATION', 'SKIPPED_NO_CACHE' FROM range(1, 4) r(i) UNION ALL SELECT 'book', 4, 7, 'UNRESOLVED', 'SKIPPED_NO_CACHE'
UNION ALL SELECT 'book', i, 7, 'ARITHMETIC', 'SKIPPED_NO_CACHE' FROM range(5, 7) r(i) UNION ALL SELECT 'book', 7, 7, 'EXTERNAL_REF', 'SKIPPED_EXTERNAL_REF' UNION ALL SELECT 'other', 1, 1, 'ARITHMETIC', 'SKIPPED_NO_CACHE' UNION ALL SELECT 'other', 1, 3, 'ARITHMETIC', 'FAILED'
UNION ALL SELECT 'other', i, 9, 'ARITHMETIC', 'SKIPPED_NO_CACHE' FROM range(1, 11) r(i))"""

ORACLE_SQL = {
    "workbook_values": f"{_ALL} SELECT scenario, file, row, col, round(num, 6) AS num, err FROM v WHERE scenario = 'base'",
    "scenario_recalc": f"{_ALL} SELECT scenario, file, row, col, round(num, 6) AS num, err FROM v WHERE scenario <> 'base'",
    "saved_plan": f"{_ALL} SELECT scenario, file, row, col, round(num, 6) AS num, err FROM v WHERE scenario <> 'base'",
    "dag_edges": f"{_EDGES} SELECT file, source, target FROM g",
    "dag_levels": f"""{_EDGES}, m AS (SELECT DISTINCT file, source AS name FROM g UNION SELECT file, target FROM g) SELECT file, name, CASE WHEN file = 'other' THEN CASE name[6:6] WHEN 'B' THEN 0 WHEN 'A' THEN 1 ELSE 2 END WHEN name[6:6] IN ('A', 'B') THEN 0 WHEN name[6:6] = 'C' THEN 1
WHEN name[6:6] = 'D' OR name = 'calc!G1' THEN 2 WHEN name[6:6] = 'E' OR name = 'calc!G2' THEN 3 WHEN name = 'calc!G3' THEN 4 ELSE 1 END AS level FROM m WHERE NOT (file = 'book' AND name IN ('calc!G5', 'calc!G6')) AND NOT (file = 'other' AND name[6:6] = 'I')""",
    "dag_cycles": """SELECT * FROM (VALUES ('book', 'calc!G5', 'calc!G5', 2::BIGINT, 'direct'), ('book', 'calc!G6', 'calc!G5', 2, 'direct'), ('other', 'calc!I1', 'calc!I1', 2, 'direct'), ('other', 'calc!I2', 'calc!I1', 2, 'direct'), ('other', 'calc!I4', 'calc!I4', 2, 'direct'),
('other', 'calc!I5', 'calc!I4', 2, 'direct'), ('other', 'calc!I6', 'calc!I6', 1, 'self'), ('other', 'calc!I7', 'calc!I7', 3, 'indirect'), ('other', 'calc!I8', 'calc!I7', 3, 'indirect'), ('other', 'calc!I9', 'calc!I7', 3, 'indirect')) t(file, name, cycle, size, kind)""",
    "dag_roles": f"{_EDGES}, m AS (SELECT DISTINCT file, source AS name FROM g UNION SELECT file, target FROM g) SELECT file, name, CASE WHEN NOT EXISTS (FROM g WHERE g.file = m.file AND g.target = m.name) THEN 'input' WHEN NOT EXISTS (FROM g WHERE g.file = m.file AND g.source = m.name) THEN 'output' ELSE 'intermediate' END AS role FROM m",
    "risk_findings": """SELECT kind, file, 'calc!' || n AS name FROM (VALUES ('external_ref', 'book', 'G7'), ('unresolved', 'book', 'G4'), ('orphan_cell', 'book', 'G2'), ('orphan_cell', 'book', 'G3'), ('orphan_cell', 'book', 'G4'), ('orphan_cell', 'book', 'G7'), ('orphan_cell', 'other', 'C1'), ('orphan_cell', 'other', 'I10'),
('hardcoded_value', 'book', 'G6'), ('hardcoded_value', 'other', 'C1'), ('hardcoded_value', 'other', 'I10')) t(kind, file, n) UNION ALL SELECT 'hardcoded_value', 'book', 'calc!' || c || (n_nationkey + 1) FROM nation, (VALUES ('C'), ('D')) o(c)""",
    "pattern_classes": f"""{_FORMULAS} SELECT file, row, col, class, CASE WHEN file = 'other' THEN CASE WHEN col = 9 AND row IN (1, 2, 5, 7, 8, 9) THEN 'cell_reference' ELSE 'inline_arithmetic' END
WHEN col IN (3, 5) THEN 'inline_arithmetic' WHEN col = 4 THEN 'if_simple' ELSE ['sum', 'sumif', 'sum', NULL, 'inline_arithmetic', 'inline_arithmetic', 'external_ref'][row] END AS rule, CASE WHEN col = 4 THEN 'IF' WHEN col = 7 AND row IN (1, 3) THEN 'SUM' WHEN col = 7 AND row = 2 THEN 'SUMIF' END AS matched,
CASE WHEN file = 'other' THEN CASE WHEN col = 9 AND row = 4 THEN 0.6667 ELSE 1 END WHEN col < 7 THEN [0.6, 0.3333, 0.6667][col - 2] ELSE [0.75, 0.625, 0.3636, 0.75, 1, 1, 1][row] END AS density FROM f""",
    "override_trail": "SELECT * FROM (VALUES ('low', 'book', 2, 1, NULL, '1', 5, 'changes_input'), ('high', 'book', 2, 1, NULL, '1', 500, 'changes_input'), ('high', 'book', 3, 3, '=A3*2+B3', NULL, 7, 'replaces_formula')) t(scenario, file, row, col, formula, before, after, kind)",
    "certification_gate": f"{_FORMULAS}, g AS (SELECT *, CASE WHEN row = 2 AND status = 'FAILED' THEN 'PASSED' ELSE status END AS said FROM f WHERE status IN ('PASSED', 'FAILED')) SELECT 'status' AS kind, NULL AS file, NULL AS row, NULL AS col, CASE WHEN count(*) FILTER (said = 'PASSED') > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS detail FROM g HAVING count(*) FILTER (said = 'FAILED') > 0 UNION ALL SELECT 'flag', file, row, col, said FROM g WHERE said <> status",
    "parity_join": f"{_FORMULAS} SELECT file, row, col, status FROM f",
    "parity_score": f"{_FORMULAS}, n AS (SELECT count(*) FILTER (status = 'PASSED') AS passed, count(*) FILTER (status IN ('PASSED', 'FAILED')) AS counted FROM f) SELECT passed, counted, round(passed / counted, 6) AS score, CASE WHEN passed = counted THEN 'PASSED' WHEN passed > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM n",
    "pattern_pivot": f"{_FORMULAS} SELECT class, count(*) FILTER (status = 'PASSED') AS PASSED, count(*) FILTER (status = 'FAILED') AS FAILED, count(*) FILTER (status = 'SKIPPED_NO_CACHE') AS SKIPPED_NO_CACHE, count(*) FILTER (status = 'SKIPPED_EXTERNAL_REF') AS SKIPPED_EXTERNAL_REF FROM f GROUP BY class",
    "daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
