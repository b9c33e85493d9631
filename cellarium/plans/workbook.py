"""A workbook as a plan: classes, graph, evaluation by levels and templates, parity, scenarios.

Formulas that were filled along share a template, and all cells of one level are evaluated by one expression; see recalc.py,
and chains.py for formulas that use the cell before them. A scenario is a set of changed cells; all scenarios run at once, as
differences from the base.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions import values as V
from cellarium.functions.rules import classified
from cellarium.operators import graph as G
from cellarium.operators.runs import ordered
from cellarium.plans.chains import foldable, scanned
from cellarium.plans.recalc import KEY, State, Template, computed, heights_of, touched
from cellarium.session import collected, cut, measured, stored
from cellarium.sources import xlsx

#: Relative distance at which numbers count as equal.
CLOSE = 1e-7


def _cell() -> F.Column:
    return F.struct(F.col("num").alias("n"), F.col("txt").alias("t"), F.col("bool").alias("b"), F.col("err").alias("e"))


def pattern_classes(formulas: DataFrame) -> DataFrame:
    """file, sheet, row, col, formula, class, rule (the first of the classifier's rules that the formula meets), matched (the function
    it was met by) and density of each formula."""
    found = classified(*(F.col(c) for c in ("functions", "operators", "operands", "external", "failed")))
    return formulas.withColumns(found).select(*G.NODE, "formula", "class", "rule", "matched", "density")


def evaluate(cells: DataFrame, overrides: DataFrame | None = None, most_levels: int | None = None) -> DataFrame:
    """scenario, file, sheet, row, col, value (a CELL) of all cells. overrides(scenario, file, sheet, row, col, num) change inputs,
    or replace formulas (without a column file, or where it is null, in all files); without overrides there is one scenario,
    "base". Cells on a cycle or after one get #CYCLE!. Files are apart."""
    return planned(cells, most_levels).values(overrides)


def recomputed(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """scenario, file, sheet, row, col of the cells whose value a scenario sets or computes again: all others are the base's."""
    plan = planned(cells)
    return plan.changed(plan.base(), overrides).select(*KEY)


#: Of the form of saved plans.
PLAN_VERSION = 1
STEPS = "version int, level int, shape string, template string, one string, areas array<struct<place:int,area:long>>"


@dataclass(frozen=True)
class Plan:
    """A workbook ready to be computed: its inputs (file, sheet, row, col, value) and its formulas in order."""

    inputs: DataFrame
    formulas: DataFrame
    #: level, shape (null: no scan), template, a formula of it and the largest size of each of its references.
    steps: list[tuple[int, str | None, str, str, dict[int, int]]]

    def save(self, path: str) -> None:
        """Writes the plan as a folder: inputs and formulas as Parquet, and the steps, with their version, as JSON. The folder
        needn't exist; an earlier plan in it is replaced."""
        spark = self.inputs.sparkSession
        self.inputs.write.mode("overwrite").parquet(f"{path}/inputs")
        self.formulas.write.mode("overwrite").parquet(f"{path}/formulas")
        rows = [(PLAN_VERSION, level, shape, template, one, [(p, a) for p, a in areas.items()]) for level, shape, template, one, areas in self.steps]
        spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("overwrite").json(f"{path}/steps")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Plan:
        """A saved plan; it needs neither the workbook nor its parser's results again."""
        rows = spark.read.schema(STEPS).json(f"{path}/steps").collect()  # a row for each distinct formula
        if strange := {r.version for r in rows} - {PLAN_VERSION}:
            raise ValueError(f"{path} holds a plan of version {sorted(strange, key=str)}; this is version {PLAN_VERSION}")
        steps = [(r.level, r.shape, r.template, r.one, {p: a for p, a in r.areas}) for r in rows]
        return Plan(spark.read.parquet(f"{path}/inputs"), spark.read.parquet(f"{path}/formulas"), sorted(steps, key=str))

    def values(self, overrides: DataFrame | None = None) -> DataFrame:
        """The same as evaluate()."""
        base = self.base()
        if overrides is None:
            return base.select(F.lit("base").alias("scenario"), *G.NODE, "value")
        changed = self.changed(base, overrides)
        copies = base.crossJoin(F.broadcast(overrides.select("scenario").distinct()))  # as many copies of the base as scenarios
        new = changed.withColumnRenamed("value", "new").withColumn("hit", F.lit(True)).hint("merge")  # as long as the sheets
        return copies.join(new, KEY, "left").select(*KEY, F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"))

    def base(self) -> DataFrame:
        """file, sheet, row, col, value of all cells."""
        formulas = self.formulas.withColumn("scenario", F.lit("base")).withColumn("fixed", F.lit(None).cast(V.CELL))
        state, heights = cut(self.inputs), self._heights()
        for level in self._levels():
            new = self._level(level, formulas.filter(F.col("level") == level), State(state, heights))
            state = _grown(state, new.select(*G.NODE, "value"), level)
            if level % 8 == 0:
                collected(formulas.sparkSession)
        lost = self.formulas.filter("level IS NULL").select(*G.NODE, V.Val(e=F.lit("#CYCLE!")).struct().cast(V.CELL).alias("value"))
        return cut(state.unionByName(lost))

    def changed(self, base: DataFrame, overrides: DataFrame) -> DataFrame:
        """scenario and the cells and values of what overrides(scenario, sheet, row, col, num, perhaps file) change: themselves,
        and the formulas that use changed cells. A scan is computed again from its first changed row on."""
        which = F.col("file") if "file" in overrides.columns else F.lit(None).cast("string")
        given = overrides.select("scenario", which.alias("ofile"), "sheet", "row", "col", "num")
        there = base.join(given, ["sheet", "row", "col"]).filter("ofile IS NULL OR ofile = file")
        value = F.struct(F.col("num").alias("n"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("e"))
        fixed = cut(there.select(*KEY, value.cast(V.CELL).alias("value")).dropDuplicates(KEY))
        state, heights = fixed, self._heights()
        at = F.when(F.col("down"), F.col("row")).otherwise(F.col("col"))
        for level in self._levels():
            formulas = self.formulas.filter(F.col("level") == level)
            hit = touched(formulas, state, heights).join(fixed.select(*KEY), KEY, "left_anti")
            plain = formulas.filter("shape IS NULL").join(hit, G.NODE).withColumn("fixed", F.lit(None).cast(V.CELL))
            scans = formulas.filter("shape IS NOT NULL")
            # Changed cells of a scan itself count, too, for those after them.
            began = scans.join(hit.unionByName(fixed.select(*KEY)), G.NODE).groupBy("scenario", "file", "node").agg(F.min(at).alias("low"), F.max(at).alias("high"))
            rest = scans.join(began, ["file", "node"]).filter((F.col("ahead") & (at >= F.col("low"))) | (~F.col("ahead") & (at <= F.col("high")))).drop("low", "high")
            rest = rest.join(fixed.withColumnRenamed("value", "fixed"), KEY, "left")
            ready = cut(plain.unionByName(rest))
            new = self._level(level, ready, State(base, heights, state)).join(fixed.select(*KEY), KEY, "left_anti")
            state = _grown(state, new, level)
        return state

    def _heights(self) -> int:
        rows = self.inputs.select("row").unionByName(self.formulas.select("row"))
        return heights_of(rows.agg(F.max("row")).first()[0] or 0)

    def _levels(self) -> list[int]:
        return sorted({s[0] for s in self.steps})

    def _level(self, level: int, ready: DataFrame, state: State) -> DataFrame:
        """KEY, value of the cells of ready, which are on this level."""
        parts = []
        plain = {t: Template(one, areas) for at, shape, t, one, areas in self.steps if at == level and shape is None}
        if plain:
            parts += computed(ready.filter("shape IS NULL"), plain, state)
        shapes: dict[str, dict[str, Template]] = {}
        for at, shape, t, one, areas in self.steps:
            if at == level and shape is not None:
                shapes.setdefault(shape, {})[t] = Template(one, areas)
        parts += [scanned(ready.filter(F.col("shape") == shape), shape, templates, state) for shape, templates in shapes.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return cut(out)


def _grown(state: DataFrame, new: DataFrame, level: int) -> DataFrame:
    """state and the new cells, which alone have been written; the parts are put together now and then."""
    both = state.unionByName(new)
    return cut(both) if level % 16 == 15 else both


def planned(cells: DataFrame, most_levels: int | None = None) -> Plan:
    with measured(cells.sparkSession):
        plan = _planned(cells, most_levels)
    collected(cells.sparkSession)
    return plan


def _planned(cells: DataFrame, most_levels: int | None) -> Plan:
    out, runs = ordered(G.templated(cells), foldable, most_levels)
    formulas = stored(out, "formulas")
    area = (F.col("r.bottom") - F.col("r.top") + 1) * (F.col("r.right") - F.col("r.left") + 1)
    # Along a run an area grows or shrinks by the same each step, so it is largest at an end.
    ends = F.array(*(F.struct(F.col(c).alias("refs")) for c in ("head", "tail")))
    sizes = runs.filter("level IS NOT NULL").select("level", "shape", "template", "one", F.explode(ends).alias("end"))
    sizes = sizes.select("level", "shape", "template", "one", F.posexplode_outer("end.refs").alias("p", "r"))
    sizes = sizes.groupBy("level", "shape", "template", "p").agg(F.min("one").alias("one"), F.max(F.coalesce(area, F.lit(1 << 30))).alias("area"))
    steps: dict[tuple, tuple[str, dict[int, int]]] = {}
    for r in sizes.collect():  # a row for each reference of each distinct formula
        one, areas = steps.setdefault((r.level, r.shape, r.template), (r.one, {}))
        if r.p is not None:
            areas[r.p] = r.area
    inputs = cells.filter("formula IS NULL").select(*G.NODE, _cell().cast(V.CELL).alias("value"))
    return Plan(inputs, formulas, [(*k, *v) for k, v in sorted(steps.items(), key=str)])


def parity(computed: DataFrame, cells: DataFrame) -> DataFrame:
    """Each formula's computed value beside the cached one: PASSED, FAILED, ERROR, SKIPPED_NO_CACHE or SKIPPED_EXTERNAL_REF."""
    cached = cells.filter("formula IS NOT NULL").select(*G.NODE, "formula", _cell().alias("cached"))
    both = cached.join(computed, G.NODE)
    got, want = F.col("value"), F.col("cached")
    none = want["n"].isNull() & want["t"].isNull() & want["b"].isNull() & want["e"].isNull()
    far = F.abs(got["n"] - want["n"]) > CLOSE * F.greatest(F.abs(got["n"]), F.abs(want["n"]))
    text = lambda c: F.coalesce(c["t"], V.shown(c["n"]), F.upper(c["b"].cast("string")), c["e"])
    same = F.when(got["n"].isNotNull() & want["n"].isNotNull(), ~far).otherwise(F.coalesce(text(got) == text(want), F.lit(False)))
    status = (
        F.when(F.col("formula").contains("["), "SKIPPED_EXTERNAL_REF").when(none, "SKIPPED_NO_CACHE").when(same, "PASSED")
        .when(got["e"].isNotNull(), "ERROR").otherwise("FAILED")
    )
    return both.select("scenario", *G.NODE, "formula", text(want).alias("expected"), text(got).alias("actual"), status.alias("status"))


STATUSES = ("PASSED", "FAILED", "ERROR", "SKIPPED_NO_CACHE", "SKIPPED_EXTERNAL_REF")


def pattern_breakdown(classes: DataFrame, results: DataFrame) -> DataFrame:
    """class, total and a count of each of STATUSES: the formulas of classes() by what parity says of them."""
    both = classes.select(*G.NODE, "class").join(results.select(*G.NODE, "status"), G.NODE)
    return both.groupBy("class").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def parity_score(results: DataFrame) -> DataFrame:
    """score and status of all results; skipped ones don't count, and nothing counts as a pass."""
    counts = results.agg(F.count_if(F.col("status") == "PASSED").alias("passed"), F.count_if(~F.col("status").startswith("SKIPPED")).alias("counted"))
    score = F.coalesce(F.try_divide("passed", "counted"), F.lit(1.0))
    return counts.select("passed", "counted", score.alias("score"), F.when(score >= 1, "PASSED").when(score > 0, "PARTIAL").otherwise("FAILED").alias("status"))


def certification_gate(results: DataFrame, claimed: str) -> DataFrame:
    """kind, file, sheet, row, col, detail of what speaks against the claimed status of parity results: a status that the
    results don't give, a pass or failure that the values don't bear out, an error value among the passes. None: certified."""
    nowhere = [F.lit(None).cast(t).alias(c) for c, t in zip(G.NODE, ("string", "string", "int", "int"), strict=True)]
    status = parity_score(results).filter(F.col("status") != claimed).select(F.lit("status").alias("kind"), *nowhere, F.col("status").alias("detail"))
    want, got = (F.col(c).try_cast("double") for c in ("expected", "actual"))
    near = F.abs(got - want) <= CLOSE * F.greatest(F.abs(got), F.abs(want))
    same = F.coalesce(near, F.col("expected").eqNullSafe(F.col("actual")))
    passed = F.col("status") == "PASSED"
    counted = results.filter(~F.col("status").startswith("SKIPPED"))
    flags = counted.filter(passed != same).select(F.lit("flag").alias("kind"), *G.NODE, F.col("status").alias("detail"))
    errors = counted.filter(passed & F.col("actual").rlike(r"#[A-Z/0]+[!?]|#N/A")).select(F.lit("error_in_passed").alias("kind"), *G.NODE, F.col("actual").alias("detail"))
    return status.unionByName(flags).unionByName(errors)


def override_trail(cells: DataFrame, overrides: DataFrame) -> DataFrame:
    """scenario, file, sheet, row, col, formula, before, after and kind (changes_input, replaces_formula, no_such_cell) of each
    override(scenario, file, sheet, row, col, num)."""
    before = cells.select(*G.NODE, "formula", F.coalesce("txt", V.shown(F.col("num")), F.upper(F.col("bool").cast("string")), "err").alias("before"), F.lit(True).alias("there"))
    both = overrides.select("scenario", *G.NODE, F.col("num").alias("after")).join(before, G.NODE, "left")
    kind = F.when(F.col("there").isNull(), "no_such_cell").when(F.col("formula").isNotNull(), "replaces_formula").otherwise("changes_input")
    return both.select("scenario", *G.NODE, "formula", "before", "after", kind.alias("kind"))


def verify_seal(document: dict, digest: str) -> bool:
    """Whether the digest is the document's."""
    return seal(document) == digest


def seal(document: dict) -> str:
    """The digest of a document's canonical JSON."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def diagnose(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    cells = cut(xlsx.cells(spark, path))
    formulas = cut(G.parsed(cells))
    links = cut(G.edges(cells, formulas))
    order, stuck = G.levels(links)
    return {"compatibility": xlsx.compatibility(spark, path), "classes": pattern_classes(formulas), "links": links, "levels": order, "cycles": G.cycles(stuck), "risks": G.risks(cells, formulas, links), "roles": G.roles(links)}


def compile_workbook(spark: SparkSession, path: str, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    cells = cut(xlsx.cells(spark, path))
    computed = cut(evaluate(cells, overrides))
    results = parity(computed, cells)
    return {"values": computed, "parity": results, "score": parity_score(results), "missing": xlsx.missing_cache(cells)}
