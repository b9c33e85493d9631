"""The dependency graph of formulas: references, edges, levels, cycles, risks.

References stay rectangles; an edge is found by joining on sheet and column, with the row between the bounds. Levels and
cycles come from rounds of joins on the edges, each cut at the checkpoint folder, so depth costs rounds, not memory.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.session import cut

PARSED = "file string, sheet string, row int, col int, formula string, template string, functions array<string>, constants array<double>, density double, operators array<string>, operands int, external boolean, failed boolean, refs array<struct<sheet:string,top:int,left:int,bottom:int,right:int>>"
REFS = "array<struct<sheet:string,top:int,left:int,bottom:int,right:int>>"
NODE = ["file", "sheet", "row", "col"]
#: Links that are collected and sorted on the driver.
FEW = 50_000


class Kinds:
    """What is in formulas. One that was filled along is parsed once; the others of its kind take its tree and move its references."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[tuple, list]] = {}

    def of(self, text: str, row: int, col: int) -> tuple[tuple, list]:
        """What all formulas of a kind share, and their references: sheet and four sides with whether each is fixed."""
        from cellarium.functions import formula as X

        key = X.kind(text, row, col)
        found = self.seen.get(key) if key is not None else None
        if found is None:
            try:
                node = X.parse(text)
            except X.FormulaError:
                return (text, [], [], None, [], 0, "[" in text, True), []
            refs = [(r.sheet, [(side, fixed) for side, fixed in zip((r.top, r.left, r.bottom, r.right), r.fixed, strict=True)]) for r in X.refs(node)]
            moved = [(sheet, [(None if x is None else x if fixed else x - (row, col)[i % 2], fixed) for i, (x, fixed) in enumerate(sides)]) for sheet, sides in refs]
            found = (X.template(node, row, col), X.calls(node), X.constants(node), X.density(text), X.signs(text), X.operands(node), "[" in text, False), moved
            if key is not None:
                self.seen[key] = found
        return found


def placed(sides: list, sheet: str, row: int, col: int) -> list[tuple]:
    """The references of a formula in this cell; those that name no sheet are to its own."""
    return [(own or sheet, *(None if x is None else x if fixed else x + (row, col)[i % 2] for i, (x, fixed) in enumerate(four))) for own, four in sides]


def _dealt(cells: DataFrame) -> DataFrame:
    """The formulas of cells. Parsing takes long for few bytes, so it isn't left to partitions that were made by size."""
    width = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.filter("formula IS NOT NULL").select(*NODE, "formula").repartition(width, *NODE)


def parsed(cells: DataFrame) -> DataFrame:
    """The formulas of cells with what is in them. References that name no sheet are to the formula's own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in PARSED.split(", ")]
        for frame in frames:
            rows, kinds = [], Kinds()
            for file, sheet, row, col, text in zip(frame["file"], frame["sheet"], frame["row"], frame["col"], frame["formula"], strict=True):
                shared, sides = kinds.of(text, row, col)
                rows.append((file, sheet, row, col, text, *shared, placed(sides, sheet, row, col)))
            yield pd.DataFrame(rows, columns=names)

    return _dealt(cells).mapInPandas(run, PARSED)


TEMPLATED = "file string, sheet string, row int, col int, formula string, template string"


def templated(cells: DataFrame) -> DataFrame:
    """The formulas of cells with their templates alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = Kinds()
            rows = zip(*(batch.column(c).to_pylist() for c in ("formula", "row", "col")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([kinds.of(*r)[0][0] for r in rows], pa.string())], names=[*batch.schema.names, "template"])

    return _dealt(cells).mapInArrow(run, TEMPLATED)


def references(formulas: DataFrame) -> DataFrame:
    return formulas.select(*NODE, F.posexplode("refs").alias("place", "ref")).select(*NODE, "place", *(F.col(f"ref.{c}").alias(f"ref_{c}") for c in ("sheet", "top", "left", "bottom", "right")))


def edges(cells: DataFrame, formulas: DataFrame) -> DataFrame:
    """file, and source and target (as Sheet!A1) of each existing cell that a formula uses, and of single cells that don't
    exist. Files are apart: a name counts within its file."""
    refs = references(formulas)
    single = (F.col("ref_top") == F.col("ref_bottom")) & (F.col("ref_left") == F.col("ref_right"))
    direct = refs.filter(single).select(*NODE, F.col("ref_sheet").alias("s"), F.col("ref_top").alias("r"), F.col("ref_left").alias("c"))
    wide = refs.filter(~F.coalesce(single, F.lit(False))).withColumn("c", F.explode(F.sequence("ref_left", "ref_right")))
    there = cells.select(F.col("file").alias("f2"), F.col("sheet").alias("s"), F.col("row").alias("r"), F.col("col").alias("c2"))
    found = wide.join(there, (wide.file == there.f2) & (wide.ref_sheet == there.s) & (wide.c == there.c2) & (F.col("r") >= wide.ref_top) & (F.col("r") <= F.coalesce(wide.ref_bottom, F.lit(1 << 30))))
    both = direct.unionByName(found.select(*NODE, "s", "r", "c"))
    return both.select("file", node("s", "r", "c").alias("source"), node("sheet", "row", "col").alias("target")).distinct()


def node(sheet: str, row: str, col: str) -> F.Column:
    from cellarium.functions.library_lookup import letters

    return F.concat(F.col(sheet), F.lit("!"), letters(F.col(col)), F.col(row).cast("string"))


def _levels_here(links: list[tuple]) -> dict[tuple, int]:
    """The levels of the nodes that are on no cycle and after none, from pairs of nodes."""
    users, waits = defaultdict(list), Counter()
    for source, target in links:
        users[source].append(target)
        waits[target] += 1
    found = {name: 0 for name in users if name not in waits}
    queue = deque(found)
    while queue:  # first in, first out: the last of its sources gives a node its level
        source = queue.popleft()
        for target in users[source]:
            waits[target] -= 1
            if not waits[target]:
                found[target] = found[source] + 1
                queue.append(target)
    return found


def levels(links: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """file, name, level of each node (0: uses nothing), and the links among nodes in cycles or after them, which have none.
    Up to FEW links are sorted on the driver, more of them in a round of joins per level, however many levels there are."""
    left, done, level = cut(links.select("file", "source", "target")), None, 0
    spark = links.sparkSession
    if left.limit(FEW + 1).count() <= FEW:
        pairs = [((r.file, r.source), (r.file, r.target)) for r in left.collect()]
        found = _levels_here(pairs)
        if most is not None and max(found.values(), default=0) >= most:
            raise ValueError(f"formulas depend on each other over more than {most} levels")
        stuck = [(*a, b[1]) for a, b in pairs if a not in found]
        order = [(file, name, n) for (file, name), n in found.items()]
        return spark.createDataFrame(order, "file string, name string, level int"), spark.createDataFrame(stuck, "file string, source string, target string")
    names = cut(links.select("file", F.explode(F.array("source", "target")).alias("name")).distinct())
    todo, width = names, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while most is None or level <= most:
        ready = todo.join(left.select("file", F.col("target").alias("name")).distinct(), ["file", "name"], "left_anti")
        ready = cut(ready.withColumn("level", F.lit(level)))
        if ready.limit(1).count() == 0:
            break
        done = cut((ready if done is None else done.unionByName(ready)).coalesce(width))
        todo = cut(todo.join(ready, ["file", "name"], "left_anti"))
        left = cut(left.join(ready.select("file", F.col("name").alias("source")), ["file", "source"], "left_anti"))
        level += 1
    else:
        raise ValueError(f"formulas depend on each other over more than {most} levels")
    return done if done is not None else names.limit(0).withColumn("level", F.lit(0)), left


def _trimmed(links: DataFrame) -> DataFrame:
    """links without those of nodes that nothing leads to or that lead nowhere, as these are on no cycle."""
    while True:
        kept = links.join(links.select("file", F.col("source").alias("target")).distinct(), ["file", "target"], "left_semi")
        kept = cut(kept.join(links.select("file", F.col("target").alias("source")).distinct(), ["file", "source"], "left_semi").select("file", "source", "target"))
        if kept.count() == links.count():
            return kept
        links = kept


def _least_reaching(links: DataFrame) -> DataFrame:
    """file, name, least: the least node from which each node is reached along links (itself included)."""
    found = cut(links.select("file", F.explode(F.array("source", "target")).alias("name")).distinct().withColumn("least", F.col("name")))
    while True:
        step = links.join(found.withColumnRenamed("name", "source"), ["file", "source"]).groupBy("file", F.col("target").alias("name")).agg(F.min("least").alias("near"))
        new = cut(found.join(step, ["file", "name"], "left").select("file", "name", F.least("least", "near").alias("least"), (F.col("near") < F.col("least")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        found = new.drop("moved")
        if not moved:
            return found


def _circles_here(links: list[tuple]) -> list[list[tuple]]:
    """The strong components of more than one node: a walk forward gives an order, and walks back in it the components."""
    ahead, behind = defaultdict(list), defaultdict(list)
    for a, b in links:
        ahead[a].append(b)
        behind[b].append(a)
    order, seen = [], set()
    for start in list(ahead):
        path = [] if start in seen else [(start, iter(ahead[start]))]
        seen.add(start)
        while path:
            after = next((b for b in path[-1][1] if b not in seen), None)
            if after is None:
                order.append(path.pop()[0])
            else:
                seen.add(after)
                path.append((after, iter(ahead[after])))
    found, taken = [], set()
    for start in reversed(order):
        member, todo = [], [start]
        while todo:
            name = todo.pop()
            if name not in taken:
                taken.add(name)
                member.append(name)
                todo += behind[name]
        if len(member) > 1:
            found.append(member)
    return found


def cycles(left: DataFrame) -> DataFrame:
    """file, name, cycle (its least member), size, kind (self, direct, indirect) of the nodes on cycles, from what levels()
    left. A cycle is a strongly connected component: nodes that reach each other.

    Up to FEW links are walked on the driver. Of more, in each round a node takes the least node that reaches it. Those that
    also reach that node back are its component; they go, and links between nodes of different least ones can be on no
    cycle, so they go, too."""
    own = left.filter("source = target").select("file", F.col("source").alias("name"), F.col("source").alias("cycle"), F.lit(1).cast("long").alias("size"), F.lit("self").alias("kind"))
    rest, done = cut(left.filter("source <> target").select("file", "source", "target").distinct()), None
    if rest.limit(FEW + 1).count() <= FEW:
        rings = _circles_here([((r.file, r.source), (r.file, r.target)) for r in rest.collect()])
        rows = [(file, name, min(m)[1], len(m), "direct" if len(m) == 2 else "indirect") for m in rings for file, name in m]
        return own.unionByName(left.sparkSession.createDataFrame(rows, "file string, name string, cycle string, size long, kind string"))
    while True:
        rest = _trimmed(rest)
        if rest.limit(1).count() == 0:
            break
        least = _least_reaching(rest)
        ends = least.select("file", F.col("name").alias("source"), F.col("least").alias("a"))
        rest = rest.join(ends, ["file", "source"]).join(ends.select("file", F.col("source").alias("target"), F.col("a").alias("b")), ["file", "target"])
        rest = cut(rest.filter("a = b").select("file", "source", "target", "a"))
        # Backwards from each least node within what it reaches.
        back = cut(rest.select("file", F.col("a").alias("name"), "a").distinct())
        while True:
            more = rest.join(back.select("file", F.col("name").alias("target"), "a"), ["file", "target", "a"]).select("file", F.col("source").alias("name"), "a").distinct()
            new = cut(back.union(more).distinct())
            if new.count() == back.count():
                break
            back = new
        done = cut(back if done is None else done.union(back))
        gone = back.select("file", "name")
        rest = rest.join(gone.withColumnRenamed("name", "source"), ["file", "source"], "left_anti").join(gone.withColumnRenamed("name", "target"), ["file", "target"], "left_anti")
        rest = cut(rest.select("file", "source", "target"))
    if done is None:
        return own
    sizes = done.groupBy("file", "a").agg(F.count("*").alias("size")).filter("size > 1")
    sized = done.join(sizes, ["file", "a"])
    return own.unionByName(sized.select("file", "name", F.col("a").alias("cycle"), "size", F.when(F.col("size") == 2, "direct").otherwise("indirect").alias("kind")))


def risks(cells: DataFrame, formulas: DataFrame, links: DataFrame) -> DataFrame:
    """kind, file, name, detail: external references, unknown functions, formulas that nothing uses, numbers within formulas."""
    from cellarium.functions.library import FUNCTIONS

    named = formulas.withColumn("name", node("sheet", "row", "col"))
    known = F.array(*(F.lit(n) for n in sorted([*FUNCTIONS, "LET"])))
    strange = F.filter(F.transform("functions", lambda f: F.regexp_replace(f, r"^_XLFN\.", "")), lambda f: ~F.array_contains(known, f))
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "file", "name", detail.cast("string").alias("detail"))
    external = row(named.filter("external"), "external_ref", F.col("formula"))
    unknown = row(named.withColumn("u", strange).filter("failed OR size(u) > 0"), "unresolved", F.array_join("u", ","))
    used = links.select("file", F.col("source").alias("name")).distinct()
    orphan = row(named.join(used, ["file", "name"], "left_anti"), "orphan_cell", F.col("formula"))
    fixed = F.filter("constants", lambda c: ~c.isin(0.0, 1.0))
    hard = row(named.withColumn("k", fixed).filter("size(k) > 0"), "hardcoded_value", F.array_join(F.transform("k", lambda c: c.cast("string")), ","))
    return external.unionByName(unknown).unionByName(orphan).unionByName(hard)


def roles(links: DataFrame) -> DataFrame:
    """file, name, role: input (used, uses nothing), output (uses, not used), intermediate."""
    s, t = (links.select("file", F.col(c).alias("name")).distinct() for c in ("source", "target"))
    both = s.withColumn("used", F.lit(True)).join(t.withColumn("uses", F.lit(True)), ["file", "name"], "full")
    return both.select("file", "name", F.when(F.col("uses").isNull(), "input").when(F.col("used").isNull(), "output").otherwise("intermediate").alias("role"))


def staged(links: DataFrame, most: int = 150) -> tuple[DataFrame, DataFrame]:
    """The nodes and links of a picture: at most so many nodes, outputs first, then inputs, then what lies between."""
    order = F.when(F.col("role") == "output", 0).when(F.col("role") == "input", 1).otherwise(2)
    nodes = roles(links).orderBy(order, "name", "file").limit(most)
    ends = [nodes.select("file", F.col("name").alias(c)) for c in ("source", "target")]
    return nodes, links.select("file", "source", "target").join(ends[0], ["file", "source"], "left_semi").join(ends[1], ["file", "target"], "left_semi")
