"""Lookups over ranges as arrays, and functions that give ranges. Lookups over tables are joins: see operators/lookup.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions import criteria
from cellarium.functions import values as V
from cellarium.functions.library_math import L
from cellarium.functions.registry import MANY, define
from cellarium.functions.values import Val

K = "LOOKUP"


def same(c: Column, v: Val) -> Column:
    """Whether a cell holds the value: numbers as numbers, text in any case."""
    v = V.scalar(v)
    tests = [c["n"] == v.n if v.n is not None else None, F.lower(c["t"]) == F.lower(v.t) if v.t is not None else None, c["b"] == v.b if v.b is not None else None]
    return F.coalesce(*(t for t in tests if t is not None), F.lit(False)) if any(t is not None for t in tests) else F.lit(False)


def place(cells: Column, test) -> Column:  # noqa: ANN001
    """The first place (from 1) whose cell passes; null if none does."""
    hits = F.transform(cells, lambda c, i: F.when(test(c), i + 1))
    return F.array_min(hits)


def at(cells: Column, i: Column, missing: str) -> Val:
    found = V.cell(F.get(cells, (i - 1).cast("int")))
    return Val(found.n, found.t, found.b, F.when(i.isNull(), F.lit(missing)).when((i < 1) | (i > F.size(cells)), F.lit(V.REF)).otherwise(found.e))


def _shape(v: Val) -> tuple[int, int]:
    return v.shape or (1, 1)


def every(cells: Column, start: Column, step: int | Column, count: int | Column) -> Column:
    """Every step-th cell from start (from 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(count) - 1 if isinstance(count, int) else count - 1), lambda i: F.get(cells, (start - 1 + i * step).cast("int")))


@define(K, "VLOOKUP PROCV", 3, 4)
def _vlookup(v: Val, table: Val, column: Val, _: Val | None = None) -> Val:
    (rows, columns), cells = _shape(table), V.to_cells(table)
    k, e = V.to_num(column)
    row = place(every(cells, F.lit(1), columns, rows), lambda c: same(c, v))
    out = at(cells, F.when(row.isNotNull(), F.when(k.between(1, columns), (row - 1) * columns + k).otherwise(-1)), V.NA)
    return Val(out.n, out.t, out.b, V.first_error(e, V.scalar(v).e, out.e))


@define(K, "HLOOKUP PROCH", 3, 4)
def _hlookup(v: Val, table: Val, row: Val, _: Val | None = None) -> Val:
    (rows, columns), cells = _shape(table), V.to_cells(table)
    k, e = V.to_num(row)
    column = place(F.slice(cells, 1, columns), lambda c: same(c, v))
    out = at(cells, F.when(column.isNotNull(), F.when(k.between(1, rows), (k - 1) * columns + column).otherwise(-1)), V.NA)
    return Val(out.n, out.t, out.b, V.first_error(e, V.scalar(v).e, out.e))


@define(K, "INDEX ÍNDICE", 2, 3)
def _index(table: Val, row: Val, column: Val | None = None) -> Val:
    (rows, columns), cells = _shape(table), V.to_cells(table)
    (r, e), (c, ec) = V.to_num(row), V.to_num(column) if column is not None else (L(1), None)
    line = rows == 1 or columns == 1
    i = F.when((r > rows) | (c > columns) | (r < 0) | (c < 0), -1).otherwise((F.greatest(r, L(1)) - 1) * columns + F.greatest(c, L(1)))
    if line and column is None:
        i = F.greatest(r, L(1))
    out = at(cells, i, V.REF)
    return Val(out.n, out.t, out.b, V.first_error(e, ec, out.e))


def _match(v: Val, cells: Column, kind: Column) -> Column:
    """0: the first that equals or fits a pattern; 1: the last at most v (ascending); -1: the last at least v (descending)."""
    v = V.scalar(v)
    exact = lambda c: same(c, v) | (F.coalesce(criteria.meets_column(c["n"], c["t"], v.t) & v.t.rlike(r"[*?]"), F.lit(False)) if v.t is not None else F.lit(False))
    first = place(cells, exact)
    number = v.n if v.n is not None else F.lit(None).cast("double")
    text = F.lower(v.t) if v.t is not None else F.lit(None).cast("string")
    up = F.array_max(F.transform(cells, lambda c, i: F.when(F.coalesce(c["n"] <= number, F.lower(c["t"]) <= text, F.lit(False)), i + 1)))
    down = F.array_max(F.transform(cells, lambda c, i: F.when(F.coalesce(c["n"] >= number, F.lower(c["t"]) >= text, F.lit(False)), i + 1)))
    return F.when(kind == 0, first).when(kind > 0, up).otherwise(down)


@define(K, "MATCH CORRESP", 2, 3)
def _match_function(v: Val, cells: Val, kind: Val | None = None) -> Val:
    i = _match(v, V.to_cells(cells), V.to_num(kind)[0] if kind is not None else L(1))
    return V.guard(Val(n=i.cast("double"), e=V.scalar(v).e), (i.isNull(), V.NA))


define(K, "XMATCH", 2, 4)(lambda v, cells, *_: _match_function(v, cells, V.literal(0.0)))


@define(K, "XLOOKUP PROCX", 3, 6)
def _xlookup(v: Val, keys: Val, values: Val, missing: Val | None = None, *_: Val) -> Val:
    i = _match(v, V.to_cells(keys), L(0))
    found = at(V.to_cells(values), i, V.NA)
    return V.either(i.isNull(), missing, found) if missing is not None else found


@define(K, "LOOKUP PROC", 2, 3)
def _lookup(v: Val, keys: Val, values: Val | None = None) -> Val:
    cells = V.to_cells(keys)
    return at(V.to_cells(values) if values is not None else cells, _match(v, cells, L(1)), V.NA)


@define(K, "CHOOSE ESCOLHER", 2, MANY)
def _choose(i: Val, *options: Val) -> Val:
    n, e = V.to_num(i)
    out = V.err(V.VALUE)
    for k, option in reversed(list(enumerate(options, 1))):
        out = V.either(F.floor(n) == k, option, out)
    return Val(out.n, out.t, out.b, V.first_error(e, out.e))


def letters(n: Column) -> Column:
    """A column's letters, up to XFD."""
    a, b, c = F.floor((n - 703) / 676), F.floor((n - 27) / 26) % 26, (n - 1) % 26
    sign = lambda x: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x.cast("int") + 1, F.lit(1))
    return F.concat(F.when(n > 702, sign(a % 26)).otherwise(""), F.when(n > 26, sign(b)).otherwise(""), sign(c))


@define(K, "ADDRESS ENDEREÇO", 2, 5)
def _address(row: Val, column: Val, kind: Val | None = None, _: Val | None = None, sheet: Val | None = None) -> Val:
    (r, er), (c, ec), k = V.to_num(row), V.to_num(column), V.to_num(kind)[0] if kind is not None else L(1)
    out = F.concat(F.when(k.isin(1, 3), "$").otherwise(""), letters(c), F.when(k.isin(1, 2), "$").otherwise(""), r.cast("long").cast("string"))
    if sheet is not None:
        out = F.concat(F.lit("'"), V.to_txt(sheet)[0], F.lit("'!"), out)
    return V.guard(Val(t=out, e=V.first_error(er, ec)))


def _reference(names: str, part: str) -> None:
    def make(args: tuple, _: object) -> Val:
        if not args or args[0].kind != "ref":
            return V.literal(1.0)
        return V.literal(float(getattr(args[0].value, part)))

    define(K, names, 0, 1, lazy=True)(make)


_reference("ROW LIN", "top")
_reference("COLUMN COL", "left")
define(K, "ROWS LINS", 1)(lambda v: V.literal(float(v.shape[0])) if v.shape else V.num(F.size(V.to_cells(v))))
define(K, "COLUMNS COLS", 1)(lambda v: V.literal(float(_shape(v)[1])))


# Ranges from ranges. Row by row; the shape is not known where it depends on the values. ----------------------------


def _key(c: Column) -> Column:
    return F.struct(c["n"].alias("n"), F.lower(c["t"]).alias("t"), c["b"].alias("b"))


define(K, "FILTER FILTRO", 2, 3)(lambda cells, use, other=None: V.span(_or_else(F.transform(F.filter(F.zip_with(V.to_cells(cells), V.to_cells(use), lambda c, u: F.struct(c.alias("c"), F.coalesce(u["b"], u["n"] != 0, F.lit(False)).alias("u"))), lambda p: p["u"]), lambda p: p["c"]), other)))


def _or_else(cells: Column, other: Val | None) -> Column:
    return F.when(F.size(cells) > 0, cells).otherwise(V.to_cells(other if other is not None else V.err("#CALC!")))


def _sorted(cells: Column, keys: Column, down: Column) -> Column:
    rows = F.zip_with(cells, keys, lambda c, k: F.struct(_key(k).alias("k"), c.alias("c")))
    placed = F.array_sort(F.transform(rows, lambda r, i: F.struct(r["k"].alias("k"), i.alias("i"), r["c"].alias("c"))))
    return F.transform(F.when(down, F.reverse(placed)).otherwise(placed), lambda r: r["c"])


define(K, "SORT CLASSIFICAR", 1, 3)(lambda cells, _=None, way=None: V.span(_sorted(V.to_cells(cells), V.to_cells(cells), V.to_num(way)[0] < 0 if way is not None else F.lit(False))))
define(K, "SORTBY CLASSIFICARPOR", 2, 3)(lambda cells, keys, way=None: V.span(_sorted(V.to_cells(cells), V.to_cells(keys), V.to_num(way)[0] < 0 if way is not None else F.lit(False))))
define(K, "UNIQUE ÚNICO", 1, 3)(lambda cells, *_: V.span(F.transform(F.filter(F.transform(V.to_cells(cells), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda p: p["i"] == F.array_position(F.transform(V.to_cells(cells), _key), _key(p["c"])) - 1), lambda p: p["c"])))
define(K, "TRANSPOSE TRANSPOR", 1)(lambda v: V.span(F.transform(F.sequence(F.lit(0), F.lit(_shape(v)[0] * _shape(v)[1] - 1)), lambda i: F.get(V.to_cells(v), ((i % _shape(v)[0]) * _shape(v)[1] + F.floor(i / _shape(v)[0])).cast("int"))), _shape(v)[::-1]))
define(K, "VSTACK", 1, MANY)(lambda *a: V.span(V.flat(list(a)), (sum(_shape(v)[0] for v in a), _shape(a[0])[1])))


def _sequence(rows: Val, columns: Val | None = None, start: Val | None = None, step: Val | None = None) -> Val:
    r, c, a, d = (V.to_num(v)[0] if v is not None else L(1) for v in (rows, columns, start, step))
    cells = F.transform(F.sequence(F.lit(0), (r * c).cast("int") - 1), lambda i: V.num(a + i * d).struct().cast(V.CELL))
    return V.span(cells)


define(K, "SEQUENCE SEQUÊNCIA", 1, 4)(_sequence)


def _part(take: bool):  # noqa: ANN202
    def make(cells: Val, n: Val) -> Val:
        (k, _), c = V.to_num(n), V.to_cells(cells)
        width = _shape(cells)[1] if cells.shape else 1
        size, k = F.size(c), F.floor(k).cast("int") * width
        if take:
            return V.span(F.when(k >= 0, F.slice(c, F.lit(1), F.least(k, size))).otherwise(F.slice(c, size - F.least(-k, size) + 1, F.least(-k, size))))
        return V.span(F.when(k >= 0, F.slice(c, F.least(k, size) + 1, size)).otherwise(F.slice(c, F.lit(1), F.greatest(size + k, F.lit(0)))))

    return make


define(K, "TAKE", 2)(_part(True))
define(K, "DROP", 2)(_part(False))
define(K, "TEXTSPLIT", 2)(lambda text, sign: V.span(F.transform(F.split(V.to_txt(text)[0], F.concat(F.lit("\\Q"), V.to_txt(sign)[0], F.lit("\\E"))), lambda t: V.txt(t).struct().cast(V.CELL))))
