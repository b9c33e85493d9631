"""Cell values as Spark columns.

A cell is a number, a text, a truth value, an error or blank. A Val has a column for each kind that it can be (None where
that is known to be impossible), of which one at most is non-null in a row; a range is an array of structs of the four.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "struct<n:double,t:string,b:boolean,e:string>"
DIV0, VALUE, NA, NUM, REF, NAME, EXT, UNSUPPORTED = "#DIV/0!", "#VALUE!", "#N/A", "#NUM!", "#REF!", "#NAME?", "#EXT!", "#UNSUPPORTED!"


@dataclass(frozen=True)
class Val:
    n: Column | None = None
    t: Column | None = None
    b: Column | None = None
    e: Column | None = None
    #: A range: array<CELL>, row by row, and its shape if that is known.
    cells: Column | None = None
    shape: tuple[int, int] | None = None

    def struct(self) -> Column:
        null = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
        if self.cells is not None:
            return F.get(self.cells, F.lit(0))
        return F.struct(null(self.n, "double").alias("n"), null(self.t, "string").alias("t"), null(self.b, "boolean").alias("b"), null(self.e, "string").alias("e"))


def num(c: Column, e: Column | None = None) -> Val:
    return Val(n=c.cast("double"), e=e)


def txt(c: Column, e: Column | None = None) -> Val:
    return Val(t=c, e=e)


def boolean(c: Column, e: Column | None = None) -> Val:
    return Val(b=c, e=e)


def err(code: str) -> Val:
    return Val(e=F.lit(code))


def cell(c: Column) -> Val:
    """A value from a CELL column."""
    return Val(n=c["n"], t=c["t"], b=c["b"], e=c["e"])


def span(cells: Column, shape: tuple[int, int] | None = None) -> Val:
    return Val(cells=cells, shape=shape)


def scalar(v: Val) -> Val:
    return cell(F.get(v.cells, F.lit(0))) if v.cells is not None else v


def literal(x: object) -> Val:
    if isinstance(x, bool):
        return boolean(F.lit(x))
    if isinstance(x, (int, float)):
        return num(F.lit(float(x)))
    return Val() if x is None else txt(F.lit(str(x)))


def first_error(*parts: Column | None) -> Column | None:
    parts = [p for p in parts if p is not None]
    return F.coalesce(*parts) if len(parts) > 1 else parts[0] if parts else None


def guard(v: Val, *tests: tuple[Column, str]) -> Val:
    """v, or the error of the first test that holds."""
    e = v.e
    for test, code in tests:
        e = first_error(e, F.when(test, F.lit(code)))
    clear = (lambda c: None if c is None else F.when(e.isNull(), c)) if e is not None else (lambda c: c)
    return Val(clear(v.n), clear(v.t), clear(v.b), e)


def to_num(v: Val) -> tuple[Column, Column | None]:
    """The number that v is in arithmetic, and its error: blanks are 0, truth values 1 or 0, text must read as a number."""
    v = scalar(v)
    parts, e = [], v.e
    if v.n is not None:
        parts.append(v.n)
    if v.b is not None:
        parts.append(v.b.cast("int").cast("double"))
    if v.t is not None:
        read = v.t.try_cast("double")
        parts.append(read)
        e = first_error(e, F.when(v.t.isNotNull() & read.isNull(), F.lit(VALUE)))
    return F.coalesce(*parts, F.lit(0.0)), e


def shown(n: Column) -> Column:
    """A number as text: whole ones without a point."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), F.format_string("%d", n.cast("long"))).otherwise(n.cast("string"))


def to_txt(v: Val) -> tuple[Column, Column | None]:
    v = scalar(v)
    parts = []
    if v.t is not None:
        parts.append(v.t)
    if v.n is not None:
        parts.append(shown(v.n))
    if v.b is not None:
        parts.append(F.upper(v.b.cast("string")))
    return F.coalesce(*parts, F.lit("")), v.e


def to_bool(v: Val) -> tuple[Column, Column | None]:
    v = scalar(v)
    parts = []
    if v.b is not None:
        parts.append(v.b)
    if v.n is not None:
        parts.append(v.n != 0)
    if v.t is not None:
        parts.append(v.t != "")
    return F.coalesce(*parts, F.lit(False)), v.e


def to_cells(v: Val) -> Column:
    return v.cells if v.cells is not None else F.array(v.struct().cast(CELL))


def flat(args: list[Val]) -> Column:
    return F.concat(*(to_cells(a) for a in args)) if len(args) > 1 else to_cells(args[0])


def error_in(cells: Column) -> Column:
    """The first error among the cells."""
    return F.get(F.filter(cells, lambda c: c["e"].isNotNull()), F.lit(0))["e"]


def numbers(cells: Column) -> Column:
    """The numbers among the cells; truth values and text are passed over."""
    return F.transform(F.filter(cells, lambda c: c["n"].isNotNull()), lambda c: c["n"])


def either(test: Column, a: Val, b: Val) -> Val:
    """a where the test holds, else b."""
    a, b = scalar(a), scalar(b)

    def pick(x: Column | None, y: Column | None) -> Column | None:
        if x is None and y is None:
            return None
        return F.when(test, x if x is not None else F.lit(None)).otherwise(y if y is not None else F.lit(None))

    return Val(pick(a.n, b.n), pick(a.t, b.t), pick(a.b, b.b), pick(a.e, b.e))
