"""Functions of the user's own in formulas: by name, class and arity, as expressions or over Arrow arrays.

    add("MARKUP", "ARITHMETIC", 2, columns=lambda price, percent: price * (1 + percent / 100))
    add("DIGITSUM", "ARITHMETIC", 1, arrow=lambda xs: pa.array([sum(map(int, str(int(x)))) for x in xs.to_pylist()]))

From then on parser, classifier, risk findings, evaluation and scenarios know the name, in this process; tasks get the
function with the plan. Arguments are numbers as in arithmetic: blanks are 0, truth values 1 or 0, and text that reads as no
number is an error, as is an argument that holds one. A null or an infinite result is #NUM!. A table function (a range to a
number) takes arrays: give ranges=True, and its argument is all numbers of its arguments, as one array.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions import library  # noqa: F401  the names that are taken
from cellarium.functions import registry as R

_ADDED: set[str] = set()


def add(name: str, kind: str, least: int, most: int | None = None, *, columns: Callable[..., Column] | None = None, arrow: Callable[..., pa.Array] | None = None, ranges: bool = False) -> None:
    """Registers a function of least to most arguments. A name that exists is refused, unless it was added here."""
    name = name.upper()
    if (columns is None) == (arrow is None):
        raise ValueError("give a function of columns or of Arrow arrays")
    if kind not in R.ORDER:
        raise ValueError(f"{kind!r} is none of the classes {R.ORDER}")
    if name in R.FUNCTIONS and name not in _ADDED:
        raise ValueError(f"{name} exists")
    remove(name)
    compute = columns if columns is not None else _over_arrow(arrow)
    if ranges:
        R.sampled(kind, name, compute)
        R.FUNCTIONS[name] = R.Function(name, kind, least, R.MANY if most is None else most, R.FUNCTIONS[name].make)
    else:
        R.numeric(kind, name, least, least if most is None else most, compute)
    _ADDED.add(name)


def remove(name: str) -> None:
    """Forgets a function that was added here; other names stay."""
    if name.upper() in _ADDED:
        _ADDED.discard(name.upper())
        del R.FUNCTIONS[name.upper()]


def added() -> list[str]:
    return sorted(_ADDED)


def _over_arrow(f: Callable[..., pa.Array]) -> Callable[..., Column]:
    def each(*arrays: pa.Array) -> pa.Array:  # the name tells scans that this is Python
        return f(*arrays).cast(pa.float64())

    udf = F.arrow_udf(each, "double")
    return lambda *xs: udf(*xs)
