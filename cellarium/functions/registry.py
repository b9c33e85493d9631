"""The spreadsheet functions by name: class, arity, and how each becomes a column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellarium.functions import values as V
from cellarium.functions.values import Val


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    least: int
    most: int
    make: Callable[..., Val]
    lazy: bool = False


FUNCTIONS: dict[str, Function] = {}


def define(kind: str, names: str, least: int, most: int | None = None, lazy: bool = False) -> Callable:
    """Registers a maker of Val from Vals (or, if lazy, from syntax nodes and a way to compile them) under all its names."""

    def register(make: Callable[..., Val]) -> Callable[..., Val]:
        first, *_ = names.split()
        for name in names.split():
            if name in FUNCTIONS:
                raise ValueError(f"{name} is defined twice")
            FUNCTIONS[name] = Function(first, kind, least, least if most is None else most, make, lazy)
        return make

    return register


MANY = 255


def numeric(kind: str, names: str, least: int, most: int | None, f: Callable[..., Column], *tests: tuple[Callable[..., Column], str], defaults: tuple = ()) -> None:
    """A function of numbers. A result that is no finite number is #NUM!."""

    def make(*args: Val) -> Val:
        pairs = [V.to_num(a) for a in args]
        xs = [x for x, _ in pairs] + [F.lit(float(d)) for d in defaults[len(pairs) - least :]]
        out = f(*xs)
        v = V.guard(Val(n=out.cast("double"), e=V.first_error(*(e for _, e in pairs))), *((t(*xs), code) for t, code in tests))
        return V.guard(v, (v.n.isNull() & (v.e.isNull() if v.e is not None else F.lit(True)) | F.isnan(v.n) | (F.abs(v.n) == float("inf")), V.NUM))

    define(kind, names, least, least + len(defaults) if most is None else most)(make)


def textual(kind: str, names: str, least: int, most: int | None, f: Callable[..., Column], out: str = "t", *tests: tuple[Callable[..., Column], str]) -> None:
    """A function of texts."""

    def make(*args: Val) -> Val:
        pairs = [V.to_txt(a) for a in args]
        xs = [x for x, _ in pairs]
        v = Val(**{out: f(*xs)}, e=V.first_error(*(e for _, e in pairs)))
        return V.guard(v, *((t(*xs), code) for t, code in tests))

    define(kind, names, least, most)(make)


def sampled(kind: str, names: str, f: Callable[[Column], Column], *tests: tuple[Callable[[Column], Column], str], flat: Callable[[Column], Column] = V.numbers) -> None:
    """A function of all numbers among its arguments, as one array."""

    def make(*args: Val) -> Val:
        cells = V.flat(list(args))
        xs = flat(cells)
        return V.guard(Val(n=f(xs).cast("double"), e=V.error_in(cells)), *((t(xs), code) for t, code in tests))

    define(kind, names, 1, MANY)(make)


def python_number(f: Callable[..., float]) -> Callable[..., Column]:
    """A Python function of numbers over Arrow batches; what it cannot compute is null. Only for what no expression computes."""

    def each(*columns: pd.Series) -> pd.Series:
        def one(*xs: float) -> float | None:
            try:
                return float(f(*xs))
            except (ValueError, OverflowError, ZeroDivisionError, ArithmeticError):
                return None

        known: dict[object, float | None] = {}  # of a batch: arguments that recur are computed once

        def value(row: tuple) -> float | None:
            key = row if 0.0 not in row else repr(row)  # 0 and -0 are apart
            if key not in known:
                known[key] = one(*row)
            return known[key]

        return pd.Series([None if any(x is None or x != x for x in row) else value(row) for row in zip(*columns, strict=True)], dtype="float64")

    from pyspark.sql.functions import pandas_udf

    udf = pandas_udf(each, DoubleType())
    return lambda *xs: udf(*(x.cast("double") for x in xs))


def python_array(f: Callable[..., float], arrays: int = 1) -> Callable[..., Column]:
    """The same for functions whose first arguments are arrays."""

    def each(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append(float(f(*([float(x) for x in a] for a in row[:arrays]), *row[arrays:])))
            except (ValueError, OverflowError, ZeroDivisionError, ArithmeticError, TypeError):
                out.append(None)
        return pd.Series(out, dtype="float64")

    from pyspark.sql.functions import pandas_udf

    udf = pandas_udf(each, DoubleType())
    return lambda *xs: udf(*xs)


# Names of spreadsheet functions that have no computation here; they answer #UNSUPPORTED!.
STATISTICAL = """
T.TEST TTEST CHISQ.DIST CHISQ.DIST.RT CHISQ.INV CHISQ.INV.RT CHISQ.TEST CHITEST F.DIST F.DIST.RT F.INV F.INV.RT F.TEST FTEST
BINOM.DIST.RANGE NEGBINOM.DIST NEGBINOMDIST EXPON.DIST EXPONDIST GAMMA.DIST GAMMADIST GAMMA.INV GAMMAINV BETA.DIST BETADIST
BETA.INV BETAINV LOGNORM.DIST LOGNORMDIST LOGNORM.INV LOGINV WEIBULL.DIST WEIBULL HYPGEOM.DIST HYPGEOMDIST PROB FREQUENCY
Z.TEST ZTEST LINEST LOGEST TREND GROWTH FORECAST.ETS FORECAST.ETS.CONFINT FORECAST.ETS.SEASONALITY FORECAST.ETS.STAT
"""
DATABASE = "DAVERAGE DCOUNT DCOUNTA DGET DMAX DMIN DPRODUCT DSTDEV DSTDEVP DSUM DVAR DVARP"
FINANCIAL = """
FVSCHEDULE DURATION MDURATION DISC INTRATE RECEIVED TBILLEQ TBILLPRICE TBILLYIELD PRICE PRICEDISC PRICEMAT YIELD YIELDDISC
YIELDMAT ACCRINT ACCRINTM COUPDAYBS COUPDAYS COUPDAYSNC COUPNCD COUPNUM COUPPCD ODDFPRICE ODDFYIELD ODDLPRICE ODDLYIELD
AMORDEGRC AMORLINC
"""
ARRAY = """
RANDARRAY TOCOL TOROW HSTACK CHOOSEROWS CHOOSECOLS EXPAND TRIMRANGE MAKEARRAY BYCOL BYROW SCAN REDUCE MAP LAMBDA GROUPBY
PIVOTBY PERCENTOF MUNIT
"""
OTHER = """
ASC DBCS BAHTTEXT PHONETIC JIS ARRAYTOTEXT VALUETOTEXT OFFSET INDIRECT AREAS GETPIVOTDATA FORMULATEXT HYPERLINK RTD ISREF
ISFORMULA ISOMITTED ERROR.TYPE CELL INFO SHEET SHEETS BESSELI BESSELJ BESSELK BESSELY CUBEVALUE CUBEMEMBER CUBESET
CUBESETCOUNT CUBEMEMBERPROPERTY CUBERANKEDMEMBER CUBEKPIMEMBER FILTERXML WEBSERVICE COPILOT TRANSLATE DETECTLANGUAGE IMAGE
STOCKHISTORY
"""
PORTUGUESE = """
DESLOC INDIRETO ÉREF ÉFÓRMULA FREQUÊNCIA CRESCIMENTO TENDÊNCIA PROJ.LIN PROJ.LOG BDSOMA BDMÉDIA BDCONTAR BDCONTARA BDMÁX
BDMÍN BDEXTRAIR BDMULTIPL BDEST BDDESVPA BDVAREST BDVARP MATRIZALEATÓRIA FÓRMULATEXTO INFODADOSTABELADINÂMICA IMAGEM
"""
KNOWN = frozenset(" ".join((STATISTICAL, DATABASE, FINANCIAL, ARRAY, OTHER, PORTUGUESE)).split())


def call(name: str, args: tuple, compiled: Callable[[object], Val]) -> Val:
    name = name.upper()
    found = FUNCTIONS.get(name)
    if found is None:
        return V.err(V.UNSUPPORTED if name in KNOWN else V.NAME)
    if not found.least <= len(args) <= found.most:
        return V.err(V.VALUE)
    return found.make(args, compiled) if found.lazy else found.make(*(compiled(a) for a in args))


def classify(names: list[str]) -> str:
    """The class of a formula by the functions in it: that of the first rule they meet."""
    from cellarium.functions.rules import rule  # with all functions defined

    return rule(names)[0]


#: The classes of formulas.
ORDER = ("AGGREGATION", "CONDITIONAL", "LOOKUP", "DATE_LOGIC", "TEXT_TRANSFORMATION", "RANKING", "THRESHOLD_LOGIC", "ARITHMETIC")
