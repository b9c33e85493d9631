"""Logic, arithmetic, trigonometry, combinatorics, finance, engineering and complex numbers."""

from __future__ import annotations

import cmath
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from cellarium.functions import values as V
from cellarium.functions.registry import MANY, define, numeric, python_array, python_number, sampled
from cellarium.functions.values import Val

L = lambda x: F.lit(float(x))
zero = lambda x: x == 0

# Logic -------------------------------------------------------------------------------------------------------------


def _carry(e: Column | None, out: Val) -> Val:
    """out, or an error that comes before it."""
    if e is None:
        return out
    clear = lambda c: None if c is None else F.when(e.isNull(), c)
    return Val(clear(out.n), clear(out.t), clear(out.b), F.coalesce(e, out.e) if out.e is not None else e)


@define("CONDITIONAL", "IF SE", 2, 3)
def _if(test: Val, yes: Val, no: Val | None = None) -> Val:
    b, e = V.to_bool(test)
    return _carry(e, V.either(b, yes, no if no is not None else V.boolean(F.lit(False))))


@define("CONDITIONAL", "IFS SES", 2, MANY)
def _ifs(*args: Val) -> Val:
    out = V.err(V.NA)
    for test, value in reversed(list(zip(args[::2], args[1::2], strict=False))):
        b, e = V.to_bool(test)
        out = _carry(e, V.either(b, value, out))
    return out


@define("CONDITIONAL", "IFERROR SEERRO", 2)
def _iferror(v: Val, other: Val) -> Val:
    v = V.scalar(v)
    return v if v.e is None else V.either(v.e.isNotNull(), other, v)


@define("CONDITIONAL", "IFNA SENÃODISP", 2)
def _ifna(v: Val, other: Val) -> Val:
    v = V.scalar(v)
    return v if v.e is None else V.either(F.coalesce(v.e == V.NA, F.lit(False)), other, v)


def _truths(args: tuple[Val, ...]) -> tuple[Column, Column]:
    cells = V.flat(list(args))
    return F.transform(cells, lambda c: F.coalesce(c["b"], c["n"] != 0, c["t"] != "", F.lit(False))), V.error_in(cells)


define("CONDITIONAL", "AND E", 1, MANY)(lambda *a: V.guard(Val(b=F.forall(_truths(a)[0], lambda x: x), e=_truths(a)[1])))
define("CONDITIONAL", "OR OU", 1, MANY)(lambda *a: V.guard(Val(b=F.exists(_truths(a)[0], lambda x: x), e=_truths(a)[1])))
define("CONDITIONAL", "XOR", 1, MANY)(lambda *a: V.guard(Val(b=F.size(F.filter(_truths(a)[0], lambda x: x)) % 2 == 1, e=_truths(a)[1])))
define("CONDITIONAL", "NOT NÃO", 1)(lambda a: V.guard(Val(b=~V.to_bool(a)[0], e=V.to_bool(a)[1])))
define("CONDITIONAL", "TRUE VERDADEIRO", 0)(lambda: V.boolean(F.lit(True)))
define("CONDITIONAL", "FALSE FALSO", 0)(lambda: V.boolean(F.lit(False)))
define("CONDITIONAL", "NA NÃO.DISP", 0)(lambda: V.err(V.NA))


@define("CONDITIONAL", "SWITCH PARÂMETRO", 3, MANY)
def _switch(v: Val, *rest: Val) -> Val:
    from cellarium.functions.formula import _compare

    out = rest[-1] if len(rest) % 2 else V.err(V.NA)
    for key, value in reversed(list(zip(rest[::2], rest[1::2], strict=False))):
        out = V.either(F.coalesce(_compare("=", v, key).b, F.lit(False)), value, out)
    return _carry(V.scalar(v).e, out)


# Arithmetic --------------------------------------------------------------------------------------------------------

A = "ARITHMETIC"
T = "THRESHOLD_LOGIC"


def ten(d: Column) -> Column:
    return F.pow(L(10), F.floor(d))


def rounded(n: Column, d: Column) -> Column:
    """Half away from zero, on the shortest decimal text, as spreadsheets show it."""
    scaled = F.abs(n) * ten(d)
    return F.signum(n) * F.floor(F.round(scaled, 9) + 0.5) / ten(d)


def aggregate(xs: Column, start: float, f) -> Column:  # noqa: ANN001
    return F.aggregate(xs, L(start), f)


def total(xs: Column) -> Column:
    return aggregate(xs, 0, lambda s, x: s + x)


def product(xs: Column) -> Column:
    return aggregate(xs, 1, lambda s, x: s * x)


def falling(n: Column, k: Column) -> Column:
    """n (n - 1) ... (n - k + 1)."""
    steps = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(1)) - 1), lambda i: n - i)).otherwise(F.array().cast("array<double>"))
    return product(steps)


def choose(n: Column, k: Column) -> Column:
    steps = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), lambda i: (n - k + i) / i)).otherwise(F.array().cast("array<double>"))
    return F.round(product(steps))


whole = F.floor
numeric(A, "ABS", 1, 1, F.abs)
numeric(T, "INT", 1, 1, F.floor)
numeric(T, "TRUNC TRUNCAR", 1, None, lambda n, d: F.signum(n) * F.floor(F.abs(n) * ten(d)) / ten(d), defaults=(0,))
numeric(A, "MOD RESTO", 2, 2, lambda a, b: a - b * F.floor(F.try_divide(a, b)), (lambda a, b: b == 0, V.DIV0))
numeric(A, "SIGN SINAL", 1, 1, F.signum)
numeric(T, "ROUND ARRED", 1, None, rounded, defaults=(0,))
numeric(T, "ROUNDUP ARREDONDAR.PARA.CIMA", 1, None, lambda n, d: F.signum(n) * F.ceil(F.round(F.abs(n) * ten(d), 9)) / ten(d), defaults=(0,))
numeric(T, "ROUNDDOWN ARREDONDAR.PARA.BAIXO", 1, None, lambda n, d: F.signum(n) * F.floor(F.round(F.abs(n) * ten(d), 9)) / ten(d), defaults=(0,))
numeric(T, "CEILING CEILING.MATH CEILING.PRECISE TETO", 1, None, lambda n, s: F.when(s == 0, 0.0).otherwise(F.ceil(F.try_divide(n, s)) * s), defaults=(1,))
numeric(T, "FLOOR FLOOR.MATH FLOOR.PRECISE PISO", 1, None, lambda n, s: F.when(s == 0, 0.0).otherwise(F.floor(F.try_divide(n, s)) * s), defaults=(1,))
numeric(T, "MROUND MARRED", 2, 2, lambda n, m: F.when(m == 0, 0.0).otherwise(rounded(F.try_divide(n, m), L(0)) * m))
numeric(T, "EVEN PAR", 1, 1, lambda n: F.signum(n) * F.ceil(F.abs(n) / 2) * 2)
numeric(T, "ODD ÍMPAR", 1, 1, lambda n: F.when(n < 0, -1.0).otherwise(1.0) * (F.ceil((F.greatest(F.abs(n), L(1)) + 1) / 2) * 2 - 1))
numeric(A, "QUOTIENT QUOCIENTE", 2, 2, lambda n, d: F.signum(F.try_divide(n, d)) * F.floor(F.abs(F.try_divide(n, d))), (lambda n, d: d == 0, V.DIV0))
numeric(A, "POWER POTÊNCIA", 2, 2, F.pow)
numeric(A, "SQRT RAIZ", 1, 1, lambda n: F.sqrt(F.abs(n)), (lambda n: n < 0, V.NUM))
numeric(A, "SQRTPI RAIZPI", 1, 1, lambda n: F.sqrt(F.abs(n) * math.pi), (lambda n: n < 0, V.NUM))
numeric(A, "EXP", 1, 1, F.exp)
numeric(A, "LN", 1, 1, F.ln)
numeric(A, "LOG", 1, None, lambda n, b: F.try_divide(F.ln(n), F.ln(b)), defaults=(10,))
numeric(A, "LOG10", 1, 1, F.log10)
numeric(A, "FACT FATORIAL", 1, 1, lambda n: falling(whole(n), whole(n)), (lambda n: n < 0, V.NUM))
numeric(A, "FACTDOUBLE", 1, 1, lambda n: F.when(n < 2, 1.0).otherwise(product(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / 2).cast("int") - 1, F.lit(0))), lambda i: F.greatest(whole(n) - 2 * i, L(1))))), (lambda n: n < -1, V.NUM))
numeric(A, "COMBIN", 2, 2, lambda n, k: choose(whole(n), whole(k)), (lambda n, k: (k < 0) | (k > n), V.NUM))
numeric(A, "COMBINA", 2, 2, lambda n, k: choose(whole(n) + whole(k) - 1, whole(k)), (lambda n, k: (k < 0) | (n < 0), V.NUM))
numeric(A, "PERMUT", 2, 2, lambda n, k: falling(whole(n), whole(k)), (lambda n, k: (k < 0) | (k > n), V.NUM))
numeric(A, "PERMUTATIONA", 2, 2, lambda n, k: F.pow(whole(n), whole(k)))
numeric(A, "PI", 0, 0, lambda: F.pi())
numeric(A, "RAND ALEATÓRIO", 0, 0, lambda: L(0.5))  # a fixed middle, so that a recomputed plan agrees with itself
numeric(A, "RANDBETWEEN ALEATÓRIOENTRE", 2, 2, lambda a, b: F.floor((a + b) / 2))
for names, f in (
    ("DEGREES GRAUS", F.degrees), ("RADIANS RADIANOS", F.radians), ("SIN SEN", F.sin), ("COS", F.cos), ("TAN", F.tan), ("ATAN", F.atan), ("SINH SENH", F.sinh), ("COSH", F.cosh),
    ("TANH", F.tanh), ("ASINH", F.asinh), ("ACOSH", F.acosh), ("ATANH", F.atanh), ("SEC", F.sec), ("SECH", lambda x: 1 / F.cosh(x)),
    ("ACOT", lambda x: math.pi / 2 - F.atan(x)), ("FISHERINV", F.tanh), ("ASIN ASEN", F.asin), ("ACOS", F.acos),
):
    numeric(A, names, 1, 1, f)
for names, f in (("CSC", lambda x: F.try_divide(L(1), F.sin(x))), ("COT", lambda x: F.try_divide(L(1), F.tan(x))), ("CSCH", lambda x: F.try_divide(L(1), F.sinh(x))), ("COTH", lambda x: F.try_divide(L(1), F.tanh(x)))):
    numeric(A, names, 1, 1, f, (zero, V.DIV0))
numeric(A, "ACOTH", 1, 1, lambda x: F.atanh(F.try_divide(L(1), x)), (lambda x: F.abs(x) <= 1, V.NUM))
numeric(A, "ATAN2", 2, 2, lambda x, y: F.atan2(y, x), (lambda x, y: (x == 0) & (y == 0), V.DIV0))
numeric(A, "FISHER", 1, 1, lambda x: 0.5 * F.ln(F.try_divide(1 + x, 1 - x)))
numeric(A, "DELTA", 1, None, lambda a, b: (a == b).cast("double"), defaults=(0,))
numeric(A, "GESTEP DEGRAU", 1, None, lambda a, b: (a >= b).cast("double"), defaults=(0,))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, of which doubles below 2**53 need 80 at most."""
    pair = F.struct(a.alias("x"), b.alias("y"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(80)), pair, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] - s["y"] * F.floor(F.try_divide(s["x"], s["y"]))).alias("y"))))
    return done["x"]


sampled(A, "GCD MDC", lambda xs: aggregate(F.transform(xs, lambda x: F.floor(F.abs(x)).cast("double")), 0, _gcd))
sampled(A, "LCM MMC", lambda xs: aggregate(F.transform(xs, lambda x: F.floor(F.abs(x)).cast("double")), 1, lambda s, x: F.when(x == 0, 0.0).otherwise(s * F.try_divide(x, _gcd(s, x)))))
sampled(A, "MULTINOMIAL", lambda xs: F.round(falling(total(xs), total(xs)) / product(F.transform(xs, lambda x: falling(x, x)))))
sampled(A, "PRODUCT MULT", product)
sampled(A, "SUMSQ SOMAQUAD", lambda xs: aggregate(xs, 0, lambda s, x: s + x * x))


def pairs(a: Val, b: Val) -> Column:
    """Numbers at the same places of two ranges, where both have one."""
    both = F.zip_with(V.to_cells(a), V.to_cells(b), lambda x, y: F.struct(x["n"].alias("x"), y["n"].alias("y")))
    return F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def paired(kind: str, names: str, f, mismatch: bool = False) -> None:  # noqa: ANN001
    def make(a: Val, b: Val) -> Val:
        ca, cb = V.to_cells(a), V.to_cells(b)
        v = Val(n=f(pairs(a, b)).cast("double"), e=V.first_error(V.error_in(ca), V.error_in(cb)))
        return V.guard(v, *([(F.size(ca) != F.size(cb), V.NA)] if mismatch else []))

    define(kind, names, 2)(make)


paired(A, "SUMX2MY2", lambda p: total(F.transform(p, lambda q: q["x"] * q["x"] - q["y"] * q["y"])))
paired(A, "SUMX2PY2", lambda p: total(F.transform(p, lambda q: q["x"] * q["x"] + q["y"] * q["y"])))
paired(A, "SUMXMY2", lambda p: total(F.transform(p, lambda q: (q["x"] - q["y"]) * (q["x"] - q["y"]))))


@define("AGGREGATION", "SUMPRODUCT SOMARPRODUTO", 1, MANY)
def _sumproduct(*args: Val) -> Val:
    cells = [V.to_cells(a) for a in args]
    out = F.transform(cells[0], lambda c: F.coalesce(c["n"], c["b"].cast("int").cast("double"), L(0)))
    for other in cells[1:]:
        out = F.zip_with(out, other, lambda x, c: x * F.coalesce(c["n"], c["b"].cast("int").cast("double"), L(0)))
    v = Val(n=total(F.filter(out, lambda x: x.isNotNull())), e=V.first_error(*(V.error_in(c) for c in cells)))
    return V.guard(v, *((F.size(c) != F.size(cells[0]), V.VALUE) for c in cells[1:]))


@define(A, "SERIESSUM", 4)
def _seriessum(x: Val, n: Val, m: Val, coefficients: Val) -> Val:
    (x, ex), (n, en), (m, em) = V.to_num(x), V.to_num(n), V.to_num(m)
    terms = F.transform(V.numbers(V.to_cells(coefficients)), lambda c, i: c * F.pow(x, n + i * m))
    return V.guard(Val(n=total(terms), e=V.first_error(ex, en, em)))


# Finance -----------------------------------------------------------------------------------------------------------


def grown(r: Column, n: Column) -> Column:
    return F.pow(1 + r, n)


def annuity(r: Column, n: Column, kind: Column) -> Column:
    """What payments of 1 are worth at the end."""
    return F.when(r == 0, n).otherwise(F.try_divide((grown(r, n) - 1) * (1 + r * kind), r))


def pmt(r: Column, n: Column, pv: Column, fv: Column, kind: Column) -> Column:
    return -F.try_divide(pv * grown(r, n) + fv, annuity(r, n, kind))


def ipmt(r: Column, per: Column, n: Column, pv: Column, fv: Column, kind: Column) -> Column:
    p = pmt(r, n, pv, fv, kind)
    before = pv * grown(r, per - 1) + p * annuity(r, per - 1, kind)
    return F.when((per == 1) & (kind == 1), 0.0).otherwise(-before * r / F.when(kind == 1, 1 + r).otherwise(1.0))


numeric(A, "PMT PGTO", 3, None, pmt, defaults=(0, 0))
numeric(A, "IPMT IPGTO", 4, None, ipmt, defaults=(0, 0))
numeric(A, "PPMT PPGTO", 4, None, lambda r, per, n, pv, fv, k: pmt(r, n, pv, fv, k) - ipmt(r, per, n, pv, fv, k), defaults=(0, 0))
numeric(A, "CUMIPMT PGTOJURACUM", 6, 6, lambda r, n, pv, a, b, k: total(F.transform(F.sequence(a.cast("int"), b.cast("int")), lambda i: ipmt(r, i.cast("double"), n, pv, L(0), k))))
numeric(A, "CUMPRINC PGTOCAPACUM", 6, 6, lambda r, n, pv, a, b, k: total(F.transform(F.sequence(a.cast("int"), b.cast("int")), lambda i: pmt(r, n, pv, L(0), k) - ipmt(r, i.cast("double"), n, pv, L(0), k))))
numeric(A, "FV VF", 3, None, lambda r, n, p, pv, k: -(pv * grown(r, n) + p * annuity(r, n, k)), defaults=(0, 0))
numeric(A, "PV VP", 3, None, lambda r, n, p, fv, k: -F.try_divide(fv + p * annuity(r, n, k), grown(r, n)), defaults=(0, 0))
numeric(A, "NPER", 3, None, lambda r, p, pv, fv, k: F.when(r == 0, -F.try_divide(pv + fv, p)).otherwise(F.try_divide(F.ln(F.try_divide(p * (1 + r * k) - fv * r, p * (1 + r * k) + pv * r)), F.ln(1 + r))), defaults=(0, 0))
numeric(A, "SLN DPD", 3, 3, lambda c, s, n: F.try_divide(c - s, n), (lambda c, s, n: n == 0, V.DIV0))
numeric(A, "SYD SDA", 4, 4, lambda c, s, n, p: F.try_divide((c - s) * (n - p + 1) * 2, n * (n + 1)))
numeric(A, "DDB BDD", 4, None, lambda c, s, n, p, f: _ddb(c, s, n, p, f), defaults=(2,))
numeric(A, "EFFECT EFETIVA", 2, 2, lambda r, n: F.pow(1 + F.try_divide(r, whole(n)), whole(n)) - 1)
numeric(A, "NOMINAL", 2, 2, lambda r, n: whole(n) * (F.pow(1 + r, F.try_divide(L(1), whole(n))) - 1))
numeric(A, "PDURATION DURAÇÃOP", 3, 3, lambda r, pv, fv: F.try_divide(F.ln(fv) - F.ln(pv), F.ln(1 + r)))
numeric(A, "RRI", 3, 3, lambda n, pv, fv: F.pow(F.try_divide(fv, pv), F.try_divide(L(1), n)) - 1)
numeric(A, "ISPMT", 4, 4, lambda r, per, n, pv: -pv * r * (1 - F.try_divide(per, n)))
numeric(A, "DOLLARDE", 2, 2, lambda d, f: F.signum(d) * (F.floor(F.abs(d)) + F.try_divide((F.abs(d) - F.floor(F.abs(d))) * F.pow(L(10), F.ceil(F.log10(whole(f)))), whole(f))), (lambda d, f: f < 1, V.DIV0))
numeric(A, "DOLLARFR", 2, 2, lambda d, f: F.signum(d) * (F.floor(F.abs(d)) + (F.abs(d) - F.floor(F.abs(d))) * whole(f) / F.pow(L(10), F.ceil(F.log10(whole(f))))), (lambda d, f: f < 1, V.DIV0))


def _ddb(c: Column, s: Column, n: Column, p: Column, f: Column) -> Column:
    """Declining balance: each period takes a share of what is left, down to the salvage value."""
    start = F.struct(c.alias("left"), L(0).alias("taken"))

    def step(a: Column, _: Column) -> Column:
        take = F.greatest(L(0), F.least(F.try_divide(a["left"] * f, n), a["left"] - s))
        return F.struct((a["left"] - take).alias("left"), take.alias("taken"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(p.cast("int"), F.lit(1))), start, step)["taken"]


def _newton(value, start: float) -> float:  # noqa: ANN001
    """A root near start, by secant steps, then by bisection where it changes sign."""
    a, b = start, start + 0.01
    fa, fb = value(a), value(b)
    for _ in range(100):
        if abs(fb) < 1e-12 or fb == fa:
            break
        a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
        if b <= -1:
            b = (a - 1) / 2
        fb = value(b)
    if abs(fb) < 1e-6:
        return b
    grid = [-0.999 + 0.01 * i for i in range(1200)]
    for low, high in zip(grid[:-1], grid[1:], strict=True):
        if value(low) * value(high) <= 0:
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (low, mid) if value(low) * value(mid) <= 0 else (mid, high)
            return mid
    raise ValueError("no rate found")


def _rate(n: float, p: float, pv: float, fv: float, k: float, guess: float) -> float:
    def value(r: float) -> float:
        if abs(r) < 1e-12:
            return pv + p * n + fv
        g = (1 + r) ** n
        return pv * g + p * (1 + r * k) * (g - 1) / r + fv

    return _newton(value, guess)


numeric(A, "RATE TAXA", 3, None, python_number(_rate), defaults=(0, 0, 0.1))
irr = python_array(lambda xs, guess: _newton(lambda r: sum(x / (1 + r) ** i for i, x in enumerate(xs)), guess))
xirr = python_array(lambda xs, ds, guess: _newton(lambda r: sum(x / (1 + r) ** ((d - ds[0]) / 365) for x, d in zip(xs, ds, strict=True)), guess), 2)


def _found(c: Column, *errors: Column | None) -> Val:
    return V.guard(Val(n=c, e=V.first_error(*errors)), (c.isNull(), V.NUM))


define(A, "IRR TIR", 1, 2)(lambda v, guess=None: _found(irr(V.numbers(V.to_cells(v)), V.to_num(guess)[0] if guess else L(0.1)), V.error_in(V.to_cells(v))))
define(A, "XIRR XTIR", 2, 3)(lambda v, d, guess=None: _found(xirr(V.numbers(V.to_cells(v)), V.numbers(V.to_cells(d)), V.to_num(guess)[0] if guess else L(0.1)), V.error_in(V.to_cells(v))))


@define(A, "NPV VPL", 2, MANY)
def _npv(rate: Val, *values: Val) -> Val:
    (r, e), cells = V.to_num(rate), V.flat(list(values))
    return V.guard(Val(n=total(F.transform(V.numbers(cells), lambda x, i: F.try_divide(x, F.pow(1 + r, i + 1)))), e=V.first_error(e, V.error_in(cells))), (r == -1, V.DIV0))


@define(A, "XNPV XVPL", 3)
def _xnpv(rate: Val, values: Val, dates: Val) -> Val:
    r, e = V.to_num(rate)
    xs, ds = V.numbers(V.to_cells(values)), V.numbers(V.to_cells(dates))
    return V.guard(Val(n=total(F.zip_with(xs, ds, lambda x, d: x / F.pow(1 + r, (d - F.get(ds, F.lit(0))) / 365))), e=e), (F.size(xs) != F.size(ds), V.NUM))


@define(A, "MIRR MTIR", 3)
def _mirr(values: Val, finance: Val, again: Val) -> Val:
    (f, ef), (g, eg), xs = V.to_num(finance), V.to_num(again), V.numbers(V.to_cells(values))
    n = F.size(xs)
    gain = total(F.transform(xs, lambda x, i: F.greatest(x, L(0)) * F.pow(1 + g, n - 1 - i)))
    cost = total(F.transform(xs, lambda x, i: F.least(x, L(0)) / F.pow(1 + f, i)))
    return V.guard(Val(n=F.pow(F.try_divide(gain, -cost), 1 / (n - 1)) - 1, e=V.first_error(ef, eg)), ((gain == 0) | (cost == 0), V.DIV0))


# Engineering -------------------------------------------------------------------------------------------------------

BASES = {"BIN": (2, 10), "OCT": (8, 10), "HEX": (16, 10), "DEC": (10, 0)}
PORTUGUESE = {("BIN", "DEC"): "BINADEC", ("BIN", "HEX"): "BINAHEX", ("BIN", "OCT"): "BINAOCT", ("DEC", "BIN"): "DECABIN", ("DEC", "HEX"): "DECAHEX", ("DEC", "OCT"): "DECAOCT",
              ("HEX", "BIN"): "HEXABIN", ("HEX", "DEC"): "HEXADEC", ("HEX", "OCT"): "HEXAOCT", ("OCT", "BIN"): "OCTABIN", ("OCT", "DEC"): "OCTADEC", ("OCT", "HEX"): "OCTAHEX"}


def _converter(a: str, b: str):  # noqa: ANN202
    def make(v: Val, places: Val | None = None) -> Val:
        (base_a, digits), (base_b, _) = BASES[a], BASES[b]
        if a == "DEC":
            n, e = V.to_num(v)
            n = F.floor(n).cast("long")
            bad = n.isNull()
        else:
            t, e = V.to_txt(v)
            t = F.upper(F.trim(t))
            signs = "0123456789ABCDEF"[:base_a]
            bad = ~t.rlike(f"^[{signs}]{{0,10}}$")
            n = F.coalesce(F.conv(F.when(t == "", "0").otherwise(t), base_a, 10).try_cast("long"), F.lit(0))
            full = base_a**digits
            n = F.when(n >= full // 2, n - full).otherwise(n)  # ten digits hold two's complement
        if b == "DEC":
            return V.guard(Val(n=n.cast("double"), e=e), (bad, V.NUM))
        full = base_b**10
        wrapped = F.when(n < 0, n + full).otherwise(n)
        out = F.conv(wrapped.cast("string"), 10, base_b)
        if places is not None:
            p, ep = V.to_num(places)
            out, e = F.when(n < 0, out).otherwise(F.lpad(out, F.greatest(p.cast("int"), F.length(out)), F.lit("0"))), V.first_error(e, ep)
        return V.guard(Val(t=out, e=e), (bad | (n < -full // 2) | (n >= full // 2), V.NUM))

    return make


for a in BASES:
    for b in BASES:
        if a != b:
            define(A, f"{a}2{b} {PORTUGUESE[a, b]}", 1, 2 if b != "DEC" else 1)(_converter(a, b))


@define(A, "BASE", 2, 3)
def _base(n: Val, radix: Val, length: Val | None = None) -> Val:
    (x, ex), (r, er) = V.to_num(n), V.to_num(radix)
    digits = F.transform(F.sequence(F.lit(51), F.lit(0), F.lit(-1)), lambda i: F.floor(x / F.pow(r, i)) - r * F.floor(x / F.pow(r, i + 1)))
    text = F.regexp_replace(F.array_join(F.transform(digits, lambda d: F.substring(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), d.cast("int") + 1, F.lit(1))), ""), "^0+(?=.)", "")
    if length is not None:
        text = F.lpad(text, F.greatest(V.to_num(length)[0].cast("int"), F.length(text)), F.lit("0"))
    return V.guard(Val(t=text, e=V.first_error(ex, er)), (~r.between(2, 36) | (x < 0), V.NUM))


@define(A, "DECIMAL", 2)
def _decimal(text: Val, radix: Val) -> Val:
    (t, et), (r, er) = V.to_txt(text), V.to_num(radix)
    t = F.upper(F.trim(t))
    values = F.transform(F.regexp_extract_all(t, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    bad = ~t.rlike("^[0-9A-Z]+$")
    return V.guard(Val(n=F.aggregate(values, L(0), lambda s, d: s * r + d), e=V.first_error(et, er)), (bad | F.exists(values, lambda d: d >= r), V.NUM))


bits = lambda x: F.floor(x).cast("long")
for names, f in (
    ("BITAND", lambda a, b: bits(a).bitwiseAND(bits(b))), ("BITOR", lambda a, b: bits(a).bitwiseOR(bits(b))), ("BITXOR", lambda a, b: bits(a).bitwiseXOR(bits(b))),
    ("BITLSHIFT", lambda a, s: F.floor(bits(a) * F.pow(L(2), bits(s)))), ("BITRSHIFT", lambda a, s: F.floor(bits(a) / F.pow(L(2), bits(s)))),
):
    numeric(A, names, 2, 2, f, (lambda a, b: a < 0, V.NUM))
numeric(A, "ERF ERF.PRECISE FUNERRO", 1, 2, lambda *x: (lambda e: e(x[0]) if len(x) == 1 else e(x[1]) - e(x[0]))(python_number(math.erf)))
numeric(A, "ERFC ERFC.PRECISE FUNERROCOMPL", 1, 1, python_number(math.erfc))

# Units by dimension, each in terms of the first.
UNITS = {
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lbm": 453.59237, "ozm": 28.349523125, "ton": 907184.74, "sg": 14593.9029372064},
    "length": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "nm": 1e-9, "mi": 1609.344, "Nmi": 1852.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10},
    "time": {"sec": 1.0, "s": 1.0, "mn": 60.0, "min": 60.0, "hr": 3600.0, "day": 86400.0, "d": 86400.0, "yr": 31557600.0},
    "pressure": {"Pa": 1.0, "p": 1.0, "kPa": 1000.0, "atm": 101325.0, "at": 101325.0, "mmHg": 133.322, "psi": 6894.757293168},
    "force": {"N": 1.0, "dyn": 1e-5, "lbf": 4.4482216152605},
    "energy": {"J": 1.0, "kJ": 1000.0, "e": 1e-7, "erg": 1e-7, "c": 4.184, "cal": 4.1868, "kcal": 4186.8, "eV": 1.602176487e-19, "ev": 1.602176487e-19, "Wh": 3600.0, "kWh": 3.6e6, "BTU": 1055.05585262, "btu": 1055.05585262, "HPh": 2684519.5376962},
    "power": {"W": 1.0, "kW": 1000.0, "MW": 1e6, "HP": 745.69987158227, "PS": 735.49875},
    "volume": {"l": 1.0, "L": 1.0, "lt": 1.0, "ml": 0.001, "m3": 1000.0, "gal": 3.785411784, "qt": 0.946352946, "pt": 0.473176473, "cup": 0.2365882365, "tsp": 0.00492892159375, "tbs": 0.01478676478125, "oz": 0.0295735295625},
    "area": {"m2": 1.0, "km2": 1e6, "ha": 10000.0, "ft2": 0.09290304, "in2": 0.00064516, "mi2": 2589988.110336, "acre": 4046.8564224},
    "speed": {"m/s": 1.0, "m/h": 1 / 3600, "km/h": 1 / 3.6, "mph": 0.44704, "kn": 1852 / 3600},
    "information": {"bit": 1.0, "byte": 8.0, "kbit": 1e3, "Mbit": 1e6, "Gbit": 1e9},
}


@define(A, "CONVERT CONVERTER", 3)
def _convert(n: Val, a: Val, b: Val) -> Val:
    (x, ex), (a, ea), (b, eb) = V.to_num(n), V.to_txt(a), V.to_txt(b)
    factor = F.create_map(*(F.lit(y) for units in UNITS.values() for u, f in units.items() for y in (u, f)))
    kind = F.create_map(*(F.lit(y) for k, units in UNITS.items() for u in units for y in (u, k)))
    kelvin = F.when(a.isin("C", "cel"), x + 273.15).when(a.isin("F", "fah"), (x + 459.67) * 5 / 9).when(a.isin("K", "kel"), x)
    warm = F.when(b.isin("C", "cel"), kelvin - 273.15).when(b.isin("F", "fah"), kelvin * 9 / 5 - 459.67).when(b.isin("K", "kel"), kelvin)
    same = F.coalesce(F.try_element_at(kind, a) == F.try_element_at(kind, b), F.lit(False))
    out = F.coalesce(F.when(same, x * F.try_element_at(factor, a) / F.try_element_at(factor, b)), warm)
    return V.guard(Val(n=out, e=V.first_error(ex, ea, eb)), (out.isNull(), V.NA))


# Complex numbers are text, such as 3+4i.


def _read(text: str) -> complex:
    t = str(text).strip().replace("i", "j")
    if t in ("j", "+j", "-j") or t.endswith(("+j", "-j")):
        t = t[:-1] + "1j"
    return complex(t.replace(" ", "") or "0")


def _show(z: complex) -> str:
    part = lambda x: f"{x:.15g}"
    re_, im = float(part(z.real)), float(part(z.imag))
    if im == 0:
        return part(re_)
    tail = ("" if im == 1 else "-" if im == -1 else part(im)) + "i"
    return tail if re_ == 0 else part(re_) + ("+" if im > 0 else "") + tail


def complex_udf(f, out: str):  # noqa: ANN001, ANN202
    from pyspark.sql.functions import pandas_udf

    def each(*columns: pd.Series) -> pd.Series:
        found = []
        for row in zip(*columns, strict=True):
            try:
                z = f(*map(_read, row))
                found.append(_show(z) if out == "string" else float(z))
            except (ValueError, ZeroDivisionError, OverflowError, TypeError):
                found.append(None)
        return pd.Series(found)

    return pandas_udf(each, StringType() if out == "string" else DoubleType())


def imaginary(names: str, least: int, most: int, f, out: str = "string") -> None:  # noqa: ANN001
    def make(*args: Val) -> Val:
        udf = complex_udf(f, out)
        read = [V.to_txt(a) for a in args]
        c = udf(*(t for t, _ in read))
        return V.guard(Val(**{"t" if out == "string" else "n": c}, e=V.first_error(*(e for _, e in read))), (c.isNull(), V.NUM))

    define(A, names, least, most)(make)


for name, f in (
    ("IMCONJUGATE", complex.conjugate), ("IMCOS", cmath.cos), ("IMCOSH", cmath.cosh), ("IMCOT", lambda z: 1 / cmath.tan(z)), ("IMCSC", lambda z: 1 / cmath.sin(z)),
    ("IMCSCH", lambda z: 1 / cmath.sinh(z)), ("IMEXP", cmath.exp), ("IMLN", cmath.log), ("IMLOG10", cmath.log10), ("IMLOG2", lambda z: cmath.log(z) / math.log(2)),
    ("IMSEC", lambda z: 1 / cmath.cos(z)), ("IMSECH", lambda z: 1 / cmath.cosh(z)), ("IMSIN", cmath.sin), ("IMSINH", cmath.sinh), ("IMSQRT", cmath.sqrt), ("IMTAN", cmath.tan),
):
    imaginary(name, 1, 1, f)
for name, f in (("IMABS", abs), ("IMAGINARY", lambda z: z.imag), ("IMREAL", lambda z: z.real), ("IMARGUMENT", cmath.phase)):
    imaginary(name, 1, 1, f, "double")
imaginary("IMDIV", 2, 2, lambda a, b: a / b)
imaginary("IMSUB", 2, 2, lambda a, b: a - b)
imaginary("IMPOWER", 2, 2, lambda a, b: a**b)
imaginary("IMSUM", 1, MANY, lambda *z: sum(z))
imaginary("IMPRODUCT", 1, MANY, lambda *z: math.prod(z))


@define(A, "COMPLEX COMPLEXO", 2, 3)
def _complex(a: Val, b: Val, sign: Val | None = None) -> Val:
    (x, ex), (y, ey) = V.to_num(a), V.to_num(b)
    s = V.to_txt(sign)[0] if sign is not None else F.lit("i")
    tail = F.concat(F.when(y == 1, "").when(y == -1, "-").otherwise(V.shown(y)), s)
    out = F.when(y == 0, V.shown(x)).when(x == 0, tail).otherwise(F.concat(V.shown(x), F.when(y > 0, "+").otherwise(""), tail))
    return V.guard(Val(t=out, e=V.first_error(ex, ey)), (~s.isin("i", "j"), V.VALUE))
