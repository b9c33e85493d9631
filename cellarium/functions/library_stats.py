"""Aggregation, conditional aggregation, statistics, ranking and distributions, over ranges as arrays."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions import criteria
from cellarium.functions import values as V
from cellarium.functions.library_math import L, choose, paired, total, whole
from cellarium.functions.registry import MANY, define, numeric, python_number, sampled
from cellarium.functions.values import Val

G, R = "AGGREGATION", "RANKING"
none = lambda xs: F.size(xs) == 0


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def moment(xs: Column, k: int) -> Column:
    """Sum of k-th powers of the distances from the mean."""
    m = mean(xs)
    return total(F.transform(xs, lambda x: F.pow(x - m, k)))


def spread(xs: Column, less: int) -> Column:
    return F.coalesce(F.try_divide(moment(xs, 2), F.size(xs) - less), L(0))


def least(xs: Column) -> Column:
    return F.coalesce(F.array_min(xs), L(0))


def most(xs: Column) -> Column:
    return F.coalesce(F.array_max(xs), L(0))


def at_rank(xs: Column, place: Column) -> Column:
    """The value at a place (from 0, between two: in proportion) of the sorted numbers."""
    s = F.array_sort(xs)
    low = F.floor(place).cast("int")
    a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
    return a + (b - a) * (place - low)


def percentile(xs: Column, k: Column) -> Column:
    return F.coalesce(at_rank(xs, (F.size(xs) - 1) * k), L(0))


def with_truths(cells: Column) -> Column:
    """Numbers, truth values as 1 and 0, text as 0."""
    some = F.filter(cells, lambda c: c["n"].isNotNull() | c["b"].isNotNull() | c["t"].isNotNull())
    return F.transform(some, lambda c: F.coalesce(c["n"], c["b"].cast("int").cast("double"), L(0)))


sampled(G, "SUM SOMA", total)
sampled(G, "AVERAGE MÉDIA", lambda xs: F.coalesce(mean(xs), L(0)))
sampled(G, "AVERAGEA MÉDIAA", lambda xs: F.coalesce(mean(xs), L(0)), flat=with_truths)
sampled(G, "MIN MÍNIMO", least)
sampled(G, "MAX MÁXIMO", most)
sampled(G, "MINA", least, flat=with_truths)
sampled(G, "MAXA", most, flat=with_truths)
sampled(G, "MEDIAN MED", lambda xs: percentile(xs, L(0.5)))
sampled(G, "STDEV STDEV.S STDEVA DESVPAD DESVPAD.A", lambda xs: F.sqrt(spread(xs, 1)))
sampled(G, "STDEV.P STDEVP STDEVPA DESVPAD.P DESVPADP", lambda xs: F.sqrt(spread(xs, 0)))
sampled(G, "VAR VAR.S VARA VAR.A", lambda xs: spread(xs, 1))
sampled(G, "VAR.P VARP VARPA", lambda xs: spread(xs, 0))
sampled(G, "AVEDEV DESV.MÉDIO", lambda xs: mean(F.transform(xs, lambda x: F.abs(x - mean(xs)))), (none, V.NUM))
sampled(G, "DEVSQ DESVQ", lambda xs: moment(xs, 2))
sampled(G, "GEOMEAN MÉDIA.GEOMÉTRICA", lambda xs: F.exp(mean(F.transform(xs, F.ln))), (lambda xs: F.exists(xs, lambda x: x <= 0) | none(xs), V.NUM))
sampled(G, "HARMEAN MÉDIA.HARMÔNICA", lambda xs: F.try_divide(F.size(xs), total(F.transform(xs, lambda x: F.try_divide(L(1), x)))), (lambda xs: F.exists(xs, lambda x: x <= 0) | none(xs), V.NUM))


def skewness(xs: Column) -> Column:
    return F.try_divide(moment(xs, 3) / F.size(xs), F.pow(moment(xs, 2) / F.size(xs), 1.5))


def kurtosis(xs: Column) -> Column:
    return F.try_divide(moment(xs, 4) / F.size(xs), F.pow(moment(xs, 2) / F.size(xs), 2)) - 3


sampled(G, "SKEW DISTORÇÃO", lambda xs: skewness(xs) * F.try_divide(F.sqrt(F.size(xs) * (F.size(xs) - 1)), F.size(xs) - 2), (lambda xs: F.size(xs) < 3, V.DIV0))
sampled(G, "SKEW.P", skewness, (lambda xs: F.size(xs) < 3, V.DIV0))
sampled(G, "KURT CURT", lambda xs: F.try_divide(F.size(xs) - 1, (F.size(xs) - 2) * (F.size(xs) - 3)) * ((F.size(xs) + 1) * kurtosis(xs) + 6), (lambda xs: F.size(xs) < 4, V.DIV0))


def _mode(xs: Column) -> Column:
    """The most frequent number; of several the one that comes first."""
    seen = F.transform(F.array_distinct(xs), lambda x: F.struct(F.size(F.filter(xs, lambda y: y == x)).alias("n"), (-F.array_position(xs, x)).alias("place"), x.alias("x")))
    return F.array_max(seen)["x"]


sampled(G, "MODE MODE.SNGL MODE.MULT MODO", _mode, (none, V.NUM))


def counted(names: str, test) -> None:  # noqa: ANN001
    define(G, names, 1, MANY)(lambda *args: V.num(F.size(F.filter(V.flat(list(args)), test))))


counted("COUNT CONT.NÚM", lambda c: c["n"].isNotNull())
counted("COUNTA CONT.VALORES", lambda c: c["n"].isNotNull() | c["b"].isNotNull() | c["e"].isNotNull() | F.coalesce(c["t"] != "", F.lit(False)))
counted("COUNTBLANK CONTAR.VAZIO", lambda c: c["n"].isNull() & c["b"].isNull() & c["e"].isNull() & F.coalesce(c["t"] == "", F.lit(True)))


# Criteria ----------------------------------------------------------------------------------------------------------


def _meets(cells: Column, criterion: Val) -> Column:
    """For each cell whether it meets the criterion, a value of any kind."""
    text, _ = V.to_txt(criterion)
    return F.transform(cells, lambda c: criteria.meets_column(c["n"], c["t"], text))


def _all_meet(args: tuple[Val, ...]) -> Column:
    out = None
    for cells, criterion in zip(args[::2], args[1::2], strict=True):
        one = _meets(V.to_cells(cells), criterion)
        out = one if out is None else F.zip_with(out, one, lambda x, y: x & y)
    return out


def chosen(cells: Column, use: Column) -> Column:
    both = F.zip_with(cells, use, lambda c, u: F.struct(c["n"].alias("n"), u.alias("u")))
    return F.transform(F.filter(both, lambda p: F.coalesce(p["u"], F.lit(False)) & p["n"].isNotNull()), lambda p: p["n"])


def conditional(names: str, f, many: str) -> None:  # noqa: ANN001
    """One criterion with an optional range of values, and many criteria after the values."""
    if names:
        define(G, names, 2, 3)(lambda cells, criterion, values=None: V.num(f(chosen(V.to_cells(values or cells), _meets(V.to_cells(cells), criterion)))))
    define(G, many, 3, MANY)(lambda values, *rest: V.num(f(chosen(V.to_cells(values), _all_meet(rest)))))


conditional("SUMIF SOMASE", total, "SUMIFS SOMASES")
conditional("AVERAGEIF MÉDIASE", lambda xs: F.coalesce(mean(xs), L(0)), "AVERAGEIFS MÉDIASES")
conditional("", most, "MAXIFS MÁXIMOSES")
conditional("", least, "MINIFS MÍNIMOSES")
define(G, "COUNTIF CONT.SE", 2)(lambda cells, criterion: V.num(F.size(F.filter(_meets(V.to_cells(cells), criterion), lambda x: x))))
define(G, "COUNTIFS CONT.SES", 2, MANY)(lambda *args: V.num(F.size(F.filter(_all_meet(args), lambda x: F.coalesce(x, F.lit(False))))))

#: SUBTOTAL and AGGREGATE codes; hidden rows are not known, so 101 to 111 are 1 to 11.
CODES = ("AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV.S", "STDEV.P", "SUM", "VAR.S", "VAR.P")


def _dispatch(code: Val, cells: tuple[Val, ...]) -> Val:
    from cellarium.functions.registry import FUNCTIONS

    n, e = V.to_num(code)
    out = V.literal(0.0)
    for i, name in enumerate(CODES, 1):
        out = V.either((n % 100) == i, FUNCTIONS[name].make(*cells), out)
    return Val(out.n, out.t, out.b, V.first_error(e, out.e))


define(G, "SUBTOTAL", 2, MANY)(lambda code, *cells: _dispatch(code, cells))
define(G, "AGGREGATE AGREGAR", 3, MANY)(lambda code, _, *cells: _dispatch(code, cells))

# Ranking -----------------------------------------------------------------------------------------------------------


def ranked(kind: str, names: str, least_: int, most_: int, f, *tests) -> None:  # noqa: ANN001
    """A function of a range and numbers: f(numbers of the range, number, ...)."""

    def make(cells: Val, *args: Val) -> Val:
        xs, read = V.numbers(V.to_cells(cells)), [V.to_num(a) for a in args]
        ks = [k for k, _ in read]
        v = Val(n=f(xs, *ks).cast("double"), e=V.first_error(V.error_in(V.to_cells(cells)), *(e for _, e in read)))
        return V.guard(v, *((t(xs, *ks), code) for t, code in tests))

    define(kind, names, least_, most_)(make)


outside = lambda xs, k: (k < 1) | (k > F.size(xs))
ranked(R, "LARGE MAIOR", 2, 2, lambda xs, k: F.get(F.array_sort(xs), (F.size(xs) - F.ceil(k)).cast("int")), (outside, V.NUM))
ranked(R, "SMALL MENOR", 2, 2, lambda xs, k: F.get(F.array_sort(xs), (F.floor(k) - 1).cast("int")), (outside, V.NUM))
share = lambda xs, k: (k < 0) | (k > 1)
ranked(R, "PERCENTILE PERCENTILE.INC PERCENTIL", 2, 2, percentile, (share, V.NUM))
ranked(R, "QUARTILE QUARTILE.INC QUARTIL", 2, 2, lambda xs, q: percentile(xs, whole(q) / 4), (lambda xs, q: (q < 0) | (q > 4), V.NUM))
exclusive = lambda xs, k: (k * (F.size(xs) + 1) < 1) | (k * (F.size(xs) + 1) > F.size(xs))
ranked(R, "PERCENTILE.EXC", 2, 2, lambda xs, k: at_rank(xs, k * (F.size(xs) + 1) - 1), (exclusive, V.NUM))
ranked(R, "QUARTILE.EXC", 2, 2, lambda xs, q: at_rank(xs, whole(q) / 4 * (F.size(xs) + 1) - 1), (lambda xs, q: exclusive(xs, whole(q) / 4), V.NUM))
below = lambda xs, x: F.size(F.filter(xs, lambda y: y < x))


def _percent_rank(xs: Column, x: Column, extra: int) -> Column:
    """The share of places below x, between two values in proportion."""
    under, low, high = below(xs, x), F.array_max(F.filter(xs, lambda y: y <= x)), F.array_min(F.filter(xs, lambda y: y >= x))
    base = below(xs, low)
    return F.try_divide(F.when(low == x, under).otherwise(base + (under - base) * F.try_divide(x - low, high - low)) + (1 if extra > 0 else 0), F.size(xs) + extra)


def _cut(x: Column, digits: Column) -> Column:
    return F.floor(x * F.pow(L(10), digits) + 1e-9) / F.pow(L(10), digits)


for names, extra in (("PERCENTRANK PERCENTRANK.INC", -1), ("PERCENTRANK.EXC", 1)):
    ranked(R, names, 2, 3, lambda xs, x, d=None, extra=extra: _cut(_percent_rank(xs, x, extra), d if d is not None else L(3)), (lambda xs, x, d=None: none(xs) | (x < F.array_min(xs)) | (x > F.array_max(xs)), V.NA))
ranked(G, "TRIMMEAN MÉDIA.INTERNA", 2, 2, lambda xs, p: mean(F.slice(F.array_sort(xs), F.floor(F.size(xs) * p / 2).cast("int") + 1, F.greatest(F.size(xs) - 2 * F.floor(F.size(xs) * p / 2).cast("int"), F.lit(0)))))


def _rank(average: bool):  # noqa: ANN202
    def make(x: Val, cells: Val, order: Val | None = None) -> Val:
        (x, e), xs = V.to_num(x), V.numbers(V.to_cells(cells))
        up = V.to_num(order)[0] != 0 if order is not None else F.lit(False)
        before = F.when(up, below(xs, x)).otherwise(F.size(F.filter(xs, lambda y: y > x)))
        ties = F.size(F.filter(xs, lambda y: y == x))
        return V.guard(Val(n=(before + 1 + ((ties - 1) / 2 if average else 0)).cast("double"), e=e), (ties == 0, V.NA))

    return make


define(R, "RANK RANK.EQ ORDEM ORDEM.EQ", 2, 3)(_rank(False))
define(R, "RANK.AVG ORDEM.MÉD", 2, 3)(_rank(True))

# Pairs -------------------------------------------------------------------------------------------------------------


def _xy(p: Column) -> tuple[Column, Column, Column, Column]:
    """Pairs, and sums of squares and products about the means."""
    n = F.size(p)
    mx, my = F.try_divide(total(F.transform(p, lambda q: q["x"])), n), F.try_divide(total(F.transform(p, lambda q: q["y"])), n)
    over = lambda f: total(F.transform(p, lambda q: f(q["x"] - mx, q["y"] - my)))
    return n, over(lambda a, b: a * a), over(lambda a, b: b * b), over(lambda a, b: a * b)


def _means(p: Column) -> tuple[Column, Column]:
    n = F.size(p)
    return F.try_divide(total(F.transform(p, lambda q: q["x"])), n), F.try_divide(total(F.transform(p, lambda q: q["y"])), n)


def _slope(p: Column) -> Column:  # x is the first range: the known y values
    _, _, syy, sxy = _xy(p)
    return F.try_divide(sxy, syy)


def _intercept(p: Column) -> Column:
    my, mx = _means(p)
    return my - _slope(p) * mx


def _corr(p: Column) -> Column:
    _, a, b, ab = _xy(p)
    return F.try_divide(ab, F.sqrt(a * b))


paired(G, "CORREL PEARSON", _corr, True)
paired(G, "COVAR COVARIANCE.P COVARIAÇÃO.P", lambda p: F.try_divide(_xy(p)[3], _xy(p)[0]), True)
paired(G, "COVARIANCE.S COVARIAÇÃO.S", lambda p: F.try_divide(_xy(p)[3], _xy(p)[0] - 1), True)
paired(G, "SLOPE INCLINAÇÃO", _slope, True)
paired(G, "INTERCEPT INTERCEPTAÇÃO", _intercept, True)
paired(G, "RSQ RQUAD", lambda p: F.pow(_corr(p), 2), True)
paired(G, "STEYX EPADYX", lambda p: F.sqrt(F.try_divide(_xy(p)[1] - F.try_divide(_xy(p)[3] * _xy(p)[3], _xy(p)[2]), _xy(p)[0] - 2)), True)


@define(G, "FORECAST FORECAST.LINEAR PREVISÃO", 3)
def _forecast(x: Val, ys: Val, xs: Val) -> Val:
    from cellarium.functions.library_math import pairs

    (x, e), p = V.to_num(x), pairs(ys, xs)
    out = _intercept(p) + _slope(p) * x
    return V.guard(Val(n=out, e=e), (out.isNull(), V.DIV0))


# Distributions: densities are expressions; distribution functions need erf, gamma or beta, so Arrow batches -------

NORMAL = NormalDist()
cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for i in range(2, 400):
        m = i // 2
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        value *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * value


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + x * x), df / 2, 0.5)
    return 1 - tail if x > 0 else tail


def inverse(f, p: float, low: float, high: float) -> float:  # noqa: ANN001
    for _ in range(200):
        mid = (low + high) / 2
        ends = (mid, high) if f(mid) < p else (low, mid)
        if ends == (low, high):  # no number lies between them
            break
        low, high = ends
    return mid


inside = lambda p, *_: (p <= 0) | (p >= 1)
density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
normal_cdf, normal_inv = python_number(cdf), python_number(NORMAL.inv_cdf)
numeric(G, "NORM.DIST NORMDIST DIST.NORM", 3, None, lambda x, m, s, c: F.when(c != 0, normal_cdf(F.try_divide(x - m, s))).otherwise(density(F.try_divide(x - m, s)) / s), (lambda x, m, s, c: s <= 0, V.NUM), defaults=(1,))
numeric(G, "NORM.S.DIST NORMSDIST DIST.NORMP", 1, None, lambda z, c: F.when(c != 0, normal_cdf(z)).otherwise(density(z)), defaults=(1,))
numeric(G, "NORM.INV NORMINV INV.NORM", 1, None, lambda p, m, s: m + s * normal_inv(p), (inside, V.NUM), defaults=(0, 1))
numeric(G, "NORM.S.INV NORMSINV INV.NORMP", 1, 1, normal_inv, (inside, V.NUM))
numeric(G, "GAUSS", 1, 1, lambda z: normal_cdf(z) - 0.5)
numeric(G, "PHI", 1, 1, density)
numeric(G, "CONFIDENCE CONFIDENCE.NORM INT.CONFIANÇA", 3, 3, lambda a, s, n: -normal_inv(a / 2) * s / F.sqrt(n), (inside, V.NUM))
student = python_number(t_cdf)
student_inv = python_number(lambda p, df: inverse(lambda x: t_cdf(x, df), p, -1e6, 1e6))
numeric(G, "CONFIDENCE.T", 3, 3, lambda a, s, n: student_inv(1 - a / 2, n - 1) * s / F.sqrt(n), (inside, V.NUM))
numeric(G, "T.DIST", 2, None, lambda x, df, c: student(x, df), (lambda x, df, c: df < 1, V.NUM), defaults=(1,))
numeric(G, "TDIST", 3, 3, lambda x, df, k: k * (1 - student(x, df)), (lambda x, df, k: (x < 0) | (df < 1), V.NUM))
numeric(G, "T.DIST.2T", 2, 2, lambda x, df: 2 * (1 - student(F.abs(x), df)), (lambda x, df: df < 1, V.NUM))
numeric(G, "T.DIST.RT", 2, 2, lambda x, df: 1 - student(x, df), (lambda x, df: df < 1, V.NUM))
numeric(G, "T.INV", 2, 2, student_inv, (inside, V.NUM))
numeric(G, "T.INV.2T TINV", 2, 2, lambda p, df: student_inv(1 - p / 2, df), (lambda p, df: (p <= 0) | (p > 1), V.NUM))
_binomial = lambda k, n, p: choose(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)
numeric(G, "BINOM.DIST BINOMDIST DISTR.BINOM", 3, None, lambda k, n, p, c: F.when(c != 0, total(F.transform(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), lambda i: _binomial(i.cast("double"), whole(n), p)))).otherwise(_binomial(whole(k), whole(n), p)), (lambda k, n, p, c: (k < 0) | (k > n) | (p < 0) | (p > 1), V.NUM), defaults=(0,))
numeric(G, "BINOM.INV CRITBINOM CRIT.BINOM", 3, 3, python_number(lambda n, p, a: next(k for k in range(int(n) + 1) if sum(math.comb(int(n), i) * p**i * (1 - p) ** (int(n) - i) for i in range(k + 1)) >= a)))
numeric(G, "POISSON.DIST POISSON DISTR.POISSON", 2, None, lambda k, m, c: python_number(lambda k, m, c: sum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in (range(int(k) + 1) if c else (int(k),))))(k, m, c), (lambda k, m, c: (k < 0) | (m <= 0), V.NUM), defaults=(0,))
numeric(G, "GAMMA", 1, 1, python_number(math.gamma))
numeric(G, "GAMMALN GAMMALN.PRECISE", 1, 1, python_number(math.lgamma), (lambda x: x <= 0, V.NUM))
numeric(G, "STANDARDIZE PADRONIZAR", 3, 3, lambda x, m, s: F.try_divide(x - m, s), (lambda x, m, s: s <= 0, V.NUM))
