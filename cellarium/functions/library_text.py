"""Text, type and date functions. Dates are day numbers from 1899-12-30, with the time of day as a fraction."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions import values as V

from cellarium.functions.library_math import L
from cellarium.functions.registry import MANY, define, numeric, textual
from cellarium.functions.values import Val

X, D = "TEXT_TRANSFORMATION", "DATE_LOGIC"
EPOCH = dt.date(1899, 12, 30)


def chars(n: Column) -> Column:
    return F.greatest(F.floor(n), F.lit(0)).cast("int")


def mixed(names: str, least: int, most: int, f, out: str = "t", kinds: str = "t", kind: str = X, *tests) -> None:  # noqa: ANN001
    """A function of texts and numbers, as `kinds` says (the last kind repeats)."""

    def make(*args: Val) -> Val:
        read = [(V.to_txt if kinds[min(i, len(kinds) - 1)] == "t" else V.to_num)(a) for i, a in enumerate(args)]
        xs = [c for c, _ in read]
        v = Val(**{out: f(*xs)}, e=V.first_error(*(e for _, e in read)))
        return V.guard(v, *((t(*xs), code) for t, code in tests))

    define(kind, names, least, most)(make)


textual(X, "LEN LENB NÚM.CARACT", 1, 1, lambda s: F.length(s).cast("double"), "n")
mixed("LEFT LEFTB ESQUERDA", 1, 2, lambda s, n=None: F.substring(s, F.lit(1), chars(n) if n is not None else F.lit(1)), "t", "tn")
mixed("RIGHT RIGHTB DIREITA", 1, 2, lambda s, n=None: F.right(s, chars(n) if n is not None else F.lit(1)), "t", "tn")
mixed("MID MIDB EXT.TEXTO", 3, 3, lambda s, a, n: F.substring(s, F.greatest(F.floor(a), F.lit(1)).cast("int"), chars(n)), "t", "tnn", X, (lambda s, a, n: a < 1, V.VALUE))
textual(X, "UPPER MAIÚSCULA", 1, 1, F.upper)
textual(X, "LOWER MINÚSCULA", 1, 1, F.lower)
# A word is a run of letters: each run of others stands before the run that it separates.
textual(X, "PROPER PRI.MAIÚSCULA", 1, 1, lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"[^\p{L}]+|\p{L}+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""))
textual(X, "TRIM ARRUMAR", 1, 1, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), " +", " "))
textual(X, "CLEAN TIRAR", 1, 1, lambda s: F.regexp_replace(s, r"[\x00-\x1f]", ""))
textual(X, "EXACT EXATO", 2, 2, lambda a, b: a == b, "b")
textual(X, "CODE UNICODE CÓDIGO", 1, 1, lambda s: F.ascii(s).cast("double"), "n", (lambda s: s == "", V.VALUE))
textual(X, "ENCODEURL CODIFURL", 1, 1, lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
mixed("REPT", 2, 2, lambda s, n: F.repeat(s, chars(n)), "t", "tn", X, (lambda s, n: n < 0, V.VALUE))
mixed("CHAR UNICHAR CARACT", 1, 1, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32"), "t", "n", X, (lambda n: (n < 1) | (n > 1114111), V.VALUE))
mixed("FIND FINDB PROCURAR", 2, 3, lambda w, s, a=None: _place(F.locate, w, s, a), "n", "ttn", X, (lambda w, s, a=None: _place(F.locate, w, s, a) == 0, V.VALUE))


def _place(_: object, w: Column, s: Column, a: Column | None) -> Column:
    start = F.floor(a).cast("int") if a is not None else F.lit(1)
    rest = F.substring(s, start, F.length(s))
    at = F.instr(rest, w)
    return F.when(at > 0, at + start - 1).otherwise(0).cast("double")


def _search(w: Column, s: Column, a: Column | None = None) -> Column:
    """The first place of a pattern with * and ?, in any case."""
    start = F.floor(a).cast("int") if a is not None else F.lit(1)
    rest = F.substring(s, start, F.length(s))
    quoted = F.regexp_replace(w, r"([\\\[\](){}.+^$|])", r"\\$1")
    regex = F.concat(F.lit("(?is)"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*?")), F.lit("?"), F.lit(".")))
    at = F.regexp_instr(rest, regex)
    return F.when(at > 0, at + start - 1).otherwise(0).cast("double")


mixed("SEARCH SEARCHB PESQUISAR LOCALIZAR", 2, 3, _search, "n", "ttn", X, (lambda *x: _search(*x) == 0, V.VALUE))


def _substitute(s: Column, old: Column, new: Column, nth: Column | None = None) -> Column:
    every = F.when(old == "", s).otherwise(F.replace(s, old, new))
    if nth is None:
        return every
    n = F.floor(nth).cast("int")
    head = F.call_function("substring_index", s, old, n)
    tail = F.substring(s, F.length(head) + F.length(old) + 1, F.length(s))
    return F.when((old == "") | (F.length(head) == F.length(s)), s).otherwise(F.concat(head, new, tail))


mixed("SUBSTITUTE SUBSTITUIR", 3, 4, _substitute, "t", "tttn")
mixed("REPLACE REPLACEB MUDAR", 4, 4, lambda s, a, n, new: F.concat(F.substring(s, F.lit(1), F.greatest(F.floor(a) - 1, F.lit(0)).cast("int")), new, F.substring(s, (F.floor(a) + F.floor(n)).cast("int"), F.length(s))), "t", "tnnt", X, (lambda s, a, n, new: (a < 1) | (n < 0), V.VALUE))


def _shown_cells(args: list[Val]) -> Column:
    cells = V.flat(args)
    return F.transform(cells, lambda c: V.to_txt(V.cell(c))[0])


define(X, "CONCATENATE CONCAT CONCATENAR", 1, MANY)(lambda *a: V.guard(Val(t=F.array_join(_shown_cells(list(a)), ""), e=V.error_in(V.flat(list(a))))))


@define(X, "TEXTJOIN UNIRTEXTO", 3, MANY)
def _textjoin(sign: Val, skip: Val, *args: Val) -> Val:
    (s, e), (b, eb), cells = V.to_txt(sign), V.to_bool(skip), V.flat(list(args))
    texts = _shown_cells(list(args))
    kept = F.when(b, F.filter(texts, lambda t: t != "")).otherwise(texts)
    joined = F.aggregate(kept, F.lit(None).cast("string"), lambda a, t: F.when(a.isNull(), t).otherwise(F.concat(a, s, t)))
    return V.guard(Val(t=F.coalesce(joined, F.lit("")), e=V.first_error(e, eb, V.error_in(cells))))


def _after(s: Column, sign: Column, n: Column | None = None) -> Column:
    k = F.floor(n).cast("int") if n is not None else F.lit(1)
    head = F.call_function("substring_index", s, sign, k)
    back = F.call_function("substring_index", s, sign, k)
    return F.when(F.length(head) == F.length(s), F.lit(None)).when(k > 0, F.substring(s, F.length(head) + F.length(sign) + 1, F.length(s))).otherwise(back)


def _before(s: Column, sign: Column, n: Column | None = None) -> Column:
    k = F.floor(n).cast("int") if n is not None else F.lit(1)
    head = F.call_function("substring_index", s, sign, k)
    return F.when(F.length(head) == F.length(s), F.lit(None)).when(k > 0, head).otherwise(F.substring(s, F.lit(1), F.length(s) - F.length(head) - F.length(sign)))


mixed("TEXTAFTER", 2, 3, _after, "t", "ttn", X, (lambda *x: _after(*x).isNull(), V.NA))
mixed("TEXTBEFORE", 2, 3, _before, "t", "ttn", X, (lambda *x: _before(*x).isNull(), V.NA))
define(X, "T", 1)(lambda v: Val(t=F.coalesce(V.scalar(v).t, F.lit("")) if V.scalar(v).t is not None else F.lit(""), e=V.scalar(v).e))


@define(X, "N", 1)
def _n(v: Val) -> Val:
    v = V.scalar(v)
    return Val(n=F.coalesce(*[c for c in (v.n, None if v.b is None else v.b.cast("int").cast("double")) if c is not None], L(0)), e=v.e)


mixed("VALUE NUMBERVALUE VALOR NUMÉRICO", 1, 1, lambda s: F.replace(F.replace(s, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("double"), "n", "t", X, (lambda s: F.replace(F.replace(s, F.lit(","), F.lit(".")), F.lit(" "), F.lit("")).try_cast("double").isNull(), V.VALUE))


def fixed(n: Column, d: Column, commas: Column) -> Column:
    from cellarium.functions.library_math import rounded

    n, places = rounded(n, d), F.greatest(F.floor(d), F.lit(0)).cast("int")
    text = F.call_function("format_number", n, places)
    return F.when(commas, text).otherwise(F.replace(text, F.lit(","), F.lit("")))


mixed("DOLLAR MOEDA", 1, 2, lambda n, d=None: F.concat(F.when(n < 0, "-").otherwise(""), F.lit("$"), fixed(F.abs(n), d if d is not None else L(2), F.lit(True))), "t", "n")


@define(X, "FIXED DEF.NÚM.DEC", 1, 3)
def _fixed(n: Val, d: Val | None = None, bare: Val | None = None) -> Val:
    (x, e), p = V.to_num(n), V.to_num(d)[0] if d is not None else L(2)
    return V.guard(Val(t=fixed(x, p, ~V.to_bool(bare)[0] if bare is not None else F.lit(True)), e=e))


def day(n: Column) -> Column:
    return F.date_add(F.lit(EPOCH), F.floor(n).cast("int"))


def number_of(d: Column) -> Column:
    return F.datediff(d, F.lit(EPOCH)).cast("double")


@define(X, "TEXT TEXTO", 2)
def _text(v: Val, form: Val) -> Val:
    """Dates by y m d h s letters, numbers by 0 # , . % and a currency sign before; other forms show the value."""
    (f, ef), (n, en) = V.to_txt(form), V.to_num(v)
    shown = V.to_txt(v)[0]
    dated = f.rlike(r"(?i)^[dmyahs/\-:. ]+$") & f.rlike(r"(?i)[dmya]|h|s")
    java = F.lower(f)
    java = F.regexp_replace(java, "a{4}|y{4}", "yyyy")
    java = F.regexp_replace(F.regexp_replace(java, r"(?<![hH:])mm?(?!m|:s)", "MM"), "MMM+", "MMMM")
    java = F.regexp_replace(F.regexp_replace(java, r"(h+):(mm)", "HH:mm"), r"(?<!H)h+", "HH")
    moment = F.timestamp_seconds(F.round((n - number_of(F.lit(dt.date(1970, 1, 1)))) * 86400)).cast("timestamp_ntz")
    safe = F.when(dated, java).otherwise("yyyy")
    as_date = F.when(dated, F.call_function("date_format", moment, safe))
    sign = F.regexp_extract(f, r"^([R$£€]+ ?)", 1)
    rest = F.substring(f, F.length(sign) + 1, F.length(f))
    places = F.length(F.regexp_extract(rest, r"\.([0#]+)", 1)).cast("double")
    numeric_form = rest.rlike(r"^[0#,]*(\.[0#]+)?%?$") & (rest != "")
    percent = rest.endswith("%")
    text = fixed(F.when(percent, n * 100).otherwise(n), places, F.instr(rest, ",") > 0)
    width = F.length(F.regexp_extract(rest, r"^(0+)", 1))
    text = F.when((width > 1) & (n >= 0), F.lpad(text, F.greatest(width + F.when(places > 0, places + 1).otherwise(0).cast("int"), F.length(text)), F.lit("0"))).otherwise(text)
    as_number = F.concat(sign, text, F.when(percent, "%").otherwise(""))
    plain = V.scalar(v).t is not None and V.scalar(v).n is None
    out = shown if plain else F.when(dated, as_date).when(numeric_form, as_number).otherwise(shown)
    return V.guard(Val(t=out, e=V.first_error(ef, V.scalar(v).e if plain else en)))


mixed("REGEXTEST", 2, 2, lambda s, p: F.regexp_like(s, p), "b", "tt")
mixed("REGEXEXTRACT", 2, 2, lambda s, p: F.regexp_substr(s, p), "t", "tt", X, (lambda s, p: F.regexp_substr(s, p).isNull(), V.NA))
mixed("REGEXREPLACE", 3, 3, lambda s, p, r: F.regexp_replace(s, p, r), "t", "ttt")

# Types -------------------------------------------------------------------------------------------------------------


def typed(names: str, f) -> None:  # noqa: ANN001
    null = lambda c: F.lit(None) if c is None else c
    define("CONDITIONAL", names, 1)(lambda v: V.boolean(F.coalesce(f(*(null(c) for c in (V.scalar(v).n, V.scalar(v).t, V.scalar(v).b, V.scalar(v).e))), F.lit(False))))


typed("ISBLANK ÉCÉL.VAZIA", lambda n, t, b, e: n.isNull() & b.isNull() & e.isNull() & (t.isNull() | (t == "")))
typed("ISERROR ÉERROS", lambda n, t, b, e: e.isNotNull())
typed("ISERR ÉERRO", lambda n, t, b, e: e.isNotNull() & (e != V.NA))
typed("ISNA É.NÃO.DISP", lambda n, t, b, e: e == V.NA)
typed("ISNUMBER ÉNÚMERO ÉNÚM", lambda n, t, b, e: n.isNotNull())
typed("ISTEXT ÉTEXTO", lambda n, t, b, e: t.isNotNull())
typed("ISNONTEXT É.NÃO.TEXTO", lambda n, t, b, e: t.isNull())
typed("ISLOGICAL ÉLÓGICO", lambda n, t, b, e: b.isNotNull())
for names, odd in (("ISEVEN ÉPAR", 0), ("ISODD ÉIMPAR", 1)):
    define("CONDITIONAL", names, 1)(lambda v, odd=odd: V.guard(Val(b=F.pmod(F.floor(F.abs(V.to_num(v)[0])), F.lit(2)) == odd, e=V.to_num(v)[1])))


@define("CONDITIONAL", "TYPE TIPO", 1)
def _type(v: Val) -> Val:
    if v.cells is not None:
        return V.literal(64.0)
    code = F.lit(1.0)
    for c, n in ((v.t, 2.0), (v.b, 4.0), (v.e, 16.0)):
        if c is not None:
            code = F.when(c.isNotNull(), n).otherwise(code)
    return V.num(code)


# Dates -------------------------------------------------------------------------------------------------------------


def dated(names: str, least: int, most: int | None, f, *tests, defaults: tuple = ()) -> None:  # noqa: ANN001
    numeric(D, names, least, most, f, *((t, c) for t, c in tests), defaults=defaults)


months = lambda d: F.year(d) * 12 + F.month(d)
dated("TODAY HOJE", 0, 0, lambda: number_of(F.current_date()))
dated("NOW AGORA", 0, 0, lambda: number_of(F.current_date()) + (F.hour(F.current_timestamp()) * 3600 + F.minute(F.current_timestamp()) * 60 + F.second(F.current_timestamp())) / 86400)
# Months and days beyond their range run on into the next year or month.
dated("DATE DATA", 3, 3, lambda y, m, d: number_of(F.add_months(F.make_date(F.least(F.greatest(F.floor(y), F.lit(1)), F.lit(9999)).cast("int"), F.lit(1), F.lit(1)), (F.floor(m) - 1).cast("int"))) + F.floor(d) - 1)
mixed("DATEVALUE", 1, 1, lambda s: _read_date(s), "n", "t", D, (lambda s: _read_date(s).isNull(), V.VALUE))


def _read_date(s: Column) -> Column:
    return number_of(F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim(s), F.lit(f))) for f in ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy"))))


dated("TIME TEMPO", 3, 3, lambda h, m, s: (h * 3600 + m * 60 + s) / 86400)


def _read_time(s: Column) -> Column:
    t = F.coalesce(*(F.try_to_timestamp(F.trim(s), F.lit(f)) for f in ("H:m:s", "H:m")))
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400


mixed("TIMEVALUE", 1, 1, _read_time, "n", "t", D, (lambda s: _read_time(s).isNull(), V.VALUE))
for names, f in (("YEAR ANO", F.year), ("MONTH MÊS", F.month), ("DAY DIA", F.dayofmonth), ("ISOWEEKNUM", F.weekofyear)):
    dated(names, 1, 1, lambda n, f=f: f(day(n)), (lambda n: n < 0, V.NUM))
seconds = lambda n: F.round((n - F.floor(n)) * 86400)
dated("HOUR HORA", 1, 1, lambda n: F.floor(seconds(n) / 3600) % 24)
dated("MINUTE MINUTO", 1, 1, lambda n: F.floor(seconds(n) / 60) % 60)
dated("SECOND SEGUNDO", 1, 1, lambda n: seconds(n) % 60)
dated("WEEKDAY DIA.DA.SEMANA", 1, None, lambda n, k: F.when(k == 1, F.dayofweek(day(n))).when(k == 2, F.weekday(day(n)) + 1).when(k == 3, F.weekday(day(n))), defaults=(1,))
dated("WEEKNUM NÚM.SEMANA NÚMSEMANA", 1, None, lambda n, k: F.floor((F.dayofyear(day(n)) + F.when(k == 2, F.weekday(F.trunc(day(n), "year"))).otherwise(F.dayofweek(F.trunc(day(n), "year")) - 1) - 1) / 7) + 1, defaults=(1,))
dated("DAYS DIAS", 2, 2, lambda a, b: F.floor(a) - F.floor(b))
dated("EDATE DATAM", 2, 2, lambda n, m: number_of(F.add_months(day(n), F.floor(m).cast("int"))))
dated("EOMONTH FIMMÊS", 2, 2, lambda n, m: number_of(F.last_day(F.add_months(day(n), F.floor(m).cast("int")))))


def days360(a: Column, b: Column, european: Column) -> Column:
    da, db = F.dayofmonth(day(a)), F.dayofmonth(day(b))
    sa = F.when(da == 31, 30).otherwise(da)
    sb = F.when((db == 31) & (european | (sa == 30)), 30).otherwise(db)
    return (F.year(day(b)) - F.year(day(a))) * 360 + (F.month(day(b)) - F.month(day(a))) * 30 + sb - sa


dated("DAYS360 DIAS360", 2, None, lambda a, b, m: days360(a, b, m != 0), defaults=(0,))


def _year_days(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def _yearfrac(a: Column, b: Column, basis: Column) -> Column:
    x, y = F.least(a, b), F.greatest(a, b)
    days = F.floor(y) - F.floor(x)
    return F.when(basis == 0, days360(x, y, F.lit(False)) / 360).when(basis == 1, days / _year_days(day(x))).when(basis == 2, days / 360).when(basis == 3, days / 365).when(basis == 4, days360(x, y, F.lit(True)) / 360)


dated("YEARFRAC FRAÇÃOANO", 2, None, _yearfrac, defaults=(0,))


@define(D, "DATEDIF DATADIF", 3)
def _datedif(a: Val, b: Val, unit: Val) -> Val:
    (x, ex), (y, ey), (u, eu) = V.to_num(a), V.to_num(b), V.to_txt(unit)
    p, q, u = day(x), day(y), F.upper(u)
    full = months(q) - months(p) - (F.dayofmonth(q) < F.dayofmonth(p)).cast("int")
    since = F.datediff(q, F.add_months(p, full))
    out = F.when(u == "D", F.datediff(q, p)).when(u == "M", full).when(u == "Y", F.floor(full / 12)).when(u == "YM", full % 12).when(u == "MD", since).when(u == "YD", F.datediff(q, F.add_months(p, (F.floor(full / 12) * 12).cast("int"))))
    return V.guard(Val(n=out.cast("double"), e=V.first_error(ex, ey, eu)), ((x > y) | out.isNull(), V.NUM))


def _work(n: Column, weekend: tuple[int, ...], off: Column | None) -> Column:
    """Whether the day with this number is worked; weekdays from Monday as 0."""
    use = ~F.weekday(day(n)).isin(*weekend)
    return use & ~F.array_contains(off, F.floor(n).cast("double")) if off is not None else use


WEEKENDS = {1: (5, 6), 2: (6, 0), 3: (0, 1), 4: (1, 2), 5: (2, 3), 6: (3, 4), 7: (4, 5), 11: (6,), 12: (0,), 13: (1,), 14: (2,), 15: (3,), 16: (4,), 17: (5,)}


def _networkdays(international: bool):  # noqa: ANN202
    def make(a: Val, b: Val, *rest: Val) -> Val:
        (x, ex), (y, ey) = V.to_num(a), V.to_num(b)
        kind, off = (rest[0] if international and rest else None), (rest[1] if international and len(rest) > 1 else rest[0] if rest and not international else None)
        off = F.transform(V.numbers(V.to_cells(off)), F.floor).cast("array<double>") if off is not None else None
        first, last = F.least(x, y), F.greatest(x, y)
        every = F.sequence(F.floor(first).cast("int"), F.floor(last).cast("int"))
        count = lambda weekend: F.size(F.filter(every, lambda d: _work(d, weekend, off)))
        out = count(WEEKENDS[1])
        if kind is not None:
            code = V.to_num(kind)[0]
            for k, weekend in WEEKENDS.items():
                out = F.when(code == k, count(weekend)).otherwise(out)
        return V.guard(Val(n=(out * F.when(x > y, -1).otherwise(1)).cast("double"), e=V.first_error(ex, ey)))

    return make


def _workday(international: bool):  # noqa: ANN202
    def make(a: Val, n: Val, *rest: Val) -> Val:
        (x, ex), (k, ek) = V.to_num(a), V.to_num(n)
        off = rest[1] if international and len(rest) > 1 else rest[0] if rest and not international else None
        offs = F.transform(V.numbers(V.to_cells(off)), F.floor).cast("array<double>") if off is not None else None
        way = F.when(k < 0, -1).otherwise(1)
        need = F.abs(F.floor(k)).cast("int")
        # Seven days hold five worked ones, less the days off.
        span = need * 2 + 14 + (F.size(offs) * 2 if offs is not None else 0)
        days = F.transform(F.sequence(F.lit(1), span), lambda i: F.floor(x) + i * way)
        hit = F.get(F.filter(days, lambda d: _work(d, WEEKENDS[1], offs)), need - 1)
        return V.guard(Val(n=F.when(need == 0, F.floor(x)).otherwise(hit).cast("double"), e=V.first_error(ex, ek)))

    return make


define(D, "NETWORKDAYS DIATRABALHOTOTAL", 2, 3)(_networkdays(False))
define(D, "NETWORKDAYS.INTL", 2, 4)(_networkdays(True))
define(D, "WORKDAY DIAÚTIL DIATRABALHO", 2, 3)(_workday(False))
define(D, "WORKDAY.INTL", 2, 4)(_workday(True))


#: Ones, fives and tens of each place of a Roman number, and its digits in terms of them.
ROMAN = ((1, "IVX"), (10, "XLC"), (100, "CDM"), (1000, "M--"))
DIGITS = ("", "1", "11", "111", "15", "5", "51", "511", "5111", "1x")


@define("ARITHMETIC", "ROMAN ROMANO", 1, 2)
def _to_roman(n: Val, _: Val | None = None) -> Val:
    x, e = V.to_num(n)
    shapes = F.array(*(F.lit(d) for d in DIGITS))
    place = lambda value, signs: F.translate(F.get(shapes, (F.floor(x / value) % 10).cast("int")), "15x", signs)
    return V.guard(Val(t=F.concat(*(place(value, signs) for value, signs in reversed(ROMAN))), e=e), ((x < 0) | (x >= 4000), V.VALUE))


@define("ARITHMETIC", "ARABIC ÁRABE", 1)
def _to_arabic(text: Val) -> Val:
    t, e = V.to_txt(text)
    t = F.upper(F.trim(t))
    signs = [(one, value) for value, (one, _, _) in ROMAN] + [(five, 5 * value) for value, (_, five, _) in ROMAN[:3]]
    worth = F.create_map(*(F.lit(x) for pair in signs for x in pair))
    numbers = F.transform(F.regexp_extract_all(t, F.lit("[A-Z]"), F.lit(0)), lambda c: F.coalesce(F.try_element_at(worth, c), F.lit(0)))
    signed = F.transform(numbers, lambda v, i: F.when(v < F.coalesce(F.get(numbers, i + 1), F.lit(0)), -v).otherwise(v))
    out = F.aggregate(signed, F.lit(0), lambda s, v: s + v)
    return V.guard(Val(n=(out * F.when(t.startswith("-"), -1).otherwise(1)).cast("double"), e=e))


