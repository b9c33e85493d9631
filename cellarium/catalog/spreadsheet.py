"""Spreadsheet functions over tables, and their SQL: formulas row by row, and aggregates over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.catalog.audit import read
from cellarium.functions import formula as X
from cellarium.functions import values as V
from cellarium.operators import ranges as R


def by_formulas(df: DataFrame, key: str, columns: list[str], formulas: dict[str, str]) -> DataFrame:
    """key and a column for each formula, in which A is the first of `columns`, B the second, and so on, of the same row."""
    kinds = dict(df.dtypes)

    def one(i: int) -> V.Val:
        c, kind = F.col(columns[i - 1]), kinds[columns[i - 1]]
        if kind == "string":
            return V.txt(c)
        if kind.startswith("timestamp") or kind == "date":
            return V.num(F.datediff(c, F.lit("1899-12-30").cast("date")))
        return V.boolean(c) if kind == "boolean" else V.num(c)

    def bind(ref: X.Ref) -> V.Val:
        if ref.single:
            return one(ref.left)
        cells = [one(i).struct().cast(V.CELL) for i in range(ref.left, ref.right + 1)]
        return V.span(F.array(*cells), (1, len(cells)))

    def shown(v: V.Val) -> F.Column:
        v = V.scalar(v)
        if v.t is not None and v.n is None and v.b is None:
            return F.coalesce(v.t, v.e) if v.e is not None else v.t
        return F.round(v.n, 6) if v.n is not None else v.b

    # Formulas take long for few bytes, so they aren't left to partitions that were made by size.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([key, *columns])).repartition(width, key)
    return rows.select(key, *(shown(X.compile_formula(f, bind)).alias(name) for name, f in formulas.items()))


def _formulas(table: str, key: str, columns: list[str], formulas: dict[str, str]):  # noqa: ANN202
    return lambda s, d: by_formulas(read(s, d, table), key, columns, formulas)


MATH = {
    "r_mod": "=MOD(B1,7)", "r_int": "=INT(C1/3)", "r_trunc": "=TRUNC(-C1/7,2)", "r_round": "=ROUND(C1,-1)", "r_up": "=ROUNDUP(C1/9,1)", "r_ceil": "=CEILING(C1,5)", "r_floor": "=FLOOR(C1,5)",
    "r_even": "=EVEN(B1)", "r_odd": "=ODD(B1)", "r_quot": "=QUOTIENT(B1,4)", "r_pow": "=B1^2", "r_sqrt": "=SQRT(C1)", "r_ln": "=LN(C1)", "r_log": "=LOG(C1,2)", "r_sin": "=SIN(B1)",
    "r_atan2": "=ATAN2(B1,C1)", "r_deg": "=DEGREES(B1)", "r_comb": "=COMBIN(10,MOD(B1,10))", "r_fact": "=FACT(MOD(B1,15))", "r_gcd": "=GCD(B1,12)", "r_lcm": "=LCM(B1,12)", "r_expr": "=(C1-B1)*2/(B1+1)-B1%",
    "r_sum": "=SUM(B1:C1)", "r_iferror": "=IFERROR(C1/(B1-10),-1)", "r_if": "=IF(AND(B1>10,C1<1500),1,0)",
}
TEXT = {
    "t_len": "=LEN(B1)", "t_left": "=LEFT(B1,3)", "t_right": "=RIGHT(B1,4)", "t_mid": "=MID(B1,2,3)", "t_up": "=UPPER(B1)", "t_low": "=LOWER(C1)", "t_sub": "=SUBSTITUTE(B1,\"a\",\"@\")", "t_rep": "=REPLACE(B1,1,2,\"#\")",
    "t_find": "=IFERROR(FIND(\"a\",B1),0)", "t_rept": "=REPT(LEFT(C1,1),3)", "t_join": "=TEXTJOIN(\"-\",TRUE,B1,\"\",C1)", "t_cat": "=B1&\"/\"&C1", "t_code": "=CODE(C1)", "t_exact": "=EXACT(B1,C1)", "t_after": "=IFERROR(TEXTAFTER(C1,\"#\"),\"none\")",
    "t_proper": "=PROPER(C1)", "t_eq": "=IF(UPPER(C1)=LOWER(C1),\"same\",\"not\")",
}
DATES = {
    "d_serial": "=B1", "d_year": "=YEAR(B1)", "d_month": "=MONTH(B1)", "d_day": "=DAY(B1)", "d_week": "=WEEKDAY(B1)", "d_week2": "=WEEKDAY(B1,2)", "d_iso": "=ISOWEEKNUM(B1)", "d_edate": "=EDATE(B1,5)", "d_eom": "=EOMONTH(B1,-1)",
    "d_work": "=NETWORKDAYS(B1,B1+30)", "d_diff": "=DATEDIF(B1,DATE(2005,6,15),\"M\")", "d_days": "=DAYS(DATE(2005,6,15),B1)", "d_text": "=TEXT(B1,\"yyyy-mm-dd\")", "d_360": "=DAYS360(B1,DATE(2005,6,15))", "d_frac": "=YEARFRAC(B1,DATE(2005,6,15),3)",
}
FINANCE = {
    "f_pmt": "=PMT(0.01,24,B1)", "f_fv": "=FV(0.02,10,-100,-B1)", "f_pv": "=PV(0.02,10,-B1)", "f_nper": "=NPER(0.01,-B1/10,B1)", "f_sln": "=SLN(B1,B1/10,5)", "f_syd": "=SYD(B1,B1/10,5,2)", "f_effect": "=EFFECT(0.12,12)",
    "f_rri": "=RRI(5,B1,B1*2)", "f_pdur": "=PDURATION(0.1,B1,B1*2)", "f_ispmt": "=ISPMT(0.1,2,10,B1)", "f_npv": "=NPV(0.1,B1,B1/2)", "f_ipmt": "=IPMT(0.01,3,24,B1)", "f_ppmt": "=PPMT(0.01,3,24,B1)",
}
ENGINEERING = {
    "e_hex": "=DEC2HEX(B1)", "e_bin": "=DEC2BIN(MOD(B1,512))", "e_oct": "=DEC2OCT(B1)", "e_back": "=HEX2DEC(DEC2HEX(B1))", "e_and": "=BITAND(B1,21)", "e_or": "=BITOR(B1,21)", "e_xor": "=BITXOR(B1,21)", "e_shift": "=BITLSHIFT(B1,3)",
    "e_km": "=CONVERT(B1,\"mi\",\"km\")", "e_f": "=CONVERT(B1,\"C\",\"F\")", "e_bad": "=IFERROR(CONVERT(B1,\"kg\",\"m\"),-1)", "e_delta": "=DELTA(B1,7)", "e_gestep": "=GESTEP(B1,25)", "e_base": "=BASE(B1,7)",
}


def _agg(table: str, by: list[str], make):  # noqa: ANN001, ANN202
    def run(s: SparkSession, d: str) -> DataFrame:
        df = read(s, d, table)
        return df.groupBy(*by).agg(*(F.round(c, 4).alias(k) for k, c in make(df).items()))

    return run


def _price_steps(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t")).agg(F.max("o_totalprice").alias("v"))


def lookup_asof(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")).alias("t"))
    return R.lookup_sorted(e, "t", _price_steps(s, d), "t", "v", ["k"]).select("o_orderkey", "found")


def index_match(s: SparkSession, d: str) -> DataFrame:
    """The region of each customer: the place found in one table is the key of the next."""
    nation = R.lookup(read(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", read(s, d, "nation"), "n_nationkey", "n_regionkey", "n_nationkey")
    matched = nation.withColumnRenamed("found", "regionkey")
    return R.lookup(matched, "regionkey", read(s, d, "region"), "r_regionkey", "r_name", "r_regionkey").select("c_custkey", "found")


def percentile_quartile(s: SparkSession, d: str) -> DataFrame:
    shares = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    found = R.quantiles(read(s, d, "orders"), "o_totalprice", shares, ["o_orderpriority"])
    return found.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in shares))


QUERIES = {
    "math_functions": _formulas("part", "p_partkey", ["p_partkey", "p_size", "p_retailprice"], MATH),
    "text_functions": _formulas("part", "p_partkey", ["p_partkey", "p_name", "p_brand"], TEXT),
    "date_functions": _formulas("orders", "o_orderkey", ["o_orderkey", "o_orderdate"], DATES),
    "finance_functions": _formulas("part", "p_partkey", ["p_partkey", "p_retailprice"], FINANCE),
    "base_conversion": _formulas("part", "p_partkey", ["p_partkey", "p_size"], ENGINEERING),
    "sumifs": _agg("lineitem", ["l_returnflag"], lambda df: {"big": R.sum_ifs(df, "l_extendedprice", {"l_quantity": ">25", "l_linestatus": "O"}), "none": R.sum_ifs(df, "l_tax", {"l_quantity": ">99"}), "all": F.sum("l_quantity")}),
    "countifs": _agg("lineitem", ["l_linestatus"], lambda df: {"n": R.count_ifs(df, {"l_quantity": "<=10", "l_discount": "<>0.05"}), "exact": R.count_ifs(df, {"l_quantity": "7"})}),
    "averageifs": _agg("lineitem", ["l_returnflag", "l_linestatus"], lambda df: {"a": R.average_ifs(df, "l_discount", {"l_quantity": ">=40"})}),
    "maxifs_minifs": _agg("orders", ["o_orderstatus"], lambda df: {"most": R.max_ifs(df, "o_totalprice", {"o_orderpriority": "1-*"}), "least": R.min_ifs(df, "o_totalprice", {"o_orderpriority": "?-LOW"})}),
    "criteria_wildcard": _agg("part", ["p_type"], lambda df: {"n": R.count_ifs(df, {"p_name": "*a*"}), "m": R.count_ifs(df, {"p_brand": "brand#1?"}), "x": R.count_ifs(df, {"p_brand": "<>Brand#11"})}),
    "sumproduct": _agg("lineitem", ["l_returnflag"], lambda df: {"s": R.sum_product("l_quantity", "l_discount")}),
    "subtotal_dispatch": _agg("lineitem", ["l_linestatus"], lambda df: {f"c{k}": R.subtotal(k, "l_quantity") for k in (1, 2, 4, 5, 7, 8, 9, 10, 111)} | {f"t{k}": R.subtotal(k, "l_returnflag", "string") for k in (2, 3)}),
    "percentile_quartile": percentile_quartile,
    "dispersion_stats": _agg("lineitem", ["l_returnflag"], lambda df: R.dispersion("l_quantity")),
    "shape_stats": _agg("lineitem", ["l_returnflag"], lambda df: R.shape("l_quantity")),
    "regression_stats": _agg("lineitem", ["l_returnflag"], lambda df: R.regression("l_extendedprice", "l_quantity")),
    "rank_eq_avg": lambda s, d: R.ranks(read(s, d, "part"), "p_size", ["p_type"]).select("p_partkey", F.col("rank_eq").cast("double"), "rank_avg"),
    "large_small": lambda s, d: R.nth(read(s, d, "orders"), "o_totalprice", 3, ["o_custkey"]).withColumnRenamed("value", "third"),
    "trimmean": lambda s, d: R.trimmed_mean(read(s, d, "orders"), "o_totalprice", 0.2, ["o_orderpriority"]).select("o_orderpriority", F.round("trimmed_mean", 4).alias("trimmed_mean")),
    "mode": lambda s, d: R.mode(read(s, d, "part"), "p_size", ["p_type"]),
    "vlookup_join": lambda s, d: R.lookup(read(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", read(s, d, "supplier"), "s_nationkey", "s_name", "s_suppkey"),
    "xlookup_default": lambda s, d: R.lookup(read(s, d, "part").select("p_partkey"), "p_partkey", read(s, d, "lineitem").filter("l_quantity = 50"), "l_partkey", "l_orderkey", "l_orderkey", -1),
    "index_match": index_match,
    "lookup_asof": lookup_asof,
}

_S = "date_diff('day', DATE '1899-12-30', o_orderdate::DATE)"
_E = "DATE '2005-06-15'"
_AGG = "SELECT {by}, {cols} FROM {t} GROUP BY {by}"


def _sql(t: str, by: str, **cols: str) -> str:
    return _AGG.format(by=by, t=t, cols=", ".join(f"round({c}, 4) AS {k}" for k, c in cols.items()))


_P, _Z = "p_retailprice", "p_size"
ORACLE_SQL = {
    "math_functions": f"""SELECT p_partkey, round({_Z} % 7, 6) AS r_mod, floor({_P} / 3) AS r_int, round(-floor({_P} / 7 * 100) / 100, 6) AS r_trunc, floor({_P} / 10 + 0.5) * 10 AS r_round, round(ceil(round({_P} / 9 * 10, 9)) / 10, 6) AS r_up,
ceil({_P} / 5) * 5 AS r_ceil, floor({_P} / 5) * 5 AS r_floor, ceil({_Z} / 2) * 2 AS r_even, {_Z} + CASE WHEN {_Z} % 2 = 0 THEN 1 ELSE 0 END AS r_odd, {_Z} // 4 AS r_quot, {_Z} * {_Z} AS r_pow, round(sqrt({_P}), 6) AS r_sqrt, round(ln({_P}), 6) AS r_ln,
round(ln({_P}) / ln(2), 6) AS r_log, round(sin({_Z}), 6) AS r_sin, round(atan2({_P}, {_Z}), 6) AS r_atan2, round(degrees({_Z}), 6) AS r_deg, factorial(10)::DOUBLE / (factorial({_Z} % 10) * factorial(10 - {_Z} % 10)) AS r_comb, factorial({_Z} % 15)::DOUBLE AS r_fact,
gcd({_Z}, 12) AS r_gcd, lcm({_Z}, 12) AS r_lcm, round(({_P} - {_Z}) * 2 / ({_Z} + 1) - {_Z} / 100, 6) AS r_expr, round({_Z} + {_P}, 6) AS r_sum, CASE WHEN {_Z} = 10 THEN -1 ELSE round({_P} / ({_Z} - 10), 6) END AS r_iferror,
CASE WHEN {_Z} > 10 AND {_P} < 1500 THEN 1 ELSE 0 END AS r_if FROM part""",
    "text_functions": """SELECT p_partkey, length(p_name) AS t_len, left(p_name, 3) AS t_left, right(p_name, 4) AS t_right, substr(p_name, 2, 3) AS t_mid, upper(p_name) AS t_up, lower(p_brand) AS t_low, replace(p_name, 'a', '@') AS t_sub, '#' || substr(p_name, 3) AS t_rep,
instr(p_name, 'a') AS t_find, repeat(left(p_brand, 1), 3) AS t_rept, p_name || '-' || p_brand AS t_join, p_name || '/' || p_brand AS t_cat, ascii(p_brand) AS t_code, p_name = p_brand AS t_exact, CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, instr(p_brand, '#') + 1) ELSE 'none' END AS t_after,
upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS t_proper, 'same' AS t_eq FROM part""",
    "date_functions": f"""SELECT o_orderkey, {_S} AS d_serial, year(o_orderdate) AS d_year, month(o_orderdate) AS d_month, day(o_orderdate) AS d_day, dayofweek(o_orderdate) + 1 AS d_week, isodow(o_orderdate) AS d_week2, week(o_orderdate) AS d_iso,
date_diff('day', DATE '1899-12-30', (o_orderdate::DATE + INTERVAL 5 MONTH)::DATE) AS d_edate, date_diff('day', DATE '1899-12-30', (date_trunc('month', o_orderdate)::DATE - INTERVAL 1 DAY)::DATE) AS d_eom,
len(list_filter(range(31), lambda i: isodow((o_orderdate::DATE + i::INT)::DATE) < 6)) AS d_work, date_sub('month', o_orderdate::DATE, {_E}) AS d_diff, date_diff('day', o_orderdate::DATE, {_E}) AS d_days, strftime(o_orderdate, '%Y-%m-%d') AS d_text,
(2005 - year(o_orderdate)) * 360 + (6 - month(o_orderdate)) * 30 + 15 - least(day(o_orderdate), 30) AS d_360, round(date_diff('day', o_orderdate::DATE, {_E}) / 365, 6) AS d_frac FROM orders""",
    "finance_functions": f"""WITH p AS (SELECT p_partkey, {_P} AS v, pow(1.01::DOUBLE, 24) AS g, pow(1.02::DOUBLE, 10) AS h, pow(1.01::DOUBLE, 2) AS g2 FROM part), q AS (SELECT *, -(v * g) / ((g - 1) / 0.01::DOUBLE) AS pmt FROM p), r AS (SELECT *, -(v * g2 + pmt * (g2 - 1) / 0.01::DOUBLE) * 0.01::DOUBLE AS ip FROM q)
SELECT p_partkey, round(pmt, 6) AS f_pmt, round(-(-v * h - 100 * (h - 1) / 0.02::DOUBLE), 6) AS f_fv, round(v * (h - 1) / 0.02::DOUBLE / h, 6) AS f_pv, round(ln((-v / 10) / (-v / 10 + v * 0.01::DOUBLE)) / ln(1.01::DOUBLE), 6) AS f_nper, round((v - v / 10) / 5, 6) AS f_sln, round((v - v / 10) * 4 * 2 / 30, 6) AS f_syd,
round(pow(1.01::DOUBLE, 12) - 1, 6) AS f_effect, round(pow(2::DOUBLE, 0.2::DOUBLE) - 1, 6) AS f_rri, round(ln(2) / ln(1.1::DOUBLE), 6) AS f_pdur, round(-v * 0.1::DOUBLE * 0.8::DOUBLE, 6) AS f_ispmt, round(v / 1.1::DOUBLE + v / 2 / 1.21::DOUBLE, 6) AS f_npv, round(ip, 6) AS f_ipmt, round(pmt - ip, 6) AS f_ppmt FROM r""",
    "base_conversion": f"""SELECT p_partkey, to_base({_Z}, 16) AS e_hex, to_base({_Z} % 512, 2) AS e_bin, to_base({_Z}, 8) AS e_oct, {_Z} AS e_back, {_Z} & 21 AS e_and, {_Z} | 21 AS e_or, xor({_Z}, 21) AS e_xor, {_Z} << 3 AS e_shift, round({_Z} * 1.609344::DOUBLE, 6) AS e_km,
round({_Z} * 9.0::DOUBLE / 5 + 32, 6) AS e_f, -1 AS e_bad, CASE WHEN {_Z} = 7 THEN 1 ELSE 0 END AS e_delta, CASE WHEN {_Z} >= 25 THEN 1 ELSE 0 END AS e_gestep, to_base({_Z}, 7) AS e_base FROM part""",
    "sumifs": _sql("lineitem", "l_returnflag", big="coalesce(sum(l_extendedprice) FILTER (l_quantity > 25 AND l_linestatus = 'O'), 0)", none="coalesce(sum(l_tax) FILTER (l_quantity > 99), 0)", all="sum(l_quantity)").replace(" AS all", ' AS "all"'),
    "countifs": _sql("lineitem", "l_linestatus", n="count(*) FILTER (l_quantity <= 10 AND l_discount <> 0.05::DOUBLE)", exact="count(*) FILTER (l_quantity = 7)"),
    "averageifs": _sql("lineitem", "l_returnflag, l_linestatus", a="coalesce(avg(l_discount) FILTER (l_quantity >= 40), 0)"),
    "maxifs_minifs": _sql("orders", "o_orderstatus", most="coalesce(max(o_totalprice) FILTER (o_orderpriority LIKE '1-%'), 0)", least="coalesce(min(o_totalprice) FILTER (o_orderpriority LIKE '_-LOW'), 0)"),
    "criteria_wildcard": _sql("part", "p_type", n="count(*) FILTER (p_name ILIKE '%a%')", m="count(*) FILTER (p_brand ILIKE 'brand#1_')", x="count(*) FILTER (p_brand <> 'Brand#11')"),
    "sumproduct": _sql("lineitem", "l_returnflag", s="sum(l_quantity * l_discount)"),
    "subtotal_dispatch": _sql("lineitem", "l_linestatus", c1="avg(l_quantity)", c2="count(l_quantity)", t2="0", t3="count(l_returnflag)", c4="max(l_quantity)", c5="min(l_quantity)", c7="stddev_samp(l_quantity)", c8="stddev_pop(l_quantity)", c9="sum(l_quantity)", c10="var_samp(l_quantity)", c111="var_pop(l_quantity)"),
    "percentile_quartile": _sql("orders", "o_orderpriority", **{f"p{k}": f"quantile_cont(o_totalprice, {k / 100})" for k in (10, 25, 50, 75, 90)}),
    "dispersion_stats": _sql("lineitem", "l_returnflag", stdev="stddev_samp(l_quantity)", stdevp="stddev_pop(l_quantity)", var="var_samp(l_quantity)", varp="var_pop(l_quantity)", devsq="var_pop(l_quantity) * count(l_quantity)"),
    "shape_stats": _sql("lineitem", "l_returnflag", skew="skewness(l_quantity)", kurt="kurtosis(l_quantity)", geomean="exp(avg(ln(l_quantity)))", harmean="count(*) / sum(1 / l_quantity)"),
    "regression_stats": _sql("lineitem", "l_returnflag", slope="regr_slope(l_extendedprice, l_quantity)", intercept="regr_intercept(l_extendedprice, l_quantity)", rsq="regr_r2(l_extendedprice, l_quantity)", correl="corr(l_extendedprice, l_quantity)", covar_p="covar_pop(l_extendedprice, l_quantity)",
        covar_s="covar_samp(l_extendedprice, l_quantity)", steyx="sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2))"),
    "rank_eq_avg": "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC)::DOUBLE AS rank_eq, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2 AS rank_avg FROM part",
    "large_small": "SELECT o_custkey, o_totalprice AS third FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) = 3",
    "trimmean": """WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS trimmed_mean FROM r WHERE i > floor(n * 0.2::DOUBLE / 2) AND i <= n - floor(n * 0.2::DOUBLE / 2) GROUP BY 1""",
    "mode": "WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_size AS mode, n AS times FROM c QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_size) = 1",
    "vlookup_join": "WITH f AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS found FROM supplier GROUP BY 1) SELECT c_custkey, c_nationkey, found FROM customer LEFT JOIN f ON c_nationkey = s_nationkey",
    "xlookup_default": "WITH f AS (SELECT l_partkey, min(l_orderkey) AS f FROM lineitem WHERE l_quantity = 50 GROUP BY 1) SELECT p_partkey, coalesce(f, -1) AS found FROM part LEFT JOIN f ON p_partkey = l_partkey",
    "index_match": "SELECT c_custkey, r_name AS found FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "lookup_asof": """WITH s AS (SELECT o_custkey AS k, o_orderdate AS t, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), e AS (SELECT o_orderkey, o_custkey AS k, o_orderdate + INTERVAL 40 DAY AS t FROM orders)
SELECT o_orderkey, v AS found FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.t >= s.t""",
}
