"""Formula queries, a function a column: each formula beside the SQL that says what it must give.

Formulas and SQL see a row of `part`: B1 or z is its size (1 to 50), C1 or v its retail price. Where SQL has no function of the
kind, the formula has a closed form (Student's distribution of one degree, complex numbers by their parts) or is a constant. SQL after @ gives text or truth.
"""

from __future__ import annotations

from cellarium.catalog.spreadsheet import by_formulas
from cellarium.catalog.audit import read

X, Y = "(z / 25)", "0.5::DOUBLE"
C = "COMPLEX(B1/25,0.5)"
#: Sums over (1, 2), (2, 4), (3, z): of products, and of squares of the second.
SXY, MY = "(z - 2)", "((6 + z) / 3)"
SYY = f"(pow(2 - {MY}, 2) + pow(4 - {MY}, 2) + pow(z - {MY}, 2))"
_M = "((8 + z) / 3)"
_MOMENT = lambda k: f"((pow(1 - {_M}, {k}) + pow(2 - {_M}, {k}) + pow(z + 5 - {_M}, {k})) / 3)"
_SORTED = "list_sort([0::DOUBLE, 10, 20, z])"

FORMULAS: dict[str, dict[str, tuple[str, str]]] = {
    "logic_functions": {
        "or": ("=OR(B1>40,C1>1500)", "@z > 40 OR v > 1500"), "and": ("=AND(B1>20,C1>1000,TRUE())", "@z > 20 AND v > 1000"), "xor": ("=XOR(B1>20,C1>1000)", "@(z > 20) <> (v > 1000)"), "true": ("=TRUE()", "@true"),
        "false": ("=FALSE()", "@false"), "not": ("=NOT(B1>20)", "@z <= 20"), "ifs": ("=IFS(B1>40,3,B1>20,2,TRUE,1)", "CASE WHEN z > 40 THEN 3 WHEN z > 20 THEN 2 ELSE 1 END"),
        "switch": ("=SWITCH(MOD(B1,3),0,\"a\",1,\"b\",\"c\")", "@CASE z % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"), "ifna": ("=IFNA(NA(),B1)", "z"), "let": ("=LET(x,B1*2,x+1)", "z * 2 + 1"),
    },
    "information_functions": {
        "isblank": ("=ISBLANK(B1)", "@false"), "iserror": ("=ISERROR(1/(B1-10))", "@z = 10"), "iserr": ("=ISERR(NA())", "@false"), "isna": ("=ISNA(NA())", "@true"), "isnumber": ("=ISNUMBER(B1)", "@true"), "istext": ("=ISTEXT(\"x\")", "@true"),
        "isnontext": ("=ISNONTEXT(B1)", "@true"), "islogical": ("=ISLOGICAL(B1>3)", "@true"), "iseven": ("=ISEVEN(B1)", "@z % 2 = 0"), "isodd": ("=ISODD(B1)", "@z % 2 = 1"), "type": ("=TYPE(B1)", "1"), "n": ("=N(B1)+N(\"x\")", "z"),
        "t": ("=T(\"x\")&T(B1)", "@'x'"),
    },
    "lookup_functions": {
        "xmatch": ("=XMATCH(MOD(B1,4),{3,2,1,0})", "4 - z % 4"), "choose": ("=CHOOSE(MOD(B1,3)+1,\"a\",\"b\",\"c\")", "@CASE z % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"), "row": ("=ROW(B1)", "1"), "rows": ("=ROWS({1;2;3})", "3"),
        "column": ("=COLUMN(C1)", "3"), "columns": ("=COLUMNS(B1:C1)", "2"), "match": ("=MATCH(B1,{0,10,20,30,40})", "1 + least(floor(z / 10), 4)"), "index": ("=INDEX({5,6,7;8,9,10},2,MOD(B1,3)+1)", "8 + z % 3"),
        "vlookup": ("=VLOOKUP(MOD(B1,2),{0,\"low\";1,\"high\"},2,FALSE)&\"\"", "@CASE WHEN z % 2 = 0 THEN 'low' ELSE 'high' END"), "hlookup": ("=HLOOKUP(MOD(B1,2),{0,1;\"x\",\"y\"},2,FALSE)&\"\"", "@CASE WHEN z % 2 = 0 THEN 'x' ELSE 'y' END"),
        "xlookup": ("=XLOOKUP(MOD(B1,3),{0,1},{7,8},-1)", "CASE z % 3 WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE -1 END"), "lookup": ("=LOOKUP(B1,{0,25},{3,4})", "CASE WHEN z < 25 THEN 3 ELSE 4 END"), "address": ("=ADDRESS(B1,28)", "@'$AB$' || z::INT"),
    },
    "arithmetic_functions": {
        "sumsq": ("=SUMSQ(B1:C1)", "z * z + v * v"), "x2my2": ("=SUMX2MY2(B1:C1,{3,4})", "z * z - 9 + v * v - 16"), "x2py2": ("=SUMX2PY2(B1:C1,{3,4})", "z * z + 9 + v * v + 16"), "xmy2": ("=SUMXMY2(B1:C1,{3,4})", "pow(z - 3, 2) + pow(v - 4, 2)"),
        "product": ("=PRODUCT(B1:C1,2)", "z * v * 2"), "abs": ("=ABS(B1-25)", "abs(z - 25)"), "sign": ("=SIGN(B1-25)", "sign(z - 25)"), "rounddown": ("=ROUNDDOWN(-C1/9,1)", "-floor(round(v / 9 * 10, 9)) / 10"), "mround": ("=MROUND(B1,4)", "floor(z / 4 + 0.5) * 4"),
        "power": ("=POWER(B1,1.5)", "pow(z, 1.5::DOUBLE)"), "sqrtpi": ("=SQRTPI(B1)", "sqrt(z * pi())"), "exp": ("=EXP(B1/10)", "exp(z / 10)"), "log10": ("=LOG10(C1)", "log10(v)"), "combina": ("=COMBINA(5,MOD(B1,6))", "factorial((4 + z % 6)::INT)::DOUBLE / factorial((z % 6)::INT) / factorial(4)"),
        "permut": ("=PERMUT(10,MOD(B1,6))", "factorial(10)::DOUBLE / factorial((10 - z % 6)::INT)"), "permutationa": ("=PERMUTATIONA(4,MOD(B1,6))", "pow(4, z % 6)"), "pi": ("=PI()*B1", "pi() * z"), "rand": ("=AND(RAND()>=0,RAND()<1)", "@true"),
        "between": ("=AND(RANDBETWEEN(B1,B1+10)>=B1,RANDBETWEEN(B1,B1+10)<=B1+10)", "@true"), "radians": ("=RADIANS(B1)", "radians(z)"), "fisher": ("=FISHER(B1/60)", "0.5::DOUBLE * ln((1 + z / 60) / (1 - z / 60))"), "fisherinv": ("=FISHERINV(B1/25)", "(exp(2 * z / 25) - 1) / (exp(2 * z / 25) + 1)"),
        "multinomial": ("=MULTINOMIAL(2,MOD(B1,4))", "factorial((2 + z % 4)::INT)::DOUBLE / 2 / factorial((z % 4)::INT)"), "factdouble": ("=FACTDOUBLE(MOD(B1,6))", "[1, 1, 2, 3, 8, 15][(z % 6)::INT + 1]"), "series": ("=SERIESSUM(B1/50,0,1,{1,2,3})", "1 + 2 * z / 50 + 3 * pow(z / 50, 2)"),
    },
    "trigonometric_functions": {
        "cos": ("=COS(B1)", "cos(z)"), "tan": ("=TAN(B1/60)", "tan(z / 60)"), "asin": ("=ASIN(B1/60)", "asin(z / 60)"), "acos": ("=ACOS(B1/60)", "acos(z / 60)"), "atan": ("=ATAN(B1)", "atan(z)"), "sinh": ("=SINH(B1/20)", "(exp(z / 20) - exp(-z / 20)) / 2"),
        "cosh": ("=COSH(B1/20)", "(exp(z / 20) + exp(-z / 20)) / 2"), "tanh": ("=TANH(B1/20)", "(exp(z / 10) - 1) / (exp(z / 10) + 1)"), "asinh": ("=ASINH(B1)", "ln(z + sqrt(z * z + 1))"), "acosh": ("=ACOSH(B1)", "ln(z + sqrt(z * z - 1))"),
        "atanh": ("=ATANH(B1/60)", "0.5::DOUBLE * ln((1 + z / 60) / (1 - z / 60))"), "sec": ("=SEC(B1/60)", "1 / cos(z / 60)"), "csc": ("=CSC(B1/60)", "1 / sin(z / 60)"), "cot": ("=COT(B1/60)", "1 / tan(z / 60)"), "sech": ("=SECH(B1/20)", "2 / (exp(z / 20) + exp(-z / 20))"),
        "csch": ("=CSCH(B1/20)", "2 / (exp(z / 20) - exp(-z / 20))"), "coth": ("=COTH(B1/20)", "(exp(z / 10) + 1) / (exp(z / 10) - 1)"), "acot": ("=ACOT(B1)", "atan(1 / z)"), "acoth": ("=ACOTH(B1+1)", "0.5::DOUBLE * ln((z + 2) / z)"),
    },
    "aggregate_functions": {
        "averagea": ("=AVERAGEA(B1:C1,TRUE)", "(z + v + 1) / 3"), "averageif": ("=AVERAGEIF(B1:C1,\">25\")", "CASE WHEN z > 25 THEN (z + v) / 2 ELSE v END"), "averageifs": ("=AVERAGEIFS(B1:C1,B1:C1,\">25\",B1:C1,\"<100\")", "CASE WHEN z > 25 THEN z ELSE 0 END"),
        "count": ("=COUNT(B1:C1,\"x\",5)", "3"), "counta": ("=COUNTA(B1:C1,\"x\")", "3"), "countblank": ("=COUNTBLANK(B1:C1)", "0"), "countifs": ("=COUNTIFS(B1:C1,\">25\",B1:C1,\"<2000\")", "(z > 25)::INT + (v < 2000)::INT"), "countif": ("=COUNTIF(B1:C1,\">25\")", "(z > 25)::INT + 1"),
        "sumif": ("=SUMIF(B1:C1,\">25\")", "@v + CASE WHEN z > 25 THEN z ELSE 0 END"), "min": ("=MIN(B1:C1,30)", "least(z, 30)"), "max": ("=MAX(B1,30)", "greatest(z, 30)"), "mina": ("=MINA(B1,TRUE)", "1"), "maxa": ("=MAXA(B1-60,TRUE)", "1"), "maxifs": ("=MAXIFS(B1:C1,B1:C1,\"<100\")", "z"),
        "minifs": ("=MINIFS(B1:C1,B1:C1,\">100\")", "v"), "small": ("=SMALL({0,10,20,B1},3)", f"{_SORTED}[3]"), "large": ("=LARGE({0,10,20,B1},1)", f"{_SORTED}[4]"), "percentile": ("=PERCENTILE({0,10,20,B1},0.5)", f"({_SORTED}[2] + {_SORTED}[3]) / 2"),
        "percentile_exc": ("=PERCENTILE.EXC({0,10,20,B1},0.5)", f"({_SORTED}[2] + {_SORTED}[3]) / 2"), "percentrank_exc": ("=PERCENTRANK.EXC({1,2,3,4},3)", "0.6"), "quartile": ("=QUARTILE({0,10,20,B1},1)", f"{_SORTED}[1] + 0.75::DOUBLE * ({_SORTED}[2] - {_SORTED}[1])"),
        "quartile_exc": ("=QUARTILE.EXC({1,2,3,4,5,6,7},1)", "2"), "median": ("=MEDIAN(0,10,20,B1)", f"({_SORTED}[2] + {_SORTED}[3]) / 2"), "stdev": ("=STDEV(B1:C1)", "abs(z - v) / sqrt(2)"), "stdevp": ("=STDEV.P(B1:C1)", "abs(z - v) / 2"), "var": ("=VAR(B1:C1)", "pow(z - v, 2) / 2"),
        "varp": ("=VAR.P(B1:C1)", "pow(z - v, 2) / 4"), "avedev": ("=AVEDEV(B1:C1)", "abs(z - v) / 2"), "devsq": ("=DEVSQ(B1:C1)", "pow(z - v, 2) / 2"), "harmean": ("=HARMEAN(B1:C1)", "2 / (1 / z + 1 / v)"), "geomean": ("=GEOMEAN(B1:C1)", "sqrt(z * v)"), "aggregate": ("=AGGREGATE(9,4,B1:C1)", "z + v"),
        "subtotal": ("=SUBTOTAL(3,B1:C1)", "2"), "subtotal6": ("=SUBTOTAL(6,B1:C1)", "z * v"), "mode": ("=MODE(B1,B1,C1)", "z"), "rank": ("=RANK(B1,{0,10,20,B1})", "1 + (z < 10)::INT + (z < 20)::INT"), "sumproduct": ("=SUMPRODUCT(B1:C1,{2,3})", "2 * z + 3 * v"),
    },
    "regression_functions": {
        "covar": ("=COVAR({1,2,3},{2,4,B1})", f"{SXY} / 3"), "covariance_s": ("=COVARIANCE.S({1,2,3},{2,4,B1})", f"{SXY} / 2"), "slope": ("=SLOPE({2,4,B1},{1,2,3})", f"{SXY} / 2"), "intercept": ("=INTERCEPT({2,4,B1},{1,2,3})", f"{MY} - {SXY}"),
        "rsq": ("=RSQ({2,4,B1+50},{1,2,3})", f"(pow({SXY}, 2) / 2 / {SYY})".replace("z", "(z + 50)")), "steyx": ("=STEYX({2,4,B1},{1,2,3})", f"sqrt(greatest({SYY} - pow({SXY}, 2) / 2, 0))"), "forecast": ("=FORECAST(5,{2,4,B1},{1,2,3})", f"{MY} + {SXY} * 3 / 2"),
        "correl": ("=CORREL({1,2,3},{2,4,B1+50})", f"({SXY} / sqrt(2 * {SYY}))".replace("z", "(z + 50)")), "skew_p": ("=SKEW.P({1,2},B1+5)", f"{_MOMENT(3)} / pow({_MOMENT(2)}, 1.5::DOUBLE)"), "standardize": ("=STANDARDIZE(C1,1000,50)", "(v - 1000) / 50"),
    },
    "distribution_functions": {
        "norm_dist": ("=NORM.DIST(B1,25,10,FALSE)", "exp(-pow((z - 25) / 10, 2) / 2) / sqrt(2 * pi()) / 10"), "phi": ("=PHI(B1/25)", "exp(-pow(z / 25, 2) / 2) / sqrt(2 * pi())"), "norm_s_dist": ("=NORM.S.DIST(1,TRUE)", "0.8413447460685429"), "gauss": ("=GAUSS(1)", "0.3413447460685429"),
        "norm_s_inv": ("=NORM.S.INV(0.975)*B1", "1.959963984540054::DOUBLE * z"), "norm_inv": ("=NORM.INV(0.975,B1,2)", "z + 2 * 1.959963984540054::DOUBLE"), "t_dist": ("=T.DIST(B1,1,TRUE)", "0.5::DOUBLE + atan(z) / pi()"), "t_dist_2t": ("=T.DIST.2T(B1,1)", "1 - 2 * atan(z) / pi()"),
        "t_dist_rt": ("=T.DIST.RT(B1,1)", "0.5::DOUBLE - atan(z) / pi()"), "t_inv": ("=T.INV(B1/60,1)", "tan(pi() * (z / 60 - 0.5::DOUBLE))"), "t_inv_2t": ("=T.INV.2T(B1/60,1)", "tan(pi() / 2 * (1 - z / 60))"), "tdist": ("=TDIST(B1,1,2)", "1 - 2 * atan(z) / pi()"),
        "binom_dist": ("=BINOM.DIST(2,5,B1/60,FALSE)", "10 * pow(z / 60, 2) * pow(1 - z / 60, 3)"), "binom_inv": ("=BINOM.INV(10,0.5,0.7)", "6"), "poisson": ("=POISSON.DIST(2,B1/10,FALSE)", "pow(z / 10, 2) * exp(-z / 10) / 2"), "gamma": ("=GAMMA(MOD(B1,10)+1)", "factorial((z % 10)::INT)"),
        "gammaln": ("=GAMMALN(B1)", "lgamma(z)"), "confidence": ("=CONFIDENCE(0.05,B1,100)", "1.959963984540054::DOUBLE * z / 10"), "confidence_t": ("=CONFIDENCE.T(0.05,B1,2)", "tan(pi() * 0.475::DOUBLE) * z / sqrt(2)"), "erf": ("=ERF(0.5)", "0.5204998778130465"), "erfc": ("=ERFC(0.5)", "0.4795001221869535"),
    },
    "text_and_time_functions": {
        "clean": ("=CLEAN(\"a\"&CHAR(7)&\"b\")", "@'ab'"), "concatenate": ("=CONCATENATE(B1,\"x\")", "@z::INT || 'x'"), "dollar": ("=DOLLAR(B1*1000,2)", "@format('${:,.2f}', z * 1000)"), "today": ("=AND(TODAY()>45000,INT(NOW())>=TODAY())", "@true"), "time": ("=TIME(MOD(B1,24),30,0)", "(z % 24 * 60 + 30) / 1440"),
        "timevalue": ("=TIMEVALUE(\"18:00:00\")", "0.75"), "hour": ("=HOUR(0.52)", "12"), "minute": ("=MINUTE(0.52)", "28"), "second": ("=SECOND(0.52)", "48"), "weeknum": ("=WEEKNUM(45291+B1)", "floor(z / 7) + 1"), "char": ("=CHAR(64+MOD(B1,26)+1)", "@chr((65 + z % 26)::INT)"),
        "search": ("=SEARCH(\"C\",\"abcabc\",MOD(B1,3)+1)", "3"), "fixed": ("=FIXED(B1*1000,1)", "@format('{:,.1f}', z * 1000)"), "roman": ("=ROMAN(MOD(B1,5)+1)", "@['I', 'II', 'III', 'IV', 'V'][(z % 5)::INT + 1]"), "arabic": ("=ARABIC(ROMAN(B1))", "z"),
    },
    "counting_and_reading_functions": {
        "sumifs": ("=SUMIFS(B1:C1,B1:C1,\">25\",B1:C1,\"<100\")", "CASE WHEN z > 25 THEN z ELSE 0 END"), "average": ("=AVERAGE(B1:C1,30)", "(z + v + 30) / 3"), "rank_avg": ("=RANK.AVG(B1,{10,20,B1})", "1 + (z < 10)::INT + (z < 20)::INT + ((z = 10)::INT + (z = 20)::INT) / 2"),
        "percentrank": ("=PERCENTRANK({1,2,3,4,5},4)", "0.75"), "skew": ("=SKEW({1,2},B1+5)", f"{_MOMENT(3)} / pow({_MOMENT(2)}, 1.5::DOUBLE) * sqrt(6)"), "kurt": ("=KURT({1,2,3,4,5})", "-1.2"), "trimmean": ("=TRIMMEAN({0,10,20,B1,1000},0.4)", "(30 + z) / 3"),
        "trim": ("=TRIM(\"  a \"&B1&\"  b \")", "@'a ' || z::INT || ' b'"), "value": ("=VALUE(B1&\".5\")", "z + 0.5"), "unichar": ("=UNICHAR(8364)&B1", "@chr(8364) || z::INT"), "unicode": ("=UNICODE(UNICHAR(200+B1))", "200 + z"),
        "textbefore": ("=TEXTBEFORE(B1&\"-x-y\",\"-\")", "@z::INT::VARCHAR"), "encodeurl": ("=ENCODEURL(\"a b/\"&B1)", "@'a%20b%2F' || z::INT"), "datevalue": ("=DATEVALUE(\"2024-01-15\")", "45306"), "workday": ("=WORKDAY(45292,B1)", "45292 + z + 2 * floor(z / 5)"),
    },
    "money_functions": {
        "xirr": ("=XIRR({-100,110},{0,365})", "0.1"), "nominal": ("=NOMINAL(0.12,B1)", "z * (pow(1.12::DOUBLE, 1 / z) - 1)"), "dollarfr": ("=DOLLARFR(1.125,16)", "1.02"), "dollarde": ("=DOLLARDE(1.02,16)", "1.125"), "irr": ("=IRR({-100,60,60})", "0.13066238629180748"), "mirr": ("=MIRR({-100,60,60},0.1,0.1)", "sqrt(1.26::DOUBLE) - 1"),
        "xnpv": ("=XNPV(0.1,{-100,110},{0,365})+B1", "z"), "rate": ("=RATE(1,-110,100)", "0.1"), "ddb": ("=DDB(100,10,5,2)", "24"), "cumprinc": ("=CUMPRINC(0.01,12,B1,1,12,0)", "-z"),
    },
    "radix_functions": {
        "bin2dec": ("=BIN2DEC(DEC2BIN(B1))", "z"), "bin2hex": ("=BIN2HEX(DEC2BIN(B1))", "@to_base(z::INT, 16)"), "bin2oct": ("=BIN2OCT(DEC2BIN(B1))", "@to_base(z::INT, 8)"), "hex2bin": ("=HEX2BIN(DEC2HEX(B1))", "@to_base(z::INT, 2)"), "hex2oct": ("=HEX2OCT(DEC2HEX(B1))", "@to_base(z::INT, 8)"),
        "oct2bin": ("=OCT2BIN(DEC2OCT(B1))", "@to_base(z::INT, 2)"), "oct2dec": ("=OCT2DEC(DEC2OCT(B1))", "z"), "oct2hex": ("=OCT2HEX(DEC2OCT(B1))", "@to_base(z::INT, 16)"), "rshift": ("=BITRSHIFT(B1,2)", "z::INT >> 2"), "decimal": ("=DECIMAL(BASE(B1,7),7)", "z"),
    },
    "complex_functions": {
        "complex": ("=COMPLEX(B1,2)", "@z::INT || '+2i'"), "imaginary": ("=IMAGINARY(COMPLEX(B1,2))", "2"), "imreal": ("=IMREAL(COMPLEX(B1,2))", "z"), "imabs": ("=IMABS(COMPLEX(B1,2))", "sqrt(z * z + 4)"), "argument": ("=IMARGUMENT(COMPLEX(B1,2))", "atan2(2, z)"),
        "conjugate": ("=IMCONJUGATE(COMPLEX(B1,2))", "@z::INT || '-2i'"), "cos": (f"=IMAGINARY(IMCOS({C}))", f"-sin({X}) * sinh({Y})"), "cosh": (f"=IMREAL(IMCOSH({C}))", f"cosh({X}) * cos({Y})"), "sin": (f"=IMAGINARY(IMSIN({C}))", f"cos({X}) * sinh({Y})"),
        "sinh": (f"=IMREAL(IMSINH({C}))", f"sinh({X}) * cos({Y})"), "tan": (f"=IMREAL(IMTAN({C}))", f"sin(2 * {X}) / (cos(2 * {X}) + cosh(2 * {Y}))"), "cot": (f"=IMREAL(IMCOT({C}))", f"sin(2 * {X}) / (cosh(2 * {Y}) - cos(2 * {X}))"),
        "sec": (f"=IMREAL(IMSEC({C}))", f"cos({X}) * cosh({Y}) / (pow(cos({X}) * cosh({Y}), 2) + pow(sin({X}) * sinh({Y}), 2))"), "sech": (f"=IMREAL(IMSECH({C}))", f"cosh({X}) * cos({Y}) / (pow(cosh({X}) * cos({Y}), 2) + pow(sinh({X}) * sin({Y}), 2))"),
        "csc": (f"=IMREAL(IMCSC({C}))", f"sin({X}) * cosh({Y}) / (pow(sin({X}) * cosh({Y}), 2) + pow(cos({X}) * sinh({Y}), 2))"), "csch": (f"=IMREAL(IMCSCH({C}))", f"sinh({X}) * cos({Y}) / (pow(sinh({X}) * cos({Y}), 2) + pow(cosh({X}) * sin({Y}), 2))"),
        "div": (f"=IMREAL(IMDIV({C},\"1+2i\"))", f"({X} + 2 * {Y}) / 5"), "exp": (f"=IMREAL(IMEXP({C}))", f"exp({X}) * cos({Y})"), "ln": (f"=IMREAL(IMLN({C}))", f"ln({X} * {X} + {Y} * {Y}) / 2"), "log10": (f"=IMREAL(IMLOG10({C}))", f"ln({X} * {X} + {Y} * {Y}) / 2 / ln(10)"),
        "log2": (f"=IMREAL(IMLOG2({C}))", f"ln({X} * {X} + {Y} * {Y}) / 2 / ln(2)"), "power": (f"=IMREAL(IMPOWER({C},2))", f"{X} * {X} - {Y} * {Y}"), "product": (f"=IMREAL(IMPRODUCT({C},\"1+2i\"))", f"{X} - 2 * {Y}"), "sqrt": (f"=IMREAL(IMSQRT({C}))", f"sqrt((sqrt({X} * {X} + {Y} * {Y}) + {X}) / 2)"),
        "sub": (f"=IMREAL(IMSUB({C},\"1+2i\"))", f"{X} - 1"), "sum": (f"=IMREAL(IMSUM({C},\"1+2i\"))", f"{X} + 1"),
    },
}


def _query(formulas: dict[str, tuple[str, str]]):  # noqa: ANN202
    return lambda s, d: by_formulas(read(s, d, "part"), "p_partkey", ["p_partkey", "p_size", "p_retailprice"], {f"f_{k}": f for k, (f, _) in formulas.items()})


def _sql(formulas: dict[str, tuple[str, str]]) -> str:
    shown = lambda e: e[1:] if e.startswith("@") else f"round(({e})::DOUBLE, 6)"
    columns = ", ".join(f"{shown(e)} AS f_{k}" for k, (_, e) in formulas.items())
    return f"WITH p AS (SELECT p_partkey, p_size::DOUBLE AS z, p_retailprice::DOUBLE AS v FROM part) SELECT p_partkey, {columns} FROM p"


QUERIES = {name: _query(formulas) for name, formulas in FORMULAS.items()}
ORACLE_SQL = {name: _sql(formulas) for name, formulas in FORMULAS.items()}
