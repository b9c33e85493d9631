"""Formulas against expected values, evaluated in one plan for each group."""

import pytest

from cellarium.functions import formula as X
from cellarium.functions import library
from cellarium.functions import values as V
from cellarium.functions.registry import classify

CASES = {
    "operators": [("=1+2*3", 7), ("=-2^2", 4), ("=2^3^2", 64), ("=10%", 0.1), ('="a"&1', "a1"), ("=7/0", "#DIV/0!"), ("=IFERROR(7/0,5)", 5), ("=1=\"1\"", False), ('="a"="A"', True), ("=1+\"x\"", "#VALUE!"), ("=(1+2)*3", 9), ("=2<>3", True), ("=TRUE+1", 2)],
    "logic": [('=IF(1>2,1,"n")', "n"), ("=IFS(FALSE,1,TRUE,2)", 2), ('=SWITCH(2,1,"a",2,"b","z")', "b"), ("=AND(TRUE,1)", True), ("=XOR(TRUE,TRUE)", False), ("=IFNA(NA(),3)", 3), ("=NOT(FALSE)", True), ("=LET(x,2,x*3)", 6), ("=IFS(FALSE,1)", "#N/A"), ("=SE(1,2,3)", 2)],
    "math": [("=MOD(7,-3)", -2), ("=ROUND(2.5,0)", 3), ("=ROUND(2.675,2)", 2.68), ("=ROUNDUP(-2.1,0)", -3), ("=TRUNC(-2.7)", -2), ("=FACT(5)", 120), ("=COMBIN(5,2)", 10), ("=GCD(12,18)", 6), ("=LCM(4,6)", 12), ("=EVEN(3)", 4), ("=ODD(2)", 3),
             ("=SQRT(-1)", "#NUM!"), ("=MULTINOMIAL(2,3)", 10), ("=SERIESSUM(2,0,1,{1,2})", 5), ("=FACTDOUBLE(7)", 105), ("=ROMAN(1994)", "MCMXCIV"), ('=ARABIC("MCMXCIV")', 1994), ("=CEILING(7,5)", 10), ("=ATAN2(1,1)", 0.785398)],
    "ranges": [("=SUM({1,2,3},4)", 10), ("=AVERAGE({1,2,3})", 2), ('=COUNTIF({1,5,9},">4")', 2), ('=SUMIF({1,5,9},">4")', 14), ('=SUMIFS({1,2,3},{4,5,6},">4")', 5), ('=COUNTIF({"apple","pear"},"a*")', 1), ("=SUMPRODUCT({1,2},{3,4})", 11), ("=SUBTOTAL(9,{1,2,3})", 6),
               ("=LARGE({1,5,3},2)", 3), ("=LARGE({1,5,3},4)", "#NUM!"), ("=RANK(5,{1,5,3})", 1), ("=RANK.AVG(5,{5,5,3})", 1.5), ("=PERCENTILE({1,2,3,4},0.5)", 2.5), ("=MEDIAN(1,2,9)", 2), ("=MODE(1,2,2)", 2), ("=STDEV(1,2,3)", 1), ("=STDEV(1)", 0)],
    "statistics": [("=SLOPE({2,4,6},{1,2,3})", 2), ("=CORREL({1,2,3},{2,4,6})", 1), ("=SKEW(3,4,5,2,3,4,5,6,4,7)", 0.359543), ("=KURT(3,4,5,2,3,4,5,6,4,7)", -0.1518), ("=GEOMEAN(4,9)", 6), ("=NORM.S.DIST(1,TRUE)", 0.841345), ("=NORM.INV(0.5,3,2)", 3), ("=T.DIST(2,10,TRUE)", 0.963306),
                   ("=BINOM.DIST(2,5,0.5,FALSE)", 0.3125), ("=POISSON(2,3,FALSE)", 0.224042), ("=GAMMA(5)", 24), ("=TRIMMEAN({1,2,3,100},0.5)", 2.5), ("=PERCENTRANK({1,2,3,4},3)", 0.666)],
    "text": [('=PROPER("o\'brien x-ray")', "O'Brien X-Ray"), ('=TRIM("  a   b ")', "a b"), ('=FIND("z","abc")', "#VALUE!"), ('=SEARCH("B?","abc")', 2), ('=SUBSTITUTE("a-b-c","-","+",2)', "a-b+c"), ('=REPLACE("abcd",2,2,"X")', "aXd"), ("=UNICHAR(8364)", "€"), ('=TEXTJOIN(",",TRUE,"a","","b")', "a,b"),
             ('=TEXT(1234.5,"#,##0.00")', "1,234.50"), ('=TEXT(45292,"yyyy-mm-dd")', "2024-01-01"), ('=TEXTBEFORE("a-b-c","-",2)', "a-b"), ('=ENCODEURL("a b")', "a%20b"), ('=VALUE("1,5")', 1.5), ("=FIXED(1234.567,1)", "1,234.6")],
    "dates": [("=DATE(2024,1,1)", 45292), ("=DATE(2024,13,1)", 45658), ("=YEAR(45292)", 2024), ("=WEEKDAY(45292)", 2), ("=EDATE(45322,1)", 45351), ("=EOMONTH(45292,1)", 45351), ('=DATEDIF(45292,45350,"M")', 1), ("=DAYS360(45292,45658)", 360), ("=NETWORKDAYS(45292,45296)", 5), ("=WORKDAY(45292,5)", 45299), ("=HOUR(0.75)", 18), ('=DATEVALUE("x")', "#VALUE!")],
    "lookup": [('=VLOOKUP(2,{1,"a";2,"b"},2,FALSE)', "b"), ('=VLOOKUP(9,{1,"a";2,"b"},2)', "#N/A"), ('=HLOOKUP(2,{1,2;"x","y"},2)', "y"), ("=INDEX({1,2;3,4},2,1)", 3), ("=INDEX({1,2},9)", "#REF!"), ("=MATCH(6,{1,5,9})", 2), ('=XLOOKUP(7,{1,2},{3,4},"no")', "no"), ('=LOOKUP(6,{1,5,9},{"a","b","c"})', "b"), ("=ADDRESS(2,28)", "$AB$2"), ("=SUM(FILTER({1,5,9},{0,1,1}))", 14), ("=SUM(UNIQUE({1,1,2}))", 3)],
    "finance": [("=PMT(0.01,12,1000)", -88.8488), ("=RATE(12,-88.8488,1000)", 0.01), ("=IRR({-100,60,60})", 0.130662), ("=NPV(0.1,100,100)", 173.5537), ("=MIRR({-100,60,60},0.1,0.1)", 0.122497), ("=DDB(100,10,5,2)", 24), ("=IPMT(0.01,1,12,1000)", -10), ("=XNPV(0.1,{-100,110},{0,365})", 0), ("=DOLLARDE(1.02,16)", 1.125)],
    "engineering": [("=DEC2BIN(-2)", "1111111110"), ('=HEX2DEC("FF")', 255), ('=HEX2DEC("XYZ")', "#NUM!"), ("=BITAND(12,10)", 8), ('=CONVERT(100,"C","F")', 212), ('=CONVERT(1,"km","kg")', "#N/A"), ('=CONVERT(1,"kcal","J")', 4186.8), ('=CONVERT(1,"Gbit","Mbit")', 1000), ('=CONVERT(2,"MW","kW")', 2000), ('=ROMAN(3999)', "MMMCMXCIX"), ('=ARABIC("-MCMXCIV")', -1994), ("=ERF(1)", 0.842701), ('=IMABS("3+4i")', 5), ('=IMSUM("1+i","2-3i")', "3-2i"), ("=BASE(255,16)", "FF"), ('=DECIMAL("FF",16)', 255)],
    "names": [("=FOO(1)", "#NAME?"), ("=BESSELI(1,2)", "#UNSUPPORTED!"), ("=DISCOUNT(1)", "#NAME?"), ("=PRICELIST(1)", "#NAME?"), ("=_xlfn.BYROW(1,2)", "#UNSUPPORTED!"), ('=_xlfn.SWITCH(1,1,"a")', "a"), ("=SOMA(1,2)", 3), ("=[Book.xlsx]S!A1", "#EXT!"), ("=MÉDIA(1,3)", 2), ("=PROCV(1,{1,5},2)", 5), ("=SUM()", "#VALUE!")],
}


@pytest.mark.parametrize("group", CASES)
def test_formulas(spark, group):
    columns = [V.scalar(X.compile_formula(f)).struct().cast(V.CELL).alias(f"c{i}") for i, (f, _) in enumerate(CASES[group])]
    row = spark.range(1).select(*columns).first()
    for (formula, want), c in zip(CASES[group], row, strict=True):
        got = next((x for x in (c.e, c.t, c.b, c.n) if x is not None), None)
        assert type(got) is type(want) and got == want if isinstance(want, (str, bool)) else got == pytest.approx(want, rel=1e-5, abs=1e-5), formula


def test_one_registry():
    assert len(library.FUNCTIONS) > 560 and library.FUNCTIONS["SOMASE"].name == "SUMIF"
    assert classify(["SUM", "IF"]) == "AGGREGATION" and classify(["FOO"]) == "UNRESOLVED" and classify([]) == "ARITHMETIC"


@pytest.mark.parametrize("text", ["=1+", "=SUM(1", "=)", "={1", "=A1 B2"])
def test_what_is_no_formula(text):
    with pytest.raises(X.FormulaError):
        X.parse(text)


def test_references():
    ref = X.refs(X.parse("='My Sheet'!$A$1:B3"))[0]
    assert (ref.sheet, ref.top, ref.left, ref.bottom, ref.right) == ("My Sheet", 1, 1, 3, 2)
    assert X.refs(X.parse("=SUM(A:C)"))[0].bottom is None
    assert X.template(X.parse("=A1+$B2"), 1, 3) == X.template(X.parse("=A7+$B8"), 7, 3)
    assert X.constants(X.parse('=A1*1.1+"2"')) == [1.1]


def test_languages():
    assert X.english("=SE(A1>1;SOMA(B1:B2);\"x;y\")") == '=IF(A1>1,SUM(B1:B2),"x;y")' and X.english("={1;2}") == "={1;2}"
    assert X.locale(["=SOMA(A1)", "=MÉDIA(A1)"]) == "pt-BR" and X.locale(["=SUM(A1)", "=IF(1,2,3)"]) == "en-US"


def test_rules_of_the_classifier():
    from cellarium.functions import rules as U
    from cellarium.functions.library import FUNCTIONS

    assert len(U.RULES) == 33 and len({r.name for r in U.RULES}) == 33
    assert FUNCTIONS.keys() <= U.places().keys()  # whatever is computed is classified
    assert U.rule(["IF", "SUM"]) == ("AGGREGATION", "sum") and U.rule(["SE", "SOMA"]) == ("AGGREGATION", "sum")
    assert U.rule(["_XLFN.XLOOKUP"]) == ("LOOKUP", "index_match") and U.rule(["DESLOC"]) == ("LOOKUP", "reference")
    assert U.rule(["BDMÍN"]) == ("AGGREGATION", "database") and U.rule(["BDD"]) == ("ARITHMETIC", "financial")
    assert U.rule(["FOO"]) == ("UNRESOLVED", None) and U.rule(["FOO", "PMT"]) == ("ARITHMETIC", "financial")
    assert U.rule(["IMAGE"]) == ("UNRESOLVED", None) and U.rule(["IMSUM"]) == ("ARITHMETIC", "engineering")


def test_formulas_that_are_no_formulas_are_unresolved(spark):
    from cellarium.operators import graph as G
    from cellarium.plans import workbook as W

    texts = ["=A1+", "=1", '="a"&B2', "=A1=B1", "=-A1", "=A1%", "=TRUE", "=(A1)", "=A1:B2", "=NAMED", "=sum(A1)"]
    rows = [("f", "s", i + 1, 1, None, None, None, None, t) for i, t in enumerate(texts)]
    cells = spark.createDataFrame(rows, "file string, sheet string, row int, col int, num double, txt string, bool boolean, err string, formula string")
    found = {r.formula: (r["class"], r.rule, r.matched) for r in W.pattern_classes(G.parsed(cells)).collect()}
    reference, inline = ("ARITHMETIC", "cell_reference", None), ("ARITHMETIC", "inline_arithmetic", None)
    assert found == {
        "=A1+": ("UNRESOLVED", None, None), "=1": reference, '="a"&B2': ("TEXT_TRANSFORMATION", "text_join", None), "=A1=B1": ("THRESHOLD_LOGIC", "comparison_operators", None),
        "=-A1": inline, "=A1%": inline, "=TRUE": reference, "=(A1)": reference, "=A1:B2": reference, "=NAMED": reference, "=sum(A1)": ("AGGREGATION", "sum", "SUM"),
    }
