"""The classifier of formulas: ordered rules, of which the first that a formula's functions meet gives its class.

A rule names its functions, has a pattern for their names, or takes those of a kind that no other rule names. All names under which the
registry knows a function go with it, as do names it knows without computing them. Formulas without functions are classified by their
operators and operands. What uses only names that no rule has is UNRESOLVED. Functions of the user's own have the class they were added
with and count after all rules.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions import registry as R
from cellarium.functions import user
from cellarium.functions.library import FUNCTIONS


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    functions: str = ""
    pattern: str = "(?!)"
    rest: tuple[str, ...] = ()


# The rules in the order in which they are tried, with the functions that each is defined by.
RULES = (
    Rule("sum", "AGGREGATION", "SUM SUBTOTAL AGGREGATE SUMPRODUCT SUMSQ SUMX2MY2 SUMX2PY2 SUMXMY2"),
    Rule("average", "AGGREGATION", "AVERAGE AVERAGEA TRIMMEAN GEOMEAN HARMEAN"),
    Rule("count", "AGGREGATION", "COUNT COUNTA COUNTBLANK"),
    Rule("countif", "AGGREGATION", "COUNTIF COUNTIFS"),
    Rule("sumif", "AGGREGATION", "SUMIF SUMIFS AVERAGEIF AVERAGEIFS"),
    Rule("min_max", "AGGREGATION", "MIN MAX MINA MAXA MINIFS MAXIFS"),
    Rule("statistical", "AGGREGATION", R.STATISTICAL + "FISHER FISHERINV FREQUÊNCIA CRESCIMENTO TENDÊNCIA PROJ.LIN PROJ.LOG", rest=("AGGREGATION", "RANKING")),
    Rule("if_simple", "CONDITIONAL", "IF"),
    Rule("if_nested", "CONDITIONAL", "IFS IFERROR IFNA SWITCH"),
    Rule("boolean_operators", "CONDITIONAL", "AND OR NOT XOR TRUE FALSE"),
    Rule("is_functions", "CONDITIONAL", "ISREF ISFORMULA ÉREF ÉFÓRMULA NA TYPE ERROR.TYPE INFO", rest=("CONDITIONAL",)),
    Rule("vlookup", "LOOKUP", "VLOOKUP HLOOKUP LOOKUP"),
    Rule("index_match", "LOOKUP", "INDEX MATCH XLOOKUP XMATCH"),
    Rule(
        "reference",
        "LOOKUP",
        """OFFSET INDIRECT ADDRESS ROW ROWS COLUMN COLUMNS AREAS CHOOSE TRANSPOSE GETPIVOTDATA HYPERLINK FORMULATEXT
        DESLOC INDIRETO INFODADOSTABELADINÂMICA FÓRMULATEXTO""",
    ),
    Rule("dynamic_array", "LOOKUP", R.ARRAY.replace("MUNIT", "") + "LET MATRIZALEATÓRIA", rest=("LOOKUP",)),
    Rule("date_extraction", "DATE_LOGIC", "YEAR MONTH DAY WEEKDAY WEEKNUM ISOWEEKNUM HOUR MINUTE SECOND"),
    Rule("date_arithmetic", "DATE_LOGIC", rest=("DATE_LOGIC",)),
    Rule("now_today", "DATE_LOGIC", "NOW TODAY"),
    Rule("text_case", "TEXT_TRANSFORMATION", "UPPER LOWER PROPER TRIM CLEAN LEN UNICODE UNICHAR CHAR CODE ASC DBCS JIS PHONETIC BAHTTEXT"),
    Rule("text_extraction", "TEXT_TRANSFORMATION", "LEFT RIGHT MID TEXTAFTER TEXTBEFORE TEXTSPLIT REGEXEXTRACT REGEXREPLACE REGEXTEST"),
    Rule("text_join", "TEXT_TRANSFORMATION", "CONCATENATE CONCAT TEXTJOIN ARRAYTOTEXT REPT"),
    Rule("text_search", "TEXT_TRANSFORMATION", "FIND SEARCH SUBSTITUTE REPLACE EXACT"),
    Rule("text_format", "TEXT_TRANSFORMATION", rest=("TEXT_TRANSFORMATION",)),
    Rule("rank", "RANKING", "RANK RANK.AVG"),
    Rule("large_small", "RANKING", "LARGE SMALL"),
    Rule("comparison_operators", "THRESHOLD_LOGIC"),
    Rule("rounding", "THRESHOLD_LOGIC", rest=("THRESHOLD_LOGIC",)),
    Rule("abs_sign", "THRESHOLD_LOGIC", "ABS SIGN MOD QUOTIENT DELTA GESTEP"),
    Rule("basic_arithmetic", "ARITHMETIC"),
    Rule("math_functions", "ARITHMETIC", "MUNIT", rest=("ARITHMETIC",)),
    Rule(
        "financial",
        "ARITHMETIC",
        R.FINANCIAL
        + """CUMIPMT CUMPRINC DDB DOLLARDE DOLLARFR EFFECT FV IPMT IRR ISPMT MIRR NOMINAL NPER NPV PDURATION PMT PPMT PV RATE RRI SLN
        SYD XIRR XNPV""",
    ),
    Rule("engineering", "ARITHMETIC", pattern="(BIN|DEC|HEX|OCT)2(BIN|DEC|HEX|OCT)|BIT(AND|OR|XOR|[LR]SHIFT)|IM(?!AGE)[A-Z0-9]+|ERFC?|BESSEL[IJKY]|CONVERT|COMPLEX"),
    Rule("database", "AGGREGATION", R.DATABASE, pattern="BD[A-ZÁÉÍ]+"),
)

ARITHMETIC_SIGNS, COMPARISON_SIGNS = ("+", "-", "*", "/", "^", "%"), ("=", "<>", "<", ">", "<=", ">=")
#: Of formulas without functions, and of those that use another file.
INLINE, REFERENCE, EXTERNAL, OWN = "inline_arithmetic", "cell_reference", "external_ref", "user_function"


def places() -> dict[str, int]:
    """The place among RULES of each function name that has a rule."""
    named = {n: i for i, r in reversed(list(enumerate(RULES))) for n in r.functions.split()}
    rest = {kind: i for i, r in enumerate(RULES) for kind in r.rest}
    own, out = set(user.added()), {}
    for name in sorted(FUNCTIONS.keys() | R.KNOWN | named.keys()):
        function = FUNCTIONS.get(name)
        first = function.name if function else name
        if name in own:
            continue
        place = named.get(name, named.get(first))
        if place is None:
            place = next((i for i, r in enumerate(RULES) if re.fullmatch(r.pattern, first)), rest.get(function.kind) if function else None)
        if place is not None:
            out[name] = place
    return out


def classified(functions: Column, operators: Column, operands: Column, external: Column, failed: Column) -> dict[str, Column]:
    """class, rule and matched (the first by name of the functions that the rule was met by) of formulas, as expressions over what
    graph.parsed found in them. The names' places are a constant of the plan, of the size of the registry."""
    known = places()
    kinds = {name: FUNCTIONS[name].kind for name in user.added()}
    table = F.from_json(F.lit(json.dumps(known)), "map<string,int>")
    own = F.from_json(F.lit(json.dumps(kinds)), "map<string,string>")
    plain = F.transform(F.array_sort(functions), lambda f: F.regexp_replace(F.upper(f), r"^_XLFN\.", ""))
    place = F.array_min(F.transform(plain, lambda f: F.try_element_at(table, f)))
    users = F.filter(plain, lambda f: F.try_element_at(own, f).isNotNull())
    rules = F.array(*(F.struct(F.lit(r.kind).alias("class"), F.lit(r.name).alias("rule")) for r in RULES))
    none = F.size(functions) == 0

    def answer(kind: Column | str, rule: str | None) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("class"), F.lit(rule).cast("string").alias("rule"))

    def signs(those: tuple[str, ...]) -> Column:
        return none & F.arrays_overlap(operators, F.array(*map(F.lit, those)))

    found = (
        F.when(external, answer("EXTERNAL_REF", EXTERNAL))
        .when(failed, answer("UNRESOLVED", None))
        .when(place.isNotNull(), F.get(rules, place))
        .when(F.size(users) > 0, answer(F.try_element_at(own, F.get(users, F.lit(0))), OWN))
        .when(signs(ARITHMETIC_SIGNS), answer("ARITHMETIC", INLINE))
        .when(signs(COMPARISON_SIGNS), answer("THRESHOLD_LOGIC", "comparison_operators"))
        .when(signs(("&",)), answer("TEXT_TRANSFORMATION", "text_join"))
        .when(none & (operands == 1), answer("ARITHMETIC", REFERENCE))
        .otherwise(answer("UNRESOLVED", None))
    )
    met = F.filter(plain, lambda f: F.when(place.isNotNull(), F.try_element_at(table, f) == place).otherwise(F.try_element_at(own, f).isNotNull()))
    matched = F.when(~external & ~failed, F.get(met, F.lit(0)))
    return {"class": found["class"], "rule": found["rule"], "matched": matched}


def rule(names: list[str]) -> tuple[str, str | None]:
    """The class and the rule of functions alone; of none, as of a formula of arithmetic."""
    plain = sorted(n.upper().removeprefix("_XLFN.") for n in names)
    known = places()
    place = min((known[n] for n in plain if n in known), default=None)
    if place is not None:
        return RULES[place].kind, RULES[place].name
    own = next((n for n in plain if n in user.added()), None)
    if own:
        return FUNCTIONS[own].kind, OWN
    return ("ARITHMETIC", INLINE) if not plain else ("UNRESOLVED", None)
