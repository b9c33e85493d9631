"""The criteria of the ...IF functions: an operator and a value, or a pattern with * and ?."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellarium.functions.values import shown

RULE = re.compile(r"^(>=|<=|<>|!=|>|<|=)(.+)$", re.S)


def pattern(text: str) -> str:
    """A regular expression for a whole text with wildcards, in any case."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text) + "$"


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def meets(n: Column, t: Column, criterion: object) -> Column:
    """Whether a cell with number n or text t meets a criterion known when the plan is made."""
    false = F.lit(False)
    if isinstance(criterion, bool) or not isinstance(criterion, (str, int, float)):
        return false
    if not isinstance(criterion, str):
        return F.coalesce(n == float(criterion), false)
    if rule := RULE.match(criterion):
        sign, right = rule[1].replace("!=", "<>"), rule[2]
        value = _number(right)
        left, other = (n, t) if value is not None else (t, n)
        value = F.lit(value) if value is not None else F.lit(right)
        if sign in ("=", "<>"):
            same = F.coalesce((F.lower(left) == F.lower(value)) if left is t else left == value, false)
            return same if sign == "=" else (n.isNotNull() | t.isNotNull()) & ~same
        test = {">": left > value, "<": left < value, ">=": left >= value, "<=": left <= value}[sign]
        return F.coalesce(test, false)
    value = _number(criterion)
    text = F.coalesce(t, shown(n))
    found = F.coalesce(text.rlike(pattern(criterion)), false)
    return found | F.coalesce(n == value, false) if value is not None else found


def meets_column(n: Column, t: Column, criterion: Column) -> Column:
    """The same for a criterion that is a column of text."""
    sign = F.regexp_extract(criterion, r"^(>=|<=|<>|!=|>|<|=)", 1)
    right = F.substring(criterion, F.length(sign) + 1, F.length(criterion))
    value = right.try_cast("double")
    equal = F.when(value.isNotNull(), F.coalesce(n == value, F.lit(False))).otherwise(F.coalesce(F.lower(t) == F.lower(right), F.lit(False)))
    more, less = F.coalesce(n > value, t > right, F.lit(False)), F.coalesce(n < value, t < right, F.lit(False))
    more, less = (F.when(value.isNotNull(), F.coalesce(x, F.lit(False))).otherwise(F.coalesce(y, F.lit(False))) for x, y in ((n > value, t > right), (n < value, t < right)))
    quoted = F.regexp_replace(criterion, r"([\\\[\](){}.+^$|])", r"\\$1")
    regex = F.concat(F.lit("(?is)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    plain = F.coalesce(F.regexp_like(F.coalesce(t, shown(n)), regex), F.lit(False)) | F.coalesce(n == criterion.try_cast("double"), F.lit(False))
    return (
        F.when(sign == "", plain).when(sign == "=", equal).when(sign.isin("<>", "!="), (n.isNotNull() | t.isNotNull()) & ~equal)
        .when(sign == ">", more).when(sign == "<", less).when(sign == ">=", more | equal).otherwise(less | equal)
    )
