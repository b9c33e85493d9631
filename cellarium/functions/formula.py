"""Formulas: tokens, syntax tree, references, and compilation to columns."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import functions as F

from cellarium.functions import values as V
from cellarium.functions.values import Val

TOKEN = re.compile(
    r"""(?P<space>\s+)
  | (?P<text>"(?:[^"]|"")*")
  | (?P<error>\#(?:DIV/0!|VALUE!|N/A|NUM!|REF!|NAME\?|NULL!))
  | (?P<external>'?\[[^\]]+\][^!]*!\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)
  | (?P<ref>(?:(?:'(?:[^']|'')+'|[\w.]+)!)?\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?(?![\w(.]))
  | (?P<columns>(?:(?:'(?:[^']|'')+'|[\w.]+)!)?\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w(.]))
  | (?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<call>[^\W\d][\w.]*(?=\s*\())
  | (?P<name>[^\W\d][\w.]*)
  | (?P<op><>|<=|>=|[-+*/^&=<>%(),;{}])""",
    re.X,
)
CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d+)$")


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int


def tokens(formula: str) -> list[Token]:
    text, at, out = formula.strip(), 0, []
    start = 1 if text.startswith("=") else 0
    at = start
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"{text!r}: {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


@dataclass(frozen=True)
class Ref:
    """A rectangle of cells; a cell is one of one row and column. Open columns have no last row. fixed says which of its sides
    (top, left, bottom, right) stay where they are when the formula is filled down or across."""

    sheet: str | None
    top: int
    left: int
    bottom: int | None
    right: int
    fixed: tuple[bool, bool, bool, bool] = (False, False, False, False)

    @property
    def single(self) -> bool:
        """One cell, and one in each cell that the formula is filled into."""
        return (self.top, self.left) == (self.bottom, self.right) and self.fixed[:2] == self.fixed[2:]

    @property
    def steady(self) -> bool:
        """Of one shape in each cell that the formula is filled into."""
        return self.bottom is not None and self.fixed[:2] == self.fixed[2:]


@dataclass(frozen=True)
class Node:
    kind: str  # literal, ref, call, unary, binary, percent, array, error
    value: object
    args: tuple = ()


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def parse_ref(text: str) -> Ref:
    sheet, _, area = text.rpartition("!")
    sheet = sheet.strip("'").replace("''", "'") or None
    a, _, b = area.partition(":")
    sides = sorted(((column_number(re.sub(r"[$\d]", "", x)), x.startswith("$")) for x in (a, b or a)), key=lambda s: s[0])
    (left, left_fixed), (right, right_fixed) = sides
    if not re.search(r"\d", area):
        return Ref(sheet, 1, left, None, right, (True, left_fixed, True, right_fixed))
    ends = sorted(((int(CELL.match(x)[2]), "$" in x[1:]) for x in (a, b or a)), key=lambda s: s[0])
    (top, top_fixed), (bottom, bottom_fixed) = ends
    return Ref(sheet, top, left, bottom, right, (top_fixed, left_fixed, bottom_fixed, right_fixed))


class _Parser:
    """Operator precedence: comparison, &, + -, * /, ^, sign, %. A sign binds closer than a power, as in spreadsheets."""

    LEVELS = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}

    def __init__(self, formula: str) -> None:
        self.formula, self.tokens, self.at = formula, tokens(formula), 0

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, value: str | None = None) -> Token:
        token = self.peek()
        if token is None or value is not None and token.value != value:
            raise FormulaError(f"{self.formula!r}: expected {value or 'more'} at token {self.at}")
        self.at += 1
        return token

    def expression(self, level: int = 1) -> Node:
        left = self.signed()
        while (token := self.peek()) and token.kind == "op" and self.LEVELS.get(token.value, 0) >= level:
            self.take()
            left = Node("binary", token.value, (left, self.expression(self.LEVELS[token.value] + 1)))
        return left

    def signed(self) -> Node:
        token = self.peek()
        if token and token.kind == "op" and token.value in "+-":
            self.take()
            return Node("unary", token.value, (self.signed(),))
        node = self.atom()
        while (token := self.peek()) and token.value == "%":
            self.take()
            node = Node("percent", "%", (node,))
        return node

    def atom(self) -> Node:
        token = self.take()
        match token.kind:
            case "number":
                return Node("literal", float(token.value))
            case "text":
                return Node("literal", token.value[1:-1].replace('""', '"'))
            case "error":
                return Node("error", token.value)
            case "external":
                return Node("error", V.EXT)
            case "ref" | "columns":
                return Node("ref", parse_ref(token.value))
            case "name":
                known = {"TRUE": True, "FALSE": False, "VERDADEIRO": True, "FALSO": False}
                return Node("literal", known[token.value.upper()]) if token.value.upper() in known else Node("name", token.value)
            case "call":
                return Node("call", token.value.upper(), tuple(self.arguments()))
        if token.value == "(":
            node = self.expression()
            self.take(")")
            return node
        if token.value == "{":
            rows = [[]]
            while True:
                rows[-1].append(self.expression())
                sign = self.take()
                if sign.value == "}":
                    return Node("array", (len(rows), len(rows[0])), tuple(x for r in rows for x in r))
                if sign.value == ";":
                    rows.append([])
        raise FormulaError(f"{self.formula!r}: {token.value!r} at {token.at}")

    def arguments(self) -> Iterator[Node]:
        self.take("(")
        if self.peek() and self.peek().value == ")":
            self.take()
            return
        while True:
            token = self.peek()
            yield Node("literal", None) if token and token.value in (",", ";", ")") else self.expression()
            sign = self.take().value
            if sign == ")":
                return
            if sign not in (",", ";"):
                raise FormulaError(f"{self.formula!r}: {sign!r} between arguments")


def parse(formula: str) -> Node:
    parser = _Parser(formula)
    node = parser.expression()
    if parser.peek():
        raise FormulaError(f"{formula!r}: {parser.peek().value!r} is left over")
    return node


def refs(node: Node) -> list[Ref]:
    own = [node.value] if node.kind == "ref" else []
    return own + [r for a in node.args for r in refs(a)]


def calls(node: Node) -> list[str]:
    own = [node.value] if node.kind == "call" else []
    return own + [c for a in node.args for c in calls(a)]


def constants(node: Node) -> list[float]:
    """Numbers written in the formula."""
    own = [node.value] if node.kind == "literal" and isinstance(node.value, float) else []
    return own + [c for a in node.args for c in constants(a)]


def signs(formula: str) -> list[str]:
    """The distinct operators of the formula."""
    return sorted({t.value for t in tokens(formula) if t.kind == "op"})


def operands(node: Node) -> int:
    """References, literals and names in the formula."""
    return int(node.kind not in ("call", "op") and not node.args) + sum(operands(a) for a in node.args)


def density(formula: str) -> float:
    """Kinds of tokens for each token: near 1 for plain formulas, low for long ones of the same few kinds."""
    found = [t.kind for t in tokens(formula)]
    return len(set(found)) / max(1, len(found))


def template(node: Node, row: int, column: int) -> str:
    """The formula relative to its cell, but for fixed sides: equal for cells that were filled down or across."""

    def place(r: Ref) -> str:
        side = lambda at, fixed, own: f"{at}" if fixed else f"[{at - own}]"
        top, left, bottom, right = r.fixed
        rows = ("", "") if r.bottom is None else (f"R{side(r.top, top, row)}", f"R{side(r.bottom, bottom, row)}")
        return f"{r.sheet or ''}!{rows[0]}C{side(r.left, left, column)}:{rows[1]}C{side(r.right, right, column)}"

    if node.kind == "ref":
        return place(node.value)
    return f"{node.kind}({node.value!r}{''.join(',' + template(a, row, column) for a in node.args)})"


_column = functools.lru_cache(20_000)(column_number)
QUOTED = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*')""")
PLACED = re.compile(r"(?<![\w.$])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![\w(.!])")
COLUMNS = re.compile(r"(?<![\w.])\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w(.])")


def kind(text: str, row: int, column: int) -> str | None:
    """A text that is equal for formulas that differ only in the cells that they are filled into, found without parsing; None
    for formulas of other books and of whole columns, which are parsed one by one."""
    if "[" in text or "\0" in text or ":" in text and COLUMNS.search(text):
        return None

    def place(m: re.Match) -> str:
        fixed, letters, steady, digits = m.groups()
        c, r = _column(letters), int(digits)
        return f"\0{fixed}{c if fixed else c - column}\0{steady}{r if steady else r - row}\0"

    if '"' not in text and "'" not in text:
        return PLACED.sub(place, text)
    return "".join(p if i % 2 else PLACED.sub(place, p) for i, p in enumerate(QUOTED.split(text)))


Bind = Callable[[Ref], Val]


def _arithmetic(sign: str, a: Val, b: Val) -> Val:
    (x, ex), (y, ey) = V.to_num(a), V.to_num(b)
    e = V.first_error(ex, ey)
    if sign == "/":
        return V.guard(Val(n=F.try_divide(x, y), e=e), (y == 0, V.DIV0))
    if sign == "^":
        out = F.pow(x, y)
        return V.guard(Val(n=out, e=e), (F.isnan(out) | (F.abs(out) == float("inf")), V.NUM))
    return V.guard(Val(n={"+": x + y, "-": x - y, "*": x * y}[sign], e=e))


def _compare(sign: str, a: Val, b: Val) -> Val:
    """Numbers come before text, text before truth values; text is compared in any case, and a blank is like the other."""
    a, b = V.scalar(a), V.scalar(b)
    null = F.lit(None)
    n = lambda v: v.n if v.n is not None else null.cast("double")
    t = lambda v: F.lower(v.t) if v.t is not None else null.cast("string")
    t_ = lambda v: v.b.cast("int") if v.b is not None else null.cast("int")
    rank = lambda v: F.when(n(v).isNotNull(), 1).when(t(v).isNotNull(), 2).when(t_(v).isNotNull(), 3).otherwise(0)
    ra, rb = rank(a), rank(b)
    blank_a, blank_b = (ra == 0) & (rb != 0), (rb == 0) & (ra != 0)
    na, nb = F.when(blank_a, F.lit(0.0)).otherwise(n(a)), F.when(blank_b, F.lit(0.0)).otherwise(n(b))
    ta, tb = F.when(blank_a, F.lit("")).otherwise(t(a)), F.when(blank_b, F.lit("")).otherwise(t(b))
    ba, bb = F.when(blank_a, F.lit(0)).otherwise(t_(a)), F.when(blank_b, F.lit(0)).otherwise(t_(b))
    kind = F.greatest(ra, rb)
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    same = (ra == rb) | (ra == 0) | (rb == 0)
    way = F.when(~same, order(ra, rb)).when(kind == 1, order(na, nb)).when(kind == 2, order(ta, tb)).when(kind == 3, order(ba, bb)).otherwise(0)
    test = {"=": way == 0, "<>": way != 0, "<": way < 0, ">": way > 0, "<=": way <= 0, ">=": way >= 0}[sign]
    return V.guard(Val(b=test, e=V.first_error(a.e, b.e)))


def compile_node(node: Node, bind: Bind, names: dict[str, Val] | None = None) -> Val:
    from cellarium.functions import library

    names = names or {}
    match node.kind:
        case "literal":
            return V.literal(node.value)
        case "error":
            return V.err(node.value)
        case "ref":
            return bind(node.value)
        case "name":
            return names.get(node.value.upper(), V.err(V.NAME))
        case "array":
            items = [V.scalar(compile_node(a, bind, names)).struct().cast(V.CELL) for a in node.args]
            return V.span(F.array(*items), node.value)
        case "percent":
            return _arithmetic("/", compile_node(node.args[0], bind, names), V.literal(100.0))
        case "unary":
            return _arithmetic("*", compile_node(node.args[0], bind, names), V.literal(-1.0 if node.value == "-" else 1.0))
        case "binary":
            a, b = (compile_node(x, bind, names) for x in node.args)
            if node.value == "&":
                (x, ex), (y, ey) = V.to_txt(a), V.to_txt(b)
                return V.guard(Val(t=F.concat(x, y), e=V.first_error(ex, ey)))
            return _arithmetic(node.value, a, b) if node.value in "+-*/^" else _compare(node.value, a, b)
        case "call":
            name = node.value.removeprefix("_XLFN.").removeprefix("_XLWS.")
            if name == "LET":
                inner = dict(names)
                for key, value in zip(node.args[:-1:2], node.args[1:-1:2], strict=True):
                    inner[str(key.value).upper()] = compile_node(value, bind, inner)
                return compile_node(node.args[-1], bind, inner)
            return library.call(name, node.args, lambda n: compile_node(n, bind, names))
    raise FormulaError(f"no rule for {node.kind}")


def compile_formula(formula: str, bind: Bind | None = None) -> Val:
    """The value of a formula whose references are bound by `bind`."""
    def unbound(ref: Ref) -> Val:
        return V.err(V.REF)

    return compile_node(parse(formula), bind or unbound)


def english(formula: str) -> str:
    """The formula with the first name of each function and commas between arguments."""
    from cellarium.functions.library import FUNCTIONS

    def shown(t: Token) -> str:
        if t.kind == "call":
            name = t.value.upper().removeprefix("_XLFN.")
            return FUNCTIONS[name].name if name in FUNCTIONS else name
        return t.value

    out, braces = ["="] if formula.strip().startswith("=") else [], 0
    for t in tokens(formula):
        braces += (t.value == "{") - (t.value == "}")
        out.append("," if t.value == ";" and not braces else shown(t))
    return "".join(out)


def locale(formulas: list[str]) -> str:
    """pt-BR if most function names that tell a language are Portuguese, else en-US."""
    from cellarium.functions.library import FUNCTIONS

    votes = 0
    for text in formulas:
        for t in tokens(text):
            name = t.value.upper()
            if t.kind == "call" and name in FUNCTIONS:
                votes += 1 if FUNCTIONS[name].name != name and not name.isascii() or FUNCTIONS[name].name != name and "." not in name else -1
    return "pt-BR" if votes > 0 else "en-US"
