"""View expressions as columns.

A view's filters and cells are short texts over a note's properties, such as
``not hasPropertyValue(file, "tags", "book")`` or ``getPropertyValue(file, "price", 0) * 5``.
They are read into tokens and compiled to columns of Spark's own functions. No text of a note
becomes SQL, and anything outside the forms below raises ``UnsupportedExpression``.

Values are nil, booleans, numbers (doubles), texts, lists of texts and others. Only nil and
false count as false. ``==`` compares kind and value, ``<`` numbers with numbers or texts with
texts; ``..`` joins texts and numbers; arithmetic takes numbers and texts that are numbers;
``%`` has its divisor's sign; a division by zero is infinite or not a number. An operation on
values of other kinds fails: a filter that fails is false, a cell that fails is empty.

Forms: literals, parentheses, ``or and not``, ``< <= > >= == ~=``, ``..``, ``+ - * / % ^``,
``#``, ``hasProperty``, ``hasPropertyValue``, ``getPropertyValue``, ``file:get``, ``toFixed``,
``string.format`` (``%d %i %s %f %%``), ``string.lower upper len rep reverse sub find match gsub``
(also as ``text:upper()``), ``tostring``, ``tonumber``, ``math.floor ceil abs sqrt max min fmod pow``,
``math.pi``, ``math.huge``, ``table.concat``, ``list[i]``, ``list:toArray()``, ``list:size()``,
``list:contains(x)``, tables of texts (``{"a", "b"}``), calls of the view's formulas,
``(function() ... end)()`` and ``listJoined(file, name, before, after, separator)``.
``find``, ``match`` and ``gsub`` give their first value only, and count characters; see ``patterns``.

Bodies of formulas and functions: ``local x = e``, ``x = e``, ``if elseif else end``, ``return e``,
``table.insert(t, e)``, ``t[#t + 1] = e``, and loops ``for i = 1, #list do`` and
``for i, x in ipairs(list) do`` (lists of properties, too), which do not stand in one another and do not
return. A local in a loop keeps its kind, text, number, boolean or table. Locals are put in place where
they are used, a branch becomes a conditional column, and a loop a ``transform`` of the list, or an
``aggregate`` if a turn needs what earlier ones left. What fails before a ``return`` fails the function.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import is_kind, number_text
from .patterns import UnsupportedPattern, replacement, translated


class UnsupportedExpression(ValueError):
    """The text is outside the supported forms."""


STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
GAP = re.compile(r"(?:\s|--[^\n]*)*")
TOKEN = re.compile(rf"(?:(?P<string>{STRING})|(?P<number>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(?P<sign>\.\.|==|~=|<=|>=|[-+*/%^#<>(),:;={{}}\[\]]))", re.S)
DIRECTIVE = re.compile(r"%(?:%|(\d*(?:\.\d+)?)([a-zA-Z]))")
NUMERIC = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# Escapes in quoted texts.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}
# The language's key words.
KEYWORDS = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
#: Levels, tokens, and parts of the compiled columns that an expression may have.
MAX_DEPTH, MAX_STEPS, MAX_SIZE = 60, 600, 4000
#: Values of a greater size are computed once where a text or number is made of them.
PLAIN = 4
#: The longest text that ``string.rep`` makes.
MAX_REPEATED = 10_000
#: A function's result while it has not returned.
RUNNING = "running"


def nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def unquoted(text: str) -> str:
    """The text between quotes, its escapes resolved."""
    return re.sub(r"\\(\d{1,3}|.)", lambda m: chr(int(m[1])) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


@dataclass(frozen=True)
class Value:
    """A compiled value.

    ``kind`` is nil, bool, number, string, list, table (made by the text itself) or any. But for any, ``column`` holds the value
    and is null where computing it failed; of a ``sure`` boolean it is never null. Any has its
    columns in ``fields``, of which ``kind`` is null for nil and ``failed`` where computing it did;
    ``test`` is its truth where that is shorter than what follows from them.
    """

    kind: str
    column: Column | None = None
    fields: dict[str, Column] | None = None
    constant: object = None
    sure: bool = False
    size: int = 1
    test: Column | None = None


def grown(*values: Value, times: int = 1) -> int:
    """The size of a column in which the values' columns occur so many times."""
    size = 1 + times * sum(v.size for v in values)
    if size > MAX_SIZE:
        raise UnsupportedExpression("the expression is too large")
    return size


FIELDS = {"kind": "string", "str": "string", "num": "double", "bool": "boolean", "list": "array<string>", "json": "string"}
OF = {"bool": "bool", "number": "num", "string": "str", "list": "list", "table": "list"}
KINDS = {kind: FIELDS[name] for kind, name in OF.items()}
NIL = Value("nil")


def constant(x) -> Value:
    kind = "bool" if isinstance(x, bool) else "number" if isinstance(x, float) else "string"
    return Value(kind, F.lit(x), constant=x, sure=kind == "bool")


def truth_value(c: Column) -> Value:
    """A boolean that never fails."""
    return Value("bool", F.coalesce(c, F.lit(False)), sure=True)


def fields_of(v: Value) -> dict[str, Column]:
    if v.kind == "any":
        return v.fields
    out = {name: nothing(t) for name, t in FIELDS.items()}
    if v.kind != "nil":
        out["kind"] = F.when(v.column.isNotNull(), F.lit(v.kind)).otherwise(F.lit("failed"))
        out[OF[v.kind]] = v.column
    return out


def property_value(key: str, props: str) -> Value:
    v = F.col(props)[key]
    kind = F.when(v["kind"].isin("int", "double"), "number").when(v["kind"] != "null", v["kind"])
    return Value("any", fields={"kind": kind, **{name: v[name] for name in FIELDS if name != "kind"}})


def is_nil(v: Value) -> Column:
    return F.lit(v.kind == "nil") if v.kind != "any" else v.fields["kind"].isNull()


def failed(v: Value) -> Column | None:
    """Whether computing the value failed; None where it cannot."""
    if v.kind == "nil" or v.sure or v.constant is not None:
        return None
    return F.coalesce(v.fields["kind"] == "failed", F.lit(False)) if v.kind == "any" else v.column.isNull()


def chosen(tests: list[Value], values: list[Value]) -> Value:
    """The value beside the first test that holds, else the last; failed where a test before failed."""
    if len({v.kind for v in values}) == 1 and values[0].kind not in ("any", "nil"):
        column = values[-1].column
        for t, v in zip(reversed(tests), reversed(values[:-1]), strict=True):
            column = F.when(truth(t), v.column).otherwise(column) if t.sure else F.when(truth(t).isNull(), nothing(KINDS[v.kind])).when(truth(t), v.column).otherwise(column)
        return Value(values[0].kind, column, size=grown(*tests, *values))
    fields = fields_of(values[-1])
    for t, v in zip(reversed(tests), reversed(values[:-1]), strict=True):
        own = fields_of(v)
        fields = {name: F.when(truth(t).isNull(), F.lit("failed") if name == "kind" else nothing(kind)).when(truth(t), own[name]).otherwise(fields[name]) for name, kind in FIELDS.items()}
    return Value("any", fields=fields, size=grown(*tests, *values, times=2))


def truth(v: Value) -> Column:
    """Whether the value counts as true; null where it failed."""
    if v.test is not None:
        return v.test
    if v.kind == "nil":
        return F.lit(False)
    if v.kind == "bool":
        return v.column
    if v.kind != "any":
        return F.when(v.column.isNotNull(), F.lit(True))
    kind = v.fields["kind"]
    return F.when(kind.isNull(), F.lit(False)).when(kind == "bool", v.fields["bool"]).when(kind != "failed", F.lit(True))


def chain(values: list[Value], stop: bool) -> Value:
    """The first value that counts as ``stop``, else the last one; failed where one before it failed."""
    tests, last = [truth(v) for v in values[:-1]], values[-1]
    if all(v.kind == "bool" for v in values):
        if all(v.sure for v in values):
            return Value("bool", reduce((lambda a, b: a | b) if stop else (lambda a, b: a & b), [v.column for v in values]), sure=True, size=grown(*values))
        column = last.column
        for t in reversed(tests):
            column = F.when(t.isNull(), nothing("boolean")).when(t == F.lit(stop), F.lit(stop)).otherwise(column)
        return Value("bool", column, size=grown(*values, times=2))
    fields, test = fields_of(last), truth(last)
    for v, t in zip(reversed(values[:-1]), reversed(tests), strict=True):
        own = fields_of(v)
        test = F.when(t.isNull(), nothing("boolean")).when(t == F.lit(stop), F.lit(stop)).otherwise(test)
        fields = {name: F.when(t.isNull(), F.lit("failed") if name == "kind" else nothing(kind)).when(t == F.lit(stop), own[name]).otherwise(fields[name]) for name, kind in FIELDS.items()}
    return Value("any", fields=fields, size=grown(*values, times=5), test=test)


def default(v: Value, other: Value) -> Value:
    """The value, or another one where it is nil."""
    missing, a, b = is_nil(v), fields_of(other), fields_of(v)
    return Value("any", fields={name: F.when(missing, a[name]).otherwise(b[name]) for name in FIELDS}, size=grown(v, v, other))


def number(v: Value) -> Column:
    """The value as an operand of arithmetic; null where it is none."""
    parsed = lambda s: F.when(s.rlike(NUMERIC), F.trim(s).try_cast("double"))
    if v.kind == "any" and v.size > PLAIN:
        return held(v, number)
    if v.kind == "number":
        return v.column
    if v.kind == "string":
        return parsed(v.column)
    if v.kind == "any":
        return F.when(v.fields["kind"] == "number", v.fields["num"]).when(v.fields["kind"] == "string", parsed(v.fields["str"]))
    return nothing("double")


def once(c: Column, made: Callable[[Column], Column]) -> Column:
    """``made(c)``, in which ``c`` is computed once however often it occurs."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def held(v: Value, made: Callable[[Value], Column]) -> Column:
    """``made(v)``, its fields computed once if they are more than a property's."""
    if v.kind != "any" or v.size <= PLAIN:
        return made(v)
    return once(F.struct(*[v.fields[name].cast(kind).alias(name) for name, kind in FIELDS.items()]), lambda s: made(Value("any", fields={name: s[name] for name in FIELDS})))


def shown(c: Column, size: int = 1) -> Column:
    """A number as text."""
    if size > PLAIN:
        return once(c, lambda x: shown(x))
    return F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(number_text(c))


def joinable(v: Value) -> Column:
    """The value as an operand of ``..``; null where it is none."""
    if v.kind == "string":
        return v.column
    if v.kind == "number":
        return shown(v.column, v.size)
    if v.kind == "any":
        return held(v, lambda v: F.when(v.fields["kind"] == "string", v.fields["str"]).when(v.fields["kind"] == "number", shown(v.fields["num"])))
    return nothing("string")


def text(v: Value) -> Column:
    """The value as a text that a reader sees; null where it failed."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", ", "nil"), F.lit("]"))
    if v.kind == "nil":
        return F.lit("nil")
    if v.kind in ("string", "number"):
        return joinable(v)
    if v.kind == "bool":
        return v.column.cast("string")
    if v.kind == "list":
        return listed(v.column)
    if v.kind == "table":
        return nothing("string")
    if v.size > PLAIN:
        return held(v, text)
    f = v.fields
    return (
        F.when(f["kind"].isNull(), "nil").when(f["kind"] == "string", f["str"]).when(f["kind"] == "number", shown(f["num"]))
        .when(f["kind"] == "bool", f["bool"].cast("string")).when(f["kind"] == "list", listed(f["list"])).when(f["kind"].isin("failed", "table"), nothing("string")).otherwise(f["json"])
    )


def equal(a: Value, b: Value) -> Column:
    """Whether both are of one kind and equal; null where one failed."""
    if "any" not in (a.kind, b.kind):
        if a.kind != b.kind or a.kind == "nil":
            return F.lit(a.kind == b.kind)
        return a.column == b.column
    if a.kind != "any":
        a, b = b, a
    f = a.fields
    if b.kind == "nil":
        return f["kind"].isNull()
    if b.kind != "any":
        same = F.coalesce((f["kind"] == b.kind) & (f[OF[b.kind]] == b.column), F.lit(False))
        return same if b.constant is not None else F.when(b.column.isNotNull(), same)
    g = b.fields
    alike = F.when(f["kind"].isNull() | g["kind"].isNull(), f["kind"].isNull() & g["kind"].isNull())
    for kind, field in {**OF, "other": "json"}.items():
        alike = alike.when((f["kind"] == kind) & (g["kind"] == kind), f[field] == g[field])
    return alike.otherwise(F.lit(False))


ORDER = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def ordered(sign: str, a: Value, b: Value) -> Column:
    """Comparison of two numbers or two texts; null for other kinds."""
    test = ORDER[sign]
    if a.kind == b.kind and a.kind in ("number", "string"):
        return test(a.column, b.column)
    kinds = {v.kind for v in (a, b)} - {"any"}
    f, g = fields_of(a), fields_of(b)
    numbers, texts = test(f["num"], g["num"]), test(f["str"], g["str"])
    if kinds == {"number"}:
        return F.when((f["kind"] == "number") & (g["kind"] == "number"), numbers)
    if kinds == {"string"}:
        return F.when((f["kind"] == "string") & (g["kind"] == "string"), texts)
    return F.when((f["kind"] == "number") & (g["kind"] == "number"), numbers).when((f["kind"] == "string") & (g["kind"] == "string"), texts)


def divided(a: Column, b: Column) -> Column:
    beyond = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull(), float("nan"))
    return F.when(b == 0, beyond).otherwise(F.try_divide(a, b))


ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divided,
    "%": lambda a, b: F.when(b == 0, F.when(a.isNotNull(), float("nan"))).otherwise(a - F.floor(F.try_divide(a, b)).cast("double") * b),
    "^": F.pow,
}


def items(v: Value, *kinds: str) -> Column:
    """The elements of a list or table; null for other kinds."""
    if v.kind == "any":
        return F.when(v.fields["kind"].isin(*kinds), v.fields["list"])
    return v.column if v.kind in kinds else nothing("array<string>")


def element(v: Value, at: Value) -> Value:
    """The element at a position from 1; nil beyond the ends."""
    listed, position = items(v, "list", "table"), number(at)
    found = F.get(listed, position.cast("int") - 1)
    whole = F.coalesce(position == F.floor(position), F.lit(True))
    fields = fields_of(NIL) | {"kind": F.when(listed.isNull() | position.isNull(), "failed").when(whole & found.isNotNull(), "string"), "str": F.when(whole, found)}
    return Value("any", fields=fields, size=grown(v, at, times=2))


def optional(kind: str, column: Column, broken: Column, size: int) -> Value:
    """A value that is nil where the column is null, and failed where ``broken`` holds."""
    fields = fields_of(NIL) | {"kind": F.when(broken, "failed").when(column.isNotNull(), kind), OF[kind]: column}
    return Value("any", fields=fields, size=size, test=F.when(~broken, column.isNotNull()))


@dataclass
class Frame:
    """Where a function's statements stand: its locals, what it has returned, and where it has failed.

    ``result`` is None while no path has returned; later its kind is ``RUNNING`` on those paths that
    have not. ``ended`` means that all paths have returned, ``broken`` holds where a statement failed
    before its path returned. ``hidden`` are the outer locals that a block's own ones stand for.
    """

    values: dict[str, Value]
    loop: tuple | None = None
    used: set[str] = field(default_factory=set)
    result: Value | None = None
    ended: bool = False
    broken: Column | None = None
    size: int = 0
    hidden: dict[str, Value] = field(default_factory=dict)
    declared: set[str] = field(default_factory=set)

    def following(self, v: Value) -> Value:
        """The result if ``v`` is that of what comes next."""
        if self.result is None:
            return v
        on, own, late = self.running(), fields_of(self.result), fields_of(v)
        return Value("any", fields={name: F.when(on, late[name]).otherwise(own[name]) for name in FIELDS}, size=grown(self.result, v))

    def running(self) -> Column:
        return fields_of(self.result)["kind"].eqNullSafe(F.lit(RUNNING))

    def fails(self, test: Column | None, size: int) -> None:
        """The function fails where the test holds."""
        if test is not None:
            late = test if self.result is None else self.running() & test
            self.broken = late if self.broken is None else self.broken | late
            self.size = grown(Value("bool", size=self.size + size))

    def value(self) -> Value:
        """The function's value."""
        v = self.result if self.ended else self.following(NIL)
        if self.broken is None:
            return v
        size = grown(v, Value("bool", size=self.size))
        if v.kind in ("any", "nil"):
            own = fields_of(v)
            return Value("any", fields=own | {"kind": F.when(self.broken, "failed").otherwise(own["kind"])}, size=size)
        return Value(v.kind, F.when(~self.broken, v.column), size=size)


def extreme(of: Callable[..., Column]) -> Callable[..., Column]:
    """The greatest or least of numbers; null where one is none."""
    return lambda *x: x[0] if len(x) == 1 else F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in x]), of(*x))


#: Functions of numbers: the least and most arguments, and the column that they make.
MATHS = {
    "math.floor": (1, 1, F.floor),
    "math.ceil": (1, 1, F.ceil),
    "math.abs": (1, 1, F.abs),
    "math.sqrt": (1, 1, F.sqrt),
    "math.max": (1, 20, extreme(F.greatest)),
    "math.min": (1, 20, extreme(F.least)),
    "math.fmod": (2, 2, lambda a, b: F.when(b == 0, F.when(a.isNotNull(), float("nan"))).otherwise(F.try_mod(a, b))),
    "math.pow": (2, 2, F.pow),
}
#: Functions of texts: the least and most arguments, the text among them.
TEXT_FUNCTIONS = {"len": (1, 1), "lower": (1, 1), "upper": (1, 1), "reverse": (1, 1), "rep": (2, 3), "sub": (2, 3), "find": (2, 4), "match": (2, 2), "gsub": (3, 3)}


class Compiler:
    """Recursive descent over the tokens of one text, by ascending strength of the operators."""

    def __init__(self, formulas: dict[str, str] | None, props: str = "props"):
        self.formulas, self.props, self.steps = formulas or {}, props, 0

    def compile(self, source: str, depth: int = 0) -> Value:
        if not isinstance(source, str):
            raise UnsupportedExpression(f"not a text: {source!r}")
        reader = Reader(self, source, depth)
        value = reader.either()
        if reader.kind:
            raise UnsupportedExpression(f"{reader.text!r} in {source!r}")
        return value

    def formula(self, name: str, depth: int) -> Value:
        if depth > MAX_DEPTH:
            raise UnsupportedExpression("formulas refer to themselves")
        reader = Reader(self, str(self.formulas[name]), depth + 1)
        if reader.kind != "name" or reader.text not in STATEMENTS:  # a bare expression
            value = reader.either()
            reader.take(";")
        else:
            value = reader.function({})
        if reader.kind:
            raise UnsupportedExpression(f"{reader.text!r} in {reader.source!r}")
        return value

    def joined(self, key: str, before: str, after: str, between: str) -> Value:
        items = F.col(self.props)[key]["list"]
        made = F.array_join(F.transform(items, lambda x: F.concat(F.lit(before), x, F.lit(after))), between)
        return Value("string", made)


STATEMENTS = frozenset(("local", "if", "for", "return"))


class Reader:
    """The tokens of a text, and the grammar over them."""

    def __init__(self, compiler: Compiler, source: str, depth: int):
        self.compiler, self.source, self.at, self.depth = compiler, source, 0, depth
        self.kind = self.text = ""
        self.frame = Frame({})
        self.next()

    def next(self) -> None:
        self.at = GAP.match(self.source, self.at).end()
        if self.at == len(self.source):
            self.kind = self.text = ""
            return
        m = TOKEN.match(self.source, self.at)
        if not m:
            raise UnsupportedExpression(self.source[self.at :])
        self.kind, self.text, self.at = m.lastgroup, m[m.lastgroup], m.end()
        self.compiler.steps += 1
        if self.compiler.steps > MAX_STEPS:
            raise UnsupportedExpression("the expression is too long")

    def take(self, text: str) -> bool:
        """Whether the token is this sign or word; it is passed over then."""
        if self.kind in ("sign", "name") and self.text == text:
            self.next()
            return True
        return False

    def want(self, text: str) -> None:
        if not self.take(text):
            raise UnsupportedExpression(f"{text!r} expected in {self.source!r}")

    def either(self) -> Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise UnsupportedExpression("too many levels")
        values = [self.both()]
        while self.take("or"):
            values.append(self.both())
        self.depth -= 1
        return chain(values, True) if len(values) > 1 else values[0]

    def both(self) -> Value:
        values = [self.compared()]
        while self.take("and"):
            values.append(self.compared())
        return chain(values, False) if len(values) > 1 else values[0]

    def compared(self) -> Value:
        left = self.joined()
        while self.kind == "sign" and self.text in ("==", "~=", "<", "<=", ">", ">="):
            sign = self.text
            self.next()
            right = self.joined()
            if sign in ORDER:
                left = Value("bool", ordered(sign, left, right), size=grown(left, right, times=2))
            else:
                same = equal(left, right)
                left = Value("bool", same if sign == "==" else ~same, size=grown(left, right, times=4))
        return left

    def joined(self) -> Value:
        values = [self.sums()]
        while self.take(".."):
            values.append(self.sums())
        size = sum(grown(v, times=1 if v.kind == "string" else 5) for v in values)
        return Value("string", F.concat(*map(joinable, values)), size=grown(Value("string", size=size))) if len(values) > 1 else values[0]

    def sums(self) -> Value:
        left = self.products()
        while self.kind == "sign" and self.text in "+-":
            left = self.arithmetic(left, self.products)
        return left

    def products(self) -> Value:
        left = self.unary()
        while self.kind == "sign" and self.text in "*/%":
            left = self.arithmetic(left, self.unary)
        return left

    def arithmetic(self, left: Value, following) -> Value:
        sign = self.text
        self.next()
        right = following()
        return Value("number", ARITHMETIC[sign](number(left), number(right)), size=grown(left, right, times=4 if sign in "/%" else 1))

    def unary(self) -> Value:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise UnsupportedExpression("too many levels")
        if self.take("not"):
            v = self.unary()
            out = Value("bool", ~truth(v), sure=v.sure, size=grown(v, times=3))
        elif self.take("-"):
            v = self.unary()
            out = Value("number", -number(v), size=grown(v))
        elif self.take("#"):
            v = self.unary()
            f = fields_of(v)
            size = F.when(f["kind"] == "string", F.length(f["str"])).when(f["kind"].isin("list", "table"), F.size(f["list"]))
            out = Value("number", size.cast("double"), size=grown(v, times=4 if v.kind == "any" else 2))
        else:
            out = self.power()
        self.depth -= 1
        return out

    def power(self) -> Value:
        base = self.single()
        if self.take("^"):  # binds to the right, and stronger than a sign before it
            exponent = self.unary()
            return Value("number", F.pow(number(base), number(exponent)), size=grown(base, exponent))
        return base

    def single(self) -> Value:
        value = self.primary()
        while self.kind == "sign" and self.text in ("[", ":"):
            if self.take("["):
                at = self.either()
                self.want("]")
                turn = self.frame.loop
                value = turn[2] if turn and value is turn[0] and at is turn[1] else element(value, at)
                continue
            self.next()
            value = self.method(value, self.word())
        return value

    def method(self, v: Value, name: str) -> Value:
        self.want("(")
        if name in TEXT_FUNCTIONS:
            return self.text_function(name, [v, *self.arguments(0, 4)])
        if name in ("toArray", "size"):
            self.arguments(0, 0)
            listed = items(v, "list")
            return Value("table", listed, size=grown(v)) if name == "toArray" else Value("number", F.when(listed.isNotNull(), F.size(listed)).cast("double"), size=grown(v, times=3))
        if name == "contains":
            (x,) = self.arguments(1, 1)
            listed, sought = items(v, "list"), fields_of(x)["str"]
            return Value("bool", F.when(listed.isNotNull(), F.coalesce(F.array_contains(listed, sought), F.lit(False))), size=grown(v, x, times=3))
        raise UnsupportedExpression(f":{name} in {self.source!r}")

    def word(self) -> str:
        """A name that the text may choose."""
        if self.kind != "name" or self.text in KEYWORDS or "." in self.text or self.text == "file":
            raise UnsupportedExpression(f"a name expected in {self.source!r}")
        text = self.text
        self.next()
        return text

    def primary(self) -> Value:
        kind, token = self.kind, self.text
        if not kind:
            raise UnsupportedExpression(f"{self.source!r} ends early")
        self.next()
        if kind == "string":
            return constant(unquoted(token))
        if kind == "number":
            return constant(float(token))
        if token == "(":
            if self.take("function"):
                self.want("(")
                self.want(")")
                value = self.function(self.frame.values)
                for sign in ("end", ")", "(", ")"):
                    self.want(sign)
                return value
            value = self.either()
            self.want(")")
            return value
        if token == "{":
            return self.table()
        if token in ("math.pi", "math.huge"):
            return constant(math.pi if token == "math.pi" else math.inf)
        if kind == "name" and token in self.frame.values:
            self.frame.used.add(token)
            return self.frame.values[token]
        if token in ("true", "false"):
            return constant(token == "true")
        if token == "nil":
            return NIL
        if token == "file" and self.take(":"):
            self.want("get")
            self.want("(")
            key = self.key()
            self.want(")")
            return property_value(key, self.compiler.props)
        if kind == "name" and token not in KEYWORDS and self.take("("):
            return self.call(token)
        raise UnsupportedExpression(f"{token!r} in {self.source!r}")

    def table(self) -> Value:
        made = []
        while not self.take("}"):
            made.append(self.either())
            if not self.take(",") and not self.take(";") and self.text != "}":
                raise UnsupportedExpression(f"}} expected in {self.source!r}")
        parts = [joinable(v) for v in made]
        column = F.array(*parts) if parts else F.array().cast("array<string>")
        for x in parts:
            column = F.when(x.isNotNull(), column)
        return Value("table", column, size=grown(*made, times=2), sure=not made)

    def function(self, values: dict[str, Value]) -> Value:
        """The value of the statements up to an ``end`` or the text's."""
        outer, self.frame = self.frame, Frame(dict(values))
        self.block()
        frame, self.frame = self.frame, outer
        return frame.value()

    def block(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise UnsupportedExpression("too many levels")
        while self.kind and self.text not in ("end", "else", "elseif"):
            if self.frame.ended:
                raise UnsupportedExpression(f"statements behind a return in {self.source!r}")
            if self.take(";"):
                continue
            if self.take("return"):
                if self.frame.loop:
                    raise UnsupportedExpression("a return in a loop")
                bare = not self.kind or self.kind != "string" and self.text in (";", "end", "else", "elseif")
                self.frame.result, self.frame.ended = self.frame.following(NIL if bare else self.either()), True
                self.take(";")
            elif self.take("local"):
                name = self.word()
                v = self.either() if self.take("=") else NIL
                if name in self.frame.values and name not in self.frame.declared:
                    self.frame.hidden[name] = self.frame.values[name]
                self.frame.declared.add(name)
                self.assign(name, v)
            elif self.take("if"):
                self.branches()
            elif self.take("for"):
                self.loop()
            elif self.take("table.insert"):
                self.want("(")
                name = self.word()
                self.want(",")
                self.insert(name, self.either())
                self.want(")")
            else:
                self.change()
        self.depth -= 1

    def change(self) -> None:
        """``x = e`` or ``t[#t + 1] = e``."""
        name = self.word()
        if name not in self.frame.values:
            raise UnsupportedExpression(f"{name!r} is no local in {self.source!r}")
        if self.take("["):
            for sign in ("#", name, "+"):
                self.want(sign)
            if self.text != "1":
                raise UnsupportedExpression(f"only an element behind the last is set: {self.source!r}")
            self.next()
            self.want("]")
            self.want("=")
            self.insert(name, self.either())
        else:
            self.want("=")
            self.assign(name, self.either())

    def assign(self, name: str, v: Value) -> None:
        self.frame.fails(failed(v), v.size)
        self.frame.values[name] = v

    def insert(self, name: str, v: Value) -> None:
        old = self.frame.values.get(name)
        if old is None or old.kind != "table":
            raise UnsupportedExpression(f"{name!r} is no table in {self.source!r}")
        item = joinable(v)
        self.frame.fails(item.isNull(), v.size)
        self.frame.values[name] = Value("table", F.concat(old.column, F.array(item)), size=grown(old, v))

    def branches(self) -> None:
        outer, tests, frames = self.frame, [], []

        def branch() -> None:
            self.frame = Frame(dict(outer.values), outer.loop, outer.used)
            self.block()
            self.frame.values.update(self.frame.hidden)
            frames.append(self.frame)
            self.frame = outer

        while True:
            tests.append(self.either())
            self.want("then")
            branch()
            if not self.take("elseif"):
                break
        if self.take("else"):
            branch()
        else:
            frames.append(Frame(dict(outer.values)))
        self.want("end")
        if any(f.broken is not None for f in frames) or not all(t.sure for t in tests):
            broken = [F.lit(False) if f.broken is None else f.broken for f in frames]
            test = broken[-1]
            for t, b in zip(reversed(tests), reversed(broken[:-1]), strict=True):
                test = F.when(truth(t).isNull(), True).when(truth(t), b).otherwise(test)
            outer.fails(test, grown(*tests) + sum(f.size for f in frames))
        if any(f.result is not None for f in frames):
            running = Value("any", fields=fields_of(NIL) | {"kind": F.lit(RUNNING)})
            outer.result = outer.following(chosen(tests, [running if f.result is None else f.result for f in frames]))
        outer.ended = all(f.ended for f in frames)
        for name, old in outer.values.items():
            after = [old if f.ended else f.values[name] for f in frames]
            if any(v is not old for v in after):
                outer.values[name] = chosen(tests, after)

    def loop(self) -> None:
        """``for i = 1, #list do`` or ``for i, x in ipairs(list) do``."""
        outer = self.frame
        if outer.loop:
            raise UnsupportedExpression("a loop in a loop")
        at, value = self.word(), None
        if self.take("="):
            if self.text != "1":
                raise UnsupportedExpression("a loop must start at 1")
            self.next()
            self.want(",")
            self.want("#")
            over = self.single()
        else:
            self.want(",")
            value = self.word()
            for sign in ("in", "ipairs", "("):
                self.want(sign)
            over = self.either()
            self.want(")")
        self.want("do")
        pairs = F.transform(items(over, "list", "table"), lambda x, i: F.struct(x.alias("x"), (i + 1).cast("double").alias("i")))
        start, names = (self.at, self.kind, self.text), {at, value}

        def turn(state: dict[str, Value], x: Column, i: Column) -> Frame:
            """The body with these locals, for one element."""
            self.at, self.kind, self.text = start
            element_, index = Value("string", x), Value("number", i, sure=True)
            own = {at: index} | ({value: element_} if value else {})
            inner = self.frame = Frame(outer.values | state | own, (over, index, element_), outer.used)
            self.block()
            inner.values.update(inner.hidden)
            self.frame = outer
            return inner

        outer.used = set()
        first = turn({}, nothing("string"), nothing("double"))  # to see which locals change, and as what
        read = outer.used
        changed = [n for n, v in outer.values.items() if n not in names and first.values[n] is not v]
        for n in changed:
            if outer.values[n].kind != first.values[n].kind or first.values[n].kind not in KINDS or first.values[n].kind == "list":
                raise UnsupportedExpression(f"{n!r} changes its kind in a loop")
        size = grown(over, Value("bool", size=first.size), *[first.values[n] for n in changed])
        empty = F.array().cast("array<string>")

        def fine(f: Frame) -> Column:
            return F.lit(True) if f.broken is None else ~f.broken

        def apart(n: str) -> Column:
            """What each turn adds to a table, in order; null where a turn fails."""

            def added(pair: Column) -> Column:
                inner = turn({c: Value("table", empty, sure=True) for c in changed}, pair["x"], pair["i"])
                return inner.values[n].column if inner.broken is None else F.when(fine(inner), inner.values[n].column)

            return F.concat(outer.values[n].column, F.flatten(F.transform(pairs, added)))

        def after(state: Column, pair: Column) -> Column:
            inner = turn({n: Value(outer.values[n].kind, state[n]) for n in changed}, pair["x"], pair["i"])
            return F.struct((state["fine"] & fine(inner)).alias("fine"), *[inner.values[n].column.alias(n) for n in changed])

        if changed and all(outer.values[n].kind == "table" and n not in read for n in changed):
            made = {n: apart(n) for n in changed}
            broken = reduce(lambda a, b: a | b, [c.isNull() for c in made.values()])
        elif changed:
            begin = F.struct(F.lit(True).alias("fine"), *[outer.values[n].column.cast(KINDS[outer.values[n].kind]).alias(n) for n in changed])
            end = F.aggregate(pairs, begin, after)
            made = {n: end[n] for n in changed}
            broken = ~F.coalesce(end["fine"], F.lit(False))
        else:
            made = {}
            broken = ~F.coalesce(F.forall(pairs, lambda pair: fine(turn({}, pair["x"], pair["i"]))), F.lit(False))
        self.want("end")
        outer.fails(broken, size)
        for n, column in made.items():
            outer.values[n] = Value(outer.values[n].kind, column, size=size)

    def key(self) -> str:
        if self.kind != "string":
            raise UnsupportedExpression(f"a quoted name expected in {self.source!r}")
        key = unquoted(self.text)
        self.next()
        return key

    def arguments(self, least: int, most: int) -> list[Value]:
        """The rest of a call's arguments, up to the closing parenthesis."""
        out = []
        if not self.take(")"):
            while True:
                out.append(self.either())
                if not self.take(","):
                    break
            self.want(")")
        if not least <= len(out) <= most:
            raise UnsupportedExpression(f"{len(out)} arguments in {self.source!r}")
        return out

    def call(self, name: str) -> Value:
        props = self.compiler.props
        if name in self.compiler.formulas and self.take("file"):
            self.want(")")
            return self.compiler.formula(name, self.depth)
        if name in ("hasProperty", "hasPropertyValue", "getPropertyValue", "listJoined"):
            self.want("file")
            self.want(",")
            key = self.key()
            rest = self.arguments(0, 3) if self.take(",") else self.arguments(0, 0)
            found = property_value(key, props)
            if name == "hasProperty" and not rest:
                return truth_value(found.fields["kind"].isNotNull())
            if name == "hasPropertyValue" and len(rest) == 1:
                if isinstance(rest[0].constant, str):  # as plain as can be, so that it can reach the scan
                    v, text_ = F.col(props)[key], rest[0].constant
                    inside = F.coalesce(F.array_contains(v["list"], text_), F.lit(False))
                    return Value("bool", is_kind(v, "list", "list", inside) | is_kind(v, "string", "str", v["str"] == text_), sure=True)
                inside = F.array_contains(found.fields["list"], fields_of(rest[0])["str"])
                test = truth_value(F.when(found.fields["kind"] == "list", inside).otherwise(equal(found, rest[0])))
                return replace(test, size=grown(found, rest[0], times=4))
            if name == "getPropertyValue" and len(rest) <= 1:
                return default(found, rest[0]) if rest and rest[0].kind != "nil" else found
            if name == "listJoined" and len(rest) == 3 and all(isinstance(r.constant, str) for r in rest):
                return self.compiler.joined(key, *(r.constant for r in rest))
        elif name == "toFixed":
            x, _ = self.arguments(2, 2)
            return Value("string", number(x).cast("string"), size=grown(x))  # the number of decimals has no effect
        elif name == "string.format":
            return self.format(self.arguments(1, 20))
        elif name == "tostring":
            (x,) = self.arguments(1, 1)
            return Value("string", text(x), size=grown(x, times=10))
        elif name == "tonumber":
            (v,) = self.arguments(1, 1)
            x = number(v)
            fields = fields_of(NIL) | {"kind": F.when(x.isNotNull(), "number"), "num": x}
            return Value("any", fields=fields, size=grown(v, times=2))
        elif name in MATHS:
            least, most, of = MATHS[name]
            given = self.arguments(least, most)
            return Value("number", of(*map(number, given)).cast("double"), size=grown(*given, times=2 + len(given)))
        elif name == "table.concat":
            given = self.arguments(1, 2)
            listed, between = items(given[0], "table"), joinable(given[1]) if given[1:] else F.lit("")
            return Value("string", F.call_function("array_join", listed, between), size=grown(*given, times=3))
        elif name.startswith("string.") and name[7:] in TEXT_FUNCTIONS:
            return self.text_function(name[7:], self.arguments(1, 5))
        raise UnsupportedExpression(f"{name} in {self.source!r}")

    def text_function(self, name: str, given: list[Value]) -> Value:
        least, most = TEXT_FUNCTIONS[name]
        if not least <= len(given) <= most:
            raise UnsupportedExpression(f"{len(given)} arguments of {name} in {self.source!r}")
        s, rest, size = joinable(given[0]), given[1:], grown(*given, times=3)
        if name == "len":
            return Value("number", F.length(s).cast("double"), size=size)
        if name in ("lower", "upper", "reverse"):
            return Value("string", {"lower": F.lower, "upper": F.upper, "reverse": F.reverse}[name](s), size=size)
        if name == "rep":
            times = F.greatest(number(rest[0]).try_cast("int"), F.lit(0))
            between = joinable(rest[1]) if rest[1:] else F.lit("")
            made = F.call_function("array_join", F.array_repeat(s, times), between)
            return Value("string", F.when(times * (F.length(s) + F.length(between)) <= MAX_REPEATED, F.when(s.isNotNull(), made)), size=size)
        if name == "sub":
            length, low, high = F.length(s), *[number(v).try_cast("int") for v in (rest + [constant(-1.0)])[:2]]
            low = F.when(low < 0, F.greatest(length + low + 1, F.lit(1))).otherwise(F.greatest(low, F.lit(1)))
            high = F.when(high < 0, length + high + 1).otherwise(F.least(high, length))
            return Value("string", F.when(high >= low, F.substring(s, low, high - low + 1)).when(low.isNotNull() & high.isNotNull() & s.isNotNull(), ""), size=size)
        if name == "find" and len(rest) == 3:
            if rest[1].constant != 1.0 or rest[2].constant is not True:
                raise UnsupportedExpression("a search must begin at 1")
            sought = joinable(rest[0])
            return optional("number", F.nullif(F.position(sought, s), F.lit(0)).cast("double"), s.isNull() | sought.isNull(), size)
        if not isinstance(rest[0].constant, str) or len(rest) > 1 + (name == "gsub"):
            raise UnsupportedExpression("a pattern must be a quoted text")
        try:
            if name == "find":
                regex = rf"\A([\s\S]*?)(?:{translated(rest[0].constant, before=1)[0]})"  # what stands before the match
                return optional("number", F.when(s.rlike(regex), F.length(F.regexp_extract(s, regex, 1)) + 1).cast("double"), s.isNull(), size)
            regex, captures = translated(rest[0].constant)
            if name == "match":
                return optional("string", F.when(s.rlike(regex), F.regexp_extract(s, regex, min(captures, 1))), s.isNull(), size)
            if not isinstance(rest[1].constant, str):
                raise UnsupportedExpression("a replacement must be a quoted text")
            return Value("string", F.regexp_replace(s, F.lit(regex), F.lit(replacement(rest[1].constant, captures))), size=size)
        except UnsupportedPattern as e:
            raise UnsupportedExpression(f"pattern {e}") from e

    def format(self, arguments: list[Value]) -> Value:
        """A pattern's directives in order; widths and precisions have no effect."""
        pattern, values = arguments[0].constant, arguments[1:]
        if not isinstance(pattern, str):
            raise UnsupportedExpression("a format must be a quoted text")
        pieces, at = [], 0
        for m in DIRECTIVE.finditer(pattern):
            pieces.append(F.lit(pattern[at : m.start()]))
            at = m.end()
            if not m[2]:
                pieces.append(F.lit("%"))
                continue
            if not values:
                raise UnsupportedExpression(f"no value for {m[0]}")
            v = values.pop(0)
            if m[2] == "f":
                pieces.append(number(v).cast("string"))
            elif m[2] in "di":
                pieces.append(number(v).try_cast("bigint").cast("string"))
            elif m[2] == "s":
                pieces.append(text(v))
            else:
                raise UnsupportedExpression(f"format {m[0]}")
        if "%" in re.sub(DIRECTIVE, "", pattern):
            raise UnsupportedExpression(f"format {pattern!r}")
        return Value("string", F.concat(*pieces, F.lit(pattern[at:])), size=grown(*arguments, times=5))


def condition(source: str, formulas: dict[str, str] | None = None) -> Column:
    """A filter expression; never null."""
    v = Compiler(formulas).compile(source)
    return v.column if v.sure else F.coalesce(truth(v), F.lit(False))


def cell(source: str, formulas: dict[str, str] | None = None) -> Column:
    """A cell as text; empty where it failed."""
    v = Compiler(formulas).compile(source)
    if v.kind == "table":
        raise UnsupportedExpression(f"a table is no text: {source!r}")
    return F.coalesce(text(v), F.lit(""))
