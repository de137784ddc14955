"""Syntax trees to Spark columns.

The static type of every node is followed along, as ``+``, ``len``, ``contains``
and slices mean different things for text, numbers and arrays. What fails on a row
(a number that is not one, a division by zero, an index out of range) is null there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .syntax import ExpressionError, Node, parse

TEXT, LONG, DOUBLE, BOOL, NULL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.NullType()


@dataclass(frozen=True)
class Typed:
    col: Column
    type: T.DataType
    constant: object = None


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def _join(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; text where they have nothing in common."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if _is_number(a) and _is_number(b):
        return LONG if _is_whole(a) and _is_whole(b) else DOUBLE
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_join(a.elementType, b.elementType))
    return TEXT


def _to(x: Typed, t: T.DataType) -> Column:
    """``x`` as ``t``; literals are made so, and widening is a plain cast, so that filters still reach the scan."""
    if x.type == t:
        return x.col
    if _is_number(x.type) and _is_number(t):
        return F.lit(float(x.constant)) if x.constant is not None and not _is_whole(t) else x.col.cast(t)
    return x.col.try_cast(t)


class Compiler:
    """Compiles trees against the columns of one schema."""

    def __init__(self, schema: T.StructType):
        self.fields = {f.name: f.dataType for f in schema.fields}

    def compile(self, node: Node, element: Typed | None = None) -> Typed:
        return getattr(self, f"_{node.kind}")(node, element)

    # leaves

    def _literal(self, node: Node, element) -> Typed:
        v = node.value
        if v is None:
            return Typed(F.lit(None), NULL)
        kind = BOOL if isinstance(v, bool) else LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else TEXT
        return Typed(F.lit(v).cast(LONG) if kind == LONG else F.lit(v), kind, v)

    def _name(self, node: Node, element) -> Typed:
        if node.value not in self.fields:
            return Typed(F.lit(None), NULL)
        return Typed(F.col(f"`{node.value}`"), self.fields[node.value])

    def _element(self, node: Node, element) -> Typed:
        if element is None:
            raise ExpressionError("# stands for an element, and there is none here")
        return element

    def _array(self, node: Node, element) -> Typed:
        items = [self.compile(p, element) for p in node.parts]
        kind: T.DataType = NULL
        for x in items:
            kind = _join(kind, x.type)
        kind = TEXT if isinstance(kind, T.NullType) else kind
        if not items:
            return Typed(F.array().cast(T.ArrayType(TEXT)), T.ArrayType(TEXT))
        return Typed(F.array(*[_to(x, kind) for x in items]), T.ArrayType(kind))

    def _closure(self, node: Node, element) -> Typed:
        raise ExpressionError("a closure can only be the argument of an array function")

    # operators

    def _if(self, node: Node, element) -> Typed:
        test, yes, no = (self.compile(p, element) for p in node.parts)
        kind = _join(yes.type, no.type)
        return Typed(F.when(self._truth(test), _to(yes, kind)).otherwise(_to(no, kind)), kind)

    def _truth(self, x: Typed) -> Column:
        if not isinstance(x.type, (T.BooleanType, T.NullType)):
            raise ExpressionError(f"a condition must be true or false, not {x.type.simpleString()}")
        return x.col if x.type == BOOL else x.col.cast(BOOL)

    def _unary(self, node: Node, element) -> Typed:
        x = self.compile(node.parts[0], element)
        if node.value == "not":
            return Typed(~self._truth(x), BOOL)
        n = self._number(x)
        return Typed(-n.col if node.value == "-" else n.col, n.type)

    def _number(self, x: Typed) -> Typed:
        if _is_whole(x.type):
            return Typed(x.col.cast(LONG), LONG, x.constant)
        if _is_number(x.type):
            return Typed(x.col.cast(DOUBLE), DOUBLE, x.constant)
        return Typed(F.lit(None).cast(DOUBLE), DOUBLE)  # text, bool and the like are no numbers: null on each row

    def _binary(self, node: Node, element) -> Typed:
        op = node.value
        a, b = (self.compile(p, element) for p in node.parts)
        if op in ("and", "or"):
            x, y = self._truth(a), self._truth(b)
            return Typed(x & y if op == "and" else x | y, BOOL)
        if op == "??":
            kind = _join(a.type, b.type)
            return Typed(F.coalesce(_to(a, kind), _to(b, kind)), kind)
        if op in ("==", "!="):
            return Typed(self._equal(a, b, op == "!="), BOOL)
        if op in ("<", ">", "<=", ">="):
            return Typed(self._compare(a, b, op), BOOL)
        if op == "in":
            fixed = self._constants(node.parts[1], a.type)
            return Typed(a.col.isin(*fixed) if fixed else self._contains(b, a), BOOL)
        if op in ("contains", "startsWith", "endsWith"):
            return Typed(self._contains(a, b) if op == "contains" else self._edge(a, b, op), BOOL)
        if op == "matches":
            return Typed(_to(a, TEXT).rlike(_to(b, TEXT)) if not isinstance(b.constant, str) else _to(a, TEXT).rlike(b.constant), BOOL)
        if op == "+" and isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
            return Typed(F.concat(a.col, b.col), TEXT)
        x, y = self._number(a), self._number(b)
        whole = _is_whole(x.type) and _is_whole(y.type)
        if op == "/":
            return Typed(F.try_divide(x.col.cast(DOUBLE), y.col.cast(DOUBLE)), DOUBLE)
        if op == "**":
            return Typed(F.pow(x.col.cast(DOUBLE), y.col.cast(DOUBLE)), DOUBLE)
        kind = LONG if whole else DOUBLE
        left, right = x.col.cast(kind), y.col.cast(kind)
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "%": F.try_mod}[op](left, right)
        return Typed(made, kind)

    def _equal(self, a: Typed, b: Typed, negated: bool) -> Column:
        if isinstance(a.type, T.NullType) or isinstance(b.type, T.NullType):
            one = b if isinstance(a.type, T.NullType) else a
            both = isinstance(a.type, T.NullType) and isinstance(b.type, T.NullType)
            same = F.lit(True) if both else one.col.isNull()
            return ~same if negated else same
        if _is_number(a.type) != _is_number(b.type) and {type(a.type), type(b.type)} & {T.StringType, T.BooleanType}:
            return F.lit(negated)  # values of different kinds are never equal
        kind = _join(a.type, b.type)
        x, y = _to(a, kind), _to(b, kind)
        return x != y if negated else x == y

    def _compare(self, a: Typed, b: Typed, op: str) -> Column:
        if _is_number(a.type) != _is_number(b.type):
            return F.lit(None).cast(BOOL)
        kind = _join(a.type, b.type)
        x, y = _to(a, kind), _to(b, kind)
        return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def _constants(self, node: Node, kind: T.DataType) -> list:
        """The values of an array of literals of one kind with the field, which a scan can look up; else none."""
        if node.kind != "array" or any(p.kind != "literal" or p.value is None for p in node.parts):
            return []
        values = [p.value for p in node.parts]
        if isinstance(kind, T.StringType) and all(isinstance(v, str) for v in values):
            return values
        whole = _is_whole(kind) and all(isinstance(v, int) and not isinstance(v, bool) for v in values)
        return values if whole else []

    def _contains(self, whole: Typed, part: Typed) -> Column:
        if isinstance(whole.type, T.ArrayType):
            kind = _join(whole.type.elementType, part.type)
            return F.array_contains(whole.col.try_cast(T.ArrayType(kind)), _to(part, kind))
        return F.contains(_to(whole, TEXT), _to(part, TEXT))

    def _edge(self, a: Typed, b: Typed, op: str) -> Column:
        return (F.startswith if op == "startsWith" else F.endswith)(_to(a, TEXT), _to(b, TEXT))

    # access

    def _member(self, node: Node, element) -> Typed:
        x = self.compile(node.parts[0], element)
        if isinstance(x.type, T.StructType) and node.value in x.type.names:
            return Typed(x.col.getField(node.value), x.type[node.value].dataType)
        if isinstance(x.type, T.MapType):
            return Typed(x.col.getItem(node.value), x.type.valueType)
        return Typed(F.lit(None), NULL)

    def _index(self, node: Node, element) -> Typed:
        x, at = (self.compile(p, element) for p in node.parts)
        if isinstance(x.type, T.ArrayType):
            i = at.col.cast("int")
            i = F.when(i < 0, i + F.size(x.col)).otherwise(i)
            return Typed(F.get(x.col, i), x.type.elementType)
        if isinstance(x.type, T.StructType) and isinstance(at.constant, str):
            return self._member(Node("member", at.constant, node.parts[:1]), element)
        if isinstance(x.type, T.MapType):
            return Typed(F.try_element_at(x.col, at.col), x.type.valueType)
        if isinstance(x.type, T.StringType):
            i = at.col.cast("int")
            return Typed(F.nullif(F.substring(x.col, i + F.when(i < 0, 0).otherwise(1), F.lit(1)), F.lit("")), TEXT)
        return Typed(F.lit(None), NULL)

    def _slice(self, node: Node, element) -> Typed:
        x, start, stop = (self.compile(p, element) for p in node.parts)
        size = F.size(x.col) if isinstance(x.type, T.ArrayType) else F.char_length(_to(x, TEXT))
        clamp = lambda i: F.greatest(F.lit(0), F.least(size, F.when(i < 0, i + size).otherwise(i)))
        a = clamp(start.col.cast("int"))
        b = size if isinstance(stop.type, T.NullType) else clamp(stop.col.cast("int"))
        n = F.greatest(F.lit(0), b - a)
        if isinstance(x.type, T.ArrayType):
            return Typed(F.slice(x.col, a + 1, n), x.type)
        return Typed(F.substring(_to(x, TEXT), a + 1, n), TEXT)

    # functions

    def _call(self, node: Node, element) -> Typed:
        spec = FUNCTIONS.get(node.value)
        if spec is None:
            raise ExpressionError(f"there is no function {node.value}")
        low, high = spec.arity
        if not low <= len(node.parts) <= high:
            raise ExpressionError(f"{node.value} takes {low if low == high else f'{low} to {high}'} arguments, not {len(node.parts)}")
        return spec.make(self, node.parts, element)

    def over(self, array: Typed, body: Node) -> tuple[T.DataType, object, Typed]:
        """Element type of an array, the closure as a Python function, and its typed result."""
        if not isinstance(array.type, T.ArrayType):
            raise ExpressionError(f"an array is needed, not {array.type.simpleString()}")
        inner = body.parts[0] if body.kind == "closure" else body
        kind = array.type.elementType
        seen: list[Typed] = []

        def apply(x: Column) -> Column:
            made = self.compile(inner, Typed(x, kind))
            seen.append(made)
            return made.col

        probe = self.compile(inner, Typed(F.lit(None).cast(kind), kind))
        return kind, apply, probe


@dataclass(frozen=True)
class Function:
    category: str
    usage: str
    about: str
    arity: tuple[int, int]
    make: object


def _text1(fn):
    return lambda c, a, e: Typed(fn(_to(c.compile(a[0], e), TEXT)), TEXT)


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _split(c, a, e):
    s, sep = (c.compile(x, e) for x in a)
    if isinstance(sep.constant, str):
        pattern = F.lit("(?!^)(?!$)" if sep.constant == "" else re.sub(r"([^A-Za-z0-9 ])", r"\\\1", sep.constant))
    else:
        pattern = F.regexp_replace(_to(sep, TEXT), r"([^A-Za-z0-9 ])", r"\\$1")
    return Typed(F.split(_to(s, TEXT), pattern), T.ArrayType(TEXT))


def _round(fn):
    def make(c, a, e):
        x = c._number(c.compile(a[0], e))
        return Typed(x.col if _is_whole(x.type) else fn(x.col).cast(DOUBLE), x.type)

    return make


def _abs(c, a, e):
    x = c._number(c.compile(a[0], e))
    return Typed(F.abs(x.col), x.type)


def _two(fn):
    def make(c, a, e):
        items = [c._number(c.compile(x, e)) for x in a]
        kind = items[0].type
        for x in items[1:]:
            kind = _join(kind, x.type)
        some = items[0].col.isNotNull()
        for x in items[1:]:
            some = some & x.col.isNotNull()
        return Typed(F.when(some, fn(*[x.col.cast(kind) for x in items])), kind)

    return make


def _len(c, a, e):
    x = c.compile(a[0], e)
    if isinstance(x.type, (T.ArrayType, T.MapType)):
        return Typed(F.size(x.col).cast(LONG), LONG)
    return Typed(F.char_length(_to(x, TEXT)).cast(LONG), LONG)


def _quantified(fn):
    def make(c, a, e):
        x = c.compile(a[0], e)
        _, apply, probe = c.over(x, a[1])
        c._truth(probe)
        return Typed(fn(x.col, lambda v: F.coalesce(apply(v), F.lit(False))), BOOL)

    return make


def _filter(c, a, e):
    x = c.compile(a[0], e)
    _, apply, probe = c.over(x, a[1])
    c._truth(probe)
    return Typed(F.filter(x.col, lambda v: apply(v)), x.type)


def _map(c, a, e):
    x = c.compile(a[0], e)
    _, apply, probe = c.over(x, a[1])
    return Typed(F.transform(x.col, lambda v: apply(v)), T.ArrayType(probe.type))


def _sum(c, a, e):
    x = c.compile(a[0], e)
    if not isinstance(x.type, T.ArrayType):
        raise ExpressionError("sum needs an array")
    kind = LONG if _is_whole(x.type.elementType) else DOUBLE
    return Typed(F.aggregate(x.col, F.lit(0).cast(kind), lambda s, v: s + F.coalesce(v.try_cast(kind), F.lit(0).cast(kind))), kind)


def _count(c, a, e):
    x = c.compile(a[0], e) if len(a) == 1 else _filter(c, a, e)
    return Typed(F.size(x.col).cast(LONG), LONG)


def _convert(kind):
    def make(c, a, e):
        x = c.compile(a[0], e)
        if kind is LONG and isinstance(x.type, T.StringType):
            return Typed(F.when(x.col.rlike(r"^\s*[+-]?\d+\s*$"), _trim(x.col).try_cast(LONG)), LONG)
        if kind is TEXT and isinstance(x.type, (T.ArrayType, T.StructType, T.MapType)):
            return Typed(F.to_json(x.col), TEXT)
        return Typed(x.col.try_cast(kind), kind)

    return make


def _field_name(node: Node) -> str:
    if node.kind != "literal" or not isinstance(node.value, str):
        raise ExpressionError("a field is named by a text in quotes")
    return node.value


def _has(c, a, e):
    name = _field_name(a[0])
    return Typed(F.col(f"`{name}`").isNotNull() if name in c.fields else F.lit(False), BOOL)


def _get_or(c, a, e):
    name, default = _field_name(a[0]), c.compile(a[1], e)
    if name not in c.fields:
        return default
    return c._binary(Node("binary", "??", (Node("name", name), a[1])), e)


FUNCTIONS: dict[str, Function] = {
    "upper": Function("string", "upper(s)", "upper case", (1, 1), _text1(F.upper)),
    "lower": Function("string", "lower(s)", "lower case", (1, 1), _text1(F.lower)),
    "trim": Function("string", "trim(s)", "without white space at either end", (1, 1), _text1(_trim)),
    "split": Function("string", "split(s, sep)", "parts between a separator", (2, 2), _split),
    "join": Function("string", "join(a, sep)", "elements with a separator between", (1, 2), lambda c, a, e: Typed(F.array_join(c.compile(a[0], e).col.cast("array<string>"), a[1].value if len(a) > 1 else ""), TEXT)),
    "startsWith": Function("string", "startsWith(s, p)", "whether a text starts so", (2, 2), lambda c, a, e: Typed(c._edge(c.compile(a[0], e), c.compile(a[1], e), "startsWith"), BOOL)),
    "endsWith": Function("string", "endsWith(s, p)", "whether a text ends so", (2, 2), lambda c, a, e: Typed(c._edge(c.compile(a[0], e), c.compile(a[1], e), "endsWith"), BOOL)),
    "contains": Function("string", "contains(s, x)", "whether a text or array holds x", (2, 2), lambda c, a, e: Typed(c._contains(c.compile(a[0], e), c.compile(a[1], e)), BOOL)),
    "round": Function("math", "round(n)", "nearest whole number, halves away from zero", (1, 1), _round(lambda x: F.round(x, 0))),
    "floor": Function("math", "floor(n)", "whole number below", (1, 1), _round(F.floor)),
    "ceil": Function("math", "ceil(n)", "whole number above", (1, 1), _round(F.ceil)),
    "abs": Function("math", "abs(n)", "without its sign", (1, 1), _abs),
    "min": Function("math", "min(a, b)", "the smaller", (2, 9), _two(F.least)),
    "max": Function("math", "max(a, b)", "the larger", (2, 9), _two(F.greatest)),
    "len": Function("array", "len(x)", "elements of an array or characters of a text", (1, 1), _len),
    "all": Function("array", "all(a, {p})", "whether p holds for each element #", (2, 2), _quantified(F.forall)),
    "any": Function("array", "any(a, {p})", "whether p holds for an element #", (2, 2), _quantified(F.exists)),
    "filter": Function("array", "filter(a, {p})", "elements for which p holds", (2, 2), _filter),
    "map": Function("array", "map(a, {f})", "f of each element", (2, 2), _map),
    "sum": Function("array", "sum(a)", "sum of elements", (1, 1), _sum),
    "count": Function("array", "count(a[, {p}])", "number of elements (for which p holds)", (1, 2), _count),
    "int": Function("type", "int(v)", "as a whole number", (1, 1), _convert(LONG)),
    "float": Function("type", "float(v)", "as a number", (1, 1), _convert(DOUBLE)),
    "string": Function("type", "string(v)", "as text", (1, 1), _convert(TEXT)),
    "has": Function("helper", 'has("f")', "whether a field has a value", (1, 1), _has),
    "getOr": Function("helper", 'getOr("f", d)', "a field's value, or d", (2, 2), _get_or),
}


def compile_expression(text: str, schema: T.StructType) -> Column:
    """The column an expression stands for, over a frame with ``schema``."""
    return Compiler(schema).compile(parse(text)).col


def compile_condition(text: str, schema: T.StructType) -> Column:
    """The same for a condition, which must be true, false or null; a filter takes null for false."""
    c = Compiler(schema)
    return c._truth(c.compile(parse(text)))


def functions(category: str | None = None) -> list[tuple[str, str, str]]:
    """``(category, usage, meaning)`` of all functions, or of a category's."""
    return [(f.category, f.usage, f.about) for f in FUNCTIONS.values() if category in (None, f.category)]
