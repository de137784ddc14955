import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import ExpressionError, compile_condition, compile_expression, functions, parse
from tarnflow.functions import access


def value(spark, expr, **fields):
    df = spark.createDataFrame([tuple(fields.values())], list(fields)) if fields else spark.range(1).drop("id")
    df = df if fields else spark.range(1)
    return df.select(compile_expression(expr, df.schema).alias("v")).head().v


#: What each rule of the language says, on inputs made up for it: (expression, value), over the row ``ROW``.
ROW = {"n": 6, "m": -4, "r": 2.25, "z": 0, "word": "Pear", "blank": "", "pad": "  fig\t", "csv": "kiwi;plum;kiwi", "yes": True, "digits": "0420"}
RULES = {
    "numbers keep their kind, division does not": [("n + m", 2), ("n * r", 13.5), ("n / m", -1.5), ("n % 4", 2), ("n - r", 3.75), ("m % 3", -1)],
    "powers bind to the right and before a sign": [("2 ** 2 ** 3", 256.0), ("-n ** 2", -36.0), ("(-n) ** 2", 36.0)],
    "what cannot be computed is nothing": [("n / z", None), ("gone * 3", None), ("word - 1", None), ('int("plum")', None), ('split(csv, ";")[7]', None)],
    "plus joins texts": [('word + "/" + pad', "Pear/  fig\t"), ('"" + blank', "")],
    "comparisons": [("n >= 6", True), ("r < m", False), ('word == "pear"', False), ('digits == 420', False), ("nil == nil", True), ('word != "Fig"', True)],
    "and, or, not, in words and signs": [("yes and n > 9", False), ("yes && n == 6", True), ("n > 9 or r > 2", True), ("n > 9 || z > 0", False), ("not yes", False), ("!(n > 9)", True)],
    "choices nest to the right": [('m > 0 ? "up" : z > 0 ? "flat" : "down"', "down"), ("n > 5 ? r : m", 2.25)],
    "has, getOr and ?? stand in for what is missing": [('has("word")', True), ('has("gone")', False), ('getOr("gone", "none")', "none"), ('getOr("n", 1)', 6), ("gone ?? 12", 12), ("r ?? 12", 2.25), ('(gone ?? 3) * (n ?? 1)', 18)],
    "membership": [("n in [2, 6]", True), ("n not in [2, 6]", False), ('csv contains "plum"', True), ('word startsWith "Pe"', True), ('word endsWith "Pe"', False)],
    "places in texts and lists": [("word[1:3]", "ea"), ("[4, 5, 6][-2]", 5), ('split(csv, ";")[1]', "plum")],
    "texts": [("upper(word)", "PEAR"), ("lower(word)", "pear"), ("trim(pad)", "fig"), ("pad | trim | upper", "FIG"), ('len("\u00e5\u00df\u00e7")', 3), ('join(split(csv, ";"), "+")', "kiwi+plum+kiwi"), ('"say \\"so\\""', 'say "so"'), ('startsWith(csv, "kiwi")', True), ('endsWith(csv, "plum")', False), ('contains(word, "ear")', True)],
    "numbers": [("round(r * 2)", 5.0), ("round(-r * 2)", -5.0), ("floor(m / 3)", -2.0), ("ceil(r)", 3.0), ("abs(m)", 4), ("min(n, m)", -4), ("max(r, n)", 6.0), ("25e-1", 2.5)],
    "lists": [("sum([n, m, 1])", 3), ("count([n, m, z], {# < 1})", 2), ("all([n, r], {# > 2})", True), ("any([m, z], {# > 0})", False), ("map([n, m], {# + 1})", [7, -3]), ("filter([n, m, z], {# != 0})", [6, -4]), ("len([n, m, z])", 3)],
    "kinds": [("int(digits)", 420), ("int(r)", 2), ('float("6.5")', 6.5), ("string(n)", "6")],
}


@pytest.mark.parametrize("rule", list(RULES))
def test_values_of_expressions(spark, rule):
    for expr, want in RULES[rule]:
        got = value(spark, expr, **ROW)
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, expr


@pytest.mark.parametrize("bad", ["price * *", "(1", "[1, 2", "a b", "1 +", '"open', "f(1,", "#", "nosuch(1)", "upper()", "all([1], 1 +)"])
def test_what_is_no_expression(spark, bad):
    with pytest.raises(ExpressionError):
        compile_expression(bad, spark.range(1).schema)


def test_conditions_must_be_true_or_false(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, x long")
    assert [r.id for r in df.filter(compile_condition("x > 3", df.schema)).collect()] == [2]
    assert df.filter(compile_condition("not (x > 3)", df.schema)).count() == 0
    with pytest.raises(ExpressionError):
        compile_condition("x + 1", df.schema)


def test_precedence():
    assert parse("a or b and c").value == "or"
    assert parse("a ?? 0 * 3").value == "*"
    assert parse("a | upper | len").value == "len"


def test_listing():
    assert len(functions()) == 26
    assert {c for c, _, _ in functions()} == {"string", "math", "array", "type", "helper"}


def test_conversions(spark):
    df = spark.createDataFrame([(65, 3.9, "12", True, dt.datetime(2024, 1, 2), "2024-01-02 03:04:05", "")], "i long, f double, s string, b boolean, t timestamp_ntz, ts string, e string")
    got = df.select(
        access.get(df, "i", str).alias("a"), access.get(df, "f", int).alias("b"), access.get(df, "s", int).alias("c"), access.get(df, "b", int).alias("d"), access.get(df, "b", float).alias("e"),
        access.get(df, "t", int).alias("f"), access.get(df, "i", bool).alias("g"), access.get(df, "e", bool).alias("h"), access.get(df, "ts", dt.datetime).alias("i"), access.get(df, "none", int).alias("j"), access.get_or(df, "ts", 7).alias("k"),
    ).head()
    assert tuple(got) == ("65", 3, 12, 1, None, None, True, False, dt.datetime(2024, 1, 2, 3, 4, 5), None, 7)


def test_json_text(spark):
    df = spark.createDataFrame([('{"a":1}',), ("no",)], "j string")
    assert [r.v for r in df.select(access.json_valid(F.col("j")).alias("v")).collect()] == [True, False]
    assert access.guess_literal("true") is True and access.guess_literal("1.5") == 1.5 and access.guess_literal("x") == "x"
    assert access.guess_literal("2024-01-02") == dt.datetime(2024, 1, 2)
