"""Column expressions against row-by-row statements of the same rules in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.functions import chatcode, sqlcompat, types
from gridloom.operators import search

TEXTS = [None, "", " ", "none", "0", "1", "2", "-1", "+3", "3.0", "3.9", "-3.9", " 42 ", "12 kg", "1.5 kg", "$2,217", "-.5x", "a-1b2", "3.", ".5", "1e3", "1E-2", "nan", "inf", "-inf", "1d", "1_000", "YES", "y", "on", "off", "True", "maybe", "Burj 828.5 m", "9007199254740993", "75000", "75000.0", "2,794,356", "+2.3%", "−0.5%", "[15]", "abc", "Z", "10", "9", "１"]
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def parse(text):
    s = text.strip()
    if NUMBER.fullmatch(s):
        return float(s)
    return float(s) if re.fullmatch(r"[+-]?(nan|inf|infinity)", s, re.I) else None


def first_number(text):
    m = re.search(r"[-+]?(?:\d+\.?\d*|\.\d+)", text, re.ASCII)
    return float(m[0]) if m else None


def to_int(text):
    if text is None or not text.strip():
        return None
    if re.fullmatch(r"[+-]?\d+", text.strip(), re.ASCII):
        return int(text.strip())
    value = parse(text)
    if value is None:
        value = first_number(text)
        return int(value) if value is not None and value == int(value) else None
    return int(value) if math.isfinite(value) else None


def to_float(text):
    if text is None or not text.strip():
        return None
    value = parse(text)
    return first_number(text) if value is None else value


def infer(text):
    if text is None or not text.strip():
        return None
    s = text.strip()
    if s.lower() in ("true", "false", "yes", "no", "1", "0", "y", "n"):
        return "boolean"
    return "integer" if re.fullmatch(r"[+-]?\d+", s, re.ASCII) else "float" if parse(s) is not None else "text"


def pasted(text):
    if text is None:
        return None
    s = text.strip().replace(",", "").replace("%", "").replace("+", "").replace("−", "-")
    return float(s) if NUMBER.fullmatch(s) else None


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


RULES = {
    "integer": (lambda c: types.convert_text(c, "integer"), to_int),
    "float": (lambda c: types.convert_text(c, "float"), to_float),
    "boolean": (lambda c: types.convert_text(c, "boolean"), lambda t: None if t is None or not t.strip() else t.strip().lower() in ("true", "1", "yes", "y", "on")),
    "number": (types.number_in_text, lambda t: None if t is None else first_number(t)),
    "infer": (types.infer_value, infer),
    "pasted": (types.pasted_number, pasted),
}


@pytest.mark.parametrize("rule", RULES)
def test_text_rules(spark, rule):
    expression, want = RULES[rule]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", expression(F.col("t")).alias("v")).collect()
    assert [r.t for r in rows if not same(r.v, want(r.t))] == []


def cell_matches(cell, kind, v1, v2):
    """One cell, as the spreadsheet decides it."""
    if kind in ("is_null", "is_not_null"):
        return (cell is None) == (kind == "is_null")
    if cell is None:
        return False
    s = str(cell)
    if kind in ("equals", "not_equals"):
        return (s == v1) == (kind == "equals")

    def number(x):
        return float(x) if isinstance(x, (bool, int, float)) and not isinstance(x, bool) else parse(str(x))

    def compare(op, other):
        a, b = number(cell), parse(other)
        a, b = (a, b) if a is not None and b is not None else (s, other)
        return {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]

    if kind == "between":
        return compare("ge", v1) and compare("le", v2)
    if kind == "outside":
        return compare("lt", v1) or compare("gt", v2)
    return compare(kind, v1)


COLUMNS = {
    "text": ("string", ["10", "9", "abc", "Abd", "", "nan", "1d", "-5", "2.5", None, "1000"]),
    "whole": ("bigint", [75000, 10, 9, -3, 0, None, 2**53 + 1]),
    "real": ("double", [75000.0, 2.5, -1.0, float("nan"), float("inf"), None, 12345678.0, 10.0]),
    "flag": ("boolean", [True, False, None]),
}


@pytest.mark.parametrize("column", COLUMNS)
@pytest.mark.parametrize("kind", sorted(search.KINDS))
def test_find_in_column(spark, column, kind):
    dtype, cells = COLUMNS[column]
    df = spark.createDataFrame(list(enumerate(cells)), f"k int, c {dtype}")
    for v1, v2 in (("10", "75000"), ("75000.0", "80000"), ("9", "10"), ("abc", "b"), ("nan", "nan"), ("True", "True"), ("-3", "2.5"), ("12345678.0", "inf")):
        if column in ("whole", "real", "flag") and (parse(v1) is None) and kind not in ("equals", "not_equals", "is_null", "is_not_null"):
            continue  # numbers against words compare as texts whose form Spark and Python don't share
        if column == "flag" and kind not in ("equals", "not_equals", "is_null", "is_not_null"):
            continue
        got = {r.k for r in search.find(df, "c", kind, v1, v2).collect()}
        assert got == {k for k, c in enumerate(cells) if cell_matches(c, kind, v1, v2)}, (v1, v2)


def test_find_needs_values(spark):
    df = spark.createDataFrame([(1,)], "c int")
    for bad in (("equals",), ("gt", ""), ("between", "1"), ("nothing", "1")):
        with pytest.raises(ValueError):
            search.find(df, "c", *bad)


def test_search_reaches_the_scan(spark, tiny):
    lines = spark.read.parquet(f"{tiny}/lineitem.parquet")
    for kind, value, pushed in (("equals", "17.0", "EqualTo(l_quantity,17.0)"), ("gt", "40", "GreaterThan(l_quantity,40.0)")):
        plan = search.find(lines, "l_quantity", kind, value).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_whole_column_inference(spark):
    cases = {"boolean": ["1", "0", None], "integer": ["1", "0", "2"], "float": ["1", "2.5"], "text": ["1", "x"], None: ["", None]}
    for want, values in cases.items():
        assert spark.createDataFrame([(v,) for v in values], "t string").agg(types.infer_column(F.col("t"))).first()[0] == want
    assert spark.createDataFrame([("yes",), ("3",)], "t string").agg(types.infer_column(F.col("t"))).first()[0] == "text"


def test_conflicts(spark):
    want = {"integer": {"float", "text"}, "float": {"text"}, "boolean": {"integer", "float", "text"}, "text": set()}
    for have, bad in want.items():
        rows = spark.createDataFrame([("integer",), ("float",), ("text",), (None,)], "k string").select("k", types.conflicts(have, F.col("k")).alias("c")).collect()
        assert {r.k for r in rows if r.c} == bad


def test_convert_typed_columns(spark):
    df = spark.createDataFrame([(1, 2.9, True, "x"), (None, -2.9, False, None), (0, float("nan"), None, "7")], "i int, f double, b boolean, t string")
    assert [r.f for r in types.convert(df, "f", "integer").collect()] == [2, -2, None]
    assert [r.i for r in types.convert(df, "i", "boolean").collect()] == [True, None, False]
    assert [r.b for r in types.convert(df, "b", "integer").collect()] == [1, 0, None]
    assert [r.i for r in types.convert(df, "i", "text").collect()] == ["1", None, "0"]
    with pytest.raises(ValueError):
        types.convert(df, "i", "date")


def test_compact(spark):
    cases = {999: "999", 1000: "1.0K", 999949: "999.9K", 999950: "1.0M", 1234567: "1.2M", 2_500_000_000: "2.5B", 0: "0"}
    rows = spark.createDataFrame([(k,) for k in cases], "n bigint").select("n", sqlcompat.compact(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == cases
    assert sqlcompat.dimensions(1234, 5) == "1,234 rows, 5 columns"


def test_date_boundaries(spark):
    row = spark.sql("SELECT timestamp'2020-12-31 23:59:59' AS a, timestamp'2021-01-01 00:00:01' AS b")
    units = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
    got = row.select(*[sqlcompat.date_diff(u, F.col("a"), F.col("b")).alias(u) for u in units]).first().asDict()
    assert got == {"year": 1, "quarter": 1, "month": 1, "week": 0, "day": 1, "hour": 1, "minute": 1, "second": 2}
    assert row.select(sqlcompat.strftime(F.col("a"), "it's %Y%%").alias("t")).first().t == "it's 2020%"
    with pytest.raises(ValueError):
        sqlcompat.strftime(F.col("a"), "%Q")


def test_code_blocks(spark):
    f = "```"
    cases = [
        (f"{f}sql\nselect 1\n{f}", "select 1", "select 1"),
        (f"{f}sql\nprint(1)\n{f}\n{f}python\nimport x\ndf = df.filter(x)\n{f}", "import x\ndf = df.filter(x)", "import x\ndf = df.filter(x)"),
        (f"{f}python\nx = 1\n{f}\n{f}\ndf = df.sort(1)\n{f}", "df = df.sort(1)", None),
        (f"{f}\nWITH a AS (SELECT 1) SELECT 2\n{f}", None, "WITH a AS (SELECT 1) SELECT 2"),
        ("no code", None, None),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string").select("k", chatcode.extract_code(F.col("t")).alias("a"), chatcode.extract_code(F.col("t"), True).alias("b")).orderBy("k").collect()
    assert [(r.a, r.b) for r in rows] == [c[1:] for c in cases]
    prose, code = chatcode.split_reply(F.col("t"))
    r = spark.createDataFrame([(f"a\n{f}python\nx\n{f}\nb\n{f}python\ny\n{f}",)], "t string").select(prose.alias("p"), code.alias("c")).first()
    assert r.p == "a\n[code]\nb\n[code]" and r.c == ["x", "y"]
