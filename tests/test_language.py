import json
import math
import operator
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlens.functions.fields import ColumnFields, RecordFields
from emberlens.functions.ambiguity import hazardous
from emberlens.functions.patterns import PatternError, check, matches, to_java
from emberlens.operators.predicate import EPSILON, compile_predicate
from emberlens.plans.language import And, Compare, Contains, Everything, Has, Matches, Not, Or, QueryError, parse
from emberlens.sources import ndjson


def test_precedence():
    a, b, c = (Compare((x,), "==", 1.0) for x in "abc")
    assert parse("a == 1 or b == 1 and c == 1") == Or(a, And(b, c))
    assert parse("not a == 1 and b == 1") == And(Not(a), b)
    assert parse("(a == 1 or b == 1) and c == 1") == And(Or(a, b), c)
    assert parse("a == 1 or b == 1 or c == 1") == Or(Or(a, b), c)
    assert parse("not not has a . b-c") == Not(Not(Has(("a", "b-c"))))
    assert parse("  ") == parse(None) == Everything()


def test_literals():
    assert parse('x == "a\\n\\"\\q\\\\"').value == 'a\n"q\\'
    assert [parse(f"x != {v}").value for v in ("-1.5e3", "true", "false", "null")] == [-1500.0, True, False, None]
    assert parse('x ~ "^a"') == Matches(("x",), "^a") and parse('x contains ""') == Contains(("x",), "")


@pytest.mark.parametrize(
    "query, column, part",
    [
        ("status = 500", 8, "single `=`"),
        ("a ! b", 3, "lone `!`"),
        ("status >=", 10, "expected a value (number, string, true, false, or null), found end of input"),
        ("(status == 500", 15, "expected `)`, found end of input"),
        ("status == 500)", 14, "unexpected trailing token `)`"),
        ("and status == 1", 1, "expected a query expression, found `and`"),
        ('path == "open', 9, "unterminated string literal"),
        ('path == "open\\', 9, "unterminated string escape"),
        ("status <> 500", 9, "found `>`"),
        ("x == 1-2", 6, "invalid number literal `1-2`"),
        ("x == $", 6, "unexpected character `$`"),
        ("x 5", 3, "after field, found number `5`"),
        ("x ~ 5", 5, "expected a string literal, found number `5`"),
        ("x. == 5", 4, "expected a field name after `.`, found `==`"),
        ("has 5", 5, "expected a field name, found number `5`"),
        ("é == ", 7, "end of input"),
        ("not " * 500 + "a == 1", 601, "nested too deeply"),
    ],
)
def test_errors(query, column, part):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert e.value.column == column and part in str(e.value)


RECORDS = [
    {}, {"a": None}, {"a": 5}, {"a": 5.0000000000000001}, {"a": "5"}, {"a": "b\n"}, {"a": True}, {"a": False}, {"a": [1]}, {"a": {"b": 1}},
    {"a": {"b": None}}, {"a": -1.5}, {"a": "Straße ÉCOLE"}, {"b": "x"}, {"a": 10**17}, {"a": ""},
]


def evaluate(e, record):
    """The language, plainly."""
    match e:
        case Everything():
            return True
        case Not(x):
            return not evaluate(x, record)
        case And(x, y):
            return evaluate(x, record) and evaluate(y, record)
        case Or(x, y):
            return evaluate(x, record) or evaluate(y, record)
    v, there = record, True
    for name in e.field:
        there = there and isinstance(v, dict) and name in v
        v = v[name] if there else None
    if isinstance(e, Has):
        return there and v is not None
    if isinstance(e, Contains):
        return isinstance(v, str) and e.needle in v
    if isinstance(e, Matches):
        import regex

        return isinstance(v, str) and regex.search(e.pattern.replace("$", r"\Z"), v) is not None
    ops = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
    if e.value is None:
        return there and (v is None if e.op == "==" else v is not None if e.op == "!=" else False)
    if isinstance(e.value, bool):
        return isinstance(v, bool) and e.op in ("==", "!=") and (v == e.value) == (e.op == "==")
    if isinstance(e.value, float):
        if not isinstance(v, int | float) or isinstance(v, bool):
            return False
        return (abs(v - e.value) < EPSILON) == (e.op == "==") if e.op in ("==", "!=") else ops[e.op](v, e.value)
    if not isinstance(v, str):
        return False
    return (v == e.value) == (e.op == "==") if e.op in ("==", "!=") else ops[e.op](v.encode(), e.value.encode())


paths = st.sampled_from([("a",), ("b",), ("a", "b"), ("a", "b", "c")])
values = st.sampled_from([5.0, -1.5, 1e17, math.pi, "5", "b\n", "", "x", True, False, None])
simple = st.one_of(
    st.builds(Compare, paths, st.sampled_from(["==", "!=", ">", ">=", "<", "<="]), values),
    st.builds(Has, paths),
    st.builds(Contains, paths, st.sampled_from(["", "a", "É", "\n"])),
    st.builds(Matches, paths, st.sampled_from(["^b$", "^$", "5", "(?i)école", r"\bStra", "[^b]", "b.?$"])),
)
trees = st.recursive(simple, lambda t: st.one_of(st.builds(Not, t), st.builds(And, t, t), st.builds(Or, t, t)), max_leaves=6)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=12, max_size=12))
def test_compiled_as_evaluated(spark, exprs):
    lines = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(RECORDS)], "pos long, value string")
    found = ndjson.records(ndjson.classify(lines))
    got = found.select("pos", *[compile_predicate(e, RecordFields()).alias(f"e{i}") for i, e in enumerate(exprs)]).collect()
    assert len(got) == len(RECORDS)
    for row in got:
        for i, e in enumerate(exprs):
            assert row[f"e{i}"] is evaluate(e, RECORDS[row["pos"]]), (e, RECORDS[row["pos"]])


def test_columns_with_struct_and_null(spark):
    df = spark.sql("SELECT named_struct('b', 1, 'c', 'x') AS a, CAST(NULL AS INT) AS n UNION ALL SELECT NULL, 3")
    held = lambda q: [r[0] for r in df.select(compile_predicate(parse(q), ColumnFields(df.schema))).collect()]
    assert held("a.b == 1") == [True, False] and held('a.c != "y"') == [True, False]
    assert held("not a.z == 1 and not a.b.q == 1") == [True, True]
    assert held("has n") == [False, True] and held("n == null") == [False, False]


def test_patterns(spark):
    assert to_java("a$") == r"(?dU)a\z" and to_java("(?m)a$").endswith("a$") and to_java(r"[$]\$") == r"(?dU)[$]\$"
    assert to_java("(?P<x>.)(?i)b") == "(?dU)(?<x>.)(?ui)b"
    for bad in ("(", "a(?=b)", r"(a)\1", "a++", "[z-a]"):
        with pytest.raises(PatternError):
            check(spark, bad)
    check(spark, r"\\1[+]+(a|b)*\++$")


HARMFUL = [
    r"(a+)+$", r"(a*)*b", r"(a|a)*b", r"(a|ab|b)*c", r"(\w|\d)+x", r"(.*a){12}", r"((x?|y?)a)*z", r"(a{1,20}){1,20}b", r"(\w+\s?)+$",
    r"^(([a-z])+.)+[A-Z]([a-z])+$", r"(?i)(a|A)*b", r".*.*.*.*x", r"((a*)*b)*", r"(\s*\w*)*;", r"(é|\w)*x", r"(?P<n>[\d_]|\w)+!$",
]
HARMLESS = [
    r"^https?://[^/]+[.]com(/|$)", r"(/\w+)+/x", r"(\d{1,3}\.){3}\d{1,3}", r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", r"a.*b.*c",
    r"^\[(error|warn)\]", r"(ab|cd)*e", r"([a-z]+,)*[a-z]+", r"x{2,300}", r"(?P<n>a|b)+c", r"\\1[+]+(a|b)*\++$", r"(?x) ( a | b )+ c # (a+)+",
    r"[[:alpha:]]+\d", r"\bfoo\b", "", "a||b", r"(\.\d+)?$",
]


def test_patterns_that_would_take_exponential_time_are_told():
    assert [p for p in HARMFUL if not hazardous(p)] == []
    assert [p for p in HARMLESS if hazardous(p)] == []


def test_linear_matching_agrees_with_backtracking(spark):
    texts = ["", "aaab", "ab c;", "AbaB", "x\ny", "éxx!", "٣٤_!", "a.b.c/1", "xayaz", "ab" * 6, "a" * 12, "foo bar Baz", "ſ", "\u3000w;", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    columns = [c for k, p in enumerate(HARMFUL) for c in (matches(F.col("t"), p).alias(f"m{k}"), F.col("t").rlike(to_java(p)).alias(f"j{k}"))]
    for row in rows.select("t", *columns).collect():
        for k, p in enumerate(HARMFUL):
            assert row[f"m{k}"] == row[f"j{k}"], (row["t"], p)


def test_a_hostile_line_is_answered_at_once(spark):
    hostile = spark.range(3).select(F.concat(F.repeat(F.lit("a"), 200_000), F.lit("!")).alias("t"))
    began = time.monotonic()
    assert hostile.where(matches(F.col("t"), "(a+)+$")).count() == 0
    assert hostile.where(matches(F.col("t"), "(a+)+!")).count() == 3
    assert time.monotonic() - began < 20


def test_patterns_without_a_linear_form_are_refused(spark):
    for bad in (r"([\W]+)+$", r"(?x)(a +)+ $", r"([a-c&&b]+)+$", r"(a{1,2000}){1,2000}"):
        with pytest.raises(PatternError):
            check(spark, bad)
    check(spark, r"(?<n>[\w-]+\u0041?)+$")
