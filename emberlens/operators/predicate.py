"""Predicates as Columns with two-valued logic: every leaf is true or false, never NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlens.functions.fields import Field
from emberlens.functions.patterns import matches
from emberlens.plans.language import And, Compare, Contains, Everything, Expr, Has, Matches, Not, Or, Path

#: Numbers are equal when they differ by less than this.
EPSILON = 2.220446049250313e-16

_ORDER = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


def _two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _compare(f: Field, op: str, value: object) -> Column:
    if value is None:
        return f.null if op == "==" else f.present if op == "!=" else F.lit(False)
    if isinstance(value, bool):
        return {"==": f.flag == value, "!=": f.flag != value}.get(op, F.lit(False))
    if isinstance(value, str):
        if op in _ORDER:
            return _ORDER[op](f.text, F.lit(value))
        return f.text == value if op == "==" else f.text != value
    if op in _ORDER:
        return _ORDER[op](f.number, F.lit(value))
    apart = F.abs(f.number - F.lit(value))
    return apart < EPSILON if op == "==" else apart >= EPSILON


def compile_predicate(expr: Expr, fields: Callable[[Path], Field]) -> Column:
    match expr:
        case Everything():
            return F.lit(True)
        case And(a, b):
            return compile_predicate(a, fields) & compile_predicate(b, fields)
        case Or(a, b):
            return compile_predicate(a, fields) | compile_predicate(b, fields)
        case Not(inner):
            return ~compile_predicate(inner, fields)
        case Has(path):
            return _two_valued(fields(path).present)
        case Compare(path, op, value):
            return _two_valued(_compare(fields(path), op, value))
        case Matches(path, pattern):
            return _two_valued(matches(fields(path).text, pattern))
        case Contains(path, needle):
            return _two_valued(F.contains(fields(path).text, F.lit(needle)))
    raise TypeError(expr)
