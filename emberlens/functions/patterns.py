"""Regular expressions of the filter language, in Java's dialect.

The language's patterns are unanchored, Unicode-aware, without look-around or
back-references; ``.`` excludes only a line feed and ``$`` is the end of the text.

Time is linear in the text, or a low power of it: a pattern that may take Java's backtracking
engine longer (``ambiguity``) is matched by RE2 on Arrow batches instead of by ``rlike``.
There ``\\b`` knows ASCII words only.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlens.functions.ambiguity import hazardous

_REFUSED = (
    (re.compile(r"\(\?(?:<?[=!])"), "look-around is not supported"),
    (re.compile(r"\\[1-9]|\\k<"), "back-references are not supported"),
    (re.compile(r"[*+?}]\+"), "possessive quantifiers are not supported"),
)
_UNIT = re.compile(r"\\.|\[(?:\\.|\[:\^?\w+:\]|[^\]\\])+\]|\(\?P<|\(\?[a-zA-Z-]*[:)]|\$|.", re.DOTALL)


class PatternError(ValueError):
    def __init__(self, pattern: str, why: str) -> None:
        super().__init__(f"invalid regex `{pattern}`: {why}")


def to_java(pattern: str) -> str:
    plain = re.sub(r"\\[^1-9k]|\[(?:\\.|[^\]\\])*\]", " ", pattern, flags=re.DOTALL)
    for refused, why in _REFUSED:
        if refused.search(plain):
            raise PatternError(pattern, why)
    out, lines = ["(?dU)"], False
    for unit in _UNIT.findall(pattern):
        if unit == "(?P<":
            out.append("(?<")
        elif unit.startswith("(?") and len(unit) > 2 and unit[-1] in ":)":
            on = unit[2:-1].split("-")[0]
            lines |= "m" in on
            out.append(unit[:2] + ("u" if "i" in on else "") + unit[2:])
        elif unit == "$":
            out.append("$" if lines else r"\z")
        else:
            out.append(unit)
    return "".join(out)


#: What RE2's own classes are too narrow for, outside and inside brackets.
_DIGIT, _LETTER, _SPACE = r"\p{Nd}", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}", r"\t-\r \x{85}\p{Z}"
_ALONE = {"d": _DIGIT, "D": r"\P{Nd}", "w": f"[{_LETTER}]", "W": f"[^{_LETTER}]", "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]"}
_AMONG = {"d": _DIGIT, "D": r"\P{Nd}", "w": _LETTER, "s": _SPACE}


def to_re2(pattern: str) -> str:
    """The pattern in RE2's dialect; ``PatternError`` where it has no such form."""

    def among(found: re.Match) -> str:
        if found[1] in "WS":
            raise PatternError(pattern, rf"takes exponential time, and has \{found[1]} inside brackets")
        return _AMONG.get(found[1], found[0])

    out = []
    for unit in _UNIT.findall(pattern):
        if unit[0] == "\\":
            out.append(_ALONE.get(unit[1:], unit))
        elif unit[0] == "[" and len(unit) > 1:
            if re.search(r"&&|--|~~|[^\\]\[(?!:)", unit):
                raise PatternError(pattern, "takes exponential time, and has sets of sets inside brackets")
            out.append(re.sub(r"\\(.)", among, unit, flags=re.DOTALL))
        else:
            out.append(unit)
    java = re.sub(r"\(\?<(?![=!])", "(?P<", "".join(out))
    return re.sub(r"\\[uU](?:\{(\w+)\}|(\w{4}))", lambda m: rf"\x{{{m[1] or m[2]}}}", java)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere in the text; null where the text is."""
    if not hazardous(pattern):
        return text.rlike(to_java(pattern))
    linear = to_re2(pattern)

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, linear)

    return found(text)


def check(spark: SparkSession, pattern: str) -> None:
    """Raise ``PatternError`` now: Spark itself compiles a pattern only when a row reaches it."""
    java = to_java(pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:  # a Py4J error that carries Java's own message
        why = getattr(getattr(e, "java_exception", None), "getDescription", lambda: str(e))()
        raise PatternError(pattern, str(why)) from None
    if hazardous(pattern):
        try:
            pc.match_substring_regex(pa.array([""]), to_re2(pattern))
        except pa.ArrowInvalid as e:
            raise PatternError(pattern, f"takes exponential time, and RE2 has no such form: {e}") from None
