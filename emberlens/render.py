"""Results as a table, JSON or NDJSON. Aggregates are bounded by the guard and rendered here."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.operators.aggregate import Aggregation
from emberlens.plans.engine import WINDOW, Plan

FORMATS = {"table": "table", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson"}
#: Shown where a group key is missing or null.
MISSING = "\0missing"
#: Fixed value: printed below a table that is not whole.
_LEFT_OUT = "(warning: group-by cardinality limit reached; {} additional value(s) folded into an overflow bucket)"


def output_format(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ValueError(f"unknown --format `{name}` (expected table, json, or ndjson)")
    return FORMATS[name.lower()]


def number(x: float | None) -> str:
    if x is None:
        return "-"
    return str(int(x)) if abs(x - int(x)) < 2.220446049250313e-16 and abs(x) < 1e15 else f"{x:.3f}"


def _table(names: list[str], keys: int, rows: list[list], left_out: int | None) -> str:
    cells = [names] + [[*row[:keys], *map(number, row[keys:])] for row in rows]
    widths = [max(len(r[i].encode()) for r in cells) for i in range(len(names))]
    cells.insert(1, ["-" * w for w in widths])
    lines = ["".join(f"{c:<{w}}  " for c, w in zip(r, widths)) for r in cells]
    if left_out:
        lines += ["", _LEFT_OUT.format(left_out)]
    return "\n".join(lines) + "\n"


def aggregation(plan: Plan, kind: str) -> str:
    """Rows, sorted by the text of their keys, and the overflow, ``limit`` + 1 at most; the input is read once."""
    with plan.aggregation.held():
        return groups(plan.aggregation, plan.aggregation.groups, kind)


def groups(result: Aggregation, found: DataFrame, kind: str) -> str:
    """``found``: groups as ``result`` makes them."""
    names, keys = [*result.names, *map(str, result.wanted)], len(result.names)
    rows, left_out = [], 0
    for r in result.shown(found, True, "o", "records").collect():
        if r[0]:
            left_out = r[1]
            continue
        rows.append([*(MISSING if k is None else str(k) for k in r[2 : 2 + keys]), *(None if x is None else float(x) for x in r[2 + keys :])])
    rows.sort(key=lambda r: r[:keys])
    objects = [dict(zip(names, row)) for row in rows]
    if kind == "ndjson":
        return "".join(json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n" for o in objects)
    if kind == "json":
        whole = {"rows": objects, "truncated": left_out > 0, "truncated_count": left_out}
        return json.dumps(whole, sort_keys=True, indent=2, ensure_ascii=False)
    return _table(names, keys, rows, left_out)


def record_text(df: DataFrame, window: bool = False) -> Column:
    """A record as compact JSON with sorted keys; a bucket overwrites a field of its name."""
    if "v" not in df.columns:
        return F.to_json(F.struct(*df.columns))
    if not window:
        return F.to_json("v")
    members = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: k != WINDOW)
    start = F.map_from_arrays(F.array(F.lit(WINDOW)), F.array(F.try_parse_json(F.col(WINDOW).cast("string"))))
    return F.to_json(F.to_variant_object(F.map_concat(members, start)))


def record_lines(plan: Plan, in_order: bool = False) -> DataFrame:
    """``line`` per record, sorted into input order where that is known and not given already (``in_order``)."""
    df, text = plan.records, record_text(plan.records, plan.query.window is not None)
    return (df.orderBy("pos") if "pos" in df.columns and not in_order and not df.isStreaming else df).select(text.alias("line"))


def records(lines: Iterable[str], kind: str) -> Iterable[str]:
    for line in lines:
        yield json.dumps(json.loads(line), indent=2, ensure_ascii=False, sort_keys=True) if kind == "json" else line
