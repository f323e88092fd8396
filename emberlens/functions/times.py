"""Instants, durations and tumbling buckets."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlens.functions.fields import Field

#: Spellings of each unit and its length in nanoseconds.
UNITS = {
    "nsec ns": 1,
    "usec us": 10**3,
    "msec ms": 10**6,
    "seconds second sec s": 10**9,
    "minutes minute mins min m": 60 * 10**9,
    "hours hour hrs hr h": 3600 * 10**9,
    "days day d": 86400 * 10**9,
    "weeks week wk w": 7 * 86400 * 10**9,
    "months month M": 2630016 * 10**9,
    "years year yr y": 31557600 * 10**9,
}
_NANOS = {name: n for names, n in UNITS.items() for name in names.split()}
#: Fixed value: what an error says.
_NO_INSTANT = "`{}` is not a valid RFC3339 timestamp or a duration like `5m`, `2h`, `1d`"
INSTANT = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,9})?Z?$"
#: Numbers above this are milliseconds, others seconds.
MILLIS_FROM = 1e12


class TimeError(ValueError):
    pass


def duration_nanos(text: str) -> int:
    """``1h 30m``, ``500ms``, ``2days``: whole numbers with units, added up."""
    rest, total = text.strip(), 0
    if not rest:
        raise TimeError("value was empty")
    if rest == "0":
        return 0
    while rest:
        m = re.match(r"(\d+)\s*([A-Za-z]+)\s*", rest, re.ASCII)
        if not m:
            raise TimeError(f"`{text}` is not a duration like `30s`, `5m`, `1h 30m`")
        if m[2] not in _NANOS:
            raise TimeError(f"unknown time unit `{m[2]}`")
        total += int(m[1]) * _NANOS[m[2]]
        rest = rest[m.end() :]
    return total


def instant(text: str, now: datetime) -> datetime:
    """A point in time, or a duration before ``now``."""
    if re.fullmatch(INSTANT.strip("^$"), text):
        head, _, fraction = text.rstrip("Z").replace(" ", "T").partition(".")
        try:
            return datetime.fromisoformat(head).replace(tzinfo=UTC) + timedelta(microseconds=int((fraction + "000000")[:6]))
        except ValueError as e:
            raise TimeError(f"`{text}`: {e}") from None
    try:
        nanos = duration_nanos(text)
    except TimeError:
        raise TimeError(_NO_INSTANT.format(text)) from None
    try:
        found = now - timedelta(microseconds=nanos // 1000)
    except OverflowError:
        found = None
    if found is None or found < datetime(1970, 1, 1, tzinfo=UTC):
        raise TimeError(f"duration `{text}` underflows the epoch")
    return found


def of_field(f: Field) -> Column:
    """The instant a field holds: a timestamp, text, or a number of seconds or milliseconds."""
    text = F.when(f.text.rlike(INSTANT), F.try_to_timestamp(F.regexp_replace(f.text, "Z$", "")))
    millis = F.when(f.number < 9.2e15, F.timestamp_millis(F.when(f.number < 9.2e15, f.number).cast("bigint")))
    seconds = F.timestamp_seconds(F.when(f.number <= MILLIS_FROM, F.greatest(f.number, F.lit(0.0))))
    return F.coalesce(f.instant, text, F.when(f.number > MILLIS_FROM, millis).otherwise(seconds))


def bucket_seconds(text: str) -> int:
    return max(1, duration_nanos(text) // 10**9)


def bucket(at: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket, in seconds; before the epoch, 0."""
    start = (F.floor(F.unix_seconds(at) / seconds) * seconds).cast("bigint")
    return F.when(start < 0, 0).otherwise(start)


def within(at: Column, since: datetime | None, until: datetime | None) -> Column:
    """Both ends count; no instant is outside."""
    kept = F.lit(True)
    for bound, test in ((since, lambda b: at >= b), (until, lambda b: at <= b)):
        if bound is not None:
            kept &= F.coalesce(test(F.lit(bound)), F.lit(False))
    return kept
