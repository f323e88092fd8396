"""Command line: ``python -m emberlens.cli [FILE] --query Q --agg A ...``."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys
import tempfile
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession

from emberlens import render
from emberlens.functions.patterns import PatternError
from emberlens.functions.times import TimeError
from emberlens.operators.aggregate import DEFAULT_CAPACITY, DEFAULT_LIMIT, MODES
from emberlens.plans.engine import Query, over_records
from emberlens.plans.language import QueryError
from emberlens.sources import ndjson, splits

NAME = "emberlens"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(NAME, description="Search logs of one JSON object a line, or summarise them by group and time, on Spark.")
    p.add_argument("file", nargs="?", help="log file; standard input if omitted")
    p.add_argument("-q", "--query", help="filter, such as: status >= 500 and not path contains \"/health\"")
    p.add_argument("-a", "--agg", action="append", default=[], help="count, sum(f), avg(f), min(f), max(f), pN(f); comma-separated")
    p.add_argument("-g", "--group-by", action="append", default=[], help="fields, comma-separated")
    p.add_argument("--since", help="RFC3339 time, or a duration before now")
    p.add_argument("--until", help="RFC3339 time, or a duration before now")
    p.add_argument("--time-field", default="timestamp")
    p.add_argument("-w", "--window", help="size of tumbling buckets, such as 1m")
    p.add_argument("-f", "--format", default="table", help="table, json or ndjson")
    p.add_argument("-F", "--follow", action="store_true", help="go on with lines that are added, across rotations")
    p.add_argument("--cardinality-limit", type=int, default=DEFAULT_LIMIT)
    p.add_argument("--reservoir-capacity", type=int, help=f"values kept of each group for percentiles (implies --percentiles sample; {DEFAULT_CAPACITY})")
    p.add_argument("--percentiles", choices=MODES, help="exact; with --follow or --reservoir-capacity: sample, which is exact up to the capacity")
    p.add_argument("--checkpoint", help="with --follow: folder for offsets and state, to go on from after a restart")
    p.add_argument("--max-line-bytes", type=int, default=ndjson.DEFAULT_MAX_LINE_BYTES)
    return p


def _query(a: argparse.Namespace, spark: SparkSession) -> tuple[Query, str]:
    try:
        query = Query.of(
            a.query, a.agg, a.group_by, a.since, a.until, a.window, time_field=a.time_field,
            limit=a.cardinality_limit, capacity=a.reservoir_capacity if a.reservoir_capacity is not None else DEFAULT_CAPACITY,
            percentiles=a.percentiles or ("exact" if a.reservoir_capacity is None and not a.follow else "sample"),
        )
        kind = render.output_format(a.format)
        return query.check(spark), kind
    except QueryError as e:
        raise ValueError(f"query error at {e}") from None
    except PatternError as e:
        raise ValueError(f"query error: {e}") from None


def _session() -> SparkSession:
    return SparkSession.builder.appName(NAME).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = spark or _session()
    try:
        query, kind = _query(a, spark)
        with contextlib.ExitStack() as stack:
            path = a.file
            if path is None:
                spool = stack.enter_context(tempfile.NamedTemporaryFile("wb", suffix=".ndjson", dir=_spool(spark)))
                for block in iter(lambda: sys.stdin.buffer.read(1 << 20), b""):
                    spool.write(block)
                spool.flush()
                path = spool.name
            elif not os.path.exists(path) and "://" not in path:
                raise ValueError(f"cannot open {path}: No such file or directory")
            if a.follow and a.file:
                return _follow(a, spark, query, kind, stack)
            _batch(a, spark, query, kind, path)
    except (ValueError, TimeError) as e:
        print(f"{NAME}: {e}", file=sys.stderr)
        return 1
    return 0


def _spool(spark: SparkSession) -> str | None:
    """Where executors can read what came on standard input: the shared folder; here, if all run here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at and splits.local(at):
        at = at.removeprefix("file://").removeprefix("file:")
        os.makedirs(at, exist_ok=True)
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("standard input needs spark.checkpoint.dir on a file system that the executors mount")
    return None


def _batch(a: argparse.Namespace, spark: SparkSession, query: Query, kind: str, path: str) -> None:
    """Every byte of the input is read once."""
    total: Counter[str] = Counter()

    def observed(lines: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation("lines")
        return ndjson.records(ndjson.classify(lines, a.max_line_bytes).observe(seen, *ndjson.tallies())), seen

    ranges = splits.splits(path) if splits.local(path) else None
    if query.aggs:
        # The bounded result is one action, which carries the counts along.
        lines, seen = observed(ndjson.read_lines(spark, path) if ranges is None else splits.read_splits(spark, ranges, a.max_line_bytes))
        print(render.aggregation(over_records(lines, query), kind))
        if ranges is None or ranges:  # without a range nothing is read, and nothing observed
            total.update(seen.get)
    elif ranges is None:
        # Another store's files: their order is known by their positions only.
        lines = ndjson.classify(ndjson.read_lines(spark, path), a.max_line_bytes)
        for text in render.records((r["line"] for r in render.record_lines(over_records(ndjson.records(lines), query)).toLocalIterator()), kind):
            print(text)
        total.update(ndjson.line_counts(lines).first().asDict())
    else:
        # Some ranges at a time, all cores on them: printed in input order without a sort, and while later ones are unread.
        for wave in splits.waves(ranges, 2 * spark.sparkContext.defaultParallelism):
            lines, seen = observed(splits.read_splits(spark, wave, a.max_line_bytes))
            for text in render.records((r["line"] for r in render.record_lines(over_records(lines, query), in_order=True).collect()), kind):
                print(text)
            total.update(seen.get)
    _skipped(total, a.max_line_bytes)


def _skipped(counts: Mapping[str, int], cap: int) -> None:
    if counts.get(ndjson.MALFORMED):
        print(f"{NAME}: skipped {counts[ndjson.MALFORMED]} malformed line(s)", file=sys.stderr)
    if counts.get(ndjson.TOO_LONG):
        print(f"{NAME}: skipped {counts[ndjson.TOO_LONG]} line(s) longer than --max-line-bytes ({cap})", file=sys.stderr)


def _follow(a: argparse.Namespace, spark: SparkSession, query: Query, kind: str, stack: contextlib.ExitStack) -> int:
    from emberlens.streaming.follow import follow

    at = a.checkpoint or stack.enter_context(tempfile.TemporaryDirectory(prefix="emberlens-follow-", dir=_spool(spark)))
    counts: dict[str, int] = {}
    running = follow(spark, a.file, query, lambda text: print(text, flush=True), at, kind, a.max_line_bytes, counted=counts.update)
    try:
        running.awaitTermination()
    except KeyboardInterrupt:
        running.stop()
        _skipped(counts, a.max_line_bytes)
    return 0


if __name__ == "__main__":
    sys.exit(main())
