"""A query over a followed file: Structured Streaming over the tail source.

Each batch is a bounded piece of the file. Records are written as they come; aggregates are
cumulative and are rendered whole after each batch that brought lines.

What a query keeps between batches is written beside its offsets in the checkpoint folder:
the folded parts of its groups (``Aggregation.added``: ``limit`` groups and one overflow, for
exact percentiles with their values' counts, for ``sample`` and ``kll`` with a bounded sample
or sketch of each) and the counts of lines. A key that was not among the first ``limit`` is
not kept, only its records' share of the overflow. State of batch n is made from that of
batch n - 1 and written under n, so a batch that is run again gives the same; the last three
are there. A restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlens import render
from emberlens.plans.engine import Query, over_records
from emberlens.sources import ndjson
from emberlens.sources.tail import BUDGET, read_tail

POLL = "300 milliseconds"
#: States of so many batches are kept.
KEPT = 3


def followed(spark: SparkSession, path: str, max_line_bytes: int = ndjson.DEFAULT_MAX_LINE_BYTES, budget: int = BUDGET) -> DataFrame:
    """Classified lines of a followed file, with ``pos``."""
    lines = read_tail(spark, path, max_line_bytes, budget)
    placed = lines.withColumn("pos", F.shiftleft("gen", 44).bitwiseOR(F.col("at")))
    return ndjson.classify(placed, max_line_bytes)


class State:
    """Tables of a batch, each in the folder of its name."""

    def __init__(self, spark: SparkSession, checkpoint: str) -> None:
        self.spark, self.at = spark, f"{checkpoint.rstrip('/')}/parts"

    def read(self, batch: int, schemas: dict) -> dict[str, DataFrame] | None:  # noqa: ANN401
        """The tables that ``batch`` left; before the first there are none."""
        return {name: self.spark.read.schema(s).parquet(self._of(batch, name)) for name, s in schemas.items()} if batch >= 0 else None

    def write(self, batch: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Written, and read back."""
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(self._of(batch, name))
        return {name: self.spark.read.schema(table.schema).parquet(self._of(batch, name)) for name, table in tables.items()}

    def _of(self, batch: int, name: str) -> str:
        return f"{self.at}/{batch % KEPT}/{name}"


def follow(
    spark: SparkSession,
    path: str,
    query: Query,
    emit: Callable[[str], None],
    checkpoint: str,
    kind: str = "ndjson",
    max_line_bytes: int = ndjson.DEFAULT_MAX_LINE_BYTES,
    trigger: dict | None = None,
    counted: Callable[[dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Start the query; ``emit`` gets rendered text, ``counted`` the lines of each kind so far.

    ``percentiles="approx"`` has no parts to keep, so it is refused.
    """
    if query.aggs and query.percentiles == "approx":
        raise ValueError("percentiles of a followed file are exact, sample or kll")
    state = State(spark, checkpoint)
    tallies = f"{ndjson.RECORD} bigint, {ndjson.BLANK} bigint, {ndjson.MALFORMED} bigint, {ndjson.TOO_LONG} bigint"

    def each(batch: DataFrame, number: int) -> None:
        lines = batch.persist()
        try:
            plan = over_records(ndjson.records(lines), query)
            now = lines.agg(*ndjson.tallies())
            old = state.read(number - 1, {"lines": tallies})
            total = now.union(old["lines"]).groupBy().sum() if old else now
            tables = {"lines": total.toDF(*now.columns)}
            if query.aggs:
                parts = plan.aggregation.added()
                before = state.read(number - 1, {name: p.schema for name, p in parts.items()})
                tables |= plan.aggregation.added(before) if before else parts
            kept = state.write(number, tables)
            if counted is not None:
                counted(kept.pop("lines").first().asDict())
            if query.aggs:
                plan.aggregation.measure(kept)
                emit(render.groups(plan.aggregation, plan.aggregation.groups_of(kept), kind))
            else:
                for text in render.records((r["line"] for r in render.record_lines(plan).toLocalIterator()), kind):
                    emit(text)
        finally:
            lines.unpersist()

    stream = followed(spark, path, max_line_bytes).writeStream.foreachBatch(each)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": POLL})).start()
