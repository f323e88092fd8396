"""A query as one plan, the same for batch and stream.

    lines -> records -> time range -> predicate -> bucket -> records out, or aggregates
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.functions import patterns, times
from emberlens.functions.fields import ColumnFields, RecordFields, dotted
from emberlens.operators.aggregate import DEFAULT_CAPACITY, DEFAULT_LIMIT, Aggregation, AggSpec, specs
from emberlens.operators.predicate import compile_predicate
from emberlens.plans.language import Everything, Expr, Matches, leaves, parse

WINDOW = "_window_start"


@dataclass(frozen=True)
class Query:
    expr: Expr = field(default_factory=Everything)
    aggs: tuple[AggSpec, ...] = ()
    group_by: tuple[str, ...] = ()
    since: datetime | None = None
    until: datetime | None = None
    time_field: str = "timestamp"
    #: Seconds of a tumbling bucket.
    window: int | None = None
    limit: int = DEFAULT_LIMIT
    capacity: int = DEFAULT_CAPACITY
    percentiles: str = "exact"

    @classmethod
    def of(
        cls,
        query: str | None = None,
        agg: str | list[str] = "",
        group_by: str | list[str] = "",
        since: str | None = None,
        until: str | None = None,
        window: str | None = None,
        now: datetime | None = None,
        **more: object,
    ) -> Query:
        """From texts. Relative times are taken from ``now`` once."""
        listed = lambda x: [y for part in ([x] if isinstance(x, str) else x) if part for y in part.split(",")]
        now = now or datetime.now(UTC)
        at = {}
        for name, text in (("since", since), ("until", until)):
            try:
                at[name] = times.instant(text, now) if text is not None else None
            except times.TimeError as e:
                raise times.TimeError(f"invalid --{name}: {e}") from None
        try:
            seconds = times.bucket_seconds(window) if window is not None else None
        except times.TimeError as e:
            raise times.TimeError(f"invalid --window: {e}") from None
        return cls(expr=parse(query), aggs=tuple(specs(*listed(agg)) if agg else ()), group_by=tuple(listed(group_by)), window=seconds, **at, **more)

    def check(self, spark: SparkSession) -> Query:
        """Raise for patterns that do not compile, before anything is read."""
        for leaf in leaves(self.expr):
            if isinstance(leaf, Matches):
                patterns.check(spark, leaf.pattern)
        return self


class Plan:
    """``records`` is the filtered input; ``aggregation`` is there if the query aggregates."""

    def __init__(self, df: DataFrame, query: Query, fields: RecordFields | ColumnFields, order: Column | None = None) -> None:
        self.query = query.check(df.sparkSession)
        at = times.of_field(fields(dotted(query.time_field)))
        kept = df
        if query.since is not None or query.until is not None:
            kept = kept.where(times.within(at, query.since, query.until))
        kept = kept.where(compile_predicate(query.expr, fields))
        keys = {}
        if query.window is not None:
            kept = kept.withColumn(WINDOW, times.bucket(at, query.window)).where(F.col(WINDOW).isNotNull())
            keys[WINDOW] = F.col(WINDOW)
        self.records = kept
        for name in query.group_by:
            keys[name] = F.col(WINDOW).cast("string") if name == WINDOW and query.window is not None else fields(dotted(name)).display
        self.aggregation = (
            Aggregation(kept, fields, keys, query.aggs, order, query.limit, query.percentiles, query.capacity) if query.aggs else None
        )

    @property
    def result(self) -> DataFrame:
        return self.aggregation.rows if self.aggregation else self.records


def over_records(df: DataFrame, query: Query) -> Plan:
    """Over NDJSON records (``raw, v`` and, if in arrival order, ``pos``)."""
    return Plan(df, query, RecordFields(), F.col("pos") if "pos" in df.columns else None)


def over_columns(df: DataFrame, query: Query, order_by: str | None = None, json: tuple[str, ...] = ()) -> Plan:
    """Over an ordinary DataFrame. ``json`` names text columns that hold JSON; paths go into them.

    The guard needs an arrival order, so it works only with ``order_by``.
    """
    parsed = df
    if json:
        whole = [F.try_parse_json(F.col(c)).alias(c) for c in json]
        parsed = df.select(*[c for c in df.columns if c not in json], *[F.col(c).alias(f"__{c}") for c in json], F.inline(F.array(F.struct(*whole))))
    plan = Plan(parsed, query, ColumnFields(parsed.schema), F.col(order_by) if order_by else None)
    if json:
        plan.records = plan.records.select(
            *[F.col(f"__{c}").alias(c) if c in json else F.col(c) for c in df.columns], *([WINDOW] if query.window is not None else [])
        )
    return plan
