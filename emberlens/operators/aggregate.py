"""Grouped aggregates over typed fields, nearest-rank percentiles and the cardinality guard.

Every mode reduces the input to *parts* that can be added up, combined before the shuffle:

* without percentiles, and with sketches (``kll``): a row of counts, sums, bounds and sketches
  for each key;
* ``exact`` (the default): counts of the values for each key, from which all else follows;
* ``sample``: the first kind, and for each key and field the ``capacity`` values whose records
  have the least hash of their position: a uniform sample that does not depend on the layout,
  holds everything up to the capacity, and of two samples gives that of both together;
* ``approx`` has no parts that can be added up: records are read again once the keys are known.

The guard (with an arrival order) admits the first ``limit`` keys. It is found from the parts,
broadcast (``limit`` rows), and folds the parts of all other keys into one overflow group
before anything is put in order or kept. So the input is read once, and groups and overflow
come from the same rows. Parts can be written and added to, as a followed query does: what is
kept then is ``limit`` groups and the overflow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.functions.fields import Field, dotted
from emberlens.plans.language import Path, plain_number

DEFAULT_LIMIT, DEFAULT_CAPACITY = 10_000, 10_000

MODES = ("exact", "sample", "kll", "approx")

#: Other names of the functions.
ALIASES = {"mean": "avg", "median": "p50"}
_SPEC = re.compile(r"([A-Za-z][A-Za-z0-9.+-]*)\((.*)\)", re.DOTALL)


@dataclass(frozen=True)
class AggSpec:
    #: count, sum, avg, min, max or percentile.
    kind: str
    field: str | None = None
    p: float | None = None

    @classmethod
    def parse(cls, text: str) -> AggSpec | None:
        """None where ``text`` is no aggregate."""
        text = text.strip()
        if text.lower() == "count":
            return cls("count")
        m = _SPEC.fullmatch(text)
        if not m or not m[2].strip():
            return None
        name, field = m[1].lower(), m[2].strip()
        name = ALIASES.get(name, name)
        if name in ("sum", "avg", "min", "max"):
            return cls(name, field)
        if name.startswith("p"):
            try:
                return cls("percentile", field, float(name[1:])) if re.fullmatch(r"[0-9.e+-]+", name[1:]) else None
            except ValueError:
                return None
        return None

    def __str__(self) -> str:
        if self.kind == "count":
            return "count"
        return f"{f'p{plain_number(self.p)}' if self.kind == 'percentile' else self.kind}({self.field})"


def specs(*texts: str) -> list[AggSpec]:
    """Of comma-separated lists; a bad one raises ValueError."""
    found = []
    for one in (x for text in texts for x in text.split(",")):
        spec = AggSpec.parse(one)
        if spec is None:
            raise ValueError(f"invalid aggregation spec `{one}`")
        found.append(spec)
    return found


def rank(p: float, n: Column) -> Column:
    """Zero-based place of the p-th percentile among ``n`` sorted values; halves go up."""
    return F.floor(F.lit(min(max(p, 0.0), 100.0) / 100.0) * (n - 1) + 0.5)


def _counts(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Counts of (keys, field number ``f``, value ``x``). Field 1 has every record, with no value if need be."""
    if len(fields) == 1:
        each = rows.select(*keys, "pos", F.lit(1).alias("f"), F.col("m0").alias("x"))
    else:
        each = _each(rows, keys, fields, "pos").where("f = 1 or x is not null")
    return each.groupBy(*keys, "f", "x").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos"))


def _each(rows: DataFrame, keys: list[str], fields: list[str], *more: str) -> DataFrame:
    """A row for each field of each record."""
    entry = F.array(*[F.struct(F.lit(i + 1).alias("f"), F.col(f"m{i}").alias("x")) for i in range(len(fields))])
    return rows.select(*keys, *more, F.explode(entry).alias("e")).select(*keys, *more, "e.f", "e.x")


#: Fine steps of one doubling of a value, and how many of them are a coarse one. A fine bucket
#: has 2 ** 21 different numbers at most (doubles have 2 ** 52 in a doubling), a coarse one has
#: ``COARSE`` fine ones, and there are 4,096 coarse ones in a doubling.
STEPS, COARSE = 1 << 32, 1 << 20
#: Groups of no more different values than this are put in order whole, where that is known.
NARROW = 1 << 20


def _bucket(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises (NaN is greatest)."""
    steps = F.floor((F.log2(F.abs(x)) + 1100) * STEPS).cast("bigint")
    signed = F.when(x > 0, steps).when(x < 0, -steps).otherwise(F.lit(0).cast("bigint"))
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(signed)


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b)])


def _wants(s: AggSpec, fields: list[str]) -> Column:
    return (F.col("f") == fields.index(s.field) + 1) & (F.col("upto") > rank(s.p, F.col("n")))


def _running(rows: DataFrame, group: list[str], by: str) -> DataFrame:
    """``upto``: ``below`` and the counts of the group's rows up to and with this one."""
    before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.col("below") + F.sum("c").over(before))


def _held(values: DataFrame, keys: list[str], ranked: Sequence[AggSpec], fields: list[str]) -> DataFrame:
    """``values`` (``f, x, c``) of the fine buckets ``b`` that hold the percentiles' places, with ``n`` and ``below``.

    Values are counted by fine buckets and these by coarse ones; running sums over a group's
    coarse buckets tell which hold a place, over their fine ones which of those do. Every sum
    runs over a number of rows that the buckets bound, however many values a group has and
    wherever they lie.
    """
    place = reduce(lambda a, b: a | b, [_wants(s, fields) & (F.col("upto") - F.col("c") <= rank(s.p, F.col("n"))) for s in ranked])
    numbers = sorted({fields.index(s.field) + 1 for s in ranked})
    values = values.where(F.col("f").isin(numbers) & F.col("x").isNotNull()).select(*keys, "f", "x", "c", _bucket(F.col("x")).alias("b"))
    group = [*keys, "f"]
    # Through a generator, so that both readers share one shuffle.
    fine = values.groupBy(*group, "b").agg(F.sum("c").alias("c"))
    fine = fine.select(F.inline(F.array(F.struct(*fine.columns)))).withColumn("w", F.floor(F.col("b") / COARSE))
    coarse = fine.groupBy(*group, "w").agg(F.sum("c").alias("c")).withColumn("below", F.lit(0).cast("bigint"))
    coarse = _running(coarse, group, "w").withColumn("n", F.sum("c").over(Window.partitionBy(*group))).where(place)

    def named(df: DataFrame, *at: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_") for c in (*group, *at)], (F.col("upto") - F.col("c")).alias("below"), "n")

    def beside(df: DataFrame, held: DataFrame, at: str) -> DataFrame:
        both = [*group, at]
        return df.join(held, _same(both, [f"{c}_" for c in both])).select(*df.columns, "below", "n")

    narrow = _running(beside(fine, named(coarse, "w"), "w"), [*group, "w"], "b").where(place)
    return beside(values, named(narrow, "b"), "b")


def _ranked(values: DataFrame, keys: list[str], wanted: Sequence[AggSpec], fields: list[str]) -> DataFrame:
    """``keys`` and, under the names a0, a1, ..., the wanted percentiles of ``values``."""
    inside = _held(values, keys, [s for s in wanted if s.kind == "percentile"], fields)
    return _running(inside, [*keys, "f", "b"], "x").groupBy(*keys).agg(*_places(wanted, fields))


def _places(wanted: Sequence[AggSpec], fields: list[str]) -> list[Column]:
    return [F.min(F.when(_wants(s, fields), F.col("x"))).alias(f"a{i}") for i, s in enumerate(wanted) if s.kind == "percentile"]


def _in_order(values: DataFrame, keys: list[str]) -> DataFrame:
    """``values`` with ``upto`` and ``n``, for groups of ``NARROW`` values at most: one shuffle, by the keys."""
    group = Window.partitionBy(*keys, "f")
    amount = F.when(F.col("x").isNotNull(), F.col("c")).otherwise(F.lit(0).cast("bigint"))
    upto = F.sum(amount).over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return values.repartition(*keys).select("*", upto.alias("upto"), F.sum(amount).over(group).alias("n"))


class Aggregation:
    """What an aggregate query gives: ``rows``, and on request ``overflow`` and ``report``.

    ``df`` is the filtered input, ``keys`` maps result columns to the Columns of the group
    keys. With ``order`` (the arrival position) only the first ``limit`` distinct keys are
    reported; the others' records form the overflow. A query without keys has no guard, and
    over no records gives no row.
    """

    def __init__(
        self,
        df: DataFrame,
        fields: Callable[[Path], Field],
        keys: dict[str, Column],
        wanted: Sequence[AggSpec],
        order: Column | None = None,
        limit: int = DEFAULT_LIMIT,
        percentiles: str = "exact",
        capacity: int = DEFAULT_CAPACITY,
    ) -> None:
        if percentiles not in MODES:
            raise ValueError(f"unknown percentile mode `{percentiles}`")
        self.names, self.wanted = list(keys), list(dict.fromkeys(wanted))
        self.capacity = max(1, capacity)
        self.mode = percentiles if any(s.kind == "percentile" for s in self.wanted) else "none"
        self.limit = max(1, limit) if order is not None and keys else None
        self.measures = list(dict.fromkeys(s.field for s in self.wanted if s.field is not None))
        self.keys = [f"k{i}" for i in range(len(keys))]
        #: Overflow flag, then the keys: what parts and groups are told apart by.
        self.by = ["o", *self.keys]
        #: Known to have ``NARROW`` different values of a group and field at most.
        self.narrow = self.mode == "sample" and self.capacity <= NARROW
        if self.mode == "sample":  # lets Spark cut each task's rows before the shuffle, too
            df.sparkSession.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", self.capacity)
        self.input = df.select(
            F.lit(False).alias("o"),
            *[c.alias(k) for k, c in zip(self.keys, keys.values())],
            *[fields(dotted(m)).number.alias(f"m{i}") for i, m in enumerate(self.measures)],
            (order if order is not None else F.lit(0)).alias("pos"),
            *([F.xxhash64(order if order is not None else F.monotonically_increasing_id()).alias("h")] if self.mode == "sample" else []),
        )

    # Parts: tables that can be added up, by name.

    def _stats(self) -> dict[str, Column]:
        made: dict[str, Column] = {"records": F.count(F.lit(1)), "pos": F.min("pos")}
        for i in range(len(self.measures)):
            x = F.col(f"m{i}")
            made |= {f"n{i}": F.count(x), f"s{i}": F.sum(x), f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
            if self.mode == "kll":
                made[f"q{i}"] = F.kll_sketch_agg_double(x)
        return made

    def _least(self, values: DataFrame) -> DataFrame:
        """Of each group and field the ``capacity`` values of least hash."""
        place = F.row_number().over(Window.partitionBy(*self.by, "f").orderBy("h", "x"))
        return values.withColumn("place", place).where(F.col("place") <= self.capacity).drop("place")

    def _sampled(self, rows: DataFrame) -> DataFrame:
        each = _each(rows, self.by, self.measures, "h").where("x is not null")
        return self._least(each.select(*self.by, "f", "x", F.lit(1).cast("bigint").alias("c"), "h"))

    @cached_property
    def parts(self) -> dict[str, DataFrame]:
        """The input's parts, with all keys; a sample is of the admitted keys and the overflow."""
        if self.mode == "exact":
            first = _counts(self.input, self.by, self.measures)
        else:
            first = self.input.groupBy(*self.by).agg(*[c.alias(k) for k, c in self._stats().items()])
        # Through a generator, so that all readers ask for the same columns and share one shuffle.
        return {"values" if self.mode == "exact" else "stats": first.select(F.inline(F.array(F.struct(*first.columns))))}

    @contextmanager
    def held(self) -> Iterator[None]:
        """Parts kept on the executors (on their disks, if need be) while the groups are collected.

        Spark shares the shuffle of parts between their readers where it can tell that these
        read the same source, which it cannot for data sources in Python. With the folded parts
        at hand, one more action tells how many values the widest group has: mostly few enough
        to put each group in order whole.
        """
        if self.mode == "approx":
            yield
            return
        self.__dict__["parts"] = {name: part.persist() for name, part in self.parts.items()}
        kept = list(self.parts.values())
        try:
            if self.mode == "exact":
                values = self.folded["values"].persist()
                self.folded["values"] = values
                kept.append(values)
                self.measure(self.folded)
            yield
        finally:
            for part in kept:
                part.unpersist()

    def _admitted(self, *parts: DataFrame) -> DataFrame | None:
        """The first ``limit`` keys: so many rows at most, broadcast."""
        if self.limit is None:
            return None
        seen = reduce(DataFrame.unionByName, [p.where("not o").select(*self.keys, "pos") for p in parts])
        first = seen.groupBy(*self.keys).agg(F.min("pos").alias("first")).orderBy("first").limit(self.limit)
        return F.broadcast(first.select(*[F.col(k).alias(f"{k}_") for k in self.keys], F.lit(True).alias("let")))

    def _folded(self, rows: DataFrame, let: DataFrame | None) -> DataFrame:
        """``rows`` with all keys that are not admitted made one, the overflow."""
        if let is None:
            return rows
        beside = rows.join(let, _same(self.keys, [f"{k}_" for k in self.keys]), "left")
        out = F.col("o") | F.col("let").isNull()
        others = [c for c in rows.columns if c not in self.by]
        return beside.select(out.alias("o"), *[F.when(~out, F.col(k)).alias(k) for k in self.keys], *others)

    def _combined(self, name: str, parts: DataFrame) -> DataFrame:
        if name == "values" and self.mode == "sample":
            return self._least(parts)
        if name == "values":
            return parts.groupBy(*self.by, "f", "x").agg(F.sum("c").alias("c"), F.min("pos").alias("pos"))
        how = {"records": F.sum, "pos": F.min, "n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max, "q": F.kll_merge_agg_double}
        return parts.groupBy(*self.by).agg(*[how[c.rstrip("0123456789")](c).alias(c) for c in parts.columns if c not in self.by])

    def added(self, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The input's parts and those of ``before`` (folded ones, of earlier records) as one: groups and overflow."""
        own, before = dict(self.parts), before or {}
        source = "values" if self.mode == "exact" else "stats"
        let = self._admitted(own[source], *([before[source]] if before else []))
        if self.mode == "sample":
            own["values"] = self._sampled(self._folded(self.input, let))
        found = {}
        for name, mine in own.items():
            folded = mine if name != source else self._folded(mine, let)
            if before:
                folded = folded.unionByName(before[name])
            found[name] = self._combined(name, folded) if before or (let is not None and name == source) else folded
        return found

    @cached_property
    def folded(self) -> dict[str, DataFrame]:
        """Parts of the admitted groups and the overflow."""
        return self.added()

    def measure(self, parts: dict[str, DataFrame]) -> None:
        """An action that learns from folded parts how wide the groups are; parts should be written or held."""
        if self.mode == "exact":
            sizes = parts["values"].groupBy(*self.by, "f").agg(F.count(F.lit(1)).alias("n"))
            self.narrow = (sizes.agg(F.max("n").alias("n")).first()["n"] or 0) <= NARROW

    # Groups.

    def _from_values(self, values: DataFrame) -> tuple[list[Column], list[Column]]:
        """Aggregates but percentiles from value counts, and what each group has besides."""

        def value(s: AggSpec) -> Column:
            if s.kind == "count":
                return F.sum(F.when(F.col("f") == 1, F.col("c")))
            mine = F.col("f") == self.measures.index(s.field) + 1
            x = F.when(mine, F.col("x"))
            if s.kind in ("min", "max"):
                return {"min": F.min, "max": F.max}[s.kind](x)
            total = F.sum(x * F.col("c"))
            return total if s.kind == "sum" else total / F.sum(F.when(mine & F.col("x").isNotNull(), F.col("c")))

        return [value(s) for s in self.wanted if s.kind != "percentile"], [F.sum(F.when(F.col("f") == 1, F.col("c"))).alias("records"), F.min("pos").alias("first")]

    def _from_stats(self, s: AggSpec) -> Column:
        if s.kind == "count":
            return F.col("records")
        i = self.measures.index(s.field)
        if s.kind == "percentile":
            return F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"q{i}", F.lit(min(max(s.p, 0.0), 100.0) / 100.0)))
        return {"sum": F.col(f"s{i}"), "avg": F.col(f"s{i}") / F.col(f"n{i}"), "min": F.col(f"lo{i}"), "max": F.col(f"hi{i}")}[s.kind]

    def groups_of(self, parts: dict[str, DataFrame]) -> DataFrame:
        """``o``, the keys, ``a0, a1, ...``, ``records`` and ``first`` of folded parts."""
        kind = lambda s: "bigint" if s.kind == "count" else "double"
        plain = [(f"a{i}", s) for i, s in enumerate(self.wanted) if self.mode == "kll" or s.kind != "percentile"]
        if self.mode == "exact":
            made, more = self._from_values(parts["values"])
            made = [c.cast(kind(s)).alias(a) for (a, s), c in zip(plain, made)]
            if self.narrow:
                found = _in_order(parts["values"], self.by).groupBy(*self.by).agg(*made, *_places(self.wanted, self.measures), *more)
                return found.select(*self.by, *[f"a{i}" for i in range(len(self.wanted))], "records", "first").where("records > 0")
            found = parts["values"].groupBy(*self.by).agg(*made, *more)
        else:
            found = parts["stats"].select(*self.by, *[self._from_stats(s).cast(kind(s)).alias(a) for a, s in plain], "records", F.col("pos").alias("first"))
        if self.mode in ("exact", "sample"):
            ranks = (
                _in_order(parts["values"], self.by).groupBy(*self.by).agg(*_places(self.wanted, self.measures))
                if self.narrow
                else _ranked(parts["values"], self.by, self.wanted, self.measures)
            )
            # Side by side through one grouping, which takes null keys for equal.
            both = found.unionByName(ranks, allowMissingColumns=True)
            names = [*[f"a{i}" for i in range(len(self.wanted))], "records", "first"]
            found = both.groupBy(*self.by).agg(*[F.max(c).alias(c) for c in names])
        return found.where("records > 0")

    @cached_property
    def groups(self) -> DataFrame:
        """The groups that the guard lets through, ``limit`` at most, and the overflow (``o``), if there is one."""
        if self.mode != "approx":
            return self.groups_of(self.folded)
        let = self._admitted(self.input)

        def value(s: AggSpec) -> Column:
            if s.kind == "count":
                return F.count(F.lit(1))
            x = F.col(f"m{self.measures.index(s.field)}")
            if s.kind == "percentile":
                return F.percentile_approx(x, min(max(s.p, 0.0), 100.0) / 100.0, self.capacity)
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[s.kind](x)

        return self._folded(self.input, let).groupBy(*self.by).agg(
            *[value(s).alias(f"a{i}") for i, s in enumerate(self.wanted)], F.count(F.lit(1)).alias("records"), F.min("pos").alias("first")
        )

    def shown(self, groups: DataFrame, keys: bool = True, *more: str) -> DataFrame:
        names = [F.col(k).alias(n) for k, n in zip(self.keys, self.names)] if keys else []
        return groups.select(*more, *names, *[F.col(f"a{i}").alias(str(s)) for i, s in enumerate(self.wanted)])

    @property
    def rows(self) -> DataFrame:
        found = self.shown(self.groups.where("not o"))
        order = [F.col(f"`{n}`").cast("string").asc_nulls_first() for n in self.names]
        return found.orderBy(*order) if order else found

    @property
    def overflow(self) -> DataFrame:
        """One row: the same aggregates over the records of the groups left out; none, if there are none."""
        return self.shown(self.groups.where("o"), False)

    @property
    def report(self) -> DataFrame:
        """One row: groups kept, and the records and distinct keys left out."""
        keys = self.input.select(*self.by, "pos") if self.mode == "approx" else next(iter(self.parts.values()))
        amount = F.sum(F.when(F.col("f") == 1, F.col("c"))) if self.mode == "exact" else F.count(F.lit(1)) if self.mode == "approx" else F.sum("records")
        each = keys.groupBy(*self.by).agg(amount.alias("records"))
        each = self._folded(each.withColumn("every", F.lit(1)), self._admitted(keys))
        out = lambda c: F.coalesce(F.sum(F.when(F.col("o"), F.col(c))), F.lit(0))
        return each.agg(
            F.count_if(~F.col("o")).alias("groups"), out("records").alias("truncated_records"), out("every").cast("bigint").alias("truncated_keys")
        ).select("*", (F.col("truncated_keys") > 0).alias("truncated"))
