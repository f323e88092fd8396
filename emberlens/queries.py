"""The registered queries over the test tables, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens import render
from emberlens.plans.engine import WINDOW, Query, over_columns, over_records
from emberlens.sources import ndjson, splits

EPS = "2.220446049250313e-16"
NOW = datetime(2024, 1, 1, 12, tzinfo=UTC)

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _FOUND[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ndjson.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filter(name: str, table: str, columns: str, query: str, where: str, **more: object) -> None:
    """A filter over a table; the result has ``columns``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return over_columns(_table(spark, sf_dir, table), Query.of(query, now=NOW), **more).records.select(*columns.split(", "))

    _register(name, f"SELECT {columns} FROM {table} WHERE {where}")(run)


_filter("filter_everything", "nation", "n_nationkey, n_name", "", "true")
_filter("filter_num_ge", "events", "event_id, user_id, value", "value >= 50", "value >= 50")
_filter("filter_num_order", "lineitem", "l_orderkey, l_linenumber, l_quantity", "l_quantity > 10 and l_quantity <= 20 and l_discount < 0.05",
        "l_quantity > 10 AND l_quantity <= 20 AND l_discount < 0.05")
_filter("filter_num_eq", "events", "event_id, user_id", "user_id == 12", f"abs(user_id - 12) < {EPS}")
_filter("filter_num_ne", "events", "event_id, user_id", "user_id != 12", f"abs(user_id - 12) >= {EPS}")
_filter("filter_str_eq", "events", "event_id, event_type", 'event_type == "error"', "event_type = 'error'")
_filter("filter_str_ne", "customer", "c_custkey, c_mktsegment", 'c_mktsegment != "BUILDING"', "c_mktsegment <> 'BUILDING'")
_filter("filter_str_order", "events", "event_id, event_type", 'event_type > "error" and event_type <= "signup"', "event_type > 'error' AND event_type <= 'signup'")
_filter("filter_and_or_not", "events", "event_id, event_type, value",
        'not (event_type == "click" or value < 10) and (value < 80 or event_type == "error")',
        "NOT (event_type = 'click' OR value < 10) AND (value < 80 OR event_type = 'error')")
_filter("filter_contains", "documents", "doc_id", 'text contains "License"', "contains(text, 'License')")
_filter("filter_regex", "pages", "page_id, url", 'url ~ "^https?://[^/]+[.]com(/|$)"', "regexp_matches(url, '^https?://[^/]+[.]com(/|$)')")
_filter("filter_regex_ambiguous", "pages", "page_id, url", 'url ~ "^https?://([a-z0-9]+[.]?)+/(.*/?)*[05]$"', "regexp_matches(url, '^https?://([a-z0-9]+[.]?)+/(.*/?)*[05]$')")
_filter("filter_nested_json", "events", "event_id, props", "props.k >= 50", "CAST(json_extract(props::JSON, '$.k') AS DOUBLE) >= 50", json=("props",))
_filter("filter_has_missing_column", "events", "event_id", "has value and not has nothing and not nothing == 1", "value IS NOT NULL")
_filter("filter_type_mismatch", "events", "event_id", 'value == "5" or event_type > 3 or user_id != "x" or not event_id ~ "1"', "true")
_filter("filter_supplier_region", "supplier", "s_suppkey, s_name", 's_name contains "1" and s_acctbal > 0', "contains(s_name, '1') AND s_acctbal > 0")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose ``x`` is missing, null, a number, text or a truth value in turn."""
    e = _table(spark, sf_dir, "events")
    x = F.expr("CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ',\"x\":null' WHEN 2 THEN ',\"x\":5' WHEN 3 THEN ',\"x\":\"5\"' ELSE ',\"x\":true' END")
    return e.select(F.concat(F.lit('{"id":'), F.col("event_id"), x, F.lit(',"deep":{"y":'), F.col("event_id") % 3, F.lit("}}")).alias("value"))


def _mixed_filter(name: str, query: str, where: str) -> None:
    @_register(name, f"SELECT event_id AS id FROM events WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = over_records(ndjson.records(ndjson.classify(_mixed(spark, sf_dir), keep=())), Query.of(query)).records
        return found.select(F.variant_get("v", "$.id", "bigint").alias("id"))


_mixed_filter("json_has", "has x", "event_id % 5 IN (2, 3, 4)")
_mixed_filter("json_not_has", "not has x", "event_id % 5 IN (0, 1)")
_mixed_filter("json_eq_null", "x == null", "event_id % 5 = 1")
_mixed_filter("json_ne_null", "x != null", "event_id % 5 IN (2, 3, 4)")
_mixed_filter("json_num_mismatch", "x == 5", "event_id % 5 = 2")
_mixed_filter("json_str_mismatch", 'x == "5"', "event_id % 5 = 3")
_mixed_filter("json_ne_mismatch", "x != 6", "event_id % 5 = 2")
_mixed_filter("json_bool", "x == true or x != false", "event_id % 5 = 4")
_mixed_filter("json_bool_order", "x > false", "false")
_mixed_filter("json_not_flips", "not x == 5", "event_id % 5 <> 2")
_mixed_filter("json_nested_path", "deep.y == 1 and not has deep.z.w", "event_id % 3 = 1")


@_register("time_since_until", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 06:30:00'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Query.of(since="2024-01-01T01:00:00Z", until="5h 30m", now=NOW, time_field="ts")
    return over_columns(_table(spark, sf_dir, "events"), query).records.select("event_id", "ts")


@_register("time_formats", "SELECT event_id, event_id % 4 AS kind, (event_id * 7) - 300 < 0 AND event_id % 4 IN (1, 2) AS clamped FROM events WHERE event_id % 4 <> 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    seconds = F.col("event_id") * 7 - 300
    iso = F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"'), iso, F.lit('"')))
    stamp = stamp.when(F.col("event_id") % 4 == 1, seconds.cast("string")).when(F.col("event_id") % 4 == 2, F.concat(seconds.cast("string"), F.lit(".5"))).otherwise("[1]")
    lines = e.select(F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"timestamp":'), stamp, F.lit("}")).alias("value"))
    found = over_records(ndjson.records(ndjson.classify(lines, keep=())), Query.of(since="1970-01-01T00:00:00Z")).records
    identity = F.variant_get("v", "$.id", "bigint")
    return found.select(identity.alias("event_id"), (identity % 4).alias("kind"), ((identity * 7 - 300 < 0) & (identity % 4).isin(1, 2)).alias("clamped"))


def _aggregate(name: str, table: str, query: Query, sql: str, order_by: str | None = None, json: tuple[str, ...] = (), digits: int = 4) -> None:
    @_register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = over_columns(_table(spark, sf_dir, table), query, order_by, json).result
        return rows.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in rows.dtypes])


def _rank(x: str, p: float) -> str:
    return f"list_sort(list({x}))[CAST(floor({p} / 100.0 * (count({x}) - 1) + 0.5) AS INT) + 1]"


_ALL = 'count(*) AS "count", round(sum(value), 4) AS "sum(value)", round(avg(value), 4) AS "avg(value)", round(min(value), 4) AS "min(value)", round(max(value), 4) AS "max(value)"'
_aggregate("agg_global", "events", Query.of("value >= 50", "count,sum(value),mean(value),min(value),max(value)"), f"SELECT {_ALL} FROM events WHERE value >= 50")
_aggregate("agg_global_empty", "events", Query.of("value < -1", "count,sum(value)"),
           'SELECT count(*) AS "count", sum(value) AS "sum(value)" FROM events WHERE value < -1 HAVING count(*) > 0')
_aggregate("agg_group_one", "events", Query.of(None, "count,sum(value),avg(value),min(value),max(value)", "event_type"),
           f"SELECT event_type, {_ALL} FROM events GROUP BY event_type")
_aggregate("agg_group_multi", "lineitem", Query.of("l_quantity > 5", "count,sum(l_quantity),avg(l_extendedprice),max(l_discount)", "l_returnflag,l_linestatus"),
           'SELECT l_returnflag, l_linestatus, count(*) AS "count", round(sum(l_quantity), 4) AS "sum(l_quantity)", round(avg(l_extendedprice), 4) AS "avg(l_extendedprice)", round(max(l_discount), 4) AS "max(l_discount)" FROM lineitem WHERE l_quantity > 5 GROUP BY ALL')
_aggregate("agg_percentiles", "events", Query.of(None, "median(value),p90(value),p95(value),p99(value),p99.9(value),p0(value),p999(value),count", "event_type"),
           "SELECT event_type, " + ", ".join(f'{_rank("value", min(p, 100))} AS "p{p}(value)"' for p in (50, 90, 95, 99, 99.9, 0, 999)) + ', count(*) AS "count" FROM events GROUP BY event_type')
_aggregate("agg_percentiles_two_fields", "lineitem", Query.of(None, "p50(l_quantity),p99(l_extendedprice),sum(l_quantity),avg(l_tax)", "l_returnflag"),
           f'SELECT l_returnflag, {_rank("l_quantity", 50)} AS "p50(l_quantity)", round({_rank("l_extendedprice", 99)}, 4) AS "p99(l_extendedprice)", round(sum(l_quantity), 4) AS "sum(l_quantity)", round(avg(l_tax), 4) AS "avg(l_tax)" FROM lineitem GROUP BY l_returnflag')
_aggregate("agg_sum_once", "orders", Query.of(None, "sum(o_totalprice),avg(o_totalprice),max(o_totalprice)", "o_orderstatus"),
           'SELECT o_orderstatus, round(sum(o_totalprice), 4) AS "sum(o_totalprice)", round(avg(o_totalprice), 4) AS "avg(o_totalprice)", round(max(o_totalprice), 4) AS "max(o_totalprice)" FROM orders GROUP BY o_orderstatus')
_aggregate("agg_non_numeric", "part", Query.of(None, "count,avg(p_name),p50(p_name),max(p_size)", "p_brand"),
           'SELECT p_brand, count(*) AS "count", NULL::DOUBLE AS "avg(p_name)", NULL::DOUBLE AS "p50(p_name)", CAST(max(p_size) AS DOUBLE) AS "max(p_size)" FROM part GROUP BY p_brand')
_aggregate("agg_missing_key", "region", Query.of(None, "count", "r_name,nothing"), 'SELECT r_name, NULL::VARCHAR AS nothing, count(*) AS "count" FROM region GROUP BY r_name')
_aggregate("agg_group_json_key", "events", Query.of(None, "count,max(props.k)", "props.k"),
           'SELECT props::JSON->>\'$.k\' AS "props.k", count(*) AS "count", max(CAST(props::JSON->>\'$.k\' AS DOUBLE)) AS "max(props.k)" FROM events GROUP BY 1', json=("props",))
_aggregate("conversation_roles", "conversations", Query.of('text contains "e"', "count,max(turn)", "role"),
           'SELECT role, count(*) AS "count", CAST(max(turn) AS DOUBLE) AS "max(turn)" FROM conversations WHERE contains(text, \'e\') GROUP BY role')
_aggregate("window_tumbling", "events", Query.of(None, "count,avg(value)", window="1h", time_field="ts"),
           f'SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS {WINDOW}, count(*) AS "count", round(avg(value), 4) AS "avg(value)" FROM events GROUP BY 1')
_aggregate("window_tumbling_grouped", "events", Query.of('event_type != "view"', "count,p90(value)", "event_type", window="1m", time_field="ts"),
           f'SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS {WINDOW}, event_type, count(*) AS "count", {_rank("value", 90)} AS "p90(value)" FROM events WHERE event_type <> \'view\' GROUP BY ALL')
_aggregate("flagship", "events", Query.of('value >= 20 and not event_type == "view"', "count,avg(value),p99(value)", "event_type", window="1d", time_field="ts"),
           f'SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS {WINDOW}, event_type, count(*) AS "count", round(avg(value), 9) AS "avg(value)", {_rank("value", 99)} AS "p99(value)" FROM events WHERE value >= 20 AND event_type <> \'view\' GROUP BY ALL', digits=9)

_GUARD = Query.of(None, "count,sum(value),p50(value)", "user_id", limit=20)
_FIRST = "WITH k AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) AS r FROM events GROUP BY user_id), g AS (SELECT e.*, r FROM events e JOIN k USING (user_id)) "
_aggregate("guard_kept", "events", _GUARD,
           _FIRST + f'SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS "count", round(sum(value), 4) AS "sum(value)", {_rank("value", 50)} AS "p50(value)" FROM g WHERE r <= 20 GROUP BY user_id', "event_id")


@_register("guard_overflow", _FIRST + f'SELECT count(*) AS "count", round(sum(value), 4) AS "sum(value)", {_rank("value", 50)} AS "p50(value)" FROM g WHERE r > 20 HAVING count(*) > 0')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = over_columns(_table(spark, sf_dir, "events"), _GUARD, "event_id").aggregation.overflow
    return found.select("count", F.round("`sum(value)`", 4).alias("sum(value)"), "`p50(value)`")


@_register("guard_report", _FIRST + """SELECT least(20, count(DISTINCT user_id)) AS "groups", count(*) FILTER (r > 20) AS truncated_records,
    count(DISTINCT user_id) FILTER (r > 20) AS truncated_keys, max(r) > 20 AS truncated FROM g""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_columns(_table(spark, sf_dir, "events"), _GUARD, "event_id").aggregation.report


@_register("window_no_agg", f"SELECT event_id, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS {WINDOW} FROM events WHERE event_type = 'error'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = Query.of('event_type == "error"', window="5m", time_field="ts")
    return over_columns(_table(spark, sf_dir, "events"), query).records.select("event_id", WINDOW)


def _as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as NDJSON; every seventh line is followed by a bad one, every eleventh by a blank one."""
    e = _table(spark, sf_dir, "events")
    bad = F.element_at(F.array(*map(F.lit, ("[1,2]", '{"a":1} x', "not json", '{"a":1},{"b":2}', "42"))), (F.col("event_id") % 5 + 1).cast("int"))
    more = F.concat(F.array(F.to_json(F.struct(*e.columns))), F.when(F.col("event_id") % 7 == 0, F.array(bad)).otherwise(F.array().cast("array<string>")),
                    F.when(F.col("event_id") % 11 == 0, F.array(F.lit(" \t\r"))).otherwise(F.array().cast("array<string>")))
    return e.select(F.explode(more).alias("value"))


@_register("ndjson_roundtrip_filter", "SELECT event_id, event_type, value FROM events WHERE value >= 50 AND NOT contains(event_type, 'i')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ndjson.records(ndjson.classify(_as_lines(spark, sf_dir), keep=()))
    found = over_records(lines, Query.of('value >= 50 and not event_type contains "i"')).records
    get = lambda name, kind: F.variant_get("v", f"$.{name}", kind).alias(name)
    return found.select(get("event_id", "bigint"), get("event_type", "string"), get("value", "double"))


@_register("ndjson_aggregate", f'SELECT event_type, count(*) AS "count", round(avg(value), 4) AS "avg(value)", {_rank("value", 99)} AS "p99(value)" FROM events WHERE user_id < 500 GROUP BY event_type')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ndjson.records(ndjson.classify(_as_lines(spark, sf_dir), keep=()))
    rows = over_records(lines, Query.of("user_id < 500", "count,avg(value),p99(value)", "event_type")).result
    return rows.select("event_type", "count", F.round("`avg(value)`", 4).alias("avg(value)"), "`p99(value)`")


@_register("ndjson_line_counts", "SELECT count(*) AS record, count(*) FILTER (event_id % 11 = 0) AS blank, count(*) FILTER (event_id % 7 = 0) AS malformed, 0::BIGINT AS too_long FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ndjson.line_counts(ndjson.classify(_as_lines(spark, sf_dir), keep=()))


@_register("ndjson_line_cap", "SELECT count(*) FILTER (strlen(text) + 11 <= 2000) AS record, count(*) FILTER (strlen(text) + 11 > 2000) AS too_long FROM (SELECT replace(replace(replace(text, '\\', '/'), '\"', ''''), chr(10), ' ') AS text FROM documents)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("/")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    lines = _table(spark, sf_dir, "documents").select(F.concat(F.lit('{"text":"'), clean, F.lit('"}')).alias("value"))
    return ndjson.line_counts(ndjson.classify(lines, 2000, keep=())).select("record", "too_long")


@_register("record_rendering", "SELECT '{\"a\":' || (event_id % 10) || ',\"z\":\"' || event_type || '\"}' AS line FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    lines = e.select(F.concat(F.lit('{ "z": "'), F.col("event_type"), F.lit('", "a": '), F.col("event_id") % 10, F.lit("}")).alias("value"))
    return render.record_lines(over_records(ndjson.records(ndjson.classify(lines, keep=())), Query.of())).select("line")


_aggregate("agg_percentiles_global", "lineitem", Query.of("l_quantity > 1", "p50(l_extendedprice),p99(l_extendedprice),p25(l_discount),count"),
           f'SELECT {_rank("l_extendedprice", 50)} AS "p50(l_extendedprice)", {_rank("l_extendedprice", 99)} AS "p99(l_extendedprice)", {_rank("l_discount", 25)} AS "p25(l_discount)", count(*) AS "count" FROM lineitem WHERE l_quantity > 1', digits=9)


@_register("agg_percentiles_epoch", "SELECT event_type, " + ", ".join(f"{_rank('ms', p)} AS p{p}" for p in (1, 50, 99)) + " FROM (SELECT event_type, (epoch_us(ts) // 1000)::DOUBLE AS ms FROM events) GROUP BY event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants as milliseconds: many values, all within a few thousandths of each other."""
    e = _table(spark, sf_dir, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    found = over_columns(e, Query.of(None, "p1(ms),p50(ms),p99(ms)", "event_type")).result
    return found.toDF("event_type", "p1", "p50", "p99")


_aggregate("agg_percentiles_sample", "events", Query.of(None, "count,sum(value),p50(value),p90(value)", "user_id", percentiles="sample"),
           f'SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS "count", round(sum(value), 4) AS "sum(value)", {_rank("value", 50)} AS "p50(value)", {_rank("value", 90)} AS "p90(value)" FROM events GROUP BY user_id')


@_register("time_millis", "SELECT event_id, event_id % 2 = 0 AS in_millis FROM events WHERE epoch_ms(ts) // 1000 BETWEEN epoch(TIMESTAMP '2024-01-01 02:00:00') AND epoch(TIMESTAMP '2024-01-01 09:00:00')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds of the same instants, as numbers of milliseconds and of seconds in turn."""
    e = _table(spark, sf_dir, "events")
    seconds = F.unix_timestamp("ts")
    stamp = F.when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds)
    lines = e.select(F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"timestamp":'), stamp, F.lit("}")).alias("value"))
    query = Query.of(since="2024-01-01T02:00:00Z", until="2024-01-01T09:00:00Z")
    identity = F.variant_get("v", "$.id", "bigint")
    found = over_records(ndjson.records(ndjson.classify(lines, keep=())), query).records
    return found.select(identity.alias("event_id"), (identity % 2 == 0).alias("in_millis"))


def _written(lines: DataFrame) -> str:
    """``lines`` as text files, in the folder that the cluster shares (one of this machine's in tests)."""
    spark = lines.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = f"{(shared or 'file://' + tempfile.gettempdir()).rstrip('/')}/emberlens-{spark.sparkContext.applicationId}/lines-{uuid.uuid4().hex}"
    lines.write.text(at)
    return at


_FILE_LINES = """CASE event_id % 6 WHEN 0 THEN '{"id":' || event_id || ',"kind":"' || event_type || '"}' || chr(13)
    WHEN 1 THEN '{"id":' || event_id || ',"pad":"' || repeat('x', CAST(event_id % 400 AS INT)) || '"}'
    WHEN 2 THEN '  ' WHEN 3 THEN '["' || event_type || '"]' ELSE '{"id":' || event_id || '}' END"""


@_register("ndjson_file_scan", f"""WITH l AS (SELECT event_id, {_FILE_LINES} AS value FROM events)
    SELECT event_id AS id, event_id % 6 = 0 AS has_kind FROM l
    WHERE (event_id % 6 IN (0, 1) OR event_id % 6 = 4) AND strlen(rtrim(value, chr(13))) <= 200""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files with carriage returns, blank and long lines, and bytes that are no UTF-8 (every sixth line)."""
    e = _table(spark, sf_dir, "events")
    spoilt = F.concat(F.lit('{"id":"'), F.unhex(F.lit("FFFE")).cast("string"), F.lit('"}'))
    at = _written(e.select(F.when(F.col("event_id") % 6 == 5, spoilt).otherwise(F.expr(_FILE_LINES)).alias("value")))
    found = over_records(ndjson.read_ndjson(spark, at, 200), Query.of("has id")).records
    return found.select(F.variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.kind", "string").isNotNull().alias("has_kind"))


_LONG = "event_id % 6 IN (0, 1, 4) AND (strlen(value) > 200 OR event_id = 7)"


@_register("ndjson_split_counts", f"""WITH l AS (SELECT event_id, {_FILE_LINES} AS value FROM events)
    SELECT count(*) FILTER (event_id % 6 IN (0, 1, 4) AND NOT ({_LONG})) AS record, count(*) FILTER (event_id % 6 = 2) AS blank,
           count(*) FILTER (event_id % 6 IN (3, 5)) AS malformed, count(*) FILTER ({_LONG}) AS too_long FROM l""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines by byte ranges of 1 MiB; one of them, of 64 MiB, takes no more memory than the others."""
    e = _table(spark, sf_dir, "events")
    spoilt = F.concat(F.lit('{"id":"'), F.unhex(F.lit("FFFE")).cast("string"), F.lit('"}'))
    value = F.when(F.col("event_id") == 7, F.repeat(F.lit("x"), 64 << 20)).when(F.col("event_id") % 6 == 5, spoilt).otherwise(F.expr(_FILE_LINES))
    at = _written(e.select(value.alias("value")))
    lines = splits.read_splits(spark, splits.splits(at, 1 << 20), 200)
    return ndjson.line_counts(ndjson.classify(lines, 200))


_BY_TYPE = Query.of(None, "count,max(user_id)", "event_type")


def _rendered(name: str, kind: str, sql: str) -> None:
    """The lines that a grouped aggregate is printed as. The guard bounds them."""

    @_register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = render.aggregation(over_columns(_table(spark, sf_dir, "events"), _BY_TYPE, "event_id"), kind)
        return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines())], "nr long, line string")


_GROUPED = "WITH g AS (SELECT event_type AS k, count(*) AS n, max(user_id) AS m, row_number() OVER (ORDER BY event_type) AS r FROM events GROUP BY event_type)"
_rendered("render_ndjson", "ndjson", _GROUPED + """ SELECT r - 1 AS nr, '{"count":' || n || '.0,"event_type":"' || k || '","max(user_id)":' || m || '.0}' AS line FROM g""")
_rendered("render_table", "table", _GROUPED + """, w AS (SELECT greatest(10, max(strlen(k))) AS a, greatest(5, max(strlen(n::VARCHAR))) AS b, greatest(12, max(strlen(m::VARCHAR))) AS c FROM g),
    l AS (SELECT 0 AS nr, 'event_type' AS x, 'count' AS y, 'max(user_id)' AS z UNION ALL SELECT 1, repeat('-', a), repeat('-', b), repeat('-', c) FROM w UNION ALL SELECT r + 1, k, n::VARCHAR, m::VARCHAR FROM g)
    SELECT CAST(nr AS BIGINT) AS nr, rpad(x, CAST(a AS INT), ' ') || '  ' || rpad(y, CAST(b AS INT), ' ') || '  ' || rpad(z, CAST(c AS INT), ' ') || '  ' AS line FROM l, w""")  # fmt: skip
_rendered("render_json", "json", _GROUPED + """, l AS (SELECT 10 * r AS nr, '    {' AS line FROM g UNION ALL SELECT 10 * r + 1, '      "count": ' || n || '.0,' FROM g
    UNION ALL SELECT 10 * r + 2, '      "event_type": "' || k || '",' FROM g UNION ALL SELECT 10 * r + 3, '      "max(user_id)": ' || m || '.0' FROM g
    UNION ALL SELECT 10 * r + 4, CASE WHEN r = max(r) OVER () THEN '    }' ELSE '    },' END FROM g
    UNION ALL SELECT 0, '{' UNION ALL SELECT 1, '  "rows": [' UNION ALL SELECT 1000000, '  ],'
    UNION ALL SELECT 1000001, '  "truncated": false,' UNION ALL SELECT 1000002, '  "truncated_count": 0' UNION ALL SELECT 1000003, '}')
    SELECT row_number() OVER (ORDER BY nr) - 1 AS nr, line FROM l""")  # fmt: skip

QUERIES, ORACLE = _FOUND, _SQL
