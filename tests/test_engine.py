import contextlib
import json
import math
import random
import re
from datetime import UTC, datetime

import pytest

from emberlens import cli
from emberlens.functions import times
from emberlens.operators import aggregate
from emberlens.operators.aggregate import AggSpec, specs
from emberlens.plans.engine import Query, over_columns, over_records
from emberlens.sources import ndjson

#: Two services of a ferry office over two minutes; the fourth line is no record.
DEMO = """{"at":"2031-03-04T08:15:02Z","desk":"tickets","code":3,"lane":"/pier/2","ms":61}
{"at":"2031-03-04T08:15:31Z","desk":"cargo","code":9,"lane":"/pier/7","ms":250,"note":"crane stuck"}
{"at":"2031-03-04T08:15:58Z","desk":"tickets","code":8,"lane":"/ping","ms":5}
-- shift change --
{"at":"2031-03-04T08:16:10Z","desk":"cargo","code":4,"lane":"/pier/7","ms":180}
{"at":"2031-03-04T08:16:44Z","desk":"tickets","code":7,"lane":"/pier/1","ms":77}
"""


@pytest.fixture
def demo(tmp_path):
    p = tmp_path / "app.log"
    p.write_text(DEMO)
    return str(p)


def run(spark, capsys, *args):
    code = cli.main(list(args), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_demo_aggregate(spark, demo, capsys):
    code, out, err = run(spark, capsys, demo, "--agg", "count,p50(ms),max(ms)", "--group-by", "desk")
    assert code == 0 and err == "emberlens: skipped 1 malformed line(s)\n"
    assert [x.split() for x in out.splitlines()] == [
        ["desk", "count", "p50(ms)", "max(ms)"], ["-" * 7, "-" * 5, "-" * 7, "-" * 7],
        ["cargo", "2", "250", "250"], ["tickets", "3", "61", "77"], [],
    ]


def test_demo_filter(spark, demo, capsys):
    _, out, _ = run(spark, capsys, demo, "--query", 'code >= 8 and not lane contains "/ping"')
    assert out == '{"at":"2031-03-04T08:15:31Z","code":9,"desk":"cargo","lane":"/pier/7","ms":250,"note":"crane stuck"}\n'
    _, out, _ = run(spark, capsys, demo, "-q", "code == 9", "-f", "JSON")
    assert json.loads(out)["code"] == 9 and out.startswith('{\n  "at"')


def test_demo_window(spark, demo, capsys):
    first = int(datetime(2031, 3, 4, 8, 15, tzinfo=UTC).timestamp())
    _, out, _ = run(spark, capsys, demo, "--time-field", "at", "--window", "1m", "--agg", "count", "-f", "ndjson")
    assert [json.loads(x) for x in out.split()] == [{"_window_start": str(first), "count": 3.0}, {"_window_start": str(first + 60), "count": 2.0}]
    _, out, _ = run(spark, capsys, demo, "--time-field", "at", "--window", "1m", "-q", "code == 7")
    assert json.loads(out)["_window_start"] == first + 60


def test_guard_output(spark, demo, capsys):
    _, out, _ = run(spark, capsys, demo, "--agg", "count", "-g", "lane", "--cardinality-limit", "2")
    assert "/pier/2" in out and "/ping" not in out and "2 additional value(s)" in out
    _, out, _ = run(spark, capsys, demo, "--agg", "count", "-g", "lane", "--cardinality-limit", "2", "-f", "json")
    assert json.loads(out)["truncated_count"] == 2 and json.loads(out)["truncated"] is True


@pytest.mark.parametrize(
    "args, message",
    [
        (["-q", "status = 5"], "emberlens: query error at column 8: expected `==`, found a single `=`"),
        (["-q", 'a == 1 or msg ~ "("'], "emberlens: query error: invalid regex `(`"),
        (["-a", "median"], "emberlens: invalid aggregation spec `median`"),
        (["-f", "xml"], "emberlens: unknown --format `xml` (expected table, json, or ndjson)"),
        (["--since", "soon"], "emberlens: invalid --since: `soon` is not a valid RFC3339 timestamp"),
        (["-w", "5"], "emberlens: invalid --window:"),
    ],
)
def test_option_errors(spark, demo, capsys, args, message):
    code, _, err = run(spark, capsys, demo, *args)
    assert code == 1 and err.startswith(message)


def test_missing_file_and_unknown_flag(spark, capsys):
    assert run(spark, capsys, "/no/such")[0] == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["--nope"], spark)
    assert e.value.code == 2


def test_lines(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b'{"a":1}\r\nnot json\n\n{"b":2}\n\xff\xfe\n[1,2]\n42\n{"a":1} {"a":2}\n{"a":1},"z":{"b":2\n{"a":1,"a":3}\n' + b'{"pad":"' + b"x" * 100 + b'"}\n \xc2\xa0\r\n{"last":1}')
    lines = ndjson.classify(ndjson.read_lines(spark, str(p)), 60)
    assert ndjson.line_counts(lines).first().asDict() == {"record": 4, "blank": 2, "malformed": 6, "too_long": 1}
    rows = ndjson.records(lines).orderBy("pos").selectExpr("to_json(v)").collect()
    assert [r[0] for r in rows] == ['{"a":1}', '{"b":2}', '{"a":3}', '{"last":1}']


def test_cap_is_inclusive(spark):
    lines = spark.createDataFrame([('{"a":1}',), ('{"a":12}',)], "value string")
    assert ndjson.line_counts(ndjson.classify(lines, 7, keep=())).first()["too_long"] == 1


def test_group_keys(spark):
    lines = spark.createDataFrame([(i, json.dumps({"k": k})) for i, k in enumerate([5, "5", 5.0, None, True, [1, 2]])] + [(9, "{}")], "pos long, value string")
    rows = over_records(ndjson.records(ndjson.classify(lines)), Query.of(agg="count", group_by="k")).result.collect()
    assert {r["k"]: r["count"] for r in rows} == {"5": 2, "5.0": 1, None: 2, "true": 1, "[1,2]": 1}


def test_number_keys(spark):
    """Whole numbers of 64 bits keep their spelling; others are doubles in their shortest form."""
    spelled = {
        "1e3": "1000.0", "1.50": "1.5", "-0": "-0.0", "0": "0", "-0.0": "-0.0", "0.0": "0.0", "1E7": "10000000.0", "12345678.25": "12345678.25", "1e15": "1000000000000000.0",
        "1.5e15": "1500000000000000.0", "1e16": "1e16", "1.25e16": "1.25e16", "1e-3": "0.001", "1e-4": "0.0001", "1.5e-5": "0.000015", "1e-6": "1e-6", "-2.5E-7": "-2.5e-7",
        "18446744073709551615": "18446744073709551615", "18446744073709551616": "1.8446744073709552e19", "-9223372036854775809": "-9.223372036854776e18", "-12": "-12",
    }
    lines = spark.createDataFrame([(i, f'{{"k": {n}}}') for i, n in enumerate(spelled)], "pos long, value string")
    rows = over_records(ndjson.records(ndjson.classify(lines)), Query.of(agg="count", group_by="k")).result.collect()
    assert {r["k"] for r in rows} == set(spelled.values()) and sum(r["count"] for r in rows) == len(spelled)


def test_strict_records(spark):
    """Halves of surrogate pairs make no record; escaped backslashes before a u do no harm."""
    good = [
        '{"a":1e308}', r'{"a":"\ud83d\ude00"}', r'{"a":"\\ud800"}', r'{"a":"\u0041\\\ud83d\ude00"}',
        '{"a":"' + r"\"\u0041" * 30000 + '","b":[[' + "[]," * 200 + "1]]}",
    ]
    bad = [
        r'{"a":"\ud800"}', r'{"a":"\uDC00\uD800"}', r'{"a":"\\\ud800"}', r'{"\ud83d\u0041":1}', r'{"a":"\ud83d\\\ude00"}',
    ]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "pos long, value string")
    found = {r["pos"]: r["status"] for r in ndjson.classify(lines).select("pos", "status").collect()}
    assert [i for i in found if (found[i] == "record") != (i < len(good))] == []


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3)], "v double")
    one = lambda agg, d=df: over_columns(d, Query.of(agg=agg)).result.collect()
    assert one("p25(v),max(v)")[0].asDict() == {"p25(v)": 2.0, "max(v)": 3.0}
    assert one("sum(v),avg(v)")[0].asDict() == {"sum(v)": 6.0, "avg(v)": 2.0}
    pair = spark.createDataFrame([(95.0,), (120.0,)], "v double")
    assert one("p50(v)", pair)[0][0] == 120.0
    hundred = spark.range(1, 101).selectExpr("double(id) v")
    assert [float(x) for x in one("p50(v),p99(v),p0(v),p100(v)", hundred)[0]] == [51.0, 99.0, 1.0, 100.0]
    for mode in ("approx", "kll"):
        got = over_columns(hundred, Query.of(agg="p50(v)", percentiles=mode)).result.first()[0]
        assert abs(got - 50) <= 2
    assert one("count,p50(v)", df.where("v > 5")) == []


def test_specs():
    assert [str(x) for x in specs("COUNT, Mean( a.b ),MEDIAN(x),p99.9(y)")] == ["count", "avg(a.b)", "p50(x)", "p99.9(y)"]
    assert AggSpec.parse("count(x)") is None and AggSpec.parse("sum()") is None and AggSpec.parse("avg (x)") is None and AggSpec.parse("px(y)") is None


def test_times():
    now = datetime(2024, 1, 1, tzinfo=UTC)
    assert times.instant("2024-01-01 00:00:00.25", now).microsecond == 250000
    assert times.instant("1h 30m", now) == datetime(2023, 12, 31, 22, 30, tzinfo=UTC)
    assert [times.bucket_seconds(x) for x in ("500ms", "1500ms", "0s", "1h1m", "1M", "1m")] == [1, 1, 1, 3660, 2630016, 60]
    for bad in ("100years", "2024-01-01", "5x", ""):
        with pytest.raises(times.TimeError):
            times.instant(bad, now)


def test_time_values(spark):
    stamps = ["1970-01-01T00:01:40Z", "1970-01-01 00:01:40", 100, 100.0, 1e12, 1700000000000, -5, True, None, "1970-01-01", "1970-01-01T00:01:40+02:00"]
    lines = spark.createDataFrame([(i, json.dumps({"ts": s})) for i, s in enumerate(stamps)], "pos long, value string")
    found = over_records(ndjson.records(ndjson.classify(lines)), Query.of(window="1m", time_field="ts")).records.collect()
    assert {r["pos"]: r["_window_start"] for r in found} == {0: 60, 1: 60, 2: 60, 3: 60, 4: 999999999960, 5: 1699999980, 6: 0}
    both = Query.of(since="1970-01-01T00:01:40Z", until="1970-01-01T00:01:40Z", time_field="ts")
    assert {r["pos"] for r in over_records(ndjson.records(ndjson.classify(lines)), both).records.collect()} == {0, 1, 2, 3}


def test_overflow_mode_and_null_keys(spark):
    df = spark.createDataFrame([(i, k, float(i)) for i, k in enumerate(["a", None, "b", "c", "a", "c"])], "i long, k string, v double")
    a = over_columns(df, Query.of(agg="count,sum(v),p50(v)", group_by="k", limit=2), "i").aggregation
    assert [tuple(r) for r in a.rows.collect()] == [(None, 1, 1.0, 1.0), ("a", 2, 4.0, 4.0)]
    assert [tuple(r) for r in a.overflow.collect()] == [(3, 10.0, 3.0)]
    assert a.report.first().asDict() == {"groups": 2, "truncated_records": 3, "truncated_keys": 2, "truncated": True}


def test_scale(spark, tmp_path):
    def line(i):
        if i % 1000 == 999:
            return "broken"
        return json.dumps({"status": 500 if i % 50 == 0 else 200, "path": f"/api/item/{i}", "latency_ms": i % 300 + 1, "service": f"svc-{i % 7}"})

    p = tmp_path / "big.log"
    p.write_text("\n".join(map(line, range(30_000))) + "\n")
    lines = ndjson.classify(ndjson.read_lines(spark, str(p)))
    assert ndjson.line_counts(lines).first()["malformed"] == 30
    rows = over_records(ndjson.records(lines), Query.of("status >= 500", "count,p99(latency_ms)", "service")).result.collect()
    assert sum(r["count"] for r in rows) == 600 and len(rows) == 7


def nearest(values, p):
    ordered = sorted(values)
    return ordered[int(min(max(p, 0), 100) / 100 * (len(ordered) - 1) + 0.5)]


def test_percentiles_split_any_bucket(spark):
    """Milliseconds of a day, numbers beside one outlier, equal numbers, infinities: no bucket stays large."""
    rnd = random.Random(3)
    day = [1.7e12 + 37 * i for i in range(6000)]
    groups = {
        "day": day, "near": [1 + i * 2.0**-52 for i in range(3000)] + [1e300], "same": [5.0] * 500, "few": [2.0, -1.0],
        "mixed": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(900)] + [0.0] * 40 + [math.inf, -math.inf], "tiny": [i * 5e-324 for i in range(400)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    ps = (0, 1, 25, 50, 90, 99.9, 100)
    plan = over_columns(df, Query.of(agg=",".join(f"p{p}(v)" for p in ps), group_by="k"))
    got = {r["k"]: list(r)[1:] for r in plan.result.collect()}
    assert got == {k: [nearest(v, p) for p in ps] for k, v in groups.items()}
    a = plan.aggregation
    held = aggregate._held(a.added()["values"], a.by, a.wanted, a.measures)
    sizes = {(r["k0"], r["b"]): r["count"] for r in held.groupBy("k0", "b").count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == "day") <= 8 and len(sizes) >= 6 * 3


@pytest.mark.parametrize("keys", ["k", ""])
def test_narrow_groups_in_order_equal_buckets(spark, monkeypatch, keys):
    """Held parts of few values are put in order whole; the result is that of the buckets."""
    odd = [("a", None, 1.0), ("a", math.nan, None), ("a", -0.0, 2.0), ("a", 0.0, 2.0), (None, 3.0, None), (None, None, None), ("c", None, 7.0), ("c", math.inf, 7.0)]
    rows = [(i, k, v, w) for i, (k, v, w) in enumerate(odd + [(f"k{i % 4}", float(i * i % 97), float(-i)) for i in range(300)])]
    df = spark.createDataFrame(rows, "i long, k string, v double, w double")
    query = Query.of(agg="count,p0(v),p50(v),p99(v),p50(w),sum(w),min(v),max(w)", group_by=keys, limit=4)
    found = []
    for bound, hold in ((1 << 20, True), (0, True), (1 << 20, False)):
        monkeypatch.setattr(aggregate, "NARROW", bound)
        a = over_columns(df, query, "i").aggregation
        with a.held() if hold else contextlib.nullcontext():
            assert a.narrow == (hold and bound > 0)
            found.append(sorted(map(str, a.groups.collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == (5 if keys else 1)
    monkeypatch.setattr(aggregate, "NARROW", 1 << 20)
    a = over_columns(df.where("i < 0"), query, "i").aggregation
    with a.held():
        assert a.groups.collect() == []


def test_sample_is_exact_up_to_its_capacity(spark):
    df = spark.range(3000).selectExpr("id i", "cast(id % 3 as string) k", "double(hash(id) % 1000) v", "if(id % 5 = 0, null, double(id)) w")
    agg = "count,p50(v),p90(v),p99(w),avg(w),min(v)"
    exact = over_columns(df, Query.of(agg=agg, group_by="k"), "i").result.collect()
    assert over_columns(df.repartition(7), Query.of(agg=agg, group_by="k", percentiles="sample", capacity=1000), "i").result.collect() == exact
    one = over_columns(df, Query.of(agg="p50(v),count", percentiles="sample", capacity=200), "i")
    again = over_columns(df.repartition(5), Query.of(agg="p50(v),count", percentiles="sample", capacity=200), "i")
    assert one.result.collect() == again.result.collect() and one.aggregation.added()["values"].count() == 200
    values, found = sorted(r["v"] for r in df.collect()), one.result.first()["p50(v)"]
    at = sum(v <= found for v in values) / len(values)
    assert abs(at - 0.5) < 4 * (0.25 / 200) ** 0.5


def test_samples_add_up(spark):
    """Of two halves' samples the sample of the whole."""
    df = spark.range(4000).selectExpr("id i", "cast(id % 5 as string) k", "double(hash(id)) v")
    query = Query.of(agg="count,p50(v)", group_by="k", percentiles="sample", capacity=50, limit=2)
    whole = over_columns(df, query, "i").aggregation
    first, rest = (over_columns(df.where(x), query, "i").aggregation for x in ("i < 1500", "i >= 1500"))
    both = rest.groups_of(rest.added(first.added()))
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.groups.collect()))


@pytest.mark.parametrize("mode", ["exact", "sample", "kll", "approx"])
def test_guard_folds_the_same_in_every_mode(spark, mode):
    df = spark.range(600).selectExpr("id i", "if(id % 4 = 1, null, concat('k', id % 50)) k", "double(id % 11) v")
    a = over_columns(df, Query.of(agg="count,sum(v),avg(v),min(v),max(v),p50(v)", group_by="k", limit=3, percentiles=mode), "i").aggregation
    rows = df.collect()
    first = list(dict.fromkeys(r["k"] for r in rows))[:3]
    over = [r["v"] for r in rows if r["k"] not in first]
    kept = {r["k"]: r["count"] for r in a.rows.collect()}
    assert kept == {k: sum(r["k"] == k for r in rows) for k in first} and None in kept
    out = a.overflow.first()
    assert list(out)[:5] == [len(over), sum(over), sum(over) / len(over), min(over), max(over)] and abs(out["p50(v)"] - nearest(over, 50)) <= 1
    assert a.report.first().asDict() == {"groups": 3, "truncated_records": len(over), "truncated_keys": len({r["k"] for r in rows}) - 3, "truncated": True}


def test_guard_reads_its_input_once(spark, sf):
    for agg in ("count,sum(value)", "count,p50(value)"):
        df = spark.read.parquet(f"{sf}/events.parquet")
        groups = over_columns(df, Query.of(agg=agg, group_by="user_id", limit=20), "event_id").aggregation.groups
        groups.collect()
        plan = groups._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        stages = re.findall(r"(?:ShuffleQueryStage|BroadcastQueryStage) (\d+)", final)
        scans = len(re.findall(r"Scan parquet", final))
        assert stages and scans - final.count("ReusedExchange") <= 1, final
