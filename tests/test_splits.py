import io
import json
import os
import random
import tracemalloc

import pytest

from emberlens import cli
from emberlens.plans.engine import Query, over_records
from emberlens.sources import ndjson, splits


def read(data, size, cap):
    out = []
    for at in range(0, len(data), size):
        for values, lengths, begins in splits.lines_of(io.BytesIO(data), at, min(len(data), at + size), cap):
            out += zip(values, lengths, begins)
    return out


@pytest.mark.parametrize("chunk", [3, 17, 1 << 20])
def test_every_line_once_whatever_the_ranges(monkeypatch, chunk):
    monkeypatch.setattr(splits, "CHUNK", chunk)
    rnd = random.Random(chunk)
    for _ in range(60):
        lines = [b"x" * rnd.choice([0, 0, 1, 2, 5, 11, 40]) for _ in range(rnd.randrange(0, 12))]
        data = b"\n".join(lines) + rnd.choice([b"", b"\n", b"\n\n"])
        want, at = [], 0
        for line in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
            want.append((line if len(line) <= 9 else None, len(line), at))
            at += len(line) + 1
        for size in (1, 2, 7, 23, 1000):
            assert read(data, size, 9) == want


def test_a_long_line_takes_constant_memory(tmp_path):
    """A line of 64 MiB between two others, with a cap of 1 MiB."""
    p = tmp_path / "long.log"
    with p.open("wb") as f:
        f.write(b'{"a":1}\n')
        for _ in range(64):
            f.write(b"x" * (1 << 20))
        f.write(b'\n{"b":2}\n')
    tracemalloc.start()
    found = []
    for name, _, start, stop in splits.splits(str(p), 16 << 20):
        with open(name, "rb", buffering=0) as handle:
            for values, lengths, _ in splits.lines_of(handle, start, stop, 1 << 20):
                found += zip(values, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(b'{"a":1}', 7), (None, 64 << 20), (b'{"b":2}', 7)] and peak < 8 << 20


def test_same_records_as_the_text_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.log").write_bytes(b"".join(json.dumps({"n": i * 100 + k, "pad": "y" * (k % 50)}).encode() + b"\r\n" for k in range(100)) + b"bad\n\n\xff\n" + b"z" * 300)
    lines = splits.read_splits(spark, splits.splits(str(tmp_path), 700), 200)
    mine, other = ndjson.classify(lines, 200), ndjson.classify(ndjson.read_lines(spark, str(tmp_path)), 200)
    assert ndjson.line_counts(mine).first() == ndjson.line_counts(other).first()
    assert [json.loads(r[0])["n"] for r in ndjson.records(mine).selectExpr("to_json(v)").collect()] == list(range(300))
    query = Query.of("n >= 20", "count,p50(n)", "pad")
    rows = [sorted(map(str, over_records(ndjson.records(x), query).result.collect())) for x in (mine, other)]
    assert rows[0] == rows[1]


def test_command_line_reads_once_and_in_order(spark, tmp_path, capsys, monkeypatch):
    p = tmp_path / "x.log"
    p.write_text("".join(json.dumps({"n": i}) + "\n" for i in range(3000)) + "bad\n")
    monkeypatch.setattr(splits, "splits", lambda path, f=splits.splits: f(path, 1000))
    read, real = [], splits.read_splits
    monkeypatch.setattr(splits, "read_splits", lambda spark, found, cap: read.extend(found) or real(spark, found, cap))
    assert cli.main([str(p), "-q", "n >= 10"], spark) == 0
    out = capsys.readouterr()
    assert [json.loads(x)["n"] for x in out.out.splitlines()] == list(range(10, 3000)) and "skipped 1 malformed" in out.err
    assert read == splits.splits(str(p)) and len(read) > 2 * spark.sparkContext.defaultParallelism
    read.clear()
    assert cli.main([str(p), "-a", "count,p50(n)", "-g", "n", "--cardinality-limit", "2", "--reservoir-capacity", "5"], spark) == 0
    assert "2998 additional value(s)" in capsys.readouterr().out and read == splits.splits(str(p))


def test_nothing_to_read(spark, tmp_path, capsys):
    p = tmp_path / "empty.log"
    p.write_text("")
    assert cli.main([str(p)], spark) == 0 and cli.main([str(p), "-a", "count", "-f", "ndjson"], spark) == 0
    assert capsys.readouterr().out.strip() == "" and os.path.exists(p)
