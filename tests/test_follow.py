import json
import os

import pytest

from emberlens.plans.engine import Query, over_records
from emberlens.sources.ndjson import read_ndjson
from emberlens.sources.tail import _TailReader
from emberlens.streaming.follow import follow


def line(i):
    return json.dumps({"n": i, "k": "ab"[i % 2]}) + "\n"


def reader(path, **more):
    return _TailReader({"path": str(path), **more})


def values(rows):
    return [r[0] for r in rows]


def test_reader_appends_and_partial_lines(tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b"one\ntw")
    r = reader(p)
    rows, end = r._read(r.initialOffset(), None)
    assert values(rows) == [b"one"]
    with p.open("ab") as f:
        f.write(b"o\nthree\n")
    more, after = r._read(end, None)
    assert values(more) == [b"two", b"three"] and r._read(after, None)[0] == []
    assert values(r.readBetweenOffsets(end, after)) == [b"two", b"three"]


def test_reader_rotation_truncation_and_absence(tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b"one\ntwo\n")
    r = reader(p)
    _, end = r._read(r.initialOffset(), None)
    os.rename(p, tmp_path / "x.log.1")
    assert r._read(end, None) == ([], end)
    p.write_bytes(b"new\n")
    rows, end = r._read(end, None)
    assert values(rows) == [b"new"]
    p.write_bytes(b"x\n")
    assert values(r._read(end, None)[0]) == [b"x"]


def test_reader_finishes_a_renamed_file_first(tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b"one\n")
    r = reader(p)
    rows, end = r._read(r.initialOffset(), None)
    with p.open("ab") as f:
        f.write(b"two\n")
    os.rename(p, tmp_path / "x.log.1")
    p.write_bytes(b"new\n")
    late, after = r._read(end, None)
    assert values(late) == [b"two"] and values(r.readBetweenOffsets(end, after)) == [b"two"]
    new, last = r._read(after, None)
    assert values(new) == [b"new"] and [x[2] for x in rows + late + new] == [0, 0, 1]
    assert values(r.readBetweenOffsets(after, last)) == [b"new"]
    assert r._read(last, None) == ([], last)


def test_reader_caps_and_budget(tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b"a" * 200_000 + b"\nshort\n" + b"b" * 16 + b"\n")
    r = reader(p, maxLineBytes="16")
    rows, _ = r._read(r.initialOffset(), None)
    assert [(x[0], x[1]) for x in rows] == [(None, 200_000), (b"short", 5), (b"b" * 16, 16)]
    small = reader(p, budget="10")
    rows, end = small._read(small.initialOffset(), None)
    assert len(rows) == 1
    rows, _ = small._read(end, None)
    assert values(rows) == [b"short", b"b" * 16]


def test_follow_records_and_restart(spark, tmp_path):
    p, at = tmp_path / "x.log", str(tmp_path / "state")
    p.write_text("".join(map(line, range(4))) + "bad\n")
    seen = []
    for extra in (None, 6):
        if extra:
            with p.open("a") as f:
                f.write("".join(map(line, range(4, extra))))
        q = follow(spark, str(p), Query.of('k == "a"'), seen.append, at, trigger={"processingTime": "0 seconds"})
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert [json.loads(x)["n"] for x in seen] == [0, 2, 4]


def test_follow_aggregates_are_cumulative(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("".join(map(line, range(3))))
    seen = []
    q = follow(spark, str(p), Query.of(agg="count,max(n)", group_by="k"), seen.append, str(tmp_path / "state"), trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
        with p.open("a") as f:
            f.write("".join(map(line, range(3, 7))))
        q.processAllAvailable()
    finally:
        q.stop()
    assert [json.loads(x) for x in seen[-1].split()] == [{"k": "a", "count": 4.0, "max(n)": 6.0}, {"k": "b", "count": 3.0, "max(n)": 5.0}]


def test_followed_percentiles_are_exact(spark, tmp_path):
    """The same as in batch: of 95 and 120 the 50th percentile is 120."""
    p = tmp_path / "x.log"
    p.write_text('{"k":"a","n":95}\n{"k":"b","n":-1.5}\n{"n":7}\n')
    query, seen = Query.of(agg="p50(n),p90(n),count,avg(n)", group_by="k"), []
    q = follow(spark, str(p), query, seen.append, str(tmp_path / "state"), trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
        with p.open("a") as f:
            f.write('{"k":"a","n":120}\n{"k":"b","n":0}\n{"k":"b","n":1e300}\n')
        q.processAllAvailable()
    finally:
        q.stop()
    batch = over_records(read_ndjson(spark, str(p)), query).result.collect()
    want = sorted(([r["k"] or "\0missing", *r[1:]] for r in batch), key=str)
    assert want == [["\0missing", 7.0, 7.0, 1, 7.0], ["a", 120.0, 120.0, 2, 107.5], ["b", 0.0, 1e300, 3, 1e300 / 3]]
    assert [[x["k"], x["p50(n)"], x["p90(n)"], x["count"], x["avg(n)"]] for x in map(json.loads, seen[-1].splitlines())] == want


def test_followed_guard_keeps_first_keys_across_rotation(spark, tmp_path):
    """The new file's inode is lower than the old one's; what was shown first stays."""
    spare, p = tmp_path / "spare", tmp_path / "x.log"
    spare.write_text('{"k":"late"}\n')
    p.write_text('{"k":"early"}\n')
    seen = []
    q = follow(spark, str(p), Query.of(agg="count", group_by="k", limit=1), seen.append, str(tmp_path / "state"), trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
        os.rename(p, tmp_path / "x.log.1")
        os.rename(spare, p)
        q.processAllAvailable()
    finally:
        q.stop()
    assert [json.loads(x)["k"] for x in seen] == ["early", "early"]


def test_reader_goes_on_after_a_restart_and_two_rotations(tmp_path):
    """What was added and rotated away while nothing ran is read: the old file's rest, the one between, the new one."""
    p = tmp_path / "x.log"
    p.write_bytes(b"one\ntwo\n")
    rows, end = reader(p)._read(reader(p).initialOffset(), None)
    with p.open("ab") as f:
        f.write(b"three\n")
    os.rename(p, tmp_path / "x.log.1")
    p.write_bytes(b"four\nfive\n")
    os.utime(p, ns=(0, os.stat(tmp_path / "x.log.1").st_mtime_ns + 1000))
    os.rename(tmp_path / "x.log.1", tmp_path / "x.log.2")
    os.rename(p, tmp_path / "x.log.1")
    (tmp_path / "x.log.swp").write_bytes(b"no log\n")
    p.write_bytes(b"six\n")
    again, seen, offsets = reader(p), [], [end]
    while True:
        more, end = again._read(end, None)
        if not more:
            break
        seen += more
        offsets.append(end)
    assert values(seen) == [b"three", b"four", b"five", b"six"] and [x[2] for x in seen] == [0, 1, 1, 2]
    replayed = [x for a, b in zip(offsets, offsets[1:]) for x in reader(p).readBetweenOffsets(a, b)]
    assert replayed == seen


def test_reader_tells_a_new_file_of_the_same_inode(tmp_path):
    p = tmp_path / "x.log"
    p.write_bytes(b"one\ntwo\n")
    rows, end = reader(p)._read(reader(p).initialOffset(), None)
    with p.open("r+b") as f:
        f.write(b"uno\ndos\ntres\n")
    more, after = reader(p)._read(end, None)
    assert values(more) == [b"uno", b"dos", b"tres"] and after["gen"] == 1


def followed(spark, path, state, query, pieces, restart=False):
    """What is emitted last, and the counts of lines, after ``pieces`` were added one by one."""
    seen, counts = [], []
    running = None
    for piece in pieces:
        with open(path, "a") as f:
            f.write(piece)
        if running is None or restart:
            if running is not None:
                running.stop()
            running = follow(spark, str(path), query, seen.append, str(state), trigger={"processingTime": "0 seconds"}, counted=counts.append)
        running.processAllAvailable()
    running.stop()
    return seen[-1], counts[-1]


@pytest.mark.parametrize("mode", ["exact", "sample", "kll"])
def test_followed_guard_keeps_bounded_state(spark, tmp_path, mode):
    """10,000 keys and a limit of 3: four groups are kept, and they are those of a batch."""
    lines = [json.dumps({"k": f"key{i % 10_000}", "n": i % 7}) + "\n" for i in range(12_000)]
    pieces = ["".join(lines[:2]), "".join(lines[2:9000]), "bad\n\n" + "".join(lines[9000:])]
    query = Query.of(agg="count,sum(n),p50(n),max(n)", group_by="k", limit=3, percentiles=mode, capacity=20_000)
    p = tmp_path / "x.log"
    last, counts = followed(spark, p, tmp_path / "state", query, pieces, restart=True)
    assert counts == {"record": 12_000, "blank": 1, "malformed": 1, "too_long": 0}
    kept = spark.read.parquet(*[str(x) for x in sorted((tmp_path / "state" / "parts").glob("2/[sv]*"))][:1])
    assert kept.select("o", "k0").distinct().count() == 4
    batch = over_records(read_ndjson(spark, str(p)), query).aggregation
    want = {r["k"]: tuple(r)[1:] for r in batch.rows.collect()}
    got = {r["k"]: (int(r["count"]), r["sum(n)"], r["p50(n)"], r["max(n)"]) for r in map(json.loads, last.splitlines())}
    assert got == want and set(want) == {"key0", "key1", "key2"}
    state = {x.name: spark.read.parquet(str(x)) for x in (tmp_path / "state" / "parts" / "2").iterdir() if x.name != "lines"}
    over = batch.groups_of(state).where("o").first()
    assert over["records"] == 12_000 - sum(r[0] for r in want.values()) == batch.overflow.first()["count"]


def test_follow_refuses_what_it_cannot_keep(spark, tmp_path):
    with pytest.raises(ValueError, match="exact, sample or kll"):
        follow(spark, str(tmp_path / "x"), Query.of(agg="p50(n)", percentiles="approx"), print, str(tmp_path / "s"))
