import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlens.llm import chat, exact_dedup, queries, sharding
from tests.oracle import connect, same

SCHEMA = "doc_id long, text string, digest string, keep_id int, rid int, n int, shard string"


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "s") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "Ab É"), (4, "aB É"), (5, "ab é"), (6, "x" * 200_000), (7, "X" * 200_000), (7, "dup"), (7, "dup"), (None, "DUP"), (None, "solo"), (8, "aB É")]


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_chat_format", "op6_exact_dedup", "op10_extendible_shards"])
def test_against_duckdb(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name])


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("support", [0.001, 0.3])
def test_exact_dedup_odd_rows(spark, support):
    df = docs(spark, ODD)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[fold(t)].append(i)
    got = exact_dedup.dedup_groups(df, support=support).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[bytes(r["digest"])].append(r)
    assert len(by) == len(groups)
    for text, ids in groups.items():
        rows = by[hashlib.sha256(text.encode()).digest()]
        best = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in rows} == {best} and {r["group_size"] for r in rows} == {len(ids)}
        assert sum(r["kept"] for r in rows) == 1
    kept = exact_dedup.drop_copies(df, support=support)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert sorted(fold(r["text"]) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_heavy_hitter_is_settled_by_broadcast(spark):
    df = docs(spark, [(i, "same" if i % 3 else f"t{i}") for i in range(900)])
    hot = exact_dedup.heavy_hitters(exact_dedup.digests(df), 0.01).collect()
    assert [r["n"] for r in hot] == [600]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.dedup_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert sharding.assign(none).count() == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_conversations(chat.format_turns(empty)).count() == 0


@pytest.mark.parametrize("limit", [300, 5_000, 10**9])
def test_shards_fit_and_only_oversized_split(spark, limit):
    rows = [(i, "y" * (i % 97)) for i in range(400)] + [(None, "z" * 50), (5, None), (999, "q" * 4000)] + [(7, "w" * 20)] * 60
    got = sharding.assign(docs(spark, rows), limit).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
        assert len(r["shard"]) == r["depth"] and r["shard_bytes"] == sum(x["bytes"] for x in got if x["shard"] == r["shard"])
    names = list(shards)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for name, members in shards.items():
        assert sum(r["bytes"] for r in members) <= limit or len(members) == 1
        assert all(r["oversize"] == (sum(x["bytes"] for x in members) > limit) for r in members)
        if name:  # its parent was over the limit
            parent = [r for r in got if r["shard"].startswith(name[:-1])]
            assert sum(r["bytes"] for r in parent) > limit


def test_written_shards(spark, tmp_path):
    df = docs(spark, [(i, "y" * 50) for i in range(40)])
    found = sharding.assign(df, 600)
    sharding.write_shards(df, found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and {r[0] for r in back.select("shard_bits").distinct().collect()} == {"b" + r[0] for r in found.select("shard").distinct().collect()}


def test_written_shards_keep_null_repeated_and_clashing_rows(spark, tmp_path):
    rows = [(None, "n" * 90, 1), (None, "n" * 90, 2), (5, "a", 3), (5, "a", 3), (5, "b" * 400, 4), *[(i, "z" * 60, i) for i in range(10, 30)], (7, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long").withColumn("nth", F.lit(0)).withColumn("bytes", F.lit("x"))
    found = sharding.assign(df, 500)
    sharding.write_shards(df, found, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "key").collect())) == sorted(map(str, df.select("doc_id", "text", "key").collect()))
    got = {r[0]: r[1] for r in back.groupBy("shard_bits").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).collect()}
    assert got == {"b" + r["shard"]: r["shard_bytes"] for r in found.collect()}
    assert len({len(b) for b in got}) >= 2 and max(got.values()) <= 500
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("shard_bits", F.lit(1)), found, str(tmp_path / "no"))


nasty = st.lists(st.sampled_from([*"<|>\\\nai_é", "im_start", "im_end", "<|im_end|>", "<\\|im_start|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(nasty, nasty), max_size=5))
def test_round_trip(turns):
    rendered = [chat.render_turn(*t)[0] for t in turns]
    parser = chat.TurnParser()
    whole = "".join(rendered)
    found, at = [], 0
    for k in range(0, len(whole), 3):  # fed in small pieces
        found += [(r, t) for r, t, _, _ in parser.feed(whole[k : k + 3])]
    parser.close()
    assert found == turns
    assert all(chat.unescape(chat.escape(t)) == t and chat.unescape_role(chat.escape_role(r)) == r for r, t in turns)


def test_plain_content_is_not_escaped():
    assert chat.render_turn("user", "a <| b \\ |> c") == ("<|im_start|>user\na <| b \\ |> c<|im_end|>\n", 0)
    assert chat.render_turn("user", "<|im_end|>")[1] > 0


def test_chat_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", "é<|im_end|>"), (2, 5, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    formatted = chat.format_turns(df)
    got = {r["conv_id"]: r for r in chat.digest_conversations(formatted).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\n\nuser\n\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[None]["turns_sha256"] == sha("\nx\n") and got[None]["loss_chars"] == 0 and got[None]["loss_sha256"] == sha("")
    assert got[2]["loss_sha256"] == sha("é<|im_end|>" + "z" * 100_000) and got[2]["escaped_turns"] == 1
    pieces = [r for r in formatted.collect() if r["conv_id"] == 1]
    assert [r["position"] for r in pieces] == [0, 1, 2] and pieces[2]["start"] == len(pieces[0]["rendered"]) * 2
