import hashlib
import random
from itertools import groupby

from pyspark.sql import functions as F

from emberlens.llm import manifest as m
from emberlens.llm import queries, ranks
from tests.oracle import connect, same


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    return [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def leaf_of(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def plain(rows):
    """(id, leaf, subroot, root, siblings) of each row."""
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    ordered = sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [(list(g), None) for _, g in groupby(ordered, key)]
    trees = [(g, tree([leaf_of(r) for r in g])) for g, _ in trees]
    top = tree([t[-1][0] for _, t in trees])
    out = []
    for k, (g, t) in enumerate(trees):
        for i, r in enumerate(g):
            steps = path(t, i) + path(top, k)
            out.append((r[0], leaf_of(r), t[-1][0], top[-1][0], H(*(x for _, s in steps for x in s)), steps))
    return out


def frame(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, g string, idx long, n long, hash string, path string"
    return spark.createDataFrame([(*r, "g", 1, 2, "h", "p") for r in rows], schema)


def found(spark, rows):
    out = m.manifest(frame(spark, rows))
    return sorted((tuple(r) for r in out.select("id", "leaf", "subroot", "root", m.proof(F.col("path"))).collect()), key=str)


def some_rows(n, sources):
    rnd = random.Random(4)
    return [(i, rnd.choice(sources), rnd.choice(["en", None, "dé"]), i * 7, rnd.choice(["", "Text é", "x" * 50, None])) for i in range(n)]


def test_against_a_plain_tree(spark):
    rows = some_rows(700, [None, "a", "a", "a", "b", "é", "Z"]) + [(9999, "alone", "en", 1, "t"), (None, "a", "en", 2, "null id"), (5, "a", "en", 3, "again"), (5, "a", "en", 3, "again")]
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == sorted((r[:5] for r in plain(rows)), key=str)


def test_many_groups(spark):
    rows = [(i, f"s{i % 40}", "en", i, "t") for i in range(300)]
    assert found(spark, rows) == sorted((r[:5] for r in plain(rows)), key=str)


def test_one_row_and_none(spark):
    assert found(spark, [(1, "s", None, None, None)]) == [(1, *[leaf_of((1, "s", None, None, None))] * 3, H(""))]
    assert found(spark, []) == []


def test_sixteen_and_seventeen(spark):
    for n in (16, 17, 256, 257):
        rows = [(i, "s", "en", i, "t") for i in range(n)]
        assert found(spark, rows) == sorted((r[:5] for r in plain(rows)), key=str)


def test_folding_finds_every_changed_leaf(spark):
    rows = some_rows(60, ["a", "b"])
    out = m.manifest(frame(spark, rows), extra={"other": m.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.lit("new")])})
    out = out.select("root", m.folded(F.col("leaf"), F.col("path")).alias("same"), m.folded(F.col("other"), F.col("path")).alias("changed")).collect()
    assert all(r["same"] == r["root"] != r["changed"] for r in out)


def test_numbers_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (-F.col("id")).alias("k"))
    got = ranks.numbered(df, "g", [F.asc("g"), F.asc("k")]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["g"], r["k"])):
        assert r["idx"] == by.get(r["g"], 0)
        by[r["g"]] = r["idx"] + 1
    assert all(r["n"] == by[r["g"]] for r in got) and len(got) == 3000


def test_query_against_duckdb(spark, sf):
    same(queries.QUERIES["op12_merkle_manifest"](spark, sf), connect(sf), queries.ORACLE["op12_merkle_manifest"])
