import random

import numpy as np
import pyarrow as pa
import pytest

from emberlens.llm import queries, signature_trees as st
from tests.oracle import connect, same


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def texts(seed, families, copies, words=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rnd.choice(vocabulary) for _ in range(14)]
    out = []
    for f in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, words * 2))]
        if f % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = shared
        for _ in range(copies):
            one = list(base)
            for _ in range(rnd.randrange(0, 3)):
                one[rnd.randrange(len(one))] = rnd.choice(vocabulary).upper()
            if rnd.random() < 0.3:
                one += [rnd.choice(vocabulary) for _ in range(rnd.randrange(4))]
            out.append(rnd.choice([" ", "\n", "\t "]).join(one))
    rnd.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, size long, node long, cluster long, comp long")


def joined(spark, rows):
    return sorted(map(tuple, st.jaccard_join(frame(spark, rows)).collect()), key=str)


def test_fewest_is_a_bound_for_every_pair_of_sizes():
    for a in range(st.LEAST, 1500):
        b = np.arange(max(st.LEAST, -(-85 * a // 100)), 100 * a // 85 + 1)
        shared = np.minimum(st.prefix_length(a) - a + st.overlap(a, b), st.prefix_length(b) - b + st.overlap(a, b))
        assert (shared >= st.fewest(a)).all() and (shared >= st.fewest(b)).all()


@pytest.mark.parametrize("fan, narrow", [(2, 64), (8, 512), (3, 1 << 12)])
def test_tree_joins_what_brute_force_joins(monkeypatch, fan, narrow):
    monkeypatch.setattr(st, "FAN", fan)
    monkeypatch.setattr(st, "NARROW", narrow)
    monkeypatch.setattr(st, "WIDE", max(narrow, 256))
    monkeypatch.setattr(st, "AT_ONCE", 1 << 9)
    many = sorted({t for t in texts(5, 40, 8) if len(shingle_set(t)) >= st.LEAST})
    n = len(many)
    for sides in (np.zeros(n, int), np.arange(n) % 2):
        table = pa.table({"node": np.arange(n), "cluster": np.zeros(n, int), "label": np.arange(n), "side": sides, "text": many})
        got = st._joined(table)
        sets = [shingle_set(t) for t in many]
        linked = [(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and (not sides.any() or sides[i] != sides[j])]

        def comps(pairs):
            label = list(range(n))
            for i, j in pairs:
                label = [label[j] if x == label[i] else x for x in label]
            return [label.index(x) for x in label]

        found = list(zip(got["a"].to_pylist(), got["b"].to_pylist()))
        assert comps(found) == comps(linked) and len(linked) > 40
        assert all((b, a) in linked or (a, b) in linked for a, b in found) and len(found) < n


def test_against_brute_force(spark):
    rows = list(enumerate(texts(1, 40, 5)))
    assert joined(spark, rows) == brute(rows)


def test_large_clusters_are_cut_into_parts(spark, monkeypatch):
    """Clusters of more than 2,048 shingles, so of more than eight documents: stars and pairs of parts decide."""
    monkeypatch.setattr(st, "TOKENS", 8 * st.LIGHT)
    rows = list(enumerate(texts(3, 4, 40)))
    assert joined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e"), (4, "A b C d e"), (4, "a b c d e"), (5, "one two"), (6, "ONE two"), (7, "one"), (8, long), (9, long + " end"), (None, "q r s t u v w"), (10, "É x"), (11, "é x"), (12, "a b")]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, []) == []


def test_query_against_duckdb(spark, sf):
    same(queries.QUERIES["op11_signature_tree_join"](spark, sf), connect(sf), queries.ORACLE["op11_signature_tree_join"])
