import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from emberlens.llm import fingerprints, graph, near_dedup, textvec

SCHEMA = "doc_id long, text string, exact long, node long, comp long, bucket long, class_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def classes(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(300, 340)]
    links = [(a, b) for a, b in links if a != b]
    want = classes(341, links)
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for pair in links for i in pair}


@pytest.mark.parametrize("density", [0.0, 0.02, 0.4])
def test_linked_loses_no_link_and_spares_pairs(spark, density):
    """Buckets of 90 and 12 nodes; a pair is linked by a coin that only verification can see."""
    nodes = list(range(100))
    rnd = random.Random(7)
    link = {(a, b) for a in nodes for b in range(a + 1, 100) if rnd.random() < density}
    banded = spark.createDataFrame([(i, 1) for i in range(90)] + [(i, 2) for i in range(85, 97)] + [(99, 3)], "node long, bucket long")
    asked = []

    def prepare(met):
        assert met.count() == 97

        def verify(pairs):
            found = [(r["a"], r["b"]) for r in pairs.collect()]
            asked.extend(found)
            return spark.createDataFrame([p for p in found if p in link], "a long, b long")

        return verify

    got = {r["node"]: r["comp"] for r in graph.linked(banded, prepare).collect()}
    proposed = {(a, b) for a in nodes for b in range(a + 1, 100) if (b < 90) or (85 <= a and b < 97)}
    want = classes(100, link & proposed)
    assert [got.get(i, i) for i in nodes] == want
    assert len(asked) == len(set(asked))
    if density == 0.4:
        assert len(asked) < len(proposed) / 4
    if density == 0.0:
        assert set(asked) == proposed


def bag(text):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def signature(text, registers):
    data, at = textvec.flat(pa.array([text]))
    start, end, of = textvec.words(data, at)
    h, _ = textvec.hashes(data, start, end)
    return near_dedup.signatures(*near_dedup.bags(*textvec.shingles(h, of)), 1, registers)[0]


@pytest.mark.parametrize("reps", [(1, 1), (300, 370), (5, 64)])
def test_signatures_estimate_weighted_jaccard(reps):
    rnd = random.Random(1)
    a = " ".join(["p q r s t u"] * reps[0] + [f"w{rnd.randrange(200)}" for _ in range(300)])
    b = " ".join(["p q r s t u"] * reps[1] + a.split()[6 * reps[0] :][:250])
    want = jaccard(bag(a), bag(b))
    assert near_dedup.similarity(pa.array([a]), pa.array([b]))[0] == pytest.approx(want)
    got = (signature(a, 6000) == signature(b, 6000)).mean()
    assert abs(got - want) < 4 * (want * (1 - want) / 6000) ** 0.5 + 1e-9


def test_short_texts_fill_every_register():
    for text in ("a", "a b c d e f", "x " * 7):
        assert (signature(text, 126) != 0).all()


@pytest.mark.parametrize("sim, least", [(0.8, 0.998), (0.82, 0.9995), (0.85, 0.9999)])
def test_bands_meet_pairs_at_the_threshold(sim, least):
    agree = np.random.Generator(np.random.PCG64(3)).random((40_000, near_dedup.REGISTERS)) < sim
    met = np.zeros(len(agree), bool)
    for band in near_dedup._chosen():
        met |= agree[:, band].all(1)
    assert met.mean() >= least


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for size in (1, 1, 2, 3, 25):
        base = [word() for _ in range(150)]
        for _ in range(size):
            copy = base[:]
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(150)] = word()
            rows.append((i, " ".join(copy)))
            i += 1
    odd = [None, "", "!!!", "???", "!!!", "one two", "One, TWO!", "one two three", "a b c d e", "w " * 30_000, "W " * 30_000, "w " * 29_000]
    rows += [(100 + k, t) for k, t in enumerate(odd)] + [(None, "null id words here now"), (None, "null id words here now"), (7, rows[7][1])]
    return rows


def test_near_classes_against_all_pairs(spark):
    rows = corpus()
    bags = [bag(t) for _, t in rows]
    links = []
    for x in range(len(rows)):
        for y in range(x):
            same = (rows[x][1] or "") == (rows[y][1] or "")
            if same or (bags[x] and jaccard(bags[x], bags[y]) >= 0.8):
                links.append((x, y))
    want = defaultdict(list)
    for k, c in enumerate(classes(len(rows), links)):
        want[c].append(rows[k][0])
    df = docs(spark, rows)
    got = near_dedup.near_classes(df).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
    have = Counter((r["class_id"], r["class_size"]) for r in got)
    least = lambda ids: None if None in ids else min(ids)
    assert have == Counter((least(v), len(v)) for v in want.values() for _ in v)
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(want)


def same_classes(got, rows, links):
    want = defaultdict(list)
    for k, c in enumerate(classes(len(rows), links)):
        want[c].append(rows[k][0])
    assert Counter((r["class_id"], r["class_size"]) for r in got) == Counter((min(v), len(v)) for v in want.values() for _ in v)


def large_groups():
    """Copies with few and many changes, copies of copies, and texts of one boilerplate with common fillings."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base, fill = [word() for _ in range(120)], [[word() for _ in range(6)] for _ in range(5)]
    texts = [base]
    for k in range(150):
        copy = (base if k % 3 else rnd.choice(texts))[:]
        for _ in range(rnd.choice((1, 2, 3, 5, 8))):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.choice((0, 1, 1, 1))] = [word()]
        texts.append(copy)
    for _ in range(70):
        texts.append(base[:60] + [w for f in fill for w in (f if rnd.random() < 0.7 else [word()])])
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_large_torn_groups_against_all_pairs(spark, monkeypatch):
    rows = large_groups()
    each = [bag(t) for _, t in rows]
    sims = {(x, y): jaccard(each[x], each[y]) for x in range(len(rows)) for y in range(x)}
    assert sum(s >= 0.8 for s in sims.values()) > 500 and sum(0.6 <= s < 0.8 for s in sims.values()) > 2000
    compared, plain = [], near_dedup.verifier

    def counted(own, threshold):
        verify = plain(own, threshold)
        return lambda pairs: compared.append(pairs.count()) or verify(pairs)

    monkeypatch.setattr(near_dedup, "verifier", counted)
    same_classes(near_dedup.near_classes(docs(spark, rows)).collect(), rows, [p for p, s in sims.items() if s >= 0.8])
    assert sum(compared) < len(sims) / 6


def test_bounds_leave_out_no_link(spark):
    """Every pair of a group at the threshold or over is proposed, whatever is linked so far."""
    rows = large_groups()
    each = [bag(t) for _, t in rows]
    want = {(x, y) for y in range(len(rows)) for x in range(y) if jaccard(each[x], each[y]) >= 0.8}
    own = spark.createDataFrame(rows, "rid long, text string")
    groups = spark.createDataFrame([(0, i) for i, _ in rows], "hub long, node long")
    placed = groups.selectExpr("hub", "node", "node AS comp")
    got = set()
    for propose in near_dedup.bounded(own, 0.8)(groups):
        got |= {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in propose(placed).collect()}
    main = min(i for i, _ in rows)  # every node alone: the group's main component is one node, which others seek
    assert want <= got and main == 0
    assert len(got) < len(rows) ** 2 / 2


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    a = " ".join(f"w{k}" for k in range(100))
    rows = [(1, a)] * 40 + [(2, a + " more words")] * 40
    seen, plain = [], near_dedup.verifier

    def counted(own, threshold):
        seen.append(own.count())
        return plain(own, threshold)

    monkeypatch.setattr(near_dedup, "verifier", counted)
    got = near_dedup.near_classes(docs(spark, rows)).collect()
    assert len(got) == 80 and {(r["class_id"], r["class_size"]) for r in got} == {(1, 80)} and sum(r["kept"] for r in got) == 1
    assert seen == [2]


def test_a_text_with_many_partners_is_replicated(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PARTNERS", 3)
    own = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p {i}") for i in range(12)], "rid long, text string")
    pairs = [(min(5, i), max(5, i)) for i in range(12) if i != 5] + [(0, 1)]
    got = near_dedup.verifier(own, 0.5)(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((min(r), max(r)) for r in got) == sorted(pairs)


def test_empty(spark):
    none = docs(spark, [])
    assert near_dedup.near_classes(none).count() == 0 and near_dedup.drop_near_copies(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0


def plain_votes(spark, text):
    """The fingerprint by its definition, with the term hashes of Spark's xxhash64."""
    words = [w for w in re.split(r"\s+", (text or "").lower()) if w]
    if not words:
        return 0
    terms = [words[k : k + 5] for k in range(max(1, len(words) - 4))]
    cols = ", ".join(f"xxhash64(w[{k}])" for k in range(5))
    df = spark.createDataFrame([(t + [None] * (5 - len(t)),) for t in terms], "w array<string>")
    # Hashes of absent words are left out, as in the operator.
    df = df.selectExpr("xxhash64(" + ", ".join(f"if(w[{k}] is null, null, {c})" for k, c in enumerate(cols.split(", "))) + ") AS a").selectExpr("a", "xxhash64(a, 1) AS b")
    sums = np.zeros(128, int)
    for r in df.collect():
        h = ((r["a"] & (2**64 - 1)) << 64) | (r["b"] & (2**64 - 1))
        sums += np.array([1 if h >> k & 1 else -1 for k in range(128)])
    return sum(1 << k for k in range(128) if sums[k] > 0)


def test_fingerprints_against_definition(spark):
    rows = [(3, "alpha beta Gamma delta epsilon zeta eta"), (1, "one two"), (2, None), (9, "é " * 4000), (None, "x y z"), (3, "tie text"), (20, "alpha beta gamma delta epsilon zeta eta")]
    df = docs(spark, rows)
    got = fingerprints.fingerprints(df).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    assert len(got) == len(rows)
    prints = {t: plain_votes(spark, t) for _, t in rows}
    by = defaultdict(set)
    for r in got:
        by[r["id"]].add(r["fingerprint"])
    for i, t in rows:
        assert f"{prints[t]:032x}" in by[i]
    same = [r for r in got if r["id"] in (3, 20) and r["fingerprint"] == f"{prints[rows[0][1]]:032x}"]
    assert {r["class_id"] for r in same} == {3}
    edited = {}
    for k in (0, 2, 3):  # ids without ties beside them
        i, t = rows[order[k]]
        nxt = rows[order[k + 1]][1] or ""
        n = len(t or "")
        edited[i] = (t or "")[: n - n // 2] + nxt[: n // 2]
    import hashlib

    shas = {r["id"]: r["edited_sha256"] for r in got}
    for i in (None, 2):
        assert shas[i] == hashlib.sha256(edited[i].encode()).hexdigest()


def test_single_row_follows_itself(spark):
    r = fingerprints.fingerprints(docs(spark, [(5, "a b c d e f g h")])).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 15


def test_radius_search_finds_all(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(128) for _ in range(40)]
    prints = base + [b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randrange(6))) for b in base for _ in range(3)] + base[:5]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(i, (signed(p >> 64), signed(p & (2**64 - 1)))) for i, p in enumerate(prints)], "rid long, f struct<hi:long,lo:long>")
    got = {r["rid"]: r["comp"] for r in fingerprints.within_radius(df, 3).collect()}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert [got.get(i, i) for i in range(len(prints))] == classes(len(prints), links)
