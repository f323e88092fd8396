import itertools
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberlens.llm import common, language, licenses, toxicity


def chain(unary, steps):
    """Marginals of a two-label chain by summing over all labellings."""
    n, total, on = len(unary), 0.0, np.zeros(len(unary))
    cost = {(0, 0): 0.0, (0, 1): steps[0], (1, 0): steps[1], (1, 1): steps[2]}
    for y in np.ndindex(*[2] * n):
        w = np.exp(sum(u for u, k in zip(unary, y) if k) + sum(cost[a, b] for a, b in zip(y, y[1:])))
        total += w
        on += w * np.array(y)
    return np.log(on / total) - np.log(1 - on / total)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 7, 3, 5])
    unary, steps = rng.normal(size=16) * 2, np.array([-1.0, 0.5, 1.5])
    first = np.cumsum(sizes) - sizes
    got, _, _ = toxicity.marginals(unary, first, sizes, steps)
    want = np.concatenate([chain(unary[a : a + n], steps) for a, n in zip(first, sizes)])
    assert np.allclose(got, want)


def test_expected_steps_by_enumeration():
    unary, steps, sizes = np.array([0.3, -1.0, 2.0, 0.1]), np.array([-0.5, 0.2, 0.9]), np.array([4])
    _, ahead, behind = toxicity.marginals(unary, np.array([0]), sizes, steps)
    got = toxicity._expected_steps(ahead, unary + behind, steps, np.array([1, 2, 3]))
    eps = 1e-6

    def log_z(s):
        cost = {(0, 0): 0.0, (0, 1): s[0], (1, 0): s[1], (1, 1): s[2]}
        return np.log(sum(np.exp(sum(u for u, k in zip(unary, y) if k) + sum(cost[a, b] for a, b in zip(y, y[1:]))) for y in np.ndindex(2, 2, 2, 2)))

    want = [(log_z(steps + eps * d) - log_z(steps - eps * d)) / (2 * eps) for d in np.eye(3)]
    assert np.allclose(got, want, atol=1e-5)


def words(rnd, n, alphabet="abcdefg"):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def toxic_model(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(240):
        text = words(rnd, 60)
        if i % 4 == 0:
            for _ in range(3):
                text[rnd.randrange(60)] = rnd.choice(["vermin", "zzhorridly", "ZZHorrids"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    rows += [(None, "vermin", 0), (900, "vermin", None), (901, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(df, df)


def test_toxicity(spark, toxic_model):
    rnd = random.Random(8)
    clean = " ".join(words(rnd, 80))
    rows = [(1, clean), (2, f"É {clean} vermin zzhorridest vermin"), (3, None), (4, ""), (5, "!!"), (5, "!!"), (None, "x " * 60_000)]
    df = spark.createDataFrame([(i, t, 0.5, []) for i, t in rows], "doc_id long, text string, score double, spans array<int>")
    got = toxicity.score(df, toxic_model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["score"] > 0.5 > by[1]["score"] and by[3]["score"] == by[4]["score"] == by[5]["score"] < 0.5
    assert [rows[1][1][s["start"] : s["end"]] for s in by[2]["spans"]] == ["vermin", "zzhorridest", "vermin"]
    assert by[1]["spans"] == []
    assert toxicity.score(df.limit(0), toxic_model).count() == 0
    assert toxicity.score(df, None).where("score != 0").count() == 0


def test_toxicity_without_classes(spark):
    df = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, toxic int")
    assert toxicity.train(df, df) is None and toxicity.train(df, df.limit(0)) is None


def test_toxicity_held_out(spark):
    """Precision and recall, so that a constant answer fails."""
    from emberlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic = 1 AS t")
    got = QUERIES["op8_toxic_spans"](spark, sf).join(truth, "doc_id").where("held_out")
    n = got.selectExpr("count_if(t and predicted = 1) AS hit", "count_if(t) AS toxic", "count_if(predicted = 1) AS said").first()
    assert n["toxic"] > 50 and n["hit"] >= 0.9 * n["toxic"] and n["hit"] >= 0.95 * n["said"]


def test_language_held_out(spark):
    from emberlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "lang AS t")
    right = QUERIES["op9_language_mixture"](spark, sf).join(truth, "doc_id").where("held_out").selectExpr("avg(double(t = lang_pred))")
    assert right.first()[0] >= 0.97


def plain_slots(text):
    """Each word's feature slots, by their definition."""
    import pyarrow as pa

    from emberlens.llm import textvec

    data, at = textvec.flat(pa.array([text]))
    start, end, _ = textvec.words(data, at)
    return [sorted(set(r)) for r in toxicity.features(data, start, end).tolist()], toxicity.features(data, start, end).tolist()


def test_fit_against_plain_version(spark, monkeypatch):
    """Token labels by counting, and the first steps of the fit with marginals by enumeration."""
    monkeypatch.setattr(toxicity, "ROUNDS", 3)
    monkeypatch.setattr(toxicity, "STRETCH", 5)
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        text = words(rnd, 8, "ab")
        if i % 2:
            text[rnd.randrange(8)] = rnd.choice(["vermin", "vermins"])
        rows.append((i, " ".join(text), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.train(df, df)

    each = [plain_slots(t) for _, t, _ in rows]
    toxic = [y == 1 for _, _, y in rows]
    df1, df0 = ({}, {})
    for (sets, _), y in zip(each, toxic):
        for s in set().union(*sets):
            (df1 if y else df0)[s] = (df1 if y else df0).get(s, 0) + 1
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)

    def beyond_doubt(s):
        a, b = df1.get(s, 0), df0.get(s, 0)
        rate = (a + b) / (n1 + n0)
        parts = [(a, n1 * rate), (b, n0 * rate), (n1 - a, n1 * (1 - rate)), (n0 - b, n0 * (1 - rate))]
        ratio = 2 * sum(x * np.log(x / e) for x, e in parts if x > 0)
        return s != 0 and ratio > toxicity.SURE and a >= toxicity.LEAST and (a + 0.5) / n1 > toxicity.RATIO * (b + 0.5) / n0

    marked = {s for s in {*df1, *df0} if beyond_doubt(s)}
    tokens = [[bool(y and marked & set(w)) for w in sets] for (sets, _), y in zip(each, toxic)]
    assert sum(map(sum, tokens)) == n1

    pos, n = sum(map(sum, tokens)), sum(map(len, tokens))
    w, steps, bias = {}, np.zeros(3), np.log((pos + 1) / (n - pos + 1))
    seen_w, seen_s, seen_b = {}, np.full(3, 1e-8), 1e-8
    for _ in range(3):
        grad, grad_s, grad_b = {}, np.zeros(3), 0.0
        for (_, slots), y in zip(each, tokens):
            for lo in range(0, len(y), 5):
                unary = np.array([sum(w.get(s, 0.0) for s in r) + bias for r in slots[lo : lo + 5]])
                label, cost = y[lo : lo + 5], {(0, 0): 0.0, (0, 1): steps[0], (1, 0): steps[1], (1, 1): steps[2]}
                kinds = {(0, 1): 0, (1, 0): 1, (1, 1): 2}
                total, on, moves = 0.0, np.zeros(len(unary)), np.zeros(3)
                for z in np.ndindex(*[2] * len(unary)):
                    weight = np.exp(sum(u for u, k in zip(unary, z) if k) + sum(cost[p] for p in zip(z, z[1:])))
                    total += weight
                    on += weight * np.array(z)
                    for p in zip(z, z[1:]):
                        if p in kinds:
                            moves[kinds[p]] += weight
                for p in zip(label, label[1:]):
                    if tuple(map(int, p)) in kinds:
                        grad_s[kinds[tuple(map(int, p))]] += 1
                grad_s -= moves / total
                error = np.array(label, float) - on / total
                grad_b += error.sum()
                for r, e in zip(slots[lo : lo + 5], error):
                    for s in r:
                        if s:
                            grad[s] = grad.get(s, 0.0) + e
        for s, g in grad.items():
            g -= toxicity.RIDGE * n * w.get(s, 0.0)
            seen_w[s] = seen_w.get(s, 1e-8) + g * g
            w[s] = w.get(s, 0.0) + toxicity.RATE * g / np.sqrt(seen_w[s])
        seen_s, seen_b = seen_s + grad_s**2, seen_b + grad_b**2
        steps, bias = steps + toxicity.RATE * grad_s / np.sqrt(seen_s), bias + toxicity.RATE * grad_b / np.sqrt(seen_b)
    assert np.allclose(got.steps, steps, atol=1e-4) and abs(got.bias - bias) < 1e-4
    assert np.allclose([got.weights[s] for s in w], list(w.values()), atol=1e-3)
    assert set(np.flatnonzero(got.weights).tolist()) <= set(w)


def test_mixture_proportions():
    rng = np.random.default_rng(2)
    n = 400
    truth = rng.random(n) < 0.3
    ll = np.where(truth[:, None], [[-9.0, -5.0, -14.0]], [[-5.0, -9.0, -14.0]]).astype(np.float32)
    doc = np.r_[np.zeros(n, int), np.ones(50, int)]
    full, chosen, shares = language.mixture(np.r_[ll, np.tile(np.float32([[-5, -9, -14]]), (50, 1))], doc)
    assert abs(shares[0, 1] - truth.mean()) < 0.03 and chosen[0].tolist() == [True, True, False]
    assert chosen[1].tolist() == [True, False, False] and shares[1].tolist() == [1, 0, 0] and full[1, 0] > 0.95


def test_language(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(words(rnd, 30, a)), lang, 0.1) for i in range(40) for a, lang in (("abcde", "aa"), ("uvwxy", "zz"))]
    schema = "doc_id long, text string, lang string, score double"
    model = language.train(spark.createDataFrame(rows + [(1, "abc", None, 0.0), (2, None, "aa", 0.0)], schema))
    assert model[0] == ["aa", "zz"]
    mixed = " ".join(words(rnd, 70, "abcde") + words(rnd, 30, "uvwxy"))
    tests = [(1, mixed), (2, None), (3, "12 – 34"), (4, ""), (5, "É"), (6, "WXYV uvw"), (6, "WXYV uvw"), (None, "abcd " * 50_000)]
    df = spark.createDataFrame([(i, t, None, 0.5) for i, t in tests], schema)
    got = language.predict(df, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(tests)
    assert by[1]["lang_pred"] == "aa" and by[1]["languages"] == ["aa", "zz"] and abs(by[1]["proportions"][0] - 0.7) < 0.05
    assert [by[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and [by[i]["score"] for i in (2, 3, 4)] == [0.0] * 3
    assert by[6]["lang_pred"] == "zz" and by[None]["lang_pred"] == "aa" and by[5]["lang_pred"] in ("aa", "zz")
    assert language.predict(df.limit(0), model).count() == 0
    nothing = language.train(df.where("lang is not null"))
    assert language.predict(df, nothing).where("lang_pred != 'und'").count() == 0


def plain_language(train, text):
    """Answer and evidence of one text, by dictionaries, one word and one set of languages at a time."""

    def found(t):
        out, low = [], bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
        for w in re.findall(rb"[a-z\x80-\xff]+", low):
            padded = b" " + w + b" "
            out.append([padded[i : i + 3] for i in range(len(w))])
        return out

    slot = lambda g: (int.from_bytes(g, "big") * 2654435761 % 2**32) >> 16
    langs = sorted({lang for _, lang in train})
    counts, letters = {x: Counter() for x in langs}, Counter()
    for t, lang in train:
        for w in found(t):
            counts[lang].update(map(slot, w))
            letters.update(b for g in w for b in g)
    total = {x: sum(c.values()) for x, c in counts.items()}
    ll = [[sum(np.log((counts[x][slot(g)] + 0.5) / (total[x] + 0.5 * 65536)) for g in w) for x in langs] for w in found(text)]

    def fit(use):
        p = [1 / len(use)] * len(use)
        for _ in range(400):
            shares = []
            for w in ll:
                each = [q * np.exp(w[i] - max(w)) for q, i in zip(p, use)]
                shares.append([e / sum(each) for e in each])
            p = [sum(s[k] for s in shares) / len(ll) for k in range(len(use))]
        return p, sum(np.log(sum(q * np.exp(w[i] - max(w)) for q, i in zip(p, use))) + max(w) for w in ll)

    sets = [c for n in range(1, len(langs) + 1) for c in itertools.combinations(range(len(langs)), n)]
    fits = {c: fit(c) for c in sets}
    best = max(sets, key=lambda c: fits[c][1] - (len(c) - 1) * 0.5 * np.log(len(ll)))
    chance = sum(np.log(0.02 / 256 + 0.98 * letters[b] / sum(letters.values())) for w in found(text) for g in w for b in g)
    top = best[int(np.argmax(fits[best][0]))]
    return langs[top], fits[sets[-1]][0][top], fits[sets[-1]][1] - chance, [langs[i] for i in best], fits[best][0]


def test_language_against_a_plain_version(spark):
    rnd = random.Random(11)
    kinds = {"aa": "abcdefg", "bb": "efghijk", "cc": "uvwxyz"}
    train = [(" ".join(words(rnd, 25, kinds[k])), k) for _ in range(6) for k in kinds]
    tests = [" ".join(words(rnd, 40, "abcdefg")), " ".join(words(rnd, 30, "abcdefg") + words(rnd, 20, "uvwxyz")), " ".join(words(rnd, 25, "efghijk")), "Ünder ÖL uvw"]
    model = language.train(spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(train)], "doc_id long, text string, lang string"))
    got = language.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).collect()
    for r in got:
        top, score, evidence, chosen, shares = plain_language(train, tests[r["doc_id"]])
        assert r["lang_pred"] == top and abs(r["score"] - score) < 0.02 and set(r["languages"]) == set(chosen)
        assert abs(r["evidence"] - evidence) < 0.01 * abs(evidence) + 0.1
        assert np.allclose(sorted(r["proportions"]), sorted(shares), atol=0.02)


def test_letters_in_random_order_have_no_language(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rnd = random.Random(8)
    some = [r["text"] for r in docs.where("n_chars > 300").orderBy("doc_id").limit(20).collect()]
    scrambled = []
    for i, text in enumerate(some):
        letters = [c for c in text if c.isalpha()]
        rnd.shuffle(letters)
        left = iter(letters)
        scrambled.append((20_000 + i, "".join(next(left) if c.isalpha() else c for c in text), None, "s", len(text)))
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(spark.createDataFrame(scrambled, docs.schema)), sf)
    assert kept.where("doc_id >= 20000").count() == 0
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.py", "code"),
        ("a/b/COPYING.txt", "Some words first.\nThis work is licensed under the GNU General Public License, version 3.\nmore " * 3),
        ("a/b/c/d/y.py", None),
        ("a/bb/z.py", "licensed fishing boats are a different thing altogether, all of them"),
        ("q/own.py", "text\nLicensed under the Apache License, Version 2.0. And more text here"),
        ("q/none.py", ""),
        (None, "x"),
        ("q/none.py", ""),
    ]
    df = spark.createDataFrame([(i, p, t, "l", 0) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license string, rid int")
    got = {r["id"]: r for r in licenses.scan(df, F.col("path")).collect()}
    assert [(got[i]["license"], got[i]["basis"], got[i]["inherited_from"]) for i in range(9)] == [
        ("MIT", "file", None), ("GPL-3.0", "inherited", "a/b"), ("GPL-3.0", "file", None), ("GPL-3.0", "inherited", "a/b"), ("MIT", "inherited", "a"),
        ("Apache-2.0", "header", None), (None, "none", None), (None, "none", None), (None, "none", None),
    ]
    assert licenses.scan(df.limit(0), F.col("path")).count() == 0


def test_toxicity_without_a_word_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "!"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.0] * 3


def test_sums_are_the_same_when_places_are_known(spark):
    """Parts send the places of their features once; with or without, sums are those of all rows."""
    rng = np.random.default_rng(5)
    width = len(toxicity.PREFIXES) + 1
    blobs = [(i % 2, rng.integers(0, 50, (n, width), dtype=np.int32)) for i, n in enumerate([3, 0, 7, 1, 12])]
    sample = spark.createDataFrame([(y, bytearray(x.tobytes())) for y, x in blobs], "y int, slots binary")

    def counts(slots, size, toxic):
        return np.bincount(slots.ravel(), minlength=toxicity.SLOTS), np.array([len(slots), toxic.sum()])

    places = {}
    first = toxicity._summed(sample, counts, places)
    again = toxicity._summed(sample, counts, places)
    whole = np.bincount(np.concatenate([x.ravel() for _, x in blobs]), minlength=toxicity.SLOTS)
    assert places and (first[0][0] == whole).all() and (again[0][0] == whole).all()
    assert first[1].tolist() == again[1].tolist() == [23, 2]


def test_licence_odd_rows(spark, monkeypatch):
    """Null ids and paths, ties, repeated and very long rows, one directory with most rows; both ways of the lookups."""
    grant = "Released under the MIT License."
    tie = "Released under the ISC License.\nReleased under the MIT License."
    rows = [(None, None, grant), (1, "a/LICENSE", grant), (2, "a/tie", tie), (3, "a/long", "word " * 200_000 + "\n" + grant), (3, "a/long", None)]
    rows += [(i, f"a/deep/{i}", "no notice") for i in range(10, 210)] + [(10, "a/deep/10", "no notice")] * 2
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")

    def found():
        got = licenses.scan(df, F.col("path")).collect()
        return sorted((str(r["id"]), r["path"], str(r["license"]), r["basis"], str(r["inherited_from"])) for r in got)

    by_broadcast = found()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert found() == by_broadcast and len(by_broadcast) == len(rows)
    expected = [("None", "", "MIT", "file", "None"), ("1", "a/LICENSE", "MIT", "file", "None"), ("2", "a/tie", "ISC", "file", "None")]
    expected += [("3", "a/long", "MIT", "header", "None"), ("3", "a/long", "ISC", "inherited", "a")]
    expected += [(str(i), f"a/deep/{i}", "ISC", "inherited", "a") for i in [*range(10, 210), 10, 10]]
    assert by_broadcast == sorted(expected)


def test_licence_files_and_wrapped_headers(spark):
    from pathlib import Path

    folder = Path(licenses.__file__).parent / "license_texts"
    gpl = (folder / "GPL-3.0.txt").read_text()
    agpl = gpl.replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("29 June 2007", "19 November 2007")
    wrapped = lambda name, mark: "\n".join(mark + line for line in textwrap.wrap(dict(licenses.HEADERS)[name], 60))
    rows = [(name, (folder / f"{name}.txt").read_text()) for name in licenses.TITLES]
    rows += [("GPL-2.0", "#!/bin/sh\n# Copyright (C) 2020 A. Body. All rights reserved.\n#\n" + wrapped("GPL-2.0", "# ") + "\n\necho one two three\n")]
    rows += [("Apache-2.0", "package x;\n/*\n" + wrapped("Apache-2.0", "  ") + "\n*/\nclass Y {}\n")]
    rows += [("AGPL-3.0", "/*\n" + wrapped("AGPL-3.0", " * ") + "\n */\nint x;"), ("MPL-2.0", wrapped("MPL-2.0", "// ") + "\nlet y = 1;")]
    rows += [("ISC", "x = 1\n# Released under\n# the ISC License.\ny = 2"), ("MIT", "// SPDX-License-Identifier: MIT\nint x;")]
    rows += [(None, agpl), (None, "The licence of the boat\nis a different thing altogether.")]
    df = spark.createDataFrame([(i, f"src{i}/{i}", t) for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["id"]: r for r in licenses.scan(df, F.col("path")).collect()}
    assert [got[i]["license"] for i in range(len(rows))] == [name for name, _ in rows]
    assert {got[i]["basis"] for i in range(len(licenses.TITLES))} == {"file"} and got[12]["basis"] == "header"


def test_pipeline(spark, sf):
    """Each stage against a plain version of what it has to keep."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "12 34", "en", "s", 5), (10_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd).coalesce(2)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language", "exact_dedup", "near_dedup", "packing"]
    kept = docs
    for name in list(stages)[:-1]:
        before = kept.toPandas()
        kept = corpus_pipeline.staged(stages[name](spark, kept, sf), name)
        after = kept.toPandas()
        assert kept.columns == docs.columns and set(after["doc_id"]) <= set(before["doc_id"]) and after["doc_id"].is_unique
        gone = before[~before["doc_id"].isin(after["doc_id"])]
        if name == "language":
            assert {10_001, 10_002, 10_003} <= set(gone["doc_id"]) and len(gone) == 3
        if name == "exact_dedup":
            folded = before["text"].map(lambda t: "".join(c.lower() if c.isascii() else c for c in t))
            assert set(after["doc_id"]) == set(before.groupby(folded)["doc_id"].max())
    packed = stages["packing"](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_keep_clashing_columns_and_repeated_rows(spark, sf):
    """Extra columns of the names used inside stay as they are; rows of one id and text leave one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    names = ["score", "lang_pred", "spans", "answer", "verdict", "key", "key_", "id", "digest", "nth", "rid", "__key", "k0", "Text 2", "exact", "best"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    wide = wide.unionAll(wide).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)
        if name.endswith("dedup"):
            assert len({r["doc_id"] for r in rows}) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).select("doc_id").distinct().count() == 40


def test_stages_on_empty_tables(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf).columns == none.columns and stage(spark, none, sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf).count() == 0


def test_nothing_to_learn_a_language_from_drops_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5).withColumn("lang", F.lit(None).cast("string"))
    assert dict(corpus_pipeline.STAGES)["language"](spark, docs, sf).count() == 5
