"""Toxic spans by a linear-chain conditional random field.

Tokens are words; a token is clean (0) or toxic (1). Its potential is the sum of hashed
weights of the word and of its first four to eight bytes; two neighbours share a transition
potential. Forward and backward passes in log-odds form, one vector step per word position
over all documents of a group, give the exact marginal of every token over its whole
document.

Training uses a sample of the training rows bounded by ``MOST_TOXIC`` and ``MOST_CLEAN``
documents: those with the smallest hash of the id, so it does not depend on the layout; of
several rows of one id the least text trains. Labels are per document, so tokens are
labelled first: a feature is marked when its document frequencies in toxic and clean
training documents differ beyond doubt (likelihood ratio over ``SURE`` and at least
``RATIO`` times as frequent); a token of a toxic document with a marked feature is toxic,
every other token is clean. The field is then fitted by maximum conditional likelihood on
those token labels. The sample stays on the executors, in ``TASKS`` parts written to the
shared folder; each pass gives one partial sum a part, and the driver holds the weights and
these sums only (``SLOTS`` numbers each, whatever the texts' length). For the fit, documents
are cut into stretches of ``STRETCH`` words that count as chains of their own; scores always
come from whole documents.

A document's score comes from its marginals: a logistic function of the expected number of
toxic tokens, their share, and the largest marginal, fitted on the same rows with the
classes weighted as in all training rows. Tokens of marginal 0.5 or more give the offending
spans, as code point offsets.

Defined results: null and empty texts, and texts without a word, get the score of no toxic
token and no spans; rows with a null id or label never train; without training rows of both
classes, or without a word in them, every score is 0; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.common import beside, crc_mod, documents, mapped, staged, text_or_empty
from emberlens.llm.textvec import groups, hashes, words

MOST_TOXIC, MOST_CLEAN = 1500, 2000
TASKS, STRETCH = 8, 256
#: Bytes of slots that a pass over the sample works on at a time.
AT_ONCE = 4 << 20
PREFIXES = (4, 5, 6, 7, 8)
SLOTS = 1 << 19
SURE, RATIO, LEAST = 20.0, 8.0, 3
ROUNDS, RATE, RIDGE = 40, 0.5, 1e-6


class Model(NamedTuple):
    weights: np.ndarray
    #: Log-potentials of (clean, toxic), (toxic, clean) and (toxic, toxic); (clean, clean) is 0.
    steps: np.ndarray
    bias: float
    #: Intercept, then one coefficient for each document feature.
    document: np.ndarray


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Slots of each word's features, one column each; slot 0 where a word is too short."""
    h, cut = hashes(data, start, end, PREFIXES)
    return np.stack([1 + (x % np.uint64(SLOTS - 1)).astype(np.int32) * (x > 0) - (x == 0) for x in (h, *cut)], 1)


def _soft(x: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
    """log((e^a + e^(b+x)) / (e^c + e^(d+x)))"""
    return np.logaddexp(a, b + x) - np.logaddexp(c, d + x)


def marginals(unary: np.ndarray, first: np.ndarray, size: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of each token, and the forward and backward parts they are the sum of."""
    ct, tc, tt = steps
    order = np.argsort(-size, kind="stable")
    starts, sizes = first[order], size[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than each position
    ahead, behind = np.empty(len(unary)), np.zeros(len(unary))
    for t in range(longest):
        at = starts[: alive[t]] + t
        ahead[at] = unary[at] + (_soft(ahead[at - 1], ct, tt, 0.0, tc) if t else 0.0)
    for t in range(longest - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        behind[at] = _soft(unary[at + 1] + behind[at + 1], tc, tt, 0.0, ct)
    return ahead + behind, ahead, behind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def summary(log_odds: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A document's features from its tokens' marginals; no tokens: zeros."""
    out = np.zeros((len(first), 3))
    some = np.flatnonzero(size > 0)
    if len(some):
        p = _sigmoid(log_odds)
        total = np.add.reduceat(p, first[some])
        out[some] = np.stack([np.log1p(total), np.sqrt(total / size[some]), np.maximum.reduceat(p, first[some])], 1)
    return out


def _marked(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Features whose document frequencies in ``n1`` toxic and ``n0`` clean documents differ beyond doubt."""

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0)

    a, b = toxic.astype(float), clean.astype(float)
    rate = (a + b) / (n1 + n0)
    ratio = 2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate)))
    marked = (ratio > SURE) & (a >= LEAST) & ((a + 0.5) / n1 > RATIO * (b + 0.5) / n0)
    marked[0] = False
    return marked


def _expected_steps(ahead: np.ndarray, right: np.ndarray, steps: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Expected number of each kind of step between neighbours, a stretch at a time."""
    total = np.zeros(3)
    for lo in range(0, len(later), 1 << 18):
        at = later[lo : lo + (1 << 18)]
        x, y = ahead[at - 1], right[at]
        pairs = np.stack([np.zeros(len(at)), steps[0] + y, steps[1] + x, steps[2] + x + y])
        pairs = np.exp(pairs - pairs.max(0))
        total += (pairs / pairs.sum(0)).sum(1)[1:]
    return total


def _cut(size: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of each stretch of documents of these lengths."""
    pieces = -(-size // stretch)
    first = np.cumsum(size) - size
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + nth * stretch
    return start, np.minimum(stretch, np.repeat(first + size, pieces) - start)


def _gradient(slots: np.ndarray, y: np.ndarray, size: np.ndarray, model: Model, stretch: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood: by feature, by kind of step, and of the bias."""
    first, length = _cut(size, stretch)
    unary = model.weights[slots].sum(1) + model.bias
    odds, ahead, behind = marginals(unary, first, length, model.steps)
    error = y - _sigmoid(odds)
    joined = np.ones(len(y), bool)
    joined[first] = False
    later = np.flatnonzero(joined)
    truth = np.array([(~y[later - 1] & y[later]).sum(), (y[later - 1] & ~y[later]).sum(), (y[later - 1] & y[later]).sum()], float)
    by_feature = np.zeros(SLOTS)
    for k in range(slots.shape[1]):
        by_feature += np.bincount(slots[:, k], weights=error, minlength=SLOTS)
    by_feature[0] = 0
    return by_feature, truth - _expected_steps(ahead, unary + behind, model.steps, later), float(error.sum())


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, slots and sizes of groups of documents ``y, slots``, of about ``AT_ONCE`` bytes (a longer one alone)."""
    width = len(PREFIXES) + 1
    y, blobs = batch.column(0).to_numpy(zero_copy_only=False) == 1, batch.column(1)
    size = np.array([len(x.as_buffer()) for x in blobs], np.int64)
    at, lo = np.r_[0, np.cumsum(size)], 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + AT_ONCE, side="right")) - 1)
        slots = np.frombuffer(b"".join(x.as_buffer() for x in blobs[lo:hi]), np.int32).reshape(-1, width)
        yield y[lo:hi], slots, size[lo:hi] // (4 * width)
        lo = hi


_SUMS = "part bigint, at binary, sums binary, few binary"


def _summed(
    sample: DataFrame, pass_over: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], places: dict[int, np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """``pass_over`` (slots, document sizes, document labels) gives sums by feature (a row or
    more of ``SLOTS`` numbers) and a few others for a group of documents; they are added up.

    A task works on groups of about ``AT_ONCE`` bytes, so what it holds does not grow with the
    part it reads. A part sends one float32 for each feature that it holds. Which these are it sends only
    where ``places`` (by a digest of them) does not say yet; what is new is put there.
    """
    known = set(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, few, there = None, None, np.zeros(SLOTS, bool)
        for b in batches:
            for y, slots, size in _documents(b):
                there[slots.ravel()] = True
                more, others = pass_over(slots, size, y)
                more = np.atleast_2d(more)
                sums, few = (more, np.asarray(others, float)) if sums is None else (sums + more, few + others)
        if sums is None:
            return
        at = np.flatnonzero(there).astype(np.int32)
        part = int.from_bytes(hashlib.blake2b(at.tobytes(), digest_size=8).digest(), "little", signed=True)
        held = np.ascontiguousarray(sums[:, at], np.float32)
        blobs = (None if part in known else at.tobytes(), held.tobytes(), few.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part]), *[pa.array([x], pa.binary()) for x in blobs]], ["part", "at", "sums", "few"])

    # Bounded: TASKS rows of at most SLOTS numbers.
    total, others = np.zeros(0), np.zeros(0)
    for r in mapped(sample, run, _SUMS).collect():
        if r["at"] is not None:
            places[r["part"]] = np.frombuffer(bytes(r["at"]), np.int32)
        at, few = places[r["part"]], np.frombuffer(bytes(r["few"]))
        if not len(others):
            others = np.zeros(len(few))
        if len(at):
            held = np.frombuffer(bytes(r["sums"]), np.float32).reshape(-1, len(at))
            if not len(total):
                total = np.zeros((len(held), SLOTS))
            total[:, at] += held
        others += few
    return (total if len(total) else np.zeros((1, SLOTS))), others


def _fit_field(sample: DataFrame, marked: np.ndarray, places: dict[int, np.ndarray]) -> Model | None:
    """Maximum conditional likelihood by AdaGrad, every step over the whole sample."""
    context = sample.sparkSession.sparkContext
    marks, stretch = context.broadcast(marked), STRETCH

    def labels(slots: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        return marks.value[slots].any(1) & np.repeat(toxic, size)

    def count(slots: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(SLOTS), np.array([labels(slots, size, toxic).sum(), len(slots)])

    few = _summed(sample, count, places)[1]
    if not len(few) or not few[1]:
        return None
    model = Model(np.zeros(SLOTS, np.float32), np.zeros(3), float(np.log((few[0] + 1) / (few[1] - few[0] + 1))), np.zeros(4))
    weights, seen_w, seen_s, seen_b = np.zeros(SLOTS), np.full(SLOTS, 1e-8), np.full(3, 1e-8), 1e-8
    for _ in range(ROUNDS):
        now = context.broadcast(model)

        def gradient(slots: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by_feature, by_step, bias = _gradient(slots, labels(slots, size, toxic), size, now.value, stretch)
            return by_feature, np.r_[by_step, bias]

        grad, others = _summed(sample, gradient, places)
        now.destroy()
        grad = grad[0] - RIDGE * few[1] * weights
        seen_w += grad**2
        seen_s += others[:3] ** 2
        seen_b += others[3] ** 2
        weights += RATE * grad / np.sqrt(seen_w)
        steps = model.steps + RATE * others[:3] / np.sqrt(seen_s)
        model = Model(weights.astype(np.float32), steps, float(model.bias + RATE * others[3] / np.sqrt(seen_b)), model.document)
    marks.destroy()
    return model


def _fit_documents(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (y - p)) - 0.01 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), grad)
        w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model | None:
    """Fit on the rows of ``docs`` that ``labels`` marks 0 or 1; None without both classes.

    The sample is drawn on ids alone; only its texts are then taken from ``docs``.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    there = docs.select(F.col(id_col).alias("id"))
    marks = staged(marks.join(there, "id", "left_semi").distinct(), "marks")
    totals = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    # Bounded: the ids with the smallest hashes, MOST_TOXIC and MOST_CLEAN at most.
    bounds = ((0, MOST_CLEAN), (1, MOST_TOXIC))
    drawn = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in bounds]
    drawn = F.broadcast(staged(drawn[0].union(drawn[1]), "drawn"))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(drawn, "id")
    rows = rows.repartition(TASKS, "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, at in groups(b.column(1)):
                start, end, text = words(data, at)
                slots = features(data, start, end)
                n = np.bincount(text, minlength=hi - lo)
                blobs = [x.tobytes() for x in np.split(slots, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary())], ["y", "slots"])

    sample = staged(mapped(rows, extract, "y int, slots binary"), "sample")

    def frequencies(slots: np.ndarray, size: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, df = np.repeat(np.arange(len(size)), size), np.zeros((2, SLOTS))
        seen = np.unique((doc[:, None] * SLOTS + slots).ravel())
        for y in (0, 1):
            df[y] = np.bincount(seen[toxic[seen // SLOTS] == bool(y)] % SLOTS, minlength=SLOTS)
        return df, np.array([toxic.sum(), (~toxic).sum()])

    places: dict[int, np.ndarray] = {}
    df, number = _summed(sample, frequencies, places)
    if not len(number) or number.min() < 1 or len(df) < 2:
        return None
    model = _fit_field(sample, _marked(df[1], df[0], int(number[0]), int(number[1])), places)
    if model is None:
        return None
    fitted = sample.sparkSession.sparkContext.broadcast(model)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, blob in zip(b.column(0).to_pylist(), b.column(1)):
                slots = np.frombuffer(blob.as_buffer(), np.int32).reshape(-1, len(PREFIXES) + 1)
                first, size = np.zeros(1, int), np.array([len(slots)])
                some = size > 0
                unary = fitted.value.weights[slots].sum(1, dtype=np.float64) + fitted.value.bias
                x = summary(marginals(unary, first[some], size[some], fitted.value.steps)[0], first, size)[0]
                yield pa.RecordBatch.from_pylist([{"y": y, "x0": x[0], "x1": x[1], "x2": x[2]}], pa.schema([("y", pa.int32()), *[(f"x{k}", pa.float64()) for k in range(3)]]))

    # Bounded: four numbers for each document of the sample.
    known = mapped(sample, summaries, "y int, x0 double, x1 double, x2 double").toArrow()
    y, x = known.column(0).to_numpy() == 1, np.stack([known.column(k).to_numpy() for k in (1, 2, 3)], 1)
    share = np.where(y, totals[1] / number[0], totals[0] / number[1])
    document = _fit_documents(x, y.astype(float), share * len(y) / share.sum())
    return model._replace(document=document)


_VERDICT = "struct<score:double,spans:array<struct<start:bigint,end:bigint,p:double>>>"


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "verdict") -> DataFrame:
    """All columns of ``docs``, and a struct ``name`` of ``score`` and ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights, whatever the corpus
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            scores, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            for lo, hi, data, at in groups(texts) if model is not None else ():
                start, end, text = words(data, at)
                slots = features(data, start, end)
                size = np.bincount(text, minlength=hi - lo)
                first = np.cumsum(size) - size
                unary = model.weights[slots].sum(1, dtype=np.float64) + model.bias
                some = size > 0
                odds, _, _ = marginals(unary, first[some], size[some], model.steps)
                x = np.c_[np.ones(hi - lo), summary(odds, first, size)]
                scores[lo:hi] = _sigmoid(x @ model.document)
                hits = np.flatnonzero(odds >= 0)
                if len(hits):
                    inner = np.cumsum((data & 0xC0) == 0x80)  # bytes that do not start a code point
                    points = np.arange(len(data) + 1) - np.r_[0, inner]
                    for i, p in zip(hits, _sigmoid(odds[hits])):
                        base = points[at[text[i]]]
                        spans[lo + text[i]].append({"start": int(points[start[i]] - base), "end": int(points[end[i]] - base), "p": float(p)})
            verdict = pa.StructArray.from_arrays([pa.array(scores), pa.array(spans, pa.list_(span))], ["score", "spans"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], verdict], [*b.schema.names[:-1], name])

    return beside(docs, text_col, run, _VERDICT, name)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` and ``spans`` beside the id."""
    return scored(docs.select(id_col, text_col), model, text_col).select(id_col, "verdict.score", "verdict.spans")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of ids whose checksum is not 0 modulo 5."""
    return labels.where(crc_mod("doc_id", 5) != 0)


def op8_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = score(docs, model)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", predicted, "spans")
