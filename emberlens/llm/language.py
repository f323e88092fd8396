"""Language identification by mixture inference.

Each language has a model of letter trigrams within words, fitted on the texts and languages
of the training rows: trigrams are hashed to ``SLOTS`` counts per language, summed over all
training rows with a combine before the shuffle, so what reaches the driver is ``SLOTS``
numbers a language, whatever the size of the corpus.

A document is a mixture: each word comes from one language with the document's proportions.
Expectation-maximisation estimates the proportions from the words' likelihoods. The set of
languages is the one of best penalised likelihood (BIC, one parameter for each language but
the first), searched from the full set by dropping the least language first. Where the best
single language beats the full mixture less one parameter, no set can do better, and it is
taken at once. The answer is the selected language with the largest proportion, and the
score its proportion under the full mixture.

Beside the answer stands ``evidence``: the log-likelihood of the document's trigrams under its
full mixture over that under a background without language, in which letters follow each other
independently, by their shares over all training rows. Text of
some learned language has a few nats a letter; what is far below 0 is spelled by none of them.

Defined results: ``und`` with score and evidence 0 for a null text, one without letters, or if there are
no training rows; ties go to the language first in order; repeated rows are judged one by
one; rows with null language or id never train; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.common import beside, crc_mod, documents, mapped, text_or_empty
from emberlens.llm.textvec import FOLD, LETTER, groups, words

class Model(NamedTuple):
    #: In order.
    languages: list[str]
    #: Log-likelihood of each slot under each language.
    table: np.ndarray
    #: Log-likelihood of each byte under the background.
    background: np.ndarray


SLOTS = 1 << 16
SMOOTHING, ROUNDS, TOLERANCE = 0.5, 30, 1e-3
#: Share of the background that falls on all bytes alike.
UNSEEN = 0.02
_LETTER = regex.compile(r"\p{L}")


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram about each word byte and its slot; first byte of each word among them; text of each word."""
    start, end, text = words(data, at, LETTER)
    shown = np.where(LETTER[data], FOLD[data], 32).astype(np.uint32)
    size = end - start
    first = np.cumsum(size) - size
    here = np.arange(size.sum()) - np.repeat(first - start, size)
    edge = np.zeros(len(here), bool)
    edge[first] = True
    before = np.where(edge, 32, shown[here - 1])
    edge[:] = False
    edge[first + size - 1] = True
    after = np.where(edge, 32, shown[np.minimum(here + 1, len(shown) - 1)])
    key = (before << np.uint32(16)) | (shown[here] << np.uint32(8)) | after
    return key, (key * np.uint32(2654435761)) >> np.uint32(16), first, text


def _letters(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return key >> np.uint32(16), (key >> np.uint32(8)) & np.uint32(255), key & np.uint32(255)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            for lo, hi, data, at in groups(b.column(1)):
                key, slots, first, text = _trigrams(data, at)
                if not len(slots):
                    continue
                of = np.repeat(text, np.diff(np.r_[first, len(slots)]))
                for one in set(lang[lo:hi]):
                    mine = (lang[lo:hi] == one)[of]
                    byte = np.concatenate(_letters(key[mine]))
                    sums[one] = sums.get(one, 0) + np.r_[np.bincount(slots[mine], minlength=SLOTS), np.bincount(byte, minlength=256)]
        for one, n in sums.items():
            at = np.flatnonzero(n)
            cols = [pa.array([one] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "slot", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    found = mapped(rows, count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((SLOTS + 256, len(langs)))
    for i, one in enumerate(langs):
        mine = found[found["lang"] == one]
        table[mine["slot"], i] = mine["n"]
    table, byte = table[:SLOTS], table[SLOTS:].sum(1)
    table = (table + SMOOTHING) / (table.sum(0) + SMOOTHING * SLOTS)
    return Model(langs, np.log(table).astype(np.float32), np.log(UNSEEN / 256 + (1 - UNSEEN) * byte / max(1.0, byte.sum())))


def _em(like: np.ndarray, first: np.ndarray, doc: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Proportions per document, from likelihoods per word; languages at 0 stay out.

    Documents that have settled leave the iteration.
    """
    out, size = part.copy(), np.diff(np.r_[first, len(doc)])
    live = np.arange(len(part))
    for _ in range(ROUNDS):
        share = np.repeat(part, size, axis=0) * like
        share /= share.sum(1, keepdims=True)
        new = np.add.reduceat(share, first, axis=0) / size[:, None]
        moved = np.abs(new - part).max(1) > TOLERANCE
        out[live] = new
        if not moved.any():
            break
        if moved.mean() < 0.7:
            like, size, live, new = like[np.repeat(moved, size)], size[moved], live[moved], new[moved]
            first = np.cumsum(size) - size
        part = new
    return out


def mixture(words_ll: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents 0, 1, ... with at least a word each: full proportions, selected set, its proportions."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, len(doc)])
    n, k = len(first), words_ll.shape[1]
    top = words_ll.max(1)
    like = np.exp(np.maximum(words_ll - top[:, None], -60)).astype(np.float64)
    single = np.add.reduceat(words_ll, first, axis=0, dtype=np.float64)
    best = single.argmax(1)
    part = np.full((n, k), 1 / k)
    part = _em(like, first, doc, part)

    def loglik(p: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        each = np.log((np.repeat(p, sizes, axis=0) * rows).sum(1)) + at
        return np.add.reduceat(each, starts, dtype=np.float64)

    penalty = 0.5 * np.log(size)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    shares = chosen.astype(float)
    value = single[np.arange(n), best]
    full = loglik(part, like, first, size, top)
    open_ = np.flatnonzero(value < full - penalty)
    if len(open_) and k > 1:
        pick = np.repeat(np.isin(np.arange(n), open_), size)
        rows, at, sizes = like[pick], top[pick], size[open_]
        starts = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(open_)), sizes)
        p = part[open_]
        for used in range(k, 1, -1):
            score = loglik(p, rows, starts, sizes, at) - (used - 1) * penalty[open_]
            better = score > value[open_]
            value[open_[better]], shares[open_[better]], chosen[open_[better]] = score[better], p[better], p[better] > 0
            if used == 2:
                break
            p[np.arange(len(p)), np.where(p > 0, p, 2).argmin(1)] = 0
            p = _em(rows, starts, number, p / p.sum(1, keepdims=True))
    return part, chosen, shares


_ANSWER = "struct<lang_pred:string,score:double,evidence:double,languages:array<string>,proportions:array<double>>"


def answered(docs: DataFrame, model: Model, text_col: str = "text", name: str = "answer") -> DataFrame:
    """All columns of ``docs``, and a struct ``name`` of ``lang_pred, score, evidence, languages, proportions``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, background = shared.value
        wide = max(1, len(langs))
        for b in batches:
            texts = b.column(b.num_columns - 1)
            pred, score, evidence = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            sets: list[list[str]] = [[] for _ in range(len(texts))]
            parts: list[list[float]] = [[] for _ in range(len(texts))]
            for lo, hi, data, at in groups(texts, max(1 << 16, (4 << 20) // wide)) if langs else ():
                key, slots, first, text = _trigrams(data, at)
                if not len(slots):
                    continue
                ll = np.stack([np.add.reduceat(table[:, i][slots], first) for i in range(wide)], 1)
                full, chosen, shares = mixture(ll, text)
                top_ll, number = ll.max(1), np.unique(text, return_inverse=True)[1]
                mixed = top_ll + np.log((np.exp(np.maximum(ll - top_ll[:, None], -60)) * full[number]).sum(1))
                chance = np.add.reduceat(sum(background[x] for x in _letters(key)), first)
                gained = np.bincount(number, weights=mixed - chance)
                for j, t in enumerate(dict.fromkeys(text.tolist())):
                    if _LETTER.search(texts[lo + t].as_py()):
                        top = int(shares[j].argmax())
                        pred[lo + t], score[lo + t] = langs[top], min(1.0, float(full[j, top]))
                        evidence[lo + t] = gained[j]
                        order = sorted(np.flatnonzero(chosen[j]), key=lambda i: -shares[j, i])
                        sets[lo + t], parts[lo + t] = [langs[i] for i in order], [float(shares[j, i]) for i in order]
            made = [pa.array(pred, pa.string()), pa.array(score), pa.array(evidence), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
            answer = pa.StructArray.from_arrays(made, ["lang_pred", "score", "evidence", "languages", "proportions"])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], answer], [*b.schema.names[:-1], name])

    return beside(docs, text_col, run, _ANSWER, name)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``lang_pred, score, evidence, languages, proportions`` beside the id."""
    return answered(docs.select(id_col, text_col), model, text_col).select(id_col, "answer.*")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod("doc_id", 3) != 1)


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, train(training_rows(docs)))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages", "proportions")
