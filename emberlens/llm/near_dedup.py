"""Near-duplicate detection: BagMinHash signatures, bands, and verified multiset overlap.

A document is the multiset of its shingles of five words (letters, digits; A-Z folded). Two
documents are linked when the weighted Jaccard similarity of their multisets, the sum of
lesser counts over the sum of greater counts, is 0.8 or more; linked documents and what they
lead to form a class.

Signatures (Ertl, "BagMinHash", 2018, for weights discretised to integers): a shingle's
weight axis is cut into the dyadic blocks [0,1), [1,2), [2,4), ... Each block carries a
Poisson process of points (time, register, height) that depends on shingle and block alone,
with a rate that is the block's length for each register. Points above the document's weight
do not count; a register holds the point of least time, so two registers agree with
probability equal to the weighted Jaccard similarity. Points are drawn in order of time only
up to a limit at which all registers are filled with high probability; a document with an
empty register is drawn again with twice the limit.

Plan: one pass over the texts writes bands and a hash of the word sequence. Equal sequences
collapse to one node first (counted before the shuffle). ``graph.linked`` pairs the nodes of
each band bucket with its hub and has the pairs verified on whole texts, which move only for
nodes in some pair. What is still apart in a large bucket is searched by exact bounds
(``bounded``): no pair that they leave out can reach the threshold, so no link between
different texts that the bands propose is lost, and a group of thousands of near copies
costs pairs in proportion to its size unless its texts consist of the same common shingles.

Defined results: null text is empty; texts of fewer than five words are one shingle; texts
without words are classed by their exact text; ids that are null are smallest; repeated rows
share a class and one of them is kept; an empty table gives an empty result; other columns
are ignored. The kept row of a class is the one of least id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.llm.common import documents, mapped, quoted, staged, text_or_empty, without
from emberlens.llm.graph import SMALL, linked, main_parts
from emberlens.llm.textvec import GROUP_BYTES, flat, groups, hashes, mix, shingles, words

#: 64 bands, each of 9 out of 256 registers. See the README for how often pairs meet: what no
#: band proposes is lost, so pairs at the threshold itself have to meet all but surely.
REGISTERS, BANDS, ROWS = 256, 64, 9
#: Pairs verified against one text by one task; a text with more partners is replicated.
PARTNERS = 1024
THRESHOLD, WORDS = 0.8, 5
#: Texts that are signed together, at most. A text draws some 2,200 points however short it is
#: (50 KB while they are sorted out), so texts of few bytes are bounded by their number.
SIGNED = 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bags(sh: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts, by text."""
    order = np.lexsort((sh, text.astype(np.uint16) if len(text) and text[-1] < 1 << 16 else text))
    sh, text = sh[order], text[order]
    first = np.flatnonzero(np.r_[True, (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])]) if len(sh) else np.zeros(0, np.int64)
    return sh[first], text[first], np.diff(np.r_[first, len(sh)])


def signatures(sh: np.ndarray, text: np.ndarray, count: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of texts 0..n-1: the winning point of each register; 0 for texts without shingles."""
    out = np.zeros(n * registers, np.uint64)
    weight = np.bincount(text, weights=count, minlength=n)
    limit = (np.log(registers) + 3) / np.maximum(weight, 1)
    # Blocks: the element, the block's lower end and its length.
    parts, low, size, k = [np.arange(len(sh))], [np.zeros(len(sh), np.int64)], [np.ones(len(sh), np.int64)], 0
    more = np.flatnonzero(count > 1)
    while len(more):
        parts.append(more)
        low.append(np.full(len(more), 1 << k))
        size.append(np.full(len(more), 1 << k))
        k += 1
        more = more[count[more] > 1 << k]
    element, low, size = np.concatenate(parts), np.concatenate(low), np.concatenate(size)
    state = mix(sh[element] ^ mix(low.astype(np.uint64) + _GOLDEN))
    doc, rate = text[element], registers * size
    rows = np.arange(len(element))
    while len(rows):
        live, time, keys, times, points = rows, np.zeros(len(rows)), [], [], []
        step = 0
        while len(live):
            step += 1
            draw = mix(state[live] + np.uint64(step * int(_GOLDEN) % 2**64))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[live]
            on = time < limit[doc[live]]
            live, time, draw = live[on], time[on], draw[on]
            point = mix(draw ^ _GOLDEN)
            register = ((point >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            height = low[live] + ((point & np.uint64(0xFFFFFFFF)) * size[live].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            under = height < count[element[live]]
            keys.append(doc[live][under] * registers + register[under])
            times.append(time[under])
            points.append(point[under] | np.uint64(1))
        key, at, point = np.concatenate(keys), np.concatenate(times), np.concatenate(points)
        best = np.full(n * registers, np.inf)
        np.minimum.at(best, key, at)
        won = at == best[key]
        out[key[won]] = point[won]
        empty = (out.reshape(n, registers) == 0).any(1) & (weight > 0)
        limit *= 2
        rows = rows[empty[doc[rows]]]
    return out.reshape(n, registers)


def _chosen() -> np.ndarray:
    """The registers of each band: dealt from shuffled decks, so each serves about equally often."""
    rng = np.random.Generator(np.random.PCG64(12))
    each = REGISTERS // ROWS
    decks = [rng.permutation(REGISTERS)[: each * ROWS].reshape(each, ROWS) for _ in range(-(-BANDS // each))]
    return np.concatenate(decks)[:BANDS]


def _bands(sig: np.ndarray) -> np.ndarray:
    """One hash per band, different between bands."""
    chosen = _chosen()
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), np.uint64((b + 1) * int(_GOLDEN) % 2**64))
        for r in range(ROWS):
            h = mix(h + sig[:, chosen[b, r]])
        out[:, b] = h
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        exact = np.asarray(b.column(2)).view(np.uint64)
        for lo, hi, data, at in groups(b.column(3), rows=SIGNED):
            n = hi - lo
            start, end, text = words(data, at)
            word, _ = hashes(data, start, end)
            size = np.bincount(text, minlength=n)
            place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            one, two = mix(exact[lo:hi] + np.uint64(1)), mix(exact[lo:hi] + np.uint64(2))
            some = np.flatnonzero(size)
            if len(some):
                first = (np.cumsum(size) - size)[some]
                for digest, salt in ((one, np.uint64(3)), (two, np.uint64(5))):
                    digest[some] = np.add.reduceat(mix(word + mix(place.astype(np.uint64) * _GOLDEN + salt)), first)
            sig = signatures(*bags(*shingles(word, text, WORDS)), n)
            bands = pa.array(_bands(sig).ravel(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(size > 0, BANDS, 0))], pa.int32()), bands.filter(pa.array(np.repeat(size > 0, BANDS))))
            cols = [*(c.slice(lo, n) for c in b.columns[:3]), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "id", "exact", "d1", "d2", "bands"])


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of ``a[i]`` and ``b[i]``."""
    sides = []
    for column in (a, b):
        data, at = flat(column)
        start, end, text = words(data, at)
        sides.append(shingles(hashes(data, start, end)[0], text, WORDS))
    sh, pair = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
    left = np.r_[np.ones(len(sides[0][0]), bool), np.zeros(len(sides[1][0]), bool)]
    order = np.lexsort((sh, pair))
    sh, pair, left = sh[order], pair[order], left[order]
    new = np.r_[True, (sh[1:] != sh[:-1]) | (pair[1:] != pair[:-1])] if len(sh) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    x, y = (np.bincount(group[s], minlength=int(new.sum())) for s in (left, ~left))
    of = pair[new]
    both, either = (np.bincount(of, weights=f(x, y), minlength=len(a)) for f in (np.minimum, np.maximum))
    return both / np.maximum(either, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        size = np.diff(flat(a)[1]) + np.diff(flat(b)[1])
        at = np.r_[0, np.cumsum(size)]
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 2 * GROUP_BYTES, side="right")) - 1)
            part = batch.slice(lo, hi - lo)
            sim = similarity(part.column(2), part.column(3))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], ["a", "b", "sim"])
            lo = hi


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("exact"), text.alias("text"))


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in groups(b.column(1)):
            start, end, text = words(data, at)
            sh, of, n = bags(*shingles(hashes(data, start, end)[0], text, WORDS))
            size = np.bincount(of, weights=n, minlength=hi - lo).astype(np.int64)
            cols = [b.column(0).slice(lo, hi - lo).take(pa.array(of)), *(pa.array(x.view(np.int64)) for x in (sh, n, size[of]))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "shingle", "n", "size"])


def own_texts(nodes: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """``rid, text`` of these nodes, one row each.

    The texts move once, by a shuffle at every size of the input: whether few or many nodes
    are needed depends on the copies in the data, not on the plan.
    """
    need = signed.select("rid", "id", "exact").join(nodes.withColumnRenamed("node", "rid"), "rid", "left_semi").hint("merge")
    same = (texts["exact"] == need["exact"]) & texts["id"].eqNullSafe(need["id"])
    own = staged(texts.join(need, same).select("rid", "text"), "texts")
    # Repeated rows (equal id and text) gave as many copies of their node's text.
    if own.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return own
    return staged(own.groupBy("rid").agg(F.first("text").alias("text")), "texts")


def verifier(own: DataFrame, threshold: float) -> Callable[[DataFrame], DataFrame]:
    """A function from pairs to those that are similar, on their whole texts.

    A text with more than ``PARTNERS`` pairs is replicated, so its pairs spread over tasks.
    """

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rid"))
        parts = ends.groupBy("rid").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")).where("parts > 1")
        p = pairs
        for end in ("a", "b"):
            p = p.join(parts.select(F.col("rid").alias(end), F.col("parts").alias(f"parts_{end}")), end, "left")
        x, y = (F.coalesce(f"parts_{end}", F.lit(1)) for end in ("a", "b"))
        # ``a`` becomes the text with more partners.
        p = p.select(F.when(x < y, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(x < y, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest(x, y).alias("parts"))
        p = p.select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
        p = p.join(own.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
        hubs = own.join(parts, "rid", "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        hubs = hubs.select(F.col("rid").alias("a"), copies, F.col("text").alias("text_a"))
        p = p.join(hubs, ["a", "part"]).select("a", "b", "text_a", "text_b")
        return mapped(p, _verify, "a bigint, b bigint, sim double").where(F.col("sim") >= threshold).select("a", "b")

    return verify


#: Sizes of one bin differ by less than this; a node's possible partners lie in some 45 bins.
BIN = math.log(1.01)
#: Of the pairs that share common shingles only, this part first, all others afterwards: what
#: is in the main component by then needs no others.
FIRST = 32
_SLACK = 1e-6


def bounded(own: DataFrame, threshold: float) -> Callable[[DataFrame], list[Callable[[DataFrame], DataFrame]]]:
    """All pairs of a group that may reach the threshold t, by bounds that lose none.

    Shingles are ordered by the number of nodes that have them, rarest first. Texts of sizes p
    and q (sums of counts) of similarity t or more overlap in t/(1+t) (p+q) at least. Of the
    shingles before their first common one none is common, so what is left from there on must
    suffice for that in both texts; it lies within the first 1-t of either.

    * If the first common shingle is in at most ``SMALL`` nodes, a join on these shingles
      finds the pair; each has so few partners.
    * Else the pair has only common shingles (of more nodes) in common, and their sum must
      suffice in both texts. Texts with many shingles of their own drop out by themselves;
      others seek, within their group, sizes that still can suffice, bin by bin.
    """
    rise = (1 + threshold) / threshold

    def within(groups: DataFrame) -> list[Callable[[DataFrame], DataFrame]]:
        texts = own.join(groups.select(F.col("node").alias("rid")).distinct(), "rid").select("rid", "text")
        bagged = staged(mapped(texts, _bag_rows, "node bigint, shingle bigint, n bigint, size bigint"), "bags")
        # Shingles of one node need no join, and those of many nodes are only summed.
        spread = bagged.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("node", "n")).alias("one"))
        spread = staged(spread.where(F.col("df") <= SMALL), "spread")
        alone = spread.where("df = 1").groupBy(F.col("one.node").alias("node")).agg(F.sum("one.n").alias("alone"))
        rare = staged(bagged.join(spread.where("df > 1").select("shingle", "df"), "shingle"), "rare")
        few = rare.groupBy("node").agg(F.sum("n").alias("few"))
        nodes = bagged.select("node", "size").distinct().join(alone, "node", "left").join(few, "node", "left")
        shared = (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared")
        nodes = staged(nodes.select("node", "size", shared, F.coalesce("few", F.lit(0)).alias("few")), "weights")
        enough = F.col("left") >= threshold * F.col("size") - _SLACK
        earlier = Window.partitionBy("node").orderBy("df", "shingle").rowsBetween(Window.unboundedPreceding, -1)
        rare = rare.select("shingle", "node", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier")).join(nodes, "node")
        rare = staged(rare.select("shingle", "node", "size", (F.col("shared") - F.col("earlier")).alias("left")).where(enough), "rare")
        common = nodes.select("node", "size", (F.col("shared") - F.col("few")).alias("left")).where(enough)

        def suffices() -> Column:
            return F.least("left", "left2") * rise >= F.col("size") + F.col("size2") - _SLACK

        def other(df: DataFrame) -> DataFrame:
            return df.toDF(*[f"{c}2" for c in df.columns])

        def by_rare(placed: DataFrame) -> DataFrame:
            mine = rare.join(placed.select("node", "comp").distinct(), "node")
            meet = (F.col("shingle") == F.col("shingle2")) & (F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2"))
            return mine.join(other(mine), meet & suffices()).select(F.col("node").alias("a"), F.col("node2").alias("b"))

        def by_common(placed: DataFrame, every: int) -> DataFrame:
            mine = placed.join(common, "node")
            low = F.floor(F.log(F.col("size") * threshold - _SLACK) / BIN)
            high = F.floor(F.log(F.least(F.col("size") / threshold, F.col("left") * rise - F.col("size")) + _SLACK) / BIN)
            seek = mine.join(main_parts(placed, "hub"), "hub").where("comp != main")
            seek = seek.select("hub", "node", "comp", "size", "left", F.explode(F.sequence(low, F.greatest(low, high))).alias("bin"))
            there = other(mine.withColumn("bin", F.floor(F.log("size") / BIN)))
            meet = (F.col("hub") == F.col("hub2")) & (F.col("bin") == F.col("bin2")) & (F.col("comp") != F.col("comp2")) & suffices()
            if every > 1:
                meet &= F.pmod(F.xxhash64(F.least("node", "node2"), F.greatest("node", "node2")), F.lit(every)) == 0
            return seek.join(there, meet).select(F.col("node").alias("a"), F.col("node2").alias("b"))

        return [by_rare, lambda placed: by_common(placed, FIRST), lambda placed: by_common(placed, 1)]

    return within


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id, exact, class_id, class_size, kept``."""
    texts = _texts(docs, id_col, text_col)
    rows = texts.select(F.monotonically_increasing_id().alias("rid"), "id", "exact", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    signed = staged(mapped(rows, _sign, f"rid bigint, id {kind}, exact bigint, d1 bigint, d2 bigint, bands array<bigint>"), "signed")

    # Equal word sequences become one node, the least row number.
    same = signed.groupBy("d1", "d2").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = signed.select("rid", "d1", "d2").join(same, ["d1", "d2"]).where("rid != node").select("rid", "node")
    copies = staged(copies, "copies", packed=True)

    nodes = signed.select("rid", "bands").join(copies.select("rid"), "rid", "left_anti")
    banded = nodes.select(F.col("rid").alias("node"), F.explode("bands").alias("bucket"))
    own: list[DataFrame] = []

    def prepare(met: DataFrame) -> Callable[[DataFrame], DataFrame]:
        own.append(own_texts(met, signed, texts))
        return verifier(own[0], threshold)

    found = linked(banded, prepare, lambda groups: bounded(own[0], threshold)(groups))

    every = signed.select("rid", "id", "exact").join(copies, "rid", "left").withColumn("node", F.coalesce("node", "rid"))
    every = staged(every.join(found, "node", "left").select("rid", "id", "exact", F.coalesce("comp", "node").alias("comp")), "placed")
    best = every.groupBy("comp").agg(F.min(F.struct("id", "rid")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return every.join(best, "comp").select(
        "id", "exact", F.col("best.id").alias("class_id"), "class_size", (F.col("rid") == F.col("best.rid")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns."""
    placed = near_classes(docs, id_col, text_col, threshold).where("class_size > 1")
    pairs = placed.groupBy("id", F.col("exact").alias("key")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = staged(pairs, "pairs")
    gone, repeated = (pairs.where(which).select("id", "key") for which in ("not kept", "kept and n > 1"))
    return without(docs, gone, repeated, id_col, F.xxhash64(text_or_empty(quoted(text_col))))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
