"""N-gram Jaccard join by signature trees.

A document is the set of its shingles of four words (runs without ASCII white space, A-Z
folded). Two documents link when 100 x intersection >= 85 x union; the result is the
components of these links, exactly: every bound below leaves out only pairs that cannot link.

A signature tree has documents as leaves, alike ones side by side. A node holds the OR of its
documents' token bitmaps, the range of their set sizes, and the most tokens that any of them
lost to a bit already set. Two documents of two nodes have at most (common bits + that number)
tokens in common. The dual traversal starts with the root against itself and goes down to the
children of those pairs of nodes whose sizes and maximum overlap still allow a link; what is
left are pairs of documents, compared as whole sets. Pairs of nodes in one and the same
component are left out too, so a thousand near copies cost few comparisons.

One tree over a whole corpus would be traversed in time quadratic in its size, so the corpus is
first cut into clusters that no link leaves:

1. One pass over the texts writes each set's size, a digest and its prefix: the quarter of its
   shingles with the least hashes. Equal sets are one node from there on.
2. If two sets link, their prefixes have at least ``fewest(size)`` shingles in common (either
   size). So a node with fewer shared shingles in its prefix has no link and goes; of the
   others the rarest shingles, all but ``fewest - 1`` of the shared ones, must contain one that
   the partner has there as well. Clusters are the components of nodes that share such a one.
3. Small clusters of like sizes are packed into blocks of about ``TOKENS`` shingles, each one
   tree in one task. A larger cluster is cut into parts by a hash: first each part is a tree,
   then the first part meets every other, then all pairs of parts meet, with only those rows
   that can still add something (what is outside the cluster's main component against all).

Defined results: null and empty texts and texts without words have size 0 and their own id as
component; texts of fewer than four words are one shingle of all; repeated rows and equal
texts are in one component; null ids are ignored in the least id of a component, and a
component of null ids alone has null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.common import documents, looked_up, mapped, staged, text_or_empty
from emberlens.llm.graph import components, merged
from emberlens.llm.near_dedup import bags, own_texts
from emberlens.llm.textvec import groups, hashes, mix, shingles, words

#: A pair links from OF hundredths on. Sets of fewer than LEAST shingles link with equal sets only.
OF, WORDS, LEAST = 85, 4, 6
#: Shingles of a block; a document counts as LIGHT at least, so a block has TOKENS / LIGHT of them at most.
TOKENS, LIGHT = 1 << 20, 256
#: Children of a node; bitmaps' width in bits, from and to; numbers of 8 bytes worked on at a time.
FAN, NARROW, WIDE, AT_ONCE = 8, 512, 1 << 15, 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def prefix_length(size):  # noqa: ANN001, ANN201 - int or array
    return np.minimum(size, size // 4 + 2)


def overlap(a, b):  # noqa: ANN001, ANN201
    """Least intersection of linked sets of these sizes."""
    return -(-OF * (a + b) // (100 + OF))


def fewest(size):  # noqa: ANN001, ANN201
    """Shingles that the prefixes of a set of this size and of any partner share at least.

    Of the set whose prefix ends first at most ``size - overlap`` shingles are not in the other,
    and those that are lie within the other's prefix. The least of this over all partners: for
    this set's prefix with the smallest partner, for the partner's with the largest (two less,
    since the rounding of the terms may differ by that much between neighbouring sizes).
    """
    small, large = -(-OF * size // 100), 100 * size // OF
    mine = prefix_length(size) - size + overlap(size, small)
    theirs = prefix_length(large) - large + overlap(size, large) - 2
    return np.maximum(1, np.minimum(mine, theirs))


def sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and in the order of their hashes, and each text's number of them."""
    start, end, text = words(data, at, ~SPACE)
    found, of, _ = bags(*shingles(hashes(data, start, end)[0], text, WORDS))
    return found, np.bincount(of, minlength=len(at) - 1).astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, at in groups(b.column(3)):
            sh, size = sets(data, at)
            first, some = np.cumsum(size) - size, np.flatnonzero(size)
            digests = np.zeros((2, hi - lo), np.uint64)
            for d, salt in zip(digests, (3, 5)):
                if len(some):
                    d[some] = np.add.reduceat(mix(sh + np.uint64(salt)), first[some])
            length = np.where(size >= LEAST, prefix_length(size), 0)
            taken = np.repeat(first, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(sh[taken].view(np.int64)))
            few = np.where(size >= LEAST, fewest(size), 0)
            cols = [*(c.slice(lo, hi - lo) for c in b.columns[:3]), *(pa.array(x) for x in (size, digests[0].view(np.int64), digests[1].view(np.int64), few)), prefix]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "id", "exact", "size", "d1", "d2", "few", "prefix"])


class Tree:
    """The documents of a block in order, and the levels of nodes above them, all as arrays."""

    def __init__(self, sh: np.ndarray, size: np.ndarray, cluster: np.ndarray, label: np.ndarray, side: np.ndarray) -> None:
        first = np.cumsum(size) - size
        # Alike documents side by side: of one cluster, with the same least hash, of like sizes.
        self.order = np.lexsort((size, sh[first], cluster))
        at = np.repeat(first[self.order], size[self.order])
        self.size = size[self.order]
        self.first = np.cumsum(self.size) - self.size
        sh = sh[at + np.arange(len(at)) - np.repeat(self.first, self.size)]
        self.token = np.unique(sh, return_inverse=True)[1]
        self.mark = np.zeros(int(self.token.max()) + 1, bool)
        self.label = np.unique(label[self.order], return_inverse=True)[1]
        number = np.unique(cluster[self.order], return_inverse=True)[1]

        width = int(min(WIDE, max(NARROW, 1 << int(2 * self.size.max() - 1).bit_length())))
        bits = np.zeros((len(size), width // 64), np.uint64)
        low, doc = sh & np.uint64(width - 1), np.repeat(np.arange(len(size)), self.size)
        np.bitwise_or.at(bits, (doc, (low >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (low & np.uint64(63)))
        lost = self.size - np.bitwise_count(bits).sum(1)
        sides = np.where(side[self.order] == 0, 1, 2)
        #: Of each level: bitmaps, least and greatest size, most lost, first and last cluster, sides.
        self.levels = [(bits, self.size, self.size, lost, number, number, sides)]
        while len(self.levels[-1][0]) > 1:
            below, cuts = self.levels[-1], np.arange(0, len(self.levels[-1][0]), FAN)
            how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum, np.bitwise_or)
            self.levels.append(tuple(f.reduceat(x, cuts, axis=0) for f, x in zip(how, below)))

    def _labels(self, height: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest component of each node of a level."""
        cuts = np.arange(0, len(self.label), FAN**height)
        return np.minimum.reduceat(self.label, cuts), np.maximum.reduceat(self.label, cuts)

    def _possible(self, height: int, x: np.ndarray, y: np.ndarray, cross: bool) -> np.ndarray:
        """Which pairs of nodes (``x <= y``) may hold a link between two components."""
        bits, least, most, lost, begin, end, sides = self.levels[height]
        low, high = self._labels(height)
        on = (begin[y] <= end[x]) & (100 * most[x] >= OF * least[y]) & (100 * most[y] >= OF * least[x])
        on &= (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
        if cross:
            on &= (sides[x] | sides[y]) == 3
        at = np.flatnonzero(on)
        step = max(1, AT_ONCE // bits.shape[1])
        for k in range(0, len(at), step):
            i, j = x[at[k : k + step]], y[at[k : k + step]]
            common = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(lost[i], lost[j])
            on[at[k : k + step]] = common >= overlap(least[i], least[j])
        return on

    def _verify(self, x: int, partners: np.ndarray) -> np.ndarray:
        """Those of ``partners`` that link with document ``x``, on whole sets."""
        mine = self.token[self.first[x] : self.first[x] + self.size[x]]
        self.mark[mine] = True
        found = []
        cut = np.searchsorted(np.cumsum(self.size[partners]), np.arange(AT_ONCE, self.size[partners].sum(), AT_ONCE))
        for y in np.split(partners, np.unique(cut)):
            if len(y):
                size = self.size[y]
                starts = np.cumsum(size) - size
                at = np.repeat(self.first[y] - starts, size) + np.arange(size.sum())
                both = np.add.reduceat(self.mark[self.token[at]].astype(np.int64), starts)
                found.append(y[100 * both >= OF * (size + self.size[x] - both)])
        self.mark[mine] = False
        return np.concatenate(found) if found else partners[:0]

    def _compare(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links that join two components, of these pairs of documents."""
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        for partners, one in zip(np.split(y, np.flatnonzero(np.diff(x)) + 1), x[np.r_[True, x[1:] != x[:-1]]] if len(x) else ()):
            # One of each component first: most of the others are in the same component then.
            firsts = partners[np.unique(self.label[partners], return_index=True)[1]]
            for some in (firsts, partners):
                some = some[self.label[some] != self.label[one]]
                for other in self._verify(one, some) if len(some) else ():
                    if self.label[other] != self.label[one]:
                        self.label[self.label == self.label[other]] = self.label[one]
                        yield int(self.order[one]), int(self.order[other])

    def links(self, cross: bool = False) -> Iterator[tuple[int, int]]:
        """Links (as places in the input) that join all that the block's links join; ``cross``: between sides only."""
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        child = np.arange(FAN)
        while stack:
            height, x, y = stack.pop()
            # Components have grown meanwhile.
            low, high = self._labels(height)
            on = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
            x, y = x[on], y[on]
            if height == 0:
                yield from self._compare(x, y)
                continue
            step = max(1, AT_ONCE // (FAN * FAN * 8))
            if len(x) > step:
                stack += [(height, x[k : k + step], y[k : k + step]) for k in range(0, len(x), step)][::-1]
                continue
            n = len(self.levels[height - 1][0])
            a = np.repeat(x[:, None] * FAN + child, FAN, 1).ravel()
            b = np.tile(y[:, None] * FAN + child, FAN).ravel()
            on = (a < n) & (b < n) & ((a <= b) if height > 1 else (a < b))
            a, b = a[on], b[on]
            on = self._possible(height - 1, a, b, cross)
            a, b = a[on], b[on]
            # A node against itself comes first: it joins near copies, which spares pairs of nodes.
            stack += [(height - 1, a[which], b[which]) for which in (a != b, a == b) if which.any()]


def _joined(table: pa.Table) -> pa.Table:
    """Links of a block's rows ``node, cluster, label, side, text``."""
    node, cluster, label, side = (table.column(c).to_numpy() for c in ("node", "cluster", "label", "side"))
    text = table.column("text").combine_chunks()
    parts = [sets(data, at) for chunk in (text.chunks if isinstance(text, pa.ChunkedArray) else [text]) for _, _, data, at in groups(chunk)]
    found = []
    if len(node) > 1:
        tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), cluster, label, side)
        found = [(node[i], node[j]) for i, j in tree.links(bool(side.any()))]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.min(1, initial=1 << 62) if len(pairs) else pairs[:, 0], "b": pairs.max(1, initial=-1) if len(pairs) else pairs[:, 0]})


def clusters(nodes: DataFrame) -> DataFrame:
    """``node, cluster``: every link between two of ``nodes`` (``node, size, few, prefix``) is within a cluster."""
    each = nodes.select("node", "few", F.explode("prefix").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(shared, "token").groupBy("node", "few").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    ranked = ranked.where(F.size("tokens") >= F.col("few"))
    rare = F.explode(F.slice("tokens", F.lit(1), (F.size("tokens") - F.col("few") + 1).cast("int")))
    rare = staged(ranked.select("node", rare.alias("t")).select("node", "t.token"), "rare")
    met = rare.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", "hub")
    edges = rare.join(met, "token").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    return components(edges).select("node", F.col("comp").alias("cluster"))


def blocks(members: DataFrame) -> DataFrame:
    """``members`` (``node, cluster, size``) with ``parts`` of the cluster, and the row's ``block`` and ``part``."""
    weight = F.greatest("size", F.lit(LIGHT))
    stats = members.groupBy("cluster").agg(F.sum(weight).alias("weight"), F.max("size").alias("most"))
    # Clusters of like sizes together, so that one width of bitmaps suits a block; a row for each power of two.
    stats = staged(stats.select("cluster", "weight", F.length(F.bin("most")).alias("like")), "clusters")
    alike = stats.groupBy("like").agg(F.ceil(F.sum(F.when(F.col("weight") <= TOKENS, F.col("weight")).otherwise(0)) / TOKENS).alias("blocks"))
    stats = stats.join(F.broadcast(alike), "like").select(
        "cluster",
        F.ceil(F.col("weight") / TOKENS).cast("int").alias("parts"),
        F.concat_ws(" ", "like", F.pmod(F.xxhash64("cluster"), F.greatest("blocks", F.lit(1)))).alias("packed"),
    )
    placed = looked_up(members, stats, "cluster", "node")
    large = F.col("parts") > 1
    return placed.select(
        "node", "cluster", "size", "parts",
        F.when(large, F.concat(F.lit("cluster "), F.col("cluster").cast("string"))).otherwise(F.col("packed")).alias("block"),
        F.when(large, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0).alias("part"),
    )


def traversed(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Links of ``rows`` (``block, i, j, side, node, cluster, label``): one tree for each block and pair of parts."""
    full = rows.join(own.select(F.col("rid").alias("node"), "text"), "node")
    found = full.groupBy("block", "i", "j").applyInArrow(_joined, "a bigint, b bigint")
    return staged(found, "links")


def _labelled(placed: DataFrame, found: DataFrame) -> DataFrame:
    return placed.join(found, "node", "left").withColumn("label", F.coalesce("comp", "node")).drop("comp")


def linked_sets(nodes: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, comp`` of the nodes that link with another; ``comp`` is a node of the component."""
    member = clusters(nodes).join(nodes.select("node", "size"), "node")
    placed = staged(blocks(staged(member, "members")), "placed")
    own = own_texts(placed.select("node"), signed, texts)

    def rows(df: DataFrame, i: Column, j: Column, side: Column) -> DataFrame:
        return df.select("block", i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"), "node", "cluster", "label")

    part, last = F.col("part"), F.col("parts") - 1
    found = components(traversed(rows(placed.withColumn("label", F.col("node")), part, part, F.lit(0)), own))
    large = placed.where("parts > 1")
    if large.isEmpty():
        return found
    # The first part against each other one.
    now = _labelled(large, found)
    first = now.where("part = 0").withColumn("other", F.explode(F.sequence(F.lit(1), last)))
    star = rows(first, F.lit(0), F.col("other"), F.lit(0)).unionAll(rows(now.where("part > 0"), F.lit(0), part, F.lit(1)))
    found = merged(found, traversed(star, own))
    # All pairs of other parts: what is outside the main component against all, and all against it.
    now = staged(_labelled(large.where("part > 0"), found), "now")
    counts = now.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("m")).select("cluster", F.col("m.label").alias("main"))
    now = staged(looked_up(now, main, "cluster", "node"), "now")
    open_parts = now.where("label != main").groupBy("cluster").agg(F.collect_set("part").alias("open"))
    now = looked_up(now, open_parts, "cluster", "node")
    other = F.when(F.col("label") != F.col("main"), F.sequence(F.lit(1), last)).otherwise(F.col("open"))
    now = now.withColumn("other", F.explode(other)).where("other != part")
    pairs = rows(now, F.least("part", "other"), F.greatest("part", "other"), F.when(F.col("part") < F.col("other"), 0).otherwise(1))
    return merged(found, traversed(pairs, own))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``."""
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("exact"), text.alias("text"))
    numbered = texts.select(F.monotonically_increasing_id().alias("rid"), "id", "exact", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"rid bigint, id {kind}, exact bigint, size bigint, d1 bigint, d2 bigint, few bigint, prefix array<bigint>"
    signed = staged(mapped(numbered, _signed, schema), "signed")

    # Equal sets become one node, the least row number.
    own = signed.where("size > 0").groupBy("d1", "d2").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = staged(signed.select("rid", "d1", "d2").where("size > 0").join(own, ["d1", "d2"]).where("rid != node").select("rid", "node"), "copies")
    nodes = signed.where(F.col("size") >= LEAST).join(copies.select("rid"), "rid", "left_anti").select(F.col("rid").alias("node"), "size", "few", "prefix")
    found = linked_sets(nodes, signed, texts)

    every = signed.select("rid", "id", "size").join(copies, "rid", "left").withColumn("node", F.coalesce("node", "rid"))
    every = staged(every.join(found, "node", "left").select("rid", "id", "size", F.coalesce("comp", "node").alias("comp")), "every")
    least = every.groupBy("comp").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return looked_up(every, least, "comp", "rid", "left").select(
        "id", F.col("size").alias("n_shingles"), F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def op11_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: Brute force over shared shingles, and components by the least id that is reachable.
OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.seen = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.component_id
FROM (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
"""
