"""SimHash fingerprints and their search within a Hamming radius (DataFrame functions only).

A text's terms are its shingles of five words (parts between white space, in lower case; a
shorter text is one shingle), weighted by how often they occur. Each term's 128-bit hash
votes with its weight for or against every bit; the fingerprint has the bits with more votes
for than against. Votes are counted two bits to a number (32 bits each), so one aggregation
row of 64 numbers holds a text's 128 counts and is combined before the shuffle.

Search: fingerprints within ``radius`` bits agree exactly on at least two of ``radius + 2``
blocks, so one table for each pair of blocks, keyed by those two, finds them all. Equal
fingerprints are one node; buckets are linked as in ``graph.linked``, by the number of
differing bits.

A document's successor is found without a global sort: ids are cut at approximate quantiles
into ranges, the first rows of each range visit the one before it as guests, and texts move
once, by range.

Defined results: null text is empty; a text without words has the fingerprint 0; null ids
come first, and rows of one id are ordered by text; the only row is its own successor; an
empty table gives an empty result; ids must be numbers; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.llm.common import documents, staged, text_or_empty
from emberlens.llm.graph import linked

BITS, WORDS, RADIUS = 128, 5, 3
#: Ranges of ids for each shuffle partition.
RANGES = 4

_PAIR = (1 << 32) | 1


def _word_hashes(text: Column) -> Column:
    """Hashes of the words; no word: an empty array."""
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def votes(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """``key, hi, lo`` for each row of ``texts`` that has a word."""
    words = texts.select(key, _word_hashes(F.col(text)).alias("w"))
    each = words.select(key, "w", F.posexplode("w").alias("at", "word"))
    each = each.where((F.col("at") == 0) | (F.col("at") + WORDS <= F.size("w")))
    term = F.xxhash64(F.col("word"), *[F.get("w", F.col("at") + k) for k in range(1, WORDS)])
    each = each.select(key, term.alias("t0")).select(key, "t0", F.xxhash64("t0", F.lit(1)).alias("t1"))
    counts = [
        F.sum(F.shiftright(f"t{half}", k).bitwiseAND(F.lit(_PAIR))).alias(f"s{half}_{k}") for half in (0, 1) for k in range(32)
    ]
    sums = each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *counts)

    def half(number: int) -> Column:
        bits = []
        for k in range(32):
            s = F.col(f"s{number}_{k}")
            for count, place in ((s.bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(s, 32), k + 32)):
                bits.append(F.when(count * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return sums.select(key, half(0).alias("hi"), half(1).alias("lo"))


def likeness(a: str, b: str) -> Column:
    """1 less the share of differing bits, of two struct columns ``hi, lo``."""
    differ = F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))
    return 1 - differ / BITS


def shown(f: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{f}.hi"), 16, "0"), F.lpad(F.hex(f"{f}.lo"), 16, "0")))


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id, text, next_rid, next_text`` for every row; ids ascending, the first after the last."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    # Two steps of a square root's comparisons each find an id's range.
    wide = max(1, isqrt(len(cuts)))
    fine = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    kind = docs.schema[id_col].dataType

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda x: x < F.col("id")))

    if cuts:
        heads = F.array(*[F.lit(x[0]).cast(kind) for x in fine])
        table = F.array(*[F.array(*[F.lit(v).cast(kind) for v in x]) for x in fine])
        block = F.greatest(below(heads) - 1, F.lit(0))
        at = F.when(F.col("id").isNull(), 0).otherwise(block * wide + below(F.get(table, block)))
    else:
        at = F.lit(0)
    rows = rows.withColumn("range", at.cast("int"))
    # One row a range, and their number is fixed beforehand.
    firsts = rows.groupBy("range").agg(F.min(F.struct("id")).alias("first"))
    order = Window.orderBy("range")
    firsts = firsts.select("range", "first", F.lag("range").over(order).alias("before"), F.max("range").over(Window.partitionBy()).alias("last"))
    firsts = firsts.select(F.col("range").alias("r"), "first.id", F.coalesce("before", "last").alias("host")).withColumnRenamed("id", "first_id")
    marked = rows.join(F.broadcast(firsts), rows["range"] == F.col("r"))
    guest = F.col("id").eqNullSafe(F.col("first_id"))
    stays = F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")))
    visits = F.array(F.struct(F.col("host").alias("at"), F.lit(True).alias("guest")))
    dealt = marked.select("rid", "id", "text", F.explode(F.when(guest, F.concat(stays, visits)).otherwise(stays)).alias("p"))
    after = Window.partitionBy("p.at").orderBy("p.guest", "id", F.xxhash64("text"), "text", "rid")
    out = dealt.select("rid", "id", "text", "p", F.lead("rid").over(after).alias("next_rid"), F.lead("text").over(after).alias("next_text"))
    return out.where(~F.col("p.guest")).drop("p")


def edited_text(text: str = "text", successor: str = "next_text") -> Column:
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(successor, F.lit(1), half))


def within_radius(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rid, comp`` of rows (``rid, f``) whose fingerprint has another within ``radius`` bits.

    ``comp`` is the least row number of the class. Rows of equal fingerprints are one node.
    """
    nodes = staged(prints.groupBy("f").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def block(i: int) -> Column:
        """Bits from edges[i] on, of hi followed by lo."""
        parts = []
        for word, base in (("hi", 0), ("lo", 64)):
            lo, hi = max(edges[i], base), min(edges[i + 1], base + 64)
            if lo < hi:
                mask = (1 << (hi - lo)) - 1
                parts.append(F.shiftrightunsigned(F.col(f"f.{word}"), base + 64 - hi).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)))
        return parts[0] if len(parts) == 1 else F.xxhash64(*parts)

    tables = [F.xxhash64(F.lit(i * blocks + j), block(i), block(j)) for i, j in combinations(range(blocks), 2)]
    banded = nodes.select("node", F.explode(F.array(*tables)).alias("bucket"))
    bits = nodes.select("node", "f")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = bits.select(F.col("node").alias("a"), F.col("f").alias("fa")), bits.select(F.col("node").alias("b"), F.col("f").alias("fb"))
        return pairs.join(a, "a").join(b, "b").where(BITS * (1 - likeness("fa", "fb")) < radius + 0.5).select("a", "b")

    comps = linked(banded, lambda _: verify)
    whole = nodes.join(comps, "node", "left").where("n > 1 or comp is not null")
    return prints.join(whole.select("f", F.coalesce("comp", "node").alias("comp")), "f").select("rid", "comp")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, and near classes.

    ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    class_id``: the least id among the documents linked by fingerprints within ``radius``.
    """
    rows = with_successor(docs, id_col, text_col).withColumn("edited", edited_text())
    meta = rows.select(
        "rid", "id", "next_rid", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    )
    both = rows.select(F.explode(F.array(F.struct((F.col("rid") * 2).alias("key"), "text"), F.struct((F.col("rid") * 2 + 1).alias("key"), F.col("edited").alias("text")))).alias("v"))
    voted = votes(both.select("v.key", "v.text"))
    zero = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    even = F.col("key").bitwiseAND(F.lit(1).cast("bigint")) == 0
    sides = [F.max(F.when(even if name == "f" else ~even, F.struct("hi", "lo"))).alias(name) for name in ("f", "e")]
    voted = voted.groupBy(F.shiftright("key", 1).alias("rid")).agg(*sides)
    # One plan for both, so that the texts' exchange is made once and used twice.
    own = meta.join(voted, "rid", "left").withColumn("f", F.coalesce("f", zero)).withColumn("e", F.coalesce("e", zero))
    own = staged(own, "prints")
    classes = within_radius(own.select("rid", "f"), radius)
    placed = own.join(classes, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = placed.groupBy("comp").agg(F.min(F.struct("id")).alias("least"))
    after = own.select(F.col("rid").alias("next_rid"), F.col("f").alias("g"))
    return (
        placed.join(least, "comp")
        .join(after, "next_rid")
        .select(
            "id",
            "n_chars",
            "edited_sha256",
            shown("f").alias("fingerprint"),
            shown("e").alias("edited_fingerprint"),
            likeness("f", "e").alias("near_edited"),
            likeness("f", "g").alias("near_next"),
            F.col("least.id").alias("class_id"),
        )
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
