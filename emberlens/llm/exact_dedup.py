"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
largest id stays.

1. One pass over the texts writes ``(row number, id, SHA-256 of the folded text)``, about 50
   bytes a row; texts are never shuffled.
2. A Misra-Gries summary (``freqItems``: Karp, Schenker and Papadimitriou's form of it, one
   table of at most ``1/support`` digests per task, merged) names every digest that may hold
   more than ``support`` of the rows. An exact count verifies them, combined before the
   shuffle, and finds the winner of each.
3. At most ``1/support`` verified winners are broadcast, a bound that does not depend on the
   data, and their rows are settled on the map side. No hot group is ever shuffled.
4. All other digests hold at most ``support`` of the rows each and are shuffled as usual.

Defined results: null text equals the empty text; among rows with equal text the null id is
smallest; rows repeated with the same id and text keep exactly one; an empty table gives an
empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.llm.common import documents, quoted, staged, text_or_empty, unused, without

#: A digest with more than this share of the rows is settled by broadcast.
SUPPORT = 0.001

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    """Lower-case A-Z only. On pure ASCII the built-in ``lower`` is the same and faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, id, digest`` per row; ``rid`` tells repeated rows apart."""
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(fold(text_or_empty(text_col)).cast("binary"), 256)).alias("digest"),
    )


def heavy_hitters(d: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified digests with more than ``support`` of the rows: ``digest, best, n``."""
    hexed = d.select(F.hex("digest").alias("digest"))
    found = hexed.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    found = found.select(F.unhex("digest").alias("digest")).distinct()
    # Bounded: a summary holds 1/support digests at most.
    exact = (
        d.join(F.broadcast(found), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("id", "rid")).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    total = d.agg(F.count(F.lit(1)).alias("total"))
    return exact.join(F.broadcast(total), F.col("n") > F.col("total") * support).drop("total")


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``id, rid, digest, keep_id, group_size, kept, heavy``."""
    d = staged(digests(docs, id_col, text_col), "digests")
    winners = staged(heavy_hitters(d, support), "winners")
    split = d.join(F.broadcast(winners), "digest", "left")
    hot = split.where(F.col("n").isNotNull()).withColumn("heavy", F.lit(True))
    group = Window.partitionBy("digest")
    rest = split.where(F.col("n").isNull()).select(
        "rid", "id", "digest", F.max(F.struct("id", "rid")).over(group).alias("best"), F.count(F.lit(1)).over(group).alias("n"), F.lit(False).alias("heavy")
    )
    return (
        hot.select(rest.columns)
        .union(rest)
        .select(
            "id",
            "rid",
            "digest",
            F.col("best.id").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("rid") == F.col("best.rid")).alias("kept"),
            "heavy",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by id and digest. Those of the heavy digests are dropped while they
    are read, by the broadcast winners; other dropped pairs are joined away, and of rows that
    share id and digest one stays. Texts are shuffled only as ``without`` says.
    """
    groups = staged(dedup_groups(docs, id_col, text_col, support).where("group_size > 1"), "groups")
    # Bounded: at most 1/support winners.
    heavy = groups.where("heavy and kept").select(F.col("digest").alias("key"), F.col("keep_id").alias("best"))
    pairs = groups.groupBy("id", F.col("digest").alias("key")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = staged(pairs, "pairs")
    gone = pairs.where("not kept").join(F.broadcast(heavy), "key", "left_anti").select("id", "key")
    digest = F.unhex(F.sha2(fold(text_or_empty(quoted(text_col))).cast("binary"), 256))
    name = unused(docs, "digest")
    marked = docs.withColumn(name, digest)
    lost = (marked[name] == heavy["key"]) & ~marked[quoted(id_col)].eqNullSafe(heavy["best"])
    light = marked.join(F.broadcast(heavy), lost, "left_anti")
    return without(light, gone, pairs.where("kept and n > 1").select("id", "key"), id_col, F.col(name)).drop(name)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


#: DuckDB's lower() folds every letter, so A-Z are translated one by one.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
