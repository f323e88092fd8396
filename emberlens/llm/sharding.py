"""Sharding by extendible hashing (DataFrame functions only).

A row's address is a string of bits: 60 bits of the MD5 of its key, then 60 bits hashed from
a row number that is unique in the table. The directory starts as one bucket with no bits; a
bucket over the byte limit splits on its next bit and no other bucket does. The second half
of the address only matters when one key's rows alone exceed a shard, so a key with a third
of all rows splits like any other.

Work is done eight bits a round: rows are summed by their next eight bits (combined before
the shuffle, so 256 rows a task and open bucket), and the eight levels of the directory are
decided on those sums. A round reads only what is still over the limit. The number of rounds
is the logarithm of the input over the limit, divided by eight.

Defined results: null text has 0 bytes; a null key is hashed as the empty string; a single
row over the limit is a shard of its own (``oversize``); an empty table gives an empty
result; repeated rows are told apart by their row number; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.llm.common import documents, quoted, staged, text_or_empty, unused

LIMIT_BYTES = 16 << 20
#: The limit of the registered query: small shards, so that small tables split too.
QUERY_LIMIT = 256 << 10
HALF, STEP = 60, 8


def _prefix(depth: int) -> list[Column]:
    """The address's first ``depth`` bits as two numbers."""
    first, second = min(depth, HALF), max(0, depth - HALF)
    return [
        F.shiftright("h1", HALF - first).alias(f"p{depth}"),
        (F.shiftright("h2", HALF - second) if second else F.lit(0).cast("bigint")).alias(f"q{depth}"),
    ]


def addresses(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rid = F.monotonically_increasing_id()
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(key_col).alias("key"),
        rid.alias("rid"),
        F.octet_length(text_or_empty(text_col)).cast("bigint").alias("bytes"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("h1"),
        F.shiftrightunsigned(F.xxhash64(rid), 64 - HALF).alias("h2"),
    )


def _round(rows: DataFrame, open_buckets: DataFrame | None, base: int, limit: int) -> DataFrame:
    """Leaf depth for each bucket of the next level; null where it is still over the limit."""
    deep = min(base + STEP, 2 * HALF)
    at = [f"p{deep}", f"q{deep}"]
    levels = range(base + 1, deep + 1)
    sums = rows.groupBy(*_prefix(deep)).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))

    def up(level: int) -> list[Column]:
        gone = deep - level
        if level > HALF:
            return [F.col(at[0]).alias(f"p{level}"), F.shiftright(at[1], gone).alias(f"q{level}")]
        kept = F.shiftright(at[0], min(deep, HALF) - level)
        return [kept.alias(f"p{level}"), F.lit(0).cast("bigint").alias(f"q{level}")]

    sums = sums.select(*at, "b", "n", *[c for level in range(base, deep) for c in up(level)])
    here = [f"p{base}", f"q{base}"]
    if open_buckets is not None:
        sums = sums.join(open_buckets, here, "left_semi")
    over = {level: Window.partitionBy(*here, *([] if level == base else [f"p{level}", f"q{level}"])) for level in levels}
    node = {level: F.struct(F.sum("b").over(w).alias("b"), F.sum("n").over(w).alias("n")) for level, w in over.items()}
    sums = sums.select(*at, *here, *[node[level].alias(f"s{level}") for level in levels])

    def settled(level: int) -> Column:
        fits = (F.col(f"s{level}.b") <= limit) | (F.col(f"s{level}.n") == 1)
        return F.lit(True) if level == 2 * HALF else fits

    leaf = F.coalesce(
        *[
            F.when(settled(k), F.struct(F.lit(k).alias("depth"), F.col(f"s{k}.b").alias("bytes"), F.col(f"s{k}.n").alias("rows")))
            for k in levels
        ]
    )
    return sums.select(*at, leaf.alias(f"leaf{deep}"))


def assign(
    docs: DataFrame, limit_bytes: int = LIMIT_BYTES, key_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``key, rid, bytes, depth, shard, shard_bytes, shard_rows, oversize``."""
    rows = staged(addresses(docs, key_col, text_col), "addresses")
    total = rows.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    found, leaves = rows, []
    if total["n"] <= 1 or total["b"] <= limit_bytes:
        whole = F.struct(F.lit(0).alias("depth"), F.lit(total["b"]).cast("bigint").alias("bytes"), F.lit(total["n"]).alias("rows"))
        found, leaves = rows.withColumn("leaf0", whole), ["leaf0"]
    base, left, still = 0, None, not leaves
    while still:
        deep = min(base + STEP, 2 * HALF)
        directory = staged(_round(rows, left, base, limit_bytes), f"directory{deep}")
        at = [f"p{deep}", f"q{deep}"]
        # Spark compares the directory's measured size with its broadcast threshold here.
        found = found.select("*", *_prefix(deep)).join(directory, at, "left").drop(*at)
        leaves.append(f"leaf{deep}")
        left = directory.where(F.col(f"leaf{deep}").isNull()).select(*at)
        base, still = deep, deep < 2 * HALF and not left.isEmpty()
    leaf = reduce(lambda a, b: F.coalesce(a, b), [F.col(x) for x in leaves])
    bits = F.concat(F.lpad(F.bin("h1"), HALF, "0"), F.lpad(F.bin("h2"), HALF, "0"))
    return found.select(
        "key",
        "rid",
        F.col("bytes"),
        leaf["depth"].alias("depth"),
        F.substring(bits, F.lit(1), leaf["depth"]).alias("shard"),
        leaf["bytes"].alias("shard_bytes"),
        leaf["rows"].alias("shard_rows"),
        (leaf["bytes"] > limit_bytes).alias("oversize"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``docs`` once, with one folder a shard (``shard_bits``).

    Rows find their shard by key and bytes, null keys too; of rows that share both each takes
    one of the places, so every shard gets the bytes it was given. A column of ``docs`` that
    is called ``shard_bits`` clashes with the folder's name: ``ValueError``.
    """
    if unused(docs, "shard_bits") != "shard_bits":
        raise ValueError("docs has a column shard_bits")
    size, nth = unused(docs, "bytes"), unused(docs, "nth")
    same = Window.partitionBy(quoted(key_col), size).orderBy(F.lit(1))
    rows = docs.withColumn(size, F.octet_length(text_or_empty(quoted(text_col))).cast("bigint")).withColumn(nth, F.row_number().over(same))
    places = Window.partitionBy("key", "bytes").orderBy("rid")
    where = shards.select("key", "bytes", F.row_number().over(places).alias("nth"), F.concat(F.lit("b"), "shard").alias("shard_bits"))
    match = rows[quoted(key_col)].eqNullSafe(where["key"]) & (rows[size] == where["bytes"]) & (rows[nth] == where["nth"])
    dealt = rows.join(where, match).select(*[rows[quoted(c)] for c in docs.columns], where["shard_bits"])
    dealt.repartition("shard_bits").write.partitionBy("shard_bits").parquet(path)


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), QUERY_LIMIT).select(
        F.col("key").alias("doc_id"), "bytes", "depth", "shard", "shard_bytes", "shard_rows", "oversize"
    )


OP10_SQL = f"""
WITH a AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
         lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), {HALF}, '0') AS bits
  FROM documents),
p AS (SELECT doc_id, bytes, CAST(d AS INTEGER) AS depth, left(bits, CAST(d AS INTEGER)) AS shard
      FROM a, (SELECT unnest(range(0, {HALF + 1})) AS d)),
s AS (SELECT depth, shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
leaf AS (SELECT p.doc_id, min(p.depth) AS depth FROM p JOIN s USING (depth, shard)
         WHERE shard_bytes <= {QUERY_LIMIT} OR shard_rows = 1 GROUP BY p.doc_id)
SELECT p.doc_id, p.bytes, p.depth, p.shard, s.shard_bytes, s.shard_rows, s.shard_bytes > {QUERY_LIMIT} AS oversize
FROM p JOIN leaf USING (doc_id, depth) JOIN s USING (depth, shard)
"""
