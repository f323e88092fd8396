"""Target-distribution importance resampling in Spark SQL functions.

Documents are drawn so that their hashed n-gram features follow those of a target table. A
bucket's gain is the log ratio of its smoothed shares in the target and in the corpus; a
document's weight is the sum of gains over its features; with Gumbel noise from a hash of the
id, the documents of highest weight plus noise are a draw without replacement in proportion
to exp(weight).

1. One pass over the texts: words, runs of 1 to ``longest`` words, their crc32 buckets; only
   the bucket numbers are written.
2. They are exploded and counted by bucket, combined before the shuffle: ``BUCKETS`` rows,
   whatever the corpus. The gain table has as many rows and is broadcast.
3. Exploded again beside the gains, they are summed by document, combined before the shuffle:
   features of a document are together, so about one row a document moves.
4. A range sort by score with partition offsets (``ranks.numbered``) gives exact places; no
   task orders more than its range.

Defined results: null and empty texts have no features, weight 0 and rank null; a null id is
hashed as the empty text and goes last among equal scores; repeated rows are ranked one by
one; an empty corpus gives an empty result; without target texts gains only level the
corpus's own buckets; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.llm.common import documents, staged, text_or_empty
from emberlens.llm.exact_dedup import fold
from emberlens.llm.ranks import numbered

BUCKETS, LONGEST, SEED, PERCENT, LEAST = 10_000, 1, "2024", 10, 20

#: All but digits, letters a-z and what is beyond ASCII.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(fold(text), _BREAK), lambda w: w != "")


def runs(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words of an array, joined by one space."""

    def of(n: int) -> Column:
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))

    return found if longest == 1 else F.flatten(F.array(found, *map(of, range(2, longest + 1))))


def featured(docs: DataFrame, text_col: str, longest: int, keep: dict[str, Column]) -> DataFrame:
    """``keep`` and, for each row, its number of ``words`` and its features' ``buckets``."""
    split = docs.select(*[c.alias(k) for k, c in keep.items()], words(text_or_empty(text_col)).alias("found"))
    bucket = F.transform(runs(F.col("found"), longest), lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("int"))
    return split.select(*keep, F.size("found").alias("words"), bucket.alias("buckets"))


def counted(features: DataFrame, name: str) -> DataFrame:
    """``bucket`` and how many features are in it; at most ``BUCKETS`` rows."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """``bucket, gain`` of the buckets that occur in either: at most ``BUCKETS`` rows."""
    both = counted(corpus, "s").join(counted(target, "t"), "bucket", "full")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    everything = Window.partitionBy()  # BUCKETS rows at most
    s, t = (F.sum(c).over(everything) for c in ("s", "t"))
    ratio = (F.col("t") + 1) * (s + BUCKETS) / ((F.col("s") + 1) * (t + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("bigint").alias("gain"))


def noise(key: Column, seed: str = SEED) -> Column:
    """A thousand times a standard Gumbel number, rounded down, from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("bigint")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = LONGEST,
    percent: int = PERCENT,
    least: int = LEAST,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_features, weight, score, rank``; ``rank`` is null where it isn't drawn."""
    keep = {"rid": F.monotonically_increasing_id(), "id": F.col(id_col)}
    corpus = staged(featured(docs, text_col, longest, keep), "features")
    gain = staged(gains(corpus, featured(target, target_col, longest, {})), "gains")
    each = corpus.select("rid", "id", "words", F.size("buckets").cast("bigint").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    weighed = each.join(F.broadcast(gain), "bucket", "left").groupBy("rid", "id", "words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    score = F.col("weight") + noise(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    scores = staged(weighed.select("rid", "id", "n_features", "weight", score.alias("score"), (F.col("words") >= least).alias("able")), "scores")
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("id"), F.asc("rid")]
    drawn = F.col("able") & (F.col("idx") < F.floor(F.col("n") * percent / 100))
    return numbered(scores, "able", order).select("id", "n_features", "weight", "score", F.when(drawn, F.col("idx") + 1).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


#: DuckDB has no crc32: a macro over the bytes of each distinct word.
CRC32_SQL = """
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc_t
  FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    """The checksum of ``text``, an SQL expression, beside ``crc_table``."""
    octet = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT"
    step = "xor(crc_t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda k: {octet}), lambda c, b: {step}, 4294967295), 4294967295)"


OP13_SQL = f"""
WITH {CRC32_SQL.strip()},
lowered AS (
  SELECT 1 AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
  UNION ALL SELECT 2, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
found AS (
  SELECT side, doc_id, unnest(regexp_extract_all(body, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM lowered),
spelled AS (SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM found), crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (side = 1)::DOUBLE AS s, count(*) FILTER (side = 2)::DOUBLE AS t FROM found JOIN spelled USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
weighed AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM found JOIN spelled USING (word) JOIN gain USING (bucket) WHERE side = 1 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
"""
