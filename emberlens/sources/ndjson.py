"""NDJSON: lines to records, with every line accounted for.

A line ends at a line feed; one carriage return before it is taken off. Each line is a
record (a JSON object), blank, malformed (no object, or no UTF-8) or too long. Malformed, too,
are objects with half a surrogate pair.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MAX_LINE_BYTES = 1 << 20
RECORD, BLANK, MALFORMED, TOO_LONG = "record", "blank", "malformed", "too_long"


def prepare(spark: SparkSession) -> None:
    """Session settings the results rely on: UTC, and the last of repeated JSON keys."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, pos``; ``pos`` orders the lines of a file, and files by name."""
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("value", at.alias("pos"))


def _half_pairs(raw: Column) -> Column:
    """Whether a line holds half a surrogate pair; lines without such escapes are told at once.

    Plain functions only: one that Spark interprets would keep the whole classification out of
    generated code.
    """
    escapes = F.regexp_replace(raw, r"\\\\", "_")
    pairs = F.regexp_replace(escapes, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    return raw.contains("\\u") & pairs.rlike(r"\\u[dD][89a-fA-F]")


def classify(lines: DataFrame, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES, keep: tuple[str, ...] = ("pos",)) -> DataFrame:
    """``status, raw, v`` beside ``keep``, from ``value`` (string or binary).

    The text is parsed as the first element of an array whose second is a mark nobody can
    know, so that trailing text or a second value is not taken for a record. The parsed value
    passes through a generator, which keeps later filters from being pushed below it and
    parsing again.
    """
    prepare(lines.sparkSession)
    value = F.col("value").cast("string")
    mark = uuid.uuid4().hex
    # A source that measured its lines has left out the bytes of the long ones.
    size = F.col("bytes") if "bytes" in lines.columns else F.octet_length(value)
    bare = F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.char_length(value) - 1)).otherwise(value)
    cut = lines.select(
        *keep,
        size.alias("bytes"),
        F.when((F.octet_length(value) <= max(1, max_line_bytes)) & F.is_valid_utf8(value), bare).alias("raw"),
    )
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit(f',"{mark}"]')))
    once = cut.select("*", F.inline(F.array(F.struct(whole.alias("parsed")))))
    inner = F.try_variant_get("parsed", "$[0]", "variant")
    # One element and then the mark, and the element starts like an object.
    starts = F.col("raw").startswith("{") | F.ltrim("raw", F.lit(" \t\r\n")).startswith("{")
    good = F.try_variant_get("parsed", "$[1]", "string") == mark
    # Most lines are records, so the dearer questions are asked of the others only.
    status = (
        F.when(F.coalesce(good & starts & ~_half_pairs(F.col("raw")), F.lit(False)), RECORD)
        .when(F.col("bytes") > max(1, max_line_bytes), TOO_LONG)
        .when(F.col("raw").isNull(), MALFORMED)
        .when(F.col("raw").rlike(r"(?U)^\s*\z"), BLANK)
        .otherwise(MALFORMED)
    )
    kept = once.select(*keep, "raw", F.inline(F.array(F.struct(status.alias("status"), inner.alias("v")))))
    return kept


def records(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status") == RECORD).drop("status")


def read_ndjson(spark: SparkSession, path: str, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """``pos, raw, v`` of the records of the files at ``path``."""
    return records(classify(read_lines(spark, path), max_line_bytes))


def tallies() -> list[Column]:
    """For ``DataFrame.observe`` over classified lines."""
    return [F.count_if(F.col("status") == s).alias(s) for s in (RECORD, BLANK, MALFORMED, TOO_LONG)]


def line_counts(classified: DataFrame) -> DataFrame:
    """One row: how many lines of each kind."""
    return classified.agg(*tallies())
