"""Arrow batches that go to Python are bounded by bytes, and results don't depend on the bound."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from emberlens.llm import language, near_dedup, toxicity
from emberlens.llm.common import _BATCH, BATCH_BYTES, mapped, staged


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


def test_batches_are_bounded(spark):
    own = spark.newSession()
    rows = own.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = mapped(rows, _sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 3000
    assert len(found) > 3 and max(r["size"] for r in found) < 2 * BATCH_BYTES


def test_one_long_row_is_a_batch(spark):
    rows = spark.newSession().range(0, 3, 1, 1).select(F.repeat(F.lit("x"), 3 * BATCH_BYTES).alias("text"))
    assert [r["n"] for r in mapped(rows, _sizes, "n bigint, size bigint").collect()] == [1, 1, 1]


def test_own_limit_is_kept(spark):
    own = spark.newSession()
    own.conf.set(_BATCH, "1m")
    mapped(own.range(3), _sizes, "n bigint, size bigint").collect()
    assert own.conf.get(_BATCH) == "1m"


def test_answers_do_not_depend_on_batches(spark):
    found = []
    for limit in ("64m", "20k"):
        own = spark.newSession()
        own.conf.set(_BATCH, limit)
        docs = own.read.parquet("/root/testdata/sf0.001/documents.parquet")
        marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
        model = toxicity.train(docs, marks)
        toxic = toxicity.score(docs, model).select("doc_id", F.round("score", 9)).collect()
        spoken = language.answered(docs, language.train(docs), name="answer").select("doc_id", "answer.lang_pred").collect()
        found.append((sorted(map(tuple, toxic)), sorted(map(tuple, spoken))))
    assert found[0] == found[1]


def _short(n):
    text = pa.array([f"word{i} of{i % 97} a{i} short{i} line{i}" for i in range(n)])
    ids = pa.array(range(n), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, ids, text], ["rid", "id", "exact", "text"])


def test_short_texts_are_signed_in_bounded_memory():
    # Each text draws some 2,200 points, however short: bounded by bytes alone, these took 1 GB for 8,000.
    batch = _short(4000)
    tracemalloc.start()
    rows = sum(b.num_rows for b in near_dedup._sign(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 250 << 20


def test_signatures_do_not_depend_on_groups(monkeypatch):
    whole = pa.Table.from_batches(near_dedup._sign(iter([_short(300)])))
    monkeypatch.setattr(near_dedup, "SIGNED", 7)
    assert whole.equals(pa.Table.from_batches(near_dedup._sign(iter([_short(300)]))))


def test_small_tables_are_few_files(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "16")
    rows = own.range(0, 2000, 1, 8)
    found = staged(rows.groupBy((F.col("id") % 500).alias("k")).count(), "few", packed=True)
    assert len(found.inputFiles()) == 1
    assert staged(own.range(0, 2000, 1, 200), "few", packed=True).select(F.input_file_name()).distinct().count() <= 32
    assert own.conf.get("spark.sql.adaptive.coalescePartitions.parallelismFirst") == "true"
    assert sorted(r["count"] for r in found.collect()) == [4] * 500
