"""Small helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* a null text counts as the empty text unless the operator says otherwise;
* only the columns named by ``id_col`` / ``text_col`` are read, so further columns of the
  input may have any name;
* whatever has to be cut from its lineage is written as Parquet to the folder that the
  cluster shares (``spark.checkpoint.dir``), never to a machine-local one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

_OWN_DIR: list[str] = []

#: Pairs of id and digest that may be broadcast, of some 60 bytes each.
BROADCAST_ROWS = 200_000

#: Tables of one row per key that ``looked_up`` broadcasts have this many bytes of values or
#: fewer; beyond that each key has this many copies.
BROADCAST_BYTES, SALTS = 32 << 20, 64

#: Rows go to Python in Arrow batches of about this many bytes (a longer row is a batch of its
#: own); both the executor's JVM and the worker hold a batch, in and out.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Small tables are written by at most this many tasks, or four a core where that is more.
FILES = 32
_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a private one only where the session names none and the
    executors are in this process (tests). On a cluster without the setting: ``RuntimeError``."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="emberlens-"))
    return _OWN_DIR[0]


def staged(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs nothing that was written. Files stay until the job's owner clears
    the folder, since lazily evaluated results may still read them.

    ``packed`` is for narrow tables of light work, of which a job writes many: what was shuffled
    is put together up to the session's advisory size, not dealt over all cores. On local
    folders Hadoop starts two processes (``chmod``) for every file.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/emberlens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if not packed:
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)
    before = spark.conf.getAll.get(_FIRST)
    spark.conf.set(_FIRST, "false")
    try:
        # Parent partitions of a task run one after the other: none is larger than before.
        df.coalesce(max(FILES, 4 * spark.sparkContext.defaultParallelism)).write.parquet(at)
    finally:
        if before is None:
            spark.conf.unset(_FIRST)
        else:
            spark.conf.set(_FIRST, before)
    return spark.read.schema(df.schema).parquet(at)


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the decimal id, modulo ``n``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(rows: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of about ``BATCH_BYTES``.

    Spark reads the limit from the session when the plan runs, so it is set there and stays;
    one that the session names already is kept.
    """
    conf = rows.sparkSession.conf
    if _BATCH not in conf.getAll:
        conf.set(_BATCH, BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def beside(docs: DataFrame, text_col: str, run: Callable, kind: str, name: str) -> DataFrame:
    """All columns of ``docs`` and one more, called ``name``, that ``run`` puts in place of the text.

    ``run`` maps Arrow batches whose last column is the text, null as the empty one; it is added
    in the worker, so texts are sent once. Columns go through under numbers, so theirs may have
    any name.
    """
    numbered = docs.toDF(*[f"k{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text_col)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("text", pc.fill_null(b.column(at), "") if b.column(at).null_count else b.column(at))

    schema = StructType([*numbered.schema.fields, StructField(name, DataType.fromDDL(kind))])
    return mapped(numbered, lambda batches: run(filled(batches)), schema).toDF(*docs.columns, name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``docs`` whose id and ``key`` are not in ``gone`` (columns ``id, key``); of the
    rows that share a pair in ``repeated`` one stays. Both name each pair once.

    ``gone`` is broadcast if it has ``BROADCAST_ROWS`` rows or fewer (it is counted), so texts
    are shuffled only where more is dropped than that, and for repeated pairs.
    """
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    name = unused(docs, "key")
    marked = docs.withColumn(name, key)

    def matches(df: DataFrame, pairs: DataFrame) -> Column:
        return df[quoted(id_col)].eqNullSafe(pairs["id"]) & (df[name] == pairs["key"])

    out = marked.join(gone, matches(marked, gone), "left_anti")
    if not repeated.isEmpty():
        again, nth = out.join(repeated, matches(out, repeated), "left_semi"), unused(marked, "nth")
        again = again.withColumn(nth, F.row_number().over(Window.partitionBy(quoted(id_col), name).orderBy(F.lit(1))))
        out = out.join(repeated, matches(out, repeated), "left_anti").unionAll(again.where(F.col(nth) == 1).drop(nth))
    return out.drop(name)


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``; no task gets a hot key's rows.

    ``table`` is written and measured. Up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes
    it is broadcast. Beyond, every key gets ``SALTS`` copies, and each row goes to the copy
    that its value of ``spread`` (such as a row number) tells. Null keys match nothing.
    """
    table = staged(table, "lookup")
    bytes_ = F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(bytes_, F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, how)
    salt = unused(rows, "salt")
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(copies.hint("merge"), [key, salt], how).drop(salt)
