"""Lines of files by byte ranges, in constant memory: a Python data source for batches.

A file is cut into ranges of ``SPLIT`` bytes; a line belongs to the range that its first byte
lies in, so ranges are read independently and every line once. The partitions are in the
order of the files' names and of the ranges, so results that keep their partitions' order are
in input order without a sort. A line over the cap is passed on with its length but without
its bytes, which are dropped piece by piece as they are read: a line of any length takes
``CHUNK`` bytes and the cap.

The files must be where every executor can open them under the same name. For other stores
there is ``ndjson.read_lines``, which holds a whole line.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from emberlens.sources.ndjson import DEFAULT_MAX_LINE_BYTES

SPLIT, CHUNK = 16 << 20, 1 << 20

#: File, its number in order, first byte, and the byte behind the range.
Split = tuple[str, int, int, int]


def local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def splits(path: str, size: int = SPLIT) -> list[Split]:
    """Ranges of the file, of a folder's files, or of those a pattern names, in order."""
    path = path.removeprefix("file://").removeprefix("file:")
    names = [path] if os.path.isfile(path) else glob.glob(f"{path}/*" if os.path.isdir(path) else path)
    names = sorted(n for n in names if os.path.isfile(n) and not os.path.basename(n).startswith(("_", ".")))
    return [(n, i, at, min(at + size, whole)) for i, n in enumerate(names) for whole in [os.path.getsize(n)] for at in range(0, whole, size)]


def lines_of(handle: BinaryIO, start: int, stop: int, cap: int) -> Iterator[tuple[list[bytes | None], list[int], list[int]]]:
    """Some lines at a time (None: over the cap), their lengths and first bytes, of those that begin in the range."""
    begin = start
    if start:
        # The range's first line begins behind the first line feed from the byte before it on.
        handle.seek(start - 1)
        begin = start - 1
        while begin < stop:
            piece = handle.read(min(CHUNK, stop - begin))
            cut = piece.find(b"\n")
            begin += len(piece) if cut < 0 else cut + 1
            if cut >= 0 or not piece:
                break
        else:
            return
    handle.seek(begin)
    held, size, at = [], 0, begin
    while begin < stop:
        piece = handle.read(CHUNK)
        first = piece.find(b"\n")
        if first < 0:
            size, at = size + len(piece), at + len(piece)
            held = [*held, piece] if size <= cap else []
            if piece:
                continue
            if size:
                yield [b"".join(held) if size <= cap else None], [size], [begin]
            return
        body = piece[first + 1 :].split(b"\n")
        size += first
        values: list[bytes | None] = [b"".join(held) + piece[:first] if size <= cap else None, *body[:-1]]
        lengths = [size, *map(len, body[:-1])]
        begins = np.r_[begin, at + first + 1 + np.cumsum([0, *(n + 1 for n in lengths[1:])])]
        last = int(np.searchsorted(begins[:-1], stop))
        if max(lengths) > cap:
            values = [v if n <= cap else None for v, n in zip(values, lengths)]
        yield values[:last], lengths[:last], begins[:last].tolist()
        at += len(piece)
        begin, size = int(begins[-1]), len(body[-1])
        held = [body[-1]] if size <= cap else []


class _Range(InputPartition):
    def __init__(self, split: Split) -> None:
        super().__init__(split)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.splits, self.cap = json.loads(options["splits"]), int(options["cap"])

    def partitions(self) -> list[InputPartition]:
        return [_Range(tuple(s)) for s in self.splits] or [_Range(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, number, start, stop = partition.value
        with open(name, "rb", buffering=0) as handle:
            for values, lengths, begins in lines_of(handle, start, stop, self.cap):
                columns = [pa.array(values, pa.binary()), pa.array(lengths, pa.int64()), pa.array([number] * len(values), pa.int32()), pa.array(begins, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["value", "bytes", "file", "at"])


class SplitsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "linesplits"

    def schema(self) -> str:
        return "value binary, bytes bigint, file int, at bigint"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))


def read_splits(spark: SparkSession, found: list[Split], max_line_bytes: int = DEFAULT_MAX_LINE_BYTES) -> DataFrame:
    """``value, bytes, pos`` of the lines of these ranges, in order within and across partitions.

    ``pos`` is one number, the file's and the line's place in it, so that least positions are
    found in hash tables (of structs Spark finds them by sorting). It holds for files up to
    2 ** 44 bytes.
    """
    spark.dataSource.register(SplitsDataSource)
    lines = spark.read.format("linesplits").option("splits", json.dumps(found)).option("cap", max(1, max_line_bytes)).load()
    place = F.shiftleft(F.col("file").cast("bigint"), 44).bitwiseOR(F.col("at"))
    return lines.select("value", "bytes", place.alias("pos"))


def waves(found: list[Split], width: int) -> Iterator[list[Split]]:
    """``width`` ranges at a time."""
    for k in range(0, len(found), width):
        yield found[k : k + width]
