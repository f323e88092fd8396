"""A growing file as a stream: a Python data source that survives rotation and truncation.

The offset is the file's identity, a generation, a position and a checksum of the file's
first bytes. A line without its line feed is held back until it is whole. When the path names
another file, what is left of the one before is read first: from the open handle, or, after a
restart, from the renamed file beside the path (``name.1`` and the like) that has the offset's
identity and first bytes. Renamed files that were written after it come next, in the order of
their last change, and then the path's own. With each file, and when a file is shorter than
the position or begins with other bytes, reading starts anew at 0 and the generation rises by
one, so (generation, position) orders lines by arrival across rotations. A batch holds about
``budget`` bytes of one file and at least one line. Lines over the cap are passed on as such,
without their bytes.
"""

from __future__ import annotations

import glob
import os
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from emberlens.sources.ndjson import DEFAULT_MAX_LINE_BYTES

BUDGET = 8 << 20
_CHUNK = 1 << 16
#: First bytes that tell a file from another one of the same inode.
HEAD = 256
#: What a rotation adds to a name.
_NUMBERED = re.compile(r"[.-]\d[\d.T:_-]*")


def _lines(handle, at: int, stop: int, cap: int, budget: int) -> Iterator[tuple[bytes | None, int, int]]:  # noqa: ANN001
    """(line or None if over the cap, its length, position behind it), from ``at`` on."""
    handle.seek(at)
    held, size, taken, begun = bytearray(), 0, 0, at
    while begun + size < stop or size == 0:
        piece = handle.readline(_CHUNK)
        if not piece or begun + size + len(piece) > stop:
            return
        size += len(piece)
        if size <= cap + 1:
            held += piece
        if piece.endswith(b"\n"):
            length = size - 1
            yield (bytes(held[:-1]) if length <= cap else None), length, begun + size
            taken += size
            begun, size = begun + size, 0
            held.clear()
            if taken >= budget:
                return


def _crc(handle: BinaryIO, pos: int) -> int:
    """Of the bytes before ``pos``, ``HEAD`` at most."""
    handle.seek(0)
    return zlib.crc32(handle.read(min(pos, HEAD)))


class _TailReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].removeprefix("file://")
        self.cap = max(1, int(options.get("maxlinebytes", options.get("maxLineBytes", DEFAULT_MAX_LINE_BYTES))))
        self.budget = int(options.get("budget", BUDGET))

        self.open: BinaryIO | None = None

    def initialOffset(self) -> dict[str, int]:  # noqa: N802
        return {"ino": 0, "gen": 0, "pos": 0, "crc": 0}

    def _renamed(self) -> list[str]:
        """Files beside the path with its name and a number or date, by their last change."""
        found = []
        for at in glob.glob(glob.escape(self.path) + "[.-]*"):
            try:
                if _NUMBERED.fullmatch(at[len(self.path) :]) and os.path.isfile(at):
                    found.append((os.stat(at).st_mtime_ns, at))
            except FileNotFoundError:
                pass
        return [at for _, at in sorted(found)]

    def _files(self, start: dict[str, int]) -> Iterator[tuple[BinaryIO, dict[str, int]]]:
        """What can be read on from ``start``: its own file, those renamed since, and the one at the path."""
        names, first = [self.path], True
        if start["ino"]:
            held = self.open
            if held is not None and os.fstat(held.fileno()).st_ino == start["ino"]:
                first = False
                yield held, start
            names = [*self._renamed(), self.path]
            inodes = [os.stat(at).st_ino if os.path.exists(at) else None for at in names]
            own = inodes.index(start["ino"]) if start["ino"] in inodes else len(names) - 1
            names = names[own:]
        gen = start["gen"]
        for at in names:
            try:
                handle = open(at, "rb")
            except FileNotFoundError:  # between a rotation's two steps
                continue
            stat = os.fstat(handle.fileno())
            if start["ino"] == stat.st_ino and stat.st_size >= start["pos"] and _crc(handle, start["pos"]) == start.get("crc", 0):
                if first:
                    yield handle, start
                continue
            gen += start["ino"] != 0
            yield handle, {"ino": stat.st_ino, "gen": gen, "pos": 0, "crc": 0}

    def _read(self, start: dict[str, int], stop: dict[str, int] | None) -> tuple[list[tuple], dict[str, int]]:
        """Lines of one file from ``start`` on, to its end or to ``stop``; and where that is."""
        end = start
        for handle, begin in self._files(start):
            if stop is not None and stop["ino"] != begin["ino"]:
                continue
            size, at, rows = os.fstat(handle.fileno()).st_size, begin["pos"], []
            gen = begin["gen"] if stop is None else stop["gen"]
            if size >= at:
                last, budget = (size, self.budget) if stop is None else (stop["pos"], stop["pos"] - at + 1)
                for line, length, after in _lines(handle, at, last, self.cap, budget):
                    rows.append((line, length, gen, at))
                    at = after
            end = {**begin, "pos": at, "crc": _crc(handle, at)} if at != begin["pos"] or begin is not start else begin
            if handle is not self.open:
                if stop is not None:
                    handle.close()
                else:
                    if self.open is not None:
                        self.open.close()
                    self.open = handle
            if rows:
                break
        return rows if end is not start else [], end

    def read(self, start: dict[str, int]) -> tuple[Iterator[tuple], dict[str, int]]:
        rows, end = self._read(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[tuple]:  # noqa: N802
        return iter(self._read(start, end)[0])

    def commit(self, end: dict[str, int]) -> None:
        pass


class TailDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value binary, bytes bigint, gen bigint, at bigint"

    def simpleStreamReader(self, schema) -> _TailReader:  # noqa: ANN001, N802
        return _TailReader(dict(self.options))


def read_tail(spark: SparkSession, path: str, max_line_bytes: int = DEFAULT_MAX_LINE_BYTES, budget: int = BUDGET) -> DataFrame:
    """A streaming DataFrame ``value, bytes, gen, at``; ``value`` is NULL for lines over the cap."""
    spark.dataSource.register(TailDataSource)
    return spark.readStream.format("tail").option("path", path).option("maxLineBytes", max_line_bytes).option("budget", budget).load()
