"""Packing by vector bin packing.

Every document becomes its token ids and a terminator. Stretches of a full sequence need no
placing; what is left of each document is a vector of demands: tokens, one segment, and
loss-bearing tokens. Sequences are bins with a limit on each of the three. Into the open bin
goes the waiting piece that fits and has the largest dot product of its demand with what the
bin has left, both in units of the limits (Panigrahy, Talwar, Uyeda and Wieder, "Heuristics
for Vector Bin Packing", 2011). When no piece fits and the bin has room, the piece with the
largest dot product is cut to fit and its rest waits on, so a bin closes short of its token
limit only at its segment or loss limit, or as the last one of a task.

A task holds at most ``WAITING`` pieces, each shorter than a sequence, and one document. No
shuffle is needed: every task packs the rows it reads, and its sequences carry the task's
number in the upper bits of their id. Each task leaves one partly filled sequence.

Defined results: null text is empty and gives one piece with the terminator alone; repeated
rows are packed one by one; a null id stays null; an empty table gives no pieces; where
``loss_col`` names no column, or its spans are null, every token but the terminator bears
loss, and with no spans none does; a token bears loss if its first byte lies in a span; other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.llm.bpe import byte_letters
from emberlens.llm.common import documents, mapped, text_or_empty

SEQUENCE, SEGMENTS, LOSS, TERMINATOR = 1024, 256, 1024, 0
WAITING, MEMO = 256, 300_000

#: The byte-level pretokeniser's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONE_BLANK = regex.compile(r"(?<!\s) (?!\s)")


class _Irregular(Exception):
    """White space other than lone blanks at a chunk's edge: its tokens depend on the next chunk."""


class ByteBpe:
    """Ids of a byte-level BPE file as little-endian bytes.

    A lone blank between two other characters always starts a token, so the chunks between
    such blanks are encoded on their own and their ids memoised.
    """

    def __init__(self, path: str, memo: int = MEMO) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        #: Bytes of each id.
        self.width = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.width[i] = len(token)
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        self.chunks = _Blobs(self, memo)

    def plain(self, text: str) -> bytes:
        ids = array("I", self.core.encode_ordinary(text))
        return ids.tobytes()

    def part(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            if head[-1:].isspace():
                raise _Irregular
            return self.plain(head) + b"".join(map(self.chunks.__getitem__, rest))
        except _Irregular:
            head, *rest = _LONE_BLANK.split(text)
            return self.plain(head) + b"".join([self.plain(" " + x) for x in rest])

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self.part(text)
        parts = self.special.split(text)
        return b"".join(array("I", [self.added[x]]).tobytes() if k % 2 else self.part(x) for k, x in enumerate(parts))


class _Blobs(dict):
    def __init__(self, owner: ByteBpe, memo: int) -> None:
        super().__init__()
        self.owner, self.memo = owner, memo

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Irregular
        got = self.owner.plain(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= self.memo:
                self.clear()
            self[chunk] = got
        return got


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)


class Packer:
    """Places pieces into sequences; ``rows`` gathers (key, start, length, sequence, offset).

    Even sequence numbers are bins, odd ones are stretches that fill a sequence alone.
    """

    def __init__(self, limits: tuple[int, int, int] = (SEQUENCE, SEGMENTS, LOSS), waiting: int = WAITING, first: int = 0) -> None:
        if min(limits) < 1:
            raise ValueError("every limit must be 1 at least")
        self.limits = np.array(limits, float)
        self.demand = np.zeros((waiting, 3))
        self.items: list[tuple | None] = [None] * waiting  # key, start, loss flags
        self.free = list(range(waiting - 1, -1, -1))
        self.bin, self.alone, self.rows = first, first + 1, []
        self.left, self.offset = self.limits.copy(), 0

    def add(self, key: object, loss: np.ndarray) -> None:
        """A document: one flag per token, 1 where it bears loss."""
        start, length, full = 0, len(loss), int(self.limits[0])
        while length - start >= full and loss[start : start + full].sum() <= self.limits[2]:
            self.rows.append((key, start, full, self.alone, 0))
            self.alone += 2
            start += full
        while start < length:
            flags = loss[start : start + full]
            borne = np.cumsum(flags)
            if borne[-1] > self.limits[2]:  # only as much as one sequence's loss limit takes
                flags = flags[: int(np.searchsorted(borne, self.limits[2], side="right"))]
            if not self.free:
                self._fill(len(self.items) // 2)
            slot = self.free.pop()
            self.items[slot] = (key, start, flags)
            self.demand[slot] = (len(flags), 1, flags.sum())
            start += len(flags)

    def finish(self) -> None:
        self._fill(0)

    def _close(self) -> None:
        self.bin += 2
        self.left, self.offset = self.limits.copy(), 0

    def _put(self, key: object, start: int, flags: np.ndarray) -> None:
        self.rows.append((key, start, len(flags), self.bin, self.offset))
        self.offset += len(flags)
        self.left -= (len(flags), 1, flags.sum())

    def _fill(self, until: int) -> None:
        """Place pieces until at most ``until`` wait."""
        while len(self.items) - len(self.free) > until:
            waits = self.demand[:, 1] > 0
            points = np.where(waits, self.demand @ (self.left / self.limits**2), -1)
            fits = waits & (self.demand <= self.left).all(axis=1)
            if fits.any():
                slot = int(np.argmax(np.where(fits, points, -1)))
                self._put(*self.items[slot])
                self.items[slot] = None
                self.demand[slot] = 0
                self.free.append(slot)
            elif not self._cut(int(np.argmax(points))):
                self._close()
            if self.left[0] < 1:
                self._close()

    def _cut(self, slot: int) -> bool:
        """Fill the bin with the first part of a waiting piece, if the other limits allow it."""
        key, start, flags = self.items[slot]
        room = min(int(self.left[0]), int(np.searchsorted(np.cumsum(flags), self.left[2], side="right")))
        if self.left[1] < 1 or not 0 < room < len(flags):
            return False
        self._put(key, start, flags[:room])
        self.items[slot] = (key, start + room, flags[room:])
        self.demand[slot] = (len(flags) - room, 1, flags[room:].sum())
        return True


_PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint, ids binary"


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: tuple[int, int, int] = (SEQUENCE, SEGMENTS, LOSS),
    keep_ids: bool = True,
    loss_col: str | None = None,
) -> DataFrame:
    """One row per piece. ``ids`` holds its ids, little-endian unsigned 32-bit numbers.

    ``loss_col``: an array of structs (start, end) of bytes of the text, the spans that bear
    loss, as in instruction data. ``loss_tokens`` counts a piece's tokens that do.
    """
    end = array("I", [TERMINATOR]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, held = byte_bpe(path), Packer(limits, first=TaskContext.get().partitionId() << 40), {}
        kinds = [pa.int64()] * 7 + [pa.binary()] * keep_ids
        names = [x.split()[0] for x in _PIECES.split(", ")][: len(kinds)]
        number = 0

        def out() -> pa.RecordBatch:
            rows = []
            for key, start, length, sequence, offset in packer.rows:
                doc_id, blob, loss, left = held[key]
                ids, borne = blob[4 * start : 4 * (start + length)], int(loss[start : start + length].sum())
                rows.append((doc_id, start, length, zlib.crc32(ids), len(blob) // 4, sequence, offset, borne, ids)[: len(names) + 1])
                if left == length:
                    del held[key]
                else:
                    held[key] = (doc_id, blob, loss, left - length)
            packer.rows = []
            cols = list(zip(*rows)) if rows else [()] * (len(names) + 1)
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))]
            return pa.RecordBatch.from_arrays(arrays, ["id", *names])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                blob = bpe.encode(text.as_py()) + end
                loss = np.ones(len(blob) // 4)
                if spans.is_valid:
                    width = bpe.width[np.frombuffer(blob, np.uint32)]
                    first = np.cumsum(width) - width
                    loss[:] = 0
                    for span in spans.as_py():
                        loss[(first >= span["start"]) & (first < span["end"])] = 1
                loss[-1] = 0
                held[number] = (doc_id, blob, loss, len(loss))
                packer.add(number, loss)
                number += 1
                if len(packer.rows) >= 2000:
                    yield out()
        packer.finish()
        if id_type is not None:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    spans = (F.lit(None) if loss_col is None else F.col(loss_col)).cast("array<struct<start:bigint,end:bigint>>")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), spans.alias("spans"))
    return mapped(rows, run, f"id {kind}, {_PIECES if keep_ids else _PIECES.removesuffix(', ids binary')}")


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
    return pieces.withColumnRenamed("id", "doc_id")
