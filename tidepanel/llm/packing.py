"""Packed token matrices by best-fit-decreasing.

A document's ids end with ``end_id``; one longer than ``context`` is split into whole rows and a rest,
losslessly.  The pieces, longest first, go each to the row with the least room that still holds it; the
rooms stand in a segment tree over capacities 0 to ``context``, so a placement takes log2(context) steps.
Rows are padded with ``end_id``.

Packing has two levels.  Each batch of an input split is tokenized and packed on its own; rows filled to
``full`` of the context stay where they are.  The pieces of all other rows of the whole table are dealt by hash
into groups of about ``group_rows`` rows and packed again, so the fill does not depend on how the input is
split, only the rests of batches are shuffled, and memory is that of a batch or a group.  The first level is
written once, so a lost executor repeats neither the tokenization nor the row numbers.

Output, one row for each packed row: row_id, ids (``context`` little-endian unsigned integers of two or
four bytes), n_tokens, cu_lengths (cumulative segment lengths from 0), resets (offsets in the row where
positions start again at 0), doc_ids and doc_offsets (where in its document each segment starts).

Cases: a null or empty text is one segment with ``end_id`` alone; a null id stays null in doc_ids; repeated
rows are packed as often; other columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.bpe import _encoding, plain, sent_vocabulary
from tidepanel.llm.common import binary
from tidepanel.operators.staging import materialize

PACKED = "row_id long, ids binary, n_tokens int, cu_lengths array<int>, resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_NAMES = [part.split()[0] for part in PACKED.split(", ")]
_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
#: Row numbers of the second level start here; those of the first have the partition in their upper half.
_SECOND = 1 << 62


class Rooms:
    """Rows by the room they have left; a segment tree finds the least sufficient room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += n
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) with the least room of at least ``need``."""
        i = self.size + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], context: int) -> list[list[int]]:
    """Pieces of each row, longest pieces placed first."""
    rooms, rows = Rooms(context), []
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = rooms.take(lengths[k])
        row, room = got or (len(rows), context)
        if got is None:
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            rooms.put(room - lengths[k], row)
    return rows


def _packed(pieces: list[np.ndarray], owner: list, start: list[int], context: int, end_id: int, kind: str, first: int) -> list[pa.Array]:
    """Columns of the rows that hold the pieces, numbered from ``first``."""
    out: list[list] = [[] for _ in _NAMES]
    for n, row in enumerate(best_fit([len(p) for p in pieces], context)):
        ends = np.cumsum([0, *(len(pieces[k]) for k in row)])
        line = np.full(context, end_id, kind)
        line[: ends[-1]] = np.concatenate([pieces[k] for k in row])
        for cell, v in zip(out, (first + n, line.tobytes(), int(ends[-1]), ends.tolist(), ends[:-1].tolist(), [owner[k] for k in row], [start[k] for k in row]), strict=True):
            cell.append(v)
    return [pa.array(c, k) for c, k in zip(out, _KINDS, strict=True)]


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, context: int = 2048, end_id: int = 50256, doc_id: str = "doc_id", text: str = "text",
         full: float = 0.99, group_rows: int = 2048) -> DataFrame:
    sent = sent_vocabulary(docs.sparkSession, ranks, pattern)
    kind = "<u2" if max(end_id, len(ranks)) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, encoding = TaskContext.get().partitionId() << 32, _encoding(sent.value)
        for b in batches:
            if not b.num_rows:
                continue
            owner, start, pieces = [], [], []
            for d, ids in zip(b.column(0).to_pylist(), encoding.encode_ordinary_batch(plain(binary(b.column(1)).to_pylist()), num_threads=1), strict=True):
                whole = np.array([*ids, end_id], kind)
                for at in range(0, len(whole), context):
                    owner.append(d), start.append(at), pieces.append(whole[at : at + context])
            rows = _packed(pieces, owner, start, context, end_id, kind, serial)
            serial += len(rows[0])
            yield pa.RecordBatch.from_arrays(rows, _NAMES)

    def again(key: tuple, rows: pa.Table) -> pa.Table:
        pieces, owner, start = [], [], []
        for b in rows.sort_by("row_id").to_batches():
            for ids, cuts, owners, starts in zip(*(b.column(c).to_pylist() for c in ("ids", "cu_lengths", "doc_ids", "doc_offsets")), strict=True):
                line = np.frombuffer(ids, kind)
                pieces += [line[a:z] for a, z in pairwise(cuts)]
                owner += owners
                start += starts
        return pa.Table.from_arrays(_packed(pieces, owner, start, context, end_id, kind, _SECOND + (key[0].as_py() << 32)), _NAMES)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = materialize(picked.mapInArrow(run, PACKED))
    kept = F.col("n_tokens") >= F.lit(full * context)
    rests = first.where(~kept)
    groups = max(1, -(-(rests.agg(F.sum("n_tokens")).first()[0] or 0) // (context * group_rows)))
    second = rests.withColumn("_group", F.pmod(F.xxhash64("row_id"), F.lit(groups))).groupBy("_group").applyInArrow(again, PACKED)
    return first.where(kept).unionByName(second)
