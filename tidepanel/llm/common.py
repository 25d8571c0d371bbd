"""Helpers shared by the operators: packed chunks of documents, word arrays, hashes, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.staging import materialize

CHUNK_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, next to other workers and the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark, rows: int = 2000):
    """Fewer rows for each Arrow batch while a block runs its jobs, as rows are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=4), use_threads=False)) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(body) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(body), options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()


def chunked(df: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``df`` packed into compressed chunks of some ``chunk_bytes`` of text: (chunk long, body binary).

    A chunk is a run of rows of one input split.  Use it in a single plan, where one exchange by
    chunk serves all the passes over the texts.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // chunk_bytes)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + serial], pa.int64()), pa.array([_pack(b.slice(lo, hi - lo))], pa.binary())], ["chunk", "body"])
                    serial += 1
        give_back()

    return df.mapInArrow(pack, "chunk long, body binary").repartition("chunk")


def chunked_by_id(df: DataFrame, doc_id: str, chunks: int) -> DataFrame:
    """Rows of ``df`` packed by ``chunk_of`` their id, several bodies for each chunk: the same in any plan, whatever the order of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk = b.column(0).to_numpy()
            order = np.argsort(chunk, kind="stable")
            present, starts = np.unique(chunk[order], return_index=True)
            rest = b.select(b.schema.names[1:])
            bodies = [_pack(rest.take(pa.array(at))) for at in np.split(order, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), pa.array(bodies, pa.binary())], ["chunk", "body"])
        give_back()

    return df.select(chunk_of(doc_id, chunks).alias("_chunk"), *df.columns).mapInArrow(pack, "chunk long, body binary")


def chunk_of(doc_id: str, chunks: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(chunks))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(words: Iterable[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each of n words, the same in every task."""
    return np.fromiter(map(_Hashes().__getitem__, words), np.uint64, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)


def grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every n consecutive elements: the multipliers are odd and unrelated, so one form is uniform in the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = multipliers(n, seed)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * m[j]
    return mix(out)


def binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column


def lists(flat: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow list column from a flat array and its offsets (one more than lists)."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat, kind))


def flat(column) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    return c.flatten().to_numpy(zero_copy_only=False)


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by bucket, the buckets present, and the offsets of their rows."""
    b = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    present, starts = np.unique(b[order], return_index=True)
    return order, present, np.append(starts, len(h))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for each node of ``edges``.

    Large-star and small-star steps alternate until nothing changes, some log of the longest
    path.  Each step groups with map-side minima and joins them back, so a node with very many
    links is never gathered in a task; each result is a written table.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u != v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
