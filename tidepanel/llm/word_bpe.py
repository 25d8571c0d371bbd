"""BPE encoding by a table of distinct words, and decoding through the table of pieces.

Words are what the tokenizer's own splitter makes of a text; its special strings are words of their own.  One
scan cuts the texts: it gathers some ``CHUNK_BYTES`` of text to a chunk, numbers the chunk's distinct words in
order of appearance and sends the numbers of every document by position to the chunk's key and the words of the
chunk, dealt by hash, to the keys of buckets.  Each bucket encodes each of its distinct words once and answers
every chunk with ids in the order asked.  There the ids are joined to the positions.  Texts are cut once and
never shuffled: what moves is positions and words.  The number of buckets follows the bytes of the input, so a
bucket stays bounded; a word common to all chunks costs a bucket some bytes for each chunk.  A stamp of the
chunk's words travels with questions and answers: where an input without fixed order gives another chunk to a
repeated task, the job fails rather than mixing the two.

Decoding joins ids with the table of pieces; that table is as large as the vocabulary, whatever the input, so
it is sent to the tasks and looked up by id.

Texts in Latin letters are cut by an expression over a fixed alphabet.  Unicode versions differ in which later
code points are letters or digits, so any other text is cut by the tokenizer library itself.

Cases: a null text is an empty one and has no ids; ids and rows repeat as often as their rows; a null id stays;
very long texts are cut whole; other columns are not read; bytes that are not UTF-8 become U+FFFD; an empty
table gives an empty result; decoding keeps null ids null and refuses ids without a piece.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidepanel.llm.common import binary, give_back, partitions

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20  # of text for each bucket

# Letters, digits and blanks below U+02C2, where all Unicode versions agree.
_LETTER, _DIGIT, _BLANK = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_BLANK}{_LETTER}{_DIGIT}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_BEYOND = re.compile("[^\0-ˁ]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a file, loaded once in each process, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Cutter:
    """Cuts texts into words as the tokenizer does."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = set(added)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def _plain(self, text: str) -> list[str]:
        if not _BEYOND.search(text):
            return _WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.added else self._plain(part))]


@lru_cache(maxsize=4)
def pieces(path: str) -> pa.Array:
    """Bytes of each id: a piece is spelled with one printable character for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
    found = tokenizer(path)
    size = found.get_vocab_size(with_added_tokens=True)
    spelled = [found.id_to_token(i) or "" for i in range(size)]
    return pa.array([bytes(map(byte_of.__getitem__, p)) if all(c in byte_of for c in p) else p.encode() for p in spelled], pa.binary())


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _tight(*parts: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed body, integers by byte planes."""
    raw = [p if isinstance(p, bytes) else p.view(np.uint8).reshape(-1, p.itemsize).T.tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _loose(body: bytes, *kinds) -> list:
    raw = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(struct.unpack_from(f"<{len(kinds)}q", raw), kinds, strict=True):
        part = raw[at : at + size]
        at += size
        if kind is not bytes:
            part = np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        out.append(part)
    return out


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each span, one span after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


_CUT = "key long, chunk long, stamp long, rows binary, body binary"


def _cut(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows with key -1 - chunk: the documents of a chunk and their words by number; with key = bucket: the chunk's words in a bucket, with their numbers."""

    def write(chunk: int, ids: list[pa.Array], counts: list[int], numbers: list[np.ndarray], known: _Numbers) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        held = pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks()], ["doc_id"])
        with pa.ipc.new_stream(sink, held.schema) as w:
            w.write_batch(held)
        words = [w.encode() for w in known]
        joined = b"".join(words)
        stamp = xxhash.xxh3_64_intdigest(joined) >> 1
        body = _tight(np.array(counts, np.int64), np.concatenate(numbers) if numbers else np.zeros(0, np.uint32))
        names = ["key", "chunk", "stamp", "rows", "body"]
        yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk]), pa.array([chunk]), pa.array([stamp]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([body], pa.binary())], names)
        if not words:
            return
        bucket = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        present, starts = np.unique(bucket[order], return_index=True)
        bodies = []
        for at in np.split(order, starts[1:]):
            own = [words[i] for i in at.tolist()]
            bodies.append(_tight(at.astype(np.uint32), np.fromiter(map(len, own), np.uint32, len(own)), b"".join(own)))
        n = len(present)
        yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([stamp] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(bodies, pa.binary())], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter, chunk = Cutter(path), TaskContext.get().partitionId() << 24
        ids, counts, numbers, known, size = [], [], [], _Numbers(), 0
        for b in (batch.slice(lo, 200) for batch in batches for lo in range(0, batch.num_rows, 200)):
            start = 0
            for i, t in enumerate(binary(b.column(1)).to_pylist()):
                words = cutter.words(t.decode("utf-8", "replace")) if t else []
                counts.append(len(words))
                numbers.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                size += len(t or b"") + 32
                if size > CHUNK_BYTES:
                    yield from write(chunk, [*ids, b.column(0).slice(start, i + 1 - start)], counts, numbers, known)
                    ids, counts, numbers, known, size, start, chunk = [], [], [], _Numbers(), 0, i + 1, chunk + 1
            if start < b.num_rows:
                ids.append(b.column(0).slice(start))
        if ids:
            yield from write(chunk, ids, counts, numbers, known)
        give_back()

    return docs.mapInArrow(scan, _CUT)


_ANSWER = "key long, stamp long, ids binary"


def _answers(cut: DataFrame, path: str) -> DataFrame:
    """Ids of the words of each (bucket, chunk) for the key of the chunk, every distinct word of a bucket encoded once."""

    def encode(t: pa.Table) -> pa.Table:
        if t.column("key")[0].as_py() < 0:  # a chunk, which waits for its answers
            return pa.table({"key": pa.array([], pa.int64()), "stamp": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        own, known, questions = tokenizer(path), _Numbers(), []
        for body in t.column("body"):
            at, sizes, joined = _loose(body.as_py(), np.uint32, np.uint32, bytes)
            ends = np.cumsum(sizes).tolist()
            words = (joined[a:b] for a, b in zip([0, *ends], ends, strict=False))
            questions.append((at, np.fromiter(map(known.__getitem__, words), np.int64, len(at))))
        words, sizes, ids = list(known), [], []
        for lo in range(0, len(words), 10_000):
            got = [e.ids for e in own.encode_batch_fast([w.decode() for w in words[lo : lo + 10_000]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.uint32, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        first = np.cumsum(size) - size
        back = [_tight(at, size[q], flat[_places(first[q].astype(np.int64), size[q].astype(np.int64))]) for at, q in questions]
        del known, words, sizes, ids, questions
        give_back()
        return pa.table({"key": pc.subtract(-1, t.column("chunk")), "stamp": t.column("stamp"), "ids": pa.array(back, pa.binary())})

    return cut.groupBy("key").applyInArrow(encode, _ANSWER)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, ids (array of int), by the tokenizer file at ``path``, which every executor can read."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), size // BUCKET_BYTES)
    # One exchange holds chunks and questions, so both passes below read it and nothing is cut twice.
    cut = _cut(docs, path, parts).repartition(parts, "key")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for key, stamp, rows, body in zip(*(left.column(c) for c in ("key", "stamp", "rows", "body")), strict=True):
            if key.as_py() >= 0:
                continue
            ids = pa.ipc.open_stream(rows.as_py()).read_all().column(0).combine_chunks()
            counts, number = _loose(body.as_py(), np.int64, np.uint32)
            parts = [_loose(x.as_py(), np.uint32, np.uint32, np.uint32) for x in right.column("ids")]
            at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
            if len(at) != (int(number.max()) + 1 if len(number) else 0) or any(s != stamp for s in right.column("stamp")):
                raise RuntimeError("a chunk did not get the ids of its words: the rows of the input changed between two runs of a task")
            size, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            sizes = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else size
            flat = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint32)
            size[at], first[at] = sizes, np.cumsum(sizes) - sizes
            ends = np.append(0, np.append(0, np.cumsum(size[number]))[np.cumsum(counts)])
            values = flat[_places(first[number], size[number])].astype(np.int32)
            out.append(pa.table({"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))}))
            del counts, number, parts, at, size, first, sizes, flat, values
        give_back()
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.nulls(0), "ids": pa.array([], pa.list_(pa.int32()))}).cast(result)

    result = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("ids", pa.list_(pa.int32()))])
    return cut.groupBy("key").cogroup(_answers(cut, path).groupBy("key")).applyInArrow(assemble, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of an array of ids: ids joined with the pieces, the bytes put together, then read as UTF-8."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                column = b.column(b.schema.get_field_index(ids))
                ends = column.offsets.to_numpy()
                spelled = table.take(column.values.slice(ends[0], ends[-1] - ends[0]))
                found = pa.ListArray.from_arrays(pa.array(ends - ends[0]), spelled, mask=column.is_null() if column.null_count else None)
                text = pa.array([None if x is None else x.decode("utf-8", "replace") for x in pc.binary_join(found, b"").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "decoded"])
        give_back()

    return rows.mapInArrow(spell, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(decoded: DataFrame) -> DataFrame:
    """n_tokens and the hashes of the decimal ids, joined by commas, and of the decoded text."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
