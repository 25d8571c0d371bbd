"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Texts are cut into pre-tokens by the tokenizer's pattern.  A chunk of documents numbers its distinct
pre-tokens in order of appearance and sends each once, to the bucket of its hash; a word common to
the whole corpus therefore reaches its bucket once for each chunk, not once for each use.  The bucket
encodes each of its distinct words once and sends the ids back to the chunks by number.  There the
positions, found by cutting the same texts again, put the ids together.  The texts cross the network
once, compressed; both passes read that one exchange.  Decoding looks each id up in the table of
token bytes, whose size is the vocabulary's, and joins them by position.

Cases: a null text is an empty one and has no ids; ids and rows repeat as often as their rows; very
long texts are cut whole; other columns are not read; bytes that are not UTF-8 become U+FFFD; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binary, chunked, give_back, partitions, unpack

CHUNK_BYTES = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def sent_vocabulary(spark, ranks: dict[bytes, int], pattern: str):
    return spark.sparkContext.broadcast({"ranks": ranks, "pattern": pattern})


def _encoding(vocabulary: dict):
    """The encoder, built once in each Python process."""
    if "encoding" not in vocabulary:
        import tiktoken

        vocabulary["encoding"] = tiktoken.Encoding("own", pat_str=vocabulary["pattern"], mergeable_ranks=vocabulary["ranks"], special_tokens={})
    return vocabulary["encoding"]


def token_bytes(vocabulary: dict) -> dict[int, bytes]:
    if "bytes" not in vocabulary:
        vocabulary["bytes"] = {i: b for b, i in vocabulary["ranks"].items()}
    return vocabulary["bytes"]


def plain(texts: list[bytes | None]) -> list[str]:
    return [t.decode("utf-8", "replace") if t else "" for t in texts]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _numbered(texts: list[str], cut) -> tuple[list[str], list[np.ndarray]]:
    """Distinct pre-tokens by number, and the numbers of each text by position."""
    d, at = _Numbers(), []
    for t in texts:
        words = cut.findall(t)
        at.append(np.fromiter(map(d.__getitem__, words), np.int32, len(words)))
    return list(d), at


def _squeeze(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _loosen(body: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    out, at = [], 8 * n
    for size in struct.unpack_from(f"<{n}q", raw):
        out.append(raw[at : at + size])
        at += size
    return out


def _dealt(distinct: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the words by bucket, the buckets in use and the starts of their words."""
    bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    present, starts = np.unique(bucket[order], return_index=True)
    return order, present.astype(np.int64), starts


def _cut_bytes(lengths: np.ndarray, body: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, ids (little-endian unsigned 32-bit integers) and decoded, the bytes of those ids."""
    spark = docs.sparkSession
    sent = sent_vocabulary(spark, ranks, pattern)
    buckets = 2 * partitions(spark)
    kind_of_id = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32
    kind = docs.schema[doc_id].dataType.simpleString()
    base = chunked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", CHUNK_BYTES)

    def texts_of(body):
        batch = unpack(body.as_buffer())
        return batch.column(0), plain(binary(batch.column(1)).to_pylist())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                distinct = [w.encode() for w in _numbered(texts_of(body)[1], cut)[0]]
                if not distinct:
                    continue
                order, present, starts = _dealt(distinct, buckets)
                bodies = []
                for at in np.split(order, starts[1:]):
                    own = [distinct[i] for i in at]
                    bodies.append(_squeeze(np.fromiter(map(len, own), np.int32, len(own)), b"".join(own)))
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array([chunk] * len(present), pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "chunk", "words"])
        give_back()

    def encode_words(t: pa.Table) -> pa.Table:
        known, asked = _Numbers(), []
        for body in t.column("words"):
            lengths, joined = _loosen(body.as_py(), 2)
            own = _cut_bytes(np.frombuffer(lengths, np.int32), joined)
            asked.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        ids = _encoding(sent.value).encode_ordinary_batch([w.decode() for w in known], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), kind_of_id, int(sizes.sum()))
        ends = np.cumsum(sizes)
        back = [_squeeze(sizes[q].astype(np.int32), flat[_spans(ends[q] - sizes[q], sizes[q])]) for q in asked]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "ids": pa.array(back, pa.binary())})

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        cut, table, out = regex.compile(pattern), token_bytes(sent.value), []
        for body in left.column("body"):
            doc, texts = texts_of(body)
            distinct, at = _numbered(texts, cut)
            order, present, _ = _dealt([w.encode() for w in distinct], buckets)
            answers = dict(zip(right.column("bucket").to_pylist(), right.column("ids"), strict=True))
            parts = [_loosen(answers[k].as_py(), 2) for k in present.tolist()]  # in the order of the words asked
            number = order
            sizes = np.concatenate([np.frombuffer(p[0], np.int32) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            flat = np.concatenate([np.frombuffer(p[1], kind_of_id) for p in parts]) if parts else np.zeros(0, kind_of_id)
            if len(number) != len(sizes):
                raise RuntimeError("words of a chunk changed between two passes")
            ends, place = np.cumsum(sizes), np.empty(len(number), np.int64)
            place[number] = np.arange(len(number))
            first, size = (ends - sizes)[place], sizes[place]
            spelled = list(map(table.__getitem__, flat.tolist()))
            decoded = [b"".join(spelled[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            ids = [flat[_spans(first[w], size[w])].astype("<u4").tobytes() for w in at]
            back = [b"".join(map(decoded.__getitem__, w.tolist())) for w in at]
            out.append(pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"]))
        del texts, distinct, at, flat, spelled, decoded, ids, back
        give_back()
        return pa.Table.from_batches(out)

    asked = base.mapInArrow(words, "bucket long, chunk long, words binary")
    known = asked.groupBy("bucket").applyInArrow(encode_words, "chunk long, bucket long, ids binary")
    return base.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(assemble, f"doc_id {kind}, ids binary, decoded binary")


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of each span, one after the other."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(first - (ends - size), size)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of a column of little-endian unsigned 32-bit ids, by the table of token bytes."""
    sent = sent_vocabulary(rows.sparkSession, ranks, "")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(sent.value)
        for b in batches:
            got = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, "decoded"])

    from pyspark.sql import types as T

    return rows.mapInArrow(spell, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the hashes of ids and decoded bytes."""
    return encoded.select(
        "doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
