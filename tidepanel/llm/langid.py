"""Language identification by nearest centroids.

A text is the vector of its byte trigrams, hashed to ``dimensions`` bins, weighted by 1 + log(count) times
the bin's inverse document frequency and normalised.  Document frequencies are counted over all documents
that may be learned from.  Each language has up to ``clusters`` centroids, fitted by spherical k-means on some
``sample`` of its documents (by hash of id and text, so about that many whatever the input); a text takes the
language of the nearest centroid by cosine.

Rejection by distance: each centroid carries the distance within which all but ``outlying`` of its
language's sample lie; a text farther away is marked ``rejected`` (its nearest language is still given).
A text without a letter is ``und``.

Cases: a null or empty text is ``und`` with score 0; a null language teaches nothing; rows with a null id are never
held out and may be learned from; without any labelled document every text is ``und``; very long texts are read
whole; repeated rows are predicted alike; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binary
from tidepanel.operators.staging import materialize


@dataclass(frozen=True)
class Setting:
    dimensions: int = 4096
    clusters: int = 4
    sample: int = 400
    rounds: int = 12
    outlying: float = 0.002
    languages: int = 1000


def _lower() -> bytes:
    """Upper case to lower, digits and other ASCII signs to a blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


_FOLD = _lower()


def trigram_counts(texts: list[bytes], dimensions: int) -> np.ndarray:
    """Counts of hashed byte trigrams, one row for each text; blanks are single."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, t in enumerate(texts):
        x = np.frombuffer(b" " + b" ".join(t.translate(_FOLD).split()) + b" ", np.uint8).astype(np.uint32)
        if len(x) > 2:
            code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - dimensions.bit_length() + 1)
            out[i] = np.bincount(code, minlength=dimensions)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.maximum(size, 1e-12)).astype(np.float32)


def spherical_kmeans(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Up to k unit centroids; the first is nearest the mean, each next farthest from those before."""
    c = v[[int(np.argmax(v @ v.mean(axis=0)))]]
    while len(c) < min(k, len(v)):
        c = np.vstack([c, v[int(np.argmin((v @ c.T).max(axis=1)))]])
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.vstack([v[own == i].sum(axis=0) for i in range(len(c)) if (own == i).any()])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def has_letter(text: bytes) -> bool:
    if any(c.isalpha() for c in text[:64].decode("latin-1") if c < "\x80"):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's text leaves 2 on division by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, setting: Setting = Setting(), text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict:
    """Model of the languages in ``docs``: idf, centroids, their languages and rejection distances."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"languages": []}
    if len(sizes) > setting.languages:
        raise ValueError(f"{len(sizes)} languages; raise Setting.languages to fit so many")
    share = {k: min(1.0, setting.sample / n) for k, n in sizes.items()}
    dims = setting.dimensions

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(dims, np.int64), 0
        make = lambda ls, bs, kind: pa.RecordBatch.from_arrays([pa.array([kind] * len(ls), pa.int32()), pa.array(ls, pa.string()), pa.array(bs, pa.binary())], ["kind", "lang", "body"])
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                counts = trigram_counts(binary(part.column(0)).to_pylist(), dims)
                df += (counts > 0).sum(axis=0)
                n += part.num_rows
                langs, h = part.column(1).to_pylist(), part.column(2).to_numpy()
                unit = (h.view(np.uint64) >> np.uint64(11)) / float(1 << 53)
                picked = [i for i, k in enumerate(langs) if unit[i] < share[k]]
                if picked:
                    yield make([langs[i] for i in picked], [np.minimum(counts[i], 65535).astype(np.uint16).tobytes() for i in picked], 0)
        if n:
            yield make([""], [np.append(df, n).tobytes()], 1)

    got = materialize(rows.mapInArrow(gather, "kind int, lang string, body binary"))

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("body"))
        return pa.table({"body": pa.array([total.tobytes()], pa.binary())})

    spread = got.where("kind = 1").withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    parts = spread.groupBy("g").applyInArrow(add, "body binary").collect()  # at most 64 sums
    total = sum(np.frombuffer(bytes(r.body), np.int64) for r in parts)
    idf = np.log((1 + total[-1]) / (1 + total[:-1])).astype(np.float32) + np.float32(0.1)

    def cluster(t: pa.Table) -> pa.Table:
        counts = np.vstack([np.frombuffer(x.as_py(), np.uint16) for x in t.column("body")]).astype(np.float32)
        v = vectors(counts, idf)
        c = spherical_kmeans(v, setting.clusters, setting.rounds)
        near = v @ c.T
        least = float(np.quantile(near.max(axis=1), setting.outlying))
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(c)), "least": pa.array([least] * len(c)), "body": pa.array([x.tobytes() for x in c], pa.binary())})

    fitted = got.where("kind = 0").groupBy("lang").applyInArrow(cluster, "lang string, least double, body binary").orderBy("lang", "body").collect()
    return {"languages": [r.lang for r in fitted], "least": np.array([r.least for r in fitted]), "idf": idf,
            "centroids": np.vstack([np.frombuffer(bytes(r.body), np.float32) for r in fitted])}


def predict(docs: DataFrame, model: dict, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score (cosine of the nearest centroid), rejected."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or b"" for t in binary(part.column(2)).to_pylist()]
                lang, score, far = ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
                known = [i for i, t in enumerate(texts) if has_letter(t)] if m["languages"] else []
                if known:
                    near = vectors(trigram_counts([texts[i] for i in known], setting.dimensions), m["idf"]) @ m["centroids"].T
                    best = near.argmax(axis=1)
                    for i, k, s in zip(known, best.tolist(), near.max(axis=1).tolist(), strict=True):
                        lang[i], score[i], far[i] = m["languages"][k], min(max(s, 0.0), 1.0), s < m["least"][k]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array([bool(x) for x in far], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """Learn from the labelled documents that are not held out; predict all."""
    return predict(docs, fit(docs.where(~held_out()), setting), setting)
