"""Substring de-duplication by seed and extend.

A repeat is a sequence of ``length`` or more words that also starts in a document with a smaller
id; every word of a later document inside a repeat is removed, so maximal repeats go whole.

1. Seed.  Each window of ``length`` words selects one winnowed anchor, the ``seed``-word gram with
   the smallest hash in it, so equal windows select equal anchors.  Windows that share an anchor
   form a run, and the run's context is the text they reach over.  A chunk of documents sends each
   distinct (anchor, context) once, with its smallest document.
2. Join.  Anchors meet in hash buckets.  An anchor of a single document is dropped.  Otherwise
   every chunk learns the smallest document of its (anchor, context): for all later documents the
   match extends over the whole run.  Where an anchor has several contexts, matches end inside the
   run, and the one document that owns a context must be extended word by word.
3. Extend.  Owners send the windows of such runs, both ways from the anchor, once for each
   distinct window, and learn the smallest document of each.
4. Words under a matched window go; neighbouring windows merge into maximal repeats.

No pair of documents is ever formed, so a passage that n documents share costs n, not n squared.
An anchor with more than ``local_contexts`` contexts within one chunk (the edge of a common
passage) sends a single mark instead of its contexts and is extended by windows, so what one
bucket gathers for an anchor is bounded by the number of chunks.  Anchors are keyed by two 64-bit
hashes with their context, windows by two.

Cases: null and empty texts have no words and lose none; texts shorter than ``length`` neither lose
nor remove anything; equal ids are not smaller than each other, so repeated rows leave each other
alone; a null id counts as larger than all others; further columns pass through untouched; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import binary, by_bucket, chunked, flat, give_back, grams, hash_words, lists, mix, partitions, unpack

_LAST = np.iinfo(np.int64).max
CHUNK_BYTES = 3 << 20


def _lookup(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray) -> np.ndarray:
    """Place of each (a, b) among the distinct keys, or -1."""
    if not len(keys_a) or not len(a):
        return np.full(len(a), -1)
    k = mix(keys_a) + keys_b
    order = np.argsort(k)
    at = np.minimum(np.searchsorted(k[order], mix(a) + b), len(k) - 1)
    at = order[at]
    return np.where((keys_a[at] == a) & (keys_b[at] == b), at, -1)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and the starts of equal runs; the first key is the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


class _Scan:
    """Words, windows and anchor runs of the documents of one chunk."""

    def __init__(self, batch: pa.RecordBatch, doc_id: str, text: str, length: int, seed: int):
        ids = batch.column(batch.schema.get_field_index(doc_id)).cast(pa.int64())
        self.docs = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.words = [t.split() if t else [] for t in binary(batch.column(batch.schema.get_field_index(text))).to_pylist()]
        self.ends = np.cumsum([0, *map(len, self.words)])
        h = hash_words(itertools.chain.from_iterable(self.words), int(self.ends[-1]))
        of = np.repeat(np.arange(len(self.docs)), np.diff(self.ends))
        m = max(0, len(h) - length + 1)
        inside = np.flatnonzero(of[:m] == of[length - 1 :]) if m else np.zeros(0, np.int64)
        self.k1, self.k2 = grams(h, length, 1)[inside], grams(h, length, 2)[inside]
        g = grams(h, seed, 3)
        best, off = g[:m].copy(), np.zeros(m, np.int64)
        for j in range(1, length - seed + 1):
            c = g[j : j + m]
            lower = c <= best
            best[lower] = c[lower]
            off[lower] = j
        self.start, off = inside, off[inside]
        anchor = inside + off
        self.first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
        self.run = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(anchor))))
        self.h = best[inside][self.first]
        part = mix(self.k1 + (off.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.ctx = mix(np.add.reduceat(part, self.first)) if len(anchor) else part
        self.window_doc = self.docs[of[inside]]
        self.doc = self.window_doc[self.first]

    def records(self, local: int):
        """Distinct (anchor, context) with smallest document and whether several; mark of anchors with many contexts."""
        order, at = _groups(self.h, self.ctx)
        h, ctx = self.h[order][at], self.ctx[order][at]
        low = np.minimum.reduceat(self.doc[order], at) if len(at) else self.doc
        many = (np.maximum.reduceat(self.doc[order], at) if len(at) else self.doc) > low
        _, lead, n = np.unique(h, return_index=True, return_counts=True)
        hot = np.repeat(n > local, n)
        self.hot = np.sort(h[lead[n > local]])
        low_of = np.minimum.reduceat(low, lead)[n > local] if len(lead) else low
        marks = len(self.hot)
        return (np.append(h[~hot], self.hot), np.append(ctx[~hot], np.zeros(marks, np.uint64)), np.append(low[~hot], low_of),
                np.append(many[~hot].astype(np.int8), np.full(marks, 2, np.int8)))

    def state(self, reply: dict, local: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run: is it covered whole, and must its windows be extended?"""
        self.records(local)
        hot = np.isin(self.h, self.hot)
        at = _lookup(self.h, self.ctx, reply["h"], reply["ctx"])
        if not len(reply["h"]):
            return np.zeros(len(self.h), bool), hot
        low = np.where(at >= 0, reply["doc"][at], _LAST)
        covered = ~hot & (at >= 0) & (low < self.doc)
        return covered, hot | ((at >= 0) & (reply["flag"][at] > 0) & ~covered)


_SENT = "bucket long, chunk long, h array<long>, ctx array<long>, doc array<long>, flag array<tinyint>"


def _send(key: str, to: np.ndarray, starts: np.ndarray, cols: list[np.ndarray], other_name: str, other: int) -> pa.RecordBatch:
    """One row for each destination with its records as arrays."""
    names = [key, other_name, "h", "ctx", "doc", "flag"]
    arrays = [pa.array(to, pa.int64()), pa.array(np.full(len(to), other), pa.int64())]
    arrays += [lists(c.view(np.int64) if c.dtype == np.uint64 else c, starts, pa.int8() if c.dtype == np.int8 else pa.int64()) for c in cols]
    return pa.RecordBatch.from_arrays(arrays, names)


def _records(t: pa.Table) -> dict[str, np.ndarray]:
    out = {n: flat(t.column(n)) for n in ("h", "ctx", "doc", "flag")}
    return {n: c.view(np.uint64) if n in ("h", "ctx") else c for n, c in out.items()}


def _to_buckets(chunk: int, cols: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    if not len(cols[0]):
        return None
    order, present, starts = by_bucket(mix(cols[0]), buckets)
    return _send("bucket", present, starts, [c[order] for c in cols], "chunk", chunk)


def _to_chunks(cols: list[np.ndarray], chunk: np.ndarray) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    present, starts = np.unique(chunk[order], return_index=True)
    b = _send("chunk", present, np.append(starts, len(order)), [c[order] for c in cols], "kind", 0)
    return pa.Table.from_batches([b])


def _run(docs: DataFrame, doc_id: str, text: str, length: int, seed: int, local: int, schema: T.StructType | str, emit: Callable) -> DataFrame:
    base = chunked(docs, text, CHUNK_BYTES)
    buckets = 4 * partitions(docs.sparkSession)
    scan = lambda body: _Scan(unpack(body), doc_id, text, length, seed)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = _to_buckets(chunk, list(scan(body.as_buffer()).records(local)), buckets)
                if out is not None:
                    yield out
        give_back()

    def join(t: pa.Table) -> pa.Table:
        r = _records(t)
        chunk = np.repeat(t.column("chunk").to_numpy(), t.column("h").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        order, at = _groups(r["h"], r["ctx"])
        r, chunk = {k: v[order] for k, v in r.items()}, chunk[order]
        size = np.diff(np.append(at, len(order)))
        low = np.minimum.reduceat(r["doc"], at)
        _, lead, contexts = np.unique(r["h"][at], return_index=True, return_counts=True)
        of_h = np.repeat(np.arange(len(lead)), contexts)
        h_low, h_high = np.minimum.reduceat(low, lead), np.maximum.reduceat(np.maximum.reduceat(r["doc"], at), lead)
        mark = np.maximum.reduceat(np.maximum.reduceat(r["flag"], at), lead)
        shared, opened = (h_high > h_low) | (mark > 0), (contexts > 1) | (mark > 1)
        row = np.repeat(np.arange(len(at)), size)
        useful = shared[of_h][row] & (r["flag"] < 2) & (opened[of_h][row] | (r["doc"] > low[row]) | (r["flag"] == 1))
        cols = [r["h"][useful], r["ctx"][useful], low[row][useful], opened[of_h][row][useful].astype(np.int8)]
        return _to_chunks(cols, chunk[useful])

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out, reply = [], _records(right)
        for chunk, body in zip(left.column("chunk").to_pylist(), left.column("body"), strict=True):
            s = scan(body.as_buffer())
            at = np.flatnonzero(s.state(reply, local)[1][s.run])
            order, lead = _groups(s.k1[at], s.k2[at])
            at = at[order]
            if len(at):
                low, high = np.minimum.reduceat(s.window_doc[at], lead), np.maximum.reduceat(s.window_doc[at], lead)
                out.append(_to_buckets(chunk, [s.k1[at][lead], s.k2[at][lead], low, (high > low).astype(np.int8)], buckets))
            del s
        give_back()
        return pa.Table.from_batches(out, schema=_arrow(_SENT))

    def meet(t: pa.Table) -> pa.Table:
        r = _records(t)
        chunk = np.repeat(t.column("chunk").to_numpy(), t.column("h").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        order, at = _groups(r["h"], r["ctx"])
        r, chunk = {k: v[order] for k, v in r.items()}, chunk[order]
        low = np.repeat(np.minimum.reduceat(r["doc"], at), np.diff(np.append(at, len(order))))
        useful = (r["doc"] > low) | (r["flag"] > 0)
        return _to_chunks([r["h"][useful], r["ctx"][useful], low[useful], np.full(int(useful.sum()), 2, np.int8)], chunk[useful])

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        r, out = _records(right), []
        runs, windows = ({k: v[m] for k, v in r.items()} for m in (r["flag"] < 2, r["flag"] == 2))
        for body in left.column("body"):
            batch = unpack(body.as_buffer())
            s = _Scan(batch, doc_id, text, length, seed)
            covered, opened = s.state(runs, local)
            hit = covered[s.run]
            at = np.flatnonzero(opened[s.run])
            found = _lookup(s.k1[at], s.k2[at], windows["h"], windows["ctx"])
            if len(windows["h"]):
                hit[at] = (found >= 0) & (windows["doc"][found] < s.window_doc[at])
            edge = np.zeros(s.ends[-1] + 1, np.int64)
            edge[s.start[hit]] += 1
            np.add.at(edge, s.start[hit] + length, -1)
            out.append(emit(batch, s.words, s.ends, np.cumsum(edge)[:-1] > 0))
        del s, batch
        give_back()
        return pa.Table.from_batches(out)

    reply = "chunk long, kind long, h array<long>, ctx array<long>, doc array<long>, flag array<tinyint>"
    first = base.mapInArrow(seeds, _SENT).groupBy("bucket").applyInArrow(join, reply)
    opened = base.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(extend, _SENT)
    second = opened.groupBy("bucket").applyInArrow(meet, reply)
    return base.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(strip, schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<tinyint>": pa.list_(pa.int8())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _texts(words, ends, gone) -> tuple[list[bytes], np.ndarray]:
    """Kept words of each document joined by one space, and how many went."""
    lost = np.add.reduceat(np.append(gone, False).astype(np.int64), ends[:-1]) if len(words) else np.zeros(0, np.int64)
    lost[np.diff(ends) == 0] = 0
    out = []
    for i, ws in enumerate(words):
        if lost[i]:
            g = gone[ends[i] : ends[i + 1]].tolist()
            ws = [w for w, x in zip(ws, g, strict=True) if not x]
        out.append(b" ".join(ws))
    return out, lost


def substring_dedup(docs: DataFrame, length: int = 13, seed: int = 6, doc_id: str = "doc_id", text: str = "text", local_contexts: int = 8) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed and kept_text, its kept words joined by one space."""

    def emit(batch, words, ends, gone):
        kept, lost = _texts(words, ends, gone)
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends), pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _run(picked, "doc_id", "text", length, seed, local_contexts, "doc_id long, n_words long, n_removed long, kept_text string", emit)


def strip_repeats(docs: DataFrame, length: int = 13, seed: int = 6, doc_id: str = "doc_id", text: str = "text", chars: str = "n_chars", local_contexts: int = 8) -> DataFrame:
    """The documents with their columns: a text that holds repeats becomes its kept words joined by one space, ``chars``
    (if there) the length of that text, and a document of which nothing is left goes.  Other texts stay as they were."""

    def emit(batch, words, ends, gone):
        kept, lost = _texts(words, ends, gone)
        changed = pa.array(lost > 0)
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        new = pa.array(kept, pa.binary()).cast(cols[text].type)
        if chars in cols:
            cols[chars] = pc.if_else(changed, pc.utf8_length(new).cast(cols[chars].type), cols[chars])
        cols[text] = pc.if_else(changed, new, cols[text])
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array((lost == 0) | (lost < np.diff(ends))))

    return _run(docs, doc_id, text, length, seed, local_contexts, docs.schema, emit)
