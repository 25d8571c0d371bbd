"""Fill-in-the-middle transformation of documents, cut through memoised content-defined chunks.

A text is a run of units: blanks with the word behind them, and blanks at the end.  To cut it after a given
number of units the text need not be walked: a rolling hash over its bytes ends a chunk where the hash has its
low bits clear, so the same passage falls into the same chunks wherever it stands, and what a chunk adds to the
counts is a small summary: units that end inside it, code points, and whether it begins or ends with a word.
Summaries are kept in a cache of each task by the chunk's hash; a hit is taken only when the cached bytes equal
the chunk.  Sums of summaries, with one unit more where a word stops at a chunk's edge, give the number of units
before each chunk, which locates the chunk of each cut; only those chunks are walked.

The cache holds ``cache_bytes`` of chunks at most and is emptied when full, which changes no result.  There is
no shuffle: a lost executor repeats its splits only.

Cases: a null or empty text is plain with no unit; a text that holds a sentinel is plain; a null id has the
digest of an empty one; rows repeat as often as their rows; very long texts are cut whole, bytes that are not
UTF-8 stay as they are; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binary, give_back, mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Setting:
    seed: int = 42
    rate: int = 50  # of 100 documents, those that are transformed
    spm: int = 80  # of 100 transformed ones, those with the suffix first
    chunk_bits: int = 8  # a chunk has some 2^chunk_bits bytes
    cache_bytes: int = 64 << 20


_ROWS = 200  # texts transformed at once
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def chunk_ends(raw: np.ndarray, bits: int) -> np.ndarray:
    """Ends of the chunks of a byte array: a hash of the last 16 bytes, doubled window by window, has its low bits clear."""
    h = _GEAR[raw]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += (h[:-width] << np.uint32(width)) if len(h) > width else np.zeros(0, np.uint32)
        h = wider
    ends = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """(units that end inside, code points, begins with a word, ends with a word) of a chunk that is not empty."""
    raw = np.frombuffer(chunk, np.uint8)
    word = ~_BLANK[raw]
    return int((word[:-1] & ~word[1:]).sum()), int(((raw & 0xC0) != 0x80).sum()), bool(word[0]), bool(word[-1])


class Summaries:
    """Summaries by content: found by hash, taken when the bytes are equal."""

    def __init__(self, most: int):
        self.most, self.held, self.known = most, 0, {}

    def of(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        key = xxhash.xxh3_64_intdigest(chunk)
        found = self.known.get(key)
        if found is not None and found[0] == chunk:
            return found[1]
        got = summary(chunk)
        if self.held + len(chunk) > self.most:
            self.known.clear()
            self.held = 0
        if found is None or key not in self.known:
            self.known[key] = chunk, got
            self.held += len(chunk)
        return got


class Layout:
    """Units and code points of one text by chunk, and the places of cuts in it."""

    def __init__(self, text: bytes, known: Summaries, bits: int):
        self.text = text
        self.ends = chunk_ends(np.frombuffer(text, np.uint8), bits) if text else np.zeros(0, np.int64)
        parts = [known.of(text[a:b]) for a, b in zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True)] if text else []
        self.inside = np.array([p[0] for p in parts], np.int64)
        self.points = np.cumsum([0, *(p[1] for p in parts)])
        begins, closes = np.array([p[2] for p in parts], bool), np.array([p[3] for p in parts], bool)
        # A word that fills the end of a chunk ends there when the next one begins with a blank or there is none.
        self.at_edge = closes & ~np.append(begins[1:], False)
        self.units = np.cumsum(self.inside + self.at_edge) if parts else np.zeros(0, np.int64)
        self.n = int(self.units[-1]) + (not closes[-1]) if parts else 0

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        if k <= 0:
            return 0, 0
        if k >= self.n:
            return len(self.text), int(self.points[-1])
        c = int(np.searchsorted(self.units, k))
        start, end = int(self.ends[c - 1]) if c else 0, int(self.ends[c])
        raw = np.frombuffer(self.text, np.uint8)[start:end]
        word = ~_BLANK[raw]
        after = k - (int(self.units[c - 1]) if c else 0)
        stops = np.flatnonzero(word & ~np.append(word[1:], not self.at_edge[c])) + 1
        at = int(stops[after - 1])
        return start + at, int(self.points[c]) + int(((raw[:at] & 0xC0) != 0x80).sum())


def fill_in_middle(docs: DataFrame, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    kind = docs.schema[doc_id].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{setting.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest.alias("_digest")).select("doc_id", "text", *draws)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Summaries(setting.cache_bytes)
        for b in (batch.slice(lo, _ROWS) for batch in batches for lo in range(0, batch.num_rows, _ROWS)):
            draws = [b.column(i).to_pylist() for i in range(2, 6)]
            out: list[list] = [[], [], [], [], []]
            for t, h1, h2, h3, h4 in zip(binary(b.column(1)).to_pylist(), *draws, strict=True):
                t = t or b""
                layout = Layout(t, known, setting.chunk_bits)
                n = layout.n
                if not t or h3 % 100 >= setting.rate or any(m in t for m in marks):
                    row = n, "plain", None, None, t
                else:
                    (p, p_chars), (q, q_chars) = layout.cut(min(h1 % (n + 1), h2 % (n + 1))), layout.cut(max(h1 % (n + 1), h2 % (n + 1)))
                    head, middle, tail = marks[0] + t[:p], marks[2] + t[p:q], marks[1] + t[q:]
                    spm = h4 % 100 < setting.spm
                    row = n, "spm" if spm else "psm", p_chars, q_chars - p_chars, tail + head + middle if spm else head + tail + middle
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)] + [pa.array(out[4], pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    return rows.mapInArrow(turn, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text behind an output and its form.  Sentinels cannot overlap each other or stand in a transformed text, so the first of each kind is the one set here."""
    out, behind = F.col(output), lambda mark: F.expr(f"substring(`{output}`, locate('{mark}', `{output}`) + {len(mark)})")
    middle = behind(MIDDLE)
    psm = F.concat(F.substring_index(F.expr(f"substring(`{output}`, {len(PREFIX) + 1})"), SUFFIX, 1), middle, F.substring_index(behind(SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(behind(PREFIX), MIDDLE, 1), middle, F.substring_index(F.expr(f"substring(`{output}`, {len(SUFFIX) + 1})"), PREFIX, 1))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", psm).otherwise(spm)


def digests(rows: DataFrame) -> DataFrame:
    """The rows with the hashes of the output and of the text restored from it, in place of the output."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    )


FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q FROM d),
c AS (SELECT *, array_to_string(list_slice(u, 1, p), '') AS a, array_to_string(list_slice(u, p + 1, q), '') AS b, array_to_string(list_slice(u, q + 1, n), '') AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
