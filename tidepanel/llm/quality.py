"""Quality rules: divergence of a document's character classes and common words from its language.

References are learned from all documents: for each language the histogram of character
classes and of its common words (those with at least ``common_share`` of the language's words,
so at most ``1 / common_share`` of them).  A language has a reference of its own with
``language_share`` of the documents or with ``reference_words`` words, whatever its share then; of more
than ``most_references`` such languages the ones with the most words have one.  A document is
judged by the Jensen-Shannon distance (base 2, so 0 to 1) of its two histograms from the
reference, each only from a minimum length on: short texts say too little.

A document without such a language says nothing about its script or its common words.  Its words
are not judged (null), and its characters only by what all scripts have in common: letters and
blanks are one class, a text with no smaller share of it than the reference has distance 0, and
the nearest of all references counts, that of all documents together among them.

Cases: a null text has no words and fails the base rules; an empty text likewise; a null lang
has no reference of its own; repeated rows are judged alike and each kept or not; other columns,
whatever their names, pass through ``keep`` untouched.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binary, give_back
from tidepanel.operators.staging import materialize

CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    common_share: float = 1 / 400
    language_share: float = 1 / 200
    reference_words: int = 10_000
    most_references: int = 1_000
    char_guard: int = 500
    word_guard: int = 100
    max_char_distance: float = 0.24
    max_word_distance: float = 0.37


def _tables() -> tuple[np.ndarray, bytes]:
    of = np.full(256, 7, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:!?'\"()-")):
        of[list(chars)] = k
    of[[c for c in range(33, 127) if of[c] == 7]] = 6
    of[128:192] = 8  # bytes that continue a code point
    low = bytearray(range(256))
    for c in range(256):
        low[c] = ord(chr(c).lower()) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
    return of, bytes(low)


_CLASS, _PLAIN = _tables()


def _classes(text: bytes) -> np.ndarray:
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(_CLASS, seen, 9)[:8]


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more in the text, the first one included."""
    if len(words) <= n:
        return 0
    d: dict[bytes, int] = {}
    ids = np.fromiter(map(d.setdefault, words, count()), np.int64, len(words))
    window = ids
    for j in range(1, n):  # windows are renumbered each time they widen, so the numbers neither overflow nor collide
        wide = window[:-1] * len(words) + ids[j:]
        _, window, times = np.unique(wide, return_inverse=True, return_counts=True)
        if len(times) == len(window):
            return 0
    at = np.flatnonzero(times[window] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + n] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: bytes | None) -> tuple[list[bytes], int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if text is None:
        return [], 0, 0, 0, 0
    words = text.split()
    joined = b"".join(words)
    chars = int((np.frombuffer(joined, np.int8) >= -64).sum())
    symbols = sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return words, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


#: Rows that count documents, classes and words; a plain word never holds that sign.
_HEAD = "substring(word, 1, 1) = X'23'"


def references(docs: DataFrame, rules: Rules = Rules(), doc_text: str = "text", lang: str = "lang") -> dict[str | None, tuple[np.ndarray, dict[bytes, float]]]:
    """Reference histograms by language; None is the pooled one, of classes only.  Their size is bounded by ``common_share`` and ``most_references``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            ks, ws, ns = [], [], []
            for k, (n_docs, classes, words) in held.items():
                for w, n in (("#docs", n_docs), *((f"#{i}", int(c)) for i, c in enumerate(classes)), ("#words", sum(words.values()))):
                    ks.append(k), ws.append(w.encode()), ns.append(n)
                for w, n in words.items():
                    ks.append(k), ws.append(w), ns.append(n)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(ws, pa.binary()), pa.array(ns, pa.int64())], ["lang", "word", "n"])

        held: dict = {}
        for b in batches:
            for lang_, text in zip(b.column(0).to_pylist(), binary(b.column(1)).to_pylist(), strict=True):
                if text:
                    if lang_ not in held:
                        held[lang_] = [0, np.zeros(8), Counter()]
                    h = held[lang_]
                    h[0] += 1
                    h[1] += _classes(text)
                    h[2].update(text.translate(_PLAIN).split())
            if sum(len(h[2]) for h in held.values()) > 500_000:
                yield rows()
        if held:
            yield rows()
        give_back()

    got = docs.select(F.col(lang).cast("string").alias("lang"), F.col(doc_text).alias("text")).mapInArrow(gather, "lang string, word binary, n long")
    counts = materialize(got.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    heads = counts.where(F.expr(_HEAD)).collect()
    size = {(r.lang, bytes(r.word)): r.n for r in heads}
    n_docs = sum(n for (_, w), n in size.items() if w == b"#docs")
    return {} if not n_docs else _fit(counts, size, n_docs, rules)


def _fit(counts, size, n_docs, rules):
    fit = {k for k, w in size if k is not None and (size[(k, b"#docs")] >= rules.language_share * n_docs or size[(k, b"#words")] >= rules.reference_words)}
    own = sorted(sorted(fit, key=lambda k: (-size[(k, b"#words")], k))[: rules.most_references])
    out = {}
    cut = {k: max(1, rules.common_share * size[(k, b"#words")]) for k in own}
    picked = counts.where(~F.expr(_HEAD))
    common: dict = defaultdict(dict)
    if own:
        least = F.create_map(*[F.lit(x) for k in own for x in (k, float(cut[k]))])
        for r in picked.where(F.col("lang").isin(own) & (F.col("n") >= F.element_at(least, F.col("lang")))).collect():
            common[r.lang][bytes(r.word)] = r.n
    for k in [*own, None]:
        classes = np.array([size[(k, b"#%d" % i)] if k is not None else sum(n for (_, w), n in size.items() if w == b"#%d" % i) for i in range(8)], float)
        words = {w: n / size[(k, b"#words")] for w, n in sorted(common[k].items())}
        out[k] = (classes / max(classes.sum(), 1), words)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))
    return float(np.sqrt(min(max(d / 2, 0.0), 1.0)))


def _any_script(classes: np.ndarray) -> np.ndarray:
    """The histogram with letters of all scripts and blanks as one class, the first."""
    text = [CLASSES.index(c) for c in ("lower", "upper", "blank", "other")]
    return np.append(classes[text].sum(), np.delete(classes, text))


class Judge:
    """Counts and verdict of one text against the references."""

    def __init__(self, refs: dict, rules: Rules):
        self.rules = rules
        self.refs = {}
        for k, (classes, words) in refs.items():
            shares = np.fromiter(words.values(), float, len(words))
            self.refs[k] = (classes, {w: i for i, w in enumerate(words)}, np.append(shares, max(0.0, 1 - shares.sum())))
        self.scripts = np.unique([_any_script(classes) for classes, _ in refs.values()], axis=0) if refs else []

    def _from_any(self, classes: np.ndarray) -> float:
        own = _any_script(classes)
        return 0.0 if own[0] >= min(r[0] for r in self.scripts) else min(js_distance(own, r) for r in self.scripts)

    def __call__(self, text: bytes | None, lang: str | None) -> tuple:
        rules = self.rules
        words, chars, symbols, dup, rep = base_counts(text)
        failed = len(words) < rules.min_words or 100 * rep > rules.max_repeat_percent * len(words)
        far_chars = far_words = None
        if text and self.refs:
            fits = lang is not None and lang in self.refs
            classes, at, shares = self.refs[lang if fits else None]
            own = _classes(text)
            if own.sum() >= rules.char_guard:
                far_chars = js_distance(own / own.sum(), classes) if fits else self._from_any(own / own.sum())
            plain = text.translate(_PLAIN).split() if at else []
            if len(plain) >= rules.word_guard and at:
                seen = np.bincount(np.fromiter((at.get(w, len(at)) for w in plain), np.int64, len(plain)), minlength=len(at) + 1)
                far_words = js_distance(seen / len(plain), shares)
        kept = not failed and (far_chars or 0) <= rules.max_char_distance and (far_words or 0) <= rules.max_word_distance
        return len(words), chars, symbols, dup, rep, failed, far_chars, far_words, kept


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def quality(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each document: its id, counts, distances (null below the minimum length, that of words also without a reference) and verdict."""
    refs = references(docs, rules, text, lang)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, kinds = Judge(refs, rules), [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        names = [x.split()[0] for x in _OUT.split(", ")]
        for b in batches:
            got = [one(t, k) for t, k in zip(binary(b.column(1)).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = list(zip(*got, strict=True)) if got else [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return picked.mapInArrow(judge, f"doc_id {kind}, {_OUT}")


def keep(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns as they were."""
    refs = references(docs, rules, text, lang)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Judge(refs, rules)
        for b in batches:
            at, of = b.schema.get_field_index(text), b.schema.get_field_index(lang)
            mask = [one(t, k)[-1] for t, k in zip(binary(b.column(at)).to_pylist(), b.column(of).to_pylist(), strict=True)]
            yield b.filter(pa.array(mask, pa.bool_()))
        give_back()

    return docs.mapInArrow(sift, docs.schema)
