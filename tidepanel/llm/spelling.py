"""Spelling variants of the words of a corpus, found in a trie of letter-group counts.

Two words are near when one inserted, deleted or replaced code point turns one into the other.  Then their
counts of letters by group differ by a surplus of one, a deficit of one, or one of each, at most.  Words stand
in a trie whose levels are the groups, each child one count of the next group.  A search goes down the trie
depth first with a budget of one surplus and one deficit, and the words of the leaves it reaches are verified
letter by letter.

A search spends its surplus before its deficit, so each pair is met once: of words of different length the
shorter one searches, of equally long ones the one with the smaller count at the first level where they differ,
of words with equal counts the smaller one.

The upper levels of the trie are keys of a shuffle: a word is stored at its own node and sent, as a search, to
the nodes that its budget reaches.  The number of shuffled levels follows the number of words, and a node with too
many stored words or searches is dealt by hash into slices of ``slice_rows``, every slice of the ones meeting
every slice of the others, so a task holds a bounded number of words and nothing is capped.  In a task all the
searches of a slice go down its trie together, node after node.

Counts come from one scan of the texts with sums kept in each task and emptied when full.  Chains of forms are
followed by doubling; a form is at least ``ratio`` times as frequent as its word, so they are short.

Cases: null and empty texts have no words; a null id counts as an empty one in the digest that damages words; a
repeated row counts again; runs of any length are words; bytes that are not UTF-8 separate words; ties are
settled by code points; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binary, give_back
from tidepanel.operators.staging import materialize

#: Levels of the trie: letters by how often they are used in European texts, then all others in four groups by code point.
LETTERS = "eaionrtslducmpghbvfykwzxqj"
_LEVEL_OF = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % 4 for c in range(256)])
LEVELS = len(LETTERS) + 4


@dataclass(frozen=True)
class Setting:
    least_letters: int = 7
    least_count: int = 2
    ratio: int = 10
    damage: int = 31  # one of so many (document, run) loses a letter
    slice_rows: int = 100_000
    held_words: int = 200_000  # sums kept in a task before they are passed on


def counted(docs: DataFrame, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{setting.least_letters},}}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], ["word", "n"])
            known.clear()
            return out

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), binary(b.column(1)).to_pylist(), strict=True):
                if not t:
                    continue
                head, seen = zlib.crc32(f"{doc or ''}:".encode()), {}
                for w in run.findall(t.lower().decode("utf-8", "replace")):
                    seen[w] = seen.get(w, 0) + 1
                for w, n in seen.items():
                    h = zlib.crc32(w.encode(), head)
                    if h % setting.damage == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < setting.least_letters:
                            continue
                    known[w] = known.get(w, 0) + n
                if len(known) > setting.held_words:
                    yield emptied()
        if known:
            yield emptied()
        give_back()

    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= setting.least_count)


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of counts by level for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    at = np.repeat(np.arange(len(words)), sizes) * LEVELS + _LEVEL_OF[codes]
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else i < len(a) and a[i + 1 :] == b[i + 1 :]


_WIDTH = 40  # letters of the words that are verified as rows of a matrix


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each word, zero behind its end (longer words are cut), and the lengths."""
    raw = b"".join(w[:_WIDTH].encode("latin-1").ljust(_WIDTH, b"\0") for w in words)
    return np.frombuffer(raw, np.uint8).reshape(-1, _WIDTH), np.fromiter(map(len, words), np.int64, len(words))


def near_rows(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """``near`` of rows of words of one matrix width; where ``longer`` the second word has one letter more, else they are equally long."""
    differ = a != b
    first = np.where(differ.any(1), differ.argmax(1), _WIDTH)
    behind = (a[:, :-1] != b[:, 1:])[:, ::-1]
    last = np.where(behind.any(1), _WIDTH - 2 - behind.argmax(1), -1)
    return np.where(longer, last < first, differ.sum(1) == 1)


def reached(counts: tuple[int, ...]) -> set[tuple[int, ...]]:
    """Upper nodes that a search reaches: no difference up to here, a surplus, or a surplus and a deficit behind it."""
    out = {counts}
    for i in range(len(counts)):
        more = counts[:i] + (counts[i] + 1,) + counts[i + 1 :]
        out.add(more)
        out.update(more[:j] + (more[j] - 1,) + more[j + 1 :] for j in range(i + 1, len(counts)) if more[j])
    return out


def _odd(counts: np.ndarray) -> np.ndarray:
    """A bit for each level, set where the count is odd."""
    return ((counts & 1).astype(np.uint64) << np.arange(LEVELS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def search(stored: list[str], asked: list[str], leaf: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (asked, stored) of the pairs whose counts the budget allows and whether the counts are equal, subtree by subtree, depth first."""
    have, want = letter_counts(stored), letter_counts(asked)
    order = np.lexsort(have.T[::-1])
    have = have[order]
    have_odd, want_odd, have_size, want_size = _odd(have), _odd(want), have.sum(1), want.sum(1)
    # (level, first and last place, searches, whether the surplus and the deficit are spent)
    stack = [(0, 0, len(stored), np.arange(len(asked)), np.zeros(len(asked), bool), np.zeros(len(asked), bool))]
    while stack:
        level, lo, hi, who, more, less = stack.pop()
        if level == LEVELS or hi - lo <= leaf:
            # The paths below are few: odd and even counts and lengths show which are worth walking.
            step = max(1, 400_000 // max(1, hi - lo))
            for at in range(0, len(who), step):
                part = who[at : at + step]
                flips = np.bitwise_count(have_odd[None, lo:hi] ^ want_odd[part, None])
                longer = have_size[None, lo:hi] - want_size[part, None]
                q, s = np.nonzero(((longer == 1) & (flips == 1)) | ((longer == 0) & ((flips == 0) | (flips == 2))))
                q, s = part[q], lo + s
                gap = have[s] - want[q]
                size, first = np.abs(gap).sum(1), np.argmax(gap != 0, 1)
                good = (size <= 2) & ((size == 0) | (gap[np.arange(len(q)), first] > 0))
                if good.any():
                    yield q[good], order[s[good]], size[good] == 0
            continue
        column = have[lo:hi, level]
        starts = np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), hi - lo], strict=True):
            gap = column[a] - want[who, level]
            alive = np.flatnonzero((gap == 0) | ((gap == 1) & ~more) | ((gap == -1) & more & ~less))
            if len(alive):
                own = gap[alive]
                stack.append((level + 1, lo + a, lo + b, who[alive], more[alive] | (own == 1), less[alive] | (own == -1)))


def near_pairs(words: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of near words, each once, of a table of distinct (word, n)."""
    total = words.count()
    levels = min(LEVELS, max(1, int(np.ceil(np.log2(max(2, total / setting.slice_rows))))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                words, ns = b.column(0).to_pylist(), b.column(1).to_pylist()
                out: list[list] = [[], [], [], []]
                for word, n, counts in zip(words, ns, letter_counts(words)[:, :levels].tolist(), strict=True):
                    counts = tuple(counts)
                    for asks, node in [(False, counts), *((True, c) for c in reached(counts))]:
                        for column, value in zip(out, (",".join(map(str, node)), asks, word, n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], ["node", "asks", "word", "n"])
        give_back()

    sent = materialize(words.select("word", "n").mapInArrow(send, "node string, asks boolean, word string, n long"))
    slices = lambda kind: F.ceil(F.count(F.when(kind, 1)) / setting.slice_rows).cast("int")
    nodes = sent.groupBy("node").agg(slices(~F.col("asks")).alias("stored"), slices(F.col("asks")).alias("asked")).where("stored > 0 and asked > 0")
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = sent.join(nodes, "node").withColumn("i", F.explode(F.when(F.col("asks"), all_of("stored")).otherwise(F.array(own("stored")))))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("asks"), F.array(own("asked"))).otherwise(all_of("asked"))))

    def meet(t: pa.Table) -> pa.Table:
        asks = t.column("asks").combine_chunks()
        left, right = t.filter(asks), t.filter(pc.invert(asks))
        asked, stored = left.column("word").to_pylist(), right.column("word").to_pylist()
        found_q, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if asked and stored:
            (a_rows, a_len), (b_rows, b_len) = spelled(asked), spelled(stored)
            for qs, ss, equal in search(stored, asked):
                for lo in range(0, len(qs), 20_000):
                    q, s, same = qs[lo : lo + 20_000], ss[lo : lo + 20_000], equal[lo : lo + 20_000]
                    good = near_rows(a_rows[q], b_rows[s], b_len[s] > a_len[q])
                    for i in np.flatnonzero(b_len[s] > _WIDTH).tolist():
                        good[i] = near(asked[q[i]], stored[s[i]])
                    for i in np.flatnonzero(good & same).tolist():
                        good[i] = asked[q[i]] < stored[s[i]]
                    found_q.append(q[good])
                    found_s.append(s[good])
        found_q, found_s = np.concatenate(found_q), np.concatenate(found_s)
        left, right = left.select(["word", "n"]).take(pa.array(found_q, pa.int64())), right.select(["word", "n"]).take(pa.array(found_s, pa.int64()))
        return pa.table({"a": left.column(0), "a_n": left.column(1), "b": right.column(0), "b_n": right.column(1)})

    return dealt.select("node", "i", "j", "asks", "word", "n").groupBy("node", "i", "j").applyInArrow(meet, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) whose chains end: forms followed to the last, twice as far in each step."""
    now, left = materialize(forms.select("word", F.col("form").alias("root"))), None
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_groups(docs: DataFrame, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    words = materialize(counted(docs, setting, doc_id, text))
    pairs = materialize(near_pairs(words, setting))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    taken = -F.col("best.m") >= setting.ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n"))
    rows = materialize(rows)
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
