"""Quality rules, substring dedup, n-gram join and BPE against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, ngram_join, quality, substring
from tidepanel.llm.queries import vocabulary


def split(text):
    return (text or "").encode().split()


def brute_repeats(words, n=5):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = set()
    for i in range(len(words) - n + 1):
        if seen[tuple(words[i : i + n])] > 1:
            hit.update(range(i, i + n))
    return len(hit)


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a a a a a a a", "a b c d e f", "", "x " * 300, "a b c d e q a b c d e a b c d"])
def test_repeated_words(text):
    assert quality.repeated_words(text.encode().split()) == brute_repeats(text.split())


def test_quality_base_counts(docs, corpus):
    text = "Aé #1 | x\n\n  \nsame line\nsame line\nsame line "
    words, chars, symbols, dup, _ = quality.base_counts(text.encode())
    assert (len(words), chars, symbols, dup) == (len(text.split()), sum(map(len, text.split())), 2, 1)
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for d, t, *_ in corpus:
        w = split(t)
        rep = brute_repeats(w)
        assert (got[d].n_words, got[d].n_repeat_words, got[d].base_failed) == (len(w), rep, len(w) < 10 or 100 * rep > 20 * len(w))
    assert not got[95].kept and not got[96].kept and got[100].kept


def test_quality_verdict_follows_divergence(spark):
    rng = np.random.default_rng(3)
    common = ["the", "of", "and", "to", "in"]
    prose = [" ".join(rng.choice(common) if rng.random() < 0.4 else f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in rng.integers(0, 5000, 200)) for _ in range(60)]
    junk = [" ".join("".join(rng.choice(list("#$%&*"), 6)) + str(rng.integers(10**6)) for _ in range(200)) for _ in range(2)]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(rows).collect()}
    assert all(got[i].kept for i in range(60)) and not got[60].kept and not got[61].kept
    p, q = np.array([0.5, 0.5]), np.array([1.0, 0.0])
    assert quality.js_distance(p, p) == 0 and quality.js_distance(np.array([0.0, 1.0]), q) == 1
    m = (p + q) / 2
    assert abs(quality.js_distance(p, q) ** 2 - ((p * np.log2(p / m)).sum() + np.log2(1 / m[0])) / 2) < 1e-12


def test_quality_keeps_columns_and_empty_table(wide, none):
    kept = quality.keep(wide)
    assert kept.columns == wide.columns and kept.where("chunk != 'own chunk'").count() == 0 and kept.count() > 50
    assert quality.quality(none).count() == 0 and quality.keep(none).count() == 0


def brute_substring(rows, n=13):
    first = {}
    for d, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, d), d)
    out = set()
    for d, t, *_ in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.add((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("local", [8, 1, 0])
def test_substring_matches_brute_force(spark, wide, corpus, local):
    """With few local contexts allowed, edges of common passages take the way of windows."""
    got = substring.substring_dedup(wide.repartition(7), local_contexts=local).collect()
    assert {tuple(r) for r in got} == brute_substring(corpus) and len(got) == len(corpus)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_of_small_alphabets(spark, seed):
    """Few different words make overlapping, nested and self-repeating windows."""
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(["a", "b"], p=[0.8, 0.2], size=rng.integers(10, 60)))) for i in range(60)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), local_contexts=2).collect()
    assert {tuple(r) for r in got} == brute_substring(rows)


def test_strip_repeats(wide, none, corpus):
    got = {r.doc_id: r for r in substring.strip_repeats(wide).collect()}
    want = {d: (n, lost, t) for d, n, lost, t in brute_substring(corpus)}
    texts = {r[0]: r[1] for r in corpus}
    for d, (n, lost, t) in want.items():
        if lost and lost == n:
            assert d not in got
        else:
            assert got[d].text == (t if lost else texts[d]) and (not lost or got[d].n_chars == len(t)) and got[d].bucket == "own bucket"
    assert substring.strip_repeats(none).count() == 0 and substring.substring_dedup(none).count() == 0


def test_null_ids_are_last(spark):
    t = " ".join(map(str, range(20)))
    rows = spark.createDataFrame([(None, t), (4, t), (None, t)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substring.substring_dedup(rows).collect()) == [(False, 0), (True, 20), (True, 20)]


def brute_components(rows, percent=90, width=3):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    low = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= (low[a], low[b]) != (m, m)
            low[a] = low[b] = m
    return {(d, len(s), low[d]) for d, s in sets.items()}


@pytest.mark.parametrize("share,least", [(1e-3, 64), (0.0, 2)])
def test_jaccard_matches_brute_force(wide, corpus, share, least):
    """The second setting makes most tokens frequent, so that combinations carry the join."""
    got = ngram_join.jaccard_components(wide, ngram_join.Setting(frequent_share=share, frequent_least=least, sketch_bits=16)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(corpus) and len(got) == len(corpus)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, seed):
    """Chains of edits: neighbours link, ends do not; all sizes from a few words on."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for n in (9, 11, 12, 13, 20, 31, 60, 120, 300):
        words = [f"v{x}" for x in rng.integers(0, 10_000, n)]
        for _ in range(14):
            rows.append((i, " ".join(words)))
            i += 1
            words = list(words)
            words[rng.integers(0, len(words))] = f"v{rng.integers(0, 10_000)}"
            if rng.random() < 0.5 and len(words) > 8:
                words = words[int(rng.integers(0, 3)):]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(rows)), [t for _, t in rows], strict=True)]
    setting = ngram_join.Setting(frequent_share=0.0, frequent_least=4, sketch_bits=18)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), setting).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def words_of(prefix, n, passage=()):
    return " ".join([*passage, *(f"{prefix}_{i}" for i in range(n))])


def test_keys_done_when_met_leave_no_open_row(spark):
    """A passage in two texts of one size is compared at once; in texts of sizes far apart nothing is; of three of one size two are left, at any number of batches."""
    pair, far, three = ([f"{p}{i}" for i in range(8)] for p in "pft")
    rows = [(1, words_of("a", 40, pair)), (2, words_of("b", 40, pair)), (3, words_of("c", 30, far)), (4, words_of("d", 90, far)), (5, words_of("e", 300, far))]
    rows += [(i, words_of(f"g{i}", 50, three)) for i in (6, 7, 8)] + [(9, words_of("h", 200, three))]
    setting = ngram_join.Setting(sketch_bits=18)
    levels = np.full(1 << 18, 5, np.uint8)
    for s in ngram_join.token_sets([" ".join(w).encode() for w in (pair, far, three)], 3):
        levels[(s & np.uint64((1 << 18) - 1)).astype(np.int64)] = 1  # the passages' shingles come first
    for parts in (1, 4):
        got = ngram_join._stars(spark.createDataFrame(rows, "doc long, text string").repartition(parts), (levels, 9), setting).collect()
        assert {(r.doc, r.up, r.near, r.open) for r in got} == {(2, 1, True, False), (7, 6, True, True), (8, 6, True, True)}


@pytest.mark.parametrize("held,parts", [(1, 5), (2, 1), (4, 5)])
def test_jaccard_of_texts_with_a_common_passage(spark, monkeypatch, held, parts):
    """Texts of sizes near and far, a passage in all and links among the larger ids only; batches send some keys whole and some not."""
    monkeypatch.setattr(ngram_join, "HELD", held)
    rng, passage, rows = np.random.default_rng(held), [f"p{i}" for i in range(12)], []
    for family in range(12):
        words = [*passage, *(f"f{family}_{i}" for i in range(int(rng.choice([30, 32, 34, 60, 110]))))]
        for copy in range(int(rng.integers(1, 8))):
            rows.append((len(rows), " ".join(words)))
            if copy % 3:
                words = [*words, f"m{family}_{copy}"] if rng.random() < 0.7 else words[1:]
    rows = [(int(k), t) for k, (_, t) in zip(rng.permutation(len(rows)), rows, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = ngram_join.jaccard_components(docs, ngram_join.Setting(frequent_share=0.5, frequent_least=8, sketch_bits=18)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_keys_of_linked_sets_meet():
    rng = np.random.default_rng(8)
    setting = ngram_join.Setting(sketch_bits=10)
    for _ in range(400):
        n = int(rng.integers(9, 200))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = x.copy()
        for _ in range(int(rng.integers(1, 12))):
            y = np.append(np.delete(y, rng.integers(0, len(y))), rng.integers(0, 1 << 63, int(rng.integers(0, 2))).astype(np.uint64))
            if len(y) < 3:
                break
        common = len(np.intersect1d(x, y))
        levels = rng.integers(0, 10, 1 << 10).astype(np.uint8)
        frequent = int(rng.choice([0, 1, 7, 10]))
        if 100 * common >= 90 * (len(x) + len(y) - common) and len(x) != common:
            assert np.intersect1d(ngram_join.keys_of(np.unique(x), levels, frequent, setting), ngram_join.keys_of(np.unique(y), levels, frequent, setting)).size


def test_drop_near_copies(wide, corpus, none):
    want = {d for d, _, c in brute_components(corpus) if d == c}
    got = ngram_join.drop_near_copies(wide)
    assert got.columns == wide.columns and {r.doc_id for r in got.select("doc_id").collect()} == want
    assert ngram_join.drop_near_copies(none).count() == 0


def test_bpe_equals_the_library(spark, wide, corpus, none):
    import tiktoken

    ranks, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = [(200, "  two  spaces\n\n\ttab 's it's   "), (201, "日本語 текст 🙂🙂 ١٢٣"), (202, "<|endoftext|>"), (203, "a" * 5000), (204, "  x\r\n")]
    rows = wide.select("doc_id", "text", "ids").union(spark.createDataFrame(odd, "doc_id long, text string").withColumn("ids", F.lit("own")))
    encoded = bpe.encode(rows.repartition(6), ranks, pattern)
    got = encoded.collect()
    texts = {d: t for d, t, *_ in corpus} | dict(odd)
    assert len(got) == len(corpus) + len(odd)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    again = bpe.decode(encoded.drop("decoded"), ranks)
    assert again.where("decoded is null").count() == 0 and {bytes(r.decoded) for r in again.collect()} == {bytes(r.decoded) for r in got}
    one = bpe.digests(encoded).where("doc_id = 201").first()
    assert one.decoded_sha256 == hashlib.sha256(texts[201].encode()).hexdigest()
    assert bpe.encode(none, ranks, pattern).count() == 0
