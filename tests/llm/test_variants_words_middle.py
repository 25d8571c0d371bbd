"""Spelling variants, word-table BPE and fill-in-the-middle against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import fim, spelling, word_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(200, "  two  spaces\n\n\ttab 's it's we'll ''s   "), (201, "日本語 текст 🙂🙂 ١٢٣ ⅷ²½"), (202, "<|endoftext|>"), (203, "a" * 5000), (204, "  x\r\n"),
       (205, "in<|endoftext|> the <|endoftext|><|endoftext|>\n<|endoftext"), (206, "՘a ᲊ Ⱟ\U00010d40x \U0001e5f1\x1c\x1d \x85\xa0 b\xa0\xa0c"), (207, "ÇA l'été Œuvre ǆ ˁ ʰ ª1º2")]


def brute_spelling(rows, ratio=10, damage=31):
    count = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= ratio * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.fixture(scope="module")
def misspelt():
    """Words with variants of all kinds, chains of forms, ties, one code point beyond the class, very long runs."""
    rng, letters = random.Random(9), "abcdefghijklmnopqrstuvwxyzéÈÿ×"
    rows, bases = [], ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(30)]
    for i, base in enumerate(bases):
        words = [base] * rng.choice([3, 40, 400])
        for _ in range(12):
            k, c = rng.randrange(len(base)), rng.choice(letters)
            v = rng.choice([base[:k] + base[k + 1 :], base[:k] + c + base[k:], base[:k] + c + base[k + 1 :]])
            words += [v] * rng.choice([1, 2, 3, 30])
        rng.shuffle(words)
        rows.append((i, "".join((w.title() if rng.random() < 0.2 else w) + rng.choice([" ", ", ", "7", "ā", "\n"]) for w in words)))
    rows += [(90, None), (91, ""), (None, "chained chained " * 3), (92, "y" * 3000 + " " + "y" * 3000), (93, "y" * 2999 + " " + "y" * 2999), (94, "chained"), (94, "chained")]
    rows += [(95, "letters " * 300 + "lettersx " * 20 + "lettersxy " * 2 + "lettersz " * 20 + "abcdefg gfedcba abcdefg gfedcba")]
    return rows


@pytest.mark.parametrize("slice_rows,held", [(100_000, 200_000), (40, 50)])
def test_spelling_matches_brute_force(spark, misspelt, slice_rows, held):
    """The second setting shuffles many levels, deals nodes into slices and empties the sums often."""
    rows = spark.createDataFrame(misspelt, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "node", "form", "i")}).repartition(5)
    got = spelling.spelling_groups(rows, spelling.Setting(slice_rows=slice_rows, held_words=held)).collect()
    want = brute_spelling(misspelt)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    chained = [w for w, form, root, *_ in want if form and form != root]
    assert chained and any(n_near > 3 for *_, n_near, _ in want)


def test_spelling_of_nothing(spark, none):
    assert spelling.spelling_groups(none).count() == 0
    one = spark.createDataFrame([(1, "only only short words here")], "doc_id long, text string")
    assert spelling.spelling_groups(one).count() == 0


def test_near_and_reached_agree():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8)))
        k, c = rng.randrange(len(a)), rng.choice("abcdé")
        b = rng.choice([a[:k] + a[k + 1 :], a[:k] + c + a[k:], a[:k] + c + a[k + 1 :], a[::-1], a])
        want = a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(a[:i] + a[i + 1 :] == b for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b))))
        assert spelling.near(a, b) == spelling.near(b, a) == want
        if 0 <= len(b) - len(a) <= 1:
            (x, _), (y, _) = spelling.spelled([a]), spelling.spelled([b])
            assert spelling.near_rows(x, y, np.array([len(b) > len(a)]))[0] == want
        if want:
            u, v = spelling.letter_counts([a, b]).tolist()
            ways = [all(tuple(y[:p]) in spelling.reached(tuple(x[:p])) for p in (1, 2, 5, 30)) for x, y in ((u, v), (v, u))]
            assert sum(ways) == (2 if u == v else 1)


def test_word_table_equals_the_library(spark, wide, corpus, none, monkeypatch):
    library = word_bpe.tokenizer(PATH)
    rows = wide.select("doc_id", "text", "ids").union(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit("own")))
    monkeypatch.setattr(word_bpe, "CHUNK_BYTES", 20_000)  # several chunks in a task
    encoded = word_bpe.encode(rows.repartition(6), PATH)
    got = word_bpe.decode(encoded, PATH).collect()
    texts = {d: t for d, t, *_ in corpus} | dict(ODD)
    assert len(got) == len(corpus) + len(ODD)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")
    d = {r.doc_id: r for r in word_bpe.digests(word_bpe.decode(encoded, PATH)).collect()}
    ids = library.encode(texts[205], add_special_tokens=False).ids
    assert 50256 in ids and d[205].n_tokens == len(ids) and d[205].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert d[95].n_tokens == 0 and d[95].ids_sha256 == d[95].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert word_bpe.encode(none, PATH).count() == 0 and word_bpe.decode(none.select(F.array(F.lit(1)).alias("ids")), PATH).count() == 0


def test_word_table_with_strings_as_ids_and_null_rows(spark):
    rows = spark.createDataFrame([(None, None), (None, "a b"), ("x", "a b"), ("x", "a b")], "doc_id string, text string")
    got = sorted((str(r.doc_id), r.ids) for r in word_bpe.encode(rows, PATH).collect())
    ab = word_bpe.tokenizer(PATH).encode("a b").ids
    assert got == [("None", []), ("None", ab), ("x", ab), ("x", ab)]


def test_decoding_of_any_ids(spark):
    library, rng = word_bpe.tokenizer(PATH), np.random.default_rng(2)
    lists = [rng.integers(0, 50_257, 40).tolist() for _ in range(30)] + [[], [50256], None]
    got = word_bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>"), PATH).collect()
    assert all(r.decoded == (None if lists[r.k] is None else library.decode(lists[r.k], skip_special_tokens=False)) for r in got)


def test_cutting_equals_the_library():
    """Random strings over letters, digits, blanks and marks of several scripts; every code point between others."""
    rng, cutter, pre = random.Random(3), word_bpe.Cutter(PATH), word_bpe.tokenizer(PATH).pre_tokenizer
    letters = "aZ'sdtlve  \n\t\r\x0b\x1c\x85\xa0 é½²ªˁ˂中!?-—١Ж᠎ᲊ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["a1! " + chr(c) + "b2? " + chr(c) + chr(c) + " " for c in [*range(0x700), *range(0x2000, 0x2100)]]
    for t in texts:
        assert cutter.words(t) == [t[a:b] for _, (a, b) in pre.pre_tokenize_str(t)]


def brute_middle(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("setting", [fim.Setting(), fim.Setting(seed=7, rate=100, spm=50, chunk_bits=3, cache_bytes=2000)])
def test_middle_matches_brute_force(spark, wide, corpus, setting):
    """The second setting cuts chunks of some 8 bytes, many of them shared, and empties its cache often."""
    rng = random.Random(4)
    odd = [(300 + i, "".join(rng.choice("ab é日🙂 \n\t\xa0<>PSM") for _ in range(rng.randrange(60)))) for i in range(150)]
    odd += [(500, "x <P> y z"), (501, "<S>"), (502, " \n"), (503, "a"), (504, "ends in blanks  "), (505, "<S<P<M" * 9), (506, "b\x00c d"), (None, "no id here at all")]
    rows = wide.select("doc_id", "text", "ids").union(spark.createDataFrame(odd, "doc_id long, text string").withColumn("ids", F.lit("own")))
    got = fim.fill_in_middle(rows.repartition(3), setting).withColumn("again", fim.restored()).collect()
    want = {brute_middle(d, t, setting.seed, setting.rate, setting.spm) for d, t, *_ in [*corpus, *odd]}
    assert {tuple(r)[:6] for r in got} == want and len(got) == len(corpus) + len(odd)
    texts = {d: t or "" for d, t, *_ in [*corpus, *odd]}
    assert all(r.again == texts[r.doc_id] for r in got)
    assert {"plain", "spm", "psm"} == {r.form for r in got}


def test_middle_of_nothing_and_collisions(none, monkeypatch):
    assert fim.digests(fim.fill_in_middle(none)).count() == 0
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda chunk: 1)  # all chunks share one key
    known = fim.Summaries(1 << 20)
    assert [known.of(c) for c in (b"a b", b"a c d", b"a b", b"a c d")] == [fim.summary(c) for c in (b"a b", b"a c d", b"a b", b"a c d")]


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 4000).astype(np.uint8).tobytes()
    known = fim.Summaries(1 << 20)
    fim.Layout(b"one " + passage, known, 7)
    held = known.held
    fim.Layout(b"another start of a text " + passage + b" end", known, 7)
    assert known.held - held < 1500
