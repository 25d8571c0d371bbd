"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of shingles (tokens); two link when their Jaccard similarity reaches the
threshold, ``100 * intersection >= percent * union``.

Order and classes.  Tokens are ordered by (level, hash), the level being the logarithm of their count
in a counting sketch over all documents, so prefixes hold a set's rarest tokens.  A token is *frequent*
when the sketch gives it at least ``frequent_share`` of the documents (never less than
``frequent_least``), else *rare*.  The sketch has a fixed width, its share of noise is the same at
every size, and it only ever overrates a token; a level is a function of the token alone, so every
task sees the same order.  What tasks receive is one byte for each slot.

Keys.  Linked sets differ in at most ``d(x) = |x| * (100 - percent) / percent`` tokens, counted
from either side.  Rare tokens among the first d + 1 are indexed singly.  If a set has r <= d rare
tokens, its prefix is extended to ``(d - r + 1) * k`` frequent ones and every k consecutive tokens
of it become one key.  In the merged order of two linked sets either one of the first d + 1 tokens
is rare and common, or all R rare ones differ; then at most d - R of the frequent ones do, so among
the first d - R + 1 blocks of k one is common to both and stands together in both.  No link is lost,
and the length of the key list is linear in the set.  That needs (d - R + 1) * k frequent tokens in the
merged order; sets so small that it may have fewer (``too_short``) index their first d + 1 tokens singly
as well, so two of them meet by the common token among these.

Candidates.  Equal sets are one class.  In each key group every set whose size allows a link is compared
with the smallest document only, and links are joined to components.  A member stays open if another one besides the smallest
document has a size near its own, so a key of two documents, or of sizes far apart, is done with when it is met; of a key
of which a batch holds more than HELD members all stay open.  Keys whose open members are not yet one component with the smallest stay
open; of open keys with the same open members one is kept.  There a few further heads of each group, spread by a hash
of the document, and one member of each component of several are compared with all members of other components,
and the links joined again: a group whose smallest document is an outlier then falls together, and a document that
links with anything in a component mostly joins it by one comparison.  A last pass compares what is still
apart, every member outside the component of the group's smallest document with every member of another
component, after a check of sizes and of parity bitmaps (their distance never exceeds the sets'
difference).  So a group of n near copies costs some n comparisons, and any pair that is neither
compared nor in one component would have to share no key.  A pair that meets in many keys is formed at the first of
them: each member knows the FIRST smallest open keys of its document, and a key forms no pair that has a smaller one in common.
All comparisons are exact, on the texts.

Cases: null and empty texts have no shingle and link with nothing; with fewer words than ``width``
the whole sequence is the one shingle; a row without id takes the component of an equal set that has one, else none, and joins no others; a row
repeated as a whole is a document like its copy (ids are taken as unique otherwise); other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binary, by_bucket, chunk_of, chunked_by_id, connected_components, flat, give_back, grams, hash_words, lists, mix, partitions, small_batches, unpack
from tidepanel.operators.staging import materialize


@dataclass(frozen=True)
class Setting:
    width: int = 3
    percent: int = 90
    k: int = 3
    sketch_bits: int = 21
    frequent_share: float = 1e-3
    frequent_least: int = 64


BITMAP = 8  # longs, in two maps of 256 bits
HELD = 4  # members of a key that a batch sends as they are; of more it sends the smallest
HEADS = 4  # of an open key, besides its smallest document
FIRST = 16  # open keys of a document that are looked through for an earlier meeting
WANTED = 1 << 20  # documents whose ids are broadcast to pick texts; more are picked from packed chunks
_ROWS = 250  # texts cut at once
_SLOTS = 64


def token_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words = [t.lower().split() if t else [] for t in texts]
    h = hash_words(itertools.chain.from_iterable(words), sum(map(len, words)))
    g, out, at = grams(h, width, 11), [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            out.append(np.unique(g[at : at + n - width + 1]))
        elif n:
            out.append(grams(h[at : at + n], n, 11 + n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """(two sums over the set, two 256-bit parity bitmaps) of each set as signed longs, and a parity bitmap of one bit or more for each token."""
    out, wide = np.zeros((len(sets), 2 + BITMAP), np.uint64), []
    for i, s in enumerate(sets):
        if not len(s):
            wide.append(b"")
            continue
        m = mix(s + np.uint64(77))
        again = mix(m ^ s)
        out[i, 0], out[i, 1] = m.sum(dtype=np.uint64), again.sum(dtype=np.uint64)
        odd = lambda at, n: np.packbits((np.bincount(at.astype(np.int64), minlength=n) & 1).astype(np.uint8))
        out[i, 2:] = np.append(odd(m >> np.uint64(56), 256), odd(again >> np.uint64(56), 256)).view(np.uint64)
        size = max(64, 1 << (len(s) - 1).bit_length())
        wide.append(odd(again & np.uint64(size - 1), size).tobytes())
    return out.view(np.int64), wide


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of how many tokens differ; the longer bitmap is folded onto the shorter."""
    u, v = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(v) > len(u):
        half = len(v) // 2
        v = v[:half] ^ v[half:]
    return int(np.bitwise_count(u ^ v).sum())


def too_short(n: int, setting: Setting) -> bool:
    """Whether a link of a set of n tokens may leave fewer than D + 1 blocks of k tokens in the merged order, D being how many tokens differ."""
    d = n * (100 - setting.percent) // setting.percent
    return any(max(n, -(-100 * i // (100 - setting.percent))) < setting.k * (i + 1) for i in range(1, d + 1))


def keys_of(tokens: np.ndarray, levels: np.ndarray, frequent: int, setting: Setting) -> np.ndarray:
    """Index keys of one set; ``levels`` has a byte for each slot of the sketch, from ``frequent`` on a token is frequent."""
    n = len(tokens)
    d = n * (100 - setting.percent) // setting.percent
    if not d:
        return np.zeros(0, np.uint64)  # only an equal set can link
    level = levels[(tokens & np.uint64((1 << setting.sketch_bits) - 1)).astype(np.int64)]
    key = mix(tokens)
    order = np.lexsort((key, level))
    key, rare = key[order], int((level < frequent).sum())
    single = key[: d + 1 if too_short(n, setting) else min(rare, d + 1)]
    if rare > d:
        return single
    head = key[rare : rare + (d - rare + 1) * setting.k]
    return np.append(single, grams(head, setting.k, 23))


def _profiles(docs: DataFrame, setting: Setting) -> DataFrame:
    """Rows of kind 0: a document's size and signature; of kind 1: a slice of one task's sketch."""
    width, slots = setting.width, 1 << setting.sketch_bits
    names = ["kind", "doc", "n", "s1", "s2", *[f"b{i}" for i in range(BITMAP)], "wide", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * BITMAP, pa.binary(), pa.binary()]

    def sketch(counts: np.ndarray) -> pa.RecordBatch:
        step = slots // _SLOTS
        small = zstandard.ZstdCompressor(level=1)
        parts = [small.compress(np.minimum(counts[i * step : (i + 1) * step], 255).astype(np.uint8).tobytes()) for i in range(_SLOTS)]
        none = pa.nulls(_SLOTS, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([1] * _SLOTS, pa.int32()), pa.array(range(_SLOTS), pa.int64()), *[none] * (3 + BITMAP), pa.nulls(_SLOTS, pa.binary()), pa.array(parts, pa.binary())], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(slots, np.uint32), 0
        for b in batches:
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                sets = token_sets(binary(part.column(1)).to_pylist(), width)
                sig, wide = _signatures(sets)
                cols = [pa.array(np.zeros(len(sets)), pa.int32()), part.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(sig[:, i])) for i in range(2 + BITMAP)], pa.array(wide, pa.binary()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds, strict=True)], names)
                slot, times = np.unique(np.concatenate(sets) & np.uint64(slots - 1), return_counts=True)
                counts[slot.astype(np.int64)] += times.astype(np.uint32)
                held += part.num_rows
                if held > 50_000:  # a full byte is then 0.5 % of the documents, above the share that makes a token frequent
                    yield sketch(counts)
                    counts[:], held = 0, 0
        if held:
            yield sketch(counts)
        del counts
        give_back()

    ddl = "kind int, doc long, n long, s1 long, s2 long, " + ", ".join(f"b{i} long" for i in range(BITMAP)) + ", wide binary, counts binary"
    return docs.mapInArrow(scan, ddl)


def _level(count):
    """Quarter steps of the binary logarithm."""
    return np.minimum(np.floor(4 * np.log2(1 + count)), 255).astype(np.uint8)


def _levels(profiles: DataFrame, documents: int, setting: Setting) -> tuple[np.ndarray, int]:
    """A level for each slot of the sketch, from the sum over all documents (2^sketch_bits bytes), and the first frequent one."""
    tokens = profiles.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    least = max(setting.frequent_least, setting.frequent_share * documents) + tokens / (1 << setting.sketch_bits)

    def total(t: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint8).astype(np.int64) for x in t.column("counts"))
        return pa.table({"slot": t.column("doc").slice(0, 1), "levels": pa.array([_level(s).tobytes()], pa.binary())})

    got = profiles.where("kind = 1").select("doc", "counts").groupBy("doc").applyInArrow(total, "slot long, levels binary").collect()
    step = (1 << setting.sketch_bits) // _SLOTS
    out = np.zeros(_SLOTS * step, np.uint8)
    for r in got:
        out[r.slot * step : (r.slot + 1) * step] = np.frombuffer(r.levels, np.uint8)
    return out, int(_level(least))


_SENT = "bucket long, key array<long>, doc array<long>, n array<int>, mark array<boolean>, up array<long>"
_STARS = "key long, doc long, up long, near boolean, open boolean"
_RUN = 50_000  # rows of a batch's own trees that go to one bucket


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Whether a sorted row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _near(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def open_members(group: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether another member of the group has a size that allows a link: one next to it by size then has."""
    order = np.lexsort((n, group))
    g, m, out = group[order], n[order], np.zeros(len(n), bool)
    both = np.flatnonzero((g[1:] == g[:-1]) & _near(m[1:], m[:-1], percent))
    out[order[both]] = out[order[both + 1]] = True
    return out


def _stars(docs: DataFrame, levels: tuple[np.ndarray, int], setting: Setting) -> DataFrame:
    """Rows (key, doc, up, near, open) that join the documents of each key into a tree: a document to the smallest of all, where a
    batch holds more than HELD of them to the smallest of its batch.  A key reaches its bucket at most HELD times for each batch, however many hold it.

    near: the sizes of doc and up allow a link.  open: doc may link with a member of the key other than up; the open rows of a key hold
    each such member, the smallest (with itself as up) only if a batch sent fewer members than it has.  Rows that are neither are left out.
    """
    spark = docs.sparkSession
    sent, buckets = spark.sparkContext.broadcast(levels), 4 * partitions(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, frequent = sent.value
        for b in batches:
            keys, times, sizes = [], [], []
            for lo in range(0, b.num_rows, _ROWS):
                sets = token_sets(binary(b.column(1).slice(lo, _ROWS)).to_pylist(), setting.width)
                found = [keys_of(s, level, frequent, setting) for s in sets]
                keys += found
                times += [len(k) for k in found]
                sizes += [len(s) for s in sets]
            if not sum(times):
                continue
            key, doc, n = np.concatenate(keys), np.repeat(b.column(0).to_numpy(), times), np.repeat(np.array(sizes, np.int64), times)
            order = np.lexsort((doc, key))
            order = order[_firsts(key[order], doc[order])]
            key, doc, n = key[order], doc[order], n[order]
            lead = np.flatnonzero(_firsts(key))
            members = np.diff(np.append(lead, len(key)))
            low, many = np.repeat(lead, members), np.repeat(members > HELD, members)
            signed, is_low = key.view(np.int64), low == np.arange(len(key))
            out = np.flatnonzero(is_low | ~many)
            order, present, starts = by_bucket(mix(key[out]), buckets)
            out = out[order]
            cols = [pa.array(present), lists(signed[out], starts, pa.int64()), lists(doc[out], starts, pa.int64()), lists(n[out], starts, pa.int32()), lists(many[out], starts, pa.bool_()), pa.nulls(len(present), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names)
            rest = np.flatnonzero(many & ~is_low)
            if len(rest):
                ends = np.append(np.arange(0, len(rest), _RUN), len(rest))
                near = _near(n[rest], n[low[rest]], setting.percent)
                to = (int(mix(key[rest[:1]])[0] % np.uint64(buckets)) + np.arange(len(ends) - 1)) % buckets
                cols = [pa.array(to, pa.int64()), lists(signed[rest], ends, pa.int64()), lists(doc[rest], ends, pa.int64()), lists(n[rest], ends, pa.int32()), lists(near, ends, pa.bool_()), lists(doc[low[rest]], ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    def meet(t: pa.Table) -> pa.Table:
        inside, t = t.filter(pc.is_valid(t.column("up"))), t.filter(pc.is_null(t.column("up")))
        key, doc, n, many = (flat(t.column(c)) for c in ("key", "doc", "n", "mark"))
        order = np.lexsort((doc, key))
        key, doc, n, many = key[order], doc[order], n[order].astype(np.int64), many[order].astype(bool)
        group = np.cumsum(_firsts(key)) - 1
        cut = np.zeros(len(key), bool)
        cut[group[many]] = True  # by group: a batch holds more of its members
        once = _firsts(key, doc)
        key, doc, n, group = key[once], doc[once], n[once], group[once]
        lead = np.flatnonzero(_firsts(key))
        low = np.repeat(lead, np.diff(np.append(lead, len(key))))
        other, cut = low != np.arange(len(key)), cut[group]
        near, open_ = other & _near(n, n[low], setting.percent), cut.copy()
        open_[other] |= open_members(group[other], n[other], setting.percent)
        kept = near | open_
        cols = [np.append(a[kept], flat(inside.column(c))) for a, c in ((key, "key"), (doc, "doc"), (doc[low], "up"))]
        own = np.ones(len(cols[0]) - int(kept.sum()), bool)
        return pa.table([*cols, np.append(near[kept], flat(inside.column("mark")).astype(bool)), np.append(open_[kept], own)], names=["key", "doc", "up", "near", "open"])

    names = ["bucket", "key", "doc", "n", "mark", "up"]
    return docs.mapInArrow(scan, _SENT).groupBy("bucket").applyInArrow(meet, _STARS)


def _only(rows: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of the documents in ``need``, a written table, where its ids may be broadcast; all rows if they are more."""
    return rows.join(F.broadcast(need), "doc", "left_semi") if need.count() <= WANTED else rows


def _either(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b"))).distinct())


def _verified(pairs: DataFrame, docs: DataFrame, setting: Setting) -> DataFrame:
    """The pairs (a, b) that link, by their texts, which are picked from packed chunks."""
    chunks = 4 * partitions(docs.sparkSession)
    need = _either(pairs)
    base = chunked_by_id(_only(docs.where("doc is not null"), need), "doc", chunks)
    need = need.withColumn("chunk", chunk_of("doc", chunks))

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        out, wanted = [], right.column("doc")
        for body in left.column("body") if right.num_rows else ():
            batch = unpack(body.as_buffer())
            out.append(batch.filter(pc.is_in(batch.column(0), value_set=wanted)))
        schema = pa.schema([("doc", pa.int64()), ("text", pa.string())])
        return pa.Table.from_batches(out).cast(schema) if out else schema.empty_table()

    texts = materialize(base.groupBy("chunk").cogroup(need.groupBy("chunk")).applyInArrow(pick, "doc long, text string"))
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.add(pc.binary_length(b.column(2)), pc.binary_length(b.column(3))).to_numpy(zero_copy_only=False).cumsum() // (2 << 20)
            starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                part, good = b.slice(lo, hi - lo), []
                xs, ys = (token_sets(binary(part.column(i)).to_pylist(), setting.width) for i in (2, 3))
                for x, y in zip(xs, ys, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= setting.percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    return both.mapInArrow(check, "a long, b long").distinct()


def _alike(percent: int, left: str, right: str):
    """Sizes and both short bitmaps allow a link."""
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    good = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    for first in (0, BITMAP // 2):
        odd = [F.bit_count(F.col(f"{left}b{i}").bitwiseXOR(F.col(f"{right}b{i}"))) for i in range(first, first + BITMAP // 2)]
        good &= (100 + percent) * (odd[0] + odd[1] + odd[2] + odd[3]) <= (100 - percent) * (n + m)
    return good


def _candidates(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and long bitmaps allow a link."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x, y = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            good = [(100 + percent) * least_difference(p, q) <= (100 - percent) * k for k, p, q in zip(n, x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = materialize(pairs)
    own = _only(own, _either(pairs)).select("doc", "n", "wide").dropDuplicates(["doc"])
    side = lambda k, p: own.select(F.col("doc").alias(k), F.col("n").alias(f"{p}n"), F.col("wide").alias(f"{p}wide"))
    both = pairs.join(side("a", "x_"), "a").join(side("b", "y_"), "b").where(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
    return both.select("a", "b", (F.col("x_n") + F.col("y_n")).alias("n"), "x_wide", "y_wide").mapInArrow(sift, "a long, b long")


def _placed(own: DataFrame, found: DataFrame) -> DataFrame:
    """Each class with its component so far."""
    return own.dropDuplicates(["doc"]).join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _one_of_equal_keys(rows: DataFrame) -> DataFrame:
    """Of the keys with the same members the smallest: a passage that some documents share is many keys, all with these members."""
    sets = rows.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("one"), F.bit_xor(F.xxhash64("doc", F.lit(7))).alias("two"))
    kept = sets.where("size > 1").groupBy("size", "one", "two").agg(F.min("key").alias("key"))
    return rows.join(kept.select("key"), "key", "left_semi")


def _with_earlier(rows: DataFrame) -> DataFrame:
    """With the open keys of the document that are smaller than the row's, as far as they are among its FIRST smallest."""
    first = rows.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("first"))
    return rows.join(first, "doc").select("key", "doc", F.filter("first", lambda k: k < F.col("key")).alias("earlier"))


def _side(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(prefix + c) for c in rows.columns if c != "key"])


def _with_heads(rows: DataFrame) -> DataFrame:
    """Members of each key with some of those of other components: HEADS of least hash, one for each residue, and the one of least hash of each
    component of several.  Keys with nearly the same members have nearly the same of these."""
    order, row = F.xxhash64("doc"), F.struct(*[c for c in rows.columns if c != "key"])
    least = F.min_by(row, F.struct(order, F.col("doc"))).alias("h")
    spread = rows.groupBy("key", F.pmod(order, F.lit(HEADS)).alias("part")).agg(least).select("key", "h.*")
    joined = rows.groupBy("key", "component").agg(least, F.count("*").alias("members")).where("members > 1").select("key", "h.*")
    return _side(rows, "x_").join(_side(spread.union(joined), "y_"), "key").where("x_component != y_component")


def _across(rows: DataFrame) -> DataFrame:
    """All members of each key that are in different components."""
    heads = rows.groupBy("key").agg(F.min_by("component", "doc").alias("head"))
    left = _side(rows.join(heads, "key").where("component != head"), "x_")
    return left.join(_side(rows, "y_"), "key").where("x_component != y_component and (x_doc < y_doc or y_component = x_head)")


def jaccard_components(docs: DataFrame, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id (smallest id with the same set), component_id."""
    with small_batches(docs.sparkSession):
        docs = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
        profiles = materialize(_profiles(docs, setting))
        sets = profiles.where("kind = 0").drop("kind", "counts")
        documents = sets.count()
        alike = sets.where("n > 0 and doc is not null").groupBy("n", "s1", "s2").agg(F.min("doc").alias("cls"))
        bits = [f"b{i}" for i in range(BITMAP)]
        member = materialize(sets.join(alike, ["n", "s1", "s2"], "left").select("doc", "n", F.coalesce("cls", "doc").alias("cls"), *bits, "wide"))
        own = member.where("doc = cls")
        named = member.where("doc is not null").select("doc", "cls").distinct()
        stars = materialize(_stars(docs.where("doc is not null"), _levels(profiles, documents, setting), setting))
        edges = stars.where("doc != up").groupBy("doc", "up").agg(F.bool_or("near").alias("near"), F.bool_or("open").alias("open")).join(named.withColumnRenamed("cls", "x"), "doc")
        edges = materialize(edges.join(named.select(F.col("doc").alias("up"), F.col("cls").alias("y")), "up").where("x != y"))
        pairs = edges.where("near").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        tried = materialize(_candidates(pairs, own, setting.percent))
        links = materialize(_verified(tried, docs, setting))
        found = connected_components(links)

        # Keys with an open document that is not yet joined to the one above it: compare across the components that meet there.
        at = _placed(own, found).select("doc", "component")
        apart = edges.where("open").join(at.select(F.col("doc").alias("x"), F.col("component").alias("cx")), "x").join(at.select(F.col("doc").alias("y"), F.col("component").alias("cy")), "y").where("cx != cy").select("doc", "up")
        open_ = stars.where("open")
        keys = open_.join(apart, ["doc", "up"], "left_semi").select("key").distinct()
        rows = open_.join(keys, "key", "left_semi").select("key", "doc").join(named, "doc").select("key", F.col("cls").alias("doc")).distinct()
        rows = materialize(_with_earlier(materialize(_one_of_equal_keys(materialize(rows)))))
        passes = (_with_heads, _across)
        for pairs_of in passes:
            members = materialize((rows if pairs_of == passes[-1] else rows.drop("earlier")).join(_placed(own, found).select("doc", "component", "n", *bits), "doc"))
            rest = pairs_of(members).where(_alike(setting.percent, "x_", "y_"))
            if pairs_of == passes[-1]:
                rest = rest.where(~F.arrays_overlap("x_earlier", "y_earlier"))
            rest = rest.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
            rest = materialize(_candidates(rest, own, setting.percent))
            if not rest.isEmpty():
                tried, links = tried.union(rest), links.union(materialize(_verified(rest, docs, setting)))
                found = connected_components(links)
    out = member.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.coalesce("component", "cls").alias("component_id"))


def drop_near_copies(docs: DataFrame, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that link, directly or not, to a document with a smaller id; columns as they were."""
    gone = jaccard_components(docs, setting, doc_id, text).where("doc_id != component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone_id"], "left_anti")
