"""Vectors, mixing, languages, shards, packing, licences and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import common, langid, licences, mixing, near_vectors, packing, sharding
from tidepanel.llm.queries import vocabulary


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2000 + i) for i in range(1, 40)]
    low = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in low.items())


def brute_vectors(rows, t=0.98):
    good = {}
    for i, v, k in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (k, np.array(v, float) / np.linalg.norm(v))
    links = {i: [j for j, (k, w) in good.items() if j != i and k == good[i][0] and len(w) == len(good[i][1]) and float(w @ good[i][1]) >= t] if i in good else [] for i, _, _ in rows}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("setting", [near_vectors.Setting(), near_vectors.Setting(cell_rows=20, block=8), near_vectors.Setting(cell_rows=40, block=16, sample=50)])
def test_near_vectors(spark, setting):
    rng = np.random.default_rng(4)
    rows, centres = [], rng.normal(size=(12, 8))
    for i in range(260):
        c = centres[i % 12] + rng.normal(size=8) * rng.choice([0.03, 0.12, 0.4])
        rows.append((i, [float(np.float32(x)) for x in c], int(rng.integers(0, 2))))
    rows += [(300 + i, rows[7][1], rows[7][2]) for i in range(40)]  # one vector many times
    rows += [(350, [2 * x for x in rows[7][1]], rows[7][2]), (351, None, 0), (352, [0.0] * 8, 0), (353, rows[7][1], None), (354, [float("nan")] + [1.0] * 7, 0), (355, [float("inf")] + [1.0] * 7, 0), (356, [None] + [1.0] * 7, 0), (357, [], 0), (358, rows[7][1][:4], rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "node": F.lit("x"), "cell": F.lit(0)})
    got = near_vectors.near_vectors(df.repartition(5), setting).collect()
    assert len(got) == len(rows) and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows)
    assert near_vectors.near_vectors(df.limit(0), setting).count() == 0


def test_schedule_stays_within_a_block():
    blocks, weights = {"a": 40, "b": 25, None: 10, "c": 1}, {"a": 7, "b": 3, None: 2, "c": 1}
    plan = mixing.schedule(blocks, weights)
    assert [x[2] for x in plan] == list(range(sum(blocks.values()))) and len({x[:2] for x in plan}) == len(plan)
    assert all(r <= slot < d for _, _, slot, _, r, d in plan)
    for phase in {x[3] for x in plan}:
        part = [x for x in plan if x[3] == phase]
        live = {x[0] for x in plan if x[3] >= phase}
        total, seen = sum(weights[s] for s in live), dict.fromkeys(live, 0)
        for n, x in enumerate(part, 1):
            seen[x[0]] += 1
            assert all(abs(seen[s] - n * weights[s] / total) < 1 for s in live)


def test_mix_places_each_row_once(wide, corpus, none):
    got = mixing.mix(wide, most_blocks=20).collect()
    assert sorted(r.position for r in got) == list(range(len(corpus)))
    by = {}
    for r in got:
        by.setdefault((r.source, r.block), []).append(r.position)
    assert all(max(p) - min(p) == len(p) - 1 for p in by.values())  # a block stands together
    assert len({r.slot for r in got}) == len(by)
    part = mixing.mix(wide, {"a": 3, "b": 1}).collect()
    assert all((r.position is None) == (r.source not in ("a", "b")) for r in part)
    stage = mixing.mixed_documents(wide)
    first = {r.doc_id for r in mixing.mix(wide).where("phase = 0").collect()}
    assert stage.columns == wide.columns and {r.doc_id for r in stage.collect()} == first
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_languages(spark, none):
    rng = random.Random(1)
    words = {"en": ["the", "and", "thing", "wher", "ould"], "fr": ["été", "que", "ment", "eaux", "la"], "de": ["und", "ßen", "keit", "sch", "über"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in ((i, rng.choice(list(words))) for i in range(300))]
    rows += [(400, None, "en"), (401, "", "en"), (402, "123 !? 45", "en"), (403, "the and thing", None), (404, "the " * 50_000, "en"), rows[0], (None, rows[1][1], "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("own"), "h": F.lit(0), "kind": F.lit(3), "notes": F.create_map(F.lit("a"), F.lit(1))})
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    known = {d: k for d, _, k in rows if d is not None and d < 300}
    held = [r for r in got if r.doc_id in known and r.held_out]
    assert len(held) > 40 and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.98 * len(held)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert (by[400], by[401], by[402], by[403], by[404]) == ("und", "und", "und", "en", "en")
    strange = spark.createDataFrame([(1, "zzzz qqqq xxxx jjjj " * 20)], "doc_id long, text string")
    model = langid.fit(df)
    assert langid.predict(strange, model).first().rejected and langid.identify(none).count() == 0
    assert langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def test_shards(spark, wide, corpus, none):
    got = sharding.shard(wide, bundles=64).collect()
    texts = {}
    for d, t, *_ in corpus:
        texts.setdefault(d, t or "")
    import zlib

    assert len(got) == len(corpus)
    for r in got:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(b) + 1, zlib.crc32(b), None)
    by, slots = {}, {}
    for r in got:
        by.setdefault(texts[r.doc_id], set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0


def test_shards_are_near_equal_with_a_large_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else "word " * (i % 50) + str(i)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert len(got) == 8 and max(r.b for r in got) <= 1.02 * min(r.b for r in got) and max(r.n for r in got) <= 1.2 * min(r.n for r in got)


def test_best_fit_matches_a_plain_search():
    rng = random.Random(9)
    for context in (8, 64, 100):
        lengths = [rng.randrange(1, context + 1) for _ in range(300)]
        rows, room = [], []
        for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = [r for r in room if r >= lengths[k]]
            room.append(context) if not fit else None
            r = min(fit) if fit else context
            room.remove(r)
            room.append(r - lengths[k])
        rows = packing.best_fit(lengths, context)
        assert sorted(k for r in rows for k in r) == list(range(300)) and all(sum(lengths[k] for k in r) <= context for r in rows)
        assert sorted(context - sum(lengths[k] for k in r) for r in rows) == sorted(room)


def test_packed_rows_give_the_documents_back(wide, corpus, none):
    import tiktoken

    ranks, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = packing.pack(wide.dropDuplicates(["doc_id"]).coalesce(2), ranks, pattern, context=256).collect()
    pieces = {}
    for r in got:
        line = np.frombuffer(r.ids, "<u2")
        assert len(line) == 256 and r.cu_lengths[0] == 0 and r.cu_lengths[-1] == r.n_tokens and r.resets == r.cu_lengths[:-1] and (line[r.n_tokens :] == 50256).all()
        for d, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_lengths, r.cu_lengths[1:], strict=False):
            pieces.setdefault(d, []).append((at, line[a:b].tolist()))
    texts = {d: t for d, t, *_ in corpus}
    assert set(pieces) == set(texts) and len({r.row_id for r in got}) == len(got)
    for d, p in pieces.items():
        assert [i for _, x in sorted(p) for i in x] == [*library.encode_ordinary(texts[d] or ""), 50256]
    assert packing.pack(none, ranks, pattern).count() == 0


@pytest.mark.parametrize("parts, group_rows", [(1, 2048), (64, 2048), (64, 40)])
def test_fill_does_not_depend_on_splits(spark, parts, group_rows):
    ranks, pattern = vocabulary()
    texts = [(i, " ".join(f"word{i % 7} again" for _ in range(1 + i * 37 % 113))) for i in range(1500)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    got = packing.pack(d, ranks, pattern, context=512, group_rows=group_rows).select("row_id", "n_tokens", "doc_ids").collect()
    assert len({r.row_id for r in got}) == len(got) and {i for r in got for i in r.doc_ids} == set(range(1500))
    assert sum(r.n_tokens for r in got) / (512 * len(got)) >= 0.98


def test_licences(spark, none):
    back = {i: s for s, i in reversed(licences.SENTENCES.items())}
    say = lambda *ids: ". ".join(back[i].upper() for i in ids) + "."
    rows = [
        (1, "Some prose here.\nLicensed under CC BY-NC 4.0.\nMore prose.", "CC-BY-NC-4.0", 1),
        (2, say("mit-grant", "mit-notice", "mit-warranty"), "MIT", 3),
        (3, say("mit-warranty", "mit-notice", "mit-grant"), "", 3),
        (4, say("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause", 4),
        (5, say("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause", 3),
        (6, "Intro.\n\n" + say("apache-header", "apache-compliance").replace(" FILE", "\nFILE").replace(" VERSION", "\n  VERSION") + "\n\nEnd.", "Apache-2.0", 2),
        (7, None, "", 0), (8, "", "", 0), (9, "a licence is not a sentence we know", "", 0), (None, "released under the MIT licence!", "MIT", 1),
        (10, "Copyright (c) 2020 X.\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", "MIT GPL-3.0-only", 3),
        (11, "word " * 100_000 + ".\nReleased under the MIT License.\n" * 2, "MIT", 2),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({"ids": F.lit(1), "low": F.lit(2), "seq": F.lit(3)})
    got = {r.doc_id: (r.licences, r.n_sentences) for r in licences.licence_scan(df).collect()}
    assert got == {d: (want, n) for d, _, want, n in rows}
    assert licences.licence_scan(none).count() == 0
    assert all(any(t in s for t in licences.TRIGGERS) for s in licences.SENTENCES | licences.MORE_SENTENCES)
    assert not any(" " in t for t in licences.TRIGGERS)
    assert not any("Python" in x or "Arrow" in x for x in licences.licence_scan(df)._jdf.queryExecution().executedPlan().toString().splitlines())


def test_licences_without_common_words_and_of_one_family(spark):
    rows = [
        (0, "CC0-1.0 Universal", "CC0-1.0"), (1, "See LICENSE. CC0-1.0 Universal", "CC0-1.0"), (2, "Released under the GNU GPL v3.", "GPL-3.0-only"),
        (3, "released under the GNU-LGPL v2.1", "LGPL-2.1-only"), (4, "SPDX-License-Identifier: GPL-2.0-only\nSPDX-License-Identifier: GPL-3.0-only", "GPL-3.0-only GPL-2.0-only"),
        (5, "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 CC-BY-4.0"), (6, "SPDX-License-Identifier: LGPL-2.1-or-later OR LGPL-3.0-only OR EPL-1.0 OR EPL-2.0", "LGPL-3.0-only LGPL-2.1-or-later EPL-2.0 EPL-1.0"),
        (7, "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"), (8, "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
    ]
    got = {r.doc_id: r.licences for r in licences.licence_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {d: want for d, _, want in rows}


def test_pipeline(spark, tmp_path, wide):
    import corpus_pipeline

    wide.write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), set(wide.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(docs.columns) == columns and docs.count() > 20
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
