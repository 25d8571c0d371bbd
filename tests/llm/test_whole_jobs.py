"""Stages return their whole job: skewed sources, similarity between 0.8 and 0.9, rare languages."""

import numpy as np
import pytest

import corpus_pipeline
from tidepanel.llm import licences, mixing, ngram_join, quality
from test_text_operators import brute_components


def test_mixture_stage_loses_no_document(spark):
    """A source with one document, one with a few and a null source end long before the hot one does."""
    rows = [(i, "t", "en", "hot" if i < 900 else "few" if i < 990 else None if i < 999 else "one", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [r.doc_id for r in corpus_pipeline.mixture(spark, docs, "").collect()]
    assert sorted(got) == list(range(1000))
    place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    assert [place[d] for d in got] == list(range(1000))


def test_token_ids_carry_the_place_in_the_mixture(spark, tmp_path):
    rows = [(i, f"text {i}", "hot" if i < 150 else "few") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    corpus_pipeline.mixture(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.token_ids(spark, spark.read.parquet(f"{tmp_path}/mixed"), "")
    assert {r.doc_id: r.position for r in got.collect()} == {r.doc_id: r.position for r in mixing.mix(docs).collect()}


def test_near_copies_stage_takes_similarity_of_80_percent(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [base, base + [f"x{i}" for i in range(20)], base + [f"y{i}" for i in range(30)], [f"z{i}" for i in range(100)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2, 3]  # 96/116, 96/126


@pytest.mark.parametrize("frequent", [0, 3, 10])
def test_keys_of_linked_sets_meet_at_80_percent(frequent):
    """Every number of tokens in x only, y only and both that links, for sizes from the smallest on."""
    rng, setting = np.random.default_rng(6), ngram_join.Setting(width=5, percent=80, sketch_bits=10)
    for common in range(3, 41):
        for only_x in range(11):
            for only_y in range(1, 11):
                if 100 * common < 80 * (common + only_x + only_y):
                    continue
                for _ in range(6):
                    u = np.unique(rng.integers(0, 1 << 63, common + only_x + only_y).astype(np.uint64))
                    rng.shuffle(u)
                    x, y = np.sort(u[: common + only_x]), np.sort(np.append(u[:common], u[common + only_x :]))
                    levels = rng.integers(0, 10, 1 << 10).astype(np.uint8)
                    assert np.intersect1d(ngram_join.keys_of(x, levels, frequent, setting), ngram_join.keys_of(y, levels, frequent, setting)).size


def test_short_sets_are_those_of_four_and_five_tokens():
    assert [n for n in range(60) if ngram_join.too_short(n, corpus_pipeline.NEAR)] == [4, 5]
    assert not any(ngram_join.too_short(n, ngram_join.Setting()) for n in range(500))  # op5's keys are as before


@pytest.mark.parametrize("share,least", [(1e-3, 64), (0.0, 2)])
def test_jaccard_at_80_percent_matches_brute_force(spark, share, least):
    """Chains of edits of all lengths, short texts among them; the second setting makes all shared tokens frequent."""
    rng, rows = np.random.default_rng(4), []
    for n in (8, 8, 8, 9, 9, 10, 12, 13, 20, 60, 150):
        words = [f"v{x}" for x in rng.integers(0, 10_000, n)]
        for _ in range(9):
            rows.append((len(rows), " ".join(words)))
            words = [*words, f"v{rng.integers(0, 10_000)}"] if rng.random() < 0.6 else words[1:] if len(words) > 7 else words
    setting = ngram_join.Setting(width=5, percent=80, frequent_share=share, frequent_least=least, sketch_bits=18)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), setting).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(rows, 80, 5)


def test_quality_keeps_small_languages(spark):
    """Clean texts of rare or null languages in other scripts or words stay, junk goes; a rare language with enough words is judged by its own."""
    rng = np.random.default_rng(7)

    def prose(letters, common, n=150):
        word = lambda: "".join(rng.choice(list(letters), int(rng.integers(3, 8))))
        return ". ".join(" ".join(str(rng.choice(common)) if rng.random() < 0.4 else word() for _ in range(n // 10)) for _ in range(10)) + "."

    junk = lambda: " ".join("".join(rng.choice(list("#$%&*"), 6)) + str(rng.integers(10**6)) for _ in range(150))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыэюя"
    rows = [(prose(latin, ["the", "of", "and", "to", "in"]), "en", True) for _ in range(1200)]
    rows += [(prose(cyrillic, ["и", "в", "не", "на"], 2500), "ru", True) for _ in range(5)] + [(junk() * 4, "ru", False)]  # 0.4 % and 12,500 words
    rows += [(prose(cyrillic, ["да", "се", "на"]), "bg", True), (prose(cyrillic, ["да"]), None, True), (prose(latin, ["ja", "ei", "on"]), "fi", True), (prose(latin, ["ja", "ei"]), None, True)]
    rows += [(" ".join("".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 50)) for _ in range(14)), lang, True) for lang in ("zh", None)]
    rows += [(junk(), "bg", False), (junk(), None, False), (junk(), "xx", False)]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert [i for i, (_, _, kept) in enumerate(rows) if got[i].kept != kept] == []
    assert all((got[i].word_distance is None) == (k not in ("en", "ru")) for i, (_, k, kept) in enumerate(rows) if kept)
    assert {r.doc_id for r in quality.keep(docs).select("doc_id").collect()} == {i for i, (_, _, kept) in enumerate(rows) if kept}
    few = quality.references(docs, quality.Rules(most_references=1))
    assert set(few) == {"en", None}


def test_licence_headers_and_titles(spark):
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
   the documentation and/or other materials provided with the distribution.
3. Neither the name of Example, Inc. nor the names of its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    terms = "This {} is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version."
    texts = {
        "// SPDX-License-Identifier: MIT\n#include <a.h>": "MIT",
        "/* SPDX-License-Identifier: Apache-2.0 */ int x;": "Apache-2.0",
        "# SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
        "# Copyright 2020 X\n# SPDX-License-Identifier: GPL-3.0-or-later\nimport os\n": "GPL-3.0-or-later",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause.": "BSD-2-Clause",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT Apache-2.0",
        "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "GPL-2.0-only", "spdx-license-identifier:LGPL-2.1+": "LGPL-2.1-or-later",
        "SPDX-License-Identifier: Apache-2.0 (it was MIT once)": "Apache-2.0", "See SPDX-License-Identifier: for the license": "",
        "SPDX-License-Identifier: MPL-2.0 AND (ISC OR CC0-1.0)": "MPL-2.0 ISC CC0-1.0",
        terms.format("program", ";", "", ";", "2"): "GPL-2.0-or-later", terms.format("program", ":", "", ",", "3"): "GPL-3.0-or-later",
        terms.format("library", ";", "Lesser ", ";", "2.1"): "LGPL-2.1-or-later", terms.format("program", ":", "Affero ", ",", "3"): "AGPL-3.0-or-later",
        terms.format("program", ":", "Lesser ", ",", "3"): "LGPL-3.0-or-later", terms.format("library", ";", "Library ", ";", "2"): "LGPL-2.0-or-later",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n": "GPL-3.0-only",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n": "GPL-2.0-only", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n": "LGPL-2.1-only",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n": "AGPL-3.0-only",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS": "Apache-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
        "To the extent possible under law, Jo Doe has waived all copyright and related or neighboring rights to Words.": "CC0-1.0", "CC0 1.0 Universal": "CC0-1.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        bsd: "BSD-3-Clause",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.licence_scan(docs).collect()}
    assert [(t, got[i], want) for i, (t, want) in enumerate(texts.items()) if got[i] != want] == []
    ids = set(licences.SENTENCES.values()) | set(licences.MORE_SENTENCES.values())
    assert all(i in ids for _, _, rule in licences.RULES + licences.MORE_RULES for i in rule)
