"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, at line ends and after ``. ; : ! ?`` before a blank; a second reading joins the
lines of a paragraph first, for wrapped licence texts, and is taken when it recognises more (of equal numbers, more
besides copyright notices: a wrapped line may begin with that word).  A normalised
sentence (ASCII lower case, other signs to one blank, licence spelt license, a copyright notice reduced to
that word) maps to a known identifier.  Rules are ordered lists of identifiers; a rule matches when its
identifiers occur in that order, others between allowed.  Within a family (one version of a licence, and the BSD
texts, of which the longer holds the shorter) only the first matching rule counts, so a longer licence comes before one
that it contains; licences of different families are all named.  Nothing is shuffled.

An SPDX line is taken out before the cut: each identifier of its expression (also after ``OR``, ``AND``) is a
sentence of its own, exceptions after ``WITH`` are not read.  ``licence_sql`` has the tables ``SENTENCES`` and
``RULES`` only, cuts SPDX lines after the colon and takes the first reading of equal ones; it says the same for texts
without SPDX lines, named holders or sentences of ``MORE_SENTENCES``, and where no such tie is decided.

Cases: null and empty texts have no sentence and no licence; a sentence that occurs twice is listed twice, a
licence once; texts are read whole; null and repeated ids are rows like others; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of public licences, normalised, and their identifiers (fixed values).
SENTENCES = {
    "copyright": "copyright",
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "this project is licensed under the mit license": "mit-line",
    "spdx license identifier mit": "mit-line",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-line",
    "licensed under the apache license version 2 0 the license": "apache-header",
    "spdx license identifier apache 2 0": "apache-line",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "this work is licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the gnu general public license version 3": "gpl3-line",
    "spdx license identifier gpl 3 0 only": "gpl3-line",
    "spdx license identifier gpl 3 0 or later": "gpl3-later-line",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc-line",
    "licensed under cc by 4 0": "cc-by-line",
    "licensed under cc by sa 4 0": "cc-by-sa-line",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-line",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-line",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-line",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "spdx license identifier bsd 3 clause": "bsd3-line",
    "spdx license identifier bsd 2 clause": "bsd2-line",
}

#: Ordered rules: licence, family, identifiers in order (fixed values).
RULES = (
    ("MIT", "mit", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", "mit", ("mit-line",)),
    ("MIT", "mit", ("mit-title", "mit-grant")),
    ("Apache-2.0", "apache", ("apache-header", "apache-compliance")),
    ("Apache-2.0", "apache", ("apache-line",)),
    ("GPL-3.0-or-later", "gpl3", ("gpl-free", "gpl3-terms")),
    ("GPL-3.0-or-later", "gpl3", ("gpl3-later-line",)),
    ("GPL-3.0-only", "gpl3", ("gpl3-line",)),
    ("GPL-2.0-or-later", "gpl2", ("gpl-free", "gpl2-terms")),
    ("CC-BY-NC-4.0", "cc-by-nc", ("cc-by-nc-line",)),
    ("CC-BY-SA-4.0", "cc-by-sa", ("cc-by-sa-line",)),
    ("CC-BY-4.0", "cc-by", ("cc-by-line",)),
    ("BSD-3-Clause", "bsd", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", "bsd", ("bsd3-line",)),
    ("BSD-2-Clause", "bsd", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", "bsd", ("bsd2-line",)),
)

_SPDX_IDS = {
    "gpl 2 0": "gpl2-only-line", "gpl 2 0 only": "gpl2-only-line", "gpl 2 0 or later": "gpl2-later-line", "gpl 3 0": "gpl3-line",
    "lgpl 2 0": "lgpl2-line", "lgpl 2 0 only": "lgpl2-line", "lgpl 2 0 or later": "lgpl2-later-line",
    "lgpl 2 1": "lgpl21-line", "lgpl 2 1 only": "lgpl21-line", "lgpl 2 1 or later": "lgpl21-later-line",
    "lgpl 3 0": "lgpl3-line", "lgpl 3 0 only": "lgpl3-line", "lgpl 3 0 or later": "lgpl3-later-line",
    "agpl 3 0": "agpl3-line", "agpl 3 0 only": "agpl3-line", "agpl 3 0 or later": "agpl3-later-line",
    "mpl 2 0": "mpl2-line", "isc": "isc-line", "epl 1 0": "epl1-line", "epl 2 0": "epl2-line", "cc0 1 0": "cc0-line", "unlicense": "unlicense-line", "0bsd": "0bsd-line",
    "cc by 4 0": "cc-by-line", "cc by sa 4 0": "cc-by-sa-line", "cc by nc 4 0": "cc-by-nc-line",
}
_TERMS = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_LICENSED = ("licensed under the {}", "this project is licensed under the {}", "this work is licensed under the {}", "released under the {}")
_TITLES = {
    "gpl2": ("gnu general public license", "version 2 june 1991"), "gpl3": ("gnu general public license", "version 3 29 june 2007"),
    "lgpl2": ("gnu library general public license", "version 2 june 1991"), "lgpl21": ("gnu lesser general public license", "version 2 1 february 1999"),
    "lgpl3": ("gnu lesser general public license", "version 3 29 june 2007"), "agpl3": ("gnu affero general public license", "version 3 19 november 2007"),
    "apache": ("apache license", "version 2 0 january 2004"),
}
_NAMES = {
    "gpl2-only-line": ("gnu general public license version 2", "gnu gpl version 2", "gnu gpl v2"), "gpl3-line": ("gnu gpl version 3", "gnu gpl v3"),
    "lgpl21-line": ("gnu lesser general public license version 2 1", "gnu lgpl version 2 1", "gnu lgpl v2 1"), "lgpl3-line": ("gnu lesser general public license version 3", "gnu lgpl version 3", "gnu lgpl v3"),
    "agpl3-line": ("gnu affero general public license version 3", "gnu agpl version 3", "gnu agpl v3"), "mpl2-line": ("mozilla public license 2 0", "mozilla public license version 2 0"),
    "isc-line": ("isc license",), "epl2-line": ("eclipse public license 2 0", "eclipse public license version 2 0"), "unlicense-line": ("unlicense",),
}

#: Sentences and rules that the SQL twin does not have (fixed values).
MORE_SENTENCES = (
    {f"spdx license identifier {s}": i for s, i in _SPDX_IDS.items()}
    | {way.format(s): i for i, names in _NAMES.items() for s in names for way in _LICENSED}
    | {name: f"{k.rstrip('123')}-name" for k, (name, _) in _TITLES.items() if k != "lgpl2"}
    | {"gnu library general public license": "library-name"}
    | {date: date.replace(" ", "-") for _, date in _TITLES.values()}
    | {f"{name} {date}": f"{k}-title" for k, (name, date) in _TITLES.items()}
    | {"apache license version 2 0 january 2004 http www apache org licenses": "apache-title", "apache license version 2 0 january 2004 https www apache org licenses": "apache-title"}
    | {_TERMS.format(f"{k}general public license"): f"{n}-terms" for k, n in (("", "gpl"), ("lesser ", "lgpl"), ("library ", "library"), ("affero ", "agpl"))}
    | {_LATER.format(v): f"later-{v.replace(' ', '-')}" for v in ("2", "2 1", "3")}
    | {_TERMS.format(f"{k}general public license") + " " + _LATER.format(v): f"{n}{v.replace(' ', '')}-terms" for k, n in (("lesser ", "lgpl"), ("library ", "library"), ("affero ", "agpl")) for v in ("2", "2 1", "3")}
    | {f"you can redistribute it and or modify it under the terms of the gnu {k}general public license version {v} as published by the free software foundation": i
       for k, v, i in (("", "2", "gpl2-only-line"), ("", "3", "gpl3-line"), ("lesser ", "2 1", "lgpl21-line"), ("lesser ", "3", "lgpl3-line"), ("affero ", "3", "agpl3-line"))}
    | {"this library is free software": "gpl-free"}
    | {f"if a copy of the mpl was not distributed with this file you can obtain one at {h} mozilla org mpl 2 0": "mpl2-copy" for h in ("http", "https")}
    | {
        "mozilla public license version 2 0": "mpl2-title",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
        "eclipse public license v 1 0": "epl1-title",
        "eclipse public license v 2 0": "epl2-title",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-terms",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
        "cc0 1 0 universal": "cc0-title",
        "creative commons legal code cc0 1 0 universal": "cc0-title",
        "this is free and unencumbered software released into the public domain": "unlicense-grant",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    }
)

MORE_RULES = (
    ("Apache-2.0", "apache", ("apache-title",)),
    ("Apache-2.0", "apache", ("apache-name", "version-2-0-january-2004")),
    ("GPL-3.0-or-later", "gpl3", ("gpl-free", "gpl-terms", "later-3")),
    ("GPL-2.0-or-later", "gpl2", ("gpl-free", "gpl-terms", "later-2")),
    ("GPL-2.0-or-later", "gpl2", ("gpl2-later-line",)),
    ("GPL-2.0-only", "gpl2", ("gpl2-only-line",)),
    ("GPL-3.0-only", "gpl3", ("gpl3-title",)),
    ("GPL-3.0-only", "gpl3", ("gpl-name", "version-3-29-june-2007")),
    ("GPL-2.0-only", "gpl2", ("gpl2-title",)),
    ("GPL-2.0-only", "gpl2", ("gpl-name", "version-2-june-1991")),
    *[(f"LGPL-{v}-or-later", f"lgpl-{v}", i) for v, t in (("3.0", "3"), ("2.1", "2 1")) for i in ((f"lgpl{t.replace(' ', '')}-terms",), ("lgpl-terms", f"later-{t.replace(' ', '-')}"), (f"lgpl{t.replace(' ', '')}-later-line",))],
    *[("LGPL-2.0-or-later", "lgpl-2.0", i) for i in (("library2-terms",), ("library-terms", "later-2"), ("lgpl2-later-line",))],
    *[(f"LGPL-{v}-only", f"lgpl-{v}", i) for v, k, name in (("3.0", "lgpl3", "lgpl-name"), ("2.1", "lgpl21", "lgpl-name"), ("2.0", "lgpl2", "library-name")) for i in ((f"{k}-line",), (f"{k}-title",), (name, _TITLES[k][1].replace(" ", "-")))],
    *[("AGPL-3.0-or-later", "agpl", i) for i in (("agpl3-terms",), ("agpl-terms", "later-3"), ("agpl3-later-line",))],
    *[("AGPL-3.0-only", "agpl", i) for i in (("agpl3-line",), ("agpl3-title",), ("agpl-name", "version-3-19-november-2007"))],
    *[("MPL-2.0", "mpl", (i,)) for i in ("mpl2-copy", "mpl2-line", "mpl2-title")],
    *[("ISC", "isc", (i,)) for i in ("isc-grant", "isc-line")],
    *[("0BSD", "0bsd", (i,)) for i in ("0bsd-grant", "0bsd-line")],
    *[("EPL-2.0", "epl2", (i,)) for i in ("epl2-terms", "epl2-line", "epl2-title")],
    *[("EPL-1.0", "epl1", (i,)) for i in ("epl1-terms", "epl1-line", "epl1-title")],
    *[("CC0-1.0", "cc0", (i,)) for i in ("cc0-waived", "cc0-line", "cc0-title")],
    *[("Unlicense", "unlicense", (i,)) for i in ("unlicense-grant", "unlicense-free", "unlicense-line")],
)

#: Sentences that name a holder or a work: the pattern of the whole sentence, a part that it holds, the sentence or identifier it stands for.
NAMED = (
    ("^([0-9]+ )?neither the names? of .+ nor the names? of (its|the|any|other) contributors may be used to endorse or promote products derived from this software without specific prior written permission$", "neither the name",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("^the names? of .+ may not be used to endorse or promote products derived from this software without specific prior written permission$", "may not be used to endorse",
     "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("^to the extent possible under law .* ?ha(s|ve) waived all copyright and related or neighboring rights to .+$", "waived all copyright", "cc0 waived copyright"),
)
MORE_SENTENCES["cc0 waived copyright"] = "cc0-waived"

#: Each known sentence holds one of these, each a part of one word, so a text without any needs no cutting however its words are separated.
TRIGGERS = ("copyright", "licens", "licenc", "permission", "software", "redistribut", "gnu", "cc0", "mozilla", "1991", "1999", "2004", "2007")

_ID = "[a-z0-9][a-z0-9.+-]*"
_SPDX = f"spdx-license-identifier:[ \\t]*((?:\\([ \\t]*)*{_ID}(?:[ \\t]*\\))*(?:[ \\t]+(?:or|and|with)[ \\t]+(?:\\([ \\t]*)*{_ID}(?:[ \\t]*\\))*)*)"
_DOTTED = "(neither\\s+the\\s+names?\\s+of\\s[^;:]{0,200}?)\\.(?=\\s[^;:]{0,200}?nor\\s+the\\s+names?\\s+of\\s)"
_TAG, _MARK = "spdx-license-identifier:", "\x01"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marked(low: Column) -> Column:
    """SPDX expressions stand between marks, which end sentences in both readings; up to three points in a holder's name go."""
    bare = low
    for _ in range(3):
        bare = F.regexp_replace(bare, _DOTTED, "$1")
    low = F.when(low.rlike(_DOTTED), bare).otherwise(low)
    return F.when(F.contains(low, F.lit(_TAG)), F.regexp_replace(low, _SPDX, f"{_MARK}{_TAG}$1{_MARK}")).otherwise(low)


def _spdx_sentences(s: Column) -> Column:
    """One sentence for each licence of an expression."""
    bare = F.regexp_replace(F.substring(s, len(_TAG) + 1, 1 << 30), f"[ \\t]with[ \\t]+{_ID}", "")
    return F.transform(F.split(bare, "[ \\t()]+(?:(?:or|and)[ \\t()]+)*"), lambda x: F.concat(F.lit(_TAG), F.regexp_replace(x, "\\+$", " or later")))


def _identifiers(low: Column, known: Column) -> Column:
    ended = F.translate(F.regexp_replace(low, "([.;:!?])[ \\t\\r\\n]+", "$1\n"), _MARK, "\n")
    cut = F.flatten(F.transform(F.split(ended, "\n+"), lambda s: F.when(s.startswith(_TAG), _spdx_sentences(s)).otherwise(F.array(s))))
    plain = F.transform(cut, lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), "licence", "license"))
    plain = F.transform(plain, lambda s: F.when(s.startswith("copyright ") & ~F.contains(s, F.lit(" license")), F.lit("copyright")).otherwise(s))
    plain = F.transform(plain, lambda s: F.coalesce(*[F.when(F.contains(s, F.lit(part)) & s.rlike(pattern), F.lit(known_as)) for pattern, part, known_as in NAMED], s))
    return F.filter(F.transform(plain, lambda s: F.element_at(known, s)), lambda s: s.isNotNull())


def _pattern(ids: tuple[str, ...]) -> str:
    return "\\|" + "\\|(.*\\|)?".join(ids) + "\\|"


def licence_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES | MORE_SENTENCES, rules=RULES + MORE_RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_sentences recognised, sentence_ids and licences, both in order and joined by a blank."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    low = F.translate(F.col(text), _UPPER, _LOWER)
    got = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(text).rlike("(?i)" + "|".join(TRIGGERS)), _marked(low)).alias("low"))
    joined = F.regexp_replace(F.regexp_replace(F.col("low"), "\n[ \\t\\r]*\n[ \\t\\r\\n]*", "\r\r"), "\n", " ")
    got = got.select("doc_id", _identifiers(F.col("low"), known).alias("a"), _identifiers(F.regexp_replace(joined, "\r\r", "\n"), known).alias("b"))
    told = lambda c: F.size(F.filter(c, lambda i: i != "copyright"))
    ids = F.coalesce(F.when((F.size("b") > F.size("a")) | ((F.size("b") == F.size("a")) & (told("b") > told("a"))), F.col("b")).otherwise(F.col("a")), F.array().cast("array<string>"))
    got = got.select("doc_id", ids.alias("ids")).withColumn("seq", F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")))
    families = dict.fromkeys(f for _, f, _ in rules)
    found = [F.coalesce(*[F.when(F.col("seq").rlike(_pattern(i)), F.lit(n)) for n, f, i in rules if f == family]) for family in families]
    return got.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.concat_ws(" ", *found).alias("licences"))


def licence_sql(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The same scan for a database that has lists and RE2 patterns."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in sentences.items()) + "}"
    cut = ("list_filter(list_transform(list_transform(list_transform(string_split_regex(regexp_replace({t}, '([.;:!?])[ \\t\\r\\n]+', '\\1\n', 'g'), '\n+'), "
           "lambda s: replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), 'licence', 'license')), "
           "lambda s: CASE WHEN starts_with(s, 'copyright ') AND NOT contains(s, ' license') THEN 'copyright' ELSE s END), lambda s: k[s]), lambda s: s IS NOT NULL)")
    wrapped = "regexp_replace(replace(regexp_replace(low, '\n[ \\t\\r]*\n[ \\t\\r\\n]*', '\r\r', 'g'), '\n', ' '), '\r\r', '\n', 'g')"
    families = dict.fromkeys(f for _, f, _ in rules)
    each = ["coalesce(" + ", ".join(f"CASE WHEN regexp_matches(seq, '{_pattern(i)}') THEN '{n}' END" for n, f, i in rules if f == family) + ")" for family in families]
    return (f"WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS low, {known} AS k FROM documents), "
            f"c AS (SELECT doc_id, {cut.format(t='low')} AS a, {cut.format(t=wrapped)} AS b FROM d), "
            "i AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids FROM c), "
            "s AS (SELECT doc_id, ids, '|' || coalesce(array_to_string(ids, '|'), '') || '|' AS seq FROM i) "
            "SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, concat_ws(' ', " + ", ".join(each) + ") AS licences FROM s")
