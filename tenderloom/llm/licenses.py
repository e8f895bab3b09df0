"""Licence scans by sentence rules.

A text is folded (lower case, line ends and ``.``, ``!``, ``?`` or ``;`` before a blank to one break,
other runs of anything but letters and digits to one blank, so comment marks go), and known sentences
become licence-sentence identifiers.  A sentence starts and ends at a break and may be wrapped at any
breaks in between; "licence" counts as "license", an item number may stand in front.  The sequence of
identifiers is then matched against ordered rules: a rule is a sequence of identifiers that stand
next to one another in the text's sequence; earlier rules win and use up their sentences.

``SENTENCES`` and ``RULES`` are the short forms, which ``OP2_SQL`` knows too; they come first where both
start.  ``NOTICES`` and ``NOTICE_RULES`` add the usual licences and notices as they really read, and wrapped
lines; on texts with these the query finds more than the statement.  A sentence that begins with ``<>`` may
have any words in front; elsewhere ``<>`` is the name of a holder, of up to ``NAME`` characters.

Sentences and rules are small fixed tables of this file and become literals of the plan.

Defined results: a null or empty text, or one without a known sentence, has no licence; repeated
sentences are matched again but named once; repeated rows are scanned row by row; an empty table
gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences in normal form and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-2.0-condition",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the software is provided as is without warranty of any kind": "as-is",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this program is free software": "gpl-free-software",
    "either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "all rights reserved": "all-rights-reserved",
}

# Ordered rules, a sequence of identifiers and the licence it stands for.
RULES = (
    (("apache-2.0-notice", "apache-2.0-condition", "apache-2.0-copy"), "Apache-2.0"),
    (("apache-2.0-notice", "apache-2.0-condition"), "Apache-2.0"),
    (("apache-2.0-notice",), "Apache-2.0"),
    (("mit-grant", "as-is"), "MIT"),
    (("mit-notice",), "MIT"),
    (("mit-grant",), "MIT"),
    (("gpl-free-software", "gpl-3.0-later"), "GPL-3.0-or-later"),
    (("gpl-3.0-notice",), "GPL-3.0-only"),
    (("cc-by-nc-4.0-notice",), "CC-BY-NC-4.0"),
    (("cc-by-4.0-notice",), "CC-BY-4.0"),
    (("bsd-grant", "as-is"), "BSD-3-Clause"),
    (("all-rights-reserved",), "All-Rights-Reserved"),
)

BREAK = r"[\r\n]+|[.!?;][ \t]+"
OTHER = "[^a-z0-9]+"
NAME = 400

_GPL = "you can redistribute it and or modify it under the terms of the gnu{} general public license as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_SHORT = {"2": "2.0", "2 1": "2.1", "3": "3.0"}
_GNU = {"": ("gpl", ("2", "3")), " lesser": ("lgpl", ("2 1", "3")), " library": ("lgpl", ("2",)), " affero": ("agpl", ("3",))}

# Further sentences, identifiers as above.
NOTICES = {
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice",
    "<> licenses this file to you under the apache license version 2 0 the license": "apache-2.0-notice",
    "you may not use this file except in compliance with the apache license version 2 0": "apache-2.0-notice",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2.0-copy",
    "apache license version 2 0 january 2004": "apache-2.0-title",
    "apache license version 2 0": "apache-2.0-title",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "neither the name <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the name of <> may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the names of <> may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "mozilla public license version 2 0": "mpl-2.0-title",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "cc0 1 0 universal": "cc0-1.0-title",
    "creative commons legal code cc0 1 0 universal": "cc0-1.0-title",
}
NOTICE_RULES = (
    (("mit-title", "mit-grant", "mit-condition", "as-is"), "MIT"),
    (("mit-grant", "mit-condition", "as-is"), "MIT"),
    (("mit-title", "mit-grant"), "MIT"),
    (("mit-title",), "MIT"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"), "BSD-4-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("isc-grant",), "ISC"),
    (("apache-2.0-title",), "Apache-2.0"),
    (("mpl-2.0-title", "mpl-2.0-notice"), "MPL-2.0"),
    (("mpl-2.0-title",), "MPL-2.0"),
    (("mpl-2.0-notice",), "MPL-2.0"),
    (("unlicense-notice",), "Unlicense"),
    (("cc0-1.0-title",), "CC0-1.0"),
)

# The GNU licences: titles, and the notice for a program, a library or a named work; without a version of its
# own the notice's second half belongs to the licence that its first half names.
for _kind, (_name, _versions) in _GNU.items():
    NOTICES["<> is free software"] = "gpl-free-software"
    NOTICES[_GPL.format(_kind)] = f"{_name}-terms"
    for _v in _versions:
        _id = f"{_name}-{_SHORT[_v]}"
        NOTICES[f"{_GPL.format(_kind)} {_LATER.format(_v)}"] = f"{_id}-notice-later"
        NOTICES[f"<> is free software you can {_GPL.format(_kind)[8:]} {_LATER.format(_v)}"] = f"{_id}-notice-later"
        for _of in (f"version {_v} of the license", f"version {_v}"):
            NOTICES[f"{_GPL.format(_kind)} {_of}"] = f"{_id}-notice-only"
            NOTICES[f"<> is free software you can {_GPL.format(_kind)[8:]} {_of}"] = f"{_id}-notice-only"
        NOTICES[f"gnu{_kind} general public license version {_v}"] = f"{_id}-title"
        for _date in ("june 1991", "february 1999", "29 june 2007", "19 november 2007"):
            NOTICES[f"gnu{_kind} general public license version {_v} {_date}"] = f"{_id}-title"
        if _id != "gpl-3.0":
            NOTICES[f"this work is licensed under the gnu{_kind} general public license version {_v}"] = f"{_id}-title"
        if _v != "3":
            NOTICES[_LATER.format(_v)] = f"gnu-{_SHORT[_v]}-later"
        _later = "gpl-3.0-later" if _v == "3" else f"gnu-{_SHORT[_v]}-later"
        _spdx = _id.upper()
        NOTICE_RULES += (
            ((f"{_id}-title", f"{_id}-notice-later"), f"{_spdx}-only"),  # a whole licence ends with its notice
            ((f"{_id}-title", "gpl-free-software", f"{_name}-terms", _later), f"{_spdx}-only"),
            ((f"{_id}-title",), f"{_spdx}-only"),
            ((f"{_id}-notice-only",), f"{_spdx}-only"),
            (("gpl-free-software", f"{_name}-terms", _later), f"{_spdx}-or-later"),
            ((f"{_name}-terms", _later), f"{_spdx}-or-later"),
            ((f"{_id}-notice-later",), f"{_spdx}-or-later"),
        )
for _spdx in dict.fromkeys([name for _, name in (*RULES, *NOTICE_RULES) if name != "All-Rights-Reserved"]):
    _words = "".join(c if c.isalnum() else " " for c in _spdx.lower())
    NOTICES[f"spdx license identifier {_words}"] = f"spdx-{_spdx.lower()}"
    NOTICE_RULES += (((f"spdx-{_spdx.lower()}",), _spdx),)
for _kind in ("", "sa ", "nd ", "nc ", "nc sa ", "nc nd "):
    _title = {"": "", "sa ": "sharealike ", "nd ": "noderivatives ", "nc ": "noncommercial ", "nc sa ": "noncommercial sharealike ", "nc nd ": "noncommercial noderivatives "}[_kind]
    _id = f"cc-by-{_kind.strip().replace(' ', '-')}{'-' if _kind else ''}4.0-notice"
    for _lead in ("licensed under", "this work is licensed under", "this work is licensed under a", "this work is licensed under the"):
        for _long in (f"cc by {_kind}4 0", f"creative commons attribution {_title}4 0 international license", f"creative commons attribution {_title}4 0 international"):
            NOTICES[f"{_lead} {_long}"] = _id
    if ((_id,), _id.removesuffix("-notice").upper()) not in RULES:
        NOTICE_RULES += (((_id,), _id.removesuffix("-notice").upper()),)
ALL_SENTENCES = NOTICES | SENTENCES
ALL_RULES = (*NOTICE_RULES, *RULES)


def _pattern(sentence: str) -> str:
    """Words between single blanks or breaks."""
    words = [f"[a-z0-9 \\n]{{1,{NAME}}}?" if w == "<>" else w.replace("license", "licen[cs]e") for w in sentence.split()]
    return "[ \\n]".join(words)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    broken = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAK, "\n")
    folded = F.regexp_replace(F.regexp_replace(broken, "[^a-z0-9\\n]+", " "), "[ \\n]*\\n[ \\n]*", "\n")
    line = F.concat(F.lit("\n"), F.trim(folded), F.lit("\n"))
    # The short forms first, then longer ones before the shorter ones that they begin with.
    order = [*SENTENCES, *sorted(set(NOTICES) - set(SENTENCES), key=lambda s: (-len(s), s))]
    open_end = [s.removeprefix("<> ") for s in order if s.startswith("<> ")]
    whole = [s for s in order if not s.startswith("<> ")]
    ways = ("|".join(map(_pattern, group)) for group in (whole, open_end))
    any_of = "((?<=\\n(?:[0-9]{{1,2}} |i{{1,3}} )?)(?:{})|(?<=[ \\n])(?:{}))(?=\\n)".format(*ways)
    plain = {s.removeprefix("<> "): i for s, i in ALL_SENTENCES.items()}
    known = F.create_map(*[F.lit(x) for pair in plain.items() if "<>" not in pair[0] for x in pair])
    named = [(f"^(?:{_pattern(s)})$", i) for s, i in plain.items() if "<>" in s]

    def of(found: Column) -> Column:
        plain = F.replace(F.translate(found, "\n", " "), F.lit("licence"), F.lit("license"))
        return F.coalesce(F.element_at(known, plain), *[F.when(found.rlike(p), F.lit(i)) for p, i in named])

    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(any_of), F.lit(1)), of), lambda x: x.isNotNull())


def match_rules(ids: Column) -> Column:
    """Licences of the rules that match; a rule takes its sentences out of the sequence for later rules."""
    # The sequence is written as |id|id|, so that neighbouring rules share no mark.
    line = F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("|"))), "|"))
    rules = F.array(
        *[F.struct(F.lit("|" + "||".join(r) + "|").alias("ids"), F.lit(name).alias("name")) for r, name in ALL_RULES]
    )

    def step(acc: Column, rule: Column) -> Column:
        gone = F.replace(acc["line"], rule["ids"], F.lit("#"))
        more = F.when(gone != acc["line"], F.array(rule["name"])).otherwise(F.array().cast("array<string>"))
        return F.struct(gone.alias("line"), F.concat(acc["names"], more).alias("names"))

    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(rules, start, step, lambda acc: F.array_distinct(acc["names"]))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, the licences of each text in the order of the rules, and its sentence identifiers."""
    rows = docs.select("doc_id", sentence_ids(F.col("text")).alias("ids"))
    found = F.col("found")
    none = F.array().cast("array<string>")
    hit = rows.select("doc_id", "ids", F.when(F.size("ids") > 0, match_rules(F.col("ids"))).otherwise(none).alias("found"))
    return hit.select(
        "doc_id",
        F.array_join(found, ",").alias("licenses"),
        F.size(found).cast("long").alias("n_licenses"),
        F.array_join("ids", ",").alias("sentences"),
        F.size("ids").cast("long").alias("n_sentences"),
    )


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = [], "lines"
    for n, (rule, _) in enumerate(RULES):
        pattern = "|" + "||".join(rule) + "|"
        steps.append(
            f"r{n} AS (SELECT *, replace(l{n}, '{pattern}', '#') AS l{n + 1} FROM {last})"
        )
        last = f"r{n}"
    names = ", ".join(f"CASE WHEN l{n + 1} <> l{n} THEN '{name}' END" for n, (_, name) in enumerate(RULES))
    return f"""
WITH known(s, id) AS (VALUES {known}),
parts AS (
  SELECT doc_id, rowid AS r, unnest(regexp_split_to_array(coalesce(text, ''), '{BREAK}')) AS part,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '{BREAK}'), 1) AS n
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), ids AS (
  SELECT r, string_agg(id, ',' ORDER BY n) AS sentences, '|' || string_agg(id || '|', '|' ORDER BY n) AS l0, count(*) AS k
  FROM parts JOIN known ON trim(regexp_replace(lower(part), '{OTHER}', ' ', 'g')) = s
  GROUP BY r
), lines AS (SELECT * FROM ids),
{", ".join(steps)},
named AS (SELECT r, sentences, k, list_filter([{names}], lambda x: x IS NOT NULL) AS found FROM {last}),
once AS (
  SELECT r, sentences, k,
         list_filter(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN list_position(found, found[i]) = i THEN found[i] END), lambda x: x IS NOT NULL) AS found
  FROM named
)
SELECT d.doc_id, coalesce(array_to_string(found, ','), '') AS licenses, coalesce(len(found), 0)::BIGINT AS n_licenses,
       coalesce(sentences, '') AS sentences, coalesce(k, 0)::BIGINT AS n_sentences
FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN once ON d.r = once.r
"""


OP2_SQL = _sql()
