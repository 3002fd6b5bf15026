"""Licence recognition by sentence rules.

A text is read in ASCII lower case. Line ends with the indentation and the comment mark behind them count as a blank,
so a sentence may run over lines; blank lines, and '.', '!', '?' and ':' before white space end it ("v. 2" and
"spdx-license-identifier:" don't). A sentence is normalised (runs of anything but letters, digits, '.' and '+' become
one blank; blanks and full stops at the ends go) and mapped to an identifier: that of a known licence sentence that it
equals, of the licence that it refers to by name anywhere in it ("... licensed under the MIT License, see ..."), or of
the one or two licences of an SPDX tag. What isn't known is passed over; the identifiers found, in order, are the
text's sequence. A rule names a licence and identifiers that must follow each other in the sequence, with others
between them or not; where a rule that holds all identifiers of another matches, that other one doesn't count. A
licence is reported once however often it occurs.

Everything is an expression inside the scan: no shuffle, no Python. Null, empty and letterless texts have an empty
sequence and no licence. Repeated rows each get a row, empty tables none; very long texts are read whole; ties can't
arise; columns of any other name, clashing ones too, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Names under which licences are referred to, as normalised text, and their identifiers.
NAMES = {
    "mit license": "MIT",
    "expat license": "MIT",
    "apache license version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache 2.0 license": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu general public license v2": "GPL-2.0",
    "gnu general public license v3": "GPL-3.0",
    "gnu general public license v3.0": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "boost software license version 1.0": "BSL-1.0",
    "eclipse public license 2.0": "EPL-2.0",
    "zlib license": "Zlib",
    "cc by 4.0": "CC-BY-4.0",
    "cc by sa 4.0": "CC-BY-SA-4.0",
    "cc by nc 4.0": "CC-BY-NC-4.0",
    "cc by nc sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by nd 4.0": "CC-BY-ND-4.0",
    "cc by nc nd 4.0": "CC-BY-NC-ND-4.0",
    "cc0 1.0": "CC0-1.0",
    "creative commons attribution 4.0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4.0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4.0 international license": "CC-BY-NC-4.0",
}
# How sentences refer to a licence by name, a pattern.
REFERENCE = "(?:licensed|released|distributed|available|provided|published|covered) under (?:the terms of )?(?:the |an? )?"
TAG = "spdx license identifier "
# Sentences of licence texts and notices, normalised, and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "apache-notice",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-useful",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-useful",
    "this source code form is subject to the terms of the mozilla public license v.2.0": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl-copy",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
# Ordered rules, a licence and the identifiers that follow each other.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("MPL-2.0", ("mpl-terms",)),
    ("Unlicense", ("unlicense",)),
)
# Further identifiers that a tag may name.
TAGS = ("GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "0BSD")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No known sentence lacks all of these.
SIGNS = "licen|permi|redistribut|free software|unencumbered|hope that it|software is provided|software foundation|shall|mpl|under"
# What is replaced before sentences are cut, in order, and by what: $1 is the group. CUT stands where a sentence ends.
CUT = "\x01"
STEPS = (
    ("\r\n?", "\n"),
    (r"\n[ \t\f]*(?://+!?|#+|/?\*+/?|;+|-+|%+|<!--)?[ \t\f]*", "\n"),
    (r"([^a-z0-9]v)\. +", "$1."),
    (r"spdx-license-identifier:[ \t]*", TAG),
    (r"\n\n+", CUT),
    (r"([.!?:])[ \t\n\f]+", "$1" + CUT),
)
NORMAL = (("[^a-z0-9.+]+", " "), ("^[ .]+|[ .]+$", ""))


def tags() -> dict[str, str]:
    """Normalised SPDX identifiers and the identifiers."""
    names = {*NAMES.values(), *(name for name, _ in RULES), *TAGS}
    return {x.lower().replace("-", " "): x for x in sorted(names)}


def _any_of(names: dict[str, str]) -> str:
    """A pattern for any of the names, the longest that fits."""
    return "(" + "|".join(n.replace(".", r"\.").replace("+", r"\+") for n in sorted(names, key=lambda n: (-len(n), n))) + ")"


def reference_pattern() -> str:
    return f"{REFERENCE}{_any_of(NAMES)}(?: |$)"


def tag_pattern() -> str:
    return f"^{TAG}{_any_of(tags())}(?: (?:or|and) {_any_of(tags())})?(?: |$)"


def rules() -> list[tuple[str, tuple[str, ...]]]:
    named = [(x, (f"ref-{x}",)) for x in sorted(set(NAMES.values()))]
    return [*RULES, *named, *((x, (f"spdx-{x}",)) for x in sorted(tags().values()))]


def wider(rule: tuple[str, tuple[str, ...]], known: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, ...]]:
    """Rules that hold all identifiers of a rule in order, and more."""

    def holds(ids: tuple[str, ...]) -> bool:
        rest = iter(ids)
        return len(ids) > len(rule[1]) and all(x in rest for x in rule[1])

    return [ids for _, ids in known if holds(ids)]


def sequence(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    low = cut = F.translate(text, UPPER, LOWER)
    for pattern, by in STEPS:
        cut = F.regexp_replace(cut, pattern, by)

    def plain(s: Column) -> Column:
        for pattern, by in NORMAL:
            s = F.regexp_replace(s, pattern, by)
        return s

    table = lambda names: F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    by_tag = {n: f"spdx-{x}" for n, x in tags().items()}

    def identified(s: Column) -> Column:
        name, first, second = F.regexp_extract(s, reference_pattern(), 1), F.regexp_extract(s, tag_pattern(), 1), F.regexp_extract(s, tag_pattern(), 2)
        known = F.element_at(table(sentences), s)
        named = F.element_at(table({n: f"ref-{x}" for n, x in NAMES.items()}), name)
        tagged = F.concat_ws("  ", F.element_at(table(by_tag), first), F.element_at(table(by_tag), second))
        return F.coalesce(known, F.when(s.contains("under "), named), F.when(s.startswith(TAG) & (first != ""), tagged))

    # only sentences with a sign are normalised and looked up
    marked = F.transform(F.filter(F.split(cut, CUT), lambda s: s.rlike(SIGNS)), plain)
    return F.when(low.rlike(SIGNS), F.filter(F.transform(marked, identified), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, known: list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """(id, n_sentences known, sequence of identifiers, licenses by name): for each whole text."""
    sentences, known = sentences or SENTENCES, known or rules()
    rows = docs.select(docs[id_col].alias("_id"), text_or_empty(text_col).alias("_text"))
    rows = rows.select("_id", sequence(F.col("_text"), sentences).alias("_sequence"))
    # two blanks between identifiers, so that each has one before and one behind it of its own
    line = F.concat(F.lit(" "), F.array_join("_sequence", "  "), F.lit(" "))
    follow = lambda ids: line.like("%" + "%".join(f" {x} " for x in ids) + "%")

    def holds(rule: tuple[str, tuple[str, ...]]) -> Column:
        out = follow(rule[1])
        for ids in wider(rule, known):
            out = out & ~follow(ids)
        return out

    match = F.array(*(F.when(holds(rule), F.lit(rule[0])) for rule in known))
    names = F.when(F.size("_sequence") > 0, F.array_sort(F.array_distinct(F.filter(match, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("_id").alias(id_col), F.size("_sequence").cast("long").alias("n_sentences"), F.regexp_replace(F.array_join("_sequence", " "), "  +", " ").alias("sequence"), F.array_join(names, ",").alias("licenses"))


def oracle() -> str:
    """The same scan as DuckDB SQL over the table documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def replaced(expression: str, steps: tuple[tuple[str, str], ...]) -> str:
        for pattern, by in steps:
            expression = f"regexp_replace({expression}, {quote(pattern)}, {quote(by.replace('$1', chr(92) + '1'))}, 'g')"
        return expression

    values = lambda names: ", ".join(f"({quote(n)}, {quote(x)})" for n, x in names.items())
    follow = lambda ids: "line LIKE " + quote("%" + "%".join(f" {x} " for x in ids) + "%")
    cases = ", ".join(f"CASE WHEN {' AND NOT '.join(follow(x) for x in (ids, *wider((name, ids), rules())))} THEN {quote(name)} END" for name, ids in rules())
    return f"""
WITH known(sentence, ident) AS (VALUES {values(SENTENCES)}),
named(name, ref) AS (VALUES {values({n: "ref-" + x for n, x in NAMES.items()})}),
tags(tag, spdx) AS (VALUES {values({n: "spdx-" + x for n, x in tags().items()})}),
numbered AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
whole AS (SELECT r, string_split({replaced("low", STEPS)}, {quote(CUT)}) AS parts FROM numbered),
cut AS (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM whole),
plain AS (SELECT r, k, {replaced("s", NORMAL)} AS sentence FROM cut WHERE regexp_matches(s, {quote(SIGNS)})),
read AS (SELECT r, k, sentence, regexp_extract(sentence, {quote(reference_pattern())}, 1) AS name,
                regexp_extract(sentence, {quote(tag_pattern())}, 1) AS t1, regexp_extract(sentence, {quote(tag_pattern())}, 2) AS t2 FROM plain),
found AS (SELECT r, k, coalesce(ident, ref, a.spdx || coalesce('  ' || b.spdx, '')) AS id
          FROM read LEFT JOIN known USING (sentence) LEFT JOIN named USING (name) LEFT JOIN tags a ON t1 = a.tag LEFT JOIN tags b ON t2 = b.tag),
seq AS (SELECT r, count(*) AS n, string_agg(id, '  ' ORDER BY k) AS ids FROM found WHERE id IS NOT NULL GROUP BY r),
lines AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS ids, ' ' || coalesce(ids, '') || ' ' AS line FROM numbered LEFT JOIN seq USING (r))
SELECT doc_id, n_sentences, replace(ids, '  ', ' ') AS sequence,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM lines"""
