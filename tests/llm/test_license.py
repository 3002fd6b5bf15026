import re
import textwrap

import duckdb
import pandas as pd
import pytest

from sievra.llm import license as lic

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS."""
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""


def wrapped(text, width, mark=""):
    """Paragraphs broken into lines behind a comment mark."""
    return ("\n" + mark.rstrip() + "\n").join("\n".join(mark + line for line in textwrap.wrap(" ".join(p.split()), width)) for p in text.split("\n\n"))


def brute(text):
    """A sentence at a time, by loops over characters and names."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    lines = low.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    rest = lines[:1] + [re.sub(r"^[ \t\f]*(//+!?|#+|/?\*+/?|;+|-+|%+|<!--)?[ \t\f]*", "", x) for x in lines[1:]]
    joined = re.sub(r"([^a-z0-9]v)\. +", r"\1.", "\n".join(rest))
    joined = re.sub(r"spdx-license-identifier:[ \t]*", "spdx license identifier ", joined)
    out = []
    for part in re.split(r"\n\n+|\x01", joined):
        for s in re.split(r"(?<=[.!?:])[ \t\n\f]+", part):
            s = re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.+]+", " ", s))
            if s in lic.SENTENCES:
                out.append([lic.SENTENCES[s]])
                continue
            names = [(m.start(), -len(n), n) for n in lic.NAMES for m in re.finditer(lic.REFERENCE + re.escape(n) + "( |$)", s)]
            if names:
                out.append(["ref-" + lic.NAMES[min(names)[2]]])
            elif s.startswith(lic.TAG):
                words, got = s[len(lic.TAG) :] + " ", []
                while len(got) < 2 and (fit := [n for n in lic.tags() if words.startswith(n + " ")]):
                    got.append("spdx-" + lic.tags()[max(fit, key=len)])
                    words = words[len(max(fit, key=len)) + 1 :]
                    if not words.startswith(("or ", "and ")):
                        break
                    words = words.split(" ", 1)[1]
                if got:
                    out.append(got)
    flat = [x for ids in out for x in ids]

    def follow(ids):
        rest = iter(flat)
        return all(x in rest for x in ids)

    found = {name: ids for name, ids in lic.RULES if follow(ids)}
    if "BSD-3-Clause" in found:
        found.pop("BSD-2-Clause", None)
    names = {*found, *(x.split("-", 1)[1] for x in flat if x.startswith(("ref-", "spdx-")))}
    return len(out), " ".join(flat), ",".join(sorted(names))


TEXTS = [
    MIT, GPL, "\n".join(BSD), "\n".join(BSD[:3] + BSD[4:]), "\n".join(reversed(BSD)), None, "", "...", "no license here. Under way.",
    "Xx. Released under the MIT License. Licensed under CC BY-NC 4.0.", "Released under the MIT License! " * 2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\nfoo",
    MIT.replace("charge", "cost"), "a " * 50000 + ". This work is licensed under the GNU General Public License, version 3. " + "b " * 50000,
]


def test_against_brute_force_and_sql(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(1, GPL, "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted(map(tuple, lic.scan(df).collect()))
    assert got == sorted((i, *brute(t)) for i, t, _ in rows)
    by = {r[0]: r[3] for r in got}
    assert by[0] == "MIT" and by[1] == "GPL-3.0-or-later" and by[2] == "BSD-3-Clause" and by[3] == "BSD-2-Clause" and by[4] == ""
    assert by[9] == "CC-BY-NC-4.0,MIT" and by[12] == "" and by[13] == "GPL-3.0"
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(con.execute(lic.oracle()).fetchall()) == got
    assert lic.scan(df.limit(0)).count() == 0


STANDARD = [(MIT, "MIT"), (GPL, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), ("\n\n".join(BSD), "BSD-3-Clause"), ("\n\n".join(BSD[:3] + BSD[4:]), "BSD-2-Clause"), (APACHE, "Apache-2.0"), (MPL, "MPL-2.0"), (ISC, "ISC")]
SHORT = [
    ("// SPDX-License-Identifier: MIT\nint main() {}", "MIT"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR Apache-2.0) */", "Apache-2.0,GPL-2.0-only"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\n# Copyright", "Apache-2.0,MIT"),
    ("Licensed under the MIT License (see LICENSE).", "MIT"),
    ("Code is licensed under the MIT License.", "MIT"),
    ("This crate is distributed under the terms of the Apache License, Version 2.0, and nothing else", "Apache-2.0"),
    ("Made available under a\n    CC BY-SA 4.0 licence", "CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: Nothing-1.0", ""),
    ("Permission is hereby granted by nobody. The mit license is fine.", ""),
]


@pytest.fixture(scope="module")
def both(spark):
    """Texts with the licences that stand in them, as they are found by the scan, by SQL and by loops."""
    rows = [(wrapped(t, width, mark), name) for t, name in STANDARD for width in (60, 76, 10_000) for mark in ("", " * ", "# ", "// ", "    ")]
    rows += SHORT + [(MIT + "\n\nSee the license for the specific language governing permissions and limitations under the license.\n\n" + GPL, "GPL-3.0-or-later,MIT")]
    rows += [(MIT.replace("\n\n", "\r\n\r\n").replace(" of ", "\r\n  of "), "MIT")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(rows)), "text": [t for t, _ in rows]}))
    return rows, sorted(map(tuple, lic.scan(df).collect())), sorted(con.execute(lic.oracle()).fetchall())


def test_standard_texts_however_they_are_wrapped(both):
    rows, got, sql = both
    assert [(r[3], t) for r, (t, _) in zip(got, rows)] == [(name, t) for t, name in rows]
    assert got == sql == [(i, *brute(t)) for i, (t, _) in enumerate(rows)]


def test_every_known_sentence_is_cut_as_it_stands(spark):
    df = spark.createDataFrame([(i, s + ".") for i, s in enumerate(lic.SENTENCES)], "doc_id long, text string")
    assert [r.sequence for r in sorted(lic.scan(df).collect())] == list(lic.SENTENCES.values())


def test_no_known_sentence_lacks_a_sign():
    assert all(re.search(lic.SIGNS, s) for s in [*lic.SENTENCES, lic.TAG, "licensed under "])
