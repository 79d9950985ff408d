"""Licence scans by sentence rules.

A text is a row of words: letters and digits in lower case, with their places; comment leaders, quotes, hyphens and white
space fall between words, so wrapped, padded, commented and hyphenated spellings read alike. Sentences begin and end where
a line, a clause or the text does. From every such beginning the words are followed along the known licence sentences (a
tree by words), and the longest one that ends where a sentence may end gives its identifier; the search goes on after it.
So a text becomes a sequence of identifiers with their places. Ordered rules then match runs of that sequence: the longest
full texts first, notices last; identifiers that a rule has used are used up. Copyright lines (the word, then a sign or a
year) and SPDX tags are recognised by how they begin; where a tag and a sentence begin at one place, the tag wins.

Only texts that hold one of KEYS, whatever stands between its words, are read word by word; every known sentence holds
one, which the tests check, so nothing is missed by it.

Defined results: null, empty and blank texts have no licence; repeated rows get the same result; an empty table gives an
empty result; other columns are not read; very long texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "reserved": "All rights reserved.",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
}
# The GNU licences by name and version, and what their notices call the work.
GNU = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
WORKS = ("program", "library", "file", "software")
GNU_NOTICE = "This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
GNU_ONLY = "This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} version {version} as published by the Free Software Foundation."
GNU_SEE = "See the {name} for more details."
GNU_COPY = "You should have received a copy of the {name} along with this {work}."
# How licences are called in notices, by SPDX identifier, and how notices begin and end.
NAMES = {
    "MIT": ("the MIT License", "the MIT licence", "MIT"), "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"), "BSD-2-Clause": ("the BSD 2-Clause License",), "BSD-3-Clause": ("the BSD 3-Clause License", "the BSD License"),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPLv2"), "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPLv3"),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3", "LGPLv3"), "AGPL-3.0-only": ("the GNU Affero General Public License, version 3", "AGPLv3"), "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"),
    "ISC": ("the ISC License",), "BSL-1.0": ("the Boost Software License 1.0",), "Unlicense": ("the Unlicense",),
}
CREATIVE = {"CC-BY": "CC BY", "CC-BY-SA": "CC BY-SA", "CC-BY-NC": "CC BY-NC", "CC-BY-ND": "CC BY-ND", "CC-BY-NC-SA": "CC BY-NC-SA", "CC-BY-NC-ND": "CC BY-NC-ND"}
VERSIONS = ("2.0", "3.0", "4.0")
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This work is released under", "This file is licensed under", "This software is licensed under", "This project is licensed under", "This document is licensed under", "This content is licensed under")


def gnu() -> tuple[dict[str, list[str]], list[tuple[str, tuple[str, ...]]]]:
    """Sentences by identifier, and rules, of the GNU licences: one pattern for all of them."""
    known_, full, short = {}, [], []
    for short_name, name, versions in GNU:
        known_[f"{short_name}-see"] = [GNU_SEE.format(name=name)]
        known_[f"{short_name}-copy"] = [GNU_COPY.format(name=name, work=w) for w in WORKS]
        for version in versions:
            spdx = f"{short_name}-{version if '.' in version else version + '.0'}"
            for kind, text in (("or-later", GNU_NOTICE), ("only", GNU_ONLY)):
                own = f"{spdx}-{kind}"
                known_[own] = [text.format(work=w, name=name, version=v) for w in WORKS for v in {version, spdx.rpartition("-")[2]}]
                full += [(own, (own, "gpl-hope", f"{short_name}-see", f"{short_name}-copy")), (own, (own, f"{short_name}-copy"))]
                short.append((own, (own,)))
    return known_, full + short


#: Ordered rules: (licence, identifiers in a row); the first that matches at a place wins.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT-0", ("mit0-grant", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-notice", "apache-copy")),
    *gnu()[1],
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("Unlicense", ("unlicense", "unlicense-free")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("EPL-2.0", ("epl-notice",)),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("WTFPL", ("wtfpl",)),
    ("all-rights-reserved", ("copyright", "reserved")),
)
#: One of these is in every known sentence, in some case.
KEYS = ("licen", "copyright", "redistribut", "warrant", "spdx", "permission", "rights reserved", "public domain", "gplv", "apache", "free software", " mit", "cc by", "cc0", "free and unencumbered", "free to copy", "the mpl")
#: KEYS as they are in texts, where anything but letters and digits may stand between words.
KEY = re.compile("|".join(re.sub("^ ", "(?<![a-z0-9])", k).replace(" ", "[^a-z0-9]+") for k in KEYS))
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)")
WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
#: Between two words: where a sentence may end and the next begin.
CUT = re.compile(r"[.!?:;][\"'”’)\]]*\s|\n")
#: What closes a sentence after its last word.
CLOSE = re.compile(r"[^A-Za-z0-9\n]*?[.!?:;][\"'”’)\]]*(?=\s|$)")
COPYRIGHT = re.compile(r"copyright\s*(?:\(c\)|©|&copy;|(?:19|20)\d\d\b)", re.IGNORECASE)


def spelled() -> list[tuple[str, str]]:
    """(sentence, identifier) of every known sentence: notices are an opening and a name."""
    names = [(spdx, n) for spdx, all_ in NAMES.items() for n in all_] + [(f"{spdx}-{v}", f"{n} {v}") for (spdx, n), v in product(CREATIVE.items(), VERSIONS)] + [("CC0-1.0", "CC0 1.0")]
    notices = [(f"{o} {n}", f"notice:{spdx}") for o, (spdx, n) in product(OPENINGS, names)]
    return notices + [(s, i) for i, s in SENTENCES.items()] + [(s, i) for i, all_ in gnu()[0].items() for s in all_]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@lru_cache(maxsize=1)
def tree() -> dict:
    """The known sentences word by word; the identifier of one that ends at a node is under "" there."""
    root: dict = {}
    for sentence, name in spelled():
        node = root
        for word in words_of(sentence):
            node = node.setdefault(word, {})
        node[""] = name
    return root


def identified(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences of a text, in order, each place once."""
    tags = [(m.start(), m.end(), f"notice:{m[1]}") for m in SPDX.finditer(text)]
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    ends = [bool(CUT.search(text[a:b])) for (_, a), (b, _) in zip(spans, spans[1:], strict=False)] + [True]
    found, i, root = [], 0, tree()
    while i < len(words):
        best = None
        if (i == 0 or ends[i - 1]) and words[i] in root:
            node, j = root, i
            while j < len(words) and (node := node.get(words[j])) is not None:
                if ends[j] and "" in node:
                    best = (j, node[""])
                j += 1
        if best is None and words[i] == "copyright" and (i == 0 or ends[i - 1]) and COPYRIGHT.match(text, spans[i][0]):
            best = (next(j for j in range(i, len(words)) if ends[j]), "copyright")
        if best is not None:
            stop = best[0]
            close = CLOSE.match(text, spans[stop][1])
            found.append((spans[i][0], close.end() if close else spans[stop][1], best[1]))
        i = best[0] + 1 if best else i + 1
    return sorted([*tags, *(x for x in found if not any(a <= x[0] < b for a, b, _ in tags))])


def licences(items: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, licence) by the ordered rules over a sequence of identifiers."""
    out, i, names = [], 0, [name for _, _, name in items]
    while i < len(names):
        if names[i].startswith("notice:"):
            out.append((items[i][0], items[i][1], names[i].removeprefix("notice:")))
            i += 1
            continue
        for licence, run in RULES:
            if tuple(names[i : i + len(run)]) == run:
                out.append((items[i][0], items[i + len(run) - 1][1], licence))
                i += len(run)
                break
        else:
            i += 1
    return out


def scan_text(text: str | None) -> tuple[list, list]:
    if not text:
        return [], []
    if not KEY.search(text.lower()):
        return [], []
    items = identified(text)
    return items, licences(items)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (start, end, id) and matches (start, end, licence) of each document, in the text's characters."""
    span = lambda name: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), (name, pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([[{"start": a, "end": b, n: x} for a, b, x in f[i]] for f in found], span(n)) for i, n in enumerate(("id", "licence"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "sentences", "matches"])

    schema = "doc_id long, sentences array<struct<start: long, end: long, id: string>>, matches array<struct<start: long, end: long, licence: string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, licences (distinct, in order of appearance) and how many sentences were known."""
    return found.select("doc_id", F.array_join(F.array_distinct(F.transform("matches", lambda m: m["licence"])), ",").alias("licences"), F.size("sentences").alias("n_sentences"))
