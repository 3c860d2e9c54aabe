"""Licence scans by sentence-rule recognition.

A text is cut into sentences, each is normalised (lower case, words of
letters and digits joined by single spaces) and looked up in the table of
licence sentences. The identifiers found, in text order, are matched against
the ordered licence rules: a rule is a sequence of identifiers that must
follow each other with nothing but unknown sentences of at most
``max_gap`` between them; earlier rules win the identifiers they use, so a
full text wins over the name of the licence inside it. An
``SPDX-License-Identifier`` line names its licences itself: each identifier
of its expression is a finding.

Input cases: null and empty texts have no finding; very long texts are cut
sentence by sentence in linear time; null ids, repeated rows and extra
columns are kept apart per row; an empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phaselens.llm.textops import blocks, small_batches

# Sentences of public licences and of the notices by which they
# are applied, with their identifiers.
SENTENCES = {
    "mit.name": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit.notice": ["Released under the MIT License", "Licensed under the MIT License",
                   "This project is licensed under the MIT License",
                   "This software is released under the MIT License", "Distributed under the MIT License"],
    "mit.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                  "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                  "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                  "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                  "furnished to do so, subject to the following conditions"],
    "mit.keep": ["The above copyright notice and this permission notice shall be included in all copies or "
                 "substantial portions of the Software"],
    "mit.asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
                 "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
                 "NONINFRINGEMENT"],
    "apache2.name": ["Apache License, Version 2.0", "Apache License Version 2.0"],
    "apache2.notice": ["Licensed under the Apache License, Version 2.0 (the \"License\")",
                       "Licensed under the Apache License, Version 2.0",
                       "Released under the Apache License, Version 2.0",
                       "This work is licensed under the Apache License, Version 2.0"],
    "apache2.use": ["you may not use this file except in compliance with the License"],
    "apache2.copy": ["You may obtain a copy of the License at"],
    "bsd.redistribute": ["Redistribution and use in source and binary forms, with or without modification, are "
                         "permitted provided that the following conditions are met"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions "
                   "and the following disclaimer"],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of "
                   "conditions and the following disclaimer in the documentation and/or other materials provided "
                   "with the distribution"],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to "
                    "endorse or promote products derived from this software without specific prior written "
                    "permission"],
    "bsd2.notice": ["Released under the BSD 2-Clause License", "Licensed under the BSD 2-Clause License"],
    "bsd3.notice": ["Released under the BSD 3-Clause License", "Licensed under the BSD 3-Clause License"],
    "gpl.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version"],
    "gpl.warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl3.notice": ["This work is licensed under the GNU General Public License, version 3",
                    "Licensed under the GNU General Public License, version 3",
                    "Released under the GNU General Public License, version 3",
                    "This work is licensed under the GNU General Public License v3.0"],
    "gpl2.notice": ["This work is licensed under the GNU General Public License, version 2",
                    "Licensed under the GNU General Public License, version 2",
                    "Released under the GNU General Public License, version 2"],
    "lgpl3.notice": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "mpl2.notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl2.copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at "
                  "https://mozilla.org/MPL/2.0/"],
    "ccby4.notice": ["This work is licensed under a Creative Commons Attribution 4.0 International License",
                     "Licensed under CC BY 4.0"],
    "ccbysa4.notice": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                       "License", "Licensed under CC BY-SA 4.0"],
    "cc0.notice": ["To the extent possible under law, the author has waived all copyright and related or "
                   "neighboring rights to this work"],
    "unlicense.domain": ["This is free and unencumbered software released into the public domain"],
    "rights.reserved": ["All rights reserved"],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                  "in all copies",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without "
                  "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
                  "in all copies"],
    "0bsd.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                   "fee is hereby granted"],
    "epl1.notice": ["This program and the accompanying materials are made available under the terms of the Eclipse "
                    "Public License v1.0 which accompanies this distribution, and is available at "
                    "http://www.eclipse.org/legal/epl-v10.html"],
    "epl2.notice": ["This program and the accompanying materials are made available under the terms of the Eclipse "
                    "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
                    "This program and the accompanying materials are made available under the terms of the Eclipse "
                    "Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
}

# The headers of the GNU licences: (identifier, licence, version). ``free`` is
# the header with "any later version", ``fixed`` the one without. The part from
# "you can" stands for any program's name before it.
_GNU = (("gpl2", "GNU General Public License", "2"), ("gpl", "GNU General Public License", "3"),
        ("lgpl2", "GNU Library General Public License", "2"), ("lgpl21", "GNU Lesser General Public License", "2.1"),
        ("lgpl3", "GNU Lesser General Public License", "3"), ("agpl3", "GNU Affero General Public License", "3"))
_THINGS = ("program", "library", "software", "file", "package", "code")
for _key, _name, _v in _GNU:
    _by = "as published by the Free Software Foundation"
    _free = [f"under the terms of the {_name} {_by}, either version {_v}{of}, or {opt}any later version"
             for of, opt in product((" of the License", ""), ("(at your option) ", "at your option ", ""))]
    _fixed = [f"under the terms of the {_name} {_by}, version {_v}{of}{end}"
              for of, end in product((" of the License", ""), ("", " only"))]
    _fixed += [f"under the terms of the {_name}{sep} {v} {_v}{of} {_by}"
               for sep, v, of in product((",",), ("version", "v"), ("", " only"))]
    for _kind, _terms in (("free", _free), ("fixed", _fixed)):
        SENTENCES.setdefault(f"{_key}.{_kind}", []).extend(
            f"{who}you can redistribute it and/or modify it {t}"
            for who, t in product(("", *(f"This {x} is free software: " for x in _THINGS)), _terms))
SENTENCES["gpl.warranty"] += [f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"
                              for x in _THINGS]

#: Names in notices ("Licensed under ..."): (licence, identifier, names).
_NAMES: list[tuple[str, str, list[str]]] = [
    ("MIT", "mit", ["MIT License", "MIT"]),
    ("Apache-2.0", "apache2", ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0",
                               "Apache 2.0 License", "Apache 2.0"]),
    ("BSD-2-Clause", "bsd2", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License",
                              "BSD 2-Clause"]),
    ("BSD-3-Clause", "bsd3", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License",
                              "Modified BSD License", "BSD 3-Clause"]),
    ("0BSD", "0bsd", ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License", "0BSD"]),
    ("ISC", "isc", ["ISC License", "ISC"]),
    ("Zlib", "zlib", ["zlib License"]),
    ("BSL-1.0", "bsl1", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    ("MPL-2.0", "mpl2", ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0",
                         "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0"]),
    ("CC0-1.0", "cc0", ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0",
                        "Creative Commons Zero v1.0 Universal"]),
    ("Unlicense", "unlicense", ["Unlicense"]),
]
for _v in ("1", "2"):
    _NAMES.append((f"EPL-{_v}.0", f"epl{_v}", [f"Eclipse Public License{x} {_v}.0" for x in
                                              ("", ", version", " version", " v", ", v.", " - v")]
                   + [f"Eclipse Public License v{_v}.0", f"EPL {_v}.0"]))
for _abbr, _name, _v, _key in (("GPL", "GNU General Public License", "2.0", "gpl2"),
                               ("GPL", "GNU General Public License", "3.0", "gpl3"),
                               ("LGPL", "GNU Lesser General Public License", "2.1", "lgpl21"),
                               ("LGPL", "GNU Lesser General Public License", "3.0", "lgpl3"),
                               ("AGPL", "GNU Affero General Public License", "3.0", "agpl3")):
    _named = [f"{name}{v}{n}" for name, v, n in product(
        (_name, _name.removeprefix("GNU "), f"GNU {_abbr}", _abbr), (", version ", " version ", " v", " "),
        {_v, _v.removesuffix(".0")})] + [f"{_abbr}v{_v}", f"{_abbr}v{_v.removesuffix('.0')}"]
    _NAMES.append((f"{_abbr}-{_v}-only", _key, _named + [f"{x} only" for x in _named]))
    _NAMES.append((f"{_abbr}-{_v}-or-later", f"{_key}later", [f"{x}{later}" for x, later in product(
        _named, (" or later", ", or (at your option) any later version", " or any later version"))]))
_CC = {"BY": ["Attribution"], "BY-SA": ["Attribution-ShareAlike", "Attribution-Share Alike"],
       "BY-ND": ["Attribution-NoDerivatives", "Attribution-NoDerivs"],
       "BY-NC": ["Attribution-NonCommercial", "Attribution-Non-Commercial"],
       "BY-NC-SA": ["Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share Alike"],
       "BY-NC-ND": ["Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"]}
for (_abbr, _long), (_v, _port) in product(_CC.items(), (("4.0", "International"), ("3.0", "Unported"),
                                                         ("2.5", "Generic"), ("2.0", "Generic"))):
    _ends = ("", " License", f" {_port}", f" {_port} License", f" {_port} (CC {_abbr} {_v})",
             f" {_port} License (CC {_abbr} {_v})")
    _NAMES.append((f"CC-{_abbr}-{_v}", "cc" + _abbr.replace("-", "").lower() + _v.removesuffix(".0").replace(".", ""),
                   [f"CC {_abbr} {_v}", f"CC {_abbr} {_v} License"]
                   + [f"Creative Commons {x} {_v}{end}" for x, end in product(_long, _ends)]))

for _licence, _key, _named in _NAMES:
    SENTENCES.setdefault(f"{_key}.notice", []).extend(f"Licensed under {x}" for x in _named)

#: Ordered rules: (licence, sentence identifiers in their order).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit.grant", "mit.keep", "mit.asis")),
    ("BSD-3-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", ("bsd.redistribute", "bsd.source", "bsd.binary")),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.warranty")),
    ("Apache-2.0", ("apache2.notice", "apache2.use", "apache2.copy")),
    ("MPL-2.0", ("mpl2.notice", "mpl2.copy")),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("MIT", ("mit.grant",)),
    ("MIT", ("mit.notice",)),
    ("MIT", ("mit.name",)),
    ("Apache-2.0", ("apache2.notice",)),
    ("Apache-2.0", ("apache2.name",)),
    ("BSD-3-Clause", ("bsd3.notice",)),
    ("BSD-2-Clause", ("bsd2.notice",)),
    ("GPL-3.0-only", ("gpl3.notice",)),
    ("GPL-2.0-only", ("gpl2.notice",)),
    ("LGPL-3.0-only", ("lgpl3.notice",)),
    ("MPL-2.0", ("mpl2.notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)),
    ("CC-BY-4.0", ("ccby4.notice",)),
    ("CC0-1.0", ("cc0.notice",)),
    ("Unlicense", ("unlicense.domain",)),
    ("Proprietary", ("rights.reserved",)),
    *(rule for x, key in (("GPL-2.0", "gpl2"), ("LGPL-2.0", "lgpl2"), ("LGPL-2.1", "lgpl21"), ("LGPL-3.0", "lgpl3"),
                          ("AGPL-3.0", "agpl3"), ("GPL-3.0", "gpl"))
      for kind, tail in (("free", "or-later"), ("fixed", "only"))
      for rule in ((f"{x}-{tail}", (f"{key}.{kind}", "gpl.warranty")), (f"{x}-{tail}", (f"{key}.{kind}",)))),
    ("ISC", ("isc.grant",)),
    ("0BSD", ("0bsd.grant",)),
    *((licence, (f"{key}.notice",)) for licence, key, _ in _NAMES),
)

#: An SPDX line: its tag, and the expression to the end of the line.
SPDX = re.compile(r"SPDX-License-Identifier[ \t]*(?P<colon>:)(?P<expression>[^\r\n]*)", re.IGNORECASE)
_SPDX_PART = re.compile(r"[()\s]*([A-Za-z0-9][A-Za-z0-9.+-]*)")
_SPDX_VERSIONED = re.compile(r"LicenseRef-.+|[A-Za-z][A-Za-z0-9.-]*-[0-9]+(\.[0-9]+)*[A-Za-z-]*\+?", re.IGNORECASE)
_SPDX_NAMES = {x.lower(): x for x in (
    "0BSD", "Beerware", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "curl", "FTL", "HPND", "IJG", "ImageMagick",
    "Info-ZIP", "ISC", "JSON", "Libpng", "MIT", "MIT-0", "MirOS", "NCSA", "OpenSSL", "PostgreSQL", "Ruby", "Sleepycat",
    "TCL", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "Zlib", "Artistic-2.0", *(x for x, _ in RULES))}


def spdx_licences(expression: str) -> tuple[list[str], int]:
    """Licence identifiers of an SPDX expression, and its length; no
    identifiers if it begins with a word that is none."""
    out, at, end = [], 0, 0
    while m := _SPDX_PART.match(expression, at):
        word = m[1].rstrip(".-")
        gnu = re.fullmatch(r"([AL]?GPL-[0-9.]+)(\+|-only|-or-later)?", word, re.IGNORECASE)
        if gnu:
            word = gnu[1].upper() + ("-or-later" if gnu[2] and gnu[2].lower() in ("+", "-or-later") else "-only")
        elif word.lower() not in _SPDX_NAMES and not _SPDX_VERSIONED.fullmatch(word):
            break
        out.append(_SPDX_NAMES.get(word.lower(), word))
        end = m.start(1) + len(m[1].rstrip(".-"))
        if exception := re.compile(r"\s+WITH\s+[A-Za-z0-9.-]*[A-Za-z0-9]", re.IGNORECASE).match(expression, end):
            end = exception.end()
        operator = re.compile(r"[()\s]+(AND|OR)\b", re.IGNORECASE).match(expression, end)
        if not operator:
            break
        at = operator.end()
    return out, end

#: A sentence ends at a line break, at ``;`` ``:`` ``!`` ``?``, or at a period
#: that white space or the end follows (so ``2.0`` stays whole).
SENTENCE = re.compile(r"[^\n;:!?.]+(?:\.(?=[^\s])[^\n;:!?.]*)*")
_OTHER = re.compile(r"[^a-z0-9]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip().replace("licenc", "licens")


#: The ways to begin a notice, all read as "licensed under".
_UNDER = [f"{who}{how} under{of}{the}" for who, how, of, the in product(
    ("", *(f"this {x} is " for x in ("work", "project", "software", "program", "file", "document", "code", "library",
                                     "package", "text", "article"))),
    ("licensed", "released", "distributed", "published", "available", "made available"),
    ("", " the terms of", " the terms and conditions of"), ("", " the", " a", " an"))]
_NOTICE = re.compile(f"(?:{'|'.join(sorted(_UNDER, key=len, reverse=True))}) (?=.)")


def _canonical(words: str) -> str:
    m = _NOTICE.match(words)
    return f"licensed under {words[m.end():]}" if m else words


def _long_form(text: str) -> list[str]:
    """The parts into which :data:`SENTENCE` cuts a table sentence."""
    return [n for n in (normalise(m[0]) for m in SENTENCE.finditer(text)) if n]


class Recogniser:
    """Sentence table and rules, with the licence names found by them.

    Licence texts are often wrapped: a table sentence may run over several
    lines. A line that begins a longer table sentence is joined with the next
    lines while the result still begins one."""

    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules=RULES, max_gap: int = 3):
        self.ids: dict[str, str] = {}
        self.beginnings: set[str] = set()
        for name, forms in sentences.items():
            for form in forms:
                whole = _canonical(" ".join(_long_form(form)))
                self.ids[whole] = name
                words = whole.split(" ")
                self.beginnings.update(" ".join(words[:k]) for k in range(1, len(words)))
        for words in (x.split(" ") for x in _UNDER):
            self.beginnings.update(" ".join(words[:k + 1]) for k in range(len(words)))
        self.rules, self.max_gap = rules, max_gap
        # a cheap necessary condition: the first word of a table sentence
        self.first_words = {w.split(" ", 1)[0] for w in (*self.ids, *_UNDER)}

    def sentences(self, text: str) -> list[tuple[int, int, int, str, int]]:
        """(number of the first cut, start, end, identifier, number of the last
        cut) of the known sentences. Cuts without a word (the marks of an empty
        comment line, the number of a clause) have no number."""
        cut = [(m.start(), m.end()) for m in SENTENCE.finditer(text)]
        spdx = {m.start("colon"): m for m in SPDX.finditer(text)}
        out, i, number = [], 0, 0
        while i < len(cut):
            a, b = cut[i]
            if b in spdx:
                tag = spdx[b]
                names, length = spdx_licences(tag["expression"])
                out += [(number, tag.start(), tag.start("expression") + length, f"spdx.{x}", number) for x in names]
                number += 1
                while i < len(cut) and cut[i][0] < (tag.end() if names else b):
                    i += 1
                continue
            joined = alone = normalise(text[a:b])
            first = joined.split(" ", 1)[0]
            best, j = None, i
            if first in self.first_words:
                while True:
                    words = _canonical(joined)
                    if words in self.ids:
                        best = (j, self.ids[words])
                    if words not in self.beginnings and joined not in self.beginnings or j + 1 == len(cut):
                        break
                    j += 1
                    joined = f"{joined} {normalise(text[cut[j][0]:cut[j][1]])}".strip()
            if best is None:
                i += 1
                number += alone != "" and not alone.isdigit() or any(map(str.isalpha, text[a:b]))
                continue
            last = number + best[0] - i
            out.append((number, a, cut[best[0]][1], best[1], last))
            i, number = best[0] + 1, last + 1
        return out

    def match(self, found: list[tuple[int, int, int, str, int]]) -> list[tuple[str, int, int]]:
        """(licence, start, end) by the ordered rules, in text order."""
        if not found:
            return []
        free = [True] * len(found)
        out = [(k.removeprefix("spdx."), a, b) for _, a, b, k, _ in found if k.startswith("spdx.")]
        for licence, needs in self.rules:
            for first in range(len(found)):
                at, used = first, []
                for need in needs:
                    while at < len(found) and used and not free[at]:
                        at += 1
                    if (at >= len(found) or not free[at] or found[at][3] != need
                            or used and found[at][0] - found[used[-1]][4] - 1 > self.max_gap):
                        break
                    used.append(at)
                    at += 1
                if len(used) == len(needs):
                    for k in used:
                        free[k] = False
                    out.append((licence, found[used[0]][1], found[used[-1]][2]))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


@cache
def _registered() -> Recogniser:
    return Recogniser()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  recogniser: Recogniser | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``licenses`` (distinct names,
    sorted, comma-joined), ``n_findings``, ``findings`` (``name:start:end`` in
    code points, in text order) and ``sentence_ids`` (in text order). A narrow
    map over two columns of the scan; nothing is shuffled."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("licenses", T.StringType()),
              T.StructField("n_findings", T.LongType()), T.StructField("findings", T.StringType()),
              T.StructField("sentence_ids", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = recogniser or _registered()
        for batch in batches:
            for block in blocks(batch.column(1)):
                raw, off = block.data.tobytes(), block.offsets.tolist()
                names, n, where, ids = [], [], [], []
                for a, b in zip(off, off[1:]):
                    known = scanner.sentences(raw[a:b].decode())
                    found = scanner.match(known)
                    names.append(",".join(sorted({x for x, _, _ in found})))
                    n.append(len(found))
                    where.append(",".join(f"{x}:{s}:{e}" for x, s, e in found))
                    ids.append(",".join(x[3] for x in known))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts), pa.array(names, pa.string()),
                     pa.array(n, pa.int64()), pa.array(where, pa.string()), pa.array(ids, pa.string())],
                    [f.name for f in fields])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, T.StructType(fields))
