"""Map-style operators against brute force: BPE, compression rules, PII,
licences, Merkle fingerprints."""

import base64
import hashlib
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phaselens.llm import bpe, compression, licenses, merkle, pii
from phaselens.llm.textops import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.text(alphabet="ab \n\t.é#|0.5é中\r", max_size=120)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P

    return bpe.ByteBPE(bpe.read_ranks(bpe.vocabulary_path()), P.PATTERN)


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_reference_and_round_trips(tokenizer, reference_tokenizer, text):
    ids = tokenizer.encode(text)
    assert ids == reference_tokenizer.encode_ordinary(text)
    assert tokenizer.decode(ids) == text.encode()


def test_bpe_cache_generations_do_not_change_results(tokenizer):
    import public_tokenizers as P

    small = bpe.ByteBPE(tokenizer.vocabulary, P.PATTERN, cache_entries=7)
    texts = [" ".join(f"wort{i * j % 13} été{i}" for i in range(9)) for j in range(12)]
    for t in texts + texts[::-1]:
        assert small.encode(t) == tokenizer.encode(t)


def test_bpe_query_shape_and_cases(spark, odd_documents, tokenizer):
    rows = bpe.encode_documents(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in rows}
    text = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    for i, r in by_id.items():
        if i is None:
            continue
        ids = tokenizer.encode(text[i])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()
    assert bpe.encode_documents(odd_documents.limit(0)).count() == 0


def brute_counts(s: str) -> tuple:
    words, seen, dup = WORD.findall(s), set(), 0
    for line in s.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(s.count(c) for c in "#*$%&|<>"), dup, len(cover)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=5), st.lists(st.sampled_from(["a", "b", "c\n", "é#"]), max_size=60))
def test_compression_base_counts(texts, words):
    texts = texts + [" ".join(words)]
    got = []
    for block in blocks(pa.array(texts)):
        c = compression.base_counts(block)
        got += list(zip(*(c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute_counts(t) for t in texts]


def test_compression_bands(spark):
    rng = np.random.default_rng(1)
    prose = " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(900))
    noise = base64.b64encode(rng.bytes(9000)).decode()
    noise = " ".join(noise[i:i + 40] for i in range(0, len(noise), 40))
    loop = " ".join(f"{a} one two three" for a in "abcdefg" * 200)
    strict = compression.CompressionRules(bands=((256, 0.3, 0.72),))
    df = spark.createDataFrame([(1, prose), (2, noise), (3, loop), (4, None), (5, "a b"), (None, prose)],
                               "doc_id long, text string")
    got = {r["doc_id"]: r for r in compression.score_documents(df, rules=strict).collect()}
    assert got[1]["kept"] and got[None]["kept"]
    assert got[2]["incompressible"] and not got[2]["kept"]
    assert got[3]["repetitive"] and not got[3]["kept"]
    assert got[4]["base_failed"] and got[4]["n_words"] == 0 and not got[5]["kept"]
    assert compression.score_documents(df.limit(0)).count() == 0


def lines(text: str, width: int) -> str:
    return "\n".join(text[i:i + width] for i in range(0, len(text), width))


CHINESE = (
    "鉴于对人类家庭所有成员的固有尊严及其平等的和不移的权利的承认,乃是世界自由、正义与和平的基础,鉴于对人权的无视和侮蔑已发展为野蛮暴行,"
    "这些暴行玷污了人类的良心,而一个人人享有言论和信仰自由并免予恐惧和匮乏的世界的来临,已被宣布为普通人民的最高愿望,鉴于为使人类不致迫不得已"
    "铤而走险对暴政和压迫进行反叛,有必要使人权受法治的保护,鉴于有必要促进各国间友好关系的发展,鉴于各联合国国家的人民已在联合国宪章中重申他们"
    "对基本人权、人格尊严和价值以及男女平等权利的信念,并决心促成较大自由中的社会进步和生活水平的改善,鉴于各会员国业已誓愿同联合国合作以促进对"
    "人权和基本自由的普遍尊重和遵行,鉴于对这些权利和自由的普遍了解对于这个誓愿的充分实现具有很大的重要性。")


def test_compression_limits_as_registered(spark, documents_table):
    import zstandard

    rules, c, rng = compression.CompressionRules(), zstandard.ZstdCompressor(level=3), np.random.default_rng(5)
    ends = [b[0] for b in rules.bands]
    for n in sorted({*ends, *(x - 1 for x in ends[1:]), 300, 1500, 5000, 20000, 100000}):
        for junk in (base64.b64encode(rng.bytes(n)).decode(), base64.b85encode(rng.bytes(n)).decode(),
                     "".join(map(chr, rng.integers(33, 127, n)))):
            for width in (40, 76):
                raw = lines(junk, width)[:n].encode()
                assert compression.compression_verdict(raw, rules, c)[4], (n, width, junk[:20])
        wide = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n // 3 + 1))).encode()
        assert n < 4100 or compression.compression_verdict(wide, rules, c)[4], n
    for r in documents_table.collect():
        assert not compression.compression_verdict((r["text"] or "").encode(), rules, c)[4]
    for n in range(90, len(CHINESE), 10):
        raw = CHINESE[:n].encode()
        assert not compression.compression_verdict(raw, rules, c)[4], len(raw)
    noise = lines(base64.b64encode(rng.bytes(2000)).decode(), 40)
    got = compression.score_documents(spark.createDataFrame([(1, noise)], "doc_id long, text string")).collect()
    assert got[0]["incompressible"] and not got[0]["base_failed"] and not got[0]["kept"]


def test_compression_judges_parts_and_short_texts(documents_table):
    import zstandard

    rules, c, rng = compression.CompressionRules(), zstandard.ZstdCompressor(level=3), np.random.default_rng(6)
    texts = [r["text"].encode() for r in documents_table.orderBy("doc_id").collect() if r["text"]]
    clean = b"\n".join(dict.fromkeys(x for x in texts if len(x) > 2000 and len(c.compress(x)) > 0.4 * len(x)))
    size = 60000
    noise = lines(base64.b64encode(rng.bytes(size)).decode(), 60).encode()
    run = b"all of this is the same run of words " * (size // 37 + 1)
    assert len(clean) > size and compression.compression_verdict(clean[:size], rules, c)[3:] == (False, False)
    for part, at in ((0.45, 0.3), (0.45, 0.55), (0.45, 0.0), (0.4, 0.2)):
        a, b = int(at * size), int((at + part) * size)
        low = compression.compression_verdict(clean[:a] + run[: b - a] + clean[b:size], rules, c)
        high = compression.compression_verdict(clean[:a] + noise[: b - a] + clean[b:size], rules, c)
        assert low[3] and high[4], (part, at)
        mid = (a + b) // 2
        both = clean[:a] + run[: mid - a] + noise[: b - mid] + clean[b:size]
        assert any(compression.compression_verdict(both, rules, c)[3:]), (part, at)
    for n in (64, 96, 130, 170, 200, 255):
        assert compression.compression_verdict((b"a b c " * n)[:n], rules, c)[3], n
    for n in (193, 230, 255):
        assert compression.compression_verdict(bytes(rng.integers(33, 127, n).astype(np.uint8)), rules, c)[4], n
    assert compression.compression_verdict(clean[:4096] + b"a" * 200, rules, c)[1] > 0.24
    for text in (clean, CHINESE.encode()):
        for n in range(64, 256, 7):
            assert not any(compression.compression_verdict(text[:n], rules, c)[3:]), n


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text: str) -> list:
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and max(map(int, m[0].split("."))) > 255:
                continue
            if k == 2 and not (12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
                                                          for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="1234567890..--  ++()@@ab%_4111é", max_size=70))
def test_pii_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.fixture(scope="module")
def crf():
    return pii.train_crf(pii.labelled_table(300), rounds=40)


def test_crf_learns_and_viterbi_is_exact(crf):
    hits = total = false = 0
    for text, spans in pii.labelled_table(120, seed=77):
        for block in blocks(pa.array([text])):
            start, end, owner, at, feats = pii.token_features(block)
            tags = crf.decode(feats, at, owner)
            _, _, _, _, every = pii.token_features(block, every=True)
            e = np.where(np.isin(np.arange(len(start)), at)[:, None] | (np.arange(len(pii.TAGS)) == 0),
                         crf.scores(every), -1e9)
            best, back = crf.begin + e[0], []
            for t in range(1, len(e)):
                cand = best[:, None] + crf.move
                back.append(cand.argmax(0))
                best = cand.max(0) + e[t]
            path = [int(best.argmax())]
            for b in back[::-1]:
                path.append(int(b[path[-1]]))
            assert list(tags) == path[::-1]
            cp = block.code_points_before()
            inside = np.zeros(len(start), bool)
            for a, z, _ in spans:
                inside |= (cp[start] < z) & (cp[end] > a)
            hits += int((tags[inside] > 0).sum())
            total += int(inside.sum())
            false += int((tags[~inside] > 0).sum())
    assert hits > 0.95 * total and false < 0.02 * total


def test_pii_adds_spans_and_masks(spark, odd_documents, crf):
    text = "call (569) 555-7279 or write jo.smith [at] mail3 [dot] com, jo@x.org, +1 (569) 555-7279."
    df = spark.createDataFrame([(1, text, "en", 5), (2, None, "en", None), (None, "é 4111 1111 1111 1111", None, 1)],
                               "doc_id long, text string, spans string, n_chars long")
    got = {r["doc_id"]: r for r in pii.find_pii(df, crf=crf, with_masked=True).collect()}
    assert got[1]["n_email"] == 1 and got[1]["n_phone"] == 1 and got[1]["n_crf"] == 2
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(text))
    assert got[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(got[1]["spans"].split(","))
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["n_card"] == 1 and got[None]["masked"] == "é [CARD]"
    masked = {r["doc_id"]: r for r in pii.mask_documents(df, crf=crf).collect()}
    assert masked[1]["text"] == "call [PHONE] or write [EMAIL], [EMAIL], [PHONE]."
    assert masked[1]["n_chars"] == len(masked[1]["text"]) and masked[2]["text"] is None
    assert masked[1]["spans"] == "en"  # an extra column with a clashing name stays as it is
    assert pii.find_pii(odd_documents, crf=crf).count() == odd_documents.count()
    assert pii.find_pii(df.limit(0), crf=crf).count() == 0


def test_pii_checks_a_span_by_the_law_of_its_kind(crf):
    bad, card = "4111 1111 1111 1112", "4111 1111 1111 1111"
    cut = lambda kind, value: [value[a:b] for a, b in pii.valid_spans(kind, value)]
    assert cut("card", f"{bad}, {card}") == cut("card", f"{bad} {card}") == [card]
    assert cut("card", bad) == [] and cut("card", "3782 822463 10005") == ["3782 822463 10005"]
    for value in ("06 12 34 56 78", "0171 1234567", "0171/1234567", "(569) 555-7279", "001 569 555 7279"):
        assert cut("phone", value) == [value]
        text = f"call {value} or write"
        for block in blocks(pa.array([text])):
            assert [text[a:b] for a, _, b in pii.crf_spans(block, [text], crf, [[]])[0]] == [value]
    assert cut("phone", "(569) 555-7279 569-555-7270") == ["(569) 555-7279", "569-555-7270"]
    assert cut("phone", "12 34 56 78") == cut("phone", "1234567890") == []


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"""


def test_license_rules(spark, odd_documents):
    r = licenses.Recogniser()
    assert [x[0] for x in r.match(r.sentences(MIT))] == ["MIT", "MIT"]
    assert [x[3] for x in r.sentences(MIT)] == ["mit.name", "mit.grant", "mit.keep", "mit.asis"]
    notice = ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in '
              "compliance with the License.\nYou may obtain a copy of the License at\n\n x")
    assert [x[0] for x in r.match(r.sentences(notice))] == ["Apache-2.0"]
    assert r.match(r.sentences("We like the MIT License, and mit too.")) == []
    df = spark.createDataFrame([(1, "x y.\nReleased under the MIT License.\nz"), (2, None), (None, "All rights reserved")],
                               "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.scan_licenses(df).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["findings"] == "MIT:5:35"
    assert got[2]["licenses"] == "" and got[None]["licenses"] == "Proprietary"
    assert licenses.scan_licenses(odd_documents).count() == odd_documents.count()
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_findings_equal_a_scan_line_by_line(spark, documents_table):
    known = {licenses.normalise(f): k for k, forms in licenses.SENTENCES.items() for f in forms if k.endswith("notice")}
    expected = {r["doc_id"]: sum(licenses.normalise(x) in known for x in (r["text"] or "").split("\n"))
                for r in documents_table.collect()}
    got = {r["doc_id"]: sum(x.endswith("notice") for x in r["sentence_ids"].split(","))
           for r in licenses.scan_licenses(documents_table).collect()}
    assert got == expected and sum(expected.values()) > 0


#: Lines of the documents, read by hand, with the licence that each states.
LICENCE_LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "Proprietary"}


def test_every_licence_line_of_the_documents_is_known(spark, documents_table):
    stated = {}
    for r in documents_table.collect():
        found = {x.strip() for x in (r["text"] or "").split("\n") if re.search("licen[sc]e|rights reserved", x, re.I)}
        assert found <= set(LICENCE_LINES)
        stated[r["doc_id"]] = ",".join(sorted({LICENCE_LINES[x] for x in found}))
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents_table).collect()}
    assert got == stated and "CC-BY-NC-4.0" in got.values()


GNU = """This {0} is free software; you can redistribute it and/or modify
it under the terms of the {1} as published by
the Free Software Foundation; either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even"""


@pytest.mark.parametrize("text, licence", [
    *((f"Licensed under CC {x} 4.0.", f"CC-{x}-4.0") for x in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
    ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-NoDerivatives 4.0 International License.",
     "CC-BY-NC-ND-4.0"),
    ("This text is made available under the\nCreative Commons Attribution-ShareAlike 3.0 Unported License (CC BY-SA 3.0)",
     "CC-BY-SA-3.0"),
    (GNU.format("program", "GNU General Public License", "2"), "GPL-2.0-or-later"),
    (GNU.format("program", "GNU General Public License", "3"), "GPL-3.0-or-later"),
    (GNU.format("library", "GNU Lesser General Public License", "2.1"), "LGPL-2.1-or-later"),
    (GNU.format("program", "GNU Affero General Public License", "3"), "AGPL-3.0-or-later"),
    (GNU.format("program", "GNU General Public License", "2").replace("This program is free", "Foo is free"),
     "GPL-2.0-or-later"),
    ("Licensed under the GPLv2 or later", "GPL-2.0-or-later"), ("Released under the AGPL-3.0.", "AGPL-3.0-only"),
    ("Distributed under the ISC license.", "ISC"), ("Released under the MIT Licence.", "MIT"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
     "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License "
     "2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("Available under the terms of the Eclipse Public License v1.0.", "EPL-1.0"),
    ("/* SPDX-License-Identifier: mit */", "MIT"), ("# SPDX-License-Identifier: (GPL-2.0+ OR MIT)\r\n", "GPL-2.0-or-later,MIT"),
    ("// x, SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note AND BSD-3-Clause", "BSD-3-Clause,GPL-2.0-only"),
    ("SPDX-License-Identifier: LicenseRef-Own. More", "LicenseRef-Own"),
    ("The line SPDX-License-Identifier: must stand first", ""), ("Licensed under the usual terms", "")])
def test_common_licences(text, licence):
    r = licenses.Recogniser()
    assert ",".join(sorted({x[0] for x in r.match(r.sentences(f"One.\n{text}\nTwo."))})) == licence


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""


@pytest.mark.parametrize("width", [16, 20, 25, 40, 60, 78, 1000])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_license_texts_at_any_wrap(width, mark):
    r = licenses.Recogniser()
    mit = MIT.split("\n\n", 2)[2].replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")
    for text, licence, n in ((BSD, "BSD-3-Clause", 4), (BSD.rsplit("\n\n", 1)[0], "BSD-2-Clause", 3), (mit, "MIT", 3)):
        wrapped = "\n".join(mark + x for part in text.split("\n") for x in textwrap.wrap(part, width) or [""])
        known = r.sentences(wrapped)
        assert len(known) == n
        assert r.match(known) == [(licence, known[0][1], known[-1][2])]


def test_license_rules_allow_few_unknown_sentences_between():
    r = licenses.Recogniser()
    first, rest = BSD.split("\n\n", 1)
    for n in range(6):
        found = r.match(r.sentences("\n".join([first, *(f"Some line {i}" for i in range(n)), rest])))
        assert [x[0] for x in found] == (["BSD-3-Clause"] if n <= r.max_gap else [])
    assert r.match(r.sentences("\n".join([first, *["中文句子"] * 4, rest]))) == []


def tree(text: str) -> merkle.Tree:
    return next(t for block in blocks(pa.array([text], pa.large_string())) for t in merkle.trees(block))


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_merkle_roots_test_equality(x, y):
    a, b = tree(x), tree(y)
    assert (a.root == b.root) == (x == y)
    assert merkle.read_tree(a.write()) == a
    assert 0.0 <= merkle.likeness(a, b) <= 1.0 and merkle.likeness(a, b) == merkle.likeness(b, a)
    assert (merkle.likeness(a, b) == 1.0) == (x == y)
    assert merkle.differing(a, a) == []


def test_merkle_locates_an_edit():
    lines = [" ".join(f"w{i * 7 + j}" for j in range(30)) for i in range(40)]
    changed = list(lines)
    changed[17] += " more"
    a, b = tree("\n".join(lines)), tree("\n".join(changed))
    found = merkle.differing(a, b)
    place = [(i, j) for i, (_, s) in enumerate(b.sections) for j in range(len(s))]
    assert [place.index(f) for f in found] == [17]
    assert 0.9 < merkle.likeness(a, b) < 1.0


def plain_likeness(x: str, y: str) -> float:
    """Of the written fingerprints: 1 for equal roots, else the Dice share of
    common pieces, counted with their repeats."""
    a, b = ([p for section in written.partition("|")[2].split(";") if section for paragraph in section.partition(":")[2].split("/")
             for p in paragraph.partition(",")[2].split(" ") if p] for written in (x, y))
    if x.partition("|")[0] == y.partition("|")[0]:
        return 1.0
    common = sum((Counter(a) & Counter(b)).values())
    return min(2 * common / (len(a) + len(b)), 1 - 1e-9) if a and b else 0.0


def plain_root(text: str, written: str) -> str:
    """The root that a written fingerprint's own sections have, each that of
    its paragraphs, and each paragraph that of the text's lines."""
    digest = lambda raw: hashlib.blake2b(raw, digest_size=8).digest()
    lines = [digest(line.encode()) for line in re.findall(r"[^\n]*\n|[^\n]+", text)]
    sections, at = [], 0
    for section in filter(None, written.partition("|")[2].split(";")):
        n = section.partition(":")[2].count("/") + 1
        assert [p.partition(",")[0] for p in section.partition(":")[2].split("/")] == [x.hex() for x in lines[at: at + n]]
        sections.append(digest(b"".join(lines[at: at + n])))
        at += n
    assert at == len(lines)
    return hashlib.blake2b(b"".join(sections), digest_size=16).hexdigest()


def check_fingerprints(df, per_range):
    """Against a plain form: the order by a sort of all rows, roots by a plain
    tree of the lines, likenesses from the written pieces."""
    from pyspark.sql import functions as F

    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.orderBy(F.col("doc_id").desc_nulls_last(), "h", "text").collect()
    got = merkle.fingerprint_documents(df, rows_per_range=per_range).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    texts = [r["text"] for r in rows]
    want = []
    for r, text, following in zip(rows, texts, texts[1:] + texts[:1]):
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        want.append((r["doc_id"], len(text), hashlib.sha256(other.encode()).hexdigest(), text, other, following))
    seen = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    assert seen == Counter(w[:3] for w in want)
    written = {}
    for r in got:
        written.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), r)
    by_text = {w[3]: written[w[:3]]["fingerprint"] for w in want}
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_next"], 6)) for r in got) == Counter(
        (*w[:3], round(plain_likeness(by_text[w[3]], by_text[w[5]]), 6)) for w in want)
    for w in want:
        r = written[w[:3]]
        assert r["fingerprint"].partition("|")[0] == plain_root(w[3], r["fingerprint"])
        assert r["edited_fingerprint"].partition("|")[0] == plain_root(w[4], r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]), abs=1e-6)


def test_fingerprints_of_documents_in_order(spark, odd_documents, documents_table):
    check_fingerprints(documents_table, 40)
    check_fingerprints(documents_table, 10 ** 6)
    check_fingerprints(odd_documents, 2)
    assert merkle.fingerprint_documents(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("per_range", [3, 17, 1000])
def test_fingerprints_of_hot_ids_text_ids_and_equal_rows(spark, per_range):
    texts = [f"line {i}\nand {i % 7} more words of it\n" for i in range(40)]
    rows = [(None, t) for t in texts] + [("a7", t) for t in texts] + [(f"x{i}", "one text for all\n") for i in range(20)]
    rows += [("hot", "equal\nrows\n")] * 30 + [(None, None)] * 25 + [("", "")]
    check_fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), per_range)


def test_fingerprint_ranges_are_even(spark):
    """A third of the rows under one id, a third without one: no range holds
    more than three times the median."""
    from pyspark.sql import functions as F

    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows + [(9, "equal")] * 1500, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in merkle._in_order(df, "doc_id", "text", 100).groupBy("range").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    assert merkle._in_order(df, "doc_id", "text", 100).where("guest").count() == len(sizes)
    assert merkle._in_order(df, "doc_id", "text", 100).agg(F.sum("copies")).first()[0] == 4500 + len(sizes)
