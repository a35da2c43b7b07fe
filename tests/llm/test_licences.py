"""Licence scans: compression decides, versions and names must agree, and nothing of a plain scan of all places is lost."""

import random
import textwrap

import pytest

from quaverlake.llm import licences
from quaverlake.llm.licences import TEMPLATES, WORD, Scanner, Template


def names(text):
    return [f["licence"] for f in licences.findings(text)[0]]


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

 1. Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.
 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.
 3. Neither the name of {who} nor the names of its contributors may be used to
    endorse or promote products derived from this software without specific
    prior written permission.

""" + textwrap.fill(licences.BSD_AS_IS, 79)


def test_common_notices_are_found_as_themselves():
    assert names("Copyright 2020\n" + BSD.format(who="the copyright holder")) == ["BSD-3-Clause-text"]
    assert names("Copyright 2020\n" + BSD.format(who="Example Industries")) == ["BSD-3-Clause-text"]
    two = BSD[: BSD.index(" 3.")] + BSD[BSD.index("THIS SOFTWARE") :]
    assert names(two) == ["BSD-2-Clause-text"]
    assert names("Licensed under the MIT License.") == ["MIT-licensed"]
    lesser = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    assert names(lesser) == ["LGPL-2.1-header"] and names(lesser.replace("2.1", "3").replace(";", ",")) == ["LGPL-3.0-header"]
    general = lesser.replace("library", "program").replace("Lesser ", "")
    assert names(general.replace("2.1", "2")) == ["GPL-2.0-header"] and names(general.replace("2.1", "3")) == ["GPL-header"]
    assert names(general.replace("2.1", "4")) == [] and names("SPDX-License-Identifier: MPL-2.0\n") == ["tag-MPL-2.0"]
    assert names("# SPDX-License-Identifier: Unknown-1.0\n") == []


def test_versions_and_names_are_no_small_difference():
    assert names(TEMPLATES["GPL-3.0"].replace("version 3", "version 5")) == []
    assert names(TEMPLATES["GPL-3.0"].replace("GNU", "Example")) == []
    assert names(TEMPLATES["Apache-2.0-header"].replace("Version 2.0", "Version 1.1")) == []
    assert names(TEMPLATES["GPL-header"].replace("GNU General", "GNU Affero General")) == ["AGPL-3.0-header"]
    assert names("Licensed under CC BY 3.0.") == [] and names("Licensed under CC BY-ND 4.0.") == []


@pytest.mark.parametrize("score", [0, 1 << 30])
def test_without_compression_the_findings_change(monkeypatch, score):
    text = "x\n" + BSD.format(who="the copyright holder") + "\n\n" + TEMPLATES["Apache-2.0-header"]
    assert names(text) == ["BSD-3-Clause-text", "Apache-2.0-header"]
    monkeypatch.setattr(Scanner, "saved", lambda self, words, template: score)
    assert names(text) != ["BSD-3-Clause-text", "Apache-2.0-header"]


def plain_places(scanner, words):
    """(template, first, last) of every confirmed match that begins anywhere, by comparing each template with all stretches of the text."""
    out = set()
    for template in scanner.templates:
        for lo in range(0, len(words), max(1, template.most // 3)):
            match = scanner.confirmed(words[lo : lo + 2 * template.most], template)
            if match:
                out.add((template.name, lo + match[0], lo + match[1]))
    return out


def test_nothing_of_a_plain_scan_is_lost():
    rnd = random.Random(11)
    scanner = Scanner(TEMPLATES)
    keys = list(TEMPLATES)
    for _ in range(25):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            words = TEMPLATES[rnd.choice(keys)].split()
            for _ in range(rnd.randint(0, max(0, len(words) // 14))):
                i = rnd.randrange(len(words))
                words[i : i + 1] = rnd.choice(([], [words[i], f"w{rnd.randrange(99)}"], [f"w{rnd.randrange(99)}"]))
            parts += [f"f{rnd.randrange(500)}" for _ in range(rnd.randint(0, 60))] + words
        text = " ".join(parts)
        spans = [m.span() for m in WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        got = scanner.scan(text)
        taken = [(s, e) for s, e, *_ in got]
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:], strict=False))
        for name, lo, hi in plain_places(scanner, words):
            a, b = spans[lo][0], spans[hi - 1][1]
            assert any(s < b and a < e for s, e in taken), (name, text[a:b])
        for s, e, name, _, coverage, _ in got:
            own = [text[a:b].lower() for a, b in spans if s <= a and b <= e]
            assert scanner.confirmed(own, next(t for t in scanner.templates if t.name == name)) and coverage >= licences.COVERAGE


def test_alignment_is_the_best_of_all():
    rnd = random.Random(2)
    scanner = Scanner({})
    for _ in range(300):
        template = Template("t", " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5))))
        words = [rnd.choice("abcdx") for _ in range(rnd.randint(1, 7))]
        pairs = scanner.aligned(words, template, 4)
        assert all(template.words[a] == words[b] for a, b in pairs)
        value = lambda p: 4 * len(p) - (len(template.words) - len(p)) - (p[-1][1] + 1 - p[0][1] - len(p) if p else 0)
        best = [[]]
        for lo in range(len(words)):
            # all ascending pairings from lo on
            stack = [(0, lo, [])]
            while stack:
                a, b, p = stack.pop()
                best.append(p)
                stack += [(i + 1, j + 1, [*p, (i, j)]) for i in range(a, len(template.words)) for j in range(b, len(words)) if template.words[i] == words[j]]
            break
        assert value(pairs) == max(map(value, best))


def test_licences_as_a_table(spark):
    rows = [(1, None), (2, ""), (3, TEMPLATES["MIT"]), (3, TEMPLATES["MIT"]), (4, "license " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, licence string")
    got = licences.licence_scan(docs, docs.columns).collect()
    assert [(r.doc_id, r.licence, r.coverage) for r in got] == [(3, "MIT", 1.0)] * 2
    assert licences.licence_scan(docs.limit(0), ["doc_id"]).collect() == []
    whole = licences.op10_licences(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted((r.doc_id, r.start, r.end, r.licence) for r in whole) == sorted((d, *f[:3]) for d, t in texts.items() for f in Scanner(TEMPLATES).scan(t or ""))
