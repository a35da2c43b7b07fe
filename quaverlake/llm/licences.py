"""Operator 10: licence scans by conditional compression.

Candidate blocks are windows of words around licence cues, for each template of twice the length that a match may have, so that a match
lies whole in one of them. White space, line ends and comment signs don't count. Each block is compressed twice, alone and with
the template as a raw zstandard dictionary. The bytes that a template saves rank the candidates; those that save less than SAVED of
what the template saves on itself are no candidates. Winners are confirmed best first by their exact wording: the block is aligned
with the template word by word, COVERAGE of the template's words must be there in order, with NOISE of other words between them at most,
and words that tell licences apart (names, versions) must all be there, with none of another licence. What is missing or added is
reported. The words of a confirmed notice are taken; blocks that hold some of them are compressed and ranked again without them,
so that a notice inside a longer one, or an older version of it, gives way to what explains more of the text.

Null and empty texts and texts without cues have no findings; whole texts are read, whatever their length. Templates that save the
same number of bytes are tried in the order of TEMPLATES, and then by place. Repeated rows give repeated findings.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, insort

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import as_text, table, with_text_columns

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."
#: Wording of common notices; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-terms": "This project is licensed under the terms of the MIT license.",
    "BSD-2-Clause-terms": BSD_TERMS,
    "BSD-2-Clause-text": f"{BSD_TERMS} {BSD_AS_IS}",
    "BSD-3-Clause-terms": f"{BSD_TERMS} {BSD_NAMES}",
    "BSD-3-Clause-text": f"{BSD_TERMS} {BSD_NAMES} {BSD_AS_IS}",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-2.0-header": GNU.format(what="program", mark=";", kind="", comma=";", version="2"),
    "LGPL-2.1-header": GNU.format(what="library", mark=";", kind="Lesser ", comma=";", version="2.1"),
    "LGPL-3.0-header": GNU.format(what="library", mark=":", kind="Lesser ", comma=",", version="3"),
    "AGPL-3.0-header": GNU.format(what="program", mark=":", kind="Affero ", comma=",", version="3"),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
TEMPLATES["MIT-full"] = f'{TEMPLATES["MIT-text"]} {AS_IS}'
#: Identifiers of licences in tagged lines; fixed values.
TAGS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]
TEMPLATES |= {f"tag-{tag}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
#: Words that tell licences apart, besides version numbers; `by` and its kin do in notices of Creative Commons.
NAMES = {"apache", "mit", "bsd", "isc", "gnu", "lesser", "affero", "mozilla", "eclipse", "boost", "zlib", "cc", "cc0"}
SHARES = {"by", "by-nc", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd"}
VERSION = re.compile(r"v?[0-9]+(\.[0-9]+)*")
CUES = ("licens", "licenc", "rights reserved", "copyright", "permission is hereby", "redistribution and use", "free software", "mozilla public", "without warrant", "unencumbered software")
COVERAGE = 0.9
#: Words within a match that are not the template's, as a share of its words, that a confirmed match may have.
NOISE = 0.2
#: Bytes that a candidate saves at least, as a share of what its template saves on itself.
SAVED = 0.2
#: The fast strategy with a target length leaves literals as they are, so that sizes tell what was matched and nothing else.
FAST = {"strategy": zstandard.STRATEGY_FAST, "target_length": 1, "min_match": 4}
#: What every text with a cue holds, and cues with anything but words between their words.
GATES = sorted({max(reversed(c.split()), key=len) for c in CUES})
CUE = re.compile("|".join(r"[\W_]+".join(map(re.escape, c.split())) for c in CUES), re.IGNORECASE)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


class Template:
    """A wording: its words, what a match may lack and add, which words must be there and which may not, and its dictionary."""

    def __init__(self, name: str, text: str) -> None:
        self.name = name
        self.words = [m.group().lower() for m in WORD.finditer(text)]
        n, own = len(self.words), set(self.words)
        self.least, self.most = math.ceil(COVERAGE * n - 1e-9), n + int(NOISE * n + 1e-9)
        telling = NAMES | (SHARES if "cc" in own else set())
        numbered = any(VERSION.fullmatch(w) for w in own)
        self.must = [w in telling or bool(VERSION.fullmatch(w)) for w in self.words]
        self.foreign = lambda w: w in telling - own or numbered and bool(VERSION.fullmatch(w))
        self.code = {w: i for i, w in enumerate(own)}
        self.codes = np.array([self.code[w] for w in self.words])
        said = " ".join(self.words).encode()
        self.given = compressor(zstandard.ZstdCompressionDict(said, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.self_saved = len(PLAIN.compress(said)) - len(self.given.compress(said))


def compressor(given: zstandard.ZstdCompressionDict | None = None) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, **FAST), dict_data=given)


PLAIN = compressor()


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = [Template(k, t) for k, t in templates.items()]

    def blocks(self, cues: list[int], n: int, template: Template) -> list[tuple[int, int]]:
        """Windows of twice a match's length, a length apart, that hold a cue (its word's place), or end next to one."""
        m = template.most
        at = sorted({k for c in cues for k in (c // m - 1, c // m) if k >= 0})
        return [(k * m, min(n, k * m + 2 * m)) for k in at]

    def saved(self, words: list[str], template: Template) -> int:
        """Bytes that the template as a dictionary takes off a block."""
        raw = " ".join(words).encode()
        return len(PLAIN.compress(raw)) - len(template.given.compress(raw))

    def aligned(self, words: list[str], template: Template, gain: int) -> list[tuple[int, int]]:
        """Places in the template and in the words that agree, in order, of the best alignment: a word that agrees counts `gain`, one that is missing or added -1."""
        block = np.array([template.code.get(w, -1) for w in words])
        at = np.arange(len(block) + 1)
        rows = [np.zeros(len(block) + 1, np.int64)]
        for code in template.codes:
            row = rows[-1] - 1
            row[1:] = np.maximum(row[1:], np.where(block == code, rows[-1][:-1] + gain, -(1 << 40)))
            rows.append(np.maximum.accumulate(row + at) - at)
        i, j, pairs = len(template.codes), int(np.argmax(rows[-1])), []
        while i:
            if j and block[j - 1] == template.codes[i - 1] and rows[i][j] == rows[i - 1][j - 1] + gain:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif rows[i][j] == rows[i - 1][j] - 1:
                i -= 1
            else:
                j -= 1
        return pairs[::-1]

    def confirmed(self, words: list[str], template: Template) -> tuple[int, int, float, str] | None:
        """First and last word, coverage and differences of the template's notice in a block, if there is one."""
        for gain in (4, 1):
            pairs = self.aligned(words, template, gain)
            if len(pairs) < template.least:
                continue
            lo, hi = pairs[0][1], pairs[-1][1] + 1
            there, held = {a for a, _ in pairs}, {b for _, b in pairs}
            missing = [i for i in range(len(template.words)) if i not in there]
            added = [words[j] for j in range(lo, hi) if j not in held]
            if len(added) <= template.most - len(template.words) and not any(template.must[i] for i in missing) and not any(map(template.foreign, added)):
                return lo, hi, len(pairs) / len(template.words), " ".join([*("-" + template.words[i] for i in missing), *("+" + w for w in added)])
        return None

    def scan(self, text: str) -> list[tuple]:
        low = text.lower()
        if not any(g in low for g in GATES):
            return []
        found = [m.start() for m in CUE.finditer(text)]
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words, starts = [text[a:b].lower() for a, b in spans], [a for a, _ in spans]
        cues = sorted({max(0, bisect_left(starts, c + 1) - 1) for c in found})
        heap: list[tuple] = []

        def offer(order: int, lo: int, hi: int) -> None:
            template = self.templates[order]
            if hi - lo >= template.least:
                saved = self.saved(words[lo:hi], template)
                if saved >= SAVED * template.self_saved:
                    heapq.heappush(heap, (-saved, order, lo, hi))

        for order, template in enumerate(self.templates):
            for lo, hi in self.blocks(cues, len(words), template):
                offer(order, lo, hi)
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            minus, order, lo, hi = heapq.heappop(heap)
            k = bisect_left(taken, (lo, lo))
            inside = [x for x in taken[max(0, k - 1) : bisect_left(taken, (hi, hi))] if x[1] > lo]
            if inside:
                edges = [lo, *(e for x in inside for e in x), hi]
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    offer(order, a, b)
                continue
            template = self.templates[order]
            # the notice may reach beyond the block, as far as words are free
            lo = max(lo - template.most, taken[k - 1][1] if k else 0, 0)
            hi = min(hi + template.most, taken[k][0] if k < len(taken) else len(words))
            match = self.confirmed(words[lo:hi], template)
            if match is None:
                continue
            first, last, coverage, differences = lo + match[0], lo + match[1], *match[2:]
            insort(taken, (first, last))
            out.append((spans[first][0], spans[last - 1][1], template.name, round(-minus / template.self_saved, 6), round(coverage, 6), differences))
            offer(order, lo, first)
            offer(order, last, hi)
        return sorted(out)


FINDING = ("start", "end", "licence", "saved", "coverage", "differences")
_scanners: list[Scanner] = []


def findings(text: str | None) -> tuple[list[dict]]:
    if not _scanners:
        _scanners.append(Scanner(TEMPLATES))
    return ([dict(zip(FINDING, f, strict=True)) for f in _scanners[0].scan(as_text(text))],)


def licence_scan(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and one row a finding: start, end (code points), licence, saved, coverage, differences.

    A carried column with the name of one of these gives way to it. An empty table gives an empty result.
    """
    carry = [c for c in carry if c not in FINDING]
    found = with_text_columns(docs, findings, "found array<struct<start:bigint,end:bigint,licence:string,saved:double,coverage:double,differences:string>>", carry=carry, prefix="_")
    kept = [f"`{c}`" for c in carry]
    return found.select(*kept, F.explode("_found").alias("_f")).select(*kept, "_f.*")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"), ["doc_id"])
