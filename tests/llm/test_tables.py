"""Operators on whole tables against brute force, held-out accuracy, and the pipeline's stages."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaverlake.llm import components, jaccard, language, licences, linededup, neardup, pii, quality, registry, toxicity

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string"


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (7, 9), (3, 1), (5, 5), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in roots(links, {x for p in links for x in p}).items() if k != 5}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_copies(seed=4):
    """Texts with copies at all distances, a large group of near copies, a common passage and edge cases."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 5000)}"
    rows = [None, "", "   ", "one", "one", "one two three four", "one two three four five", "one two three four five six"]
    for size in (5, 8, 12, 20, 40, 100, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            rows.append(" ".join(base))
            for edits in (0, 1, 2, size // 20, size // 12, size // 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.integers(0, len(copy))] = word()
                rows.append(" ".join(copy[: len(copy) - int(rng.integers(0, 3))]))
    passage, centre = [word() for _ in range(60)], [word() for _ in range(80)]
    for _ in range(40):
        rows.append(" ".join(passage + [word() for _ in range(int(rng.integers(5, 60)))]))
        copy = list(centre)
        copy[rng.integers(0, 80)] = word()
        rows.append(" ".join(copy))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("hot", "block"), [(64, 1024), (4, 8)])
def test_jaccard_equals_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies()
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(links, sets)
    out = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in out} == want
    assert {r.doc_id: r.n_shingles for r in out} == {i: len(s) for i, s in sets.items()}


def test_jaccard_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_components(docs).collect() == [] and jaccard.one_of_each(docs).collect() == []


def test_pii_adds_spans(spark):
    """What the trees add lies outside base spans, all of it is assigned to a token, and no such token is missed."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    found = pii.personal_data(docs, pii.fit(docs), [F.col("doc_id")]).filter("size(spans) > size(base) OR contains(lower(body), 'token = ')").collect()
    added = 0
    for r in found:
        new = [s for s in r.spans if s not in r.base]
        assert all(s.e <= b.s or b.e <= s.s for s in new for b in r.base)
        tokens = [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.body)]
        assert set(tokens) <= {(s.s, s.e) for s in new if pii.ALL[s.kind] == "secret"}
        added += len(new)
    assert added >= 100


def plain_line_dedup(rows, passage=50):
    """Every line of a run of whole lines with enough words that occurs in an earlier text, by extending each pair of equal lines.

    Within a text, of a run's shortest windows from both ends those go that have a first place, but for what lies in it.
    """
    earlier, places, out = {}, {}, {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.encode().split()]
        words = [len(lines[i].encode().split()) for i in at]
        own = [lines[i].strip(" \t\n\x0b\x0c\r") for i in at]
        gone = set()
        for i, line in enumerate(own):
            for e, j in places.get(line, ()):
                other = earlier[e]
                if i and j and own[i - 1] == other[j - 1]:
                    continue  # the run was looked at from its first line on
                n = 0
                while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                    n += 1
                if sum(words[i : i + n]) >= passage:
                    gone |= set(range(at[i], at[i + n - 1] + 1))
        windows = []
        for a in range(len(at)):
            b = next((b for b in range(a, len(at)) if sum(words[a : b + 1]) >= passage), None)
            windows += [] if b is None else [(a, b)]
        for b in range(len(at)):
            a = next((a for a in range(b, -1, -1) if sum(words[a : b + 1]) >= passage), None)
            windows += [] if a is None else [(a, b)]
        first = {}
        for a, b in sorted(windows):
            first.setdefault(tuple(own[a : b + 1]), (a, b))
        for a, b in windows:
            x, y = first[tuple(own[a : b + 1])]
            if x != a:
                gone |= set(range(max(at[a], at[y] + 1), at[b] + 1))
        earlier[d] = own
        for i, line in enumerate(own):
            places.setdefault(line, []).append((d, i))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    line = " ".join(f"v{i}" for i in range(26))
    rows += [(10**6, "\n".join([line] * 6)), (10**6 + 1, f"x\n{line}\n\n{line}\ny"), (10**6 + 2, "short\n" * 200)]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert got == plain_line_dedup(rows)


def maximal_line_dedup(rows, passage=50):
    """Every run of whole lines with enough words, of any length, that stood earlier goes."""
    seen, out = {}, {}
    for d, text in sorted(rows):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x.split()]
        gone = set()
        for a in range(len(at)):
            for b in range(a, len(at)):
                key = tuple(lines[i].strip() for i in at[a : b + 1])
                if sum(len(x.split()) for x in key) >= passage:
                    first, end = seen.setdefault(key, (d, at[b]))
                    if (first, end) != (d, at[b]):
                        gone |= set(range(at[a] if first != d else max(at[a], end + 1), at[b] + 1))
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_removes_whole_runs(spark):
    rng = np.random.default_rng(9)
    line = lambda n: " ".join(f"t{rng.integers(0, 10**6)}" for _ in range(n))
    a, b, c = line(60), line(10), line(10)
    rows = [(1, "\n".join([line(3), a, b, c, line(5)])), (2, "\n".join([line(8), a, b, "", c, line(4)])), (3, "\n".join([line(60), b])), (4, "\n".join([line(9), a]))]
    rows += [(5, rows[2][1]), (6, "\n".join([b, c, a, b, a, b, c])), (7, "\n".join([line(20), line(20)])), (8, "\n".join([line(9), c]))]
    pool = [line(int(n)) for n in (1, 2, 5, 9, 14, 22, 31, 49, 50, 70)]
    rows += [(d, "\n".join(pool[i] for i in rng.integers(0, 10, int(rng.integers(1, 12))))) for d in range(10, 130)]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS), ["doc_id"]).collect()}
    assert got[5] == "" and not {a, b, c} & set(got[2].split("\n"))
    assert got == maximal_line_dedup(rows)


def test_winnowing_selects_few_lines():
    text = "\n".join(f"word{i} is line {i * i} of it" for i in range(400))
    found = linededup.fingerprints(text, 50)
    assert 0 < len(found) < 100 and sum(len(w) for _, w in found) > 380
    inner = "\n".join(text.split("\n")[100:130])
    assert {f for f, _ in linededup.fingerprints(inner, 50)} & {f for f, _ in found}


def test_pipeline_edges(spark):
    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = corpus_pipeline.quality_stage(spark, whole, SMALL).orderBy(F.length("text").desc()).first().text
    n = 10**9  # no labels there, so the base rules decide alone
    docs = spark.createDataFrame([(n, text, 5, True, "x"), (n + 1, text, 5, None, None), (n + 2, None, None, True, "x"), (n + 3, "", 0, True, "x")], DOCS + ", n_chars int, _q_kept boolean, `a.b` string")
    rows, none = docs, docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows, none = jaccard.materialize(stage(spark, rows, SMALL), "edges"), stage(spark, none, SMALL)
        assert rows.columns == none.columns == docs.columns
    kept = {r.doc_id: (r.text, r["a.b"]) for r in rows.collect()}
    assert kept.keys() <= {n, n + 1} and kept[n][0] and kept[n][1] == "x" and none.count() == 0
    assert {r.doc_id for r in corpus_pipeline.packing_stage(spark, rows, SMALL).collect()} == set(kept)
    assert corpus_pipeline.packing_stage(spark, none, SMALL).collect() == []


def test_licence_table(spark):
    notices = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."]
    filler = " ".join(f"word{i}" for i in range(20_000))
    texts = [None, "", " ".join(notices), "\n".join([notices[0]] * 3), f"{filler} {notices[3]} {filler}", "license terms of no kind at all"]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)] + [(2, texts[2], 7, "x")], DOCS + ", start int, `a.b` string")
    out = licences.licence_scan(docs, ["doc_id", "start", "a.b"])
    assert out.columns == ["doc_id", "a.b", *licences.FINDING]
    found = {}
    for r in out.collect():
        found.setdefault(r.doc_id, []).append((r.start, r.licence))
        assert r.coverage >= licences.COVERAGE and texts[r.doc_id][r.start : r.end]
    assert sorted(found) == [2, 3, 4] and [n for _, n in sorted(found[4])] == ["GPL-3.0"]
    assert sorted(n for _, n in found[2]) == sorted(["MIT", "CC-BY-4.0", "all-rights-reserved", "GPL-3.0", "Apache-2.0"] * 2)
    assert [n for _, n in sorted(found[3])] == ["MIT"] * 3
    assert licences.licence_scan(docs.limit(0), ["doc_id"]).collect() == []


def test_line_dedup_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3), (None, "a\nb", 3)], DOCS + ", n_lines int")
    out = linededup.line_dedup(docs, ["doc_id", "n_lines"], prefix="_").select("doc_id", "n_lines", "_text").collect()
    assert sorted(map(repr, ((r[0], r[1], r[2]) for r in out))) == sorted(map(repr, ((1, 3, None), (2, 3, ""), (2, 3, ""), (None, 3, "a\nb"))))
    assert linededup.line_dedup(docs.limit(0), ["doc_id"]).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 900)] + 0.12 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 0), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, rows[0][1], None), (2005, [float("nan")] * 16, 0), (2006, [None] * 16, 0), (2007, [], 0)]
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.sqrt((v * v).sum()) for _, v, _ in ok])
    lab, ids = np.array([r[2] for r in ok]), np.array([r[0] for r in ok])
    near = (unit @ unit.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    count = dict(zip(ids.tolist(), near.sum(axis=1).tolist(), strict=True))
    want = roots([(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(near), strict=True)], [r[0] for r in rows])
    for cell in (1024, 60):
        old, neardup.CELL = neardup.CELL, cell
        try:
            out = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
        finally:
            neardup.CELL = old
        assert {r.vec_id: r.n_links for r in out} == {r[0]: count.get(r[0], 0) for r in rows}
        assert {r.vec_id: r.component_id for r in out} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in out)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group()))


def test_base_spans_equal_plain_matching(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("aB0123459.@+-() %_\n é") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", "1.2.3.4.5.6.7.8.9", "a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (415) 555-0100", "x" * 50_000 + "@y.z", "1" * 50_000, "256.1.1.1 1.1.1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = pii.personal_data(docs, pii.fit(docs), [F.col("doc_id")])
    for r in found.select("doc_id", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s")).collect():
        assert r.b == plain_spans(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.b.split(","))) <= set(filter(None, r.s.split(",")))


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "write a@b.cd or call +1 (415) 555-0100 now", 5), (2, None, 5), (3, "", 5)], DOCS + ", body int")
    out = {r.doc_id: r for r in pii.redact(docs, (pii.boosting.flat([], [], 0.0), [float("inf")] * 4)).collect()}
    assert out[1].text == "write [EMAIL] or call [PHONE] now" and out[1].body == 5
    assert out[2].text is None and out[3].text == ""
    assert pii.redact(docs.limit(0), pii.fit(docs.limit(0))).collect() == []


def test_held_out_language_and_toxicity(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    lang = language.op4_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert lang.filter("lang = lang_pred").count() >= 0.97 * lang.count()
    # the small table has some 40 toxic labels, too few to learn the other languages' words from
    tox = toxicity.op5_toxicity(spark, LARGER).join(labels, "doc_id").filter("held_out").collect()
    clean = [r for r in tox if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    scores = [(r.score, r.toxic) for r in tox]
    pairs = [(a, b) for a, x in scores if x for b, y in scores if not y]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) >= 0.85 * len(pairs)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in quality.quality(docs, model, ["doc_id"]).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns
    kept = jaccard.materialize(kept, "t")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lines = jaccard.materialize(corpus_pipeline.line_dedup_stage(spark, kept, SMALL), "t")
    assert {r.doc_id: r.text for r in lines.collect()} == plain_line_dedup(rows) and lines.columns == columns
    assert lines.filter("n_chars <> length(text)").count() == 0
    one = jaccard.materialize(corpus_pipeline.jaccard_stage(spark, lines, SMALL), "t")
    sets = {r.doc_id: shingle_set(r.text) for r in lines.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in one.collect()} == {d for d, root in roots(links, sets).items() if d == root}
    clean = jaccard.materialize(corpus_pipeline.pii_stage(spark, one, SMALL), "t")
    assert all(plain_spans(r.text) == "" for r in clean.collect()) and clean.columns == columns
    pieces = corpus_pipeline.packing_stage(spark, clean, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in registry.QUERIES if k.startswith("op")} and "pipeline" in registry.QUERIES
