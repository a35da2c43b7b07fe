"""Operators on single texts: tokenizers, statistics, licences, and their edge cases."""

import random
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaverlake.llm import boosting, bpe, language, licences, packing, quality, toxicity

EDGE = ["", " ", "\n\n", "a", "a  b", "a\n\nb", "!'s x's", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "   x  y", "é İ ΣΣ", "naïve café", "x" * 5000, "1.2.3 \U0001f600"]
DOCS = "doc_id bigint, text string"


def noise(n, alphabet, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_equals_library():
    path = public_tokenizers.path(bpe.VOCABULARY)
    library, own = Tokenizer.from_file(path), bpe.codec(path)
    for text in EDGE + noise(3000, "ab'sdtlreve  \n\t é日1²!.#|<>"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == packed(ids), repr(text)
        assert own.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_fragments_join_back():
    own = bpe.codec(public_tokenizers.path(bpe.VOCABULARY))
    for word in (b"strength", "日本".encode(), b"a\x00b"):
        assert b"".join(own.split(word)) == word


def test_word_tokenizer_equals_library():
    path = public_tokenizers.path(packing.VOCABULARY)
    library, own = Tokenizer.from_file(path), packing.tokenizer(path)
    for text in EDGE + noise(3000, "abTHEé ß,.!'sdll<|>\n\t İΣÀ"):
        assert own.encode(text) == packed(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_assign_fills_and_cuts():
    lengths = np.array(sorted(np.random.default_rng(1).integers(1, 100, 500), reverse=True))
    parts = list(packing.assign(lengths, 100, 0.001))
    taken = np.zeros(500, int)
    room = {}
    for piece, begin, take, seq, offset in parts:
        assert begin == taken[piece] and offset == room.get(seq, 0)
        taken[piece] += take
        room[seq] = offset + take
    assert (taken == lengths).all() and max(room.values()) <= 100
    assert len(room) == -(-int(lengths.sum()) // 100)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x " * 9000)]])
def test_pack_covers_every_token(spark, rows):
    out = packing.pack(spark.createDataFrame(rows, DOCS), public_tokenizers.path(packing.VOCABULARY)).collect()
    assert len(out) == 0 if not rows else len(out) >= len(rows)
    assert all(r.length <= 4096 and r.offset + r.length <= 4096 for r in out)
    assert sum(r.length for r in out if r.doc_id is None) == (9001 if rows else 0)
    assert sorted(r.length for r in out if r.doc_id in (1, 2)) == ([1, 1] if rows else [])


def plain_statistics(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_plain_count():
    for text in [None, *EDGE, *noise(300, "ab c\n#é \t", 8), "a b c a b c", "x\nx\n \n \nx"]:
        assert quality.statistics(text)[:5] == plain_statistics(text), repr(text)


def test_trees_keep_directions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = (x[:, 0] + 0.3 * rng.random(3000) > 0.6).astype(float)
    trees = boosting.fit(x, y, monotone={0: 1, 1: -1})
    grid = np.linspace(0, 1, 50)
    assert (np.diff(trees.margin(np.column_stack([grid, np.full(50, 0.5)]))) >= -1e-9).all()
    assert (np.diff(trees.margin(np.column_stack([np.full(50, 0.5), grid]))) <= 1e-9).all()
    assert ((trees.probability(x) > 0.5) == (y > 0)).mean() > 0.85


def test_trees_as_column(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    trees = boosting.fit(x, (x[:, 0] > x[:, 1]).astype(float), trees=5)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = [r.m for r in df.select(trees.column([df.a, df.b, df.c]).alias("m")).collect()]
    assert got == pytest.approx(trees.margin(x).tolist())


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "w " * 60, 7), (3, "w " * 60, 7)], DOCS + ", kept int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    out = quality.quality(docs, model, ["doc_id", "kept"]).collect()
    assert [r.base_failed for r in out] == [True] * 4 and not any(r.kept for r in out)
    assert quality.quality(docs.limit(0), model, ["doc_id"]).collect() == []


def test_licences_found_and_told_apart():
    names = lambda t: [f["licence"] for f in licences.findings(t)[0]]
    for name, text in licences.TEMPLATES.items():
        assert name in names(f"some words\n{text}\nmore words")
    assert names("licensed by nobody") == [] and names(None) == [] and names("") == []
    assert names(licences.TEMPLATES["GPL-2.0"]) == ["GPL-2.0"]
    two = licences.TEMPLATES["MIT"] + "\n" + licences.TEMPLATES["CC-BY-NC-4.0"]
    assert names(two) == ["MIT", "CC-BY-NC-4.0"]
    found = licences.findings("x\n" + licences.TEMPLATES["MIT-text"].replace("Software", "Program"))[0][0]
    assert found["licence"] == "MIT-text" and "+program" in found["differences"]


def licence_names(text):
    return [f["licence"] for f in licences.findings(text)[0]]


def test_licences_beyond_the_best_ranked():
    t = licences.TEMPLATES
    for names in (["GPL-3.0", "all-rights-reserved"], ["CC-BY-4.0", "all-rights-reserved"], ["MIT", "CC-BY-4.0", "GPL-3.0", "all-rights-reserved"], ["LGPL-3.0", "MIT", "GPL-2.0", "GPL-3.0"]):
        for order in (names, names[::-1]):
            assert licence_names("\n".join(t[n] for n in order)) == order


def test_licences_in_long_blocks():
    rng = random.Random(4)
    filler = [" ".join(f"w{rng.randrange(4000)}" for _ in range(9)) + " license" for _ in range(3000)]
    for name in ("MIT", "MIT-text", "CC-BY-4.0", "GPL-3.0", "all-rights-reserved"):
        lines = list(filler)
        for at in (0, 1, 700, 2999):
            lines.insert(at, licences.TEMPLATES[name])
        assert licence_names("\n".join(lines)) == [name] * 4
    names = [rng.choice(list(licences.TEMPLATES)) for _ in range(300)]
    assert licence_names("\n".join(licences.TEMPLATES[n] for n in names)) == names


def test_licences_partial_notice_beside_a_whole_one():
    whole = licences.TEMPLATES["MIT-text"].split()
    edited = [w for i, w in enumerate(whole) if i % 15 != 7]
    for words in (whole[:60] + edited, edited + whole[:60], edited + whole):
        found = licences.findings(" ".join(words))[0]
        assert [f["licence"] for f in found] == ["MIT-text"] * (2 if words[-1] == whole[-1] and len(words) > 150 else 1)


@pytest.mark.parametrize("prefix", ["", "# ", "// ", " * ", "-- "])
@pytest.mark.parametrize("width", [30, 80])
def test_licences_wrapped(prefix, width):
    for name, text in licences.TEMPLATES.items():
        wrapped = textwrap.wrap(text, width, initial_indent=prefix, subsequent_indent=prefix, break_on_hyphens=False)
        assert licence_names("\n".join(["x = 1", *wrapped, "y = 2"])) == [name]
        assert licence_names("\n".join([*["filler text"] * 200, *wrapped, *["filler text"] * 200, *wrapped])) == [name] * 2
    assert licence_names("All rights\n// reserved.") == ["all-rights-reserved"]
    assert licence_names("İİİ All rights reserved") == ["all-rights-reserved"]


def test_viterbi_equals_plain():
    rng = np.random.default_rng(2)
    sizes = np.array([5, 0, 1, 9, 3])
    scores = rng.normal(0, 4, (int(sizes.sum()), 3)).astype(np.float32)
    got, at = language.viterbi(scores, sizes), 0
    for n in sizes:
        own = scores[at : at + n]
        best = max((sum(own[i, s] for i, s in enumerate(p)) - language.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False)), p) for p in __import__("itertools").product(range(3), repeat=int(n)))
        path = got[at : at + n]
        value = sum(own[i, s] for i, s in enumerate(path)) - language.SWITCH * (path[1:] != path[:-1]).sum()
        assert value == pytest.approx(best[0], abs=1e-3)
        at += n


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, lang) for i in range(40) for t, lang in (("the house and the garden", "en"), ("das haus und der garten", "de"), ("дом и сад", "ru"))], DOCS + ", lang string")
    model = language.fit(docs, docs.doc_id >= 0)
    probe = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "der garten und das haus"), (5, "сад дом")], DOCS)
    out = {r.doc_id: r for r in language.identify(probe, model, ["doc_id"]).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "de", "ru"]
    assert out[1].score == 0 and 0 < out[4].score <= 1 and out[5].spans[0].lang == "ru"
    none = language.fit(docs.limit(0), docs.doc_id >= 0)
    assert {r.lang_pred for r in language.identify(probe, none, ["doc_id"]).collect()} == {"und"}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you stupid idiot you moron"), (4, "a calm text")] * 5, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, model, ["doc_id"]).collect()}
    assert out[3] > out[4] and out[1] == out[2] and all(0 <= s <= 1 for s in out.values())


def test_toxicity_counts_capitals_of_whole_texts():
    shouting = len(toxicity.PATTERNS) - toxicity.PATTERNS.index("shouting")
    calm = len(toxicity.PATTERNS) - toxicity.PATTERNS.index("calm")
    for text, is_shouting, is_calm in (("aB" * 2000, 0, 0), ("Ba" * 2000, 0, 0), ("BaB" * 3000, 1, 0), ("aaBBB" * 2000, 1, 0), ("Baaaaaaaaa" * 2000 + "B", 0, 0), ("B" + "a" * 19 + "b" * 4000, 0, -1), ("Baaaaaaaaaaa" * 2000, 0, -1)):
        got = toxicity.votes(text, {})
        assert (got[-shouting], got[-calm]) == (is_shouting, is_calm), text[:12]


def test_pack_equals_library(spark):
    """Ids of every piece, starts and offsets without gaps, and at most one sequence of padding a block, against the library."""
    path = public_tokenizers.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, "lorem ipsum, dolor " * 7000), (10**6 + 1, None), (10**6 + 2, "")]
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [packing.END] for d, t in rows}
    out = packing.pack(spark.createDataFrame(rows, DOCS), path).collect()
    at, room = {}, {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] = r.start + r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert at == {d: len(v) for d, v in ids.items()}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= packing.CAPACITY and len(room) == -(-sum(map(len, ids.values())) // packing.CAPACITY)
