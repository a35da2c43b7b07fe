"""Long fragments and the query of operator 6 as tables, against the library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quaverlake.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def test_long_fragments_equal_the_library():
    rnd, lib, codec = random.Random(8), library(), bpe.codec(PATH)
    texts = ["a" * n for n in (63, 64, 65, 66, 127, 1000, 20_001)] + ["ab" * 700, "the" * 3000, "\n" * 5000, " " * 5001 + "x", "é" * 900, "1" * 999, "=" * 1500, "aA" * 400]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(60, 3000))) for alphabet in ("ab", "aeiou", "etaoinshrdlu", "zqxjkvb", "日本語ß") for _ in range(12)]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text[:20]
        assert codec.decode(ids) == text


def test_both_ways_of_merging_agree(monkeypatch):
    rnd, codec = random.Random(9), bpe.codec(PATH)
    fragments = ["".join(rnd.choice("etaoins") for _ in range(rnd.randint(1, 200))).encode() for _ in range(300)]
    long = [codec.merge_long(f) for f in fragments]
    monkeypatch.setattr(bpe, "LONG", 1 << 30)
    assert [codec.merge(f) for f in fragments] == long


def test_a_million_of_one_letter():
    codec = bpe.codec(PATH)
    began = time.perf_counter()
    ids = codec.encode("a" * 1_000_000)
    assert time.perf_counter() - began < 30 and codec.decode(ids) == "a" * 1_000_000


def test_query_columns_against_the_library(spark, tmp_path):
    """The three digest columns on nulls, empty texts, special tokens, repeated rows, extra columns and no rows."""
    lib = library()
    rows = [(1, None), (2, ""), (3, "Hello  world\n\n it's 2024 <|endoftext|>x"), (3, "Hello  world\n\n it's 2024 <|endoftext|>x"), (4, "ß é 日本 😀 \r\n\t"), (None, "no id"), (5, "a" * 5000)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in bpe.op6_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for d, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.op6_bpe(spark, f"{tmp_path}/none").collect() == []
    both = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH), PATH)
    assert sorted((str(r.doc_id), r.decoded) for r in both.collect()) == sorted((str(d), t or "") for d, t in rows)
