r"""Operator 12: spelling variants, by asymmetric chunks.

Words are counted first, in one aggregation. Two words that are one edit apart are found by a join: of two words the longer
(of equal ones the smaller) contributes two disjoint chunks, its halves, with their lengths and places; the other contributes
its positional grams of those lengths. One edit leaves one half whole, in its place or shifted by one, so the words meet there. What
is left of both words is again one edit apart; it is halved in the same way, and the half that stays is part of the join key.
So a key holds about three quarters of a word, and words meet only where a stretch of a quarter differs: no chunk as common as a
frequent prefix becomes a group whose pairs are all compared. Grams that no chunk can meet within one place aren't emitted.
Pairs that meet are verified by their edit distance; pairs that meet under several keys are folded.

A run of letters that the noise rule hits loses one code point before it is counted, as the contract of the query says. A null
doc_id counts as an empty one in that rule. Null texts have no words; repeated rows count again, as their texts do. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import Scratch, table

LETTERS = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in so many (by the checksum of document and word) loses a code point.
NOISE = 199
LEAST_LENGTH, LEAST_N, RATIO = 6, 5, 5


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: all words of at least LEAST_LENGTH code points that occur LEAST_N times or more."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    low = run.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = low.filter(F.length("run") >= LEAST_LENGTH).select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_N)


def part(word: Column, start: Column, length: Column) -> Column:
    return F.substring(word, start + 1, length)


def keys(word: Column, own: Column, size: Column) -> list[Column]:
    """Four keys of a word of `own` code points, as it meets words of `size` that give the chunks; for these own = size.

    A half (the first from the left end, the second from the right) and a half of what is left, likewise.
    """
    first = F.floor(size / 2).cast("int")
    second = size - first
    left, right = F.floor(first / 2).cast("int"), F.floor(second / 2).cast("int")
    last = own - second
    return [
        F.concat(F.lit("1"), part(word, F.lit(0), first + right)),
        F.concat(F.lit("2"), part(word, F.lit(0), first), F.lit(" "), part(word, own - (second - right), second - right)),
        F.concat(F.lit("3"), part(word, F.lit(0), left), F.lit(" "), part(word, last, second)),
        F.concat(F.lit("4"), part(word, last - (first - left), (first - left) + second)),
    ]


def near_pairs(words: DataFrame) -> DataFrame:
    """x, nx, y, ny: each pair of words at edit distance one, once."""
    own = F.length("word")
    chunk = F.explode(F.array(*(F.struct(own.alias("size"), k.alias("key")) for k in keys(F.col("word"), own, own))))
    gram = F.explode(F.array(*(F.struct((own + more).alias("size"), k.alias("key")) for more in (0, 1) for k in keys(F.col("word"), own, own + more))))
    x = words.select(F.col("word").alias("x"), F.col("n").alias("nx"), chunk.alias("c")).select("x", "nx", "c.size", "c.key")
    y = words.select(F.col("word").alias("y"), F.col("n").alias("ny"), gram.alias("g")).select("y", "ny", "g.size", "g.key")
    met = x.join(y, ["size", "key"]).filter((F.length("x") > F.length("y")) | (F.col("x") < F.col("y")))
    return met.filter(F.levenshtein("x", "y", 1) == 1).select("x", "nx", "y", "ny").distinct()


def variants(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n).

    Each step of a chain of forms multiplies n by RATIO at least, so the largest n bounds the chain; roots are found by
    doubling, in as many joins as the logarithm of that bound.
    """
    scratch = scratch or Scratch()
    words, seen = scratch.keep_with(words, "words", [F.count(F.lit(1)).alias("n"), F.max("n").alias("most")])
    pairs = near_pairs(words)
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("ny").alias("m")).union(pairs.select("y", "x", "nx"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("b"))
    much = -F.col("b.m") >= RATIO * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("b.w")).alias("form"), F.when(much, -F.col("b.m")).alias("form_n"))
    formed = scratch.keep(formed, "forms")
    steps = max(1, int(math.log(max(seen["most"] or 1, 1), RATIO)))
    root = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        root = scratch.keep(root.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    done = scratch.keep(formed.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "variants")
    scratch.drop(but=1)
    return done


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(vocabulary(table(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", *(F.col(c).cast("long").alias(c) for c in ("n", "n_near", "form_n")))
