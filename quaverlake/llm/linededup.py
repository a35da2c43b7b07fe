"""Operator 7: line dedup by winnowing over line hashes.

A passage counts as repeated when a run of whole lines with at least PASSAGE words occurs earlier: in an earlier document by
doc_id, or earlier in the same one. A window is the shortest run of lines from a line on, or up to a line, with that many
words; of each window the least line hash is selected (the last one among equals). Neighbouring windows often select the same line,
so there are fewer fingerprints than lines (two thirds where most lines have tens of words), and two equal runs always have a fingerprint in common, at the same line.
Fingerprints are joined first: one that occurs once in the corpus can't lie in a repeated run and goes. Around those that
repeat, matches are verified and extended both ways by the windows that selected them, which have digests, not line by line: the windows that
agree with an earlier place reach as far as the repeated run, and no farther. Only the first place of each is looked up, never
all pairs, and the lines of matching windows go from all places but the first.

Lines are compared without white space at their ends; lines without words take no part and go only inside a deleted run.
A run that overlaps its own first place keeps that place. Null and empty texts stay as they are. Rows that agree in
doc_id and text count as one document and get the same result. The order of documents with a null doc_id is first. Of
columns with clashing names the carried ones stay.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import as_text, materialize, table, with_text_columns

#: Words that a repeated run of lines must have.
PASSAGE = 50
SPACE = b" \t\n\x0b\x0c\r"


def fingerprints(text: str | None, passage: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """The selected line hashes, each with the windows that selected it: (window hash, first line, last line)."""
    hashes, words, at = [], [], []
    for i, line in enumerate(as_text(text).encode().split(b"\n")):
        if n := len(line.split()):
            hashes.append(xxhash.xxh3_64_intdigest(line.strip(SPACE)))
            words.append(n)
            at.append(i)
    if not words:
        return []
    total = np.zeros(len(words) + 1, np.int64)
    total[1:] = np.cumsum(words)
    end = np.searchsorted(total[1:], total[:-1] + passage)
    pairs = [(a, b) for a, b in enumerate(end.tolist()) if b < len(words)]
    begin = np.searchsorted(total, total[1:] - passage, "right") - 1
    pairs += [(a, b) for b, a in enumerate(begin.tolist()) if a >= 0 and end[a] != b]
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in pairs:
        run = hashes[a : b + 1]
        least = max(range(a, b + 1), key=lambda i: (-hashes[i], i))
        chosen.setdefault(least, []).append((signed(xxhash.xxh3_64_intdigest(np.array(run, np.uint64).tobytes())), at[a], at[b]))
    return [(signed(hashes[i]), found) for i, found in sorted(chosen.items())]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def row_id(docs: DataFrame) -> Column:
    """Two hashes of doc_id and text, so that no other document is met by chance."""
    return F.struct(F.xxhash64(docs["doc_id"], docs["text"]).alias("h"), F.xxhash64(F.lit("again"), docs["text"], docs["doc_id"]).alias("g"))


def repeated(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """row (as row_id gives it), runs: the line ranges that go, as array of (first, last)."""
    rows = docs.select(row_id(docs).alias("row"), "doc_id", "text")
    window = "array<struct<digest:bigint,first:bigint,last:bigint>>"
    found = with_text_columns(rows, lambda t: (fingerprints(t, passage),), f"f array<struct<fingerprint:bigint,windows:{window}>>", carry=["row", "doc_id"])
    selected = materialize(found.select("row", "doc_id", F.explode("f").alias("f")).select("row", "doc_id", "f.*"), "line-fingerprints")
    again = selected.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fingerprint")
    places = materialize(selected.join(again, "fingerprint", "left_semi"), "line-places")
    places = places.select("fingerprint", "row", "doc_id", F.explode("windows").alias("w")).select("fingerprint", "row", "doc_id", "w.*")
    place = F.struct("doc_id", "row", "first", "last")
    sources = places.groupBy("fingerprint", "digest").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = places.join(sources, ["fingerprint", "digest"]).filter("row != source.row or first != source.first")
    begin = F.when(F.col("row") == F.col("source.row"), F.greatest("first", F.col("source.last") + 1)).otherwise(F.col("first"))
    return later.groupBy("row").agg(F.collect_set(F.struct(begin.alias("first"), "last")).alias("runs"))


def without(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int, int]:
    """The text without the lines of the runs, and how many lines there were, lines went and words went."""
    if text is None:
        return None, 0, 0, 0
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0, 0
    edge = np.zeros(len(lines) + 1, np.int64)
    for r in runs:
        if r["first"] <= r["last"]:
            edge[r["first"]] += 1
            edge[r["last"] + 1] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum()), sum(len(x.encode().split()) for x, g in zip(lines, gone, strict=True) if g)


def line_dedup(docs: DataFrame, carry: list[str], passage: int = PASSAGE, prefix: str = "") -> DataFrame:
    """The carried columns with text (deduplicated), n_lines, n_removed and n_removed_words of every document."""
    inner = docs.select(*(docs[f"`{c}`"].alias(f"in{i}") for i, c in enumerate(carry)), docs["text"].alias("whole"), row_id(docs).alias("row"))
    joined = inner.join(repeated(docs, passage).hint("shuffle_hash"), "row", "left")
    out = with_text_columns(joined, without, "text string, n_lines bigint, n_removed bigint, n_removed_words bigint", text="whole", more=("runs",), carry=[f"in{i}" for i in range(len(carry))], prefix="out_")
    return out.toDF(*carry, *(prefix + c for c in ("text", "n_lines", "n_removed", "n_removed_words")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), ["doc_id"])
