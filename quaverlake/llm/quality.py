"""Operator 2: quality rules. Boosted trees over document statistics, behind two fixed base rules.

Statistics are taken of the whole text; words are runs of characters other than ASCII white space. The trees are fitted on all
labelled documents (by Spark's sums of gradients, see `boosting`) with directions fixed for some statistics, kept as flat numpy
node arrays and scored a batch at a time. A quarter of the labelled documents, by a hash of their ids, is held out; the threshold
is the margin (rounded down to 2**-MARGIN_SCALE) that keeps all but MISSED of its good documents, so that clean documents stay.

Null and empty texts have no words and fail the base rule. Without labels (or with one kind only) the trees reject nothing.
Repeated rows get equal verdicts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm import boosting
from quaverlake.llm.common import Scratch, as_text, mix, table, with_text_columns, word_hashes

#: Share of held-out good documents that the threshold may reject.
MISSED = 0.0005
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_digits bigint, n_marks bigint, n_distinct bigint"
FEATURES = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "line_words"]
#: More symbols, repeats or capitals never make a text better.
DIRECTIONS = {FEATURES.index(f): -1 for f in ("symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate")}
UPPER, DIGITS, MARKS = (bytes(range(65, 91)), bytes(range(48, 58)), b"!?;:\"'()[]{}=_/\\~^")


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATISTICS."""
    text = as_text(text)
    raw = text.encode()
    words = word_hashes(raw)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    repeated = 0
    if len(words) >= 4:
        with np.errstate(over="ignore"):
            windows = mix(words[:-2] * np.uint64(3) ^ mix(words[1:-1] + np.uint64(1)) ^ mix(words[2:] * np.uint64(5)))
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return (len(words), len(text) - count(SPACE), count(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), count(UPPER), count(DIGITS), count(MARKS), len(np.unique(words)))


def features(rows: np.ndarray) -> np.ndarray:
    """Rates of the statistics (rows by STATISTICS), as FEATURES names them."""
    words, chars, symbols, dups, repeats, lines, upper, digits, marks, distinct = rows.astype(float).T
    per_word, per_char, per_line = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([np.log1p(words), chars / per_word, symbols / per_word, dups / per_line, repeats / per_word, upper / per_char, digits / per_char, marks / per_word, distinct / per_word, words / per_line], axis=1)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[boosting.Trees, float]:
    """Trees and threshold from all labelled rows; texts become statistics before the join, so that no text is shuffled."""
    known = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality")
    found = with_text_columns(docs.select("doc_id", "text"), statistics, "x array<double>", carry=["doc_id"], after=lambda rows: [(x,) for x in features(np.array(rows, np.int64)).tolist()])
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0
    scratch = Scratch()
    data = scratch.keep(found.join(known, "doc_id").select("x", (F.col("quality") > 0).cast("int").alias("y"), F.lit(1).cast("bigint").alias("n"), held.alias("held"), F.lit(0).alias("part")), "labelled")
    trees, margins = boosting.fit_table(scratch, data, len(FEATURES), monotone=DIRECTIONS)
    scratch.drop()
    good = sorted((level, n) for _, level, y, n in margins if y == 1)
    if not good:
        return trees, 0.0
    upto = np.cumsum([n for _, n in good])
    least = good[int(np.searchsorted(upto, int(MISSED * (upto[-1] - 1)) + 1))][0] / (1 << boosting.MARGIN_SCALE)
    return trees, min(0.5, float(1 / (1 + np.exp(-least))))


def quality(docs: DataFrame, model: tuple[boosting.Trees, float], carry: list[str], prefix: str = "") -> DataFrame:
    """The carried columns, the statistics, base_failed, quality (probability) and kept of each document."""
    trees, threshold = model

    def verdicts(rows: list[tuple]) -> list[tuple]:
        data = np.array(rows, np.int64)
        failed = (data[:, 0] < LEAST_WORDS) | (100 * data[:, 4] > REPEAT_PERCENT * data[:, 0])
        good = np.where(failed, 0.0, trees.probability(features(data)))
        return [(*r, *v) for r, v in zip(rows, zip(failed.tolist(), good.tolist(), (~failed & (good >= threshold)).tolist(), strict=True), strict=True)]

    schema = STATISTICS + ", base_failed boolean, quality double, kept boolean"
    return with_text_columns(docs, statistics, schema, carry=carry, prefix=prefix, after=verdicts)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return quality(docs, model, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
