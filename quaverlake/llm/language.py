"""Operator 4: language identification of mixed-language texts.

The script of a word (by Unicode ranges) narrows the languages it may be in, to those that were seen in that script. Each
word gets a score per language from hashed character n-grams, and the Viterbi path over a text's words, with a penalty for
each switch, labels its spans. A text's language is the one whose spans hold the most letters; its score is their share.

The n-gram tables are counted on a bounded sample of labelled documents (SAMPLE rows). Words are runs of letters. Null texts
and texts without letters are `und` with score 0, as are all texts if nothing could be learned. Ties go to the language that
comes first by name. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quaverlake.llm.common import as_text, bounded_sample, crc_fold, cut, schema_of, struct_of, table

#: Labelled documents that n-grams are counted on, about (twice that at most).
SAMPLE = 6_000
#: Buckets of the hashed n-grams (pairs and triples of characters, a word's edges included).
BUCKETS = 1 << 15
#: What a switch of language between two words costs, in log-likelihood; what a language outside a word's script costs.
SWITCH, WRONG_SCRIPT = 6.0, 40.0
#: Share of a script's letters that a language must have in the sample to be a candidate for it.
LEAST_SHARE = 0.005
#: Words that are scored and labelled together.
BLOCK = 1 << 20
#: First code points of script ranges and the script that starts there (0: other). Fixed values, by Unicode's blocks.
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7),
    (0x0980, 8), (0x0E00, 9), (0x0E80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12),
    (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD800, 0), (0xF900, 13), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0),
]
SCRIPTS = 14
STARTS, SCRIPT_OF = (np.array(c) for c in zip(*RANGES, strict=True))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code point positions of words' starts and ends, and for each letter the buckets of its pair and triple."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = letters()[cp] if len(cp) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    if not len(edge):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    lower = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = lower if len(lower) == len(cp) else cp
    inside = np.zeros(len(cp) + 2, np.uint64)
    inside[1:-1] = np.where(mask, cp, 0)
    at = np.flatnonzero(mask) + 1
    with np.errstate(over="ignore"):
        pair = inside[at] * np.uint64(0x9E3779B1) + inside[at + 1] * np.uint64(0x85EBCA77)
        triple = pair * np.uint64(0xC2B2AE3D27D4EB4F) + inside[at - 1] * np.uint64(0x165667B19E3779F9) + np.uint64(77)
        both = [((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % BUCKETS for h in (pair, triple)]
    return edge[0::2], edge[1::2], both[0], both[1]


def scripts_of(text: str, starts: np.ndarray) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return SCRIPT_OF[np.searchsorted(STARTS, cp[starts], side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    #: log probability of pair and triple buckets: (2, BUCKETS, languages).
    table: np.ndarray
    #: what a language costs in a script: (scripts, languages).
    cost: np.ndarray


def fit(docs: DataFrame, train: Column, rows: int = SAMPLE) -> Model:
    """Count n-grams and scripts by language on a bounded sample of the rows for which `train` holds."""
    sample = bounded_sample(docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text"), rows, "doc_id")
    schema = "lang string, kind int, bucket int, n bigint"
    arrow = schema_of(docs.sparkSession, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start, _, pair, triple = words_of(text)
                own = sums.setdefault(lang, np.zeros(2 * BUCKETS + SCRIPTS, np.int64))
                own[:BUCKETS] += np.bincount(pair, minlength=BUCKETS)
                own[BUCKETS : 2 * BUCKETS] += np.bincount(triple, minlength=BUCKETS)
                if len(start):
                    own[2 * BUCKETS :] += np.bincount(scripts_of(text, start), minlength=SCRIPTS)
            for lang, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(own[at])], schema=arrow)

    found = sample.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    grams, seen = np.zeros((2, BUCKETS, len(languages))), np.zeros((SCRIPTS, len(languages)))
    for r in found:
        if r.kind < 2:
            grams[r.kind, r.bucket, place[r.lang]] = r.n
        else:
            seen[r.bucket, place[r.lang]] = r.n
    grams = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) if languages else grams
    share = seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    narrow = (share < LEAST_SHARE) & (seen.sum(axis=1, keepdims=True) > 0)
    return Model(languages, grams.astype(np.float32), np.where(narrow, -WRONG_SCRIPT, 0.0).astype(np.float32))


def viterbi(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best path of each text: scores of all texts' words one after the other, sizes by text.

    Texts step on together, longest first, so that one numpy step serves all that still have words.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    back = np.zeros(scores.shape, np.uint8 if scores.shape[1] < 256 else np.int32)
    value = scores[first[: active[0]]].copy() if len(active) else None
    own = np.arange(scores.shape[1], dtype=back.dtype)
    for t in range(1, len(active)):
        n = active[t]
        at = first[:n] + t
        best = value[:n].argmax(axis=1).astype(back.dtype)
        jump = value[np.arange(n), best][:, None] - SWITCH
        stay = value[:n] >= jump
        back[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, value[:n], jump) + scores[at]
    path = np.zeros(len(scores), np.int64)
    if not len(active):
        return path
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return path


def label_block(texts: list[tuple], model: Model) -> list[tuple]:
    """(language, score, spans) of each text's (starts, ends, pairs, triples, scripts)."""
    sizes = np.array([len(t[0]) for t in texts])
    scores = []
    for start, end, pair, triple, script in texts:
        if len(start):
            by_letter = model.table[0][pair] + model.table[1][triple]
            first = np.cumsum(end - start) - (end - start)
            scores.append(np.add.reduceat(by_letter, first, axis=0) + model.cost[script])
    path = viterbi(np.concatenate(scores), sizes) if scores else np.zeros(0, np.int64)
    out, at = [], 0
    for start, end, *_ in texts:
        own = path[at : at + len(start)]
        at += len(start)
        if not len(own):
            out.append(("und", 0.0, []))
            continue
        share = np.bincount(own, end - start, minlength=len(model.languages))
        cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
        spans = [{"start": int(start[a]), "end": int(end[b - 1]), "lang": model.languages[own[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)]
        best = int(share.argmax())
        out.append((model.languages[best], float(share[best] / share.sum()), spans))
    return out


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns, lang_pred, score and spans: array<struct<start, end, lang>> in code points."""
    made = "lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>"
    fields = schema_of(docs.sparkSession, made)
    kept = [c for c in carry if c not in fields.names]
    out = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)] + [StructField(f"n{i}", f.dataType) for i, f in enumerate(struct_of(made).fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            rows, waiting, held = [], [], 0
            for text in map(as_text, batch.column(batch.num_columns - 1).to_pylist()):
                words = words_of(text) if model.languages else (np.zeros(0, np.int64),) * 4
                waiting.append((*words, scripts_of(text, words[0])))
                held += len(words[0])
                if held >= BLOCK:
                    rows += label_block(waiting, model)
                    waiting, held = [], 0
            rows += label_block(waiting, model) if waiting else []
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[f.name for f in out.fields])

    inner = docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)), docs["text"].alias("t"))
    return inner.mapInArrow(run, out).toDF(*kept, *fields.names)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False))
    model = fit(docs, ~held_out)
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
