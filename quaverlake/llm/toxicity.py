"""Operator 5: toxicity by weak supervision.

Voters look at a text and vote toxic (1), clean (-1) or nothing (0): one for each entry of a lexicon (words
and word beginnings that a bounded labelled sample shows mostly in toxic texts, and a short list) and some for patterns. A generative label model estimates, by
expectation maximisation on votes of a bounded sample, each voter's class-conditional rates, and from what remains of the
votes' covariance how far voters repeat each other; a voter counts the less the more it is repeated. A linear classifier is
then trained on the posterior labels and scores every whole text.

Null and empty texts get the score of a text on which no lexicon voter votes. Without labels the short list stands alone.
Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import as_text, bounded_sample, crc_fold, cut, schema_of, table, with_text_columns

#: Labelled documents that words and the prior are learned on, and documents whose votes are modelled; twice that at most.
SAMPLE, UNLABELLED = 10_000, 10_000
#: The lexicon's size is bounded: what stands in fewer toxic documents than SUPPORT, or is less likely in them than LIFT asks, or comes after the
#: MINED best, has no voter of its own; texts are scored whole by the voters that there are.
#: Mined entries at most, the toxic documents one must stand in, and by how much (natural log) it must be likelier in toxic ones.
MINED, SUPPORT, LIFT = 60, 8, 2.5
#: Entries that may be counted: those of the most toxic documents.
COUNTED = 20_000
#: Lengths of word beginnings; they end in a star, whole words don't.
BEGINNINGS = (4, 5, 6, 7)
SEEDS = ["idiot", "stupid", "moron", "loser", "worthless", "pathetic", "disgusting", "trash", "scum", "imbecile"]
YOU = {"you", "your", "du", "tu"}
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ["two_hits", "three_hits", "one_in_200", "one_in_100", "one_in_50", "insult_at_you", "shouting", "exclaiming", "no_hit", "calm"]


@dataclass
class Model:
    lexicon: list[str]
    weights: np.ndarray
    bias: float


def entries(words: set[str]) -> set[str]:
    """All entries that a text's words may match."""
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


def votes(text: str | None, place: dict[str, int]) -> np.ndarray:
    """One vote for each entry of the lexicon, then one for each pattern."""
    text = as_text(text)
    words = WORD.findall(text.lower())
    out = np.zeros(len(place) + len(PATTERNS), np.int8)
    hit = set()
    for w in set(words):
        for e in (w, *(w[:n] + "*" for n in BEGINNINGS)):
            if e in place:
                out[place[e]] = 1
                hit.add(w)
    n = sum(w in hit for w in words) if hit else 0
    upper = sum(map(str.isupper, text)) / max(1, len(text))
    at_you = bool(hit) and any((a in YOU and b in hit) or (b in YOU and a in hit) for a, b in zip(words, words[1:], strict=False))
    rate = n / max(1, len(words))
    out[len(place) :] = (n >= 2, n >= 3, rate > 0.005, rate > 0.01, rate > 0.02, at_you, upper > 0.5, text.count("!") > 0.1 * len(words) + 3, -int(not hit), -int(upper < 0.1 and "!" not in text))
    return out


def mine(labelled: DataFrame) -> list[str]:
    """Entries that stand mostly in toxic texts of the labelled sample; of entries that extend each other, the best one."""
    schema = "entry string, toxic bigint, clean bigint"
    arrow = schema_of(labelled.sparkSession, schema)

    def counter(wanted: set[str] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut(batches):
                sums = {True: Counter(), False: Counter()}
                for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = entries(set(WORD.findall(as_text(text).lower())))
                    sums[toxic > 0].update(own if wanted is None else own & wanted)
                    sums[toxic > 0][""] += 1
                keys = list(sums[True].keys() | sums[False].keys())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([sums[k][w] for w in keys], pa.int64()) for k in (True, False))], schema=arrow)

        return count

    def counts(df: DataFrame, wanted: set[str] | None) -> DataFrame:
        return df.select("toxic", "text").mapInArrow(counter(wanted), schema).groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    often = counts(labelled.filter("toxic > 0"), None).filter((F.col("toxic") >= SUPPORT) & (F.col("entry") != ""))
    wanted = {r.entry for r in often.orderBy(F.desc("toxic"), "entry").limit(COUNTED).collect()}
    if not wanted:
        return []
    found = {r.entry: (r.toxic, r.clean) for r in counts(labelled, wanted).collect()}
    toxic, clean = found.pop("")
    lift = {e: np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)) for e, (t, c) in found.items()}
    chosen: list[str] = []
    for e in sorted((e for e in lift if lift[e] >= LIFT), key=lambda e: (-found[e][0] * lift[e], -len(e), e)):
        stem = e.rstrip("*")
        if len(chosen) < MINED and not any(stem.startswith(c.rstrip("*")) or c.startswith(stem) for c in chosen):
            chosen.append(e)
    return chosen


def label_model(v: np.ndarray, prior: float, rounds: int = 25) -> np.ndarray:
    """Posterior of toxic for each row of votes: EM over class-conditional vote rates, correlated voters sharing their weight."""
    kinds = np.stack([v == k for k in (-1, 0, 1)]).astype(float)
    repeat = np.ones(v.shape[1])
    p = np.clip(0.5 + 0.45 * np.sign(v.astype(float).clip(0).sum(axis=1) - 0.5), 0.02, 0.98)
    for step in range(rounds):
        rates = []
        for q in (p, 1 - p):
            r = np.einsum("kij,i->kj", kinds, q) + 0.5
            rates.append(r / r.sum(axis=0))
        gain = np.log(rates[0]) - np.log(rates[1])
        logit = np.log(prior / (1 - prior)) + np.einsum("kij,kj->i", kinds, gain / repeat)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if step == rounds // 2:
            expected = p[:, None] * (rates[0][2] - rates[0][0]) + (1 - p)[:, None] * (rates[1][2] - rates[1][0])
            rest = v - expected
            norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            repeat = (np.abs(rest.T @ rest) / norm[:, None] / norm[None, :]).clip(0, 1)
            np.fill_diagonal(repeat, 1.0)
            repeat = np.where(repeat > 0.2, repeat, 0).sum(axis=1)
    return p


def linear(v: np.ndarray, p: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton's method."""
    x = np.column_stack([v.astype(float), np.ones(len(v))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge * len(v)), 1e-6)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (s * (1 - s))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, x.T @ (s - p) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: the rows that may be learned from. Both samples are bounded; their ids are broadcast."""
    known = bounded_sample(labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic"), SAMPLE, "doc_id")
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    mined = mine(labelled)
    lexicon = list(dict.fromkeys([*mined, *SEEDS]))
    place = {w: i for i, w in enumerate(lexicon)}
    read = lambda df, carry: with_text_columns(df, lambda t: (votes(t, place).tobytes(),), "votes binary", carry=carry).collect()
    seen = read(labelled.limit(4 * SAMPLE), ["toxic"])
    other = read(bounded_sample(docs.select("doc_id", "text"), UNLABELLED, "doc_id"), [])
    prior = (sum(r.toxic > 0 for r in seen) + 1) / (len(seen) + 20)
    v = np.array([np.frombuffer(r.votes, np.int8) for r in [*seen, *other]]).reshape(-1, len(lexicon) + len(PATTERNS))
    if not len(v):
        v = np.zeros((1, len(lexicon) + len(PATTERNS)), np.int8)
    weights, bias = linear(v, label_model(v, prior))
    return Model(lexicon, weights, bias)


def toxicity(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns, score and predicted of every text."""
    place = {w: i for i, w in enumerate(model.lexicon)}

    def scored(rows: list[tuple]) -> list[tuple]:
        v = np.array([np.frombuffer(r[0], np.int8) for r in rows])
        s = 1 / (1 + np.exp(-np.clip(v @ model.weights + model.bias, -30, 30)))
        return [(float(x), int(x >= 0.5)) for x in s]

    return with_text_columns(docs, lambda t: (votes(t, place).tobytes(),), "score double, predicted int", carry=carry, after=scored)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")
