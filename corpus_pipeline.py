"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, PII, packing, each on what the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; where a text changes, n_chars
follows it. A document whose lines all went by line dedup stays, with an empty text. Null and empty texts fail the quality rules.
Extra columns are carried through all stages but the last, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm import jaccard, linededup, packing, pii, quality
from quaverlake.llm.common import materialize, table


def counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def columns(docs: DataFrame) -> list[str]:
    """The names of all columns, quoted, for they may hold dots."""
    return [f"`{c}`" for c in docs.columns]


def free(docs: DataFrame, prefix: str) -> str:
    """The prefix, made longer until no column begins with it."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own = free(docs, "_q_")
    return quality.quality(docs, model, docs.columns, prefix=own).filter(F.col(f"{own}kept")).select(*columns(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from all places but the first."""
    own = free(docs, "_l_")
    done = linededup.line_dedup(docs, docs.columns, prefix=own)
    return counted(done.withColumn("text", F.col(f"{own}text")).select(*columns(docs)))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return counted(pii.redact(docs, pii.fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard", jaccard_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trees, winnowing and packing can't be put in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
