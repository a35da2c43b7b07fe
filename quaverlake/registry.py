"""All registered queries of the note and token operators, with the SQL that DuckDB must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaverlake.operators import constraints, corpus, decoder, encoding, generation, histograms, joins, labels, measures, ranking, runs, sampling, scoring, sequences, subjects, upkeep, voices
from quaverlake.sources import catalogue, kern, midi

MODULES = (labels, joins, histograms, scoring, sampling, sequences, corpus, runs, measures, ranking, subjects, constraints, encoding, voices, decoder, generation, upkeep, catalogue, kern, midi)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
