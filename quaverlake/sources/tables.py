"""Writers and readers of prepared data: sequences, statistics, calibration and run tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCES = "seq_id bigint, piece_id string, tokens array<int>"
STATISTICS = "dist string, bin int, p double"
CALIBRATION = "perplexity array<double>, entropy array<double>"


def write_sequences(df: DataFrame, path: str) -> None:
    df.select("seq_id", "piece_id", "tokens").write.mode("errorifexists").json(path)


def read_sequences(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Sequences of at least `least` tokens; ids stay with their tokens."""
    return spark.read.schema(SEQUENCES).json(path).filter(F.size("tokens") >= least)


def read_statistics(spark: SparkSession, path: str | None, bins: dict[str, int]) -> DataFrame:
    """Corpus statistics, with equal shares for a distribution that the file lacks."""
    even = spark.createDataFrame([(d, b, 1.0 / n) for d, n in bins.items() for b in range(n)], STATISTICS)
    if path is None:
        return even
    known = spark.read.schema(STATISTICS).json(path)
    return known.unionByName(even.join(known.select("dist").distinct(), "dist", "left_anti"))


def parse_calibration(text: str):
    """Ranges from a JSON text, null if a range isn't two ascending numbers."""
    c = F.from_json(text, CALIBRATION)
    good = lambda x: (F.size(x) == 2) & (F.get(x, F.lit(0)) < F.get(x, F.lit(1)))
    return F.when(good(c["perplexity"]) & good(c["entropy"]), c)


def write_runs(parts: list[DataFrame], path: str) -> None:
    """Run tables of different columns as one CSV table whose header is the union of theirs, in first-seen order."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole.write.mode("errorifexists").option("header", True).csv(path)


def read_form_weights(spark: SparkSession, path: str | None) -> DataFrame:
    """form, dimension, weight of a JSON file whose `weights_by_form` holds weights by form and dimension; no rows without a file."""
    none = spark.createDataFrame([], "form string, dimension string, weight double")
    if path is None:
        return none
    text = spark.read.text(path, wholetext=True)
    known = text.select(F.from_json("value", "weights_by_form map<string, map<string, double>>").alias("j"))
    return known.select(F.explode("j.weights_by_form").alias("form", "w")).select("form", F.explode("w").alias("dimension", "weight")).filter("weight IS NOT NULL")


def weights_for(weights: DataFrame, defaults: dict[str, float], form: str) -> dict[str, float]:
    """The weights of a form, or the defaults where the table has none for it."""
    return {r.dimension: r.weight for r in weights.filter(F.col("form") == form).collect()} or defaults


def write_report(df: DataFrame, path: str) -> None:
    """Rows as CSV under the names of their columns."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def collect_files(spark: SparkSession, patterns: list[str], explicit: list[str] = (), suffixes: tuple[str, ...] = ("mid", "midi")) -> DataFrame:
    """The paths that patterns match and those that are named, each once, of the suffixes (in either case), in order."""
    found = [spark.read.format("binaryFile").load(p).select("path") for p in patterns] + ([spark.createDataFrame([(p,) for p in explicit], "path string")] if explicit else [])
    every = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "path string")
    plain = every.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return plain.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).distinct().orderBy("path")
