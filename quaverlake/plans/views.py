"""Note, logit and token views over the driver's tables, and the same views as SQL.

notes: user_id is the piece, event_id % 4 the voice, and within a voice notes follow each other by time without gaps.
shifted notes: starts moved by 480 * (event_id % 3), which makes gaps and overlaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import DURATIONS, lits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    """piece_id, voice, note_idx, start, dur, pitch, event_id; one shuffle, by piece and voice."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("piece_id"), (F.col("event_id") % 4).cast("int").alias("voice"), F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("int").alias("k"))
    e = e.withColumn("pitch", 36 + F.col("k") % 49).withColumn("dur", F.element_at(lits(DURATIONS), (F.col("event_id") % 11 + 1).cast("int")))
    w = W.partitionBy("piece_id", "voice").orderBy("ts", "event_id")
    start = F.coalesce(F.sum("dur").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = e.select("piece_id", "voice", (F.row_number().over(w) - 1).alias("note_idx"), start.alias("start"), "dur", "pitch", "event_id")
    return n.withColumn("start", F.col("start") + 480 * (F.col("event_id") % 3)) if shifted else n


def key_root(piece: str = "piece_id"):
    return (F.col(piece) % 12).cast("int")


def key_mode(piece: str = "piece_id"):
    return F.when(F.col(piece) % 2 == 0, "major").otherwise("minor")


def logits(spark: SparkSession, sf_dir: str, factor: float = 20.0) -> DataFrame:
    """ctx_id, token_id, logit: the components of each vector, scaled."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ctx_id"), F.posexplode("embedding").alias("token_id", "v")).select("ctx_id", "token_id", F.round(F.col("v").cast("double") * factor, 6).alias("logit"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece_id, turn, pos (from 0), token: the words of each turn of a conversation."""
    return split_turns(table(spark, sf_dir, "conversations"))


def split_turns(turns: DataFrame) -> DataFrame:
    c = turns.select(F.col("conv_id").alias("piece_id"), "turn", F.split(F.lower("text"), " ").alias("words"))
    return c.select("piece_id", "turn", F.posexplode("words").alias("pos", "token"))


#: The same views for DuckDB, as common table expressions.
NOTES_SQL = """n0 AS (SELECT event_id, ts, user_id AS piece_id, CAST(event_id % 4 AS INT) AS voice,
  36 + CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT) % 49 AS pitch,
  ([60,120,180,240,360,480,720,960,1440,1920,2880])[CAST(event_id % 11 AS INT) + 1] AS dur FROM events),
n AS (SELECT piece_id, voice, CAST(row_number() OVER w - 1 AS BIGINT) AS note_idx, pitch, dur, event_id,
  CAST(coalesce(sum(dur) OVER (PARTITION BY piece_id, voice ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM n0 WINDOW w AS (PARTITION BY piece_id, voice ORDER BY ts, event_id)),
n2 AS (SELECT piece_id, voice, note_idx, pitch, dur, event_id, start + 480 * (event_id % 3) AS start FROM n),
pc AS (SELECT DISTINCT user_id AS piece_id, CAST(user_id % 12 AS INT) AS key_root, CASE WHEN user_id % 2 = 0 THEN 'major' ELSE 'minor' END AS key_mode FROM events)"""
LOGITS_SQL = """g AS (SELECT vec_id AS ctx_id, CAST(i AS INT) AS token_id, round(CAST(embedding[i + 1] AS DOUBLE) * 20.0, 6) AS logit FROM embeddings, range(64) r(i) WHERE i < len(embedding))"""
TOKENS_SQL = """s0 AS (SELECT conv_id AS piece_id, turn, string_split(lower(text), ' ') AS words FROM conversations),
t AS (SELECT piece_id, turn, CAST(i AS INT) AS pos, words[i + 1] AS token FROM (SELECT piece_id, turn, words, unnest(range(len(words))) AS i FROM s0))"""
