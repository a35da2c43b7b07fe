"""Counts and windows over notes, tokens and orders: spans, bars, phrases, rings, frequency tables and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import length_bucket
from quaverlake.operators.histograms import class_counts, key_of, keys_sql
from quaverlake.plans.views import NOTES_SQL, TOKENS_SQL, notes, table, tokens


def measure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of four quarters of each piece, and the bucket that they fall in."""
    bars = notes(spark, sf_dir).groupBy("piece_id").agg(F.ceil(F.max(F.col("start") + F.col("dur")) / 1920).cast("long").alias("bars"))
    return bars.withColumn("bucket", length_bucket(F.col("bars")))


def voice_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = notes(spark, sf_dir).groupBy("piece_id", "voice").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("piece_id").agg(F.round(F.min("c") / F.max("c"), 9).alias("balance"))


def notes_per_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).groupBy("piece_id", "voice").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("start") + F.col("dur")).alias("e"))
    return n.select("piece_id", "voice", F.round(F.col("c") / F.greatest(F.lit(1), F.ceil(F.col("e") / 1920)), 9).alias("density"))


def valid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces in which every voice spans 16 quarters."""
    v = notes(spark, sf_dir).groupBy("piece_id", "voice").agg((F.max(F.col("start") + F.col("dur")) - F.min("start")).alias("span"))
    return v.groupBy("piece_id").agg(F.bool_and(F.col("span") >= 16 * 480).alias("valid"), F.min("span").cast("long").alias("shortest"))


def melody_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of voice 0 that long notes end; each starts where the one before ended."""
    n = notes(spark, sf_dir).filter("voice = 0")
    first = n.groupBy("piece_id").agg(F.min("start").alias("first"))
    w = W.partitionBy("piece_id").orderBy("start")
    ends = n.filter("dur >= 720").withColumn("end", F.col("start") + F.col("dur")).withColumn("prev", F.lag("end").over(w))
    return ends.join(first, "piece_id").select("piece_id", F.col("end").cast("long").alias("end_tick"), (F.col("end") - F.coalesce("prev", "first")).cast("long").alias("length"))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the lowest voice after which a phrase may end: long ones, or with a rest of a quarter behind."""
    w = W.partitionBy("piece_id").orderBy("start", "note_idx")
    b = notes(spark, sf_dir, shifted=True).filter("voice = 3").withColumn("gap", F.lead("start").over(w) - F.col("start") - F.col("dur"))
    return b.filter("gap is not null").groupBy("piece_id").agg(F.count_if((F.col("dur") >= 960) | (F.col("gap") >= 480)).alias("points"), F.count_if(F.col("gap") >= 480).alias("rests"))


def key_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by detected key, with their share."""
    keys = key_of(class_counts(notes(spark, sf_dir), ["piece_id"]), ["piece_id"]).groupBy("key_root", "key_mode").agg(F.count(F.lit(1)).alias("pieces"))
    return keys.withColumn("percent", F.round(100 * F.col("pieces") / F.sum("pieces").over(W.partitionBy(F.lit(1))), 6))  # at most 24 rows


def token_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 32 tokens at each place of a conversation."""
    w = W.partitionBy("piece_id").orderBy("turn", "pos").rowsBetween(-31, 0)
    return tokens(spark, sf_dir).select("piece_id", "turn", "pos", F.array_join(F.collect_list("token").over(w), " ").alias("ring"))


def repeated_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where the last three tokens equal the three before, by conversation."""
    w = W.partitionBy("piece_id").orderBy("turn", "pos")
    t = tokens(spark, sf_dir)
    same = (F.col("token") == F.lag("token", 3).over(w)) & (F.lag("token", 1).over(w) == F.lag("token", 4).over(w)) & (F.lag("token", 2).over(w) == F.lag("token", 5).over(w))
    return t.withColumn("same", same).groupBy("piece_id").agg(F.count_if("same").alias("repeats"), F.count(F.lit(1)).alias("tokens"))


def shifted_pairs(spark: SparkSession, sf_dir: str, length: int = 24) -> DataFrame:
    """Inputs and labels of each turn, in crops of `length` tokens, the last one padded: without the last token and without the first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("words"))
    crops = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / length).cast("int")), lambda i: F.slice("words", i * length + 1, F.lit(length)))
    full = c.select("conv_id", "turn", F.posexplode(crops).alias("crop", "w"))
    full = full.withColumn("w", F.concat("w", F.array_repeat(F.lit("<pad>"), F.lit(length) - F.size("w"))))
    return full.select("conv_id", "turn", "crop", F.array_join(F.slice("w", 1, length - 1), " ").alias("inputs"), F.array_join(F.slice("w", 2, length - 1), " ").alias("labels"))


def token_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of at least 20 tokens that hold a given token."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    return c.filter((F.size("w") >= 20) & F.array_contains("w", "the")).select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"))


def conditioning_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without one kind of token, and with the first of another kind only: dropout with probability one."""
    t = tokens(spark, sf_dir)
    w = W.partitionBy("piece_id", "turn", "token").orderBy("pos")
    kept = t.withColumn("k", F.row_number().over(w)).filter("token <> 'of' and (token <> 'the' or k = 1)")
    return kept.groupBy("piece_id", "turn").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("token") == "the").alias("marks"))


def frequency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment and priority, by segment, and in all."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def fold_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best variant of each text (in lower case, white space aside): by a priority of sources, then by doc_id, under a collision-safe name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.lower(F.regexp_replace("text", "[ \\t\\r\\n]+", "")), 256).alias("head"))
    prio = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src0", 1).otherwise(2)
    best = d.groupBy("head").agg(F.min(F.struct(prio.alias("p"), "doc_id", "source")).alias("b"))
    return best.select("b.doc_id", F.concat_ws("__", "b.source", F.col("b.doc_id").cast("string")).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (measure_counts, voice_balance, notes_per_measure, valid_groups, melody_phrases, boundaries, key_frequencies, token_ring, repeated_patterns, shifted_pairs, token_subset, conditioning_dropout, frequency_rollup, fold_variants)
}
SQL = {
    "measure_counts": f"WITH {NOTES_SQL}, b AS (SELECT piece_id, CAST(ceil(max(start + dur) / 1920.0) AS BIGINT) AS bars FROM n GROUP BY 1) SELECT piece_id, bars, CASE WHEN bars <= 16 THEN 'short' WHEN bars <= 32 THEN 'medium' WHEN bars <= 64 THEN 'long' ELSE 'extended' END AS bucket FROM b",
    "voice_balance": f"WITH {NOTES_SQL} SELECT piece_id, round(min(c) * 1.0 / max(c), 9) AS balance FROM (SELECT piece_id, voice, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1",
    "notes_per_measure": f"WITH {NOTES_SQL} SELECT piece_id, voice, round(count(*) / greatest(1, ceil(max(start + dur) / 1920.0)), 9) AS density FROM n GROUP BY 1, 2",
    "valid_groups": f"WITH {NOTES_SQL} SELECT piece_id, bool_and(span >= 7680) AS valid, CAST(min(span) AS BIGINT) AS shortest FROM (SELECT piece_id, voice, max(start + dur) - min(start) AS span FROM n GROUP BY 1, 2) GROUP BY 1",
    "melody_phrases": f"WITH {NOTES_SQL}, v AS (SELECT *, min(start) OVER (PARTITION BY piece_id) AS first FROM n WHERE voice = 0) SELECT piece_id, start + dur AS end_tick, start + dur - coalesce(lag(start + dur) OVER (PARTITION BY piece_id ORDER BY start), first) AS length FROM v WHERE dur >= 720",
    "boundaries": f"WITH {NOTES_SQL}, b AS (SELECT *, lead(start) OVER (PARTITION BY piece_id ORDER BY start, note_idx) - start - dur AS gap FROM n2 WHERE voice = 3) SELECT piece_id, count(*) FILTER (dur >= 960 OR gap >= 480) AS points, count(*) FILTER (gap >= 480) AS rests FROM b WHERE gap IS NOT NULL GROUP BY 1",
    "key_frequencies": f"WITH {NOTES_SQL}, k AS (WITH {keys_sql('n', 'piece_id')}), c AS (SELECT key_root, key_mode, count(*) AS pieces FROM k GROUP BY 1, 2) SELECT *, round(100 * pieces / sum(pieces) OVER (), 6) AS percent FROM c",
    "token_ring": f"WITH {TOKENS_SQL} SELECT piece_id, turn, pos, array_to_string(list(token) OVER (PARTITION BY piece_id ORDER BY turn, pos ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), ' ') AS ring FROM t",
    "repeated_patterns": f"WITH {TOKENS_SQL}, q AS (SELECT piece_id, token = lag(token, 3) OVER w AND lag(token, 1) OVER w = lag(token, 4) OVER w AND lag(token, 2) OVER w = lag(token, 5) OVER w AS same FROM t WINDOW w AS (PARTITION BY piece_id ORDER BY turn, pos)) SELECT piece_id, count(*) FILTER (same) AS repeats, count(*) AS tokens FROM q GROUP BY 1",
    "shifted_pairs": "WITH s AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations), k AS (SELECT *, unnest(range((len(w) + 23) // 24)) AS i FROM s), c AS (SELECT conv_id, turn, CAST(i AS INT) AS crop, list_resize(w[i * 24 + 1:i * 24 + 24], 24, '<pad>') AS w FROM k) SELECT conv_id, turn, crop, array_to_string(w[1:23], ' ') AS inputs, array_to_string(w[2:24], ' ') AS labels FROM c",
    "token_subset": "SELECT conv_id, turn, len(w) AS n_tokens FROM (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations) WHERE len(w) >= 20 AND list_contains(w, 'the')",
    "conditioning_dropout": f"WITH {TOKENS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY piece_id, turn, token ORDER BY pos) AS k FROM t) SELECT piece_id, turn, count(*) AS kept, count(*) FILTER (token = 'the') AS marks FROM k WHERE token <> 'of' AND (token <> 'the' OR k = 1) GROUP BY 1, 2",
    "frequency_rollup": "SELECT c_mktsegment, o_orderpriority, count(*) AS orders, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)",
    "fold_variants": "SELECT doc_id, source || '__' || doc_id AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lower(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g')) ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END, doc_id) AS r FROM documents) WHERE r = 1",
}
