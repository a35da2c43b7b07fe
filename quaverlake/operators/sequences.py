"""Token sequences: entropy, diversity, chunks, weights, splits, prefixes and running states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import in_range_score
from quaverlake.plans.views import TOKENS_SQL, split_turns, table, tokens

CHUNK, STRIDE, PREFIX = 16, 12, 2
#: Characters of text whose tokens one task sorts and counts.
TASK_CHARS = 8 << 20


def tokens_by_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all turns, which are shuffled whole, by piece, before they are split.

    There are as many tasks as the text needs, so that a task's memory doesn't grow with the input: a token takes ten times
    as much there as in a shuffled turn, by whose bytes tasks would be put together otherwise.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chars = turns.agg(F.sum(F.length("text"))).first()[0] or 0
    return split_turns(turns.repartition(max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "conv_id"))


def unigrams(t: DataFrame) -> DataFrame:
    return t.groupBy("piece_id", "token").agg(F.count(F.lit(1)).alias("c"))


def bigrams(t: DataFrame) -> DataFrame:
    w = W.partitionBy("piece_id").orderBy("turn", "pos")
    return t.withColumn("next", F.lead("token").over(w)).filter("next is not null").groupBy("piece_id", "token", "next").agg(F.count(F.lit(1)).alias("c2"))


def token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy(tokens_by_piece(spark, sf_dir))


def entropy(t: DataFrame) -> DataFrame:
    u = unigrams(t)
    p = F.col("c") / F.sum("c").over(W.partitionBy("piece_id"))
    return u.withColumn("p", p).groupBy("piece_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def bigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp of minus the mean, over distinct bigrams, of ln(count of the bigram / bigrams that begin with its first token)."""
    return perplexity(tokens_by_piece(spark, sf_dir))


def perplexity(t: DataFrame) -> DataFrame:
    b = bigrams(t).withColumn("c", F.sum("c2").over(W.partitionBy("piece_id", "token")))
    return b.groupBy("piece_id").agg(F.round(F.exp(-F.avg(F.log(F.col("c2") / F.col("c") + 1e-10))), 6).alias("perplexity"))


def token_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of distinct tokens and bigrams and of repeats, and the weighted sum of a piecewise linear score of each."""
    return diversity(tokens_by_piece(spark, sf_dir))


def diversity(t: DataFrame) -> DataFrame:
    w = W.partitionBy("piece_id").orderBy("turn", "pos")
    n = t.withColumn("same", F.when(F.lag("token").over(w) == F.col("token"), 1).otherwise(0)).groupBy("piece_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("token").alias("u"), F.sum("same").alias("r"))
    b = bigrams(t).groupBy("piece_id").agg(F.count(F.lit(1)).alias("b"))
    x = n.join(b, "piece_id").filter("n > 1").select("piece_id", "n", (F.col("u") / F.col("n")).alias("unique_ratio"), (F.col("b") / (F.col("n") - 1)).alias("bigram_ratio"), (F.col("r") / (F.col("n") - 1)).alias("repeat_ratio"))
    u, g, r = F.col("unique_ratio"), F.col("bigram_ratio"), F.col("repeat_ratio")
    unique = F.when(u < 0.05, 0.1).when(u < 0.10, 0.1 + (u - 0.05) * 8.0).when(u <= 0.50, 0.5 + F.least(F.lit(0.5), (u - 0.10) * 1.25)).otherwise(F.greatest(F.lit(0.3), 1.0 - (u - 0.50) * 2))
    varied = F.when(g < 0.15, g * 4).when(g <= 0.7, 0.6 + (g - 0.15) * 0.73).when(g <= 0.9, 1.0).otherwise(F.greatest(F.lit(0.5), 1.0 - (g - 0.9) * 5))
    steady = F.when(r < 0.1, 1.0).when(r < 0.3, 1.0 - (r - 0.1) * 2.5).otherwise(F.greatest(F.lit(0.1), 0.5 - (r - 0.3)))
    score = 0.35 * unique + 0.35 * varied + 0.30 * steady
    return x.select("piece_id", *(F.round(c, 9).alias(c) for c in ("unique_ratio", "bigram_ratio", "repeat_ratio")), F.round(F.when(F.col("n") < 10, 0.5).otherwise(score), 6).alias("diversity"))


def prefix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens up to and with the first that ends a sentence, 0 if there is none, for each turn."""
    t = tokens(spark, sf_dir)
    return t.groupBy("piece_id", "turn").agg(F.coalesce(F.min(F.when(F.col("token").endswith("."), F.col("pos") + 1)), F.lit(0)).alias("prefix_len"))


def chunks(seq: DataFrame, size: int = CHUNK, stride: int = STRIDE, prefix: int = PREFIX) -> DataFrame:
    """chunk_idx and chunk: windows over what follows the prefix, each behind the prefix; short sequences are one chunk."""
    body = F.slice("words", prefix + 1, F.greatest(F.size("words"), F.lit(1)))
    room, step = size - prefix, stride - prefix
    starts = F.when(F.size("words") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size("words") - prefix - room + step - 1, F.lit(0)), F.lit(step)))
    cut = F.transform(starts, lambda s: F.when(F.size("words") <= size, F.col("words")).otherwise(F.concat(F.slice("words", 1, prefix), F.slice(body, s + 1, room))))
    return seq.select(*[c for c in seq.columns if c != "words"], F.posexplode(cut).alias("chunk_idx", "chunk"))


def chunk_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("piece_id"), "turn", F.split(F.lower("text"), " ").alias("words"))
    return chunks(c).select("piece_id", "turn", "chunk_idx", F.size("chunk").alias("n_tokens"), F.array_join("chunk", " ").alias("chunk"))


def piece_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each chunk (turn) by the number of its piece's chunks: 1, 1/sqrt(n), 1/n."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("piece_id"), "turn")
    n = F.count(F.lit(1)).over(W.partitionBy("piece_id"))
    return c.select("piece_id", "turn", F.lit(1.0).alias("uniform"), F.round(1 / F.sqrt(n), 9).alias("sqrt"), F.round(1 / n, 9).alias("inverse"))


def split_hash(piece: Column) -> Column:
    """An integer hash that any engine can repeat."""
    return F.pmod(piece * F.lit(2654435761) + F.lit(12345), F.lit(1000))


def piece_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by split: a piece is wholly in one split, so nothing leaks."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("piece_id"), "turn")
    return c.withColumn("split", F.when(split_hash(F.col("piece_id")) < 100, "val").otherwise("train")).groupBy("split").agg(F.countDistinct("piece_id").alias("pieces"), F.count(F.lit(1)).alias("turns"))


def running_voice_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn: the role that spoke last before it, and the turns of the current run of that role."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("piece_id"), "turn", "role")
    w = W.partitionBy("piece_id").orderBy("turn")
    s = c.withColumn("before", F.lag("role").over(w)).withColumn("run", F.sum(F.when(F.col("role") == F.col("before"), 0).otherwise(1)).over(w))
    return s.select("piece_id", "turn", "before", "run", F.row_number().over(W.partitionBy("piece_id", "run").orderBy("turn")).alias("in_run"))


def weighted_sample(spark: SparkSession, sf_dir: str, k: int = 50, seed: int = 7) -> DataFrame:
    """k turns, drawn without replacement with weights 1/sqrt(n): the smallest of -ln(u)/w, u hashed from the seed."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "piece_id", "turn"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return piece_weights(spark, sf_dir).withColumn("key", -F.log(u) / F.col("sqrt")).orderBy("key", "piece_id", "turn").limit(k).select("piece_id", "turn")


QUERIES = {f.__name__: f for f in (token_entropy, bigram_perplexity, token_diversity, prefix_length, chunk_sequences, piece_weights, piece_split_hash, running_voice_state, weighted_sample)}


def range_sql(v: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {v} BETWEEN {lo} AND {hi} THEN 1.0 WHEN {v} < {lo} THEN greatest(0.0, 1 - ({lo} - {v}) / {hi - lo}) ELSE greatest(0.0, 1 - ({v} - {hi}) / {2 * (hi - lo)}) END)"


BIGRAM_SQL = "bg AS (SELECT piece_id, token, nx, count(*) AS c2 FROM (SELECT *, lead(token) OVER (PARTITION BY piece_id ORDER BY turn, pos) AS nx FROM t) WHERE nx IS NOT NULL GROUP BY 1, 2, 3), un AS (SELECT piece_id, token, count(*) AS c FROM t GROUP BY 1, 2)"
DIVERSITY_SQL = """0.35 * (CASE WHEN unique_ratio < 0.05 THEN 0.1 WHEN unique_ratio < 0.10 THEN 8 * unique_ratio - 0.3 WHEN unique_ratio <= 0.50 THEN least(1.0, 0.375 + 1.25 * unique_ratio) ELSE greatest(0.3, 2 - 2 * unique_ratio) END)
 + 0.35 * (CASE WHEN bigram_ratio < 0.15 THEN 4 * bigram_ratio WHEN bigram_ratio <= 0.7 THEN 0.4905 + 0.73 * bigram_ratio WHEN bigram_ratio <= 0.9 THEN 1.0 ELSE greatest(0.5, 5.5 - 5 * bigram_ratio) END)
 + 0.30 * (CASE WHEN repeat_ratio < 0.1 THEN 1.0 WHEN repeat_ratio < 0.3 THEN 1.25 - 2.5 * repeat_ratio ELSE greatest(0.1, 0.8 - repeat_ratio) END)"""
SQL = {
    "token_entropy": f"WITH {TOKENS_SQL}, {BIGRAM_SQL}, p AS (SELECT piece_id, c * 1.0 / sum(c) OVER (PARTITION BY piece_id) AS p FROM un) SELECT piece_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1",
    "bigram_perplexity": f"WITH {TOKENS_SQL}, {BIGRAM_SQL} SELECT piece_id, round(exp(-avg(ln(c2 * 1.0 / c + 1e-10))), 6) AS perplexity FROM bg JOIN (SELECT piece_id, token, sum(c2) AS c FROM bg GROUP BY 1, 2) USING (piece_id, token) GROUP BY 1",
    "token_diversity": f"""WITH {TOKENS_SQL}, {BIGRAM_SQL}, n AS (SELECT piece_id, count(*) AS n, count(DISTINCT token) AS u, sum(same) AS r FROM (SELECT *, CASE WHEN lag(token) OVER (PARTITION BY piece_id ORDER BY turn, pos) = token THEN 1 ELSE 0 END AS same FROM t) GROUP BY 1),
x AS (SELECT piece_id, n, u * 1.0 / n AS unique_ratio, b * 1.0 / (n - 1) AS bigram_ratio, r * 1.0 / (n - 1) AS repeat_ratio FROM n JOIN (SELECT piece_id, count(*) AS b FROM bg GROUP BY 1) USING (piece_id) WHERE n > 1)
SELECT piece_id, round(unique_ratio, 9) AS unique_ratio, round(bigram_ratio, 9) AS bigram_ratio, round(repeat_ratio, 9) AS repeat_ratio, round(CASE WHEN n < 10 THEN 0.5 ELSE {DIVERSITY_SQL} END, 6) AS diversity FROM x""",
    "prefix_length": f"WITH {TOKENS_SQL} SELECT piece_id, turn, CAST(coalesce(min(CASE WHEN ends_with(token, '.') THEN pos + 1 END), 0) AS INT) AS prefix_len FROM t GROUP BY 1, 2",
    "chunk_sequences": f"""WITH s AS (SELECT conv_id AS piece_id, turn, string_split(lower(text), ' ') AS w FROM conversations), c AS (SELECT piece_id, turn, w, unnest(CASE WHEN len(w) <= {CHUNK} THEN [0] ELSE range(0, greatest(len(w) - {CHUNK} + {STRIDE - PREFIX - 1}, 0) + 1, {STRIDE - PREFIX}) END) AS st FROM s),
k AS (SELECT piece_id, turn, CAST(st // {STRIDE - PREFIX} AS INT) AS chunk_idx, CASE WHEN len(w) <= {CHUNK} THEN w ELSE list_concat(w[1:{PREFIX}], w[{PREFIX} + st + 1:{PREFIX} + st + {CHUNK - PREFIX}]) END AS ch FROM c) SELECT piece_id, turn, chunk_idx, CAST(len(ch) AS INT) AS n_tokens, array_to_string(ch, ' ') AS chunk FROM k""",
    "piece_weights": "SELECT conv_id AS piece_id, turn, 1.0 AS uniform, round(1 / sqrt(count(*) OVER (PARTITION BY conv_id)), 9) AS sqrt, round(1.0 / count(*) OVER (PARTITION BY conv_id), 9) AS inverse FROM conversations",
    "piece_split_hash": "SELECT CASE WHEN (conv_id * 2654435761 + 12345) % 1000 < 100 THEN 'val' ELSE 'train' END AS split, count(DISTINCT conv_id) AS pieces, count(*) AS turns FROM conversations GROUP BY 1",
    "running_voice_state": "WITH s AS (SELECT conv_id AS piece_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), r AS (SELECT *, CAST(sum(CASE WHEN role = before THEN 0 ELSE 1 END) OVER (PARTITION BY piece_id ORDER BY turn) AS BIGINT) AS run FROM s) SELECT piece_id, turn, before, run, CAST(row_number() OVER (PARTITION BY piece_id, run ORDER BY turn) AS INT) AS in_run FROM r",
}
