"""Filters on next-token logits, masks and biases, and the choices made from them. Rows are (ctx_id, token_id, logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import HARMONIC_MINOR, MAJOR, lits
from quaverlake.plans.views import LOGITS_SQL, logits, table

TEMPERATURE, TOP_K, TOP_P, MIN_P = 1.15, 10, 0.9, 0.1


def softmax(g: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Adds p: the softmax of logit / temperature within a context; NaN and infinities weigh nothing."""
    w = W.partitionBy("ctx_id")
    finite = F.when(F.isnan("logit") | (F.abs("logit") == float("inf")), None).otherwise(F.col("logit") / temperature)
    e = g.withColumn("_e", F.exp(finite - F.max(finite).over(w)))
    return e.withColumn("p", F.round(F.coalesce(F.col("_e") / F.sum("_e").over(w), F.lit(0.0)), 12)).drop("_e")


def top_k(g: DataFrame, k: int) -> DataFrame:
    """Tokens not below the k-th logit of their context; ties with it stay."""
    return g.withColumn("_r", F.rank().over(W.partitionBy("ctx_id").orderBy(F.desc("logit")))).filter(F.col("_r") <= k).drop("_r")


def top_p(g: DataFrame, p: float) -> DataFrame:
    """The likeliest tokens up to and with the one that reaches mass p (needs column p)."""
    w = W.partitionBy("ctx_id").orderBy(F.desc("logit"), "token_id").rowsBetween(W.unboundedPreceding, -1)
    return g.withColumn("_m", F.coalesce(F.sum("p").over(w), F.lit(0.0))).filter(F.round("_m", 9) <= p).drop("_m")


def min_p(g: DataFrame, share: float) -> DataFrame:
    """Tokens with at least `share` of the likeliest token's p (needs column p)."""
    return g.withColumn("_x", F.max("p").over(W.partitionBy("ctx_id"))).filter(F.col("p") >= share * F.col("_x")).drop("_x")


def sample(g: DataFrame, seed: int) -> DataFrame:
    """One token for each context: temperature, top-k, top-p and min-p, then Gumbel arg-max with noise hashed from the seed.

    Where nothing is left, the context's largest finite logit, else token 0.
    """
    kept = min_p(top_p(softmax(top_k(g, TOP_K)), TOP_P), MIN_P)
    u = (F.pmod(F.xxhash64(F.lit(seed), "ctx_id", "token_id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    drawn = kept.filter("p > 0").groupBy("ctx_id").agg(F.max_by("token_id", F.log("p") - F.log(-F.log(u))).alias("drawn"))
    return argmax(g).join(drawn, "ctx_id", "left").select("ctx_id", F.coalesce("drawn", "token_id").alias("token_id"))


def argmax(g: DataFrame) -> DataFrame:
    """The token of the largest logit (the first on ties); NaN counts as minus infinity; token 0 if nothing is finite."""
    v = F.when(F.isnan("logit"), float("-inf")).otherwise(F.col("logit"))
    best = g.groupBy("ctx_id").agg(F.max(F.struct(v.alias("v"), (-F.col("token_id")).alias("t"))).alias("b"))
    return best.select("ctx_id", F.when(F.col("b.v") == float("-inf"), 0).otherwise(-F.col("b.t")).cast("int").alias("token_id"))


def outside_range(token: Column, lo: int = 12, hi: int = 51) -> Column:
    """Tokens 0 to 63 stand for pitches 24 to 87 here; the allowed range is in tokens."""
    return ~token.between(lo, hi)


def softmax_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmax(logits(spark, sf_dir)).select("ctx_id", "token_id", F.round("p", 9).alias("p"))


def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(logits(spark, sf_dir), TOP_K).groupBy("ctx_id").agg(F.count(F.lit(1)).alias("kept"), F.min("logit").alias("least"))


def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_p(softmax(logits(spark, sf_dir)), TOP_P).groupBy("ctx_id").agg(F.count(F.lit(1)).alias("kept"))


def min_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_p(softmax(logits(spark, sf_dir)), MIN_P).groupBy("ctx_id").agg(F.count(F.lit(1)).alias("kept"))


def argmax_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argmax(logits(spark, sf_dir))


def range_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens left in range, and the best of them."""
    g = logits(spark, sf_dir).withColumn("logit", F.when(outside_range(F.col("token_id")), float("-inf")).otherwise(F.col("logit")))
    return g.filter("logit > double('-inf')").groupBy("ctx_id").agg(F.count(F.lit(1)).alias("allowed"), F.max("logit").alias("best"))


def key_bias(spark: SparkSession, sf_dir: str, weight: float = 0.5) -> DataFrame:
    """Logits raised in the scale of C (major or, for odd contexts, harmonic minor), lowered by half of that outside."""
    steps = F.when(F.col("ctx_id") % 2 == 0, lits(MAJOR)).otherwise(lits(HARMONIC_MINOR))
    inside = F.array_contains(steps, (F.col("token_id") % 12).cast("int"))
    return logits(spark, sf_dir).select("ctx_id", "token_id", F.round(F.col("logit") + F.when(inside, weight).otherwise(-weight / 2), 6).alias("logit"))


def degenerate_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits after penalties that stand on the recent tokens of the conversation of the same id.

    Tokens 0 to 3 are PAD, BOS, EOS and VOICE_SEP, which opens each turn; a word counts as token 4, 5 or 6 by its length. The
    last token loses 1, the tokens of a three-token pattern that was just repeated lose 2 for each time they stand in it.
    PAD and BOS are barred, and VOICE_SEP while the turn has fewer than four words. With fewer than four tokens nothing changes.
    """
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), "turn", F.transform(F.split(F.lower("text"), " "), lambda w: 4 + F.length(w) % 3).alias("w"))
    t = c.select("ctx_id", "turn", F.posexplode(F.concat(F.array(F.lit(3)), F.coalesce("w", F.array().cast("array<int>")))).alias("pos", "tok"))
    recent = t.withColumn("back", F.row_number().over(W.partitionBy("ctx_id").orderBy(F.desc("turn"), F.desc("pos")))).filter("back <= 6")
    ring = recent.groupBy("ctx_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("b"), "tok"))), lambda x: x["tok"]).alias("ring"), F.max(F.struct("turn", "pos"))["pos"].alias("in_turn"))
    last = F.slice("ring", -3, 3)
    again = (F.size("ring") == 6) & (F.slice("ring", 1, 3) == last)
    times = F.size(F.filter(last, lambda x: x == F.col("token_id")))
    loss = F.when(F.col("token_id") == F.element_at("ring", -1), 1.0).otherwise(0.0) + F.when(again, 2.0 * times).otherwise(0.0)
    barred = F.col("token_id").isin(0, 1) | ((F.col("token_id") == 3) & (F.col("in_turn") < 4))
    new = F.when(barred, float("-inf")).otherwise(F.col("logit") - loss)
    g = logits(spark, sf_dir).join(ring, "ctx_id", "left")
    return g.select("ctx_id", "token_id", F.round(F.when(F.size("ring") >= 4, new).otherwise(F.col("logit")), 6).alias("logit"))


def sampled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(logits(spark, sf_dir), seed=42)


QUERIES = {f.__name__: f for f in (softmax_temperature, top_k_filter, top_p_filter, min_p_filter, argmax_token, range_mask, key_bias, degenerate_penalties, sampled_tokens)}

SOFTMAX_SQL = f"{LOGITS_SQL}, e0 AS (SELECT *, exp(logit / {TEMPERATURE} - max(logit / {TEMPERATURE}) OVER (PARTITION BY ctx_id)) AS e FROM g), sm AS (SELECT ctx_id, token_id, logit, round(e / sum(e) OVER (PARTITION BY ctx_id), 12) AS p FROM e0)"
SQL = {
    "softmax_temperature": f"WITH {SOFTMAX_SQL} SELECT ctx_id, token_id, round(p, 9) AS p FROM sm",
    "top_k_filter": f"WITH {LOGITS_SQL} SELECT ctx_id, count(*) AS kept, min(logit) AS least FROM (SELECT *, rank() OVER (PARTITION BY ctx_id ORDER BY logit DESC) AS r FROM g) WHERE r <= {TOP_K} GROUP BY 1",
    "top_p_filter": f"WITH {SOFTMAX_SQL} SELECT ctx_id, count(*) AS kept FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM sm) WHERE round(m, 9) <= {TOP_P} GROUP BY 1",
    "min_p_filter": f"WITH {SOFTMAX_SQL} SELECT ctx_id, count(*) AS kept FROM (SELECT *, max(p) OVER (PARTITION BY ctx_id) AS x FROM sm) WHERE p >= {MIN_P} * x GROUP BY 1",
    "argmax_token": f"WITH {LOGITS_SQL} SELECT ctx_id, token_id FROM (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY logit DESC, token_id) AS r FROM g) WHERE r = 1",
    "range_mask": f"WITH {LOGITS_SQL} SELECT ctx_id, count(*) AS allowed, max(logit) AS best FROM g WHERE token_id BETWEEN 12 AND 51 GROUP BY 1",
    "key_bias": f"WITH {LOGITS_SQL} SELECT ctx_id, token_id, round(logit + CASE WHEN list_contains(CASE WHEN ctx_id % 2 = 0 THEN {MAJOR} ELSE {HARMONIC_MINOR} END, token_id % 12) THEN 0.5 ELSE -0.25 END, 6) AS logit FROM g",
    "degenerate_penalties": f"""WITH {LOGITS_SQL}, s AS (SELECT conv_id, turn, list_concat([3], list_transform(string_split(lower(text), ' '), lambda w: 4 + length(w) % 3)) AS w FROM conversations),
a AS (SELECT conv_id AS ctx_id, flatten(list(w ORDER BY turn)) AS a, len(arg_max(w, turn)) - 1 AS in_turn FROM s GROUP BY 1)
SELECT g.ctx_id, g.token_id, round(CASE WHEN len(a) IS NULL OR len(a) < 4 THEN logit WHEN token_id IN (0, 1) OR token_id = 3 AND in_turn < 4 THEN CAST('-inf' AS DOUBLE)
 ELSE logit - CASE WHEN token_id = a[-1] THEN 1.0 ELSE 0.0 END - CASE WHEN len(a) >= 6 AND a[-3:] = a[-6:-4] THEN 2.0 * len(list_filter(a[-3:], lambda x: x = token_id)) ELSE 0.0 END END, 6) AS logit FROM g LEFT JOIN a USING (ctx_id)""",
}
