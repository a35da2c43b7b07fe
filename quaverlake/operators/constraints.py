"""Decoding constraints applied in order: pitch tokens, and scale-degree tokens with a relaxation for each context.

The history of a context is the conversation of that id; a separator opens each turn, and each word stands for a token of 4 to 63. Specials are
the same in both layouts: 0 PAD, 1 BOS, 2 EOS, 3 VOICE_SEP, 4 to 7 the voices. Pitch layout: 8 to 56 are the pitches from 36 up, 57 to 59
durations, 60 to 63 bar, beats and time shift. Scale-degree layout: 8 to 12 octaves 2 to 6, 13 and 14 sharp and flat, 15 to 21 degrees, 22 to 32
durations, 33 to 63 time shifts. Contexts need two, three or four voices by turns; those of four are fugues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import HARMONIC_MINOR, MAJOR, NATURAL_MINOR, lits
from quaverlake.operators.runs import degree_pitch
from quaverlake.plans.views import LOGITS_SQL, logits, table

# Ranges of four voices from the highest down, and the sizes of biases and penalties.
RANGES = [(60, 84), (48, 72), (48, 69), (36, 60)]
KEY_WEIGHT, CHROMATIC, LAST, PATTERN, MISSING = 0.5, 1.0, 1.0, 2.0, 1.5
LEAST_NOTES, RECENT, STACKED, ADVANCE, PAIRED = 4, 32, 1.1, 0.35, 0.25
# End of fixed values.
BARRED = float("-inf")
#: How far below the best token a token may stand to be offered to the scale-degree constraints.
REACH = 2.0


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ctx_id, seq (place from the end, from 1), tok."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), "turn", F.posexplode(F.concat(F.array(F.lit(3)), F.transform(F.split(F.lower("text"), " "), lambda w: (4 + (F.ascii(w) + F.length(w)) % 60).cast("int")))).alias("pos", "tok"))
    w = W.partitionBy("ctx_id").orderBy(F.desc("turn"), F.desc("pos"))
    return c.select("ctx_id", F.row_number().over(w).alias("seq"), "tok")


def state(h: DataFrame, note: Column, temporal: Column | None = None) -> DataFrame:
    """ctx_id, voice (1 to 4), octave and accidental that still wait for a note (0: none), voices that have notes, the last six tokens and their number,
    the notes since the last voice or separator, and how many voices came since the last temporal token or separator among the last RECENT.

    A voice, separator, duration or time shift takes what waits; an octave takes the accidental.
    """
    temporal = F.lit(False) if temporal is None else temporal
    tok, seq = F.col("tok"), F.col("seq")
    before = F.last(F.when(tok.between(4, 7), tok - 3), ignorenulls=True).over(W.partitionBy("ctx_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0))
    ends = (tok <= 7) | (tok >= 22)
    latest = lambda value, where: F.min_by(value, F.when(where, seq))
    whole = W.partitionBy("ctx_id")
    last = lambda where: F.coalesce(F.min(F.when(where, seq)).over(whole), F.lit(1 << 30))
    x = h.withColumn("of", F.coalesce(before, F.lit(1))).withColumn("voiced", last(tok.between(3, 7))).withColumn("slot", last(temporal | (tok == 3)))
    return x.groupBy("ctx_id").agg(
        F.coalesce(latest(tok - 3, tok.between(4, 7)), F.lit(1)).alias("voice"),
        F.coalesce(latest(F.when(tok.between(8, 12), tok - 6).otherwise(0), ends | tok.between(8, 12)), F.lit(0)).alias("octave"),
        F.coalesce(latest(F.when(tok == 13, "#").when(tok == 14, "b").otherwise(""), ends | tok.between(8, 14)), F.lit("")).alias("accidental"),
        F.collect_set(F.when(note, F.col("of"))).alias("sung"),
        F.transform(F.array_sort(F.collect_list(F.when(seq <= 6, F.struct((-seq).alias("s"), tok.alias("t"))))), lambda v: v["t"]).alias("ring"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(note & (seq < F.col("voiced"))).alias("in_voice"),
        F.size(F.collect_set(F.when(tok.between(4, 7) & (seq < F.col("slot")) & (seq <= RECENT), tok))).alias("stacked"),
    )


def joined(g: DataFrame, s: DataFrame) -> DataFrame:
    """Logits with the state of their context (the first voice and nothing else where there is none) and the required voices without notes."""
    x = g.join(s, "ctx_id", "left").withColumn("voice", F.coalesce("voice", F.lit(1))).withColumn("octave", F.coalesce("octave", F.lit(0))).withColumn("accidental", F.coalesce("accidental", F.lit("")))
    x = x.fillna({"n_tokens": 0, "in_voice": 0, "stacked": 0}).withColumn("ring", F.coalesce("ring", F.array().cast("array<int>"))).withColumn("sung", F.coalesce("sung", F.array().cast("array<int>")))
    return x.withColumn("missing", F.array_except(F.sequence(F.lit(1), (F.col("ctx_id") % 3 + 2).cast("int")), "sung")).withColumn("key_root", (F.col("ctx_id") % 12).cast("int")).withColumn("key_mode", F.when(F.col("ctx_id") % 2 == 0, "major").otherwise("minor"))


def bound(side: int) -> Column:
    return F.element_at(lits([r[side] for r in RANGES]), F.col("voice"))


def degenerate(x: Column, temporal: Column) -> Column:
    """The last token and a three-token pattern that was just repeated lose, PAD and BOS are barred, and VOICE_SEP while the voice has fewer
    than four notes; in a fugue voices lose where several came at one time, and temporal tokens gain. Nothing with fewer than four tokens."""
    token, ring = F.col("token_id"), F.col("ring")
    fugue, stacked = F.col("ctx_id") % 3 == 2, F.col("stacked")
    bias = F.when(token.between(4, 7), F.when(stacked >= 3, -STACKED).when(stacked == 2, -PAIRED).otherwise(0.0)).when(temporal & (stacked >= 3), ADVANCE).otherwise(0.0)
    again = (F.size(ring) == 6) & (F.slice(ring, 1, 3) == F.slice(ring, 4, 3))
    times = F.when(again, F.size(F.filter(F.slice(ring, 4, 3), lambda t: t == token))).otherwise(0)
    lowered = x - F.when(token == F.try_element_at(ring, F.lit(-1)), LAST).otherwise(0.0) - PATTERN * times + F.when(fugue, bias).otherwise(0.0)
    barred = token.isin(0, 1) | ((token == 3) & (F.col("in_voice") < LEAST_NOTES))
    return F.when(F.col("n_tokens") < 4, x).when(barred, BARRED).otherwise(lowered)


def covered(x: Column) -> Column:
    """While a required voice has no note, EOS is barred and the tokens of such voices gain."""
    token = F.col("token_id")
    lacks = F.array_contains("missing", token - 3) & token.between(4, 7)
    return F.when((F.size("missing") > 0) & (token == 2), BARRED).when(lacks, x + MISSING).otherwise(x)


def constrained_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on pitch tokens: out of the current voice's range they are barred, in the key they gain; then what degenerates, and missing voices."""
    tok, time = F.col("token_id"), lambda t: t.between(60, 63)
    x = joined(logits(spark, sf_dir), state(history(spark, sf_dir), F.col("tok").between(57, 59), time(F.col("tok"))))
    pitch, sung = tok + 28, tok.between(8, 56)
    inside = F.array_contains(F.when(F.col("key_mode") == "major", lits(MAJOR)).otherwise(lits(HARMONIC_MINOR)), F.pmod(pitch - F.col("key_root"), F.lit(12)).cast("int"))
    ranged = F.when(sung & ~pitch.between(bound(0), bound(1)), BARRED).otherwise(F.col("logit"))
    biased = ranged + F.when(~sung, 0.0).when(inside, KEY_WEIGHT).otherwise(-KEY_WEIGHT / 2)
    return x.select("ctx_id", "token_id", F.round(covered(degenerate(biased, time(tok))), 6).alias("logit"))


def narrowed(g: DataFrame) -> DataFrame:
    """Logits of which the tokens further than REACH below the best of their context are barred, as a min-p filter bars them."""
    best = F.max("logit").over(W.partitionBy("ctx_id"))  # 64 tokens
    return g.withColumn("logit", F.when(F.col("logit") >= best - REACH, F.col("logit")).otherwise(BARRED))


def relaxed(g: DataFrame, s: DataFrame) -> DataFrame:
    """Scale-degree tokens: the first pass that leaves a finite logit in the context, of all constraints, without those on repeats,
    without the chromatic penalty, and without ranges; `level` tells which. 4: the input as it is, or EOS alone where that has nothing finite."""
    tok, time = F.col("token_id"), lambda t: t.between(33, 63)
    x = joined(g, s)
    of = lambda octave, degree, accidental: degree_pitch(octave, degree, accidental, F.col("key_root"), F.col("key_mode"))
    unreachable = tok.between(8, 12) & ((of(tok - 6, F.lit(7), F.lit("#")) < bound(0)) | (of(tok - 6, F.lit(1), F.lit("")) > bound(1)))
    sounded = of(F.col("octave"), F.greatest(F.least(tok - 14, F.lit(7)), F.lit(1)), F.col("accidental"))
    outside = tok.between(15, 21) & (F.col("octave") > 0) & ~sounded.between(bound(0), bound(1))
    ranged = F.when(unreachable | outside, BARRED).otherwise(F.col("logit"))
    penalised = ranged - F.when(tok.isin(13, 14), CHROMATIC).otherwise(0.0)
    passes = F.array(*(covered(p) for p in (degenerate(penalised, time(tok)), penalised, ranged, F.col("logit"))), F.col("logit"))
    x = x.select("ctx_id", "token_id", passes.alias("p"))
    w = W.partitionBy("ctx_id")  # 64 tokens
    alive = F.array(*(F.max(F.col("p")[i] > BARRED).over(w) for i in range(5)))
    x = x.withColumn("first", F.array_position(alive, True).cast("int"))
    last = F.when(tok == 2, 0.0).otherwise(BARRED)
    return x.select("ctx_id", "token_id", F.when(F.col("first") > 0, F.col("first") - 1).otherwise(4).alias("level"), F.round(F.when(F.col("first") > 0, F.try_element_at("p", F.greatest("first", F.lit(1)))).otherwise(last), 6).alias("logit"))


def degree_state(h: DataFrame) -> DataFrame:
    return state(h, F.col("tok").between(22, 32), F.col("tok").between(33, 63))


def relaxed_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relaxed(narrowed(logits(spark, sf_dir)), degree_state(history(spark, sf_dir)))


def pending_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The octave and accidental of each history that still wait for a note, and the current voice."""
    return state(history(spark, sf_dir), F.col("tok").between(22, 32)).select("ctx_id", "voice", "octave", "accidental", F.array_join(F.transform(F.array_sort("sung"), lambda v: v.cast("string")), ",").alias("sung"))


QUERIES = {f.__name__: f for f in (constrained_logits, relaxed_logits, pending_markers)}

HISTORY_SQL = """h0 AS (SELECT conv_id AS ctx_id, turn, string_split(lower(text), ' ') AS w FROM conversations), h1 AS (SELECT ctx_id, turn, w, unnest(range(len(w) + 1)) AS i FROM h0),
h2 AS (SELECT ctx_id, row_number() OVER (PARTITION BY ctx_id ORDER BY turn, i) AS k, CAST(CASE WHEN i = 0 THEN 3 ELSE 4 + (CASE WHEN w[i] = '' THEN 0 ELSE unicode(w[i]) END + length(w[i])) % 60 END AS INT) AS tok FROM h1),
h3 AS (SELECT *, coalesce(last_value(CASE WHEN tok BETWEEN 4 AND 7 THEN tok - 3 END IGNORE NULLS) OVER (PARTITION BY ctx_id ORDER BY k), 1) AS of, max(k) OVER (PARTITION BY ctx_id) AS last FROM h2)"""


def state_sql(note: str, temporal: str = "FALSE") -> str:
    return f"""{HISTORY_SQL}, hb AS (SELECT ctx_id, coalesce(max(k) FILTER (tok <= 7), 0) AS voiced, coalesce(max(k) FILTER (tok = 3 OR {temporal}), 0) AS slot FROM h3 GROUP BY 1),
hs AS (SELECT ctx_id, count(*) FILTER (({note}) AND k > voiced) AS in_voice, count(DISTINCT CASE WHEN tok BETWEEN 4 AND 7 AND k > slot AND k > last - 32 THEN tok END) AS stacked FROM h3 JOIN hb USING (ctx_id) GROUP BY 1),
s0 AS (SELECT ctx_id, coalesce(arg_max(tok - 3, k) FILTER (tok BETWEEN 4 AND 7), 1) AS voice, coalesce(arg_max(CASE WHEN tok BETWEEN 8 AND 12 THEN tok - 6 ELSE 0 END, k) FILTER (tok <= 12 OR tok >= 22), 0) AS octave,
 coalesce(arg_max(CASE tok WHEN 13 THEN '#' WHEN 14 THEN 'b' ELSE '' END, k) FILTER (tok <= 14 OR tok >= 22), '') AS accidental, coalesce(list_sort(list(DISTINCT of) FILTER ({note})), []) AS sung, list(tok ORDER BY k)[-6:] AS ring, count(*) AS n_tokens FROM h3 GROUP BY 1), st AS (SELECT * FROM s0 JOIN hs USING (ctx_id))"""


def joined_sql(g: str) -> str:
    ranges = [[r[i] for r in RANGES] for i in (0, 1)]
    return f"""jn AS (SELECT g.ctx_id, token_id AS t, logit AS x, coalesce(octave, 0) AS octave, coalesce(accidental, '') AS accidental, coalesce(n_tokens, 0) AS n_tokens, coalesce(in_voice, 0) AS in_voice, coalesce(stacked, 0) AS stacked, g.ctx_id % 3 = 2 AS fugue, coalesce(ring, []) AS ring, ({ranges[0]})[coalesce(voice, 1)] AS lo, ({ranges[1]})[coalesce(voice, 1)] AS hi,
 list_filter(range(1, g.ctx_id % 3 + 3), lambda v: NOT list_contains(coalesce(sung, []), v)) AS missing, g.ctx_id % 12 AS r, g.ctx_id % 2 = 0 AS major FROM {g} g LEFT JOIN st ON st.ctx_id = g.ctx_id)"""


def degenerate_sql(x: str, temporal: str) -> str:
    bias = f"CASE WHEN NOT fugue THEN 0.0 WHEN t BETWEEN 4 AND 7 THEN CASE WHEN stacked >= 3 THEN -1.1 WHEN stacked = 2 THEN -0.25 ELSE 0.0 END WHEN {temporal} AND stacked >= 3 THEN 0.35 ELSE 0.0 END"
    return f"CASE WHEN n_tokens < 4 THEN {x} WHEN t IN (0, 1) OR t = 3 AND in_voice < 4 THEN CAST('-inf' AS DOUBLE) ELSE {x} + {bias} - CASE WHEN t = ring[-1] THEN 1.0 ELSE 0.0 END - CASE WHEN len(ring) = 6 AND ring[1:3] = ring[4:6] THEN 2.0 * len(list_filter(ring[4:6], lambda v: v = t)) ELSE 0.0 END END"


def covered_sql(x: str) -> str:
    return f"CASE WHEN len(missing) > 0 AND t = 2 THEN CAST('-inf' AS DOUBLE) WHEN t BETWEEN 4 AND 7 AND list_contains(missing, t - 3) THEN {x} + 1.5 ELSE {x} END"


def pitch_sql(octave: str, degree: str, accidental: str) -> str:
    return f"(({octave} + 1) * 12 + r + (CASE WHEN major THEN {MAJOR} ELSE {NATURAL_MINOR} END)[{degree}] + CASE {accidental} WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END)"


SQL = {
    "constrained_logits": f"""WITH {LOGITS_SQL}, {state_sql('tok BETWEEN 57 AND 59', 'tok >= 60')}, {joined_sql('g')}, b AS (SELECT *, CASE WHEN t NOT BETWEEN 8 AND 56 THEN x WHEN t + 28 < lo OR t + 28 > hi THEN CAST('-inf' AS DOUBLE) WHEN list_contains(CASE WHEN major THEN {MAJOR} ELSE {HARMONIC_MINOR} END, (t + 28 - r) % 12) THEN x + 0.5 ELSE x - 0.25 END AS y FROM jn),
d AS (SELECT *, {degenerate_sql('y', 't >= 60')} AS z FROM b) SELECT ctx_id, t AS token_id, round({covered_sql('z')}, 6) AS logit FROM d""",
    "relaxed_logits": f"""WITH {LOGITS_SQL}, gn AS (SELECT ctx_id, token_id, CASE WHEN logit >= max(logit) OVER (PARTITION BY ctx_id) - 2.0 THEN logit ELSE CAST('-inf' AS DOUBLE) END AS logit FROM g), {state_sql('tok BETWEEN 22 AND 32', 'tok >= 33')}, {joined_sql('gn')},
b AS (SELECT *, CASE WHEN t BETWEEN 8 AND 12 AND ({pitch_sql('t - 6', '7', "'#'")} < lo OR {pitch_sql('t - 6', '1', "''")} > hi) THEN CAST('-inf' AS DOUBLE) WHEN t BETWEEN 15 AND 21 AND octave > 0 AND {pitch_sql('octave', 'CAST(t - 14 AS INT)', 'accidental')} NOT BETWEEN lo AND hi THEN CAST('-inf' AS DOUBLE) ELSE x END AS y FROM jn),
c AS (SELECT *, y - CASE WHEN t IN (13, 14) THEN 1.0 ELSE 0.0 END AS z FROM b), d AS (SELECT *, {degenerate_sql('z', 't >= 33')} AS q FROM c),
p AS (SELECT ctx_id, t, {covered_sql('q')} AS p0, {covered_sql('z')} AS p1, {covered_sql('y')} AS p2, {covered_sql('x')} AS p3, x AS p4 FROM d),
v AS (SELECT ctx_id, {', '.join(f"max(p{i}) > CAST('-inf' AS DOUBLE) AS v{i}" for i in range(5))} FROM p GROUP BY 1)
SELECT ctx_id, t AS token_id, CAST(CASE {' '.join(f'WHEN v{i} THEN {i}' for i in range(4))} ELSE 4 END AS INT) AS level, round(CASE {' '.join(f'WHEN v{i} THEN p{i}' for i in range(5))} WHEN t = 2 THEN 0.0 ELSE CAST('-inf' AS DOUBLE) END, 6) AS logit FROM p JOIN v USING (ctx_id)""",
    "pending_markers": f"WITH {state_sql('tok BETWEEN 22 AND 32')} SELECT ctx_id, CAST(voice AS INT) AS voice, CAST(octave AS INT) AS octave, accidental, array_to_string(sung, ',') AS sung FROM st",
}
