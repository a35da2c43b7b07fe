"""Control tokens of pieces, their decoding to on and off events, and sliding buffers; batch forms of the streams in `streaming.state`.

Control tokens come in time order: BAR begins a bar, VOICE_v and BEAT_t (ticks in the bar) set where the next note stands,
N_pitch_dur is the note, and EOS ends the piece. Decoding gives an on row at the note's token and an off row at the first
token at which its duration has passed; what is still open ends at EOS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.plans.views import NOTES_SQL, TOKENS_SQL, notes, tokens

BAR = 1920
BUFFER = 32


def control_tokens(n: DataFrame) -> DataFrame:
    """piece_id, pos, token of notes (piece_id, voice, note_idx, start, dur, pitch)."""
    w = W.partitionBy("piece_id").orderBy("start", "voice", "note_idx")
    bar, beat = F.floor(F.col("start") / BAR), F.col("start") % BAR
    before = F.coalesce(F.lag(bar).over(w), F.lit(-1))
    moved = (bar > before) | (beat != F.coalesce(F.lag(beat).over(w), F.lit(-1)))
    own = n.select("piece_id", "start", "voice", "note_idx", F.concat(
        F.array_repeat(F.lit("BAR"), (bar - before).cast("int")),
        F.when(moved & (beat > 0), F.array(F.concat(F.lit("BEAT_"), beat.cast("string")))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce(F.lag("voice").over(w), F.lit(-1)) != F.col("voice"), F.array(F.concat(F.lit("VOICE_"), F.col("voice").cast("string")))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat_ws("_", F.lit("N"), F.col("pitch").cast("string"), F.col("dur").cast("string"))),
    ).alias("own"))
    first = F.coalesce(F.sum(F.size("own")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    body = own.select("piece_id", first.alias("first"), "own").select("piece_id", "first", F.posexplode("own").alias("i", "token")).select("piece_id", (F.col("first") + F.col("i")).alias("pos"), "token")
    ends = body.groupBy("piece_id").agg((F.max("pos") + 1).alias("pos"), F.lit("EOS").alias("token"))
    return body.unionByName(ends)


def numbered(token: Column, prefix: str, part: int = 1) -> Column:
    """The number at a place of a token that has the prefix, else null."""
    return F.when(token.startswith(prefix), F.element_at(F.split(token, "_"), part + 1).cast("bigint"))


def decoded(t: DataFrame) -> DataFrame:
    """piece_id, at (position of the token that gives the event), kind, tick, voice, pitch."""
    w = W.partitionBy("piece_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    token = F.col("token")
    place = F.when(token == "BAR", F.lit(0)).otherwise(numbered(token, "BEAT_"))
    s = t.select("piece_id", "pos", "token", (F.count_if(token == "BAR").over(w) - 1).alias("bar"), F.last(place, ignorenulls=True).over(w).alias("beat"), F.last(numbered(token, "VOICE_"), ignorenulls=True).over(w).cast("int").alias("voice"))
    now = (F.greatest(F.col("bar"), F.lit(0)) * BAR + F.coalesce("beat", F.lit(0))).cast("bigint")
    s = s.select("piece_id", "pos", "token", now.alias("now"), "voice")
    sung = s.filter(token.startswith("N_")).select("piece_id", "pos", "now", "voice", numbered(token, "N_").cast("int").alias("pitch"), (F.col("now") + numbered(token, "N_", 2)).alias("off"))
    reached = s.groupBy("piece_id", "now").agg(F.min("pos").alias("pos"))
    last = s.filter("token = 'EOS'").groupBy("piece_id").agg(F.min("pos").alias("eos"))
    asked = sung.select("piece_id", F.col("off").alias("tick"), F.lit(0).alias("point"), F.lit(None).cast("bigint").alias("pos"), "voice", "pitch")
    points = reached.select("piece_id", F.col("now").alias("tick"), F.lit(1).alias("point"), "pos", F.lit(None).cast("int").alias("voice"), F.lit(None).cast("int").alias("pitch"))
    ahead = W.partitionBy("piece_id").orderBy("tick", "point").rowsBetween(W.currentRow, W.unboundedFollowing)
    offs = asked.unionByName(points).withColumn("at", F.first("pos", ignorenulls=True).over(ahead)).filter("point = 0").join(last, "piece_id", "left")
    on = sung.select("piece_id", F.col("pos").alias("at"), F.lit("on").alias("kind"), F.col("now").alias("tick"), "voice", "pitch")
    return on.unionByName(offs.select("piece_id", F.coalesce("at", "eos").alias("at"), F.lit("off").alias("kind"), "tick", "voice", "pitch"))


def buffered(t: DataFrame, key: list[str], size: int = BUFFER) -> DataFrame:
    """key, pos (absolute), evicted (what the token drives out, or null), kept and first (how many stay, and the oldest's position)."""
    w = W.partitionBy(*key).orderBy("pos")
    return t.select(*key, "pos", F.lag("token", size).over(w).alias("evicted"), F.least(F.col("pos") + 1, F.lit(size)).cast("int").alias("kept"), F.greatest(F.col("pos") - size + 1, F.lit(0)).cast("int").alias("first"))


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(control_tokens(notes(spark, sf_dir)))


def sliding_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffered(tokens(spark, sf_dir), ["piece_id", "turn"])


QUERIES = {f.__name__: f for f in (decoded_events, sliding_buffer)}

SQL = {
    "decoded_events": f"""WITH {NOTES_SQL}, o AS (SELECT *, start // 1920 AS bar, start % 1920 AS beat, lag(start // 1920) OVER w AS b0, lag(start % 1920) OVER w AS t0, lag(voice) OVER w AS v0, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY piece_id ORDER BY start, voice, note_idx)),
c AS (SELECT *, bar - coalesce(b0, -1) + CAST(beat > 0 AND (coalesce(b0, -1) < bar OR t0 <> beat) AS INT) + CAST(coalesce(v0, -1) <> voice AS INT) + 1 AS size FROM o),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY piece_id ORDER BY k) - 1 AS BIGINT) AS pos FROM c),
e AS (SELECT piece_id, max(pos) + 1 AS eos FROM p GROUP BY 1),
y AS (SELECT piece_id, pos - size + 1 + j AS q, CASE WHEN j < bar - coalesce(b0, -1) THEN (coalesce(b0, -1) + 1 + j) * 1920 ELSE start END AS now FROM (SELECT *, unnest(range(size)) AS j FROM p)),
z AS (SELECT p.piece_id, p.pos, min(q) AS q FROM p JOIN y ON y.piece_id = p.piece_id AND y.now >= p.start + p.dur GROUP BY 1, 2)
SELECT piece_id, pos AS "at", 'on' AS kind, CAST(start AS BIGINT) AS tick, voice, pitch FROM p UNION ALL
SELECT p.piece_id, coalesce(q, eos), 'off', CAST(start + dur AS BIGINT), voice, pitch FROM p JOIN e ON e.piece_id = p.piece_id LEFT JOIN z ON z.piece_id = p.piece_id AND z.pos = p.pos""",
    "sliding_buffer": f"WITH {TOKENS_SQL} SELECT piece_id, turn, pos, lag(token, 32) OVER (PARTITION BY piece_id, turn ORDER BY pos) AS evicted, CAST(least(pos + 1, 32) AS INT) AS kept, CAST(greatest(pos - 31, 0) AS INT) AS first FROM t",
}
