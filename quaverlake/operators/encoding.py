"""Pieces as token sequences, and the repair of performed notes: quantizing, triage, fewer voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import lits
from quaverlake.operators import scoring
from quaverlake.operators.ranking import CADENCES_SQL
from quaverlake.operators.subjects import BAR, ENTRY_SQL, SCAN_SQL, bar_of, entries
from quaverlake.plans.views import NOTES_SQL, notes

#: Forms of the fixture's pieces by turns; the first three are marked where a subject enters.
FORMS, WITH_SUBJECT = ["fugue", "sinfonia", "invention", "chorale", "motet"], 3
GRID, PULL = 120, 40


def form(piece: str = "piece_id") -> Column:
    return F.element_at(lits(FORMS), (F.col(piece) % len(FORMS) + 1).cast("int"))


def events(n: DataFrame) -> DataFrame:
    """piece_id, voice, note, tick, kind, token: cadences (0), bars (1), subject starts (2), notes (3) and subject ends (4); bars and cadences have voice -1."""
    ends = n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).cast("bigint").alias("m"))
    every = lambda c: c.select("piece_id", "voice", F.col("note").cast("bigint").alias("note"), F.col("tick").cast("bigint").alias("tick"), "kind", "token")
    none = {"voice": F.lit(-1), "note": F.lit(-1)}
    bars = ends.select("piece_id", F.explode(F.expr(f"sequence(0L, m - 1, {BAR}L)")).alias("tick")).withColumns(none | {"kind": F.lit(1), "token": F.lit("BAR")})
    found = scoring.cadences(n).join(ends, "piece_id").filter("tick < m").select("piece_id", "tick", F.col("label").alias("token")).withColumns(none | {"kind": F.lit(0)})
    sung = n.select("piece_id", "voice", F.col("note_idx").alias("note"), F.col("start").alias("tick"), F.lit(3).alias("kind"), F.concat_ws("_", F.lit("N"), F.col("voice").cast("string"), F.col("pitch").cast("string"), F.col("dur").cast("string")).alias("token"))
    marked = entries(n, bar_of()).filter(F.col("piece_id") % len(FORMS) < WITH_SUBJECT)
    both = F.array(F.struct(F.col("place").alias("note"), F.lit(2).alias("kind"), F.lit("SUBJECT_START").alias("token")), F.struct((F.col("free") - 1).alias("note"), F.lit(4).alias("kind"), F.lit("SUBJECT_END").alias("token")))
    marks = marked.select("piece_id", "voice", F.explode(both).alias("m")).select("piece_id", "voice", "m.*").join(sung.select("piece_id", "voice", "note", "tick"), ["piece_id", "voice", "note"])
    return every(bars).unionByName(every(found)).unionByName(every(sung)).unionByName(every(marks))


def encoded(n: DataFrame) -> DataFrame:
    """piece_id, encoding, pos, token: each piece interleaved by time, and voice by voice without bars and cadences, behind its encoding and form."""
    e = events(n).withColumn("encoding", F.explode(F.when(F.col("voice") < 0, F.array(F.lit("interleaved"))).otherwise(F.array(F.lit("interleaved"), F.lit("sequential")))))
    by_time = F.col("encoding") == "interleaved"
    w = W.partitionBy("piece_id", "encoding").orderBy("first", "second", "note", "kind")
    at = e.withColumn("first", F.when(by_time, F.col("tick")).otherwise(F.col("voice"))).withColumn("second", F.when(by_time, F.col("voice")).otherwise(F.col("tick")))
    body = at.select("piece_id", "encoding", (F.row_number().over(w) + 1).alias("pos"), "token")
    pieces = n.select("piece_id").distinct().withColumn("encoding", F.explode(lits(["interleaved", "sequential"])))
    head = pieces.select("piece_id", "encoding", F.posexplode(F.array(F.concat(F.lit("ENCODE_"), F.upper("encoding")), F.concat(F.lit("FORM_"), F.upper(form())))).alias("pos", "token"))
    return head.unionByName(body)


def piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(notes(spark, sf_dir))


def sequence_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and encoding of each sequence, read back from the first of such tokens; chorale and interleaved where there is none."""
    s = encoded(notes(spark, sf_dir)).filter(F.col("token").startswith("FORM_") | F.col("token").startswith("ENCODE_"))
    first = lambda p: F.min_by(F.lower(F.substring("token", len(p) + 1, 40)), F.when(F.col("token").startswith(p), F.col("pos")))
    return s.groupBy("piece_id", "encoding").agg(F.coalesce(first("FORM_"), F.lit("chorale")).alias("form"), F.coalesce(first("ENCODE_"), F.lit("interleaved")).alias("mode"))


def category(token: Column) -> Column:
    return F.when(token.rlike("^(FORM|ENCODE)_"), "conditioning").when(token.startswith("CAD_"), "cadence").when(token.startswith("SUBJECT_"), "subject").when(token.startswith("N_"), "note").when(token == "BAR", "time").otherwise("other")


def token_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all sequences by category and encoding."""
    return encoded(notes(spark, sf_dir)).groupBy("encoding", category(F.col("token")).alias("category")).agg(F.count(F.lit(1)).alias("tokens"), F.countDistinct("token").alias("kinds"))


def quantize(n: DataFrame) -> DataFrame:
    """Notes on a grid of sixteenths, those within 40 ticks of a bar line on it, at least a sixteenth long, at velocity 64; of equal ones the longest stays."""
    bar = F.bround(F.col("start") / BAR, 0) * BAR
    on = F.when(F.abs(F.col("start") - bar) <= PULL, bar).otherwise(F.bround(F.col("start") / GRID, 0) * GRID).cast("bigint")
    long = F.greatest(F.lit(GRID), F.bround(F.col("dur") / GRID, 0) * GRID).cast("bigint")
    return n.groupBy("piece_id", "voice", on.alias("start"), "pitch").agg(F.max(long).alias("dur"), F.lit(64).alias("velocity"))


def quantized_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that were played up to 40 ticks early or late, put back on the grid."""
    return quantize(notes(spark, sf_dir).withColumn("start", F.greatest(F.lit(0), F.col("start") + F.col("event_id") * 37 % 81 - 40)))


def triaged(n: DataFrame, least: int = 16, most_voices: int = 4) -> DataFrame:
    """piece_id, notes, overlapping, voices_used, status: bad (too few notes), voices to be separated, voices to be reduced, or clean."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "event_id")
    p = n.withColumn("over", F.lead("start").over(w) < F.col("start") + F.col("dur"))
    p = p.groupBy("piece_id").agg(F.count(F.lit(1)).alias("notes"), F.countDistinct("voice").alias("voices_used"), F.count_if("over").alias("overlapping"))
    status = F.when(F.col("notes") < least, "bad").when(F.col("overlapping") * 4 > F.col("notes"), "needs_voice_sep").when(F.col("voices_used") > most_voices, "needs_voice_reduce").otherwise("clean")
    return p.select("piece_id", "notes", "overlapping", "voices_used", status.alias("status"))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each piece needs before it can be used."""
    return triaged(notes(spark, sf_dir, shifted=True)).drop("voices_used")


def reduced(n: DataFrame, k: int) -> DataFrame:
    """Pieces in k voices at most: voices by mean pitch from the highest down, in k equal groups; of notes that start together the outer one stays, and each ends where the next begins."""
    return in_parts(n, k).select("piece_id", F.col("part").alias("voice"), "start", "dur", "pitch", F.monotonically_increasing_id().alias("event_id"))


def in_parts(n: DataFrame, k: int) -> DataFrame:
    mean = n.groupBy("piece_id", "voice").agg(F.round(F.avg("pitch"), 9).alias("mean"))
    w = W.partitionBy("piece_id")
    group = mean.select("piece_id", "voice", F.floor((F.row_number().over(w.orderBy(F.desc("mean"), "voice")) - 1) * k / F.count(F.lit(1)).over(w)).cast("int").alias("part"))
    outer = F.when(F.col("part") == 0, F.col("pitch")).otherwise(-F.col("pitch"))
    kept = n.join(group, ["piece_id", "voice"]).groupBy("piece_id", "part", "start").agg(F.max(F.struct(outer.alias("o"), "dur", "pitch")).alias("b"))
    nxt = F.lead("start").over(W.partitionBy("piece_id", "part").orderBy("start"))
    return kept.select("piece_id", "part", "start", F.least(F.col("b.dur").cast("bigint"), F.coalesce(nxt - F.col("start"), F.col("b.dur").cast("bigint"))).cast("bigint").alias("dur"), F.col("b.pitch").alias("pitch"))


def reduce_voices(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    return in_parts(notes(spark, sf_dir), k)


QUERIES = {f.__name__: f for f in (piece_tokens, sequence_settings, token_categories, quantized_notes, triage, reduce_voices)}

ENCODED_SQL = f"""{CADENCES_SQL}, {ENTRY_SQL}, {SCAN_SQL}, mx AS (SELECT piece_id, CAST(max(start + dur) AS BIGINT) AS m FROM n GROUP BY 1),
ev AS (SELECT piece_id, unnest(range(0, m, 1920)) AS tick, -1 AS voice, -1 AS note, 1 AS kind, 'BAR' AS token FROM mx UNION ALL SELECT cv.piece_id, tick, -1, -1, 0, label FROM cv JOIN mx ON mx.piece_id = cv.piece_id WHERE tick < m
 UNION ALL SELECT piece_id, start, voice, note_idx, 3, 'N_' || voice || '_' || pitch || '_' || dur FROM n UNION ALL SELECT en.piece_id, n.start, en.voice, n.note_idx, 2, 'SUBJECT_START' FROM en JOIN n ON n.piece_id = en.piece_id AND n.voice = en.voice AND n.note_idx = en.place WHERE en.piece_id % 5 < 3
 UNION ALL SELECT en.piece_id, n.start, en.voice, n.note_idx, 4, 'SUBJECT_END' FROM en JOIN n ON n.piece_id = en.piece_id AND n.voice = en.voice AND n.note_idx = en.free - 1 WHERE en.piece_id % 5 < 3),
ec AS (SELECT piece_id, 'interleaved' AS encoding, row_number() OVER (PARTITION BY piece_id ORDER BY tick, voice, note, kind) + 1 AS pos, token FROM ev UNION ALL SELECT piece_id, 'sequential', row_number() OVER (PARTITION BY piece_id ORDER BY voice, tick, note, kind) + 1, token FROM ev WHERE voice >= 0
 UNION ALL SELECT piece_id, e, 0, 'ENCODE_' || upper(e) FROM mx, (SELECT unnest(['interleaved', 'sequential']) AS e) UNION ALL SELECT piece_id, e, 1, 'FORM_' || upper(({FORMS})[CAST(piece_id % 5 AS INT) + 1]) FROM mx, (SELECT unnest(['interleaved', 'sequential']) AS e))"""
SQL = {
    "piece_tokens": f"WITH RECURSIVE {NOTES_SQL}, {ENCODED_SQL} SELECT piece_id, encoding, CAST(pos AS INT) AS pos, token FROM ec",
    "sequence_settings": f"WITH RECURSIVE {NOTES_SQL}, {ENCODED_SQL} SELECT piece_id, encoding, coalesce(arg_min(lower(token[6:]), pos) FILTER (starts_with(token, 'FORM_')), 'chorale') AS form, coalesce(arg_min(lower(token[8:]), pos) FILTER (starts_with(token, 'ENCODE_')), 'interleaved') AS mode FROM ec GROUP BY 1, 2",
    "token_categories": f"WITH RECURSIVE {NOTES_SQL}, {ENCODED_SQL} SELECT encoding, CASE split_part(token, '_', 1) WHEN 'FORM' THEN 'conditioning' WHEN 'ENCODE' THEN 'conditioning' WHEN 'CAD' THEN 'cadence' WHEN 'SUBJECT' THEN 'subject' WHEN 'N' THEN 'note' WHEN 'BAR' THEN 'time' ELSE 'other' END AS category, count(*) AS tokens, count(DISTINCT token) AS kinds FROM ec GROUP BY 1, 2",
    "quantized_notes": f"WITH {NOTES_SQL}, j AS (SELECT piece_id, voice, pitch, dur, greatest(0, start + event_id * 37 % 81 - 40) AS s FROM n), q AS (SELECT piece_id, voice, pitch, CAST(greatest(120, round_even(dur / 120.0, 0) * 120) AS BIGINT) AS dur, CAST(CASE WHEN abs(s - round_even(s / 1920.0, 0) * 1920) <= 40 THEN round_even(s / 1920.0, 0) * 1920 ELSE round_even(s / 120.0, 0) * 120 END AS BIGINT) AS start FROM j) SELECT piece_id, voice, start, pitch, max(dur) AS dur, CAST(64 AS INT) AS velocity FROM q GROUP BY 1, 2, 3, 4",
    "triage": f"WITH {NOTES_SQL}, o AS (SELECT *, lead(start) OVER (PARTITION BY piece_id, voice ORDER BY start, event_id) < start + dur AS over FROM n2), p AS (SELECT piece_id, count(*) AS notes, count(DISTINCT voice) AS voices, count(*) FILTER (over) AS overlapping FROM o GROUP BY 1) SELECT piece_id, notes, overlapping, CASE WHEN notes < 16 THEN 'bad' WHEN overlapping * 4 > notes THEN 'needs_voice_sep' WHEN voices > 4 THEN 'needs_voice_reduce' ELSE 'clean' END AS status FROM p",
    "reduce_voices": f"WITH {NOTES_SQL}, m AS (SELECT piece_id, voice, round(avg(pitch), 9) AS mean FROM n GROUP BY 1, 2), g AS (SELECT piece_id, voice, CAST((row_number() OVER (PARTITION BY piece_id ORDER BY mean DESC, voice) - 1) * 2 // count(*) OVER (PARTITION BY piece_id) AS INT) AS part FROM m), k AS (SELECT n.piece_id, part, start, dur, pitch, row_number() OVER (PARTITION BY n.piece_id, part, start ORDER BY CASE WHEN part = 0 THEN -pitch ELSE pitch END, dur DESC) AS r FROM n JOIN g ON g.piece_id = n.piece_id AND g.voice = n.voice) SELECT piece_id, part, start, CAST(least(dur, coalesce(lead(start) OVER (PARTITION BY piece_id, part ORDER BY start) - start, dur)) AS BIGINT) AS dur, pitch FROM k WHERE r = 1",
}
