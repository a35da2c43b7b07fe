"""The subject of a piece, its entries in all voices, and how much of it comes back later.

The subject is the first phrase of the voice that enters first: notes that begin within two bars of its first note, up to the first
gap of a quarter or more once three notes are taken. A voice is monophonic and no note is shorter than 60 ticks, so a subject of two bars
of at most 1920 ticks holds at most 65 notes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.plans.views import NOTES_SQL, notes

BAR, QUARTER, LONGEST = 1920, 480, 65
# Weights of kinds of returns, least share of a subject and least quality of an entry.
EXACT, INVERTED, BACKWARDS, NEAR = 1.0, 0.85, 0.60, 0.28
LEAST_SHARE, LEAST_QUALITY, LEAST_NOTES = 0.70, 0.80, 4
# End of fixed values.


def bar_of(piece: str = "piece_id") -> Column:
    """Ticks of a bar: the pieces of the fixture are in 4/4, 3/4 and 6/8 by turns."""
    return F.when(F.col(piece) % 3 == 0, BAR).otherwise(1440)


def subject_notes(n: DataFrame, bar: Column) -> DataFrame:
    """piece_id, voice, pos (from 0), start, dur, pitch of each subject's notes; the lowest voice on ties."""
    first = n.groupBy("piece_id").agg(F.min(F.struct("start", "voice")).alias("f"))
    near = n.join(first, "piece_id").filter((F.col("voice") == F.col("f.voice")) & (F.col("start") <= F.col("f.start") + 2 * bar))
    w = W.partitionBy("piece_id").orderBy("start", "note_idx")
    # the note behind the last one of the two bars can't matter: a gap before it ends the subject where the two bars end it too
    gap = F.lead("start").over(w) - F.col("start") - F.col("dur")
    x = near.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("stop", F.when((gap >= QUARTER) & (F.col("pos") >= 2), 1).otherwise(0))
    ended = F.coalesce(F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("ended", ended).filter("ended = 0").select("piece_id", "voice", "pos", "start", "dur", "pitch")


def subject_steps(n: DataFrame, bar: Column) -> DataFrame:
    """piece_id, subject_voice, steps: the intervals of the subject as an array of at most 64."""
    s = subject_notes(n, bar).groupBy("piece_id", F.col("voice").alias("subject_voice")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pitch"))), lambda x: x["pitch"]).alias("p"))
    return s.select("piece_id", "subject_voice", F.zip_with(F.slice("p", 2, LONGEST), F.slice("p", 1, F.size("p") - 1), lambda b, a: b - a).alias("steps"))


def following(n: DataFrame, k: int) -> DataFrame:
    """Notes with `ahead`, the next k intervals of their voice (fewer at its end)."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    return n.withColumn("_i", F.lead("pitch").over(w) - F.col("pitch")).withColumn("ahead", F.collect_list("_i").over(w.rowsBetween(0, k - 1))).drop("_i")


def best_length(ahead: Column, steps: Column) -> Column:
    """Struct (quality, notes) of the best candidate at a note: the highest share of intervals that agree with the subject's
    (the first three may be off by one), of the lengths from 70 % of the subject (four notes at least) up; the shortest on ties."""
    least = F.greatest(F.lit(LEAST_NOTES), F.ceil((F.size(steps) + 1) * LEAST_SHARE).cast("int"))
    hits = F.transform(F.arrays_zip(F.slice(ahead, F.lit(1), F.size(steps)).alias("a"), F.slice(steps, F.lit(1), F.size(ahead)).alias("b")), lambda x, i: F.when(F.abs(x["a"] - x["b"]) <= F.when(i < 3, 1).otherwise(0), 1).otherwise(0))
    start = F.struct(F.lit(0).alias("hits"), F.lit(1).alias("n"), F.lit(0.0).alias("quality"), F.lit(0).alias("notes"))

    def longer(acc: Column, hit: Column) -> Column:
        got, count = acc["hits"] + hit, acc["n"] + 1
        better = (count >= least) & (got / acc["n"] > acc["quality"])
        return F.struct(got.alias("hits"), count.alias("n"), F.when(better, got / acc["n"]).otherwise(acc["quality"]).alias("quality"), F.when(better, count).otherwise(acc["notes"]).alias("notes"))

    return F.aggregate(hits, start, longer, lambda acc: F.struct(acc["quality"].alias("quality"), acc["notes"].alias("notes")))


def entry_candidates(n: DataFrame, bar: Column) -> DataFrame:
    """Places at which an entry could begin: piece_id, voice, place (in the voice), free (the place behind it), notes, quality and bounds."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    ahead = following(n, LONGEST - 1).withColumn("place", (F.row_number().over(w) - 1).cast("bigint")).withColumn("ends", F.collect_list((F.col("start") + F.col("dur")).cast("bigint")).over(w.rowsBetween(0, LONGEST - 1)))
    steps = subject_steps(n, bar).filter(F.size("steps") >= LEAST_NOTES - 1)
    x = ahead.join(steps, "piece_id").withColumn("b", best_length(F.col("ahead"), F.col("steps"))).filter(F.col("b.quality") >= LEAST_QUALITY)
    return x.select("piece_id", "voice", "place", (F.col("place") + F.col("b.notes")).alias("free"), F.col("b.notes").alias("notes"), F.round("b.quality", 9).alias("quality"), F.col("start").cast("bigint").alias("start"), F.element_at("ends", F.col("b.notes")).alias("until"), ((F.col("voice") == F.col("subject_voice")) & (F.col("place") == 0)).alias("exposition"))


def apart(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that begin (`place`) where the row kept before them leaves room (`free`) or later.

    Parts come by piece, voice and `place`; only the last kept row of a voice is held.
    """
    voice, room = None, None
    for part in parts:
        keep = []
        for i, (piece, v, at, free) in enumerate(zip(part["piece_id"], part["voice"], part["place"], part["free"], strict=True)):
            if (piece, v) != voice or at >= room:
                voice, room = (piece, v), free
                keep.append(i)
        yield part.iloc[keep]


def greedy(c: DataFrame) -> DataFrame:
    """The candidates that a scan from left to right takes in each voice; the order decides, so a window can't."""
    return c.repartition("piece_id", "voice").sortWithinPartitions("piece_id", "voice", "place").mapInPandas(apart, c.schema)


def entries(n: DataFrame, bar: Column) -> DataFrame:
    """Entries of the subject. Its first statement agrees with itself, so it is always among them, marked as exposition."""
    return greedy(entry_candidates(n, bar))


def likeness(own: Column, steps: Column, k: int) -> Column:
    """The weight of k intervals by the strongest way in which a fragment of `steps` agrees with them, 0 if none does."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - k + 1, F.lit(1))), lambda i: F.slice(steps, i, F.lit(k)))
    near = F.exists(parts, lambda p: F.forall(F.zip_with(p, own, lambda a, b: F.abs(a - b)), lambda d: d <= 1))
    kind = F.when(F.array_contains(parts, own), EXACT).when(F.array_contains(parts, F.transform(own, lambda v: -v)), INVERTED)
    return kind.when(F.array_contains(parts, F.reverse(own)), BACKWARDS).when(near, NEAR).otherwise(0.0)


def returns(n: DataFrame) -> DataFrame:
    """Places after the first quarter of a piece at which four to six intervals (three, if the subject has no more) are a fragment of the subject:
    as it is, inverted, backwards or within one; `weight` is the strongest, `place` the tick and `free` a bar later."""
    span = n.groupBy("piece_id").agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("dur")).alias("hi"))
    late = F.col("start") >= F.col("lo") + (F.col("hi") - F.col("lo")) * 0.25
    steps = subject_steps(n, F.lit(BAR)).filter(F.size("steps") >= 3)
    x = following(n, 6).join(steps, "piece_id").join(span, "piece_id").filter(late & F.exists("steps", lambda s: s != 0))
    m, weight = F.size("steps"), F.lit(0.0)
    for k in (3, 4, 5, 6):
        own = F.slice("ahead", 1, k)
        asked = (F.size(own) == k) & (k >= F.least(m, F.lit(4))) & (k <= m)
        weight = F.greatest(weight, F.when(asked, likeness(own, F.col("steps"), k)).otherwise(0.0))
    found = x.select("piece_id", "voice", F.col("start").cast("bigint").alias("place"), (F.col("start") + BAR).cast("bigint").alias("free"), weight.alias("weight"))
    return found.filter("weight > 0")


def recall(n: DataFrame) -> DataFrame:
    """piece_id and recall for every piece: 0.3 for subjects of less than four notes, 0 for those that stay on one pitch."""
    hit = greedy(returns(n))
    count = lambda v: F.count_if(F.col("weight") == v)
    per = hit.groupBy("piece_id").agg(count(EXACT).alias("e"), count(INVERTED).alias("i"), count(BACKWARDS).alias("r"), count(NEAR).alias("a"), F.countDistinct("voice").alias("v"))
    w = F.col("e") * EXACT + F.col("i") * INVERTED + F.col("r") * BACKWARDS + F.least(F.lit(2), F.col("a")) * NEAR
    base = F.when(w < 0.25, 0.0).when(w < 1, 0.12 + 0.28 * (w - 0.25)).when(w < 2, 0.33 + 0.20 * (w - 1)).when(w < 3.5, 0.53 + 0.14 * (w - 2)).otherwise(0.74)
    score = base + F.when(F.col("v") >= 3, 0.16).when(F.col("v") >= 2, 0.10).otherwise(0.0)
    cap = F.least(F.when(F.col("e") + F.col("i") == 0, 0.62).otherwise(1.0), F.when(F.col("e") + F.col("i") + F.col("r") == 0, 0.48).otherwise(1.0), F.when(F.col("v") <= 1, 0.80).otherwise(1.0))
    scored = per.select("piece_id", F.least(score, cap).alias("s"))
    short = subject_steps(n, F.lit(BAR)).select("piece_id", (F.size("steps") < 3).alias("short"))
    return short.join(scored, "piece_id", "left").select("piece_id", F.round(F.when(F.col("short"), 0.3).otherwise(F.coalesce("s", F.lit(0.0))), 9).alias("recall"))


def subject_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of each subject, on voices with gaps and overlaps."""
    return subject_notes(notes(spark, sf_dir, shifted=True), bar_of())


def subject_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places at which an entry could begin, with its length in notes and quality."""
    return entry_candidates(notes(spark, sf_dir), bar_of()).select("piece_id", "voice", "place", "notes", "quality")


def subject_entries_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(notes(spark, sf_dir), bar_of()).select("piece_id", "voice", "place", "notes", "quality", "start", "until", "exposition")


def subject_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes before which a subject marker opens and behind which one closes."""
    e = entries(notes(spark, sf_dir), bar_of())
    both = F.array(F.struct(F.col("place").alias("note"), F.lit("SUBJECT_START").alias("marker")), F.struct((F.col("free") - 1).alias("note"), F.lit("SUBJECT_END").alias("marker")))
    return e.select("piece_id", "voice", F.explode(both).alias("m")).select("piece_id", "voice", "m.note", "m.marker")


def subject_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, pieces that hold them and the share of entries that follow the exposition, by mode of the piece."""
    mode = F.when(F.col("piece_id") % 2 == 0, "major").otherwise("minor").alias("mode")
    e = entries(notes(spark, sf_dir), bar_of())
    return e.groupBy(mode).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("piece_id").alias("pieces"), F.round(F.avg(F.when(F.col("exposition"), 0.0).otherwise(1.0)), 9).alias("later"))


def thematic_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall(notes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (subject_phrases, subject_candidates, subject_entries_greedy, subject_markers, subject_density, thematic_recall)}


def phrase_sql(n: str, bar: str, p: str) -> str:
    """{p}s: the subjects' notes; {p}i: their intervals by place; {p}m: intervals a piece."""
    return f"""{p}f AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY start, voice) AS r, min(start) OVER (PARTITION BY piece_id) AS lo FROM {n}),
{p}v AS (SELECT x.piece_id, x.voice, x.start, x.dur, x.pitch, row_number() OVER w AS k, lead(x.start) OVER w - x.start - x.dur AS gap FROM {n} x JOIN {p}f f ON f.piece_id = x.piece_id AND f.r = 1 AND f.voice = x.voice WHERE x.start <= f.lo + 2 * {bar} WINDOW w AS (PARTITION BY x.piece_id ORDER BY x.start, x.note_idx)),
{p}s AS (SELECT piece_id, voice, CAST(k - 1 AS INT) AS pos, start, dur, pitch FROM {p}v a WHERE NOT EXISTS (SELECT 1 FROM {p}v b WHERE b.piece_id = a.piece_id AND b.k < a.k AND b.k >= 3 AND b.gap >= 480)),
{p}i AS (SELECT a.piece_id, a.voice, a.pos AS k, b.pitch - a.pitch AS d FROM {p}s a JOIN {p}s b ON a.piece_id = b.piece_id AND b.pos = a.pos + 1), {p}m AS (SELECT piece_id, voice, count(*) AS m FROM {p}i GROUP BY 1, 2),
{p}n AS (SELECT *, row_number() OVER w - 1 AS place, lead(pitch) OVER w - pitch AS ivl FROM {n} WINDOW w AS (PARTITION BY piece_id, voice ORDER BY start, note_idx))"""


#: Places and their next free places as a chain: each row names the first candidate that its entry leaves room for.
SCAN_SQL = """nx AS (SELECT c.*, (SELECT min(d.place) FROM cn d WHERE d.piece_id = c.piece_id AND d.voice = c.voice AND d.place >= c.free) AS nxt FROM cn c),
en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, voice ORDER BY place) AS r FROM nx) WHERE r = 1 UNION ALL SELECT nx.*, 0 AS r FROM en JOIN nx ON nx.piece_id = en.piece_id AND nx.voice = en.voice AND nx.place = en.nxt)"""
ENTRY_SQL = f"""{phrase_sql("n", "CASE WHEN x.piece_id % 3 = 0 THEN 1920 ELSE 1440 END", "s")},
hi AS (SELECT a.piece_id, a.voice, a.place, i.k, CASE WHEN abs(b.ivl - i.d) <= CASE WHEN i.k < 3 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END AS hit FROM sn a JOIN si i ON i.piece_id = a.piece_id JOIN sn b ON b.piece_id = a.piece_id AND b.voice = a.voice AND b.place = a.place + i.k WHERE b.ivl IS NOT NULL),
ql AS (SELECT *, avg(hit) OVER (PARTITION BY piece_id, voice, place ORDER BY k) AS q FROM hi),
bl AS (SELECT ql.piece_id, ql.voice, place, k, q, row_number() OVER (PARTITION BY ql.piece_id, ql.voice, place ORDER BY round(q, 9) DESC, k) AS r FROM ql JOIN sm ON sm.piece_id = ql.piece_id WHERE m >= 3 AND k + 2 >= greatest(4, ceil((m + 1) * 0.7))),
cn AS (SELECT bl.piece_id, bl.voice, bl.place, bl.place + k + 2 AS free, CAST(k + 2 AS INT) AS notes, round(q, 9) AS quality, a.start, b.start + b.dur AS until, bl.voice = sm.voice AND bl.place = 0 AS exposition FROM bl JOIN sm ON sm.piece_id = bl.piece_id JOIN sn a ON a.piece_id = bl.piece_id AND a.voice = bl.voice AND a.place = bl.place JOIN sn b ON b.piece_id = bl.piece_id AND b.voice = bl.voice AND b.place = bl.place + k + 1 WHERE r = 1 AND round(q, 9) >= 0.8)"""
FRAGMENTS_SQL = ", ".join(f"[{', '.join(f'lead(ivl, {j}) OVER w' for j in range(k))}] AS g{k}" for k in (3, 4, 5, 6))
#: tr: the recall of each piece. Needs WITH RECURSIVE.
RECALL_SQL = f"""{phrase_sql("n", "1920", "t")}, td AS (SELECT piece_id, list(d ORDER BY k) AS s FROM ti GROUP BY 1 HAVING max(abs(d)) > 0),
tg AS (SELECT *, lead(ivl, 2) OVER w AS i3, lead(ivl, 3) OVER w AS i4, lead(ivl, 4) OVER w AS i5, lead(ivl, 5) OVER w AS i6, {FRAGMENTS_SQL} FROM tn WINDOW w AS (PARTITION BY piece_id, voice ORDER BY start, note_idx)),
tb AS (SELECT piece_id, min(start) + (max(start + dur) - min(start)) * 0.25 AS cut FROM n GROUP BY 1),
th AS (SELECT piece_id, voice, start, k, s, CASE k WHEN 3 THEN g3 WHEN 4 THEN g4 WHEN 5 THEN g5 ELSE g6 END AS g FROM (SELECT *, unnest([3, 4, 5, 6]) AS k FROM tg JOIN td USING (piece_id) JOIN tb USING (piece_id) WHERE start >= cut AND len(s) >= 3) WHERE k >= least(len(s), 4) AND k <= len(s) AND CASE k WHEN 3 THEN i3 WHEN 4 THEN i4 WHEN 5 THEN i5 ELSE i6 END IS NOT NULL),
tp AS (SELECT *, list_transform(range(1, len(s) - k + 2), lambda i: s[i:i + k - 1]) AS parts FROM th),
tk AS (SELECT piece_id, voice, start, max(CASE WHEN list_contains(parts, g) THEN 1.0 WHEN list_contains(parts, list_transform(g, lambda x: -x)) THEN 0.85 WHEN list_contains(parts, list_reverse(g)) THEN 0.60
 WHEN len(list_filter(parts, lambda p: len(list_filter(list_zip(p, g), lambda z: abs(z[1] - z[2]) > 1)) = 0)) > 0 THEN 0.28 ELSE 0.0 END) AS weight FROM tp GROUP BY 1, 2, 3),
tc AS (SELECT piece_id, voice, start AS place, weight FROM tk WHERE weight > 0), tx AS (SELECT c.*, (SELECT min(d.place) FROM tc d WHERE d.piece_id = c.piece_id AND d.voice = c.voice AND d.place >= c.place + 1920) AS nxt FROM tc c),
te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, voice ORDER BY place) AS r FROM tx) WHERE r = 1 UNION ALL SELECT tx.*, 0 AS r FROM te JOIN tx ON tx.piece_id = te.piece_id AND tx.voice = te.voice AND tx.place = te.nxt),
tq AS (SELECT piece_id, count(*) FILTER (weight = 1.0) AS e, count(*) FILTER (weight = 0.85) AS i, count(*) FILTER (weight = 0.60) AS b, least(2, count(*) FILTER (weight = 0.28)) AS a, count(DISTINCT voice) AS v FROM te GROUP BY 1),
tw AS (SELECT *, e + 0.85 * i + 0.60 * b + 0.28 * a AS w FROM tq),
ty AS (SELECT piece_id, least(CASE WHEN w < 0.25 THEN 0 WHEN w < 1 THEN 0.05 + 0.28 * w WHEN w < 2 THEN 0.13 + 0.20 * w WHEN w < 3.5 THEN 0.25 + 0.14 * w ELSE 0.74 END + CASE WHEN v >= 3 THEN 0.16 WHEN v = 2 THEN 0.10 ELSE 0 END,
 CASE WHEN e + i = 0 THEN 0.62 ELSE 1 END, CASE WHEN e + i + b = 0 THEN 0.48 ELSE 1 END, CASE WHEN v = 1 THEN 0.80 ELSE 1 END) AS score FROM tw),
tr AS (SELECT piece_id, CAST(round(CASE WHEN coalesce(m, 0) < 3 THEN 0.3 ELSE coalesce(score, 0) END, 9) AS DOUBLE) AS recall FROM (SELECT DISTINCT piece_id FROM n) LEFT JOIN tm USING (piece_id) LEFT JOIN ty USING (piece_id))"""
SQL = {
    "subject_phrases": f"WITH {NOTES_SQL}, {phrase_sql('n2', 'CASE WHEN x.piece_id % 3 = 0 THEN 1920 ELSE 1440 END', 's')} SELECT * FROM ss",
    "subject_candidates": f"WITH {NOTES_SQL}, {ENTRY_SQL} SELECT piece_id, voice, place, notes, quality FROM cn",
    "subject_entries_greedy": f"WITH RECURSIVE {NOTES_SQL}, {ENTRY_SQL}, {SCAN_SQL} SELECT piece_id, voice, place, notes, quality, start, until, exposition FROM en",
    "subject_markers": f"WITH RECURSIVE {NOTES_SQL}, {ENTRY_SQL}, {SCAN_SQL} SELECT piece_id, voice, place AS note, 'SUBJECT_START' AS marker FROM en UNION ALL SELECT piece_id, voice, free - 1, 'SUBJECT_END' FROM en",
    "subject_density": f"WITH RECURSIVE {NOTES_SQL}, {ENTRY_SQL}, {SCAN_SQL} SELECT CASE WHEN piece_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, count(*) AS entries, count(DISTINCT piece_id) AS pieces, round(avg(CASE WHEN exposition THEN 0.0 ELSE 1.0 END), 9) AS later FROM en GROUP BY 1",
    "thematic_recall": f"WITH RECURSIVE {NOTES_SQL}, {RECALL_SQL} SELECT * FROM tr",
}
