"""Distributions of pitches, intervals and durations, corpus statistics, keys and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import DURATIONS, HARMONIC_MINOR, MAJOR, PROFILE_MAJOR, PROFILE_MINOR, correlation, interval_kind, lits, nearest_bin, pitch_class
from quaverlake.operators.runs import degree_parts
from quaverlake.plans.views import NOTES_SQL, key_mode, key_root, notes, table

assert len(MAJOR) == len(HARMONIC_MINOR)


def with_steps(n: DataFrame) -> DataFrame:
    """Notes with the interval to the previous note of the voice and the one before that."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    steps = n.withColumn("ivl", F.col("pitch") - F.lag("pitch").over(w))
    return steps.withColumn("before", F.lag("ivl").over(w))


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """piece_id, bin, p: every bin of every piece, shares of the values that aren't null, equal shares if there are none."""
    counted = rows.select("piece_id", value.cast("int").alias("bin")).groupBy("piece_id").pivot("bin", list(range(bins))).count()
    dense = counted.select("piece_id", F.posexplode(F.array(*(F.coalesce(F.col(f"`{b}`"), F.lit(0)) for b in range(bins)))).alias("bin", "c"))
    total = F.sum("c").over(W.partitionBy("piece_id"))
    return dense.select("piece_id", "bin", F.round(F.when(total > 0, F.col("c") / total).otherwise(1.0 / bins), 9).alias("p"))


def clipped(ivl: Column) -> Column:
    """Bin 0 to 24 of an interval, null for none (greatest and least would pass over the null)."""
    return F.when(ivl.isNotNull(), F.least(F.greatest(ivl, F.lit(-12)), F.lit(12)) + 12)


def pitch_class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(notes(spark, sf_dir), pitch_class(F.col("pitch")), 12)


def interval_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(with_steps(notes(spark, sf_dir)), clipped(F.col("ivl")), 25)


def duration_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(notes(spark, sf_dir), nearest_bin(F.col("dur")), 11)


def interval_bigram_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_steps(notes(spark, sf_dir)).filter("before is not null")
    return histogram(s, interval_kind(F.col("before")) * 5 + interval_kind(F.col("ivl")), 25)


def scale_degree_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note by its tonic-relative degree; notes off the scale (natural minor) count as the degree below, raised."""
    return histogram(notes(spark, sf_dir), degree_parts(F.col("pitch"), key_root(), key_mode())["degree"] - 1, 7)


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dist, bin, p over the whole corpus: one pass, each note giving a row for each of its distributions."""
    s = with_steps(notes(spark, sf_dir))
    rows = F.array(
        F.struct(F.lit("pitch_class_dist").alias("dist"), pitch_class(F.col("pitch")).alias("bin")),
        F.struct(F.lit("interval_dist").alias("dist"), clipped(F.col("ivl")).cast("int").alias("bin")),
        F.struct(F.lit("duration_dist").alias("dist"), nearest_bin(F.col("dur")).cast("int").alias("bin")),
        F.struct(F.lit("scale_degree_dist").alias("dist"), (degree_parts(F.col("pitch"), key_root(), key_mode())["degree"] - 1).cast("int").alias("bin")),
    )
    counts = s.select(F.explode(rows).alias("r")).select("r.*").filter("bin is not null").groupBy("dist", "bin").agg(F.count(F.lit(1)).alias("c"))
    return counts.select("dist", "bin", F.round(F.col("c") / (F.sum("c").over(W.partitionBy("dist")) + 1e-10), 9).alias("p"))


def key_of(counts: DataFrame, group: list[str]) -> DataFrame:
    """group, key_root, key_mode, corr: the best of 24 keys by correlation with its profile; roots ascend, major first on ties.

    counts: group and h, an array of twelve counts.
    """
    keys = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda r: F.array(F.struct(r.alias("root"), F.lit(0).alias("minor")), F.struct(r.alias("root"), F.lit(1).alias("minor"))))))
    tried = counts.select(*group, "h", keys.alias("k"))
    profile = F.when(F.col("k.minor") == 0, lits(PROFILE_MAJOR)).otherwise(lits(PROFILE_MINOR))
    rotated = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda pc: F.element_at(profile, (F.pmod(pc - F.col("k.root"), F.lit(12)) + 1).cast("int")))
    scored = tried.withColumn("corr", F.round(F.coalesce(correlation(F.transform("h", lambda x: x.cast("double")), rotated), F.lit(0.0)), 9))
    best = scored.groupBy(*group).agg(F.max(F.struct("corr", (-F.col("k.root") * 2 - F.col("k.minor")).alias("o"))).alias("b"))
    return best.select(*group, F.floor(-F.col("b.o") / 2).cast("int").alias("key_root"), F.when(F.col("b.o") % 2 == 0, "major").otherwise("minor").alias("key_mode"), F.col("b.corr").alias("corr"))


def class_counts(n: DataFrame, group: list[str]) -> DataFrame:
    return n.groupBy(*group).agg(F.array(*(F.count_if(F.col("pitch") % 12 == k) for k in range(12))).alias("h"))


def detect_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_of(class_counts(notes(spark, sf_dir), ["piece_id"]), ["piece_id"])


def modulation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 3840 ticks from a piece's first onset that hold at least four notes: their best key, if its correlation is above 0.5."""
    n = notes(spark, sf_dir)
    first = F.min("start").over(W.partitionBy("piece_id"))
    win = n.withColumn("win", F.floor((F.col("start") - first) / 3840))
    counts = class_counts(win, ["piece_id", "win"]).filter(F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x) >= 4)
    return key_of(counts, ["piece_id", "win"]).filter("corr > 0.5").select("piece_id", "win", "key_root", "key_mode")


def median_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).groupBy("piece_id", "voice").agg(F.percentile("dur", F.lit(0.5)).cast("double").alias("median_dur"))


def repeated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a voice's commonest cell of four intervals; 0 for voices of fewer than five notes."""
    return cell_ratios(notes(spark, sf_dir)).select("piece_id", "voice", F.round("rep", 9).alias("repeat_ratio"))


def cell_ratios(n: DataFrame, length: int = 4) -> DataFrame:
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    s = n.select("piece_id", "voice", *((F.lag("pitch", k).over(w) - F.lag("pitch", k + 1).over(w)).alias(f"i{k}") for k in range(length)))
    last = f"i{length - 1}"
    cells = s.groupBy("piece_id", "voice", *(f"i{k}" for k in range(length))).agg(F.count(F.lit(1)).alias("k"))
    whole = F.when(F.col(last).isNotNull(), F.col("k"))
    return cells.groupBy("piece_id", "voice").agg(F.coalesce(F.max(whole) / F.sum(whole), F.lit(0.0)).alias("rep"))


def accompaniment_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of five ratios (uncapped) that are high where the lowest voice accompanies; 0 with fewer than 24 low or 8 high notes."""
    n = notes(spark, sf_dir)
    per = n.groupBy("piece_id", "voice").agg(F.count(F.lit(1)).alias("c"), F.avg("pitch").alias("mean"), F.percentile("dur", F.lit(0.5)).alias("med"), F.avg(F.when(F.col("dur") <= 240, 1.0).otherwise(0.0)).alias("short"), F.max(F.col("start") + F.col("dur")).alias("end"))
    v = per.join(cell_ratios(n), ["piece_id", "voice"])
    row = F.struct("c", "med", "short", (F.col("c") / F.greatest(F.lit(1), F.ceil(F.col("end") / 1920))).alias("density"), "rep")
    ends = v.groupBy("piece_id").agg(F.min_by(row, F.struct("mean", "voice")).alias("low"), F.max_by(row, F.struct("mean", "voice")).alias("top"), F.count(F.lit(1)).alias("voices"))
    parts = [F.col("low.short") / 0.70, F.col("low.density") / 8, F.col("low.rep") / 0.20, F.col("top.med") / F.greatest(F.lit(1.0), F.col("low.med")) / 1.8, F.col("low.c") / F.col("top.c") / 1.5]
    mean = sum(parts[1:], parts[0]) / 5
    return ends.select("piece_id", F.round(F.when((F.col("low.c") < 24) | (F.col("top.c") < 8) | (F.col("voices") < 2), 0.0).otherwise(mean), 9).alias("severity"))


def nearest_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of quantities by return flag: by floor rank, by half-even rank and interpolated.

    Quantities are few, so ranks come from a histogram with running counts, not from sorted lists.
    """
    hist = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("l_returnflag").orderBy("l_quantity")
    ranked = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(W.partitionBy("l_returnflag")))
    out = []
    for q in (0.1, 0.5, 0.9):
        for name, rank in (("floor", F.floor((F.col("n") - 1) * q)), ("round", F.bround((F.col("n") - 1) * q, 0))):
            out.append(F.min(F.when(F.col("upto") > rank, F.col("l_quantity"))).alias(f"{name}_p{int(q * 100)}"))
        out.append(F.percentile("l_quantity", F.lit(q), F.col("c")).alias(f"linear_p{int(q * 100)}"))
    return ranked.groupBy("l_returnflag").agg(*out)


QUERIES = {f.__name__: f for f in (pitch_class_hist, interval_hist, duration_hist, interval_bigram_hist, scale_degree_hist, corpus_stats, detect_key, modulation_windows, median_duration, repeated_cells, accompaniment_severity, nearest_rank_pct)}

STEPS_SQL = """st0 AS (SELECT *, pitch - lag(pitch) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx) AS ivl FROM n),
st AS (SELECT *, lag(ivl) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx) AS before FROM st0)"""


def bin_sql(value: str) -> str:
    bins = ",".join(map(str, DURATIONS))
    return f"(SELECT i FROM (SELECT unnest([{bins}]) AS b, unnest(range(11)) AS i) ORDER BY abs(b - ({value})), i LIMIT 1)"


def hist_sql(source: str, value: str, bins: int) -> str:
    return f"""h AS (SELECT piece_id, {value} AS bin FROM {source}), d AS (SELECT p.piece_id, b.bin, count(h.bin) AS c FROM (SELECT DISTINCT piece_id FROM h) p CROSS JOIN (SELECT unnest(range({bins})) AS bin) b LEFT JOIN h ON h.piece_id = p.piece_id AND h.bin = b.bin GROUP BY 1, 2)
SELECT piece_id, CAST(bin AS INT) AS bin, round(CASE WHEN sum(c) OVER (PARTITION BY piece_id) > 0 THEN c * 1.0 / sum(c) OVER (PARTITION BY piece_id) ELSE 1.0 / {bins} END, 9) AS p FROM d"""


def kind_sql(c: str) -> str:
    return f"(CASE WHEN {c} <= -5 THEN 0 WHEN {c} < 0 THEN 1 WHEN {c} = 0 THEN 2 WHEN {c} <= 4 THEN 3 ELSE 4 END)"


def keys_sql(source: str, group: str) -> str:
    """Counts by class in `source` (group, pitch) to the best key of each group, as a query."""
    on = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in group.split(","))
    ga = ", ".join(f"a.{g.strip()}" for g in group.split(","))
    return f"""kc AS (SELECT {ga}, a.pcl, count(b.pitch) AS c FROM (SELECT {group}, pcl FROM (SELECT DISTINCT {group} FROM {source}), (SELECT unnest(range(12)) AS pcl)) a LEFT JOIN {source} b ON {on} AND b.pitch % 12 = a.pcl GROUP BY {ga}, a.pcl),
ky AS (SELECT r.root, m.minor FROM (SELECT unnest(range(12)) AS root) r, (SELECT unnest([0, 1]) AS minor) m),
sc AS (SELECT {group}, root, minor, round(coalesce(corr(c, CASE WHEN minor = 0 THEN ({PROFILE_MAJOR})[(pcl - root + 12) % 12 + 1] ELSE ({PROFILE_MINOR})[(pcl - root + 12) % 12 + 1] END), 0), 9) AS corr FROM kc, ky GROUP BY {group}, root, minor),
bk AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY corr DESC, root, minor) AS rk FROM sc)
SELECT {group}, CAST(root AS INT) AS key_root, CASE WHEN minor = 0 THEN 'major' ELSE 'minor' END AS key_mode, corr FROM bk WHERE rk = 1"""


def floor_rank(q: float) -> str:
    return f"max(CASE WHEN r = CAST(floor((n - 1) * {q}) AS BIGINT) THEN l_quantity END)"


def round_rank(q: float) -> str:
    return f"max(CASE WHEN r = CAST(round_even((n - 1) * {q}, 0) AS BIGINT) THEN l_quantity END)"


#: Steps of the natural scale up to a pitch, and the cells of four intervals of a voice with their counts.
DEGREE_SQL = "len(list_filter(CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,10] END, lambda q: q <= (pitch - key_root + 120) % 12))"
CELLS_SQL = """ce AS (SELECT piece_id, voice, coalesce(max(k) * 1.0 / sum(k), 0.0) AS rep FROM (SELECT piece_id, voice, CASE WHEN len(c) = 5 THEN count(*) END AS k FROM
 (SELECT piece_id, voice, CASE WHEN len(p) = 5 THEN list_transform(p, lambda x: x - p[1]) ELSE [0] END AS c FROM (SELECT piece_id, voice, list(pitch) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS p FROM n)) GROUP BY piece_id, voice, c) GROUP BY 1, 2)"""
SQL = {
    "pitch_class_hist": f"WITH {NOTES_SQL}, " + hist_sql("n", "pitch % 12", 12),
    "interval_hist": f"WITH {NOTES_SQL}, {STEPS_SQL}, " + hist_sql("st", "CASE WHEN ivl IS NOT NULL THEN least(greatest(ivl, -12), 12) + 12 END", 25),
    "duration_hist": f"WITH {NOTES_SQL}, " + hist_sql("(SELECT piece_id, bx FROM n JOIN (SELECT dur, " + bin_sql("dur") + " AS bx FROM (SELECT DISTINCT dur FROM n)) q USING (dur))", "bx", 11),
    "interval_bigram_hist": f"WITH {NOTES_SQL}, {STEPS_SQL}, " + hist_sql("(SELECT * FROM st WHERE before IS NOT NULL)", f"{kind_sql('before')} * 5 + {kind_sql('ivl')}", 25),
    "scale_degree_hist": f"WITH {NOTES_SQL}, " + hist_sql("(SELECT * FROM n JOIN pc USING (piece_id))", f"{DEGREE_SQL} - 1", 7),
    "corpus_stats": f"""WITH {NOTES_SQL}, {STEPS_SQL}, r AS (SELECT 'pitch_class_dist' AS dist, pitch % 12 AS bin FROM n UNION ALL SELECT 'interval_dist', least(greatest(ivl, -12), 12) + 12 FROM st WHERE ivl IS NOT NULL
UNION ALL SELECT 'duration_dist', list_position({DURATIONS}, dur) - 1 FROM n UNION ALL SELECT 'scale_degree_dist', {DEGREE_SQL} - 1 FROM n JOIN pc USING (piece_id)), c AS (SELECT dist, bin, count(*) AS c FROM r WHERE bin >= 0 GROUP BY 1, 2)
SELECT dist, CAST(bin AS INT) AS bin, round(c / (sum(c) OVER (PARTITION BY dist) + 1e-10), 9) AS p FROM c""",
    "detect_key": f"WITH {NOTES_SQL}, " + keys_sql("n", "piece_id"),
    "modulation_windows": f"WITH {NOTES_SQL}, w0 AS (SELECT piece_id, CAST((start - min(start) OVER (PARTITION BY piece_id)) // 3840 AS BIGINT) AS win, pitch FROM n), wn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY piece_id, win) AS m FROM w0) WHERE m >= 4), best AS (WITH " + keys_sql("wn", "piece_id, win") + ") SELECT piece_id, win, key_root, key_mode FROM best WHERE corr > 0.5",
    "median_duration": f"WITH {NOTES_SQL} SELECT piece_id, voice, CAST(median(dur) AS DOUBLE) AS median_dur FROM n GROUP BY 1, 2",
    "repeated_cells": f"WITH {NOTES_SQL}, {CELLS_SQL} SELECT piece_id, voice, round(rep, 9) AS repeat_ratio FROM ce",
    "accompaniment_severity": f"""WITH {NOTES_SQL}, {CELLS_SQL},
v AS (SELECT n.piece_id, n.voice, count(*) AS c, avg(pitch) AS mean, median(dur) AS med, avg(CASE WHEN dur <= 240 THEN 1.0 ELSE 0.0 END) AS short, count(*) * 1.0 / greatest(1, ceil(max(start + dur) / 1920.0)) AS density FROM n GROUP BY 1, 2),
x AS (SELECT v.*, rep, row_number() OVER (PARTITION BY v.piece_id ORDER BY mean, v.voice) AS lo, row_number() OVER (PARTITION BY v.piece_id ORDER BY mean DESC, v.voice DESC) AS hi, count(*) OVER (PARTITION BY v.piece_id) AS voices FROM v JOIN ce USING (piece_id, voice))
SELECT l.piece_id, round(CASE WHEN l.c < 24 OR t.c < 8 OR l.voices < 2 THEN 0.0 ELSE (l.short / 0.70 + l.density / 8 + l.rep / 0.20 + t.med / greatest(1, l.med) / 1.8 + l.c * 1.0 / t.c / 1.5) / 5 END, 9) AS severity FROM x l JOIN x t ON l.piece_id = t.piece_id AND l.lo = 1 AND t.hi = 1""",
    "nearest_rank_pct": "WITH r AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, " + ", ".join(f"{floor_rank(q)} AS floor_p{int(q * 100)}, {round_rank(q)} AS round_p{int(q * 100)}, quantile_cont(l_quantity, {q}) AS linear_p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM r GROUP BY 1",
}
