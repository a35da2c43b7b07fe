"""Per-piece labels: texture, imitation, harmonic rhythm, tension and chromaticism."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import pitch_class, scale
from quaverlake.operators.joins import GRAMS_SQL, beats, fuzzy_counts, stab
from quaverlake.plans.views import NOTES_SQL, key_mode, key_root, notes
from quaverlake.plans.written import materialize


def band(value: Column, high: float, mid: float, names: tuple[str, str, str], default: str | None = None) -> Column:
    """names[0] above high, names[1] above mid, else names[2]."""
    out = F.when(value > high, names[0]).when(value > mid, names[1]).otherwise(names[2])
    return out if default is None else F.when(value.isNull(), default).otherwise(out)


def texture(n: DataFrame) -> DataFrame:
    """Mean share of voices that start in an eighth-note slot, over slots in which any starts."""
    voices = n.groupBy("piece_id").agg(F.countDistinct("voice").alias("voices"))
    slots = n.select("piece_id", "voice", F.floor(F.col("start") / 240).alias("slot")).distinct().groupBy("piece_id", "slot").agg(F.count(F.lit(1)).alias("c"))
    ratio = slots.join(voices, "piece_id").groupBy("piece_id").agg(F.round(F.avg(F.col("c") / F.col("voices")), 9).alias("sync_ratio"))
    return ratio.withColumn("texture", F.when(F.col("sync_ratio") > 0.60, "homophonic").when(F.col("sync_ratio") < 0.54, "polyphonic").otherwise("mixed"))


def imitation(n: DataFrame, k: int = 6) -> DataFrame:
    """Fuzzy n-gram matches between voices, per note."""
    total = n.groupBy("piece_id").agg(F.count(F.lit(1)).alias("total"))
    hits = fuzzy_counts(n, k).groupBy("piece_id").agg(F.sum("matches").alias("hits"))
    score = total.join(hits, "piece_id", "left").select("piece_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("total"), 9).alias("imitation_score"))
    return score.withColumn("imitation", band(F.col("imitation_score"), 0.30, 0.10, ("high", "low", "none")))


def harmonic_rhythm(n: DataFrame, measure: int = 1920) -> DataFrame:
    """Changes of the sounding pitch-class set from beat to beat, per measure. A silent beat counts when sound returns."""
    grid = beats(n)
    masks = stab(grid, n.select("piece_id", "start", "dur", "pitch"), ["piece_id"]).groupBy("piece_id", "tick").agg(F.bit_or(F.expr("shiftleft(1, cast(pitch % 12 as int))")).alias("mask"))
    full = grid.join(masks.hint("merge"), ["piece_id", "tick"], "left").fillna({"mask": 0})
    w = W.partitionBy("piece_id").orderBy("tick")
    changed = full.withColumn("before", F.lag("mask").over(w)).withColumn("change", F.when(F.col("before").isNotNull() & (F.col("mask") != 0) & (F.col("mask") != F.col("before")), 1).otherwise(0))
    ends = n.groupBy("piece_id").agg(F.greatest(F.lit(1), F.ceil(F.max(F.col("start") + F.col("dur")) / measure)).alias("measures"))
    rate = changed.groupBy("piece_id").agg(F.sum("change").alias("changes"), F.count(F.lit(1)).alias("beats")).join(ends, "piece_id")
    rate = rate.select("piece_id", F.round(F.col("changes") / F.col("measures"), 9).alias("changes_per_measure"), "beats")
    label = F.when(F.col("beats") < 2, "moderate").when(F.col("changes_per_measure") <= 2.77, "slow").when(F.col("changes_per_measure") <= 3.18, "moderate").otherwise("fast")
    return rate.select("piece_id", "changes_per_measure", label.alias("harmonic_rhythm"))


def tension(n: DataFrame) -> DataFrame:
    """Share of dissonant pairs among voice pairs that sound together at an attack of either."""
    onsets = n.select("piece_id", F.col("start").alias("tick"), F.col("voice").alias("at")).distinct()
    sounding = stab(onsets.select("piece_id", "tick").distinct(), n.select("piece_id", "voice", "start", "dur", "pitch"), ["piece_id"]).select("piece_id", "tick", "voice", "pitch")
    attacks = onsets.groupBy("piece_id", "tick").agg(F.collect_set("at").alias("attacking"))
    a, b = (sounding.select("piece_id", "tick", F.col("voice").alias(f"v{s}"), F.col("pitch").alias(f"p{s}")) for s in "ab")
    pairs = a.join(b.hint("merge"), ["piece_id", "tick"]).filter("va < vb").join(attacks.hint("merge"), ["piece_id", "tick"]).filter("array_contains(attacking, va) or array_contains(attacking, vb)")
    rough = (F.abs(F.col("pa") - F.col("pb")) % 12).isin(1, 2, 6, 10, 11)
    ratio = pairs.groupBy("piece_id").agg(F.round(F.avg(F.when(rough, 1.0).otherwise(0.0)), 9).alias("tension_ratio"))
    full = n.select("piece_id").distinct().join(ratio, "piece_id", "left")
    return full.withColumn("tension", band(F.col("tension_ratio"), 0.145, 0.128, ("high", "moderate", "low"), "moderate"))


def chromaticism(n: DataFrame) -> DataFrame:
    """Share of notes outside the scale (harmonic in minor)."""
    outside = ~F.array_contains(scale(key_root(), key_mode()), pitch_class(F.col("pitch")))
    ratio = n.groupBy("piece_id").agg(F.round(F.avg(F.when(outside, 1.0).otherwise(0.0)), 9).alias("chromatic_ratio"))
    return ratio.withColumn("chromaticism", band(F.col("chromatic_ratio"), 0.15, 0.05, ("high", "moderate", "low")))


def texture_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texture(notes(spark, sf_dir))


def imitation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imitation(notes(spark, sf_dir))


def harmonic_rhythm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_rhythm(notes(spark, sf_dir))


def tension_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tension(notes(spark, sf_dir))


def chromaticism_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chromaticism(notes(spark, sf_dir))


def analysis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes and the labels of each kind are written on the way, so that the driver plans one kind at a time."""
    n = materialize(notes(spark, sf_dir), "notes")
    return together([(part.__name__, materialize(part(n), part.__name__)) for part in (texture, imitation, harmonic_rhythm, tension, chromaticism)])


def together(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """piece_id and a column for each part, of the pieces that all parts have, once each: a union and one aggregation, so that the driver holds no table to broadcast."""
    names = [name for name, _ in parts]
    rows = [df.select("piece_id", *(F.col(name) if name == k else F.lit(None).cast("string").alias(k) for k in names)) for name, df in parts]
    both = reduce(DataFrame.unionByName, rows).filter("piece_id is not null")
    return both.groupBy("piece_id").agg(*(F.max(k).alias(k) for k in names)).filter(" and ".join(f"{k} is not null" for k in names))


def crosstab_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures against degrees of chromaticism, all columns, zero where nothing falls."""
    n = notes(spark, sf_dir)
    both = texture(n).join(chromaticism(n), "piece_id")
    return both.groupBy("texture").pivot("chromaticism", ["low", "moderate", "high"]).count().na.fill(0)


#: Crosstabs of labels: names of rows and columns, each with its values in order; fixed values.
CROSSTABS = {
    "imitation_x_texture": (("imitation", ["none", "low", "high"]), ("texture", ["homophonic", "mixed", "polyphonic"])),
    "imitation_x_harmonic_rhythm": (("imitation", ["none", "low", "high"]), ("harmonic_rhythm", ["slow", "moderate", "fast"])),
    "tension_x_chromaticism": (("tension", ["low", "moderate", "high"]), ("chromaticism", ["low", "moderate", "high"])),
}


def label_crosstabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by two labels, for three pairs of labels: every cell, in order, zero where nothing falls."""
    kinds = sorted({name for pair in CROSSTABS.values() for name, _ in pair})
    counts = materialize(analysis_labels(spark, sf_dir), "labels").groupBy(*kinds).agg(F.count(F.lit(1)).alias("c"))  # at most 243 rows
    cells = [F.struct(F.lit(t).alias("crosstab"), F.lit(i * len(columns) + j).cast("int").alias("place"), F.lit(r).alias("row"), F.lit(k).alias("column"), ((F.col(row) == r) & (F.col(column) == k)).alias("hit")) for t, ((row, rows), (column, columns)) in CROSSTABS.items() for i, r in enumerate(rows) for j, k in enumerate(columns)]
    each = counts.select("c", F.explode(F.array(*cells)).alias("x"))
    return each.groupBy("x.crosstab", "x.place", "x.row", "x.column").agg(F.coalesce(F.sum(F.when(F.col("x.hit"), F.col("c"))), F.lit(0)).alias("pieces"))


QUERIES = {f.__name__: f for f in (label_crosstabs, texture_labels, imitation_labels, harmonic_rhythm_labels, tension_labels, chromaticism_labels, analysis_labels, crosstab_labels)}

TEXTURE_SQL = """tx AS (SELECT piece_id, sync_ratio, CASE WHEN sync_ratio > 0.60 THEN 'homophonic' WHEN sync_ratio < 0.54 THEN 'polyphonic' ELSE 'mixed' END AS texture FROM (
  SELECT piece_id, round(avg(c * 1.0 / voices), 9) AS sync_ratio FROM (SELECT piece_id, start // 240 AS slot, count(DISTINCT voice) AS c FROM n GROUP BY 1, 2) JOIN (SELECT piece_id, count(DISTINCT voice) AS voices FROM n GROUP BY 1) USING (piece_id) GROUP BY 1))"""
IMITATION_SQL = GRAMS_SQL + """, g6 AS (SELECT * FROM iv WHERE i6 IS NOT NULL), im AS (SELECT piece_id, imitation_score, CASE WHEN imitation_score > 0.30 THEN 'high' WHEN imitation_score > 0.10 THEN 'low' ELSE 'none' END AS imitation FROM (
  SELECT t.piece_id, round(coalesce(hits, 0) * 1.0 / total, 9) AS imitation_score FROM (SELECT piece_id, count(*) AS total FROM n GROUP BY 1) t LEFT JOIN (
  SELECT a.piece_id, count(*) AS hits FROM g6 a JOIN g6 b ON a.piece_id = b.piece_id AND a.voice < b.voice WHERE abs(a.i1-b.i1)+abs(a.i2-b.i2)+abs(a.i3-b.i3)+abs(a.i4-b.i4)+abs(a.i5-b.i5)+abs(a.i6-b.i6) <= 1 AND abs(a.start-b.start) >= 480 GROUP BY 1) h ON t.piece_id = h.piece_id))"""
RHYTHM_SQL = """bt AS (SELECT piece_id, unnest(range(0, CAST(max(start + dur) AS BIGINT), 480)) AS tick, greatest(1, ceil(max(start + dur) / 1920.0)) AS measures FROM n GROUP BY piece_id),
mk AS (SELECT bt.piece_id, tick, measures, coalesce(bit_or(CAST(1 AS BIGINT) << CAST(pitch % 12 AS INT)), 0) AS mask FROM bt LEFT JOIN n ON bt.piece_id = n.piece_id AND start <= tick AND tick < start + dur GROUP BY 1, 2, 3),
ch AS (SELECT *, lag(mask) OVER (PARTITION BY piece_id ORDER BY tick) AS before FROM mk),
hr AS (SELECT piece_id, changes_per_measure, CASE WHEN beats < 2 THEN 'moderate' WHEN changes_per_measure <= 2.77 THEN 'slow' WHEN changes_per_measure <= 3.18 THEN 'moderate' ELSE 'fast' END AS harmonic_rhythm FROM (
  SELECT piece_id, round(sum(CASE WHEN before IS NOT NULL AND mask <> 0 AND mask <> before THEN 1 ELSE 0 END) / max(measures), 9) AS changes_per_measure, count(*) AS beats FROM ch GROUP BY 1))"""
TENSION_SQL = """pr AS (SELECT DISTINCT a.piece_id, a.voice AS va, b.voice AS vb FROM (SELECT DISTINCT piece_id, voice FROM n) a JOIN (SELECT DISTINCT piece_id, voice FROM n) b ON a.piece_id = b.piece_id AND a.voice < b.voice),
ats AS (SELECT DISTINCT pr.piece_id, va, vb, start AS tick FROM pr JOIN n ON n.piece_id = pr.piece_id AND n.voice IN (va, vb)),
tn AS (SELECT p.piece_id, tension_ratio, CASE WHEN tension_ratio IS NULL THEN 'moderate' WHEN tension_ratio > 0.145 THEN 'high' WHEN tension_ratio > 0.128 THEN 'moderate' ELSE 'low' END AS tension FROM (SELECT DISTINCT piece_id FROM n) p LEFT JOIN (
  SELECT ats.piece_id, round(avg(CASE WHEN abs(x.pitch - y.pitch) % 12 IN (1, 2, 6, 10, 11) THEN 1.0 ELSE 0.0 END), 9) AS tension_ratio FROM ats
  JOIN n x ON x.piece_id = ats.piece_id AND x.voice = va AND x.start <= tick AND tick < x.start + x.dur JOIN n y ON y.piece_id = ats.piece_id AND y.voice = vb AND y.start <= tick AND tick < y.start + y.dur GROUP BY 1) r ON p.piece_id = r.piece_id)"""
SCALE_SQL = "CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,11] END"
CHROMATIC_SQL = f"""cr AS (SELECT piece_id, chromatic_ratio, CASE WHEN chromatic_ratio > 0.15 THEN 'high' WHEN chromatic_ratio > 0.05 THEN 'moderate' ELSE 'low' END AS chromaticism FROM (
  SELECT n.piece_id, round(avg(CASE WHEN list_contains({SCALE_SQL}, (pitch % 12 - key_root + 12) % 12) THEN 0.0 ELSE 1.0 END), 9) AS chromatic_ratio FROM n JOIN pc USING (piece_id) GROUP BY 1))"""
SQL = {
    "texture_labels": f"WITH {NOTES_SQL}, {TEXTURE_SQL} SELECT * FROM tx",
    "imitation_labels": f"WITH {NOTES_SQL}, {IMITATION_SQL} SELECT * FROM im",
    "harmonic_rhythm_labels": f"WITH {NOTES_SQL}, {RHYTHM_SQL} SELECT * FROM hr",
    "tension_labels": f"WITH {NOTES_SQL}, {TENSION_SQL} SELECT * FROM tn",
    "chromaticism_labels": f"WITH {NOTES_SQL}, {CHROMATIC_SQL} SELECT * FROM cr",
    "analysis_labels": f"WITH {NOTES_SQL}, {TEXTURE_SQL}, {IMITATION_SQL}, {RHYTHM_SQL}, {TENSION_SQL}, {CHROMATIC_SQL} SELECT piece_id, texture, imitation, harmonic_rhythm, tension, chromaticism FROM tx JOIN im USING (piece_id) JOIN hr USING (piece_id) JOIN tn USING (piece_id) JOIN cr USING (piece_id)",
    "crosstab_labels": f"""WITH {NOTES_SQL}, {TEXTURE_SQL}, {CHROMATIC_SQL} SELECT texture, {", ".join(f"count(*) FILTER (chromaticism = '{k}') AS {k}" for k in ("low", "moderate", "high"))} FROM tx JOIN cr USING (piece_id) GROUP BY 1""",
}
SQL["label_crosstabs"] = f"WITH lb AS ({SQL['analysis_labels']}) " + " UNION ALL ".join(
    f"SELECT '{t}' AS crosstab, CAST({i * len(columns) + j} AS INT) AS place, '{r}' AS row, '{k}' AS \"column\", count(*) FILTER ({row} = '{r}' AND {column} = '{k}') AS pieces FROM lb" for t, ((row, rows), (column, columns)) in CROSSTABS.items() for i, r in enumerate(rows) for j, k in enumerate(columns)
)
