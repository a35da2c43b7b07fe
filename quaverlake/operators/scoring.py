"""Scores of pieces: voice leading, statistics, structure, completeness, and their composite with guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import PROFILE_MAJOR, PROFILE_MINOR, correlation, lits, scale_degree
from quaverlake.operators import histograms as H
from quaverlake.operators.joins import as_of, stab
from quaverlake.operators.labels import SCALE_SQL
from quaverlake.operators.subjects import RECALL_SQL, recall
from quaverlake.plans.views import NOTES_SQL, key_mode, key_root, notes

#: Weights of the composite; fixed values.
WEIGHTS = {"voice_leading": 0.20, "statistical": 0.09, "structural": 0.22, "contrapuntal": 0.20, "completeness": 0.05, "thematic_recall": 0.24}
#: Thresholds and steps of the form profiles; fixed values.
PROFILES = {
    "fugue": ((0.62, 0.74, 0.74, 0.008), (0.70, 0.84, 0.80, 0.010), (0.78, 0.40, 0.88, 0.006), (0.90, 0.66, 0.40, -0.012), (0.92, 0.78, 0.66, 0.44, -0.018), 0.04),
    "sinfonia": ((0.58, 0.70, 0.72, 0.006), (0.66, 0.80, 0.78, 0.008), (0.74, 0.38, 0.86, 0.005), (0.89, 0.64, 0.38, -0.010), (0.91, 0.76, 0.64, 0.42, -0.014), 0.035),
    "invention": ((0.55, 0.68, 0.70, 0.006), (0.63, 0.78, 0.76, 0.008), (0.70, 0.36, 0.85, 0.004), (0.88, 0.62, 0.36, -0.010), (0.90, 0.74, 0.62, 0.40, -0.014), 0.035),
}


def one(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def leading(n: DataFrame) -> DataFrame:
    """piece_id, voice_leading: penalties of each voice pair per aligned transition, averaged over the pairs.

    Onsets and notes are shuffled once, by piece; pairs are made and followed in the tasks of their piece, without a join.
    """
    onsets = n.select("piece_id", F.col("start").alias("tick")).distinct()
    voices = n.select("piece_id", "voice").distinct()
    at = as_of(onsets.join(voices, "piece_id"), n, ["piece_id", "voice"], within="piece_id")
    upper = F.collect_list(F.struct("voice", "pitch", "hit")).over(W.partitionBy("piece_id", "tick").orderBy("voice").rowsBetween(W.unboundedPreceding, -1))
    pairs = at.withColumn("x", upper).select("piece_id", "tick", F.explode("x").alias("x"), F.col("voice").alias("vl"), F.col("pitch").alias("l"), F.col("hit").alias("hit_l"))
    pairs = pairs.select("piece_id", "tick", F.col("x.voice").alias("vu"), "vl", F.col("x.pitch").alias("u"), "l", F.col("x.hit").alias("hit_u"), "hit_l").filter("(hit_u or hit_l) and (u is not null or l is not null)")
    w = W.partitionBy("piece_id", "vu", "vl").orderBy("tick")
    t = pairs.withColumn("pu", F.lag("u").over(w)).withColumn("pl", F.lag("l").over(w))
    u, l, pu, pl = map(F.col, ("u", "l", "pu", "pl"))
    full = u.isNotNull() & l.isNotNull() & pu.isNotNull() & pl.isNotNull()
    same = F.signum(u - pu) * F.signum(l - pl) > 0
    before, now = F.pmod(pu - pl, F.lit(12)), F.pmod(u - l, F.lit(12))
    exact = (F.abs(pu - pl) == F.abs(u - l)) & (now == 0) & (pu != pl) & same
    fifths, octaves = one(full & (before == 7) & (now == 7) & same), F.when(full & exact, 1.0).when(full & (before == 0) & (now == 0) & same, 0.5).otherwise(0.0)
    moves = t.groupBy("piece_id", "vu", "vl").agg(F.count(F.lit(1)).alias("aligned"), F.sum(2.0 * fifths + 2.5 * octaves + 1.0 * one(full & (u < l))).alias("moved"))
    s = H.with_steps(n)
    leap = F.abs("ivl")
    alone = s.groupBy("piece_id", "voice").agg(F.sum(F.when(leap > 12, 1.5).when(leap.isin(6, 10, 11), 0.5).otherwise(0.0) + F.when((F.abs("before") > 5) & (leap > 2), 0.3 * 0.8).otherwise(0.0)).alias("leaps"), F.count(F.lit(1)).alias("c"), F.collect_set("pitch").alias("ps"))
    left, right = (alone.select("piece_id", F.col("voice").alias(f"v{x}"), F.col("leaps").alias(f"leaps_{x}"), F.col("c").alias(f"c_{x}"), F.col("ps").alias(f"ps_{x}")) for x in "ul")
    p = moves.join(left, ["piece_id", "vu"]).join(right, ["piece_id", "vl"])
    raw = F.greatest(F.lit(0.0), 1 - (F.col("moved") + F.col("leaps_u") + F.col("leaps_l")) / F.greatest(F.col("aligned") - 1, F.lit(1)))
    uniq = F.size(F.array_union("ps_u", "ps_l"))
    flat = F.when(F.col("c_u") + F.col("c_l") <= 4, 1.0).when(uniq <= 2, 0.1).when(uniq <= 5, 0.3 + (uniq - 2) * 0.23).otherwise(1.0)
    return p.groupBy("piece_id").agg(F.round(F.avg(F.when(F.col("aligned") < 2, 0.5).otherwise(raw * flat)), 9).alias("voice_leading"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (natural logarithm), both with 1e-10 added and normalised."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda a: F.transform(F.transform(a, lambda v: v + 1e-10), lambda v: v / total(F.transform(a, lambda y: y + 1e-10)))
    both = F.zip_with(norm(p), norm(q), lambda a, b: (a * F.log(2 * a / (a + b)) + b * F.log(2 * b / (a + b))) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), total(both)))


def piece_vectors(rows: DataFrame, value: Column, bins: int, name: str) -> DataFrame:
    return H.histogram(rows, value, bins).groupBy("piece_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias(name))


def statistical(n: DataFrame) -> DataFrame:
    """piece_id, statistical: nearness of a piece's distributions to the corpus', and how even its bigrams are."""
    s = H.with_steps(n)
    kinds = H.interval_kind(F.col("before")) * 5 + H.interval_kind(F.col("ivl"))
    parts = [("pc", n, H.pitch_class(F.col("pitch")), 12), ("iv", s, H.clipped(F.col("ivl")), 25), ("du", n, H.nearest_bin(F.col("dur")), 11)]
    out = piece_vectors(s.filter("before is not null"), kinds, 25, "bi")
    for name, rows, value, bins in parts:
        whole = rows.select(value.cast("int").alias("bin")).filter("bin is not null").agg(*(F.count_if(F.col("bin") == b).alias(f"b{b}") for b in range(bins)))
        total = sum((F.col(f"b{b}") for b in range(1, bins)), F.col("b0"))
        ref = whole.select(F.array(*(F.round(F.col(f"b{b}") / total, 9) for b in range(bins))).alias(f"ref_{name}"))
        out = out.join(piece_vectors(rows, value, bins, name), "piece_id").crossJoin(F.broadcast(ref))  # the corpus' shares are one row
    entropy = F.aggregate("bi", F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    score = 0.20 * distance(F.col("pc"), F.col("ref_pc")) + 0.25 * distance(F.col("iv"), F.col("ref_iv")) + 0.20 * distance(F.col("du"), F.col("ref_du")) + 0.35 * (entropy / 4.643856189774724 * 0.5)
    return out.select("piece_id", F.round(F.greatest(F.lit(0.0), 1 - 2 * score), 6).alias("statistical"))


def ends(n: DataFrame, voice: Column, name: str) -> DataFrame:
    """The last three notes of a voice per piece, last first, as array of structs."""
    w = W.partitionBy("piece_id").orderBy(F.desc("note_idx"))
    last = n.filter(voice).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return last.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("r", "start", "dur", "pitch"))).alias(name))


def completeness(n: DataFrame) -> DataFrame:
    per = n.groupBy("piece_id", "voice").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("dur")).alias("end"))
    whole = per.groupBy("piece_id").agg(F.min("first").alias("lo"), F.max("end").alias("hi"), F.count(F.lit(1)).alias("voices"), F.max("first").alias("late"), F.min("end").alias("early"))
    top, low = ends(n, F.col("voice") == 0, "s"), ends(n, F.col("voice") == 3, "b")
    p = whole.join(top, "piece_id").join(low, "piece_id")
    s, b = F.col("s")[0], F.col("b")[0]
    bars = (F.col("hi") - F.col("lo")) / 1920
    score = 0.25 * one(F.col("voices") >= 2) + F.when(bars >= 8, 0.15).when(bars >= 4, 0.08).otherwise(0.0) + 0.10 * one(F.col("late") < F.col("lo") + 1920) + 0.10 * one(F.col("early") > F.col("hi") - 1920)
    score = score + 0.15 * one((s["dur"] >= 480) & (b["dur"] >= 480)) + 0.15 * one(b["pitch"] % 12 == key_root()) + 0.10 * one(F.abs(s["start"] + s["dur"] - b["start"] - b["dur"]) < 960)
    return p.select("piece_id", F.round(F.least(F.lit(1.0), score), 9).alias("completeness"))


def cadence(n: DataFrame) -> DataFrame:
    """piece_id, cadence: the close of the outer voices, arrivals of the bass at long notes or gaps, and long last notes."""
    root = key_root()
    fifth, fourth, second = F.pmod(root + 7, F.lit(12)), F.pmod(root + 5, F.lit(12)), F.pmod(root + 2, F.lit(12))
    third = F.pmod(root + F.when(key_mode() == "major", 4).otherwise(3), F.lit(12))
    p = ends(n, F.col("voice") == 0, "s").join(ends(n, F.col("voice") == 3, "b"), "piece_id")
    pc = lambda i: F.get(F.col("b"), F.lit(i))["pitch"] % 12
    top = F.col("s")[0]["pitch"] % 12
    close = 0.15 * one(pc(0) == root) + F.when(top == root, 0.10).when(top == third, 0.08).otherwise(0.0)
    authentic = (pc(0) == root) & (pc(1) == fifth)
    close = close + 0.15 * one(authentic) + 0.10 * one(authentic & ((pc(2) == second) | (pc(2) == fourth)))
    held = 0.10 * one(F.col("b")[0]["dur"] >= 960) + 0.10 * one(F.col("s")[0]["dur"] >= 960)
    w = W.partitionBy("piece_id").orderBy("start", "note_idx")
    bass = n.filter("voice = 3").withColumn("next", F.lead("start").over(w)).withColumn("prev", F.lag("pitch").over(w)).withColumn("m", F.count(F.lit(1)).over(W.partitionBy("piece_id")))
    at = F.col("pitch") % 12
    good = F.when((at == root) & (F.col("prev") % 12 == fifth), 2).when((at == root) | (at == fifth), 1).otherwise(0)
    points = bass.filter("m >= 4 and next is not null and (dur >= 960 or next - start - dur >= 480)").groupBy("piece_id").agg(F.least(F.lit(1.0), F.sum(good) / F.count(F.lit(1))).alias("inner"))
    return p.join(points, "piece_id", "left").select("piece_id", F.round(F.least(F.lit(1.0), close + 0.30 * F.coalesce("inner", F.lit(0.3)) + held), 9).alias("cadence"))


def length(n: DataFrame) -> DataFrame:
    b = n.groupBy("piece_id").agg(((F.max(F.col("start") + F.col("dur")) - F.min("start")) / 1920).alias("b"))
    v = F.col("b")
    score = F.when(v < 4, 0.1).when(v < 12, 0.3 + 0.4 * (v - 4) / 8).when(v <= 60, 0.8 + 0.2 * F.least(F.lit(1.0), (v - 12) / 20)).otherwise(F.greatest(F.lit(0.5), 1 - (v - 60) / 60))
    return b.select("piece_id", F.round(score, 9).alias("length"))


def modulation(n: DataFrame) -> DataFrame:
    """piece_id, modulation: whether the keys of two-bar windows are near the piece's own, and how many they are."""
    first = F.min("start").over(W.partitionBy("piece_id"))
    win = n.withColumn("win", F.floor((F.col("start") - first) / 3840))
    counts = H.class_counts(win, ["piece_id", "win"]).filter(F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x) >= 4)
    keys = H.key_of(counts, ["piece_id", "win"]).filter("corr > 0.5").select("piece_id", F.col("key_root").alias("r"), F.col("key_mode").alias("m")).distinct()
    step, minor = F.pmod(F.col("r") - key_root(), F.lit(12)), F.col("m") == "minor"
    near_major = ((step == 7) | (step == 0)) | ((step == 5) & ~minor) | ((step == 9) & minor)
    near_minor = ((step == 7) | (step == 0)) | ((step == 5) & minor) | ((step == 3) & ~minor)
    near = F.when(key_mode() == "major", near_major).otherwise(near_minor)
    k = keys.groupBy("piece_id").agg(F.count(F.lit(1)).alias("k"), F.count_if(near).alias("near"))
    full = n.groupBy("piece_id").agg(F.count(F.lit(1)).alias("c")).join(k, "piece_id", "left")
    far, kk = F.col("k") - F.col("near"), F.col("k")
    quality = F.when((F.col("near") >= 2) & (far <= 1), 1.0).when(F.col("near") >= 2, F.greatest(F.lit(0.5), 1 - far * 0.15)).otherwise(0.4)
    number = F.when(kk == 2, 0.7).when(kk <= 4, 1.0).when(kk <= 6, 0.8).otherwise(F.greatest(F.lit(0.4), 1 - (kk - 6) * 0.1))
    score = F.when(F.col("c") < 16, 0.3).when(kk.isNull() | (kk <= 1), 0.4).otherwise(0.6 * quality + 0.4 * number)
    return full.select("piece_id", F.round(score, 9).alias("modulation"))


def key_consistency(n: DataFrame) -> DataFrame:
    h = H.class_counts(n, ["piece_id"])
    profile = F.when(key_mode() == "major", lits(PROFILE_MAJOR)).otherwise(lits(PROFILE_MINOR))
    rotated = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda pc: F.element_at(profile, (F.pmod(pc - key_root(), F.lit(12)) + 1).cast("int")))
    corr = F.coalesce(correlation(F.transform("h", lambda x: x.cast("double")), rotated), F.lit(0.0))
    return h.select("piece_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (corr + 0.2) / 1.2)), 9).alias("key_consistency"))


def islands(n: DataFrame, step: int = 480, reach: int = 3840) -> DataFrame:
    """piece_id, tick, active on a grid of beats; a note counts only while its start is less than `reach` ticks away."""
    span = n.groupBy("piece_id").agg(F.min("start").cast("long").alias("lo"), F.max(F.col("start") + F.col("dur")).cast("long").alias("hi"))
    grid = span.select("piece_id", F.explode(F.expr(f"sequence(lo, hi - 1, {step}L)")).alias("tick"))
    heard = stab(grid, n.select("piece_id", "start", F.least("dur", F.lit(reach)).alias("dur")), ["piece_id"]).select("piece_id", "tick").distinct().withColumn("active", F.lit(1))
    return grid.join(heard, ["piece_id", "tick"], "left").fillna({"active": 0})


def phrase_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of beats on which anything sounds, with their bounds."""
    g = islands(notes(spark, sf_dir, shifted=True))
    w = W.partitionBy("piece_id").orderBy("tick")
    runs = g.withColumn("edge", F.when(F.col("active") == F.lag("active").over(w), 0).otherwise(1)).withColumn("run", F.sum("edge").over(w))
    return runs.filter("active = 1").groupBy("piece_id", "run").agg(F.min("tick").alias("begin_tick"), (F.max("tick") + 480).alias("end_tick")).select("piece_id", "begin_tick", "end_tick")


def cadences(n: DataFrame, least: float = 2.0, measure: int = 1920) -> DataFrame:
    """piece_id, tick, bar_index, label, confidence at bar lines; the outer voices are 0 and 3."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    v = n.withColumn("prev", F.lag("pitch").over(w)).withColumn("voices", F.lit(4)).select("piece_id", "voice", "start", "dur", "pitch", "prev")
    bars = n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).cast("long").alias("m"), F.countDistinct("voice").alias("voices")).filter(F.col("m") >= measure)
    bars = bars.select("piece_id", "voices", F.explode(F.expr(f"sequence({measure}L, m, {measure}L)")).alias("tick"))
    here = stab(bars.select("piece_id", "tick"), v, ["piece_id"]).groupBy("piece_id", "tick").agg(
        F.count(F.lit(1)).alias("sounding"),
        F.count_if((F.col("dur") >= 960) | (F.abs(F.col("start") + F.col("dur") - F.col("tick")) <= 120)).alias("settled"),
        F.max(F.when(F.col("voice") == 3, F.struct("pitch", "prev", "dur"))).alias("b"),
        F.max(F.when(F.col("voice") == 0, F.struct("pitch", "dur"))).alias("s"),
    )
    root, mode = key_root(), key_mode()
    degree = lambda c: scale_degree(c % 12, root, mode)
    c = bars.join(here, ["piece_id", "tick"]).filter("b is not null and b.prev is not null")
    c = c.select("piece_id", "tick", "voices", "sounding", "settled", "b", "s", degree(F.col("b.pitch")).alias("bd"), degree(F.col("b.prev")).alias("pd"), degree(F.col("s.pitch")).alias("sd"), (F.col("b.pitch") - F.col("b.prev")).alias("mv"))
    dominant = F.col("mv").isin(5, -7) | ((F.abs("mv") <= 12) & (F.pmod("mv", F.lit(12)) == 5))
    before, both = F.coalesce(F.col("pd").isin(2, 4), F.lit(False)), F.col("settled") + F.col("voices") - F.col("sounding") >= F.greatest(F.lit(2), F.ceil(F.col("voices") * 0.5))
    long_ = (F.col("b.dur") >= 960) | F.coalesce(F.col("s.dur") >= 960, F.lit(False))
    label = F.when((F.col("bd") == 1) & dominant, F.when(F.col("sd") == 1, "CAD_PAC").when(F.col("sd").isin(3, 5), "CAD_IAC")).when((F.col("bd") == 5) & (before | both), "CAD_HC").when((F.col("bd") == 6) & dominant, "CAD_DC")
    sure = F.when(F.col("bd") == 5, one(before)).otherwise(1.0) + one(both) + one(long_)
    return c.select("piece_id", "tick", F.floor(F.col("tick") / measure).alias("bar_index"), label.alias("label"), sure.alias("confidence")).filter(F.col("label").isNotNull() & (F.col("confidence") >= least))


def cadence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cadences(notes(spark, sf_dir))


def voice_leading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leading(notes(spark, sf_dir, shifted=True))


def statistical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistical(notes(spark, sf_dir))


def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness(notes(spark, sf_dir))


def phrase_lengths(n: DataFrame) -> DataFrame:
    """piece_id, how (gaps or melody), ticks of each phrase longer than half a bar: by beats on which nothing sounds, and by the long notes of voice 0."""
    end = n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).cast("long").alias("hi"))
    w = W.partitionBy("piece_id").orderBy("tick")
    g = islands(n)
    turns = g.withColumn("was", F.lag("active").over(w)).filter("was IS NULL OR was <> active").withColumn("next", F.lead("tick").over(w)).join(end, "piece_id")
    gaps = turns.filter("active = 1 OR next IS NULL").select("piece_id", F.lit("gaps").alias("how"), (F.coalesce("next", "hi") - F.col("tick")).alias("ticks"))
    v = W.partitionBy("piece_id").orderBy("start", "note_idx")
    top = n.filter("voice = 0").withColumn("i", F.row_number().over(v)).withColumn("m", F.count(F.lit(1)).over(W.partitionBy("piece_id"))).withColumn("until", (F.col("start") + F.col("dur")).cast("long"))
    closes = top.filter("m >= 4 AND (i = 1 OR dur >= 720)").withColumn("since", F.lag(F.when(F.col("i") == 1, F.col("start")).otherwise(F.col("until"))).over(v))
    melody = closes.filter("i > 1").select("piece_id", F.lit("melody").alias("how"), (F.col("until") - F.col("since")).cast("long").alias("ticks"))
    return gaps.unionByName(melody).filter("ticks > 960")


def phrases(n: DataFrame) -> DataFrame:
    """piece_id, phrase: whether phrases show, how near their lengths are to 2, 4 or 8 bars, and how many lengths there are; 0.3 where none shows."""
    bars = F.col("ticks") / 1920
    near = F.array_min(F.array(*(F.struct(F.abs(bars - k).alias("d"), F.lit(k).alias("k")) for k in (2, 4, 8))))
    per = phrase_lengths(n).groupBy("piece_id", "how").agg(F.count(F.lit(1)).alias("k"), F.avg(F.greatest(F.lit(0.0), 1 - near["d"] / near["k"])).alias("regular"), (F.countDistinct(F.bround(bars)) / F.count(F.lit(1))).alias("unique"))
    some = per.filter("k >= 2")
    best = some.groupBy("piece_id").agg(F.min_by(F.struct("k", "regular", "unique"), "how").alias("p"))  # gaps before melody
    u = F.col("p.unique")
    variety = F.when(F.col("p.k") < 3, 0.15).otherwise(0.3 * F.when(u < 0.2, 0.5).when(u <= 0.7, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (u - 0.7) * 2)))
    score = F.least(F.lit(1.0), 0.3 + 0.4 * F.col("p.regular") + variety)
    full = n.groupBy("piece_id").agg(F.count(F.lit(1)).alias("c")).join(best, "piece_id", "left")
    return full.select("piece_id", F.round(F.when((F.col("c") < 16) | F.col("p").isNull(), 0.3).otherwise(score), 9).alias("phrase"))


def structure(n: DataFrame) -> DataFrame:
    """The parts of the structural score and the score, which few pitches lower."""
    p = key_consistency(n)
    for part in (cadence, phrases, modulation, length):
        p = p.join(part(n), "piece_id")
    p = p.join(n.groupBy("piece_id").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("pitch").alias("u")), "piece_id")
    ramp = F.when((F.col("c") <= 8) | (F.col("u") > 5), 1.0).when(F.col("u") <= 2, 0.1).otherwise(0.2 + (F.col("u") - 2) * 0.27)
    score = 0.25 * F.col("key_consistency") + 0.25 * F.col("cadence") + 0.20 * F.col("phrase") + 0.15 * F.col("modulation") + 0.15 * F.col("length")
    return p.withColumn("structural", F.round(score * ramp, 6)).drop("c", "u")


def structural_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(notes(spark, sf_dir)).select("piece_id", "key_consistency", "cadence", "phrase", "modulation", "length", "structural")


def stagger(n: DataFrame) -> DataFrame:
    """Our own contrapuntal measures: the share of onsets that one voice has alone, the share of joint onsets at which voices
    move in different directions (independence, 1 without any), and the balance of voices by notes."""
    per = n.groupBy("piece_id", "start").agg(F.countDistinct("voice").alias("m")).groupBy("piece_id").agg(F.avg(one(F.col("m") == 1)).alias("stagger"))
    way = F.signum(F.col("pitch") - F.lag("pitch").over(W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")))
    joint = n.withColumn("way", way).groupBy("piece_id", "start").agg(F.count("way").alias("k"), (F.min("way") < F.max("way")).alias("apart")).groupBy("piece_id")
    per = per.join(joint.agg(F.coalesce(F.avg(F.when(F.col("k") > 1, one(F.col("apart")))), F.lit(1.0)).alias("independence")), "piece_id")
    size = n.groupBy("piece_id", "voice").agg(F.count(F.lit(1)).alias("c")).groupBy("piece_id").agg((F.min("c") / F.max("c")).alias("balance"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("voices"))
    return per.join(size, "piece_id").select("piece_id", F.round("stagger", 9).alias("stagger"), F.round("independence", 9).alias("independence"), F.round("balance", 9).alias("balance"), "total", "voices")


def guarded(n: DataFrame) -> DataFrame:
    """piece_id, multiplier and flags of a fugue's guardrails."""
    p = leading(n).join(completeness(n), "piece_id").join(cadence(n), "piece_id").join(stagger(n), "piece_id")
    big = F.col("total") >= 32
    rules = [
        (F.col("voice_leading") < 0.65, 0.80, "low_voice_leading"),
        (F.col("completeness") < 0.50, 0.80, "low_completeness"),
        (big & (F.col("voices") < 4), 0.70, "fugue_missing_voice"),
        (big & (F.col("cadence") < 0.45), 0.85, "fugue_weak_cadence"),
        (big & (F.col("balance") < 0.35), 0.75, "fugue_unbalanced_voices"),
        (big & (F.col("stagger") > 0.90) & (F.col("independence") < 0.45), 0.80, "fugue_fragmented_not_dialogic"),
        (big & (F.col("stagger") < 0.10), 0.85, "fugue_over_lockstep"),
        (big & (F.col("completeness") < 0.65), 0.80, "fugue_incomplete_form"),
    ]
    mult = F.lit(1.0)
    for test, factor, _ in rules:
        mult = mult * F.when(test, factor).otherwise(1.0)
    flags = F.array_join(F.filter(F.array(*(F.when(t, name) for t, _, name in rules)), lambda x: x.isNotNull()), "|")
    return p.withColumn("multiplier", F.round(mult, 9)).withColumn("flags", flags)


def guardrail_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(notes(spark, sf_dir)).select("piece_id", "multiplier", "flags")


def interaction_tests(form: str) -> list[tuple[Column, float]]:
    """What a form's profile asks of the measures, and the step of each: two rewards of rhetoric, one of flow, two penalties."""
    rhetoric, strong, flow, flat, safe, _ = PROFILES[form]
    c = F.col
    return [
        *(((c("cadence") >= r[0]) & (c("phrase") >= r[1]) & (c("key_consistency") >= r[2]), r[3]) for r in (rhetoric, strong)),
        ((c("stagger") >= flow[0]) & (c("contrary") >= flow[1]) & (c("melodic") >= flow[2]), flow[3]),
        ((c("voice_leading") >= flat[0]) & ((c("phrase") < flat[1]) | (c("contrary") < flat[2])), flat[3]),
        ((c("voice_leading") >= safe[0]) & (c("independence") < safe[1]) & (c("stagger") < safe[2]) & (c("contrary") < safe[3]), safe[4]),
    ]


def interaction(form: str) -> tuple[Column, Column]:
    """The bounded sum of the steps, and how many apply."""
    tests, bound = interaction_tests(form), PROFILES[form][-1]
    total = sum((F.when(t, v).otherwise(0.0) for t, v in tests), F.lit(0.0))
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), total)), sum((t.cast("int") for t, _ in tests), F.lit(0))


def motion(n: DataFrame) -> DataFrame:
    """Our own measures for the interaction: contrary, the share of joint onsets of the outer voices at which they move in opposite directions (0
    without any), and melodic, the share of intervals of a fifth at most."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    s = n.withColumn("ivl", F.col("pitch") - F.lag("pitch").over(w))
    melodic = s.groupBy("piece_id").agg(F.avg(F.when(F.col("ivl").isNotNull(), one(F.abs("ivl") <= 7))).alias("melodic"))
    both = s.filter("voice in (0, 3) and ivl is not null").groupBy("piece_id", "start").agg(F.max(F.when(F.col("voice") == 0, F.signum("ivl"))).alias("u"), F.max(F.when(F.col("voice") == 3, F.signum("ivl"))).alias("l")).filter("u is not null and l is not null")
    contrary = both.groupBy("piece_id").agg(F.avg(one(F.col("u") * F.col("l") < 0)).alias("contrary"))
    return melodic.join(contrary, "piece_id", "left").select("piece_id", F.round(F.coalesce("melodic", F.lit(0.0)), 9).alias("melodic"), F.round(F.coalesce("contrary", F.lit(0.0)), 9).alias("contrary"))


def composed(n: DataFrame, form: str = "fugue") -> DataFrame:
    """All measures of each piece, with composite: the weighted sum under the guardrails, plus the interaction of the form's profile."""
    p = guarded(n).join(statistical(n), "piece_id").join(structure(n).drop("cadence"), "piece_id").join(recall(n), "piece_id").join(motion(n), "piece_id")
    value = {k: F.col(k) for k in WEIGHTS} | {"contrapuntal": F.col("stagger"), "thematic_recall": F.col("recall")}
    total = sum((w * value[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    return p.withColumn("composite", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total * F.col("multiplier") + interaction(form)[0])), 5))


def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces as fugues. Contrapuntal, contrary and melodic are our own measures."""
    return composed(notes(spark, sf_dir)).select("piece_id", "composite")


def selection_score(spark: SparkSession, sf_dir: str, groups: int = 10) -> DataFrame:
    """The best two of each group of pieces (ids with the same last digit) by the selection score of fugues, and the best two by that of
    chorales: the composite, raised by stagger and balance and lowered by onsets of three and more; or raised by such onsets and completeness."""
    n = notes(spark, sf_dir)
    dense = n.groupBy("piece_id", "start").agg(F.countDistinct("voice").alias("k")).groupBy("piece_id").agg(F.avg(one(F.col("k") >= 3)).alias("dense"))
    p = composed(n).join(dense, "piece_id")
    fugue = F.col("composite") + 0.12 * F.col("stagger") + 0.05 * F.col("balance") - 0.08 * F.col("dense")
    chorale = F.col("composite") + 0.08 * F.col("dense") + 0.04 * F.col("completeness")
    both = p.select("piece_id", (F.col("piece_id") % groups).alias("prompt"), F.explode(F.array(F.struct(F.lit("fugue").alias("form"), F.round(fugue, 5).alias("selection")), F.struct(F.lit("chorale").alias("form"), F.round(chorale, 5).alias("selection")))).alias("s")).select("piece_id", "prompt", "s.*")
    best = F.row_number().over(W.partitionBy("prompt", "form").orderBy(F.desc("selection"), "piece_id"))
    return both.withColumn("rank", best).filter("rank <= 2")


QUERIES = {f.__name__: f for f in (cadence_events, phrase_islands, voice_leading_score, statistical_score, structural_score, completeness_score, guardrail_flags, composite_score, selection_score)}


def leading_sql(n: str) -> str:
    return f"""vp AS (SELECT DISTINCT a.piece_id, a.voice AS vu, b.voice AS vl FROM (SELECT DISTINCT piece_id, voice FROM {n}) a JOIN (SELECT DISTINCT piece_id, voice FROM {n}) b ON a.piece_id = b.piece_id AND a.voice < b.voice),
vo AS (SELECT DISTINCT vp.piece_id, vu, vl, start AS tick FROM vp JOIN {n} x ON x.piece_id = vp.piece_id AND x.voice IN (vu, vl)),
vq AS (SELECT DISTINCT piece_id, tick, voice FROM (SELECT piece_id, tick, vu AS voice FROM vo UNION SELECT piece_id, tick, vl FROM vo)),
va AS (SELECT q.piece_id, q.tick, q.voice, (SELECT CASE WHEN x.start + x.dur > q.tick THEN x.pitch END FROM {n} x WHERE x.piece_id = q.piece_id AND x.voice = q.voice AND x.start <= q.tick ORDER BY x.start DESC, x.event_id DESC LIMIT 1) AS pitch FROM vq q),
vx AS (SELECT vo.piece_id, vu, vl, vo.tick, a.pitch AS u, b.pitch AS l FROM vo JOIN va a ON a.piece_id = vo.piece_id AND a.tick = vo.tick AND a.voice = vu JOIN va b ON b.piece_id = vo.piece_id AND b.tick = vo.tick AND b.voice = vl WHERE a.pitch IS NOT NULL OR b.pitch IS NOT NULL),
vt AS (SELECT *, lag(u) OVER w AS pu, lag(l) OVER w AS pl FROM vx WINDOW w AS (PARTITION BY piece_id, vu, vl ORDER BY tick)),
vs AS (SELECT *, (sign(u - pu) * sign(l - pl) > 0) AS same, ((u - l) % 12 + 12) % 12 AS nw, ((pu - pl) % 12 + 12) % 12 AS bf FROM vt),
vm AS (SELECT piece_id, vu, vl, count(*) AS aligned, sum(CASE WHEN same AND bf = 7 AND nw = 7 THEN 2.0 ELSE 0 END + CASE WHEN same AND abs(pu - pl) = abs(u - l) AND nw = 0 AND pu <> pl THEN 2.5 WHEN same AND bf = 0 AND nw = 0 THEN 1.25 ELSE 0 END + CASE WHEN u < l AND pu IS NOT NULL AND pl IS NOT NULL THEN 1.0 ELSE 0 END) AS moved FROM vs GROUP BY 1, 2, 3),
vl0 AS (SELECT *, pitch - lag(pitch) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx) AS ivl FROM {n}), vl1 AS (SELECT *, lag(ivl) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx) AS before FROM vl0),
vv AS (SELECT piece_id, voice, sum(CASE WHEN abs(ivl) > 12 THEN 1.5 WHEN abs(ivl) IN (6, 10, 11) THEN 0.5 ELSE 0 END + CASE WHEN abs(before) > 5 AND abs(ivl) > 2 THEN 0.24 ELSE 0 END) AS leaps, count(*) AS c, list_distinct(list(pitch)) AS ps FROM vl1 GROUP BY 1, 2),
vz AS (SELECT vm.piece_id, aligned, greatest(0.0, 1 - (moved + a.leaps + b.leaps) / greatest(aligned - 1, 1)) AS raw, a.c + b.c AS c, len(list_distinct(list_concat(a.ps, b.ps))) AS q FROM vm JOIN vv a ON a.piece_id = vm.piece_id AND a.voice = vu JOIN vv b ON b.piece_id = vm.piece_id AND b.voice = vl),
ld AS (SELECT piece_id, round(avg(CASE WHEN aligned < 2 THEN 0.5 ELSE raw * CASE WHEN c <= 4 THEN 1.0 WHEN q <= 2 THEN 0.1 WHEN q <= 5 THEN 0.3 + (q - 2) * 0.23 ELSE 1.0 END END), 9) AS voice_leading FROM vz GROUP BY 1)"""


def last_sql(voice: int, name: str) -> str:
    return f"""{name} AS (SELECT piece_id, max(pitch) FILTER (r = 1) AS p1, max(pitch) FILTER (r = 2) AS p2, max(pitch) FILTER (r = 3) AS p3, max(dur) FILTER (r = 1) AS d1, max(start) FILTER (r = 1) AS s1 FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY note_idx DESC) AS r FROM n WHERE voice = {voice}) WHERE r <= 3 GROUP BY 1)"""


COMPLETE_SQL = f"""{last_sql(0, "es")}, {last_sql(3, "eb")}, pv AS (SELECT piece_id, voice, min(start) AS f, max(start + dur) AS e FROM n GROUP BY 1, 2), wh AS (SELECT piece_id, min(f) AS lo, max(e) AS hi, count(*) AS voices, max(f) AS late, min(e) AS early FROM pv GROUP BY 1),
cm AS (SELECT piece_id, round(least(1.0, CASE WHEN voices >= 2 THEN 0.25 ELSE 0 END + CASE WHEN (hi - lo) / 1920.0 >= 8 THEN 0.15 WHEN (hi - lo) / 1920.0 >= 4 THEN 0.08 ELSE 0 END + CASE WHEN late < lo + 1920 THEN 0.10 ELSE 0 END + CASE WHEN early > hi - 1920 THEN 0.10 ELSE 0 END
 + CASE WHEN es.d1 >= 480 AND eb.d1 >= 480 THEN 0.15 ELSE 0 END + CASE WHEN eb.p1 % 12 = key_root THEN 0.15 ELSE 0 END + CASE WHEN abs(es.s1 + es.d1 - eb.s1 - eb.d1) < 960 THEN 0.10 ELSE 0 END), 9) AS completeness FROM wh JOIN es USING (piece_id) JOIN eb USING (piece_id) JOIN pc USING (piece_id))"""
CADENCE_SQL = """bs AS (SELECT *, lead(start) OVER w AS nx, lag(pitch) OVER w AS pv, count(*) OVER (PARTITION BY piece_id) AS m FROM n WHERE voice = 3 WINDOW w AS (PARTITION BY piece_id ORDER BY start, note_idx)),
pt AS (SELECT bs.piece_id, least(1.0, sum(CASE WHEN pitch % 12 = key_root AND pv % 12 = (key_root + 7) % 12 THEN 2 WHEN pitch % 12 IN (key_root, (key_root + 7) % 12) THEN 1 ELSE 0 END) * 1.0 / count(*)) AS inn FROM bs JOIN pc USING (piece_id) WHERE m >= 4 AND nx IS NOT NULL AND (dur >= 960 OR nx - start - dur >= 480) GROUP BY 1),
cd AS (SELECT es.piece_id, round(least(1.0, CASE WHEN eb.p1 % 12 = key_root THEN 0.15 ELSE 0 END + CASE WHEN es.p1 % 12 = key_root THEN 0.10 WHEN es.p1 % 12 = (key_root + CASE WHEN key_mode = 'major' THEN 4 ELSE 3 END) % 12 THEN 0.08 ELSE 0 END
 + CASE WHEN eb.p1 % 12 = key_root AND eb.p2 % 12 = (key_root + 7) % 12 THEN 0.15 + CASE WHEN eb.p3 % 12 IN ((key_root + 2) % 12, (key_root + 5) % 12) THEN 0.10 ELSE 0 END ELSE 0 END
 + 0.30 * coalesce(inn, 0.3) + CASE WHEN eb.d1 >= 960 THEN 0.10 ELSE 0 END + CASE WHEN es.d1 >= 960 THEN 0.10 ELSE 0 END), 9) AS cadence FROM es JOIN eb USING (piece_id) JOIN pc USING (piece_id) LEFT JOIN pt USING (piece_id))"""
STRUCTURE_SQL = f"""wq AS (SELECT piece_id, CAST((start - min(start) OVER (PARTITION BY piece_id)) // 3840 AS BIGINT) AS win, pitch FROM n), wn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY piece_id, win) AS m FROM wq) WHERE m >= 4), kb AS (WITH {H.keys_sql("wn", "piece_id, win")}),
kd AS (SELECT DISTINCT kb.piece_id, kb.key_root AS r, kb.key_mode AS m FROM kb WHERE corr > 0.5),
ks AS (SELECT kd.piece_id, count(*) AS k, count(*) FILTER ((r - key_root + 12) % 12 IN (0, 7) OR ((r - key_root + 12) % 12 = 5 AND m = key_mode) OR ((r - key_root + 12) % 12 = CASE WHEN key_mode = 'major' THEN 9 ELSE 3 END AND m <> key_mode)) AS nr FROM kd JOIN pc USING (piece_id) GROUP BY 1),
md AS (SELECT piece_id, round(CASE WHEN c < 16 THEN 0.3 WHEN k IS NULL OR k <= 1 THEN 0.4 ELSE 0.6 * CASE WHEN nr >= 2 AND k - nr <= 1 THEN 1.0 WHEN nr >= 2 THEN greatest(0.5, 1 - (k - nr) * 0.15) ELSE 0.4 END + 0.4 * CASE WHEN k = 2 THEN 0.7 WHEN k <= 4 THEN 1.0 WHEN k <= 6 THEN 0.8 ELSE greatest(0.4, 1 - (k - 6) * 0.1) END END, 9) AS modulation FROM (SELECT piece_id, count(*) AS c FROM n GROUP BY 1) LEFT JOIN ks USING (piece_id)),
ln AS (SELECT piece_id, round(CASE WHEN b < 4 THEN 0.1 WHEN b < 12 THEN 0.3 + 0.4 * (b - 4) / 8 WHEN b <= 60 THEN 0.8 + 0.2 * least(1.0, (b - 12) / 20) ELSE greatest(0.5, 1 - (b - 60) / 60) END, 9) AS length FROM (SELECT piece_id, (max(start + dur) - min(start)) / 1920.0 AS b FROM n GROUP BY 1)),
kx AS (SELECT pc.piece_id, pcl, key_root, key_mode, count(n.pitch) AS c FROM pc CROSS JOIN (SELECT unnest(range(12)) AS pcl) LEFT JOIN n ON n.piece_id = pc.piece_id AND n.pitch % 12 = pcl GROUP BY 1, 2, 3, 4),
kc2 AS (SELECT piece_id, round(least(1.0, greatest(0.0, (coalesce(corr(c, CASE WHEN key_mode = 'major' THEN ({PROFILE_MAJOR})[(pcl - key_root + 12) % 12 + 1] ELSE ({PROFILE_MINOR})[(pcl - key_root + 12) % 12 + 1] END), 0) + 0.2) / 1.2)), 9) AS key_consistency FROM kx GROUP BY 1),
pg AS (SELECT piece_id, unnest(range(CAST(min(start) AS BIGINT), CAST(max(start + dur) AS BIGINT), 480)) AS tick, CAST(max(start + dur) AS BIGINT) AS hi FROM n GROUP BY 1), ps AS (SELECT DISTINCT pg.piece_id, tick FROM pg JOIN n ON n.piece_id = pg.piece_id AND start <= tick AND tick < start + least(dur, 3840)),
pw AS (SELECT pg.*, ps.tick IS NOT NULL AS active, lag(ps.tick IS NOT NULL) OVER (PARTITION BY pg.piece_id ORDER BY pg.tick) AS was FROM pg LEFT JOIN ps ON ps.piece_id = pg.piece_id AND ps.tick = pg.tick), px AS (SELECT *, lead(tick) OVER (PARTITION BY piece_id ORDER BY tick) AS nx FROM pw WHERE was IS NULL OR was <> active),
py AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY piece_id) AS m FROM n WHERE voice = 0 WINDOW w AS (PARTITION BY piece_id ORDER BY start, note_idx)), pz AS (SELECT *, lag(CASE WHEN i = 1 THEN start ELSE start + dur END) OVER (PARTITION BY piece_id ORDER BY i) AS since FROM py WHERE m >= 4 AND (i = 1 OR dur >= 720)),
pl AS (SELECT piece_id, 0 AS how, coalesce(nx, hi) - tick AS ticks FROM px WHERE active OR nx IS NULL UNION ALL SELECT piece_id, 1, start + dur - since FROM pz WHERE i > 1),
pq AS (SELECT *, ticks / 1920.0 AS b, CASE WHEN abs(ticks / 1920.0 - 2) <= abs(ticks / 1920.0 - 4) THEN 2 WHEN abs(ticks / 1920.0 - 4) <= abs(ticks / 1920.0 - 8) THEN 4 ELSE 8 END AS s FROM pl WHERE ticks > 960),
pr AS (SELECT piece_id, how, count(*) AS k, avg(greatest(0.0, 1 - abs(b - s) / s)) AS rg, count(DISTINCT round_even(b, 0)) * 1.0 / count(*) AS u FROM pq GROUP BY 1, 2 HAVING count(*) >= 2), pu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY how) AS r FROM pr) WHERE r = 1),
ph AS (SELECT piece_id, c, q, round(CASE WHEN c < 16 OR k IS NULL THEN 0.3 ELSE least(1.0, 0.3 + 0.4 * rg + CASE WHEN k < 3 THEN 0.15 WHEN u < 0.2 THEN 0.15 WHEN u <= 0.7 THEN 0.3 ELSE 0.3 * greatest(0.3, 1 - (u - 0.7) * 2) END) END, 9) AS phrase FROM (SELECT piece_id, count(*) AS c, count(DISTINCT pitch) AS q FROM n GROUP BY 1) LEFT JOIN pu USING (piece_id)),
sr AS (SELECT piece_id, key_consistency, cadence, phrase, modulation, length, round((0.25 * key_consistency + 0.25 * cadence + 0.20 * phrase + 0.15 * modulation + 0.15 * length) * CASE WHEN c <= 8 OR q > 5 THEN 1.0 WHEN q <= 2 THEN 0.1 ELSE 0.2 + (q - 2) * 0.27 END, 6) AS structural FROM kc2 JOIN cd USING (piece_id) JOIN md USING (piece_id) JOIN ln USING (piece_id) JOIN ph USING (piece_id))"""


def share_sql(name: str, source: str, value: str, bins: int) -> str:
    """Dense shares by piece (p) and for the corpus (q)."""
    return f"""{name}0 AS (SELECT piece_id, {value} AS bin FROM {source}), {name}1 AS (SELECT a.piece_id, b.bin, count(x.bin) AS c FROM (SELECT DISTINCT piece_id FROM {name}0) a CROSS JOIN (SELECT unnest(range({bins})) AS bin) b LEFT JOIN {name}0 x ON x.piece_id = a.piece_id AND x.bin = b.bin GROUP BY 1, 2),
{name}2 AS (SELECT piece_id, bin, round(CASE WHEN sum(c) OVER (PARTITION BY piece_id) > 0 THEN c * 1.0 / sum(c) OVER (PARTITION BY piece_id) ELSE 1.0 / {bins} END, 9) AS p, round(sum(c) OVER (PARTITION BY bin) * 1.0 / sum(c) OVER (), 9) AS q FROM {name}1),
{name}3 AS (SELECT piece_id, (p + 1e-10) / sum(p + 1e-10) OVER (PARTITION BY piece_id) AS p, (q + 1e-10) / sum(q + 1e-10) OVER (PARTITION BY piece_id) AS q FROM {name}2),
{name}4 AS (SELECT piece_id, sqrt(greatest(0.0, sum((p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2))) AS d FROM {name}3 GROUP BY 1)"""


STATISTICAL_SQL = f"""{H.STEPS_SQL}, {share_sql("ja", "n", "pitch % 12", 12)}, {share_sql("jb", "st", "CASE WHEN ivl IS NOT NULL THEN least(greatest(ivl, -12), 12) + 12 END", 25)}, {share_sql("jc", "n", f"list_position({H.DURATIONS}, dur) - 1", 11)},
{share_sql("jd", "(SELECT * FROM st WHERE before IS NOT NULL)", f"{H.kind_sql('before')} * 5 + {H.kind_sql('ivl')}", 25)}, je AS (SELECT piece_id, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS ent FROM jd2 GROUP BY 1),
sa AS (SELECT piece_id, round(greatest(0.0, 1 - 2 * (0.20 * ja4.d + 0.25 * jb4.d + 0.20 * jc4.d + 0.35 * (ent / 4.643856189774724 * 0.5))), 6) AS statistical FROM ja4 JOIN jb4 USING (piece_id) JOIN jc4 USING (piece_id) JOIN je USING (piece_id))"""
GUARD_SQL = """iw AS (SELECT piece_id, start, sign(pitch - lag(pitch) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx)) AS way FROM n),
iv AS (SELECT piece_id, round(coalesce(avg(CASE WHEN k > 1 THEN CASE WHEN d > 1 THEN 1.0 ELSE 0.0 END END), 1.0), 9) AS independence FROM (SELECT piece_id, start, count(way) AS k, count(DISTINCT way) AS d FROM iw GROUP BY 1, 2) GROUP BY 1),
og AS (SELECT piece_id, round(avg(CASE WHEN m = 1 THEN 1.0 ELSE 0.0 END), 9) AS stagger FROM (SELECT piece_id, start, count(DISTINCT voice) AS m FROM n GROUP BY 1, 2) GROUP BY 1),
sz AS (SELECT piece_id, round(min(c) * 1.0 / max(c), 9) AS balance, sum(c) AS total, count(*) AS voices FROM (SELECT piece_id, voice, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1),
ge AS (SELECT *, [CASE WHEN voice_leading < 0.65 THEN 'low_voice_leading' END, CASE WHEN completeness < 0.50 THEN 'low_completeness' END, CASE WHEN total >= 32 AND voices < 4 THEN 'fugue_missing_voice' END, CASE WHEN total >= 32 AND cadence < 0.45 THEN 'fugue_weak_cadence' END,
 CASE WHEN total >= 32 AND balance < 0.35 THEN 'fugue_unbalanced_voices' END, CASE WHEN total >= 32 AND stagger > 0.90 AND independence < 0.45 THEN 'fugue_fragmented_not_dialogic' END, CASE WHEN total >= 32 AND stagger < 0.10 THEN 'fugue_over_lockstep' END, CASE WHEN total >= 32 AND completeness < 0.65 THEN 'fugue_incomplete_form' END] AS fl FROM ld JOIN cm USING (piece_id) JOIN cd USING (piece_id) JOIN og USING (piece_id) JOIN iv USING (piece_id) JOIN sz USING (piece_id)),
gr AS (SELECT *, array_to_string(list_filter(fl, lambda x: x IS NOT NULL), '|') AS flags, round(CASE WHEN fl[1] IS NULL THEN 1 ELSE 0.8 END * CASE WHEN fl[2] IS NULL THEN 1 ELSE 0.8 END * CASE WHEN fl[3] IS NULL THEN 1 ELSE 0.7 END * CASE WHEN fl[4] IS NULL THEN 1 ELSE 0.85 END * CASE WHEN fl[5] IS NULL THEN 1 ELSE 0.75 END * CASE WHEN fl[6] IS NULL THEN 1 ELSE 0.8 END * CASE WHEN fl[7] IS NULL THEN 1 ELSE 0.85 END * CASE WHEN fl[8] IS NULL THEN 1 ELSE 0.8 END, 9) AS multiplier FROM ge)"""
def interaction_sql(form: str) -> tuple[str, str]:
    """The bounded sum of a profile's steps, and how many apply."""
    a, b, c, d, e, bound = PROFILES[form]
    tests = [f"cadence >= {r[0]} AND phrase >= {r[1]} AND key_consistency >= {r[2]}" for r in (a, b)] + [f"stagger >= {c[0]} AND contrary >= {c[1]} AND melodic >= {c[2]}", f"voice_leading >= {d[0]} AND (phrase < {d[1]} OR contrary < {d[2]})", f"voice_leading >= {e[0]} AND independence < {e[1]} AND stagger < {e[2]} AND contrary < {e[3]}"]
    steps = [x[-1] for x in (a, b, c, d, e)]
    return f"greatest(-{bound}, least({bound}, {' + '.join(f'CASE WHEN {t} THEN {v} ELSE 0 END' for t, v in zip(tests, steps, strict=True))}))", " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests)


COMPOSITE_SQL = f"""{NOTES_SQL}, {leading_sql('n')}, {COMPLETE_SQL}, {CADENCE_SQL}, {GUARD_SQL}, {STATISTICAL_SQL}, {STRUCTURE_SQL}, {RECALL_SQL},
mo AS (SELECT *, pitch - lag(pitch) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx) AS ivl FROM n), ml AS (SELECT piece_id, round(coalesce(avg(CASE WHEN ivl IS NOT NULL THEN CASE WHEN abs(ivl) <= 7 THEN 1.0 ELSE 0.0 END END), 0.0), 9) AS melodic FROM mo GROUP BY 1),
mb AS (SELECT piece_id, start, max(sign(ivl)) FILTER (voice = 0) AS u, max(sign(ivl)) FILTER (voice = 3) AS l FROM mo WHERE ivl IS NOT NULL GROUP BY 1, 2), mc AS (SELECT piece_id, round(avg(CASE WHEN u * l < 0 THEN 1.0 ELSE 0.0 END), 9) AS contrary FROM mb WHERE u IS NOT NULL AND l IS NOT NULL GROUP BY 1),
cp AS (SELECT gr.piece_id, gr.voice_leading, gr.completeness, gr.cadence, stagger, independence, balance, multiplier, statistical, key_consistency, phrase, structural, recall, melodic, coalesce(contrary, 0.0) AS contrary FROM gr JOIN sa USING (piece_id) JOIN sr USING (piece_id) JOIN tr USING (piece_id) JOIN ml USING (piece_id) LEFT JOIN mc USING (piece_id)),
co AS (SELECT *, round(greatest(0.0, least(1.0, (0.20 * voice_leading + 0.09 * statistical + 0.22 * structural + 0.20 * stagger + 0.24 * recall + 0.05 * completeness) * multiplier + {interaction_sql('fugue')[0]})), 5) AS composite FROM cp)"""
SQL = {
    "cadence_events": f"""WITH {NOTES_SQL}, v AS (SELECT *, lag(pitch) OVER (PARTITION BY piece_id, voice ORDER BY start, note_idx) AS prev FROM n), br AS (SELECT piece_id, voices, unnest(range(1920, m + 1, 1920)) AS tick FROM (SELECT piece_id, CAST(max(start + dur) AS BIGINT) AS m, count(DISTINCT voice) AS voices FROM n GROUP BY 1)),
h AS (SELECT br.piece_id, tick, voices, count(v.pitch) AS sounding, count(*) FILTER (dur >= 960 OR abs(start + dur - tick) <= 120) AS settled, max(pitch) FILTER (voice = 3) AS bp, max(prev) FILTER (voice = 3) AS bv, max(dur) FILTER (voice = 3) AS bd0, max(pitch) FILTER (voice = 0) AS sp, max(dur) FILTER (voice = 0) AS sd0 FROM br JOIN v ON v.piece_id = br.piece_id AND start <= tick AND tick < start + dur GROUP BY 1, 2, 3),
d AS (SELECT h.*, nullif(list_position({SCALE_SQL.replace("[0,2,4,5,7,9,11]", "list_transform([0,2,4,5,7,9,11], lambda q: (q + key_root) % 12)").replace("[0,2,3,5,7,8,11]", "list_transform([0,2,3,5,7,8,11], lambda q: (q + key_root) % 12)")}, bp % 12), 0) AS bd, nullif(list_position({SCALE_SQL}, (bv % 12 - key_root + 12) % 12), 0) AS pd, nullif(list_position({SCALE_SQL}, (sp % 12 - key_root + 12) % 12), 0) AS sd, bp - bv AS mv FROM h JOIN pc USING (piece_id) WHERE bp IS NOT NULL AND bv IS NOT NULL),
e AS (SELECT *, (mv IN (5, -7) OR (abs(mv) <= 12 AND ((mv % 12) + 12) % 12 = 5)) AS dom, coalesce(pd IN (2, 4), FALSE) AS pre, settled + voices - sounding >= greatest(2, ceil(voices * 0.5)) AS conv, (bd0 >= 960 OR coalesce(sd0 >= 960, FALSE)) AS lng FROM d),
f AS (SELECT piece_id, tick, CAST(tick // 1920 AS BIGINT) AS bar_index, CASE WHEN bd = 1 AND dom THEN CASE WHEN sd = 1 THEN 'CAD_PAC' WHEN sd IN (3, 5) THEN 'CAD_IAC' END WHEN bd = 5 AND (pre OR conv) THEN 'CAD_HC' WHEN bd = 6 AND dom THEN 'CAD_DC' END AS label, CAST(CASE WHEN bd = 5 THEN CAST(pre AS INT) ELSE 1 END + CAST(conv AS INT) + CAST(lng AS INT) AS DOUBLE) AS confidence FROM e) SELECT * FROM f WHERE label IS NOT NULL AND confidence >= 2""",
    "phrase_islands": f"""WITH {NOTES_SQL}, u AS (SELECT * FROM n2), gd AS (SELECT piece_id, unnest(range(CAST(min(start) AS BIGINT), CAST(max(start + dur) AS BIGINT), 480)) AS tick FROM u GROUP BY 1), ac AS (SELECT gd.piece_id, gd.tick, EXISTS (SELECT 1 FROM u WHERE u.piece_id = gd.piece_id AND start <= tick AND tick < start + least(dur, 3840)) AS active FROM gd),
e AS (SELECT *, CASE WHEN active = lag(active) OVER (PARTITION BY piece_id ORDER BY tick) THEN 0 ELSE 1 END AS edge FROM ac), r AS (SELECT *, sum(edge) OVER (PARTITION BY piece_id ORDER BY tick) AS run FROM e) SELECT piece_id, min(tick) AS begin_tick, max(tick) + 480 AS end_tick FROM r WHERE active GROUP BY piece_id, run""",
    "voice_leading_score": f"WITH {NOTES_SQL}, {leading_sql('n2')} SELECT * FROM ld",
    "statistical_score": f"WITH {NOTES_SQL}, {STATISTICAL_SQL} SELECT * FROM sa",
    "structural_score": f"WITH {NOTES_SQL}, {COMPLETE_SQL}, {CADENCE_SQL}, {STRUCTURE_SQL} SELECT * FROM sr",
    "completeness_score": f"WITH {NOTES_SQL}, {COMPLETE_SQL} SELECT * FROM cm",
    "guardrail_flags": f"WITH {NOTES_SQL}, {leading_sql('n')}, {COMPLETE_SQL}, {CADENCE_SQL}, {GUARD_SQL} SELECT piece_id, multiplier, flags FROM gr",
    "composite_score": f"WITH RECURSIVE {COMPOSITE_SQL} SELECT piece_id, composite FROM co",
    "selection_score": f"""WITH RECURSIVE {COMPOSITE_SQL}, ds AS (SELECT piece_id, avg(CASE WHEN k >= 3 THEN 1.0 ELSE 0.0 END) AS dense FROM (SELECT piece_id, start, count(DISTINCT voice) AS k FROM n GROUP BY 1, 2) GROUP BY 1),
bo AS (SELECT piece_id, piece_id % 10 AS prompt, 'fugue' AS form, round(composite + 0.12 * stagger + 0.05 * balance - 0.08 * dense, 5) AS selection FROM co JOIN ds USING (piece_id) UNION ALL SELECT piece_id, piece_id % 10, 'chorale', round(composite + 0.08 * dense + 0.04 * completeness, 5) FROM co JOIN ds USING (piece_id))
SELECT piece_id, prompt, form, selection, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt, form ORDER BY selection DESC, piece_id) AS r FROM bo) WHERE r <= 2""",
}
