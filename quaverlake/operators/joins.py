"""Interval and as-of joins on tick axes, n-gram joins, and the pairings of voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.plans.views import NOTES_SQL, notes

#: Ticks of a bucket of the tick axis: range joins get a bucket as a further equi-key, so that a long piece spreads out.
BUCKET = 7680


def stab(probes: DataFrame, held: DataFrame, keys: list[str], tick: str = "tick") -> DataFrame:
    """Every probe with every row of `held` that sounds at its tick (start <= tick < start + dur), on equal keys.

    Each held row is repeated for the buckets that it reaches, so the join is an equi-join with a short residual. It is a merge join: as a
    file or after a shuffle notes are small enough to be broadcast, but not in the driver's memory.
    """
    spread = held.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + F.col("dur") - 1) / BUCKET))))
    at = probes.withColumn("_b", F.floor(F.col(tick) / BUCKET))
    return at.join(spread.hint("merge"), [*keys, "_b"]).filter(f"start <= {tick} and {tick} < start + dur").drop("_b")


def as_of(probes: DataFrame, held: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """Each probe (keys, tick) with the pitch of the latest row that started by then, null if that has ended, and `hit`, whether it starts there.

    Union and one window over the keys: no join, and a row that started last hides older ones that still sound. The rows are shuffled by the
    keys, or by the one of them that `within` names.
    """
    both = probes.select(*keys, "tick", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("struct<e:bigint,p:int,s:bigint>").alias("note"))
    both = both.unionByName(held.select(*keys, F.col("start").alias("tick"), F.lit(0).alias("kind"), F.col("event_id").alias("seq"), F.struct((F.col("start") + F.col("dur")).cast("long").alias("e"), F.col("pitch").cast("int").alias("p"), F.col("start").cast("long").alias("s")).alias("note")))
    both = both.repartition(within) if within else both
    w = W.partitionBy(*keys).orderBy("tick", "kind", "seq").rowsBetween(W.unboundedPreceding, 0)
    last = both.withColumn("last", F.last("note", ignorenulls=True).over(w)).filter("kind = 1")
    return last.select(*keys, "tick", F.when(F.col("last.e") > F.col("tick"), F.col("last.p")).alias("pitch"), (F.col("last.s") == F.col("tick")).alias("hit"))


def ngrams(n: DataFrame, k: int) -> DataFrame:
    """piece_id, voice, start, gram: k successive intervals from each note."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    steps = n.withColumn("ivl", F.lead("pitch").over(w) - F.col("pitch"))
    grams = steps.withColumn("gram", F.collect_list("ivl").over(w.rowsBetween(0, k - 1)))
    return grams.filter(F.size("gram") == k).select("piece_id", "voice", "start", "gram")


#: Bits of an interval in a coded gram: intervals of up to 510 semitones, and six of them in a long.
WIDTH = 10


def coded_grams(n: DataFrame, k: int) -> DataFrame:
    """piece_id, voice, start, code: k successive intervals (six at most) from each note, as one long."""
    w = W.partitionBy("piece_id", "voice").orderBy("start", "note_idx")
    at = [F.col("pitch"), *(F.lead("pitch", i).over(w) for i in range(1, k + 1))]
    code = sum((F.shiftleft((b - a + (1 << WIDTH - 1)).cast("long"), WIDTH * i) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))), F.lit(0).cast("long"))
    return n.select("piece_id", "voice", "start", code.alias("code")).filter("code is not null")


def near_codes(code: Column, k: int) -> Column:
    """The coded gram and all that differ from it by one in one place."""
    return F.array(code, *(code + F.lit(d << WIDTH * i) for i in range(k) for d in (-1, 1)))


def near_grams(g: DataFrame, k: int) -> DataFrame:
    """piece_id, voice, gram, c, own: for each distinct coded gram of a voice the grams near it, with how often it occurs (own: where it is the gram itself).

    Grams that are near agree in a half, so those that share neither half with another voice go first.
    """
    d, half = g.groupBy("piece_id", "code", "voice").agg(F.count(F.lit(1)).alias("c")), WIDTH * (k // 2)
    for name, value in (("low", F.col("code").bitwiseAND((1 << half) - 1)), ("high", F.shiftright("code", half))):
        w = W.partitionBy("piece_id", name)
        d = d.withColumn(name, value).withColumn(f"shared_{name}", F.min("voice").over(w) < F.max("voice").over(w))
    near = d.filter("shared_low or shared_high").select("piece_id", "voice", "code", "c", F.explode(near_codes(F.col("code"), k)).alias("gram"))
    return near.select("piece_id", "voice", "gram", "c", F.when(F.col("gram") == F.col("code"), F.col("c")).otherwise(0).alias("own"))


def fuzzy_counts(n: DataFrame, k: int = 6, apart: int = 480) -> DataFrame:
    """piece_id, voice_a < voice_b, matches: pairs of grams at L1 distance 0 or 1 and at least `apart` ticks apart.

    Coded grams are shuffled once, by piece; all else stays in the tasks of a piece. Equal grams of a voice are counted before their near grams
    are exploded, and pairs are not made but counted at each gram: all pairs of two voices by their counts of it, less the near ones among
    those that start less than `apart` from each other, which a window on ticks finds. There are no joins.
    """
    g = coded_grams(n, k).repartition("piece_id")
    per = near_grams(g, k).groupBy("piece_id", "gram", "voice").agg(F.sum("c").alias("c"), F.sum("own").alias("own"))
    above = F.collect_list(F.struct("voice", "c")).over(W.partitionBy("piece_id", "gram").orderBy("voice").rowsBetween(W.unboundedPreceding, -1))
    every = per.withColumn("a", above).filter("own > 0").select("piece_id", F.explode("a").alias("x"), "voice", "own")
    around = F.collect_list(F.struct("voice", "code")).over(W.partitionBy("piece_id").orderBy("start").rangeBetween(1 - apart, apart - 1))
    steps = [0, *(d << WIDTH * i for i in range(k) for d in (-1, 1))]
    close = g.withColumn("a", around).select("piece_id", F.explode("a").alias("x"), "voice", "code").filter(F.col("x.voice") < F.col("voice")).filter((F.col("x.code") - F.col("code")).isin(steps))
    both = every.select("piece_id", F.col("x.voice").alias("voice_a"), F.col("voice").alias("voice_b"), (F.col("x.c") * F.col("own")).alias("matches")).unionByName(close.select("piece_id", F.col("x.voice").alias("voice_a"), F.col("voice").alias("voice_b"), F.lit(-1).cast("long").alias("matches")))
    return both.groupBy("piece_id", "voice_a", "voice_b").agg(F.sum("matches").alias("matches")).filter("matches > 0")


def beats(n: DataFrame, step: int = 480) -> DataFrame:
    """piece_id and a tick for each beat of the piece."""
    return n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).alias("m")).select("piece_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("m") - 1).cast("long"), F.lit(step).cast("long"))).alias("tick"))


def asof_pitch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir, shifted=True)
    probes = beats(n).join(n.select("piece_id", "voice").distinct(), "piece_id")
    return as_of(probes, n, ["piece_id", "voice"]).drop("hit")


def interval_stab_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir, shifted=True)
    met = stab(beats(n), n.drop("event_id"), ["piece_id"])
    return met.groupBy("piece_id", "tick").agg(F.bit_or(F.expr("shiftleft(1, cast(pitch % 12 as int))")).cast("long").alias("mask"))


def voice_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices 0 and 1 at every onset of either, where one of them sounds."""
    n = notes(spark, sf_dir, shifted=True).filter("voice < 2")
    onsets = n.select("piece_id", F.col("start").alias("tick")).distinct()
    probes = onsets.withColumn("voice", F.explode(F.array(F.lit(0), F.lit(1))))
    found = as_of(probes, n, ["piece_id", "voice"])
    both = found.groupBy("piece_id", "tick").agg(F.max(F.when(F.col("voice") == 0, F.col("pitch"))).alias("upper"), F.max(F.when(F.col("voice") == 1, F.col("pitch"))).alias("lower"))
    return both.filter("upper is not null or lower is not null")


def onset_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a piece's onsets at which 1, 2, 3 or 4 voices start."""
    per = notes(spark, sf_dir).groupBy("piece_id", "start").agg(F.countDistinct("voice").alias("m"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return per.groupBy("piece_id").agg(F.count(F.lit(1)).alias("onsets"), *(share(F.col("m") == k).alias(f"share_{k}") for k in (1, 2, 3, 4)), share(F.col("m") >= 3).alias("share_3or4"))


def voice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent voices and the outer pair of each piece, with the share of head notes that cross within half a beat; voices that cross at more than
    half of them are swapped, and a pair is valid if both voices reach over 16 quarters."""
    n = notes(spark, sf_dir)
    head = n.filter("note_idx < 20").select("piece_id", "voice", "start", "pitch")
    last = n.groupBy("piece_id").agg(F.max("voice").alias("last"))
    a, b = (head.select("piece_id", F.col("voice").alias(f"voice_{s}"), F.col("start").alias(f"start_{s}"), F.col("pitch").alias(f"pitch_{s}")) for s in "ab")
    met = a.join(b, "piece_id").join(last, "piece_id").filter("voice_b = voice_a + 1 or (voice_a = 0 and voice_b = last and last > 1)").filter("abs(start_a - start_b) < 240")
    pairs = met.groupBy("piece_id", "voice_a", "voice_b").agg(F.count(F.lit(1)).alias("near"), F.round(F.avg(F.when(F.col("pitch_a") < F.col("pitch_b"), 1.0).otherwise(0.0)), 9).alias("crossed"))
    span = n.groupBy("piece_id", "voice").agg((F.max(F.col("start") + F.col("dur")) - F.min("start")).alias("span"))
    for s in "ab":
        pairs = pairs.join(span.withColumnsRenamed({"voice": f"voice_{s}", "span": f"span_{s}"}), ["piece_id", f"voice_{s}"])
    swap = F.col("crossed") > 0.5
    upper, lower = F.when(swap, F.col("voice_b")).otherwise(F.col("voice_a")), F.when(swap, F.col("voice_a")).otherwise(F.col("voice_b"))
    return pairs.select("piece_id", upper.alias("upper"), lower.alias("lower"), "near", "crossed", swap.alias("swapped"), (F.least("span_a", "span_b") >= 7680).alias("valid"))


def voice_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three consecutive voices, with the notes they hold."""
    per = notes(spark, sf_dir).groupBy("piece_id", "voice").agg(F.count(F.lit(1)).alias("c"))
    arr = per.groupBy("piece_id").agg(F.array_sort(F.collect_list(F.struct("voice", "c"))).alias("v"))
    win = arr.filter("size(v) >= 3").select("piece_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("v") - 2), lambda i: F.slice("v", i, 3))).alias("group_idx", "g"))
    return win.select("piece_id", "group_idx", F.aggregate("g", F.lit(0).cast("long"), lambda acc, x: acc + x["c"]).alias("n_notes"))


def fuzzy_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_counts(notes(spark, sf_dir), k=2)


def fragment_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the fragments of a piece's head (voice 0) return exactly, inverted or backwards."""
    n = notes(spark, sf_dir)
    frag = ngrams(n, 2)
    subject = frag.join(n.filter("voice = 0 and note_idx < 5").select("piece_id", "voice", "start"), ["piece_id", "voice", "start"]).select("piece_id", "gram").distinct()
    variants = F.array(F.struct(F.lit("exact").alias("kind"), F.col("gram").alias("g")), F.struct(F.lit("inversion").alias("kind"), F.transform("gram", lambda x: -x).alias("g")), F.struct(F.lit("retrograde").alias("kind"), F.reverse("gram").alias("g")))
    wanted = subject.select("piece_id", F.explode(variants).alias("v")).select("piece_id", "v.kind", F.col("v.g").alias("gram")).distinct()
    return frag.filter("voice > 0").join(wanted, ["piece_id", "gram"]).groupBy("piece_id", "kind").agg(F.count(F.lit(1)).alias("hits"))


def band_match_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of other voices that stay within one of a fragment of voice 0's head in every place.

    A band of one around the first interval is the equi-key; the rest is a residual.
    """
    n = notes(spark, sf_dir)
    frag = ngrams(n, 2)
    head = frag.join(n.filter("voice = 0 and note_idx < 5").select("piece_id", "voice", "start"), ["piece_id", "voice", "start"])
    a = head.select("piece_id", F.col("start").alias("start_a"), F.col("gram").alias("x"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.element_at("gram", 1) + d)).alias("k"))
    b = frag.filter("voice > 0").select("piece_id", "voice", F.col("start").alias("start_b"), F.col("gram").alias("y"), F.element_at("gram", 1).alias("k"))
    near = F.forall(F.zip_with("x", "y", lambda p, q: F.abs(p - q)), lambda d: d <= 1)
    return a.join(b, ["piece_id", "k"]).filter(near).groupBy("piece_id", "start_a").agg(F.count(F.lit(1)).alias("matches"))


QUERIES = {f.__name__: f for f in (asof_pitch_lookup, interval_stab_set, voice_alignment, onset_multiplicity, voice_pairs, voice_groups, fuzzy_ngram_join, fragment_membership, band_match_fragments)}

BEATS_SQL = """b2 AS (SELECT piece_id, unnest(range(0, CAST(max(start + dur) AS BIGINT), 480)) AS tick FROM n2 GROUP BY piece_id)"""
GRAMS_SQL = """iv AS (SELECT *, lead(pitch, 1) OVER w - pitch AS i1, lead(pitch, 2) OVER w - lead(pitch, 1) OVER w AS i2, lead(pitch, 3) OVER w - lead(pitch, 2) OVER w AS i3,
  lead(pitch, 4) OVER w - lead(pitch, 3) OVER w AS i4, lead(pitch, 5) OVER w - lead(pitch, 4) OVER w AS i5, lead(pitch, 6) OVER w - lead(pitch, 5) OVER w AS i6
  FROM n WINDOW w AS (PARTITION BY piece_id, voice ORDER BY start, note_idx))"""
SQL = {
    "asof_pitch_lookup": f"""WITH {NOTES_SQL}, {BEATS_SQL}, p AS (SELECT b2.piece_id, v.voice, tick FROM b2 JOIN (SELECT DISTINCT piece_id, voice FROM n2) v ON b2.piece_id = v.piece_id)
SELECT p.piece_id, p.voice, p.tick, (SELECT CASE WHEN x.start + x.dur > p.tick THEN x.pitch END FROM n2 x WHERE x.piece_id = p.piece_id AND x.voice = p.voice AND x.start <= p.tick ORDER BY x.start DESC, x.event_id DESC LIMIT 1) AS pitch FROM p""",
    "interval_stab_set": f"""WITH {NOTES_SQL}, {BEATS_SQL} SELECT b2.piece_id, tick, CAST(bit_or(CAST(1 AS BIGINT) << CAST(pitch % 12 AS INT)) AS BIGINT) AS mask FROM b2 JOIN n2 ON b2.piece_id = n2.piece_id AND start <= tick AND tick < start + dur GROUP BY 1, 2""",
    "voice_alignment": f"""WITH {NOTES_SQL}, o AS (SELECT DISTINCT piece_id, start AS tick FROM n2 WHERE voice < 2), p AS (SELECT piece_id, tick, voice FROM o, (SELECT unnest([0, 1]) AS voice) v),
f AS (SELECT p.*, (SELECT CASE WHEN x.start + x.dur > p.tick THEN x.pitch END FROM n2 x WHERE x.piece_id = p.piece_id AND x.voice = p.voice AND x.start <= p.tick ORDER BY x.start DESC, x.event_id DESC LIMIT 1) AS pitch FROM p)
SELECT piece_id, tick, max(CASE WHEN voice = 0 THEN pitch END) AS upper, max(CASE WHEN voice = 1 THEN pitch END) AS lower FROM f GROUP BY 1, 2 HAVING max(pitch) IS NOT NULL""",
    "onset_multiplicity": f"""WITH {NOTES_SQL}, p AS (SELECT piece_id, start, count(DISTINCT voice) AS m FROM n GROUP BY 1, 2)
SELECT piece_id, count(*) AS onsets, {", ".join(f"round(avg(CASE WHEN m = {k} THEN 1.0 ELSE 0.0 END), 9) AS share_{k}" for k in (1, 2, 3, 4))}, round(avg(CASE WHEN m >= 3 THEN 1.0 ELSE 0.0 END), 9) AS share_3or4 FROM p GROUP BY 1""",
    "voice_pairs": f"""WITH {NOTES_SQL}, h AS (SELECT * FROM n WHERE note_idx < 20), l AS (SELECT piece_id, max(voice) AS last FROM n GROUP BY 1), sp AS (SELECT piece_id, voice, max(start + dur) - min(start) AS span FROM n GROUP BY 1, 2), vp AS (
SELECT a.piece_id, a.voice AS voice_a, b.voice AS voice_b, count(*) AS near, round(avg(CASE WHEN a.pitch < b.pitch THEN 1.0 ELSE 0.0 END), 9) AS crossed FROM h a JOIN h b ON a.piece_id = b.piece_id JOIN l ON l.piece_id = a.piece_id
WHERE (b.voice = a.voice + 1 OR (a.voice = 0 AND b.voice = last AND last > 1)) AND abs(a.start - b.start) < 240 GROUP BY 1, 2, 3)
SELECT vp.piece_id, CASE WHEN crossed > 0.5 THEN voice_b ELSE voice_a END AS upper, CASE WHEN crossed > 0.5 THEN voice_a ELSE voice_b END AS lower, near, crossed, crossed > 0.5 AS swapped, least(x.span, y.span) >= 7680 AS valid
FROM vp JOIN sp x ON x.piece_id = vp.piece_id AND x.voice = voice_a JOIN sp y ON y.piece_id = vp.piece_id AND y.voice = voice_b""",
    "voice_groups": f"""WITH {NOTES_SQL}, p AS (SELECT piece_id, voice, count(*) AS c, row_number() OVER (PARTITION BY piece_id ORDER BY voice) - 1 AS r FROM n GROUP BY 1, 2)
SELECT a.piece_id, CAST(a.r AS INT) AS group_idx, CAST(sum(b.c) AS BIGINT) AS n_notes FROM p a JOIN p b ON a.piece_id = b.piece_id AND b.r BETWEEN a.r AND a.r + 2 GROUP BY 1, 2 HAVING count(*) = 3""",
    "fuzzy_ngram_join": f"""WITH {NOTES_SQL}, {GRAMS_SQL}, g AS (SELECT * FROM iv WHERE i2 IS NOT NULL) SELECT a.piece_id, a.voice AS voice_a, b.voice AS voice_b, count(*) AS matches FROM g a JOIN g b ON a.piece_id = b.piece_id AND a.voice < b.voice
WHERE abs(a.i1 - b.i1) + abs(a.i2 - b.i2) <= 1 AND abs(a.start - b.start) >= 480 GROUP BY 1, 2, 3""",
    "fragment_membership": f"""WITH {NOTES_SQL}, {GRAMS_SQL}, g AS (SELECT piece_id, voice, note_idx, [i1, i2] AS f FROM iv WHERE i2 IS NOT NULL), s AS (SELECT DISTINCT piece_id, f FROM g WHERE voice = 0 AND note_idx < 5),
w AS (SELECT piece_id, 'exact' AS kind, f FROM s UNION SELECT piece_id, 'inversion', [-f[1], -f[2]] FROM s UNION SELECT piece_id, 'retrograde', [f[2], f[1]] FROM s)
SELECT g.piece_id, kind, count(*) AS hits FROM g JOIN w ON g.piece_id = w.piece_id AND g.f = w.f WHERE voice > 0 GROUP BY 1, 2""",
    "band_match_fragments": f"""WITH {NOTES_SQL}, {GRAMS_SQL}, g AS (SELECT * FROM iv WHERE i2 IS NOT NULL) SELECT a.piece_id, a.start AS start_a, count(*) AS matches FROM g a JOIN g b ON a.piece_id = b.piece_id
WHERE a.voice = 0 AND a.note_idx < 5 AND b.voice > 0 AND abs(a.i1 - b.i1) <= 1 AND abs(a.i2 - b.i2) <= 1 GROUP BY 1, 2""",
}
