"""Voice separation: polyphonic notes to monophonic voices, online, with a cap, a second pass, a retry and quality gates.

Notes whose onsets follow one another within a jitter are one cluster. Clusters come in time order; the notes of each are given
to voices so that higher notes have higher voices and the sum of leaps is least (ties: the smallest voices). A voice that has
not sung yet leaps from its centre. The second pass takes the voices' mean pitches of the first as centres and is kept where
it leaps less; otherwise the first pass stands. A piece is folded in one task as its sorted notes stream by, so that only the
last pitch and end of each voice are held; everything else is joins, windows and aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.operators import encoding
from quaverlake.plans.views import notes

QUARTER = 480
#: What it costs to cut a note that still sounds, in semitones; rows of an Arrow batch.
CUT, ROWS = 24, 8_192
ASSIGNED = "piece_id bigint, event_id bigint, voice int, leap bigint"


@dataclass(frozen=True)
class Settings:
    """mode auto finds the number of voices and makes a second pass, fixed takes most_voices in one; on_cap fail or raise-cap says what
    becomes of a piece that needs more; ignore_pedal takes a note to end where the next cluster begins when voices are given out."""

    most_voices: int = 16
    mode: str = "auto"
    jitter: float = 0.025
    on_cap: str = "raise-cap"
    ignore_pedal: bool = True


STRONGER = Settings(most_voices=32, mode="fixed")


def clustered(n: DataFrame, settings: Settings) -> DataFrame:
    """piece_id, event_id, cluster (tick of its first onset), start, dur, pitch."""
    w = W.partitionBy("piece_id").orderBy("start", F.desc("pitch"), "event_id")
    new = F.col("start") - F.coalesce(F.lag("start").over(w), F.lit(-(1 << 40))) > int(settings.jitter * QUARTER)
    marked = n.select("piece_id", "event_id", F.col("start").cast("bigint").alias("start"), F.col("dur").cast("bigint").alias("dur"), F.col("pitch").cast("int").alias("pitch"), F.when(new, F.col("start")).cast("bigint").alias("first"))
    return marked.withColumn("cluster", F.last("first", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("first")


def plan(c: DataFrame, settings: Settings) -> DataFrame:
    """piece_id, voices, reason (null unless the cap stops the piece), low and high pitch."""
    sizes = c.groupBy("piece_id", "cluster").agg(F.count(F.lit(1)).alias("size"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    worst = F.max(F.struct("size", (-F.col("cluster")).alias("at")))
    p = sizes.groupBy("piece_id").agg(worst.alias("w"), F.min("low").alias("low"), F.max("high").alias("high"))
    need = F.col("w.size")
    if not settings.ignore_pedal:
        ends = F.array(F.struct(F.col("start").alias("tick"), F.lit(1).alias("d")), F.struct((F.col("start") + F.col("dur")).alias("tick"), F.lit(-1).alias("d")))
        moves = c.select("piece_id", F.explode(ends).alias("m")).groupBy("piece_id", "m.tick").agg(F.sum("m.d").alias("d"))
        sounding = moves.withColumn("k", F.sum("d").over(W.partitionBy("piece_id").orderBy("tick"))).groupBy("piece_id").agg(F.max("k").alias("sounding"))
        p, need = p.join(sounding, "piece_id"), F.greatest(F.col("w.size"), "sounding")
    found = F.least(need, F.greatest(F.lit(settings.most_voices), F.col("w.size"))) if settings.mode == "auto" else F.greatest(F.lit(settings.most_voices), F.col("w.size"))
    too_many = (F.col("w.size") > settings.most_voices) & F.lit(settings.on_cap == "fail")
    reason = F.when(too_many, F.format_string("cluster of size %d at tick %d", F.col("w.size"), -F.col("w.at")))
    return p.select("piece_id", found.cast("int").alias("voices"), reason.alias("reason"), "low", "high")


def cheapest(pitches: list[int], at: list[int], busy: list[bool]) -> tuple[list[int], int]:
    """The ascending voices for descending pitches that leap least, the smallest of equals, and the leaps' sum; `at`: where each voice is."""
    k, v = len(pitches), len(at)
    none = 1 << 60
    best = [[none] * (v + 1) for _ in range(k)] + [[0] * (v + 1)]
    for i in range(k - 1, -1, -1):
        for j in range(v - 1, -1, -1):
            best[i][j] = min(best[i][j + 1], abs(pitches[i] - at[j]) + CUT * busy[j] + best[i + 1][j + 1])
    out, j = [], 0
    for i in range(k):
        while abs(pitches[i] - at[j]) + CUT * busy[j] + best[i + 1][j + 1] != best[i][j]:
            j += 1
        out.append(j)
        j += 1
    return out, best[0][0]


def fold(rows: Iterator[tuple], ignore_pedal: bool) -> Iterator[tuple]:
    """(piece_id, event_id, voice, leap) of rows (piece_id, cluster, pitch, event_id, end, centres) by piece, cluster and falling pitch."""
    piece = cluster = None
    at: list[int] = []
    ends: list[int] = []
    held: list[tuple] = []

    def give() -> Iterator[tuple]:
        busy = [not ignore_pedal and e > cluster for e in ends]
        chosen, leap = cheapest([r[2] for r in held], at, busy)
        for r, v in zip(held, chosen, strict=True):
            yield r[0], r[3], v, leap if r is held[0] else 0
            at[v], ends[v] = r[2], r[4]

    for row in rows:
        if held and (row[0], row[1]) != (piece, cluster):
            yield from give()
            held = []
        if row[0] != piece:
            at, ends = list(row[5]), [-(1 << 40)] * len(row[5])
        piece, cluster = row[:2]
        held.append(row)
    if held:
        yield from give()


def assigned(c: DataFrame, centres: DataFrame, ignore_pedal: bool) -> DataFrame:
    """piece_id, event_id, voice, leap; centres: piece_id and centres, the pitch at which each voice begins, from the highest down."""
    dealt = c.join(centres, "piece_id").select("piece_id", "cluster", "pitch", "event_id", (F.col("start") + F.col("dur")).alias("end"), "centres")
    ordered = dealt.repartition("piece_id").sortWithinPartitions("piece_id", "cluster", F.desc("pitch"), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(x.to_pylist() for x in b.columns), strict=True)

        out: list[tuple] = []
        for row in fold(rows(), ignore_pedal):
            out.append(row)
            if len(out) == ROWS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(run, ASSIGNED)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["piece_id", "event_id", "voice", "leap"])


def separate(n: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The notes of all pieces that aren't stopped (piece_id, voice, start, dur, pitch, event_id), and what became of each piece.

    A note ends where the next of its voice begins, at the latest. Outcomes: piece_id, ok, reason, voices, passes (1 or 2, the
    pass that stands; null if stopped), leaps. event_id must tell the notes of a piece apart.
    """
    c = clustered(n, settings)
    p = plan(c, settings)
    going = p.filter("reason IS NULL")
    even = F.transform(F.sequence(F.lit(0), F.col("voices") - 1), lambda i: F.round(F.col("high") - (F.col("high") - F.col("low")) * i / F.greatest(F.col("voices") - 1, F.lit(1))).cast("int"))
    start = going.select("piece_id", even.alias("centres"))
    best = assigned(c, start, settings.ignore_pedal).withColumn("pass", F.lit(1))
    if settings.mode == "auto":
        sung = best.join(c.select("piece_id", "event_id", "pitch"), ["piece_id", "event_id"]).groupBy("piece_id", "voice").agg(F.round(F.avg("pitch")).cast("int").alias("mean"))
        means = sung.groupBy("piece_id").agg(F.map_from_entries(F.collect_list(F.struct("voice", "mean"))).alias("m"))  # at most as many as voices
        centres = start.join(means, "piece_id").select("piece_id", F.transform("centres", lambda x, i: F.coalesce(F.col("m")[i.cast("int")], x)).alias("centres"))
        both = best.unionByName(assigned(c, centres, settings.ignore_pedal).withColumn("pass", F.lit(2)))
        cost = both.groupBy("piece_id", "pass").agg(F.sum("leap").alias("leaps")).groupBy("piece_id").agg(F.min(F.struct("leaps", "pass")).alias("b"))
        best = both.join(cost.select("piece_id", F.col("b.pass").alias("pass")), ["piece_id", "pass"])
    own = best.join(c, ["piece_id", "event_id"])
    w = W.partitionBy("piece_id", "voice").orderBy("cluster")
    ends = F.least("dur", F.coalesce(F.lead("start").over(w) - F.col("start"), F.col("dur")))
    out = own.select("piece_id", "voice", "start", ends.alias("dur"), "pitch", "event_id")
    done = best.groupBy("piece_id").agg(F.countDistinct("voice").alias("voices"), F.max("pass").alias("passes"), F.sum("leap").alias("leaps"))
    outcomes = p.select("piece_id", "reason").join(done, "piece_id", "left").select("piece_id", F.col("reason").isNull().alias("ok"), "reason", F.col("voices").cast("int").alias("voices"), "passes", "leaps")
    return out, outcomes


def separate_with_retry(n: DataFrame, first: Settings = Settings(), second: Settings = STRONGER) -> tuple[DataFrame, DataFrame]:
    """As separate; pieces that the first settings stop are separated with the second, and outcomes tell the attempt."""
    a, done = separate(n, first)
    failed = done.filter(~F.col("ok")).select("piece_id")
    b, again = separate(n.join(failed, "piece_id", "left_semi"), second)
    return a.unionByName(b), done.filter("ok").withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))


def extremes(n: DataFrame, name: str) -> DataFrame:
    return n.groupBy("piece_id").agg(F.min("pitch").alias(f"{name}_low"), F.max("pitch").alias(f"{name}_high"))


def gates(n: DataFrame, settings: Settings, most: int = 4) -> DataFrame:
    """One row: what share of pieces is separated, has at most `most` voices when reduced, isn't bad then, and how far extremes drift (medians).

    passed asks for 90 %, all, 95 % and two semitones.
    """
    out, outcomes = separate(n, settings)
    reduced = encoding.reduced(out, most)
    final = encoding.triaged(reduced, most_voices=most)
    each = outcomes.join(final, "piece_id", "left").join(extremes(n, "was"), "piece_id").join(extremes(reduced, "is"), "piece_id", "left")
    ok = F.col("ok")
    rate = lambda c: F.avg(F.when(ok, c.cast("double")))
    median = lambda a, b: F.coalesce(F.median(F.when(ok, F.abs(F.col(a) - F.col(b)).cast("double"))), F.lit(999.0))
    row = each.agg(F.count(F.lit(1)).alias("pieces"), F.avg(ok.cast("double")).alias("separated"), rate(F.col("voices_used") <= most).alias("few_voices"), rate(F.col("status") != "bad").alias("not_bad"), median("was_low", "is_low").alias("low_drift"), median("was_high", "is_high").alias("high_drift"))
    good = (F.col("separated") >= 0.9) & (F.col("few_voices") == 1.0) & (F.col("not_bad") >= 0.95) & (F.col("low_drift") <= 2.0) & (F.col("high_drift") <= 2.0)
    return row.withColumn("passed", F.coalesce(good, F.lit(False)))


def polyphonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shifted notes of each piece, without their voices."""
    return notes(spark, sf_dir, shifted=True).select("piece_id", "start", "dur", "pitch", "event_id")


def separated_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifted notes given to voices again; pieces with more than four notes at once take the retry."""
    return separate_with_retry(polyphonic(spark, sf_dir), replace(Settings(), most_voices=4, on_cap="fail"))[0]


def separation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separate_with_retry(polyphonic(spark, sf_dir), replace(Settings(), most_voices=4, on_cap="fail"))[1]


def reduction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates(polyphonic(spark, sf_dir), replace(Settings(), mode="fixed"))


QUERIES = {f.__name__: f for f in (separated_voices, separation_outcomes, reduction_gates)}
#: The cheapest assignment is a fold over states of all voices, which SQL can't express; tests compare it with all assignments.
SQL: dict[str, str] = {}
