"""Scalar functions on small literal inputs."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quaverlake.functions import pitch as P
from quaverlake.operators import joins, subjects


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_floor_and_classes(spark):
    assert one(spark, P.octave(F.lit(60))) == 4
    assert one(spark, P.octave(F.lit(-1))) == -2
    assert one(spark, P.pitch_class(F.lit(-1))) == 11
    assert one(spark, P.interval_class(F.lit(-7))) == 5
    assert one(spark, P.is_consonant(F.lit(7))) is True
    assert one(spark, P.is_consonant(F.lit(6))) is False


def test_names_round_trip(spark):
    bad = spark.range(0, 128).filter(P.parse_note(P.note_name(F.col("id").cast("int"))) != F.col("id")).count()
    assert bad == 0
    assert one(spark, P.parse_note(F.lit("Bb3"))) == 58
    assert one(spark, P.parse_note(F.lit("H2"))) is None


def test_scale_degrees(spark):
    assert one(spark, P.scale_degree(F.lit(11), F.lit(0), F.lit("minor"))) == 7
    assert one(spark, P.scale_degree(F.lit(10), F.lit(0), F.lit("minor"))) is None


def test_bins_and_meters(spark):
    assert one(spark, P.nearest_bin(F.lit(150))) == 1  # 120 and 180 are as near: the lower one
    assert one(spark, P.beats_per_measure(F.lit(6), F.lit(8))) == 2
    assert one(spark, P.ticks_per_measure(F.lit(3), F.lit(4))) == 1440
    assert one(spark, P.length_bucket(F.lit(17))) == "medium"
    want = {846: None, 847: "fugue", 868: None, 869: "fugue", 870: None, 871: "fugue", 893: "fugue", 565: "fugue", 1080: "fugue", 772: "invention", 801: "sinfonia", 525: "trio_sonata", 371: "chorale", 1: None}
    got = spark.createDataFrame([(k,) for k in want], "n int").select("n", P.catalogue_form(F.col("n")).alias("form")).collect()
    assert {r.n: r.form for r in got} == want


def test_range_score(spark):
    assert one(spark, P.in_range_score(F.lit(5.0), 4.0, 6.0)) == 1.0
    assert one(spark, P.in_range_score(F.lit(3.0), 4.0, 6.0)) == 0.5
    assert one(spark, P.in_range_score(F.lit(7.0), 4.0, 6.0)) == 0.75


def test_greedy_scan_goes_on_over_parts():
    rows = [(1, 0, t, t + 1920) for t in range(0, 9600, 480)] + [(1, 1, t, t + 1920) for t in range(480, 4800, 960)] + [(2, 1, 0, 1920)]
    frame = pd.DataFrame(rows, columns=["piece_id", "voice", "place", "free"])
    want = [(1, 0, t) for t in range(0, 9600, 1920)] + [(1, 1, 480), (1, 1, 2400), (1, 1, 4320), (2, 1, 0)]
    for size in (1, 3, 7, 100):
        parts = (frame.iloc[i : i + size] for i in range(0, len(frame), size))
        got = pd.concat(subjects.apart(parts))
        assert list(got[["piece_id", "voice", "place"]].itertuples(index=False, name=None)) == want


def test_fuzzy_counts_equal_pairs_and_make_no_pairs(spark):
    rng = random.Random(2)
    rows = [(p, v, i, 240 * i + 60 * rng.randrange(4), 60 + rng.choice((0, 0, 1, 2))) for p in range(3) for v in range(3) for i in range(40)]
    n = spark.createDataFrame(rows, "piece_id bigint, voice int, note_idx int, start bigint, pitch int")
    grams = [(r.piece_id, r.voice, r.start, r.gram) for r in joins.ngrams(n, 2).collect()]
    want = {}
    for p, v, s, g in grams:
        for q, w, t, h in grams:
            if p == q and v < w and abs(s - t) >= 480 and sum(abs(x - y) for x, y in zip(g, h, strict=True)) <= 1:
                want[p, v, w] = want.get((p, v, w), 0) + 1
    assert {(r.piece_id, r.voice_a, r.voice_b): r.matches for r in joins.fuzzy_counts(n, k=2).collect()} == want
    # 20,000 equal grams in each of two voices: 400 million pairs, which are only counted
    hot = spark.range(40_000).select(F.lit(1).cast("long").alias("piece_id"), (F.col("id") % 2).cast("int").alias("voice"), F.col("id").cast("int").alias("note_idx"), (F.col("id") * 960).alias("start"), F.lit(60).alias("pitch"))
    assert [r.matches for r in joins.fuzzy_counts(hot, k=2).collect()] == [19_998**2]


def test_fuzzy_counts_shuffle_coded_grams_only(spark):
    n = spark.createDataFrame([(1, v, i, 480 * i, 60 + i % 3) for v in range(2) for i in range(9)], "piece_id bigint, voice int, note_idx int, start bigint, pitch int")
    plan = joins.fuzzy_counts(n)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffled and not any("gram#" in line for line in shuffled)  # near grams, 13 a note, stay in their task


def test_repeated_grams_are_counted_before_their_near_grams_are_made(spark):
    n = spark.createDataFrame([(1, v, i, 480 * i, 60) for v in range(2) for i in range(1000)], "piece_id bigint, voice int, note_idx int, start bigint, pitch int")
    near = joins.near_grams(joins.coded_grams(n, 6), 6)
    assert near.count() == 2 * 13 and {r.own for r in near.filter("own > 0").collect()} == {994}  # not 13 for each of 1,988 grams
    windows = [line for line in plan_of(joins.fuzzy_counts(n)).splitlines() if "Window [" in line and "RangeFrame" in line]
    assert windows and not any("gram#" in line for line in windows)  # near grams are not sorted by tick


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_planned_one_kind_at_a_time(spark):
    from quaverlake.operators import labels

    for query in (labels.analysis_labels, labels.label_crosstabs):
        assert "Window" not in (plan := plan_of(query(spark, "/root/testdata/sf0.001"))) and "events.parquet" not in plan


def test_labels_broadcast_no_notes(spark):
    """The driver builds no table of notes, ticks or attacks; small files would be broadcast otherwise. The labels are put together without a join."""
    from quaverlake.operators import labels

    n = labels.materialize(labels.notes(spark, "/root/testdata/sf0.001"), "notes")
    for part in (labels.tension, labels.harmonic_rhythm):
        plan = plan_of(part(n))
        built = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert "SortMergeJoin" in plan and not any("tick#" in line for line in built)
    assert "Join" not in plan_of(labels.analysis_labels(spark, "/root/testdata/sf0.001"))


def test_voice_leading_joins_no_ticks(spark):
    from quaverlake.operators import scoring
    from quaverlake.plans.views import notes

    plan = plan_of(scoring.leading(notes(spark, "/root/testdata/sf0.001")))
    assert not any("Join" in line and "tick#" in line for line in plan.splitlines())


def test_null_texts_hide_no_other_turns(spark, tmp_path):
    from quaverlake.operators import ranking, sampling

    spark.createDataFrame([(0, 0, "aaaaaaaa b"), (0, 1, None)], "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, [0.0] * 8)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.token_id: r.logit for r in ranking.voice_floor(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(range(8), 0.0)  # voices 0 and 1 have notes
    got = {r.token_id: r.logit for r in sampling.degenerate_penalties(spark, str(tmp_path)).collect()}
    assert got[3] == float("-inf")  # the turn without a text is open, and has no words


def test_tokens_are_shuffled_as_whole_turns(spark):
    """Tasks are dealt by the text they hold, and tokens, ten times as large, are never shuffled."""
    from quaverlake.operators import ranking, sequences

    for query in (sequences.bigram_perplexity, sequences.token_diversity, ranking.information_score):
        plan = plan_of(query(spark, "/root/testdata/sf0.001"))
        assert "REPARTITION_BY_NUM" in plan and not any("token#" in line for line in plan.splitlines() if "Exchange hashpartitioning(" in line)
