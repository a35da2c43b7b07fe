"""Voice separation against all assignments, on the cases of a cap, a pedal, a second pass and a retry, and on the given notes."""

import itertools
import random
from dataclasses import replace

from quaverlake.operators import voices
from quaverlake.operators.voices import Settings

SF = "/root/testdata/sf0.001"


def piece(rows):
    return [(1, s, d, p, i) for i, (s, d, p) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "piece_id bigint, start bigint, dur bigint, pitch int, event_id bigint")


def tracks(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.piece_id, r.voice, r.start)):
        out.setdefault((r.piece_id, r.voice), []).append((r.start, r.dur, r.pitch))
    for t in out.values():
        assert all(s1 >= s0 + d0 and d0 > 0 for (s0, d0, _), (s1, _, _) in itertools.pairwise(t))
    return out


def test_cheapest_is_the_least_of_all():
    rnd = random.Random(5)
    for _ in range(400):
        v = rnd.randint(1, 6)
        at, busy = [rnd.randint(40, 80) for _ in range(v)], [rnd.random() < 0.3 for _ in range(v)]
        pitches = sorted((rnd.randint(40, 80) for _ in range(rnd.randint(1, v))), reverse=True)
        cost = lambda c: sum(abs(p - at[j]) + voices.CUT * busy[j] for p, j in zip(pitches, c, strict=True))
        want = min(itertools.combinations(range(v), len(pitches)), key=lambda c: (cost(c), c))
        assert voices.cheapest(pitches, at, busy) == (list(want), cost(want))


def test_two_voices_stay_monophonic(spark):
    n = frame(spark, piece([x for i in range(8) for x in ((i * 480, 480, 72 + i % 5), (i * 480, 480, 52 + i % 5))]))
    out, outcomes = voices.separate(n, replace(Settings(), most_voices=6, on_cap="fail"))
    got = tracks(out)
    assert len(got) == 2 and [p for _, _, p in got[1, 0]] == [72 + i % 5 for i in range(8)]
    assert [(r.ok, r.voices) for r in outcomes.collect()] == [(True, 2)]


def test_cap_stops_a_piece_and_the_retry_separates_it(spark):
    n = frame(spark, piece([(0, 480, p) for p in (84, 79, 72, 67, 60)]))
    capped = replace(Settings(), most_voices=4, mode="fixed", on_cap="fail")
    out, outcomes = voices.separate(n, capped)
    assert out.count() == 0
    assert [(r.ok, r.reason, r.passes) for r in outcomes.collect()] == [(False, "cluster of size 5 at tick 0", None)]
    again, outcomes = voices.separate_with_retry(n, capped)
    assert len(tracks(again)) == 5 and [(r.ok, r.attempt) for r in outcomes.collect()] == [(True, 2)]


def test_pedal_is_passed_over_when_voices_are_given_out(spark):
    rows = []
    for i in range(8):
        rows += [(i * 1920, 3840, 72 + i % 4), (i * 1920, 3840, 50 + i % 4)] + [(i * 1920, 3840, 62 + i % 3)] * (i % 2 == 0)
    got = tracks(voices.separate(frame(spark, piece(rows)))[0])
    assert 2 <= len(got) <= 3 and max(d for t in got.values() for _, d, _ in t) == 3840
    held = tracks(voices.separate(frame(spark, piece(rows)), replace(Settings(), ignore_pedal=False))[0])
    assert len(held) > 3


def test_four_voices_are_found_and_three_match_a_fixed_number(spark):
    rows = [x for i in range(8) for x in ((i * 480, 480, 72), (i * 480, 480, 48))]
    rows += [(i * 480, 480, p) for i in range(8, 16) for p in (76, 69, 60, 52)]
    assert len(tracks(voices.separate(frame(spark, piece(rows)), replace(Settings(), most_voices=8))[0])) == 4
    n = frame(spark, piece([(i * 480, 480, p + i % 2) for i in range(12) for p in (76, 64, 52)]))
    assert tracks(voices.separate(n)[0]) == tracks(voices.separate(n, replace(Settings(), most_voices=3, mode="fixed"))[0])


def test_second_pass_stands_where_it_leaps_less(spark):
    rows = [(0, 480, 90), (0, 480, 30)] + [(480 * i, 480, p) for i in range(1, 9) for p in (88, 86, 84)]
    n = frame(spark, piece(rows))
    (_, first), (_, both) = voices.separate(n, replace(Settings(), most_voices=3, mode="fixed")), voices.separate(n)
    a, b = first.first(), both.first()
    assert b.leaps <= a.leaps and b.passes in (1, 2) and (b.passes == 2) == (b.leaps < a.leaps)


def test_jitter_makes_one_cluster(spark):
    got = tracks(voices.separate(frame(spark, piece([(0, 480, 60), (10, 480, 50), (21, 480, 40), (500, 480, 61)])))[0])
    assert len(got) == 3


def test_given_notes(spark):
    n = voices.polyphonic(spark, SF)
    out, outcomes = voices.separate_with_retry(n, replace(Settings(), most_voices=4, on_cap="fail"))
    tracks(out)
    assert out.count() == n.count() and out.select("event_id").distinct().count() == n.count()
    assert {r.attempt for r in outcomes.collect()} <= {1, 2} and outcomes.filter("not ok").count() == 0
    row = voices.reduction_gates(spark, SF).first()
    assert row.separated == 1.0 and row.few_voices == 1.0 and row.pieces == n.select("piece_id").distinct().count()
    assert row.low_drift <= 2 and row.high_drift <= 2


def test_no_notes(spark):
    out, outcomes = voices.separate_with_retry(frame(spark, []))
    assert out.count() == 0 and outcomes.count() == 0
