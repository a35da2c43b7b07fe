"""Folds, exact ranks and what stands around a generator, against plain loops; scans and phrase scores by hand."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quaverlake.operators import generation as G
from quaverlake.operators import scoring as S
from quaverlake.plans import folds
from quaverlake.sources import catalogue

SF = "/root/testdata/sf0.001"


def test_percentiles_and_least_hashes_are_exact(spark):
    rnd = random.Random(1)
    rows = [(k, i, rnd.choice((float(rnd.randint(0, 9)), rnd.random() * 1000))) for k, n in (("a", 1), ("b", 2), ("c", 500), ("d", 333)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    for q in (0.0, 0.33, 0.75, 1.0):
        got = {r.k: r.cut for r in folds.exact_percentile(df.union(spark.createDataFrame([("a", 9, None)], df.schema)), "k", "v", q, 7.0).collect()}
        for k in "abcd":
            x = sorted(v for kk, _, v in rows if kk == k)
            at = (len(x) - 1) * q
            low = x[int(at)]
            assert got[k] == pytest.approx(low + (x[min(int(at) + 1, len(x) - 1)] - low) * (at - int(at)))
    quota = spark.createDataFrame([("a", 3), ("b", 0), ("c", 123), ("d", 333)], "k string, wanted bigint")
    for digits in (1, 4):
        got = folds.least_by_hash(df, "k", quota, F.col("i").cast("string"), digits).collect()
        want = {(k, i) for k, w in (("a", 3), ("c", 123), ("d", 333)) for i in sorted((i for kk, i, _ in rows if kk == k), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:w]}
        assert sorted((r.k, r.i) for r in got) == sorted(want)


def test_equal_mix_is_equal_and_the_same_again(spark):
    a, b = (sorted(map(tuple, G.equal_mix(spark, SF).collect())) for _ in range(2))
    assert a == b
    count = {}
    for _, priority, source in a:
        count[priority, source] = count.get((priority, source), 0) + 1
    assert all(count[p, "real"] == n for (p, s), n in count.items() if s == "winner")


def test_forced_starts_by_hand():
    bar, own = "BAR", "SUBJECT_START"
    rows = [(1, i, t) for i, t in enumerate([bar, bar, bar, own, bar, bar, bar, bar, bar])] + [(2, 0, bar), (2, 1, own), (2, 2, bar)]
    assert list(G.starts(iter(rows), 3, 2)) == [(1, 1, 2, 1, True), (1, 3, 3, 2, False), (1, 5, 5, 3, True), (2, 1, 1, 1, False)]


def test_chained_chunks_against_a_loop(spark):
    rows = G.chunks(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.piece_id, {}).setdefault(r.chunk, []).append((r.cand, r.tokens))
    want = []
    for piece, turns in by.items():
        tail, at = [], 0
        for chunk in sorted(turns):
            scored = [(-(len(set(t)) * 1_000_000 // len(t) + G.SEAM * sum(x in tail for x in t[: G.OVERLAP])), cand, t) for cand, t in turns[chunk]]
            score, cand, t = min(scored, key=lambda x: x[:2])
            new = t if chunk == 0 else t[G.OVERLAP :]
            want.append((piece, chunk, cand, -score, at, len(new), hashlib.md5(" ".join(new).encode()).hexdigest()))
            tail, at = t[-G.OVERLAP :], at + len(new)
    assert sorted(map(tuple, G.chained_chunks(spark, SF).collect())) == sorted(want)


def test_random_subjects_keep_their_key_and_range(spark):
    for r in G.random_subjects(spark, SF).collect():
        scale = [0, 2, 4, 5, 7, 9, 11] if r.c_custkey % 2 == 0 else [0, 2, 3, 5, 7, 8, 11]
        assert (r.pitch - r.c_custkey) % 12 in scale and 36 <= r.pitch <= 84 and 1 <= r.degree <= 7 and 2 <= r.octave <= 6 and r.dur in (240, 480, 960)


def test_scan_of_a_folder(spark, tmp_path):
    for name in ("a/x.mid", "a/_gen/y.mid", "b/z.tar.krn", "b/z.txt", "top.XML", "top.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(b"12345")
    assert sorted(map(tuple, catalogue.scan(spark, str(tmp_path)).collect())) == [("a/x.mid", "a/x", 5), ("b/z.tar.krn", "b/z.tar", 5), ("top.xml", "top", 5)]


def notes(spark, rows):
    return spark.createDataFrame([(1, v, i, s, d, p, i) for i, (v, s, d, p) in enumerate(rows)], "piece_id bigint, voice int, note_idx bigint, start bigint, dur int, pitch int, event_id bigint")


def test_phrase_scores_by_hand(spark):
    """Two phrases of two bars with a silent bar between; the melody's long notes where nothing is silent; too few notes."""
    gaps = [(0, s, 240, 60 + s % 7) for b in (0, 5760) for s in range(b, b + 3840, 240)]
    assert sorted((r.how, r.ticks) for r in S.phrase_lengths(notes(spark, gaps)).collect()) == [("gaps", 3840), ("gaps", 3840)]
    assert S.phrases(notes(spark, gaps)).first().phrase == pytest.approx(0.3 + 0.4 + 0.15)
    melody = [(0, s, 960 if s % 3840 == 2880 else 480, 60) for b in range(0, 15360, 3840) for s in (b, b + 480, b + 960, b + 1440, b + 1920, b + 2400, b + 2880)]
    got = S.phrase_lengths(notes(spark, melody)).collect()
    assert sorted(r.ticks for r in got if r.how == "melody") == [3840] * 4
    assert S.phrases(notes(spark, melody)).first().phrase == pytest.approx(0.3 + 0.4 + 0.3)
    assert S.phrases(notes(spark, melody[:10])).first().phrase == 0.3


def test_few_pitches_lower_the_structure(spark):
    rows = [(v, s, 480, 60 + v) for v in (0, 3) for s in range(0, 9600, 480)]
    flat = S.structure(notes(spark, rows)).first()
    parts = 0.25 * flat.key_consistency + 0.25 * flat.cadence + 0.20 * flat.phrase + 0.15 * flat.modulation + 0.15 * flat.length
    assert flat.structural == pytest.approx(0.1 * parts, abs=1e-5)
    assert statistics.fmean([flat.phrase]) >= 0.3
