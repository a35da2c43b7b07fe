"""Subjects, their entries and recall: small pieces by hand, and melodies of few pitches against a plain scan."""

import math
import random

from pyspark.sql import functions as F

from quaverlake.operators import subjects as S

SCHEMA = "piece_id bigint, voice int, note_idx bigint, start bigint, dur int, pitch int"


def frame(spark, pieces):
    rows = [(p, v, i, s, d, x) for p, voices in pieces.items() for v, voice in enumerate(voices) for i, (s, d, x) in enumerate(voice)]
    return spark.createDataFrame(rows, SCHEMA)


def line(start, pitches, dur=480):
    return [(start + i * dur, dur, p) for i, p in enumerate(pitches)]


def plain_subject(voices, bar):
    first = min((v[0][0], i) for i, v in enumerate(voices) if v)
    kept = []
    voice = voices[first[1]]
    for i, note in enumerate(voice):
        if note[0] > first[0] + 2 * bar:
            break
        kept.append(note)
        if len(kept) >= 3 and i + 1 < len(voice) and voice[i + 1][0] - note[0] - note[1] >= 480:
            break
    return first[1], kept


def steps(voice):
    return [b[2] - a[2] for a, b in zip(voice, voice[1:])]


def plain_entries(voices, bar=1920):
    _, subject = plain_subject(voices, bar)
    if len(subject) < 4:
        return []
    least, found = max(4, math.ceil(len(subject) * 0.7)), []
    for v, voice in enumerate(voices):
        i = 0
        while i + least <= len(voice):
            shares = []
            for size in range(least, min(len(subject), len(voice) - i) + 1):
                pairs = list(zip(steps(subject[:size]), steps(voice[i : i + size]), strict=True))
                shares.append((-sum(abs(a - b) <= (1 if k < 3 else 0) for k, (a, b) in enumerate(pairs)) / len(pairs), size))
            best, size = min(shares)
            if -best >= 0.8:
                found.append((v, i, size))
                i += size
            else:
                i += 1
    return found


def plain_recall(voices):
    _, subject = plain_subject(voices, 1920)
    own = steps(subject)
    if len(own) < 3:
        return 0.3
    if not any(own):
        return 0.0
    cut = min(n[0] for v in voices for n in v)
    cut += (max(n[0] + n[1] for v in voices for n in v) - cut) * 0.25
    sizes = [3] if len(own) == 3 else [k for k in (4, 5, 6) if k <= len(own)]
    got, heard = {1.0: 0, 0.85: 0, 0.6: 0, 0.28: 0}, set()
    for v, voice in enumerate(voices):
        late = [n for n in voice if n[0] >= cut]
        ahead, room = steps(late), -1
        for i, note in enumerate(late):
            if note[0] < room:
                continue
            weight = 0
            for k in sizes:
                x = ahead[i : i + k]
                parts = [own[j : j + k] for j in range(len(own) - k + 1)] if len(x) == k else []
                kinds = [(1.0, x in parts), (0.85, [-a for a in x] in parts), (0.6, x[::-1] in parts), (0.28, any(all(abs(a - b) <= 1 for a, b in zip(p, x)) for p in parts))]
                weight = max([weight] + [w for w, yes in kinds if yes])
            if weight:
                got[weight] += 1
                heard.add(v)
                room = note[0] + 1920
    w = got[1.0] + 0.85 * got[0.85] + 0.6 * got[0.6] + 0.28 * min(2, got[0.28])
    score = 0 if w < 0.25 else 0.12 + 0.28 * (w - 0.25) if w < 1 else 0.33 + 0.2 * (w - 1) if w < 2 else 0.53 + 0.14 * (w - 2) if w < 3.5 else 0.74
    score += {0: 0, 1: 0, 2: 0.1}.get(len(heard), 0.16)
    strong = got[1.0] + got[0.85]
    return min(score, 1 if strong else 0.62, 1 if strong + got[0.6] else 0.48, 1 if len(heard) > 1 else 0.8)


def test_entries_by_hand(spark):
    theme = [60, 62, 61, 63, 64]
    n = frame(spark, {3: [line(0, theme), line(3840, [67, 69, 68, 70, 71])], 6: [line(0, [60, 62, 64])]})
    got = {(r.piece_id, r.voice, r.place, r.notes, r.quality, r.start, r.until, r.exposition) for r in S.entries(n, F.lit(1920)).collect()}
    assert got == {(3, 0, 0, 4, 1.0, 0, 1920, True), (3, 1, 0, 4, 1.0, 3840, 5760, False)}


def test_subject_ends_at_a_gap_after_three_notes(spark):
    voice = [(0, 240, 60), (720, 240, 62), (960, 240, 64), (1680, 240, 65)]
    n = frame(spark, {1: [voice], 2: [line(0, [60] * 12)]})
    got = S.subject_notes(n, F.lit(1920)).groupBy("piece_id").count().collect()
    assert {(r.piece_id, r["count"]) for r in got} == {(1, 3), (2, 9)}


def test_melodies_of_few_pitches_agree_with_a_plain_scan(spark):
    rng = random.Random(5)
    pieces = {p: [line(480 * rng.randrange(8), [60 + rng.randrange(2 + p % 3) for _ in range(rng.randrange(1, 60))], rng.choice((240, 480))) for _ in range(3)] for p in range(40)}
    pieces[40] = [line(0, [60] * 30), line(0, [60] * 30)]
    n = frame(spark, pieces).repartition(4)
    got = {}
    for r in S.entries(n, F.lit(1920)).collect():
        got.setdefault(r.piece_id, []).append((r.voice, r.place, r.notes))
    assert {p: sorted(e) for p, e in got.items()} == {p: e for p, v in pieces.items() if (e := plain_entries(v))}
    assert {r.piece_id: round(r.recall, 6) for r in S.recall(n).collect()} == {p: round(plain_recall(v), 6) for p, v in pieces.items()}


def test_empty(spark):
    n = spark.createDataFrame([], SCHEMA)
    assert S.entries(n, F.lit(1920)).count() == 0 and S.recall(n).count() == 0
