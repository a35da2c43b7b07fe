"""MIDI bytes: round trips of notes, hand-written files, broken files, the source and the sink on a folder."""

import random

import pytest
from pyspark.sql import functions as F

from quaverlake.plans.views import notes
from quaverlake.sources import midi

SF = "/root/testdata/sf0.001"


def on(delta, status, *data):
    return midi.written_length(delta) + bytes((status, *data))


def chunk(name, body):
    return name + len(body).to_bytes(4, "big") + body


def whole(*tracks, division=480, head=b""):
    return chunk(b"MThd", b"\0\1" + len(tracks).to_bytes(2, "big") + division.to_bytes(2, "big") + head) + b"".join(chunk(b"MTrk", t) for t in tracks)


END = b"\0\xff\x2f\0"


def test_numbers_of_all_lengths():
    for n in (0, 1, 127, 128, 8191, 16383, 16384, 2097151, 2097152, 268435455):
        assert midi.length_of(midi.written_length(n) + b"\xff", 0) == (n, len(midi.written_length(n)))


def test_running_status_meta_and_system_messages():
    body = b"\0\xff\x03\x02hi" + b"\0\xff\x51\x03\x07\xa1\x20" + b"\0\xff\x58\x04\x06\x03\x18\x08" + b"\0\xff\x59\x02\xfd\x01"
    body += on(0, 0x91, 60, 80) + b"\x81\x70\x40\x50" + b"\x0a\x3c\x00" + b"\0\xf0\x03\x01\x02\xf7" + on(5, 0x81, 0x40, 0) + on(0, 0xC1, 7) + on(0, 0xE1, 0, 64) + END
    reason, division, rows = midi.parse(whole(body, division=96, head=b"xx"))
    assert (reason, division) == (None, 96)
    assert [r[2:] for r in rows] == [(0, "tempo", None, 500_000, 0), (0, "meter", None, 6, 8), (0, "key", None, -3, 1), (0, "on", 1, 60, 80), (240, "on", 1, 64, 80), (250, "off", 1, 60, 0), (255, "off", 1, 64, 0), (255, "program", 1, 7, 0), (255, "bend", 1, 0, 64), (255, "end", None, 0, 0)]


@pytest.mark.parametrize("data", [None, b"", b"MThd", b"RIFF" + bytes(40), whole(END)[:-1], whole(END, division=0xE250), whole(b"\0\x3c\x40"), whole(on(0, 0x90, 60)), whole(b"\xff\xff\xff\xff\xff"), whole(b"\0\xff\x51\x05\x01"), whole(b"\0\xf8"), whole(END).replace(b"\0\1\0\1", b"\0\1\0\2"), whole(b"\0")])
def test_broken_files_have_a_reason(data):
    reason, division, rows = midi.parse(data)
    assert reason and division is None and rows == []


def test_random_tracks_come_back():
    rnd = random.Random(3)
    for _ in range(50):
        tracks = []
        for _ in range(rnd.randint(1, 20)):
            now, track = 0, []
            for _ in range(rnd.randint(0, 30)):
                now += rnd.choice((0, 1, 480, 100_000))
                d = rnd.randint(1, 5000)
                track.append((now, d, rnd.randint(0, 127), rnd.randint(1, 127)))
                now += d
            tracks.append(track)
        _, _, rows = midi.parse(midi.built(tracks))
        for k, track in enumerate(tracks):
            opened = {}
            got = []
            for t, _, tick, kind, channel, a, b in rows:
                if t == k and kind == "on":
                    opened[a] = (tick, b)
                    assert channel == k % 16
                elif t == k and kind == "off":
                    since, v = opened.pop(a)
                    got.append((since, tick - since, a, v))
            assert sorted(got) == sorted(track)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sink_and_source(spark, tmp_path):
    n = notes(spark, SF).select(F.format_string("p%d/a.mid", "piece_id").alias("path"), F.col("voice").alias("track"), "start", "dur", "pitch")
    midi.write_midi(n, str(tmp_path / "out"))
    (tmp_path / "out" / "bad.mid").write_bytes(b"MThd nothing")
    (tmp_path / "out" / "other.txt").write_bytes(b"x")
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_writing")]
    want = rows(n.select(F.concat(F.lit(str(tmp_path / "out") + "/"), "path"), "track", F.col("start").cast("bigint"), F.col("dur").cast("bigint"), "pitch"))
    for read in (midi.read_midi(spark, str(tmp_path / "out")), midi.read_binary(spark, str(tmp_path / "out")).withColumn("path", F.regexp_replace("path", "^file:", ""))):
        assert [(r.reason, r.tick) for r in read.filter("reason IS NOT NULL").collect()] == [("no header", None)]
        assert rows(midi.notes_of(read).select("path", "track", "start", "dur", "pitch")) == want
    with pytest.raises(Exception, match="FileExistsError"):
        midi.write_midi(n, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_writing")]


def test_overwritten_and_empty_notes(spark):
    """A second on takes the place of the first, an off without an on and an empty note give nothing."""
    track = on(0, 0x90, 60, 80) + on(10, 0x90, 60, 90) + on(10, 0x80, 60, 0) + on(0, 0x80, 60, 0) + on(0, 0x90, 61, 1) + on(0, 0x80, 61, 0) + END
    df = spark.createDataFrame([("a", bytearray(whole(track))), ("b", None), ("c", bytearray(whole(END)))], "path string, content binary")
    m = midi.parsed(df)
    assert rows(midi.notes_of(m)) == [("a", 0, 10, 10, 60, 90)]
    assert {(r.path, r.reason) for r in m.select("path", "reason").distinct().collect()} == {("a", None), ("b", "no header"), ("c", None)}


def test_one_track_is_split_at_its_median(spark):
    n = spark.createDataFrame([("one", 3, 0, 10, p, 1) for p in (50, 60, 61, 70)] + [("two", t, 0, 10, 60, 1) for t in (2, 5)], midi.NOTES)
    assert {(r.path, r.pitch, r.track): r.voice for r in midi.halves(n).collect()} == {("one", 50, 3): 1, ("one", 60, 3): 1, ("one", 61, 3): 0, ("one", 70, 3): 0, ("two", 60, 2): 0, ("two", 60, 5): 1}
