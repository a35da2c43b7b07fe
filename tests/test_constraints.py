"""States of token histories and the grid, by hand; relaxation on the smallest tables."""

from pyspark.sql import functions as F

from quaverlake.operators import constraints as C
from quaverlake.operators import encoding as E

DATA = "/root/testdata/sf0.001"


def test_state_by_hand(spark):
    histories = {1: [5, 9, 13], 2: [4, 9, 15, 22, 6], 3: [8, 14, 16], 4: [7, 10, 13, 11, 1 + 14, 25, 20]}
    rows = [(c, len(t) - i, x) for c, t in histories.items() for i, x in enumerate(t)]
    h = spark.createDataFrame(rows, "ctx_id bigint, seq int, tok int")
    got = {r.ctx_id: (r.voice, r.octave, r.accidental, sorted(r.sung), r.ring) for r in C.state(h, F.col("tok").between(22, 32)).collect()}
    assert got[1] == (2, 3, "#", [], [5, 9, 13])
    assert got[2] == (3, 0, "", [1], [4, 9, 15, 22, 6])
    assert got[3] == (1, 2, "b", [], [8, 14, 16])
    assert got[4] == (4, 0, "", [4], [10, 13, 11, 15, 25, 20])


def test_relaxation_by_hand(spark):
    """Contexts that hold all tokens, PAD and BOS only, sharps only, notes out of range only, EOS only while voices are missing, and nothing."""
    history = [4, 10, 15, 22, 33, 15, 22, 33, 10]
    h = spark.createDataFrame([(c, len(history) - i, t) for c in range(0, 36, 6) for i, t in enumerate(history)], "ctx_id bigint, seq int, tok int")
    kept = {0: set(range(64)), 6: {0, 1}, 12: {13, 14}, 18: {8}, 24: {2}, 30: set()}
    g = spark.createDataFrame([(c, t, 1.0 if t in k else float("-inf")) for c, k in kept.items() for t in range(64)], "ctx_id bigint, token_id int, logit double")
    got = {}
    for r in C.relaxed(g, C.degree_state(h)).collect():
        got.setdefault((r.ctx_id, r.level), {})[r.token_id] = r.logit
    alive = {k: {t: x for t, x in v.items() if x > float("-inf")} for k, v in got.items()}
    assert set(alive) == {(0, 0), (6, 1), (12, 0), (18, 3), (24, 4), (30, 4)}
    assert alive[6, 1] == {0: 1.0, 1: 1.0} and alive[12, 0] == {13: 0.0, 14: 0.0} and alive[18, 3] == {8: 1.0} and alive[24, 4] == {2: 1.0} and alive[30, 4] == {2: 0.0}
    assert 0 not in alive[0, 0] and 3 not in alive[0, 0] and alive[0, 0][10] == 0.0 and alive[0, 0][5] == 2.5


def test_chain_by_hand(spark):
    """Separators wait for four notes; a fugue in which three voices came at one time lowers voices and raises time; others don't."""
    long = [4, 57, 57, 57, 57, 60, 4, 5, 6]
    cases = {2: long, 1: long, 5: [4, 57, 57, 57, 57], 8: [4, 57, 57, 3, 57, 57], 11: [60, 4, 5]}
    h = spark.createDataFrame([(c, len(t) - i, x) for c, t in cases.items() for i, x in enumerate(t)], "ctx_id bigint, seq int, tok int")
    s = {r.ctx_id: (r.in_voice, r.stacked) for r in C.state(h, F.col("tok").between(57, 59), F.col("tok") >= 60).collect()}
    assert s == {2: (0, 3), 1: (0, 3), 5: (4, 1), 8: (2, 0), 11: (0, 2)}
    g = spark.createDataFrame([(c, t, 0.0) for c in cases for t in range(64)], "ctx_id bigint, token_id int, logit double")
    x = C.joined(g, C.state(h, F.col("tok").between(57, 59), F.col("tok") >= 60))
    got = {(r.ctx_id, r.token_id): r.x for r in x.select("ctx_id", "token_id", C.degenerate(F.col("logit"), F.col("token_id") >= 60).alias("x")).collect()}
    assert got[2, 4] == -1.1 and got[2, 6] == -2.1 and got[2, 61] == 0.35 and got[1, 4] == 0.0 and got[1, 61] == 0.0
    assert got[5, 3] == 0.0 and got[8, 3] == float("-inf") and got[2, 3] == float("-inf") and got[2, 0] == float("-inf") and got[11, 4] == 0.0


def test_grid_pulls_onto_beats_and_bars(spark):
    rows = [(1, 0, 475, 225, 60), (1, 0, 1885, 30, 62), (1, 0, 3700, 100, 64), (1, 0, 3590, 200, 64)]
    n = spark.createDataFrame(rows, "piece_id bigint, voice int, start bigint, dur int, pitch int")
    got = {(r.start, r.dur, r.pitch, r.velocity) for r in E.quantize(n).collect()}
    assert got == {(480, 240, 60, 64), (1920, 120, 62, 64), (3720, 120, 64, 64), (3600, 240, 64, 64)}
