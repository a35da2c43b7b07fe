"""Streams with an end give what their batch forms give, and their state shrinks."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.operators import decoder
from quaverlake.plans.views import notes
from quaverlake.streaming import state

DATA = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, df, fn, parts, name):
    """What came out, and the number of keyed values that the state held after each batch."""
    source = str(tmp_path / "in")
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(source) if (tmp_path / "in").mkdir() is None else None
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    held = []
    try:
        for i, part in enumerate(parts):
            part.coalesce(1).write.parquet(f"{source}/{i:03d}")
            q.processAllAvailable()
            held.append(q.lastProgress.stateOperators[0].numRowsTotal)
    finally:
        q.stop()
    return spark.table(name), held


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def timed(df):
    return df.withColumn("at", F.timestamp_millis(F.col("pos").cast("bigint") + 1))  # what stands at the epoch is late from the start


def test_decoder(spark, tmp_path):
    t = timed(decoder.control_tokens(notes(spark, DATA).filter("piece_id < 3"))).cache()
    want = decoder.decoded(t)
    parts = [t.filter("pos < 40"), t.filter("pos >= 40 and pos < 41"), t.filter("pos >= 41")]
    got, held = streamed(spark, tmp_path, t, lambda s: state.stateful(s, {"piece_id": "bigint"}, state.Decoder(), 3_600_000), parts, "decoded")
    assert rows(got) == rows(want) and got.filter("kind = 'off'").count() == got.filter("kind = 'on'").count() > 50
    assert held[0] > 0 and held[-1] == 0


def test_sliding_buffer_and_idle_sequences(spark, tmp_path):
    """Sequence 1 ends, sequence 2 falls silent and goes by its timer, sequence 3 goes on."""
    t = timed(spark.range(300).select((F.col("id") % 3 + 1).alias("seq_id"), F.floor(F.col("id") / 3).alias("pos"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("token")))
    end = t.filter("seq_id = 1 and pos = 99").withColumn("token", F.lit("EOS"))
    t = t.filter("not (seq_id = 1 and pos = 99)").unionByName(end)
    later = timed(spark.range(100, 103).select(F.lit(3).cast("bigint").alias("seq_id"), F.col("id").alias("pos"), F.lit("x").alias("token"))).withColumn("at", F.timestamp_millis(F.col("pos") + 100_000))
    last = later.withColumn("pos", F.col("pos") + 3).withColumn("at", F.timestamp_millis(F.col("pos") + 200_000))
    parts = [t.filter("pos < 50"), t.filter("pos >= 50"), later, last]
    got, held = streamed(spark, tmp_path, t, lambda s: state.stateful(s, {"seq_id": "bigint"}, state.SlidingBuffer(idle=150_000)), parts, "buffered")
    whole = t.unionByName(later).unionByName(last)
    assert rows(got) == rows(decoder.buffered(whole, ["seq_id"]))
    assert held[0] > held[1] > held[3]


def test_sequence_state(spark, tmp_path):
    t = timed(spark.createDataFrame([(s, p, 2 if p == 59 and s == 1 else (p * s) % 4) for s in (1, 2, 3) for p in range(60)], "seq_id bigint, pos bigint, token int"))
    got, held = streamed(spark, tmp_path, t, lambda s: state.stateful(s, {"seq_id": "bigint"}, state.SequenceState(separator=3, eos=99), 3_600_000), [t.filter("pos < 20"), t.filter("pos >= 20")], "seen")
    w = W.partitionBy("seq_id").orderBy("pos")
    u = t.withColumn("new", F.when(F.lag("token").over(w) == F.col("token"), 0).otherwise(1)).withColumn("g", F.sum("new").over(w)).withColumn("s", F.sum(F.when(F.col("token") == 3, 1).otherwise(0)).over(w))
    run, since = F.row_number().over(W.partitionBy("seq_id", "g").orderBy("pos")), F.row_number().over(W.partitionBy("seq_id", "s").orderBy("pos"))
    want = u.select("seq_id", "pos", F.row_number().over(w), run, F.when(F.col("s") > 0, since - 1).otherwise(since), F.collect_list("token").over(w.rowsBetween(-31, 0)))
    assert rows(got) == rows(want) and held[-1] > 0


def test_decoder_of_hard_tokens(spark):
    """A note that outlasts the piece, silent bars, equal pitches at once, no notes."""
    n = spark.createDataFrame([(1, 0, 0, 0, 480, 60), (1, 1, 0, 0, 99_999, 60), (1, 0, 1, 9_000, 10, 60), (1, 2, 0, 9_000, 480, 61)], "piece_id bigint, voice int, note_idx bigint, start bigint, dur bigint, pitch int")
    t = decoder.control_tokens(n)
    assert [r.token for r in t.orderBy("pos").collect()] == ["BAR", "VOICE_0", "N_60_480", "VOICE_1", "N_60_99999", "BAR", "BAR", "BAR", "BAR", "BEAT_1320", "VOICE_0", "N_60_10", "VOICE_2", "N_61_480", "EOS"]
    got = {(r.kind, r.tick, r.voice): r.at for r in decoder.decoded(t).collect()}
    assert got == {("on", 0, 0): 2, ("on", 0, 1): 4, ("on", 9000, 0): 11, ("on", 9000, 2): 13, ("off", 480, 0): 5, ("off", 99_999, 1): 14, ("off", 9010, 0): 14, ("off", 9480, 2): 14}
    assert decoder.decoded(decoder.control_tokens(n.limit(0))).count() == 0
