"""Streams give what their batch twins give."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.operators import corpus
from quaverlake.plans.views import notes
from quaverlake.streaming import twins

DATA = "/root/testdata/sf0.001"


def run(spark, tmp_path, df, fn, files, mode="append", name="out"):
    """Write df in `files` ordered parts, stream them one after the other through fn, and give back what came out."""
    source = str(tmp_path / "in")
    for i, part in enumerate(files):
        part.coalesce(1).write.mode("append").parquet(f"{source}/{i:03d}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def same(a, b):
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(a) == rows(b)


def test_note_pairing(spark, tmp_path):
    m = corpus.messages(notes(spark, DATA, shifted=True).filter("piece_id < 3"))
    m = m.select("piece_id", "voice", "pitch", "tick", "on").cache()
    parts = [m.filter("tick < 6000"), m.filter("tick >= 6000 and tick < 12000"), m.filter("tick >= 12000")]
    want = corpus.note_pairing(spark, DATA).filter("piece_id < 3")
    same(run(spark, tmp_path, m, twins.pair_notes, parts, name="paired"), want)


def test_tumbling_windows(spark, tmp_path):
    n = notes(spark, DATA).filter("piece_id < 3").select("piece_id", "start", "pitch").cache()
    want = n.groupBy("piece_id", (F.floor(F.col("start") / 3840) * 3840).alias("from_tick")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pitch"), 9).alias("mean_pitch"))
    same(run(spark, tmp_path, n, twins.tumbling_counts, [n.filter("start < 5000"), n.filter("start >= 5000")], "complete", "tumbled"), want)


def test_sessions(spark, tmp_path):
    n = notes(spark, DATA, shifted=True).filter("piece_id < 3").select("piece_id", "voice", "start").cache()
    w = W.partitionBy("piece_id", "voice").orderBy("start")
    islands = n.withColumn("new", F.when(F.col("start") - F.lag("start").over(w) <= 480, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    want = islands.groupBy("piece_id", "voice", "k").agg(F.min("start").alias("from_tick"), (F.max("start") + 480).alias("to_tick"), F.count(F.lit(1)).alias("n")).drop("k")
    same(run(spark, tmp_path, n, twins.phrases, [n.filter("start < 5000"), n.filter("start >= 5000")], "complete", "sessions"), want)


def test_constraint_state(spark, tmp_path):
    t = spark.createDataFrame([(s, p, (p * s) % 3) for s in (1, 2, 3) for p in range(50)], "seq_id bigint, pos int, token int")
    out = run(spark, tmp_path, t, twins.constraint_state, [t.filter("pos < 20"), t.filter("pos >= 20")], name="states").collect()
    assert len(out) == 150
    last = {r.seq_id: r for r in out if r.pos == 49}
    assert last[3].run == 50 and last[3].recent == [0] * 32 and last[1].recent == [p % 3 for p in range(18, 50)]
