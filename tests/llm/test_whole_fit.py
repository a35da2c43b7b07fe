"""The trees of operators 1 and 2 learn from every row, those outside any bounded sample too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaverlake.llm import boosting, pii, quality
from quaverlake.llm.common import Scratch


def outside(spark, rows, share):
    """Ids below rows whose hash lies above the share by which rows were once sampled."""
    ids = spark.range(rows).filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) > int(share * (1 << 20)) + 1)
    return sorted(r.id for r in ids.collect())


def test_trees_of_a_table_equal_those_of_arrays(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((2000, 3)) * 200)
    y = (x[:, 0] + 60 * rng.random(2000) > 130).astype(int)
    rows = [(r, int(v), 1, False, 0) for r, v in zip(x.tolist(), y.tolist(), strict=True)] + [([0.0, 0.0, 0.0], 1, 10**6, True, 0)]
    data = spark.createDataFrame(rows, "x array<double>, y int, n bigint, held boolean, part int")
    plain = boosting.fit(x, y.astype(float), monotone={0: 1, 1: -1}, trees=4).margin(x)
    seen = []
    for few in (boosting.FEW, 0):
        monkeypatch.setattr(boosting, "FEW", few)
        scratch = Scratch()
        found, levels = boosting.fit_table(scratch, data, 3, monotone={0: 1, 1: -1}, trees=4)
        scratch.drop()
        assert found.margin(x) == pytest.approx(plain, abs=1e-4)
        assert [(p, k, n) for p, _, k, n in levels] == [(0, 1, 10**6)] and levels[0][1] == np.floor(found.margin(np.zeros((1, 3)))[0] * 1024)
        seen.append(found.margin(x))
    assert seen[0] == pytest.approx(seen[1], abs=1e-9)


def test_quality_learns_from_every_label(spark):
    n = 26_000
    bad = outside(spark, n, 12_000 / n)[:400]
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(bad), F.repeat(F.lit("# $ % & one "), 30)).otherwise(F.concat(F.repeat(F.lit("one two three "), 30), F.col("id"))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (~F.col("id").isin(bad)).cast("int").alias("quality"))
    trees, _ = quality.fit(docs, labels)
    good, symbols = trees.probability(quality.features(np.array([quality.statistics("one two three " * 30 + "7"), quality.statistics("# $ % & one " * 30)])))
    assert good > 0.9 and symbols < 0.1


def test_pii_learns_from_every_document(spark):
    n = 14_000
    own = outside(spark, n, 6_000 / n)[:300]
    name = F.concat(F.lit("bob"), F.col("id"), F.lit("@site"), F.col("id") % 7, F.lit(".org"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id").isin(own), F.concat(F.lit("write to "), name, F.lit(" today"))).otherwise("no data here").alias("text"))
    model = pii.fit(docs)
    case = spark.createDataFrame([(1, "write to ann51 [at] site3 [dot] org today")], "doc_id bigint, text string")
    assert pii.personal_data(case, model, []).select(pii.written(F.col("spans")).alias("w")).first().w == "email:9:35"
