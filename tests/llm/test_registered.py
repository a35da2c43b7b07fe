"""The queries as they are registered: each gives a row for every row of its table, and what SQL can say agrees."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quaverlake.llm import registry
from quaverlake.llm.common import crc_fold, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, SF), con.execute(registry.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op1_pii", "op2_quality", "op4_language", "op5_toxicity", "op6_bpe", "op7_line_dedup"])
def test_a_row_for_every_document(spark, name):
    got = [r.doc_id for r in registry.QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(got) == sorted(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())


def test_packing_covers_every_document(spark):
    got = registry.QUERIES["op8_packing"](spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t for r in got) and len(got) == table(spark, SF, "documents").select("doc_id").distinct().count()


def test_toxicity_finds_nine_of_ten_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = registry.QUERIES["op5_toxicity"](spark, sf).filter("held_out").select("doc_id", "predicted")
    labels = table(spark, sf, "labels").filter("toxic IS NOT NULL").filter(crc_fold("doc_id", 5) == 0).select("doc_id", "toxic")
    r = scored.join(labels, "doc_id").agg(F.sum("toxic").alias("toxic"), F.expr("count_if(toxic = 1 AND predicted = 1)").alias("hit"), F.expr("count_if(toxic = 0 AND predicted = 1)").alias("false"), F.expr("count_if(toxic = 0)").alias("clean")).first()
    assert r.hit >= 0.9 * r.toxic and r.false <= 0.01 * r.clean
