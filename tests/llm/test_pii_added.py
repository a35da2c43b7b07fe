"""What the trees add beside the base: written-out addresses, other separators, secrets of any length; and what they leave alone."""

from pyspark.sql import functions as F

from quaverlake.llm import pii

CASES = {
    "write to bob [at] example [dot] com today": ["email:9:35"],
    "contact ann (at) site (dot) org": ["email:8:31"],
    "server 10 . 0 . 0 . 1 up": ["ip:7:21"],
    "card 4111.1111.1111.1111": ["card:5:24"],
    "password: hunter2hunter2hunter2": ["secret:10:31"],
    'token = "faf2116c36a8d7a9d8e6f5a4b3c2d1e0f9a8b7c6"': ["secret:9:49"],
    "api_key = " + "a1" * 120: ["secret:10:250"],
    "card 4111 1111 1111 1112 no": [],
    "ip 999 . 1 . 1 . 1 no": [],
    "in 1999 2000 2001 2002 the": [],
    "see 2024-05-06 and 12 34 56 78, or 3.14, 100,000": [],
    "we met at the house . It was late": [],
}


def test_added_spans_by_hand(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id bigint, text string")
    got = {r.doc_id: r.w for r in pii.personal_data(docs, model, [F.col("doc_id")]).select("doc_id", pii.written(F.col("spans")).alias("w")).collect()}
    assert {t: [x for x in got[i].split(",") if x] for i, t in enumerate(CASES)} == CASES
