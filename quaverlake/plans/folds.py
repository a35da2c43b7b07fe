"""Ordered folds for what windows can't say, and exact ranks without sorting a whole group in one task."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 8_192


def folded(df: DataFrame, keys: list[str], order: list[Column | str], fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """fn makes rows of the schema from the rows (columns in order) of a task: whole keys, each by the order. It sees a row once."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for part in itertools.batched(fn(rows), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_bucket(df: DataFrame, key: str, bucket: Column) -> DataFrame:
    """key, bucket, rows, before: how many rows of the key stand in each bucket and in the buckets below it."""
    from pyspark.sql import Window as W

    counts = df.groupBy(F.col(key).alias(key), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("before", F.sum("rows").over(W.partitionBy(key).orderBy("bucket")) - F.col("rows"))


def least_by_hash(df: DataFrame, key: str, quota: DataFrame, text: Column, buckets: int = 4) -> DataFrame:
    """The rows of each key whose hashes are the least, exactly `quota` (key, wanted) of them, or all if there are fewer.

    Counts by the first hexadecimal digits of the hash tell the bucket in which the quota ends; rows are ranked in that one alone.
    The hash of `text` must tell the rows of a key apart.
    """
    from pyspark.sql import Window as W

    hashed = df.withColumn("_h", F.md5(text)).withColumn("_b", F.substring("_h", 1, buckets))
    edge = by_bucket(hashed, key, F.col("_b")).join(quota, key).filter("before < wanted AND wanted <= before + rows").select(key, F.col("bucket").alias("_edge"), (F.col("wanted") - F.col("before")).alias("_left"))
    whole = hashed.join(quota.select(key, "wanted"), key).join(edge, key, "left")
    sure = whole.filter("_edge IS NULL AND wanted > 0 OR _b < _edge")
    ranked = whole.filter("_b = _edge").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_h"))).filter("_r <= _left")
    return sure.select(*df.columns).unionByName(ranked.select(*df.columns))


def exact_percentile(df: DataFrame, key: str, value: str, q: float, width: float) -> DataFrame:
    """key and cut, the interpolated percentile: only the buckets (of `width`) that hold its two ranks are ranked."""
    from pyspark.sql import Window as W

    rows = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    place = by_bucket(rows, key, F.col("_b"))
    total = place.groupBy(key).agg(F.sum("rows").alias("n")).select(key, ((F.col("n") - 1) * q).alias("at"))
    low, high = F.floor("at"), F.ceil("at")
    near = place.join(total, key).filter((F.col("before") <= high) & (low < F.col("before") + F.col("rows"))).select(key, F.col("bucket").alias("_b"), "before", "at")
    ranked = rows.join(near, [key, "_b"]).withColumn("_r", F.col("before") + F.row_number().over(W.partitionBy(key, "_b").orderBy("_v")) - 1)
    ends = ranked.groupBy(key).agg(F.min("at").alias("at"), F.min(F.when(F.col("_r") == low, F.col("_v"))).alias("a"), F.min(F.when(F.col("_r") == high, F.col("_v"))).alias("b"))
    return ends.select(key, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - low)).alias("cut"))
