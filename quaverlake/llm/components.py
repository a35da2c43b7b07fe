"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step hooks neighbours to the least neighbour known, in one shuffle: the links of an id stream by in order, so that the
least comes first and nothing else is held. The links are written to the shared folder after each round, and the rounds end
when a round changes nothing. Nothing but a count and a sum a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaverlake.llm.common import Scratch, schema_of


def star(links: DataFrame, large: bool) -> DataFrame:
    """One step: a large star hooks the larger neighbours of each id, a small star all of them and the id itself.

    For a small star links must go from the larger id (a) to the smaller (b), as a large star gives them.
    """
    schema = "a bigint, b bigint"
    arrow = schema_of(links.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a = last_b = least = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            begins = np.concatenate(([last_a is None or a[0] != last_a], a[1:] != a[:-1]))
            again = np.concatenate(([not begins[0] and b[0] == last_b], ~begins[1:] & (b[1:] == b[:-1])))
            at = np.maximum.accumulate(np.where(begins, np.arange(len(a)), -1))
            m = np.where(at >= 0, b[at], 0 if least is None else least)
            if large:
                m = np.minimum(m, a)
                hooked = (b > a) & (b != m) & ~again
                out = b[hooked], m[hooked]
            else:
                hooked = (b != m) & ~again
                out = np.concatenate((b[hooked], a[begins])), np.concatenate((m[hooked], m[begins]))
            last_a, last_b, least = a[-1], b[-1], m[-1]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], schema=arrow)

    if large:
        links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return links.repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, schema)


def hooked(links: DataFrame, before: DataFrame | None, scratch: Scratch) -> DataFrame | None:
    """id and component (least id that links reach) of every id but the least of each component.

    `before` is what an earlier call gave; its components grow by the new links. None stands for no links at all.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    new, seen = scratch.keep_with(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links", sums)
    if not seen["n"]:
        return before
    now = new if before is None else new.union(before.select(F.col("id").alias("a"), F.col("component").alias("b")))
    seen = None
    while True:
        now, found = scratch.keep_with(star(star(now, large=True), large=False), "stars", sums)
        if found == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = found


def connected_components(links: DataFrame) -> DataFrame:
    """id and component (least id that links reach) of every id that stands in a link (a, b) with a <> b."""
    found = hooked(links, None, Scratch())
    if found is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
