"""Operator 9: near-duplicate vectors, by an exact metric range join.

Vectors of one label (and dimension) link when their cosine is at least COSINE, that is, when their directions are at most
sqrt(2 - 2 * COSINE) apart. Pivots divide each large label: a vector belongs to the cell of its nearest pivot and is
copied to every other cell whose boundary it may reach over: by the triangle inequality a vector y within r of x, in the
cell of pivot q, has d(x, q) - d(x, p) <= 2r (p: the nearest pivot of x), and in Euclidean space
d(x, q)^2 - d(x, p)^2 <= 2r * d(p, q) as well. A cell is then joined on its own, its members by CHUNK against all of the
cell's rows as they stream by, so memory is bounded whatever a cell holds. Equal vectors are one with a weight.

Per vector the links are counted; of the links themselves a spanning forest of each chunk is kept for the components.
Vectors that are null, zero or hold nulls, NaN or infinities, and those without a label, link with nothing and are
components of their own. Repeated rows count as separate vectors of the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quaverlake.llm.common import materialize, schema_of, table
from quaverlake.llm.components import connected_components

COSINE = 0.93
#: Vectors that a cell should hold; pivots are broadcast, so beyond MOST_PIVOTS the cells grow instead.
CELL, MOST_PIVOTS = 1024, 1024
#: Vectors of a cell that are held in memory while the rest of the cell streams by.
CHUNK = 2048
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows (vec_id, h1, h2), and the distinct vectors: vec_id (the least), weight, label, dim, embedding, h1, h2."""
    usable = vectors.select("vec_id", "label", "embedding").filter("label is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = usable.filter(finite & F.exists("embedding", lambda x: x != 0))
    keyed = usable.select("*", F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding", "label").alias("h2"))
    one = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    return keyed.select("vec_id", "h1", "h2"), one.withColumn("dim", F.size("embedding"))


def choose_pivots(one: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Pivots of each label and dimension with more vectors than a cell: at most 2 * MOST_PIVOTS in all."""
    groups = one.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    cell = max(CELL, one.count() / MOST_PIVOTS)
    large = {(r.label, r.dim): -(-r.n // int(cell)) for r in groups.filter(F.col("n") > cell).collect()}
    if not large:
        return {}
    wanted = F.broadcast(groups.filter(F.col("n") > cell).select("label", "dim", (4 * F.ceil(F.col("n") / cell) / F.col("n")).alias("share")))
    lot = F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 20)) / (1 << 20)
    sample: dict[tuple[int, int], list] = {}
    for r in one.join(wanted, ["label", "dim"]).filter(lot <= F.col("share")).select("label", "dim", "vec_id", "embedding").orderBy("vec_id").limit(16 * MOST_PIVOTS).collect():
        sample.setdefault((r.label, r.dim), []).append(r.embedding)
    out = {}
    for key, rows in sample.items():
        x = unit(np.array(rows, np.float64))
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < min(large[key], len(x)):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(far.argmax()))
        out[key] = x[chosen]
    return out


def assign_cells(one: DataFrame, pivots: dict[tuple[int, int], np.ndarray], radius: float) -> DataFrame:
    """vec_id, weight, label, dim, embedding, home (cell) and others (cells that get a copy)."""
    cols = ["vec_id", "weight", "label", "dim", "embedding"]
    shared = one.sparkSession.sparkContext.broadcast(pivots)
    out = StructType([StructField(c, one.schema[c].dataType) for c in cols]).add("home", IntegerType()).add("others", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = (np.array(batch.column(i).to_pylist()) for i in (2, 3))
            home, others = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            for key in set(zip(label.tolist(), dim.tolist(), strict=True)):
                p = shared.value.get(key)
                if p is None or len(p) < 2:
                    continue
                rows = np.flatnonzero((label == key[0]) & (dim == key[1]))
                x = unit(matrix(batch.column(4).take(pa.array(rows))))
                square = np.maximum(0, 2 - 2 * x @ p.T)
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                near = square.argmin(axis=1)
                gap = np.sqrt(square) - np.sqrt(square[np.arange(len(rows)), near])[:, None]
                plane = square - square[np.arange(len(rows)), near][:, None]
                reach = (gap <= 2 * radius + SLACK) & (plane <= 2 * radius * between[near] + SLACK)
                reach[np.arange(len(rows)), near] = False
                home[rows] = near
                for r, cells in zip(rows.tolist(), reach, strict=True):
                    others[r] = np.flatnonzero(cells).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(others, pa.list_(pa.int32()))], names=[*cols, "home", "others"])

    return one.select(*cols).mapInArrow(run, out)


def join_cells(placed: DataFrame, cosine: float) -> DataFrame:
    """vec_id with n_links (of the distinct vector: weights of others), and links (vec_id, other) that keep components."""
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    rows = placed.select("vec_id", "weight", "label", "dim", "embedding", "home", F.explode(F.concat(F.array("home"), "others")).alias("cell"))
    rows = rows.join(sizes, cell).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("own", (F.col("cell") == F.col("home")) & (F.pmod(F.hash("vec_id"), F.col("chunks")) == F.col("chunk")))
    dealt = rows.select("label", "dim", "cell", "chunk", "own", "vec_id", "weight", "embedding").repartition("label", "dim", "cell", "chunk").sortWithinPartitions("label", "dim", "cell", "chunk", F.desc("own"), "vec_id")
    schema = "vec_id bigint, n_links bigint, other bigint"
    arrow = schema_of(placed.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Chunk | None = None
        for batch in batches:
            keys = np.stack([np.array(batch.column(i).to_pylist(), np.int64) for i in range(4)], axis=1)
            edge = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edge, edge[1:], strict=False):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if held is None or held.key != key:
                    if held is not None:
                        yield held.done(arrow)
                    held = Chunk(key, cosine)
                part = batch.slice(a, b - a)
                held.add(np.array(part.column(4).to_pylist()), np.array(part.column(5).to_pylist(), np.int64), np.array(part.column(6).to_pylist(), np.int64), matrix(part.column(7)))
        if held is not None:
            yield held.done(arrow)

    return dealt.mapInArrow(run, schema)


class Chunk:
    """One chunk of a cell: its own vectors come first and are held, then all rows of the cell pass by."""

    def __init__(self, key: tuple, cosine: float):
        self.key, self.cosine = key, cosine
        self.ids, self.vectors, self.weights = np.empty(0, np.int64), None, np.empty(0, np.int64)
        self.links: list[tuple[int, int]] = []
        self.pending: list[tuple] = []

    def add(self, own: np.ndarray, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> None:
        if own.any():
            self.pending.append((ids[own], weights[own], x[own]))
        if not own.all():
            self.settle()
            self.meet(ids[~own], weights[~own], x[~own])

    def settle(self) -> None:
        """All own vectors are here: hold them and join them with each other."""
        if not self.pending:
            return
        self.ids = np.concatenate([p[0] for p in self.pending])
        own_weights = np.concatenate([p[1] for p in self.pending])
        self.vectors = np.concatenate([p[2] for p in self.pending])
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.count, self.group = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        self.pending = []
        self.meet(self.ids, own_weights, self.vectors)

    def meet(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> None:
        if self.vectors is None:
            return
        for k in range(0, len(ids), CHUNK):
            part, norms = x[k : k + CHUNK], np.sqrt((x[k : k + CHUNK] ** 2).sum(axis=1))
            near = (self.vectors @ part.T) / (self.norms[:, None] * norms[None, :]) >= self.cosine
            near &= self.ids[:, None] != ids[None, k : k + CHUNK]
            self.count += near @ weights[k : k + CHUNK]
            for j in np.flatnonzero(near.any(axis=0)).tolist():
                mine = np.flatnonzero(near[:, j])
                self.links.append((int(ids[k + j]), int(self.ids[mine[0]])))
                groups = np.unique(self.group[mine])
                if len(groups) > 1:
                    self.links += [(int(self.ids[mine[0]]), int(self.ids[g])) for g in groups.tolist()]
                    self.group[np.isin(self.group, groups)] = groups[0]

    def done(self, arrow: pa.Schema) -> pa.RecordBatch:
        self.settle()
        n = len(self.ids)
        links = sorted(set(self.links))
        counts = self.count.tolist() if n else []
        return pa.RecordBatch.from_arrays([pa.array([*self.ids.tolist(), *(a for a, _ in links)], pa.int64()), pa.array([*counts, *[None] * len(links)], pa.int64()), pa.array([*[None] * n, *(b for _, b in links)], pa.int64())], schema=arrow)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    usable, one = distinct_vectors(vectors)
    one = materialize(one, "vectors")
    embedding = one.schema["embedding"].dataType
    assert isinstance(embedding, ArrayType), "embeddings are arrays of numbers"
    placed = materialize(assign_cells(one, choose_pivots(one), float(np.sqrt(2 - 2 * cosine))), "cells")
    joined = materialize(join_cells(placed, cosine), "vector-links")
    groups = connected_components(joined.filter("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    counts = joined.filter("other is null").select(F.col("vec_id").alias("id"), "n_links")
    known = one.select(F.col("vec_id").alias("id"), "weight", "h1", "h2").join(counts, "id", "left").join(groups, "id", "left")
    known = known.select("h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    found = usable.join(known, ["h1", "h2"]).select(F.col("vec_id").alias("id"), F.struct("n_links", "component_id").alias("found")).groupBy("id").agg(F.max("found").alias("found"))
    out = vectors.select("vec_id").join(found, F.col("vec_id") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("found.n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found.component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
