"""Small helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quaverlake.plans.written import materialize, new_path, shared_dir  # noqa: F401 (for the operators)

#: Bytes of output that one Arrow batch may hold before it is handed to Spark.
BATCH_BYTES = 8 << 20
#: Rows of a written table for which one task suffices where it is read again.
TASK_ROWS = 50_000


class Scratch:
    """Tables that an operator writes on its way; they are deleted together once what follows doesn't read them."""

    def __init__(self) -> None:
        self.tables: list[tuple[DataFrame, str]] = []

    def keep_with(self, df: DataFrame, name: str, sums: list[Column]) -> tuple[DataFrame, dict]:
        """df, written and read back, and sums (n, the number of rows, among them) over its rows, taken while it is written."""
        seen = Observation()
        path = new_path(df.sparkSession, name)
        df.observe(seen, *sums).write.parquet(path)
        found = seen.get
        out = df.sparkSession.read.schema(df.schema).parquet(path).coalesce(max(1, -(-found["n"] // TASK_ROWS)))
        self.tables.append((out, path))
        return out, found

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep_with(df, name, [F.count(F.lit(1)).alias("n")])[0]

    def drop(self, but: int = 0) -> None:
        """Delete all tables but the last ones; what still reads the others must have been written."""
        gone = self.tables[: len(self.tables) - but]
        self.tables = self.tables[len(gone) :]
        for df, path in gone:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text(value: str | None) -> str:
    return "" if value is None else value


def with_text_columns(df: DataFrame, fn: Callable[..., tuple], schema: str, text: str = "text", carry: list[str] | None = None, more: tuple[str, ...] = (), prefix: str = "", setup: Callable[[], object] | None = None, after: Callable[[list[tuple]], list[tuple]] | None = None) -> DataFrame:
    """Append columns that fn makes from each text (and from the columns named in `more`).

    `carry` names the columns to keep (default: all); they pass through Arrow untouched. The new columns are named by the DDL
    schema behind `prefix`; a carried column of the same name gives way to the new one. `after` may turn what fn made of a
    whole batch into the final rows, for what is better done in one go.
    """
    new = [prefix + f.name for f in struct_of(schema).fields]
    carry = [c for c in (df.columns if carry is None else carry) if c not in new]
    inner = df.select(*(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)), *(df[f"`{c}`"].alias(f"t{i}") for i, c in enumerate((text, *more))))
    fields = schema_of(df.sparkSession, schema)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        for batch in cut(batches):
            rows = [fn(*first, *values) for values in zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)]
            rows = after(rows) if after and rows else rows
            made = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t.type) for t in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *(f"n{i}" for i in range(len(made)))])

    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)] + [StructField(f"n{i}", f.dataType) for i, f in enumerate(struct_of(schema).fields)])
    return inner.mapInArrow(run, out).toDF(*carry, *new)


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Apply fn to each row (its columns in order) and return rows of the given DDL schema.

    fn gets the value of setup() first where setup is given; setup runs once a task.
    Output batches are cut by size, so that a few very long texts don't pile up.
    """
    arrow = schema_of(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        rows: list[tuple] = []
        held = 0
        for batch in cut(batches):
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = fn(*first, *values)
                rows.append(row)
                held += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
                if held >= BATCH_BYTES:
                    yield to_batch(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield to_batch(rows, arrow)

    return df.mapInArrow(run, schema)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BATCH_BYTES, or one row if it is larger."""
    for batch in batches:
        step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)) if batch.nbytes > BATCH_BYTES else max(1, batch.num_rows)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def struct_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct_of(ddl))


def crc_fold(column: str, parts: int):
    """crc32 of the decimal text of a column, modulo parts: the folds that contracts name."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, rows: int, key: str, total: int | None = None) -> DataFrame:
    """About `rows` rows with the smallest key hashes, and never more than twice that.

    The share is taken by a hash of the key and so needs no shuffle; the limit only guards against one key that repeats very often.
    """
    total = df.count() if total is None else total
    share = min(1.0, rows / max(total, 1))
    if share < 1.0:
        df = df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return df.limit(2 * rows)


#: Odd multipliers of the polynomial word hash and of the shingle hash.
WORD_BASE, SHINGLE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of WORD_BASE and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((WORD_BASE, pow(WORD_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (a run of bytes other than ASCII white space), in order."""
    if not raw:
        return np.empty(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    white = WHITE[b]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    edge = np.concatenate(([0] if not white[0] else [], edge, [len(b)] if not white[-1] else [])).astype(np.int64)
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of `width` words; the whole sequence if it is shorter."""
    words = word_hashes(raw)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n, width, np.uint64)
        for k in range(width):
            total = total * np.uint64(SHINGLE_BASE) + words[k : k + n]
    return np.unique(mix(total))
