"""Operator 8: cost-balanced packing of documents into sequences of a fixed number of tokens.

Each document is tokenized once and ended by an end token. What fills whole sequences is cut off; the rest of the document
is one piece. Pieces are dealt evenly over blocks of a bounded number of documents and bytes of text. In a block, pieces go by
descending estimated cost (linear in their tokens plus quadratic, for attention) to the sequence of the lowest cost so far
that has room. A piece that fits nowhere whole is cut: it fills the cheapest sequence that has room, and goes on with the
rest. A block opens as many sequences as its tokens need, so less than one sequence of each block is padding.

Null and empty texts are the end token alone. Repeated rows are packed as often as they occur. Other columns than doc_id and
text are not carried; doc_id keeps its type. A block's pieces are sorted, so that a task that runs again gives the same.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.bpe import byte_alphabet
from quaverlake.llm.common import BATCH_BYTES, as_text, cut, schema_of, table, to_batch

VOCABULARY, END, CAPACITY = "word_bpe_49k.json", 2, 4096
#: Documents and bytes of text that one block may hold, on average; a block's pieces are packed by one task.
BLOCK, BLOCK_BYTES = 16_000, 64 << 20
#: Cost of n tokens is n + QUADRATIC * n * n: attention over 6144 tokens costs as much as the rest of a layer.
QUADRATIC = 1 / 6144
#: Words that a Python worker remembers; beyond that it forgets all of them and goes on.
REMEMBERED = 1_000_000
#: From bytes, as Latin-1 characters, to the characters that stand for them in the vocabulary.
BYTES = {b: c for c, b in byte_alphabet().items()}


def letters(word: bytes) -> bool:
    """Whether it is a word of Latin-1 letters in lower case, in UTF-8."""
    if word.isascii():
        return word.isalpha() and word.islower()
    text = word.decode()
    return text.isalpha() and text.islower() and max(text) < "\u0100"


class WordTokenizer(dict):
    """The tokenizer over single white-space-separated words (bytes), which it never joins; known words aren't encoded again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.four = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        """The ids of a new word: one of letters goes to the tokenizer's model at once, others through all its steps.

        Words are in lower case here where they may be (see encode). A comma or full stop that ends a word of letters is
        always a token of its own.
        """
        if word.isalpha() and word.islower():
            ids = b"".join([self.four[t.id] for t in self.model.tokenize(word.decode())])
        elif len(word) > 1 and word[-1] in b",." and letters(word[:-1]):
            ids = self[word[:-1]] + self[word[-1:]]
        elif letters(word):
            ids = b"".join([self.four[t.id] for t in self.model.tokenize(word.decode("latin-1").translate(BYTES))])
        else:
            ids = b"".join([self.four[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        The tokenizer lowers texts itself, after normalisation that leaves Latin-1 texts as they are; those are lowered
        at once, so that fewer different words are met. What may hold a special token is left alone.
        """
        if "<|" not in text and (text.isascii() or max(text) < "\u0100"):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.encode().split()))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens, and crc of a piece that fills a sequence, ids (16 or 32 bits each) of another."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, crc bigint, ids binary"
    arrow = schema_of(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        narrow = words.tokenizer.get_vocab_size() <= 1 << 16
        last = struct.pack("<I", end)
        rows, held = [], 0
        for batch in cut(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.encode(as_text(text)) + last
                n = len(ids) // 4
                for start in range(0, n - n % capacity, capacity):
                    rows.append((doc, start, capacity, n, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), None))
                if rest := n % capacity:
                    tail = ids[4 * (n - rest) :]
                    rows.append((doc, n - rest, rest, n, None, np.frombuffer(tail, "<u4").astype("<u2").tobytes() if narrow else tail))
                    held += len(tail)
                held += 64
                if held >= BATCH_BYTES:
                    yield to_batch(rows, arrow)
                    rows, held = [], 0
        if rows:
            yield to_batch(rows, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def assign(lengths: np.ndarray, capacity: int, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(piece, first token, tokens, sequence, offset) of all parts; lengths must descend and be below the capacity."""
    n = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(n, capacity), np.zeros(n)
    for piece, length in enumerate(lengths.tolist()):
        begin = 0
        while begin < length:
            rest = length - begin
            fits = np.flatnonzero(room >= rest)
            if not len(fits):
                fits = np.flatnonzero(room > 0)
            at = int(fits[cost[fits].argmin()])
            take = min(rest, int(room[at]))
            yield piece, begin, take, at, capacity - int(room[at])
            room[at] -= take
            cost[at] += take + quadratic * take * take
            begin += take


def pack(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY, quadratic: float = QUADRATIC, block: int = BLOCK) -> DataFrame:
    """Where each piece of each document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // block), -(-size.bytes // BLOCK_BYTES))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    arrow = schema_of(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        whole, rest = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (rest if row[5] is not None else whole).append(row)
        whole.sort(key=lambda r: (r[0] is None, r[0], r[1], r[4]))
        out = [(doc, start, length, crc, total, first + i, 0) for i, (doc, start, length, total, crc, _) in enumerate(whole)]
        first += len(whole)
        rest.sort(key=lambda r: (-r[2], r[0] is None, r[0], r[1], r[5]))
        for i, begin, take, at, offset in assign(np.array([r[2] for r in rest], np.int64), capacity, quadratic):
            doc, start, length, total, _, ids = rest[i]
            tokens = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4")[begin : begin + take].astype("<u4")
            out.append((doc, start + begin, take, zlib.crc32(tokens.tobytes()), total, first + at, offset))
        for k in range(0, len(out), 50_000):
            yield to_batch(out[k : k + 50_000], arrow)

    return pieces(docs, path, end, capacity).repartition(blocks).mapInArrow(run, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
