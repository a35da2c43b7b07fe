"""Operator 6: byte-level BPE by forced-boundary splitting.

Two bytes that stand side by side in no vocabulary token can never end up in one token, so the text may be cut between
them. The fragments are encoded on their own, remembered, and their ids concatenated. Cuts are taken at two levels:
before white space that follows a visible character (no token holds such a byte pair, and the pre-tokenizer cuts there
whatever stands around it), and, inside each pre-token, at every other byte pair that no token holds.

Null and empty texts give no ids and decode to the empty text. Repeated rows give repeated results.
Columns other than the key and the text are not carried along.
"""

from __future__ import annotations

import heapq
import json
import re
import struct

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import as_text, map_rows, table

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokenizer of the byte-level vocabulary: a fixed value of its format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(r"\s*\S+|\s+")
#: Ranks are kept as rank << 16 | id of the merged token; this one is above all of them.
NO_RANK = 1 << 40
#: Fragments that a Python worker remembers; beyond that it forgets all of them and goes on.
REMEMBERED = 400_000
#: Bytes from which a fragment is merged by a heap over a linked list, whose time grows with n log n; below, a scan is faster.
LONG = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else 256 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ForcedBoundaryCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.pieces |= {i: t.encode() for t, i in special.items()}
        self.single = {b: vocab[c] for c, b in letters.items() if c in vocab}
        self.joined = bytearray(1 << 16)
        for token in self.pieces.values():
            for a, b in zip(token, token[1:], strict=False):
                self.joined[a << 8 | b] = 1
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a] << 16 | vocab[b]] = rank << 16 | vocab[a + b]
        self.pretoken = regex.compile(PRETOKEN)
        self.chunks: dict[str, bytes] = {}
        self.fragments: dict[bytes, bytes] = {}

    def merge(self, fragment: bytes) -> bytes:
        """Merge the adjacent pair of the lowest rank, leftmost first, until no pair has a rank."""
        if len(fragment) >= LONG:
            return self.merge_long(fragment)
        ids = [self.single[b] for b in fragment]
        rank_of = self.ranks.get
        ranks = [rank_of(a << 16 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < NO_RANK:
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 16 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(new << 16 | ids[i + 1], NO_RANK)
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge_long(self, fragment: bytes) -> bytes:
        """The same by a heap of pairs (rank, place) and links to the next and the previous token; a pair that has changed is passed over."""
        ids = [self.single[b] for b in fragment]
        n, rank_of = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank_of(a << 16 | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)] + [NO_RANK]
        heap = [rank << 32 | i for i, rank in enumerate(now) if rank < NO_RANK]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if now[i] != rank:
                continue
            ids[i] = new = rank & 0xFFFF
            gone = after[i]
            j = after[i] = after[gone]
            now[gone] = NO_RANK
            ids[gone] = -1
            now[i] = NO_RANK
            if j < n:
                before[j] = i
                now[i] = rank_of(new << 16 | ids[j], NO_RANK)
                if now[i] < NO_RANK:
                    heapq.heappush(heap, now[i] << 32 | i)
            h = before[i]
            if h >= 0:
                now[h] = rank_of(ids[h] << 16 | new, NO_RANK)
                if now[h] < NO_RANK:
                    heapq.heappush(heap, now[h] << 32 | h)
        kept = [i for i in ids if i >= 0]
        return struct.pack(f"<{len(kept)}I", *kept)

    def split(self, pretoken: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        joined, left, start, out = self.joined, pretoken[0], 0, []
        for i, right in enumerate(pretoken[1:], 1):
            if not joined[left << 8 | right]:
                out.append(pretoken[start:i])
                start = i
            left = right
        out.append(pretoken[start:])
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            pretokens = [chunk]
        elif word[:-1].isalpha() and word[-1] in ",.":
            pretokens = [chunk[:-1], chunk[-1]]
        else:
            pretokens = self.pretoken.findall(chunk)
        out = []
        for pretoken in pretokens:
            for fragment in self.split(pretoken.encode()):
                found = self.fragments.get(fragment)
                if found is None:
                    found = self.merge(fragment)
                    if len(self.fragments) >= REMEMBERED:
                        self.fragments.clear()
                    if len(fragment) <= 64:
                        self.fragments[fragment] = found
                out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        parts = self.special_at.split(text) if self.special_at else [text]
        for part in parts:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            known = self.chunks
            for chunk in CHUNK.findall(part):
                found = known.get(chunk)
                if found is None:
                    found = self.encode_chunk(chunk)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(chunk) <= 64:
                        known[chunk] = found
                out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    """One codec a Python worker and vocabulary; what it remembers serves all of the worker's tasks."""
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (binary: little-endian unsigned 32-bit integers) of each whole text."""
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), lambda c, k, t: (k, c.encode(as_text(t))), f"`{key}` {kind}, ids binary", lambda: codec(path))


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, ids and the text that the ids stand for; special tokens are kept."""
    kind = encoded.schema[key].dataType.simpleString()
    return map_rows(encoded.select(key, "ids"), lambda c, k, i: (k, i, c.decode(i)), f"`{key}` {kind}, ids binary, decoded string", lambda: codec(path))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids and the text that the ids stand for, in one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()

    def both(c: ForcedBoundaryCodec, k: object, t: str | None) -> tuple:
        ids = c.encode(as_text(t))
        return k, ids, c.decode(ids)

    return map_rows(docs.select(key, text), both, f"`{key}` {kind}, ids binary, decoded string", lambda: codec(path))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
