"""Operator 13: the trie of the first turns of conversations, by vertical bitmaps.

A shard is a hundred of ids, which hold their leader too: its conversations are rebuilt in one pass over its sorted rows, and
each keeps a bit of the shard's bitsets. The turns are then indexed as (position, turn) to bitset. A depth-first walk
intersects the bitset of a node with the postings of the next position: each intersection that isn't empty is a child, its
popcount the child's members here, and the members without a turn there end at the node. A walk holds SLAB positions of one
shard; the bitsets at its end are where the next slab goes on, so a conversation of any length needs the same memory.

Shards meet in aggregations alone: a node's members are the sum of its popcounts, its children are counted after nodes are
merged, and what a node adds to its ancestors (a leaf, saved text) is given to the shard of its smallest member, which
passes it up its own nodes; the sums of an ancestor over all shards are those of its subtree, whatever its size. The lists of
ends come in order of shards and are hashed as they stream by. Nodes are told apart by a 128-bit digest of their turns. Texts
are hashed where they are read and never shuffled.

Rows without conv_id belong to no conversation and go. A null turn comes first; rows of a conversation with the same turn stand in the order
of their hashes. Null roles and texts are empty. Repeated rows are turns of their own. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import Scratch, schema_of, table

#: Ids of a shard (a leader and those it leads), positions that a walk holds, most turns that are led plus one.
SHARD, SLAB, LED = 100, 64, 6
#: Rows of a batch that a task hands on.
ROWS = 8_192
MASK, PRIMES = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TURNS = "shard bigint, slab bigint, conv bigint, position bigint, k1 bigint, k2 bigint, chars bigint"
NODES = "shard bigint, node bigint, parent bigint, depth bigint, g1 bigint, g2 bigint, p1 bigint, p2 bigint, least bigint, n bigint, chars bigint, ends string"
GIVEN = "shard bigint, depth bigint, node bigint, parent bigint, g1 bigint, g2 bigint, leaves bigint, saved bigint"


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in itertools.batched(rows, ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def streamed(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn turns the rows of a task, in their order, into rows of the schema; it sees each once and keeps what it needs."""
    arrow = schema_of(df.sparkSession, schema)
    return df.mapInArrow(lambda batches: batches_of(fn(rows_of(batches)), arrow), schema)


def rebuilt_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The turns of rebuilt conversations, in rows of TURNS, of rows (shard, own, conv, k1, k2, chars) whose leader comes first.

    own is 0 for the leader. A conversation without turns gives one row with position 0.
    """
    shard, led = None, []
    for (sh, conv), own in itertools.groupby(rows, key=lambda r: (r[0], r[2])):
        if sh != shard:
            shard, led = sh, []
        h, at = crc32(str(conv).encode()) % LED, 0
        first = next(own)
        own = itertools.chain((first,), own)
        if first[1] == 0:
            led = [r[3:] for r in itertools.islice(own, LED - 1)]
            own = itertools.chain(((None, 0, conv, *t) for t in led), own)
        for t in led[:h]:
            yield sh, at // SLAB, conv, at + 1, *t
            at += 1
        for r in itertools.islice(own, h, None):
            yield sh, at // SLAB, conv, at + 1, *r[3:]
            at += 1
        if not at:
            yield sh, 0, conv, 0, 0, 0, 0


def digest(parent: tuple[int, int], k1: int, k2: int) -> tuple[int, int]:
    """The digest of a node from its parent's and its last turn."""

    def mixed(x: int, prime: int) -> int:
        x = (x ^ (x >> 31)) * prime & MASK
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & MASK
        return x ^ (x >> 32)

    a, b = (mixed(((p * 3 + 1) & MASK) ^ mixed(k & MASK, q), q) for p, k, q in zip(parent, (k1, k2), PRIMES, strict=True))
    return a, b


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_nodes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The nodes of each shard, in rows of NODES, from its turns by slab, conversation and position."""
    for shard, slabs in itertools.groupby(rows, key=lambda r: r[0]):
        ids: list[int] = []
        numbers = itertools.count()
        frontier: list[tuple] | None = None
        for _, turns in itertools.groupby(slabs, key=lambda r: r[1]):
            index: dict[tuple, int] = {}
            turn_of: list[dict[int, tuple]] = [{} for _ in range(SLAB + 1)]
            if frontier is None:  # the first slab names all conversations, in order
                slot: dict[int, int] = {}
                for _, _, conv, position, *turn in turns:
                    bit = slot.setdefault(conv, len(slot))
                    if position:
                        key = (position, *turn)
                        index[key] = index.get(key, 0) | 1 << bit
                        turn_of[position % SLAB or SLAB][bit] = key
                ids = list(slot)
                frontier = [(next(numbers), None, 0, (0, 0), (0, 0), (1 << len(ids)) - 1, 0)]
            else:
                for _, _, conv, position, *turn in turns:
                    key = (position, *turn)
                    index[key] = index.get(key, 0) | 1 << slot[conv]
                    turn_of[position % SLAB or SLAB][slot[conv]] = key
            frontier = yield from walk(shard, ids, index, turn_of, frontier, numbers)
        for node in frontier or ():
            yield node_row(shard, ids, node, node[5])


def walk(shard: int, ids: list[int], index: dict[tuple, int], turn_of: list[dict[int, tuple]], frontier: list[tuple], numbers: Iterator[int]):
    """Depth first from each node of the frontier through one slab; the nodes at its last position are returned, not given."""
    beyond, stack = [], list(reversed(frontier))
    top = (frontier[0][2] // SLAB + 1) * SLAB if frontier else 0
    while stack:
        node = stack.pop()
        number, _, depth, own, _, bits, _ = node
        if depth == top:
            beyond.append(node)
            continue
        rest, going, children = bits, 0, []
        at = turn_of[(depth + 1) % SLAB or SLAB]
        while rest:
            low = rest & -rest
            key = at.get(low.bit_length() - 1)
            if key is None:
                rest ^= low
                continue
            child = bits & index[key]
            rest &= ~child
            going |= child
            children.append((next(numbers), number, depth + 1, digest(own, key[1], key[2]), own, child, key[3]))
        yield node_row(shard, ids, node, bits & ~going)
        stack.extend(reversed(children))
    return beyond


def node_row(shard: int, ids: list[int], node: tuple, ending: int) -> tuple:
    number, parent, depth, own, above, bits, chars = node
    ends = ",".join(str(ids[i]) for i in range(len(ids)) if ending >> i & 1) if ending else None
    least = ids[(bits & -bits).bit_length() - 1]
    return shard, number, parent, depth, *map(signed, (*own, *above)), least, bits.bit_count(), chars, ends


def passed_up(rows: Iterator[tuple]) -> Iterator[tuple]:
    """g1, g2, leaves, saved of each node's subtree within its shard, from rows of GIVEN by shard and depth, deepest first."""
    for _, levels in itertools.groupby(rows, key=lambda r: r[0]):
        below: dict[int, list[int]] = {}
        for _, level in itertools.groupby(levels, key=lambda r: r[1]):
            here: dict[int, list[int]] = {}
            for _, _, node, parent, g1, g2, leaves, saved in level:
                more = below.get(node, (0, 0))
                leaves, saved = leaves + more[0], saved + more[1]
                yield g1, g2, leaves, saved
                mine = here.setdefault(parent, [0, 0])
                mine[0] += leaves
                mine[1] += saved
            below = here


def end_hashes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """g1, g2 and the hash of all ends of a node, from rows (g1, g2, first, ends) by node and then by first id."""
    for (g1, g2), parts in itertools.groupby(rows, key=lambda r: r[:2]):
        seen = hashlib.sha256()
        for i, (_, _, _, ends) in enumerate(parts):
            seen.update(("," * bool(i) + ends).encode())
        yield g1, g2, seen.hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The turns of all rebuilt conversations, in rows of TURNS."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.expr(f"conv_id div {SHARD}").alias("shard"),
        F.when(F.col("conv_id") % SHARD == 0, 0).otherwise(1).alias("own"),
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit("turn"), text, role).alias("k2"),
        F.length(text).cast("long").alias("chars"),
    )
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "own", "conv", F.asc_nulls_first("turn"), "k1", "k2")
    return streamed(dealt.drop("turn"), rebuilt_rows, TURNS)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch()
    turns = rebuilt(conversations)
    local = scratch.keep(streamed(turns.repartition("shard").sortWithinPartitions("shard", "slab", "conv", "position"), shard_nodes, NODES), "nodes")
    ends = local.filter("ends IS NOT NULL").select("g1", "g2", F.split("ends", ",", 2)[0].cast("long").alias("first"), "ends")
    hashed = streamed(ends.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "first"), end_hashes, "g1 bigint, g2 bigint, ends_sha256 string")
    whole = local.groupBy("g1", "g2").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.struct("depth", "p1", "p2", "chars")).alias("x"))
    whole = scratch.keep(whole.select("g1", "g2", "conv_id", "n_convs", "x.*"), "merged")
    children = whole.filter("depth > 0").groupBy(F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = whole.join(children, ["g1", "g2"], "left").join(hashed, ["g1", "g2"], "left")
    nodes = scratch.keep(nodes.select("g1", "g2", "conv_id", "depth", "p1", "p2", "n_convs", "chars", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "whole")
    owner = nodes.select("g1", "g2", F.col("conv_id").alias("least"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("worth"))
    given = local.select("shard", "depth", "node", "parent", "g1", "g2", "least").join(owner, ["g1", "g2", "least"], "left")
    given = given.select("shard", "depth", "node", F.coalesce("parent", F.lit(-1)).alias("parent"), "g1", "g2", F.coalesce("leaf", F.lit(0)).alias("leaves"), F.coalesce("worth", F.lit(0)).alias("saved"))
    sums = streamed(given.repartition("shard").sortWithinPartitions("shard", F.desc("depth")), passed_up, "g1 bigint, g2 bigint, leaves bigint, saved bigint")
    sums = sums.groupBy("g1", "g2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = nodes.select(F.col("g1").alias("p1"), F.col("g2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(sums, ["g1", "g2"]).join(above, ["p1", "p2", "depth"], "left")
    done = scratch.keep(done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")
    scratch.drop(but=1)
    return done


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
