"""Operator 3: n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct runs of WIDTH words (64-bit hashes). Sets fall into bands of similar size, and a set
takes part in its own band and, if a similar set may be larger than the band allows, in the next. Two sets that are similar
enough differ in at most H elements, a quarter of the smaller one's size (the Hamming bound of Jaccard 0.8).

For a band the domain of hashes is divided into groups of partitions; signatures are what a set has in subsets of a group's
partitions. Bands of small sets (up to GROUPED) take groups of three partitions and enumerate the subsets of two: two
differences at least, in different partitions, break all three (one is enough for a group of which the set fills one
partition only). Larger bands take groups of two partitions and subsets of one, where one difference breaks one signature:
with many partitions larger groups make half as many signatures again, for no fewer candidates. A set emits the
signatures of all groups that it fills. Those that H differences can't break are shared with each similar set, which emits
all of its own too; what is guaranteed beyond one signature is the set's spare. Candidates share as many at least as the
larger spare of the two guarantees.

Signatures that more than HOT sets share are left out of the pairs, and a pair needs as many fewer as both sets have of them;
as all signatures are emitted, a passage that many documents share leaves enough of the others. Only pairs of sets that both
run out of spare (large groups of near copies) are joined by hot signatures: by stars around the set with the most hot
signatures, and only what lies in different components after that meets in blocks. Sets whose groups can all be broken (very
small ones) emit single shingles besides, by the prefix rule. Candidates are compared exactly, best partners first, and
later only across components, so that no link between different components is lost and copies aren't expanded into all pairs.

Texts are lower-cased (A-Z) and split at ASCII white space; fewer than WIDTH words are one run. Null texts and texts without
words have an empty set and link with nothing. Equal texts (and repeated rows) have equal sets and so are one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import BATCH_BYTES, Scratch, as_text, materialize, mix, schema_of, shingles, table, to_batch, with_text_columns
from quaverlake.llm.components import hooked

WIDTH = 5
#: The least similarity of a link, as a fraction: intersection * OF >= union * AT_LEAST.
AT_LEAST, OF = 80, 100
#: Ratio of a band's largest sizes to those of the band before.
BAND = 1.5625
#: Partitions of a band, as a share of its largest size.
PARTITIONS = 0.32
#: The largest size of bands with groups of three partitions, and partitions that these bands have for each of their largest size.
GROUPED, GROUPED_PARTITIONS = 63, 0.6
#: Sets that may share a signature before it counts as hot.
HOT = 64
#: The spare that can be told; more counts as that. Sizes are told in classes of this ratio; similar sets are few apart.
MOST_SPARE, SIZE_STEP = 8000, 1.02
SIZE_APART = int(np.log(OF / AT_LEAST) / np.log(SIZE_STEP)) + 1
#: Sets of the crowd that meet in one block.
BLOCK = 2048
#: Hot signatures by which a set looks for a hub in one round of stars.
STAR_KEYS = 4
#: Sets that a task remembers to have emitted, so that equal texts are not emitted again.
REMEMBERED = 200_000
#: Sets that one task compares with a held set before it is held again in another.
FAN = 256


def bounds() -> np.ndarray:
    """The largest size of each band; sets of three or less link with nothing but their copies."""
    out = [3, 6]
    while out[-1] < 1 << 40:
        out.append(int(np.ceil(out[-1] * BAND)))
    return np.array(out)


BOUNDS = bounds()


def lower(text: str | None) -> bytes:
    return as_text(text).encode().lower()


def set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0)))


def folded(s: np.ndarray, mixed: np.ndarray, parts: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The filled partitions in order, and the sum of the mixed hashes in each."""
    with np.errstate(over="ignore"):
        part = ((mix(s ^ seed) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        return ranked[first], np.add.reduceat(mixed[order], first)


def partenum(s: np.ndarray, mixed: np.ndarray, band: int, allowed: int) -> tuple[np.ndarray, int]:
    """All signatures of a set in a band, and its spare: how many of them, less one, `allowed` differences can't break."""
    seed = np.uint64(band * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        if BOUNDS[band] > GROUPED:
            at, content = folded(s, mixed, int(PARTITIONS * BOUNDS[band]) + 4, seed)
            return mix(content ^ mix(at.astype(np.uint64) + seed)), len(at) - allowed - 1
        groups = int(GROUPED_PARTITIONS * BOUNDS[band] / 3) + 1
        at, content = folded(s, mixed, 3 * groups, seed)
        whole, filled = np.zeros(3 * groups, np.uint64), np.zeros(3 * groups, bool)
        whole[at], filled[at] = content, True
        whole, filled = whole.reshape(-1, 3), filled.reshape(-1, 3)
        subset = (whole + np.roll(whole, 1, axis=1)).ravel()
        some = (filled | np.roll(filled, 1, axis=1)).ravel()
        sig = mix(subset ^ mix(np.arange(3 * groups, dtype=np.uint64) + seed))[some]
    needed = np.sort(np.minimum(filled.sum(axis=1), 2))
    needed = needed[needed > 0]
    return sig, len(needed) - int((np.cumsum(needed) <= allowed).sum()) - 1


def signatures(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(signatures, info) of a set for each band that it takes part in; info packs the spare, the band and what kind it is.

    info: spare + 1 in the bits from 18 on, the size's class in bits 8 to 17, home band in bits 2 to 7, bit 1 for single
    shingles, bit 0 for the next band.
    """
    n = len(s)
    if n <= BOUNDS[0]:
        return []
    out = []
    home = int(np.searchsorted(BOUNDS, n))
    mixed = mix(s)
    size = int(np.log(n) / np.log(SIZE_STEP)) << 8
    for band in (home, home + 1) if n * OF // AT_LEAST > BOUNDS[home] else (home,):
        sig, spare = partenum(s, mixed, band, n // 4)
        spare = min(max(spare, -1), MOST_SPARE)
        kind = size | home << 2 | (band > home)
        out.append((sig, (spare + 1) << 18 | kind))
        if spare < 0:
            prefix = n - -(-n * AT_LEAST // OF) + 1
            out.append((mix(s[:prefix] ^ np.uint64(0x5555)), kind | 2))
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), sid (hash of the set) and n_shingles of every document."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))

    def ids(text: str | None) -> tuple[int, int]:
        s = shingles(lower(text), WIDTH)
        return set_id(s), len(s)

    return with_text_columns(rows, ids, "sid bigint, n_shingles bigint", carry=["doc_id", "row"])


def signature_rows(docs: DataFrame) -> DataFrame:
    schema = "sig bigint, sid bigint, info int"
    arrow = schema_of(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size, emitted = 0, set()

        def flush() -> pa.RecordBatch:
            counts = [len(h[0]) for h in held]
            columns = (np.concatenate([h[0] for h in held]).view(np.int64), np.repeat(np.array([h[1] for h in held], np.int64), counts), np.repeat(np.array([h[2] for h in held], np.int32), counts))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(lower(text), WIDTH)
                sid = set_id(s)
                if sid in emitted:
                    continue
                if len(emitted) >= REMEMBERED:
                    emitted.clear()
                emitted.add(sid)
                for sig, info in signatures(s):
                    held.append((sig, sid, info))
                    size += 24 * len(sig)
                if size >= BATCH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, schema)


def meetings(rows: DataFrame) -> DataFrame:
    """From signatures: pairs (a, b, shared, spare, band), and rows (a, sig, spare, band) of hot signatures."""
    schema = "a bigint, b bigint, shared int, spare int, band int, sig bigint"
    arrow = schema_of(rows.sparkSession, schema)
    dealt = rows.repartition("sig").sortWithinPartitions("sig", "sid")

    def hot_rows(sig: np.ndarray, sid: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
        n = len(sig)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(sid), none, pa.nulls(n, pa.int32()), pa.array((info >> 18).astype(np.int32) - 1), pa.array(band_of(info)), pa.array(sig)], schema=arrow)

    def band_of(info: np.ndarray) -> np.ndarray:
        return ((info >> 2 & 63) + (info & 1)).astype(np.int32)

    def pair_rows(sid: np.ndarray, info: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.RecordBatch | None:
        left, right = [], []
        for n in np.unique(size):
            i, j = np.triu_indices(int(n), 1)
            at = first[size == n]
            left.append((at[:, None] + i).ravel())
            right.append((at[:, None] + j).ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        home = info >> 2 & 63
        band = band_of(info)
        size_ = info >> 8 & 1023
        meet = ((band[a] == np.maximum(home[a], home[b])) | (info[a] & 2 > 0)) & (np.abs(size_[a] - size_[b]) <= SIZE_APART)
        a, b = a[meet], b[meet]
        if not len(a):
            return None
        spare = np.maximum(info[a] >> 18, info[b] >> 18).astype(np.int32) - 1
        key = np.stack([sid[a], sid[b]], axis=1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, spare, where = key[order], spare[order], band[a][order]
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
        shared = np.diff(np.append(edge, len(key))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key[edge, 0]), pa.array(key[edge, 1]), pa.array(shared), pa.array(np.minimum.reduceat(spare, edge)), pa.array(where[edge]), pa.nulls(len(edge), pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        running: int | None = None  # the signature at the end of what was read, if it is known to be hot
        last: tuple[int, int] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if not len(new[0]):
                    continue
                same = np.concatenate(([last == (int(new[0][0]), int(new[1][0]))], (new[0][1:] == new[0][:-1]) & (new[1][1:] == new[1][:-1])))
                last = (int(new[0][-1]), int(new[1][-1]))
                sig, sid, info = (np.concatenate((k, c[~same])) for k, c in zip(kept, new, strict=True))
            else:
                sig, sid, info = kept
            if not len(sig):
                continue
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(first, len(sig)))
            hot = (size > HOT) | (sig[first] == running if running is not None else False)
            open_run = batch is not None and not hot[-1]
            whole = np.ones(len(first), bool)
            whole[-1] = not open_run
            if (hot & whole).any():
                rows_ = np.repeat(hot & whole, size)
                yield hot_rows(sig[rows_], sid[rows_], info[rows_])
            running = int(sig[-1]) if hot[-1] else None
            cold = whole & ~hot & (size > 1)
            if cold.any() and (made := pair_rows(sid, info, first[cold], size[cold])) is not None:
                yield made
            tail = slice(first[-1], None) if open_run else slice(len(sig), None)
            kept = [sig[tail], sid[tail], info[tail]]

    return dealt.mapInArrow(run, schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links. a's set is held while those of its partners stream by, FAN of them a task."""
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    held = fans.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(0).alias("role"), F.col("a").alias("sid"))
    partners = pairs.join(fans, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("fan"), F.lit(1).alias("role"), F.col("b").alias("sid"))
    rows = held.union(partners).join(sets, "sid").select("a", "fan", "role", "sid", "s").repartition("a", "fan").sortWithinPartitions("a", "fan", "role")
    schema = "a bigint, b bigint"
    arrow = schema_of(pairs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, of = np.empty(0, np.uint64), None
        for batch in batches:
            found = []
            for a, role, sid, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                other = np.frombuffer(s, np.uint64)
                if role == 0:
                    mine, of = other, a
                elif a == of:
                    at = np.searchsorted(mine, other)
                    at[at == len(mine)] = 0
                    both = int((mine[at] == other).sum()) if len(mine) else 0
                    if OF * both >= AT_LEAST * (len(mine) + len(other) - both):
                        found.append((a, sid))
            if found:
                yield to_batch(found, arrow)

    return rows.mapInArrow(run, schema)


def candidate_sets(docs: DataFrame, ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and s (its sorted hashes) of the wanted sids, from one document each."""
    reps = ids.filter("n_shingles > 0").groupBy("sid").agg(F.min("row").alias("row")).join(wanted, "sid", "left_semi")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(reps.hint("shuffle_hash"), "row").dropDuplicates(["sid"])
    return with_text_columns(texts, lambda t: (shingles(lower(t), WIDTH).tobytes(),), "s binary", carry=["sid"])


def best_partner(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, shared): each b with the a that it shares most with."""
    return pairs.groupBy("b").agg(F.max(F.struct("shared", F.xxhash64("a").alias("h"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *pairs.columns[2:]))


def grouped(rows: DataFrame, column: str, groups: DataFrame | None) -> DataFrame:
    """rows with the component of a column's set (itself if it stands in no link yet) as group_<column>."""
    if groups is None:
        return rows.withColumn(f"group_{column}", F.col(column))
    return rows.join(groups.select(F.col("id").alias(column), F.col("component").alias("_c")), column, "left").withColumn(f"group_{column}", F.coalesce("_c", column)).drop("_c")


def across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    return grouped(grouped(pairs, "a", groups), "b", groups).filter("group_a <> group_b").select("a", "b", *pairs.columns[2:])


def similarity_groups(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id (a sid) and component of all sets that link with others, but the least of each component.

    What is written on the way is deleted at the end.
    """
    scratch = Scratch()
    met = scratch.keep(meetings(signature_rows(docs)), "meetings")
    # a row for each set and band with hot signatures; a set has no more of them than it emitted
    hot = met.filter("b is null").groupBy(F.col("a").alias("sid"), "band").agg(F.collect_set("sig").alias("sigs"), F.min("spare").alias("spare"))
    hot = scratch.keep(hot.withColumn("hot", F.size("sigs")), "hot-sets")
    pairs = met.filter("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("spare").alias("spare"), F.min("band").alias("band"))
    any_hot = not hot.isEmpty()
    if any_hot:
        for side in ("a", "b"):
            pairs = pairs.join(hot.select(F.col("sid").alias(side), "band", F.col("hot").alias(f"hot_{side}")), [side, "band"], "left")
        pairs = pairs.withColumn("spare", F.col("spare") - F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))))
    pairs = scratch.keep(pairs.filter(F.col("shared") >= F.greatest(F.lit(1), F.col("spare") + 1)).select("a", "b", "shared"), "candidates")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))
    # a pair that shares no other signature shares more hot ones than either has spare
    crowd = hot.filter("hot > spare")
    any_short = any_hot and not crowd.isEmpty()
    if any_short:
        wanted = wanted.union(crowd.select("sid"))
    sets = scratch.keep(candidate_sets(docs, ids, wanted.distinct()), "sets")
    # best partners first, then what lies in different components after that, last the crowd's own pairs
    first = best_partner(both_ways(pairs))
    groups = None
    for salt, found in enumerate((lambda: first, lambda: across(pairs, groups).select("a", "b"))):
        found = found().union(star_pairs(crowd, groups, salt)).distinct() if any_short else found()
        groups = hooked(compare(found, sets), groups, scratch)
    if any_short:
        groups = hooked(compare(crowd_pairs(crowd, groups, sets, scratch), sets), groups, scratch)
    groups = scratch.keep(ids.select("sid").limit(0).selectExpr("sid AS id", "sid AS component") if groups is None else groups, "groups")
    scratch.drop(but=1)
    return groups


def star_pairs(crowd: DataFrame, groups: DataFrame | None, salt: int) -> DataFrame:
    """Pairs of a set without spare and a hub: the one with the most hot signatures that shares a key with it, outside its component.

    The keys of a set are STAR_KEYS of its hot signatures by least hash, so near copies have some in common.
    """
    own = grouped(crowd, "sid", groups)
    hashed = F.transform("sigs", lambda s: F.struct(F.xxhash64(s, F.lit(salt)).alias("h"), s.alias("sig")))
    rows = own.select("sid", "hot", "group_sid", F.explode(F.slice(F.array_sort(hashed), 1, STAR_KEYS)).alias("k")).select("k.sig", "sid", "hot", "group_sid")
    hub = rows.groupBy("sig").agg(F.max(F.struct("hot", F.xxhash64("sid").alias("h"), "sid", "group_sid")).alias("hub"))
    return rows.join(hub, "sig").filter("group_sid <> hub.group_sid").select(F.col("hub.sid").alias("a"), F.col("sid").alias("b"))


def sketches(sets: DataFrame) -> DataFrame:
    """sid, band, n and the counts of a set's hashes in buckets, as many as the band's sizes, for both bands of a set."""
    schema = "sid bigint, band int, n int, sketch binary"
    arrow = schema_of(sets.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(raw, np.uint64)
                home = int(np.searchsorted(BOUNDS, len(s)))
                for band in (home, home + 1):
                    bits = int(np.clip(np.ceil(np.log2(BOUNDS[band])), 4, 12))
                    counts = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                    rows.append((sid, band, len(s), np.minimum(counts, 255).astype(np.uint8).tobytes()))
            if rows:
                yield to_batch(rows, arrow)

    return sets.select("sid", "s").mapInArrow(run, schema)


def crowd_pairs(crowd: DataFrame, groups: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of sets without spare, across components, that share hot signatures.

    Two such sets share one more than either has spare; so one of those is among the first of each set's, in any fixed
    order and without as many as it has spare. Only signatures count that sets of different components have. In a signature's crowd the largest component is dealt into chunks, and so are the others together; each chunk of the one meets each chunk of the
    others in a block of its own, and these meet each other. So the many that are one component already are not repeated.
    Only pairs are made whose sizes and bucket counts allow the similarity: counts differ by no more than the sets do.
    """
    rows = scratch.keep(grouped(crowd, "sid", groups).join(sketches(sets), ["sid", "band"]), "crowd-sketches")
    hashed = F.array_sort(F.transform("sigs", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("sig"))))
    first = F.explode(F.slice(hashed, F.lit(1), F.col("hot") - F.col("spare")).getField("sig")).alias("sig")
    parts = rows.select(first, "group_sid").groupBy("sig", "group_sid").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("sig").agg(F.max(F.struct("c", "group_sid")).alias("main"), F.sum("c").alias("c")).filter("c > main.c")
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    sizes = sizes.select("sig", F.col("main.group_sid").alias("main"), chunks(F.col("main.c")).alias("k_main"), chunks(F.col("c") - F.col("main.c")).alias("k_rest"))
    dealt = rows.select(first, "sid", "group_sid", "n", "sketch").join(sizes, "sig").withColumn("rest", F.col("group_sid") != F.col("main"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.when(F.col("rest"), F.col("k_rest")).otherwise(F.col("k_main"))).cast("int"))
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    block = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    chunk = F.col("chunk")
    of_main = F.transform(upto("k_rest"), lambda j: block(0, chunk, j))
    of_rest = F.concat(F.transform(upto("k_main"), lambda i: block(0, i, chunk)), F.transform(upto("k_rest"), lambda j: block(1, F.least(chunk, j), F.greatest(chunk, j))))
    dealt = dealt.withColumn("block", F.when(F.col("rest"), of_rest).otherwise(of_main))
    dealt = dealt.select("sig", F.explode("block").alias("block"), "rest", "chunk", "sid", "group_sid", "n", "sketch")
    dealt = dealt.select("sig", "block.kind", "block.lo", "block.hi", "rest", "chunk", "sid", "group_sid", "n", "sketch")
    blocks = dealt.repartition("sig", "kind", "lo", "hi").sortWithinPartitions("sig", "kind", "lo", "hi")
    schema = "a bigint, b bigint"
    arrow = schema_of(crowd.sparkSession, schema)

    def meet(rows: list[tuple]) -> list[tuple]:
        kind, lo, hi = rows[0][1:4]
        rest, chunk, sid, group, n = (np.array([r[i] for r in rows]) for i in range(4, 9))
        width = np.array([len(r[9]) for r in rows])
        counts = {w: np.stack([np.frombuffer(r[9], np.uint8) if len(r[9]) == w else np.zeros(w, np.uint8) for r in rows]).astype(np.int16) for w in set(width.tolist())}
        out = []
        for i in np.flatnonzero(rest).tolist():
            j = np.flatnonzero(~rest) if kind == 0 else np.arange(i + 1, len(rows))
            ok = (group[j] != group[i]) & (OF * np.minimum(n[j], n[i]) >= AT_LEAST * np.maximum(n[j], n[i]))
            if kind == 1 and lo != hi:
                ok &= chunk[j] != chunk[i]
            j = j[ok]
            told = width[j] == width[i]
            apart = np.abs(counts[width[i]][j] - counts[width[i]][i]).sum(axis=1)
            j = j[~told | (apart * (OF + AT_LEAST) <= (OF - AT_LEAST) * (n[j] + n[i]))]
            for k in j.tolist():
                out.append((int(min(sid[i], sid[k])), int(max(sid[i], sid[k]))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in _with_end(batches):
            for row in [None] if batch is None else zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row is None or row[:4] != held[0][:4]):
                    if found := meet(held):
                        yield to_batch(found, arrow)
                    held = []
                if row is not None:
                    held.append(row)

    return blocks.mapInArrow(run, schema).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_shingles, component_id (the least doc_id that links reach) and group of every row.

    Rows of one component have the same group; rows with an empty set have none.
    """
    ids = materialize(identify(docs), "set-ids")
    groups = similarity_groups(docs, ids)
    known = ids.filter("n_shingles > 0").join(groups, ids["sid"] == groups["id"], "left").select("doc_id", "row", "n_shingles", F.coalesce("component", "sid").alias("group"))
    least = known.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    linked = known.join(least, "group").select("doc_id", "row", "n_shingles", "component_id", "group")
    return linked.union(ids.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("bigint").alias("group")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one (the least doc_id) of each component; documents with an empty set all stay.

    Of rows that agree in doc_id and text one stays if the set is not empty; else rows must agree in all columns for that.
    """
    found = jaccard_components(docs)
    first = found.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("once"))
    stay = first.union(found.filter("group is null").select("row", F.lit(False).alias("once")).distinct())
    rows = docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)), F.xxhash64("doc_id", "text").alias("row")).join(stay.hint("shuffle_hash"), "row")
    again = F.when(F.col("once"), F.lit(0).cast("long")).otherwise(F.xxhash64(*(f"c{i}" for i in range(len(docs.columns)))))
    return rows.withColumn("again", again).dropDuplicates(["row", "again"]).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
