"""Corpus preparation: filters, keyed dedup, note transforms, MIDI events, ranking of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.plans.views import NOTES_SQL, key_root, notes, table

#: Styles by source, as a small dimension table of this fixture.
STYLES = [("src0", "bach"), ("src1", "baroque"), ("src2", "baroque"), ("src3", "renaissance"), ("src4", "classical"), ("src5", "baroque")]


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, "source string, style string")


def keep_first(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key by the order, which must name a tie breaker. Partial aggregation, so hot keys spread."""
    row = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.struct(*df.columns).alias("row"))
    return df.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min(row).alias("m")).select("m.row.*")


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and text (in lower case, two hashes of it), the first by doc_id."""
    text = F.lower("text")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(text).alias("h"), F.xxhash64(text).alias("g"))
    return keep_first(d, [F.col("source"), F.col("h"), F.col("g")], [F.col("doc_id")]).select("doc_id", "source")


def composer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naming one source admits all sources of its style: expand the accepted set, then a semi-join."""
    dim = styles(spark)
    wanted = dim.filter("source = 'src1'").select("style")
    accepted = dim.join(wanted, "style", "left_semi").select("source").distinct()
    return table(spark, sf_dir, "documents").join(F.broadcast(accepted), "source", "left_semi").select("doc_id", "source")  # the dimension is a constant


def anti_known_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose id is not that of a known document of src0."""
    known = table(spark, sf_dir, "documents").filter("source = 'src0'").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").join(known, "page_id", "left_anti").select("page_id", "url")


def error_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason why a page is no score: too short, markup in its first 4096 characters, or none."""
    head = F.lower(F.substring("html", 1, 4096))
    reason = F.when(F.length("html") < 32, "short").when((F.instr(head, "<html") > 0) | (F.instr(head, "access unsuccessful") > 0), "html").otherwise("none")
    return table(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("pages"))


def path_style_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style by the first known directory of a path (here: of source/lang/doc_id), else `other`."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws("/", F.lit("data"), "source", "lang"), "/").alias("parts"))
    at = d.select("doc_id", F.posexplode("parts").alias("pos", "source")).join(F.broadcast(styles(spark)), "source", "left")
    return at.groupBy("doc_id").agg(F.coalesce(F.min_by("style", F.when(F.col("style").isNotNull(), F.col("pos"))), F.lit("other")).alias("style"))


def extract_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag and attribute pairs of pages' links, by count."""
    hits = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-z]+)[ >]"), F.lit(1))).alias("tag"))
    return hits.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose props are an object with an integer k, by type."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count_if(F.col("p.k").isNotNull()).alias("valid"), F.sum("p.k").alias("total"))


def transpose_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces moved up by 0 to 11 semitones, with their new root; those that leave 36 to 84 go."""
    n = notes(spark, sf_dir).groupBy("piece_id").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"), F.count(F.lit(1)).alias("n_notes"))
    moved = n.select("piece_id", "lo", "hi", "n_notes", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("semitones"))
    return moved.filter("lo + semitones >= 36 and hi + semitones <= 84").select("piece_id", "semitones", F.pmod(key_root() + F.col("semitones"), F.lit(12)).cast("int").alias("root"), "n_notes")


def cropped(n: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Notes that overlap [begin, end), cut to it and counted from it."""
    inside = n.filter((F.col("start") < end) & (F.col("start") + F.col("dur") > begin))
    s, e = F.greatest(F.col("start"), begin), F.least(F.col("start") + F.col("dur"), end)
    return inside.select("piece_id", "voice", "note_idx", (s - begin).cast("long").alias("start"), (e - s).cast("long").alias("dur"), "pitch")


def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cropped(notes(spark, sf_dir), F.lit(1920).cast("long"), F.lit(5760).cast("long"))


def random_crop_seeded(spark: SparkSession, sf_dir: str, seed: int = 11) -> DataFrame:
    """A window of 16 to 64 quarters of each piece, placed by a seeded hash; pieces in which a voice falls silent go."""
    n = notes(spark, sf_dir)
    span = n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).alias("m"), F.countDistinct("voice").alias("v"))
    size = (16 + F.pmod(F.xxhash64(F.lit(seed), "piece_id"), F.lit(49))) * 480
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "piece_id"), F.greatest(F.floor((F.col("m") - size) / 480), F.lit(1))) * 480
    win = span.select("piece_id", "v", at.alias("begin"), (at + size).alias("end"))
    cut = cropped(n.join(win, "piece_id").withColumnRenamed("begin", "b").withColumnRenamed("end", "e"), F.col("b"), F.col("e"))
    full = cut.groupBy("piece_id").agg(F.countDistinct("voice").alias("w")).join(win, "piece_id").filter("w = v").select("piece_id")
    return cut.join(full, "piece_id", "left_semi")


def overlap_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of notes that start together the highest stays, and each note ends where the next begins."""
    n = notes(spark, sf_dir, shifted=True)
    w = W.partitionBy("piece_id", "voice", "start").orderBy(F.desc("pitch"), "event_id")
    top = n.withColumn("r", F.row_number().over(w)).filter("r = 1")
    nxt = F.lead("start").over(W.partitionBy("piece_id", "voice").orderBy("start"))
    return top.select("piece_id", "voice", "start", F.least("dur", F.coalesce(nxt - F.col("start"), F.col("dur"))).cast("long").alias("dur"), "pitch")


def messages(n: DataFrame) -> DataFrame:
    """On and off messages of notes, off before on at the same tick."""
    both = F.array(F.struct(F.col("start").cast("long").alias("tick"), F.lit(1).alias("on")), F.struct((F.col("start") + F.col("dur")).cast("long").alias("tick"), F.lit(0).alias("on")))
    return n.select("piece_id", "voice", "pitch", F.explode(both).alias("m")).select("piece_id", "voice", "pitch", "m.tick", "m.on")


def note_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from messages: an off ends the latest on of its pitch; a second on takes the place of the first; empty notes go."""
    w = W.partitionBy("piece_id", "voice", "pitch").orderBy("tick", "on")
    m = messages(notes(spark, sf_dir, shifted=True)).withColumn("was_on", F.lag("on").over(w)).withColumn("since", F.lag("tick").over(w))
    return m.filter("on = 0 and was_on = 1 and tick > since").select("piece_id", "voice", F.col("since").alias("start"), (F.col("tick") - F.col("since")).alias("dur"), "pitch")


def midi_delta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each voice in order, with the ticks since the one before."""
    w = W.partitionBy("piece_id", "voice").orderBy("tick", "on", "pitch")
    m = messages(notes(spark, sf_dir))
    return m.select("piece_id", "voice", "tick", "on", "pitch", (F.col("tick") - F.coalesce(F.lag("tick").over(w), F.lit(0))).alias("delta"))


def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs by segment and priority: runs, share that succeeded, mean and population deviation of those."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ok = F.col("o_orderstatus") != "P"
    price = F.when(ok, F.col("o_totalprice"))
    return o.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 9).alias("success"), F.round(F.coalesce(F.avg(price), F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.stddev_pop(price), F.lit(0.0)), 4).alias("std"))


def pool_merge_topk(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Two pools (urgent and other orders), each ranked by price; the best k of both."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderpriority").startswith("1"), "a").otherwise("b").alias("pool"))
    best = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(k)
    return best.select("o_orderkey", "pool", "o_totalprice")


def topn_per_group(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


def max_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the largest quantity, counted by flag."""
    li = table(spark, sf_dir, "lineitem")
    top = li.agg(F.max("l_quantity").alias("q"))
    return li.join(F.broadcast(top), F.abs(F.col("l_quantity") - F.col("q")) < 1e-12).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("ties"))  # one row


def outliers(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The n largest lines by each of three measures."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *(F.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
    long = li.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_extendedprice", "l_tax"], "measure", "value")
    w = W.partitionBy("measure").orderBy(F.desc("value"), "l_orderkey", "l_linenumber", "l_partkey")
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("measure", "rank", "value")


QUERIES = {
    f.__name__: f
    for f in (dedup_keep_first, composer_filter, anti_known_paths, error_page_filter, path_style_lookup, extract_pairs, json_shape, transpose_all_keys, crop_window, random_crop_seeded, overlap_truncate, note_pairing, midi_delta_events)
    + (sweep_summary, pool_merge_topk, topn_per_group, max_ties, outliers)
}

STYLE_SQL = "sty AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in STYLES) + ") v(source, style))"
MESSAGES_SQL = "ms AS (SELECT piece_id, voice, pitch, CAST(start AS BIGINT) AS tick, 1 AS \"on\" FROM {n} UNION ALL SELECT piece_id, voice, pitch, CAST(start + dur AS BIGINT), 0 FROM {n})"
SQL = {
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, lower(text)",
    "composer_filter": f"WITH {STYLE_SQL} SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM sty WHERE style IN (SELECT style FROM sty WHERE source = 'src1'))",
    "anti_known_paths": "SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')",
    "error_page_filter": "SELECT CASE WHEN length(html) < 32 THEN 'short' WHEN instr(lower(substring(html, 1, 4096)), '<html') > 0 OR instr(lower(substring(html, 1, 4096)), 'access unsuccessful') > 0 THEN 'html' ELSE 'none' END AS reason, count(*) AS pages FROM pages GROUP BY 1",
    "path_style_lookup": f"WITH {STYLE_SQL} SELECT doc_id, coalesce(style, 'other') AS style FROM documents LEFT JOIN sty USING (source)",
    "extract_pairs": "SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z]+)[ >]', 1)) AS tag FROM pages) GROUP BY 1",
    "json_shape": """SELECT event_type, count(k) AS valid, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1""",
    "transpose_all_keys": f"WITH {NOTES_SQL}, p AS (SELECT piece_id, min(pitch) AS lo, max(pitch) AS hi, count(*) AS n_notes FROM n GROUP BY 1), m AS (SELECT *, unnest(range(12)) AS s FROM p) SELECT piece_id, CAST(s AS INT) AS semitones, CAST((piece_id + s) % 12 AS INT) AS root, n_notes FROM m WHERE lo + s >= 36 AND hi + s <= 84",
    "crop_window": f"WITH {NOTES_SQL} SELECT piece_id, voice, note_idx, greatest(start, 1920) - 1920 AS start, least(start + dur, 5760) - greatest(start, 1920) AS dur, pitch FROM n WHERE start < 5760 AND start + dur > 1920",
    "overlap_truncate": f"WITH {NOTES_SQL}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, voice, start ORDER BY pitch DESC, event_id) AS r FROM n2) WHERE r = 1) SELECT piece_id, voice, start, least(dur, coalesce(lead(start) OVER (PARTITION BY piece_id, voice ORDER BY start) - start, dur)) AS dur, pitch FROM t",
    "note_pairing": f"WITH {NOTES_SQL}, {MESSAGES_SQL.format(n='n2')}, q AS (SELECT *, lag(\"on\") OVER w AS was, lag(tick) OVER w AS since FROM ms WINDOW w AS (PARTITION BY piece_id, voice, pitch ORDER BY tick, \"on\")) SELECT piece_id, voice, since AS start, tick - since AS dur, pitch FROM q WHERE \"on\" = 0 AND was = 1 AND tick > since",
    "midi_delta_events": f"WITH {NOTES_SQL}, {MESSAGES_SQL.format(n='n')} SELECT piece_id, voice, tick, \"on\", pitch, tick - coalesce(lag(tick) OVER (PARTITION BY piece_id, voice ORDER BY tick, \"on\", pitch), 0) AS delta FROM ms",
    "sweep_summary": "SELECT c_mktsegment, o_orderpriority, count(*) AS runs, round(avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END), 9) AS success, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus <> 'P'), 0), 4) AS mean, round(coalesce(stddev_pop(o_totalprice) FILTER (o_orderstatus <> 'P'), 0), 4) AS std FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "pool_merge_topk": "SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1') THEN 'a' ELSE 'b' END AS pool, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "topn_per_group": "SELECT o_orderpriority, CAST(rank AS INT) AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5",
    "max_ties": "SELECT l_returnflag, count(*) AS ties FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem) GROUP BY 1",
    "outliers": "SELECT measure, CAST(rank AS INT) AS rank, value FROM (SELECT measure, value, row_number() OVER (PARTITION BY measure ORDER BY value DESC) AS rank FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_tax INTO NAME measure VALUE value)) WHERE rank <= 10",
}
