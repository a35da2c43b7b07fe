"""Run tables and names: advantages, winners, running rewards, key and scale-degree functions, slugs and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import MAJOR, NATURAL_MINOR, floor_div, lits
from quaverlake.plans.folds import exact_percentile
from quaverlake.plans.views import NOTES_SQL, key_mode, key_root, notes, table


def degree_parts(p: Column, root: Column, mode: Column) -> Column:
    """struct<octave, degree, accidental> of a pitch: tonic-relative octave, natural minor, a sharp where the pitch is off the scale."""
    steps = F.when(mode == "major", lits(MAJOR)).otherwise(lits(NATURAL_MINOR))
    rel = F.pmod(p - root, F.lit(12)).cast("int")
    exact = F.array_position(steps, rel).cast("int")
    below = F.array_position(steps, F.pmod(rel - 1, F.lit(12)).cast("int")).cast("int")
    return F.struct((floor_div(p - root, 12) - 1).cast("int").alias("octave"), F.when(exact > 0, exact).otherwise(below).alias("degree"), F.when(exact > 0, "").otherwise("#").alias("accidental"))


def degree_pitch(octave: Column, degree: Column, accidental: Column, root: Column, mode: Column) -> Column:
    steps = F.when(mode == "major", lits(MAJOR)).otherwise(lits(NATURAL_MINOR))
    return (octave + 1) * 12 + root + F.element_at(steps, degree) + F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)


def parse_key(s: Column) -> Column:
    """struct<root, mode> of `C# minor`, `Bb`, `am`, `F# major`: a capital without a mode is major; null if it is none of these."""
    letter, accidental, mode = (F.regexp_extract(s, r"^\s*([A-Ga-g])([#b]?)\s*(major|minor|maj|min|M|m)?\s*$", i) for i in (1, 2, 3))
    step = F.element_at(F.create_map(*(x for k, v in zip("CDEFGAB", MAJOR, strict=True) for x in (F.lit(k), F.lit(v)))), F.upper(letter))
    root = F.pmod(step + F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0), F.lit(12)).cast("int")
    minor = mode.isin("minor", "min", "m") | ((mode == "") & (letter == F.lower(letter)))
    return F.when(letter != "", F.struct(root.alias("root"), F.when(minor, "minor").otherwise("major").alias("mode")))


def scale_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir).select("piece_id", "pitch").distinct().withColumn("d", degree_parts(F.col("pitch"), key_root(), key_mode()))
    back = degree_pitch(F.col("d.octave"), F.col("d.degree"), F.col("d.accidental"), key_root(), key_mode())
    return n.select("piece_id", "pitch", "d.octave", "d.degree", "d.accidental", back.cast("int").alias("back"))


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(price - mean) / (population deviation + 1e-8) of an order within its priority; the few means are joined back."""
    o = table(spark, sf_dir, "orders")
    per = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("dev"))
    joined = o.join(per, o["o_orderpriority"].eqNullSafe(per["o_orderpriority"]))
    return joined.select("o_orderkey", F.round((F.col("o_totalprice") - F.col("mean")) / (F.col("dev") + 1e-8), 6).alias("advantage"))


def winner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders at or above the 75th percentile of their priority's prices. The percentile is found by counts, joined back."""
    o = table(spark, sf_dir, "orders")
    cut = exact_percentile(o, "o_orderpriority", "o_totalprice", 0.75, 100.0)
    return o.join(cut, "o_orderpriority").filter("o_totalprice >= cut").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("winners"))


def running_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of a user's finished events so far, and whether the best of the last three beats the best before by 0.005."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("so_far", F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 6))
    recent, before = F.max("value").over(w.rowsBetween(-2, 0)), F.max("value").over(w.rowsBetween(W.unboundedPreceding, -3))
    return e.select("event_id", "so_far", (recent <= before + 0.005).alias("plateau"))


def iteration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by iteration (orders by month): how many, their mean, best and the mean of the best tenth (at or above the 90th percentile), and whether
    the best mean of the last three iterations is no better than the best before by a half per cent."""
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("iteration"), "o_totalprice")
    top = o.join(exact_percentile(o, "iteration", "o_totalprice", 0.9, 100.0), "iteration").filter("o_totalprice >= cut").groupBy("iteration").agg(F.round(F.avg("o_totalprice"), 4).alias("top_tenth"))
    m = o.groupBy("iteration").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("best")).join(top, "iteration")
    w = W.partitionBy(F.lit(1)).orderBy("iteration")  # a row an iteration
    return m.withColumn("plateau", F.max("mean").over(w.rowsBetween(-2, 0)) <= 1.005 * F.max("mean").over(w.rowsBetween(W.unboundedPreceding, -3)))


def slug(text: Column) -> Column:
    """ASCII letters and digits of what stands before a comma, in lower case; `composer` if nothing is left."""
    head = F.regexp_replace(F.lower(F.substring_index(text, ",", 1)), "[^a-z0-9]+", "")
    return F.when(head == "", "composer").otherwise(head)


def safe_name(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, safe names and form labels of pages' addresses."""
    p = table(spark, sf_dir, "pages")
    low = F.lower("url")
    form = F.when(low.contains("news"), "news").when(low.contains("blog"), "blog").otherwise("other")
    return p.select("page_id", slug(F.col("url")).alias("slug"), safe_name(F.col("url")).alias("name"), form.alias("label"))


def original_source(s: Column) -> Column:
    """A source without its last ` (voices ...)`."""
    return F.regexp_replace(s, r"^(.*) \(voices .*$", "$1")


def voice_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.concat("source", F.lit(" (voices "), F.pmod("doc_id", F.lit(4)).cast("string"), F.lit("-3)")).alias("s"))
    return d.groupBy(original_source(F.col("s")).alias("original")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("s").alias("groups"))


def prefix_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of conversations whose first 160 words (the rule's reach) hold each of some marks before the first full stop."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(F.split(F.lower("text"), " "), 1, 160).alias("w"))
    stop = F.coalesce(F.nullif(F.array_position(F.transform("w", lambda x: x.endswith(".")), True), F.lit(0)), F.lit(161))
    head = words.select("conv_id", "turn", F.slice("w", F.lit(1), stop.cast("int")).alias("h"))
    return head.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mark"), F.array_contains("h", m).alias("has")) for m in ("the", "of", "and", "la")))).alias("m")).groupBy("m.mark").agg(F.round(F.avg(F.when(F.col("m.has"), 1.0).otherwise(0.0)), 9).alias("share"))


QUERIES = {f.__name__: f for f in (scale_degrees, group_advantage, winner_filter, running_reward, iteration_metrics, page_names, voice_suffixes, prefix_health)}

STEPS_SQL = "CASE WHEN key_mode = 'major' THEN [0,2,4,5,7,9,11] ELSE [0,2,3,5,7,8,10] END"
SQL = {
    "scale_degrees": f"""WITH {NOTES_SQL}, d AS (SELECT DISTINCT n.piece_id, pitch, key_root, key_mode FROM n JOIN pc USING (piece_id)), e AS (SELECT *, list_position({STEPS_SQL}, (pitch - key_root + 12) % 12) AS x, list_position({STEPS_SQL}, (pitch - key_root + 11) % 12) AS y FROM d)
SELECT piece_id, pitch, CAST(floor((pitch - key_root) / 12.0) - 1 AS INT) AS octave, CAST(CASE WHEN x > 0 THEN x ELSE y END AS INT) AS degree, CASE WHEN x > 0 THEN '' ELSE '#' END AS accidental, CAST(pitch AS INT) AS back FROM e""",
    "group_advantage": "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_pop(o_totalprice) OVER w + 1e-8), 6) AS advantage FROM orders WINDOW w AS (PARTITION BY o_orderpriority)",
    "winner_filter": "SELECT o_orderpriority, count(*) AS winners FROM orders JOIN (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.75) AS cut FROM orders GROUP BY 1) USING (o_orderpriority) WHERE o_totalprice >= cut GROUP BY 1",
    "running_reward": "SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS so_far, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) + 0.005 AS plateau FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "iteration_metrics": "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS iteration, o_totalprice, quantile_cont(o_totalprice, 0.9) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS cut FROM orders), m AS (SELECT iteration, count(*) AS runs, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS best, round(avg(o_totalprice) FILTER (o_totalprice >= cut), 4) AS top_tenth FROM o GROUP BY 1) SELECT *, max(mean) OVER (ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= 1.005 * max(mean) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS plateau FROM m",
    "page_names": "SELECT page_id, CASE WHEN regexp_replace(lower(split_part(url, ',', 1)), '[^a-z0-9]+', '', 'g') = '' THEN 'composer' ELSE regexp_replace(lower(split_part(url, ',', 1)), '[^a-z0-9]+', '', 'g') END AS slug, replace(replace(url, '/', '__'), ' ', '_') AS name, CASE WHEN contains(lower(url), 'news') THEN 'news' WHEN contains(lower(url), 'blog') THEN 'blog' ELSE 'other' END AS label FROM pages",
    "voice_suffixes": "SELECT source AS original, count(*) AS rows, count(DISTINCT doc_id % 4) AS groups FROM documents GROUP BY 1",
    "prefix_health": """WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ')[1:160] AS w FROM conversations), s AS (SELECT *, coalesce(nullif(list_position(list_transform(w, lambda x: ends_with(x, '.')), TRUE), 0), 161) AS st FROM w), m AS (SELECT unnest(['the', 'of', 'and', 'la']) AS mark)
SELECT mark, round(avg(CASE WHEN list_contains(w[1:st], mark) THEN 1.0 ELSE 0.0 END), 9) AS share FROM s, m GROUP BY 1""",
}
