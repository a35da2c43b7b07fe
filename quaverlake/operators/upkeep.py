"""Upkeep of corpora and runs: label repair, names and links of files, unions of ids, model figures, and the metrics of the best of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.operators import scoring
from quaverlake.operators.ranking import NAMES, pick_sql, works
from quaverlake.plans.views import LOGITS_SQL, logits, notes, table

# The form tokens that a repair changes and how far it looks, the ids it is for, endings of derived files, links to files.
FORM_CHORALE, FORM_FUGUE, REACH = 21, 26, 10
FUGUE_IDS = "wtc1f|wtc2f"
DERIVED = r"(?i)(?:-auto|-combined|-beat|-sampled|-pan|-nopan|extractf|-20|-60|-80|-S)\.krn$"
LINK = r"location=([^&]+)&file=([^&]+\.krn)"
# End of fixed values.


def repaired(tokens: Column, piece: Column) -> Column:
    """Tokens with the first chorale label among the first REACH made a fugue's, where the id says that the piece is one."""
    at = F.array_position(F.slice(tokens, 1, REACH), FORM_CHORALE)
    return F.when(F.lower(piece).rlike(FUGUE_IDS) & (at > 0), F.transform(tokens, lambda t, i: F.when(i + 1 == at, FORM_FUGUE).otherwise(t))).otherwise(tokens)


def label_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequences of the fixture (lengths of words as tokens, under names of works) are repaired, and where."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.slice(F.split("text", " "), 1, 64), lambda w: (F.length(w) % 3 + 20).cast("int")).alias("tokens")).join(works(spark, sf_dir).select("doc_id", "source_name"), "doc_id")
    t = t.withColumn("new", repaired(F.col("tokens"), F.col("source_name")))
    return t.select("doc_id", (F.col("new") != F.col("tokens")).alias("fixed"), F.nullif(F.array_position("new", FORM_FUGUE), F.lit(0)).alias("place"), F.array_join(F.transform(F.slice("new", 1, 12), lambda x: x.cast("string")), ",").alias("head"))


def derived_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of works, and whether they are those of derived files."""
    name = F.concat(F.replace(F.col("source_name"), F.lit("/"), F.lit("_")), F.element_at(F.array(F.lit(".krn"), F.lit("-60.KRN"), F.lit("-auto.krn"), F.lit("-auto.mid")), (F.col("doc_id") % 4 + 1).cast("int")))
    return works(spark, sf_dir).select("doc_id", name.alias("name"), name.rlike(DERIVED).alias("derived"))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location and file of each link to a score in pages, by count of pages; the fixture's pages get two links each."""
    link = lambda a, b: F.concat(F.lit('<a href="?location=users/'), (F.col("page_id") % a).cast("string"), F.lit("&file="), (F.col("page_id") % b).cast("string"), F.lit('.krn&format=x">'))
    html = F.concat("html", link(7, 11), link(5, 13))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("location"), F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("file"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(pairs).alias("p")).groupBy("p.location", "p.file").agg(F.countDistinct("page_id").alias("pages"))


def id_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ids of parts and suppliers of each order's lines, in order."""
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("l_partkey", "l_suppkey")))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


def parameters(vocabulary: Column, width: Column, heads: Column, kv_heads: Column, layers: Column, tied: Column) -> Column:
    """Learned numbers of a decoder: embeddings, attention with shared keys, a gated layer of 8/3 of the width in steps of 64, two norms a layer, and a head unless tied."""
    kv = kv_heads * F.floor(width / heads)
    hidden = F.floor((F.floor(width * 8 / 3) + 63) / 64) * 64
    layer = 2 * width * width + 2 * width * kv + 3 * width * hidden + 2 * width
    return (vocabulary * width + layers * layer + F.when(tied, 0).otherwise(width * vocabulary)).cast("bigint")


def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a configuration for each part: widths of 64 to 512, 8 heads with 8, 4, 2 or 1 for keys, 1 to 12 layers."""
    k, s = F.col("p_partkey"), F.col("p_size")
    kv = F.element_at(F.array(*map(F.lit, (8, 4, 2, 1))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", parameters(F.lit(125) + k % 300, (s % 8 + 1) * 64, F.lit(8), kv, s % 12 + 1, k % 2 == 0).alias("params"))


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity (of a mean loss of 20 at most) and mean entropy in bits of the contexts of each sequence (ids by tens), for a target token of each context."""
    g = logits(spark, sf_dir)
    norm = g.groupBy("ctx_id").agg((F.max("logit")).alias("top"), F.log(F.sum(F.exp("logit"))).alias("z"))
    p = F.exp(F.col("logit") - F.col("z"))
    per = g.join(norm, "ctx_id").groupBy("ctx_id").agg(F.sum(F.when(F.col("token_id") == F.col("ctx_id") * 7 % 64, F.col("z") - F.col("logit"))).alias("loss"), F.sum(-p * F.log2(p + 1e-10)).alias("entropy"))
    return per.groupBy(F.floor(F.col("ctx_id") / 10).alias("seq_id")).agg(F.round(F.exp(F.least(F.avg("loss"), F.lit(20.0))), 4).alias("perplexity"), F.round(F.avg("entropy"), 6).alias("entropy"))


def top_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the piece with the best composite of each group (ids with the same last digit)."""
    n = notes(spark, sf_dir)
    size = n.groupBy("piece_id", "voice").agg(F.count(F.lit(1)).alias("c")).groupBy("piece_id").agg(F.min("c").alias("voice_min_notes"), F.max("c").alias("voice_max_notes"))
    p = scoring.composed(n).join(size, "piece_id").withColumn("prompt", F.col("piece_id") % 10)
    best = p.withColumn("rank", F.row_number().over(W.partitionBy("prompt").orderBy(F.desc("composite"), "piece_id"))).filter("rank = 1")
    return best.select("prompt", "piece_id", "composite", "voice_leading", "statistical", "structural", F.col("stagger").alias("cp_onset_staggering"), F.col("independence").alias("cp_voice_independence"), F.col("balance").alias("voice_balance_ratio"), "completeness", F.col("recall").alias("thematic_recall"), F.col("multiplier").alias("guardrail_multiplier"), F.col("flags").alias("guardrail_flags"), "voice_min_notes", "voice_max_notes")


QUERIES = {f.__name__: f for f in (label_repair, derived_names, linked_files, id_unions, parameter_counts, model_metrics, top_metrics)}
SQL = {
    "label_repair": f"""WITH t AS (SELECT doc_id, {pick_sql(NAMES, 'doc_id')} AS s, list_transform(string_split(text, ' ')[1:64], lambda w: length(w) % 3 + 20) AS t FROM documents), r AS (SELECT *, CASE WHEN regexp_matches(lower(s), '{FUGUE_IDS}') THEN coalesce(list_position(t[1:{REACH}], {FORM_CHORALE}), 0) ELSE 0 END AS at_ FROM t)
SELECT doc_id, at_ > 0 AS fixed, CAST(nullif(at_, 0) AS BIGINT) AS place, array_to_string(list_transform(t[1:12], lambda x, i: CASE WHEN i = at_ THEN {FORM_FUGUE} ELSE x END), ',') AS head FROM r""",
    "derived_names": f"WITH n AS (SELECT doc_id, replace({pick_sql(NAMES, 'doc_id')}, '/', '_') || (['.krn', '-60.KRN', '-auto.krn', '-auto.mid'])[CAST(doc_id % 4 AS INT) + 1] AS name FROM documents) SELECT doc_id, name, regexp_matches(name, '{DERIVED}') AS derived FROM n",
    "linked_files": f"""WITH h AS (SELECT page_id, html || '<a href="?location=users/' || (page_id % 7) || '&file=' || (page_id % 11) || '.krn&format=x">' || '<a href="?location=users/' || (page_id % 5) || '&file=' || (page_id % 13) || '.krn&format=x">' AS h FROM pages),
m AS (SELECT page_id, unnest(regexp_extract_all(h, '{LINK}')) AS m FROM h) SELECT regexp_extract(m, '{LINK}', 1) AS location, regexp_extract(m, '{LINK}', 2) AS file, count(DISTINCT page_id) AS pages FROM m GROUP BY 1, 2""",
    "id_unions": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(flatten(list([l_partkey, l_suppkey])))), ',') AS ids FROM lineitem GROUP BY 1",
    "parameter_counts": "WITH c AS (SELECT p_partkey, 125 + p_partkey % 300 AS v, (p_size % 8 + 1) * 64 AS w, ([8, 4, 2, 1])[CAST(p_partkey % 4 AS INT) + 1] AS kv, p_size % 12 + 1 AS l, p_partkey % 2 = 0 AS tied FROM part) SELECT p_partkey, CAST(v * w + l * (2 * w * w + 2 * w * kv * (w // 8) + 3 * w * ((w * 8 // 3 + 63) // 64 * 64) + 2 * w) + CASE WHEN tied THEN 0 ELSE w * v END AS BIGINT) AS params FROM c",
    "model_metrics": f"WITH {LOGITS_SQL}, z AS (SELECT ctx_id, ln(sum(exp(logit))) AS z FROM g GROUP BY 1), x AS (SELECT ctx_id, sum(CASE WHEN token_id = ctx_id * 7 % 64 THEN z - logit END) AS loss, sum(-exp(logit - z) * log2(exp(logit - z) + 1e-10)) AS entropy FROM g JOIN z USING (ctx_id) GROUP BY 1) SELECT ctx_id // 10 AS seq_id, round(exp(least(avg(loss), 20.0)), 4) AS perplexity, round(avg(entropy), 6) AS entropy FROM x GROUP BY 1",
    "top_metrics": f"""WITH RECURSIVE {scoring.COMPOSITE_SQL}, vz9 AS (SELECT piece_id, min(c) AS lo, max(c) AS hi FROM (SELECT piece_id, voice, count(*) AS c FROM n GROUP BY 1, 2) GROUP BY 1),
rk AS (SELECT co.*, lo, hi, piece_id % 10 AS prompt, row_number() OVER (PARTITION BY piece_id % 10 ORDER BY composite DESC, piece_id) AS r FROM co JOIN vz9 USING (piece_id))
SELECT prompt, rk.piece_id, composite, rk.voice_leading, statistical, structural, rk.stagger AS cp_onset_staggering, rk.independence AS cp_voice_independence, rk.balance AS voice_balance_ratio, rk.completeness, recall AS thematic_recall, rk.multiplier AS guardrail_multiplier, flags AS guardrail_flags, lo AS voice_min_notes, hi AS voice_max_notes FROM rk JOIN gr ON gr.piece_id = rk.piece_id WHERE r = 1""",
}
