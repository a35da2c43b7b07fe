"""Scores and adjustments by form, forms and keywords of sources, loader unions, exact and active starts, constraint masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import catalogue_form, in_range_score, lits, parse_note
from quaverlake.operators import histograms as H
from quaverlake.operators import scoring as S
from quaverlake.operators import sequences as Q
from quaverlake.operators.joins import stab
from quaverlake.operators.runs import parse_key
from quaverlake.plans.views import LOGITS_SQL, NOTES_SQL, TOKENS_SQL, logits, notes, table

# Thresholds and steps of the form profiles, keywords, directories and names that results must agree with.
KEYWORDS = [("chorale", "chorale"), ("invention", "invention"), ("sinfonia", "sinfonia"), ("trio sonata", "trio_sonata"), ("sonata", "sonata"), ("fugue", "fugue"), ("quartet", "quartet"), ("motet", "motet"), ("wtc1f", "fugue"), ("wtc2f", "fugue"), ("inven", "invention")]
KEYBOARD = ["sonata", "partita", "suite", "toccata", "fantasia", "prelude", "fughetta", "invention", "sinfonia", "keyboard", "klavier", "piano", "harpsichord", "clavier"]
VOICES = {"2-part": 2, "invention": 2, "sinfonia": 3, "trio_sonata": 3, "chorale": 4, "quartet": 4, "sonata": 4, "fugue": 4, "motet": 4}
STEM_PARTS = ["-auto", "-combined", "-beat", "-sampled", "-pan", "-nopan", "extractf", "-20", "-60", "-80", "-S"]
KEY_NAMES = ["C_major", "C_minor", "Db_major", "Cs_minor", "D_major", "D_minor", "Eb_major", "Eb_minor", "E_major", "E_minor", "F_major", "F_minor", "Fs_major", "Fs_minor", "G_major", "G_minor", "Ab_major", "Gs_minor", "A_major", "A_minor", "Bb_major", "Bb_minor", "B_major", "B_minor"]
QUARTETS_BY = [
    "haydn", "mozart", "beethoven", "mayer", "saintgeorges", "hensel", "arriaga", "kalliwoda", "maier", "brahms", "schubert", "schumann", "cherubini",
    "hoffmeister", "boccherini", "andree", "bartok", "beach", "borodin", "bridge", "busoni", "carreno", "debussy", "delius", "dvorak", "elgar",
    "faure", "glazunov", "glinka", "gounod", "gouvy", "grieg", "indy", "janacek", "krzyzanowska", "moeran", "mullerhermann", "nielsen", "ravel",
    "reger", "schulhoff", "smetana", "smyth", "stanford", "strauss", "wolf",
]
MOTETS_BY = [
    "josquin", "ockeghem", "victoria", "lassus", "byrd", "dufay", "dunstable", "isaac", "banchieri", "flecha", "giovannelli", "landini", "vecchi",
    "obrecht", "desprez", "busnois", "delarue", "martini", "agricola", "compere", "mouton", "brumel", "regis", "tinctoris", "palestrina", "trecento",
    "ciconia", "luca", "lusitano", "monteverdi",
]
DURATION_CODES = {"w": 1920, "h": 960, "q": 480, "e": 240, "s": 120, "dq": 720, "dh": 1440, "de": 360}
# End of fixed values.

#: Forms by directory, and names that the sources of the fixture are made of.
DIRECTORIES = dict.fromkeys(QUARTETS_BY, "quartet") | dict.fromkeys(MOTETS_BY, "motet")
NAMES = ["BWV 847 in c", "BWV 1080/1", "bwv 868", "kern/Dvorak/op96", "x/tinctoris/missa", "BWV 846 prelude", "bwv772", "BWV 9999 air", "Riemenschneider Chorale", "Two-part Invention", "Trio Sonata in C", "Piano Sonata", "kern/Haydn/op20", "kern/josquin/missa-combined", "wtc1f01", "Quartet op 18", "misc/toccata-S", "unknown work"]
ALIASES = {"2-part": "invention", "3-part": "sinfonia", "4-part": "chorale"}
CALIBRATED = {"fugue": 0.24, "invention": 0.18}
TEXTS = ["C4:q D4:e Eb4:e F4:q", "G4 A4:h x9 B4:zz", "F#3:dq G3:s", "C5:w", ":q", "Bb2:de C3:dh D3"]


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_name, n_parts and style: sources as a loader sees them, one for each document."""
    d = table(spark, sf_dir, "documents")
    pick = lambda values, by: F.element_at(lits(values), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))
    return d.select("doc_id", pick(NAMES, F.col("doc_id")).alias("source_name"), (F.col("doc_id") % 5 + 1).cast("int").alias("n_parts"), pick(["baroque", "renaissance", "classical"], F.floor(F.col("doc_id") / 13)).alias("style"))


def form_of(name: Column, parts: Column, style: Column) -> Column:
    """Form by catalogue number, then by keyword in order, then by directory, then by the number of parts and style."""
    low = F.lower(name)
    keyword = F.coalesce(*(F.when(low.contains(k), f) for k, f in KEYWORDS))
    folders = F.split(F.replace(low, F.lit("\\"), F.lit("/")), "/")
    known = F.create_map(*(F.lit(x) for kv in DIRECTORIES.items() for x in kv))
    folder = F.try_element_at(F.filter(F.transform(folders, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()), F.lit(1))
    number = F.nullif(F.regexp_extract(low, r"bwv\s*(\d+)", 1), F.lit("")).try_cast("int")
    by_parts = F.when(parts <= 2, "invention").when(parts == 3, "sinfonia").when(style == "renaissance", "motet").when(style == "classical", "quartet").otherwise("chorale")
    return F.coalesce(catalogue_form(number), keyword, folder, by_parts)


def detect_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and voices of each source, whether it is keyboard repertoire, and whether a name part rejects it."""
    w = works(spark, sf_dir).withColumn("form", form_of(F.col("source_name"), F.col("n_parts"), F.col("style")))
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in VOICES.items() for x in kv)), F.col("form"))
    any_of = lambda c, words: F.coalesce(*(F.when(c.contains(k), True) for k in words), F.lit(False))
    return w.select("doc_id", "form", sure.cast("int").alias("voices"), any_of(F.lower("source_name"), KEYBOARD).alias("keyboard"), any_of(F.col("source_name"), STEM_PARTS).alias("rejected"))


def accompaniment_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose accompaniment severity is 1 or more, and whether the counterpoint-safe policy drops them: only if keyboard sources (here, even ids) too."""
    s = H.accompaniment_severity(spark, sf_dir)
    like = F.col("severity") >= 1.0
    return s.select("piece_id", like.alias("like"), (like & (F.col("piece_id") % 2 == 0)).alias("dropped"))


def information_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.35 perplexity in 5 to 25, 0.30 entropy in 2 to 5, 0.35 diversity, for each conversation."""
    t = Q.tokens_by_piece(spark, sf_dir)
    p = Q.perplexity(t).join(Q.entropy(t), "piece_id").join(Q.diversity(t).select("piece_id", "diversity"), "piece_id")
    score = 0.35 * in_range_score(F.col("perplexity"), 5.0, 25.0) + 0.30 * in_range_score(F.col("entropy"), 2.0, 5.0) + 0.35 * F.col("diversity")
    return p.select("piece_id", F.round(score, 5).alias("information"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with measures between 0 and 1, one for each order."""
    share = lambda k, m: (F.col("o_orderkey") * k % m / (m - 1))
    form = F.element_at(lits(["fugue", "sinfonia", "invention", "2-part", "motet"]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    cols = {"voice_leading": (7, 101), "cadence": (11, 103), "phrase": (13, 107), "key_consistency": (17, 109), "stagger": (19, 113), "contrary": (23, 127), "melodic": (29, 131), "independence": (31, 137)}
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", form.alias("form"), *(share(*v).alias(k) for k, v in cols.items()))


def interaction_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction of each run's form, bounded, and how many of its tests apply."""
    m = measures(spark, sf_dir)
    delta, count = F.lit(0.0), F.lit(0)
    for form in S.PROFILES:
        mine = F.col("form").isin(*(["invention", "2-part"] if form == "invention" else [form]))
        total, applied = S.interaction(form)
        delta, count = F.when(mine, total).otherwise(delta), F.when(mine, applied).otherwise(count)
    return m.select("o_orderkey", F.round(delta, 6).alias("delta"), count.alias("applied"))


def form_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall weight that runs of each requested form get: calibrated for the form, else for its alias, else the default."""
    form = F.element_at(lits(["fugue", "2-part", "3-part", "4-part", "motet"]), (F.col("doc_id") % 5 + 1).cast("int"))
    of = lambda values, k: F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), k)
    d = table(spark, sf_dir, "documents").select(form.alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("runs"))
    return d.select("form", "runs", F.coalesce(of(CALIBRATED, F.col("form")), of(CALIBRATED, of(ALIASES, F.col("form"))), F.lit(0.24)).alias("weight"))


def form_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p33 and p67 of each form's stagger, from counts of the few values there are."""
    hist = measures(spark, sf_dir).groupBy("form", F.round("stagger", 6).alias("stagger")).agg(F.count(F.lit(1)).alias("c"))
    return hist.groupBy("form").agg(*(F.round(F.percentile("stagger", F.lit(q / 100), F.col("c")), 6).alias(f"p{q}") for q in (33, 67)))


def loader_union(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """Three sources in order of priority as one table, filtered, the first of each name kept, at most `most` of each source."""
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("prio"), F.col("doc_id").alias("id"), F.concat_ws(":", "lang", F.md5("text")).alias("name"))
    b = table(spark, sf_dir, "benchmark").select(F.lit(1).alias("prio"), F.col("item_id").cast("bigint").alias("id"), F.concat(F.lit("en:"), F.md5("text")).alias("name"))
    p = table(spark, sf_dir, "pages").select(F.lit(2).alias("prio"), F.col("page_id").cast("bigint").alias("id"), F.concat(F.lit("en:"), F.md5("html")).alias("name"))
    kept = d.unionByName(b).unionByName(p).filter(F.col("name").startswith("en:")).groupBy("name").agg(F.min(F.struct("prio", "id")).alias("m")).select("m.prio", "m.id", "name")
    return kept.withColumn("k", F.row_number().over(W.partitionBy("prio").orderBy("id", "name"))).filter(F.col("k") <= most).select("prio", "id", F.col("k").cast("int").alias("k"))


def bar_ticks(n: DataFrame) -> DataFrame:
    ends = n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).cast("long").alias("m"))
    return ends.select("piece_id", F.explode(F.expr("sequence(0L, m, 1920L)")).alias("tick"))


def exact_or_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each bar line and voice the first note that starts there, else the first that sounds there, else none."""
    n = notes(spark, sf_dir, shifted=True)
    bars = bar_ticks(n)
    first = F.min_by("pitch", F.struct("start", "note_idx"))
    exact = bars.join(n.withColumnRenamed("start", "tick").select("piece_id", "tick", "voice", "pitch", "note_idx"), ["piece_id", "tick"]).groupBy("piece_id", "tick", "voice").agg(F.min_by("pitch", "note_idx").alias("exact"))
    active = stab(bars, n.select("piece_id", "voice", "start", "dur", "pitch", "note_idx"), ["piece_id"]).groupBy("piece_id", "tick", "voice").agg(first.alias("active"))
    return active.join(exact, ["piece_id", "tick", "voice"], "full").select("piece_id", "tick", "voice", "exact", F.coalesce("exact", "active").alias("pitch"))


def keep_max_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cadence of the highest confidence of each tick, the first on ties; and its token. Rivals of 1.5 to 3.5 stand beside the cadences."""
    c = S.cadences(notes(spark, sf_dir)).withColumn("o", F.lit(0))
    rival = 1.5 + F.col("bar_index") % 5 / 2
    again = c.union(c.select("piece_id", "tick", "bar_index", F.lit("CAD_DC").alias("label"), rival.alias("confidence"), F.lit(1).alias("o")))
    best = again.groupBy("piece_id", "tick").agg(F.max(F.struct("confidence", (-F.col("o")).alias("o"), "label")).alias("b"))
    token = F.element_at(F.create_map(*(F.lit(x) for kv in {"CAD_PAC": 101, "CAD_IAC": 102, "CAD_HC": 103, "CAD_DC": 104}.items() for x in kv)), F.col("b.label"))
    return best.select("piece_id", "tick", F.col("b.label").alias("label"), token.alias("token"))


def cadence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cadences a bar and shares of their kinds, by mode of the piece."""
    n = notes(spark, sf_dir)
    mode = F.when(F.col("piece_id") % 2 == 0, "major").otherwise("minor").alias("mode")
    bars = n.groupBy("piece_id").agg(F.ceil(F.max(F.col("start") + F.col("dur")) / 1920).alias("b")).groupBy(mode).agg(F.sum("b").alias("bars"))
    kinds = S.cadences(n).groupBy(mode).agg(F.count(F.lit(1)).alias("cadences"), *(F.round(F.avg(F.when(F.col("label") == k, 1.0).otherwise(0.0)), 9).alias(k.lower()) for k in ("CAD_PAC", "CAD_HC")))
    return bars.join(kinds, "mode").select("mode", "cadences", F.round(F.col("cadences") / F.col("bars"), 9).alias("per_bar"), "cad_pac", "cad_hc")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between every fourth bar line, cadences and first entries of voices, with the notes that begin in each."""
    n = notes(spark, sf_dir)
    ends = n.groupBy("piece_id").agg(F.max(F.col("start") + F.col("dur")).cast("long").alias("m"))
    grid = ends.select("piece_id", F.explode(F.expr("sequence(0L, m - 1, 7680L)")).alias("tick"))
    entries = n.groupBy("piece_id", "voice").agg(F.min("start").alias("tick")).select("piece_id", "tick")
    cuts = grid.union(S.cadences(n).select("piece_id", "tick")).union(entries).distinct().join(ends, "piece_id").filter("tick < m")
    parts = cuts.withColumn("until", F.coalesce(F.lead("tick").over(W.partitionBy("piece_id").orderBy("tick")), F.col("m")))
    probes = n.select("piece_id", F.col("start").alias("at"))
    held = parts.select("piece_id", F.col("tick").alias("start"), (F.col("until") - F.col("tick")).alias("dur"))
    counts = stab(probes, held, ["piece_id"], tick="at").groupBy("piece_id", F.col("start").alias("tick")).agg(F.count(F.lit(1)).alias("notes"))
    return parts.join(counts, ["piece_id", "tick"], "left").select("piece_id", "tick", "until", F.coalesce("notes", F.lit(0)).alias("notes"))


def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key token name and path slug of each piece's best key, and root and mode read back from the name."""
    k = H.detect_key(spark, sf_dir)
    name = F.element_at(lits(KEY_NAMES), F.col("key_root") * 2 + F.when(F.col("key_mode") == "major", 1).otherwise(2))
    spelled = F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "^([A-G])s", "$1#")
    back = parse_key(spelled)
    return k.select("piece_id", name.alias("name"), F.lower(F.replace(spelled, F.lit(" "), F.lit("_"))).alias("slug"), back["root"].alias("root"), back["mode"].alias("mode"))


def subject_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch and duration of each note of a subject string; unknown codes are quarters, what is no note is passed over."""
    text = F.element_at(lits(TEXTS), (F.col("c_custkey") % len(TEXTS) + 1).cast("int"))
    parts = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.split(text, " ")).alias("pos", "part"))
    code = F.create_map(*(F.lit(x) for kv in DURATION_CODES.items() for x in kv))
    note = parts.select("c_custkey", "pos", parse_note(F.split_part("part", F.lit(":"), F.lit(1))).alias("pitch"), F.coalesce(F.try_element_at(code, F.split_part("part", F.lit(":"), F.lit(2))), F.lit(480)).alias("dur"))
    return note.filter("pitch is not null")


def beat_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats as ticks, rounded half to even and truncated."""
    beats = F.col("l_quantity").cast("double") / 64
    return table(spark, sf_dir, "lineitem").select(F.bround(beats * 480, 0).cast("bigint").alias("rounded"), (beats * 480).cast("bigint").alias("cut")).groupBy("rounded", "cut").agg(F.count(F.lit(1)).alias("rows"))


def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a comma-separated argument; blanks go, what is no number is null."""
    raw = F.concat_ws(",", F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment", (F.col("c_custkey") / 4).cast("string"))
    items = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(items).alias("items"), F.round(F.aggregate(F.transform(items, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def sequence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, pieces and lengths of the corpus, by role."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split(F.lower("text"), " ")))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("sequences"), F.countDistinct("conv_id").alias("pieces"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


def category_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-entropy of the likeliest token, by category of the token."""
    g = logits(spark, sf_dir)
    norm = g.groupBy("ctx_id").agg(F.max("logit").alias("top"), F.log(F.sum(F.exp("logit"))).alias("z"), F.max_by("token_id", F.struct("logit", (-F.col("token_id")).alias("t"))).alias("token"))
    return norm.groupBy((F.col("token") % 4).alias("category")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.col("z") - F.col("top")), 5).alias("loss"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ctx_id and toks: the token kinds of the conversation of that id in order; 0 to 3 are voices, 4 is a temporal token."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("ctx_id"), "turn", F.coalesce(F.transform(F.split(F.lower("text"), " "), lambda w: F.length(w) % 8), F.array().cast("array<int>")).alias("w"))  # a null text has no tokens
    return c.groupBy("ctx_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "w"))), lambda x: x["w"])).alias("toks"))


def anti_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits biased by the voices since the last temporal token of the last 32: three or more lower voices by 1.1 and raise temporal tokens by 0.35, two lower voices by 0.25."""
    r = recent(spark, sf_dir).withColumn("last", F.reverse(F.slice("toks", F.greatest(F.size("toks") - 31, F.lit(1)), F.lit(32))))
    since = F.when(F.array_position("last", 4) > 0, F.slice("last", F.lit(1), (F.array_position("last", 4) - 1).cast("int"))).otherwise(F.col("last"))
    r = r.select("ctx_id", F.size(F.array_distinct(F.filter(since, lambda x: x < 4))).alias("voices"))
    voice, temporal = F.col("token_id") % 8 < 4, F.col("token_id") % 8 == 4
    bias = F.when(voice & (F.col("voices") >= 3), -1.1).when(temporal & (F.col("voices") >= 3), 0.35).when(voice & (F.col("voices") == 2), -0.25).otherwise(0.0)
    return logits(spark, sf_dir).join(r, "ctx_id").select("ctx_id", "token_id", F.round(F.col("logit") + bias, 6).alias("logit"))


def voice_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """While one of the required voices (2 to 4) has no note, the end token (7) is barred and tokens of missing voices gain 1.5."""
    r = recent(spark, sf_dir).select("ctx_id", F.filter(F.sequence(F.lit(0), (F.col("ctx_id") % 3 + 1).cast("int")), lambda v: ~F.array_contains("toks", v)).alias("missing"))
    gain = F.when(F.array_contains("missing", (F.col("token_id") % 8).cast("int")), 1.5).otherwise(0.0)
    barred = (F.col("token_id") == 7) & (F.size("missing") > 0)
    return logits(spark, sf_dir).join(r, "ctx_id").select("ctx_id", "token_id", F.when(barred, float("-inf")).otherwise(F.round(F.col("logit") + gain, 6)).alias("logit"))


QUERIES = {f.__name__: f for f in (detect_form, accompaniment_like, information_score, interaction_adjustment, form_weights, form_thresholds, loader_union, exact_or_active, keep_max_per_tick, cadence_density, sections, key_names, subject_tokens, beat_rounding, number_lists, sequence_summary, category_loss, anti_lockstep, voice_floor)}


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def pick_sql(values: list, by: str) -> str:
    return f"({values})[CAST(({by}) % {len(values)} AS INT) + 1]"


def range_sql(v: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {v} BETWEEN {lo} AND {hi} THEN 1.0 WHEN {v} < {lo} THEN greatest(0.0, 1 - ({lo} - {v}) / {hi - lo}) ELSE greatest(0.0, 1 - ({v} - {hi}) / {2 * (hi - lo)}) END)"


def profile_sql(form: str) -> str:
    forms = "('invention', '2-part')" if form == "invention" else f"('{form}')"
    total, applied = S.interaction_sql(form)
    return f"SELECT o_orderkey, round({total}, 6) AS delta, CAST({applied} AS INT) AS applied FROM m WHERE form IN {forms}"


MEASURES_SQL = "m AS (SELECT o_orderkey, o_totalprice, o_orderpriority, " + pick_sql(["fugue", "sinfonia", "invention", "2-part", "motet"], "o_orderkey") + " AS form, " + ", ".join(f"(o_orderkey * {k} % {p}) * 1.0 / {p - 1} AS {n}" for n, k, p in (("voice_leading", 7, 101), ("cadence", 11, 103), ("phrase", 13, 107), ("key_consistency", 17, 109), ("stagger", 19, 113), ("contrary", 23, 127), ("melodic", 29, 131), ("independence", 31, 137))) + " FROM orders)"
CADENCES_SQL = S.SQL["cadence_events"].removeprefix(f"WITH {NOTES_SQL}, ").rsplit(" SELECT * FROM f WHERE", 1)[0] + ", cv AS (SELECT * FROM f WHERE label IS NOT NULL AND confidence >= 2)"
RECENT_SQL = "rc AS (SELECT conv_id AS ctx_id, flatten(list(list_transform(string_split(lower(text), ' '), lambda w: length(w) % 8) ORDER BY turn)) AS toks FROM conversations GROUP BY 1)"
SQL = {
    "detect_form": f"""WITH w AS (SELECT doc_id, {pick_sql(NAMES, 'doc_id')} AS s, CAST(doc_id % 5 + 1 AS INT) AS n_parts, {pick_sql(['baroque', 'renaissance', 'classical'], 'doc_id // 13')} AS style FROM documents),
b AS (SELECT *, TRY_CAST(regexp_extract(lower(s), 'bwv\\s*(\\d+)', 1) AS INT) AS bwv FROM w), f AS (SELECT *, CASE WHEN bwv BETWEEN 250 AND 438 THEN 'chorale' WHEN bwv BETWEEN 772 AND 786 THEN 'invention' WHEN bwv BETWEEN 787 AND 801 THEN 'sinfonia' WHEN bwv IN (565, 1080) OR bwv BETWEEN 847 AND 893 AND bwv % 2 = 1 THEN 'fugue' WHEN bwv BETWEEN 525 AND 530 THEN 'trio_sonata'
 {' '.join(f"WHEN contains(lower(s), '{k}') THEN '{v}'" for k, v in KEYWORDS)} {' '.join(f"WHEN list_contains(string_split(lower(s), '/'), '{k}') THEN '{v}'" for k, v in DIRECTORIES.items())}
 WHEN n_parts <= 2 THEN 'invention' WHEN n_parts = 3 THEN 'sinfonia' WHEN style = 'renaissance' THEN 'motet' WHEN style = 'classical' THEN 'quartet' ELSE 'chorale' END AS form FROM b)
SELECT doc_id, form, CAST(CASE {' '.join(f"WHEN form = '{k}' THEN {v}" for k, v in VOICES.items())} END AS INT) AS voices, {any_sql('lower(s)', KEYBOARD)} AS keyboard, {any_sql('s', STEM_PARTS)} AS rejected FROM f""",
    "accompaniment_like": f"SELECT piece_id, severity >= 1.0 AS \"like\", severity >= 1.0 AND piece_id % 2 = 0 AS dropped FROM ({H.SQL['accompaniment_severity']})",
    "information_score": f"SELECT piece_id, round(0.35 * {range_sql('perplexity', 5.0, 25.0)} + 0.30 * {range_sql('entropy', 2.0, 5.0)} + 0.35 * diversity, 5) AS information FROM ({Q.SQL['bigram_perplexity']}) JOIN ({Q.SQL['token_entropy']}) USING (piece_id) JOIN ({Q.SQL['token_diversity']}) USING (piece_id)",
    "interaction_adjustment": f"WITH {MEASURES_SQL} " + " UNION ALL ".join(profile_sql(f) for f in S.PROFILES) + " UNION ALL SELECT o_orderkey, 0.0 AS delta, CAST(0 AS INT) AS applied FROM m WHERE form = 'motet'",
    "form_weights": f"SELECT form, count(*) AS runs, CASE form WHEN 'fugue' THEN 0.24 WHEN '2-part' THEN 0.18 ELSE 0.24 END AS weight FROM (SELECT {pick_sql(['fugue', '2-part', '3-part', '4-part', 'motet'], 'doc_id')} AS form FROM documents) GROUP BY 1",
    "form_thresholds": f"WITH {MEASURES_SQL} SELECT form, round(quantile_cont(round(stagger, 6), 0.33), 6) AS p33, round(quantile_cont(round(stagger, 6), 0.67), 6) AS p67 FROM m GROUP BY 1",
    "loader_union": "WITH u AS (SELECT 0 AS prio, doc_id AS id, lang || ':' || md5(text) AS name FROM documents UNION ALL SELECT 1, item_id, 'en:' || md5(text) FROM benchmark UNION ALL SELECT 2, page_id, 'en:' || md5(html) FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY prio, id) AS r FROM u WHERE starts_with(name, 'en:')) SELECT CAST(prio AS INT) AS prio, CAST(id AS BIGINT) AS id, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY prio ORDER BY id, name) AS k FROM k WHERE r = 1) WHERE k <= 50",
    "exact_or_active": f"""WITH {NOTES_SQL}, b AS (SELECT piece_id, unnest(range(0, m + 1, 1920)) AS tick FROM (SELECT piece_id, CAST(max(start + dur) AS BIGINT) AS m FROM n2 GROUP BY 1)),
j AS (SELECT b.piece_id, tick, voice, pitch, note_idx, start FROM b JOIN n2 ON n2.piece_id = b.piece_id AND start <= tick AND tick < start + dur) SELECT piece_id, tick, voice, arg_min(pitch, note_idx) FILTER (start = tick) AS exact, coalesce(arg_min(pitch, note_idx) FILTER (start = tick), arg_min(pitch, start * 100000 + note_idx)) AS pitch FROM j GROUP BY 1, 2, 3""",
    "keep_max_per_tick": f"WITH {NOTES_SQL}, {CADENCES_SQL}, u AS (SELECT piece_id, tick, label, confidence, 0 AS o FROM cv UNION ALL SELECT piece_id, tick, 'CAD_DC', 1.5 + bar_index % 5 / 2.0, 1 FROM cv), x AS (SELECT *, row_number() OVER (PARTITION BY piece_id, tick ORDER BY confidence DESC, o) AS r FROM u) SELECT piece_id, tick, label, CAST(CASE label WHEN 'CAD_PAC' THEN 101 WHEN 'CAD_IAC' THEN 102 WHEN 'CAD_HC' THEN 103 ELSE 104 END AS INT) AS token FROM x WHERE r = 1",
    "cadence_density": f"WITH {NOTES_SQL}, {CADENCES_SQL}, k AS (SELECT CASE WHEN piece_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, count(*) AS cadences, round(avg(CASE WHEN label = 'CAD_PAC' THEN 1.0 ELSE 0 END), 9) AS cad_pac, round(avg(CASE WHEN label = 'CAD_HC' THEN 1.0 ELSE 0 END), 9) AS cad_hc FROM cv GROUP BY 1), z AS (SELECT CASE WHEN piece_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, sum(b) AS bars FROM (SELECT piece_id, ceil(max(start + dur) / 1920.0) AS b FROM n GROUP BY 1) GROUP BY 1) SELECT mode, cadences, round(cadences / bars, 9) AS per_bar, cad_pac, cad_hc FROM k JOIN z USING (mode)",
    "sections": f"""WITH {NOTES_SQL}, {CADENCES_SQL}, e9 AS (SELECT piece_id, CAST(max(start + dur) AS BIGINT) AS m FROM n GROUP BY 1), c9 AS (SELECT piece_id, unnest(range(0, m, 7680)) AS tick FROM e9 UNION SELECT piece_id, tick FROM cv UNION SELECT piece_id, min(start) FROM n GROUP BY piece_id, voice),
s9 AS (SELECT c9.piece_id, tick, coalesce(lead(tick) OVER (PARTITION BY c9.piece_id ORDER BY tick), m) AS until FROM c9 JOIN e9 USING (piece_id) WHERE tick < m) SELECT s9.piece_id, tick, until, count(n.pitch) AS notes FROM s9 LEFT JOIN n ON n.piece_id = s9.piece_id AND start >= tick AND start < until GROUP BY 1, 2, 3""",
    "key_names": f"SELECT piece_id, name, lower(replace(CASE WHEN name[2] = 's' THEN name[1] || '#' || name[3:] ELSE name END, ' ', '_')) AS slug, key_root AS root, key_mode AS mode FROM (SELECT *, ({KEY_NAMES})[key_root * 2 + CASE WHEN key_mode = 'major' THEN 1 ELSE 2 END] AS name FROM ({H.SQL['detect_key']}))",
    "subject_tokens": f"""WITH t AS (SELECT c_custkey, string_split({pick_sql(TEXTS, 'c_custkey')}, ' ') AS p FROM customer), u AS (SELECT c_custkey, CAST(i AS INT) AS pos, p[i + 1] AS part FROM (SELECT *, unnest(range(len(p))) AS i FROM t)), v AS (SELECT c_custkey, pos, regexp_extract(split_part(part, ':', 1), '^([A-Ga-g])([#b]?)(-?\\d+)$', ['l', 'a', 'o']) AS g, split_part(part, ':', 2) AS d FROM u)
SELECT c_custkey, pos, CAST((CAST(g.o AS INT) + 1) * 12 + ([0, 2, 4, 5, 7, 9, 11])[strpos('CDEFGAB', upper(g.l))] + CASE g.a WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END AS INT) AS pitch, CAST(CASE d {' '.join(f"WHEN '{k}' THEN {v}" for k, v in DURATION_CODES.items())} ELSE 480 END AS INT) AS dur FROM v WHERE g.l <> ''""",
    "beat_rounding": "SELECT CAST(round_even(CAST(l_quantity AS DOUBLE) / 64 * 480, 0) AS BIGINT) AS rounded, CAST(trunc(CAST(l_quantity AS DOUBLE) / 64 * 480) AS BIGINT) AS cut, count(*) AS rows FROM lineitem GROUP BY 1, 2",
    "number_lists": "WITH r AS (SELECT c_custkey, list_filter(list_transform(string_split(concat_ws(',', CAST(c_custkey AS VARCHAR), ' ', c_mktsegment, CAST(c_custkey / 4 AS VARCHAR)), ','), lambda x: trim(x)), lambda x: x <> '') AS x FROM customer) SELECT c_custkey, CAST(len(x) AS INT) AS items, round(list_sum(list_transform(x, lambda v: coalesce(TRY_CAST(v AS DOUBLE), 0))), 6) AS total FROM r",
    "sequence_summary": "SELECT role, count(*) AS sequences, count(DISTINCT conv_id) AS pieces, CAST(min(n) AS INT) AS shortest, CAST(max(n) AS INT) AS longest, round(avg(n), 6) AS mean FROM (SELECT *, len(string_split(lower(text), ' ')) AS n FROM conversations) GROUP BY 1",
    "category_loss": f"WITH {LOGITS_SQL}, z AS (SELECT ctx_id, max(logit) AS top, ln(sum(exp(logit))) AS z FROM g GROUP BY 1), a AS (SELECT ctx_id, min(token_id) AS token FROM g JOIN z USING (ctx_id) WHERE logit = top GROUP BY 1) SELECT CAST(token % 4 AS INT) AS category, count(*) AS rows, round(avg(z - top), 5) AS loss FROM a JOIN z USING (ctx_id) GROUP BY 1",
    "anti_lockstep": f"""WITH {LOGITS_SQL}, {RECENT_SQL}, x AS (SELECT ctx_id, toks[greatest(len(toks) - 31, 1):] AS t FROM rc), y AS (SELECT ctx_id, len(list_distinct(list_filter(t, lambda v, i: v < 4 AND NOT list_contains(t[i:], 4)))) AS voices FROM x)
SELECT ctx_id, token_id, round(logit + CASE WHEN token_id % 8 < 4 AND voices >= 3 THEN -1.1 WHEN token_id % 8 = 4 AND voices >= 3 THEN 0.35 WHEN token_id % 8 < 4 AND voices = 2 THEN -0.25 ELSE 0 END, 6) AS logit FROM g JOIN y USING (ctx_id)""",
    "voice_floor": f"WITH {LOGITS_SQL}, {RECENT_SQL}, x AS (SELECT ctx_id, list_filter(range(ctx_id % 3 + 2), lambda v: NOT list_contains(toks, v)) AS missing FROM rc) SELECT ctx_id, token_id, CASE WHEN token_id = 7 AND len(missing) > 0 THEN CAST('-inf' AS DOUBLE) ELSE round(logit + CASE WHEN list_contains(missing, token_id % 8) THEN 1.5 ELSE 0 END, 6) END AS logit FROM g JOIN x USING (ctx_id)",
}
