"""What stands around a generator: subjects drawn at random, forced subject starts, chained chunks, section rewards on tokens, and
the equal mix of winners and real data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.functions.pitch import HARMONIC_MINOR, MAJOR, lits, scale
from quaverlake.operators import encoding, joins, scoring
from quaverlake.operators.encoding import ENCODED_SQL
from quaverlake.operators.joins import stab
from quaverlake.operators.ranking import SQL as RANKING_SQL
from quaverlake.operators.ranking import sections
from quaverlake.plans.folds import exact_percentile, folded, least_by_hash
from quaverlake.plans.views import NOTES_SQL, notes, table

# Shares of steps of a random subject, its rhythms, the pitches it may use, and the weights of a section's scores.
STEPS = [(0.4, 1), (0.7, -1), (0.85, 2), (0.95, -2)]
RHYTHMS = [[480] * 8, [240] * 8, [480, 240, 240] * 3, [240, 240, 480] * 3, [960, 480, 480, 240, 240, 480, 480, 960]]
LOWEST, HIGHEST, OCTAVES = 36, 84, (2, 6)
SECTION = {"voice_leading": 0.30, "contrapuntal": 0.25, "fragment": 0.20, "statistical": 0.10, "cadence": 0.15}
# End of fixed values.
LENGTH, SEED = 8, 7
#: Candidates of a chunk, tokens of its context, and what a token of the context is worth in millionths.
BEST_OF, OVERLAP, SEAM = 8, 4, 125_000
LEAST_ENTRIES, SPACING = 4, 2


def draw(what: str, key: Column, i: Column | int = 0) -> Column:
    """A number in [0, 2**32) that depends on the seed, on what is drawn, for whom and how many times."""
    text = F.concat_ws(":", F.lit(str(SEED)), F.lit(what), key.cast("string"), (F.lit(i) if isinstance(i, int) else i).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def step_of(r: Column, sign: Column) -> Column:
    out = F
    for share, step in STEPS:
        out = out.when(r < int(share * (1 << 32)), step)
    return out.when(sign % 2 == 0, 3).otherwise(-3)


def walks(keys: DataFrame, key: str, root: Column, mode: Column) -> DataFrame:
    """key, i, pitch, octave, degree, dur: a subject in notes (a walk over the scale's pitches, kept between LOWEST and HIGHEST), and the
    same walk in degrees, whose octaves are kept between OCTAVES."""
    k = F.col(key)
    tones = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(7)), lambda o: F.transform(F.array_sort(scale(root, mode)), lambda s: s + 12 * o))), lambda p: p.between(LOWEST, HIGHEST))
    high, fifth = draw("octave", k) % 2, draw("degree", k) % 2
    first = F.element_at(scale(root, mode), (fifth * 4 + 1).cast("int")) + (4 + high) * 12 + 12
    moves = F.transform(F.sequence(F.lit(1), F.lit(LENGTH - 1)), lambda i: step_of(draw("step", k, i), draw("sign", k, i)))
    d = keys.select(key, tones.alias("tones"), first.cast("int").alias("first"), moves.alias("moves"), F.struct((4 + high).cast("int").alias("o"), (fifth * 4).cast("int").alias("d")).alias("deg"), (draw("rhythm", k) % len(RHYTHMS)).cast("int").alias("rhythm"))
    at = F.array_position("tones", F.col("first")).cast("int")
    walked = F.aggregate("moves", F.array(at), lambda acc, m: F.concat(acc, F.array(F.least(F.greatest(F.element_at(acc, -1) + m, F.lit(1)), F.size("tones")))))

    def degree(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        moved = last["d"] + m
        octave = F.greatest(F.least(last["o"] + F.floor(moved / 7).cast("int"), F.lit(OCTAVES[1])), F.lit(OCTAVES[0]))
        return F.concat(acc, F.array(F.struct(octave.alias("o"), F.pmod(moved, F.lit(7)).cast("int").alias("d"))))

    both = F.arrays_zip(walked.alias("at"), F.aggregate("moves", F.array("deg"), degree).alias("deg"))
    out = d.select(key, "tones", "rhythm", F.posexplode(both).alias("i", "x"))
    durs = F.array(*(lits(r[:LENGTH]) for r in RHYTHMS))
    return out.select(key, "i", F.element_at("tones", F.col("x.at")).alias("pitch"), F.col("x.deg.o").alias("octave"), (F.col("x.deg.d") + 1).alias("degree"), durs[F.col("rhythm")][F.col("i")].alias("dur"))


def random_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject for each customer, in the key of its number; the same seed gives the same subjects."""
    root, mode = (F.col("c_custkey") % 12).cast("int"), F.when(F.col("c_custkey") % 2 == 0, "major").otherwise("minor")
    return walks(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", root, mode)


def starts(rows: Iterator[tuple], least: int, spacing: int) -> Iterator[tuple]:
    """(piece, pos, bar, entry, forced) of each subject start, from rows (piece, pos, token) by piece and pos."""
    piece = None
    bars = entries = due = 0
    for p, pos, token in rows:
        if p != piece:
            piece, bars, entries, due = p, 0, 0, spacing
        bars += token == "BAR"
        own = token == "SUBJECT_START"
        if own or token == "BAR" and entries < least and bars >= due:
            entries, due = entries + 1, bars + spacing
            yield p, pos, bars, entries, not own


def forced_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where subjects start in each piece's tokens until LEAST_ENTRIES have: at their own tokens, or forced behind the bar that comes
    SPACING bars after the start before (or the beginning)."""
    t = encoding.encoded(notes(spark, sf_dir)).filter("encoding = 'interleaved' and token in ('BAR', 'SUBJECT_START')").select("piece_id", F.col("pos").cast("bigint").alias("pos"), "token")
    found = folded(t, ["piece_id"], ["pos"], lambda rows: starts(rows, LEAST_ENTRIES, SPACING), "piece_id bigint, pos bigint, bar int, entry int, forced boolean")
    return found.filter(F.col("entry") <= LEAST_ENTRIES)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece_id, chunk, cand, tokens: the seed of a piece (its own first turn) and, for each later chunk, that turn of the BEST_OF conversations of its block."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1).alias("chunk"), F.split(F.lower("text"), " ").alias("tokens"))
    c = c.withColumn("block", F.floor(F.col("conv_id") / BEST_OF))
    pieces = c.select(F.col("conv_id").alias("piece_id"), "block").distinct()
    return pieces.join(c, "block").filter("chunk > 0 or conv_id = piece_id").select("piece_id", "chunk", F.col("conv_id").alias("cand"), "tokens")


def chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(piece, chunk, cand, score, first, new) of the winner of each chunk, from rows (piece, chunk, cand, tokens) in that order.

    A candidate scores what share of its tokens differ and how many of its first OVERLAP tokens stand among the last of the winner
    before; the least candidate wins a tie. Its first OVERLAP tokens are context; `new` are the others, `first` their place.
    """
    piece = chunk = best = None
    tail: list = []
    at = 0

    def close() -> tuple:
        nonlocal tail, at
        score, cand, tokens = best
        new = tokens if not chunk else tokens[OVERLAP:]
        out = piece, chunk, cand, score, at, new
        tail, at = tokens[-OVERLAP:], at + len(new)
        return out

    for p, c, cand, tokens in rows:
        if best is not None and (p, c) != (piece, chunk):
            yield close()
            best = None
        if p != piece:
            tail, at = [], 0
        piece, chunk = p, c
        score = len(set(tokens)) * 1_000_000 // len(tokens) + SEAM * sum(t in tail for t in tokens[:OVERLAP])
        if best is None or score > best[0]:
            best = score, cand, tokens
    if best is not None:
        yield close()


def chained_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long sequences stitched of the best candidate of each chunk, chosen in order."""
    won = folded(chunks(spark, sf_dir), ["piece_id"], ["chunk", "cand"], chained, "piece_id bigint, chunk int, cand bigint, score bigint, first bigint, new array<string>")
    return won.select("piece_id", "chunk", "cand", "score", "first", F.size("new").alias("size"), F.md5(F.array_join("new", " ")).alias("tokens_md5"))


def keyed(s: DataFrame) -> Column:
    """A section's own key: its piece and the tick at which it begins."""
    return F.col("piece_id") * (1 << 32) + F.col("tick")


def section_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece_id, tick, until, place, and the five scores of each section with their weighted sum.

    voice_leading, statistical and the share of single onsets (contrapuntal) are taken of the section's notes alone, 0.5 where it has too
    few; fragment is 1 if three intervals of it are the first three of the piece's highest voice, 0.7 if they are their inversion;
    cadence is the confidence (of 3) of a cadence at its end.
    """
    n = notes(spark, sf_dir)
    s = sections(spark, sf_dir).drop("notes").withColumn("place", F.row_number().over(W.partitionBy("piece_id").orderBy("tick")))
    held = s.select("piece_id", F.col("tick").alias("start"), (F.col("until") - F.col("tick")).alias("dur"), keyed(s).alias("key"))
    own = stab(n.withColumnsRenamed({"start": "at", "dur": "long"}), held, ["piece_id"], tick="at").select(F.col("key").alias("piece_id"), "voice", "note_idx", F.col("at").alias("start"), F.col("long").alias("dur"), "pitch", "event_id")
    grams = joins.ngrams(own, 3).select(F.col("piece_id").alias("key"), "gram")
    theme = joins.ngrams(n, 3).filter("voice = 0 and start = 0").groupBy("piece_id").agg(F.min("gram").alias("theme"))
    mine = s.select("piece_id", keyed(s).alias("key")).join(theme, "piece_id").join(grams, "key")
    kind = F.when(F.col("gram") == F.col("theme"), 1.0).when(F.col("gram") == F.transform("theme", lambda v: -v), 0.7).otherwise(0.0)
    fragment = mine.groupBy("key").agg(F.max(kind).alias("fragment"))
    closes = scoring.cadences(n).groupBy("piece_id", F.col("tick").alias("until")).agg((F.max("confidence") / 3.0).alias("cadence"))
    x = s.withColumn("key", keyed(s))
    for part, name in ((scoring.leading(own), "voice_leading"), (scoring.stagger(own), "stagger"), (scoring.statistical(own), "statistical")):
        x = x.join(part.select(F.col("piece_id").alias("key"), name), "key", "left")
    x = x.join(fragment, "key", "left").join(closes, ["piece_id", "until"], "left").withColumnRenamed("stagger", "contrapuntal")
    x = x.select("piece_id", "tick", "until", "place", *(F.coalesce(k, F.lit(0.5 if k in ("voice_leading", "contrapuntal", "statistical") else 0.0)).alias(k) for k in SECTION))
    return x.withColumn("reward", F.round(sum((w * F.col(k) for k, w in SECTION.items()), F.lit(0.0)), 6))


def section_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_scores(spark, sf_dir).select("piece_id", "tick", "place", *(F.round(k, 6).alias(k) for k in SECTION), "reward")


def section_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose composite reaches the 75th percentile of their group (ids with the same last digit), of whose sections none is below 0.3,
    and whose mean section reaches the 70th percentile of the group. Scores are rounded, so that the percentiles hold few values."""
    per = section_scores(spark, sf_dir).groupBy("piece_id").agg(F.min("reward").alias("least"), F.round(F.avg("reward"), 6).alias("mean"))
    x = scoring.composite_score(spark, sf_dir).join(per, "piece_id").withColumn("prompt", F.col("piece_id") % 10)
    group = W.partitionBy("prompt")
    x = x.withColumn("a", F.percentile("composite", F.lit(0.75)).over(group)).withColumn("b", F.percentile("mean", F.lit(0.70)).over(group))
    return x.filter("composite >= a AND least >= 0.3 AND mean >= b").select("piece_id", "prompt", "composite", "least", "mean")


def token_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The advantage of each token's section among the sections of the same place of the pieces of its group (ids with the same last digit)."""
    s = section_scores(spark, sf_dir).select("piece_id", "tick", "until", "place", "reward", (F.col("piece_id") % 10).alias("prompt"))
    per = s.groupBy("prompt", "place").agg(F.avg("reward").alias("mean"), F.stddev_pop("reward").alias("dev"))
    a = s.join(per, ["prompt", "place"]).select("piece_id", F.col("tick").alias("start"), (F.col("until") - F.col("tick")).alias("dur"), "place", F.round((F.col("reward") - F.col("mean")) / (F.col("dev") + 1e-8), 4).alias("advantage"))
    t = encoding.events(notes(spark, sf_dir)).select("piece_id", F.col("tick").alias("at"), "voice", "note", "kind")
    return stab(t, a, ["piece_id"], tick="at").select("piece_id", F.col("at").alias("tick"), "voice", "note", "kind", "place", "advantage")


def equal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners (orders at or above the 75th percentile of their priority's prices) and as many other orders of the same priority, the
    same at every run: those whose keys have the least hashes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").join(exact_percentile(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 0.75, 100.0), "o_orderpriority")
    won = o.filter("o_totalprice >= cut").select("o_orderkey", "o_orderpriority")
    quota = won.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("wanted"))
    real = least_by_hash(o.filter("o_totalprice < cut").select("o_orderkey", "o_orderpriority"), "o_orderpriority", quota, F.col("o_orderkey").cast("string"))
    return won.withColumn("source", F.lit("winner")).unionByName(real.withColumn("source", F.lit("real")))


QUERIES = {f.__name__: f for f in (random_subjects, forced_starts, chained_chunks, section_rewards, section_winners, token_advantages, equal_mix)}


def draw_sql(what: str, i: str = "0") -> str:
    return f"CAST('0x' || substr(md5('{SEED}:{what}:' || c_custkey || ':' || {i}), 1, 8) AS BIGINT)"


def scale_sql(root: str, major: str) -> str:
    return f"list_transform(CASE WHEN {major} THEN {MAJOR} ELSE {HARMONIC_MINOR} END, lambda x: (x + {root}) % 12)"


SECTION_SQL = f"""sx AS ({RANKING_SQL['sections']}), ss AS (SELECT piece_id, CAST(tick AS BIGINT) AS tick, CAST(until AS BIGINT) AS until, piece_id * 4294967296 + tick AS key, row_number() OVER (PARTITION BY piece_id ORDER BY tick) AS place FROM sx),
nn AS (WITH {NOTES_SQL} SELECT * FROM n), n AS (SELECT key AS piece_id, voice, note_idx, start, dur, pitch, event_id FROM nn JOIN ss ON ss.piece_id = nn.piece_id AND start >= tick AND start < until),
gm AS (SELECT piece_id, voice, start, [lead(pitch, 1) OVER w - pitch, lead(pitch, 2) OVER w - lead(pitch, 1) OVER w, lead(pitch, 3) OVER w - lead(pitch, 2) OVER w] AS g FROM n WINDOW w AS (PARTITION BY piece_id, voice ORDER BY start, note_idx)),
th AS (SELECT piece_id, [lead(pitch, 1) OVER w - pitch, lead(pitch, 2) OVER w - lead(pitch, 1) OVER w, lead(pitch, 3) OVER w - lead(pitch, 2) OVER w] AS g, start FROM nn WHERE voice = 0 WINDOW w AS (PARTITION BY piece_id ORDER BY start, note_idx)),
fr AS (SELECT key, max(CASE WHEN gm.g = th.g THEN 1.0 WHEN gm.g = list_transform(th.g, lambda v: -v) THEN 0.7 ELSE 0 END) AS fragment FROM ss JOIN th ON th.piece_id = ss.piece_id AND th.start = 0 AND th.g[3] IS NOT NULL JOIN gm ON gm.piece_id = key AND gm.g[3] IS NOT NULL GROUP BY 1),
ce AS (SELECT piece_id, tick, max(confidence) / 3.0 AS cadence FROM ({scoring.SQL['cadence_events']}) GROUP BY 1, 2), {scoring.leading_sql('n')}, {scoring.STATISTICAL_SQL},
og AS (SELECT piece_id, round(avg(CASE WHEN m = 1 THEN 1.0 ELSE 0.0 END), 9) AS stagger FROM (SELECT piece_id, start, count(DISTINCT voice) AS m FROM n GROUP BY 1, 2) GROUP BY 1),
rw AS (SELECT ss.*, coalesce(voice_leading, 0.5) AS voice_leading, coalesce(stagger, 0.5) AS contrapuntal, coalesce(fragment, 0.0) AS fragment, coalesce(statistical, 0.5) AS statistical, coalesce(cadence, 0.0) AS cadence FROM ss LEFT JOIN ld ON ld.piece_id = key LEFT JOIN og ON og.piece_id = key LEFT JOIN sa ON sa.piece_id = key LEFT JOIN fr USING (key) LEFT JOIN ce ON ce.piece_id = ss.piece_id AND ce.tick = ss.until),
rv AS (SELECT *, round(0.30 * voice_leading + 0.25 * contrapuntal + 0.20 * fragment + 0.10 * statistical + 0.15 * cadence, 6) AS reward FROM rw)"""
SQL = {
    "random_subjects": f"""WITH RECURSIVE k AS (SELECT c_custkey, {scale_sql('c_custkey % 12', 'c_custkey % 2 = 0')} AS s, {draw_sql('octave')} % 2 AS hi, {draw_sql('degree')} % 2 AS fi, {draw_sql('rhythm')} % 5 AS rh FROM customer),
t AS (SELECT *, list_sort(list_filter(flatten(list_transform(range(2, 8), lambda o: list_transform(s, lambda x: x + 12 * o))), lambda p: p BETWEEN 36 AND 84)) AS tones FROM k),
w AS (SELECT c_custkey, 0 AS i, tones, rh, CAST(list_position(tones, s[fi * 4 + 1] + (4 + hi) * 12 + 12) AS BIGINT) AS ix, CAST(4 + hi AS BIGINT) AS o, CAST(fi * 4 AS BIGINT) AS d FROM t UNION ALL
SELECT c_custkey, i + 1, tones, rh, least(greatest(ix + m, 1), len(tones)), least(greatest(o + CAST(floor((d + m) / 7.0) AS BIGINT), 2), 6), (d + m + 7) % 7 FROM (SELECT *, CASE {' '.join(f"WHEN {draw_sql('step', '(i + 1)')} < {int(share * (1 << 32))} THEN {step}" for share, step in STEPS)} WHEN {draw_sql('sign', '(i + 1)')} % 2 = 0 THEN 3 ELSE -3 END AS m FROM w) WHERE i < 7)
SELECT c_custkey, CAST(i AS INT) AS i, CAST(tones[ix] AS INT) AS pitch, CAST(o AS INT) AS octave, CAST(d + 1 AS INT) AS degree, CAST(({[r[:8] for r in RHYTHMS]})[rh + 1][i + 1] AS INT) AS dur FROM w""",
    "forced_starts": f"""WITH RECURSIVE {NOTES_SQL}, {ENCODED_SQL}, tk AS (SELECT piece_id, pos, token, count(*) FILTER (token = 'BAR') OVER (PARTITION BY piece_id ORDER BY pos) AS bars FROM ec WHERE encoding = 'interleaved' AND token IN ('BAR', 'SUBJECT_START')),
fs AS (SELECT DISTINCT piece_id, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS bars, 0 AS entry, FALSE AS forced FROM tk UNION ALL
SELECT piece_id, pos, bars, entry + 1, token = 'BAR' FROM (SELECT tk.piece_id, tk.pos, tk.bars, tk.token, fs.entry, row_number() OVER (PARTITION BY tk.piece_id ORDER BY tk.pos) AS r FROM fs JOIN tk ON tk.piece_id = fs.piece_id AND tk.pos > fs.pos AND (tk.token = 'SUBJECT_START' OR tk.bars >= fs.bars + {SPACING}) WHERE fs.entry < {LEAST_ENTRIES}) WHERE r = 1)
SELECT piece_id, CAST(pos AS BIGINT) AS pos, CAST(bars AS INT) AS bar, CAST(entry AS INT) AS entry, forced FROM fs WHERE entry > 0""",
    "chained_chunks": f"""WITH RECURSIVE c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk, string_split(lower(text), ' ') AS t, conv_id // {BEST_OF} AS block FROM conversations),
q AS (SELECT p.conv_id AS piece_id, c.chunk, c.conv_id AS cand, c.t, list_unique(c.t) * 1000000 // len(c.t) AS own FROM (SELECT DISTINCT conv_id, block FROM c) p JOIN c ON c.block = p.block AND (c.chunk > 0 OR c.conv_id = p.conv_id)),
r AS (SELECT piece_id, chunk, cand, own AS score, t, CAST(0 AS BIGINT) AS first, len(t) AS size FROM q WHERE chunk = 0 UNION ALL
SELECT piece_id, chunk, cand, score, t, first, size FROM (SELECT q.piece_id, q.chunk, q.cand, q.t, q.own + {SEAM} * len(list_filter(q.t[1:{OVERLAP}], lambda x: list_contains(r.t[-{OVERLAP}:], x))) AS score, r.first + r.size AS first, greatest(len(q.t) - {OVERLAP}, 0) AS size,
 row_number() OVER (PARTITION BY q.piece_id ORDER BY q.own + {SEAM} * len(list_filter(q.t[1:{OVERLAP}], lambda x: list_contains(r.t[-{OVERLAP}:], x))) DESC, q.cand) AS k FROM r JOIN q ON q.piece_id = r.piece_id AND q.chunk = r.chunk + 1) WHERE k = 1)
SELECT piece_id, CAST(chunk AS INT) AS chunk, cand, CAST(score AS BIGINT) AS score, CAST(first AS BIGINT) AS first, CAST(size AS INT) AS size, md5(coalesce(array_to_string(CASE WHEN chunk = 0 THEN t ELSE t[{OVERLAP + 1}:] END, ' '), '')) AS tokens_md5 FROM r""",
    "section_rewards": f"WITH {SECTION_SQL} SELECT piece_id, tick, CAST(place AS INT) AS place, {', '.join(f'round({k}, 6) AS {k}' for k in SECTION)}, reward FROM rv",
    "section_winners": f"""WITH cs AS ({scoring.SQL['composite_score']}), pe AS (WITH {SECTION_SQL} SELECT piece_id, min(reward) AS least, round(avg(reward), 6) AS mean FROM rv GROUP BY 1),
xx AS (SELECT *, piece_id % 10 AS prompt, quantile_cont(composite, 0.75) OVER (PARTITION BY piece_id % 10) AS a, quantile_cont(mean, 0.70) OVER (PARTITION BY piece_id % 10) AS b FROM cs JOIN pe USING (piece_id)) SELECT piece_id, prompt, composite, least, mean FROM xx WHERE composite >= a AND least >= 0.3 AND mean >= b""",
    "token_advantages": f"""WITH RECURSIVE av AS (WITH {SECTION_SQL} SELECT piece_id, tick, until, place, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8), 4) AS advantage FROM rv WINDOW w AS (PARTITION BY piece_id % 10, place)),
et AS (WITH RECURSIVE {NOTES_SQL}, {ENCODED_SQL} SELECT piece_id, tick, voice, note, kind FROM ev) SELECT et.piece_id, CAST(et.tick AS BIGINT) AS tick, voice, CAST(note AS BIGINT) AS note, kind, CAST(place AS INT) AS place, advantage FROM et JOIN av ON av.piece_id = et.piece_id AND et.tick >= av.tick AND et.tick < until""",
    "equal_mix": """WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice >= quantile_cont(o_totalprice, 0.75) OVER (PARTITION BY o_orderpriority) AS won FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, won ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS r, count(*) FILTER (won) OVER (PARTITION BY o_orderpriority) AS k FROM o)
SELECT o_orderkey, o_orderpriority, CASE WHEN won THEN 'winner' ELSE 'real' END AS source FROM r WHERE won OR r <= k""",
}
