r"""Operator 1: personal data, by candidate generators and boosted trees, in DataFrame functions only.

Four base patterns (email, IP address, card, phone) give the base spans, which always stay. Wider generators propose
overlapping candidate spans (written-out addresses, numbers in other groupings, keys and passwords). Boosted trees score each
candidate by its format and its context. They learn on all documents (by Spark's sums of gradients, see `boosting`): true are base spans and their
rewritings (at and dot written out, other separators, 00 for +) in the context of the base span, false are all other
candidates; of secrets, for which there is no base pattern, those are true that a word such as token or password is assigned
to, and the trees don't see that word. On a held-out third (by a hash of the features) each kind gets the least threshold at which PRECISION of the accepted
candidates are true (midway to the next lower score, even odds at least), or none; a secret that such a word is assigned to needs no score. Accepted candidates that touch no
base span compete: of those that overlap, the one of the higher score is added. The scored model is an expression of Spark
columns; the driver only picks the splits of trees and the thresholds from sums.

Base patterns are leftmost and non-overlapping per kind. They are written so that matching is linear: runs start only
where a run can start, and groups don't give back. Positions are code points, ends exclusive. Null texts count as empty and
have no spans. Repeated rows give equal results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm import boosting
from quaverlake.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: The kinds of candidates: those of base spans, then those that only the method finds.
ALL = (*KINDS, "secret")
PRECISION = 0.99
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: wider than the base in what they take, so their spans overlap base spans and each other.
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)\x20?\(?[0-9]{1,4}\)?(?:[\x20./-]?\(?[0-9]{2,5}\)?){1,5}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=@-])",
}
#: What a text holds in which a pattern of a kind can match, by a test that is cheaper than the pattern.
HINTS = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9]"}
#: Where a card number of four groups is cut, and rewritings of base spans: patterns and replacements in order, and whether what they
#: give is still true. The trees learn from them what candidates look like that no base pattern finds.
CUT = r"[^0-9]|(?<=^[0-9]{4}|^[0-9]{8}|^[0-9]{12})(?=[0-9])"
REWRITTEN = {
    "email": (((("@", " [at] "),), True), ((("@", " @ "),), True), (((r"^([^@]*)@(.*)\.([^.]*)$", "$1(at)$2(dot)$3"),), True), (((r"^([^@]*)@(.*)\.([^.]*)$", "$1 [at] $2 [dot] $3"),), True)),
    "ip": ((((r"\.", " . "),), True), (((r"\.", ". "),), True), ((("^[0-9]+", "999"),), False), ((("^[0-9]+", "999"), (r"\.", " . ")), False)),
    "card": (*((((CUT, c),), True) for c in "./ "), *((((end, "9"), (CUT, c)), False) for end in ("[0-8]$", "^[0-8]") for c in "./ "), ((("[0-8]$", "9"),), False)),
    "phone": ((((r"^\+", "00"),), True), (((r"[\x20-]", "/"),), True)),
}
#: What a secret is assigned to.
ASSIGNED = r"(?i)(?:token|secret|passwor[dt]|passwd|pwd|api[_-]?key|access[_-]?key|credential|auth)\w*[\"']?\x20?(?:=>?|:)\x20?[\"']?$"
CUES = (r"(?i)\b(?:e-?mail|contact|write|mailto)\b", r"(?i)\b(?:ip|host|server|address|client)\b", r"(?i)\b(?:card|visa|credit|payment)\b", r"(?i)\b(?:tel|phone|call|mobile|fax)\b")
CONTEXT, FEATURES = 24, 14 + len(CUES)


def matches(text: Column, pattern: str, some: Column | None = None) -> Column:
    """array<struct<s, e, m>> of all matches: code points before, up to the end, and the match. None is sought where `some` doesn't hold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.when(text.rlike(pattern) if some is None else some & text.rlike(pattern), F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(empty)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    back = F.reverse(digits(m))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return (F.length(back) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), add) % 10 == 0)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def spans_of(kind: str, found: Column) -> Column:
    """array<struct<kind, s, e>>: kind as its place in KINDS."""
    return F.transform(found, lambda x: F.struct(F.lit(ALL.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def base_columns(text: Column) -> dict[str, Column]:
    def base(kind: str) -> Column:
        return spans_of(kind, F.filter(matches(text, BASE[kind], F.col(f"some_{kind}")), lambda x: valid(kind, x["m"])))

    return {f"base_{k}": base(k) for k in KINDS}


def features(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    number = F.length(digits(m))
    flag = lambda c: c.cast("double")
    return [
        kind.cast("double"),
        F.length(m).cast("double"),
        number.cast("double"),
        F.length(F.regexp_replace(m, r"[^\x20().,/_-]", "")).cast("double"),
        F.size(F.split(m, "[^0-9]+")).cast("double"),
        F.length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
        flag(F.when(number.between(13, 19), luhn(m)).otherwise(False)),
        F.size(F.array_distinct(F.split(m, ""))).cast("double"),
        flag(F.when(kind == ALL.index("ip"), F.forall(F.split(m, "[^0-9]+"), lambda part: part.cast("int") <= 255)).otherwise(False)),
        flag(m.rlike("^[0-9a-f]+$")),
        flag(m.rlike("[a-z]") & m.rlike("[A-Z]")),
        flag(before.rlike("[=:]\\x20?[\"']?$")),
        flag(before.rlike("[A-Za-z0-9]$")),
        flag(after.rlike("^[A-Za-z0-9]")),
        *(flag(before.rlike(cue)) for cue in CUES),
    ]


def candidates(text: Column, kind: str, some: Column | None = None) -> Column:
    """array<struct<kind, s, e, assigned, x>> of the wide generator of a kind, with the features x."""

    def row(c: Column) -> Column:
        before = F.substring(text, F.greatest(c["s"] - CONTEXT, F.lit(0)) + 1, F.least(c["s"], F.lit(CONTEXT)))
        after = F.substring(text, c["e"] + 1, F.lit(1))
        assigned = before.rlike(ASSIGNED) if kind == "secret" else F.lit(False)
        return F.struct(F.lit(ALL.index(kind)).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), assigned.alias("assigned"), F.array(*features(F.lit(ALL.index(kind)), c["m"], before, after)).alias("x"))

    return F.transform(matches(text, WIDE[kind], some), row)


def with_candidates(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """carry, body (the text, or empty), base (all base spans) and wide (all candidates), by kind and then by start."""
    body = docs.select(*carry, F.coalesce("text", F.lit("")).alias("body"))
    body = body.select("*", *(F.col("body").rlike(HINTS[k]).alias(f"some_{k}") for k in ALL))
    found = body.select("*", *(c.alias(n) for n, c in base_columns(F.col("body")).items()), *(candidates(F.col("body"), k, F.col(f"some_{k}")).alias(f"wide_{k}") for k in ALL))
    return found.drop(*(f"some_{k}" for k in ALL)).select("*", F.concat(*(f"base_{k}" for k in KINDS)).alias("base"), F.concat(*(f"wide_{k}" for k in ALL)).alias("wide"))


def learnt(docs: DataFrame) -> DataFrame:
    """x, y of all candidates, and kind, before, m, after of all base spans (their context and themselves; x is null), each once with its number n."""
    is_base = lambda c: F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["s"] == c["s"]) & (b["e"] == c["e"]))
    text = lambda s, n: F.substring("body", s + 1, n)
    row = lambda *v: F.struct(*(c.cast(t).alias(k) for c, (k, t) in zip(v, (("x", "array<double>"), ("y", "int"), ("kind", "int"), ("before", "string"), ("m", "string"), ("after", "string")), strict=True)))
    none = F.lit(None)
    known = F.transform("wide", lambda c: row(c["x"], is_base(c) | c["assigned"], none, none, none, none))
    near = F.transform("base", lambda b: row(none, none, b["kind"], text(F.greatest(b["s"] - CONTEXT, F.lit(0)), F.least(b["s"], F.lit(CONTEXT))), text(b["s"], b["e"] - b["s"]), text(b["e"], F.lit(CONTEXT))))
    return with_candidates(docs, []).select(F.explode(F.concat(known, near)).alias("r")).select("r.*").groupBy("x", "y", "kind", "before", "m", "after").agg(F.count(F.lit(1)).alias("n"))


def rewritings(near: DataFrame) -> DataFrame:
    """x, y and n of the candidates of each kind in rewritten base spans, within their context: true are those that are the whole span of a true rewriting."""
    out = []
    changed = lambda steps: F.regexp_replace("m", *steps[0]) != F.col("m")  # noqa: E731 (a number that ends in 9 stays true where its end becomes 9)
    for kind, rules in REWRITTEN.items():
        own = near.filter(F.col("kind") == KINDS.index(kind))
        new = own.select("before", "after", "n", F.explode(F.array(*(F.struct(reduce(lambda m, step: F.regexp_replace(m, *step), steps, F.col("m")).alias("new"), F.lit(true).alias("kept"), (F.lit(true) | changed(steps)).alias("told")) for steps, true in rules))).alias("r"), "m").select("before", "after", "n", "r.*", "m").filter("told and new <> m")
        text = new.select("kept", "n", F.concat("before", "new", "after").alias("body"), F.length("before").alias("s"), (F.length("before") + F.length("new")).alias("e"))
        c = text.select("s", "e", "kept", "n", F.explode(candidates(F.col("body"), kind)).alias("c")).filter("c.s < e AND s < c.e")  # other data in the context tells nothing
        out.append(c.select(F.col("c.x").alias("x"), (F.col("kept") & (F.col("c.s") == F.col("s")) & (F.col("c.e") == F.col("e"))).cast("int").alias("y"), "n"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def fit(docs: DataFrame) -> tuple[boosting.Trees, list[float]]:
    """Trees, and for each kind the margin from which a candidate is accepted (infinite if no threshold is precise enough)."""
    scratch = Scratch()
    found = scratch.keep(learnt(docs.select("text")), "learnt")
    data = found.filter("x is not null").select("x", "y", "n").union(rewritings(found.filter("x is null"))).groupBy("x", "y").agg(F.sum("n").alias("n"))
    held = F.pmod(F.xxhash64(F.lit("held"), "x"), F.lit(3)) == 2
    data = scratch.keep(data.select("x", "y", "n", held.alias("held"), F.col("x")[0].cast("int").alias("part")), "vectors")
    trees, margins = boosting.fit_table(scratch, data, FEATURES, trees=40, depth=4)
    scratch.drop()
    limits = []
    for k in range(len(ALL)):
        own = np.array(sorted(((-level, y, n) for part, level, y, n in margins if part == k)), float).reshape(-1, 3)
        values, place = np.unique(own[:, 0], return_inverse=True)
        true, n = np.bincount(place, own[:, 1] * own[:, 2], len(values)), np.bincount(place, own[:, 2], len(values))
        values = -values / (1 << boosting.MARGIN_SCALE)
        good = np.flatnonzero((np.cumsum(true) >= PRECISION * np.cumsum(n)) & (values > 0))
        below = values[good[-1] + 1 :][:1] if len(good) else []  # midway to the first candidate that would spoil the precision, but not below even odds
        limits.append(float(max(0.0, (values[good[-1]] + below[0]) / 2)) if len(below) else 0.0 if len(good) else float("inf"))
    return trees, limits


def personal_data(docs: DataFrame, model: tuple[boosting.Trees, list[float]], carry: list[Column]) -> DataFrame:
    """carry, body, base and spans: array<struct<kind, s, e>> of base and added spans, by kind and then by start."""
    trees, limits = model
    found = with_candidates(docs, carry)
    limit = F.array(*(F.lit(float(v)) for v in limits))
    free = F.filter("wide", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    scored = F.transform("free", lambda c: F.struct((-trees.column([c["x"][i] for i in range(FEATURES)])).alias("score"), c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["assigned"].alias("assigned")))
    wanted = F.array_sort(F.filter("scored", lambda c: c["assigned"] | (-c["score"] >= F.element_at(limit, c["kind"] + 1))))
    span = lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))
    none = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    add = lambda acc, c: F.when(F.exists(acc, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])), acc).otherwise(F.concat(acc, F.array(span(c))))
    found = found.select("*", free.alias("free")).select("*", scored.alias("scored"))
    return found.select("*", F.when(F.size("free") > 0, F.array_sort(F.concat("base", F.aggregate(wanted, none, add)))).otherwise(F.col("base")).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(body: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by the name of its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        apart = x["s"] >= acc["at"]
        piece = F.array(F.substring(body, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.when(apart, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body))))
    return F.when(F.size(spans) > 0, done).otherwise(body)


def redact(docs: DataFrame, model: tuple[boosting.Trees, list[float]]) -> DataFrame:
    """The documents, all their columns, with redacted texts; null texts stay null."""
    inner = docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)), docs["text"].alias("text"))
    at = docs.columns.index("text")
    found = personal_data(inner, model, [F.col(f"c{i}") for i in range(len(docs.columns))])
    new = F.when(F.col(f"c{at}").isNotNull(), redacted(F.col("body"), F.col("spans"))).alias(f"c{at}")
    return found.select(*(new if i == at else F.col(f"c{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, fit(docs), [F.col("doc_id")])
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
