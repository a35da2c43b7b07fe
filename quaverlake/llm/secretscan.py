r"""Operator 11: secret scans through a ledger of blobs, in DataFrame functions only.

Every historical version of every path is content-addressed by the SHA-256 of its text (null: empty). The ledger is a folder of
written runs; a row of a run has a blob, the pairs (rule and its version) that were looked for in it, and what they found. A
scan takes the distinct blobs of the versions it is given, drops the pairs that the ledger already holds, looks through one
copy of each blob that is left, for the rules that are left, and adds a run. Findings are then joined back from the ledger to
all paths. So a text is scanned once however many paths and versions hold it, a second scan of the same history scans
nothing, and a new rule, or a new version of one, is looked for in all blobs but the others aren't looked for again.

Copies are folded before they are shuffled (a hot text leaves each task once), and only addresses meet the ledger. Few new
blobs are told to the scan of the texts by a broadcast that Spark sizes; many by a join on the address. A run counts once
its writer has committed it, so an executor or a driver that is lost leaves nothing half done: the next scan does it again.

Three rules are the base (assign, access, hex), the others are the formats of tokens that their issuers publish, and long
tokens that mix cases and digits. Each is leftmost and non-overlapping by itself; matches that fail their check are dropped
and not retried. Spans may overlap between rules. Positions are code points, ends exclusive. Patterns match in linear time.
Repeated rows get equal results, empty texts none, an empty table no rows. Carried columns named blob or spans give way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.llm.common import new_path, table
from quaverlake.llm.pii import matches


@dataclass(frozen=True)
class Rule:
    """What is looked for: raise the version when the pattern or its check changes. `hint` is in every text that has a match."""

    kind: str
    version: int
    pattern: str
    hint: str
    valid: Callable[[Column], Column]

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


def at_least(n: int) -> Callable[[Column], Column]:
    return lambda m: F.length(m) >= n


def mixed(m: Column) -> Column:
    """32 and more characters with both cases, three digits and sixteen different characters: neither words nor plain numbers."""
    return (F.length(m) >= 32) & m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9].*[0-9]") & (F.size(F.array_distinct(F.split(m, ""))) >= 16)


ASSIGN = r"(?:password|passwd|secret|token|api_?key)"
RULES = (
    Rule("assign", 1, rf"(?i:{ASSIGN})[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++", rf"(?i:{ASSIGN})[\"'\x20:=]", lambda m: m.rlike("[A-Za-z0-9+/_.=-]{8,}$") & (F.length(F.regexp_extract(m, rf"(?i:{ASSIGN})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)) >= 8)),
    Rule("access", 1, r"AKIA[A-Z0-9]++", "AKIA", at_least(16)),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}+", "[0-9a-f]{32}", at_least(32)),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]++", "gh[oprsu]_", at_least(40)),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]++", "xox[abprs]-", at_least(20)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]++", "AIza", at_least(39)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", r"eyJ[A-Za-z0-9_-]+\.", at_least(40)),
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*+-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z0-9 ]*+-----", "-----BEGIN ", lambda m: m.rlike("^-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")),
    Rule("url", 1, r"://[^\s/:@\"'<>]++:[^\s/:@\"'<>]++@", "://", at_least(8)),
    Rule("mixed", 1, r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+", "[A-Za-z0-9_-]{32}", mixed),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<pair:string,s:int,e:int>>"


def body(text: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def address(text: str = "text") -> Column:
    """The content address of a version."""
    return F.sha2(body(text), 256)


def found_by(rule: Rule, text: Column) -> Column:
    valid = F.filter(matches(text, rule.pattern), lambda x: rule.valid(x["m"]))
    return F.transform(valid, lambda x: F.struct(F.lit(rule.pair).alias("pair"), x["s"].alias("s"), x["e"].alias("e")))


def runs(spark: SparkSession, folder: str) -> list[str]:
    """The committed runs of a ledger."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    every = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(p.toString() for p in every if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """blob, pairs, spans: what each committed run looked for, and found, in each blob."""
    schema = f"blob string, pairs array<string>, spans {SPANS}"
    done = runs(spark, folder)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def unseen(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """blob and pairs: what the ledger doesn't hold yet of the blobs of these versions."""
    spark = versions.sparkSession
    wanted = F.array(*(F.lit(r.pair) for r in rules))
    blobs = versions.select(address(text).alias("blob")).distinct()
    if not runs(spark, folder):
        return blobs.select("blob", wanted.alias("pairs"))
    seen = ledger(spark, folder).select("blob", F.explode("pairs").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
    left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", left.alias("pairs")).filter(F.size("pairs") > 0)


def scan(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Look through the blobs of these versions for the pairs that the ledger lacks, and add what is found to it as one run."""
    spark = versions.sparkSession
    copies = versions.select(address(text).alias("blob"), body(text).alias("body")).groupBy("blob").agg(F.max("body").alias("body"))
    if runs(spark, folder):
        path = new_path(spark, "unseen")
        unseen(versions, folder, rules, text).write.parquet(path)
        todo = spark.read.parquet(path)
        copies = copies.join(todo.select("blob"), "blob", "left_semi").join(todo, "blob")
    else:
        path, copies = None, copies.withColumn("pairs", F.array(*(F.lit(r.pair) for r in rules)))
    none = F.array().cast(SPANS)
    each = [F.when(F.array_contains("pairs", r.pair), found_by(r, F.col("body"))).otherwise(none) for r in rules]
    some = F.col("body").rlike("|".join(f"(?:{r.hint})" for r in rules))
    copies.select("blob", "pairs", F.when(some, F.concat(*each)).otherwise(none).alias("spans")).write.parquet(f"{folder}/run-{uuid.uuid4().hex}")
    if path:
        gone = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def findings(versions: DataFrame, folder: str, carry: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The carried columns of every version, its blob, and spans: array<struct<s, k, e>> by start and then by the rule's place.

    Only blobs with findings are joined; a version whose blob has none, or was never scanned, has an empty array.
    """
    carry = [c for c in carry if c not in ("blob", "spans")]
    paths = versions.select(*(versions[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)), address(text).alias("blob"))
    place = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.pair), F.lit(i))))
    of = ledger(versions.sparkSession, folder).filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("x"))
    known = of.select("blob", F.struct(F.col("x.s").alias("s"), place[F.col("x.pair")].alias("k"), F.col("x.e").alias("e")).alias("x")).filter("x.k IS NOT NULL")
    each = known.groupBy("blob").agg(F.array_sort(F.collect_set("x")).alias("spans"))
    spans = F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int>>"))
    return paths.join(each, "blob", "left").select(*(f"c{i}" for i in range(len(carry))), "blob", spans.alias("spans")).toDF(*carry, "blob", "spans")


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one version of one path; the ledger is new, so that every distinct text is scanned."""
    docs, folder = table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    scan(docs, folder)
    found = findings(docs, folder, ["doc_id"])
    number = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "blob")
