"""Scores by file and by catalogue: a recursive scan of many extensions, and searches by (query, field) in order of priority.

A scan lists files through Spark, so any store that it reads will do, and never opens them. A search tests each entry against
all searches in one pass over the entries; what a path matched first, by the order of searches and then of entries, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaverlake.functions.pitch import lits
from quaverlake.plans.views import table

# The extensions that are scanned and the searches in order (what is sought, where, and the style that it gives).
EXTENSIONS = ["mid", "midi", "mxl", "musicxml", "xml", "krn", "mscz", "mscx", "abc", "ly", "mei", "cap", "capx"]
SEARCHES = [
    ("bach", "composer", "bach"),
    ("bach", "title", "bach"),
    ("palestrina", "composer", "renaissance"),
    ("monteverdi", "composer", "renaissance"),
    ("josquin", "composer", "renaissance"),
    ("ciconia", "composer", "renaissance"),
    ("luca", "composer", "renaissance"),
    ("trecento", "composer", "renaissance"),
    ("handel", "composer", "baroque"),
    ("corelli", "composer", "baroque"),
    ("cpebach", "composer", "baroque"),
    ("haydn", "composer", "classical"),
    ("mozart", "composer", "classical"),
    ("beethoven", "composer", "classical"),
    ("schubert", "composer", "classical"),
    ("schumann_robert", "composer", "classical"),
    ("schumann_clara", "composer", "classical"),
]
# End of fixed values.


def selected(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, work (the path without its extension) of the files that a scan takes: relative paths of a known extension (small letters)
    below no folder whose name begins with an underscore. Each path once."""
    own = F.col(path)
    known = F.regexp_extract(own, r"\.([^./]+)$", 1).isin(*EXTENSIONS)
    return paths.filter(known & ~own.rlike("(^|/)_[^/]*/")).select(own.alias("path"), F.regexp_replace(own, r"\.[^./]*$", "").alias("work")).distinct()


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The score files below a folder, with their sizes: path (relative), work, length."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root).select("path", "length")
    base = root.rstrip("/").removeprefix("file:")
    relative = files.select(F.regexp_replace("path", rf"^[a-z0-9]*:?/*\Q{base.lstrip('/')}\E/", "").alias("path"), "length")
    return selected(relative).join(relative, "path")


def searched(entries: DataFrame) -> DataFrame:
    """path, style, search (its place, from 0) of entries (entry, path, composer, title): each path under the first search that finds one of its entries."""
    found = F.coalesce(*(F.when(F.contains(F.lower(field), F.lit(query)), i) for i, (query, field, _) in enumerate(SEARCHES)))
    first = entries.select("path", "entry", found.alias("search")).filter("search IS NOT NULL").groupBy("path").agg(F.min(F.struct("search", "entry")).alias("m"))
    return first.select("path", lits([s for _, _, s in SEARCHES])[F.col("m.search")].alias("style"), F.col("m.search").alias("search"), F.col("m.entry").alias("entry"))


#: Folders, endings, composers and titles that the fixture's paths and entries are made of.
FOLDERS = ["bach", "_generated", "kern/haydn", "Motets/josquin", "misc/_old/x", "mozart"]
ENDINGS = ["mid", "midi", "krn", "MID", "txt", "xml", "abc", "pdf", "ly", "separated.mid", "mei"]
COMPOSERS = ["J. S. Bach", "Luca Marenzio", "Haydn, Joseph", "unknown", "CPEBach", "W. A. Mozart", "trecento anon.", "Clara Schumann_Clara"]
TITLES = ["Fugue in C", "Variations on a theme by BACH", "Motet", "Quartet"]


def pick(values: list, by: Column) -> Column:
    return F.element_at(lits(values), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a scan takes of a listing with a path for every document."""
    d = F.col("doc_id")
    return selected(table(spark, sf_dir, "documents").select(F.concat(pick(FOLDERS, d), F.lit("/w"), F.floor(d / 3).cast("string"), F.lit("."), pick(ENDINGS, d)).alias("path")))


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the searches find in a catalogue with an entry for every document, three entries to a path."""
    d = F.col("doc_id")
    return searched(table(spark, sf_dir, "documents").select(d.alias("entry"), F.concat(F.lit("corpus/"), F.floor(d / 3).cast("string")).alias("path"), pick(COMPOSERS, d * 5 + F.floor(d / 7)).alias("composer"), pick(TITLES, F.floor(d / 5)).alias("title")))


QUERIES = {f.__name__: f for f in (file_scan, catalogue_search)}


def pick_sql(values: list, by: str) -> str:
    return f"({values})[CAST(({by}) % {len(values)} AS INT) + 1]"


SQL = {
    "file_scan": f"""WITH p AS (SELECT DISTINCT {pick_sql(FOLDERS, 'doc_id')} || '/w' || (doc_id // 3) || '.' || {pick_sql(ENDINGS, 'doc_id')} AS path FROM documents)
SELECT path, left(path, length(path) - length(string_split(path, '.')[-1]) - 1) AS work FROM p WHERE list_contains({EXTENSIONS}, string_split(path, '.')[-1]) AND len(list_filter(string_split(path, '/')[:-2], lambda x: starts_with(x, '_'))) = 0""",
    "catalogue_search": f"""WITH e AS (SELECT doc_id AS entry, 'corpus/' || (doc_id // 3) AS path, {pick_sql(COMPOSERS, 'doc_id * 5 + doc_id // 7')} AS composer, {pick_sql(TITLES, 'doc_id // 5')} AS title FROM documents),
s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{q}', '{f}', '{s}')" for i, (q, f, s) in enumerate(SEARCHES))}) v(search, query, field, style)),
m AS (SELECT path, style, search, entry, row_number() OVER (PARTITION BY path ORDER BY search, entry) AS r FROM e JOIN s ON contains(lower(CASE field WHEN 'title' THEN title ELSE composer END), query)) SELECT path, style, CAST(search AS INT) AS search, entry FROM m WHERE r = 1""",
}
