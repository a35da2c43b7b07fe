"""Humdrum **kern scores: whole text files to note rows, with a reason where a file gives none.

Files are read by Spark (any store it can read), names are filtered before the text is opened, and each file is parsed on
its own in a worker. A map of spines follows splits, joins, exchanges, new and ending spines, so that each column always knows
its part, its time and its open tie. Parts with too few or too many spines, error pages and broken files are named as reasons, not dropped silently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaverlake.plans.views import NOTES_SQL
from quaverlake.plans.views import notes as fixture

QUARTER = 480
NOTES = "array<struct<voice:int,start:bigint,dur:bigint,pitch:int>>"
SCHEMA = f"reason string, ts_num int, ts_den int, notes {NOTES}"
#: Semitones of note letters, parts of names of derived files, what an error page says; fixed values.
LETTERS = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}
DERIVED = ["-auto", "-combined", "-beat", "-sampled", "-pan", "-nopan", "extractf", "-20", "-60", "-80", "-S"]
ERROR_PAGE = ["<html", "access unsuccessful"]


class Broken(ValueError):
    """A score whose lines don't fit its spines."""


@dataclass
class Column:
    """One column of the score at a line: its part (None unless kern), the time reached in quarters, and the note that a tie holds open."""

    part: int | None
    at: Fraction = Fraction(0)
    tied: dict[int, list] = field(default_factory=dict)

    def split(self) -> list[Column]:
        return [self, Column(self.part, self.at, dict(self.tied))]


def length_of(token: str) -> Fraction:
    """Quarters of a data token: the reciprocal with dots; 0 is a breve, 00 a long; grace notes and tokens without a number have none."""
    found = re.search(r"(\d+)(?:%(\d+))?(\.*)", token)
    if not found or "q" in token or "Q" in token:
        return Fraction(0)
    number, over, dots = found[1], int(found[2] or 1), len(found[3])
    whole = Fraction(8 << (len(number) - 1)) if set(number) == {"0"} else Fraction(4 * over, int(number))
    return whole * (2 - Fraction(1, 1 << dots))


def pitch_of(token: str) -> int | None:
    note = re.search(r"([A-Ga-g]+)([#-]*)", token)
    if not note or "r" in token:
        return None
    letter, k = note[1][0], len(note[1])
    octave = 3 + k if letter.islower() else 4 - k
    return 12 * (octave + 1) + LETTERS[letter.lower()] + note[2].count("#") - note[2].count("-")


def turned(columns: list[Column], cells: list[str], kern_parts: list[int]) -> list[Column]:
    """The columns after a line of spine manipulators."""
    out, i, swap = [], 0, [k for k, c in enumerate(cells) if c == "*x"]
    if len(swap) % 2:
        raise Broken("exchange")
    columns = list(columns)
    for a, b in zip(swap[::2], swap[1::2], strict=True):
        columns[a], columns[b] = columns[b], columns[a]
    while i < len(cells):
        cell, own = cells[i], columns[i]
        if cell == "*^":
            out += own.split()
        elif cell == "*v":
            last = i
            while last + 1 < len(cells) and cells[last + 1] == "*v" and columns[last + 1].part == own.part:
                last += 1
            for other in columns[i + 1 : last + 1]:
                own.at = max(own.at, other.at)
                own.tied = other.tied | own.tied
            out.append(own)
            i = last
        elif cell == "*+":
            out += [own, Column(None, min((c.at for c in columns if c.part is not None), default=own.at))]  # at the line's time
        elif cell.startswith("**"):
            if cell == "**kern" and own.part is None:
                own.part = len(kern_parts)
                kern_parts.append(own.part)
            out.append(own)
        elif cell != "*-":
            out.append(own)
        i += 1
    return out


def notes_in(text: str, least: int, most: int) -> tuple[str | None, tuple[int, int] | None, list[tuple[int, int, Fraction, Fraction, int]]]:
    """(reason, meter, notes (voice, order, start, length, pitch)) of a score."""
    columns: list[Column] | None = None
    parts: list[int] = []
    notes: list[list] = []
    meter = None
    for line in text.splitlines():
        cells = line.split("\t")
        if not line or line.startswith("!"):
            continue
        if columns is None:
            if not cells[0].startswith("**"):
                continue
            columns = [Column(None) for _ in cells]
            turned(columns, cells, parts)
            if len(parts) < least:
                return "few_parts", None, []
            if len(parts) > most:
                return "many_parts", None, []
            continue
        if len(cells) != len(columns):
            raise Broken("columns")
        if cells[0].startswith("*"):
            for c in cells:
                if (m := re.fullmatch(r"\*M(\d+)/(\d+)", c)) and meter is None:
                    meter = (int(m[1]), int(m[2]))
            columns = turned(columns, cells, parts)
        elif not cells[0].startswith("="):
            for column, cell in zip(columns, cells, strict=True):
                if column.part is None or cell == ".":
                    continue
                token = cell.split(" ")[0]  # of a chord the first note counts
                length, pitch = length_of(token), pitch_of(token)
                if pitch is not None and length:
                    held = column.tied.pop(pitch, None) if "_" in token or "]" in token else None
                    if held is None:
                        held = [column.part, len(notes), column.at, length, pitch]
                        notes.append(held)
                    else:
                        held[3] += length
                    if "[" in token or "_" in token:
                        column.tied[pitch] = held
                column.at += length
    if columns is None:
        return "few_parts", None, []
    return None, meter, [(len(parts) - 1 - part, *rest) for part, *rest in notes]


def parse(text: str | None, least: int = 2, most: int = 4) -> tuple:
    """(reason, meter, notes): ok, error_page, few_parts, many_parts, few_voices (fewer than `least` parts sound) or error:<name>.

    Voices count from the highest spine, which stands last in a score; a part that is added later counts as the highest.
    """
    if text is None or len(text) < 32 or any(x in text[:4096].lower() for x in ERROR_PAGE):
        return ("error_page", None, None, [])
    try:
        reason, meter, found = notes_in(text, least, most)
    except (Broken, ValueError, ZeroDivisionError) as e:
        return (f"error:{type(e).__name__}", None, None, [])
    if reason:
        return (reason, None, None, [])
    if len({n[0] for n in found}) < least:
        return ("few_voices", None, None, [])
    ticks = lambda x: int(x * QUARTER)
    rows = sorted((voice, ticks(start), i, ticks(length), pitch) for voice, i, start, length, pitch in found if ticks(length) > 0)
    return ("ok", *(meter or (4, 4)), [{"voice": v, "start": s, "dur": d, "pitch": p} for v, s, _, d, p in rows])


def skipped(path):
    """Files that were derived from others, and those in folders whose names begin with an underscore."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    derived = F.lit(False)
    for part in DERIVED:
        derived = derived | name.contains(part)
    return derived | path.rlike(r"(^|/)_[^/]*/")


def scores_of(files: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """path, reason, ts_num, ts_den, notes of rows (path, value)."""
    udf = F.udf(lambda t: parse(t, least, most), SCHEMA, useArrow=True)
    read = files.filter(~skipped(F.col("path"))).select("path", udf("value").alias("p")).select("path", "p.*")
    empty = F.array().cast(NOTES)
    return read.unionByName(files.filter(skipped(F.col("path"))).select("path", F.lit("name").alias("reason"), F.lit(None).cast("int").alias("ts_num"), F.lit(None).cast("int").alias("ts_den"), empty.alias("notes")))


def read_kern(spark: SparkSession, path: str, least: int = 2, most: int = 4) -> DataFrame:
    """path, composer (its folder), reason, ts_num, ts_den and notes of each file below a folder."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.krn").load(path)
    out = scores_of(files.select(F.col("_metadata.file_path").alias("path"), "value"), least, most)
    return out.select("path", F.element_at(F.split("path", "/"), -2).alias("composer"), "reason", "ts_num", "ts_den", "notes")


def note_rows(scores: DataFrame) -> DataFrame:
    """One row a note: path, voice, note_idx, start, dur, pitch."""
    flat = scores.filter("reason = 'ok'").select("path", F.posexplode("notes").alias("i", "n")).select("path", "i", "n.*")
    return flat.select("path", "voice", (F.row_number().over(W.partitionBy("path", "voice").orderBy("start", "i")) - 1).alias("note_idx"), "start", "dur", "pitch")


def drop_reasons(scores: DataFrame) -> DataFrame:
    return scores.groupBy("composer", "reason").agg(F.count(F.lit(1)).alias("files"))


#: Ticks of a page: a piece is cut into scores of so many, so that no score grows with its piece.
PAGE = 1 << 15


def written_scores(n: DataFrame) -> DataFrame:
    """path and value: notes (piece_id, voice 0 to 3, start, dur, pitch) as scores in which voices 0 and 1 share a spine that is split and joined again.

    Lines are a sixty-fourth apart where something begins; a note is written with its length in quarters over four.
    """
    note = F.struct(F.col("start").cast("bigint").alias("start"), "voice", F.col("dur").cast("bigint").alias("dur"), "pitch")
    page = n.withColumn("page", F.floor(F.col("start") / PAGE).cast("bigint")).groupBy("piece_id", "page").agg(F.array_sort(F.collect_list(note)).alias("notes"))
    return page.select(F.format_string("x/%d/%d.krn", "piece_id", "page").alias("path"), F.udf(score_text, "string")("notes", F.col("page") * PAGE).alias("value"))


def score_text(notes: list, begin: int) -> str:
    """A score of three parts of notes (start, voice, dur, pitch); each voice gets rests where it is silent."""
    streams: list[list[tuple[int, str]]] = [[] for _ in range(4)]
    now = [begin] * 4
    last = max((s + d for s, _, d, _ in notes), default=begin)
    for s, v, d, p in notes:
        if s > now[v]:
            streams[v].append((now[v], reciprocal(s - now[v]) + "r"))
        streams[v].append((s, reciprocal(d) + name_of(p)))
        now[v] = s + d
    for v in range(4):
        if now[v] < last:
            streams[v].append((now[v], reciprocal(last - now[v]) + "r"))
    at = sorted({t for s in streams for t, _ in s})
    cell = [dict(s) for s in streams]
    lines = ["!!!OTL: page", "**kern\t**kern\t**kern", "*M4/4\t*M4/4\t*M4/4", "=1\t=1\t=1", "*\t*\t*^"]
    lines += ["\t".join(cell[v].get(t, ".") for v in (3, 2, 1, 0)) for t in at]
    return "\n".join([*lines, "*\t*\t*v\t*v", "*-\t*-\t*-", ""])


def reciprocal(ticks: int) -> str:
    """A length as a rational reciprocal of a whole note."""
    whole = Fraction(4 * QUARTER, ticks)
    return f"{whole.numerator}%{whole.denominator}" if whole.denominator > 1 else str(whole.numerator)


def name_of(pitch: int) -> str:
    """The name of a pitch with sharps."""
    octave, pc = divmod(pitch, 12)
    letter = next(x for x, v in reversed(LETTERS.items()) if v <= pc)
    name = letter * (octave - 4) if octave > 4 else letter.upper() * (5 - octave)
    return name + "#" * (pc - LETTERS[letter])


def kern_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of all pieces as they come back from scores in which two voices split from one spine: those two are one part, 0."""
    back = note_rows(scores_of(written_scores(fixture(spark, sf_dir)), least=1))
    return back.select(F.split("path", "/")[1].cast("bigint").alias("piece_id"), "voice", (F.col("start") + F.regexp_extract("path", r"/(\d+)\.krn$", 1).cast("bigint") * PAGE).alias("start"), "dur", "pitch")


QUERIES = {"kern_round_trip": kern_round_trip}
SQL = {"kern_round_trip": f"WITH {NOTES_SQL} SELECT piece_id, CAST(greatest(voice - 1, 0) AS INT) AS voice, CAST(start AS BIGINT) AS start, CAST(dur AS BIGINT) AS dur, pitch FROM n"}
