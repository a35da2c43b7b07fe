"""Standard MIDI files as a source and a sink, without a MIDI library.

`midi` is a Python data source. Its reader makes one partition of about BUNDLE bytes of files and gives a row for each message,
with absolute ticks; a file that can't be read gives one row with a reason. Its writer makes a file of each path: tasks write under
names of their own, and the driver's commit moves what finished tasks wrote into place, so that a task that is lost or run
twice leaves nothing behind. Paths are those of pyarrow's file systems (a shared folder, hdfs://, s3://). Where only Spark's
readers reach a store, `read_binary` parses what binaryFile reads.

Messages become notes by windows: an off ends the latest on of its track and pitch, a second on takes the place of the first,
an on without velocity is an off, empty notes go.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quaverlake.operators.histograms import class_counts, key_of, keys_sql
from quaverlake.plans.views import NOTES_SQL
from quaverlake.plans.views import notes as fixture

MESSAGES = "path string, reason string, division int, track int, seq int, tick bigint, kind string, channel int, a int, b int"
BODY = "reason string, division int, messages array<struct<track:int,seq:int,tick:bigint,kind:string,channel:int,a:int,b:int>>"
NOTES = "path string, track int, start bigint, dur bigint, pitch int, velocity int"
#: Bytes of files that one task reads; velocity of written notes; microseconds of a quarter.
BUNDLE, VELOCITY, TEMPO, DIVISION = 8 << 20, 80, 500_000, 480
#: Channel messages by the upper half of their status byte, and how many data bytes they have; fixed values.
CHANNEL = {0x8: ("off", 2), 0x9: ("on", 2), 0xA: ("pressure", 2), 0xB: ("control", 2), 0xC: ("program", 1), 0xD: ("touch", 1), 0xE: ("bend", 2)}
#: Meta messages that are kept, by their type; fixed values.
META = {0x2F: "end", 0x51: "tempo", 0x58: "meter", 0x59: "key"}


class Broken(ValueError):
    """A file that isn't a MIDI file, or ends too early."""


def length_of(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number, and where it ends."""
    value = 0
    for i in range(at, min(at + 4, len(data))):
        value = value << 7 | data[i] & 0x7F
        if data[i] < 0x80:
            return value, i + 1
    raise Broken("number without end")


def written_length(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def track_messages(data: bytes) -> Iterator[tuple[int, str, int | None, int, int]]:
    """(tick, kind, channel, a, b) of a track's bytes. a and b are the data bytes; of a tempo the microseconds, of a meter its two
    numbers, of a key its sharps and whether it is minor. Messages of the system have no row."""
    at = tick = 0
    status = None
    while at < len(data):
        delta, at = length_of(data, at)
        tick += delta
        if at >= len(data):
            raise Broken("message without end")
        if data[at] == 0xFF:
            if at + 1 >= len(data):
                raise Broken("message without end")
            kind = META.get(data[at + 1])
            size, at = length_of(data, at + 2)
            body, at, status = data[at : at + size], at + size, None
            if len(body) < size:
                raise Broken("message without end")
            if kind == "tempo" and size == 3:
                yield tick, kind, None, int.from_bytes(body, "big"), 0
            elif kind == "meter" and size >= 2:
                yield tick, kind, None, body[0], 1 << body[1]
            elif kind == "key" and size == 2:
                yield tick, kind, None, struct.unpack("b", body[:1])[0], body[1]
            elif kind == "end":
                yield tick, kind, None, 0, 0
                return
        elif data[at] in (0xF0, 0xF7):
            size, at = length_of(data, at + 1)
            at, status = at + size, None
        elif data[at] > 0xF0:
            raise Broken("message of the system in a track")
        else:
            if data[at] >= 0x80:
                status, at = data[at], at + 1
            if status is None:
                raise Broken("running status without a status")
            kind, n = CHANNEL[status >> 4]
            body, at = data[at : at + n], at + n
            if len(body) < n or max(body) > 0x7F:
                raise Broken("message without end")
            yield tick, "off" if kind == "on" and not body[1] else kind, status & 15, body[0], body[1] if n == 2 else 0


def parse(data: bytes | None) -> tuple[str | None, int | None, list[tuple]]:
    """(reason, division, messages (track, seq, tick, kind, channel, a, b)); a reason comes without messages."""
    try:
        if data is None or data[:4] != b"MThd" or len(data) < 14:
            raise Broken("no header")
        size, _, tracks, division = struct.unpack(">IHHH", data[4:14])
        if division & 0x8000 or not division:
            raise Broken("time by frames")
        at, out, track = 8 + size, [], 0
        while at + 8 <= len(data) and track < tracks:
            name, size = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
            body, at = data[at + 8 : at + 8 + size], at + 8 + size
            if name != b"MTrk":
                continue
            if len(body) < size:
                raise Broken("track without end")
            out += [(track, i, *m) for i, m in enumerate(track_messages(body))]
            track += 1
        if track < tracks:
            raise Broken("tracks missing")
        return None, division, out
    except Broken as e:
        return str(e), None, []


def built(tracks: list[list[tuple[int, int, int, int]]], division: int = DIVISION, tempo: int = TEMPO) -> bytes:
    """A file of tracks of notes (start, dur, pitch, velocity): off before on at a tick, the tempo in the first track, a channel each."""
    out = [b"MThd", struct.pack(">IHHH", 6, 1, len(tracks), division)]
    for k, track in enumerate(tracks):
        events = sorted(e for s, d, p, v in track for e in ((s, 1, p, v), (s + d, 0, p, 0)))
        body, now = [b"\x00\xff\x51\x03" + tempo.to_bytes(3, "big")] if k == 0 else [], 0
        for tick, on, p, v in events:
            body.append(written_length(tick - now) + bytes(((0x90 if on else 0x80) | k % 16, p, v)))
            now = tick
        body.append(b"\x00\xff\x2f\x00")
        whole = b"".join(body)
        out += [b"MTrk", struct.pack(">I", len(whole)), whole]
    return b"".join(out)


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Files(InputPartition):
    paths: list[str]


class MidiReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """Files below the path whose names end in mid or midi, by name, in bundles of about BUNDLE bytes."""
        from pyarrow import fs

        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out, held = [Files([])], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.extension.lower() in ("mid", "midi")), key=lambda f: f.path):
            if held + f.size > BUNDLE and out[-1].paths:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                reason, division, messages = parse(f.read())
            if reason:
                yield path, reason, None, None, None, None, None, None, None, None
            for m in messages:
                yield path, None, division, *m


@dataclass
class Moved(WriterCommitMessage):
    names: list[tuple[str, str]]


class MidiWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.stage, self.overwrite = path, f"_writing-{uuid.uuid4().hex}", overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        """Files of rows (path, track, start, dur, pitch, velocity) that come sorted by path."""
        import itertools

        system, root = filesystem(self.path)
        folder, names = f"{root}/{self.stage}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        for path, rows in itertools.groupby(iterator, key=lambda r: r["path"]):
            tracks: dict[int, list[tuple]] = {}
            for r in rows:
                tracks.setdefault(r["track"], []).append((r["start"], r["dur"], r["pitch"], r["velocity"]))
            name = f"{folder}/{len(names)}.mid"
            with system.open_output_stream(name) as f:
                f.write(built([tracks[t] for t in sorted(tracks)]))
            names.append((name, f"{root}/{path}"))
        return Moved(names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = filesystem(self.path)
        for message in messages:
            for name, path in message.names if message else ():
                if not self.overwrite and system.get_file_info(path).type != fs.FileType.NotFound:
                    raise FileExistsError(path)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                system.move(name, path)
        system.delete_dir(f"{root}/{self.stage}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class MidiSource(DataSource):
    """spark.read.format("midi").load(path) gives MESSAGES; write.format("midi") takes NOTES whose rows of a path stand together."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return MidiReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MidiWriter(self.options["path"], overwrite)


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MidiSource)
    return spark.read.format("midi").load(path)


def parsed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Messages of files that stand as bytes in a column."""
    udf = F.udf(parse, BODY)
    p = files.select(F.col(path).alias("path"), udf(content).alias("p"))
    return p.select("path", "p.reason", "p.division", F.explode_outer("p.messages").alias("m")).select("path", "reason", "division", "m.*")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{mid,midi,MID,MIDI}").load(path))


def notes_of(messages: DataFrame) -> DataFrame:
    """path, track, start, dur, pitch, velocity of messages."""
    m = messages.filter("kind IN ('on', 'off')")
    w = W.partitionBy("path", "track", "a").orderBy("seq")
    m = m.withColumn("was", F.lag("kind").over(w)).withColumn("since", F.lag("tick").over(w)).withColumn("v", F.lag("b").over(w))
    return m.filter("kind = 'off' AND was = 'on' AND tick > since").select("path", "track", F.col("since").alias("start"), (F.col("tick") - F.col("since")).alias("dur"), F.col("a").alias("pitch"), F.col("v").alias("velocity"))


def write_midi(n: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each path (relative, with its extension) of notes (path, track, start, dur, pitch and velocity, or that of VELOCITY)."""
    velocity = F.col("velocity").cast("int") if "velocity" in n.columns else F.lit(VELOCITY)
    rows = n.select("path", F.col("track").cast("int").alias("track"), F.col("start").cast("bigint").alias("start"), F.col("dur").cast("bigint").alias("dur"), F.col("pitch").cast("int").alias("pitch"), velocity.alias("velocity"))
    n.sparkSession.dataSource.register(MidiSource)
    rows.repartition("path").sortWithinPartitions("path", "track", "start", "pitch").write.format("midi").mode(mode).save(path)


def halves(n: DataFrame) -> DataFrame:
    """Voices of the notes of files: by track, from 0; a file of one track is split at its median pitch, notes from there up are voice 0."""
    per = n.groupBy("path").agg(F.countDistinct("track").alias("tracks"), F.percentile("pitch", 0.5).alias("middle"))
    rank = F.dense_rank().over(W.partitionBy("path").orderBy("track")) - 1
    half = F.when(F.col("pitch") >= F.col("middle"), 0).otherwise(1)
    return n.join(per, "path").withColumn("voice", F.when(F.col("tracks") == 1, half).otherwise(rank).cast("int")).drop("tracks", "middle")


def pieces(n: DataFrame) -> DataFrame:
    """A row for each file: path, voices, notes, ticks, key_root, key_mode."""
    v = halves(n)
    keys = key_of(class_counts(v, ["path"]), ["path"])
    return v.groupBy("path").agg(F.countDistinct("voice").alias("voices"), F.count(F.lit(1)).alias("notes"), F.max(F.col("start") + F.col("dur")).alias("ticks")).join(keys.drop("corr"), "path")


#: Ticks of a take: a piece is cut into files of so many, so that no file grows with its piece.
TAKE = 1 << 17


def takes(n: DataFrame) -> DataFrame:
    """path and content: the pieces as bytes of MIDI files, one for each TAKE ticks of a piece."""
    note = F.struct("voice", F.col("start").cast("bigint").alias("start"), F.col("dur").cast("bigint").alias("dur"), "pitch")
    files = n.withColumn("take", F.floor(F.col("start") / TAKE).cast("bigint")).groupBy("piece_id", "take").agg(F.array_sort(F.collect_list(note)).alias("notes"))

    def bytes_of(notes: list, voices: int = 4) -> bytes:
        tracks: list[list[tuple]] = [[] for _ in range(voices)]
        for v, s, d, p in notes:
            tracks[v].append((s, d, p, VELOCITY))
        return built(tracks)

    return files.select(F.format_string("%d/%d.mid", "piece_id", "take").alias("path"), F.udf(bytes_of, "binary")("notes").alias("content"))


def midi_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes as they come back from MIDI files of all pieces."""
    back = notes_of(parsed(takes(fixture(spark, sf_dir))))
    return back.select(F.split("path", "/")[0].cast("bigint").alias("piece_id"), F.col("track").alias("voice"), "start", "dur", "pitch")


def midi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices, length and key of each piece, read from MIDI files of its upper voice alone, which is split at the median pitch."""
    upper = fixture(spark, sf_dir).filter("voice = 0")
    p = pieces(notes_of(parsed(takes(upper))).withColumn("path", F.split("path", "/")[0]))
    return p.select(F.col("path").cast("bigint").alias("piece_id"), "voices", "notes", "ticks", "key_root", "key_mode")


QUERIES = {f.__name__: f for f in (midi_round_trip, midi_pieces)}
SQL = {
    "midi_round_trip": f"WITH {NOTES_SQL} SELECT piece_id, voice, CAST(start AS BIGINT) AS start, CAST(dur AS BIGINT) AS dur, pitch FROM n",
    "midi_pieces": f"""WITH {NOTES_SQL}, u AS (SELECT * FROM n WHERE voice = 0), md AS (SELECT piece_id, quantile_cont(pitch, 0.5) AS middle FROM u GROUP BY 1),
ag AS (SELECT piece_id, count(DISTINCT pitch >= middle) AS voices, count(*) AS notes, CAST(max(start + dur) AS BIGINT) AS ticks FROM u JOIN md USING (piece_id) GROUP BY 1), k AS (WITH {keys_sql("u", "piece_id")})
SELECT ag.piece_id, voices, notes, ticks, key_root, key_mode FROM ag JOIN k ON k.piece_id = ag.piece_id""",
}
