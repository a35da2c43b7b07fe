"""Structured Streaming twins: note pairing with open notes as state, and phrases by session and tumbling windows.

A tick axis becomes event time by taking a tick as a millisecond from the epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRED = "piece_id bigint, voice int, pitch int, start bigint, dur bigint"
OPEN = "since bigint"


def event_time(tick: Column) -> Column:
    return F.timestamp_millis(tick)


def pair_notes(messages: DataFrame) -> DataFrame:
    """Notes from a stream of (piece_id, voice, pitch, tick, on), in order for each pitch: the state is the open note.

    An off without an open note is passed over, a second on takes the place of the first, and what is open at the end is dropped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        out = []
        for part in parts:
            for r in part.sort_values(["tick", "on"]).itertuples(index=False):
                if r.on:
                    since = int(r.tick)
                elif since is not None:
                    if r.tick > since:
                        out.append((*key, since, int(r.tick) - since))
                    since = None
        if since is None:
            state.remove() if state.exists else None
        else:
            state.update((since,))
        yield pd.DataFrame(out, columns=["piece_id", "voice", "pitch", "start", "dur"])

    return messages.groupBy("piece_id", "voice", "pitch").applyInPandasWithState(step, PAIRED, OPEN, "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(notes: DataFrame, width: int = 3840, late: int = 60_000) -> DataFrame:
    """Notes and mean pitch of each piece in tumbling windows of `width` ticks; rows later than `late` ticks are passed over."""
    timed = notes.withColumn("at", event_time(F.col("start"))).withWatermark("at", f"{late} milliseconds")
    out = timed.groupBy("piece_id", F.window("at", f"{width} milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("pitch").alias("mean_pitch"))
    return out.select("piece_id", F.unix_millis("w.start").alias("from_tick"), "n", F.round("mean_pitch", 9).alias("mean_pitch"))


def phrases(notes: DataFrame, gap: int = 480, late: int = 60_000) -> DataFrame:
    """Phrases of each voice: onsets that follow each other within `gap` ticks, as session windows."""
    timed = notes.withColumn("at", event_time(F.col("start"))).withWatermark("at", f"{late} milliseconds")
    out = timed.groupBy("piece_id", "voice", F.session_window("at", f"{gap} milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("piece_id", "voice", F.unix_millis("w.start").alias("from_tick"), F.unix_millis("w.end").alias("to_tick"), "n")


def constraint_state(tokens: DataFrame, ring: int = 32) -> DataFrame:
    """For a stream of (seq_id, pos, token): after each token the count, the run of equal tokens and the last `ring` tokens."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, run, recent = (state.get[0], state.get[1], list(state.get[2])) if state.exists else (0, 0, [])
        out = []
        for part in parts:
            for r in part.sort_values("pos").itertuples(index=False):
                run = run + 1 if recent and recent[-1] == r.token else 1
                recent = [*recent[-(ring - 1) :], int(r.token)]
                n += 1
                out.append((*key, int(r.pos), n, run, recent))
        state.update((n, run, recent))
        yield pd.DataFrame(out, columns=["seq_id", "pos", "n", "run", "recent"])

    return tokens.groupBy("seq_id").applyInPandasWithState(step, "seq_id bigint, pos int, n int, run int, recent array<int>", "n int, run int, recent array<int>", "append", GroupStateTimeout.NoTimeout)
