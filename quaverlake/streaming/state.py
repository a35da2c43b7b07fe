"""Streams whose state ends: a sequence's state goes with its EOS, or once no token has come for `idle` of event time.

Each operator keeps one value a sequence, reads it once a batch and writes it once. Tokens of a sequence come in order of pos over
the batches; within a batch they are put in order. Rows have an event time `at`. The batch forms are in `operators.decoder`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaverlake.operators.decoder import BAR, BUFFER

IDLE = 60_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ending(StatefulProcessor):
    """One value a key, cleared at EOS or when the watermark passes the last event time by `idle` milliseconds.

    Subclasses say the value's schema and what it is at the start, what a row does to it, and what is given when it ends.
    """

    SCHEMA = OUT = ""
    EOS: Any = "EOS"

    def __init__(self, idle: int = IDLE) -> None:
        self.idle = idle
        self.keys: list[str] = []

    def named(self, key: tuple, out: tuple) -> Row:
        return Row(*self.keys, *(c.split()[0] for c in self.OUT.split(", ")))(*key, *out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.SCHEMA)
        self.deadline = handle.getValueState("deadline", "at bigint")

    def start(self) -> list:
        raise NotImplementedError

    def step(self, state: list, row: Row) -> Iterator[tuple]:
        """Change the state by a row; give rows of what stands behind the key."""
        raise NotImplementedError

    def finish(self, state: list, pos: int | None) -> Iterator[tuple]:
        """What is given when the sequence ends: at the EOS at pos, or without one."""
        return iter(())

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = list(self.value.get()) if self.value.exists() else None
        latest = 0
        for row in sorted(rows, key=lambda r: r.pos):
            latest = max(latest, int(row.at.timestamp() * 1000))
            state = self.start() if state is None else state
            for out in self.step(state, row):
                yield self.named(key, out)
            if row.token == self.EOS:
                for out in self.finish(state, row.pos):
                    yield self.named(key, out)
                state = None
        self.disarm()
        if state is None:
            self.value.clear()
        else:
            self.value.update(tuple(state))
            self.deadline.update((latest + self.idle,))
            self.handle.registerTimer(latest + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.value.exists():
            for out in self.finish(list(self.value.get()), None):
                yield self.named(key, out)
        self.value.clear()
        self.deadline.clear()

    def disarm(self) -> None:
        if self.deadline.exists():
            self.handle.deleteTimer(self.deadline.get()[0])
            self.deadline.clear()

    def close(self) -> None:
        pass


class SequenceState(Ending):
    """After each token how many came, how long the run of equal ones is, how many came since the last separator, and the last BUFFER."""

    SCHEMA = "n int, run int, since int, recent array<int>"
    OUT = "pos bigint, n int, run int, since int, recent array<int>"

    def __init__(self, separator: int, eos: int, idle: int = IDLE, size: int = BUFFER) -> None:
        super().__init__(idle)
        self.separator, self.EOS, self.size = separator, eos, size

    def start(self) -> list:
        return [0, 0, 0, []]

    def step(self, state: list, row: Row) -> Iterator[tuple]:
        n, run, since, recent = state
        run = run + 1 if recent and recent[-1] == row.token else 1
        since = 0 if row.token == self.separator else since + 1
        state[:] = [n + 1, run, since, [*list(recent)[-(self.size - 1) :], row.token]]
        yield row.pos, *state


class SlidingBuffer(Ending):
    """The last `size` tokens: what each token drives out, how many are kept, and the absolute position of the oldest."""

    SCHEMA = "pos bigint, recent array<string>"
    OUT = "pos bigint, evicted string, kept int, first bigint"

    def __init__(self, idle: int = IDLE, size: int = BUFFER) -> None:
        super().__init__(idle)
        self.size = size

    def start(self) -> list:
        return [-1, []]

    def step(self, state: list, row: Row) -> Iterator[tuple]:
        recent = [*state[1], row.token]
        evicted = recent.pop(0) if len(recent) > self.size else None
        state[:] = [state[0] + 1, recent]
        yield state[0], evicted, len(recent), state[0] - len(recent) + 1


class Decoder(Ending):
    """Control tokens to events: on rows at once, off rows when the running time has reached them, the open rest at the end."""

    SCHEMA = "bar bigint, beat bigint, voice int, open array<struct<tick:bigint,voice:int,pitch:int>>"
    OUT = "at bigint, kind string, tick bigint, voice int, pitch int"

    def start(self) -> list:
        return [-1, 0, None, []]

    def step(self, state: list, row: Row) -> Iterator[tuple]:
        kind, *numbers = row.token.split("_")
        if kind == "BAR":
            state[0], state[1] = state[0] + 1, 0
        elif kind == "BEAT":
            state[1] = int(numbers[0])
        elif kind == "VOICE":
            state[2] = int(numbers[0])
        now = max(state[0], 0) * BAR + state[1]
        opened = [tuple(o) for o in state[3]]
        for tick, voice, pitch in opened:
            if tick <= now:
                yield row.pos, "off", tick, voice, pitch
        state[3] = [o for o in opened if o[0] > now]
        if kind == "N":
            pitch, dur = map(int, numbers)
            yield row.pos, "on", now, state[2], pitch
            state[3].append((now + dur, state[2], pitch))

    def finish(self, state: list, pos: int | None) -> Iterator[tuple]:
        for tick, voice, pitch in sorted(map(tuple, state[3])):
            yield pos, "off", tick, voice, pitch


def kept(spark: SparkSession) -> None:
    """The session keeps state in RocksDB, which state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stateful(tokens: DataFrame, key: dict[str, str], processor: Ending, late: int = 0) -> DataFrame:
    """A processor over a stream of tokens (key columns, pos, token, at), whose rows may be `late` milliseconds late."""
    kept(tokens.sparkSession)
    processor.keys = list(key)
    schema = ", ".join([*(f"{k} {t}" for k, t in key.items()), processor.OUT])
    return tokens.withWatermark("at", f"{late} milliseconds").groupBy(*key).transformWithState(processor, schema, "Append", "EventTime")
