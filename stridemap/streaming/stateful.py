"""Keyed folds over streams: one state per run in the state store, rows in the order of their position.

A fold is a dataclass of JSON values with ``step(row) -> list of output tuples``. Its fields are the state; they are bounded, so the
state store holds a few hundred bytes a run, and the sliding windows of the slowest fold some hundred numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.operators.sequence import Track


def folded_stream(stream: DataFrame, by: str, order: str, schema: str, make: Callable[[], Any]) -> DataFrame:
    """Fold each run of a stream in the order of ``order``, whatever its batches. A row that comes after a later one of its run was folded is refused: the
    stream fails, as its answers would depend on the batches. (A run's lines come from one log, whose reader keeps their order.)"""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        fold, upto = make(), None
        if state.exists:
            upto, kept = json.loads(state.get[0])
            fold = type(fold)(**kept)
        rows = pd.concat(list(batches)).sort_values(order)
        if upto is not None and rows[order].iloc[0] < upto:
            raise ValueError(f"run {key[0]}: {order} {rows[order].iloc[0]} came after {upto} was folded")
        out = [o for r in rows.itertuples(index=False) for o in fold.step(r)]
        state.update((json.dumps([rows[order].iloc[-1].item(), asdict(fold)]),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(by).applyInPandasWithState(run, schema, "state string", "append", "NoTimeout")


def _none(value: Any) -> Any:
    return None if value is None or value != value else value


@dataclass
class Debounce:
    """Presses at least ``gap_s`` after the last accepted one. Also throttles: what is said at most every so many seconds."""

    gap_s: float = C.DEBOUNCE_S
    last: float | None = None

    def step(self, r: Any) -> list[tuple]:
        if self.last is not None and r.t - self.last < self.gap_s:
            return []
        self.last = float(r.t)
        return [(r.run, int(r.pos))]


@dataclass
class Failures:
    """Consecutive failed looks, reported at the first and every ``reminder``; and the look that ends a streak."""

    reminder: int = C.FAILURE_REMINDER
    streak: int = 0

    def step(self, r: Any) -> list[tuple]:
        if r.event != "scan_failed":
            over, self.streak = self.streak, 0
            return [(r.run, int(r.pos), "recovered", over)] if over and r.event == "scan" else []
        self.streak += 1
        return [(r.run, int(r.pos), "failed", self.streak)] if self.streak == 1 or self.streak % self.reminder == 0 else []


@dataclass
class Associations:
    """Changes of each card's association: connected, roam, disconnected."""

    cards: dict = field(default_factory=dict)

    def step(self, r: Any) -> list[tuple]:
        now, before = [_none(r.ssid), _none(r.bssid)], self.cards.get(r.interface, [None, None])
        self.cards[r.interface] = now
        if now == before or (now[0] is None and before[0] is None):
            return []
        change = "connected" if before[0] is None else "disconnected" if now[0] is None else "roam"
        return [(r.run, r.interface, int(r.pos), now[0], change)]


@dataclass
class Battery:
    """The first reading at or under each threshold while not charging; one a reading, the lowest."""

    thresholds: list = field(default_factory=lambda: sorted(C.BATTERY_WARNINGS))
    least: int | None = None

    def step(self, r: Any) -> list[tuple]:
        under = [x for x in self.thresholds if r.percent <= x]
        if r.charging or not under or (self.least is not None and under[0] >= self.least):
            return []
        self.least = under[0]
        return [(r.run, int(r.pos), self.least)]


@dataclass
class Changes:
    """Rows whose value differs from the one before: new stretches and corners in full, else each tenth of the way."""

    last: str | None = None

    def step(self, r: Any) -> list[tuple]:
        value = f"{r.stretch}@{int(r.fraction * 10)}"
        changed, self.last = value != self.last, value
        return [(r.run, int(r.pos), r.stretch, float(r.fraction))] if changed else []


@dataclass
class PaceFold:
    """The constant-speed filter on a stream of answers."""

    state: dict = field(default_factory=dict)

    def step(self, r: Any) -> list[tuple]:
        track = Track(**self.state)
        length = _none(r.length_m)
        fraction = track.placed(r.stretch, None if length is None else float(length), float(r.fraction), float(r.spread), float(r.t))
        self.state = asdict(track)
        return [(r.run, int(r.seq), r.stretch, float(fraction))]


@dataclass
class Calibration:
    """The card's offset after each look: the median of its last pairs, if there are enough and it is not absurd.

    A row is a look with the level differences that it taught (``offs``); the offset holds for this look and later ones.
    """

    pairs: list = field(default_factory=list)

    def step(self, r: Any) -> list[tuple]:
        self.pairs = [*self.pairs, *(float(x) for x in r.offs)][-C.CAL_KEPT :]
        found = median(self.pairs) if len(self.pairs) >= C.CAL_PAIRS else None
        good = found is not None and abs(found) <= C.CAL_MOST
        return [(r.run, int(r.seq), len(self.pairs), found if good else None)]


def accepted_presses(stream: DataFrame, gap_s: float = C.DEBOUNCE_S) -> DataFrame:
    return folded_stream(stream, "run", "pos", "run string, pos long", lambda: Debounce(gap_s))


def failures(stream: DataFrame, reminder: int = C.FAILURE_REMINDER) -> DataFrame:
    return folded_stream(stream, "run", "pos", "run string, pos long, what string, streak long", lambda: Failures(reminder))


def associations(stream: DataFrame) -> DataFrame:
    return folded_stream(stream, "run", "pos", "run string, interface string, pos long, ssid string, change string", Associations)


def battery_warnings(stream: DataFrame) -> DataFrame:
    return folded_stream(stream, "run", "pos", "run string, pos long, threshold long", Battery)


def answer_changes(stream: DataFrame) -> DataFrame:
    return folded_stream(stream, "run", "pos", "run string, pos long, stretch string, fraction double", Changes)


def paced(stream: DataFrame) -> DataFrame:
    return folded_stream(stream, "run", "seq", "run string, seq long, stretch string, fraction double", PaceFold)


def calibrated(stream: DataFrame) -> DataFrame:
    return folded_stream(stream, "run", "seq", "run string, seq long, pairs long, offset double", Calibration)


def first_seen(stream: DataFrame) -> DataFrame:
    """Networks of a run not met before in it; the built-in deduplication keeps the keys in the state store."""
    return stream.dropDuplicates(["run", "key"])


def sessions(stream: DataFrame, time: str = "time", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each run by silence, closed once the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy("run", F.session_window(time, gap)).agg(F.count("*").alias("records"))
