"""The live loop: a run is located look by look, with its card calibrated, its ties settled and its place kept to a walking pace.

Matching needs the whole map, so it is a job a batch; what a run remembers is in the state store. So the loop is a chain of streams with small tables
between them: ``look`` matches new looks, ``card`` (only if levels count) learns the card's offset and matches again at the corrected levels, ``walk`` settles
ties and paces. A batch may end anywhere: the answers are those of ``stridemap.walk.located`` for the whole log. What was handed on is deleted from the tables
between, and what a run remembers goes when it was silent for long.

A batch that is made again after a failure writes its rows again; each run drops looks that it has folded already, so nothing is said twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stridemap import constants as C
from stridemap import walk
from stridemap.operators.scans import carry_walk
from stridemap.operators.sequence import Track
from stridemap.runtime import written_once
from stridemap.sources.logs import records_of, sightings
from stridemap.streaming.live import ANSWERS
from stridemap.streaming.resume import _ROCKS, _STORE

HEARD = "array<struct<key:string,signal_dbm:int,signal_percent:int,strength:double>>"
#: A look of a run: what it heard and what it teaches about its card.
LESSONS = f"run string, seq long, query string, t long, heard {HEARD}, offs array<double>"
#: A look with the offset that its levels are corrected by.
OFFSETS = f"run string, seq long, query string, t long, heard {HEARD}, offset double"
#: A candidate of a look; a look without any has one row without a rank.
PLACES = (
    "run string, seq long, query string, t long, rank int, stretch string, share double, fraction double, lat double, lon double, length_m double, best double, "
    "spread double, scattered boolean, lat_0 double, lat_slope double, lon_0 double, lon_slope double"
)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _in_order(rows: Iterator[pd.DataFrame], seen: Any) -> pd.DataFrame:
    """The rows of looks that a run has not folded yet, in order; ``seen`` is moved on past them."""
    new = pd.concat(list(rows))
    upto = seen.get()
    new = new[new["seq"] > upto[0]] if upto else new
    if len(new):
        seen.update((int(new["seq"].max()),))
    return new


class Card(StatefulProcessor):
    """The offset of a run's card after each look: the median of its last pairs, if there are enough and it is not absurd."""

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long", self.forget_ms)
        self.pairs = handle.getListState("pairs", "off double", self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = _in_order(rows, self.seen).sort_values("seq")
        pairs, out = [x[0] for x in self.pairs.get()], []
        for r in new.itertuples():
            pairs = [*pairs, *(float(x) for x in r.offs)][-C.CAL_KEPT :]
            found = median(pairs) if len(pairs) >= C.CAL_PAIRS else None
            out.append((key[0], r.seq, r.query, r.t, r.heard, found if found is not None and abs(found) <= C.CAL_MOST else None))
        if pairs:
            self.pairs.put([(x,) for x in pairs])
        yield pd.DataFrame(out, columns=_names(OFFSETS))

    def close(self) -> None:
        pass


#: A candidate as a run remembers it: its stretch and its share of the odds.
Named = tuple[str, float]


def _tied(own: list[Named]) -> bool:
    return len(own) > 1 and own[0][1] < C.DOMINANCE


def _meet(a: str, b: str) -> bool:
    return not set(a.split("|")).isdisjoint(b.split("|"))


def by_vote(own: list[Named], back: list[list[Named]]) -> tuple[int, int, str | None]:
    """(index of the chosen candidate, looks that settled it, alternative): see ``sequence.vote``."""
    if not _tied(own):
        return 0, 0, None
    near = [sum(any(_meet(c[0], own[k][0]) for c in look[: 2 if _tied(look) else 1]) for look in back) for k in (0, 1)]
    best = int(near[1] > near[0])
    return best, max(near) if near[0] != near[1] else 0, own[1 - best][0]


def by_path(own: list[Named], back: list[list[Named]]) -> tuple[int, int, str | None]:
    """The same by the likeliest path: see ``sequence.path``."""
    layers = [look for look in [*back, own] if look]
    if len(layers) == 1:
        return 0, 0, own[1][0] if _tied(own) else None
    odds = [[(stretch, 0.0 if _tied(look) else math.log(share)) for stretch, share in look] for look in layers]

    def cost(a: str, b: str) -> float:
        return 0.0 if a == b else math.log(C.NEXT_STRETCH if _meet(a, b) else C.JUMP)

    ends = odds[0]
    for layer in odds[1:]:
        ends = [(stretch, score + max(before + cost(old, stretch) for old, before in ends)) for stretch, score in layer]
    ranks = sorted((round(-score, 9), k) for k, (_, score) in enumerate(ends))
    share = math.exp(-ranks[0][0]) / sum(math.exp(-c) for c, _ in ranks)
    best = ranks[0][1]
    if len(ranks) > 1 and share < C.DOMINANCE:
        return best, 0, own[ranks[1][1]][0]
    moved = _tied(own) or best != 0
    return best, len(layers) - 1 if moved else 0, (own[1][0] if best == 0 else own[0][0]) if _tied(own) else None


class Walker(StatefulProcessor):
    """The answer to each look of a run, from its candidates, those of the looks before it, and the walker's pace."""

    def __init__(self, order: str, pace: bool, forget_ms: int | None) -> None:
        self.order, self.pace, self.forget_ms = order, pace, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long", self.forget_ms)
        self.looks = handle.getListState("looks", "back int, stretch string, share double", self.forget_ms)
        self.track = handle.getValueState("track", "stretch string, length double, x double, v double, xx double, xv double, vx double, vv double, since double", self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = _in_order(rows, self.seen)
        back: list[list[Named]] = [[] for _ in range(C.LOOK_BACK)]
        for nth, stretch, share in self.looks.get():
            if stretch is not None:
                back[nth].append((stretch, share))
        track, out = self._walker(), []
        for _, look in new.groupby("seq", sort=True):
            places = list(look[look["rank"].notna()].sort_values("rank").itertuples())
            own = [(p.stretch, float(p.share)) for p in places]
            if own:
                best, settled, other = (by_vote if self.order == "tie" else by_path)(own, back)
                out.append(self._answer(places[best], settled, other, track))
            back = [*back[1:], own]
        if len(new):
            # An empty look keeps its place by a row without a stretch.
            self.looks.put([(n, *c) for n, look in enumerate(back) for c in (look or [(None, None)])])
            if track.stretch is not None:
                (xx, xv), (vx, vv) = track.spread
                self.track.update((track.stretch, track.length, *track.mean, xx, xv, vx, vv, track.since))
            elif self.track.exists():
                self.track.clear()
        yield pd.DataFrame(out, columns=_names(ANSWERS))

    def _walker(self) -> Track:
        kept = self.track.get()
        if not kept:
            return Track()
        stretch, length, x, v, xx, xv, vx, vv, since = kept
        return Track(stretch, length, [x, v], [[xx, xv], [vx, vv]], since)

    def _answer(self, p: Any, settled: int, other: str | None, track: Track) -> tuple:
        there = lambda x: None if pd.isna(x) else float(x)
        fraction, lat, lon = float(p.fraction), there(p.lat), there(p.lon)
        if self.pace:
            fraction = track.placed(p.stretch, there(p.length_m), fraction, float(p.spread), float(p.t))
            if there(p.lat_0) is not None:
                lat, lon = (None if c is None else a + b * fraction for c, a, b in ((lat, p.lat_0, p.lat_slope), (lon, p.lon_0, p.lon_slope)))
        if p.scattered:
            lat = lon = other = None
        return (p.run, p.seq, p.query, p.t, p.stretch, fraction, lat, lon, float(p.best), settled, other)

    def close(self) -> None:
        pass


@dataclass
class Loop:
    """The streams of a loop, in the order of the chain."""

    starts: list[Callable[[], StreamingQuery]]

    def run(self, timeout_s: int | None = None) -> None:
        """Take what is there through the chain, one stream after the other, and end."""
        for start in self.starts:
            query = start()
            if query.awaitTermination(timeout_s) is False:
                query.stop()
                raise TimeoutError(f"{query.name} took over {timeout_s} s")

    def start(self) -> list[StreamingQuery]:
        """Start all streams at once, which then run until they are stopped."""
        return [start() for start in self.starts]


def follow_walks(
    lines: DataFrame, fps: DataFrame, keys: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, order: str = "tie", by_signal: bool = False, pace: bool = True,
    every: str | None = None, forget_s: int = 7200, reach_s: int = C.ONE_LOOK_S,
) -> Loop:
    """The loop over a stream of log lines (file, pos, value, and walk if a file's lines come in several batches, see ``tail.whole_cycles``): ``sink`` gets the answers of each batch, and must have
    written what it needs of them when it returns.

    ``folder`` (shared) holds checkpoints and the tables between the streams. ``every`` (as ``5 seconds``) sets the rate; without it a stream ends when it
    has read what is there. The map is read again by every batch, so it may grow. With ``every``, a run silent for ``forget_s`` starts anew; a folder's checkpoints are for
    loops with it or loops without it, not for both.
    """
    spark = lines.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    # Only a stream that never ends forgets: with processing times Spark makes batches for ever, so one that should end has none.
    forget_ms, clock = (forget_s * 1000, "processingTime") if every else (None, "none")

    def stream(name: str, rows: DataFrame, batch: Callable[[DataFrame, int], None]) -> Callable[[], StreamingQuery]:
        def guarded(df: DataFrame, n: int) -> None:
            with written_once(spark):
                batch(df, n)

        writer = rows.writeStream.foreachBatch(guarded).option("checkpointLocation", f"{folder}/{name}-checkpoint")
        return lambda: (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def between(name: str, schema: str) -> DataFrame:
        """A table that one stream writes and the next reads, deleting what it has read."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
        return spark.readStream.schema(schema).option("cleanSource", "delete").option("recursiveFileLookup", True).parquet(f"{folder}/{name}")

    def hand_on(rows: DataFrame, name: str, n: int) -> None:
        # A run's looks of a batch are in one file, so that the next stream meets them together.
        rows.repartition("run").write.mode("overwrite").parquet(f"{folder}/{name}/{n}")

    def places(runs: DataFrame, asked: DataFrame, n: int) -> None:
        ranked = walk.ranked_places(runs, asked, fps, keys, by_signal, reach_s)
        hand_on(runs.join(ranked, "query", "left").select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in PLACES.split(", "))), "places", n)

    def look(df: DataFrame, n: int) -> None:
        df = walk.materialize(df, "lines")  # read several times below, and it may come out of a state
        records = records_of(df)
        # A stream that carries walks over from batch to batch names them itself.
        named = records.join(df.select("file", "pos", "walk"), ["file", "pos"]) if "walk" in df.columns else carry_walk(records, "outing", "file")
        runs, asked = walk.asked_of(sightings(named))
        runs, asked = walk.materialize(runs, "runs"), walk.materialize(asked, "asked")
        if not by_signal:
            return places(runs, asked, n)
        taught = walk.lessons(runs, asked, fps, keys, reach_s).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("key", "off"))).alias("p"))
        heard = asked.groupBy("query").agg(F.collect_list(F.struct("key", "signal_dbm", "signal_percent", "strength")).cast(HEARD).alias("heard"))
        rows = runs.join(heard, "query", "left").join(taught, "query", "left")
        none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})"))
        rows = rows.select("run", "seq", "query", "t", none(F.col("heard"), HEARD).alias("heard"), none(F.transform("p", lambda x: x["off"]), "array<double>").alias("offs"))
        return hand_on(rows, "lessons", n)

    def again(df: DataFrame, n: int) -> None:
        known = walk.materialize(df, "known")
        asked = known.select("query", F.explode("heard").alias("h")).select("query", "h.*")
        places(known.select("run", "seq", "query", "t"), walk.materialize(walk.corrected(asked, known), "corrected"), n)

    starts = [stream("look", lines, look)]
    if by_signal:
        learned = between("lessons", LESSONS).groupBy("run").transformWithStateInPandas(Card(forget_ms), OFFSETS, "append", clock)
        starts.append(stream("card", learned, again))
    answers = between("places", PLACES).groupBy("run").transformWithStateInPandas(Walker(order, pace, forget_ms), ANSWERS, "append", clock)
    return Loop([*starts, stream("walk", answers, lambda df, n: sink(walk.materialize(df, "answers"), n))])
