"""What a walk has announced so far, as a stream that can be cut and carried on from its log.

A run (a log file) announces each network once, and numbers its marks and cycles. Its state in the store is the set of networks met and two counters. A stream
that is started anew, without its checkpoint, is given its ``carried`` state: all networks of the file, whichever walk met them; the marks of
the walk that the file ends with alone, as each walk numbers its own; and the cycles of the whole file, which no two of its looks share.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stridemap.functions.exprs import network_key
from stridemap.operators.scans import last_walk

EVENTS = "run string, pos long, what string, key string"
ANNOUNCED = "run string, pos long, what string, key string, number long"
#: Places that a record takes in ``pos``: one for itself, then its networks.
PLACES = 10_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_of(records: DataFrame) -> DataFrame:
    """(run, pos, what, key) of records in the log schema: ``mark``, ``cycle``, and ``network`` for each network of a look.

    An anonymous network has the empty key: nothing tells two of them apart, so the first stands for all.
    """
    at = F.col("pos") * PLACES
    plain = records.where("event in ('mark', 'scan')").select(
        F.col("file").alias("run"), at.alias("pos"), F.when(F.col("event") == "mark", "mark").otherwise("cycle").alias("what"), F.lit(None).cast("string").alias("key")
    )
    looks = records.where("event = 'scan'").select(F.col("file").alias("run"), at.alias("at"), F.posexplode("networks").alias("k", "n"))
    return plain.unionByName(looks.select("run", (F.col("at") + F.col("k") + 1).alias("pos"), F.lit("network").alias("what"), network_key(F.col("n.bssid"), F.col("n.ssid")).alias("key")))


def carried(records: DataFrame) -> DataFrame:
    """The state (run, key, marks, cycles) that the records (file, pos, walk, event, number, cycle, networks) of logs leave: a row a network, and one with the counters.

    Records without a number were counted all the same: a counter is never below the count of its records.
    """
    heard = events_of(records).where("what = 'network'").select("run", "key").distinct()
    marks = last_walk(records.where("walk is not null"), "file").where("event = 'mark'").groupBy("file").agg(F.greatest(F.max("number"), F.count("*")).alias("marks"))
    cycles = records.groupBy("file").agg(F.greatest(F.max("cycle"), F.count(F.when(F.col("event") == "scan", 1))).alias("cycles"))
    counts = cycles.join(marks, "file", "left").select(F.col("file").alias("run"), F.coalesce("marks", F.lit(0)).cast("long").alias("marks"), F.coalesce("cycles", F.lit(0)).cast("long").alias("cycles"))
    none = F.lit(None).cast("long")
    return heard.select("run", "key", none.alias("marks"), none.alias("cycles")).unionByName(counts.select("run", F.lit(None).cast("string").alias("key"), "marks", "cycles"))


class Announcer(StatefulProcessor):
    """First meetings, and numbers of marks and cycles."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "pos long")
        self.counts = handle.getValueState("counts", "marks long, cycles long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        heard = initialState["key"].notna()
        for name in initialState.loc[heard, "key"]:
            self.seen.updateValue((name,), (-1,))
        for row in initialState[~heard].itertuples():
            self.counts.update((int(row.marks), int(row.cycles)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        numbers = dict(zip(("mark", "cycle"), self.counts.get() or (0, 0), strict=True))
        out = []
        for row in pd.concat(list(rows)).sort_values("pos").itertuples():
            if row.what in numbers:
                numbers[row.what] += 1
                out.append((key[0], row.pos, row.what, None, numbers[row.what]))
            elif not self.seen.containsKey((row.key,)):
                self.seen.updateValue((row.key,), (row.pos,))
                out.append((key[0], row.pos, row.what, row.key, None))
        self.counts.update((numbers["mark"], numbers["cycle"]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANNOUNCED.split(", ")]).astype({"number": "Int64"})

    def close(self) -> None:
        pass


def announced(stream: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """ANNOUNCED rows of a stream of EVENTS, carried on from ``state`` (see ``carried``; a table, not a stream).

    Its state is kept in RocksDB, so the session's state store is set to that. With a checkpoint of its own the stream needs no ``state``, and takes none.
    """
    stream.sparkSession.conf.set(_STORE, _ROCKS)
    return stream.groupBy("run").transformWithStateInPandas(Announcer(), ANNOUNCED, "append", "none", initialState=None if state is None else state.groupBy("run"))


def announced_batch(events: DataFrame) -> DataFrame:
    """The same of a whole table of EVENTS: first meetings by minima, numbers by counting."""
    first = events.where("what = 'network'").groupBy("run", "key").agg(F.min("pos").alias("pos"))
    rest = events.where("what <> 'network'").withColumn("number", F.row_number().over(Window.partitionBy("run", "what").orderBy("pos")).cast("long"))
    return first.select("run", "pos", F.lit("network").alias("what"), "key", F.lit(None).cast("long").alias("number")).unionByName(rest.select("run", "pos", "what", "key", "number"))
