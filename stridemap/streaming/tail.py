"""Logs that are still being written: their lines as they are ended, and their cycles as they are over.

``register(spark)`` adds the streaming source ``tail`` (option ``path``: a folder). Its offsets are the sizes of the files, so a batch is a range of bytes of each,
cut into pieces for the tasks. A line belongs to the piece in which it ends: half a line has no end yet, and comes in the batch that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stridemap.sources.logs import records_of
from stridemap.streaming.resume import _ROCKS, _STORE

LINES = "file string, pos long, value string"
#: Bytes of a file that a task reads at most, and a step in looking back for where a line began.
PIECE, STEP = 16 << 20, 64 << 10
WALKED = "file string, pos long, value string, walk string"


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int


def lines_ending(handle: Any, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(offset, text) of the lines of a file whose line feed is at ``start`` or later and before ``end``."""
    handle.seek(start)
    raw = handle.read(end - start)
    upto = raw.rfind(b"\n") + 1
    if not upto:
        return
    head, at = b"", start
    while at > 0 and b"\n" not in head:
        step = min(STEP, at)
        at -= step
        handle.seek(at)
        head = handle.read(step) + head
    head = head[head.rfind(b"\n") + 1 :]
    at = start - len(head)
    for line in (head + raw[:upto]).split(b"\n")[:-1]:
        yield at, line.decode("utf-8", "replace").removesuffix("\r")
        at += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = self._fs()
        return {f.path: f.size for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_")) and f.size}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        shorter = sorted(f for f, size in start.items() if end.get(f, 0) < size)
        if shorter:
            raise ValueError(f"logs only grow, but these became shorter or went: {', '.join(shorter[:5])}")
        return [Piece(f, at, min(at + PIECE, size)) for f, size in end.items() for at in range(start.get(f, 0), size, PIECE)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        with self._fs()[0].open_input_file(partition.file) as handle:
            for at, line in lines_ending(handle, partition.start, partition.end):
                if line.strip():
                    yield partition.file, at, line


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        return TailReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tail)


def tailed(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of LINES of the files right in a folder (a path or a URI), ``pos`` being where in the file a line begins. A last line that isn't ended doesn't come."""
    register(spark)
    return spark.readStream.format("tail").option("path", folder).load()


class Cycles(StatefulProcessor):
    """Holds back the lines of a file until their cycle is over, and carries its walk on."""

    def __init__(self, late_s: int) -> None:
        self.late_s = late_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.walk = handle.getValueState("walk", "walk string")
        self.open = handle.getListState("open", "pos long, value string, walk string, cycle long, t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("pos")
        walk, held = (self.walk.get() or ("",))[0], list(self.open.get())
        for r in new.itertuples():
            walk = walk if pd.isna(r.outing) else r.outing
            held.append((int(r.pos), r.value, walk, *(None if pd.isna(x) else int(x) for x in (r.cycle, r.t))))
        self.walk.update((walk,))
        now = max((x[4] for x in held if x[4] is not None), default=None)
        last: dict = {}
        for _, _, of, cycle, t in held:
            if cycle is not None and t is not None:
                last[of, cycle] = max(t, last.get((of, cycle), t))
        waits = {c for c, t in last.items() if t > now - self.late_s}
        # Lines go on in their order: the first one that waits holds back all after it.
        first = next((k for k, x in enumerate(held) if (x[2], x[3]) in waits), len(held))
        if held[first:]:
            self.open.put(held[first:])
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], *x[:3]) for x in held[:first]], columns=[c.split()[0] for c in WALKED.split(", ")])

    def close(self) -> None:
        pass


def whole_cycles(lines: DataFrame, late_s: int = 10) -> DataFrame:
    """WALKED: a stream of lines whose cycles come whole, however the cards' records were torn, each with the last walk that its file named so far.

    A cycle is over when its file has a record ``late_s`` seconds or more after the cycle's last; its own later records then come as a look of their own. Each file
    has its own clock, so old logs may be added at any time and no line is lost; the last cycle of a file waits for the next record. Lines that are
    no records are left out.
    """
    lines.sparkSession.conf.set(_STORE, _ROCKS)
    kept = records_of(lines.withColumn("file", F.to_json(F.struct("file", "value"))))
    # The line itself rides along in the place of the file, which records keep as it is.
    both = F.from_json("file", "file string, value string")
    look = F.when(F.col("event") == "scan", F.col("cycle"))
    rows = kept.select(both.alias("b"), "pos", "outing", look.alias("cycle"), F.unix_seconds("time").alias("t")).select("b.file", "pos", "b.value", "outing", "cycle", "t")
    return rows.groupBy("file").transformWithStateInPandas(Cycles(late_s), WALKED, "append", "none")
