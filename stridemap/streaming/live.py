"""Locating a stream of looks: new lines of logs are decoded, located in micro-batches against a map, and appended with their votes."""

from __future__ import annotations

import html
import os
import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stridemap import constants as C
from stridemap.operators import matching, sequence
from stridemap.runtime import delete_path
from stridemap.sources.logs import records_of, sightings

ANSWERS = "run string, seq bigint, query string, t bigint, stretch string, fraction double, lat double, lon double, score double, settled int, alternative string"


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a log folder as they come: (file, pos, value)."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    files = raw.select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "value")).where("trim(value) <> ''").select(
        "file", F.col("pos").cast("bigint").alias("pos"), "value"
    )


def locate_batch(looks: DataFrame, fps: DataFrame, fp_keys: DataFrame, reach_s: int = C.ONE_LOOK_S) -> DataFrame:
    """Answers to a batch of looks (run, scan_id, t, pos, key, strength), ties settled by the looks before them in the batch's runs."""
    named = looks.where("key <> ''").withColumn("query", F.concat_ws("|", "run", "scan_id"))
    queries = named.select("query", F.lit("").alias("grp")).distinct()
    keys = named.groupBy("query", "key").agg(F.max("strength").alias("strength"))
    ranked = matching.candidates(matching.best_looks(matching.walk_scores(fps, fp_keys, queries, keys), reach_s), fps)
    runs = looks.withColumn("query", F.concat_ws("|", "run", "scan_id")).groupBy("run", "query").agg(F.min("t").alias("t"), F.min("pos").alias("seq"))
    voted = sequence.vote(ranked, runs.select("run", "seq", "query")).select("query", "stretch", "settled", "alternative")
    places = matching.locations(ranked.join(voted.select("query", "stretch"), ["query", "stretch"]).withColumn("rank", F.lit(1)))
    return places.select("query", "stretch", "fraction", "lat", "lon", "score").join(voted.select("query", "settled", "alternative"), "query").join(runs, "query").select(
        "run", "seq", "query", "t", "stretch", "fraction", "lat", "lon", "score", "settled", "alternative"
    )


def tails(looks: DataFrame, back: int = C.LOOK_BACK) -> DataFrame:
    """The networks of the last ``back`` looks of each run, to be held against those of the next batch."""
    last = looks.groupBy("run", "scan_id").agg(F.min("pos").alias("seq"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("seq")))
    return looks.join(last.withColumn("nth", nth).where(F.col("nth") <= back).select("run", "scan_id"), ["run", "scan_id"])


def follow(
    spark: SparkSession, folder: str, fps: DataFrame, fp_keys: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, reach_s: int = C.ONE_LOOK_S,
    every: str | None = None,
) -> StreamingQuery:
    """Start following a log folder; ``sink`` gets each batch's answers. The map is read again by every batch, so it may grow.

    A look's vote takes the looks before it into account, wherever a batch ended: the last ones of each run are written beside the
    checkpoint under the number of their batch, and the batch after reads them. ``every`` (as ``5 seconds``) sets a fixed rate, at which Spark starts batches whatever
    they take; without it the query ends when it has read all that is there.
    """
    names = ["run", "scan_id", "t", "pos", "key", "strength"]

    def batch(lines: DataFrame, n: int) -> None:
        from stridemap.operators.scans import carry_walk

        looks = sightings(carry_walk(records_of(lines), "outing", "file")).select(*names)
        before = _kept(spark, f"{checkpoint}/looks/{n - 1}", looks)
        both = looks.withColumn("fresh", F.lit(True)).union(before.withColumn("fresh", F.lit(False)))
        tails(both.drop("fresh")).write.mode("overwrite").parquet(f"{checkpoint}/looks/{n}")
        new = looks.select("run", F.concat_ws("|", "run", "scan_id").alias("query")).distinct()
        sink(locate_batch(both.drop("fresh"), fps, fp_keys, reach_s).join(new, ["run", "query"], "left_semi").select(*ANSWER_NAMES), n)
        # If this batch is made again it needs the looks of the one before, and no older ones.
        delete_path(spark, f"{checkpoint}/looks/{n - 2}")

    stream = read_lines(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


ANSWER_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]


def _kept(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What the batch before left, or nothing if it was the first."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.where("false")


def replace_file(path: str, text: str) -> None:
    """Write a page so that readers see the old one or the new one, never a part (driver-side, one small file)."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def page(answers: list[dict], title: str = "Where am I", reload_s: int = 5) -> str:
    """A small page with the newest answers, which reloads itself, and says so when it has not been renewed for three reloads (30 seconds at least)."""
    rows = "".join(f"<li>{html.escape(a['run'])}: {a['fraction']:.0%} along {html.escape(a['stretch'])}</li>" for a in answers)
    stale = f"setTimeout(()=>document.body.classList.add('stale'),{max(3 * reload_s, 30) * 1000})"
    return (
        f'<!DOCTYPE html><meta charset="utf-8"><meta http-equiv="refresh" content="{reload_s}"><title>{html.escape(title)}</title>'
        f"<style>.stale::before{{content:'not renewed'}}</style><body><ul>{rows}</ul><script>{stale}</script>"
    )
