"""What a folder holds: its walks, which of them a map has, and files that read as notebooks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.operators.scans import carry_walk
from stridemap.runtime import materialize
from stridemap.sources import maps
from stridemap.sources.logs import records_of
from stridemap.sources.notebook import crossing_lines

#: Fixed value: from so many crossings on a file reads as a notebook.
LEAST_CROSSINGS = 2


def mapped_walks(spark: SparkSession, path: str) -> DataFrame | None:
    """(walk) of the walks on a map, by what stands after the last slash of its outings; None if the map is there and can't be read, which is not an empty map."""
    try:
        walks = maps.read_map(spark, path).where("outing <> ''").select(F.element_at(F.split("outing", "/"), -1).alias("walk"))
        return materialize(walks.distinct(), "mapped", few=True)
    except (PySparkException, Py4JJavaError) as e:
        if not any(word in str(e) for word in ("FAILED_READ_FILE", "AccessControlException", "Permission denied")):
            raise
        return None


def walks_of(spark: SparkSession, folder: str, mapped: DataFrame | None) -> DataFrame:
    """(file, walk, began, ended, scans, marks, on_map, unreadable) of all walks of the logs in a folder, the newest first; one row a walk, not one a file.

    ``on_map`` is null if ``mapped`` is None: nobody knows. A walk without a name is on no map. A log that can't be read has one row that says so, with no walk.
    Looks are those with a time, all cards of a cycle together; marks those with a number and a time. Empty files have no row.
    """
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.col("_metadata.file_path").alias("file"))
    text = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    text = materialize(text, "logs")
    lines = text.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "value")).where("trim(value) <> ''")
    records = carry_walk(records_of(lines.select("file", F.col("pos").cast("bigint").alias("pos"), "value")), "outing", "file")
    look = F.when((F.col("event") == "scan") & F.col("time").isNotNull(), F.coalesce(F.concat(F.lit("c"), F.col("cycle").cast("string")), F.col("time").cast("string")))
    mark = F.when((F.col("event") == "mark") & F.col("number").isNotNull() & F.col("time").isNotNull(), 1)
    found = records.groupBy("file", "walk").agg(F.min("time").alias("began"), F.max("time").alias("ended"), F.countDistinct(look).alias("scans"), F.count(mark).alias("marks"))
    if mapped is None:
        found = found.withColumn("on_map", F.lit(None).cast("boolean"))
    else:
        known = mapped.select("walk", F.lit(True).alias("on_map")).distinct()
        found = found.join(known, "walk", "left").withColumn("on_map", F.coalesce("on_map", F.lit(False)) & (F.col("walk") != ""))
    shut = there.join(text.select("file"), "file", "left_anti").select("file", F.lit(True).alias("unreadable"))
    rows = found.withColumn("unreadable", F.lit(False)).unionByName(shut, allowMissingColumns=True)
    return rows.select("file", "walk", "began", "ended", "scans", "marks", "on_map", "unreadable").orderBy(F.col("began").desc_nulls_last(), "file", "walk")


def described(walks: DataFrame) -> DataFrame:
    """A line for each row of ``walks_of``: (file, walk, line)."""
    name = F.element_at(F.split("file", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    many = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {word}"), F.when(F.col(c) != 1, "s").otherwise(""))
    # Minutes to even halves.
    minutes = F.bround((F.unix_micros("ended") - F.unix_micros("began")) / 60e6).cast("long").cast("string")
    when = F.coalesce(F.date_format("began", "yyyy-MM-dd HH:mm"), F.lit("no time in it"))
    on = F.when(F.col("on_map"), "  on the map").otherwise("")
    lasted = F.coalesce(F.concat(F.lit("  "), minutes, F.lit(" min")), F.lit(""))
    line = F.concat(when, F.lit("  "), F.when(F.col("walk") == "", stem).otherwise(F.col("walk")), F.lit("  "), many("scans", "scan"), F.lit("  "), many("marks", "mark"), lasted, on)
    return walks.select("file", "walk", F.when(F.col("unreadable"), F.concat(name, F.lit("  cannot be read"))).otherwise(line).alias("line"))


def notebooks_in(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(file, crossings) of the text files (``*.txt``) right in some folders that name LEAST_CROSSINGS crossings at least; files that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folders)
    text = files.select(F.col("_metadata.file_path").alias("file"), F.col("content").cast("string").alias("text")).where(F.is_valid_utf8("text")).dropDuplicates(["file"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file": b["file"], "crossings": b["text"].map(lambda t: len(crossing_lines(t))).astype("int64")})

    return text.mapInPandas(counted, "file string, crossings long").where(F.col("crossings") >= LEAST_CROSSINGS)
