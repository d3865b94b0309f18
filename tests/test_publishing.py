"""Geocoding, publishing and suggestions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap import publishing
from stridemap.functions import exprs


def test_geocode(spark):
    ways = spark.createDataFrame(
        [(1, {"name": "Avenida Agraciada", "alt_name": "Agraciada"}, [10, 11, 12]), (2, {"name": "Freire"}, [10, 20]), (3, {"name": "Solari"}, [12, 30]), (4, {"name": "Freire", "highway": "footway"}, [12, 20])],
        "way_id long, tags map<string,string>, nodes array<long>",
    )
    nodes = spark.createDataFrame([(10, -34.9, -56.2), (11, -34.9, -56.201), (12, -34.9, -56.22), (20, -34.901, -56.2), (30, -34.901, -56.22)], "node_id long, lat double, lon double")
    rows = [("r", 0, 0, "Agraciada y FREIRE", None, None), ("r", 1, 60, "Solari, Agraciada", None, None), ("r", 2, 9000, "Plaza", None, None), ("r", 3, 9100, "Freire y Nowhere", None, None),
            ("r", 4, 9200, "Freire / Solari", -34.95, -56.3)]
    got = [r["outcome"] for r in publishing.geocode(spark.createDataFrame(rows, "run string, ord int, t long, name string, lat double, lon double"), ways, nodes).orderBy("ord").collect()]
    assert got == ["too fast", "too fast", "no corner", "missing", "given"]
    slow = spark.createDataFrame([(r[0], r[1], r[2] * 60, *r[3:]) for r in rows], "run string, ord int, t long, name string, lat double, lon double")
    assert [(r["outcome"], r["lat"]) for r in publishing.geocode(slow, ways, nodes).orderBy("ord").collect()][:2] == [("one", -34.9), ("one", -34.9)]


def test_export(spark):
    n = [("Casa Lopez", "aa:bb:cc:dd:ee:ff", "psk", 2412, -60, None, True), ("Bar", None, "odd", None, -70, None, False)]
    rec = [("f", 0, datetime(2026, 9, 5, 17), -10800, "scan", "tok", "wlan0", 1, None, None, None, None, None, None, None, None, None, n),
           ("f", 1, datetime(2026, 9, 5, 17, 1), -10800, "connected", "tok", "wlan0", None, "Casa Lopez", "aa", None, None, None, None, None, None, None, [])]
    records = spark.createDataFrame(rec, C.LOG_SCHEMA).withColumn("run", F.lit("r")).withColumn("walk", F.lit("tok"))
    start = records.select(F.unix_seconds("time")).first()[0]
    ways = spark.createDataFrame([("r", 0, start - 60, "Rivera y Brito", -34.9, -56.1), ("r", 1, start + 60, "Plaza", -34.9, -56.101)], "run string, ord int, t long, name string, lat double, lon double")
    done = publishing.export(records, ways, b"k")
    lines = [r["value"] for r in done.records.collect()]
    assert len(lines) == 1 and '"time":"1970-01-01T00:01:00+00:00"' in lines[0] and '"withheld by --export-public"' in lines[0] and "ap-" in lines[0] and "ssid-" in lines[0] and "Lopez" not in lines[0]
    assert tuple(done.counts.first()) == (1, 2, 0) and done.survivors.collect() == []
    notes = [r["line"] for r in done.notebook.orderBy("ord", "part").collect()]
    assert notes[0] == "date 1970-01-01" and notes[1].startswith("00:00:00 street-") and notes[1].endswith("@ 0.000000, 0.000000") and " place-" in notes[2]
    kept = publishing.export(records, ways, b"k", ssid="keep")
    assert "Casa Lopez" in kept.records.first()["value"]
    with pytest.raises(ValueError):
        publishing.export(records.union(records.withColumn("walk", F.lit("other"))), ways, b"k")


def test_suggestion(spark):
    df = spark.createDataFrame([("a", 1, 5, 0), ("b", 2, 5, 3)], "walk string, first_t long, scans long, marks long")
    say = publishing.suggestion
    assert [say(df.where("false"), 0, []), say(df, 0, []), say(df, 1, None), say(df, 1, ["b"]), say(df, 1, ["a", "b"]), say(df.where("walk = 'a'"), 1, ["a"])] == [
        "walk", "transcribe b", None, "add a", "check", "walk again"]


def test_phrases(spark):
    df = spark.createDataFrame([("A", "B", 0.0, 100.0), ("A", "B", 0.525, 100.0), ("A y C", "B", 0.1, 100.0), ("A", "B", 1.0, None)], "a string, b string, f double, n double")
    rows = df.select(exprs.described(F.col("a"), F.col("b"), F.col("f")).alias("d"), exprs.said(F.col("a"), F.col("b"), F.col("f"), F.col("n")).alias("s")).collect()
    assert rows[0]["d"] == 'at "A"' and rows[1]["d"] == 'between "A" and "B", 52% of the way' and rows[2]["s"] == 'at the corner of "A y C"' and rows[3]["s"] == 'at "B"'


def exported(spark, value):
    """An export of one line; one whose notebook can't be written if ``value`` is None."""
    records = spark.createDataFrame([(value or "x",)], "value string")
    notes = spark.createDataFrame([("r", 0, 0, "date 1970-01-01")], "run string, ord int, part int, line string")
    return publishing.Exported(records, notes if value else notes.withColumn("line", F.raise_error(F.lit("full"))), records, records)


def test_an_export_is_whole_or_not_there(spark, tmp_path):
    out = tmp_path / "out" / "walk"
    with pytest.raises(Exception, match="full"):
        publishing.write_export(exported(spark, None), str(out))
    assert list((tmp_path / "out").iterdir()) == []  # the log was written, and went
    publishing.write_export(exported(spark, "one"), str(out))
    assert spark.read.text(str(out / "log")).first()[0] == "one" and spark.read.text(str(out / "notebook")).count() == 1
    with pytest.raises(FileExistsError):
        publishing.write_export(exported(spark, "two"), str(out))
    (tmp_path / "out" / "empty").mkdir()
    with pytest.raises(FileExistsError):  # a folder that someone just made stays as it is
        publishing.write_export(exported(spark, "two"), f"{tmp_path}/out/empty/")
    assert spark.read.text(str(out / "log")).first()[0] == "one" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["empty", "walk"]


def test_one_walk(spark):
    df = spark.createDataFrame([("a", "scan", datetime(2026, 9, 5)), ("b", "scan", None), ("", "mark", None)], "walk string, event string, time timestamp")
    assert publishing.one_walk(df, "a").count() == publishing.one_walk(df.where("walk = 'a'")).count() == 1
    for walk, match in ((None, r"several: \(unnamed\), a, b"), ("c", "no walk called 'c'"), ("b", "no look")):
        with pytest.raises(ValueError, match=match):
            publishing.one_walk(df, walk)
    with pytest.raises(ValueError, match="no walk"):
        publishing.one_walk(df.where("false"))
