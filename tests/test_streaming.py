"""Streams give what batches give on the same rows."""

import math

from pyspark.sql import functions as F

from stridemap.operators import scans, sequence
from stridemap.streaming import live, stateful


def streamed(spark, df, tmp_path, name, transform):
    path = str(tmp_path / name)
    df.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(path)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_debounce(spark, tmp_path):
    rows = spark.createDataFrame([("r", k, float(t)) for k, t in enumerate([0, 6, 12, 18, 40])], "run string, pos long, t double")
    got = streamed(spark, rows, tmp_path, "presses", lambda s: stateful.accepted_presses(s, 10.0))
    assert sorted(r["pos"] for r in got) == sorted(r["pos"] for r in scans.accepted_presses(rows, 10.0).collect())


def test_failures_and_associations(spark, tmp_path):
    kinds = ["scan", "scan_failed", "scan_failed", "scan_failed", "scan", "scan_failed"]
    rows = spark.createDataFrame([("r", k, e) for k, e in enumerate(kinds)], "run string, pos long, event string")
    got = {(r["pos"], r["what"], r["streak"]) for r in streamed(spark, rows, tmp_path, "fails", lambda s: stateful.failures(s, 3))}
    assert got == {(1, "failed", 1), (3, "failed", 3), (4, "recovered", 3), (5, "failed", 1)}
    rows = spark.createDataFrame([("r", "w", k, s, s) for k, s in enumerate([None, "a", "a", "b", None])], "run string, interface string, pos long, ssid string, bssid string")
    got = {(r["pos"], r["change"]) for r in streamed(spark, rows, tmp_path, "assoc", stateful.associations)}
    assert got == {(r["pos"], r["change"]) for r in scans.associations(rows).collect()} == {(1, "connected"), (3, "roam"), (4, "disconnected")}


def test_battery_changes_and_first_meetings(spark, tmp_path):
    percents = [(90, False), (20, False), (19, True), (15, False), (10, False), (9, False), (50, False), (5, True)]
    rows = spark.createDataFrame([("r", k, p, c) for k, (p, c) in enumerate(percents)], "run string, pos long, percent int, charging boolean")
    got = {(r["pos"], r["threshold"]) for r in streamed(spark, rows, tmp_path, "battery", stateful.battery_warnings)}
    assert got == {(r["pos"], r["threshold"]) for r in scans.battery_warnings(rows).collect()} == {(1, 20), (4, 10)}
    rows = spark.createDataFrame([("r", k, s, f) for k, (s, f) in enumerate([("a|b", 0.11), ("a|b", 0.19), ("a|b", 0.2), ("b|c", 0.2), ("b|c", 0.21)])], "run string, pos long, stretch string, fraction double")
    assert sorted(r["pos"] for r in streamed(spark, rows, tmp_path, "changes", stateful.answer_changes)) == [0, 2, 3]
    rows = spark.createDataFrame([("r", "k"), ("r", "k"), ("r", "l"), ("q", "k")], "run string, key string")
    assert sorted(tuple(r) for r in streamed(spark, rows, tmp_path, "met", stateful.first_seen)) == [("q", "k"), ("r", "k"), ("r", "l")]


def test_calibrated_and_sessions(spark, tmp_path):
    # Offsets hold from thirty pairs on, and not if they are absurd.
    rows = spark.createDataFrame([(r, k, [off + 0.1 * j for j in range(10)]) for r, off in (("r", 4.0), ("far", 40.0)) for k in range(4)], "run string, seq long, offs array<double>")
    got = {(r["run"], r["seq"]): (r["pairs"], r["offset"]) for r in streamed(spark, rows, tmp_path, "cards", stateful.calibrated)}
    assert {k: v[0] for k, v in got.items()} == {(r, k): 10 * (k + 1) for r in ("r", "far") for k in range(4)}
    assert [got["r", k][1] for k in (0, 1)] == [None, None] and all(abs(got["r", k][1] - 4.45) < 1e-9 for k in (2, 3)) and got["far", 3][1] is None
    rows = spark.sql("select 'r' as run, timestamp '2026-09-05 17:00:00' + make_interval(0, 0, 0, 0, 0, m) as time from values (0), (10), (39), (75), (300) as v(m)")
    got = sorted((r["session_window"]["start"].minute, r["records"]) for r in streamed(spark, rows, tmp_path, "silences", stateful.sessions))
    assert got == [(0, 3), (15, 1)]  # the last one is open still


def test_pace(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r", k, k, float(5 * k), "a|b" if k < 6 else "b|c", (k % 6) / 6 + 0.05 * math.sin(k), 0.02, 90.0) for k in range(12)],
        "run string, seq long, query long, t double, stretch string, fraction double, spread double, length_m double",
    )
    want = {(r["seq"], round(r["fraction"], 9)) for r in sequence.paced(rows).collect()}
    got = {(r["seq"], round(r["fraction"], 9)) for r in streamed(spark, rows, tmp_path, "paces", stateful.paced)}
    assert got == want


def test_follow(spark, tmp_path):
    log = tmp_path / "logs"
    log.mkdir()
    (log / "a.jsonl").write_text(
        "".join(
            f'{{"time": "2026-09-05T17:00:{5 * k:02d}Z", "event": "scan", "outing": "x", "cycle": {k + 1}, "networks": [{{"ssid": "", "bssid": "{b}", "signal_dbm": -60}}]}}\n'
            for k, b in enumerate(["aa", "bb", "zz"])
        )
    )
    fps = spark.createDataFrame([(1, "m", "w", 0, "a|b", 0.1, 0.0, 0.0, 100.0), (2, "m", "v", 99, "b|c", 0.9, 0.0, 0.1, 100.0)],
                                "fp_id long, grp string, walk string, t long, stretch string, fraction double, lat double, lon double, length_m double")
    keys = spark.createDataFrame([(1, "aa", -60.0), (2, "bb", -60.0)], "fp_id long, key string, strength double")
    out = str(tmp_path / "answers")
    query = live.follow(spark, str(log), fps, keys, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [r["stretch"] for r in spark.read.parquet(out).orderBy("seq").collect()] == ["a|b", "b|c"]
    assert F.lit(1) is not None
