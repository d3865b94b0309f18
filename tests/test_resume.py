"""A stream that is cut and carried on from its log says what the uncut one says."""

import json

import pytest

from stridemap.sources import logs
from stridemap.streaming import resume


def lines(n=24, first_walk=9):
    """A log of two walks: marks numbered from one in each, cycles throughout, an anonymous network, and a line that is none."""
    out, marks, cycles = [], 0, 0
    for k in range(n):
        walk = "w1" if k < first_walk else "w2"
        marks = 0 if k == first_walk else marks
        base = {"time": f"2026-09-05T17:{k:02d}:00-03:00", "outing": walk}
        if k % 4 == 3:
            marks += 1
            out.append({**base, "event": "mark", "number": marks})
        else:
            cycles += 1
            found = [{"ssid": f"n{(k * j) % 11}", "bssid": f"aa:bb:cc:dd:ee:{(k * j) % 11:02x}", "signal_dbm": -60} for j in range(1, 4)]
            out.append({**base, "event": "scan", "cycle": cycles, "networks": [*found, *([{"signal_dbm": -70}] if k % 5 == 0 else [])]})
    return [json.dumps(x) for x in out[:5]] + ["{half a li"] + [json.dumps(x) for x in out[5:]]


def records(spark, given, first=0):
    rows = spark.createDataFrame([("f", first + k, line) for k, line in enumerate(given)], "file string, pos long, value string")
    from stridemap.operators.scans import carry_walk

    return carry_walk(logs.records_of(rows), "outing", "file")


def told(spark, tmp_path, events, name, state=None):
    folder = str(tmp_path / name)
    events.orderBy("pos").coalesce(1).write.option("maxRecordsPerFile", 7).parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        query = resume.announced(stream, state).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
        query.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).start().awaitTermination(240)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return {tuple(r) for r in spark.table(name).collect()}


@pytest.mark.parametrize("cut", [0, 2, 13])
def test_resumed_equals_uncut(spark, tmp_path, cut):
    given = lines(first_walk=0)
    expected = {tuple(r) for r in resume.announced_batch(resume.events_of(records(spark, given))).collect()}
    if not cut:
        assert told(spark, tmp_path, resume.events_of(records(spark, given)), "uncut") == expected
        return
    old, rest = records(spark, given[:cut]), resume.events_of(records(spark, given[cut:], cut))
    before = {tuple(r) for r in resume.announced_batch(resume.events_of(old)).collect()}
    after = told(spark, tmp_path, rest, f"cut{cut}", resume.carried(old))
    assert before | after == expected and not before & after
    numbers = [r[4] for r in expected if r[2] == "cycle"]
    assert len(numbers) == len(set(numbers)) == 18


def test_what_a_log_carries_over(spark):
    given = lines()
    state = resume.carried(records(spark, given)).collect()
    heard = {r["key"] for r in state if r["key"] is not None}
    expected = {n.get("bssid", "") for x in given if "networks" in x for n in json.loads(x)["networks"]}
    assert heard == expected and "" in heard
    counts = [(r["marks"], r["cycles"]) for r in state if r["key"] is None]
    marks = [json.loads(x)["number"] for x in given if '"mark"' in x and '"w2"' in x]
    assert counts == [(max(marks), max(json.loads(x)["cycle"] for x in given if '"cycle"' in x))] and len(state) == len(expected) + 1
    older = resume.carried(records(spark, given[:8])).collect()  # the first walk's marks are its own
    assert [r["marks"] for r in older if r["key"] is None] == [1]
    assert resume.carried(records(spark, ["{"])).collect() == []
