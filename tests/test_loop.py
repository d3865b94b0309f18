"""The live loop gives, wherever its batches end, the answers of the whole log."""

import json
import random
import time

import pytest

from stridemap import walk
from stridemap.operators.scans import carry_walk
from stridemap.sources import logs
from stridemap.streaming import loop, tail

MAP = "fp_id long, grp string, walk string, t long, stretch string, fraction double, lat double, lon double, length_m double"
#: A stretch and where along the way it begins; the last one hears what the second does, and only the looks before tell the two apart.
STRETCHES = (("a|b", 0), ("b|c", 1), ("c|d", 2), ("x|y", 1))


def level(place, k, draw):
    """The level of access point ``k`` (each a sixth of a stretch further) at a place along all stretches."""
    return round(-50 - 45 * abs(place - k / 6) + draw.uniform(-2, 2))


def the_map(spark, draw):
    fps, keys = [], []
    for stretch, start in STRETCHES:
        for i in range(6):
            place = start + i / 5
            fps.append((len(fps), "m", f"walk of {stretch}", 1000 * len(fps) + 10 * i, stretch, i / 5, 0.001 * place, 0.0, 110.0))
            keys += [(len(fps) - 1, f"k{k}", float(level(place, k, draw))) for k in range(19) if abs(place - k / 6) < 0.6]
    return spark.createDataFrame(fps, MAP), spark.createDataFrame(keys, "fp_id long, key string, strength double")


def log(name, steps, card, draw):
    """Lines of a walk over the stretches by a card that reads ``card`` dB off, with looks that hear nothing known and lines that are none."""
    out = []
    for k in range(steps):
        place = 3 * k / steps
        heard = [{"ssid": "", "bssid": f"k{j}", "signal_dbm": level(place, j, draw) + card} for j in range(19) if abs(place - j / 6) < draw.choice([0.3, 0.6])]
        heard = [{"ssid": "", "bssid": "zz", "signal_dbm": -70}] if k % 7 == 5 else heard
        heard += [{"ssid": "", "bssid": f"k{draw.randrange(19)}", "signal_dbm": -85}] if k % 4 == 1 else []
        heard += [{"ssid": "", "bssid": "pc", "signal_percent": 40}] if k % 3 == 1 else []
        out.append(json.dumps({"time": f"2026-09-05T17:{5 * k // 60:02d}:{5 * k % 60:02d}Z", "event": "scan", "outing": name, "cycle": k + 1, "networks": heard}))
    return [(name, k, v) for k, v in enumerate(out[:4] + ["{half a li"] + out[4:])]


def answers(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize(("order", "by_signal"), [("tie", False), ("path", True)])
def test_any_border_gives_the_answers_of_the_whole_log(spark, tmp_path, order, by_signal):
    draw = random.Random(5)
    fps, keys = the_map(spark, draw)
    rows = log("r1", 20, -6, draw) + log("r2", 16, 3, draw)
    lines = spark.createDataFrame(rows, "file string, pos long, value string")
    # r1 goes on in every batch, r2 in the last two.
    cuts = [[r for r in rows if r[0] == "r1" and r[1] < 3], [r for r in rows if (r[0] == "r1" and 3 <= r[1] < 12) or (r[0] == "r2" and r[1] < 8)],
            [r for r in rows if (r[0] == "r1" and r[1] >= 12) or (r[0] == "r2" and r[1] >= 8)]]
    for part in cuts:
        spark.createDataFrame(part, lines.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
        time.sleep(0.05)  # files are read in the order of their times
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines"))
    out = str(tmp_path / "answers")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        made = loop.follow_walks(stream, fps, keys, lambda df, n: df.write.mode("append").parquet(out), f"file://{tmp_path}/loop", order, by_signal)
        made.run(100)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = logs.sightings(carry_walk(logs.records_of(lines), "outing", "file"))
    whole = walk.located(found, fps, keys, order, by_signal, pace=True)
    want, got = answers(whole), answers(spark.read.parquet(out).select(whole.columns))
    assert got == want and len(want) > 25
    # The state matters: without what came before, some of these answers are others.
    alone = walk.located(found, fps, keys, order, by_signal, pace=False)
    assert answers(alone) != want
    assert any(r["settled"] for r in whole.collect())
    if by_signal:
        runs, asked = walk.asked_of(found)
        off = {r["run"]: r["offset"] for r in walk.sequence.running_offsets(walk.lessons(runs, asked, fps, keys), runs).where("offset is not null").orderBy("seq").collect()}
        assert -8 < off["r1|r1"] < -4 and 1 < off["r2|r2"] < 5


def test_a_log_that_grows(spark, tmp_path):
    draw = random.Random(7)
    fps, keys = the_map(spark, draw)
    given = [r[2] + "\n" for r in log("w", 16, 0, draw)]
    folder, out = tmp_path / "logs", str(tmp_path / "answers")
    folder.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for part in ("".join(given[:8]) + given[8][:30], given[8][30:] + "".join(given[9:])):  # the first ends within a line
            with open(folder / "a", "a") as f:
                f.write(part)
            stream = tail.whole_cycles(tail.tailed(spark, f"file://{folder}"), 10)
            loop.follow_walks(stream, fps, keys, lambda df, n: df.write.mode("append").parquet(out), f"file://{tmp_path}/loop").run(60)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    lines = spark.createDataFrame([("a", k, v) for k, v in enumerate(given)], "file string, pos long, value string")
    columns = ["t", "stretch", "fraction", "lat", "score", "settled", "alternative"]
    whole = answers(walk.located(logs.sightings(carry_walk(logs.records_of(lines), "outing", "file")), fps, keys, pace=True).select(columns))
    got = answers(spark.read.parquet(out).select(columns))
    # The last cycles wait for a later record of their log.
    assert got == whole[: len(got)] and len(whole) - 2 <= len(got) < len(whole)
