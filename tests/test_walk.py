"""The walk operators against hand-computed values and plain Python."""

import json
import math
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stridemap.functions import exprs
from stridemap.operators import geo, matching, placement, publish, scans, sequence
from stridemap.sources import logs, maps, notebook, sinks

TZ = timezone(timedelta(hours=-3))


def test_place_by_clock_and_movement(spark):
    """A stop between two scans: the clock goes on, movement doesn't."""
    w = spark.createDataFrame([("r", 0, 0, "A", -34.0, -56.0), ("r", 1, 600, "B", -34.0, -56.1)], "run string, ord int, t long, name string, lat double, lon double")
    s = spark.createDataFrame(
        [("r", 1, 120, None, ["a", "b"]), ("r", 2, 240, None, ["a", "b"]), ("r", 3, 360, None, ["a", "b"]), ("r", 4, 480, None, ["c", "d"]), ("r", 5, 999, None, ["c"])],
        "run string, scan_id long, t long, interface string, keys array<string>",
    )
    inside = placement.in_segment(s, placement.segments(w))
    assert inside.where("seg is null").count() == 1
    clock = [r["fraction"] for r in placement.place_by_clock(inside).orderBy("t").collect()]
    assert clock == pytest.approx([0.2, 0.4, 0.6, 0.8])
    moved = [r["fraction"] for r in placement.place_by_movement(inside).orderBy("t").collect()]
    assert moved == pytest.approx([0.2, 0.2, 0.2, 0.8])


def test_turnover(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["c", "d"]), (["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in rows.select(placement.turnover(F.col("x"), F.col("y"))).collect()] == pytest.approx([0, 1, 2 / 3, 0])


def test_other_cards_and_holes_say_nothing(spark):
    w = spark.createDataFrame([("r", 0, 0, "A", None, None), ("r", 1, 1000, "B", None, None)], "run string, ord int, t long, name string, lat double, lon double")
    s = spark.createDataFrame(
        [("r", k, t, card, [str(k)]) for k, (t, card) in enumerate([(0, "a"), (10, "a"), (20, "b"), (30, "b"), (200, "b")])],
        "run string, scan_id long, t long, interface string, keys array<string>",
    )
    rows = placement.steps(placement.in_segment(s, placement.segments(w))).orderBy("t").collect()
    assert [r["step"] for r in rows] == [None, 1.0, None, 1.0, None] and rows[-1]["hole"]


@pytest.mark.parametrize("few", [100, 0])
def test_rarity_and_similarity(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_GROUPS", few)
    fps = spark.createDataFrame([(i, "m", f"w{i}", i, "a|b", 0.5, None, None, 100.0) for i in range(1, 5)], "fp_id long, grp string, walk string, t long, stretch string, fraction double, lat double, lon double, length_m double")
    keys = spark.createDataFrame([(i, k, -60.0) for i, ks in enumerate(("AB", "AB", "AB", "AZ"), 1) for k in ks], "fp_id long, key string, strength double")
    got = {r["key"]: r["weight"] for r in matching.rarity(keys, fps).collect()}
    assert got == pytest.approx({"A": math.log(2), "B": math.log(1 + 4 / 3), "Z": math.log(5)})
    q = spark.createDataFrame([(9, "q")], "query long, grp string")
    qk = spark.createDataFrame([(9, "A", -50.0), (9, "Z", -60.0), (9, "new", -70.0)], "query long, key string, strength double")
    a, b, z, new = math.log(2), math.log(1 + 4 / 3), math.log(5), math.log(5)
    scores = {r["fp_id"]: r["score"] for r in matching.similarities(fps, keys, q, qk).collect()}
    assert scores[1] == pytest.approx(a / (a + b + z + new), abs=1e-8) and scores[4] == pytest.approx((a + z) / (a + z + new), abs=1e-8)
    alike = {r["fp_id"]: r["score"] for r in matching.similarities(fps, keys, q, qk, by_signal=True, by_rarity=False).collect()}
    assert alike[4] == pytest.approx(2 / 3 * math.exp(-5 / 10), abs=1e-8)


def test_zero_scores_dilute_a_look(spark):
    fps = spark.createDataFrame(
        [(1, "m", "w", 0, "a|b", 0.2, None, None, None), (2, "m", "w", 10, "a|b", 0.4, None, None, None), (3, "m", "v", 0, "c|d", 0.4, None, None, None)],
        "fp_id long, grp string, walk string, t long, stretch string, fraction double, lat double, lon double, length_m double",
    )
    scores = spark.createDataFrame([("q", 1, 0.4), ("q", 3, 0.25)], "query string, fp_id long, score double")
    found = {r["walk"]: r["score"] for r in matching.looks(scores, fps).collect()}
    assert found == {"w": 0.2, "v": 0.25}
    answer = matching.locations(matching.candidates(matching.looks(scores, fps), fps)).collect()[0]
    assert answer["stretch"] == "c|d"


def test_shares_and_ties(spark):
    ranked = spark.createDataFrame([("q", 1, 0.86, "a|b"), ("q", 2, 0.69, "c|d")], "query string, fp_id long, score double, stretch string")
    fps = ranked.select("fp_id", F.lit("m").alias("grp"), F.col("stretch").alias("walk"), F.lit(0).cast("long").alias("t"), "stretch", F.lit(0.5).alias("fraction"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("length_m"))
    rows = matching.candidates(matching.looks(ranked.drop("stretch"), fps), fps).orderBy("rank").collect()
    assert rows[0]["share"] == pytest.approx(3**1.7 / (3**1.7 + 1))


def plain_path(layers):
    """The likeliest path by enumeration: (stretch of the last layer, share)."""
    def emit(layer):
        tie = len(layer) > 1 and layer[0][1] < 0.6
        return [(s, 0.0 if tie else math.log(p)) for s, p in layer]

    best = dict.fromkeys([])
    state = emit(layers[0])
    for layer in layers[1:]:
        def cost(a, b):
            return 0 if a == b else math.log(0.5) if set(a.split("|")) & set(b.split("|")) else math.log(0.05)

        state = [(s, e + max(p + cost(a, s) for a, p in state)) for s, e in emit(layer)]
    total = sum(math.exp(v) for _, v in state)
    best = max(state, key=lambda x: x[1])
    return best[0], math.exp(best[1]) / total


def test_path_and_vote(spark):
    layers = [[("a|b", 0.9), ("c|d", 0.1)], [("b|e", 0.55), ("c|d", 0.45)], [("c|d", 0.52), ("b|e", 0.48)]]
    rows = [(str(k), j, s, p) for k, layer in enumerate(layers) for j, (s, p) in enumerate(layer, 1)]
    ranked = spark.createDataFrame(rows, "query string, rank long, stretch string, share double")
    runs = spark.createDataFrame([("r", k, str(k)) for k in range(3)], "run string, seq long, query string")
    got = sequence.path(ranked, runs).where("seq = 2").first()
    want = plain_path(layers)
    assert got["stretch"] == want[0] and got["share"] == pytest.approx(want[1])
    voted = sequence.vote(ranked, runs).where("seq = 2").first()
    assert (voted["stretch"], voted["settled"], voted["alternative"]) == ("b|e", 2, "c|d")


def test_pace_moves_over_a_mark():
    track = sequence.Track()
    assert track.placed("a|b", 100.0, 0.9, 0.0, 0) == pytest.approx(0.9)
    track.mean[1] = 1.0
    after = track.placed("b|c", 100.0, 0.0, 0.0, 10)
    assert 0 <= after <= 0.05 and track.stretch == "b|c"
    assert sequence.Track().placed("a|b", None, 0.4, 0.1, 0) == 0.4


def test_a_place_has_one_measure_for_each_stretch_at_a_mark():
    """90 m from a towards b at 1 m/s, 10 m before the mark b: on stretches of 50 m that begin or end at b, and on one without it."""
    track = sequence.Track("a|b", 100.0, [90.0, 1.0])
    assert track.on("b|c", 50.0) == [-10.0, 1.0] and track.on("c|b", 50.0) == [60.0, -1.0] and track.on("c|d", 50.0) is None
    assert track.on("a|e", 50.0) == [-90.0, -1.0] and track.on("e|a", 50.0) == [140.0, 1.0] and track.on("a|b", 100.0) == [90.0, 1.0]
    mean, spread = sequence.predicted([0.0, 2.0], [[4.0, 1.0], [1.0, 9.0]], 3.0)
    q = sequence.C.PACE_ACCELERATION**2
    assert mean == [6.0, 2.0] and spread[0] == pytest.approx([4 + 6 + 81 + q * 81 / 4, 1 + 27 + q * 13.5]) and spread[1] == pytest.approx([28 + q * 13.5, 9 + 9 * q])
    mean, spread = sequence.corrected([6.0, 2.0], [[4.0, 2.0], [2.0, 9.0]], 8.0, 4.0)
    assert mean == [7.0, 2.5] and spread == [[2.0, 1.0], [1.0, 8.5]]


def test_debounce_counts_from_the_last_accepted(spark):
    rows = spark.createDataFrame([("r", k, float(t)) for k, t in enumerate([0, 6, 12, 18, 40])], "run string, pos long, t double")
    assert sorted(r["pos"] for r in scans.accepted_presses(rows, 10.0).collect()) == [0, 2, 4]


def test_debounce_by_doubled_pointers(spark):
    """Long chains, ties, tenths that floats round, runs without a name and presses without a time, against a plain fold; no list in the plan."""
    draw = random.Random(6)
    rows = [("long", k, float(k)) for k in range(300)] + [("alike", k, 5.0) for k in range(20)] + [("tenths", k, k / 10) for k in range(120)]
    rows += [(None, k, draw.randrange(2000) / 10) for k in range(80)] + [("late", 0, None), ("late", 1, 3.0), ("late", 2, 3.1)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, pos long, t double")
    for gap in (2.5, 0.3, 0.7, 0.0):
        want, last = [], {}
        for run, pos, t in sorted(rows, key=lambda x: (x[0] or "", x[2] is not None, x[2] or 0.0, x[1])):
            if t is None or last.get(run) is None or t - last[run] >= gap:
                want.append((run or "", pos))
                last[run] = t
        got = scans.accepted_presses(df, gap)
        assert sorted((r["run"] or "", r["pos"]) for r in got.collect()) == sorted(want)
        assert "collect_list" not in got._jdf.queryExecution().toString()
    assert scans.accepted_presses(df.where("false"), 2.5).collect() == []


def test_log_door(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text(
        '{"time": "2026-09-05T17:45:00-03:00", "event": "scan", "outing": "x", "cycle": 1, "networks": [{"ssid": "a", "bssid": "AA:BB", "signal_dbm": -47.5, "connected": true}, 5,'
        ' {"ssid": 5, "connected": "false", "signal_dbm": 100000}]}\n'
        '{"time": "2026-09-05T17:45:00", "event": "scan", "cycle": 1.7}\n{"x": NaN}\n[1, 2, 3]\n{"a": 1, "a": 2, "cycle": true, "event": "mark", "number": 3}\n{"time": "2026-09\n'
    )
    rows = logs.read_log(spark, str(p)).orderBy("pos").collect()
    assert [r["event"] for r in rows] == ["scan", "scan", "mark"] and [r["walk"] for r in rows] == ["x"] * 3
    first, second = rows[0]["networks"]
    assert (first["bssid"], first["signal_dbm"], first["connected"]) == ("aa:bb", -47, True) and (second["ssid"], second["signal_dbm"], second["connected"]) == ("", None, False)
    assert rows[0]["time"] is not None and rows[0]["utc_offset_s"] == -10800 and rows[1]["time"] is None and rows[1]["cycle"] is None and rows[2]["cycle"] is None
    assert logs.count_lost(spark, str(p)).first()["lost"] == 2
    line = json.loads(sinks.encoded_records(logs.read_log(spark, str(p)).where("pos = 0")).first()["value"])
    assert line["time"] == "2026-09-05T17:45:00-03:00" and line["networks"][0]["security"] is None


def test_notebook():
    text = "17:45 A\ndate 2026-09-06\n00:10 C @ -34.9, -56.1 # seen\n"
    read = notebook.Reader("n", date(2026, 9, 5), -10800).read(text.splitlines())
    assert [(t.isoformat(), n, a) for t, n, a, _ in read] == [("2026-09-05T17:45:00-03:00", "A", None), ("2026-09-06T00:10:00-03:00", "C", -34.9)]
    over = notebook.Reader("n", date(2026, 9, 5), 0).read(["23:50 A", "00:10 B"])
    assert (over[1][0] - over[0][0]).total_seconds() == 1200
    marks = [(k, datetime(2026, 9, 5, 17, k, tzinfo=TZ)) for k in (1, 2, 7)]
    assert [t.minute for t, *_ in notebook.Reader("n", date(2026, 9, 5), -10800, marks).read(["A", "#7 B"])] == [1, 7]
    for bad in (["17:0 A", "18:00 B"], ["date 2026-9-6"], ["25:00 A"], ["17:00 A"], ["17:00 A @ -99, 0", "18:00 B"], ["17:00 A", "2026-09-04 10:00 B"]):
        with pytest.raises(notebook.NotebookError):
            notebook.Reader("n", date(2026, 9, 5), 0).read(bad)
    with pytest.raises(notebook.UntimedNotebook):
        notebook.Reader("n", date(2026, 9, 5), 0).read(["A", "B"])
    assert notebook.geocoded("17:00 A # x\r\n18:00 B\r\n", {1: (-34.9, -56.1)}) == "17:00 A @ -34.900000, -56.100000 # x\r\n18:00 B\r\n"


def test_notebook_lines_are_told_by_how_they_begin():
    say = lambda raw: notebook.entry(1, raw)
    assert (say("17:45:10 A y B @ -34.9 , 56 # x").clock, say("17:45 A @ -34.9,56").place, say("17:45 A @ home").name) == ((17, 45, 10), (-34.9, 56.0), "A @ home")
    assert (say("2026-09-05T07:45 A").day, say("2026-09-05 7:45 A").clock, say("DATE 2026-09-05").day) == ("2026-09-05", (7, 45), "2026-09-05")
    assert say("#7 A # seen").mark == 7 and say("\ufeff#7 A").mark == 7 and say("# only a comment") is None and say("   ") is None and say("#7") is None
    assert all(say(x).wrong for x in ("date", "date soon", "date: 2026-09-05", "17 : 45 A", "2026-09 A", "17:5 A", "17:45"))
    assert say("dates of A").name == "dates of A" and say("1st street").name == "1st street"
    marks = [(k, datetime(2026, 9, 5, 17, k, tzinfo=TZ)) for k in (1, 2, 7)]
    for bad in (["#1 A", "#1 B"], ["#3 A", "B"], ["#7 A", "B"]):
        with pytest.raises(notebook.NotebookError):
            notebook.Reader("n", date(2026, 9, 5), -10800, marks).read(bad)
    with pytest.raises(notebook.NotebookError):
        notebook.Reader("n", date(2026, 9, 5), 0, [(1, marks[0][1]), (1, marks[1][1])]).read(["A", "B"])


def test_map_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "map")
    n = [("a", "aa:bb", None, None, -60, None, False)]
    fps = spark.createDataFrame([(0, "o1", "o1#0", datetime(2026, 9, 5), "B", "A", 0.25, -34.9, -56.1, 100.0, n)], maps.fingerprints_of(spark.createDataFrame([], "file string, pos long, value string")).schema)
    assert maps.append_map(fps, path) == 1 and maps.append_map(fps, path) == 0
    row = maps.with_stretch(maps.read_map(spark, path)).first()
    assert (row["stretch"], row["fraction"], row["networks"][0]["bssid"]) == ("a|b", 0.75, "aa:bb")


def test_map_append_of_two_writers(spark, tmp_path, monkeypatch):
    """Both find the outing absent; the second to commit adds nothing. An outing is there whole or not at all, and no cache is left behind."""
    path = str(tmp_path / "map")
    schema = maps.fingerprints_of(spark.createDataFrame([], "file string, pos long, value string")).schema
    rows = lambda outing, n: spark.createDataFrame([(k, outing, "w", datetime(2026, 9, 5), "B", "A", 0.25, None, None, None, []) for k in range(n)], schema)
    assert maps.append_map(rows("o1", 3), path) == 3
    absent = maps.read_map(spark, str(tmp_path / "none"))
    with monkeypatch.context() as m:  # the second writer read the map before the first one wrote
        m.setattr(maps, "read_map", lambda *_: absent)
        assert maps.append_map(rows("o1", 3).union(rows("o2", 2)), path) == 2
    assert {(r["outing"], r["count"]) for r in maps.read_map(spark, path).groupBy("outing").count().collect()} == {("o1", 3), ("o2", 2)}
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(maps, "_renamed", lambda *_: (_ for _ in ()).throw(RuntimeError()))
        maps.append_map(rows("o3", 2), path)
    assert maps.read_map(spark, path).count() == 5 and not [p for p in (tmp_path / "map").iterdir() if p.name.startswith("_staging")]
    assert maps.append_map(rows("o3", 2), path) == 2 and maps.append_map(rows(None, 1), path) == maps.append_map(rows(None, 1), path) == 1


def test_geometry(spark):
    line = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01)]
    df = spark.createDataFrame([(1, "s", line)], f"line_id long, name string, points array<{geo.POINT}>")
    total = df.select(geo.length_m(F.col("points"))).first()[0]
    assert total == pytest.approx(2 * 6371000 * math.radians(0.01), rel=1e-6)
    half = df.select(geo.point_along(F.col("points"), F.lit(0.5)).alias("p")).first()["p"]
    assert (half["lat"], half["lon"]) == pytest.approx((0.0, 0.01), abs=1e-9)
    pieces = spark.createDataFrame([(1, "s", line[:2]), (2, "s", [line[2], line[1]]), (3, "t", line[:2])], df.schema)
    assert sorted((r["name"], len(r["points"])) for r in geo.chained(pieces).collect()) == [("s", 3), ("t", 2)]
    pair = spark.createDataFrame([("p", 0.0, 0.002, 0.008, 0.01)], "pair_id string, a_lat double, a_lon double, b_lat double, b_lon double")
    block = geo.blocks(pair, df).first()
    assert block["length_m"] == pytest.approx(6371000 * math.radians(0.016), rel=1e-4)


def test_junctions(spark):
    streets = spark.createDataFrame([("agraciada", [10, 11, 12]), ("freire", [10, 20]), ("solari", [12, 30]), ("far", [40])], "street string, nodes array<long>")
    nodes = spark.createDataFrame([(10, -34.9, -56.2), (11, -34.9, -56.201), (12, -34.9, -56.202), (20, -34.901, -56.2), (30, -34.901, -56.202), (40, -34.95, -56.3)], "node_id long, lat double, lon double")
    corners = spark.createDataFrame([("1", "freire", "agraciada"), ("2", "freire", "far"), ("3", "freire", "nowhere")], "corner_id string, first string, second string")
    got = {r["corner_id"]: (r["outcome"], r["lat"]) for r in geo.junctions(corners, streets, nodes).collect()}
    assert got == {"1": ("one", -34.9), "2": ("apart", None), "3": ("missing", None)}


def test_pseudonyms_are_keyed_digests(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("Rivera y Brito",), ("BRITO, Rívera",), ("Plaza",)], "name string")
    names = [r[0] for r in df.select(publish.crossing(b"k", F.col("name"))).collect()]
    one = "street-" + hmac.new(b"k", "street\0rivera".encode(), hashlib.sha256).hexdigest()[:12]
    assert names[0].split(" y ")[0] == one == names[1].split(", ")[1] and names[2].startswith("place-")
    leaks = publish.survivors(spark.createDataFrame([("Casa",), ("nobody",)], "value string"), spark.createDataFrame([("my CASA, casa",)], "text string"))
    assert [(r["value"], r["occurrences"]) for r in leaks.collect()] == [("casa", 2)]


def test_channels_and_text(spark):
    df = spark.createDataFrame([(2412, 1), (2484, 14), (5180, 36), (5955, 1), (900, None)], "mhz int, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", exprs.channel(F.col("mhz")).alias("got")).collect())
    lines = spark.createDataFrame([("#7 A # x", "#7 A"), ("17:00 B # y", "17:00 B"), ("# only", "")], "line string, want string")
    assert all(r["got"] == r["want"] for r in lines.select("want", exprs.strip_comment(F.col("line")).alias("got")).collect())
    names = spark.createDataFrame([("  Simón   BOLÍVAR ñ ",)], "name string")
    assert names.select(exprs.folded("name")).first()[0] == "simon bolivar n"
