"""Every row is worked on: no filter on ids, no prefix of a text."""

import math

import pytest

from stridemap import constants as C
from stridemap.plans import place_queries


def _customers(spark, tmp_path, keys):
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    rows = place_queries._points(spark, str(tmp_path)).orderBy("point_id").collect()
    lines = {}
    for r in rows:
        lines.setdefault(r["grp"], []).append((r["lat"], r["lon"]))
    return rows, lines


def _project(lat, lon, a, b):
    scale, k = math.cos(math.radians(lat)), C.EARTH_RADIUS_M
    ax, ay = math.radians(a[1] - lon) * scale * k, math.radians(a[0] - lat) * k
    dx, dy = math.radians(b[1] - a[1]) * scale * k, math.radians(b[0] - a[0]) * k
    t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    return t, math.hypot(ax + t * dx, ay + t * dy)


def test_every_point_is_searched_on_every_line(spark, tmp_path):
    rows, lines = _customers(spark, tmp_path, range(1, 43))
    want = set()
    for r in rows:
        lat, lon = r["lat"] + 0.00011, r["lon"] + 0.00013
        for line, p in lines.items():
            legs = [(_project(lat, lon, p[k], p[k + 1]), k) for k in range(len(p) - 1)]
            near = [(round(off, 9), k) for (_, off), k in legs if off <= C.NEAR_CROSSING_M]
            if near:
                want.add((r["point_id"], line, round(min(near)[0], 4)))
    got = place_queries.nearest_on_line(spark, str(tmp_path)).collect()
    assert {(r["place_id"], r["line_id"], r["off_m"]) for r in got} == want and len(got) == len(want)
    assert any(place % 5 for place, _, _ in want)


def test_every_leg_has_its_block(spark, tmp_path):
    rows, lines = _customers(spark, tmp_path, [1, 2, 3, 5, 8, 11, 12, 17, 19, 20, 24, 30])
    want = {}
    for r, s in zip(rows, rows[1:], strict=False):
        if r["grp"] == s["grp"]:
            mid = math.radians((r["lat"] + s["lat"]) / 2)
            north, east = math.radians(s["lat"] - r["lat"]), math.radians(s["lon"] - r["lon"]) * math.cos(mid)
            want[str(r["point_id"])] = (r["grp"], C.EARTH_RADIUS_M * math.hypot(north, east))
    got = place_queries.block_between(spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 8
    for r in got:
        line, length = want[r["pair_id"]]
        assert r["line_id"] == line and r["length_m"] == pytest.approx(length, abs=0.002)
