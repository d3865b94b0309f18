"""Rings of saved answers, and small texts, against values worked out by hand."""

import json

from pyspark.sql import functions as F

from stridemap.functions import exprs
from stridemap.operators import geo, matching
from stridemap.sources import maps

A, B, C, D, E = (0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.5, 0.5)


def at(*points):
    return [{"lat": a, "lon": b} for a, b in points]


def member(role, *points, kind="way"):
    return {"type": kind, "role": role, "geometry": at(*points)}


ELEMENTS = [
    {"type": "way", "id": 1, "tags": {"leisure": "park", "landuse": "grass", "building": "yes"}, "geometry": at(A, B, C, A)},
    {"type": "relation", "id": 2, "tags": {"natural": "water"}, "members": [member("outer", A, B), member("outer", C, B), member("outer", C, D), member("outer", D, A), member("label", A, C)]},
    # An inner ring beside the outer one, a member that is no way, and one of a single point.
    {"type": "relation", "id": 3, "tags": {"landuse": "grass"}, "members": [member("outer", A, B, C, A), member("inner", E, D, B), member("inner", B, E), member("outer", D, kind="node"), member("outer", D)]},
    {"type": "relation", "id": 4, "tags": {"natural": "water"}, "members": [member("outer", A, B), member("outer", B, C, D)]},  # a gap between D and A
    {"type": "relation", "id": 5, "tags": {"natural": "water"}, "members": [member("outer", A, B), member("outer", C, D)]},  # pieces that don't meet are no rings
    {"type": "relation", "id": 6, "tags": {"building": "yes"}, "members": [member("outer", A, B, C, A)]},  # only areas are put together
    {"type": "way", "id": 7, "tags": {"highway": "residential", "name": "Rivera"}, "geometry": [*at(A), {"lat": 1.0}, *at(B)]},
    {"type": "way", "id": 8, "tags": {"highway": "residential", "name": ""}, "geometry": at(A, B)},
    {"type": "way", "id": 9, "tags": {"waterway": "river"}, "geometry": at(A)},
    {"type": "way", "id": 10, "tags": {"natural": "water"}},
    {"type": "node", "id": 11, "tags": {"natural": "water"}, "lat": 0.0, "lon": 0.0},
]
RINGS = {
    (1, "park", 0): [A, B, C, A], (2, "water", 0): [A, B, C, D, A], (3, "park", 0): [A, B, C, A], (3, "park", 1): [E, D, B, E], (4, "water", 0): [A, B, C, D],
    (7, "road", 0): [A, B],
}


def test_rings_are_closed_from_their_members(spark, tmp_path):
    path = tmp_path / "answer.json"
    path.write_text(json.dumps({"elements": ELEMENTS}))
    drawn = geo.drawn_surroundings(maps.read_overpass(spark, str(path))[0])
    got = {(r["line_id"], r["layer"], r["ring"]): [(p["lat"], p["lon"]) for p in r["points"]] for r in drawn.collect()}
    assert got == RINGS
    assert [r["name"] for r in drawn.where("layer = 'road'").collect()] == ["Rivera"]
    # Written and read again, an area keeps its rings together.
    maps.encoded_streets(drawn).coalesce(1).write.text(str(tmp_path / "streets"))
    back = maps.read_streets(spark, str(tmp_path / "streets")).groupBy("layer", "line_id").agg(F.count("*").alias("n")).collect()
    assert sorted((r["layer"], r["n"]) for r in back) == [("park", 1), ("park", 2), ("road", 1), ("water", 1), ("water", 1)]


def test_pieces_join_whichever_way_they_were_drawn():
    assert geo.end_to_end([[A, B], [C, B], [C, D], [D]]) == [[A, B, C, D]]
    assert geo.end_to_end([[A, B], [C, D]]) == [[A, B], [C, D]]
    assert geo.end_to_end([[B, A], [B, C], [D, A]]) in ([[D, A, B, C]], [[C, B, A, D]])
    assert geo.end_to_end([]) == []


def test_small_texts(spark):
    rows = spark.createDataFrame([(True, True, 100.0, 0.125), (True, False, 101.0, 0.5), (False, None, None, 0.5), (None, True, 10.0, None)], "b boolean, f boolean, m double, x double")
    got = [tuple(r) for r in rows.select(exprs.caveats(F.col("b"), F.col("f")), exprs.and_metres(F.col("m"), F.col("x"))).collect()]
    assert got == [(" (barely pinned down, few sightings)", " (12 m)"), (" (barely pinned down)", " (50 m)"), ("", ""), (" (few sightings)", "")]
    names = [("A y B", "a", "b", "a y b"), ("B y A", "b", "a", "b y a"), ("b y a", "b", "a", "b y a"), ("C y D", "c", "d", "c y d"), ("Plaza", None, None, "plaza")]
    told = lambda n: geo.confusable_report(spark.createDataFrame(n, "name string, fold_a string, fold_b string, folded string")).collect()
    text = told(names)[0]["text"]
    assert text.split("\n")[2] == '  "A y B" and "B y A"' and len(text.split("\n")) == 4 and told(names[3:]) == [("",)]
    fps = spark.createDataFrame([("o", 1.0, 2.0), ("o", None, 2.0), (None, 3.0, 4.0)], "outing string, lat double, lon double")
    assert sorted(tuple(r) for r in matching.mapped_places(fps).collect()) == [(1.0, 2.0), (3.0, 4.0)]
    assert matching.can_hold_out(fps).first()[0] and not matching.can_hold_out(fps.where("outing = 'o'")).first()[0]
