"""Polylines, junctions and street graphs.

``lines`` (line_id, name, points: array of (lat, lon)) are the drawn streets of an area and small beside the places that are joined with
them; every spatial join goes through grid cells, so no pair further apart than the reach is looked at.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import distance_m, folded, project
from stridemap.operators.components import connected_components
from stridemap.runtime import shuffled

POINT = "struct<lat:double,lon:double>"


def leg_lengths(points: Column) -> Column:
    """Metres of each leg of a polyline."""
    n = F.size(points)
    return F.zip_with(
        F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: distance_m(a["lat"], a["lon"], b["lat"], b["lon"])
    )


def length_m(points: Column) -> Column:
    return F.aggregate(leg_lengths(points), F.lit(0.0), lambda a, d: a + d)


def point_along(points: Column, fraction: Column) -> Column:
    """The point at a share of a polyline's length; its ends outside 0 to 1."""
    legs = leg_lengths(points)
    goal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)) * length_m(points)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), points[0].alias("at"))

    def step(state: Column, leg: Column) -> Column:
        here = (state["sum"] <= goal) & (leg > 0)
        share = F.least(F.lit(1.0), (goal - state["sum"]) / leg)
        a, b = F.get(points, state["i"]), F.get(points, state["i"] + 1)
        point = F.struct((a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"))
        return F.struct((state["sum"] + leg).alias("sum"), (state["i"] + 1).alias("i"), F.when(here, point).otherwise(state["at"]).alias("at"))

    return F.aggregate(legs, start, step, lambda s: s["at"])


def legs(lines: DataFrame) -> DataFrame:
    """(line_id, name, k, a, b, n) a row per leg."""
    n = F.size("points")
    pairs = F.zip_with(F.slice("points", 1, n - 1), F.slice("points", 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return lines.where(n > 1).select("line_id", "name", n.alias("n"), F.posexplode(pairs).alias("k", "leg")).select("line_id", "name", "n", "k", "leg.a", "leg.b")


def _cells(lat: Column, lon: Column, reach_deg: float) -> Column:
    return F.struct(F.floor(lat / reach_deg).alias("y"), F.floor(lon / reach_deg).alias("x"))


def nearest_on_lines(places: DataFrame, lines: DataFrame, reach_m: float = C.NEAR_CROSSING_M, cell_m: float = 250.0) -> DataFrame:
    """(place_id, line_id, k, along, off_m): the nearest point of every line within reach of a place; the first leg of equals.

    A point at the end of a leg is given as the start of the next. ``places``: place_id, lat, lon.
    """
    deg = cell_m / 111_000.0
    pad = reach_m / 111_000.0 * 2
    a, b = F.col("a"), F.col("b")
    box = lambda c: (F.floor((F.least(a[c], b[c]) - pad) / deg), F.floor((F.greatest(a[c], b[c]) + pad) / deg))
    (y0, y1), (x0, x1) = box("lat"), box("lon")
    drawn = legs(lines).withColumn("y", F.explode(F.sequence(y0, y1))).withColumn("x", F.explode(F.sequence(x0, x1)))
    at = places.select("place_id", "lat", "lon", F.floor(F.col("lat") / deg).alias("y"), F.floor(F.col("lon") / deg).alias("x"))
    met = at.join(drawn, ["y", "x"])
    along, off = project(F.col("lat"), F.col("lon"), F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    met = met.withColumn("along", along).withColumn("off_m", off).where(F.col("off_m") <= reach_m)
    best = met.groupBy("place_id", "line_id").agg(F.min(F.struct(F.round("off_m", 9).alias("off_m"), "k", "along", "n")).alias("m"))
    at_end = (F.col("m.along") >= 1.0) & (F.col("m.k") < F.col("m.n") - 2)
    return best.select(
        "place_id", "line_id", F.when(at_end, F.col("m.k") + 1).otherwise(F.col("m.k")).alias("k"), F.when(at_end, 0.0).otherwise(F.col("m.along")).alias("along"),
        F.col("m.off_m").alias("off_m"),
    )


def blocks(pairs: DataFrame, lines: DataFrame, reach_m: float = C.NEAR_CROSSING_M) -> DataFrame:
    """(pair_id, line_id, points): the run of a drawn street from one mark to the next, marks included.

    The line with the least sum of distances to both marks wins; a run over LONGEST_DETOUR times the chord is no block. ``pairs``:
    pair_id, a_lat, a_lon, b_lat, b_lon. Pairs without a block have no row.
    """
    side = lambda s: pairs.select(F.concat_ws(":", F.col("pair_id").cast("string"), F.lit(s)).alias("place_id"), F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon"))
    near = nearest_on_lines(side("a").union(side("b")), lines, reach_m)
    near = near.withColumn("pair_id", F.split("place_id", ":")[0]).withColumn("side", F.split("place_id", ":")[1])
    ends = {s: near.where(F.col("side") == s).select("pair_id", "line_id", F.col("k").alias(f"{s}_k"), F.col("along").alias(f"{s}_t"), F.col("off_m").alias(f"{s}_off")) for s in "ab"}
    both = ends["a"].join(ends["b"], ["pair_id", "line_id"]).where("a_k <> b_k or a_t <> b_t")
    rows = both.join(lines.select("line_id", "points"), "line_id").join(pairs.withColumn("pair_id", F.col("pair_id").cast("string")), "pair_id")
    ahead = (F.col("a_k") < F.col("b_k")) | ((F.col("a_k") == F.col("b_k")) & (F.col("a_t") < F.col("b_t")))
    rows = rows.withColumn("ahead", ahead)
    pick = lambda c, yes, no: F.when(F.col("ahead"), F.col(f"{yes}_{c}")).otherwise(F.col(f"{no}_{c}"))
    rows = rows.withColumns({"k0": pick("k", "a", "b"), "t0": pick("t", "a", "b"), "k1": pick("k", "b", "a"), "t1": pick("t", "b", "a")})

    def at(k: str, t: str) -> Column:
        p, q = F.get("points", F.col(k)), F.get("points", F.col(k) + 1)
        return F.struct((p["lat"] + (q["lat"] - p["lat"]) * F.col(t)).alias("lat"), (p["lon"] + (q["lon"] - p["lon"]) * F.col(t)).alias("lon"))

    stop = F.when(F.col("t1") > 0, F.col("k1") + 1).otherwise(F.col("k1"))  # vertices strictly inside the run
    inner = F.slice("points", F.col("k0") + 2, F.greatest(stop - F.col("k0") - 1, F.lit(0)))
    run = F.concat(F.array(at("k0", "t0")), inner, F.array(at("k1", "t1")))
    run = F.when(F.col("ahead"), run).otherwise(F.reverse(run))
    mark = lambda s: F.array(F.struct(F.col(f"{s}_lat").alias("lat"), F.col(f"{s}_lon").alias("lon")))
    rows = rows.withColumn("drawn", F.concat(mark("a"), run, mark("b"))).withColumn("length", length_m(F.col("drawn")))
    chord = distance_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    rows = rows.where((chord <= 0) | (F.col("length") <= chord * C.LONGEST_DETOUR))
    best = Window.partitionBy("pair_id").orderBy(F.round(F.col("a_off") + F.col("b_off"), 9), "line_id")
    rows = rows.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return rows.select("pair_id", "line_id", F.col("drawn").alias("points"), F.col("length").alias("length_m"))


def chained(lines: DataFrame) -> DataFrame:
    """Lines of one name that meet end to end as one line, whichever way each was drawn: grouped by name, one street at a time."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        done = end_to_end([[(p["lat"], p["lon"]) for p in points] for points in rows.sort_values("line_id")["points"]])
        name, first = rows["name"].iloc[0], int(rows["line_id"].min())
        return pd.DataFrame({
            "name": [name] * len(done), "line_id": [first + k for k in range(len(done))], "points": [[{"lat": a, "lon": b} for a, b in line] for line in done]
        })

    return lines.groupBy("name").applyInPandas(chain, f"name string, line_id long, points array<{POINT}>")


Line = list[tuple[float, float]]


def end_to_end(pieces: list[Line]) -> list[Line]:
    """Pieces that meet at their ends as few lines, each grown from its first piece; a piece of one point is none."""
    todo, done = [p for p in pieces if len(p) > 1], []
    while todo:
        line, grew = todo.pop(0), True
        while grew:
            grew = False
            for k, other in enumerate(todo):
                ways = ((line, other), (line, other[::-1]), (other, line), (line[::-1], other))
                hit = next(((a, b) for a, b in ways if a[-1] == b[0]), None)
                if hit:
                    line, grew = hit[0] + hit[1][1:], True
                    del todo[k]
                    break
        done.append(line)
    return done


#: Least points of a shape of each layer of the surroundings, and the layers that are areas, which may have several rings.
LEAST_POINTS = {"building": 3, "river": 2, "road": 2, "water": 3, "park": 3}
AREAS = ("water", "park")


def drawn_surroundings(elements: DataFrame) -> DataFrame:
    """(line_id, layer, name, ring, points) of saved answers with geometry (type, id, tags, geometry, members): lines, outlines, and the rings of areas.

    A relation's rings are its outer and inner members joined end to end, one relation at a time; all rings of an area share its ``line_id``, and are filled by the even-odd
    rule. A ring that a missing member leaves open is kept. Points without coordinates are dropped, and shapes with too few points left.
    """
    shapes = surroundings(elements)
    way = F.col("type") == "way"
    known = lambda g: F.coalesce(F.filter(g, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()), F.expr("cast(array() as array<struct<lat:double,lon:double>>)"))
    name = F.when(F.col("layer") == "road", F.col("tags")["name"])
    plain = shapes.where(way).select(F.col("id").alias("line_id"), "layer", name.alias("name"), F.lit(0).alias("ring"), known(F.col("geometry")).alias("points"))
    members = shapes.where(~way & F.col("layer").isin(*AREAS)).select("id", "layer", F.posexplode("members").alias("k", "m"))
    pieces = members.where("m.type = 'way' and m.role in ('outer', 'inner')").select("id", "layer", "k", known(F.col("m.geometry")).alias("points"))

    def close(rows: pd.DataFrame) -> pd.DataFrame:
        done = end_to_end([[(p["lat"], p["lon"]) for p in points] for points in rows.sort_values("k")["points"]])
        return pd.DataFrame({
            "line_id": [int(rows["id"].iloc[0])] * len(done), "layer": [rows["layer"].iloc[0]] * len(done), "name": None, "ring": range(len(done)),
            "points": [[{"lat": a, "lon": b} for a, b in line] for line in done],
        })

    rings = pieces.groupBy("id", "layer").applyInPandas(close, f"line_id long, layer string, name string, ring int, points array<{POINT}>")
    least = F.create_map(*(F.lit(x) for pair in LEAST_POINTS.items() for x in pair))
    return plain.unionByName(rings).where(F.size("points") >= least[F.col("layer")])


def near_pairs(points: DataFrame, reach_m: float, by: list[str]) -> DataFrame:
    """(by, a, b): pairs of points of one group within reach, through grid cells as wide as the reach. Needs point_id, lat, lon.

    The join is always shuffled: of a side that is exploded, Spark's estimate from a file's compressed bytes says nothing.
    """
    deg = reach_m / 111_000.0
    squeeze = F.greatest(F.cos(F.radians(F.col("lat"))), F.lit(0.01))
    y, x = F.floor(F.col("lat") / deg), F.floor(F.col("lon") * squeeze / deg)
    one = points.select(*by, F.col("point_id").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), y.alias("y"), x.alias("x"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-2, -1, 0, 1, 2))))
    two = points.select(*by, F.col("point_id").alias("b"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), y.alias("y0"), x.alias("x0"), around.alias("d"))
    two = two.select(*by, "b", "b_lat", "b_lon", (F.col("y0") + F.col("d.i")).alias("y"), (F.col("x0") + F.col("d.j")).alias("x"))
    gap = distance_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return one.join(shuffled(two), [*by, "y", "x"]).where("a < b").withColumn("gap_m", gap).where(F.col("gap_m") <= reach_m)


def clusters(points: DataFrame, reach_m: float = C.JUNCTION_CLUSTER_M, by: list[str] | None = None) -> DataFrame:
    """``points`` with ``cluster``: the least point id that steps within reach lead to, inside a group."""
    by = by or []
    found = connected_components(near_pairs(points, reach_m, by).select("a", "b"))
    return points.join(shuffled(found.withColumnRenamed("node", "point_id")), "point_id", "left").withColumn("cluster", F.coalesce("component", "point_id")).drop("component")


def middles(clustered: DataFrame, by: list[str]) -> DataFrame:
    """Mean place of each cluster, how many points it has and how far the farthest lies from the middle."""
    keys = [*by, "cluster"]
    mean = clustered.groupBy(*keys).agg(F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"), F.count("*").alias("points"))
    far = clustered.join(mean, keys)
    away = distance_m(F.col("mid_lat"), F.col("mid_lon"), F.col("lat"), F.col("lon"))
    return far.groupBy(*keys, "mid_lat", "mid_lon", "points").agg(F.max(away).alias("spread_m"))


#: Fixed value: the tags under which a way may carry its street's name, in order of preference.
NAME_TAGS = ("name", "alt_name", "short_name", "official_name", "name:es", "loc_name")
#: Fixed value: ways that carry a street's name without being the street.
NOT_STREETS = ("footway", "path", "steps", "cycleway", "construction", "proposed", "platform", "bus_guideway", "raceway")


def ways_by_street(ways: DataFrame, wanted: DataFrame) -> DataFrame:
    """(street, way_id, nodes): each way under the first of its names that is wanted. ``ways``: way_id, tags (map), nodes; ``wanted``: street (folded)."""
    named = ways.withColumn("t", F.explode(F.array(*(F.struct(F.lit(k).alias("p"), F.col("tags")[tag].alias("n")) for k, tag in enumerate(NAME_TAGS)))))
    named = named.where("t.n is not null and not coalesce(array_contains(array('" + "','".join(NOT_STREETS) + "'), tags['highway']), false)")
    named = named.withColumn("street", folded("t.n")).join(wanted.select("street").distinct(), "street", "left_semi")
    return named.groupBy("way_id").agg(F.min_by(F.struct("street", "nodes"), "t.p").alias("m")).select("m.street", "way_id", "m.nodes")


def junctions(corners: DataFrame, streets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(corner_id, outcome, lat, lon, nodes, spread_m, apart_m): where the two streets of each corner meet.

    ``one``: their common nodes are one cluster; ``several``: they meet in places apart; ``near``: no common node, but two within
    NEARBY_JUNCTION_M, whose middle is taken; ``apart``; ``missing``: a street without nodes. ``corners``: corner_id, first, second
    (folded); ``streets``: street, nodes; ``nodes``: node_id, lat, lon.
    """
    at = streets.select("street", F.explode("nodes").alias("node_id")).distinct().join(nodes, "node_id")
    side = lambda c: corners.select("corner_id", F.col(c).alias("street")).join(at, "street").drop("street")
    a, b = side("first"), side("second")
    shared = a.join(b.select("corner_id", "node_id"), ["corner_id", "node_id"])
    spots = shared.withColumn("point_id", F.concat_ws(":", "corner_id", "node_id"))
    mids = middles(clusters(spots, C.JUNCTION_CLUSTER_M, ["corner_id"]), ["corner_id"])
    one = F.struct("mid_lat", "mid_lon", "points", "spread_m")
    met = mids.groupBy("corner_id").agg(F.count("*").alias("groups"), F.first(one).alias("m"))
    # Only corners without a common node are compared pairwise, within reach; the least distance of the rest is not searched.
    alone = lambda rows, mark: rows.join(shared.select("corner_id").distinct(), "corner_id", "left_anti").withColumn("mark", F.lit(mark))
    rest = alone(a, "a").union(alone(b, "b")).withColumn("point_id", F.concat_ws(":", "mark", "node_id"))
    close = near_pairs(rest, C.NEARBY_JUNCTION_M, ["corner_id"]).where("substring(a, 1, 1) <> substring(b, 1, 1)")
    close = close.groupBy("corner_id").agg(F.min(F.struct("gap_m", "a_lat", "a_lon", "b_lat", "b_lon")).alias("c"))
    there = lambda rows, name: rows.select("corner_id").distinct().withColumn(name, F.lit(True))
    rows = corners.join(met, "corner_id", "left").join(close, "corner_id", "left").join(there(a, "has_a"), "corner_id", "left").join(there(b, "has_b"), "corner_id", "left")
    outcome = (
        F.when(F.col("groups") == 1, "one").when(F.col("groups") > 1, "several").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "missing")
        .when(F.col("c").isNotNull(), "near").otherwise("apart")
    )
    mean = lambda c: (F.col(f"c.a_{c}") + F.col(f"c.b_{c}")) / 2
    rows = rows.withColumn("outcome", outcome)
    pick = lambda own, other: F.when(F.col("outcome") == "one", own).when(F.col("outcome") == "near", other)
    return rows.select(
        "corner_id", "outcome", pick(F.col("m.mid_lat"), mean("lat")).alias("lat"), pick(F.col("m.mid_lon"), mean("lon")).alias("lon"),
        pick(F.col("m.points"), F.lit(2)).alias("nodes"), pick(F.col("m.spread_m"), F.col("c.gap_m") / 2).alias("spread_m"),
    )


def implausible(crossings: DataFrame, speed: float = C.MAX_WALK_MS) -> DataFrame:
    """Consecutive crossings (run, ord, t, name, lat, lon) that are too far apart for the time between them."""
    w = Window.partitionBy("run").orderBy("ord")
    later = lambda c: F.lead(c).over(w)
    metres = distance_m(F.col("lat"), F.col("lon"), later("lat"), later("lon"))
    rows = crossings.select("run", "ord", "name", later("name").alias("next_name"), later("ord").alias("next_ord"), (metres / (later("t") - F.col("t"))).alias("speed"), (later("t") - F.col("t")).alias("span"))
    return rows.where((F.col("span") > 0) & (F.col("speed") > speed)).drop("span")


def without_implausible(crossings: DataFrame, placed: DataFrame, speed: float = C.MAX_WALK_MS) -> DataFrame:
    """``placed`` (run, ord, ...) without both ends of every impossible stretch."""
    bad = implausible(crossings, speed)
    ends = bad.select("run", "ord").union(bad.select("run", "next_ord")).distinct()
    return placed.join(ends, ["run", "ord"], "left_anti")


def confusable(names: DataFrame, key: str = "name") -> DataFrame:
    """Corners written with the same two streets in more than one way. Needs ``name``, ``fold_a``, ``fold_b``, ``folded``."""
    pair = F.array_sort(F.array("fold_a", "fold_b"))
    rows = names.where("fold_a is not null").withColumn("corner", F.concat_ws("|", pair))
    return rows.groupBy("corner").agg(F.countDistinct("folded").alias("ways"), F.count("*").alias("n")).where("ways > 1")


def confusable_report(names: DataFrame) -> DataFrame:
    """One row, ``text``: the warning about the corners that ``confusable`` finds, with their spellings; empty if there are none."""
    corner = F.concat_ws("|", F.array_sort(F.array("fold_a", "fold_b")))
    spelled = names.where("fold_a is not null").groupBy(corner.alias("corner"), "folded").agg(F.min("name").alias("name"))
    lines = spelled.groupBy("corner").agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") > 1)
    line = F.concat(F.lit("  "), F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), n, F.lit('"'))), " and "))
    said = lines.agg(F.array_sort(F.collect_list(line)).alias("said"))  # a line a corner of the notebooks
    head = "These crossings are written both ways round, so each is being taken for two\ndifferent corners and the blocks meeting there are split in two:"
    text = F.concat_ws("\n", F.lit(head), F.array_join("said", "\n"), F.lit("Settle on one spelling in the notebook, and do this again."))
    return said.select(F.when(F.size("said") > 0, text).otherwise("").alias("text"))


def bounding_box(points: DataFrame, margin_m: float = C.SURROUNDINGS_M) -> DataFrame:
    """South, west, north and east of all points, with a margin."""
    up = F.degrees(F.lit(margin_m / C.EARTH_RADIUS_M))
    rows = points.where("lat is not null").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("lat", "lon") for f in (F.min, F.max)))
    wide = up / F.greatest(F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)), F.lit(0.01))
    return rows.select(
        (F.col("min_lat") - up).alias("south"), (F.col("min_lon") - wide).alias("west"), (F.col("max_lat") + up).alias("north"), (F.col("max_lon") + wide).alias("east")
    )


def surroundings(elements: DataFrame) -> DataFrame:
    """``elements`` (type, tags) with ``layer``: the first kind that fits; others are left out."""
    tag = lambda name: F.col("tags")[name]
    way = F.col("type") == "way"
    layer = (
        F.when(tag("natural") == "water", "water").when((tag("leisure") == "park") | (tag("landuse") == "grass"), "park").when(way & tag("building").isNotNull(), "building")
        .when(way & tag("waterway").isNotNull(), "river").when(way & tag("highway").isNotNull() & (F.length(tag("name")) > 0), "road")
    )
    return elements.where(F.col("type").isin("way", "relation")).withColumn("layer", layer).where("layer is not null")
