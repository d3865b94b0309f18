"""Fingerprint maps, street shapes and saved street-graph answers: JSON in, JSON out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.functions.exprs import both_or_none, canonical, folded
from stridemap.operators.geo import AREAS, POINT
from stridemap.runtime import delete_path
from stridemap.runtime import renamed as _renamed
from stridemap.sources.logs import lines_of, moment, networks, number, parsed, text


def fingerprints_of(lines: DataFrame) -> DataFrame:
    """Lines (file, pos, value) -> fingerprints; rows without both names and a fraction from 0 to 1 are left out."""
    v = F.col("v")
    at, _ = moment(v)
    lat, lon = both_or_none(number(v, "lat", -90, 90), number(v, "lon", -180, 180))
    rows = parsed(lines).where(v.isNotNull()).select(
        F.col("pos").alias("fp_id"), text(v, "outing").alias("outing"), text(v, "walk").alias("walk"), at.alias("time"), text(v, "from").alias("name_from"),
        text(v, "to").alias("name_to"), number(v, "fraction", 0, 1).alias("fraction"), lat.alias("lat"), lon.alias("lon"), number(v, "length_m", 0, 1e9).alias("length_m"),
        networks(v).alias("networks"),
    )
    return rows.where("name_from is not null and name_to is not null and fraction is not null")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprints of a map in file order; a path that doesn't exist is an empty map, one that can't be read an error."""
    try:
        return fingerprints_of(lines_of(spark, path, deep=True))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return fingerprints_of(spark.createDataFrame([], "file string, pos bigint, value string"))


def with_stretch(fps: DataFrame) -> DataFrame:
    """``fps`` in the canonical direction, with ``stretch`` (folded names), as the matching operators take them."""
    rows = fps.withColumn("a", folded("name_from")).withColumn("b", folded("name_to"))
    ahead = canonical(F.col("a"), F.col("b"))
    return rows.withColumn("stretch", F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))).withColumn(
        "fraction", F.when(ahead, F.col("fraction")).otherwise(1.0 - F.col("fraction"))
    ).drop("a", "b")


def encoded(fps: DataFrame) -> DataFrame:
    """Map rows as JSON lines, numbers rounded to half even; security and frequency stay out, missing fields too."""
    networks_ = F.transform("networks", lambda n: F.struct(n["ssid"].alias("ssid"), n["bssid"].alias("bssid"), n["signal_dbm"].alias("signal_dbm"), n["signal_percent"].alias("signal_percent")))
    row = F.struct(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("time"), "outing", "walk", F.col("name_from").alias("from"), F.col("name_to").alias("to"),
        F.bround("fraction", 4).alias("fraction"), F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), F.bround("length_m", 1).alias("length_m"), networks_.alias("networks"),
    )
    return fps.select("outing", F.to_json(row).alias("value"))


def append_map(fps: DataFrame, path: str) -> int:
    """Add the outings that a map (a folder of JSON lines) doesn't hold; the number of fingerprints added.

    Rows are staged beside the map, hidden from readers, in a folder for each outing. A folder becomes part of the map by one rename, which is refused if
    the outing's folder is there: of two callers with one outing the first adds it, the other nothing. An outing is on the map as a whole or not at all, and a call
    that broke off can be made again. Fingerprints without an outing are added each time.
    """
    from stridemap.operators.matching import append_outings

    spark = fps.sparkSession
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    part = F.coalesce(F.concat(F.lit("outing-"), F.sha2("outing", 256)), F.lit(f"unnamed-{uuid.uuid4().hex}"))
    encoded(append_outings(fps, read_map(spark, path))).select(part.alias("part"), "value").write.partitionBy("part").text(staging)
    try:
        staged = spark.read.schema("value string, part string").text(staging).groupBy("part").agg(F.count("*").alias("n")).collect()  # a row an outing
        return sum(r["n"] for r in staged if _renamed(spark, f"{staging}/part={r['part']}", f"{path.rstrip('/')}/{r['part']}"))
    finally:
        delete_path(spark, staging)


#: Layers of street shapes, and the least points of a shape of each.
LAYERS = {"street": 2, "road": 2, "river": 2, "building": 3, "water": 3, "park": 3}


def _points(v: Column, path: str, least: int) -> Column:
    """An array of [lat, lon] pairs; broken pairs are dropped, and a shape with too few left is null."""
    items = F.try_variant_get(v, path, "array<array<double>>")
    good = F.filter(items, lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).between(-90, 90) & F.get(p, F.lit(1)).between(-180, 180))
    points = F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("lat"), F.get(p, F.lit(1)).alias("lon")))
    return F.when(F.size(points) >= least, points)


def read_streets(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, layer, name, points): a row per line or ring."""
    rows = parsed(lines_of(spark, path)).where("v is not null")
    v = F.col("v")
    shapes = []
    for layer, least in LAYERS.items():
        if layer in ("street", "road"):
            one = rows.select(F.lit(layer).alias("layer"), "pos", text(v, layer).alias("name"), _points(v, "$.line", least).alias("points")).where("name is not null")
        elif layer in ("building", "river"):
            one = rows.select(F.lit(layer).alias("layer"), "pos", F.lit(None).cast("string").alias("name"), _points(v, f"$.{layer}", least).alias("points"))
        else:
            rings = rows.select("pos", F.explode(F.try_variant_get(v, f"$.{layer}", "array<variant>")).alias("v"))
            one = rings.select(F.lit(layer).alias("layer"), "pos", F.lit(None).cast("string").alias("name"), _points(F.col("v"), "$", least).alias("points"))
        shapes.append(one.where("points is not null"))
    out = shapes[0]
    for one in shapes[1:]:
        out = out.union(one)
    return out.select(F.col("pos").alias("line_id"), "layer", "name", F.col("points").cast(f"array<{POINT}>").alias("points"))


def encoded_streets(lines: DataFrame) -> DataFrame:
    """Street shapes (line_id, layer, name, points, and ``ring`` where areas have several) as JSON lines, an area's rings in one, coordinates to seven decimals."""
    rows = lines if "ring" in lines.columns else lines.withColumn("ring", F.lit(0))
    pairs = F.transform("points", lambda p: F.array(F.bround(p["lat"], 7), F.bround(p["lon"], 7)))
    rows = rows.select("line_id", "layer", "name", "ring", pairs.alias("line"))
    shape = lambda key: F.to_json(F.struct(F.col("line").alias(key)))
    value = F.when(F.col("layer") == "building", shape("building")).when(F.col("layer") == "river", shape("river"))
    for layer in ("street", "road"):
        value = value.when(F.col("layer") == layer, F.to_json(F.struct(F.col("name").alias(layer), "line")))
    rings = rows.where(F.col("layer").isin(*AREAS)).groupBy("layer", "line_id").agg(F.array_sort(F.collect_list(F.struct("ring", "line"))).alias("rings"))
    area = F.lit(None).cast("string")
    for layer in AREAS:
        area = F.when(F.col("layer") == layer, F.to_json(F.struct(F.transform("rings", lambda r: r["line"]).alias(layer)))).otherwise(area)
    return rows.where(~F.col("layer").isin(*AREAS)).select(value.alias("value")).unionByName(rings.select(area.alias("value")))


OVERPASS = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,"
    "members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"
)


def read_overpass(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, ways, nodes) of saved street-graph answers."""
    rows = spark.read.schema(OVERPASS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    ways = rows.where("type = 'way'").select(F.col("id").alias("way_id"), F.coalesce("tags", F.expr("cast(map() as map<string,string>)")).alias("tags"), "nodes")
    nodes = rows.where("type = 'node' and lat is not null and lon is not null").select(F.col("id").alias("node_id"), "lat", "lon")
    return rows, ways, nodes


def drawn_ways(streets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line_id, name, points): ways with the coordinates of their nodes, in order; nodes without any are dropped."""
    at = streets.select("street", "way_id", F.posexplode("nodes").alias("k", "node_id")).join(nodes, "node_id")
    points = at.groupBy("street", "way_id").agg(F.array_sort(F.collect_list(F.struct("k", "lat", "lon"))).alias("p"))
    rows = points.select(F.col("way_id").alias("line_id"), F.col("street").alias("name"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("points"))
    return rows.where(F.size("points") > 1)
