"""Views of the driver's tables in the walk analytics' schemas, in integer arithmetic that SQL repeats exactly.

``events`` become a month of hourly looks: an event is a sighting, its day an outing, its user (modulo 40) a network, its type the
card that heard it. Crossings lie at 0, 6, 12, 18 and 24 h: A, B, C, B, A, so that each stretch is walked there and back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.functions import exprs
from stridemap.operators import networks, placement

#: name, latitude, longitude of the crossings in order
CROSSINGS = [
    ("Plaza A", -34.9, -56.15), ("Calle B", -34.901, -56.152), ("Esquina C", -34.903, -56.155), ("Calle B", -34.901, -56.152), ("Plaza A", -34.9, -56.15),
]

E_SQL = """
e AS (SELECT event_id AS pos, epoch_us(ts) // 1000000 AS t, strftime(ts, '%Y-%m-%d') AS run, epoch_us(ts) // 3600000000 AS scan_id,
  'k' || (user_id % 40) AS key, event_type AS interface, (-100 + floor(value / 10))::BIGINT AS dbm, user_id, value, props,
  CASE WHEN user_id % 7 = 0 THEN 'open' ELSE 'psk' END AS security FROM events),
names AS (SELECT * FROM (VALUES (0, 'Plaza A', -34.9::DOUBLE, -56.15::DOUBLE), (1, 'Calle B', -34.901::DOUBLE, -56.152::DOUBLE), (2, 'Esquina C', -34.903::DOUBLE, -56.155::DOUBLE),
  (3, 'Calle B', -34.901::DOUBLE, -56.152::DOUBLE), (4, 'Plaza A', -34.9::DOUBLE, -56.15::DOUBLE)) v(ord, name, lat, lon)),
wp AS (SELECT run, ord, day * 86400 + ord * 21600 AS t, name, lat, lon FROM (SELECT DISTINCT run, t // 86400 AS day FROM e) d, names),
segs AS (SELECT a.run, a.ord AS seg, a.t AS start_t, b.t AS end_t, a.name AS start_name, b.name AS end_name, a.lat AS start_lat, a.lon AS start_lon,
  b.lat AS end_lat, b.lon AS end_lon FROM wp a JOIN wp b ON a.run = b.run AND b.ord = a.ord + 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings: pos, t, run (day), scan_id (hour), key, interface, dbm, strength, security."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    rows = rows.select(F.col("event_id").alias("pos"), t.alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("run"), "user_id", "value", "props", F.col("event_type").alias("interface"))
    return rows.select(
        "pos", "t", "run", F.floor(F.col("t") / 3600).alias("scan_id"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), "interface",
        (F.floor(F.col("value") / 10) - 100).alias("dbm"), (F.floor(F.col("value") / 10) - 100).cast("double").alias("strength"), "user_id", "value", "props",
        F.when(F.col("user_id") % 7 == 0, "open").otherwise("psk").alias("security"),
    )


def waypoints(e: DataFrame) -> DataFrame:
    """Five crossings a day."""
    marks = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(n).alias("name"), F.lit(a).alias("lat"), F.lit(o).alias("lon")) for k, (n, a, o) in enumerate(CROSSINGS)))
    days = e.select("run", F.floor(F.col("t") / 86400).alias("day")).distinct()
    return days.select("run", "day", F.explode(marks).alias("m")).select(
        "run", F.col("m.ord").alias("ord"), (F.col("day") * 86400 + F.col("m.ord") * 21600).alias("t"), "m.name", "m.lat", "m.lon"
    )


def scans(e: DataFrame) -> DataFrame:
    """Looks: run, scan_id, t, interface (null: all cards together), keys."""
    return e.groupBy("run", "scan_id").agg(F.min("t").alias("t"), F.array_sort(F.collect_set("key")).alias("keys")).withColumn(
        "interface", F.lit(None).cast("string")
    )


def segments(e: DataFrame) -> DataFrame:
    segs = placement.segments(waypoints(e))
    return networks.route_stretches(segs.withColumn("fold_start", F.lower("start_name")).withColumn("fold_end", F.lower("end_name")))


def placed_sightings(e: DataFrame) -> DataFrame:
    """The strongest reading of each (look, key), placed by the clock."""
    where = placement.with_coordinates(placement.place_by_clock(placement.in_segment(scans(e), segments(e))))
    where = where.withColumn("along", networks.along()).drop("keys", "interface")
    best = F.max_by(F.struct("strength", "pos"), F.struct(F.col("strength"), -F.col("pos")))
    heard = e.groupBy("run", "scan_id", "key").agg(best.alias("b")).select("run", "scan_id", "key", "b.strength", "b.pos")
    return heard.join(where, ["run", "scan_id"]).withColumn("has_signal", F.lit(True)).withColumn("connected", F.col("pos") % 50 == 0)


def fingerprints(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, their keys): looks placed by the clock in the canonical direction of their stretch."""
    where = placement.with_coordinates(placement.place_by_clock(placement.in_segment(scans(e), segments(e))))
    forward = exprs.canonical(F.lower("start_name"), F.lower("end_name"))
    fps = where.select(
        F.col("scan_id").alias("fp_id"), F.col("run").alias("grp"), F.concat_ws("#", "run", F.col("seg").cast("string")).alias("walk"), "t", "stretch",
        F.when(forward, F.col("fraction")).otherwise(1.0 - F.col("fraction")).alias("fraction"), "lat", "lon",
        exprs.distance_m(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")).alias("length_m"),
    )
    keys = e.groupBy(F.col("scan_id").alias("fp_id"), "key").agg(F.max("strength").alias("strength"))
    return fps, keys
