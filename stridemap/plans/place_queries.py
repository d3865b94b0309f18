"""Queries over text, names, places and what is published, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap.functions import exprs
from stridemap.operators import geo, plan, publish
from stridemap.plans.lens import E_SQL, events, waypoints
from stridemap.runtime import bounded
from stridemap.sources import sinks

#: A key for the queries below; a real export has its own.
KEY = b"a key that is no secret"
_SPLIT_SQL = r"\s+(?:y|e|esq\.?|esquina|&)\s+|\s*/\s*"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    mhz = F.when(F.col("p_size") <= 16, 2402 + 5 * F.col("p_size")).otherwise(4900 + 50 * F.col("p_size"))
    return part.select("p_partkey", mhz.alias("mhz"), exprs.channel(mhz).alias("channel"))


CHANNELS_SQL = """WITH m AS (SELECT p_partkey, CASE WHEN p_size <= 16 THEN 2402 + 5 * p_size ELSE 4900 + 50 * p_size END AS mhz FROM part)
SELECT p_partkey, mhz, CASE WHEN mhz = 2484 THEN 14 WHEN mhz BETWEEN 2412 AND 2472 THEN (mhz - 2407) // 5 WHEN mhz BETWEEN 5000 AND 5895 THEN (mhz - 5000) // 5
  WHEN mhz BETWEEN 5955 AND 7115 THEN (mhz - 5950) // 5 END AS channel FROM m"""


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of nations as a corner, joined in four ways; a nation and itself with accents are one street."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    other = nation.select(F.col("n_nationkey").alias("k2"), F.initcap("n_name").alias("name2"))
    pairs = nation.join(other, F.abs(F.col("n_nationkey") - F.col("k2")) <= 3)
    pairs = pairs.withColumn("name2", F.when(F.col("k2") == F.col("n_nationkey"), F.translate("name2", "aeiou", "áéíóú")).otherwise(F.col("name2")))
    by = (F.col("n_nationkey") + F.col("k2")) % 4
    word = F.when(by == 0, " y ").when(by == 1, ", ").when(by == 2, " / ").otherwise(" Esq. ")
    return pairs.select("n_nationkey", "k2", F.concat("n_name", word, "name2").alias("name"))


_CORNERS_SQL = """capital AS (SELECT *, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(n_name, ' ')], ' ') AS cap FROM nation),
c AS (SELECT a.n_nationkey, b.n_nationkey AS k2, a.n_name || CASE (a.n_nationkey + b.n_nationkey) % 4 WHEN 0 THEN ' y ' WHEN 1 THEN ', ' WHEN 2 THEN ' / ' ELSE ' Esq. ' END
  || CASE WHEN a.n_nationkey = b.n_nationkey THEN translate(b.cap, 'aeiou', 'áéíóú') ELSE b.cap END AS name FROM nation a JOIN capital b ON abs(a.n_nationkey - b.n_nationkey) <= 3),
s AS (SELECT *, CASE WHEN contains(name, ',') THEN string_split(name, ',') ELSE string_split_regex(name, '(?i)""" + _SPLIT_SQL + """') END AS p FROM c),
h AS (SELECT n_nationkey, k2, name, CASE WHEN len(p) = 2 AND trim(p[1]) <> '' AND trim(p[2]) <> '' AND replace(lower(strip_accents(trim(p[1]))), 'ß', 'ss') <> replace(lower(strip_accents(trim(p[2]))), 'ß', 'ss') THEN [trim(p[1]), trim(p[2])] END AS t FROM s)"""


def corner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = exprs.halves(F.col("name"))
    return _corners(spark, sf_dir).select("n_nationkey", "k2", "name", F.get(two, F.lit(0)).alias("first"), F.get(two, F.lit(1)).alias("second"))


def confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corners(spark, sf_dir).withColumn("t", exprs.halves(F.col("name")))
    rows = rows.select(exprs.folded(F.col("name")).alias("folded"), exprs.folded(F.get("t", F.lit(0))).alias("fold_a"), exprs.folded(F.get("t", F.lit(1))).alias("fold_b"))
    return geo.confusable(rows)


def fold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bounded(docs).select("doc_id", exprs.folded(F.col("text")).alias("folded"))


def html_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", exprs.plain_html(F.col("html")).alias("line"))


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(exprs.xml_escaped(F.concat("html", F.lit("\t\r\x01\x1f\n")))).alias("escaped_md5"))


def strip_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    line = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("#7 "), F.col("url"))).otherwise(F.col("url"))
    return pages.select("page_id", exprs.strip_comment(line).alias("line"))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = events(spark, sf_dir).select("user_id").distinct()
    mac = F.concat(F.lit("AA:BB:CC:00:00:"), F.lpad(F.hex("user_id"), 2, "0"))
    return users.select("user_id", publish.address(KEY, mac).alias("address"), publish.address(KEY, mac, True).alias("shaped"), exprs.pseudonym(KEY, "ssid", F.col("user_id").cast("string")).alias("name"))


def _pad(byte: int) -> str:
    key = KEY.ljust(64, b"\0")
    assert len(key) == 64 and hashlib.sha256  # a key of more than a block would be hashed first
    return "unhex('" + bytes(b ^ byte for b in key).hex() + "')"


def _hmac_sql(message: str) -> str:
    return f"sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode({message}))))"


PSEUDONYMS_SQL = f"""WITH u AS (SELECT DISTINCT user_id, 'aa:bb:cc:00:00:' || lower(lpad(hex(user_id), 2, '0')) AS mac FROM events),
d AS (SELECT user_id, {_hmac_sql("'bssid' || chr(0) || mac")} AS a, {_hmac_sql("'ssid' || chr(0) || user_id::VARCHAR")} AS n FROM u)
SELECT user_id, 'ap-' || substr(a, 1, 12) AS address, lower(lpad(hex((('0x' || substr(a, 1, 2))::INT & 254) | 2), 2, '0')) || ':' || substr(a, 3, 2) || ':' || substr(a, 5, 2) || ':'
  || substr(a, 7, 2) || ':' || substr(a, 9, 2) || ':' || substr(a, 11, 2) AS shaped, 'ssid-' || substr(n, 1, 12) AS name FROM d"""


def public_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kinds = {"click": "scan", "view": "new", "error": "scan_failed", "purchase": "connected", "signup": "mark"}
    event = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("interface")]
    reason = F.when(F.col("interface") == "error", F.when(F.col("user_id") % 2 == 0, "SYN_DROPPED").otherwise("what the daemon said"))
    rows = e.select(
        F.col("pos").alias("row"), "t", event.alias("event"), F.col("run").alias("outing"), F.lit("wlan0").alias("interface"), F.col("scan_id").alias("cycle"), reason.alias("reason"),
        F.lit(None).cast("double").alias("seconds"), F.col("user_id").alias("number"), F.lit(None).cast("bigint").alias("key"),
    )
    out = publish.public_records(rows, KEY, F.lit(1704067200))
    return out.select("row", "t", "event", "outing", "interface", "cycle", "reason", "number")


PUBLIC_SQL = f"""WITH {E_SQL}, k AS (SELECT *, CASE interface WHEN 'click' THEN 'scan' WHEN 'view' THEN 'new' WHEN 'error' THEN 'scan_failed' WHEN 'purchase' THEN 'connected' ELSE 'mark' END AS event FROM e)
SELECT pos AS row, t - 1704067200 AS t, event, 'outing-' || substr({_hmac_sql("'outing' || chr(0) || run")}, 1, 12) AS outing,
  'radio-' || substr({_hmac_sql("'radio' || chr(0) || 'wlan0'")}, 1, 12) AS interface, scan_id AS cycle,
  CASE WHEN interface = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'SYN_DROPPED' ELSE 'withheld by --export-public' END END AS reason, user_id AS number
FROM k WHERE event <> 'connected'"""


def leak_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host labels of pages that can be read in their own URLs' paths or in the answers of conversations."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    values = pages.select(F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^./]*)", 1).alias("value"))
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text")
    return publish.survivors(values, lines)


LEAK_SQL = r"""WITH v AS (SELECT DISTINCT lower(regexp_extract(url, '://(?:www\.|m\.|blog\.)?([^./]*)', 1)) AS value FROM pages),
n AS (SELECT value, (length(text) - length(replace(lower(text), value, ''))) // length(value) AS n FROM v, conversations WHERE value <> '')
SELECT value, sum(n)::BIGINT AS occurrences FROM n WHERE n > 0 GROUP BY value"""


def notebook_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waypoints(events(spark, sf_dir)).withColumn("run", F.substring("run", 1, 7)).withColumn("ord", F.col("t") * 10 + F.col("ord"))
    return publish.notebook_lines(w)


NOTEBOOK_SQL = f"""WITH {E_SQL}, w AS (SELECT substr(run, 1, 7) AS run, t * 10 + ord AS ord, to_timestamp(t) AT TIME ZONE 'UTC' AS ts, name, lat, lon FROM wp),
d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d') IS DISTINCT FROM lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY run ORDER BY ord) AS fresh FROM w),
l AS (SELECT run, ord, CASE WHEN fresh THEN ['date ' || day] ELSE [] END || [strftime(ts, '%H:%M:%S') || ' ' || name || printf(' @ %.6f, %.6f', lat, lon)] AS lines FROM d)
SELECT run, ord, (generate_subscripts(lines, 1) - 1)::INT AS part, unnest(lines) AS line FROM l"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers strewn over a few streets' worth of ground: 200 groups of ten, some tens of metres apart."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    group, i = F.floor(F.col("k") / 10), F.col("k") % 10
    lat = -34.9 + 0.01 * (group % 50) + 0.00002 * (1 + 2 * (group % 4)) * ((F.col("k") * 7) % 23)
    lon = -56.1 + 0.01 * F.floor(group / 50) + 0.0002 * i
    return rows.select(F.col("k").alias("point_id"), group.alias("grp"), lat.alias("lat"), lon.alias("lon"))


_POINTS_SQL = """pts AS (SELECT c_custkey AS point_id, c_custkey // 10 AS grp, -34.9::DOUBLE + 0.01::DOUBLE * (c_custkey // 10 % 50) + 0.00002::DOUBLE * (1 + 2 * (c_custkey // 10 % 4)) * (c_custkey * 7 % 23) AS lat,
  -56.1::DOUBLE + 0.01::DOUBLE * (c_custkey // 500) + 0.0002::DOUBLE * (c_custkey % 10) AS lon FROM customer)"""
_GAP = "6371000.0::DOUBLE * sqrt(pow(radians({1}.lat - {0}.lat), 2) + pow(radians({1}.lon - {0}.lon) * cos(radians(({0}.lat + {1}.lat) / 2)), 2))"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geo.clusters(_points(spark, sf_dir), geo.C.JUNCTION_CLUSTER_M, ["grp"])
    return geo.middles(rows, ["grp"]).select("grp", "cluster", "points", *(F.round(c, 6).alias(c) for c in ("mid_lat", "mid_lon")), F.round("spread_m", 4).alias("spread_m"))


CLUSTERS_SQL = f"""WITH RECURSIVE {_POINTS_SQL}, near AS (SELECT a.grp, a.point_id AS a, b.point_id AS b FROM pts a JOIN pts b ON a.grp = b.grp WHERE {_GAP.format("a", "b")} <= 60),
r AS (SELECT point_id, point_id AS root FROM pts UNION SELECT near.b, r.root FROM r JOIN near ON near.a = r.point_id WHERE near.b > r.root),
c AS (SELECT pts.*, cluster FROM pts JOIN (SELECT point_id, min(root) AS cluster FROM r GROUP BY point_id) m USING (point_id)),
m AS (SELECT grp, cluster, avg(lat) AS lat, avg(lon) AS lon, count(*) AS points FROM c GROUP BY ALL)
SELECT m.grp, m.cluster, points, round(m.lat, 6) AS mid_lat, round(m.lon, 6) AS mid_lon, round(max({_GAP.format("m", "c")}), 4) AS spread_m
FROM m JOIN c ON m.grp = c.grp AND m.cluster = c.cluster GROUP BY m.grp, m.cluster, points, m.lat, m.lon"""


def nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest two points of each group that are within 30 m."""
    rows = geo.near_pairs(_points(spark, sf_dir), geo.C.NEARBY_JUNCTION_M, ["grp"])
    best = rows.groupBy("grp").agg(F.min(F.struct(F.round("gap_m", 6).alias("gap_m"), "a", "b")).alias("m"))
    return best.select("grp", "m.gap_m", "m.a", "m.b")


PAIR_SQL = f"""WITH {_POINTS_SQL}, g AS (SELECT a.grp, a.point_id AS a, b.point_id AS b, round({_GAP.format("a", "b")}, 6) AS gap_m FROM pts a JOIN pts b ON a.grp = b.grp AND a.point_id < b.point_id
  WHERE {_GAP.format("a", "b")} <= 30), n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gap_m, a, b) AS nth FROM g)
SELECT grp, gap_m, a, b FROM n WHERE nth = 1"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of points as a drawn line, in the order of the points."""
    rows = _points(spark, sf_dir).groupBy(F.col("grp").alias("line_id")).agg(F.array_sort(F.collect_list(F.struct("point_id", "lat", "lon"))).alias("p"))
    return rows.select("line_id", F.col("line_id").cast("string").alias("name"), F.transform("p", lambda x: F.struct(x["lat"], x["lon"])).alias("points"))


_LEGS_SQL = (
    _POINTS_SQL
    + """, legs AS (SELECT grp AS line_id, row_number() OVER w - 1 AS k, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon, count(*) OVER (PARTITION BY grp) AS n
  FROM pts WINDOW w AS (PARTITION BY grp ORDER BY point_id)),
leg AS (SELECT *, 6371000.0::DOUBLE * sqrt(pow(radians(b_lat - a_lat), 2) + pow(radians(b_lon - a_lon) * cos(radians((a_lat + b_lat) / 2)), 2)) AS d FROM legs WHERE b_lat IS NOT NULL)"""
)


def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(F.size("points") > 1).select("line_id", F.round(geo.length_m(F.col("points")), 4).alias("length_m"))


def point_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.point_along(F.col("points"), (F.col("line_id") % 11) / 10.0)
    rows = _lines(spark, sf_dir).where(F.size("points") > 1).select("line_id", at.alias("at"))
    return rows.select("line_id", F.round("at.lat", 7).alias("lat"), F.round("at.lon", 7).alias("lon"))


ALONG_SQL = f"""WITH {_LEGS_SQL}, s AS (SELECT *, sum(d) OVER (PARTITION BY line_id ORDER BY k) AS upto, sum(d) OVER (PARTITION BY line_id) * (line_id % 11) / 10.0::DOUBLE AS goal FROM leg),
h AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k DESC) AS nth FROM s WHERE upto - d <= goal AND d > 0)
SELECT line_id, round(a_lat + (b_lat - a_lat) * least(1, (goal - (upto - d)) / d), 7) AS lat, round(a_lon + (b_lon - a_lon) * least(1, (goal - (upto - d)) / d), 7) AS lon FROM h WHERE nth = 1"""


def plan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a plan of all lines, large enough for legs of 20 m to hold a name, writes their names."""
    frame = plan.frame_around(_points(spark, sf_dir), 100_000.0)
    if frame is None:
        raise ValueError("a plan needs two places")
    rows = plan.labels(_lines(spark, sf_dir), frame)
    return rows.select("line_id", "k", *(F.round(c, 4).alias(c) for c in ("x", "y", "angle")))


PLAN_LABELS_SQL = (
    "WITH RECURSIVE "
    + _LEGS_SQL
    + """, box AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, 200 / 111320.0::DOUBLE AS up, 200 / 111320.0::DOUBLE / greatest(cos(radians(avg(lat))), 0.01) AS aside FROM pts),
fr AS (SELECT s - greatest((n - s) / 10, up) AS s, n + greatest((n - s) / 10, up) AS n, w - greatest((e - w) / 10, aside) AS w, e + greatest((e - w) / 10, aside) AS e FROM box),
frame AS (SELECT *, least(greatest(99904 * (n - s) / ((e - w) * greatest(cos(radians((n + s) / 2)), 0.01)) + 96, 300), 200000) AS h FROM fr),
mid AS (SELECT line_id, k, d, 48 + ((a_lon + b_lon) / 2 - w) / (e - w) * 99904 AS x, 48 + (n - (a_lat + b_lat) / 2) / (n - s) * (h - 96) AS y,
  (b_lon - a_lon) / (e - w) * 99904 AS dx, (a_lat - b_lat) / (n - s) * (h - 96) AS dy, sum(d) OVER (PARTITION BY line_id ORDER BY k) - d / 2 AS m FROM (SELECT * EXCLUDE (n) FROM leg), frame),
fit AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY m, k) AS i FROM mid WHERE sqrt(dx * dx + dy * dy) >= length(line_id::VARCHAR) * 4.95 + 8),
f(line_id, i, last, kept) AS (SELECT line_id, i, m, TRUE FROM fit WHERE i = 1
  UNION ALL SELECT t.line_id, t.i, CASE WHEN t.m - f.last >= 250 THEN t.m ELSE f.last END, t.m - f.last >= 250 FROM f JOIN fit t ON t.line_id = f.line_id AND t.i = f.i + 1),
a AS (SELECT line_id, k, x, y, degrees(atan2(dy, dx)) AS g FROM fit JOIN f USING (line_id, i) WHERE kept)
SELECT line_id, k, round(x, 4) AS x, round(y, 4) AS y, round(CASE WHEN g > 90 THEN g - 180 WHEN g <= -90 THEN g + 180 ELSE g END, 4) AS angle FROM a"""
)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir)
    return rows.select(F.col("point_id").alias("place_id"), (F.col("lat") + 0.00011).alias("lat"), (F.col("lon") + 0.00013).alias("lon"))


def nearest_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geo.nearest_on_lines(_places(spark, sf_dir), _lines(spark, sf_dir))
    return rows.select("place_id", "line_id", "k", F.round("along", 6).alias("along"), F.round("off_m", 4).alias("off_m"))


NEAREST_SQL = f"""WITH {_LEGS_SQL}, pl AS (SELECT point_id AS place_id, lat + 0.00011::DOUBLE AS lat, lon + 0.00013::DOUBLE AS lon FROM pts),
f AS (SELECT place_id, line_id, k, n, 6371000.0::DOUBLE * radians(a_lon - lon) * cos(radians(lat)) AS ax, 6371000.0::DOUBLE * radians(a_lat - lat) AS ay,
  6371000.0::DOUBLE * radians(b_lon - lon) * cos(radians(lat)) AS bx, 6371000.0::DOUBLE * radians(b_lat - lat) AS by_ FROM pl, leg WHERE abs(lat - a_lat) < 0.01 AND abs(lon - a_lon) < 0.01),
t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS along FROM f),
o AS (SELECT *, sqrt(pow(ax + along * (bx - ax), 2) + pow(ay + along * (by_ - ay), 2)) AS off FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY place_id, line_id ORDER BY round(off, 9), k, along) AS nth FROM o WHERE off <= 25)
SELECT place_id, line_id, CASE WHEN along >= 1 AND k < n - 2 THEN k + 1 ELSE k END AS k, round(CASE WHEN along >= 1 AND k < n - 2 THEN 0 ELSE along END, 6) AS along, round(off, 4) AS off_m
FROM b WHERE nth = 1"""


def block_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block from every point of a line to the next; a pair has the id of its first point."""
    after = Window.partitionBy("grp").orderBy("point_id")
    at = _points(spark, sf_dir).select(
        F.col("point_id").alias("pair_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(after).alias("b_lat"), F.lead("lon").over(after).alias("b_lon"),
    )
    rows = geo.blocks(at.where(F.col("b_lat").isNotNull()), _lines(spark, sf_dir))
    return rows.select("pair_id", "line_id", F.size("points").alias("points"), F.round("length_m", 3).alias("length_m"))


def implausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waypoints(events(spark, sf_dir)).withColumn("t", F.floor(F.col("t") / 300))
    return geo.implausible(w).select("run", "ord", "name", "next_name", "next_ord", F.round("speed", 6).alias("speed"))


IMPLAUSIBLE_SQL = f"""WITH {E_SQL}, n AS (SELECT run, ord, name, lead(name) OVER w AS next_name, lead(ord) OVER w AS next_ord,
  6371000.0::DOUBLE * sqrt(pow(radians(lead(lat) OVER w - lat), 2) + pow(radians(lead(lon) OVER w - lon) * cos(radians((lat + lead(lat) OVER w) / 2)), 2)) AS d,
  lead(t // 300) OVER w - t // 300 AS s FROM wp WINDOW w AS (PARTITION BY run ORDER BY ord))
SELECT run, ord, name, next_name, next_ord, round(d / s, 6) AS speed FROM n WHERE s > 0 AND d / s > 2.5"""


def geojson_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.crossing_features(waypoints(events(spark, sf_dir)))


GEOJSON_SQL = f"""WITH {E_SQL} SELECT run, ord, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"kind":"crossing","name":"' || name || '"}}}}' AS value FROM wp"""

QUERIES = {
    f.__name__: f
    for f in (
        channels, corner_split, confusable, fold_names, html_line, xml_escape, strip_comment, pseudonyms, public_records, leak_scan, notebook_export, clusters, nearest_pair,
        polyline_length, point_along, plan_labels, nearest_on_line, block_between, implausible, geojson_crossings,
    )
}
_FOLD = "replace(lower(strip_accents({0})), 'ß', 'ss')"
ORACLE_SQL = {
    "channels": CHANNELS_SQL,
    "corner_split": f"WITH {_CORNERS_SQL} SELECT n_nationkey, k2, name, t[1] AS first, t[2] AS second FROM h",
    "confusable": f"""WITH {_CORNERS_SQL}, f AS (SELECT least(lower(t[1]), lower(t[2])) || '|' || greatest(lower(t[1]), lower(t[2])) AS corner, lower(name) AS name FROM h WHERE t IS NOT NULL)
        SELECT corner, count(DISTINCT name) AS ways, count(*) AS n FROM f GROUP BY corner HAVING count(DISTINCT name) > 1""",
    "fold_names": rf"""SELECT doc_id, {_FOLD.format(r"trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))")} AS folded FROM documents""",
    "html_line": r"""WITH w AS (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')), ' ([:,.])', '\1', 'g') AS line FROM pages),
        e AS (SELECT page_id, substr(line, greatest(instr(line, 'Error:'), 1)) AS line FROM w)
        SELECT page_id, CASE WHEN length(line) <= 200 THEN line ELSE substr(line, 1, 199) || '…' END AS line FROM e""",
    "xml_escape": r"""SELECT page_id, md5(replace(replace(replace(regexp_replace(html || chr(9) || chr(13) || chr(1) || chr(31) || chr(10), '[\x00-\x08\x0b-\x1f]', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
        AS escaped_md5 FROM pages""",
    "strip_comment": "SELECT page_id, trim(CASE WHEN page_id % 2 = 0 THEN '#7 ' ELSE '' END || string_split(url, '#')[1]) AS line FROM pages",
    "pseudonyms": PSEUDONYMS_SQL, "public_records": PUBLIC_SQL, "leak_scan": LEAK_SQL, "notebook_export": NOTEBOOK_SQL, "clusters": CLUSTERS_SQL, "nearest_pair": PAIR_SQL,
    "polyline_length": f"WITH {_LEGS_SQL} SELECT line_id, round(sum(d), 4) AS length_m FROM leg GROUP BY line_id", "point_along": ALONG_SQL, "plan_labels": PLAN_LABELS_SQL, "nearest_on_line": NEAREST_SQL,
    "implausible": IMPLAUSIBLE_SQL, "geojson_crossings": GEOJSON_SQL,
}
