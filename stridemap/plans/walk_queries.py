"""Queries over the month of looks (lens E): log, placement, networks, map and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions import exprs
from stridemap.operators import matching, networks, placement, scans
from stridemap.plans.lens import E_SQL, events, fingerprints, placed_sightings, segments, waypoints
from stridemap.plans.lens import scans as looks_of
from stridemap.runtime import materialize

#: Hourly looks: a look's neighbours are an hour away.
REACH_S = 3600


def _r(*names: str, digits: int = 9) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def carry_outing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = e.withColumn("token", F.when(F.col("k") % 10 == 0, F.col("k").cast("string")))
    return scans.carry_walk(rows.select("run", "pos", "token"))


CARRY_SQL = f"""WITH {E_SQL},
k AS (SELECT run, pos, CASE WHEN json_extract_string(props, '$.k')::INT % 10 = 0 THEN json_extract_string(props, '$.k') END AS token FROM e)
SELECT run, pos, token, coalesce(last_value(token IGNORE NULLS) OVER (PARTITION BY run ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS walk FROM k"""


def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.walks(carry_outing(spark, sf_dir))


WALKS_SQL = f"""WITH w AS ({CARRY_SQL}), g AS (SELECT run, walk, min(pos) AS first_pos, count(*) AS records FROM w GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY run ORDER BY first_pos) AS ord FROM g"""


def last_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.last_walk(carry_outing(spark, sf_dir)).select("run", "pos", "walk")


LAST_WALK_SQL = f"""WITH w AS ({CARRY_SQL}), l AS (SELECT run, arg_max(walk, pos) AS walk FROM w GROUP BY run)
SELECT run, pos, walk FROM w JOIN l USING (run, walk)"""


def merged_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumnRenamed("scan_id", "cycle")
    return scans.merged_looks(e, ["pos", "interface", "strength"])


MERGED_SQL = f"""WITH {E_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run, scan_id, key ORDER BY dbm DESC, pos) AS nth,
  min(t) OVER (PARTITION BY run, scan_id) AS t0 FROM e)
SELECT run, scan_id AS cycle, key, pos, interface, dbm::DOUBLE AS strength, t0 AS t FROM o WHERE nth = 1"""


def open_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.open_networks(events(spark, sf_dir).withColumn("ssid", F.col("key")))


OPEN_SQL = f"""WITH {E_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dbm DESC, pos) AS nth FROM e WHERE security = 'open')
SELECT key, key AS ssid, dbm::DOUBLE AS strength, t FROM o WHERE nth = 1"""


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.first_seen(events(spark, sf_dir))


FIRST_SQL = f"""WITH {E_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY t, pos) AS nth FROM e)
SELECT run, key, t, scan_id FROM o WHERE nth = 1"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("run", F.col("user_id").cast("string"))
    return scans.sessions(e.select("run", "pos", "t"))


SESSIONS_SQL = f"""WITH {E_SQL}, s AS (SELECT user_id::VARCHAR AS run, pos, t, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, pos) >= 1800)::INT, 1) AS s FROM e)
SELECT run, pos, t, sum(s) OVER (PARTITION BY run ORDER BY t, pos)::BIGINT AS session FROM s"""


def assoc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("interface <> 'click'")
    rows = e.select("run", "interface", "pos", F.when(F.col("user_id") % 5 > 0, F.col("key")).alias("ssid"), F.when(F.col("user_id") % 5 > 0, F.col("key")).alias("bssid"))
    return scans.associations(rows)


ASSOC_SQL = f"""WITH {E_SQL}, r AS (SELECT run, interface, pos, CASE WHEN user_id % 5 > 0 THEN key END AS ssid FROM e WHERE interface <> 'click'),
l AS (SELECT *, lag(ssid) OVER (PARTITION BY run, interface ORDER BY pos) AS old FROM r)
SELECT run, interface, pos, ssid, ssid AS bssid, CASE WHEN old IS NULL THEN 'connected' WHEN ssid IS NULL THEN 'disconnected' ELSE 'roam' END AS change
FROM l WHERE ssid IS DISTINCT FROM old"""


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = e.select("run", "pos", F.when(F.col("interface").isin("error", "view"), "scan_failed").otherwise("scan").alias("event"))
    return scans.failure_runs(rows, 3).drop("event")


FAILURES_SQL = f"""WITH {E_SQL}, r AS (SELECT run, pos, interface IN ('error', 'view') AS bad FROM e),
i AS (SELECT *, sum((NOT bad)::INT) OVER (PARTITION BY run ORDER BY pos) AS island FROM r),
s AS (SELECT run, pos, row_number() OVER (PARTITION BY run, island ORDER BY pos) AS streak FROM i WHERE bad)
SELECT *, streak = 1 OR streak % 3 = 0 AS reported FROM s"""


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return scans.accepted_presses(e.select("run", "pos", "t"), 600.0)


DEBOUNCE_SQL = f"""WITH RECURSIVE {E_SQL}, o AS (SELECT run, pos, t, row_number() OVER (PARTITION BY run ORDER BY t, pos) AS n FROM e),
f(run, n, last, kept, pos) AS (SELECT run, 1, t, TRUE, pos FROM o WHERE n = 1
  UNION ALL SELECT o.run, o.n, CASE WHEN o.t - f.last >= 600 THEN o.t ELSE f.last END, o.t - f.last >= 600, o.pos FROM f JOIN o ON o.run = f.run AND o.n = f.n + 1)
SELECT run, pos FROM f WHERE kept"""


def clock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ticks = e.select("run", "pos", F.col("t").alias("boot_s"), (F.col("t") - F.floor(F.col("value"))).alias("mono_s"))
    return scans.clock_drift(ticks, 100).select("run", "pos", "seconds")


DRIFT_SQL = f"""WITH {E_SQL}, d AS (SELECT run, pos, floor(value)::BIGINT - lag(floor(value)::BIGINT) OVER (PARTITION BY run ORDER BY pos) AS seconds FROM e)
SELECT * FROM d WHERE seconds >= 100"""


def outing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("event", F.when(F.col("interface") == "purchase", "mark").otherwise("scan"))
    return scans.outing_summaries(e.withColumn("walk", F.col("run")).withColumn("cycle", F.col("scan_id"))).drop("walk")


SUMMARY_SQL = f"""WITH {E_SQL} SELECT run, min(t) AS first_t, max(t) AS last_t, count(DISTINCT scan_id) FILTER (interface <> 'purchase') AS scans,
  count(*) FILTER (interface = 'purchase') AS marks, max(scan_id) AS last_cycle FROM e GROUP BY run"""


def answer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))
    return scans.changes(talk, ["text_sha256"], ["conv_id"], ["turn"])


CHANGES_SQL = """WITH c AS (SELECT conv_id, turn, sha256(text) AS text_sha256 FROM conversations),
l AS (SELECT *, lag(text_sha256) OVER w AS old, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text_sha256 FROM l WHERE n = 1 OR text_sha256 IS DISTINCT FROM old"""


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return scans.announcements(e.select("run", F.col("scan_id").alias("cycle"), "pos", F.col("key").alias("ssid"), "security"), 14)


ANNOUNCE_SQL = f"""WITH {E_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY run, scan_id) > 14 AS many FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY scan_id, pos) AS nth FROM m WHERE NOT many OR security = 'open')
SELECT run, scan_id AS cycle, pos, key AS ssid, security FROM n WHERE nth = 1"""

LOOKS_SQL = E_SQL + """,
scan AS (SELECT run, scan_id, min(t) AS t, list_sort(list(DISTINCT key)) AS keys FROM e GROUP BY run, scan_id),
inseg AS (SELECT s.*, g.seg, g.start_t, g.end_t, start_name, end_name, start_lat, start_lon, end_lat, end_lon FROM scan s JOIN segs g ON s.run = g.run AND s.t >= g.start_t
  AND (s.t < g.end_t OR (g.seg = 3 AND s.t = g.end_t)))"""
STEPS_SQL = LOOKS_SQL + """,
spans AS (SELECT *, t - lag(t) OVER w AS span, lag(keys) OVER w AS before FROM inseg WINDOW w AS (PARTITION BY run, seg ORDER BY t, scan_id)),
raw AS (SELECT *, CASE WHEN span IS NOT NULL THEN 1.0::DOUBLE - len(list_intersect(before, keys))::DOUBLE / len(list_distinct(list_concat(before, keys))) END AS raw,
  list_sort(list(span) FILTER (span IS NOT NULL) OVER (PARTITION BY run, seg)) AS all_spans FROM spans),
step AS (SELECT *, coalesce(usual > 0 AND span > usual * 3, FALSE) AS hole, CASE WHEN NOT coalesce(usual > 0 AND span > usual * 3, FALSE) THEN raw END AS step
  FROM (SELECT *, coalesce(all_spans[len(all_spans) // 2 + 1], 0) AS usual FROM raw))"""
CLOCK_SQL = LOOKS_SQL + """,
clock AS (SELECT *, (t - start_t)::DOUBLE / (end_t - start_t) AS fraction FROM inseg)"""
MOVE_SQL = STEPS_SQL + """,
sums AS (SELECT *, sum(step) OVER w AS walked, sum(CASE WHEN step IS NOT NULL THEN span END) OVER w AS seconds, min(t) OVER w AS t0, max(t) OVER w AS tn
  FROM step WINDOW w AS (PARTITION BY run, seg)),
fill AS (SELECT *, CASE WHEN walked > 0 AND seconds > 0 THEN walked / seconds END AS rate,
  CASE WHEN span IS NULL THEN 0 ELSE coalesce(step, walked / seconds * span) END AS filled FROM sums),
move AS (SELECT *, coalesce(least(1, greatest(0, (rate * (t0 - start_t) + sum(filled) OVER (PARTITION BY run, seg ORDER BY t, scan_id))
  / (rate * (t0 - start_t) + sum(filled) OVER (PARTITION BY run, seg) + rate * (end_t - tn)))), (t - start_t)::DOUBLE / (end_t - start_t)) AS fraction FROM fill)"""


def _in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return placement.in_segment(looks_of(e), segments(e))


def scan_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.steps(_in_segments(spark, sf_dir)).select("run", "seg", "scan_id", "span", "hole", *_r("step"))


def place_by_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placement.with_coordinates(placement.place_by_clock(_in_segments(spark, sf_dir)))
    return rows.select("run", "scan_id", "t", "seg", "start_name", "end_name", *_r("fraction", "lat", "lon"))


def place_by_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place_by_movement(_in_segments(spark, sf_dir)).select("run", "scan_id", "seg", *_r("fraction"))


def outside_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return placement.outside(looks_of(e), waypoints(e).where("ord between 1 and 3"))


PLACED_SQL = CLOCK_SQL + """,
heard AS (SELECT run, scan_id, key, max(dbm)::DOUBLE AS strength, arg_max(pos, (dbm * 100000000 - pos)) AS pos FROM e GROUP BY ALL),
placed AS (SELECT h.*, t, seg, start_name, end_name, fraction, start_lat + (end_lat - start_lat) * fraction AS lat, start_lon + (end_lon - start_lon) * fraction AS lon,
  pos % 50 = 0 AS connected, least(lower(start_name), lower(end_name)) || '|' || greatest(lower(start_name), lower(end_name)) AS stretch, seg < 2 AS forward,
  CASE WHEN seg < 2 THEN fraction ELSE 1 - fraction END AS along, pow(10.0::DOUBLE, strength / 30.0::DOUBLE) AS w FROM heard h JOIN clock USING (run, scan_id))"""


def network_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.in_route_order(networks.roll_up(placed_sightings(events(spark, sf_dir))))
    return rows.select("run", "key", "seen", "first_t", "last_t", "best_t", "seg", *_r("fraction"), "best", "connected", "ord")


ROLLUP_SQL = f"""WITH {PLACED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY strength DESC, t, pos) AS nth,
  count(DISTINCT scan_id) OVER w AS seen, min(t) OVER w AS first_t, max(t) OVER w AS last_t, bool_or(connected) OVER w AS con, min(pos) OVER w AS first_pos
  FROM placed WINDOW w AS (PARTITION BY run, key))
SELECT run, key, seen, first_t, last_t, t AS best_t, seg, round(fraction, 9) AS fraction, strength AS best, con AS connected,
  row_number() OVER (PARTITION BY run ORDER BY seg, o.fraction, first_pos) AS ord FROM o WHERE nth = 1"""

_DIST = "6371000.0::DOUBLE * sqrt(pow(radians({0} - {2}), 2) + pow(radians({1} - {3}) * cos(radians(({0} + {2}) / 2)), 2))"


def centroid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.centroids(placed_sightings(events(spark, sf_dir)))
    return rows.select("run", "key", "sightings", *_r("est_lat", "est_lon"), *_r("spread_m", "plain_spread_m", digits=4), "few_sightings")


CENTROID_SQL = f"""WITH {PLACED_SQL}, m AS (SELECT run, key, sum(w * lat) / sum(w) AS est_lat, sum(w * lon) / sum(w) AS est_lon, avg(lat) AS p_lat, avg(lon) AS p_lon,
  count(*) AS sightings FROM placed GROUP BY run, key)
SELECT p.run, p.key, sightings, round(any_value(est_lat), 9) AS est_lat, round(any_value(est_lon), 9) AS est_lon,
  round(sum(w * {_DIST.format("est_lat", "est_lon", "lat", "lon")}) / sum(w), 4) AS spread_m, round(avg({_DIST.format("p_lat", "p_lon", "lat", "lon")}), 4) AS plain_spread_m,
  sightings < 3 AS few_sightings FROM placed p JOIN m ON p.run = m.run AND p.key = m.key GROUP BY p.run, p.key, sightings"""


def centroid_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.route_centroids(placed_sightings(events(spark, sf_dir)))
    return rows.select("run", "key", "stretch", "sightings", *_r("at", "spread", "plain_spread"), "few_sightings")


ROUTE_SQL = f"""WITH {PLACED_SQL}, s AS (SELECT run, key, stretch, row_number() OVER (PARTITION BY run, key ORDER BY round(sum(w), 12) DESC, min(t)) AS nth FROM placed GROUP BY run, key, stretch),
c AS (SELECT p.* FROM placed p JOIN s ON p.run = s.run AND p.key = s.key AND p.stretch = s.stretch AND nth = 1),
m AS (SELECT run, key, sum(w * along) / sum(w) AS mid, avg(along) AS p_at, count(*) AS sightings FROM c GROUP BY run, key)
SELECT c.run, c.key, stretch, sightings, round(any_value(mid), 9) AS "at", round(sum(w * abs(along - mid)) / sum(w), 9) AS spread, round(avg(abs(along - p_at)), 9) AS plain_spread,
  sightings < 3 AS few_sightings FROM c JOIN m ON c.run = m.run AND c.key = m.key GROUP BY c.run, c.key, stretch, sightings"""


def pass_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = networks.repeated_stretches(networks.passes(placed_sightings(events(spark, sf_dir))))
    return rows.select("run", "stretch", "passes", "shared", *_r("disagreement", "shift"))


PASSES_SQL = f"""WITH {PLACED_SQL}, p AS (SELECT run, stretch, seg, forward, key, sum(w * along) / sum(w) AS mid FROM placed GROUP BY ALL),
k AS (SELECT run, stretch, key, count(*) AS n, max(mid) - min(mid) AS r, avg(mid) FILTER (forward) AS there, avg(mid) FILTER (NOT forward) AS back FROM p GROUP BY ALL),
q AS (SELECT run, stretch, count(DISTINCT seg) AS passes FROM p GROUP BY ALL HAVING count(DISTINCT seg) > 1)
SELECT k.run, k.stretch, passes, count(*) AS shared, round(avg(r), 9) AS disagreement, round(avg(there - back) / 2, 9) AS shift
FROM k JOIN q ON k.run = q.run AND k.stretch = q.stretch WHERE n > 1 GROUP BY ALL"""


def route_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(events(spark, sf_dir)).select("run", "seg", "stretch", "forward", "is_last")


STRETCH_SQL = f"""WITH {E_SQL} SELECT run, seg, least(lower(start_name), lower(end_name)) || '|' || greatest(lower(start_name), lower(end_name)) AS stretch, seg < 2 AS forward,
  seg = 3 AS is_last FROM segs"""


def check_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    rows = placement.held_out_crossings(looks_of(e), waypoints(e))
    leg = lambda a, b: exprs.distance_m(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon"))
    first, second = leg("start", "mid"), leg("mid", "end")
    error = lambda c: F.abs(F.col(c) - first / (first + second)) * (first + second)
    return rows.select("run", "seg", "scan_id", F.round(error("fraction"), 3).alias("by_movement_m"), F.round(error("clock"), 3).alias("by_clock_m"))


def map_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _ = fingerprints(events(spark, sf_dir))
    return fps.select("fp_id", "grp", "walk", "t", "stretch", *_r("fraction", "lat", "lon"), F.round("length_m", 2).alias("length_m"))


FPS_SQL = CLOCK_SQL + f""",
fps AS (SELECT scan_id AS fp_id, run AS grp, run || '#' || seg AS walk, t, least(lower(start_name), lower(end_name)) || '|' || greatest(lower(start_name), lower(end_name)) AS stretch,
  CASE WHEN lower(start_name) <= lower(end_name) THEN fraction ELSE 1 - fraction END AS fraction, start_lat + (end_lat - start_lat) * fraction AS lat,
  start_lon + (end_lon - start_lon) * fraction AS lon, {_DIST.format("end_lat", "end_lon", "start_lat", "start_lon")} AS length_m FROM clock),
fk AS (SELECT scan_id AS fp_id, run AS grp, key, max(dbm)::DOUBLE AS strength FROM e GROUP BY ALL)"""


def map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.map_summary(fingerprints(events(spark, sf_dir))[0])


def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, keys = fingerprints(events(spark, sf_dir))
    return matching.rarity(keys, fps).select("key", "df", *_r("weight"))


def _held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    fps, keys = (materialize(x, "fingerprints", few=True) for x in fingerprints(events(spark, sf_dir)))
    queries = fps.select(F.col("fp_id").alias("query"), "grp")
    return fps, keys, queries, keys.withColumnRenamed("fp_id", "query")


def similarity(spark: SparkSession, sf_dir: str, by_signal: bool = False) -> DataFrame:
    rows = matching.similarities(*_held_out(spark, sf_dir), by_signal=by_signal, floor=C.SIMILARITY_FLOOR)
    top = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "fp_id")
    return rows.withColumn("nth", F.row_number().over(top)).where("nth <= 5").select("query", "fp_id", "nth", *_r("score"))


def similarity_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity(spark, sf_dir, True)


SIM_SQL = FPS_SQL + """,
n AS (SELECT grp, count(*) AS own_n, (SELECT count(*) FROM fps) AS n FROM fps GROUP BY grp), df AS (SELECT key, count(*) AS df FROM fk GROUP BY key),
own AS (SELECT grp, key, count(*) AS own FROM fk GROUP BY ALL),
wt AS (SELECT n.grp, df.key, CASE WHEN df > coalesce(own, 0) THEN ln(1 + (n - own_n)::DOUBLE / (df - coalesce(own, 0))) ELSE ln(1 + n - own_n) END AS w
  FROM n CROSS JOIN df LEFT JOIN own ON own.grp = n.grp AND own.key = df.key),
wq AS (SELECT fp_id AS query, sum(w) AS wq FROM fk JOIN wt USING (grp, key) GROUP BY ALL),
wf AS (SELECT wt.grp, fp_id, sum(w) AS wf FROM fk JOIN wt ON fk.key = wt.key GROUP BY ALL),
met AS (SELECT q.fp_id AS query, q.grp, f.fp_id, sum(w) AS inter, avg(abs(q.strength - f.strength)) AS off FROM fk q JOIN fk f ON q.key = f.key AND q.grp <> f.grp
  JOIN wt ON wt.grp = q.grp AND wt.key = q.key GROUP BY ALL),
sim AS (SELECT query, met.fp_id, round(inter / (wq + wf - inter), 9) AS score, round(inter / (wq + wf - inter) * exp(-off / 10), 9) AS by_signal
  FROM met JOIN wq USING (query) JOIN wf ON wf.grp = met.grp AND wf.fp_id = met.fp_id)"""


def _top_sql(column: str) -> str:
    return f"""WITH {SIM_SQL}, o AS (SELECT query, fp_id, round({column}, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round({column}, 9) DESC, fp_id) AS nth FROM sim WHERE round({column}, 9) >= 0.15)
SELECT query, fp_id, nth, score FROM o WHERE nth <= 5"""


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, keys, queries, query_keys = _held_out(spark, sf_dir)
    rows = matching.best_looks(matching.walk_scores(fps, keys, queries, query_keys), REACH_S)
    return rows.select("query", "walk", "stretch", *_r("fraction", digits=4), "score", "best")


BESIDE_SQL = SIM_SQL + """,
hit AS (SELECT DISTINCT query, walk FROM sim JOIN fps USING (fp_id)),
all_s AS (SELECT h.query, f.*, coalesce(s.score, 0) AS score FROM hit h JOIN fps f ON h.walk = f.walk LEFT JOIN sim s ON s.query = h.query AND s.fp_id = f.fp_id),
beside AS (SELECT *, round(avg(score) OVER w, 9) AS mean, max(score) OVER w AS best, sum(score) OVER w AS ss, sum(score * fraction) OVER w AS sf, sum(score * lat) OVER w AS slat,
  sum(score * lon) OVER w AS slon FROM all_s WINDOW w AS (PARTITION BY query, walk ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 3600 FOLLOWING)),
nth AS (SELECT *, row_number() OVER (PARTITION BY query, walk ORDER BY mean DESC, t, fp_id) AS n FROM beside),
look AS (SELECT query, walk, stretch, sf / ss AS fraction, slat / ss AS lat, slon / ss AS lon, length_m, mean AS score, best, grp AS outing FROM nth WHERE n = 1 AND mean >= 0.15)"""
LOCATE_SQL = BESIDE_SQL + """,
ord AS (SELECT walk, min(fp_id) AS o FROM fps GROUP BY walk),
top AS (SELECT look.*, row_number() OVER (PARTITION BY query ORDER BY score DESC, o) AS place FROM look JOIN ord USING (walk)),
cand AS (SELECT query, stretch, sum(score * fraction) / sum(score) AS fraction, sum(score * lat) / sum(score) AS lat, sum(score * lon) / sum(score) AS lon, max(best) AS best,
  max(score) AS weight, count(*) AS matches, min(place) AS first, list({'s': score, 'f': fraction}) AS m, any_value(length_m) AS length_m FROM top WHERE place <= 5 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY first) AS rank, pow(3.0::DOUBLE, 10 * weight) / sum(pow(3.0::DOUBLE, 10 * weight)) OVER (PARTITION BY query) AS share FROM cand)"""


def _located(spark: SparkSession, sf_dir: str, by_signal: bool = False, by_rarity: bool = True) -> DataFrame:
    rows = matching.locate(*_held_out(spark, sf_dir), by_signal=by_signal, by_rarity=by_rarity, reach_s=REACH_S)
    return rows.select("query", "stretch", *_r("fraction", "lat", "lon", "score"), "matches", *_r("spread"), "alternative")


def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir)


def locate_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, by_rarity=False)


def locate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, by_signal=True)


ANSWER_SQL = """SELECT a.query, a.stretch, round(a.fraction, 9) AS fraction, round(a.lat, 9) AS lat, round(a.lon, 9) AS lon, round(a.best, 9) AS score, a.matches,
  round(list_sum([x.s * abs(x.f - a.fraction) FOR x IN a.m]) / list_sum([x.s FOR x IN a.m]), 9) AS spread, CASE WHEN a.share < 0.6 THEN b.stretch END AS alternative
FROM rk a LEFT JOIN rk b ON a.query = b.query AND b.rank = 2 WHERE a.rank = 1"""
_ALIKE = LOCATE_SQL.replace("CASE WHEN df > coalesce(own, 0) THEN ln(1 + (n - own_n)::DOUBLE / (df - coalesce(own, 0))) ELSE ln(1 + n - own_n) END AS w", "1.0::DOUBLE AS w")
_SIGNAL = LOCATE_SQL.replace("coalesce(s.score, 0) AS score", "coalesce(s.by_signal, 0) AS score")


def stretch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.stretch_lines(fingerprints(events(spark, sf_dir))[0])
    return rows.select("stretch", *_r("lat_slope", "lat_0", "lon_slope", "lon_0", digits=6))


def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = fingerprints(events(spark, sf_dir))[0].withColumn("outing", F.col("grp"))
    known = fps.where(F.substring("outing", 9, 2).cast("int") % 3 == 0)
    return matching.append_outings(fps, known).select("outing", "fp_id", "walk")


CHECK_PACE_SQL = E_SQL + """,
scan AS (SELECT run, scan_id, min(t) AS t, list_sort(list(DISTINCT key)) AS keys FROM e GROUP BY run, scan_id),
mid AS (SELECT m.run, m.ord AS seg, m.t AS mid_t, a.t AS start_t, b.t AS end_t, a.lat AS a_lat, a.lon AS a_lon, m.lat AS m_lat, m.lon AS m_lon, b.lat AS b_lat, b.lon AS b_lon
  FROM wp m JOIN wp a ON a.run = m.run AND a.ord = m.ord - 1 JOIN wp b ON b.run = m.run AND b.ord = m.ord + 1),
inseg AS (SELECT s.*, seg, start_t, end_t FROM scan s JOIN mid m ON s.run = m.run AND s.t >= start_t AND (s.t < end_t OR (seg = 3 AND s.t = end_t)))"""
PACE_SQL = f"""WITH {CHECK_PACE_SQL}{MOVE_SQL[len(LOOKS_SQL):]}, near AS (SELECT m.*, d.* EXCLUDE (run, seg, start_t, end_t),
  row_number() OVER (PARTITION BY m.run, m.seg ORDER BY abs(m.t - mid_t), m.t, m.scan_id) AS nth, (m.t - m.start_t)::DOUBLE / (m.end_t - m.start_t) AS clock,
  {_DIST.format("a_lat", "a_lon", "m_lat", "m_lon")} AS d1, {_DIST.format("m_lat", "m_lon", "b_lat", "b_lon")} AS d2 FROM move m JOIN mid d ON m.run = d.run AND m.seg = d.seg),
gap AS (SELECT d.run, d.seg, min(abs(s.t - d.mid_t)) AS g FROM mid d JOIN scan s ON s.run = d.run GROUP BY ALL)
SELECT near.run, near.seg, scan_id, round(abs(fraction - d1 / (d1 + d2)) * (d1 + d2), 3) AS by_movement_m, round(abs(clock - d1 / (d1 + d2)) * (d1 + d2), 3) AS by_clock_m
FROM near JOIN gap ON near.run = gap.run AND near.seg = gap.seg WHERE nth = 1 AND abs(t - mid_t) = g"""

QUERIES = {
    f.__name__: f
    for f in (
        carry_outing, walk_order, last_walks, merged_cycles, open_networks, first_seen, sessions, assoc_changes, failure_runs, debounce, clock_drift,
        outing_summaries, answer_changes, announcements, scan_turnover, place_by_clock, place_by_movement, outside_route, network_rollup, centroid_map,
        centroid_route, pass_compare, route_stretches, check_pace, map_fingerprints, map_summary, rarity, similarity, similarity_signal, looks, locate,
        locate_alike, locate_signal, stretch_lines, anti_append,
    )
}
ORACLE_SQL = {
    "carry_outing": CARRY_SQL, "walk_order": WALKS_SQL, "last_walks": LAST_WALK_SQL, "merged_cycles": MERGED_SQL, "open_networks": OPEN_SQL, "first_seen": FIRST_SQL,
    "sessions": SESSIONS_SQL, "assoc_changes": ASSOC_SQL, "failure_runs": FAILURES_SQL, "debounce": DEBOUNCE_SQL, "clock_drift": DRIFT_SQL, "outing_summaries": SUMMARY_SQL,
    "answer_changes": CHANGES_SQL, "announcements": ANNOUNCE_SQL,
    "scan_turnover": f"WITH {STEPS_SQL} SELECT run, seg, scan_id, span, hole, round(step, 9) AS step FROM step",
    "place_by_clock": f"""WITH {CLOCK_SQL} SELECT run, scan_id, t, seg, start_name, end_name, round(fraction, 9) AS fraction,
        round(start_lat + (end_lat - start_lat) * fraction, 9) AS lat, round(start_lon + (end_lon - start_lon) * fraction, 9) AS lon FROM clock""",
    "place_by_movement": f"WITH {MOVE_SQL} SELECT run, scan_id, seg, round(fraction, 9) AS fraction FROM move",
    "outside_route": f"""WITH {LOOKS_SQL}, b AS (SELECT run, min(t) AS a, max(t) AS z FROM wp WHERE ord BETWEEN 1 AND 3 GROUP BY run)
        SELECT scan.run, count(*) FILTER (t < a) AS before, count(*) FILTER (t > z) AS after FROM scan JOIN b ON scan.run = b.run GROUP BY ALL""",
    "network_rollup": ROLLUP_SQL, "centroid_map": CENTROID_SQL, "centroid_route": ROUTE_SQL, "pass_compare": PASSES_SQL, "route_stretches": STRETCH_SQL, "check_pace": PACE_SQL,
    "map_fingerprints": f"""WITH {FPS_SQL} SELECT fp_id, grp, walk, t, stretch, round(fraction, 9) AS fraction, round(lat, 9) AS lat, round(lon, 9) AS lon,
        round(length_m, 2) AS length_m FROM fps""",
    "map_summary": f"WITH {FPS_SQL} SELECT count(*) AS fingerprints, count(DISTINCT walk) AS walks, count(DISTINCT stretch) AS stretches, count(DISTINCT grp) AS outings FROM fps",
    "rarity": f"WITH {FPS_SQL} SELECT key, count(*) AS df, round(ln(1 + (SELECT count(*) FROM fps)::DOUBLE / count(*)), 9) AS weight FROM fk GROUP BY key",
    "similarity": _top_sql("score"), "similarity_signal": _top_sql("by_signal"),
    "looks": f"WITH {BESIDE_SQL} SELECT query, walk, stretch, round(fraction, 4) AS fraction, score, best FROM look",
    "locate": f"WITH {LOCATE_SQL} {ANSWER_SQL}", "locate_alike": f"WITH {_ALIKE} {ANSWER_SQL}", "locate_signal": f"WITH {_SIGNAL} {ANSWER_SQL}",
    "stretch_lines": f"""WITH {FPS_SQL} SELECT stretch, round(regr_slope(lat, fraction), 6) AS lat_slope, round(regr_intercept(lat, fraction), 6) AS lat_0,
        round(regr_slope(lon, fraction), 6) AS lon_slope, round(regr_intercept(lon, fraction), 6) AS lon_0 FROM fps GROUP BY stretch HAVING count(DISTINCT fraction) > 1""",
    "anti_append": f"WITH {FPS_SQL} SELECT grp AS outing, fp_id, walk FROM fps WHERE substr(grp, 9, 2)::INT % 3 <> 0",
}
