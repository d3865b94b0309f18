"""Queries over answers (lens E): sequences, pace, calibration, levels, bands and the held-out check of the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.operators import evaluate, levels, matching, sequence
from stridemap.plans.lens import events, fingerprints
from stridemap.plans.walk_queries import _DIST, ANSWER_SQL, FPS_SQL, LOCATE_SQL, REACH_S, _held_out, _r
from stridemap.runtime import materialize


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints, their keys, candidates of every look against the other days), the last written once."""
    fps, keys, queries, query_keys = _held_out(spark, sf_dir)
    found = matching.best_looks(matching.walk_scores(fps, keys, queries, query_keys), REACH_S)
    return fps, keys, materialize(matching.candidates(found, fps), "candidates")


def _runs(fps: DataFrame) -> DataFrame:
    return fps.select(F.col("grp").alias("run"), F.col("fp_id").alias("seq"), F.col("fp_id").alias("query"))


def _answers(fps: DataFrame, ranked: DataFrame) -> DataFrame:
    """Located looks with their run, order and time."""
    return matching.locations(ranked).join(fps.select(F.col("fp_id").alias("query"), F.col("grp").alias("run"), "grp", "t"), "query").withColumn("seq", F.col("query"))


def locate_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _, ranked = _ranked(spark, sf_dir)
    return sequence.vote(ranked, _runs(fps)).select("query", "stretch", "settled", "alternative")


TIE_SQL = f"""WITH {LOCATE_SQL}, mine AS (SELECT query, list(string_split(stretch, '|') ORDER BY rank) AS c, list(stretch ORDER BY rank) AS s, count(*) > 1 AND max(share) FILTER (rank = 1) < 0.6 AS tie FROM rk GROUP BY query),
lay AS (SELECT f.fp_id AS query, c, s, tie, [lag(CASE WHEN tie THEN c[1:2] ELSE c[1:1] END, 1) OVER w, lag(CASE WHEN tie THEN c[1:2] ELSE c[1:1] END, 2) OVER w,
  lag(CASE WHEN tie THEN c[1:2] ELSE c[1:1] END, 3) OVER w] AS back FROM fps f LEFT JOIN mine ON mine.query = f.fp_id WINDOW w AS (PARTITION BY f.grp ORDER BY f.fp_id)),
v AS (SELECT *, CASE WHEN tie THEN len([b FOR b IN back IF len([x FOR x IN b IF len(list_intersect(x, c[1])) > 0]) > 0]) END AS v0,
  CASE WHEN tie THEN len([b FOR b IN back IF len([x FOR x IN b IF len(list_intersect(x, c[2])) > 0]) > 0]) END AS v1 FROM lay WHERE c IS NOT NULL)
SELECT query, CASE WHEN tie AND v1 > v0 THEN s[2] ELSE s[1] END AS stretch, CASE WHEN tie AND v0 <> v1 THEN greatest(v0, v1) ELSE 0 END AS settled,
  CASE WHEN tie THEN CASE WHEN v1 > v0 THEN s[1] ELSE s[2] END END AS alternative FROM v"""


def locate_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _, ranked = _ranked(spark, sf_dir)
    return sequence.path(ranked, _runs(fps)).select("query", "stretch", *_r("share"), "settled", "alternative")


def pace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks at a pace of seconds instead of hours, so that the filter carries over."""
    fps, _, ranked = _ranked(spark, sf_dir)
    answers = _answers(fps, ranked).withColumn("t", F.col("t") / 720.0)
    return sequence.paced(answers).select("run", "query", "stretch", *_r("fraction"))


def answer_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _, ranked = _ranked(spark, sf_dir)
    return sequence.jumps(_answers(fps, ranked).withColumn("t", F.col("t") / 720.0))


JUMPS_SQL = f"""WITH {LOCATE_SQL}, a AS ({ANSWER_SQL.replace("round(a.fraction, 9)", "a.fraction")}),
j AS (SELECT grp AS run, t / 720.0::DOUBLE - lag(t / 720.0::DOUBLE) OVER w AS span, a.stretch = lag(a.stretch) OVER w AS same,
  abs(a.fraction - lag(a.fraction) OVER w) * f2.len AS moved FROM a JOIN fps f ON f.fp_id = a.query JOIN (SELECT stretch, any_value(length_m) AS len FROM fps GROUP BY ALL) f2 ON f2.stretch = a.stretch
  WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT run, count(*) AS steps, count(*) FILTER (moved > 2.5 * span + 5) AS fast FROM j WHERE same AND span > 0 GROUP BY run"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, keys, ranked = _ranked(spark, sf_dir)
    pairs = sequence.calibration_pairs(_answers(fps, ranked), fps, keys, keys.withColumnRenamed("fp_id", "query"))
    return sequence.card_offsets(pairs)


def level_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, keys = fingerprints(events(spark, sf_dir))
    rows = levels.curves(fps, keys)
    return rows.select("stretch", "key", *_r("fraction", "level", "support", digits=5))


CURVES_SQL = f"""WITH {FPS_SQL}, sz AS (SELECT stretch, max(length_m) AS len, greatest(round_even(max(length_m) / 2, 0), 10)::INT AS steps FROM fps GROUP BY stretch HAVING count(*) > 1),
g AS (SELECT f.fp_id, f.stretch, k, steps, fraction * len - len * k / steps AS d, exp(-0.5 * pow((fraction * len - len * k / steps) / 12, 2)) AS w
  FROM fps f JOIN sz ON f.stretch = sz.stretch, range(0, 400) r(k) WHERE k <= steps),
ks AS (SELECT DISTINCT stretch, key FROM fk JOIN fps USING (fp_id)),
v AS (SELECT g.stretch, ks.key, k, steps, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * (greatest(coalesce(strength, -95), -95) + 95)) AS t0,
  sum(w * d * (greatest(coalesce(strength, -95), -95) + 95)) AS t1 FROM g JOIN ks ON ks.stretch = g.stretch LEFT JOIN fk ON fk.fp_id = g.fp_id AND fk.key = ks.key GROUP BY ALL)
SELECT stretch, key, round(k::DOUBLE / steps, 5) AS fraction, round(greatest(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END - 95, -95), 5) AS level,
  round(s0, 5) AS support FROM v"""


def locate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, keys, ranked = _ranked(spark, sf_dir)
    curve = materialize(levels.curves(fps, keys), "curves")
    return levels.place(matching.locations(ranked), curve, keys.withColumnRenamed("fp_id", "query")).select("query", *_r("fraction"))


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _, ranked = _ranked(spark, sf_dir)
    rows = sequence.bands(matching.locations(ranked), matching.stretch_lines(fps))
    return rows.select("query", "stretch", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


BAND_SQL = f"""WITH {LOCATE_SQL}, ln AS (SELECT stretch, regr_slope(lat, fraction) AS sa, regr_intercept(lat, fraction) AS a0, regr_slope(lon, fraction) AS so, regr_intercept(lon, fraction) AS o0
  FROM fps GROUP BY stretch HAVING count(DISTINCT fraction) > 1),
c AS (SELECT query, ln.stretch, 20 + 60 * (1 - best) AS r, 6371000 * radians(o0 - lon) * cos(radians(lat)) AS x0, 6371000 * radians(a0 - lat) AS y0,
  6371000 * radians(so) * cos(radians(lat)) AS dx, 6371000 * radians(sa) AS dy FROM rk, ln WHERE rank = 1),
q AS (SELECT *, dx * dx + dy * dy AS sq, x0 * dx + y0 * dy AS h FROM c), g AS (SELECT *, h * h - sq * (x0 * x0 + y0 * y0 - r * r) AS gap FROM q WHERE sq > 0),
b AS (SELECT query, stretch, greatest(0, (-h - sqrt(gap)) / sq) AS low, least(1, (-h + sqrt(gap)) / sq) AS high FROM g WHERE gap > 0)
SELECT query, stretch, round(low, 4) AS low, round(high, 4) AS high FROM b WHERE low < high"""


def check_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps, _, ranked = _ranked(spark, sf_dir)
    rows = evaluate.report(evaluate.measured(fps, matching.locations(ranked)))
    return rows.select(
        "scans", "right_stretch", "across_mark", "wrong_stretch", "not_on_map", "within_band",
        *(F.round(c, 4).alias(c) for c in ("mean_fraction", "median_fraction", "mean_m", "median_m", "pulled_in_m")),
    )


CHECK_SQL = f"""WITH {LOCATE_SQL}, j AS (SELECT f.*, a.stretch AS fs, a.fraction AS ff, a.lat AS fla, a.lon AS flo, best AS score, a.stretch = f.stretch AS same,
  string_split(f.stretch, '|') AS p, string_split(a.stretch, '|') AS q FROM fps f LEFT JOIN rk a ON a.query = f.fp_id AND a.rank = 1),
s AS (SELECT *, CASE WHEN same THEN NULL WHEN p[1] = q[1] THEN [0, 0] WHEN p[1] = q[2] THEN [0, 1] WHEN p[2] = q[1] THEN [1, 0] WHEN p[2] = q[2] THEN [1, 1] END AS sh FROM j),
m AS (SELECT *, CASE WHEN same THEN abs(fraction - ff) ELSE abs(fraction - sh[1]) + abs(ff - sh[2]) END AS ef,
  CASE WHEN same OR sh IS NOT NULL THEN {_DIST.format("lat", "lon", "fla", "flo")} END AS em, CASE WHEN fraction < 0.2 THEN 0 WHEN fraction > 0.8 THEN 1 END AS e FROM s)
SELECT count(*) AS scans, count(*) FILTER (same) AS right_stretch, count(*) FILTER (sh IS NOT NULL) AS across_mark, count(*) FILTER (fs IS NOT NULL AND NOT same AND sh IS NULL) AS wrong_stretch,
  count(*) FILTER (fs IS NULL) AS not_on_map, count(*) FILTER (em <= 20 + 60 * (1 - score)) AS within_band, round(avg(ef), 4) AS mean_fraction, round(median(ef), 4) AS median_fraction,
  round(avg(em), 4) AS mean_m, round(median(em), 4) AS median_m,
  round(avg(CASE WHEN same AND e IS NOT NULL THEN (CASE WHEN e = 0 THEN 1 ELSE -1 END) * (ff - fraction) * length_m WHEN sh[1] = e THEN -em END), 4) AS pulled_in_m FROM m"""

QUERIES = {
    f.__name__: f for f in (locate_tie, locate_path, pace_filter, answer_jumps, calibration, level_curves, locate_levels, band, check_map)
}
#: The path, pace, calibration and level placement are recursive or stateful; tests hold them against plain Python.
ORACLE_SQL = {"locate_tie": TIE_SQL, "answer_jumps": JUMPS_SQL, "level_curves": CURVES_SQL, "band": BAND_SQL, "check_map": CHECK_SQL}
