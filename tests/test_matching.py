"""The bounded similarity join and sums without the own group, against plain Python and against maps built anew."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap import walk
from stridemap.operators import levels, matching

FPS = "fp_id long, grp string, walk string, t long, stretch string, fraction double, lat double, lon double, length_m double"
KEYS = "fp_id long, key string, strength double"


def a_map(seed=4, groups=5, walks=12, looks=5):
    """Looks of places with networks of their own, and one network that all hear; some looks hear nothing else, or nothing."""
    r = random.Random(seed)
    fps, keys = [], []
    for w in range(walks):
        place = w % 4
        for k in range(looks):
            fp = len(fps)
            lat = None if fp % 13 == 0 else -34.9 - place / 100 - k / 9000 + r.random() / 1e5
            fps.append((fp, f"g{w % groups}", f"w{w}", 100 * w + 4 * k, f"s{place}|s{place + 1}", r.choice([k / looks, r.random()]), lat, None if lat is None else -56.1 - k / 5000, r.choice([100.0, 100.0, 120.0 + w])))
            own = [] if fp % 17 == 0 else r.sample([f"n{place}{x}" for x in range(7)], r.choice([0, 2, 5]))
            keys += [(fp, key, r.choice([None, -60.0, -71.0, -80.0])) for key in own + (["all"] if fp % 17 else [])]
    return fps, keys


def scored(fps, keys, by_signal=False):
    """(query, fp) -> score, each group left out of the map in its turn."""
    group, of = {f[0]: f[1] for f in fps}, defaultdict(dict)
    for fp, key, strength in keys:
        of[fp][key] = strength
    out = {}
    for held in set(group.values()):
        rest = [fp for fp in group if group[fp] != held]
        df = Counter(k for fp in rest for k in of[fp])
        weight = lambda ks, df=df, rest=rest: sum(math.log(1 + len(rest) / df[k]) if df[k] else math.log(1 + len(rest)) for k in ks)
        for q in (fp for fp in group if group[fp] == held):
            for fp in rest:
                both = of[q].keys() & of[fp].keys()
                if both:
                    score = weight(both) / weight(of[q].keys() | of[fp].keys())
                    off = [abs(of[q][k] - of[fp][k]) for k in both if of[q][k] is not None and of[fp][k] is not None]
                    out[q, fp] = score * ((math.exp(-sum(off) / len(off) / 10) if off else 0.75) if by_signal else 1)
    return out


@pytest.mark.parametrize("few", [100, 0])
def test_no_pair_over_the_floor_is_lost(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_GROUPS", few)
    made, heard = a_map()
    fps, keys = spark.createDataFrame(made, FPS), spark.createDataFrame(heard, KEYS)
    queries, asked = fps.select(F.col("fp_id").alias("query"), "grp"), keys.withColumnRenamed("fp_id", "query")
    for by_signal in (False, True):
        expected = scored(made, heard, by_signal)
        for floor in (0.0, 0.15, 0.6):
            got = {(r["query"], r["fp_id"]): r["score"] for r in matching.similarities(fps, keys, queries, asked, by_signal, floor=floor).collect()}
            wanted = {pair: s for pair, s in expected.items() if s >= floor}
            assert got.keys() == wanted.keys()
            assert all(s == pytest.approx(wanted[pair], abs=1e-8) for pair, s in got.items())


def test_what_all_hear_is_joined_with_nothing(spark):
    made, heard = a_map(walks=24)
    heard = [(fp, key, s) for fp, key, s in heard if key != "all"] + [(f[0], "all", -50.0) for f in made]
    alone = {f[0] for f in made} - {fp for fp, key, _ in heard if key != "all"}
    heard = [(fp, key, s) for fp, key, s in heard if fp not in alone]  # looks with no other network weigh all in that one
    fps, keys = spark.createDataFrame(made, FPS), spark.createDataFrame(heard, KEYS)
    queries, asked = fps.select(F.col("fp_id").alias("query"), "grp"), keys.withColumnRenamed("fp_id", "query")
    own, rest = matching.held_out_weights(keys, fps, queries.select("grp").distinct())
    df = own.groupBy("key").agg(F.sum("own").alias("df"))
    weights = matching.weighted(asked.join(queries, "query"), own, rest, df)
    found = {(r["query"], r["walk"]) for r in matching.candidate_walks(weights, fps, keys, own, 0.3).collect()}
    of, sets = {f[0]: f[2] for f in made}, defaultdict(set)
    for fp, key, _ in heard:
        sets[fp].add(key)
    for query, w in found:  # each shares something else with one of the walk's looks
        assert any(of[fp] == w and len(sets[fp] & sets[query]) > 1 for fp in sets)
    pairs = len({(q, of[fp]) for q in sets for fp in sets if made[q][1] != made[fp][1]})
    assert 0 < len(found) < pairs / 2
    assert found >= {(q, of[fp]) for (q, fp), s in scored(made, heard).items() if s >= 0.3}


def test_scores_of_whole_walks_give_the_best_looks(spark):
    made, heard = a_map(seed=9)
    fps, keys = spark.createDataFrame(made, FPS), spark.createDataFrame(heard, KEYS)
    queries, asked = fps.select(F.col("fp_id").alias("query"), "grp"), keys.withColumnRenamed("fp_id", "query")
    bounded = matching.best_looks(matching.walk_scores(fps, keys, queries, asked), 6)
    whole = matching.looks(matching.similarities(fps, keys, queries, asked), fps, 6)
    rows = lambda df: sorted((tuple(None if x is None else round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(whole.columns).collect()), key=repr)
    assert rows(bounded) == rows(whole) and len(rows(whole)) > 20


def test_sums_without_the_own_group_are_those_of_a_map_without_it(spark):
    made, heard = a_map(seed=2, groups=3)
    made += [(900, "lone", "wl", 1, "s0|s1", 0.25, -34.9, -56.0, 400.0), (901, "lone", "wl", 2, "x|y", 0.5, -34.0, -56.0, None), (902, "g0", "wm", 2, "x|y", 0.5, -34.0, -56.0, None)]
    heard = [(fp, k, s) for fp, k, s in heard if s is not None] + [(900, "n00", -50.0), (901, "n00", -50.0), (902, "only", -50.0)]
    fps, keys = spark.createDataFrame(made, FPS), spark.createDataFrame(heard, KEYS)
    wanted = fps.select("grp").distinct().crossJoin(fps.select("stretch").distinct())
    lines, curves = walk.held_out_lines(fps, wanted), levels.held_out_curves(fps, keys, wanted)
    assert "NestedLoop" not in lines._jdf.queryExecution().toString() and "NestedLoop" not in curves._jdf.queryExecution().toString()
    got_lines = {(r["grp"], r["stretch"]): tuple(r)[2:] for r in lines.select("grp", "stretch", "lat_slope", "lat_0", "lon_slope", "lon_0").collect()}
    got_curves = {(r["grp"], r["stretch"], round(r["fraction"], 9), r["key"]): (r["level"], r["support"]) for r in curves.collect()}
    seen_lines = seen_curves = 0
    for held in ("g0", "g1", "g2", "lone"):
        rest = fps.where(F.col("grp") != held)
        for r in matching.stretch_lines(rest).collect():
            assert got_lines[held, r["stretch"]] == pytest.approx((r["lat_slope"], r["lat_0"], r["lon_slope"], r["lon_0"]), abs=1e-9)
            seen_lines += 1
        theirs = keys.join(rest.select("fp_id"), "fp_id")
        for r in levels.curves(rest, theirs).collect():
            level, support = got_curves[held, r["stretch"], round(r["fraction"], 9), r["key"]]
            assert support == pytest.approx(r["support"], abs=1e-9)
            if support >= C.LEVEL_SUPPORT:  # others are not used
                assert level == pytest.approx(r["level"], abs=1e-4)
            seen_curves += 1
    assert (seen_lines, seen_curves) == (len(got_lines), len(got_curves)) and seen_lines > 10
