"""Fingerprint maps and locating scans on them by weighted set similarity.

``fps`` (fp_id, grp, walk, t, stretch, fraction, lat, lon, length_m), ``fp_keys`` (fp_id, key, strength; a key once a look), ``queries`` (query, grp) and
``query_keys`` (query, key, strength). ``grp`` is what is held out: a query is never matched with fingerprints of its own group. With
all groups of queries distinct from those of the map, nothing is held out.

Every query is scored in one job, with the weights of the map without the query's group worked out from counts (document frequency less the
group's own) instead of a map per group. Pairs that can't reach the floor are never made: a prefix index over the rarest keys finds the walks that may answer (``candidate_walks``), and
only these are scored, in full. A network that all looks hear is in no prefix, so it is joined with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import distance_m
from stridemap.runtime import materialize, small_side

#: Decimals to which scores are rounded before they are ranked, so that the order of summing can't decide a tie.
DECIMALS = 9
#: What a bound gives way, for rounding.
SLACK = 1e-6
#: Up to so many held-out groups, every fingerprint is weighed once for each of them.
FEW_GROUPS = 100


def rarity(fp_keys: DataFrame, fps: DataFrame) -> DataFrame:
    """(key, df, weight): ln(1 + N / df) over all fingerprints of the map, empty ones too."""
    n = fps.agg(F.count("*").alias("n"))
    return fp_keys.groupBy("key").agg(F.countDistinct("fp_id").alias("df")).crossJoin(F.broadcast(n)).select(
        "key", "df", F.log(1.0 + F.col("n") / F.col("df")).alias("weight")
    )


def held_out_weights(fp_keys: DataFrame, fps: DataFrame, groups: DataFrame, by_rarity: bool = True) -> tuple[DataFrame, DataFrame]:
    """((grp, key, weight) for keys that a group has itself, (grp, key-independent counts n)) of the map without each group.

    Keys that a group lacks have the same df in the map without it, but another N; ``weight_of`` puts both together.
    """
    of = fp_keys.join(fps.select("fp_id", "grp"), "fp_id")
    own = of.groupBy("grp", "key").agg(F.countDistinct("fp_id").alias("own"))
    n = fps.groupBy("grp").agg(F.count("*").alias("own_n"))
    total = fps.agg(F.count("*").alias("n"))
    rest = groups.join(n, "grp", "left").crossJoin(F.broadcast(total)).select("grp", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("rest_n"))
    return own, rest


def weighted(keys: DataFrame, own: DataFrame, rest: DataFrame, df: DataFrame, by_rarity: bool = True) -> DataFrame:
    """``keys`` (grp, key, ...) with ``weight`` in the map without the group; a key that it lacks weighs as one not known."""
    if not by_rarity:
        return keys.withColumn("weight", F.lit(1.0))
    rows = keys.join(rest, "grp").join(df, "key", "left").join(own, ["grp", "key"], "left")
    left = F.coalesce("df", F.lit(0)) - F.coalesce("own", F.lit(0))
    weight = F.when(left > 0, F.log(1.0 + F.col("rest_n") / left)).otherwise(F.log(1.0 + F.col("rest_n")))
    return rows.withColumn("weight", weight).drop("rest_n", "df", "own")


def candidate_walks(asked: DataFrame, fps: DataFrame, fp_keys: DataFrame, own: DataFrame, floor: float, by_rarity: bool = True) -> DataFrame:
    """(query, grp, walk) of all walks with a fingerprint that may score ``floor`` at least, found through rare keys alone. ``own``: see ``held_out_weights``.

    Keys are put in one order, the rarest first. What two looks share weighs no less than ``floor`` times either of them, and no more than what is left from the
    first shared key on. So the first shared key stands before the tails of both that weigh less than that share, and only these heads are
    joined. A fingerprint's weights depend on the group that is left out; its head is that of the least total and the greatest tail of all groups.
    """
    share = max(floor - SLACK, 0.0)
    sizes = fps.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    bounds = own.groupBy("key").agg(F.sum("own").alias("df"), F.max("own").alias("own")).crossJoin(F.broadcast(sizes))
    low = F.log(1.0 + (F.col("n") - F.col("most")) / F.col("df")) if by_rarity else F.lit(1.0)
    high = F.log(1.0 + F.col("n") / F.greatest(F.col("df") - F.col("own"), F.lit(1))) if by_rarity else F.lit(1.0)
    bounds = bounds.select("key", "df", low.alias("low"), high.alias("high"))
    back = [F.desc("df"), F.desc("key")]
    tail = Window.partitionBy("query").orderBy(*back).rowsBetween(Window.unboundedPreceding, 0)
    of_query = Window.partitionBy("query")
    mine = asked.join(bounds.select("key", "df"), "key", "left").fillna(0, ["df"]).select("query", "grp", "key", "df", F.sum("weight").over(tail).alias("left"), F.sum("weight").over(of_query).alias("wq"))
    mine = mine.where((F.col("df") > 0) & (F.col("left") >= share * F.col("wq"))).select("query", "grp", "key", "wq")
    tail, of_fp = Window.partitionBy("fp_id").orderBy(*back).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("fp_id")
    theirs = fp_keys.join(bounds, "key").select(
        "fp_id", "key", F.sum("high").over(tail).alias("left"), F.sum("low").over(of_fp).alias("least"), F.sum("high").over(of_fp).alias("most"))
    theirs = theirs.where(F.col("left") >= share * F.col("least")).join(fps.select("fp_id", "walk", F.col("grp").alias("fp_grp")), "fp_id")
    # Of a walk's fingerprints with a key one row is enough: the bounds of all of them.
    theirs = theirs.groupBy("key", "walk", "fp_grp").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    met = mine.join(theirs, "key").where((F.col("grp") != F.col("fp_grp")) & (F.col("wq") >= share * F.col("least")) & (F.col("most") >= share * F.col("wq")))
    return met.select("query", "grp", "walk").distinct()


def walk_scores(fps: DataFrame, fp_keys: DataFrame, queries: DataFrame, query_keys: DataFrame, by_signal: bool = False, by_rarity: bool = True,
                floor: float = C.SIMILARITY_FLOOR) -> DataFrame:
    """(query, score, and the columns of ``fps``) of every fingerprint of the walks in which one may score ``floor``; also those that share no key, as 0.

    Walks are joined with the query's keys and these with the walk's fingerprints, by key; while map and queries are small, within one task a (query, walk).
    """
    groups = queries.select("grp").distinct()
    own, rest = held_out_weights(fp_keys, fps, groups)
    own = materialize(own, "own", few=True)
    df = own.groupBy("key").agg(F.sum("own").alias("df"))
    asked = weighted(query_keys.join(queries, "query").select("query", "grp", "key", "strength"), own, rest, df, by_rarity)
    asked = materialize(asked.select("query", "grp", "key", "strength", "weight"), "asked", few=True)
    walks = materialize(candidate_walks(asked, fps, fp_keys, own, floor, by_rarity), "walks", few=True)
    totals = asked.groupBy("query").agg(F.sum("weight").alias("wq"))
    # A fingerprint's total weight depends on the group that is left out: for a few groups it is summed for each, for many only for those that may meet it.
    if groups.count() <= FEW_GROUPS:
        needed = fp_keys.select("fp_id", "key").crossJoin(F.broadcast(groups))
    else:
        needed = walks.select("grp", "walk").distinct().join(fps.select("walk", "fp_id"), "walk").select("grp", "fp_id").join(fp_keys.select("fp_id", "key"), "fp_id")
    sums = materialize(weighted(needed, own, rest, df, by_rarity).groupBy("grp", "fp_id").agg(F.sum("weight").alias("wf")), "sums", few=True)
    # A key of no weight that all looks have keeps fingerprints that share no other.
    mine = asked.select("query", "key", "weight", "strength").unionByName(totals.select("query", *(F.lit(v).cast(k).alias(c) for c, k, v in _ALL)))
    there = fps.select("walk", "fp_id")
    theirs = fp_keys.join(there, "fp_id").select("walk", "key", "fp_id", F.col("strength").alias("theirs")).unionByName(
        there.withColumn("key", F.lit(_ALL[0][2])).withColumn("theirs", F.lit(None).cast("double"))
    )
    # Pairs are many times the bytes of what is joined, so they are dealt to as many tasks as there are shuffle partitions, whatever their bytes.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = walks.repartition(tasks, "query", "walk").join(small_side(mine, 64), "query").join(small_side(theirs, 80), ["walk", "key"])
    off = F.abs(F.col("strength") - F.col("theirs"))
    pairs = met.groupBy("query", "walk", "grp", "fp_id").agg(F.sum("weight").alias("inter"), F.avg(off).alias("off"))
    pairs = pairs.join(small_side(totals, 32), "query").join(small_side(sums, 64), ["grp", "fp_id"], "left")
    inter = F.col("inter")
    score = inter / (F.col("wq") + F.col("wf") - inter)
    if by_signal:
        score = score * F.coalesce(F.exp(-F.col("off") / C.RSSI_SCALE), F.lit(C.SIGNAL_UNKNOWN))
    pairs = pairs.select("query", "walk", "fp_id", F.when(inter > 0, F.round(score, DECIMALS)).otherwise(0.0).alias("score"))
    return pairs.join(small_side(fps, 200), ["walk", "fp_id"])


#: What stands in for a key that all looks have.
_ALL = (("key", "string", "\0"), ("weight", "double", 0.0), ("strength", "double", None))


def similarities(fps: DataFrame, fp_keys: DataFrame, queries: DataFrame, query_keys: DataFrame, by_signal: bool = False, by_rarity: bool = True,
                 floor: float = 0.0) -> DataFrame:
    """(query, fp_id, score) of all pairs that score ``floor`` at least; with a floor of 0, of all that share a key."""
    rows = walk_scores(fps, fp_keys, queries, query_keys, by_signal, by_rarity, floor)
    return rows.where((F.col("score") > 0) & (F.col("score") >= floor)).select("query", "fp_id", "score")


def looks(scores: DataFrame, fps: DataFrame, reach_s: int = C.ONE_LOOK_S, floor: float = C.SIMILARITY_FLOOR) -> DataFrame:
    """``best_looks`` from (query, fp_id, score) of fingerprints that share something with the query; the rest of their walks is joined back."""
    hits = scores.join(fps.select("fp_id", "walk"), "fp_id").select("query", "walk").distinct()
    rows = hits.join(fps, "walk").join(scores.select("query", "fp_id", "score"), ["query", "fp_id"], "left")
    return best_looks(rows.withColumn("score", F.coalesce("score", F.lit(0.0))), reach_s, floor)


def best_looks(rows: DataFrame, reach_s: int = C.ONE_LOOK_S, floor: float = C.SIMILARITY_FLOOR) -> DataFrame:
    """Each walk's best look at a query, from ``walk_scores``: the fingerprints within reach of one of them with the highest mean score.

    The mean counts fingerprints that share nothing with the query as 0. It is no more than the best score of the look, so walks without a score of ``floor`` have no
    row anyway. Ties: untimed fingerprints in file order, then the earliest.
    """
    rows = rows.withColumnRenamed("fp_id", "fp")
    timed = F.col("t").isNotNull()
    # An untimed fingerprint is a neighbourhood of one.
    w = Window.partitionBy("query", "walk", F.when(timed, F.lit(-1)).otherwise(F.col("fp"))).orderBy("t").rangeBetween(-reach_s, reach_s)
    s = F.col("score")
    known = F.col("lat").isNotNull()
    rows = rows.withColumns({
        "mean": F.round(F.avg(s).over(w), DECIMALS), "best": F.max(s).over(w), "sum_s": F.sum(s).over(w), "sum_f": F.sum(s * F.col("fraction")).over(w),
        "sum_known": F.sum(F.when(known, s)).over(w), "sum_lat": F.sum(s * F.col("lat")).over(w), "sum_lon": F.sum(s * F.col("lon")).over(w),
        "when": F.max("t").over(w), "len": F.first("length_m", ignorenulls=True).over(w),
    })
    one = Window.partitionBy("query", "walk").orderBy(F.col("mean").desc(), timed, "t", "fp")
    rows = rows.withColumn("nth", F.row_number().over(one)).where((F.col("nth") == 1) & (F.col("mean") > 0) & (F.col("mean") >= floor))
    return rows.select(
        "query", "walk", "stretch", (F.col("sum_f") / F.col("sum_s")).alias("fraction"), (F.col("sum_lat") / F.col("sum_known")).alias("lat"),
        (F.col("sum_lon") / F.col("sum_known")).alias("lon"), F.col("len").alias("length_m"), F.col("mean").alias("score"), "best", "when",
        F.col("grp").alias("outing"),
    )


def candidates(found: DataFrame, fps: DataFrame, neighbours: int = C.NEIGHBOURS) -> DataFrame:
    """The stretches of each query's best looks, ranked by their best look; one row a stretch with its weighted middle."""
    order = fps.groupBy("walk").agg(F.min("fp_id").alias("walk_ord"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "walk_ord")
    top = found.join(order, "walk").withColumn("place", F.row_number().over(w)).where(F.col("place") <= neighbours)
    s = F.col("score")
    groups = top.groupBy("query", "stretch").agg(
        (F.sum(s * F.col("fraction")) / F.sum(s)).alias("fraction"), (F.sum(s * F.col("lat")) / F.sum(F.when(F.col("lat").isNotNull(), s))).alias("lat"),
        (F.sum(s * F.col("lon")) / F.sum(F.when(F.col("lon").isNotNull(), s))).alias("lon"), F.min_by("length_m", F.when(F.col("length_m").isNotNull(), F.col("place"))).alias("length_m"),
        F.max("best").alias("best"), F.max("score").alias("weight"), F.count("*").alias("matches"), F.min("place").alias("first_place"),
        F.countDistinct("outing").alias("outings"), F.max("when").alias("when"),
        F.array_sort(F.collect_list(F.struct("score", "fraction", "lat", "lon"))).alias("members"),  # at most ``neighbours`` of them
    )
    members = F.col("members")
    spread = F.aggregate(members, F.lit(0.0), lambda a, m: a + m["score"] * F.abs(m["fraction"] - F.col("fraction"))) / F.aggregate(
        members, F.lit(0.0), lambda a, m: a + m["score"]
    )
    known = F.filter(members, lambda m: m["lat"].isNotNull())
    apart = F.array_max(F.flatten(F.transform(known, lambda a: F.transform(known, lambda b: distance_m(a["lat"], a["lon"], b["lat"], b["lon"])))))
    groups = groups.withColumn("spread", spread).withColumn("apart", F.when(F.size(known) > 1, apart)).drop("members")
    by = Window.partitionBy("query").orderBy("first_place")
    odds = F.pow(F.lit(C.ODDS_PER_TENTH), 10.0 * F.col("weight"))
    return groups.withColumn("rank", F.row_number().over(by)).withColumn("share", odds / F.sum(odds).over(Window.partitionBy("query"))).drop("first_place")


def locations(ranked: DataFrame) -> DataFrame:
    """The answer to each query: the first candidate, and the second as alternative if they are nearly as likely.

    Coordinates are withheld, and the alternative dropped, if the looks behind the answer lie too far apart to be one place.
    """
    first = ranked.where("rank = 1")
    second = ranked.where("rank = 2").select("query", F.col("stretch").alias("second"))
    rows = first.join(second, "query", "left")
    far = F.coalesce(F.nullif(C.ONE_PLACE_BLOCKS * F.col("length_m"), F.lit(0.0)), F.lit(C.ONE_PLACE_M))
    scattered = F.coalesce(F.col("apart") > far, F.lit(False))
    tied = F.col("second").isNotNull() & (F.col("share") < C.DOMINANCE)
    return rows.select(
        "query", "stretch", "fraction", F.when(~scattered, F.col("lat")).alias("lat"), F.when(~scattered, F.col("lon")).alias("lon"), "length_m",
        F.col("best").alias("score"), "matches", "spread", "when", "outings", scattered.alias("scattered"), F.when(~scattered & tied, F.col("second")).alias("alternative"),
    )


def locate(fps: DataFrame, fp_keys: DataFrame, queries: DataFrame, query_keys: DataFrame, by_signal: bool = False, by_rarity: bool = True,
           neighbours: int = C.NEIGHBOURS, floor: float = C.SIMILARITY_FLOOR, reach_s: int = C.ONE_LOOK_S) -> DataFrame:
    """Where each query was taken; queries that match nothing well enough have no row."""
    scores = walk_scores(fps, fp_keys, queries, query_keys, by_signal, by_rarity, floor)
    return locations(candidates(best_looks(scores, reach_s, floor), fps, neighbours))


def append_outings(fps: DataFrame, known: DataFrame) -> DataFrame:
    """Fingerprints of outings that the map doesn't hold yet."""
    return fps.join(known.select("outing").distinct(), "outing", "left_anti")


def map_summary(fps: DataFrame) -> DataFrame:
    return fps.agg(
        F.count("*").alias("fingerprints"), F.countDistinct("walk").alias("walks"), F.countDistinct("stretch").alias("stretches"),
        F.countDistinct("grp").alias("outings"),
    )


def mapped_places(fps: DataFrame) -> DataFrame:
    """(lat, lon) of the fingerprints that say where they were taken."""
    return fps.where("lat is not null and lon is not null").select("lat", "lon")


def can_hold_out(fps: DataFrame, outing: str = "outing") -> DataFrame:
    """One row, ``by_outing``: whether there are outings enough to hold one out whole; fingerprints without an outing are one."""
    return fps.agg((F.countDistinct(F.struct(outing)) > 1).alias("by_outing"))


def stretch_lines(fps: DataFrame) -> DataFrame:
    """Least-squares line of each stretch, latitude and longitude over the fraction; needs two different fractions."""
    rows = fps.where("lat is not null")
    return rows.groupBy("stretch").agg(
        F.regr_slope("lat", "fraction").alias("lat_slope"), F.regr_intercept("lat", "fraction").alias("lat_0"),
        F.regr_slope("lon", "fraction").alias("lon_slope"), F.regr_intercept("lon", "fraction").alias("lon_0"), F.countDistinct("fraction").alias("n"),
    ).where("n > 1").drop("n")
