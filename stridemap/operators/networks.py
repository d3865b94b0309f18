"""Where networks stand: roll-ups, weighted centroids on the map and along the route, and how passes of a stretch agree.

``placed`` has a row per (run, scan, key) in a segment: run, scan_id, t, seg, fraction, lat, lon, key, strength, has_signal, pos,
connected, stretch, along (fraction in the stretch's direction), forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import distance_m, signal_weight


def route_stretches(segs: DataFrame, fold_start: str = "fold_start", fold_end: str = "fold_end") -> DataFrame:
    """Segments of one unordered pair of crossings are one stretch; the first of them sets its direction."""
    a, b = F.col(fold_start), F.col(fold_end)
    rows = segs.withColumn("stretch", F.concat_ws("|", F.least(a, b), F.greatest(a, b)))
    first = Window.partitionBy("run", "stretch").orderBy("seg")
    return rows.withColumn("forward", a == F.first(a).over(first))


def along() -> Column:
    return F.when(F.col("forward"), F.col("fraction")).otherwise(1.0 - F.col("fraction"))


def roll_up(placed: DataFrame) -> DataFrame:
    """Per run and network: scans that saw it, first and last time, its best sighting (the earliest of equals) and where that was."""
    best = F.max_by(F.struct("t", "seg", "fraction", "strength"), F.struct(F.col("strength"), -F.col("t"), -F.col("pos")))
    return placed.groupBy("run", "key").agg(
        F.countDistinct("scan_id").alias("seen"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), best.alias("b"),
        F.max("connected").alias("connected"), F.min("pos").alias("first_pos"),
    ).select("run", "key", "seen", "first_t", "last_t", F.col("b.t").alias("best_t"), F.col("b.seg").alias("seg"),
             F.col("b.fraction").alias("fraction"), F.col("b.strength").alias("best"), "connected", "first_pos")


def in_route_order(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("ord", F.row_number().over(Window.partitionBy("run").orderBy("seg", "fraction", "first_pos")))


def first_listing(placed: DataFrame) -> DataFrame:
    """A scan's first listing of each key, if it has a signal."""
    w = Window.partitionBy("run", "scan_id", "key").orderBy("pos")
    return placed.withColumn("nth", F.row_number().over(w)).where("nth = 1 and has_signal").drop("nth")


def centroids(placed: DataFrame, path_loss: float = C.PATH_LOSS) -> DataFrame:
    """Weighted centroid, weighted mean distance to it, and the same without weights: two aggregations and a join on the key."""
    rows = first_listing(placed).where("lat is not null").withColumn("w", signal_weight(F.col("strength"), path_loss))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w"))
    middles = rows.groupBy("run", "key").agg(
        mean("lat").alias("est_lat"), mean("lon").alias("est_lon"), F.avg("lat").alias("plain_lat"), F.avg("lon").alias("plain_lon"),
        F.count("*").alias("sightings"),
    )
    joined = rows.join(middles, ["run", "key"])
    away = distance_m(F.col("est_lat"), F.col("est_lon"), F.col("lat"), F.col("lon"))
    plain = distance_m(F.col("plain_lat"), F.col("plain_lon"), F.col("lat"), F.col("lon"))
    spreads = joined.groupBy("run", "key").agg((F.sum(F.col("w") * away) / F.sum("w")).alias("spread_m"), F.avg(plain).alias("plain_spread_m"))
    return flags(middles.join(spreads, ["run", "key"]).drop("plain_lat", "plain_lon"), "spread_m", "plain_spread_m")


def flags(rows: DataFrame, spread: str, plain: str) -> DataFrame:
    """Whether the signal pinned a network down at all, and whether there was little to go by."""
    barely = (F.col(plain) <= 0) | (F.col(spread) > C.PINNED * F.col(plain))
    return rows.withColumn("barely_pinned", barely).withColumn("few_sightings", F.col("sightings") < 3)


def route_centroids(placed: DataFrame, path_loss: float = C.PATH_LOSS) -> DataFrame:
    """The same along the stretch on which a network was loudest in sum (the first walked of equals)."""
    rows = first_listing(placed).withColumn("w", signal_weight(F.col("strength"), path_loss))
    sums = rows.groupBy("run", "key", "stretch").agg(F.sum("w").alias("total"), F.min(F.struct("t", "pos")).alias("first"))
    loudest = Window.partitionBy("run", "key").orderBy(F.round("total", 12).desc(), "first")
    chosen = sums.withColumn("nth", F.row_number().over(loudest)).where("nth = 1").select("run", "key", "stretch")
    rows = rows.join(chosen, ["run", "key", "stretch"])
    middles = rows.groupBy("run", "key", "stretch").agg(
        (F.sum(F.col("w") * F.col("along")) / F.sum("w")).alias("at"), F.avg("along").alias("plain_at"), F.count("*").alias("sightings")
    )
    joined = rows.join(middles, ["run", "key", "stretch"])
    spreads = joined.groupBy("run", "key", "stretch").agg(
        (F.sum(F.col("w") * F.abs(F.col("along") - F.col("at"))) / F.sum("w")).alias("spread"),
        F.avg(F.abs(F.col("along") - F.col("plain_at"))).alias("plain_spread"),
    )
    return flags(middles.join(spreads, ["run", "key", "stretch"]).drop("plain_at"), "spread", "plain_spread")


def passes(placed: DataFrame, path_loss: float = C.PATH_LOSS) -> DataFrame:
    """Each pass (walked segment) of a stretch: the centroid of every network with a signal, all listings counted."""
    rows = placed.where("has_signal").withColumn("w", signal_weight(F.col("strength"), path_loss))
    return rows.groupBy("run", "stretch", "seg", "forward", "key").agg((F.sum(F.col("w") * F.col("along")) / F.sum("w")).alias("at"))


def repeated_stretches(passed: DataFrame) -> DataFrame:
    """Stretches walked more than once: how far apart the passes put the same network, and half the shift between directions."""
    per = passed.groupBy("run", "stretch", "key").agg(
        F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("range"), F.avg(F.when(F.col("forward"), F.col("at"))).alias("there"),
        F.avg(F.when(~F.col("forward"), F.col("at"))).alias("back"),
    )
    walked = passed.groupBy("run", "stretch").agg(F.countDistinct("seg").alias("passes")).where("passes > 1")
    found = per.where("n > 1").groupBy("run", "stretch").agg(
        F.count("*").alias("shared"), F.avg("range").alias("disagreement"), (F.avg(F.col("there") - F.col("back")) / 2.0).alias("shift")
    )
    return walked.join(found, ["run", "stretch"])
