"""Placing scans between crossings: by the clock, or by how much the set of networks in view turns over.

Tables: ``waypoints`` (run, ord, t, name, lat, lon), ``scans`` (run, scan_id, t, interface, keys: array of identities). A run is one
walk's notebook, so windows and range joins stay within (run, segment), whatever the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C


def segments(waypoints: DataFrame) -> DataFrame:
    """Consecutive crossings of a run: half-open, the last one closed."""
    w = Window.partitionBy("run").orderBy("ord")
    later = lambda c: F.lead(c).over(w).alias(f"end_{c}")
    rows = waypoints.select(
        "run", F.col("ord").alias("seg"), *(F.col(c).alias(f"start_{c}") for c in ("t", "name", "lat", "lon")),
        *(later(c) for c in ("t", "name", "lat", "lon")), (F.lead("ord", 2).over(w).isNull()).alias("is_last"),
    )
    return rows.where("end_t is not null")


def in_segment(scans: DataFrame, segs: DataFrame) -> DataFrame:
    """As-of join of scans (run, t, ...) with the segment (run, seg, start_t, end_t, ...) that holds them, in one sort of each run; others get null.

    Segments follow one another, so the last one that has begun is the only one that can hold a scan. A segment of no duration holds none, unless it is the
    last: then what happens at its moment is in it.
    """
    mine, theirs = F.struct(*(F.col(c) for c in scans.columns)), F.struct(*(F.col(c) for c in segs.columns if c != "run"))
    marks = segs.where((F.col("start_t") < F.col("end_t")) | F.col("is_last")).select("run", F.col("start_t").alias("at"), F.lit(0).alias("kind"), "seg", theirs.alias("theirs"))
    looks = scans.select("run", F.col("t").alias("at"), F.lit(1).alias("kind"), mine.alias("mine"))
    order = Window.partitionBy("run").orderBy("at", "kind", "seg").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(looks, allowMissingColumns=True).withColumn("found", F.last("theirs", ignorenulls=True).over(order)).where("kind = 1")
    at_end = F.col("found.is_last") & (F.col("mine.t") == F.col("found.end_t"))
    inside = (F.col("mine.t") < F.col("found.end_t")) | at_end
    return found.withColumn("found", F.when(inside, F.col("found"))).select("mine.*", "found.*")


def outside(scans: DataFrame, waypoints: DataFrame) -> DataFrame:
    """How many scans of each run lie before the first and after the last crossing."""
    ends = waypoints.groupBy("run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return scans.join(ends, "run").groupBy("run").agg(
        F.count(F.when(F.col("t") < F.col("first_t"), 1)).alias("before"), F.count(F.when(F.col("t") > F.col("last_t"), 1)).alias("after")
    )


def clock_fraction() -> Column:
    span = F.col("end_t") - F.col("start_t")
    return F.when(span > 0, (F.col("t") - F.col("start_t")) / span).otherwise(F.lit(0.0))


def place_by_clock(placed: DataFrame) -> DataFrame:
    """``fraction`` of the segment at a steady pace."""
    return placed.where("seg is not null").withColumn("fraction", clock_fraction())


def turnover(before: Column, after: Column) -> Column:
    """Jaccard distance of two arrays of identities; 0 for two empty views."""
    union = F.size(F.array_union(before, after))
    return F.when(union > 0, 1.0 - F.size(F.array_intersect(before, after)) / union).otherwise(F.lit(0.0))


def steps(placed: DataFrame) -> DataFrame:
    """Per scan of a segment: ``span`` since the scan before it, and ``step``, the turnover, which is null where it says nothing.

    It says nothing between looks of different cards and across a hole: a span over HOLE times the segment's usual span (the upper median).
    """
    w = Window.partitionBy("run", "seg").orderBy("t", "scan_id")
    whole = Window.partitionBy("run", "seg")
    rows = placed.where("seg is not null").withColumn("span", F.col("t") - F.lag("t").over(w))
    raw = F.when(
        F.col("interface").eqNullSafe(F.lag("interface").over(w)) & F.col("span").isNotNull(), turnover(F.lag("keys").over(w), F.col("keys"))
    )
    rows = rows.withColumn("raw", raw).withColumn("nth", F.row_number().over(whole.orderBy(F.asc_nulls_last("span"))))
    upper = F.when(F.col("nth") == F.floor(F.count("span").over(whole) / 2) + 1, F.col("span"))
    rows = rows.withColumn("upper", upper).withColumn("usual", F.coalesce(F.max("upper").over(whole), F.lit(0))).drop("nth", "upper")
    hole = (F.col("usual") > 0) & (F.col("span") > F.col("usual") * C.HOLE)
    return rows.withColumn("hole", F.coalesce(hole, F.lit(False))).withColumn("step", F.when(~F.col("hole"), F.col("raw"))).drop("raw")


def place_by_movement(placed: DataFrame) -> DataFrame:
    """``fraction`` by shared-out turnover; by the clock where a segment shows no movement."""
    rows = steps(placed)
    whole = Window.partitionBy("run", "seg")
    w = whole.orderBy("t", "scan_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "walked": F.sum("step").over(whole), "seconds": F.sum(F.when(F.col("step").isNotNull(), F.col("span"))).over(whole),
        "t0": F.min("t").over(whole), "tn": F.max("t").over(whole),
    })
    rows = rows.withColumn("rate", F.when((F.col("walked") > 0) & (F.col("seconds") > 0), F.col("walked") / F.col("seconds")))
    filled = F.when(F.col("span").isNotNull(), F.coalesce("step", F.col("rate") * F.col("span"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("filled", filled).withColumns({"sum_filled": F.sum("filled").over(whole), "so_far": F.sum("filled").over(w)})
    head = F.col("rate") * (F.col("t0") - F.col("start_t"))
    tail = F.col("rate") * (F.col("end_t") - F.col("tn"))
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (head + F.col("so_far")) / (head + F.col("sum_filled") + tail)))
    return rows.withColumn("fraction", F.coalesce(moved, clock_fraction())).drop(
        "walked", "seconds", "t0", "tn", "rate", "filled", "sum_filled", "so_far", "usual"
    )


def with_coordinates(placed: DataFrame) -> DataFrame:
    """``lat`` and ``lon`` on the straight line between the crossings; null unless both have coordinates."""
    along = lambda c: F.col(f"start_{c}") + (F.col(f"end_{c}") - F.col(f"start_{c}")) * F.col("fraction")
    both = F.col("start_lat").isNotNull() & F.col("end_lat").isNotNull()
    return placed.withColumn("lat", F.when(both, along("lat"))).withColumn("lon", F.when(both, along("lon")))


def held_out_crossings(scans: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Each inner crossing left out in turn: where its nearest scan lands on the merged segment, by the clock and by movement.

    Only the two legs that meet at the crossing are placed again, in one windowed pass partitioned by crossing.
    """
    w = Window.partitionBy("run").orderBy("ord")
    side = lambda c, k: (F.lag(c) if k < 0 else F.lead(c)).over(w)
    inner = waypoints.select(
        "run", F.col("ord").alias("seg"), F.col("t").alias("mid_t"), *(side(c, -1).alias(f"start_{c}") for c in ("t", "name", "lat", "lon")),
        *(side(c, 1).alias(f"end_{c}") for c in ("t", "name", "lat", "lon")), F.col("lat").alias("mid_lat"), F.col("lon").alias("mid_lon"),
        F.lead("ord", 2).over(w).isNull().alias("is_last"),
    ).where("start_t is not null and end_t is not null")
    inside = (F.col("t") >= F.col("start_t")) & ((F.col("t") < F.col("end_t")) | (F.col("is_last") & (F.col("t") == F.col("end_t"))))
    legs = scans.join(inner.withColumnRenamed("run", "seg_run"), (F.col("run") == F.col("seg_run")) & inside).drop("seg_run")
    moved = place_by_movement(legs).withColumn("clock", clock_fraction())
    gap = F.abs(F.col("t") - F.col("mid_t"))
    at = F.struct("scan_id", "fraction", "clock")
    near = moved.groupBy("run", "seg").agg(F.min_by(at, F.struct(gap, F.col("t"), F.col("scan_id"))).alias("best"), F.min(gap).alias("best_gap"))
    # The nearest of all scans, in the legs or not: a crossing whose nearest scan is elsewhere has no answer.
    times = scans.select("run", F.col("t").alias("at")).unionByName(inner.select("run", F.col("mid_t").alias("at"), "seg"), allowMissingColumns=True)
    order = Window.partitionBy("run").orderBy("at")
    heard = F.when(F.col("seg").isNull(), F.col("at"))
    times = times.withColumns({
        "before": F.last(heard, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0)), "after": F.first(heard, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing)),
    })
    least = times.where("seg is not null").select("run", "seg", F.least(F.col("at") - F.col("before"), F.col("after") - F.col("at")).alias("least_gap"))
    good = near.join(least, ["run", "seg"]).where("best_gap = least_gap").select("run", "seg", "best.*")
    return good.join(inner, ["run", "seg"])
