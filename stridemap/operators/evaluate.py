"""How well a map locates its own scans when each outing is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import distance_m
from stridemap.operators.sequence import ends


def measured(fps: DataFrame, answers: DataFrame) -> DataFrame:
    """Each scan of the map with its held-out answer: error in metres and as a fraction, and whether it is across a mark.

    On the right stretch the error is the difference along it; on one that shares a mark it is measured through the mark; elsewhere
    there is none. Metres are straight where both places have coordinates.
    """
    found = answers.select(
        F.col("query").alias("fp_id"), F.col("stretch").alias("f_stretch"), F.col("fraction").alias("f_fraction"), F.col("lat").alias("f_lat"),
        F.col("lon").alias("f_lon"), F.col("length_m").alias("f_length_m"), "score",
    )
    rows = fps.join(found, "fp_id", "left")
    a, b = ends(F.col("stretch")), ends(F.col("f_stretch"))
    same = F.col("stretch") == F.col("f_stretch")
    pair = lambda i, j: F.struct(F.lit(float(i)).alias("mine"), F.lit(float(j)).alias("theirs"))
    shared = F.when(a[0] == b[0], pair(0, 0)).when(a[0] == b[1], pair(0, 1)).when(a[1] == b[0], pair(1, 0)).when(a[1] == b[1], pair(1, 1))
    rows = rows.withColumn("shared", F.when(~same, shared)).withColumn("same", same)
    to_mark, past = F.abs(F.col("fraction") - F.col("shared.mine")), F.abs(F.col("f_fraction") - F.col("shared.theirs"))
    gap = F.abs(F.col("fraction") - F.col("f_fraction"))
    straight = distance_m(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"))
    along = F.when(same, gap * F.col("length_m")).when(F.col("shared").isNotNull(), to_mark * F.col("length_m") + past * F.col("f_length_m"))
    rows = rows.withColumn("error_fraction", F.when(same, gap).otherwise(to_mark + past))
    rows = rows.withColumn("error_m", F.when(same | F.col("shared").isNotNull(), F.coalesce(straight, along)))
    abstained = F.col("f_stretch").isNull()
    return rows.withColumns({
        "abstained": abstained, "across_mark": F.col("shared").isNotNull(), "wrong_stretch": ~abstained & ~F.coalesce("same", F.lit(False)) & F.col("shared").isNull()
    })


def inwards(rows: DataFrame) -> Column:
    """Metres that an answer to a scan near a corner lies towards the middle of the block; null elsewhere."""
    end = F.when(F.col("fraction") < C.NEAR_A_CORNER, 0.0).when(F.col("fraction") > 1 - C.NEAR_A_CORNER, 1.0)
    way = F.when(end == 0.0, 1.0).otherwise(-1.0) * (F.col("f_fraction") - F.col("fraction")) * F.col("length_m")
    return F.when(end.isNotNull() & F.col("length_m").isNotNull(), F.when(F.col("same"), way).when(F.col("shared.mine") == end, -F.col("error_m")))


def report(rows: DataFrame) -> DataFrame:
    """One row of figures for a held-out check (all of them exact)."""
    band = C.BAND_BASE_M + C.BAND_SLOPE_M * (1.0 - F.col("score"))
    judged = F.col("error_m").isNotNull()
    return rows.agg(
        F.count("*").alias("scans"), F.count(F.when(F.col("same"), 1)).alias("right_stretch"), F.count(F.when(F.col("across_mark"), 1)).alias("across_mark"),
        F.count(F.when(F.col("wrong_stretch"), 1)).alias("wrong_stretch"), F.count(F.when(F.col("abstained"), 1)).alias("not_on_map"),
        F.avg("error_fraction").alias("mean_fraction"), F.median("error_fraction").alias("median_fraction"), F.avg("error_m").alias("mean_m"),
        F.median("error_m").alias("median_m"), F.count(F.when(judged & (F.col("error_m") <= band), 1)).alias("within_band"),
        F.avg(inwards(rows)).alias("pulled_in_m"),
    )


def own_outing_only(candidates: DataFrame, fps: DataFrame) -> DataFrame:
    """Queries whose answer rests on no outing but their own. Needs query, grp, outings (array)."""
    return candidates.where(F.size(F.array_except("outings", F.array("grp"))) == 0)
