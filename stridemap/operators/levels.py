"""Level curves along a stretch, and placing a scan on them.

The curve of a key is its level over the metres of the stretch: a local line, weighted by a Gaussian, at every grid point. A
fingerprint that lacks the key counts with the level of an unheard network.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.runtime import materialize


def curves(fps: DataFrame, fp_keys: DataFrame) -> DataFrame:
    """(stretch, fraction, key, level, support) on a grid of LEVEL_STEP_M, for stretches with two fingerprints at least.

    Needs fp_id, stretch, fraction, length_m. Grid points and keys multiply with the fingerprints of one stretch only.
    """
    heard = fp_keys.select("fp_id").distinct()
    rows = fps.join(heard, "fp_id", "left_semi").select("fp_id", "stretch", "fraction", "length_m")
    sizes = rows.groupBy("stretch").agg(F.count("*").alias("n"), F.max("length_m").alias("len")).where("n > 1")
    sizes = sizes.withColumn("len", F.coalesce(F.nullif("len", F.lit(0.0)), F.lit(C.BLOCK_M)))
    sizes = sizes.withColumn("steps", F.greatest(F.bround(F.col("len") / C.LEVEL_STEP_M).cast("int"), F.lit(10)))
    keys = fp_keys.join(rows.select("fp_id", "stretch"), "fp_id").select("stretch", "key").distinct()
    points = rows.join(sizes, "stretch").select("stretch", "fp_id", (F.col("fraction") * F.col("len")).alias("x"), "len", "steps")
    grid = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    d = F.col("x") - F.col("len") * F.col("k") / F.col("steps")
    grid = grid.withColumn("d", d).withColumn("w", F.exp(-0.5 * F.pow(F.col("d") / C.LEVEL_WIDTH_M, 2)))
    # Sums over all fingerprints, with the unheard level everywhere; then what each key adds to that where it was heard.
    base = grid.groupBy("stretch", "k", "steps").agg(F.sum("w").alias("s0"), F.sum(F.expr("w * d")).alias("s1"), F.sum(F.expr("w * d * d")).alias("s2"))
    over = F.greatest(F.col("strength"), F.lit(C.LEVEL_UNHEARD)) - C.LEVEL_UNHEARD
    added = grid.join(fp_keys.select("fp_id", "key", over.alias("over")), "fp_id").groupBy("stretch", "k", "key").agg(
        F.sum(F.expr("w * over")).alias("t0"), F.sum(F.expr("w * d * over")).alias("t1")
    )
    rows = base.join(keys, "stretch").join(added, ["stretch", "k", "key"], "left").fillna(0.0, ["t0", "t1"])
    return rows.select("stretch", *_levels())


def _levels() -> list[Column]:
    """fraction, key, level, support of a grid point and key from its sums."""
    flat = F.expr("s0 * s2 - s1 * s1")
    value = F.when(flat > 1e-9, F.expr("(s2 * t0 - s1 * t1)") / flat).when(F.col("s0") > 0, F.expr("t0 / s0")).otherwise(0.0)
    return [
        (F.col("k") / F.col("steps")).alias("fraction"), F.col("key"), F.greatest(value + C.LEVEL_UNHEARD, F.lit(C.LEVEL_UNHEARD)).alias("level"),
        F.col("s0").alias("support"),
    ]


def held_out_curves(fps: DataFrame, fp_keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """(grp, stretch, fraction, key, level, support): ``curves`` of the map without each group, for the ``wanted`` (grp, stretch).

    All sums are taken once over all groups, and the own group's are subtracted. A grid depends on the length of the stretch, which the own group may have
    been alone to give: a stretch has then two grids. A point whose sums are all but the own group's keeps few digits, and no support.
    """
    heard = fp_keys.select("fp_id").distinct()
    rows = fps.join(heard, "fp_id", "left_semi").select("fp_id", "grp", "stretch", "fraction", "length_m")
    own = rows.groupBy("stretch", "grp").agg(F.count("*").alias("own_n"), F.max("length_m").alias("len"))
    total = own.groupBy("stretch").agg(F.sum("own_n").alias("n"), F.max(F.struct("len", "grp")).alias("first"))
    second = own.join(total, "stretch").where(F.col("grp") != F.col("first.grp")).groupBy("stretch").agg(F.max("len").alias("second"))
    held = wanted.distinct().join(total, "stretch").join(second, "stretch", "left").join(own.select("stretch", "grp", "own_n"), ["stretch", "grp"], "left")
    held = held.where(F.col("n") - F.coalesce("own_n", F.lit(0)) > 1)
    length = F.when(F.col("grp") == F.col("first.grp"), F.col("second")).otherwise(F.col("first.len"))
    held = held.select("grp", "stretch", F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(C.BLOCK_M)).alias("len"))
    held = materialize(held.withColumn("steps", F.greatest(F.bround(F.col("len") / C.LEVEL_STEP_M).cast("int"), F.lit(10))), "held", few=True)
    grid = rows.join(held.select("stretch", "len", "steps").distinct(), "stretch").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    d = F.col("fraction") * F.col("len") - F.col("len") * F.col("k") / F.col("steps")
    grid = grid.withColumn("d", d).withColumn("w", F.exp(-0.5 * F.pow(F.col("d") / C.LEVEL_WIDTH_M, 2)))
    over = F.greatest(F.col("strength"), F.lit(C.LEVEL_UNHEARD)) - C.LEVEL_UNHEARD
    with_keys = grid.join(fp_keys.select("fp_id", "key", over.alias("over")), "fp_id")
    base = _less_own(grid, ["stretch", "len", "k"], {"s0": "w", "s1": "w * d", "s2": "w * d * d"})
    added = _less_own(with_keys, ["stretch", "len", "k", "key"], {"t0": "w * over", "t1": "w * d * over"})
    keys = _less_own(fp_keys.join(rows.select("fp_id", "grp", "stretch"), "fp_id"), ["stretch", "key"], {"heard": "1L"})
    met = base(held).join(keys(held.select("grp", "stretch")).where("heard > 0").drop("heard"), ["grp", "stretch"])
    return added(met).select("grp", "stretch", *_levels())


def _less_own(rows: DataFrame, by: list[str], sums: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """Joins to held-out rows (grp, some of ``by``) the ``sums`` of all other groups' ``rows``; 0 where there is none."""
    own = materialize(rows.groupBy("grp", *by).agg(*(F.sum(F.expr(e)).alias(f"own_{k}") for k, e in sums.items())), "sums", few=True)
    total = own.groupBy(*by).agg(*(F.sum(f"own_{k}").alias(k) for k in sums))

    def joined(held: DataFrame) -> DataFrame:
        known = [c for c in by if c in held.columns]
        met = held.join(total, known, "left" if known == by else "inner").join(own, ["grp", *by], "left")
        return met.withColumns({k: F.coalesce(k, F.lit(0.0)) - F.coalesce(f"own_{k}", F.lit(0.0)) for k in sums}).drop(*(f"own_{k}" for k in sums))

    return joined


def place(answers: DataFrame, curve: DataFrame, query_keys: DataFrame) -> DataFrame:
    """(query, fraction): each answer moved to the grid point of its stretch whose levels fit the scan best, up to a constant.

    Ties go to the point nearest to the match, then the smaller fraction. Answers whose scan shares no key with the stretch's
    curves, or without curves, have no row.
    """
    good = curve.where(F.col("support") >= C.LEVEL_SUPPORT).withColumnRenamed("fraction", "f")
    asked = answers.select("query", "stretch", "fraction")
    shared = asked.join(query_keys.select("query", "key"), "query").join(curve.select("stretch", "key").distinct(), ["stretch", "key"], "left_semi")
    asked = asked.join(shared.select("query").distinct(), "query", "left_semi")
    met = asked.join(good, "stretch").join(query_keys.select("query", "key", F.col("strength").alias("mine")), ["query", "key"], "left")
    miss = F.coalesce(F.greatest("mine", F.lit(C.LEVEL_UNHEARD)), F.lit(C.LEVEL_UNHEARD)) - F.col("level")
    fits = met.withColumn("miss", miss).groupBy("query", "fraction", "f").agg(
        F.sum(F.col("miss") * F.col("miss")).alias("ss"), F.sum("miss").alias("s"), F.count("*").alias("n")
    )
    misfit = F.round(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), 6)
    best = F.min(F.struct(misfit.alias("misfit"), F.round(F.abs(F.col("f") - F.col("fraction")), 12).alias("away"), F.col("f")))
    return fits.groupBy("query").agg(best.alias("b")).select("query", F.col("b.f").alias("fraction"))
