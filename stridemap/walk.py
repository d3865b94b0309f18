"""The whole jobs, from logs and notebooks to placed networks, maps and answers.

``looks`` are sightings with a look's best reading per key (run, scan_id, t, interface, key, strength, has_signal, pos, ...), ``waypoints`` (run, ord, t, name, lat,
lon), ``streets`` optional drawn lines (line_id, name, points). A run is one walk. Results are tables over all runs at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import distance_m, folded, strength
from stridemap.operators import evaluate, geo, levels, matching, networks, placement, scans, sequence
from stridemap.runtime import materialize


@dataclass(frozen=True)
class Reconciliation:
    """Looks placed along their route, and what follows from them."""

    segments: DataFrame  # run, seg, stretch, forward, points (drawn, or null), length_m
    scans: DataFrame  # run, scan_id, t, seg, fraction, lat, lon, stretch, along, length_m
    placed: DataFrame  # the same per sighting
    networks: DataFrame  # in route order, with both estimates


def looks_of(sightings: DataFrame) -> DataFrame:
    """One look per cycle: all cards together, the strongest reading of each key, anonymous networks left out.

    A look of one card keeps its name, so that looks of different cards aren't compared.
    """
    named = sightings.where("key <> ''")
    keep = ["strength", "pos", "has_signal", "ssid", "bssid", "security", "frequency", "signal_dbm", "signal_percent", "connected"]
    best = scans.strongest(named, ["run", "scan_id", "key"], keep)
    return best.join(scan_times(sightings).select("run", "scan_id", "t", "interface"), ["run", "scan_id"])


def scan_times(sightings: DataFrame) -> DataFrame:
    cards = F.collect_set("interface")
    return sightings.groupBy("run", "scan_id").agg(F.min("t").alias("t"), F.when(F.size(cards) == 1, F.max("interface")).alias("interface"))


def segments_of(waypoints: DataFrame, streets: DataFrame | None = None) -> DataFrame:
    """Segments with their stretch, and the drawn block between their crossings where there is one."""
    segs = placement.segments(waypoints).withColumn("fold_start", folded("start_name")).withColumn("fold_end", folded("end_name"))
    segs = networks.route_stretches(segs)
    chord = distance_m(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))
    if streets is None:
        return segs.withColumn("points", F.lit(None).cast(f"array<{geo.POINT}>")).withColumn("length_m", chord)
    segs = segs.withColumn("pair_id", F.concat_ws("#", "run", F.col("seg").cast("string")))
    ends = segs.where("start_lat is not null and end_lat is not null").select(
        "pair_id", F.col("start_lat").alias("a_lat"), F.col("start_lon").alias("a_lon"), F.col("end_lat").alias("b_lat"), F.col("end_lon").alias("b_lon")
    )
    drawn = geo.blocks(ends, geo.chained(streets)).select("pair_id", "points", F.col("length_m").alias("drawn_m"))
    return segs.join(drawn, "pair_id", "left").withColumn("length_m", F.coalesce("drawn_m", chord)).drop("pair_id", "drawn_m")


def coordinates(placed: DataFrame) -> DataFrame:
    """``lat`` and ``lon`` of a fraction on the drawn block, else on the chord."""
    rows = placement.with_coordinates(placed).withColumn("at", F.when(F.col("points").isNotNull(), geo.point_along(F.col("points"), F.col("fraction"))))
    return rows.withColumn("lat", F.coalesce("at.lat", "lat")).withColumn("lon", F.coalesce("at.lon", "lon")).drop("at")


def reconcile(
    sightings: DataFrame, waypoints: DataFrame, streets: DataFrame | None = None, by_movement: bool = True, path_loss: float = C.PATH_LOSS
) -> Reconciliation:
    """Place every look of every run, and every network that they heard."""
    looks = materialize(looks_of(sightings), "looks")
    times = scan_times(sightings)
    keys = looks.groupBy("run", "scan_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    views = times.join(keys, ["run", "scan_id"], "left").withColumn("keys", F.coalesce("keys", F.expr("cast(array() as array<string>)")))
    segs = materialize(segments_of(waypoints, streets), "segments")
    inside = placement.in_segment(views, segs)
    fractions = placement.place_by_movement(inside) if by_movement else placement.place_by_clock(inside)
    where = coordinates(fractions).withColumn("along", networks.along())
    where = materialize(where.drop("span", "hole", "step"), "placed")
    placed = looks.drop("t", "interface").join(where.drop("keys", "interface"), ["run", "scan_id"])
    rolled = networks.in_route_order(networks.roll_up(placed))
    on_map = networks.centroids(placed, path_loss).select("run", "key", "est_lat", "est_lon", "spread_m", "plain_spread_m", "sightings", "barely_pinned", "few_sightings")
    on_route = networks.route_centroids(placed, path_loss).select("run", "key", F.col("stretch").alias("est_stretch"), F.col("at").alias("est_at"), F.col("spread").alias("est_spread"))
    found = rolled.join(on_map, ["run", "key"], "left").join(on_route, ["run", "key"], "left")
    return Reconciliation(segs, where, placed, found)


def fingerprints(result: Reconciliation) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, keys) of a reconciliation: looks in the canonical direction of their stretch, numbered in the order of time."""
    ahead = F.col("fold_start") <= F.col("fold_end")
    rows = result.scans.withColumn("fp_id", F.struct("run", "scan_id"))
    fps = rows.select(
        "fp_id", "scan_id", F.col("run").alias("grp"), F.col("run").alias("outing"), F.concat_ws("#", "run", F.col("seg").cast("string")).alias("walk"), "t", "stretch",
        F.when(ahead, F.col("fraction")).otherwise(1.0 - F.col("fraction")).alias("fraction"), "lat", "lon", "length_m",
    )
    # Numbers rise with time, as ties go to what was walked first; looks of one second are told apart by run and scan.
    nth = F.row_number().over(Window.partitionBy("t").orderBy("grp", "scan_id"))
    fps = fps.withColumn("fp_new", F.col("t") * (1 << 24) + nth).drop("scan_id")
    keys = result.placed.select(F.struct("run", "scan_id").alias("fp_id"), "key", F.when(F.col("has_signal"), F.col("strength")).alias("strength"))
    named = fps.select("fp_id", "fp_new")
    keys = keys.join(named, "fp_id").select(F.col("fp_new").alias("fp_id"), "key", "strength")
    return fps.drop("fp_id").withColumnRenamed("fp_new", "fp_id"), keys


def check(
    fps: DataFrame, keys: DataFrame, by_signal: bool = False, order: str | None = None, pace: bool = False, calibrate: bool = False, along_levels: bool = False,
    reach_s: int = C.ONE_LOOK_S,
) -> tuple[DataFrame, DataFrame]:
    """(report, jumps) of a map with each outing held out; ``order``: None, "tie" or "path"."""
    queries = fps.select(F.col("fp_id").alias("query"), "grp")
    asked = corrected_keys(fps, keys)[0] if calibrate else keys.withColumnRenamed("fp_id", "query")
    scores = matching.walk_scores(fps, keys, queries, asked, by_signal)
    ranked = materialize(matching.candidates(matching.best_looks(scores, reach_s), fps), "ranked")
    answers = settled(ranked, fps, order)
    if along_levels:
        answers = held_out_levels(answers, fps, keys, asked)
    if pace:
        timed = answers.join(fps.select(F.col("fp_id").alias("query"), F.col("grp").alias("run"), "t"), "query").withColumn("seq", F.col("query"))
        moved = sequence.paced(timed).select("query", F.col("fraction").alias("moved"))
        # Each group's lines are those of the map without it.
        answers = answers.join(moved, "query").join(queries, "query")
        answers = answers.join(held_out_lines(fps, answers.select("grp", "stretch")), ["grp", "stretch"], "left")
        answers = answers.withColumn("lat", F.when(F.col("lat").isNotNull(), F.col("lat_0") + F.col("lat_slope") * F.col("moved")))
        answers = answers.withColumn("lon", F.when(F.col("lon").isNotNull(), F.col("lon_0") + F.col("lon_slope") * F.col("moved"))).withColumn("fraction", F.col("moved"))
    rows = materialize(evaluate.measured(fps, answers), "measured")
    return evaluate.report(rows), sequence.jumps(in_a_row(rows)).agg(F.sum("steps").alias("steps"), F.sum("fast").alias("fast"))


def in_a_row(rows: DataFrame) -> DataFrame:
    """Answers of each held-out run in order; an answer on another stretch breaks a row, so it keeps its own name."""
    own = F.when(F.col("same"), F.col("stretch")).otherwise(F.concat(F.lit("?"), F.col("fp_id").cast("string")))
    return rows.select(F.col("grp").alias("run"), "t", own.alias("stretch"), F.col("f_fraction").alias("fraction"), "length_m")


def held_out_lines(fps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``matching.stretch_lines`` of the map without each group, for the ``wanted`` (grp, stretch): sums of all groups less those of the own."""
    rows = fps.where("lat is not null and fraction is not null").select("grp", "stretch", "fraction", "lat", "lon")
    # Coordinates are taken from a corner of the stretch, so that the difference of two sums keeps its digits.
    corner = rows.groupBy("stretch").agg(F.min("lat").alias("lat_min"), F.min("lon").alias("lon_min"))
    rows = rows.join(corner, "stretch").withColumn("y", F.col("lat") - F.col("lat_min")).withColumn("x", F.col("lon") - F.col("lon_min"))
    moments = {"n": "1.0D", "f": "fraction", "ff": "fraction * fraction", "y": "y", "x": "x", "fy": "fraction * y", "fx": "fraction * x"}
    own = rows.groupBy("stretch", "grp").agg(
        *(F.sum(F.expr(e)).alias(f"own_{k}") for k, e in moments.items()), F.min("fraction").alias("low"), F.max("fraction").alias("high"), F.min("lat_min").alias("lat_min"),
        F.min("lon_min").alias("lon_min"),
    )
    own = materialize(own, "moments", few=True)
    # The least and the greatest fraction of the others: those of the group with the least (greatest) one, and of the rest.
    ends = own.groupBy("stretch").agg(F.min(F.struct("low", "grp")).alias("first"), F.max(F.struct("high", "grp")).alias("last"))
    named = own.select("stretch", "grp", "low", "high").join(ends, "stretch")
    second = named.groupBy("stretch").agg(F.min(F.when(F.col("grp") != F.col("first.grp"), F.col("low"))).alias("low_2"), F.max(F.when(F.col("grp") != F.col("last.grp"), F.col("high"))).alias("high_2"))
    total = own.groupBy("stretch").agg(*(F.sum(f"own_{k}").alias(k) for k in moments), F.min("lat_min").alias("lat_min"), F.min("lon_min").alias("lon_min"))
    total = total.join(ends, "stretch").join(second, "stretch")
    met = wanted.distinct().join(total, "stretch").join(own.select("stretch", "grp", *(f"own_{k}" for k in moments)), ["stretch", "grp"], "left")
    met = met.withColumns({k: F.col(k) - F.coalesce(f"own_{k}", F.lit(0.0)) for k in moments})
    low = F.when(F.col("grp") == F.col("first.grp"), F.col("low_2")).otherwise(F.col("first.low"))
    high = F.when(F.col("grp") == F.col("last.grp"), F.col("high_2")).otherwise(F.col("last.high"))
    met = met.where(low < high).withColumn("flat", F.expr("n * ff - f * f"))
    slope = lambda v: (F.col("n") * F.col(f"f{v}") - F.col("f") * F.col(v)) / F.col("flat")
    met = met.withColumn("lat_slope", slope("y")).withColumn("lon_slope", slope("x"))
    at = lambda v, c: F.col(f"{c}_min") + (F.col(v) - F.col(f"{c}_slope") * F.col("f")) / F.col("n")
    return met.select("grp", "stretch", "lat_slope", at("y", "lat").alias("lat_0"), "lon_slope", at("x", "lon").alias("lon_0"))


def corrected_keys(fps: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query keys, offsets): the map's own looks with their levels corrected by what each held-out run teaches about its card."""
    queries = fps.select(F.col("fp_id").alias("query"), "grp")
    asked = keys.withColumnRenamed("fp_id", "query")
    found = matching.locate(fps, keys, queries, asked)
    runs = fps.select(F.col("grp").alias("run"), "grp", F.col("fp_id").alias("seq"), F.col("fp_id").alias("query"))
    pairs = sequence.calibration_pairs(found.join(runs, "query"), fps, keys, asked)
    offsets = materialize(sequence.running_offsets(pairs, runs.drop("grp")), "offsets")
    moved = asked.join(offsets.select("query", "offset"), "query", "left")
    level = F.coalesce(F.bround(F.col("strength") - F.col("offset")), F.col("strength"))
    return moved.select("query", "key", level.alias("strength")), offsets


def settled(ranked: DataFrame, fps: DataFrame, order: str | None) -> DataFrame:
    """Locations of the first candidates, or of those that the scans before them settle on."""
    if order is None:
        return matching.locations(ranked)
    runs = fps.select(F.col("grp").alias("run"), F.col("fp_id").alias("seq"), F.col("fp_id").alias("query"))
    chosen = (sequence.vote if order == "tie" else sequence.path)(ranked, runs).select("query", "stretch", F.col("alternative").alias("other"))
    first = ranked.join(chosen.select("query", "stretch"), ["query", "stretch"]).withColumn("rank", F.lit(1))
    places = matching.locations(first).drop("alternative")
    return places.join(chosen.select("query", "other"), "query").withColumn("alternative", F.when(~F.col("scattered"), F.col("other"))).drop("other")


# --- looks of a log on a map


def asked_of(sightings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, asked) of sightings: the looks (run, seq, query, t), and what each heard (query, key, signal_dbm, signal_percent, strength), of a key the strongest."""
    rows = sightings.withColumn("query", F.concat_ws("|", "run", "scan_id"))
    runs = rows.groupBy("run", "query").agg(F.min("pos").alias("seq"), F.min("t").alias("t"))
    best = scans.strongest(rows.where("key <> ''"), ["query", "key"], ["signal_dbm", "signal_percent", "strength", "has_signal"])
    return runs, best.withColumn("strength", F.when(F.col("has_signal"), F.col("strength"))).drop("has_signal")


def lessons(runs: DataFrame, asked: DataFrame, fps: DataFrame, keys: DataFrame, reach_s: int = C.ONE_LOOK_S) -> DataFrame:
    """What each look teaches about its card (run, seq, query, key, off), where a match without levels is sure of the place."""
    queries = runs.select("query", F.lit("").alias("grp"))
    found = matching.locate(fps, keys, queries, asked.select("query", "key", "strength"), reach_s=reach_s)
    return sequence.calibration_pairs(found.join(runs.select("run", "seq", "query"), "query").withColumn("grp", F.lit("")), fps, keys, asked.where("strength is not null"))


def corrected(asked: DataFrame, offsets: DataFrame) -> DataFrame:
    """``asked`` at the levels that the map's card would have read (query, key, strength); ``offsets``: query, offset (null: not known)."""
    rows = asked.join(offsets.select("query", "offset"), "query", "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))
    dbm = F.bround(F.col("signal_dbm") - F.col("offset"))
    percent = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(F.col("signal_percent") - F.col("offset") / 0.6)))
    return rows.select("query", "key", F.when(F.col("strength").isNotNull(), strength(dbm, F.when(F.col("signal_percent").isNotNull(), percent))).alias("strength"))


def ranked_places(runs: DataFrame, asked: DataFrame, fps: DataFrame, keys: DataFrame, by_signal: bool = False, reach_s: int = C.ONE_LOOK_S) -> DataFrame:
    """The candidates of each look, with whether they are ``scattered`` and the line of their stretch (lat_0, lat_slope, lon_0, lon_slope)."""
    queries = runs.select("query", F.lit("").alias("grp"))
    scores = matching.walk_scores(fps, keys, queries, asked.select("query", "key", "strength"), by_signal)
    ranked = matching.candidates(matching.best_looks(scores, reach_s), fps)
    # Scatter is told of one candidate by itself, so each stands as a query with one.
    alone = ranked.withColumn("one", F.struct("query", "rank")).drop("query").withColumnRenamed("one", "query").withColumn("rank", F.lit(1))
    scattered = matching.locations(alone).select(F.col("query.query").alias("query"), F.col("query.rank").alias("rank"), "scattered")
    return ranked.join(scattered, ["query", "rank"]).join(matching.stretch_lines(fps), "stretch", "left")


def located(
    sightings: DataFrame, fps: DataFrame, keys: DataFrame, order: str = "tie", by_signal: bool = False, pace: bool = False, reach_s: int = C.ONE_LOOK_S
) -> DataFrame:
    """Where each look of logs was taken (run, seq, query, t, stretch, fraction, lat, lon, score, settled, alternative), in the light of the looks before it.

    ``order``: ties go by vote ("tie") or by the likeliest path ("path"). With ``by_signal`` levels count, corrected by what the run taught about its card up
    to that look. With ``pace`` a place is kept to a walking pace on its stretch's line. Looks that match nothing have no row.
    """
    runs, asked = (materialize(x, n) for x, n in zip(asked_of(sightings), ("runs", "asked"), strict=True))
    if by_signal:
        offsets = sequence.running_offsets(lessons(runs, asked, fps, keys, reach_s), runs)
        asked = materialize(corrected(asked, offsets), "corrected")
    ranked = materialize(ranked_places(runs, asked, fps, keys, by_signal, reach_s), "ranked")
    chosen = (sequence.vote if order == "tie" else sequence.path)(ranked, runs.select("run", "seq", "query")).select("query", "stretch", "settled", "alternative")
    rows = ranked.join(chosen, ["query", "stretch"]).join(runs, "query")
    if pace:
        moved = sequence.paced(rows).select("query", F.col("fraction").alias("moved"))
        rows = rows.join(moved, "query").withColumn("fraction", F.col("moved"))
    on = lambda c: F.coalesce(F.col(f"{c}_0") + F.col(f"{c}_slope") * F.col("moved"), F.col(c)) if pace else F.col(c)
    where = {c: F.when(~F.col("scattered") & F.col(c).isNotNull(), on(c)) for c in ("lat", "lon")}
    rows = rows.withColumns({**where, "alternative": F.when(~F.col("scattered"), F.col("alternative"))})
    return rows.select("run", "seq", "query", "t", "stretch", "fraction", "lat", "lon", F.col("best").alias("score"), F.col("settled").cast("int").alias("settled"), "alternative")


def held_out_levels(answers: DataFrame, fps: DataFrame, keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers placed on the level curves of the map without their own group."""
    own = answers.join(fps.select(F.col("fp_id").alias("query"), "grp"), "query")
    wanted = materialize(own.select("grp", "stretch").distinct(), "wanted", few=True)
    heard = keys.where("strength is not null")
    curve = materialize(levels.held_out_curves(fps, heard, wanted), "curves")
    named = own.withColumn("stretch", F.concat_ws("\0", "grp", "stretch"))
    moved = levels.place(named, curve.withColumn("stretch", F.concat_ws("\0", "grp", "stretch")), asked.where("strength is not null")).withColumnRenamed("fraction", "moved")
    rows = answers.join(moved, "query", "left").join(own.select("query", "grp"), "query").join(held_out_lines(fps, wanted), ["grp", "stretch"], "left")
    on = lambda c: F.when(F.col("moved").isNotNull() & F.col(c).isNotNull(), F.col(f"{c}_0") + F.col(f"{c}_slope") * F.col("moved")).otherwise(F.col(c))
    return rows.withColumn("lat", on("lat")).withColumn("lon", on("lon")).withColumn("fraction", F.coalesce("moved", "fraction")).select(answers.columns)


def place_on_levels(answers: DataFrame, fps: DataFrame, keys: DataFrame, query_keys: DataFrame) -> DataFrame:
    """Answers moved to where the levels fit best; those without curves stay."""
    moved = levels.place(answers, levels.curves(fps, keys), query_keys).withColumnRenamed("fraction", "fitted")
    return answers.join(moved, "query", "left").withColumn("fraction", F.coalesce("fitted", "fraction")).drop("fitted")
