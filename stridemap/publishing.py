"""Whole jobs around a walk: working out the corners of a notebook, publishing a walk, and what to do next."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import folded, halves
from stridemap.operators import geo, publish
from stridemap.runtime import delete_path, renamed
from stridemap.sources import sinks


def geocode(crossings: DataFrame, ways: DataFrame, nodes: DataFrame, speed: float = C.MAX_WALK_MS) -> DataFrame:
    """(run, ord, name, outcome, lat, lon): where each crossing of a notebook is, from a saved street graph.

    ``crossings``: run, ord, t (null: untimed), name, lat, lon. Outcomes: ``given`` (it had coordinates), ``one`` and ``near`` (found), ``several``,
    ``apart``, ``missing`` (not found), ``no corner`` (its name isn't two streets) and ``too fast`` (found, but no walk covers the way to the next or
    from the last crossing in the time).
    """
    two = halves(F.col("name"))
    rows = crossings.withColumn("first", F.get(two, F.lit(0))).withColumn("second", F.get(two, F.lit(1)))
    rows = rows.withColumn("first", folded("first")).withColumn("second", folded("second"))
    rows = rows.withColumn("corner_id", F.when(F.col("first").isNotNull(), F.concat_ws("|", F.least("first", "second"), F.greatest("first", "second"))))
    corners = rows.where("corner_id is not null").select("corner_id", F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")).distinct()
    wanted = corners.select(F.col("first").alias("street")).union(corners.select("second")).distinct()
    found = geo.junctions(corners, geo.ways_by_street(ways, wanted).select("street", "nodes"), nodes)
    found = found.select("corner_id", "outcome", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    given = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = rows.join(found, "corner_id", "left")
    outcome = F.when(given, "given").when(F.col("corner_id").isNull(), "no corner").otherwise(F.col("outcome"))
    rows = rows.withColumn("outcome", outcome).withColumn("lat", F.when(given, F.col("lat")).otherwise(F.col("f_lat")))
    rows = rows.withColumn("lon", F.when(given, F.col("lon")).otherwise(F.col("f_lon"))).select("run", "ord", "t", "name", "outcome", "lat", "lon")
    bad = geo.implausible(rows.where("t is not null"), speed)
    ends = bad.select("run", "ord").union(bad.select("run", "next_ord")).distinct().withColumn("fast", F.lit(True))
    out = rows.join(ends, ["run", "ord"], "left").withColumn("fast", F.coalesce("fast", F.lit(False)) & F.col("outcome").isin("one", "near"))
    return out.select(
        "run", "ord", "name", F.when(F.col("fast"), "too fast").otherwise(F.col("outcome")).alias("outcome"), *(F.when(~F.col("fast"), F.col(c)).alias(c) for c in ("lat", "lon"))
    )


@dataclass(frozen=True)
class Exported:
    """A published walk: its records and notebook as lines, what was counted, and source identifiers that can still be read in it."""

    records: DataFrame
    notebook: DataFrame
    counts: DataFrame
    survivors: DataFrame


def export(records: DataFrame, waypoints: DataFrame, key: bytes, ssid: str = "remove", shaped: bool = False, keep_places: bool = False, keep_time: bool = False) -> Exported:
    """Publish walks: ``records`` in the log schema with ``run``, ``waypoints`` (run, ord, t, name, lat, lon). The first moment and place of each run become zero.

    A run must be one walk: with records of several, nothing is published.
    """
    several = records.groupBy("run").agg(F.countDistinct("walk").alias("walks")).where("walks > 1")
    if not several.isEmpty():
        raise ValueError("a log of several walks can't be published at once: choose one")
    rows = records.withColumn("row", F.monotonically_increasing_id()).withColumn("t", F.unix_seconds("time"))
    began = rows.groupBy("run").agg(F.min("t").alias("a")).join(waypoints.groupBy("run").agg(F.min("t").alias("b")), "run", "full").select("run", F.least("a", "b").alias("began"))
    rows = rows.join(began, "run")
    public = publish.public_records(rows, key, F.col("began"), keep_time)
    inner = rows.where(F.col("event").isin("scan", "new")).select("row", F.posexplode("networks").alias("k", "n")).select("row", "k", "n.*")
    out = publish.public_networks(inner.withColumn("row", F.struct("row", "k")), key, ssid, shaped)
    lists = out.groupBy(F.col("row.row").alias("row")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("row.k").alias("k"), F.struct(*(c for c in out.columns if c != "row")).alias("n")))), lambda x: x["n"]).alias("networks")
    )
    empty = F.expr(f"cast(array() as array<{C.NETWORK}>)")
    lines = public.join(lists, "row", "left").withColumn("networks", F.coalesce(F.col("networks").cast(f"array<{C.NETWORK}>"), empty))
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    lines = lines.withColumns(none("ssid", "bssid", "frequency", "signal_dbm", "signal_percent")).withColumn("time", F.timestamp_seconds("t")).withColumn("utc_offset_s", F.lit(0))
    lines = lines.withColumn("file", F.lit("")).withColumnRenamed("row", "pos")
    encoded = sinks.encoded_records(lines).orderBy("pos")
    places = waypoints.join(began, "run")
    first = waypoints.where("lat is not null").groupBy("run").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("origin"))
    places = places.join(first, "run", "left")
    lat, lon = publish.moved_place(F.col("lat"), F.col("lon"), F.col("origin.lat"), F.col("origin.lon"))
    moved = places.select(
        "run", "ord", (F.col("t") if keep_time else F.col("t") - F.col("began")).alias("t"), (F.col("name") if keep_places else publish.crossing(key, F.col("name"))).alias("name"),
        (F.col("lat") if keep_places else lat).alias("lat"), (F.col("lon") if keep_places else lon).alias("lon"),
    )
    notes = publish.notebook_lines(moved)
    secret = inner.select(F.explode(F.array("ssid", "bssid")).alias("value")) if ssid != "keep" else inner.select(F.col("bssid").alias("value"))
    secret = secret.union(rows.select(F.explode(F.array("interface", "outing")).alias("value"))).where("length(value) > 2")
    if not keep_places:
        secret = secret.union(waypoints.select("name"))
    written = encoded.select(F.col("value").alias("text")).union(notes.select("line"))
    return Exported(encoded, notes, publish.export_counts(rows, public, out), publish.survivors(secret, written))


def one_walk(records: DataFrame, walk: str | None = None) -> DataFrame:
    """The records of one walk of a log, to be published: the named one, or the only one there is. ``records`` have ``run`` and ``walk``.

    Which of several walks goes out is not guessed, so a log of several needs a name. Refused are also a walk that the log lacks, and one whose looks have no time.
    """
    if walk is None:
        names = [r["walk"] for r in records.select("walk").distinct().orderBy("walk").limit(20).collect()]
        if len(names) > 1:
            raise ValueError("an export is one walk, and the log holds several: " + ", ".join(n or "(unnamed)" for n in names))
        walk = names[0] if names else ""
    own = records.where(F.col("walk") == walk)
    if own.isEmpty():
        raise ValueError(f"no walk called {walk!r} in the log")
    if own.where("event = 'scan' and time is not null").isEmpty():
        raise ValueError("the walk has no look with a time")
    return own


def write_export(done: Exported, path: str) -> None:
    """Write a published walk as a new folder with ``log`` and ``notebook``; FileExistsError if anything is there.

    Both are staged in a hidden folder beside it that becomes the export by one rename, which is refused if the name is taken. So there is a whole export or none,
    whatever fails, and of two callers with one name the second gets the error.
    """
    spark = done.records.sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    staging = f"{folder}/.{name}.{uuid.uuid4().hex[:12]}.new" if folder or path.startswith("/") else f".{name}.{uuid.uuid4().hex[:12]}.new"
    try:
        done.records.select("value").write.text(f"{staging}/log")
        done.notebook.orderBy("run", "ord", "part").select("line").write.text(f"{staging}/notebook")
        if not renamed(spark, staging, path.rstrip("/")):
            raise FileExistsError(f"{path} is there already: delete it, or name another")
    finally:
        delete_path(spark, staging)


def suggestion(outings: DataFrame, notebooks: int, mapped: list[str] | None) -> str | None:
    """What to do next. ``outings``: walk, first_t, scans, marks (a few rows); ``mapped``: outings on the map, None if it can't be read."""
    usable = outings.where("scans > 0").orderBy(F.col("first_t").desc()).select("walk", "marks").collect()
    if not usable:
        return "walk"
    if usable[0]["marks"] and not notebooks:
        return f"transcribe {usable[0]['walk']}"
    if mapped is None:
        return None
    waiting = [o["walk"] for o in usable if o["walk"] not in mapped]
    if waiting and notebooks:
        return f"add {waiting[0]}"
    return None if not mapped else "walk again" if len(mapped) == 1 else "check"
