"""Operators on the log: walks, looks, catalogues and capture semantics, as batch queries.

Tables are exploded: ``records`` (run, pos, t, event, ...) and ``sightings`` (run, scan_id, pos, t, key, strength, ...), where
``run`` is a log file or device, ``pos`` the order in it and ``t`` seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.runtime import materialize


def carry_walk(records: DataFrame, token: str = "token", run: str = "run", pos: str = "pos") -> DataFrame:
    """``walk``: the last token given so far in a run, the empty string before the first."""
    so_far = Window.partitionBy(run).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("walk", F.coalesce(F.last(token, ignorenulls=True).over(so_far), F.lit("")))


def walks(records: DataFrame, run: str = "run", pos: str = "pos") -> DataFrame:
    """Walks of each run in the order in which they first appear."""
    found = records.groupBy(run, "walk").agg(F.min(pos).alias("first_pos"), F.count("*").alias("records"))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy(run).orderBy("first_pos")))


def last_walk(records: DataFrame, run: str = "run", pos: str = "pos") -> DataFrame:
    """Records of the walk that each run ends with."""
    last = records.groupBy(run).agg(F.max_by("walk", pos).alias("walk"))
    return records.join(last, [run, "walk"], "left_semi")


def strongest(sightings: DataFrame, by: list[str], keep: list[str], strength: str = "strength", pos: str = "pos") -> DataFrame:
    """Of each group the strongest row, the earlier one of two alike; ``keep`` are the columns taken from it."""
    best = F.max_by(F.struct(*keep), F.struct(F.col(strength), -F.col(pos)))
    return sightings.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def merged_looks(sightings: DataFrame, keep: list[str]) -> DataFrame:
    """One look per cycle: the strongest reading of each key, all cards together. Needs run, cycle, t, key, strength, pos."""
    one = strongest(sightings, ["run", "cycle", "key"], keep)
    when = sightings.groupBy("run", "cycle").agg(F.min("t").alias("t"))
    return one.join(when, ["run", "cycle"])


def anonymous_kept(sightings: DataFrame, keep: list[str]) -> DataFrame:
    """``merged_looks`` and, untouched, the networks without an identity."""
    named = merged_looks(sightings.where("key <> ''"), keep)
    when = sightings.groupBy("run", "cycle").agg(F.min("t").alias("t"))
    rest = sightings.where("key = ''").select("run", "cycle", "key", *keep).join(when, ["run", "cycle"])
    return named.unionByName(rest)


def last_looks(scans: DataFrame, n: int = 4) -> DataFrame:
    """The last ``n`` cycles of each run."""
    recent = Window.partitionBy("run").orderBy(F.col("t").desc(), F.col("cycle").desc())
    return scans.select("run", "cycle", "t").distinct().withColumn("back", F.row_number().over(recent)).where(F.col("back") <= n)


def open_networks(sightings: DataFrame) -> DataFrame:
    """Open networks by their strongest sighting, strongest first."""
    found = strongest(sightings.where("security = 'open'"), ["key"], ["ssid", "strength", "t"])
    return found.orderBy(F.col("strength").desc(), "key")


def outing_summaries(records: DataFrame) -> DataFrame:
    """One row per walk: first and last moment, scans, marks; the newest first."""
    return records.groupBy("run", "walk").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.countDistinct(F.when(F.col("event") == "scan", F.col("cycle"))).alias("scans"),
        F.count(F.when(F.col("event") == "mark", 1)).alias("marks"), F.max("cycle").alias("last_cycle"),
    ).orderBy(F.col("first_t").desc())


# --- capture semantics over stored records


def first_seen(sightings: DataFrame) -> DataFrame:
    """The first sighting of each key of a run."""
    first = F.min_by(F.struct("t", "scan_id"), F.struct("t", "pos"))
    return sightings.groupBy("run", "key").agg(first.alias("f")).select("run", "key", "f.*")


def associations(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """What changed in each card's association: connected, roam, disconnected; unchanged rows are left out.

    Needs run, interface, pos, ssid, bssid (both null while not associated).
    """
    w = Window.partitionBy("run", "interface").orderBy(*(order or ["pos"]))
    old_s, old_b = F.lag("ssid").over(w), F.lag("bssid").over(w)
    on, was = F.col("ssid").isNotNull(), old_s.isNotNull()
    change = (
        F.when(on & ~was, "connected").when(~on & was, "disconnected")
        .when(on & was & ~(F.col("ssid").eqNullSafe(old_s) & F.col("bssid").eqNullSafe(old_b)), "roam")
    )
    return records.withColumn("change", change).where("change is not null")


def failure_runs(records: DataFrame, reminder: int = C.FAILURE_REMINDER) -> DataFrame:
    """Failed scans with their number in a row (``streak``), and whether one is reported: the first and then every so many."""
    w = Window.partitionBy("run").orderBy("pos")
    island = F.sum(F.when(F.col("event") != "scan_failed", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = records.withColumn("island", island).where("event = 'scan_failed'")
    rows = rows.withColumn("streak", F.row_number().over(Window.partitionBy("run", "island").orderBy("pos")))
    return rows.withColumn("reported", (F.col("streak") == 1) | (F.col("streak") % reminder == 0)).drop("island")


def recoveries(records: DataFrame) -> DataFrame:
    """Scans that follow a failed one."""
    w = Window.partitionBy("run").orderBy("pos")
    return records.withColumn("before", F.lag("event").over(w)).where("event = 'scan' and before = 'scan_failed'").drop("before")


def clock_drift(ticks: DataFrame, least: float = C.SUSPEND_S) -> DataFrame:
    """Suspensions: ticks between which the boot clock gained on the running clock. Needs run, pos, boot_s, mono_s."""
    w = Window.partitionBy("run").orderBy("pos")
    slept = (F.col("boot_s") - F.lag("boot_s").over(w)) - (F.col("mono_s") - F.lag("mono_s").over(w))
    return ticks.withColumn("seconds", slept).where(F.col("seconds") >= least)


def accepted_presses(presses: DataFrame, gap_s: float) -> DataFrame:
    """Presses that count: at least ``gap_s`` after the last one that counted (not merely the last one), per run.

    A press more than the gap after its predecessor always counts, so runs are cut there. Within a cut each press points to the first one that is late enough
    to count after it, and what the cut's first press reaches along these pointers counts. The pointers are doubled, so a chain of n presses takes log2(n)
    rounds of joins, and no list of a cut is made. A press without a time counts. Needs run, pos (once a run), t. The same rule throttles announcements.
    """
    if gap_s <= 0:
        return presses.select("run", F.col("pos").cast("long").alias("pos"))
    w = Window.partitionBy("run").orderBy("t", "pos")
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) >= gap_s).cast("int"), F.lit(1))
    rows = presses.select("run", F.col("pos").cast("long").alias("pos"), F.col("t").cast("double").alias("t"))
    rows = rows.withColumn("cut", cut).withColumn("part", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The end of a press's gap stands among the presses: before those of its own time if they are late enough (t + gap is rounded), else after them.
    until = F.col("t") + gap_s
    side = F.when(until - F.col("t") >= gap_s, 0).otherwise(2)
    ends = rows.select("run", "part", "pos", "cut", until.alias("t"), side.alias("side"), F.lit(None).cast("long").alias("press"))
    both = ends.union(rows.select("run", "part", "pos", "cut", "t", F.lit(1), "pos"))
    back = Window.partitionBy("run", "part").orderBy(F.desc("t"), F.desc("side"), F.desc("pos"))
    both = both.withColumn("next", F.last("press", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    # As structs, so that a run without a name is joined with itself.
    at, then = F.struct("run", "pos"), F.when(F.col("next").isNotNull(), F.struct("run", F.col("next").alias("pos")))
    jumps = materialize(both.where("press is null").select("cut", at.alias("at"), then.alias("next")), "jumps")
    counted, jumps = jumps.where("cut = 1").select("at"), jumps.where("next is not null").select("at", "next")
    while not jumps.isEmpty():
        counted = materialize(counted.union(counted.join(jumps, "at").select("next")), "counted", few=True)
        further = jumps.select(F.col("at").alias("next"), F.col("next").alias("after"))
        jumps = materialize(jumps.join(further, "next").select("at", F.col("after").alias("next")), "jumps", few=True)
    return counted.select("at.*")


def battery_warnings(readings: DataFrame, thresholds: tuple[int, ...] = C.BATTERY_WARNINGS) -> DataFrame:
    """The first reading at or under each threshold while not charging; one threshold a reading, the lowest. Needs run, pos, percent, charging."""
    under = F.filter(F.array(*(F.lit(x) for x in sorted(thresholds))), lambda x: F.col("percent") <= x)
    rows = readings.where(~F.col("charging")).withColumn("threshold", F.get(under, F.lit(0))).where("threshold is not null")
    so_far = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.min("threshold").over(so_far)).where("before is null or threshold < before").drop("before")


def sessions(records: DataFrame, gap_s: int = C.SESSION_GAP_S) -> DataFrame:
    """``session``: numbered per run, a new one after a silence of ``gap_s``."""
    w = Window.partitionBy("run").orderBy("t", "pos")
    starts = F.coalesce((F.col("t") - F.lag("t").over(w) >= gap_s).cast("int"), F.lit(1))
    return records.withColumn("starts", starts).withColumn(
        "session", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("starts")


def changes(rows: DataFrame, of: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before in their group (the first one counts)."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lit(True)
    for c in of:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("same", same & (F.row_number().over(w) > 1)).where(~F.col("same")).drop("same")


def announcements(new: DataFrame, quiet: int = 3) -> DataFrame:
    """What is said of each cycle's new networks: all names while they are few, else only open ones; each name once a run.

    Needs run, cycle, pos, ssid, security.
    """
    per = Window.partitionBy("run", "cycle")
    rows = new.withColumn("many", F.count("*").over(per) > quiet).where("ssid <> ''").where("not many or security = 'open'")
    first = F.row_number().over(Window.partitionBy("run", "ssid").orderBy("cycle", "pos"))
    return rows.withColumn("nth", first).where("nth = 1").drop("nth", "many")
