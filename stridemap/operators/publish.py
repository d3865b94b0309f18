"""Publishing a walk: keyed pseudonyms, field-by-field projections, a moved clock and origin, and a scan for what leaked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.functions.exprs import distance_m, folded, halves, hmac_sha256, mac_shaped, pseudonym
from stridemap.runtime import BROADCAST_BYTES, materialize

# What may go out as it is.
PUBLIC_EVENTS = ("scan", "new", "scan_failed", "suspended", "mark", "button_lost")
PLAIN_REASONS = ("radio soft blocked (rfkill)", "radio hard blocked (rfkill)", "SYN_DROPPED")
PLAIN_SECURITY = ("open", "wep", "psk", "8021x", "secured")
WITHHELD = "withheld by --export-public"
EPOCH_S = 0


def address(key: bytes, bssid: Column, shaped: bool = False) -> Column:
    """An address's pseudonym; addresses are compared in lower case."""
    low = F.lower(bssid)
    if not shaped:
        return F.when(F.length(bssid) > 0, pseudonym(key, "bssid", low))
    return F.when(F.length(bssid) > 0, mac_shaped(F.substring(hmac_sha256(key, F.concat(F.lit("bssid\0"), low)), 1, 12)))


def crossing(key: bytes, name: Column) -> Column:
    """A crossing's pseudonym, street by street if it is a corner; a comma stays one. Spellings that fold alike are one street."""
    two = halves(name)
    street = lambda s: pseudonym(key, "street", folded(s))
    corner = F.concat(street(F.get(two, F.lit(0))), F.when(F.instr(name, ",") > 0, ", ").otherwise(" y "), street(F.get(two, F.lit(1))))
    return F.when(two.isNotNull(), corner).otherwise(pseudonym(key, "place", folded(name)))


def public_networks(networks: DataFrame, key: bytes, ssid: str = "remove", shaped: bool = False) -> DataFrame:
    """One row per network as it goes out: every field is named here, none is passed on. ``ssid``: remove, pseudonym or keep.

    A network without an address keeps a pseudonym of its name, since it has no other identity.
    """
    name = F.coalesce("ssid", F.lit(""))
    hidden = F.when(name != "", pseudonym(key, "ssid", name)).otherwise(name)
    no_address = F.coalesce(F.length("bssid"), F.lit(0)) == 0
    shown = {"keep": name, "pseudonym": hidden, "remove": F.when(no_address, hidden).otherwise(F.lit(""))}[ssid]
    security = F.when(F.col("security").isNull() | F.col("security").isin(*PLAIN_SECURITY), F.col("security")).otherwise(F.lit(WITHHELD))
    return networks.select(
        "row", shown.alias("ssid"), address(key, F.col("bssid"), shaped).alias("bssid"), security.alias("security"), "frequency", "signal_dbm", "signal_percent",
        F.lit(False).alias("connected"),
    )


def public_records(records: DataFrame, key: bytes, began_s: Column, keep_time: bool = False) -> DataFrame:
    """Records as they go out; those of unknown kinds, of associations and without a time are left out."""
    when = F.col("t") if keep_time else F.col("t") - began_s + EPOCH_S
    some = lambda c, kind: F.when(F.length(c) > 0, pseudonym(key, kind, F.col(c)))
    reason = F.when(F.col("reason").isNull() | F.col("reason").isin(*PLAIN_REASONS), F.col("reason")).otherwise(F.lit(WITHHELD))
    return records.where(F.col("event").isin(*PUBLIC_EVENTS) & F.col("t").isNotNull()).select(
        "row", when.alias("t"), "event", some("outing", "outing").alias("outing"), some("interface", "radio").alias("interface"), "cycle", reason.alias("reason"),
        "seconds", "number", "key",
    )


def export_counts(records: DataFrame, public: DataFrame, networks: DataFrame) -> DataFrame:
    """Scans and distinct networks that go out, and records that were withheld (associations are left out, not withheld)."""
    there = records.agg(F.count(F.when(~F.col("event").isin("connected", "disconnected"), 1)).alias("all_records"))
    went = public.agg(F.count("*").alias("went"), F.count(F.when(F.col("event") == "scan", 1)).alias("scans"))
    heard = networks.agg(F.countDistinct(F.coalesce(F.nullif("bssid", F.lit("")), F.nullif("ssid", F.lit("")))).alias("networks"))
    return there.crossJoin(went).crossJoin(heard).select("scans", "networks", (F.col("all_records") - F.col("went")).alias("withheld"))


def moved_place(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """A place as far from (0, 0) as it is from the walk's first place."""
    north = distance_m(lat0, lon0, lat, lon0) * F.when(lat >= lat0, 1.0).otherwise(-1.0)
    east = distance_m(lat0, lon0, lat0, lon) * F.when(lon >= lon0, 1.0).otherwise(-1.0)
    return F.bround(F.degrees(north / C.EARTH_RADIUS_M), 6), F.bround(F.degrees(east / C.EARTH_RADIUS_M), 6)


def survivors(values: DataFrame, lines: DataFrame, least: int = 3) -> DataFrame:
    """(value, occurrences) of source identifiers that can still be read in what goes out, whatever their case.

    Values meet lines by their first ``least`` characters (shorter ones by their whole length): a line's distinct runs of so many characters are held
    against the values' heads before anything moves, then only (line, value) pairs do, and the text of a line joins those alone.
    """
    v = values.select(F.lower("value").alias("value")).where("value <> ''").distinct()
    v = materialize(v.withColumn("head", F.substring("value", 1, least)), "values", few=True)
    sizes = sorted(r[0] for r in v.select(F.length("head")).distinct().collect())  # ``least`` values at most
    if not sizes:
        return v.select("value", F.lit(0).cast("long").alias("occurrences"))
    low = materialize(lines.select(F.monotonically_increasing_id().alias("line"), F.lower("text").alias("text")).where("text <> ''"), "lines")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - (k - 1), F.lit(1))), lambda at: F.substring(F.col("text"), at, F.lit(k)))
    heads = low.select("line", F.explode(F.array_distinct(F.flatten(F.array(*(runs(k) for k in sizes))))).alias("head"))
    total = v.agg(F.sum(F.octet_length("value") + F.octet_length("head") + 32)).first()[0]
    met = heads.join(F.broadcast(v) if total <= BROADCAST_BYTES else v, "head").select("line", "value")
    count = (F.length("text") - F.length(F.replace(F.col("text"), F.col("value"), F.lit("")))) / F.length("value")
    return met.join(low, "line").withColumn("n", count).where("n > 0").groupBy("value").agg(F.sum("n").cast("long").alias("occurrences"))


def notebook_lines(waypoints: DataFrame) -> DataFrame:
    """Lines of an exported notebook: a date directive whenever the day changes. Needs run, ord, t, name, lat, lon."""
    w = Window.partitionBy("run").orderBy("ord")
    moment = F.timestamp_seconds("t")
    day = F.date_format(moment, "yyyy-MM-dd")
    rows = waypoints.withColumn("day", day).withColumn("new_day", ~F.col("day").eqNullSafe(F.lag("day").over(w)))
    place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.format_string(" @ %.6f, %.6f", "lat", "lon")).otherwise(F.lit(""))
    line = F.concat(F.date_format(moment, "HH:mm:ss"), F.lit(" "), F.col("name"), place)
    both = F.when(F.col("new_day"), F.array(F.concat(F.lit("date "), F.col("day")), line)).otherwise(F.array(line))
    return rows.select("run", "ord", F.posexplode(both).alias("part", "line"))

