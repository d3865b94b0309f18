"""Writers: log records, networks as CSV, GeoJSON, reports and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridemap.functions.exprs import frame_xy, xml_escaped

_NETWORK_FIELDS = ("ssid", "bssid", "security", "frequency", "signal_dbm", "signal_percent", "connected")
_FIELDS = ("outing", "interface", "cycle", "ssid", "bssid", "frequency", "signal_dbm", "signal_percent", "reason", "seconds", "number", "key")


def encoded_records(records: DataFrame) -> DataFrame:
    """Records as JSON lines: missing fields stay out, but a network always has all of its fields, and a look its list."""
    local = F.timestamp_seconds(F.unix_seconds("time") + F.col("utc_offset_s"))
    sign = F.when(F.col("utc_offset_s") < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs("utc_offset_s") / 3600), F.floor(F.abs("utc_offset_s") % 3600 / 60))
    head = F.to_json(F.struct(F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("time"), "event", *_FIELDS))
    one = lambda n: F.to_json(F.struct(*(n[f].alias(f) for f in _NETWORK_FIELDS)), {"ignoreNullFields": "false"})
    tail = F.concat(F.lit(',"networks":['), F.array_join(F.transform("networks", one), ","), F.lit("]}"))
    line = F.when(F.col("event").isin("scan", "new"), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), tail)).otherwise(head)
    return records.select("file", "pos", line.alias("value"))


def write_log(records: DataFrame, path: str) -> None:
    """Append records to a log folder."""
    encoded_records(records).select("value").write.mode("append").text(path)


#: The columns of the networks' table.
CSV_COLUMNS = (
    "ssid", "bssid", "security", "frequency_mhz", "channel", "best_signal_dbm", "best_signal_percent", "best_seen", "seen", "connected", "first_seen", "last_seen",
    "from", "to", "fraction", "lat", "lon", "estimated_lat", "estimated_lon", "spread_m", "estimated_from", "estimated_to", "estimated_fraction", "estimated_spread",
    "barely_pinned",
)


def write_csv(networks: DataFrame, path: str) -> None:
    """Networks with the columns that there are of CSV_COLUMNS, in that order; the others are empty."""
    have = set(networks.columns)
    rows = networks.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in have else F.lit("").alias(c) for c in CSV_COLUMNS))
    rows.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def _feature(geometry: Column, kind: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.lit(kind).alias("kind"), *fields).alias("properties")), {"ignoreNullFields": "false"})


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.bround(lon, 6), F.bround(lat, 6)).alias("coordinates"))


def network_features(networks: DataFrame, fields: list[str]) -> DataFrame:
    """A GeoJSON point per network with coordinates: its estimate, else the place of its best sighting."""
    lat, lon = F.coalesce("est_lat", "lat"), F.coalesce("est_lon", "lon")
    by = F.when(F.col("est_lat").isNotNull(), "estimate").otherwise("strongest sighting").alias("placed_by")
    return networks.where(lat.isNotNull()).select(_feature(_point(lat, lon), "network", *(F.col(f) for f in fields), by).alias("value"))


def crossing_features(waypoints: DataFrame) -> DataFrame:
    rows = waypoints.where("lat is not null and lon is not null")
    return rows.select("run", "ord", _feature(_point(F.col("lat"), F.col("lon")), "crossing", F.col("name")).alias("value"))


def route_features(waypoints: DataFrame) -> DataFrame:
    """A line per run through its crossings with coordinates, if there are two."""
    rows = waypoints.where("lat is not null and lon is not null")
    runs = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("ord", "lat", "lon", "name"))).alias("p")).where("size(p) > 1")
    line = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
    return runs.select("run", _feature(line, "route", F.col("p")[0]["name"].alias("from"), F.element_at("p", -1)["name"].alias("to")).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Features (``value``) as newline-delimited GeoJSON; a part file per task, never one task for all."""
    features.select("value").write.mode("errorifexists").text(path)


def collection(features: list[str]) -> str:
    """A FeatureCollection of one walk's features, which a caller has collected."""
    return '{"type": "FeatureCollection", "features": [' + ",\n".join(features) + "]}"


def svg_paths(lines: DataFrame, west: float, south: float, mid_lat: float, metres_per_px: float, height_px: float) -> DataFrame:
    """Drawn lines as SVG path elements on a flat frame, names escaped."""

    def at(p: Column) -> Column:
        x, y = frame_xy(p["lat"] - south, p["lon"] - west, F.lit(mid_lat))
        return F.format_string("%.1f %.1f", x / metres_per_px, F.lit(height_px) - y / metres_per_px)

    d = F.concat(F.lit("M"), F.array_join(F.transform("points", at), " L"))
    title = F.when(F.col("name").isNotNull(), F.concat(F.lit("<title>"), xml_escaped(F.col("name")), F.lit("</title>"))).otherwise(F.lit(""))
    return lines.select("line_id", F.concat(F.lit('<path d="'), d, F.lit('" fill="none">'), title, F.lit("</path>")).alias("value"))


def scale_bar_m(width_m: float) -> float:
    """A round length (1, 2 or 5 times a power of ten) of at most a quarter of the width."""
    import math

    if width_m <= 0:
        return 0.0
    power = 10.0 ** math.floor(math.log10(width_m / 4))
    return next(k * power for k in (5, 2, 1) if k * power <= width_m / 4 * (1 + 1e-9))


def report(rows: list[dict], columns: list[str], title: str) -> str:
    """A small table as text, columns as wide as they must be."""
    cells = [columns, *([("" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c])) for c in columns] for r in rows)]
    widths = [max(len(row[k]) for row in cells) for k in range(len(columns))]
    return "\n".join([title, *("  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in cells)]) + "\n"


def percent(share: float) -> str:
    """A share as a whole percentage, rounded to half even."""
    return f"{share:.0%}"


def describe_location(stretch: str, fraction: float, score: float, matches: int, alternative: str | None) -> str:
    """An answer in one line."""
    sure = f" (or {alternative.replace('|', ' - ')})" if alternative else ""
    return f"{percent(fraction)} of the way along {stretch.replace('|', ' - ')}, similarity {percent(score)}, {matches} walks{sure}"
