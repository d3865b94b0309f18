"""Append-only logs of radio looks: JSON lines behind a strict door.

A line is parsed as a variant, and each field is taken only if it has the JSON type that it must have: what doesn't fit is null, never
coerced, and spoils neither its neighbours nor its line. Lines that are no JSON object are left out; those that are JSON but no
object, or hold NaN or an infinity, are counted as lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap import constants as C
from stridemap.operators.scans import carry_walk

#: Fixed value: a moment with an offset; without one it is refused.
MOMENT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, name: str) -> Column:
    """A field if it is a JSON string."""
    path = f"$.{name}"
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number(v: Column, name: str, low: float, high: float) -> Column:
    """A field if it is a JSON number in a range."""
    path = f"$.{name}"
    x = F.try_variant_get(v, path, "double")
    return F.when(_kind(v, path).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$") & x.between(low, high), x)


def whole(v: Column, name: str, low: float, high: float) -> Column:
    """A number, cut towards zero."""
    return number(v, name, low, high).cast("int")


def integer(v: Column, name: str, low: float, high: float = float(2**53)) -> Column:
    """A number without a fraction."""
    x = number(v, name, low, high)
    return F.when(x == F.floor(x), x.cast("bigint"))


def moment(v: Column, name: str = "time") -> tuple[Column, Column]:
    """(timestamp, offset in seconds) of an ISO moment that names its offset."""
    raw = text(v, name)
    good = F.when(raw.rlike(MOMENT), raw)
    zone = F.regexp_extract(good, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(zone == "Z", 0).otherwise(sign * (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60))
    at = F.try_to_timestamp(F.regexp_replace(good, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return at, F.when(at.isNotNull(), offset)


def network(v: Column) -> Column:
    """A network of a look; null unless it is an object."""
    truth = F.coalesce(F.when(_kind(v, "$.connected") == "BOOLEAN", F.try_variant_get(v, "$.connected", "boolean")), F.lit(False))
    fields = F.struct(
        F.coalesce(text(v, "ssid"), F.lit("")).alias("ssid"), F.lower(text(v, "bssid")).alias("bssid"), F.nullif(F.lower(text(v, "security")), F.lit("")).alias("security"),
        whole(v, "frequency", 100, 100_000).alias("frequency"), whole(v, "signal_dbm", -130, 0).alias("signal_dbm"),
        whole(v, "signal_percent", 0, 100).alias("signal_percent"), truth.alias("connected"),
    )
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), fields)


def networks(v: Column) -> Column:
    """The networks of a record, in order; elements that are no objects are dropped, and so is what is no list."""
    items = F.when(_kind(v, "$.networks").startswith("ARRAY"), F.try_variant_get(v, "$.networks", "array<variant>"))
    return F.coalesce(F.filter(F.transform(items, network), lambda n: n.isNotNull()), F.expr(f"cast(array() as array<{C.NETWORK}>)"))


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with ``v``, the variant of a line that is a JSON object, and ``lost``, whether it is JSON of another kind or holds no number.

    Of a key given twice the last value counts.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    raw = F.trim(F.col(line))
    v = F.when(raw.rlike(r"\}$"), F.try_parse_json(raw))
    any_json = F.try_parse_json(raw)
    bare = F.regexp_replace(raw, r'"(\\.|[^"\\])*"', '""')
    # NaN and the infinities are words that other readers take for numbers: with a number in their place the line is JSON.
    odd = bare.rlike(r"\b(NaN|Infinity)\b") & F.try_parse_json(F.regexp_replace(bare, r"-?\b(NaN|Infinity)\b", "0")).isNotNull()
    rows = lines.withColumn("v", v).withColumn("any", any_json)
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    lost = F.coalesce(odd | (F.col("any").isNotNull() & ~F.schema_of_variant("any").startswith("OBJECT")), F.lit(False))
    return rows.withColumn("lost", lost).withColumn("v", F.when(is_object, F.col("v"))).drop("any")


def records_of(lines: DataFrame) -> DataFrame:
    """Lines (file, pos, value) -> records in the log schema, in file order by ``pos``."""
    rows = parsed(lines).where(F.col("v").isNotNull())
    v = F.col("v")
    at, offset = moment(v)
    return rows.select(
        "file", "pos", at.alias("time"), offset.alias("utc_offset_s"), text(v, "event").alias("event"), F.nullif(text(v, "outing"), F.lit("")).alias("outing"),
        F.nullif(text(v, "interface"), F.lit("")).alias("interface"), integer(v, "cycle", 1).alias("cycle"), text(v, "ssid").alias("ssid"),
        F.lower(text(v, "bssid")).alias("bssid"), whole(v, "frequency", 100, 100_000).alias("frequency"), whole(v, "signal_dbm", -130, 0).alias("signal_dbm"),
        whole(v, "signal_percent", 0, 100).alias("signal_percent"), text(v, "reason").alias("reason"), number(v, "seconds", 0, 1e18).alias("seconds"),
        integer(v, "number", 1).alias("number"), integer(v, "key", 0).alias("key"), networks(v).alias("networks"),
    )


def lines_of(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(file, pos, value) of text files, with ``deep`` of those in subfolders too; ``pos`` rises along each file.

    A file is one row of its lines here, so that their order is known: logs are rotated files of a few MB, and many files are read in
    parallel.
    """
    whole_files = spark.read.option("recursiveFileLookup", deep).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole_files.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("pos", "value")).where("trim(value) <> ''").select(
        "file", F.col("pos").cast("bigint").alias("pos"), "value"
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of the logs under a path, each with its walk."""
    return carry_walk(records_of(lines_of(spark, path)), "outing", "file")


def count_lost(spark: SparkSession, path: str) -> DataFrame:
    """(file, lost): unusable lines of each file."""
    return parsed(lines_of(spark, path)).groupBy("file").agg(F.sum(F.col("lost").cast("bigint")).alias("lost"))


def sightings(records: DataFrame) -> DataFrame:
    """Records of scans exploded into (run, scan_id, cycle, pos, t, interface, key, strength, has_signal, ...).

    A look without a cycle number is told by its second.
    """
    from stridemap.functions import exprs

    t = F.unix_seconds("time")
    scans = records.where("event = 'scan' and time is not null")
    rows = scans.select(
        F.concat_ws("|", "file", "walk").alias("run"), F.coalesce(F.concat(F.lit("c"), F.col("cycle").cast("string")), F.concat(F.lit("t"), t.cast("string"))).alias("scan_id"),
        "interface", t.alias("t"), (F.col("pos") * 10_000).alias("base"), F.posexplode("networks").alias("k", "n"),
    )
    rows = rows.select("run", "scan_id", "interface", "t", (F.col("base") + F.col("k")).alias("pos"), "n.*")
    return rows.withColumns({
        "key": exprs.network_key(F.col("bssid"), F.col("ssid")), "strength": exprs.strength(F.col("signal_dbm"), F.col("signal_percent")),
        "has_signal": exprs.has_signal(F.col("signal_dbm"), F.col("signal_percent")), "cycle": F.col("scan_id"),
    })
