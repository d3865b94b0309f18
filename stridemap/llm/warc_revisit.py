"""Resolution of not-modified revisit records.

A revisit record (a 304 answer, stored without a body) is joined as of its date to the latest earlier full response of
the same canonical URL. If its validators agree with that response's, the record resolves to it, and its permitted
header fields are merged over the stored ones, as a cache does (RFC 9110, 15.4.5); fields that describe the body stay as stored.

The as-of join runs in two steps, so that a URL with a third of all captures is spread over many tasks. Captures
are dealt by (URL, time block); within a block a window finds the latest earlier response. Of every block only its last
response goes on, a row a block, and a second window carries it to the later blocks of the URL. Bodies never move.

Defined results (column ``resolution``): ``response`` for a full response; ``resolved``; ``mismatch`` if the validators differ;
``unverified`` if none of them is on both sides; ``orphan`` if there is no earlier response; ``no_url`` for a null URL or one
without a host; ``undated`` for a null date. Only ``resolved`` rows carry a source and merged headers; ``response`` rows
carry their own. "Earlier" is by date, then record id; rows that are alike in both are not earlier than one another. A
null record id sorts first. Repeated rows get a row each. Header names are compared in lower case, and of a
name given twice the last value counts. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a time block; a block's captures of one URL are one window partition.
BLOCK_S = 86_400

#: Fields of a stored response that a 304 answer never replaces.
KEPT = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding")
#: Fields of one connection or exchange, never stored by the merge.
DROPPED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade", "set-cookie")

#: Query parameters that only track the visitor.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="

#: A URL up to its first path segment.
SECTION = "^([^:/?#]+://[^/?#]*/?[^/?#]*)"


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, in lower case, path without a slash at its end, query without tracking and in
    order; no scheme, no fragment. Null without a host."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def lowered(headers: Column) -> Column:
    """Header names in lower case; of equal names the last value."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    empty = F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), empty)


def weak(etag: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(captures: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """One row per capture: record_id, url_key, date, resolution, source_id, status, headers (map).

    ``captures``: record_id, uri, date (timestamp), is_revisit, status, headers (map), digest (of the body, null without one).
    """
    rows = captures.select(
        F.col("record_id"), canonical_url(F.col("uri").cast("string")).alias("url_key"), F.col("date").cast("timestamp").alias("date"),
        F.coalesce(F.col("is_revisit"), F.lit(False)).alias("is_revisit"), F.col("status").cast("int").alias("status"),
        lowered(F.col("headers")).alias("headers"), F.col("digest").cast("string").alias("digest"),
    )
    timed = F.col("url_key").isNotNull() & F.col("date").isNotNull()
    loose = rows.where(~timed).withColumns({"found": F.lit(None).cast("struct<id:bigint,status:int,headers:map<string,string>,digest:string>")})
    rows = rows.where(timed).withColumn("block", F.floor(F.col("date").cast("double") / block_s))
    response = F.when(
        ~F.col("is_revisit"), F.struct(F.col("record_id").cast("long").alias("id"), "status", "headers", "digest")
    )
    order = [F.col("date"), F.col("record_id").asc_nulls_first()]
    within = Window.partitionBy("url_key", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("found", F.last(response, ignorenulls=True).over(within))
    # The last response of each block, and for each block the last one of the blocks before.
    at = F.struct(F.col("date"), F.col("record_id"))
    ends = rows.groupBy("url_key", "block").agg(F.max_by(response, F.when(~F.col("is_revisit"), at)).alias("last"))
    before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("url_key", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    joined = here.join(ends, ["url_key", "block"])
    joined = joined.withColumn("found", F.coalesce("found", "carried")).drop("carried", "block")
    return verdicts(joined.unionByName(loose))


def verdicts(rows: DataFrame) -> DataFrame:
    """Check the validators of each revisit against the response found, and merge the headers."""
    own, old = F.col("headers"), F.col("found.headers")
    tags, dates = (weak(own["etag"]), weak(old["etag"])), (own["last-modified"], old["last-modified"])
    digests = (F.col("digest"), F.col("found.digest"))
    agree = F.coalesce(tags[0] == tags[1], dates[0] == dates[1], digests[0] == digests[1])  # the first that both have
    resolution = (
        F.when(~F.col("is_revisit"), "response").when(F.col("url_key").isNull(), "no_url").when(F.col("date").isNull(), "undated")
        .when(F.col("found").isNull(), "orphan").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    )
    news = F.map_filter(own, lambda k, v: ~k.isin(*KEPT, *DROPPED))
    stored = F.map_filter(old, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(news), k), F.lit(False)))
    merged = F.map_concat(stored, news)
    good = F.col("resolution") == "resolved"
    return rows.withColumn("resolution", resolution).select(
        "record_id", "url_key", "date", "resolution",
        F.when(good, F.col("found.id")).otherwise(F.when(F.col("resolution") == "response", F.col("record_id").cast("long"))).alias("source_id"),
        F.when(good, F.col("found.status")).otherwise(F.col("status")).alias("status"),
        F.when(good, merged).when(F.col("resolution") == "response", own).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures of their section's front page (host and first segment), one a minute in the order of their ids.

    Section pages are captured again and again, which single pages of the table are not. A quarter of the captures (by crc32 of
    the id) are revisits without a body. A host's entity tag changes every 100 pages; one revisit in eight sends
    no tag but a date, which changes at the same pages.
    """
    part = F.crc32(F.col("page_id").cast("string"))
    revisit = F.coalesce(part % 4 == 1, F.lit(False))
    version = F.floor(F.col("page_id") / 100).cast("string")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)
    tag = F.concat(F.lit('W/"'), F.substring(F.md5(F.lower(host)), 1, 8), F.lit("-"), version, F.lit('"'))
    tagged = F.when(revisit & (part % 32 == 1), F.lit(None)).otherwise(tag)
    names = F.array(*(F.lit(x) for x in ("ETag", "Last-Modified", "Content-Length", "Date")))
    values = F.array(
        tagged, F.concat(F.lit("v"), version),
        F.when(revisit, F.lit("0")).otherwise(F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), F.col("page_id").cast("string"),
    )
    headers = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())
    return pages.select(
        F.col("page_id").alias("record_id"), F.regexp_extract("url", SECTION, 1).alias("uri"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("date"), revisit.alias("is_revisit"),
        F.when(revisit, 304).otherwise(200).alias("status"), headers.alias("headers"),
        F.when(~revisit, F.sha2(F.coalesce("html", F.lit("")), 256)).alias("digest"),
    )


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, with revisits resolved; headers as sorted ``name: value`` lines."""
    out = resolve_revisits(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.select(
        F.col("record_id").alias("page_id"), "url_key", "resolution", F.col("source_id").alias("source_page_id"), "status",
        F.array_join(F.array_sort(lines), "\n").alias("headers"),
    )


OP1_SQL = (r"""
WITH RECURSIVE bits AS (SELECT i AS n, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
p AS (SELECT page_id, url, html,
  xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(page_id::VARCHAR, '')]),
    lambda a, b: xor(a >> 8, crc.t[xor(a & 255, b) + 1]::BIGINT)), 4294967295) AS part FROM pages, crc),
s AS (SELECT page_id, part % 4 = 1 AS revisit, page_id // 100 AS version, part, octet_length(encode(coalesce(html, ''))) AS bytes,
  lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS h, regexp_extract(regexp_extract(url, 'SECTION', 1), '^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)', 1) AS rest FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort([q FOR q IN string_split(regexp_extract(rest, '\?(.*)$', 1), '&')
    IF q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid|ref)=')]) AS kept FROM s),
k AS (SELECT page_id, revisit, version, bytes, CASE WHEN revisit AND part % 32 = 1 THEN NULL
    ELSE 'W/"' || substr(md5(h), 1, 8) || '-' || version || '"' END AS tag,
  CASE WHEN host <> '' THEN host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key FROM c),
f AS (SELECT *, last_value(CASE WHEN NOT revisit THEN {'id': page_id, 'tag': tag, 'version': version, 'bytes': bytes} END IGNORE NULLS)
  OVER (PARTITION BY url_key ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found FROM k),
r AS (SELECT *, CASE WHEN NOT revisit THEN 'response' WHEN url_key IS NULL THEN 'no_url' WHEN found IS NULL THEN 'orphan'
  WHEN coalesce(tag = found.tag, version = found.version) THEN 'resolved' ELSE 'mismatch' END AS resolution FROM f)
SELECT page_id, url_key, resolution,
  CASE resolution WHEN 'resolved' THEN found.id WHEN 'response' THEN page_id END AS source_page_id,
  CASE WHEN revisit AND resolution <> 'resolved' THEN 304 ELSE 200 END AS status,
  CASE WHEN resolution IN ('resolved', 'response') THEN 'content-length: ' || CASE WHEN revisit THEN found.bytes ELSE bytes END
    || chr(10) || 'date: ' || page_id || chr(10) || 'etag: ' || CASE WHEN revisit THEN coalesce(tag, found.tag) ELSE tag END
    || chr(10) || 'last-modified: v' || version END AS headers
FROM r
""").replace("SECTION", SECTION)
