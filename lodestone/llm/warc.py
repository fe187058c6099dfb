"""Not-modified revisit records of web archives, resolved to full responses (operator 1).

A revisit says that a page has not changed; it carries validators and a few headers, but no body. It is resolved by an
as-of join to the latest earlier full response of the same canonical URL: if the validators agree, the response's headers
are updated with those of the revisit that may change without the body, and the body is the response's.

The join sorts all records once by (URL, time) over range partitions, without bodies. Within a partition a window carries
the last response forward; what a partition needs from earlier ones comes from a summary of one row for each URL and
partition. A URL with very many captures is spread over as many partitions as its rows fill.

Edge cases: records without URL or time, or revisits before any response, get the outcome `no_response`; revisits without
validators `no_validator`, with other ones than the response `mismatch`; null or empty headers count as none; records of
one URL and time are ordered by id, and a response at the revisit's very time counts as earlier only by its smaller id;
repeated records are resolved as often as they come; an empty table gives an empty table; further columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Headers of a 304 that never replace stored ones (RFC 9111, section 3.2; RFC 9110, section 7.6.1).
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that name a session or a campaign and not a page. Short names (ref, sid) often name a page, so they stay.
NO_PAGE = "utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid"

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host and path in one spelling: no scheme, www, default port, fragment or campaign; parameters sorted; no slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^(?i)[a-z][a-z0-9+.-]*://", "")
    place, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(place, r"^[^/]*", ""), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({NO_PAGE})(=|$)")))
    return F.when(url.isNotNull() & (host != ""), F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def header(headers: Column, name: str) -> Column:
    """The last value of a header, or null."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(-1))["value"]


def strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, those replaced that the fresh ones may replace."""
    allowed = F.filter(fresh, lambda h: ~F.lower(h["name"]).isin(NOT_MERGED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.array_contains(names, F.lower(h["name"]))), allowed)


def latest_before(rows: DataFrame, key: str, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds to each row the last non-null `value` of an earlier row with the same key, in a total order within it."""
    placed = common.staged(
        rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), name
    )
    inside = W.partitionBy("_part", key).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    summary = placed.groupBy(key, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_last"))
    split = W.partitionBy(key)
    before = split.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(key, "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    found = placed.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).join(carried, [key, "_part"], "left")
    return found.withColumn(out, F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_at", "_part")


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id long, warc_type, url, captured timestamp, headers array<struct<name,value>>, payload_digest.

    Result for each record: record_id, warc_type, canonical_url, response_id (whose body it has), outcome, headers and
    payload_digest. outcome: full, resolved, no_response, no_validator or mismatch.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), "warc_type", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured").cast("timestamp").alias("captured"),
        F.coalesce("headers", F.array().cast(HEADERS)).alias("headers"), "payload_digest",
    )
    full = F.col("warc_type") == "response"
    usable = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    offered = rows.withColumn("_response", F.when(full & usable, F.struct("record_id", "headers", "payload_digest")))
    found = latest_before(offered, "canonical_url", ["captured", "record_id"], "_response", "_stored", "records")
    stored = F.col("_stored")
    old_tag, new_tag = strong(header(stored["headers"], "etag")), strong(header(F.col("headers"), "etag"))
    old_time, new_time = header(stored["headers"], "last-modified"), header(F.col("headers"), "last-modified")
    agrees = F.when(new_tag.isNotNull(), F.coalesce(new_tag == old_tag, F.lit(False))).otherwise(F.coalesce(new_time == old_time, F.lit(False)))
    outcome = (
        F.when(full, "full").when(~usable | stored.isNull(), "no_response").when(new_tag.isNull() & new_time.isNull(), "no_validator").when(~agrees, "mismatch").otherwise("resolved")
    )
    judged = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return judged.select(
        "record_id", "warc_type", "canonical_url", F.when(full, F.col("record_id")).when(resolved, stored["record_id"]).alias("response_id"), "outcome",
        F.when(resolved, merged(stored["headers"], F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, stored["payload_digest"]).when(full, F.col("payload_digest")).alias("payload_digest"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl history for each page of a table that has one state of each: the response, a revisit, a changed response with
    a revisit, and revisits that come too early, have an old validator or none. Spellings of the URL vary."""
    tag = lambda s: F.concat(F.lit('"'), F.substring(F.md5(F.concat(F.coalesce("html", F.lit("")), F.lit(s))), 1, 16), F.lit('"'))
    day = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)) * 60 + n * 86_400)
    digest = lambda s: F.sha2(F.concat(F.coalesce("html", F.lit("")), F.lit(s)), 256)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    lit = F.lit

    def record(k: int, kind: str, url: Column, n: int, headers: list[Column], payload: Column) -> Column:
        return F.struct((F.col("page_id") * 8 + k).alias("record_id"), lit(kind).alias("warc_type"), url.alias("url"), day(n).alias("captured"), F.array(*headers).cast(HEADERS).alias("headers"), payload.cast("string").alias("payload_digest"))

    def answer(s: str, n: str) -> list[Column]:
        return [pair("Content-Type", lit("text/html")), pair("Content-Length", F.octet_length(F.coalesce("html", lit(""))).cast("string")), pair("ETag", tag(s)), pair("Last-Modified", lit(n)), pair("Date", lit(n)), pair("Cache-Control", lit("max-age=60"))]

    u, none = F.col("url"), lit(None)
    other = F.concat(F.regexp_replace(u, "#.*$", ""), lit("#again"))
    history = [
        record(0, "revisit", u, -1, [pair("ETag", tag("")), pair("Date", lit("day -1"))], none),
        record(1, "response", u, 0, answer("", "day 0"), digest("")),
        record(2, "revisit", other, 1, [pair("etag", F.concat(lit("W/"), tag(""))), pair("date", lit("day 1")), pair("content-length", lit("0")), pair("Vary", lit("Accept"))], none),
        record(3, "revisit", u, 2, [pair("Last-Modified", lit("day 0")), pair("Cache-Control", lit("no-store"))], none),
        record(4, "response", other, 3, answer("+", "day 3"), digest("+")),
        record(5, "revisit", u, 4, [pair("ETag", tag("")), pair("Date", lit("day 4"))], none),
        record(6, "revisit", other, 5, [pair("ETag", tag("+")), pair("Date", lit("day 5")), pair("Connection", lit("close"))], none),
        record(7, "revisit", u, 6, [pair("Date", lit("day 6"))], none),
    ]
    return pages.select(F.explode(F.array(*history)).alias("r")).select("r.*")


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat_ws(": ", F.lower(h["name"]), h["value"]))), "\n")
    return out.withColumn("headers", lines)


def oracle() -> str:
    """DuckDB: the same histories; the latest earlier response by a window over each URL."""
    def tag(s: str) -> str:
        return f"""'"' || left(md5(coalesce(html, '') || '{s}'), 16) || '"'"""

    def full(s: str, n: str) -> str:
        return f"['content-type: text/html', 'content-length: ' || strlen(coalesce(html, '')), 'etag: ' || {tag(s)}, 'last-modified: {n}', 'date: {n}', 'cache-control: max-age=60']"

    hidden = ", ".join(f"'{x}'" for x in NOT_MERGED)
    rows = [
        (0, "revisit", "url", -1, f"['etag: ' || {tag('')}, 'date: day -1']", "''"),
        (1, "response", "url", 0, full("", "day 0"), "''"),
        (2, "revisit", "url || '#again'", 1, f"['etag: W/' || {tag('')}, 'date: day 1', 'content-length: 0', 'vary: Accept']", "''"),
        (3, "revisit", "url", 2, "['last-modified: day 0', 'cache-control: no-store']", "''"),
        (4, "response", "url || '#again'", 3, full("+", "day 3"), "'+'"),
        (5, "revisit", "url", 4, f"['etag: ' || {tag('')}, 'date: day 4']", "''"),
        (6, "revisit", "url || '#again'", 5, f"['etag: ' || {tag('+')}, 'date: day 5', 'connection: close']", "''"),
        (7, "revisit", "url", 6, "['date: day 6']", "''"),
    ]
    parts = [f"SELECT page_id * 8 + {k} AS record_id, '{t}' AS warc_type, {u} AS url, coalesce(page_id, 0) * 60 + {n} * 86400 AS tm, {h} AS h, CASE WHEN '{t}' = 'response' THEN sha256(coalesce(html, '') || {s}) END AS payload FROM pages" for k, t, u, n, h, s in rows]
    return f"""
WITH r AS ({' UNION ALL '.join(parts)}),
c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)[a-z][a-z0-9+.-]*://', '') AS bare FROM r),
c2 AS (SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS place, regexp_extract(bare, '\\?(.*)$', 1) AS query FROM c),
c3 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host,
  regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '') AS path,
  list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^({NO_PAGE})(=|$)'))) AS kept FROM c2),
c4 AS (SELECT record_id, warc_type, tm, h, payload, CASE WHEN url IS NOT NULL AND host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical_url FROM c3),
s AS (SELECT *, last_value(CASE WHEN warc_type = 'response' THEN {{'id': record_id, 'h': h, 'payload': payload}} END IGNORE NULLS)
  OVER (PARTITION BY canonical_url ORDER BY tm, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM c4),
v AS (SELECT *, replace(list_filter(h, lambda x: x LIKE 'etag: %')[1][7:], 'W/', '') AS tag, list_filter(h, lambda x: x LIKE 'last-modified: %')[1][16:] AS mod,
  list_filter(stored.h, lambda x: x LIKE 'etag: %')[1][7:] AS old_tag, list_filter(stored.h, lambda x: x LIKE 'last-modified: %')[1][16:] AS old_mod,
  list_filter(h, lambda x: NOT list_contains([{hidden}], split_part(x, ': ', 1))) AS fresh FROM s),
o AS (SELECT *, CASE WHEN warc_type = 'response' THEN 'full' WHEN canonical_url IS NULL OR stored IS NULL THEN 'no_response' WHEN tag IS NULL AND mod IS NULL THEN 'no_validator'
  WHEN NOT coalesce(CASE WHEN tag IS NOT NULL THEN tag = old_tag ELSE mod = old_mod END, false) THEN 'mismatch' ELSE 'resolved' END AS outcome,
  list_transform(fresh, lambda x: split_part(x, ': ', 1)) AS names FROM v)
SELECT record_id, warc_type, canonical_url, CASE outcome WHEN 'full' THEN record_id WHEN 'resolved' THEN stored.id END AS response_id, outcome,
  array_to_string(list_sort(CASE WHEN outcome = 'resolved' THEN list_concat(list_filter(stored.h, lambda x: NOT list_contains(names, split_part(x, ': ', 1))), fresh) ELSE h END), chr(10)) AS headers,
  CASE outcome WHEN 'full' THEN payload WHEN 'resolved' THEN stored.payload END AS payload_digest FROM o"""
