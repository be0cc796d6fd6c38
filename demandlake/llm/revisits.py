"""Resolving not-modified revisit records of web archives.

A revisit record (HTTP 304) has no payload.  It stands for the latest full
response of the same canonical URL that was captured strictly earlier, if the
validators agree: the entity tags (compared weakly) when the revisit has one,
else the Last-Modified dates, else only a response that has no validator
either.  A resolved revisit takes that response's status and payload, and its
headers updated by those that a 304 may send.

The as-of step is a join by canonical URL and time block in two levels: the
last response of each (URL, block) goes through a window over the few blocks
of the URL, and a window inside (URL, block) finds the last response of the
block itself.  So a URL that holds a third of all records is spread over its
blocks.  Only ids, validators and headers travel; payloads are joined last,
once, by record id.

Defined results (column ``resolution``): ``response`` for full responses;
``resolved``; ``no_earlier_response``; ``validator_mismatch``;
``no_validators``; ``no_url`` for a revisit whose URL is null or blank;
``no_time`` for one without a time (a response without a time, URL or id is
never referred to); ``other`` for any other or null kind.  Every record gives
one row: rows that repeat an id stay apart, and where their payloads differ
the greatest is taken for all; a record without an id keeps its own payload.  Of responses at one time
the largest record id is the latest; a response at the revisit's own time is
not earlier.  Null headers are no headers; names are matched without case;
of names that differ in case only, the last in byte order counts.  Extra columns are kept; columns that clash
with an output name are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlake.llm.common import stage

BLOCK_SECONDS = 3600

# Header fields that a 304 response carries to update a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, trailing slashes and tracking
    parameters (``utm_*``) dropped, host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.length(F.trim(url)) > 0, full)


def plain_headers(headers: Column) -> Column:
    """Names in lower case; null as none.  Of names that differ in case only,
    the last in byte order counts (a map has no order of its own)."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(
        F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _payload_key() -> Column:
    """The record's id; without one, a hash of what the record is."""
    return F.coalesce(F.col("record_id").cast("string"),
                      F.concat(F.lit("-"), F.sha2(F.concat_ws("|", "url", F.col("time").cast("string"), "kind", "payload"), 256)))


def resolve(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``records``: record_id long, url, time long (seconds), kind
    (``response`` or ``revisit``), status int, headers map, payload string.
    Returns them with ``canonical_url``, ``resolution``, ``ref_id``, and
    status, headers and payload as resolved."""
    made = ("canonical_url", "resolution", "ref_id")
    extra = [c for c in records.columns if c not in ("record_id", "url", "time", "kind", "status", "headers", "payload", *made)]
    r = records.select("record_id", "url", canonical_url(F.col("url")).alias("canonical_url"), "time", "kind", "status",
                       plain_headers(F.col("headers")).alias("headers"),
                       _payload_key().alias("__own"), F.struct(F.lit(1).alias("__x"), *[F.col(f"`{c}`") for c in extra]).alias("__extra"))
    r = r.withColumn("__block", F.floor(F.col("time") / block_seconds))
    usable = (F.col("kind") == "response") & F.col("time").isNotNull() & F.col("canonical_url").isNotNull() & F.col("record_id").isNotNull()
    stored = F.struct("time", "record_id", "status", "headers")
    r = stage(r.withColumn("__full", F.when(usable, stored)), "revisits")  # ids, times and headers
    # level 1: the last response of every block, carried to later blocks of the URL
    lasts = r.where(usable).groupBy("canonical_url", "__block").agg(
        F.max_by("__full", F.struct("time", "record_id")).alias("__full"))
    seen = r.where((F.col("kind") == "revisit") & F.col("time").isNotNull() & F.col("canonical_url").isNotNull()).groupBy(
        "canonical_url", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("canonical_url").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.join(lasts, ["canonical_url", "__block"], "full").select(
        "canonical_url", "__block", F.last("__full", ignorenulls=True).over(before).alias("__carried")).where("__carried is not null")
    # level 2: the last response earlier in the same block
    inside = Window.partitionBy("canonical_url", "__block").orderBy(
        "time", F.when(F.col("kind") == "response", 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("__near", F.last("__full", ignorenulls=True).over(inside)).join(
        carried, ["canonical_url", "__block"], "left")
    ref = F.when((F.col("kind") == "revisit") & F.col("time").isNotNull() & F.col("canonical_url").isNotNull(),
                 F.coalesce("__near", "__carried"))
    d = near.withColumn("__ref", ref)
    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    old = F.col("__ref")["headers"]
    resolution = (
        F.when(F.col("kind") == "response", "response").when(F.coalesce(F.col("kind") != "revisit", F.lit(True)), "other")
        .when(F.col("canonical_url").isNull(), "no_url").when(F.col("time").isNull(), "no_time")
        .when(F.col("__ref").isNull(), "no_earlier_response")
        .when(tag.isNotNull(), F.when(F.coalesce(_strong(tag) == _strong(old["etag"]), F.lit(False)), "resolved").otherwise("validator_mismatch"))
        .when(date.isNotNull(), F.when(F.coalesce(F.trim(date) == F.trim(old["last-modified"]), F.lit(False)), "resolved")
              .otherwise("validator_mismatch"))
        .when(old["etag"].isNull() & old["last-modified"].isNull(), "resolved").otherwise("no_validators"))
    d = d.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    d = d.select("record_id", "url", "canonical_url", "time", "kind", "resolution", "__own",
                 F.when(done, F.col("__ref")["record_id"]).alias("ref_id"),
                 F.when(done, F.col("__ref")["status"]).otherwise(F.col("status")).alias("status"),
                 F.when(done, merged).otherwise(F.col("headers")).alias("headers"), "__extra")
    # one payload an id, so rows that repeat an id stay as many as they are
    payloads = records.where("payload is not null").groupBy(_payload_key().alias("__id")).agg(F.max("payload").alias("payload"))
    d = d.join(payloads, F.when(done, F.col("ref_id").cast("string")).otherwise(F.col("__own")) == F.col("__id"), "left")
    return d.select("record_id", "url", "canonical_url", "time", "kind", "resolution", "ref_id", "status", "headers", "payload",
                    *[F.col("__extra")[c].alias(c) for c in extra])


def records_from_pages(pages: DataFrame) -> DataFrame:
    """Archive records of repeated visits to ``pages`` (page_id, url, html):
    a full response for every page, later revisits whose validators are
    strong, weak, a date, or stale, and for some pages a second response with
    a new entity tag in between."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    start = F.lit(1704067200) + p * 60
    text = lambda v: v.cast("string")
    modified = F.concat(F.lit("t"), text(start - 1000))
    first = F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"),
                         F.lit("Content-Length"), text(F.length("html")), F.lit("Cache-Control"), F.lit("max-age=600"),
                         F.lit("Date"), text(start))
    second = (F.when(p % 3 == 0, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Date"), text(start + 86400),
                                              F.lit("Cache-Control"), F.lit("max-age=1200"), F.lit("Content-Length"), F.lit("0")))
              .when(p % 3 == 1, F.create_map(F.lit("last-modified"), modified, F.lit("date"), text(start + 86400)))
              .otherwise(F.create_map(F.lit("ETag"), F.when(p % 11 == 0, F.lit('"stale"')).otherwise(tag), F.lit("Expires"), text(start + 172800))))
    third = F.create_map(F.lit("ETag"), F.concat(F.lit('"v2-'), text(p), F.lit('"')), F.lit("Date"), text(start + 172800))
    fourth = F.create_map(F.lit("ETag"), tag, F.lit("Date"), text(start + 259200))

    def visit(n: int, kind: str, headers: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), headers.alias("headers")))

    visits = F.array(visit(0, "response", first, F.lit(True)), visit(1, "revisit", second, p % 5 != 4),
                     visit(2, "response", third, p % 4 == 0), visit(3, "revisit", fourth, p % 2 == 0))
    d = pages.withColumn("v", F.explode(F.filter(visits, lambda x: x.isNotNull())))
    return d.select((p * 4 + F.col("v.n")).alias("record_id"), "url", (start + F.col("v.n") * 86400).alias("time"),
                    F.col("v.kind").alias("kind"), F.when(F.col("v.kind") == "response", 200).otherwise(304).alias("status"),
                    F.col("v.headers").alias("headers"), F.when(F.col("v.kind") == "response", F.col("html")).alias("payload"))


RESOLVED_PAGES_SQL = """
WITH visit AS (
  SELECT page_id, url, html, n, 1704067200 + page_id * 60 AS start,
         '"' || substr(md5(html), 1, 16) || '"' AS tag
  FROM pages, (VALUES (0), (1), (2), (3)) AS t(n)
  WHERE n = 0 OR (n = 1 AND page_id % 5 <> 4) OR (n = 2 AND page_id % 4 = 0) OR (n = 3 AND page_id % 2 = 0)
), part AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM visit
), split AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'),
                               lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params
  FROM part
), rec AS (
  SELECT page_id * 4 + n AS record_id, start + n * 86400 AS time,
         CASE WHEN n IN (0, 2) THEN 'response' ELSE 'revisit' END AS kind,
         host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS curl, html,
         CASE n WHEN 0 THEN tag WHEN 2 THEN '"v2-' || page_id || '"' WHEN 3 THEN tag
           ELSE CASE page_id % 3 WHEN 0 THEN 'W/' || tag WHEN 1 THEN NULL
                ELSE CASE WHEN page_id % 11 = 0 THEN '"stale"' ELSE tag END END END AS etag,
         CASE WHEN n = 0 OR (n = 1 AND page_id % 3 = 1) THEN 't' || (start - 1000) END AS modified,
         CASE WHEN n = 0 THEN 'text/html' END AS ctype,
         CASE WHEN n = 0 THEN CAST(length(html) AS VARCHAR) WHEN n = 1 AND page_id % 3 = 0 THEN '0' END AS clen,
         CASE WHEN n = 0 THEN 'max-age=600' WHEN n = 1 AND page_id % 3 = 0 THEN 'max-age=1200' END AS cache,
         CASE WHEN n = 1 AND page_id % 3 = 2 THEN NULL ELSE CAST(start + n * 86400 AS VARCHAR) END AS date_,
         CASE WHEN n = 1 AND page_id % 3 = 2 THEN CAST(start + 172800 AS VARCHAR) END AS expires
  FROM split
), stored AS (
  SELECT * FROM rec WHERE kind = 'response'
  QUALIFY row_number() OVER (PARTITION BY curl, time ORDER BY record_id DESC) = 1
), latest AS (
  SELECT r.*, s.record_id AS s_id, s.etag AS s_etag, s.modified AS s_modified, s.ctype AS s_ctype, s.clen AS s_clen,
         s.cache AS s_cache, s.date_ AS s_date, s.expires AS s_expires, s.html AS s_html
  FROM rec r ASOF LEFT JOIN stored s ON r.curl = s.curl AND r.time > s.time
), judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN s_id IS NULL THEN 'no_earlier_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(s_etag, '^W/', '')
                                    THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN modified = s_modified THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM latest
), merged AS (
  SELECT record_id, curl, kind, resolution, resolution = 'resolved' AS ok, s_id, s_html, html,
    CASE WHEN ok THEN coalesce(cache, s_cache) ELSE cache END AS h_cache,
    CASE WHEN ok THEN s_clen ELSE clen END AS h_clen, CASE WHEN ok THEN s_ctype ELSE ctype END AS h_ctype,
    CASE WHEN ok THEN coalesce(date_, s_date) ELSE date_ END AS h_date,
    CASE WHEN ok THEN coalesce(etag, s_etag) ELSE etag END AS h_etag,
    CASE WHEN ok THEN coalesce(expires, s_expires) ELSE expires END AS h_expires,
    CASE WHEN ok THEN coalesce(modified, s_modified) ELSE modified END AS h_modified
  FROM judged
)
SELECT record_id, curl AS canonical_url, kind, resolution, CASE WHEN ok THEN s_id END AS ref_id,
  CASE WHEN kind = 'response' OR ok THEN 200 ELSE 304 END AS status,
  concat_ws(chr(10), 'cache-control: ' || h_cache, 'content-length: ' || h_clen, 'content-type: ' || h_ctype, 'date: ' || h_date,
            'etag: ' || h_etag, 'expires: ' || h_expires, 'last-modified: ' || h_modified) AS headers,
  CASE WHEN kind = 'response' THEN sha256(html) WHEN ok THEN sha256(s_html) END AS payload_sha256
FROM merged
"""
