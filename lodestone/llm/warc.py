"""WARC not-modified revisits, resolved to the latest earlier full response of the same canonical URL.

The as-of join has two levels, so that a URL with very many records is no single group: where a URL has more than `slice_rows`
records, time is cut into slices at the quantiles of such URLs' times (at most MOST_SLICES of them; then slices grow, and their
windows spill). A window within (URL, slice) finds the latest response of the same slice, and the slices' last responses tell
the rest. Only keys and times go through the windows; headers and bodies are joined on at the end.

A revisit resolves if its validators allow: its entity tag must equal the response's (weakly compared), or, without a tag,
its Last-Modified; a revisit without validators resolves unverified. The headers that a not-modified response may renew
replace the response's own (RFC 9110, 15.4.5); all other headers come from the response.

Defined results: a revisit without an earlier response is `unresolved`; at equal times a response does not count as earlier;
among responses of one URL and time the largest record_id counts (null is the least), and among those of one record_id the one
with the largest body (null is the least), then headers; a record_id that other URLs or times use too makes no difference; a
revisit or response without a record_id is resolved like any other (response_id is null then, the verdict tells); a null URL or
time is never resolved; null headers are empty; repeated records each get their row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SLICE_ROWS, MOST_SLICES = 65_536, 4_096
#: The fields that a 304 response may carry to renew stored ones, and query keys that only track.
RENEWABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a slash at its end, query without tracking
    keys and in order; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda q: (q != "") & ~q.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _slice(keys: DataFrame, slice_rows: int) -> Column:
    """The slice of time that a record lies in; equal times share one."""
    counts = keys.groupBy("canonical").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    slices = min(MOST_SLICES, -(-most // slice_rows))
    if slices < 2:
        return F.lit(0)
    hot = keys.join(counts.where(F.col("n") > slice_rows), "canonical", "left_semi")
    bounds = sorted(set(hot.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)], 20 * slices)).first()[0] or []))
    # a slice begins after its bound; two looks, at every 64th bound and at the 64 from there, instead of one at all
    above = lambda part: F.size(F.filter(part, lambda b: b < F.col("at")))
    literal = lambda values: F.array(*map(F.lit, values))
    coarse = F.greatest(above(literal(bounds[::64])) - 1, F.lit(0)) * 64
    return coarse + above(F.slice(literal(bounds), coarse + 1, F.lit(64)))


def latest_earlier(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(record_id, canonical, at, response_at, response_id) of the revisits among records (record_id, canonical, at, full) that have
    an earlier response, once each."""
    keys = records.select("record_id", "canonical", "at", "full").where("canonical IS NOT NULL AND at IS NOT NULL")
    keys = keys.withColumn("slice", _slice(keys, slice_rows))
    response = F.when(F.col("full"), F.struct("at", "record_id"))
    inside = Window.partitionBy("canonical", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = keys.withColumn("found", F.max(response).over(inside)).where(~F.col("full"))
    ends = keys.where("full").groupBy("canonical", "slice").agg(F.max(F.struct("at", "record_id")).alias("end"))
    # what each slice inherits: the last response of the slices before it
    asked = near.where("found IS NULL").select("canonical", "slice").distinct().join(ends, ["canonical", "slice"], "full")
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = asked.select("canonical", "slice", F.max("end").over(before).alias("carried"))
    found = near.join(inherited, ["canonical", "slice"], "left").withColumn("found", F.coalesce("found", "carried"))
    return found.where("found IS NOT NULL").select("record_id", "canonical", "at", F.col("found.at").alias("response_at"), F.col("found.record_id").alias("response_id")).distinct()


def _tag(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "^W/", "")


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A row for each revisit of records (record_id, url, at as a number, warc_type, status, headers as map<string,string> with
    names in lower case, body): record_id, canonical, response_id, verdict, status, headers and body."""
    records = records.select("record_id", "url", "at", "warc_type", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "body")
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    keyed = records.withColumn("canonical", canonical_url(F.col("url"))).withColumn("full", F.coalesce(full, F.lit(False)))
    revisits = keyed.where((F.col("warc_type") == "revisit") & (F.col("status") == 304))
    used = keyed.where(F.col("full") | ((F.col("warc_type") == "revisit") & (F.col("status") == 304)))
    found = latest_earlier(used, slice_rows).select(*(F.col(c).alias(f"_{c}") for c in ("record_id", "canonical", "at")), "response_at", "response_id")
    # ids may be null, and may be used again by other URLs: they are only a part of each key
    same = F.col("record_id").eqNullSafe(F.col("_record_id")) & (F.col("canonical") == F.col("_canonical")) & (F.col("at") == F.col("_at"))
    matched = revisits.drop("body", "full").join(found, same, "left").drop("_record_id", "_canonical", "_at")
    content = F.struct("body", F.array_sort(F.map_entries("headers")).alias("entries"))
    stored = keyed.where("full AND canonical IS NOT NULL AND at IS NOT NULL").groupBy("canonical", "at", "record_id").agg(F.max(content).alias("content"))
    stored = stored.select(*(F.col(c).alias(f"_{c}") for c in ("record_id", "canonical", "at")), F.map_from_entries("content.entries").alias("stored"), "content.body")
    of_response = F.col("response_id").eqNullSafe(F.col("_record_id")) & (F.col("canonical") == F.col("_canonical")) & (F.col("response_at") == F.col("_at"))
    joined = matched.join(stored, of_response, "left")
    own, old = F.col("headers"), F.col("stored")
    tag, modified = own["etag"], own["last-modified"]
    verdict = (
        F.when(F.col("response_at").isNull(), "unresolved")
        .when(tag.isNotNull(), F.when(_tag(tag).eqNullSafe(_tag(old["etag"])), "resolved").otherwise("validator_mismatch"))
        .when(modified.isNotNull(), F.when(modified.eqNullSafe(old["last-modified"]), "resolved").otherwise("validator_mismatch"))
        .otherwise("unverified")
    )
    renewed = F.map_filter(own, lambda k, v: k.isin(*RENEWABLE) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    good = F.col("verdict").isin("resolved", "unverified")
    return joined.withColumn("verdict", verdict).select(
        "record_id", "canonical", F.when(good, F.col("response_id")).alias("response_id"), "verdict",
        F.when(good, F.lit(200)).otherwise(F.col("status")).alias("status"), F.when(good, merged).otherwise(own).alias("headers"), F.when(good, F.col("body")).alias("body"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records told from pages (page_id, url, html), which have no capture log of their own.

    Page p is fetched in full at time 10 p. It is asked for again at 10 p + 10 (p mod 7) + 5 through an address that differs
    only in what the canonical form drops: with its entity tag, a stale tag, its date, or no validator."""
    day = F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(28)).cast("string"))
    tag = F.md5(F.coalesce("html", F.lit("")))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("at"), F.lit("response").alias("warc_type"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("t"), F.col("page_id") * 10)).alias("headers"), F.col("html").alias("body"),
    )
    kind = F.pmod(F.col("page_id"), F.lit(5))
    later = F.col("page_id") * 10 + F.pmod(F.col("page_id"), F.lit(7)) * 10 + 5
    check = F.when(kind == 0, F.create_map(F.lit("etag"), F.lit("stale"))).when(kind <= 2, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag))).when(kind == 3, F.create_map(F.lit("last-modified"), day)).otherwise(F.create_map().cast("map<string,string>"))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), later.alias("at"), F.lit("revisit").alias("warc_type"), F.lit(304).alias("status"),
        F.map_concat(check, F.create_map(F.lit("date"), F.concat(F.lit("t"), later), F.lit("content-type"), F.lit("ignored"))).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(again)


def op10_warc_revisits(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "canonical", "response_id", "verdict", "status", F.array_join(lines, ";").alias("headers"), F.md5("body").alias("body_md5"))


ORACLE_OP10 = r"""
WITH bare AS (
  SELECT page_id, html, url, md5(coalesce(html, '')) AS tag, 'day ' || (page_id % 28) AS day, page_id * 10 AS at,
    page_id * 10 + (page_id % 7) * 10 + 5 AS later,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|fbclid|gclid)(=|$)'))) AS query
  FROM bare),
p AS (SELECT *, host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical FROM parts),
matched AS (
  SELECT r.page_id, r.canonical, r.later, r.tag, r.day, s.page_id AS found, s.tag AS old_tag, s.day AS old_day, s.html AS body, s.at AS old_at
  FROM p r ASOF LEFT JOIN p s ON r.canonical = s.canonical AND r.later > s.at),
judged AS (
  SELECT *, CASE WHEN found IS NULL THEN 'unresolved'
    WHEN page_id % 5 = 0 THEN CASE WHEN old_tag = 'stale' THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN page_id % 5 <= 2 THEN CASE WHEN old_tag = tag THEN 'resolved' ELSE 'validator_mismatch' END
    WHEN page_id % 5 = 3 THEN CASE WHEN old_day = day THEN 'resolved' ELSE 'validator_mismatch' END
    ELSE 'unverified' END AS verdict
  FROM matched)
SELECT page_id * 2 + 1 AS record_id, canonical, CASE WHEN verdict IN ('resolved', 'unverified') THEN found * 2 END AS response_id, verdict,
  CASE WHEN verdict IN ('resolved', 'unverified') THEN 200 ELSE 304 END AS status,
  CASE WHEN verdict IN ('resolved', 'unverified')
    THEN 'content-type=text/html;date=t' || later || ';etag=' || CASE WHEN page_id % 5 = 0 THEN 'stale' WHEN page_id % 5 <= 2 THEN 'W/' || tag ELSE old_tag END || ';last-modified=' || old_day
    ELSE 'content-type=ignored;date=t' || later || CASE WHEN page_id % 5 = 0 THEN ';etag=stale' WHEN page_id % 5 <= 2 THEN ';etag=W/' || tag WHEN page_id % 5 = 3 THEN ';last-modified=' || day ELSE '' END END AS headers,
  CASE WHEN verdict IN ('resolved', 'unverified') THEN md5(body) END AS body_md5
FROM judged
"""
