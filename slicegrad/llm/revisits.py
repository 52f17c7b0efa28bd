"""Resolving not-modified revisits of a web archive: an as-of join by canonical URL.

A revisit names no payload; it stands for the latest full response of the same page captured before it. The join
sorts all captures by canonical URL and time into ranges of about equal size, so a URL with a third of all captures
spans many ranges. Within a range a window gives the latest response before each revisit. What a range needs from
earlier ones is the last response of its first URL; that is one small row per range, found by a window over those
rows alone.

Validators are checked in this order; the first that both sides have decides: entity tag (weak marks ignored), time of
last modification, payload digest. A pair without a common validator is not resolved. A resolved revisit has the
response's headers, of which the revisit's own values replace those that a not-modified answer may update.

Defined results: a revisit without URL or time, or without an earlier response, has outcome ``no_response``; responses
without URL or time serve no revisit; a response at the very time of a revisit is not earlier; of several at one time
the greatest id counts; equal rows are kept; header names are compared in lower case; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicegrad.llm.common import saved, shuffle_width
from slicegrad.session import bounded_broadcast

# Headers that a not-modified answer may update, parameters that name no other page, default ports.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = ("fbclid", "gclid", "ref", "sessionid")
ROWS_PER_RANGE = 2_000_000

SCHEME = "^(?:[A-Za-z][A-Za-z0-9+.-]*://)?"


def canonical_url(url: Column) -> Column:
    """One spelling per page: no scheme, ``www.``, default port, fragment, tracking parameter or last slash; lower-case
    host and sorted parameters."""
    clean = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(clean, SCHEME + "([^/?#]*)", 1)), ":(80|443)$", "")
    host = F.regexp_replace(host, "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(clean, SCHEME + "[^/?#]*([^?#]*)", 1), "/+$", "")
    given = F.split(F.regexp_extract(clean, "^[^?#]*[?]([^#]*)", 1), "&", -1)
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    kept = F.filter(given, lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~name(p).startswith("utm_"))
    query = F.array_join(F.sort_array(kept), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.trim(url) != "", whole)


def lower_names(headers: Column) -> Column:
    """Headers with lower-case names; of names that differ in case only, one stays."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(F.sort_array(pairs), lambda e: e["value"].isNotNull())
    alone = lambda all_: F.filter(all_, lambda e, i: ~e["key"].eqNullSafe(F.get(all_, i - 1)["key"]))
    return F.coalesce(F.map_from_entries(F.get(F.transform(F.array(first), alone), F.lit(0))), F.create_map().cast("map<string,string>"))


def _match(revisit: Column, response: Column) -> Column:
    """True or false by the first validator that both have; null if they have none in common."""
    def value(side, name):
        return F.regexp_replace(F.element_at(side["headers"], F.lit(name)), "^W/", "") if name == "etag" else F.element_at(side["headers"], F.lit(name))

    return F.coalesce(
        value(revisit, "etag") == value(response, "etag"),
        value(revisit, "last-modified") == value(response, "last-modified"),
        revisit["digest"] == response["digest"],
    )


def merged_headers(revisit: Column, response: Column) -> Column:
    """The response's headers, with the revisit's values for those it may update."""
    news = F.map_filter(revisit, lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(response, lambda k, _: ~F.array_contains(F.map_keys(news), k))
    return F.map_concat(old, news)


def resolve(captures: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """``record_id, url_key, response_id, outcome, headers`` of every revisit.

    ``captures`` has ``record_id, url, ts`` (a number or time), ``kind`` ('response' or 'revisit'), ``headers``
    (a map) and ``digest`` of the payload. ``outcome`` is ``resolved``, ``mismatch``, ``no_validator`` or ``no_response``;
    headers are merged where resolved, and the revisit's own elsewhere.
    """
    spark = captures.sparkSession
    plain = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("kind") == "response").alias("full"),
        lower_names(F.col("headers")).alias("headers"), "digest",
    ).filter(F.col("full").isNotNull())
    placed = plain.filter(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    n = ranges or shuffle_width(spark, captures.count(), ROWS_PER_RANGE)
    # revisits before responses of the same moment, which are not earlier
    order = ["url_key", "ts", "full", "record_id"]
    ranged = placed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ranged, _ = saved(ranged, "captures")

    response = F.when(F.col("full"), F.struct("record_id", "headers", "digest"))
    before = Window.partitionBy("part", "url_key").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    with_own = ranged.withColumn("own", F.last(response, ignorenulls=True).over(before)).filter(~F.col("full"))

    # per range: its first URL asks, its last URL answers with its latest response
    ends = ranged.groupBy("part").agg(F.min("url_key").alias("first_url"), F.max("url_key").alias("last_url"))
    at_end = ranged.join(bounded_broadcast(ends, n, 16), "part").filter((F.col("url_key") == F.col("last_url")) & F.col("full"))
    latest = at_end.groupBy("part", F.col("url_key")).agg(F.max_by(F.struct("record_id", "headers", "digest"), F.struct("ts", "record_id")).alias("gives"))
    asks = ends.select("part", F.col("first_url").alias("url_key"), F.lit(None).cast(latest.schema["gives"].dataType).alias("gives"), F.lit(0).alias("turn"))
    gives = latest.select("part", "url_key", "gives", F.lit(1).alias("turn"))
    earlier = Window.partitionBy("url_key").orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.union(gives).withColumn("carried", F.last("gives", ignorenulls=True).over(earlier)).filter("turn = 0")
    carried, _ = saved(carried.select("part", "url_key", "carried"), "carried")
    found = with_own.join(bounded_broadcast(carried, n, 128), ["part", "url_key"], "left").withColumn("response", F.coalesce("own", "carried"))

    mine = F.struct("headers", "digest")
    matched = _match(mine, F.col("response"))
    outcome = (
        F.when(F.col("response").isNull(), "no_response").when(matched.isNull(), "no_validator").when(matched, "resolved").otherwise("mismatch")
    )
    known = found.withColumn("outcome", outcome).select(
        "record_id", "url_key", F.when(F.col("outcome") == "resolved", F.col("response.record_id")).alias("response_id"), "outcome",
        F.when(F.col("outcome") == "resolved", merged_headers(F.col("headers"), F.col("response.headers"))).otherwise(F.col("headers")).alias("headers"),
    )
    lost = plain.filter(~F.col("full") & (F.col("url_key").isNull() | F.col("ts").isNull()))
    lost = lost.select("record_id", "url_key", F.lit(None).cast(known.schema["response_id"].dataType).alias("response_id"), F.lit("no_response").alias("outcome"), "headers")
    return known.union(lost)


def page_captures(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages``: each page is fetched once in full and then up to four times again.

    A hash of page and visit decides whether a later visit is a new full response with changed content, a revisit by
    entity tag, by date or by digest, or a revisit whose tag belongs to other content.
    """
    number = lambda text: F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")
    visit = F.explode(F.sequence(F.lit(0), number(F.col("page_id").cast("string")) % 5)).alias("visit")
    rows = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("sum"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), visit)
    way = F.when(F.col("visit") == 0, 0).otherwise(number(F.concat_ws("-", "page_id", "visit")) % 6)
    rows = rows.withColumn("way", way)
    changed = F.col("way").isin(1, 4)
    tag = F.concat(F.lit('"'), F.when(changed, F.md5(F.concat_ws("-", "sum", "visit"))).otherwise(F.col("sum")), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("visit"))
    ts = F.col("page_id") * 60 + F.col("visit") * 86_400
    full = F.col("way") < 2
    base = F.create_map(F.lit("Date"), date, F.lit("Server"), F.lit("s"))
    headers = (
        F.when(full, F.map_concat(base, F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), F.lit("day 0"), F.lit("Content-Length"), F.col("size").cast("string"))))
        .when(F.col("way") == 2, F.map_concat(base, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Connection"), F.lit("close"))))
        .when(F.col("way") == 3, F.map_concat(base, F.create_map(F.lit("last-modified"), F.lit("day 0"))))
        .when(F.col("way") == 4, F.map_concat(base, F.create_map(F.lit("ETag"), tag)))
        .otherwise(base)
    )
    return rows.select(
        (F.col("page_id") * 8 + F.col("visit")).alias("record_id"), "url", ts.alias("ts"),
        F.when(full, "response").otherwise("revisit").alias("kind"), headers.alias("headers"), F.col("sum").alias("digest"),
    )
