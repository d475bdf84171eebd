"""Resolution of not-modified revisit records.

A revisit takes the payload of the latest strictly earlier full response (status
200) with the same canonical URL, if its validators agree, and the response's
headers with those that a 304 may renew. The as-of join works on slim rows in two
levels: the last response of each stretch of time of a URL, carried over the
stretches, then the rows inside one stretch. So one URL with any share of all
captures is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions

#: Headers that a 304 response may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell resources apart.
TRACKING = "utm_[a-z]*|ref|fbclid|gclid"
#: Stands for a null time: before every other.
NO_TIME = -(2**62)


def canonical_url(url: Column) -> Column:
    """Scheme, www., default ports, fragments, tracking parameters and a last slash dropped; host in lower case; null is empty."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    rest = F.substr(u, F.length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(rest, f"([?&])(({TRACKING})=[^&]*(&|$))+", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "[?&]+$", ""), "/$", "")
    return F.concat(host, rest)


def latest_earlier(records: DataFrame, stretches: int | None = None) -> DataFrame:
    """record_id of each record and ``found``: struct of the latest strictly earlier full response of its URL.

    records: record_id, url (canonical), captured (long), full (boolean), info.
    Equal times: not earlier. Of responses at one time the largest record_id.
    """
    spark = records.sparkSession
    n = stretches or 4 * partitions(spark)
    rows = stretched(records, n)
    mine = F.struct("captured", "record_id", "info")
    lasts = rows.where("full").groupBy("url", "stretch").agg(F.max(mine).alias("last"))
    # at most one row for each stretch of a URL; a stretch takes what earlier ones left
    spots = rows.select("url", "stretch").distinct().join(lasts, ["url", "stretch"], "left")
    before = Window.partitionBy("url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.withColumn("carry", F.last("last", ignorenulls=True).over(before)).select("url", "stretch", "carry")
    # only strictly earlier: the range of a row ends before its time
    inside = Window.partitionBy("url", "stretch").orderBy("captured").rangeBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("here", F.max(F.when(F.col("full"), mine)).over(inside))
    found = own.join(carried, ["url", "stretch"], "left").select("record_id", F.coalesce("here", "carry").alias("found"))
    return found.groupBy("record_id").agg(F.max("found").alias("found"))  # a repeated record finds what its likes find


def stretched(records: DataFrame, n: int) -> DataFrame:
    """``records`` with the number of their stretch of time, which never falls as ``captured`` grows.

    The n stretches part what lies between the first and last hundredth of the known
    times; one more on either side takes the rest, so that null or wrong times don't widen them.
    """
    known = F.when(F.col("captured") > NO_TIME, F.col("captured"))
    low, high = records.agg(F.percentile_approx(known, [0.01, 0.99]).alias("span")).first().span or (0, 0)
    width = max(1, -(-(high - low + 1) // n))
    at = F.floor((F.col("captured") - low) / width)
    return records.withColumn("stretch", F.least(F.greatest(at, F.lit(-1)), F.lit(n)).cast("int"))


def resolve(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record with its outcome, the response it rests on, merged headers and payload.

    records: record_id (long; rows that repeat one stay rows), url, captured (long), status (int), headers
    (map of lower-case names), payload. Records of status 304 are revisits.
    ``outcome``: full, resolved, changed (a validator disagrees) or unresolved (no
    earlier response). Validators: etag (weak prefix ignored), else
    last-modified; one that either side lacks agrees. Full records are their own
    source; other columns aren't carried. A null time is before all others.
    """
    r = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"), F.coalesce(F.col("captured").cast("long"), F.lit(NO_TIME)).alias("captured"),
        F.coalesce("status", F.lit(200)).alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload",
    )
    slim = r.select("record_id", "url", "captured", (F.col("status") == 200).alias("full"), F.to_json("headers").alias("info"))
    joined = r.drop("payload").join(latest_earlier(slim), "record_id")
    theirs = F.from_json("found.info", "map<string,string>")
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    same = F.coalesce(tag(F.col("headers")) == tag(theirs), F.element_at("headers", "last-modified") == F.element_at(theirs, "last-modified"), F.lit(True))
    revisit = F.col("status") == 304
    outcome = F.when(~revisit, "full").when(F.col("found").isNull(), "unresolved").when(same, "resolved").otherwise("changed")
    renewed = F.map_filter("headers", lambda k, _: k.isin(*RENEWED))
    kept = F.map_filter(theirs, lambda k, _: ~F.map_contains_key(renewed, k))
    out = joined.withColumn("outcome", outcome).select(
        "record_id", "url", "captured", "outcome",
        F.when(F.col("outcome") == "full", F.col("record_id")).when(F.col("outcome") == "resolved", F.col("found.record_id")).alias("source_id"),
        F.when(F.col("outcome") == "resolved", F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"),
    )
    if not with_payload:
        return out
    # records without a source are dealt out by their own id, not by one null
    key = F.when(F.col("source_id").isNotNull(), F.concat(F.lit("s"), F.col("source_id").cast("string"))).otherwise(F.concat(F.lit("r"), F.col("record_id").cast("string")))
    bodies = r.groupBy("record_id").agg(F.max("payload").alias("payload")).select(F.concat(F.lit("s"), F.col("record_id").cast("string")).alias("__source"), "payload")
    return out.withColumn("__source", key).join(bodies, "__source", "left").drop("__source")


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl that asks for each page twice at one time: a 304 that names the page's etag, and the full answer.

    Record ids are 2 * page_id for the revisit, one more for the response.
    """
    etag = F.concat(F.lit('"'), F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), F.lit('"'))
    both = pages.select("page_id", "url", "html", etag.alias("etag"), F.explode(F.array(F.lit(304), F.lit(200))).alias("status"))
    plain = F.create_map(F.lit("etag"), F.col("etag"), F.lit("content-type"), F.lit("text/html"))
    fresh = F.create_map(F.lit("etag"), F.col("etag"), F.lit("date"), F.col("page_id").cast("string"), F.lit("content-length"), F.lit("0"))
    return both.select(
        (2 * F.col("page_id") + (F.col("status") == 200).cast("long")).alias("record_id"), "url", F.col("page_id").alias("captured"), "status",
        F.when(F.col("status") == 200, plain).otherwise(fresh).alias("headers"), F.when(F.col("status") == 200, F.col("html")).alias("payload"),
    )
