"""Resolution of not-modified revisits in web archives (operator 4).

A revisit record says that a page had not changed; its content is in an earlier full response. Each
revisit is matched, as of its time, with the latest earlier full response of the same canonical URL.
If the validators agree (entity tags by weak comparison, else modification times), the response's
headers are taken, overlaid with those that a 304 answer may update; otherwise nothing is merged.

The as-of join shuffles no payloads: records are narrow until the sources are known. Times are matched,
not records: of the responses of a URL at one second one counts, and its revisits at one second have
the same source. It has two levels, so that a URL with very many captures is no single group: within
each span of time by a window, over two rows a second at most, and from one span to the next by the
last response of each span.

Defined results, in ``status``: ``resolved``; ``mismatch`` (validators differ); ``unvalidated`` (no validator
on both sides); ``missing`` (no earlier response, or no URL or time, which match nothing: null, or a URL
whose canonical form is empty). Of responses at the same time the one of the greatest ``record_id``
counts; a response at the revisit's own time is not earlier. Null headers count as none; header names
are compared in lower case, the last of equal names wins. Repeated revisits are resolved alike, each in
its own row; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that a 304 answer may update in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that do not name another page.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"
#: Seconds of a span of the two-level join.
SPAN = 86_400


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, ``www.``, default port, closing slashes and tracking parameters; host
    in lower case, parameters in order; null where nothing is left."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    base = F.regexp_extract(rest, r"^([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(base, r"^([^/]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(base, r"^[^/]*(/[\s\S]*)$", 1), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?([\s\S]*)$", 1), "&", -1), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    return F.nullif(F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))), F.lit(""))


def _lowered(headers: Column) -> Column:
    """Map with lower-case names; of equal names the last one stays."""
    named = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    kept = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later.key == e.key))
    return F.coalesce(F.map_from_entries(kept), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged_headers(stored: Column, update: Column) -> Column:
    new = F.map_filter(update, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Each revisit of ``records`` (``record_id, url, ts`` in seconds, ``kind`` response or revisit,
    ``headers`` map) with ``source_id, source_ts, status, merged``."""
    h = _lowered(F.col("headers"))
    keyed = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", F.col("kind") == "revisit", h.alias("headers"))
    keyed = keyed.toDF("record_id", "canonical", "ts", "revisit", "headers").withColumn("span", F.floor(F.col("ts") / span))
    lost = keyed.where(F.col("canonical").isNull() | F.col("ts").isNull()).where("revisit")
    whole = keyed.where(F.col("canonical").isNotNull() & F.col("ts").isNotNull())
    asks = whole.where("revisit")
    full = whole.where("NOT revisit").groupBy("canonical", "span", "ts").agg(F.max_by(F.struct("ts", "record_id", "headers"), "record_id").alias("full"))
    # The last response of each span; maps are no part of the order.
    last = full.groupBy("canonical", "span").agg(F.max_by("full", "ts").alias("last"))
    times = asks.select("canonical", "span", "ts").distinct()
    marks = times.select("canonical", "span").distinct().join(last, ["canonical", "span"], "full_outer")
    before = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("canonical", "span", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # At equal times a revisit comes first: only strictly earlier responses count.
    both = full.withColumn("asked", F.lit(False)).unionByName(times.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    within = Window.partitionBy("canonical", "span").orderBy("ts", F.col("asked").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("seen", F.last("full", ignorenulls=True).over(within)).where("asked")
    sources = seen.join(carried, ["canonical", "span"], "left").select("canonical", "ts", F.coalesce("seen", "carried").alias("source"))
    found = asks.join(sources, ["canonical", "ts"], "left")
    none = lost.withColumn("source", F.lit(None).cast(found.schema["source"].dataType))
    columns = ["record_id", "canonical", "ts", "headers", "source"]
    every = found.select(*columns).unionByName(none.select(*columns))
    return every.select("record_id", "canonical", "ts", F.col("source.record_id").alias("source_id"), F.col("source.ts").alias("source_ts"), _status().alias("status"), F.when(_status() == "resolved", merged_headers(F.col("source.headers"), F.col("headers"))).alias("merged"))


def _status() -> Column:
    tag = lambda c: F.regexp_replace(F.element_at(F.col(c), "etag"), "^W/", "")
    day = lambda c: F.element_at(F.col(c), "last-modified")
    mine, theirs = ((tag("headers"), tag("source.headers")), (day("headers"), day("source.headers")))
    agree = F.when(mine[0].isNotNull() & mine[1].isNotNull(), mine[0] == mine[1]).when(theirs[0].isNotNull() & theirs[1].isNotNull(), theirs[0] == theirs[1])
    return F.when(F.col("source").isNull(), "missing").when(agree.isNull(), "unvalidated").when(agree, "resolved").otherwise("mismatch")


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` with the payload of each resolved revisit's source."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("source_id"), F.col(payload).alias("__payload"))
    body = F.when(F.col("status") == "resolved", F.col("__payload")).alias(payload)
    return resolved.join(bodies, "source_id", "left").select(*(F.col(c) for c in resolved.columns), body)


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl over ``pages`` (``page_id, url, html``): each page is fetched at minute
    ``page_id``, and asked for again some hours later, with its own validators, and found unchanged.
    Every tenth page has no entity tag."""
    body = F.coalesce("html", F.lit(""))
    ts = F.col("page_id") * 60
    tagged = F.col("page_id") % 10 != 0
    tag = F.when(tagged, F.md5(body.cast("binary")))
    later = (ts + 1 + F.pmod(F.col("page_id"), F.lit(5)) * 40_000).cast("long")
    pairs = lambda *p: F.map_filter(F.map_from_entries(F.array(*(F.struct(F.lit(k), v.cast("string")) for k, v in p))), lambda k, v: v.isNotNull())
    first = pairs(("Content-Type", F.lit("text/html")), ("Content-Length", F.octet_length(body)), ("ETag", tag), ("Last-Modified", ts), ("Date", ts), ("Server", F.lit("origin")))
    again = pairs(("Content-Length", F.lit(0)), ("Connection", F.lit("close")), ("ETag", F.concat(F.lit("W/"), tag)), ("Last-Modified", ts), ("Date", later), ("Cache-Control", F.concat(F.lit("max-age="), F.pmod(F.col("page_id"), F.lit(7)))))
    record = lambda kind, at, headers: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("ts"), headers.alias("headers"))
    both = F.explode(F.array(record("response", ts, first), record("revisit", later, again)))
    return pages.select(F.col("page_id").alias("record_id"), "url", both.alias("r")).select("record_id", "url", "r.*")


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's revisit: its source, and what the resolved record consists of."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    digests = pages.select(F.col("page_id").alias("source_id"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("__sha"))
    found = resolve(crawl(pages)).join(digests, "source_id", "left")
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat_ws("=", e.key, e.value))), ";")
    resolved = F.col("status") == "resolved"
    return found.select(F.col("record_id").alias("page_id"), "canonical", "ts", F.col("source_id").alias("source_page_id"), "source_ts", "status", F.when(resolved, F.col("__sha")).alias("payload_sha256"), F.when(resolved, headers).alias("headers"))


ORACLE_SQL = {
    "op4_revisits": rf"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, page_id * 60 AS ts, page_id * 60 + 1 + (page_id % 5) * 40000 AS later,
  regexp_replace(regexp_replace(url, '#[\s\S]*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
cut AS (SELECT *, regexp_extract(rest, '^([^?]*)', 1) AS base, list_sort(list_filter(string_split(regexp_extract(rest, '\?([\s\S]*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params FROM p),
c AS (SELECT page_id, ts, later, body, CASE WHEN page_id % 10 <> 0 THEN md5(body) END AS tag,
  nullif(regexp_replace(regexp_replace(lower(regexp_extract(base, '^([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(base, '^[^/]*(/[\s\S]*)$', 1), '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END, '') AS canonical FROM cut),
j AS (SELECT r.page_id, r.canonical, r.later, r.tag, r.ts AS own, f.page_id AS source, f.ts AS source_ts, f.tag AS source_tag, f.body,
  CASE WHEN f.page_id IS NULL THEN 'missing' WHEN r.tag IS NOT NULL AND f.tag IS NOT NULL THEN CASE WHEN r.tag = f.tag THEN 'resolved' ELSE 'mismatch' END WHEN r.ts = f.ts THEN 'resolved' ELSE 'mismatch' END AS status
  FROM c r ASOF LEFT JOIN c f ON r.canonical = f.canonical AND r.later > f.ts)
SELECT page_id, canonical, CAST(later AS BIGINT) AS ts, source AS source_page_id, CAST(source_ts AS BIGINT) AS source_ts, status, CASE WHEN status = 'resolved' THEN sha256(body) END AS payload_sha256,
CASE WHEN status = 'resolved' THEN 'cache-control=max-age=' || (page_id % 7) || ';content-length=' || strlen(body) || ';content-type=text/html;date=' || later || coalesce(';etag=' || CASE WHEN tag IS NOT NULL THEN 'W/' || tag ELSE source_tag END, '') || ';last-modified=' || own || ';server=origin' END AS headers FROM j"""
}
