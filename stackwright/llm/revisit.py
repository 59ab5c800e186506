"""WARC revisits that say "not modified": the response each stands for.

A revisit record (a 304 answer) repeats no payload. It is resolved by an as-of join on the canonical URL to the latest
earlier full response (type ``response``, status 200), if their validators agree: entity tags decide where both have
one (compared weakly), else Last-Modified dates where both have one. Header fields that a 304 may update (RFC 9110,
15.4.5) then replace those of the response; all others stay as stored.

Records are dealt out by range of (URL, time, record), so a URL with a third of all records spans many tasks. Each task
looks back within its range; what a range can't see is carried over as the last response of each (URL, range), one row
for each. Payloads take no part: only locators and header fields move.

Outcomes: ``resolved``, ``validator_mismatch`` (the response is named, headers are the revisit's), ``no_validator``
(neither kind on both sides) and ``no_earlier_response`` (also for a null URL or time). "Earlier" is by (date,
record_id), so of records of one second the smaller record_id is earlier. Repeated rows are resolved each; null headers
count as none. No records: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fields that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, www and default port; path without final slashes; other parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    for pattern in (r"^[^@]*@", r":(80|443)$", r"^www[0-9]*\.", r"\.$"):
        host = F.regexp_replace(host, pattern, "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    given = F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _value(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def _plain(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def merged_headers(stored: Column, update: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """``stored`` with its fields replaced by the permitted ones of ``update``, sorted by name and value."""
    new = F.filter(update, lambda h: h["name"].isin(*permitted))
    names = F.transform(new, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), new))


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, outcome, response_id and headers.

    ``records``: record_id long, url string, date long (seconds), type string, status int, headers
    array<struct<name, value>>; further columns are ignored.
    """
    empty = F.array().cast("array<struct<name:string,value:string>>")
    named = F.transform(F.coalesce("headers", empty), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    chosen = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url"), F.col("date").cast("long").alias("date"),
        ((F.col("type") == "response") & (F.col("status") == 200)).alias("full"), (F.col("type") == "revisit").alias("revisit"), F.array_sort(named).alias("headers"),
    ).filter("full OR revisit")
    dated = F.col("url").isNotNull() & F.col("date").isNotNull()
    dealt = chosen.filter(dated).repartitionByRange("url", "date", "record_id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt)
    response = F.when(F.col("full"), F.struct("date", "record_id", "headers"))
    back = Window.partitionBy("part", "url").orderBy("date", "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(response, ignorenulls=True).over(back)).filter("revisit").drop("full", "revisit")
    lasts = dealt.groupBy(F.col("url").alias("_url"), F.col("part").alias("_part")).agg(F.max(response).alias("last"))
    parts_before = Window.partitionBy("_url").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(parts_before)).filter("carried IS NOT NULL").drop("last")
    found = near.join(carried, (F.col("url") == F.col("_url")) & (F.col("part") == F.col("_part")), "left").withColumn("found", F.coalesce("near", "carried"))
    undated = chosen.filter(~dated).filter("revisit").select("record_id", "url", "headers", F.lit(None).cast("struct<date:bigint,record_id:bigint,headers:array<struct<name:string,value:string>>>").alias("found"))
    both = found.select("record_id", "url", "headers", "found").unionByName(undated)
    etag, stored_etag = _value(F.col("headers"), "etag"), _value(F.col("found.headers"), "etag")
    changed, stored_changed = _value(F.col("headers"), "last-modified"), _value(F.col("found.headers"), "last-modified")
    outcome = (
        F.when(F.col("found").isNull(), "no_earlier_response")
        .when(etag.isNotNull() & stored_etag.isNotNull(), F.when(_plain(etag) == _plain(stored_etag), "resolved").otherwise("validator_mismatch"))
        .when(changed.isNotNull() & stored_changed.isNotNull(), F.when(changed == stored_changed, "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )
    told = both.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome") == "resolved", merged_headers(F.col("found.headers"), F.col("headers"), permitted)).otherwise(F.col("headers"))
    return told.select("record_id", F.col("url").alias("canonical_url"), "outcome", F.col("found.record_id").alias("response_id"), headers.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two captures of each page, as the table has no headers: a full response, and a later 304 answer.

    Times and validators follow from page_id: of five 304 answers one has a stale entity tag, one a weak one, one only a
    date, one neither and one the same tag; every seventh response has no tag.
    """
    at = F.pmod(F.col("page_id") * 37, F.lit(100000))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 16), F.lit('"'))

    def field(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    def present(*fields: Column) -> Column:
        return F.filter(F.array(*fields), lambda h: h["value"].isNotNull())

    kind = F.col("page_id") % 5
    sent = F.when(kind == 0, '"stale"').when(kind == 1, F.concat(F.lit("W/"), tag)).when(kind == 4, tag)
    base = pages.select("page_id", "url", at.alias("at"), tag.alias("tag"), sent.alias("sent"), kind.alias("kind"))
    responses = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("date"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        present(field("Content-Type", F.lit("text/html")), field("ETag", F.when(F.col("page_id") % 7 != 0, F.col("tag"))), field("Last-Modified", F.col("at")), field("Cache-Control", F.lit("no-cache"))).alias("headers"),
    )
    revisits = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("at") + 50000).alias("date"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        present(field("ETag", F.col("sent")), field("Last-Modified", F.when(F.col("kind") == 2, F.col("at"))), field("Cache-Control", F.lit("max-age=600")), field("Content-Length", F.lit("0"))).alias("headers"),
    )
    return responses.unionByName(revisits)


def page_revisits(pages: DataFrame) -> DataFrame:
    """resolve_revisits() of records_of_pages(), headers as lines."""
    found = resolve_revisits(records_of_pages(pages))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", "canonical_url", "outcome", "response_id", lines.alias("headers"))


#: The same rows as page_revisits() over table pages.
SQL = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS bare,
                  ((page_id * 37) % 100000 + 100000) % 100000 AS secs, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
c AS (SELECT page_id, secs, tag, page_id % 5 AS kind,
             regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', ''), '\.$', '')
             || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
             list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
                                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) AS params FROM b),
u AS (SELECT page_id, secs, tag, kind, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM c),
res AS (SELECT page_id * 2 AS rid, url, secs AS d, CASE WHEN page_id % 7 <> 0 THEN tag END AS etag, secs AS lm FROM u),
rev AS (SELECT page_id * 2 + 1 AS rid, url, secs + 50000 AS d, CASE kind WHEN 0 THEN '"stale"' WHEN 1 THEN 'W/' || tag WHEN 4 THEN tag END AS etag,
               CASE WHEN kind = 2 THEN secs END AS lm FROM u),
hit AS (SELECT rev.rid, arg_max(res.rid, (res.d, res.rid)) AS response FROM rev JOIN res ON rev.url = res.url AND (res.d, res.rid) < (rev.d, rev.rid) GROUP BY rev.rid),
j AS (SELECT rev.*, res.rid AS response, res.etag AS setag, res.lm AS slm,
             CASE WHEN res.rid IS NULL THEN 'no_earlier_response'
                  WHEN rev.etag IS NOT NULL AND res.etag IS NOT NULL
                  THEN CASE WHEN regexp_replace(rev.etag, '^W/', '') = res.etag THEN 'resolved' ELSE 'validator_mismatch' END
                  WHEN rev.lm IS NOT NULL THEN CASE WHEN rev.lm = res.lm THEN 'resolved' ELSE 'validator_mismatch' END
                  ELSE 'no_validator' END AS outcome
      FROM rev LEFT JOIN hit ON hit.rid = rev.rid LEFT JOIN res ON res.rid = hit.response)
SELECT rid AS record_id, url AS canonical_url, outcome, response AS response_id,
       CASE WHEN outcome = 'resolved'
            THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || coalesce(chr(10) || 'etag: ' || coalesce(etag, setag), '')
                 || chr(10) || 'last-modified: ' || coalesce(lm, slm)
            ELSE 'cache-control: max-age=600' || chr(10) || 'content-length: 0' || coalesce(chr(10) || 'etag: ' || etag, '')
                 || coalesce(chr(10) || 'last-modified: ' || lm, '') END AS headers
FROM j
"""
