"""Web-archive records: not-modified revisits resolved to the response they repeat.

Each revisit is joined, as of its time, to the latest full response (status
200) of the same canonical URL captured strictly before it.  Its validators
are checked against that response: entity tags by weak comparison if it has
one, else the modification date.  On a match the response's payload is taken
and the header fields a not-modified answer may renew are laid over the
response's own.

``state``: 'resolved'; 'mismatch' (a validator differs); 'unvalidated' (the
revisit has no validator, or the response lacks its counterpart); 'orphan'
(no earlier full response).  Only a resolved revisit has payload and headers.

The join takes two steps.  A window over both kinds without their payloads,
hashed by canonical URL and sorted by time, with running state of one row,
names each revisit's response; however often one URL is captured, only narrow
rows of it meet in a task.  Then responses come to their revisits by URL, time
and id, so that payloads are spread by capture and move once.  Revisits
without URL or time can't match and take no part in either.

Nulls: a record with null URL or time is an orphan if a revisit and never a
match; null headers are no headers; a null or empty validator is none; an
empty or very long payload is a payload.  Of responses captured at one time
the one with the greatest record id counts; those alike in URL, time and id are
one, whichever comes first.  Repeated revisits each get a row.
Empty input gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, table

#: Fields that a 304 answer renews in what is stored (RFC 9110 section 15.4.5, RFC 9111 section 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)="


def canonical_url(url: Column) -> Column:
    """http(s) alike, host in lower case without www., m. and default port, no fragment, no tracking parameters, the others sorted, no final slash."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _tag(etag: Column) -> Column:
    """An entity tag for weak comparison; null for none."""
    return F.nullif(F.regexp_replace(F.trim(etag), r"^W/", ""), F.lit(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records``: record_id, url, ts (number), kind ('response', 'revisit'), status, headers (map with lower-case names), payload."""
    r = Columns(records, ["record_id", "url", "ts", "kind", "status", "headers", "payload"]).only()
    r = r.withColumns({"canonical": canonical_url(F.col("url")), "is_full": F.when(F.col("kind") == "response", 1).otherwise(0)})
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    responses = r.filter("kind = 'response' and status = 200").filter(placed)
    revisits = r.filter("kind = 'revisit'")
    key = lambda i: F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit(""))  # noqa: E731 - never null: grouped and joined by plain equality, payloads move once
    narrow = ["record_id", "canonical", "ts", "is_full", "headers"]
    before = Window.partitionBy("canonical").orderBy("ts", "is_full", F.col("record_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    named = (responses.select(*narrow).withColumn("headers", F.lit(None).cast("map<string,string>")).unionByName(revisits.filter(placed).select(*narrow))
             .withColumn("source", F.last(F.when(F.col("is_full") == 1, F.struct("ts", "record_id")), ignorenulls=True).over(before)).filter("is_full = 0"))
    every = named.unionByName(revisits.filter(~placed).select(*narrow).withColumn("source", F.lit(None).cast(named.schema["source"].dataType)))
    full = responses.groupBy(F.col("canonical").alias("fc"), F.col("ts").alias("ft"), key(F.col("record_id")).alias("fr")).agg(F.first(F.struct("record_id", "headers", "payload")).alias("full"))
    wanted = every.withColumns({"fc": F.col("canonical"), "ft": F.col("source.ts"), "fr": F.when(F.col("source").isNotNull(), key(F.col("source.record_id")))}).drop("source")
    found = wanted.join(full, ["fc", "ft", "fr"], "left").drop("fc", "ft", "fr")
    old = F.coalesce(F.col("full.headers"), F.create_map().cast("map<string,string>"))
    new = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    field = lambda m, n: F.try_element_at(m, F.lit(n))
    tag, date = _tag(field(new, "etag")), F.nullif(field(new, "last-modified"), F.lit(""))
    counterpart = F.when(tag.isNotNull(), _tag(field(old, "etag"))).otherwise(F.nullif(field(old, "last-modified"), F.lit("")))
    state = (F.when(F.col("full").isNull(), "orphan").when(counterpart.isNull() | F.coalesce(tag, date).isNull(), "unvalidated")
             .when(counterpart == F.coalesce(tag, date), "resolved").otherwise("mismatch"))
    renewed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    lines = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
    ok = F.col("state") == "resolved"
    return found.withColumn("state", state).select(
        "record_id", "canonical", "ts", "state", F.col("full.record_id").alias("source_id"),
        F.when(ok, lines).alias("headers"), F.when(ok, F.col("full.payload")).alias("payload"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records of the table pages: of each page a full response and a revisit.

    The revisit of page p asks for its URL with a fragment and a tracking
    parameter more, and p % 5 settles its validator: the entity tag itself, in
    weak form, another tag, the modification date alone, or none.  A revisit
    with p % 7 = 0 comes before its response.
    """
    p = Columns(pages, ["page_id", "url", "html"]).only()
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), F.col("page_id") % 365)
    case, ts = F.col("page_id") % 5, F.col("page_id") * 10
    response = p.select((F.col("page_id") * 2).alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
                        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.concat(F.lit("t"), ts)).alias("headers"),
                        F.col("html").alias("payload"))
    asked = F.when(case == 0, tag).when(case == 1, F.concat(F.lit("W/"), tag)).when(case == 2, F.lit('"other"'))
    later = F.when(F.col("page_id") % 7 == 0, ts - 5).otherwise(ts + 5)
    revisit = p.select((F.col("page_id") * 2 + 1).alias("record_id"),
                       F.concat("url", F.when(F.col("url").contains("#"), "").otherwise(F.concat(F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=again#top")))).alias("url"),
                       later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
                       F.create_map(F.lit("etag"), asked, F.lit("last-modified"), F.when(case < 4, date), F.lit("date"), F.concat(F.lit("t"), later), F.lit("content-length"), F.lit("0")).alias("headers"),
                       F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


def op10_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))


_BARE = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
SQL = rf"""
WITH p AS (SELECT page_id, url, html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (page_id % 365) AS day, page_id % 5 AS c, page_id * 10 AS t0,
    CASE WHEN page_id % 7 = 0 THEN page_id * 10 - 5 ELSE page_id * 10 + 5 END AS t1 FROM pages),
r AS (SELECT page_id * 2 AS record_id, url, t0 AS ts, 1 AS is_full, tag, day, html FROM p UNION ALL
  SELECT page_id * 2 + 1, url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_source=again#top' ELSE '?utm_source=again#top' END, t1, 0,
    CASE c WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 2 THEN '"other"' END, CASE WHEN c < 4 THEN day END, NULL FROM p),
b AS (SELECT *, {_BARE} AS bare FROM r),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS kept FROM b),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM q),
f AS (SELECT a.record_id, a.canonical, a.ts, regexp_replace(a.tag, '^W/', '') AS tag, a.day, b.record_id AS source_id, b.tag AS btag, b.day AS bday, b.html, b.ts AS bts
  FROM (SELECT * FROM k WHERE is_full = 0) a LEFT JOIN (SELECT * FROM k WHERE is_full = 1) b ON a.canonical = b.canonical AND b.ts < a.ts
  QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY b.ts DESC NULLS LAST, b.record_id DESC) = 1),
s AS (SELECT *, CASE WHEN source_id IS NULL THEN 'orphan' WHEN coalesce(tag, day) IS NULL THEN 'unvalidated' WHEN coalesce(tag, day) = CASE WHEN tag IS NULL THEN bday ELSE btag END THEN 'resolved' ELSE 'mismatch' END AS state FROM f)
SELECT record_id, canonical, ts, state, source_id, CASE WHEN state = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: t' || ts || chr(10) || 'etag: '
    || CASE WHEN (record_id // 2) % 5 = 1 THEN 'W/' || tag ELSE coalesce(tag, btag) END || chr(10) || 'last-modified: ' || coalesce(day, bday) END AS headers,
  CASE WHEN state = 'resolved' THEN html END AS payload FROM s"""

QUERIES = {"op10_warc_revisit": op10_warc_revisit}
ORACLE_SQL = {"op10_warc_revisit": SQL}
