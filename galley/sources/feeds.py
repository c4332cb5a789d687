"""Feeds as they arrive: RSS and Atom, JSON and JSONP, list pages, raw bytes; to item rows.

All parsing is in column expressions over a table of raw responses, one row a response.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from galley.functions import text
from galley.functions.dates import clamp_future, parse_time
from galley.operators.textops import _clean_sql, _clean_title_sql
from galley.plans.catalog import query
from galley.sources.snapshots import IT_SQL, items

SUMMARY_CHARS, LIST_LIMIT = 600, 40


_DECLARED = re.compile(rb"encoding=[\"']([\w-]+)[\"']", re.I)


def _decode(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    if named := _DECLARED.search(raw[:300]):
        try:
            return raw.decode(named[1].decode("ascii"), "replace")
        except LookupError:
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        return raw.decode("gb18030")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """Bytes to text: the declared encoding, else UTF-8, else GB18030, else Latin-1. Spark itself decodes no GB18030."""
    return raw.map(_decode)


def tag(block: Column, *names: str) -> Column:
    """The content of the first of the named elements that the block has, without a CDATA wrap."""
    out = F.lit("")
    for n in reversed(names):
        got = F.regexp_extract(block, f"(?is)<{n}\\b[^>]*>(.*?)</{n}>", 1)
        out = F.when(block.rlike(f"(?is)<{n}\\b[^>]*>.*?</{n}>"), got).otherwise(out)
    return F.regexp_replace(out, "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", "$1")


def parse_rss(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per <item> or <entry>: the other columns, ordinal, title, summary, url, published_ts, native_id."""
    rest = [c for c in pages.columns if c != body]
    blocks = pages.select(*rest, F.posexplode(F.regexp_extract_all(F.col(body), F.lit("(?is)<(item|entry)\\b[^>]*>(.*?)</\\1>"), F.lit(2))).alias("ordinal", "block"))
    b = F.col("block")
    link = F.trim(tag(b, "link"))
    href = F.regexp_extract(b, "(?i)<link\\b[^>]*href=[\"']([^\"']+)[\"']", 1)
    url = F.when(link != "", text.clean_text(link)).when(href != "", href).otherwise(text.clean_text(tag(b, "guid", "id")))
    rows = blocks.select(
        *rest, "ordinal", text.clean_title(tag(b, "title")).alias("title"),
        F.substring(text.clean_text(tag(b, "description", "summary", "content:encoded", "content")), 1, SUMMARY_CHARS).alias("summary"),
        url.alias("url"), parse_time(tag(b, "pubDate", "published", "updated", "dc:date", "date")).alias("published_ts"), text.clean_text(tag(b, "guid")).alias("native_id"),
    )
    return rows.filter("title <> ''")


def parse_json(pages: DataFrame, paths: dict[str, str], body: str = "body", rows_at: str = "$") -> DataFrame:
    """One row per object of the array at `rows_at`; `paths` names where title, url, ... stand in it.

    A JSONP wrap is taken off. Rows that are no objects, or have no title, are left out.
    """
    rest = [c for c in pages.columns if c != body]
    plain = F.when(F.ltrim(F.col(body)).rlike("^[\\[{]"), F.col(body)).otherwise(F.regexp_extract(F.col(body), "(?s)[\\{\\[].*[\\}\\]]", 0))
    array = plain if rows_at == "$" else F.get_json_object(plain, rows_at)
    rows = pages.select(*rest, F.posexplode(F.from_json(array, T.ArrayType(T.StringType()))).alias("ordinal", "row")).filter(F.col("row").startswith("{"))
    got = {k: F.get_json_object("row", p if p.startswith("$") else "$." + p) for k, p in paths.items()}
    none = F.lit(None).cast("string")
    out = rows.select(
        *rest, "ordinal", text.clean_title(got.get("title", none)).alias("title"), F.substring(text.clean_text(got.get("summary", none)), 1, SUMMARY_CHARS).alias("summary"),
        F.coalesce(got.get("url", none), F.lit("")).alias("url"), parse_time(got.get("published", none)).alias("published_ts"), F.coalesce(got.get("id", none), F.lit("")).alias("native_id"),
    )
    return out.filter("title <> ''")


def parse_list(pages: DataFrame, pattern: str, base: str, body: str = "body", limit: int = LIST_LIMIT) -> DataFrame:
    """Rows of a list page by a pattern whose groups 1, 2, 3 are url, title and date; each url once."""
    rest = [c for c in pages.columns if c != body]
    groups = F.arrays_zip(*[F.regexp_extract_all(F.col(body), F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "url"), (2, "title"), (3, "date"))])
    rows = pages.select(*rest, F.posexplode(groups).alias("ordinal", "x")).select(*rest, "ordinal", F.trim("x.url").alias("url"), text.clean_title("x.title").alias("title"), F.col("x.date").alias("date"))
    first = rows.filter("title <> ''").withColumn("n", F.row_number().over(Window.partitionBy(*rest, "url").orderBy("ordinal"))).filter("n = 1").drop("n")
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(*rest).orderBy("ordinal"))).filter(F.col("n") <= limit).drop("n")
    full = F.when(F.col("url").startswith("/"), F.concat(F.lit(base.rstrip("/")), "url")).otherwise(F.col("url"))
    return kept.select(*rest, "ordinal", "title", F.lit("").alias("summary"), full.alias("url"), parse_time(F.col("date")).alias("published_ts"), F.lit("").alias("native_id"))


def parse(pages: DataFrame, paths: dict[str, str], pattern: str, base: str = "", body: str = "body", rows_at: str = "$") -> DataFrame:
    """Rows of pages of every kind (column `kind`: rss, json, jsonp, html; null as rss), each by its reader.

    Pages are parted by kind before they are read, so each is scanned by one reader.
    """
    kind = F.coalesce("kind", F.lit("rss"))
    json_, list_ = kind.isin("json", "jsonp"), kind == "html"
    parts = (parse_rss(pages.filter(~json_ & ~list_), body), parse_json(pages.filter(json_), paths, body, rows_at), parse_list(pages.filter(list_), pattern, base, body))
    columns = parts[0].columns
    return parts[0].unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))


def to_items(parsed: DataFrame, fetched: Column) -> DataFrame:
    """Parsed rows (source_id, max_items, ordinal, ...) to items: capped, keyed, each key's first row, times clamped."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("ordinal"))
    capped = parsed.withColumn("n", n).filter((F.coalesce("max_items", F.lit(0)) <= 0) | (F.col("n") <= F.col("max_items")))
    keyed = capped.withColumn("id", text.item_id("source_id", "title"))
    first = keyed.groupBy("id").agg(F.min(F.struct("n", "source_id", "title", "summary", "url", "published_ts")).alias("x")).select("id", "x.*")
    return first.select("id", "source_id", "title", "summary", "url", clamp_future(F.col("published_ts"), fetched).alias("published_ts"), fetched.alias("fetched_ts"))


# ---- the items written as feeds and read back

def _escaped(c: str) -> Column:
    t = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _feed_pages(spark: SparkSession, folder: str, row: Column, head: str, sep: str, tail: str) -> DataFrame:
    """Pages of the items of each source; a source's items are spread over up to 4096 pages."""
    it = items(spark, folder, "title", "url", "summary", "published_ts").filter("title is not null")
    rows = it.select("source_id", F.substring(F.sha1("id"), 1, 3).alias("page"), "id", row.alias("row"))
    lines = F.array_sort(F.collect_list(F.struct("id", "row")))
    return rows.groupBy("source_id", "page").agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["row"]), sep), F.lit(tail)).alias("body"))


_TITLE_SQL = "trim(regexp_replace(translate(title, chr(12288) || chr(160), '  '), '[\\t\\n\\v\\f\\r ]+', ' ', 'g'))"


@query("S03_rss_scan", f"WITH {IT_SQL} SELECT source_id, id AS native_id, coalesce(url, '') = '' AS no_url, published_ts, title, summary FROM (SELECT * EXCLUDE (title, summary), {_clean_title_sql('title')} AS title, substr({_clean_sql('summary')}, 1, {SUMMARY_CHARS}) AS summary FROM it) WHERE title <> ''")
def rss_scan(spark: SparkSession, folder: str) -> DataFrame:
    row = F.concat(F.lit("<item><title><![CDATA["), F.col("title"), F.lit("]]></title><guid>"), F.col("id"), F.lit("</guid>"), F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("<link>"), _escaped("url"), F.lit("</link>"))).otherwise(""),
                   F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("<description><![CDATA["), F.col("summary"), F.lit("]]></description>"))).otherwise(""),
                   F.when(F.col("published_ts").isNotNull(), F.concat(F.lit("<pubDate>"), F.date_format(F.timestamp_seconds("published_ts"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>"))).otherwise(""), F.lit("</item>"))
    got = parse_rss(_feed_pages(spark, folder, row, "<rss><channel>", "\n", "</channel></rss>"))
    return got.select("source_id", "native_id", (F.col("url") == F.col("native_id")).alias("no_url"), "published_ts", "title", "summary")


@query("S04_json_scan", f"WITH {IT_SQL} SELECT source_id, id AS native_id, coalesce(url, '') AS url, published_ts FROM it WHERE title IS NOT NULL")
def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    row = F.to_json(F.struct(F.struct(F.col("id"), F.col("title")).alias("main"), F.col("url").alias("link"), F.col("published_ts").alias("time")))
    pages = _feed_pages(spark, folder, row, 'call({"data": [', ",", "]});")
    got = parse_json(pages, {"title": "main.title", "id": "main.id", "url": "link", "published": "time"}, rows_at="$.data")
    return got.select("source_id", "native_id", "url", "published_ts")


@query("S05_list_scan", f"WITH {IT_SQL} SELECT source_id, 'https://example.org/a/' || id AS url FROM it WHERE title IS NOT NULL")
def list_scan(spark: SparkSession, folder: str) -> DataFrame:
    row = F.concat(F.lit('<li><a href="/a/'), F.col("id"), F.lit('">'), _escaped("title"), F.lit("</a> <i>2026-03-01</i></li>"))
    pages = _feed_pages(spark, folder, row, "<ul>", "\n", "</ul>")
    got = parse_list(pages, '<a href="([^"]+)">(.*?)</a> <i>([^<]*)</i>', "https://example.org", limit=1_000_000)
    return got.select("source_id", "url")


@query("S08_items_of_feed", f"WITH {IT_SQL}, t AS (SELECT source_id, title, min(id) AS first_id, count(*) AS n FROM it WHERE title IS NOT NULL GROUP BY 1, 2) SELECT source_id, count(*) AS n_items, sum(n)::BIGINT AS n_delivered FROM t GROUP BY 1")
def items_of_feed(spark: SparkSession, folder: str) -> DataFrame:
    """One source's repeats of a title make one item."""
    it = items(spark, folder, "title", "url", "summary", "published_ts").filter("title is not null")
    parsed = it.select("source_id", F.lit(0).alias("max_items"), F.col("id").alias("ordinal"), "title", "summary", "url", "published_ts")
    made = to_items(parsed, F.lit(2_000_000_000).cast("bigint")).groupBy("source_id").agg(F.count("*").alias("n_items"))
    return made.join(it.groupBy("source_id").agg(F.count("*").alias("n_delivered")), "source_id")
