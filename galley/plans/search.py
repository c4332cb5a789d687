"""The query language of the feed: words and key:value parts, compiled to column predicates."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("zh", "en", "pt", "all")


@dataclass
class Search:
    text: list[str] = field(default_factory=list)
    source: str | None = None
    lang: str | None = None
    topic: str | None = None
    min_cred: float | None = None
    hours: int | None = None


def parse(raw: str | None) -> Search:
    """Parts as source:x lang:zh topic:ai cred:>=60 after:7d "quoted words"; what is no valid part is a word."""
    try:
        parts = shlex.split(raw or "")
    except ValueError:
        parts = (raw or "").split()
    out = Search()
    for part in parts:
        key, colon, value = part.partition(":")
        key, value = key.lower(), value.strip()
        match key if colon else "":
            case "source" if value:
                out.source = value
            case "lang" if value.lower() in LANGS:
                out.lang = value.lower()
            case "topic" if re.fullmatch("[a-z_]{2,24}", value.lower()):
                out.topic = value.lower()
            case "cred" if re.fullmatch(r"(>=?|=)?\d+(\.\d+)?", value):
                out.min_cred = max(0.0, min(100.0, float(value.lstrip(">="))))
            case "after" if m := re.fullmatch(r"(\d+)([hd])", value.lower()):
                out.hours = int(m[1]) * (24 if m[2] == "d" else 1)
            case _:
                out.text.append(part)
    return out


def matching(clusters: DataFrame, items: DataFrame, search: Search) -> DataFrame:
    """The clusters that a search finds; conditions on items become semi joins.

    `clusters` has id, headline, topics, cred, last_ts, updated_ts; `items` has cluster_id,
    title, summary, source_id, lang.
    """
    out = clusters
    if search.min_cred is not None:
        out = out.filter(F.col("cred") >= search.min_cred)
    if search.topic:
        out = out.filter(F.array_contains("topics", search.topic))
    if search.hours is not None:
        now = F.broadcast(clusters.agg(F.max("last_ts").alias("now")))
        out = out.join(now, F.col("last_ts") >= F.col("now") - search.hours * 3600).drop("now")
    want = items.filter("cluster_id is not null")
    if search.source:
        hit = want.filter(F.col("source_id") == search.source).select(F.col("cluster_id").alias("id"))
        out = out.join(hit, "id", "left_semi")
    if search.lang and search.lang != "all":
        hit = want.filter(F.lower(F.substring(F.trim("lang"), 1, 2)) == search.lang).select(F.col("cluster_id").alias("id"))
        out = out.join(hit, "id", "left_semi")
    for word in search.text:
        # special characters are literal: no pattern is built from what the user typed
        low = F.lit(word.lower())
        seen = F.contains(F.lower(F.coalesce("title", F.lit(""))), low) | F.contains(F.lower(F.coalesce("summary", F.lit(""))), low)
        out = out.join(want.filter(seen).select(F.col("cluster_id").alias("id")), "id", "left_semi")
    return out
