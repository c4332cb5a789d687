"""Chained and dictionary joins, phrase search, blocking, as-of joins, sessions, formatted summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import features, text
from galley.operators.clustering import _SETS, WINDOW_DAYS, gram_classes
from galley.operators.content import _lexicon_sql
from galley.operators.textops import titled
from galley.plans.catalog import query
from galley.session import materialize
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes, sources
from galley.sources.tables import table


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str, width: int = 86_400) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time.

    No range join: both sides go through a window over key and stretch of time, so a key with
    very many rows is spread; what a stretch inherits from earlier ones comes from a table of
    one row per key and stretch. On equal times the right row counts. One right row per key and time.
    """
    cols = [c for c in left.columns if c not in (by, ts)]
    stretch = F.floor(F.col(ts) / width)
    a = left.select(by, ts, F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.select(by, ts, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    last = F.last("_value", ignorenulls=True).over(Window.partitionBy(by, "_s").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0))
    seen = a.unionByName(b).withColumn("_s", stretch).withColumn("_got", last).filter("_side = 1")
    ends = right.filter(F.col(value).isNotNull()).groupBy(by, stretch.alias("_s")).agg(F.max(F.struct(ts, F.col(value).alias("v")))["v"].alias("_end"))
    needed = seen.select(by, "_s").distinct().join(ends, [by, "_s"], "full")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    inherited = needed.select(by, "_s", before.alias("_before"))
    return seen.join(inherited, [by, "_s"], "left").select(by, ts, "_row.*", F.coalesce("_got", "_before").alias(value))


def words(c: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def has_phrase(c: Column, phrase: str) -> Column:
    """Whether the words of the phrase stand next to each other in the text."""
    wanted = " ".join(phrase.lower().split())
    return F.contains(F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")), F.lit(f" {wanted} "))


@query("J03_left_chain", f"WITH {IT_SQL}, {PR_SQL} SELECT s.id, (SELECT count(*) FROM it WHERE it.source_id = s.id) AS n_items, (SELECT count(*) FROM pr WHERE pr.source_id = s.id) AS n_probes FROM sources s")
def left_chain(spark: SparkSession, folder: str) -> DataFrame:
    a = items(spark, folder).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_items"))
    b = probes(spark, folder).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_probes"))
    return sources(spark, folder).select("id").join(a, "id", "left").join(b, "id", "left").fillna(0)


@query("J05_five_way", f"WITH {IT_SQL}, {CL_SQL}, {PR_SQL}, t AS (SELECT id, unnest(list_distinct(topics)) AS topic FROM cl), o AS (SELECT DISTINCT source_id FROM pr WHERE verdict = 'healthy') SELECT t.topic, s.source_role AS role, count(*) AS n, count(DISTINCT it.cluster_id) AS n_clusters FROM it JOIN cl ON cl.id = it.cluster_id JOIN t ON t.id = cl.id JOIN sources s ON s.id = it.source_id JOIN o ON o.source_id = s.id GROUP BY 1, 2")
def five_way(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id").filter("cluster_id is not null")
    so = sources(spark, folder).select(F.col("id").alias("source_id"), F.col("source_role").alias("role"))
    healthy = probes(spark, folder).filter("verdict = 'healthy'").select("source_id").distinct()
    topics = clusters(spark, folder, "topics").select(F.col("id").alias("cluster_id"), F.explode(F.array_distinct("topics")).alias("topic"))
    # items per cluster and role first: topics multiply few rows
    per = it.join(so, "source_id").join(healthy, "source_id", "left_semi").groupBy("cluster_id", "role").agg(F.count("*").alias("k"))
    return per.join(topics, "cluster_id").groupBy("topic", "role").agg(F.sum("k").alias("n"), F.count("*").alias("n_clusters"))


@query("J11_phrase_search", f"WITH {IT_SQL} SELECT id, cluster_id FROM it WHERE contains(' ' || array_to_string(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), ' ') || ' ', ' central bank ') OR contains(' ' || array_to_string(regexp_extract_all(lower(coalesce(summary, '')), '[a-z0-9]+'), ' ') || ' ', ' central bank ')")
def phrase_search(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "title", "summary")
    return it.filter(has_phrase(F.col("title"), "central bank") | has_phrase(F.col("summary"), "central bank")).select("id", "cluster_id")


@query("J12_blocked_pairs", f"WITH {_SETS}, f AS (SELECT gram, count(*) AS df FROM e GROUP BY 1 HAVING count(*) <= 8), p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM e a JOIN f ON f.gram = a.gram JOIN e b ON b.gram = a.gram AND a.id < b.id GROUP BY 1, 2) SELECT a, b, shared FROM p WHERE shared >= 2")
def blocked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that share two rare grams or more: an inverted index joined with itself.

    A gram is rare if at most eight titles have it, so the pairs grow with the titles; the
    similarity join finds the pairs of common grams, exactly.
    """
    sets = gram_classes(spark, folder)[1]
    each = sets.select("id", F.explode("grams").alias("gram"))
    rare = each.groupBy("gram").agg(F.count("*").alias("df")).filter("df <= 8").select("gram")
    few = each.join(rare, "gram", "left_semi")
    a, b = (few.select("gram", F.col("id").alias(k)) for k in "ab")
    return a.join(b, "gram").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter("shared >= 2")


#: Most sets of one stretch of days that a task takes as its own.
STRETCH_ROWS = 20_000


def sharing(sets: DataFrame, days: int) -> DataFrame:
    """(id, n_links, most) of (id, day, keys): how many sets within `days` share keys of weight two or more, and the most shared.

    `keys` are structs of a number k and a weight w. The pairs grow with the square of a stretch
    of days, so they are counted against the inverted index of the stretch and never written.
    """
    base = sets.select("id", "day", F.col("keys.k").alias("k"), F.col("keys.w").alias("w"), F.floor(F.col("day") / days).alias("home"))
    largest = base.groupBy("home").count().agg(F.max("count")).first()[0] or 0
    slices = -(-largest // STRETCH_ROWS) or 1
    # a set meets those of its own stretch and of the two beside it; large stretches are shared out by the set's own slice
    spread = base.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("block", F.explode(F.array(*[F.col("home") + i for i in (-1, 0, 1)])))
    spread = spread.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("own", (F.col("home") == F.col("block")) & (F.col("own") == F.col("slice")))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        mine = np.flatnonzero(b["own"].to_numpy())
        if len(mine):
            n, day, ids = len(b), b["day"].to_numpy(), b["id"].to_numpy()
            sizes = np.array([len(x) for x in b["k"]])
            token = np.unique(np.concatenate(list(b["k"])), return_inverse=True)[1]
            weight = np.concatenate(list(b["w"]))
            order = np.argsort(token, kind="stable")
            place, ends = np.repeat(np.arange(n), sizes)[order], np.cumsum(np.bincount(token))
            first = np.concatenate([[0], np.cumsum(sizes)])
            for i in mine:
                at = slice(first[i], first[i + 1])
                shared = np.zeros(n, np.int64)
                for t, w in zip(token[at], weight[at]):
                    shared[place[ends[t - 1] if t else 0 : ends[t]]] += w
                shared[i] = 0
                shared[np.abs(day - day[i]) > days] = 0
                found = int((shared >= 2).sum())
                if found:
                    out.append((ids[i], found, int(shared.max())))
        return pd.DataFrame(out, columns=["id", "n_links", "most"])

    return spread.filter("size(k) > 0").select("block", "slice", "id", "day", "own", "k", "w").groupBy("block", "slice").applyInPandas(run, "id string, n_links long, most long")


_KEYS_SQL = f"""{_SETS}, f AS (SELECT gram, count(*) AS df FROM e GROUP BY 1 HAVING count(*) <= greatest(8, floor(0.12 * (SELECT count(*) FROM s)))),
h AS (SELECT id, t, {_lexicon_sql('t')} AS events FROM (SELECT id, coalesce(nullif(canonical_title, ''), title, '') AS t FROM it)),
b AS (SELECT s.id, s.day, unnest(list_distinct(regexp_extract_all(h.t, '[A-Z][a-z]+'))) AS subject, h.events FROM s JOIN h ON h.id = s.id WHERE NOT regexp_matches(lower(h.t), '{features.DIGEST.replace("'", "''")}') AND len(regexp_extract_all(h.t, '{features.PARTS}')) < 2),
k AS (SELECT e.id, e.day, 'g:' || e.gram AS k, 1 AS w FROM e JOIN f ON f.gram = e.gram UNION ALL SELECT id, day, 'x:' || subject || ':' || unnest(events), 2 FROM b)"""


@query("J12_blocked_links", f"WITH {_KEYS_SQL}, p AS (SELECT a.id AS a, b.id AS b, sum(a.w) AS shared FROM k a JOIN k b ON b.k = a.k AND a.id <> b.id AND abs(a.day - b.day) <= 3 GROUP BY 1, 2 HAVING sum(a.w) >= 2) SELECT a AS id, count(*) AS n_links, max(shared)::BIGINT AS most FROM p GROUP BY 1")
def blocked_links(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates of each title, counted: others within three days that share two grams, or a named subject and its event.

    A gram counts up to 0.12 of the titles, and up to eight of few; a subject with its event weighs two.
    Round-ups give no such keys.
    """
    sets = materialize(gram_classes(spark, folder)[1], "gram-sets")
    cap = F.broadcast(sets.agg(F.greatest(F.lit(8), F.floor(0.12 * F.count("*"))).alias("cap")))
    # no more grams can be in over 0.12 of the titles than 8.3 times the grams of a mean title: one row
    common = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).join(cap, F.col("df") > F.col("cap")).agg(F.collect_list("gram").alias("common"))
    numbered = lambda x, kind, w: F.transform(x, lambda k: F.struct(F.xxhash64(F.concat(F.lit(kind), k)).alias("k"), F.lit(w).alias("w")))
    subjects = F.array_distinct(F.regexp_extract_all("t", F.lit("[A-Z][a-z]+"), F.lit(0)))
    names = features.bridge_keys(subjects, features.labels(F.col("t"), features.EVENTS))
    named = titled(spark, folder).filter(~features.digest(F.col("t"))).select("id", names.alias("names")).filter("size(names) > 0")
    both = sets.crossJoin(F.broadcast(common)).join(named, "id", "left")
    keys = both.select("id", "day", F.concat(numbered(F.array_except("grams", "common"), "g:", 1), F.coalesce(numbered(F.col("names"), "x:", 2), F.array())).alias("keys"))
    return sharing(keys, WINDOW_DAYS)


@query("J19_owner_pairs", "SELECT a.id AS a, b.id AS b FROM sources a JOIN sources b ON a.owner = b.owner AND a.id < b.id")
def owner_pairs(spark: SparkSession, folder: str) -> DataFrame:
    so = sources(spark, folder).filter("owner is not null")
    a, b = (so.select("owner", F.col("id").alias(k)) for k in "ab")
    return a.join(b, "owner").filter("a < b").select("a", "b")


@query("J20_as_of", f"WITH {IT_SQL}, {PR_SQL}, p AS (SELECT source_id, ts, max(verdict) AS verdict FROM pr GROUP BY 1, 2) SELECT it.id, p.verdict FROM it ASOF LEFT JOIN p ON p.source_id = it.source_id AND it.fetched_ts >= p.ts WHERE it.fetched_ts IS NOT NULL")
def probe_before_item(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with the last probe verdict of its source before it was fetched."""
    left = items(spark, folder).filter("fetched_ts is not null").select("source_id", F.col("fetched_ts").alias("ts"), "id")
    right = probes(spark, folder).groupBy("source_id", "ts").agg(F.max("verdict").alias("verdict"))
    return as_of(left, right, "source_id", "ts", "verdict").select("id", "verdict")


@query("A18_top_share_lines", f"WITH {IT_SQL}, n AS (SELECT source_id, count(*) AS n FROM it GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source_id) AS place, sum(n) OVER () AS total FROM n) SELECT place::INT AS place, printf('%s %.1f%%', source_id, 100.0 * n / total) AS line FROM r WHERE place <= 5")
def top_share_lines(spark: SparkSession, folder: str) -> DataFrame:
    from galley.operators.aggregates import shares

    top = shares(items(spark, folder), "source_id").orderBy(F.desc("n"), "source_id").limit(5)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "source_id"))  # five rows
    return top.select(place.alias("place"), F.format_string("%s %.1f%%", F.col("source_id"), 100 * F.col("share")).alias("line"))


@query("A31_any_member", f"WITH {IT_SQL} SELECT cluster_id, min(id) AS member, count(DISTINCT lang) AS n_labels FROM it WHERE cluster_id IS NOT NULL GROUP BY 1")
def any_member(spark: SparkSession, folder: str) -> DataFrame:
    """One definite member per cluster, where a bare column would give any."""
    return items(spark, folder, "cluster_id", "lang").filter("cluster_id is not null").groupBy("cluster_id").agg(F.min("id").alias("member"), F.countDistinct("lang").alias("n_labels"))


@query("R09_sessions", "WITH s AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, count(DISTINCT g) AS n_sessions, count(*) AS n_events FROM g GROUP BY 1")
def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user: events less than half an hour apart."""
    ev = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = ev.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("P11_focus", f"WITH {CL_SQL} SELECT id FROM cl WHERE topics[1] IN ('ai', 'chips', 'open_source', 'robotics')")
def focus(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(spark, folder, "topics").filter(F.try_element_at("topics", F.lit(1)).isin("ai", "chips", "open_source", "robotics")).select("id")


@query("P16_any_keyword", f"WITH {IT_SQL} SELECT id FROM it WHERE regexp_matches(lower(coalesce(title, '')), 'recall|strike|召回|罢工')")
def any_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").filter(F.lower(F.coalesce("title", F.lit(""))).rlike("recall|strike|召回|罢工")).select("id")


@query("F16_bridge_keys", f"WITH {IT_SQL} SELECT id, len(list_distinct(regexp_extract_all(coalesce(title, ''), '[A-Z][a-z]+')))::INT * len(list_distinct(regexp_extract_all(lower(coalesce(title, '')), 'fines|recalls|strike|names')))::INT AS n_keys FROM it")
def bridge_key_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys of a named subject and an event a title gives to block on."""
    from galley.functions.features import bridge_keys

    t = F.coalesce("title", F.lit(""))
    subjects = F.array_distinct(F.regexp_extract_all(t, F.lit("[A-Z][a-z]+"), F.lit(0)))
    events = F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("fines|recalls|strike|names"), F.lit(0)))
    return items(spark, folder, "title").select("id", F.size(bridge_keys(subjects, events)).alias("n_keys"))


@query("F27_relevance", f"WITH {IT_SQL}, m AS (SELECT id, len([w FOR w IN ['chip', 'sensor', 'satellite', '芯片', '卫星'] IF contains(lower(coalesce(title, '')), w)]) AS h, len([w FOR w IN ['chip', 'sensor', 'satellite', '芯片', '卫星'] IF contains(lower(coalesce(title, '') || ' ' || substr(coalesce(summary, ''), 1, 1200)), w)]) AS a FROM it) SELECT id, round(least(1.0, 0.34 * h + 0.10 * (a - h)), 6)::DOUBLE AS strength FROM m")
def topic_strength(spark: SparkSession, folder: str) -> DataFrame:
    """How strongly an item is about a topic: words of the headline weigh more than those of the text."""
    topic = ["chip", "sensor", "satellite", "芯片", "卫星"]
    head = F.lower(F.coalesce("title", F.lit("")))
    whole = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("summary", F.lit("")), 1, 1200)))
    h, a = F.size(text.contains_any(head, topic)), F.size(text.contains_any(whole, topic))
    return items(spark, folder, "title", "summary").select("id", F.round(F.least(F.lit(1.0), 0.34 * h + 0.10 * (a - h)), 6).alias("strength"))
