"""The scorecard: gates over all tables, from single rows of totals.

Every table is read once and becomes one row of totals; the gates are expressions over the row
of all of them, the same in either dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.plans.catalog import query
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes, source_key, sources

#: Gate, value, comparison with its bound, and what a miss means.
GATES = (
    ("enabled_sources", "n_enabled", ">= 20", "fail"), ("source_owners", "n_owners", ">= 15", "fail"), ("source_languages", "n_langs", ">= 3", "fail"), ("source_regions", "n_regions", ">= 4", "fail"),
    ("ai_specialist_sources", "n_ai_sources", ">= 20", "fail"), ("ai_reporting_sources", "n_ai_reporting", ">= 15", "fail"), ("healthy_source_rate", "n_healthy / nullif(n_enabled, 0)", ">= 0.80", "fail"),
    ("source_probe_success_24h", "probes_ok / nullif(probes_day, 0)", ">= 0.80", "fail"), ("international_items_24h_share", "foreign_day / nullif(items_day, 0)", ">= 0.10", "fail"), ("global_depth_target", "foreign_day / nullif(items_day, 0)", ">= 0.20", "warn"),
    ("largest_owner_share_24h", "owner_most / nullif(items_day, 0)", "<= 0.35", "fail"), ("independently_corroborated_24h", "corroborated_day", ">= 1", "fail"), ("independent_corroboration_rate", "corroborated_day / nullif(clusters_day, 0)", ">= 0.10", "warn"),
    ("ai_events_72h", "ai_events", ">= 20", "fail"), ("ai_independent_corroboration_rate", "ai_corroborated / nullif(ai_events, 0)", ">= 0.10", "warn"), ("ai_single_source_share", "1 - ai_corroborated / nullif(ai_events, 0)", "<= 0.90", "warn"),
    ("orphan_clusters", "n_orphans", "= 0", "fail"), ("dangling_cluster_references", "n_dangling", "= 0", "fail"), ("content_freshness_seconds", "content_age", "<= 7200", "fail"), ("body_preview_coverage_72h", "bodies_ok / nullif(bodies_tried, 0)", ">= 0.40", "warn"),
    ("undated_share", "undated / nullif(n_items, 0)", "<= 0.05", "warn"), ("future_share", "future / nullif(n_items, 0)", "<= 0.02", "warn"), ("unranked_share", "unranked / nullif(n_clusters, 0)", "<= 0.05", "warn"),
)
_VALUE = "round(CAST(coalesce({}, -1) AS DOUBLE), 4)"


def _gate_rows_sql() -> str:
    rows = ", ".join(f"('{g}', {_VALUE.format(v)}, '{b}', CASE WHEN coalesce({v}, -1) {b} THEN 'pass' ELSE '{miss}' END)" for g, v, b, miss in GATES)
    return f"SELECT gate, value, target, status FROM w, LATERAL (VALUES {rows}) g(gate, value, target, status)"


_TOTALS = f"""WITH {IT_SQL}, {CL_SQL}, {PR_SQL}, m AS (SELECT max(fetched_ts) AS now FROM it),
s AS (SELECT count(*) AS n_enabled, count(DISTINCT owner) AS n_owners, count(DISTINCT lang) AS n_langs, count(DISTINCT region_code) AS n_regions, count(*) FILTER (WHERE list_contains(topics, 'ai')) AS n_ai_sources, count(*) FILTER (WHERE list_contains(topics, 'ai') AND source_role IN ('reporting', 'wire')) AS n_ai_reporting FROM sources WHERE coalesce(enabled, true)),
v AS (SELECT lower(trim(source_id)) AS id, arg_max(verdict, (ts, id)) AS verdict FROM pr GROUP BY 1), h AS (SELECT count(*) AS n_healthy FROM v JOIN sources USING (id) WHERE coalesce(enabled, true) AND verdict = 'healthy'),
q AS (SELECT count(*) AS probes_day, count(*) FILTER (WHERE verdict <> 'down') AS probes_ok FROM pr WHERE ts > (SELECT max(ts) - 86400 FROM pr)),
d AS (SELECT it.*, coalesce(s.owner, 'unknown') AS owner FROM it LEFT JOIN sources s ON s.id = it.source_id, m WHERE it.published_ts >= m.now - 86400),
i AS (SELECT count(*) AS items_day, count(*) FILTER (WHERE coalesce(lang, '') NOT LIKE 'zh%') AS foreign_day FROM d), o AS (SELECT coalesce(max(n), 0) AS owner_most FROM (SELECT count(*) AS n FROM d GROUP BY owner)),
c AS (SELECT count(*) AS n_clusters, count(*) FILTER (WHERE rank IS NULL) AS unranked, count(*) FILTER (WHERE last_ts >= now - 86400) AS clusters_day, count(*) FILTER (WHERE last_ts >= now - 86400 AND n_groups >= 2) AS corroborated_day, count(*) FILTER (WHERE last_ts >= now - 259200 AND list_contains(topics, 'ai')) AS ai_events, count(*) FILTER (WHERE last_ts >= now - 259200 AND list_contains(topics, 'ai') AND n_groups >= 2) AS ai_corroborated FROM cl, m),
r AS (SELECT (SELECT count(*) FROM cl WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.cluster_id = cl.id)) AS n_orphans, (SELECT count(*) FROM it WHERE cluster_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.id = it.cluster_id)) AS n_dangling),
t AS (SELECT count(*) AS n_items, count(*) FILTER (WHERE published_ts IS NULL) AS undated, count(*) FILTER (WHERE published_ts > fetched_ts + 300) AS future, max(now) - max(CASE WHEN published_ts <= now THEN published_ts END) AS content_age, count(*) FILTER (WHERE body_ts >= now - 259200) AS bodies_tried, count(*) FILTER (WHERE body_ts >= now - 259200 AND body_state = 'ok') AS bodies_ok FROM it, m),
w AS (SELECT * FROM s, h, q, i, o, c, r, t)"""
_SQL = f"{_TOTALS} {_gate_rows_sql()}"
#: The totals, in the order of the tables they come from.
TOTALS = (
    "n_enabled", "n_owners", "n_langs", "n_regions", "n_ai_sources", "n_ai_reporting", "n_healthy", "probes_day", "probes_ok", "items_day", "foreign_day", "owner_most", "n_clusters", "unranked", "clusters_day",
    "corroborated_day", "ai_events", "ai_corroborated", "n_orphans", "n_dangling", "n_items", "undated", "future", "content_age", "bodies_tried", "bodies_ok",
)


def totals_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row of all TOTALS."""
    it = items(spark, folder, "published_ts", "lang", "cluster_id", "body_ts", "body_state")
    cl = clusters(spark, folder, "rank", "last_ts", "n_groups", "topics")
    so = sources(spark, folder).filter(F.coalesce("enabled", F.lit(True)))
    pr = probes(spark, folder)
    now = F.broadcast(it.agg(F.max("fetched_ts").alias("now")))  # one row, as are all the totals below
    ai = F.coalesce(F.array_contains("topics", "ai"), F.lit(False))
    totals = [so.agg(
        F.count("*").alias("n_enabled"), F.count_distinct("owner").alias("n_owners"), F.count_distinct("lang").alias("n_langs"), F.count_distinct("region_code").alias("n_regions"),
        F.count_if(ai).alias("n_ai_sources"), F.count_if(ai & F.col("source_role").isin("reporting", "wire")).alias("n_ai_reporting"))]
    last = pr.groupBy(source_key().alias("id")).agg(F.max(F.struct("ts", F.col("id").alias("n"), "verdict")).alias("x")).filter("x.verdict = 'healthy'")
    totals.append(so.join(last, "id", "left_semi").agg(F.count("*").alias("n_healthy")))
    since = F.broadcast(pr.agg((F.max("ts") - 86_400).alias("since")))
    totals.append(pr.crossJoin(since).filter("ts > since").agg(F.count("*").alias("probes_day"), F.count_if(F.col("verdict") != "down").alias("probes_ok")))
    owner = sources(spark, folder).select(F.col("id").alias("source_id"), "owner")
    day = it.crossJoin(now).filter("published_ts >= now - 86400").join(owner, "source_id", "left")
    owners = day.groupBy(F.coalesce("owner", F.lit("unknown")).alias("owner")).agg(F.count("*").alias("n"), F.count_if(~F.coalesce("lang", F.lit("")).startswith("zh")).alias("f"))
    totals.append(owners.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items_day"), F.coalesce(F.sum("f"), F.lit(0)).alias("foreign_day"), F.coalesce(F.max("n"), F.lit(0)).alias("owner_most")))
    recent, three = F.col("last_ts") >= F.col("now") - 86_400, F.col("last_ts") >= F.col("now") - 259_200
    totals.append(cl.crossJoin(now).agg(
        F.count("*").alias("n_clusters"), F.count_if(F.col("rank").isNull()).alias("unranked"), F.count_if(recent).alias("clusters_day"), F.count_if(recent & (F.col("n_groups") >= 2)).alias("corroborated_day"),
        F.count_if(three & ai).alias("ai_events"), F.count_if(three & ai & (F.col("n_groups") >= 2)).alias("ai_corroborated")))
    used = it.filter("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n"))
    met = cl.select("id", F.lit(True).alias("there")).join(used, "id", "full")
    totals.append(met.agg(F.count_if(F.col("n").isNull()).alias("n_orphans"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_dangling")))
    tried = F.col("body_ts") >= F.col("now") - 259_200
    totals.append(it.crossJoin(now).agg(
        F.count("*").alias("n_items"), F.count_if(F.col("published_ts").isNull()).alias("undated"), F.count_if(F.col("published_ts") > F.col("fetched_ts") + 300).alias("future"),
        (F.max("now") - F.max(F.when(F.col("published_ts") <= F.col("now"), F.col("published_ts")))).alias("content_age"), F.count_if(tried).alias("bodies_tried"), F.count_if(tried & (F.col("body_state") == "ok")).alias("bodies_ok")))
    wide = totals[0]
    for t in totals[1:]:
        wide = wide.crossJoin(t)  # single rows
    return wide


@query("Q04_scorecard", _SQL)
def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """(gate, value, target, status) of every gate; a share of nothing counts as -1."""
    wide = totals_of(spark, folder)
    rows = [F.struct(F.lit(g).alias("gate"), F.expr(_VALUE.format(v)).alias("value"), F.lit(b).alias("target"), F.when(F.expr(f"coalesce({v}, -1) {b}"), "pass").otherwise(miss).alias("status")) for g, v, b, miss in GATES]
    return wide.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


@query("Q04_scorecard_status", f"WITH g AS ({_SQL}) SELECT CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'degraded' WHEN count(*) FILTER (WHERE status = 'warn') > 0 THEN 'advisory' ELSE 'healthy' END AS status, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'fail') AS n_fail FROM g")
def scorecard_status(spark: SparkSession, folder: str) -> DataFrame:
    """The scorecard in one row."""
    n = scorecard(spark, folder).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("pass", "warn", "fail")])
    status = F.when(F.col("n_fail") > 0, "degraded").when(F.col("n_warn") > 0, "advisory").otherwise("healthy")
    return n.select(status.alias("status"), "n_pass", "n_warn", "n_fail")


@query("Q07_gauges", f"{_TOTALS} SELECT name, value FROM w, LATERAL (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {t}::DOUBLE)' for t in TOTALS)}) g(name, value)")
def gauges(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value) of every total, for a monitor."""
    rows = [F.struct(F.lit(t).alias("name"), F.col(t).cast("double").alias("value")) for t in TOTALS]
    return totals_of(spark, folder).select(F.explode(F.array(*rows)).alias("g")).select("g.*")
