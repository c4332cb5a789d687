"""Aggregations: rollups, filtered distincts, shares, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions.scoring import doubt_band, source_dimensions, source_score
from galley.plans.catalog import query
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes, sources
from galley.sources.tables import table


def lower_quantile(values: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The element at place floor((n - 1) * q) of each group's sorted values.

    Values are counted first, so a group is as large as its distinct values, and running
    counts name the element; no group is gathered into an array.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    place = F.floor((F.col("_all") - 1) * q)
    return upto.filter((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)).select(*by, F.col(value).alias(name))


def shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share) with the share of the whole."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))
    return n.crossJoin(total).select(by, "n", (F.col("n") / F.col("total")).alias("share"))  # one row of totals


@query("A01_cluster_rollup", f"WITH {IT_SQL} SELECT cluster_id, count(*) AS n_items, min(coalesce(published_ts, fetched_ts)) AS first_ts, max(coalesce(published_ts, fetched_ts)) AS last_ts, count(DISTINCT grp) AS n_groups, min(tier) AS best_tier, array_to_string(list_sort(list(DISTINCT grp)), ',') AS groups FROM it WHERE cluster_id IS NOT NULL GROUP BY 1")
def cluster_rollup(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "published_ts", "grp", "tier").filter("cluster_id is not null")
    ts = F.coalesce("published_ts", "fetched_ts")
    groups = F.array_sort(F.collect_set("grp"))  # owners are as many as the registry has
    return it.groupBy("cluster_id").agg(F.count("*").alias("n_items"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.size(groups).cast("bigint").alias("n_groups"), F.min("tier").alias("best_tier"), F.array_join(groups, ",").alias("groups"))


@query("A02_filtered_distinct", f"WITH {IT_SQL} SELECT it.cluster_id, count(DISTINCT it.grp) FILTER (WHERE s.source_role IN ('reporting', 'wire')) AS independent_groups, count(DISTINCT it.grp) AS all_groups FROM it LEFT JOIN sources s ON s.id = it.source_id WHERE it.cluster_id IS NOT NULL GROUP BY 1")
def filtered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "grp").filter("cluster_id is not null")
    it = it.join(sources(spark, folder).select(F.col("id").alias("source_id"), "source_role"), "source_id", "left")
    # one row per cluster and owner first: the distinct counts become plain ones
    pairs = it.groupBy("cluster_id", "grp").agg(F.max(F.coalesce(F.col("source_role").isin("reporting", "wire"), F.lit(False))).alias("own"))
    return pairs.groupBy("cluster_id").agg(F.count_if("own").alias("independent_groups"), F.count("grp").alias("all_groups"))


@query("A03_authority", f"WITH {IT_SQL}, w AS (SELECT cluster_id, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.3 END::DOUBLE AS w FROM it WHERE cluster_id IS NOT NULL) SELECT cluster_id, round(0.7 * max(w) + 0.3 * avg(w), 6) AS authority FROM w GROUP BY 1")
def authority_of(spark: SparkSession, folder: str) -> DataFrame:
    from galley.functions.scoring import authority, tier_weight

    w = items(spark, folder, "cluster_id", "tier").filter("cluster_id is not null").select("cluster_id", tier_weight(F.col("tier")).alias("w"))
    return w.groupBy("cluster_id").agg(F.round(authority(F.max("w"), F.avg("w")), 6).alias("authority"))


@query("A04_content_hash", f"WITH {IT_SQL} SELECT cluster_id, substr(sha256(string_agg(id || '|' || coalesce(title, '') || '|' || coalesce(summary, ''), chr(10) ORDER BY id)), 1, 24) AS content_hash FROM it WHERE cluster_id IS NOT NULL GROUP BY 1")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "title", "summary").filter("cluster_id is not null")
    line = F.concat_ws("|", "id", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("id", line.alias("line"))))
    return it.groupBy("cluster_id").agg(F.substring(F.sha2(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), 256), 1, 24).alias("content_hash"))


@query("A05_counts", f"WITH {IT_SQL}, {CL_SQL} SELECT 'code' AS dim, coalesce(cred_code, '') AS name, count(*) AS n FROM cl GROUP BY 2 UNION ALL SELECT 'lang', coalesce(lang, ''), count(*) FROM it GROUP BY 2 UNION ALL SELECT 'topic', coalesce(topics[1], ''), count(*) FROM cl GROUP BY 2 UNION ALL SELECT 'source', source_id, count(*) FROM it GROUP BY 2")
def counts(spark: SparkSession, folder: str) -> DataFrame:
    it, cl = items(spark, folder, "lang"), clusters(spark, folder, "cred_code", "topics")

    def by(df: DataFrame, dim: str, name: Column) -> DataFrame:
        return df.groupBy(F.coalesce(name, F.lit("")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(dim).alias("dim"), "name", "n")

    parts = [by(cl, "code", F.col("cred_code")), by(it, "lang", F.col("lang")), by(cl, "topic", F.try_element_at("topics", F.lit(1))), by(it, "source", F.col("source_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("A06_conditional_counts", f"WITH {IT_SQL}, m AS (SELECT max(fetched_ts) AS now FROM it), p(name, hours) AS (VALUES ('day', 24), ('three_days', 72), ('week', 168), ('month', 720)) SELECT p.name, count(*) AS n, count(DISTINCT it.source_id) AS n_sources, count(*) FILTER (WHERE it.tier = 1) AS n_first_tier FROM p, m, it WHERE it.fetched_ts > m.now - p.hours * 3600 GROUP BY 1")
def conditional_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over several look-back periods in one pass; the periods are a table of four rows."""
    it = items(spark, folder, "tier")
    now = F.broadcast(it.agg(F.max("fetched_ts").alias("now")))
    periods = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("hours")) for n, h in (("day", 24), ("three_days", 72), ("week", 168), ("month", 720))])
    seen = it.join(now, F.col("fetched_ts") > F.col("now") - 720 * 3600).select("*", F.explode(periods).alias("p")).filter(F.col("fetched_ts") > F.col("now") - F.col("p.hours") * 3600)
    return seen.groupBy(F.col("p.name").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("n_sources"), F.count_if(F.col("tier") == 1).alias("n_first_tier"))


@query("A07_concentration", f"WITH {IT_SQL}, n AS (SELECT source_id, count(*)::DOUBLE AS n FROM it GROUP BY 1), s AS (SELECT source_id, n / sum(n) OVER () AS share FROM n), g AS (SELECT grp, count(*)::DOUBLE AS n FROM it GROUP BY 1) SELECT round(max(share), 6) AS top_share, round(sum(share * share), 6) AS hhi, (SELECT round(sum(share), 6) FROM (SELECT share FROM s ORDER BY share DESC, source_id LIMIT 3)) AS top3_share, (SELECT round(max(n) / sum(n), 6) FROM g) AS top_group_share FROM s")
def concentration(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "grp")
    s = shares(it, "source_id")
    top3 = s.orderBy(F.desc("share"), "source_id").limit(3).agg(F.round(F.sum("share"), 6).alias("top3_share"))
    group = shares(it, "grp").agg(F.round(F.max("share"), 6).alias("top_group_share"))
    return s.agg(F.round(F.max("share"), 6).alias("top_share"), F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi")).crossJoin(top3).crossJoin(group)  # single rows


_STATS_SQL = f"""{IT_SQL}, {CL_SQL}, st AS (SELECT it.source_id, count(*) AS n_items, count(it.cluster_id) AS n_clustered,
 count(*) FILTER (WHERE it.cluster_id IS NOT NULL AND coalesce(cl.n_groups, 0) >= 2) AS n_contested,
 count(*) FILTER (WHERE it.cluster_id IS NOT NULL AND coalesce(cl.n_groups, 0) >= 2 AND cl.first_ts > 0 AND coalesce(it.published_ts, it.fetched_ts, 0) <= cl.first_ts) AS n_lead,
 count(*) FILTER (WHERE it.cluster_id IS NOT NULL AND (coalesce(cl.cred, 0) < 40 OR coalesce(cl.relevance, 0) < 0.28)) AS n_noise,
 avg(CASE WHEN it.cluster_id IS NOT NULL THEN coalesce(cl.relevance, 0) END) AS avg_rel, avg(CASE WHEN it.cluster_id IS NOT NULL THEN coalesce(cl.doubt, 0) END) AS avg_doubt,
 sum(CASE WHEN it.cluster_id IS NOT NULL THEN CAST(round(coalesce(cl.relevance, 0) * 1000000) AS BIGINT) END)::BIGINT AS rel_sum, sum(CASE WHEN it.cluster_id IS NOT NULL THEN CAST(round(coalesce(cl.doubt, 0) * 1000000) AS BIGINT) END)::BIGINT AS doubt_sum
 FROM it LEFT JOIN cl ON cl.id = it.cluster_id GROUP BY 1)"""


def source_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: items, clustered, contested, lead and noise counts, mean relevance and doubt."""
    it = items(spark, folder, "cluster_id", "published_ts")
    cl = clusters(spark, folder, "n_groups", "first_ts", "cred", "relevance", "doubt").withColumnRenamed("id", "key").drop("updated_ts")
    it = it.withColumn("key", F.coalesce("cluster_id", F.concat(F.lit("\u0000"), F.col("id"))))
    joined = it.join(cl, "key", "left")
    in_cluster = F.col("cluster_id").isNotNull()
    contested = in_cluster & (F.coalesce("n_groups", F.lit(0)) >= 2)
    ts = F.coalesce("published_ts", "fetched_ts", F.lit(0))
    noise = in_cluster & ((F.coalesce("cred", F.lit(0.0)) < 40) | (F.coalesce("relevance", F.lit(0.0)) < 0.28))
    return joined.groupBy("source_id").agg(
        F.count("*").alias("n_items"), F.count("cluster_id").alias("n_clustered"), F.count_if(contested).alias("n_contested"),
        F.count_if(contested & (F.col("first_ts") > 0) & (ts <= F.col("first_ts"))).alias("n_lead"), F.count_if(noise).alias("n_noise"),
        F.avg(F.when(in_cluster, F.coalesce("relevance", F.lit(0.0)))).alias("avg_rel"), F.avg(F.when(in_cluster, F.coalesce("doubt", F.lit(0.0)))).alias("avg_doubt"),
        *[F.sum(F.when(in_cluster, F.round(F.coalesce(c, F.lit(0.0)) * 1_000_000).cast("bigint"))).alias(f"{name}_sum") for c, name in (("relevance", "rel"), ("doubt", "doubt"))],
    )


@query("A08_source_stats", f"WITH {_STATS_SQL} SELECT source_id, n_items, n_clustered, n_contested, n_lead, n_noise, ((2 * rel_sum + n_clustered) // (2 * nullif(n_clustered, 0))) / 1000000 AS avg_rel, ((2 * doubt_sum + n_clustered) // (2 * nullif(n_clustered, 0))) / 1000000 AS avg_doubt FROM st")
def source_stats_rounded(spark: SparkSession, folder: str) -> DataFrame:
    # the means are rounded in whole millionths: sums of doubles depend on their order, which shows at halves
    mean = {f"avg_{c}": F.expr(f"((2 * {c}_sum + n_clustered) div (2 * nullif(n_clustered, 0))) / 1000000") for c in ("rel", "doubt")}
    return source_stats(spark, folder).withColumns(mean).drop("rel_sum", "doubt_sum")


@query("A09_source_score", f"""WITH {_STATS_SQL}, d AS (SELECT s.id AS source_id, s.source_role IN ('official', 'regulatory_filing') AS prim, coalesce(n_items, 0) AS n, coalesce(n_clustered, 0) AS c,
 least(1.0, ln(1 + coalesce(n_items, 0)) / ln(21)) AS supply, CASE WHEN n_contested > 0 THEN n_lead / n_contested ELSE 0 END AS lead, CASE WHEN n_clustered > 0 THEN n_contested / n_clustered ELSE 0 END AS corr,
 CASE WHEN n_clustered > 0 THEN least(1.0, avg_rel / 0.6) ELSE 0 END AS rel, CASE WHEN n_clustered > 0 THEN 1 - n_noise / n_clustered ELSE 0 END AS clean, CASE WHEN n_clustered > 0 THEN greatest(0, 1 - avg_doubt / 50) ELSE 0 END AS trust FROM sources s LEFT JOIN st ON st.source_id = s.id)
SELECT source_id, n AS n_items, round(CASE WHEN prim THEN (0.2 * supply + 0.2 * rel + 0.15 * clean + 0.1 * trust) / 0.65 ELSE 0.2 * supply + 0.2 * lead + 0.15 * corr + 0.2 * rel + 0.15 * clean + 0.1 * trust END, 5) AS score FROM d""")
def source_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every registered source, silent ones included."""
    st = sources(spark, folder).select(F.col("id").alias("source_id"), "source_role").join(source_stats(spark, folder), "source_id", "left").fillna(0)
    dims = source_dimensions(F.col("n_items"), F.col("n_clustered"), F.col("n_contested"), F.col("n_lead"), F.col("n_contested"), F.col("n_noise"), F.col("avg_rel"), F.col("avg_doubt"))
    return st.select("source_id", "n_items", F.round(source_score(dims, F.col("source_role").isin("official", "regulatory_filing")), 5).alias("score"))


@query("A11_language_bias", f"WITH {IT_SQL}, {CL_SQL}, a AS (SELECT lower(substr(trim(it.lang), 1, 2)) AS lang, avg(cl.relevance) AS rel, count(*) AS n FROM it JOIN cl ON cl.id = it.cluster_id WHERE length(trim(it.lang)) >= 2 GROUP BY 1) SELECT lang, n, round(rel, 6) AS avg_relevance, rel < 0.7 * max(rel) OVER () AS under_served FROM a")
def language_bias(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "lang", "cluster_id").filter(F.length(F.trim("lang")) >= 2)
    joined = it.join(clusters(spark, folder, "relevance").select(F.col("id").alias("cluster_id"), "relevance"), "cluster_id")
    a = joined.groupBy(F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang")).agg(F.count("*").alias("n"), F.avg("relevance").alias("rel"))
    best = F.broadcast(a.agg(F.max("rel").alias("best")))
    return a.crossJoin(best).select("lang", "n", F.round("rel", 6).alias("avg_relevance"), (F.col("rel") < 0.7 * F.col("best")).alias("under_served"))


@query("A12_doubt_bands", f"WITH {CL_SQL}, b AS (SELECT coalesce(doubt, 0) AS d FROM cl) SELECT CASE WHEN d >= 50 THEN 'SUSPECT' WHEN d >= 25 THEN 'QUESTIONABLE' WHEN d >= 10 THEN 'MINOR' ELSE 'CLEAR' END AS band, count(*) AS n, round(avg(d), 6) AS mean, count(*) FILTER (WHERE d >= 25) AS flagged FROM b GROUP BY 1")
def doubt_bands(spark: SparkSession, folder: str) -> DataFrame:
    d = clusters(spark, folder, "doubt").select(F.coalesce("doubt", F.lit(0.0)).alias("d"))
    return d.groupBy(doubt_band(F.col("d")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.count_if(F.col("d") >= 25).alias("flagged"))


@query("A14_verdict_pivot", f"WITH {PR_SQL} SELECT source_id, count(*) FILTER (WHERE verdict = 'healthy') AS healthy, count(*) FILTER (WHERE verdict = 'degraded') AS degraded, count(*) FILTER (WHERE verdict = 'unhealthy') AS unhealthy, count(*) FILTER (WHERE verdict = 'down') AS down FROM pr GROUP BY 1")
def verdict_pivot(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ["healthy", "degraded", "unhealthy", "down"]
    return probes(spark, folder).groupBy("source_id").pivot("verdict", kinds).count().fillna(0, kinds)


@query("A15_topic_trend", f"WITH {CL_SQL}, t AS (SELECT DISTINCT id, unnest(topics) AS topic, last_ts, coalesce(relevance, 0) AS rel, n_groups FROM cl) SELECT topic, count(*) AS n, max(last_ts) AS last_ts, round(sum(rel), 4) AS total_relevance, CASE WHEN count(*) FILTER (WHERE n_groups >= 2) >= 3 THEN 'collective' WHEN count(*) FILTER (WHERE n_groups >= 2) = 2 THEN 'converging' ELSE 'single' END AS signal FROM t GROUP BY 1")
def topic_trend(spark: SparkSession, folder: str) -> DataFrame:
    t = clusters(spark, folder, "topics", "last_ts", "relevance", "n_groups").select("id", F.explode(F.array_distinct("topics")).alias("topic"), "last_ts", F.coalesce("relevance", F.lit(0.0)).alias("rel"), "n_groups")
    several = F.count_if(F.col("n_groups") >= 2)
    return t.groupBy("topic").agg(F.count("*").alias("n"), F.max("last_ts").alias("last_ts"), F.round(F.sum("rel"), 4).alias("total_relevance"), F.when(several >= 3, "collective").when(several == 2, "converging").otherwise("single").alias("signal"))


@query("A19_lower_p95", f"WITH {PR_SQL}, r AS (SELECT source_id, ms, row_number() OVER (PARTITION BY source_id ORDER BY ms) - 1 AS k, count(*) OVER (PARTITION BY source_id) AS n FROM pr WHERE ms IS NOT NULL) SELECT source_id, ms AS p95_ms FROM r WHERE k = floor((n - 1) * 0.95)")
def lower_p95(spark: SparkSession, folder: str) -> DataFrame:
    return lower_quantile(probes(spark, folder).select("source_id", "ms"), ["source_id"], "ms", 0.95, "p95_ms")


@query("A20_median_delay", f"WITH {IT_SQL} SELECT source_id, median(fetched_ts - published_ts)::DOUBLE AS median_delay FROM it WHERE published_ts <= fetched_ts GROUP BY 1")
def median_delay(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "published_ts").filter("published_ts <= fetched_ts")
    return it.groupBy("source_id").agg(F.median(F.col("fetched_ts") - F.col("published_ts")).cast("double").alias("median_delay"))


@query("A21_quality_gates", f"""WITH {IT_SQL}, {CL_SQL}, m AS (SELECT (SELECT count(*) FROM it) AS n, (SELECT count(*) FROM it WHERE published_ts IS NULL) AS undated, (SELECT count(*) FROM it WHERE published_ts > fetched_ts + 300) AS future, (SELECT count(*) FROM it WHERE summary IS NULL OR summary = '') AS bare, (SELECT count(*) FROM cl WHERE rank IS NULL) AS unranked, (SELECT count(*) FROM cl) AS ncl)
SELECT gate, round(value, 6) AS value, CASE WHEN value <= warn THEN 'pass' WHEN value <= fail THEN 'warn' ELSE 'fail' END AS status FROM m, LATERAL (VALUES ('undated', undated / n, 0.02, 0.1), ('future', future / n, 0.005, 0.05), ('bare', bare / n, 0.05, 0.3), ('unranked', unranked / ncl, 0.01, 0.05)) v(gate, value, warn, fail)""")
def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    """One wide pass over each table, then one row per gate."""
    it = items(spark, folder, "published_ts", "summary").agg(F.count("*").alias("n"), F.count_if(F.col("published_ts").isNull()).alias("undated"), F.count_if(F.col("published_ts") > F.col("fetched_ts") + 300).alias("future"), F.count_if(F.coalesce("summary", F.lit("")) == "").alias("bare"))
    cl = clusters(spark, folder, "rank").agg(F.count("*").alias("ncl"), F.count_if(F.col("rank").isNull()).alias("unranked"))
    gates = [("undated", "undated", "n", 0.02, 0.1), ("future", "future", "n", 0.005, 0.05), ("bare", "bare", "n", 0.05, 0.3), ("unranked", "unranked", "ncl", 0.01, 0.05)]
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), (F.col(a) / F.col(b)).alias("value"), F.lit(w).alias("warn"), F.lit(x).alias("fail")) for g, a, b, w, x in gates])
    out = it.crossJoin(cl).select(F.explode(rows).alias("g")).select("g.*")
    return out.select("gate", F.round("value", 6).alias("value"), F.when(F.col("value") <= F.col("warn"), "pass").when(F.col("value") <= F.col("fail"), "warn").otherwise("fail").alias("status"))


@query("A25_stratified_sample", f"WITH {IT_SQL}, s AS (SELECT it.id, lower(substr(coalesce(trim(it.lang), ''), 1, 2)) AS lang, coalesce(s.source_role, '') AS role FROM it LEFT JOIN sources s ON s.id = it.source_id), r AS (SELECT *, row_number() OVER (PARTITION BY lang, role ORDER BY md5(id), id) AS n FROM s) SELECT id, lang, role, n FROM r ORDER BY n, lang, role LIMIT 200")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """200 items, drawn round robin from the strata of language and role in a fixed random order."""
    role = sources(spark, folder).select(F.col("id").alias("source_id"), "source_role")
    s = items(spark, folder, "lang").join(role, "source_id", "left").select("id", F.lower(F.substring(F.coalesce(F.trim("lang"), F.lit("")), 1, 2)).alias("lang"), F.coalesce("source_role", F.lit("")).alias("role"))
    # a stratum may hold a third of all rows: rank within salted parts first, keep what can be drawn
    salted = s.withColumn("h", F.md5("id")).withColumn("salt", F.substring("h", 1, 1))
    part = F.row_number().over(Window.partitionBy("lang", "role", "salt").orderBy("h", "id"))
    few = salted.withColumn("k", part).filter("k <= 200")
    n = F.row_number().over(Window.partitionBy("lang", "role").orderBy("h", "id"))
    return few.withColumn("n", n.cast("bigint")).select("id", "lang", "role", "n").orderBy("n", "lang", "role").limit(200)


@query("A28_topic_radar", f"WITH {CL_SQL}, {IT_SQL}, t AS (SELECT id, unnest(topics) AS topic FROM cl), r AS (SELECT DISTINCT it.cluster_id, s.source_role FROM it JOIN sources s ON s.id = it.source_id) SELECT t.topic, count(DISTINCT t.id) AS n_clusters, count(DISTINCT t.id) FILTER (WHERE r.source_role = 'official') AS n_official, count(DISTINCT t.id) FILTER (WHERE r.source_role IN ('reporting', 'wire')) AS n_reported FROM t LEFT JOIN r ON r.cluster_id = t.id GROUP BY 1 ORDER BY n_clusters DESC, topic LIMIT 12")
def topic_radar(spark: SparkSession, folder: str) -> DataFrame:
    role = sources(spark, folder).select(F.col("id").alias("source_id"), "source_role")
    r = items(spark, folder, "cluster_id").filter("cluster_id is not null").join(role, "source_id").groupBy(F.col("cluster_id").alias("id")).agg(F.max((F.col("source_role") == "official").cast("int")).alias("o"), F.max(F.col("source_role").isin("reporting", "wire").cast("int")).alias("w"))
    t = clusters(spark, folder, "topics").select("id", F.explode(F.array_distinct("topics")).alias("topic")).join(r, "id", "left")
    return t.groupBy("topic").agg(F.count("*").alias("n_clusters"), F.count_if(F.col("o") == 1).alias("n_official"), F.count_if(F.col("w") == 1).alias("n_reported")).orderBy(F.desc("n_clusters"), "topic").limit(12)


@query("A32_run_summary", f"WITH {PR_SQL} SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n, count(*) FILTER (WHERE error IS NOT NULL) AS n_failed, max(ms) AS max_ms, max(ts) FILTER (WHERE error IS NULL) AS last_ok FROM pr GROUP BY 1")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return probes(spark, folder).groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), F.max("ms").alias("max_ms"), F.max(F.when(F.col("error").isNull(), F.col("ts"))).alias("last_ok"))


@query("A33_distinct_and_span", f"WITH {IT_SQL} SELECT count(DISTINCT source_id) AS n_sources, count(DISTINCT grp) AS n_groups, count(DISTINCT lang) AS n_labels, max(fetched_ts) - min(fetched_ts) AS span FROM it")
def distinct_and_span(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "grp", "lang").agg(F.countDistinct("source_id").alias("n_sources"), F.countDistinct("grp").alias("n_groups"), F.countDistinct("lang").alias("n_labels"), (F.max("fetched_ts") - F.min("fetched_ts")).alias("span"))


@query("A35_cube", f"WITH {IT_SQL} SELECT coalesce(grp, '') AS grp, tier, grouping_id(grp, tier) AS level, count(*) AS n FROM it GROUP BY CUBE (grp, tier)")
def cube(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "grp", "tier").cube("grp", "tier").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select(F.coalesce("grp", F.lit("")).alias("grp"), "tier", "level", "n")


@query("A36_tpch_style_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def lineitem_rollup(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"), F.count("*").alias("n"))
