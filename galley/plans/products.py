"""Composite queries: the feed, cluster pages, statistics, research, digests, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import text
from galley.operators.aggregates import lower_quantile, source_stats
from galley.operators.evidence import _CLAIM_SQL, STATUS_SQL, claim_status, lead_claims
from galley.operators.textops import _TOKENS
from galley.operators.windows import interleave
from galley.plans.catalog import query
from galley.plans.search import matching, parse
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes, sources

FEED_LIMIT = 80


def feed(spark: SparkSession, folder: str, raw: str, limit: int = FEED_LIMIT) -> DataFrame:
    """The ranked feed for a search: (place, id, headline, rank), four of the major languages to one Chinese."""
    cl = clusters(spark, folder, "headline", "topics", "cred", "last_ts", "rank", "relevance", "headline_src").filter("rank is not null")
    it = items(spark, folder, "cluster_id", "title", "summary", "lang")
    minor = F.coalesce(text.cjk_ratio("headline") >= 0.3, F.lit(False))
    found = matching(cl, it, parse(raw)).filter("relevance >= 0.28 and cred >= 40").withColumn("minor", minor)
    # the best of each kind; Spark keeps no more than these of a partition before it moves them
    best = F.row_number().over(Window.partitionBy("minor").orderBy(F.desc("rank"), "id"))
    placed = interleave(found.withColumn("best", best).filter(F.col("best") <= limit), F.col("minor"), [F.desc("rank"), F.col("id")], 4)
    return placed.filter(F.col("place") <= limit).select("place", "id", "headline", "rank")


_HAN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"


def _feed_sql(where: str) -> str:
    return f"""WITH {CL_SQL}, {IT_SQL}, f AS (SELECT * FROM cl WHERE rank IS NOT NULL AND relevance >= 0.28 AND cred >= 40 {where}),
h AS (SELECT *, len(regexp_extract_all(coalesce(headline, ''), '{_HAN}')) AS a, len(regexp_extract_all(coalesce(headline, ''), '[A-Za-z]')) AS b FROM f),
m AS (SELECT *, a + b > 0 AND a / (a + b) >= 0.3 AS minor FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY minor ORDER BY rank DESC, id) AS n FROM m),
p AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN minor THEN n - 1 ELSE (n - 1) // 4 END, minor, n)::INT AS place FROM n) SELECT place, id, headline, rank FROM p WHERE place <= {FEED_LIMIT}"""


@query("Q01_ranked_feed", _feed_sql(""))
def ranked_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed(spark, folder, "")


@query("Q01_search_feed", _feed_sql("AND cred >= 50 AND list_contains(topics, 'ai') AND EXISTS (SELECT 1 FROM it WHERE it.cluster_id = cl.id AND lower(substr(trim(it.lang), 1, 2)) = 'en') AND EXISTS (SELECT 1 FROM it WHERE it.cluster_id = cl.id AND (contains(lower(coalesce(title, '')), 'bank') OR contains(lower(coalesce(summary, '')), 'bank')))"))
def search_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed(spark, folder, "topic:ai lang:en cred:>=50 bank")


@query("Q02_cluster_detail", f"WITH {CL_SQL}, {IT_SQL} SELECT cl.id, it.id AS item_id, it.source_id, coalesce(s.owner, '') AS owner, row_number() OVER (PARTITION BY cl.id ORDER BY coalesce(it.published_ts, it.fetched_ts), it.tier, it.id) AS place FROM (SELECT id FROM cl WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT 20) cl JOIN it ON it.cluster_id = cl.id LEFT JOIN sources s ON s.id = it.source_id")
def cluster_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The time line of the twenty best ranked clusters with the owners of their sources."""
    top = clusters(spark, folder, "rank").filter("rank is not null").orderBy(F.desc("rank"), "id").limit(20).select("id")
    it = items(spark, folder, "cluster_id", "published_ts", "tier").withColumnRenamed("id", "item_id").withColumnRenamed("cluster_id", "id")
    so = sources(spark, folder).select(F.col("id").alias("source_id"), "owner")
    rows = it.join(F.broadcast(top), "id").join(so, "source_id", "left")  # twenty rows
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("published_ts", "fetched_ts"), "tier", "item_id"))
    return rows.select("id", "item_id", "source_id", F.coalesce("owner", F.lit("")).alias("owner"), place.cast("bigint").alias("place"))


_QUESTION = "bank satellite"


#: What the status of a claim adds to its score, and the least score of an answer.
STATUS_WEIGHT = {"independently_reported": 0.18, "official_statement": 0.10, "disputed": 0.06, "single_report": 0.0}
LEAST_SCORE = 0.18

_HAY = _TOKENS.replace("(t, '", "(hay, '").replace("(t,", "(hay,")


@query("Q05_research", f"WITH {_CLAIM_SQL}, {CL_SQL}, {STATUS_SQL}, h AS (SELECT c.cluster_id, lower(c.claim || ' ' || coalesce(cl.headline, '')) AS hay, cl.cred, cl.last_ts, st.status FROM c JOIN cl ON cl.id = c.cluster_id JOIN st ON st.cluster_id = c.cluster_id), t AS (SELECT *, contains(hay, 'bank')::INT + contains(hay, 'satellite')::INT AS matched, list_distinct({_HAY}) AS g2 FROM h), u AS (SELECT *, len(list_intersect(g2, ['bank', 'satellite'])) AS k, len(g2) AS n FROM t WHERE matched >= 2), v AS (SELECT *, greatest(k / (n + 2 - k), 0.8 * k / least(n, 2), CASE WHEN contains(hay, 'bank satellite') THEN 1.0 ELSE 0.0 END, 0.75 * matched / 2) + 0.25 * matched / 2 AS score FROM u) SELECT cluster_id, round(score + CASE status WHEN 'independently_reported' THEN 0.18 WHEN 'official_statement' THEN 0.10 WHEN 'disputed' THEN 0.06 ELSE 0.0 END, 6) AS score FROM v WHERE score >= {LEAST_SCORE} ORDER BY score DESC, cred DESC NULLS LAST, last_ts DESC NULLS LAST, cluster_id LIMIT 20")
def research(spark: SparkSession, folder: str, question: str = _QUESTION) -> DataFrame:
    """The claims that answer a question: enough of its words; by likeness, wording, coverage and the claim's status."""
    terms = list(dict.fromkeys(question.lower().split()))
    required = 1 if len(terms) <= 1 else max(2, int(len(terms) * 0.6 + 0.5))
    cl = clusters(spark, folder, "headline", "cred", "last_ts").withColumnRenamed("id", "cluster_id")
    both = lead_claims(spark, folder).join(cl, "cluster_id").withColumn("hay", F.lower(F.concat_ws(" ", "claim", F.coalesce("headline", F.lit("")))))
    matched = sum((F.contains("hay", F.lit(t)).cast("int") for t in terms), F.lit(0))
    found = both.withColumn("matched", matched).filter(F.col("matched") >= required)
    scored = found.withColumn("score", research_score(F.lit(question.lower()), F.col("hay"), len(terms), F.col("matched")) + 0.25 * F.col("matched") / len(terms)).filter(F.col("score") >= LEAST_SCORE)
    weight = sum((F.when(F.col("status") == k, v).otherwise(0.0) for k, v in STATUS_WEIGHT.items()), F.lit(0.0))
    rated = scored.join(claim_status(spark, folder).select("cluster_id", "status"), "cluster_id").withColumn("score", F.round(F.col("score") + weight, 6))
    return rated.orderBy(F.desc("score"), F.desc_nulls_last("cred"), F.desc_nulls_last("last_ts"), "cluster_id").limit(20).select("cluster_id", "score")


def research_score(question: Column, hay: Column, n_terms: int, matched: Column) -> Column:
    """The best of likeness, containment, the question word for word, and the share of its words."""
    q, t = text.grams(question), text.grams(hay)
    best = F.greatest(text.jaccard(q, t), 0.8 * text.overlap(q, t), F.contains(hay, question).cast("double"), 0.75 * matched / n_terms)
    return F.when((F.size(q) > 0) & (F.size(t) > 0), best).otherwise(0.0)


@query("Q07_metrics", f"WITH {IT_SQL}, {CL_SQL}, {PR_SQL}, r AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS k, count(*) OVER () AS n FROM pr WHERE ms IS NOT NULL) SELECT 'items' AS name, count(*)::DOUBLE AS value FROM it UNION ALL SELECT 'clusters', count(*) FROM cl UNION ALL SELECT 'probes_down', count(*) FROM pr WHERE verdict = 'down' UNION ALL SELECT 'probe_p95_ms', (SELECT ms FROM r WHERE k = floor((n - 1) * 0.95)) UNION ALL SELECT 'clusters_corroborated', count(*) FROM cl WHERE n_groups >= 2")
def metrics(spark: SparkSession, folder: str) -> DataFrame:
    it, cl, pr = items(spark, folder), clusters(spark, folder, "n_groups"), probes(spark, folder)

    def one(df: DataFrame, name: str, value) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")

    p95 = lower_quantile(pr.select(F.lit(1).alias("all"), "ms"), ["all"], "ms", 0.95, "value").select(F.lit("probe_p95_ms").alias("name"), F.col("value").cast("double").alias("value"))
    parts = [one(it, "items", F.count("*")), one(cl, "clusters", F.count("*")), one(pr, "probes_down", F.count_if(F.col("verdict") == "down")), p95, one(cl, "clusters_corroborated", F.count_if(F.col("n_groups") >= 2))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("Q08_sources", f"WITH {IT_SQL}, {PR_SQL}, n AS (SELECT source_id, count(*) AS n FROM it GROUP BY 1), l AS (SELECT lower(trim(source_id)) AS source_id, arg_max(verdict, (ts, id)) AS verdict FROM pr GROUP BY 1) SELECT s.id, s.source_role, coalesce(n.n, 0) AS n_items, coalesce(l.verdict, 'unseen') AS verdict FROM sources s LEFT JOIN n ON n.source_id = s.id LEFT JOIN l ON l.source_id = s.id")
def source_list(spark: SparkSession, folder: str) -> DataFrame:
    from galley.sources.snapshots import source_key

    n = items(spark, folder).groupBy("source_id").agg(F.count("*").alias("n"))
    last = probes(spark, folder).withColumn("source_id", source_key()).groupBy("source_id").agg(F.max(F.struct("ts", "id", "verdict")).alias("x"))
    so = sources(spark, folder).select("id", "source_role", F.col("id").alias("source_id"))
    return so.join(n, "source_id", "left").join(last, "source_id", "left").select("id", "source_role", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("x.verdict", F.lit("unseen")).alias("verdict"))


@query("Q09_entity_search", f"WITH {IT_SQL} SELECT s.id, s.name, count(DISTINCT it.cluster_id) AS n_clusters FROM sources s LEFT JOIN it ON it.source_id = s.id WHERE contains(lower(s.name), 'post') OR EXISTS (SELECT 1 FROM it x WHERE x.source_id = s.id AND contains(x.title, s.name)) GROUP BY 1, 2")
def entity_search(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "title")
    so = sources(spark, folder).select(F.col("id").alias("source_id"), "name")
    own = it.join(so, "source_id").filter(F.contains("title", F.col("name"))).select("source_id")
    kept = so.filter(F.contains(F.lower("name"), F.lit("post"))).unionByName(so.join(own, "source_id", "left_semi")).distinct()
    n = it.groupBy("source_id").agg(F.countDistinct("cluster_id").alias("n"))
    return kept.join(n, "source_id", "left").select(F.col("source_id").alias("id"), "name", F.coalesce("n", F.lit(0)).alias("n_clusters"))


@query("Q12_digest", f"WITH {CL_SQL}, v AS (SELECT id, rank, CASE WHEN relevance < 0.28 OR cred < 40 THEN 'noise' WHEN cred_code IN ('SINGLE', 'LOW') THEN 'unverified' ELSE 'signal' END AS part FROM cl WHERE rank IS NOT NULL AND relevance IS NOT NULL AND cred IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY rank DESC, id) AS place FROM v) SELECT part, place, id FROM r WHERE place <= CASE part WHEN 'signal' THEN 12 ELSE 8 END")
def digest(spark: SparkSession, folder: str) -> DataFrame:
    cl = clusters(spark, folder, "rank", "relevance", "cred", "cred_code").filter("rank is not null and relevance is not null and cred is not null")
    part = F.when((F.col("relevance") < 0.28) | (F.col("cred") < 40), "noise").when(F.col("cred_code").isin("SINGLE", "LOW"), "unverified").otherwise("signal")
    # the places of a part come from its first rows only; a limit per part is pushed below the shuffle
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("rank"), "id"))
    top = cl.withColumn("part", part).withColumn("place", place).filter("place <= 12")
    return top.filter((F.col("part") == "signal") | (F.col("place") <= 8)).select("part", F.col("place").cast("bigint").alias("place"), "id")


@query("Q15_lead_scorecard", f"WITH {IT_SQL}, f AS (SELECT cluster_id, min(published_ts) AS first_ts, arg_min(grp, (published_ts, id)) AS first_grp FROM it WHERE cluster_id IS NOT NULL AND published_ts IS NOT NULL GROUP BY 1), l AS (SELECT it.cluster_id, f.first_grp, min(it.published_ts) - f.first_ts AS lead_s FROM it JOIN f ON f.cluster_id = it.cluster_id WHERE it.grp <> f.first_grp AND it.published_ts IS NOT NULL GROUP BY it.cluster_id, f.first_grp, f.first_ts) SELECT first_grp AS grp, count(*) AS n_led, median(lead_s)::DOUBLE AS median_lead_s FROM l GROUP BY 1")
def lead_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    from galley.operators.windows import lead_time

    return lead_time(spark, folder).groupBy(F.col("first_grp").alias("grp")).agg(F.count("*").alias("n_led"), F.median("lead_s").cast("double").alias("median_lead_s"))


@query("Q16_restatement", f"WITH {CL_SQL}, b AS (SELECT id, cred_code AS before, CASE WHEN cred >= 75 THEN 'CONFIRMED' WHEN cred >= 60 THEN 'LIKELY' WHEN cred >= 40 THEN 'SINGLE' ELSE 'LOW' END AS now FROM cl WHERE cred IS NOT NULL) SELECT coalesce(before, '') AS before, now, count(*) AS n FROM b GROUP BY 1, 2")
def restatement(spark: SparkSession, folder: str) -> DataFrame:
    """How many clusters each stored band would become under the rules as they stand."""
    from galley.functions.scoring import cred_band

    cl = clusters(spark, folder, "cred", "cred_code").filter("cred is not null")
    return cl.groupBy(F.coalesce("cred_code", F.lit("")).alias("before"), cred_band(F.col("cred")).alias("now")).agg(F.count("*").alias("n"))


@query("Q20_composition", f"WITH {_CLAIM_SQL}, g AS (SELECT cluster_id, count(*) FILTER (WHERE relation = 'refute') AS r, count(DISTINCT CASE WHEN relation = 'support' AND role IN ('reporting', 'wire') THEN grp END) AS i, count(*) FILTER (WHERE relation = 'support') AS s, count(*) FILTER (WHERE relation = 'support' AND role <> 'official') AS o FROM ev GROUP BY 1), t AS (SELECT CASE WHEN r > 0 THEN 'disputed' WHEN i >= 2 THEN 'independently_reported' WHEN s > 0 AND o = 0 THEN 'official_statement' ELSE 'single_report' END AS status FROM g) SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1")
def composition(spark: SparkSession, folder: str) -> DataFrame:
    from galley.operators.aggregates import shares

    return shares(claim_status(spark, folder), "status").withColumn("share", F.round("share", 6))
