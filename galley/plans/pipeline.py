"""The scoring run: items to scored clusters, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import scoring
from galley.functions.text import contains_any
from galley.operators.evidence import _CLAIM_SQL, STATUS_SQL, claim_status
from galley.operators.textops import _words
from galley.plans.catalog import query
from galley.sources.snapshots import IT_SQL, PR_SQL, items, probes, source_key, sources

#: Characters of all summaries of a cluster that the wording is judged by.
BODY_CHARS = 1500
#: Points of the signs of doubt.
DOUBT = {"disputed": 35, "degraded": 6, "rumor": 18, "rumor_attributed": 9, "clickbait": 6, "clickbait_cap": 18, "hype": 10, "punctuation": 5, "stack": 8, "aggregators": 15, "no_independent": 10, "echo": 8, "stale": 10, "future": 12}
EDITORIAL = ("reporting", "wire", "official", "regulatory_filing")


def score_clusters(members: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """One row per cluster of (id, cluster_id, source_id, grp, tier, title, summary, ts).

    Counts over owners and roles come from one row per cluster and owner; the summaries are
    cut per item before they are gathered, as no more than BODY_CHARS of them are read.
    """
    role = registry.select(F.col("id").alias("source_id"), "source_role")
    it = members.join(role, "source_id", "left").withColumn("role", F.coalesce("source_role", F.lit("reporting")))
    is_ = lambda *r: F.max(F.col("role").isin(*r))
    owners = it.groupBy("cluster_id", "grp").agg(
        is_("reporting", "wire").alias("own"), is_("official").alias("official"), is_("wire").alias("wire"), is_(*EDITORIAL).alias("editorial"), is_("official", "regulatory_filing").alias("primary"),
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("tier").alias("best_tier"),
        F.max(scoring.tier_weight(F.col("tier"))).alias("w_max"), F.sum(scoring.tier_weight(F.col("tier"))).alias("w_sum"),
    )
    by = owners.groupBy("cluster_id").agg(
        F.sum("n").alias("n_items"), F.count_if(F.col("own") & F.col("grp").isNotNull()).alias("n_groups"), F.count("grp").alias("n_owners"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("best_tier").alias("best_tier"), F.max("official").alias("official"), F.max("wire").alias("wire"), F.max("editorial").alias("editorial"), F.max("primary").alias("primary"),
        F.max("w_max").alias("w_max"), (F.sum("w_sum") / F.sum("n")).alias("w_mean"),
    )
    lead = F.min(F.struct("tier", (-F.length("title")).alias("l"), "id", "title"))["title"]
    words = it.groupBy("cluster_id").agg(lead.alias("headline"), F.sum(F.length(F.coalesce("summary", F.lit("")))).alias("body_chars"))
    # every summary takes a character at least, with the space behind it: more than so many first ones can't be read
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))
    firsts = it.select("cluster_id", "id", F.substring(F.coalesce("summary", F.lit("")), 1, BODY_CHARS).alias("s")).withColumn("place", place).filter(F.col("place") <= BODY_CHARS)
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: x["s"])
    words = words.join(firsts.groupBy("cluster_id").agg(F.substring(F.array_join(bodies, " "), 1, BODY_CHARS).alias("bodies")), "cluster_id")
    c = by.join(words, "cluster_id").filter("headline is not null")

    content = scoring.content_quality(F.col("headline"), F.col("bodies"), F.col("body_chars"))
    timing = scoring.timing(F.col("first_ts"), F.col("last_ts"), F.col("n_items"), now)
    cred = scoring.credibility(scoring.authority(F.col("w_max"), F.col("w_mean")), scoring.corroboration(F.col("n_groups"), F.col("official"), F.col("wire")), content, timing)
    return c.withColumn("content", content).withColumn("timing", timing.cast("double")).withColumn("cred", cred).withColumn("doubt", _doubt(now))


def _doubt(now: Column) -> Column:
    text = F.concat_ws(" ", "headline", "bodies")
    n = {k: F.size(contains_any(F.col("headline") if k in ("CLICKBAIT", "HYPE") else text, getattr(scoring, k))) for k in ("RUMOR", "ATTRIBUTION", "CLICKBAIT", "HYPE")}
    marks = (F.regexp_count("headline", F.lit("[！!？?]")) >= 2) | F.col("headline").rlike(scoring.EMOJI)
    stacked = (n["RUMOR"] > 0).cast("int") + (n["CLICKBAIT"] > 0).cast("int") + (n["HYPE"] > 0).cast("int") + marks.cast("int")
    span = F.greatest(F.lit(0), F.col("last_ts") - F.col("first_ts")) / 3600
    points = (
        F.when(n["RUMOR"] > 0, F.when(n["ATTRIBUTION"] > 0, DOUBT["rumor_attributed"]).otherwise(DOUBT["rumor"])).otherwise(0)
        + F.least(F.lit(DOUBT["clickbait_cap"]), DOUBT["clickbait"] * n["CLICKBAIT"]) + F.when(n["HYPE"] > 0, DOUBT["hype"]).otherwise(0) + F.when(marks, DOUBT["punctuation"]).otherwise(0)
        + F.when(stacked >= 3, DOUBT["stack"]).otherwise(0) + F.when(~F.col("editorial"), DOUBT["aggregators"]).when((F.col("n_groups") == 0) & ~F.col("primary"), DOUBT["no_independent"]).otherwise(0)
        + F.when((F.col("n_items") >= 3) & (F.col("n_owners") == 1), DOUBT["echo"]).otherwise(0)
        + F.when(F.col("first_ts") > now + 3600, DOUBT["future"]).when((F.col("n_items") > 1) & (span > 48), DOUBT["stale"]).otherwise(0)
    )
    return F.least(F.lit(100), points)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters as of the last fetch."""
    it = items(spark, folder, "cluster_id", "grp", "tier", "title", "summary", "published_ts").filter("cluster_id is not null")
    now = it.agg(F.max("fetched_ts").alias("now")).first()["now"]  # one value
    members = it.select("id", "cluster_id", "source_id", "grp", "tier", "title", "summary", F.coalesce("published_ts", "fetched_ts").alias("ts"))
    return score_clusters(members, sources(spark, folder), F.lit(now).cast("bigint"))


_SCORED_SQL = f"""{IT_SQL}, nw AS (SELECT max(fetched_ts) AS now FROM it WHERE cluster_id IS NOT NULL), e AS (SELECT it.*, coalesce(s.source_role, 'reporting') AS role, coalesce(it.published_ts, it.fetched_ts) AS ts, CASE it.tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.4 ELSE 0.3 END::DOUBLE AS w FROM it LEFT JOIN sources s ON s.id = it.source_id WHERE it.cluster_id IS NOT NULL),
b AS (SELECT cluster_id, count(*) AS n_items, count(DISTINCT CASE WHEN role IN ('reporting', 'wire') THEN grp END) AS n_groups, count(DISTINCT grp) AS n_owners, min(ts) AS first_ts, max(ts) AS last_ts, min(tier) AS best_tier, bool_or(role = 'official') AS o, bool_or(role = 'wire') AS wi, bool_or(role IN ('reporting', 'wire', 'official', 'regulatory_filing')) AS ed, bool_or(role IN ('official', 'regulatory_filing')) AS pr, max(w) AS wm, sum(w) / count(*) AS wa,
 arg_min(title, (tier, -len(title), id)) AS h, substr(string_agg(substr(coalesce(summary, ''), 1, {BODY_CHARS}), ' ' ORDER BY id), 1, {BODY_CHARS}) AS bo, sum(len(coalesce(summary, ''))) AS bc FROM e GROUP BY 1),
x AS (SELECT *, h || ' ' || bo AS t FROM b, nw WHERE h IS NOT NULL),
q AS (SELECT *, {_words('CLICKBAIT', 'h')} AS cb, {_words('RUMOR', 't')} AS ru, {_words('ATTRIBUTION', 't')} AS att, {_words('HYPE', 'h')} AS hy, len(regexp_extract_all(h, '[！!？?]')) AS m, len(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?')) AS f, regexp_matches(h, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F000}}-\\x{{1F2FF}}]') AS em, greatest(0, last_ts - first_ts) / 3600 AS span FROM x),
p AS (SELECT *, greatest(0.0, least(1.0, 0.62 - least(0.30, 0.10 * cb) - least(0.28, 0.12 * ru) * CASE WHEN att > 0 THEN 0.5 ELSE 1.0 END + least(0.20, 0.07 * att) - least(0.12, 0.06 * hy) - CASE WHEN m >= 2 THEN 0.10 WHEN m = 1 AND regexp_matches(h, '[！!]$') THEN 0.04 ELSE 0 END - CASE WHEN em THEN 0.08 ELSE 0 END
 + CASE WHEN f >= 3 THEN 0.10 WHEN f >= 1 THEN 0.04 ELSE 0 END + CASE WHEN regexp_matches(t, '[“”"「」]') THEN 0.04 ELSE 0 END - CASE WHEN len(h) < 8 THEN 0.06 ELSE 0 END - CASE WHEN len(h) > 60 THEN 0.04 ELSE 0 END + CASE WHEN bc >= 120 THEN 0.05 WHEN bc = 0 THEN -0.05 ELSE 0 END)) AS content,
 CASE WHEN first_ts > now + 3600 THEN 0.30 WHEN n_items <= 1 THEN 0.60 WHEN span <= 6 THEN 1.00 WHEN span <= 24 THEN 0.85 WHEN span <= 48 THEN 0.60 ELSE 0.42 END AS timing, least(1.0, greatest(1 - exp(-0.85 * greatest(n_groups - 1, 0)), CASE WHEN o THEN 0.25 WHEN wi THEN 0.15 ELSE 0 END)) AS corr FROM q)"""


@query("F28_credibility", f"WITH {_SCORED_SQL} SELECT cluster_id, n_items, n_groups, best_tier, round(100 * (0.40 * (0.7 * wm + 0.3 * wa) + 0.30 * corr + 0.20 * content + 0.10 * timing), 4) AS cred FROM p")
def credibilities(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("cluster_id", "n_items", "n_groups", "best_tier", F.round("cred", 4).alias("cred"))


_TROUBLED = f"""dis AS (SELECT cluster_id FROM (WITH {_CLAIM_SQL}, {STATUS_SQL} SELECT * FROM st) WHERE status = 'disputed'),
ill AS (SELECT DISTINCT it.cluster_id FROM it JOIN (WITH {PR_SQL} SELECT lower(trim(source_id)) AS source_id FROM pr GROUP BY 1 HAVING arg_max(verdict, (ts, id)) IN ('degraded', 'unhealthy', 'down')) h ON h.source_id = it.source_id WHERE it.cluster_id IS NOT NULL)"""


@query("F31_doubt", f"WITH {_SCORED_SQL}, {_TROUBLED} SELECT p.cluster_id, least(100, CASE WHEN dis.cluster_id IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN ill.cluster_id IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN ru > 0 THEN CASE WHEN att > 0 THEN 9 ELSE 18 END ELSE 0 END + least(18, 6 * cb) + CASE WHEN hy > 0 THEN 10 ELSE 0 END + CASE WHEN m >= 2 OR em THEN 5 ELSE 0 END + CASE WHEN (ru > 0)::INT + (cb > 0)::INT + (hy > 0)::INT + (m >= 2 OR em)::INT >= 3 THEN 8 ELSE 0 END + CASE WHEN NOT ed THEN 15 WHEN n_groups = 0 AND NOT pr THEN 10 ELSE 0 END + CASE WHEN n_items >= 3 AND n_owners = 1 THEN 8 ELSE 0 END + CASE WHEN first_ts > now + 3600 THEN 12 WHEN n_items > 1 AND span > 48 THEN 10 ELSE 0 END)::INT AS doubt FROM p LEFT JOIN dis ON dis.cluster_id = p.cluster_id LEFT JOIN ill ON ill.cluster_id = p.cluster_id")
def doubts(spark: SparkSession, folder: str) -> DataFrame:
    """Points against each cluster: wording, sources, times, a disputed claim, and sources whose last probe failed."""
    disputed = claim_status(spark, folder).filter("status = 'disputed'").select("cluster_id", F.lit(DOUBT["disputed"]).alias("d"))
    last = probes(spark, folder).groupBy(source_key().alias("source_id")).agg(F.max(F.struct("ts", "id", "verdict")).alias("x")).filter(F.col("x.verdict").isin("degraded", "unhealthy", "down"))
    ill = items(spark, folder, "cluster_id").filter("cluster_id is not null").join(last.select("source_id"), "source_id", "left_semi").select("cluster_id", F.lit(DOUBT["degraded"]).alias("h")).distinct()
    both = scored(spark, folder).select("cluster_id", "doubt").join(disputed, "cluster_id", "left").join(ill, "cluster_id", "left")
    return both.select("cluster_id", F.least(F.lit(100), F.col("doubt") + F.coalesce("d", F.lit(0)) + F.coalesce("h", F.lit(0))).cast("int").alias("doubt"))


@query("F30_blend", f"WITH {_SCORED_SQL}, r AS (SELECT cluster_id, 100 * (0.40 * (0.7 * wm + 0.3 * wa) + 0.30 * corr + 0.20 * content + 0.10 * timing) AS cred, ru, cb FROM p) SELECT cluster_id, round(greatest(0, least(100, 0.75 * cred + 0.25 * 50 - least(12.0, 4.0 * (ru + cb)))), 4) AS cred FROM r")
def blended(spark: SparkSession, folder: str) -> DataFrame:
    """The rule score with a neutral verdict mixed in, less four points a flag."""
    s = scored(spark, folder)
    flags = F.size(contains_any(F.concat_ws(" ", "headline", "bodies"), scoring.RUMOR)) + F.size(contains_any(F.col("headline"), scoring.CLICKBAIT))
    mixed = 0.75 * F.col("cred") + 0.25 * 50 - F.least(F.lit(12.0), 4.0 * flags)
    return s.select("cluster_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mixed)), 4).alias("cred"))
