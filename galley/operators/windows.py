"""Window functions, rankings, paging and interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.plans.catalog import query
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes

#: Length of the front list of a feed, within which interleaving and owner caps work.
FEED = 400


@query("W01_first_in_cluster", f"WITH {IT_SQL}, r AS (SELECT id, cluster_id, published_ts, published_ts = min(published_ts) OVER (PARTITION BY cluster_id) AS is_first FROM it WHERE cluster_id IS NOT NULL AND published_ts IS NOT NULL) SELECT id, cluster_id FROM r WHERE is_first")
def first_in_cluster(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "published_ts").filter("cluster_id is not null and published_ts is not null")
    first = it.groupBy("cluster_id").agg(F.min("published_ts").alias("published_ts"))
    return it.join(first, ["cluster_id", "published_ts"], "left_semi").select("id", "cluster_id")


@query("W02_top_by_topic", f"WITH {CL_SQL}, t AS (SELECT id, unnest(list_distinct(topics)) AS topic, rank FROM cl WHERE rank IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rank DESC, id) AS place FROM t) SELECT topic, place, id FROM r WHERE place <= 5")
def top_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    t = clusters(spark, folder, "topics", "rank").filter("rank is not null").select("id", F.explode(F.array_distinct("topics")).alias("topic"), "rank")
    # a group-limit is pushed below the shuffle, so each task sends at most five rows a topic
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("rank"), "id"))
    return t.withColumn("place", place).filter("place <= 5").select("topic", F.col("place").cast("bigint").alias("place"), "id")


_DELTA = f"""{PR_SQL}, m AS (SELECT source_id, CAST(floor(ts / (7*86400)) AS BIGINT) AS week, sum(coalesce(n_new, 0))::BIGINT AS n FROM pr GROUP BY 1, 2),
d AS (SELECT source_id, week, n, coalesce(CASE WHEN lag(week) OVER w = week - 1 THEN lag(n) OVER w END, 0) AS prev FROM m WINDOW w AS (PARTITION BY source_id ORDER BY week))"""


def weekly_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """New items per source and week with the week before; a missing week counts as none."""
    m = probes(spark, folder).groupBy("source_id", F.floor(F.col("ts") / (7 * 86400)).alias("week")).agg(F.sum(F.coalesce("n_new", F.lit(0))).alias("n"))
    w = Window.partitionBy("source_id").orderBy("week")
    prev = F.coalesce(F.when(F.lag("week").over(w) == F.col("week") - 1, F.lag("n").over(w)), F.lit(0))
    return m.withColumn("prev", prev)


@query("W03_period_delta", f"WITH {_DELTA} SELECT source_id, week, n, prev, n - prev AS delta, CASE WHEN prev = 0 THEN 'new' WHEN n = 0 THEN 'exit' WHEN n > prev THEN 'add' ELSE 'trim' END AS kind FROM d WHERE abs(n - prev) >= 1")
def period_delta(spark: SparkSession, folder: str) -> DataFrame:
    d = weekly_deltas(spark, folder).filter(F.abs(F.col("n") - F.col("prev")) >= 1)
    kind = F.when(F.col("prev") == 0, "new").when(F.col("n") == 0, "exit").when(F.col("n") > F.col("prev"), "add").otherwise("trim")
    return d.select("source_id", "week", "n", "prev", (F.col("n") - F.col("prev")).alias("delta"), kind.alias("kind"))


@query("W04_streak", f"WITH {_DELTA}, c AS (SELECT source_id, week, n > prev AS up FROM d WHERE n <> prev), s AS (SELECT source_id, week, up, lag(up) OVER (PARTITION BY source_id ORDER BY week) = up AS same FROM c) SELECT source_id, week, up, coalesce(same, false) AS streak FROM s")
def streak(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a change goes the way of the last change; weeks without change are passed over."""
    c = weekly_deltas(spark, folder).filter("n <> prev").select("source_id", "week", (F.col("n") > F.col("prev")).alias("up"))
    same = F.lag("up").over(Window.partitionBy("source_id").orderBy("week")) == F.col("up")
    return c.withColumn("streak", F.coalesce(same, F.lit(False)))


def front(spark: SparkSession, folder: str) -> DataFrame:
    """The FEED best ranked clusters with the owner and language of their headline's source."""
    from galley.sources.snapshots import sources

    top = clusters(spark, folder, "rank", "headline_src", "relevance", "cred").filter("rank is not null").orderBy(F.desc("rank"), "id").limit(FEED)
    so = sources(spark, folder).select(F.col("name").alias("headline_src"), "owner", "lang").dropDuplicates(["headline_src"])
    return top.join(so, "headline_src", "left").select("id", "rank", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce(F.col("lang") == "zh", F.lit(False)).alias("minor"))


_FRONT = f"{CL_SQL}, top AS (SELECT id, rank, headline_src FROM cl WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT {FEED}), f AS (SELECT t.id, t.rank, coalesce(s.owner, '') AS owner, coalesce(s.lang = 'zh', false) AS minor FROM top t LEFT JOIN (SELECT name, any_value(owner) AS owner, any_value(lang) AS lang FROM sources GROUP BY 1) s ON s.name = t.headline_src)"


#: Share of a list that one owner may fill, and the length of the list.
OWNER_SHARE, CAPPED = 0.30, 60


@query("W05_owner_cap", f"WITH {_FRONT}, n AS (SELECT owner, count(*) AS n FROM f GROUP BY 1), t AS (SELECT least({CAPPED}, sum(n))::BIGINT AS target, count(*) AS owners FROM n), k AS (SELECT range AS cap FROM range(1, {FEED} + 1)), c AS (SELECT min(cap) AS cap FROM (SELECT k.cap FROM k, n, t WHERE k.cap >= greatest(1, ceil({OWNER_SHARE} * t.target), ceil(t.target / least(t.owners, t.target))) GROUP BY k.cap, t.target HAVING sum(least(n.n, k.cap)) >= t.target)), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rank DESC, id) AS k FROM f), p AS (SELECT r.id, r.owner, r.k, row_number() OVER (ORDER BY rank DESC, id) AS place FROM r, c WHERE r.k <= c.cap) SELECT id, owner, k, place FROM p, t WHERE place <= t.target")
def owner_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The first CAPPED rows of the front list, no owner with more than its share; the cap grows where owners are scarce.

    The front list has no more than FEED rows, whatever the size of the table.
    """
    f = front(spark, folder)
    n = f.groupBy("owner").agg(F.count("*").alias("n"))
    t = n.agg(F.least(F.lit(CAPPED), F.sum("n")).alias("target"), F.count("*").alias("owners"))
    least = F.greatest(F.lit(1), F.ceil(OWNER_SHARE * F.col("target")), F.ceil(F.col("target") / F.least("owners", "target")))
    tried = n.crossJoin(F.broadcast(t)).withColumn("cap", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(FEED).cast("bigint")))).filter(F.col("cap") >= least)
    fits = tried.groupBy("cap", "target").agg(F.sum(F.least("n", "cap")).alias("room")).filter("room >= target")
    cap = F.broadcast(fits.groupBy("target").agg(F.min("cap").alias("cap")))  # one row
    k = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("rank"), "id"))
    kept = f.withColumn("k", k.cast("bigint")).crossJoin(cap).filter("k <= cap")
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rank"), "id"))
    return kept.withColumn("place", place.cast("bigint")).filter("place <= target").select("id", "owner", "k", "place")


def interleave(df: DataFrame, minor: Column, order: list[Column], every: int) -> DataFrame:
    """Ranks two kinds into one list: `every` of the major kind, then one of the minor."""
    n = F.row_number().over(Window.partitionBy("minor").orderBy(*order))
    turned = df.withColumn("minor", minor).withColumn("_n", n)
    turned = turned.withColumn("_turn", F.when(F.col("minor"), F.col("_n") - 1).otherwise(F.floor((F.col("_n") - 1) / every)))
    place = F.row_number().over(Window.partitionBy().orderBy("_turn", "minor", "_n"))
    return turned.withColumn("place", place).drop("_n", "_turn")


@query("W06_interleave", f"WITH {_FRONT}, n AS (SELECT *, row_number() OVER (PARTITION BY minor ORDER BY rank DESC, id) AS n FROM f), t AS (SELECT *, CASE WHEN minor THEN n - 1 ELSE (n - 1) // 4 END AS turn FROM n) SELECT id, minor, row_number() OVER (ORDER BY turn, minor, n) AS place FROM t")
def interleaved(spark: SparkSession, folder: str) -> DataFrame:
    # the list is the front FEED rows, whatever the size of the table
    return interleave(front(spark, folder), F.col("minor"), [F.desc("rank"), F.col("id")], 4).select("id", "minor", F.col("place").cast("bigint").alias("place"))


@query("W07_lead_time", f"WITH {IT_SQL}, f AS (SELECT cluster_id, min(published_ts) AS first_ts, arg_min(grp, (published_ts, id)) AS first_grp FROM it WHERE cluster_id IS NOT NULL AND published_ts IS NOT NULL GROUP BY 1) SELECT it.cluster_id, f.first_grp, min(it.published_ts) - f.first_ts AS lead_s FROM it JOIN f ON f.cluster_id = it.cluster_id WHERE it.grp <> f.first_grp AND it.published_ts IS NOT NULL GROUP BY it.cluster_id, f.first_grp, f.first_ts")
def lead_time(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds from a cluster's first report to the first one of another owner."""
    it = items(spark, folder, "cluster_id", "published_ts", "grp").filter("cluster_id is not null and published_ts is not null")
    # one row per cluster and owner is enough
    g = it.groupBy("cluster_id", "grp").agg(F.min(F.struct("published_ts", "id")).alias("x"))
    first = g.groupBy("cluster_id").agg(F.min(F.struct("x", "grp")).alias("f"))
    other = g.join(first, "cluster_id").filter("grp <> f.grp")
    return other.groupBy("cluster_id", F.col("f.grp").alias("first_grp"), F.col("f.x.published_ts").alias("first_ts")).agg(F.min("x.published_ts").alias("t")).select("cluster_id", "first_grp", (F.col("t") - F.col("first_ts")).alias("lead_s"))


@query("W08_share_of_total", f"WITH {IT_SQL}, n AS (SELECT grp, count(*) AS n FROM it GROUP BY 1) SELECT grp, n, round(n / sum(n) OVER (), 6) AS share FROM n")
def share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    from galley.operators.aggregates import shares

    return shares(items(spark, folder, "grp"), "grp").withColumn("share", F.round("share", 6))


@query("W09_day_difference", f"WITH {PR_SQL}, d AS (SELECT source_id, CAST(floor(ts / 86400) AS BIGINT) AS day, avg(ms) AS ms FROM pr WHERE ms IS NOT NULL GROUP BY 1, 2), l AS (SELECT source_id, day, ms, lag(ms) OVER (PARTITION BY source_id ORDER BY day) AS before FROM d) SELECT source_id, day, round(ms - before, 3) AS change FROM l WHERE before IS NOT NULL")
def day_difference(spark: SparkSession, folder: str) -> DataFrame:
    d = probes(spark, folder).filter("ms is not null").groupBy("source_id", F.floor(F.col("ts") / 86400).alias("day")).agg(F.avg("ms").alias("ms"))
    before = F.lag("ms").over(Window.partitionBy("source_id").orderBy("day"))
    return d.withColumn("before", before).filter("before is not null").select("source_id", "day", F.round(F.col("ms") - F.col("before"), 3).alias("change"))


@query("W10_backoff", f"WITH {PR_SQL}, n AS (SELECT source_id, count(*) AS n FROM pr WHERE verdict = 'down' GROUP BY 1) SELECT source_id, n AS attempts, least(3600, 60 * pow(2, least(n, 6)))::DOUBLE AS wait_s FROM n")
def backoff(spark: SparkSession, folder: str) -> DataFrame:
    n = probes(spark, folder).filter("verdict = 'down'").groupBy("source_id").agg(F.count("*").alias("attempts"))
    return n.withColumn("wait_s", F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), F.least("attempts", F.lit(6)))))


@query("K01_top_ranked", f"WITH {CL_SQL} SELECT id, rank FROM cl WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT 80")
def top_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(spark, folder, "rank").filter("rank is not null").orderBy(F.desc("rank"), "id").limit(80).select("id", "rank")


@query("K02_case_sort", f"WITH {IT_SQL} SELECT id FROM it ORDER BY CASE WHEN length(coalesce(summary, '')) < 80 THEN 0 ELSE 1 END, tier, fetched_ts DESC NULLS LAST, id LIMIT 100")
def case_sort(spark: SparkSession, folder: str) -> DataFrame:
    thin = F.when(F.length(F.coalesce("summary", F.lit(""))) < 80, 0).otherwise(1)
    return items(spark, folder, "summary", "tier").orderBy(thin, "tier", F.desc_nulls_last("fetched_ts"), "id").limit(100).select("id")


@query("K03_page", f"WITH {CL_SQL} SELECT id, (SELECT count(*) FROM cl) AS total FROM cl ORDER BY last_ts DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def page(spark: SparkSession, folder: str) -> DataFrame:
    cl = clusters(spark, folder, "last_ts")
    total = F.broadcast(cl.agg(F.count("*").alias("total")))
    return cl.orderBy(F.desc_nulls_last("last_ts"), "id").offset(100).limit(50).select("id").crossJoin(total)


@query("K04_latest_forward", f"WITH {PR_SQL}, l AS (SELECT id, ts FROM pr ORDER BY ts DESC, id DESC LIMIT 60) SELECT id, ts, row_number() OVER (ORDER BY ts, id) AS place FROM l")
def latest_forward(spark: SparkSession, folder: str) -> DataFrame:
    last = probes(spark, folder).orderBy(F.desc("ts"), F.desc("id")).limit(60).select("id", "ts")
    return last.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("ts", "id")).cast("bigint"))  # sixty rows


@query("K07_timeline", f"WITH {IT_SQL}, r AS (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(published_ts, fetched_ts), tier, id) AS place FROM it WHERE cluster_id IS NOT NULL) SELECT cluster_id, place, id FROM r WHERE place <= 50")
def timeline(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "published_ts", "tier").filter("cluster_id is not null")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.coalesce("published_ts", "fetched_ts"), "tier", "id"))
    return it.withColumn("place", place).filter("place <= 50").select("cluster_id", F.col("place").cast("bigint").alias("place"), "id")
