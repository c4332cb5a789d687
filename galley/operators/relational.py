"""Joins, sinks, set operations and constraints over the desk's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.plans.catalog import query
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes, sources

# ---- sinks as pure functions of snapshots


def append_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key isn't there yet, each key once; append these."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if: dict[str, Column] | None = None) -> DataFrame:
    """The snapshot after writing `new` over `old`; both have the same columns.

    `keep_if` names columns of which the old value stays where the condition holds; it may
    use the columns as old_x and new_x.
    """
    names = [c for c in old.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in names], F.lit(True).alias("_old"))
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("_new"))
    both = o.join(n, key, "full_outer")
    out = []
    for c in names:
        value = F.when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
        if keep_if and c in keep_if:
            value = F.when(F.col("_old") & F.col("_new") & keep_if[c], F.col(f"old_{c}")).otherwise(value)
        out.append(value.alias(c))
    return both.select(key, *out)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Child rows after all children of the parents in `new` were replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def accumulate(counters: DataFrame, delta: DataFrame, key: str, sums: list[str], latest: list[str]) -> DataFrame:
    """Counter upsert: sums are added, of `latest` columns the greater non-null value stays."""
    both = counters.unionByName(delta)
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def retain(df: DataFrame, ts: str, since: int | Column) -> DataFrame:
    """Retention: rows at or after a time."""
    return df.filter(F.col(ts) >= since)


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """ON DELETE CASCADE: children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def migrated(df: DataFrame, columns: dict[str, str], version: int) -> DataFrame:
    """A table in the shape of a version: missing columns as nulls, types cast, others dropped; once there it stays so."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()], F.lit(version).alias("schema_version"))


def audited(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, before, after): what a change of rows changed, for the audit trail; a missing row counts as null."""
    a, b = (df.select(key, *[F.col(c).cast("string").alias(f"{side}_{c}") for c in columns]) for side, df in (("a", before), ("b", after)))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in columns])
    return a.join(b, key, "full").select(key, F.explode(rows).alias("x")).select(key, "x.*").filter(~F.col("before").eqNullSafe(F.col("after")))


# ---- registered queries

@query("S11_recent_items", f"WITH {IT_SQL} SELECT id, published_ts FROM it WHERE published_ts BETWEEN (SELECT max(published_ts) - 30*86400 FROM it WHERE published_ts <= fetched_ts) AND (SELECT max(published_ts) FROM it WHERE published_ts <= fetched_ts)")
def recent_items(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "published_ts")
    now = it.filter("published_ts <= fetched_ts").agg(F.max("published_ts").alias("now"))
    return it.join(F.broadcast(now), F.col("published_ts").between(F.col("now") - 30 * 86400, F.col("now"))).select("id", "published_ts")


@query("S12_append_ignore", f"WITH {IT_SQL} SELECT id, fetched_ts FROM it WHERE fetched_ts > (SELECT min(fetched_ts) + 86400*20 FROM items)")
def append_new(spark: SparkSession, folder: str) -> DataFrame:
    from galley.sources.tables import table

    raw = table(spark, folder, "items").select("id", "fetched_ts").filter("id is not null")
    edge = F.broadcast(raw.agg((F.min("fetched_ts") + 86400 * 20).alias("edge")))
    old = raw.join(edge, F.coalesce("fetched_ts", F.lit(0)) <= F.col("edge")).select("id")
    new = raw.join(edge, F.col("fetched_ts") > F.col("edge")).groupBy("id").agg(F.min("fetched_ts").alias("fetched_ts"))
    return append_ignore(old, new, "id")


@query("S13_upsert_clusters", f"WITH {CL_SQL} SELECT id, headline, cred, updated_ts FROM cl")
def upsert_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Older snapshot rows written over by the newest ones."""
    from galley.sources.tables import table

    raw = table(spark, folder, "clusters").select("id", "headline", "cred", "updated_ts").filter("id is not null").dropDuplicates()
    n = Window.partitionBy("id").orderBy(F.col("updated_ts").desc_nulls_last())
    ranked = raw.withColumn("n", F.row_number().over(n))
    return upsert(ranked.filter("n = 2").drop("n"), ranked.filter("n = 1").drop("n"), "id")


@query("S14_health_counters", f"""WITH {PR_SQL} SELECT lower(trim(source_id)) AS source_id, count(*) FILTER (WHERE verdict <> 'down') AS ok_count, count(*) FILTER (WHERE verdict = 'down') AS err_count,
 max(ts) FILTER (WHERE verdict <> 'down') AS last_ok_ts, sum(coalesce(n_new, 0))::BIGINT AS n_new FROM pr GROUP BY 1""")
def health_counters(spark: SparkSession, folder: str) -> DataFrame:
    from galley.sources.snapshots import source_key

    p = probes(spark, folder).withColumn("source_id", source_key())
    down = F.col("verdict") == "down"
    return p.groupBy("source_id").agg(F.count_if(~down).alias("ok_count"), F.count_if(down).alias("err_count"), F.max(F.when(~down, F.col("ts"))).alias("last_ok_ts"), F.sum(F.coalesce("n_new", F.lit(0))).alias("n_new"))


@query("S17_probe_retention", f"WITH {PR_SQL} SELECT count(*) AS kept, min(ts) AS oldest FROM pr WHERE ts >= (SELECT max(ts) - 30*86400 FROM pr)")
def probe_retention(spark: SparkSession, folder: str) -> DataFrame:
    p = probes(spark, folder)
    edge = F.broadcast(p.agg((F.max("ts") - 30 * 86400).alias("edge")))
    return p.join(edge, F.col("ts") >= F.col("edge")).agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


@query("J01_items_of_clusters", f"WITH {IT_SQL}, {CL_SQL} SELECT it.id AS item_id, cl.id AS cluster_id, cl.cred FROM it JOIN cl ON cl.id = it.cluster_id")
def items_of_clusters(spark: SparkSession, folder: str) -> DataFrame:
    it, cl = items(spark, folder, "cluster_id"), clusters(spark, folder, "cred")
    return it.filter("cluster_id is not null").join(cl.select(F.col("id").alias("cluster_id"), "cred"), "cluster_id").select(F.col("id").alias("item_id"), "cluster_id", "cred")


@query("J02_items_left_clusters", f"WITH {IT_SQL}, {CL_SQL} SELECT it.source_id, count(*) AS n_items, count(cl.id) AS n_clustered, count(*) - count(cl.id) AS n_loose FROM it LEFT JOIN cl ON cl.id = it.cluster_id GROUP BY 1")
def items_left_clusters(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id")
    # items without a cluster can't match; spread over made-up keys they don't meet in one task
    it = it.withColumn("key", F.coalesce("cluster_id", F.concat(F.lit("\u0000"), F.col("id"))))
    joined = it.join(clusters(spark, folder).select(F.col("id").alias("key"), F.lit(1).alias("hit")), "key", "left")
    return joined.groupBy("source_id").agg(F.count("*").alias("n_items"), F.count("hit").alias("n_clustered"), (F.count("*") - F.count("hit")).alias("n_loose"))


@query("J04_three_way", f"WITH {IT_SQL}, {CL_SQL} SELECT s.grp, count(*) AS n, count(DISTINCT cl.id) AS n_clusters FROM it JOIN cl ON cl.id = it.cluster_id JOIN sources s ON s.id = it.source_id GROUP BY 1")
def three_way(spark: SparkSession, folder: str) -> DataFrame:
    it, cl, so = items(spark, folder, "cluster_id"), clusters(spark, folder), sources(spark, folder)
    joined = it.filter("cluster_id is not null").join(cl.select(F.col("id").alias("cluster_id")), "cluster_id")
    joined = joined.join(so.select(F.col("id").alias("source_id"), "grp"), "source_id")  # the registry is small: broadcast by its size
    return joined.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct("cluster_id").alias("n_clusters"))


@query("J06_semi", f"WITH {IT_SQL}, {CL_SQL} SELECT id, n_items FROM cl WHERE EXISTS (SELECT 1 FROM it JOIN sources s ON s.id = it.source_id WHERE it.cluster_id = cl.id AND s.source_role = 'official')")
def semi(spark: SparkSession, folder: str) -> DataFrame:
    official = sources(spark, folder).filter("source_role = 'official'").select(F.col("id").alias("source_id"))
    hit = items(spark, folder, "cluster_id").join(official, "source_id", "left_semi").select(F.col("cluster_id").alias("id"))
    return clusters(spark, folder, "n_items").join(hit, "id", "left_semi").select("id", "n_items")


@query("J07_anti", f"WITH {IT_SQL}, {CL_SQL} SELECT 'cluster without items' AS what, count(*) AS n FROM cl WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.cluster_id = cl.id) UNION ALL SELECT 'item without its cluster', count(*) FROM it WHERE cluster_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.id = it.cluster_id)")
def anti(spark: SparkSession, folder: str) -> DataFrame:
    it, cl = items(spark, folder, "cluster_id").filter("cluster_id is not null"), clusters(spark, folder)
    orphans = cl.select("id").join(it.select(F.col("cluster_id").alias("id")), "id", "left_anti").agg(F.lit("cluster without items").alias("what"), F.count("*").alias("n"))
    dangling = it.select("cluster_id").join(cl.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti").agg(F.lit("item without its cluster").alias("what"), F.count("*").alias("n"))
    return orphans.unionByName(dangling)


_LEAD = "row_number() OVER (PARTITION BY it.cluster_id ORDER BY (it.source_name = cl.headline_src) DESC NULLS LAST, it.tier, it.published_ts NULLS LAST, it.id)"


@query("J08_lead_item", f"WITH {IT_SQL}, {CL_SQL}, r AS (SELECT it.cluster_id, it.id AS item_id, {_LEAD} AS n FROM it JOIN cl ON cl.id = it.cluster_id) SELECT cluster_id, item_id FROM r WHERE n = 1")
def lead_item(spark: SparkSession, folder: str) -> DataFrame:
    """The item that stands for its cluster: the headline's source first, then tier and time."""
    it, cl = items(spark, folder, "cluster_id", "source_name", "tier", "published_ts"), clusters(spark, folder, "headline_src")
    joined = it.filter("cluster_id is not null").join(cl.select(F.col("id").alias("cluster_id"), "headline_src"), "cluster_id")
    # an argmin keeps one row per cluster in the map-side combine; a window would move all
    best = F.min(F.struct(F.when(F.col("source_name") == F.col("headline_src"), 0).when(F.col("source_name") != F.col("headline_src"), 1).otherwise(2).alias("a"), "tier", F.coalesce("published_ts", F.lit(2**62)).alias("t"), "id"))
    return joined.groupBy("cluster_id").agg(best.alias("x")).select("cluster_id", F.col("x.id").alias("item_id"))


@query("J09_latest_probe", f"WITH {PR_SQL} SELECT source_id, id AS probe_id, ts, verdict FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC NULLS LAST, id DESC) AS n FROM pr) WHERE n = 1")
def latest_probe(spark: SparkSession, folder: str) -> DataFrame:
    x = F.max(F.struct("ts", "id", "verdict"))
    return probes(spark, folder).groupBy("source_id").agg(x.alias("x")).select("source_id", F.col("x.id").alias("probe_id"), F.col("x.ts").alias("ts"), F.col("x.verdict").alias("verdict"))


@query("J10_registry_lookup", f"WITH {IT_SQL} SELECT it.id, coalesce(s.source_role, 'unknown') AS role, coalesce(s.owner, '') AS owner, coalesce(s.region_code, '') AS region FROM it LEFT JOIN sources s ON s.id = it.source_id")
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    so = sources(spark, folder).select(F.col("id").alias("source_id"), "source_role", "owner", "region_code")
    return items(spark, folder).join(so, "source_id", "left").select("id", F.coalesce("source_role", F.lit("unknown")).alias("role"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("region_code", F.lit("")).alias("region"))


@query("J14_within_cluster_pairs", f"WITH {IT_SQL}, o AS (SELECT cluster_id, grp, min(id) AS id FROM it WHERE tier = 1 GROUP BY 1, 2) SELECT a.cluster_id, a.id AS item_a, b.id AS item_b FROM o a JOIN o b ON a.cluster_id = b.cluster_id AND a.grp < b.grp")
def within_cluster_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of first-tier items of one cluster from different owners, one item an owner.

    Owners are as many as the registry has, so a cluster's pairs are bounded, whatever its size.
    """
    it = items(spark, folder, "cluster_id", "grp", "tier").filter("cluster_id is not null and tier = 1 and grp is not null")
    one = it.groupBy("cluster_id", "grp").agg(F.min("id").alias("id"))
    a, b = (one.select("cluster_id", F.col("id").alias(f"item_{k}"), F.col("grp").alias(f"grp_{k}")) for k in "ab")
    return a.join(b, "cluster_id").filter("grp_a < grp_b").select("cluster_id", "item_a", "item_b")


@query("J17_full_outer_periods", f"""WITH {PR_SQL}, m AS (SELECT source_id, CAST(floor(ts / (30*86400)) AS BIGINT) AS period, sum(coalesce(n_new, 0))::BIGINT AS n FROM pr GROUP BY 1, 2)
SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(b.period, a.period + 1) AS period, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS now, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM m a FULL OUTER JOIN m b ON a.source_id = b.source_id AND a.period + 1 = b.period WHERE coalesce(b.period, a.period + 1) <= (SELECT max(period) FROM m)""")
def full_outer_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent periods by key, with keys that appear or vanish."""
    m = probes(spark, folder).groupBy("source_id", F.floor(F.col("ts") / (30 * 86400)).alias("period")).agg(F.sum(F.coalesce("n_new", F.lit(0))).alias("n"))
    a = m.select("source_id", (F.col("period") + 1).alias("period"), F.col("n").alias("before"))
    b = m.select("source_id", "period", F.col("n").alias("now"))
    last = F.broadcast(m.agg(F.max("period").alias("last")))
    out = a.join(b, ["source_id", "period"], "full").join(last, F.col("period") <= F.col("last")).fillna(0, ["before", "now"])
    return out.select("source_id", "period", "before", "now", (F.col("now") - F.col("before")).alias("delta"))


@query("J21_dense_registry", f"WITH {IT_SQL} SELECT s.id AS source_id, count(it.id) AS n_items FROM sources s LEFT JOIN it ON it.source_id = s.id GROUP BY 1")
def dense_registry(spark: SparkSession, folder: str) -> DataFrame:
    n = items(spark, folder).groupBy("source_id").agg(F.count("*").alias("n_items"))
    return sources(spark, folder).select(F.col("id").alias("source_id")).join(n, "source_id", "left").select("source_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))


@query("U02_array_algebra", "SELECT a.id AS a, b.id AS b, len(list_intersect(a.topics, b.topics))::INT AS both_have, len(list_distinct(list_concat(a.topics, b.topics)))::INT AS either_has, len([x FOR x IN list_distinct(a.topics) IF NOT list_contains(b.topics, x)])::INT AS only_a FROM sources a JOIN sources b ON a.grp = b.grp AND a.id < b.id")
def array_algebra(spark: SparkSession, folder: str) -> DataFrame:
    so = sources(spark, folder)
    a, b = (so.select("grp", F.col("id").alias(k), F.col("topics").alias(f"t{k}")) for k in "ab")
    return a.join(b, "grp").filter("a < b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("both_have"), F.size(F.array_union("ta", "tb")).alias("either_has"), F.size(F.array_except("ta", "tb")).alias("only_a"))


@query("U03_row_difference", f"WITH {IT_SQL}, {PR_SQL} SELECT DISTINCT source_id FROM it EXCEPT SELECT id FROM sources UNION ALL (SELECT id FROM sources EXCEPT SELECT source_id FROM it)")
def row_difference(spark: SparkSession, folder: str) -> DataFrame:
    have, known = items(spark, folder).select("source_id").distinct(), sources(spark, folder).select(F.col("id").alias("source_id"))
    return have.exceptAll(known).unionByName(known.exceptAll(have))


@query("U04_union_dedup", f"WITH {IT_SQL}, {CL_SQL} SELECT id, 'item' AS seen_as FROM it UNION ALL SELECT id, 'cluster' FROM cl WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.id = cl.id)")
def union_dedup(spark: SparkSession, folder: str) -> DataFrame:
    a = items(spark, folder).select("id", F.lit("item").alias("seen_as"))
    b = clusters(spark, folder).select("id", F.lit("cluster").alias("seen_as"))
    return a.unionByName(b.join(a.select("id"), "id", "left_anti"))


@query("N01_key_violations", "SELECT 'items' AS name, count(*) AS n FROM (SELECT id FROM items GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'clusters', count(*) FROM (SELECT id FROM clusters GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'documents', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)")
def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    from galley.sources.tables import table

    def bad(name: str, key: str) -> DataFrame:
        return table(spark, folder, name).groupBy(key).count().filter("count > 1").agg(F.lit(name).alias("name"), F.count("*").alias("n"))

    return bad("items", "id").unionByName(bad("clusters", "id")).unionByName(bad("documents", "doc_id"))


@query("N02_check_violations", f"WITH {CL_SQL} SELECT count(*) FILTER (WHERE cred < 0 OR cred > 100) AS bad_cred, count(*) FILTER (WHERE relevance < 0 OR relevance > 1) AS bad_relevance, count(*) FILTER (WHERE cred_code NOT IN ('CONFIRMED', 'LIKELY', 'SINGLE', 'LOW')) AS bad_code, count(*) FILTER (WHERE first_ts > last_ts) AS bad_span FROM cl")
def check_violations(spark: SparkSession, folder: str) -> DataFrame:
    cl = clusters(spark, folder, "cred", "relevance", "cred_code", "first_ts", "last_ts")
    return cl.agg(F.count_if((F.col("cred") < 0) | (F.col("cred") > 100)).alias("bad_cred"), F.count_if((F.col("relevance") < 0) | (F.col("relevance") > 1)).alias("bad_relevance"), F.count_if(~F.col("cred_code").isin("CONFIRMED", "LIKELY", "SINGLE", "LOW")).alias("bad_code"), F.count_if(F.col("first_ts") > F.col("last_ts")).alias("bad_span"))


@query("N03_cascade", f"WITH {IT_SQL}, {CL_SQL} SELECT it.id FROM it WHERE EXISTS (SELECT 1 FROM cl WHERE cl.id = it.cluster_id AND cl.cred >= 40)")
def cascade_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items left after clusters of low credibility were deleted with their items."""
    return cascade(items(spark, folder, "cluster_id"), clusters(spark, folder, "cred").filter("cred >= 40"), "cluster_id", "id").select("id")


@query("N09_audit_trail", f"WITH {CL_SQL}, s AS (SELECT id, max(updated_ts) AS now FROM clusters WHERE id IS NOT NULL GROUP BY 1), o AS (SELECT c.id, max(c.updated_ts) AS was FROM clusters c JOIN s ON s.id = c.id AND c.updated_ts < s.now GROUP BY 1), b AS (SELECT c.id, min(c.n_items) AS n_items, min(c.n_groups) AS n_groups FROM clusters c JOIN o ON o.id = c.id AND o.was = c.updated_ts GROUP BY 1) SELECT b.id, v.col AS \"column\", v.x AS before, v.y AS after FROM b JOIN cl ON cl.id = b.id, LATERAL (VALUES ('n_items', b.n_items::VARCHAR, cl.n_items::VARCHAR), ('n_groups', b.n_groups::VARCHAR, cl.n_groups::VARCHAR)) v(col, x, y) WHERE v.x IS DISTINCT FROM v.y")
def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """What the current row of each cluster changed against the snapshot before it."""
    from galley.sources.tables import table

    all_ = table(spark, folder, "clusters").filter("id is not null").select("id", "updated_ts", "n_items", "n_groups")
    now = all_.groupBy("id").agg(F.max("updated_ts").alias("now"))
    older = all_.join(now, "id").filter("updated_ts < now")
    was = older.groupBy("id").agg(F.max("updated_ts").alias("updated_ts"))
    before = older.join(was, ["id", "updated_ts"]).groupBy("id").agg(F.min("n_items").alias("n_items"), F.min("n_groups").alias("n_groups"))
    return audited(before, clusters(spark, folder, "n_items", "n_groups").join(before.select("id"), "id", "left_semi"), "id", ["n_items", "n_groups"])
