"""Dictionary extraction: which entities of a catalogue a text names.

No text is held against every alias. Texts and aliases meet on an anchor, the first word of a
Latin alias or the first two characters of a Chinese one; only where anchors meet is the whole
alias looked for. The catalogue may grow with the desk: it is joined by size, not broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.functions import text
from galley.plans.catalog import query
from galley.sources.snapshots import CL_SQL, IT_SQL, clusters, items, sources

#: Full-width signs, letters and digits, and the plain ones: 94 of either, in order.
WIDE, PLAIN = "".join(chr(n) for n in range(0xFF01, 0xFF5F)), "".join(chr(n) for n in range(0x21, 0x7F))
CATALOGUE = "entity_id string, name string, kind string, aliases array<string>, context array<string>, against array<string>"
EVIDENCE = 3


def folded(t: Column) -> Column:
    """A text as it is compared: full-width signs plain, lower case."""
    return F.lower(F.translate(F.coalesce(t, F.lit("")), WIDE + "　", PLAIN + " "))


def anchors(t: Column) -> Column:
    """The words of a folded text, and its Chinese characters and pairs of them."""
    runs = F.regexp_extract_all(t, F.lit(f"[{text.CJK}]+"), F.lit(0))
    single = F.flatten(F.transform(runs, lambda r: F.filter(F.split(r, ""), lambda c: c != "")))
    pairs = F.flatten(F.transform(runs, text.bigrams))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), single, pairs))


def anchor(alias: Column) -> Column:
    """The one anchor of a folded alias."""
    han = F.regexp_extract(alias, f"^[{text.CJK}]{{1,2}}", 0)
    return F.when(han != "", han).otherwise(F.regexp_extract(alias, "[a-z0-9]+", 0))


def names(t: Column, term: Column) -> Column:
    """Whether a folded text has a folded term: Latin ones as whole words, others anywhere."""
    latin = term.rlike("[a-z]")
    pattern = F.concat(F.lit("(?<![a-z0-9])\\Q"), term, F.lit("\\E(?![a-z0-9])"))
    return F.when(latin, F.regexp_like(t, pattern)).otherwise(F.contains(t, term))


def mentions(texts: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """(key, entity_id, name, kind, hits): the entities that (key, text) names, with up to EVIDENCE of their aliases.

    An entity with context terms counts only beside one of them, and never beside a term of
    `against`. Null texts name nothing.
    """
    folded_texts = texts.select(F.col(key).alias("k"), folded(F.col("text")).alias("t")).filter("t <> ''")
    aliases = catalogue.select("entity_id", F.posexplode("aliases").alias("place", "alias")).withColumn("a", folded(F.trim("alias"))).filter("a <> ''").withColumn("anchor", anchor(F.col("a"))).filter("anchor <> ''")
    met = folded_texts.select("k", "t", F.explode(anchors(F.col("t"))).alias("anchor")).join(aliases, "anchor").filter(names(F.col("t"), F.col("a")))
    once = met.groupBy("k", "entity_id", "a").agg(F.min(F.struct("place", "alias")).alias("x"), F.first("t").alias("t"))
    hits = once.groupBy("k", "entity_id").agg(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, EVIDENCE), lambda x: x["alias"]).alias("hits"), F.first("t").alias("t"))
    terms = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), folded)
    full = hits.join(catalogue.select("entity_id", "name", "kind", terms(F.col("context")).alias("context"), terms(F.col("against")).alias("against")), "entity_id")
    beside = (F.size("context") == 0) | F.exists("context", lambda w: names(F.col("t"), w))
    kept = full.filter(beside & ~F.exists("against", lambda w: F.contains(F.col("t"), w)))
    return kept.select(F.col("k").alias(key), "entity_id", "name", "kind", "hits")


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The source registry as a catalogue."""
    none = F.array().cast("array<string>")
    return sources(spark, folder).select(F.col("id").alias("entity_id"), "name", F.lit("source").alias("kind"), F.array("name").alias("aliases"), none.alias("context"), none.alias("against"))


_NAMED = "regexp_matches(lower(it.title), '(^|[^a-z0-9])' || lower(d.name) || '($|[^a-z0-9])')"


@query("F21_entity_links", f"WITH {IT_SQL} SELECT it.id, d.id AS entity_id, d.name FROM it JOIN sources d ON {_NAMED}")
def entity_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every title with the names of the registry in it."""
    return mentions(items(spark, folder, "title").select("id", F.col("title").alias("text")), registry(spark, folder), "id").select("id", "entity_id", "name")


@query("J18_dictionary_join", f"WITH {IT_SQL}, d AS (SELECT name FROM sources) SELECT d.name, count(*) AS n FROM it JOIN d ON {_NAMED} GROUP BY 1")
def dictionary_join(spark: SparkSession, folder: str) -> DataFrame:
    """How many titles mention each name of the registry."""
    return entity_links(spark, folder).groupBy("name").agg(F.count("*").alias("n"))


@query("A28_entity_clusters", f"WITH {IT_SQL} SELECT d.id AS entity_id, count(DISTINCT it.cluster_id) AS n_clusters, count(*) AS n_items FROM it JOIN sources d ON {_NAMED} WHERE it.cluster_id IS NOT NULL GROUP BY 1")
def entity_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters and items that name each entity; one row per cluster and entity before the distinct count."""
    it = items(spark, folder, "title", "cluster_id").filter("cluster_id is not null")
    found = mentions(it.select("id", F.col("title").alias("text")), registry(spark, folder), "id").join(it.select("id", "cluster_id"), "id")
    own = found.groupBy("entity_id", "cluster_id").agg(F.count("*").alias("n"))
    return own.groupBy("entity_id").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_items"))


RADAR, CANDIDATES, HOURS = 30, 1500, 72


@query("Q06_ai_radar", f"WITH {CL_SQL}, {IT_SQL}, m AS (SELECT max(last_ts) AS now FROM cl), top AS (SELECT cl.* FROM cl, m WHERE rank IS NOT NULL AND last_ts >= m.now - {HOURS} * 3600 ORDER BY rank DESC, id LIMIT {CANDIDATES}), ai AS (SELECT * FROM top WHERE len(list_filter(coalesce(topics, []), lambda x: starts_with(x, 'ai'))) > 0), o AS (SELECT DISTINCT it.cluster_id FROM it JOIN sources s ON s.id = it.source_id WHERE s.source_role = 'official'), e AS (SELECT ai.id, cred, rank, CASE WHEN n_groups >= 2 THEN 'independent' WHEN o.cluster_id IS NOT NULL THEN 'primary' ELSE 'single' END AS evidence FROM ai LEFT JOIN o ON o.cluster_id = ai.id) SELECT id, evidence, row_number() OVER (ORDER BY evidence = 'independent' DESC, evidence = 'primary' DESC, cred DESC NULLS LAST, rank DESC, id) AS place FROM e QUALIFY place <= {RADAR}")
def ai_radar(spark: SparkSession, folder: str) -> DataFrame:
    """The front of one theme: best evidence first, then credibility and rank, of the best ranked recent clusters."""
    cl = clusters(spark, folder, "last_ts", "rank", "topics", "n_groups", "cred").filter("rank is not null")
    now = F.broadcast(clusters(spark, folder, "last_ts").agg(F.max("last_ts").alias("now")))  # one row
    top = cl.crossJoin(now).filter(F.col("last_ts") >= F.col("now") - HOURS * 3600).orderBy(F.desc("rank"), "id").limit(CANDIDATES)
    ai = top.filter(F.exists(F.coalesce("topics", F.array().cast("array<string>")), lambda x: x.startswith("ai")))
    role = sources(spark, folder).filter("source_role = 'official'").select(F.col("id").alias("source_id"))
    official = items(spark, folder, "cluster_id").filter("cluster_id is not null").join(role, "source_id", "left_semi").select(F.col("cluster_id").alias("id"), F.lit(True).alias("official")).distinct()
    evidence = F.when(F.col("n_groups") >= 2, "independent").when(F.col("official"), "primary").otherwise("single")
    rows = ai.join(official, "id", "left").withColumn("evidence", evidence)
    order = [F.desc(F.col("evidence") == "independent"), F.desc(F.col("evidence") == "primary"), F.desc_nulls_last("cred"), F.desc("rank"), F.col("id")]
    best = rows.orderBy(*order).limit(RADAR)
    place = F.row_number().over(Window.partitionBy().orderBy(*order))  # of RADAR rows
    return best.select("id", "evidence", place.cast("bigint").alias("place"))


@query("Q03_stats", f"WITH {CL_SQL}, {IT_SQL}, m AS (SELECT max(fetched_ts) - 86400 AS day FROM it), r AS (SELECT cl.* FROM cl, m WHERE last_ts >= m.day), d AS (SELECT it.* FROM it, m WHERE published_ts >= m.day) SELECT 'total' AS part, 'clusters' AS name, count(*) AS n FROM cl UNION ALL SELECT 'total', 'items', count(*) FROM it UNION ALL SELECT 'band', coalesce(cred_code, ''), count(*) FROM cl GROUP BY 2 UNION ALL SELECT 'day', 'fresh', count(*) FROM r UNION ALL SELECT 'day', 'corroborated', count(*) FILTER (WHERE n_groups >= 2) FROM r UNION ALL SELECT 'day', 'noise', count(*) FILTER (WHERE relevance < 0.28 OR cred < 40) FROM r UNION ALL SELECT 'topic', topics[1], count(*) FROM r WHERE len(topics) > 0 GROUP BY 2 UNION ALL SELECT 'source_lang', coalesce(lang, 'zh'), count(*) FROM sources WHERE coalesce(enabled, true) GROUP BY 2 UNION ALL SELECT 'item_lang', coalesce(nullif(lang, ''), 'unknown'), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'owner', coalesce(s.owner, 'unknown'), count(*) FROM d LEFT JOIN sources s ON s.id = d.source_id GROUP BY 2 UNION ALL SELECT 'role', coalesce(s.source_role, 'unknown'), count(*) FROM d LEFT JOIN sources s ON s.id = d.source_id GROUP BY 2")
def stats(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, bands and the last day by topic, language, owner and role, as (part, name, n)."""
    it = items(spark, folder, "published_ts", "lang")
    cl = clusters(spark, folder, "last_ts", "cred_code", "n_groups", "relevance", "cred", "topics")
    so = sources(spark, folder)
    day = F.broadcast(it.agg((F.max("fetched_ts") - 86_400).alias("day")))  # one row
    recent = cl.crossJoin(day).filter("last_ts >= day")
    today = it.crossJoin(day).filter("published_ts >= day").join(so.select(F.col("id").alias("source_id"), "owner", "source_role"), "source_id", "left")

    def by(df: DataFrame, part: str, name: Column) -> DataFrame:
        return df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n")

    sums = recent.agg(F.count("*").alias("fresh"), F.count_if(F.col("n_groups") >= 2).alias("corroborated"), F.count_if((F.col("relevance") < 0.28) | (F.col("cred") < 40)).alias("noise"))
    parts = [
        cl.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("clusters").alias("name"), "n"), it.agg(F.count("*").alias("n")).select(F.lit("total").alias("part"), F.lit("items").alias("name"), "n"),
        by(cl, "band", F.coalesce("cred_code", F.lit(""))), sums.select(F.lit("day").alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in sums.columns])).alias("x")).select("part", "x.*"),
        by(recent.filter("size(topics) > 0"), "topic", F.try_element_at("topics", F.lit(1))), by(so.filter(F.coalesce("enabled", F.lit(True))), "source_lang", F.coalesce("lang", F.lit("zh"))),
        by(today, "item_lang", F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown"))), by(today, "owner", F.coalesce("owner", F.lit("unknown"))), by(today, "role", F.coalesce("source_role", F.lit("unknown"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
