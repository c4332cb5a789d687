"""Projections, predicates and text operators over items and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import dates, features, scoring, text
from galley.plans.catalog import query
from galley.sources.snapshots import CL_SQL, IT_SQL, PR_SQL, clusters, items, probes, sources

_HAN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
_TITLE = "coalesce(nullif(canonical_title, ''), title, '')"
#: The tokens of the expression t in SQL.
_TOKENS = f"""flatten([CASE WHEN len(r) <= 1 THEN [r] ELSE [substr(r, i, 2) FOR i IN range(1, len(r))] END FOR r IN
 [coalesce(nullif(translate(x, '{text.CJK_STOP}', ''), ''), x) FOR x IN regexp_extract_all(t, '{_HAN}+')]])
 || [lower(w) FOR w IN regexp_extract_all(t, '[A-Za-z][A-Za-z0-9+#.\\-]+')] || regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?%?')"""
_TOK_SQL = f"tok AS (SELECT id, {_TOKENS} AS toks FROM (SELECT id, {_TITLE} AS t FROM it))"


def titled(spark: SparkSession, folder: str) -> DataFrame:
    """(id, t): the English rendering of each title, or the title."""
    return items(spark, folder, "title", "canonical_title").select("id", F.coalesce(F.nullif("canonical_title", F.lit("")), "title", F.lit("")).alias("t"))


#: Prefixes of the ids of official sources and of wires.
OFFICIAL, WIRE = "^(gov|pbc|stats|fed|ecb|sec|un)_", "^(xinhua|reuters)_"


def _unescaped_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    for name, sign in text.ENTITIES.items():
        out = f"replace({out}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return out


_BLANKS = "[\\t\\n\\v\\f\\r ]"


def _clean_sql(column: str) -> str:
    return f"trim(regexp_replace(translate(regexp_replace({_unescaped_sql(column)}, '<[^>]+>', ' ', 'g'), chr(12288) || chr(160), '  '), '{_BLANKS}+', ' ', 'g'))"


def _clean_title_sql(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_clean_sql(column)}, '{text.NOTES}', '', 'g'), '(?:[-—_|｜]{_BLANKS}*(?:{text.PUBLISHERS}){_BLANKS}*$)', '', 'g'), ' -—_|｜·、,，。')"


@query("P01_clean_text", f"WITH {IT_SQL} SELECT id, {_clean_sql('summary')} AS clean FROM it")
def clean_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "summary").select("id", text.clean_text("summary").alias("clean"))


@query("P02_clean_title", f"WITH {IT_SQL} SELECT id, trim(regexp_replace(regexp_replace({_clean_sql('title')}, '{text.NOTES}', '', 'g'), '(?:[-—_|｜]{_BLANKS}*(?:{text.PUBLISHERS}){_BLANKS}*$)', '', 'g'), ' -—_|｜·、,，。') AS clean FROM it")
def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").select("id", text.clean_title("title").alias("clean"))


@query("P03_item_id", f"WITH {IT_SQL} SELECT id, substr(sha1(source_id || '|' || title), 1, 20) AS made FROM it WHERE title IS NOT NULL")
def made_ids(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").filter("title is not null").select("id", text.item_id("source_id", "title").alias("made"))


@query("P05_source_role", "SELECT id, CASE WHEN source_role IS NOT NULL AND source_role <> '' THEN source_role WHEN regexp_matches(id, '^(gov|pbc|stats|fed|ecb|sec|un)_') THEN 'official' WHEN regexp_matches(id, '^(xinhua|reuters)_') THEN 'wire' WHEN id = 'hackernews' THEN 'community' WHEN tier = 3 THEN 'aggregator' ELSE 'reporting' END AS role FROM sources")
def source_roles(spark: SparkSession, folder: str) -> DataFrame:
    role = F.when(F.coalesce("source_role", F.lit("")) != "", F.col("source_role")).when(F.col("id").rlike(OFFICIAL), "official").when(F.col("id").rlike(WIRE), "wire").when(F.col("id") == "hackernews", "community").when(F.col("tier") == 3, "aggregator").otherwise("reporting")
    return sources(spark, folder).select("id", role.alias("role"))


@query("P07_health_layers", f"WITH {PR_SQL}, {IT_SQL}, n AS (SELECT source_id, max(published_ts) AS newest FROM it GROUP BY 1) SELECT pr.id, CASE WHEN pr.error IS NOT NULL THEN 'down' WHEN coalesce(pr.n_items, 0) = 0 THEN 'unhealthy' WHEN n.newest IS NULL THEN 'degraded' WHEN greatest(0, pr.ts - n.newest) <= coalesce(s.freshness_hours, 72) * 3600 THEN 'healthy' ELSE 'degraded' END AS layer FROM pr LEFT JOIN n ON n.source_id = pr.source_id LEFT JOIN sources s ON s.id = pr.source_id")
def health_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Reachable, filled, dated and fresh: the newest dated item of the source against the hours it may lie back."""
    newest = items(spark, folder, "published_ts").groupBy("source_id").agg(F.max("published_ts").alias("newest"))
    hours = sources(spark, folder).select(F.col("id").alias("source_id"), "freshness_hours")
    both = probes(spark, folder).join(newest, "source_id", "left").join(hours, "source_id", "left")
    fresh = F.greatest(F.lit(0), F.col("ts") - F.col("newest")) <= F.coalesce("freshness_hours", F.lit(72)) * 3600
    layer = F.when(F.col("error").isNotNull(), "down").when(F.coalesce("n_items", F.lit(0)) == 0, "unhealthy").when(F.col("newest").isNull(), "degraded").when(fresh, "healthy").otherwise("degraded")
    return both.select("id", layer.alias("layer"))


@query("P08_cred_band", f"WITH {CL_SQL} SELECT id, CASE WHEN cred >= 75 THEN 'CONFIRMED' WHEN cred >= 60 THEN 'LIKELY' WHEN cred >= 40 THEN 'SINGLE' ELSE 'LOW' END AS band FROM cl")
def cred_bands(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(spark, folder, "cred").select("id", scoring.cred_band(F.col("cred")).alias("band"))


@query("P10_views", f"WITH {CL_SQL} SELECT id, relevance >= 0.28 AND cred >= 40 AS signal, coalesce(cred_code IN ('SINGLE', 'LOW'), false) AS unverified, relevance < 0.28 OR cred < 40 AS noise FROM cl WHERE relevance IS NOT NULL AND cred IS NOT NULL")
def views(spark: SparkSession, folder: str) -> DataFrame:
    cl = clusters(spark, folder, "relevance", "cred", "cred_code").filter("relevance is not null and cred is not null")
    return cl.select("id", ((F.col("relevance") >= 0.28) & (F.col("cred") >= 40)).alias("signal"), F.coalesce(F.col("cred_code").isin("SINGLE", "LOW"), F.lit(False)).alias("unverified"), ((F.col("relevance") < 0.28) | (F.col("cred") < 40)).alias("noise"))


@query("P13_literal_contains", f"WITH {IT_SQL} SELECT id FROM it WHERE contains(lower(title), 'a') AND contains(title, '%')")
def literal_contains(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").filter(F.contains(F.lower("title"), F.lit("a")) & F.contains("title", F.lit("%"))).select("id")


@query("P14_topic_member", f"WITH {CL_SQL} SELECT id FROM cl WHERE list_contains(topics, 'ai') AND topics[1] <> 'ai'")
def topic_member(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(spark, folder, "topics").filter(F.array_contains("topics", "ai") & (F.try_element_at("topics", F.lit(1)) != "ai")).select("id")


@query("P17_latin_term", f"WITH {IT_SQL} SELECT id FROM it WHERE regexp_matches(lower(title), '(^|[^a-z0-9])(bank|motors)([^a-z0-9]|$)') OR contains(title, '银行')")
def latin_term(spark: SparkSession, folder: str) -> DataFrame:
    """Latin terms at word borders, Chinese ones anywhere."""
    t = F.lower("title")
    return items(spark, folder, "title").filter(t.rlike("(?<![a-z0-9])(bank|motors)(?![a-z0-9])") | F.contains("title", F.lit("银行"))).select("id")


@query("P18_digest_headline", f"WITH {IT_SQL} SELECT id FROM it WHERE regexp_matches(title, '(?i){features.DIGEST.replace(chr(39), chr(39) * 2)}') OR len(regexp_extract_all(title, '{features.PARTS}')) >= 2")
def digest_headlines(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").filter("title is not null").filter(features.digest(F.col("title"))).select("id")


@query("P19_cjk_ratio", f"WITH {IT_SQL}, c AS (SELECT id, len(regexp_extract_all(coalesce(title, ''), '{_HAN}')) AS h, len(regexp_extract_all(coalesce(title, ''), '[A-Za-z]')) AS l FROM it) SELECT id FROM c WHERE h + l > 0 AND h / (h + l) >= 0.3")
def cjk_items(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").filter(text.cjk_ratio("title") >= 0.3).select("id")


@query("F01_tokens", f"WITH {IT_SQL}, {_TOK_SQL} SELECT id, array_to_string(toks, ' ') AS toks FROM tok")
def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return titled(spark, folder).select("id", F.array_join(text.tokens("t"), " ").alias("toks"))


@query("F02_gram_set", f"WITH {IT_SQL}, {_TOK_SQL} SELECT id, len(list_distinct(toks))::INT AS n_grams FROM tok")
def gram_sets(spark: SparkSession, folder: str) -> DataFrame:
    return titled(spark, folder).select("id", F.size(text.grams("t")).alias("n_grams"))


@query("F05_simhash", f"WITH {IT_SQL}, {_TOK_SQL}, h AS (SELECT id, ('0x' || substr(md5(tk), 1, 16))::UBIGINT AS h FROM (SELECT id, unnest(toks) AS tk FROM tok)), b AS (SELECT id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS w FROM h, range(63) r(i) GROUP BY 1, 2) SELECT id, sum(CASE WHEN w > 0 THEN (1::UBIGINT << i)::BIGINT ELSE 0 END)::BIGINT AS fingerprint FROM b GROUP BY 1")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return titled(spark, folder).withColumn("toks", text.tokens("t")).filter(F.size("toks") > 0).select("id", text.simhash("toks").alias("fingerprint"))


@query("F06_fingerprint_check", f"WITH {IT_SQL}, {CL_SQL} SELECT it.id, bit_count(xor(it.simhash, lead.simhash))::INT AS distance FROM it JOIN it lead ON lead.id = it.cluster_id WHERE it.simhash IS NOT NULL AND lead.simhash IS NOT NULL AND it.id <> lead.id")
def fingerprint_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Bits by which items differ from the first item of their cluster."""
    it = items(spark, folder, "cluster_id", "simhash").filter("simhash is not null")
    lead = it.select(F.col("id").alias("cluster_id"), F.col("simhash").alias("lead"))
    return it.filter("cluster_id is not null and id <> cluster_id").join(lead, "cluster_id").select("id", text.hamming("simhash", "lead").alias("distance"))


@query("F10_hashes", f"WITH {IT_SQL} SELECT id, substr(sha1(title), 1, 12) AS h12, substr(sha256(title), 1, 16) AS h16 FROM it WHERE title IS NOT NULL")
def hashes(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").filter("title is not null").select("id", F.substring(F.sha1("title"), 1, 12).alias("h12"), F.substring(F.sha2("title", 256), 1, 16).alias("h16"))


def _words(name: str, where: str) -> str:
    words = ", ".join(f"'{w}'" for w in getattr(scoring, name))
    return f"len([w FOR w IN [{words}] IF contains({where}, w)])"


_QUALITY = f"""x AS (SELECT id, headline AS h, '' AS b, headline || ' ' AS t FROM cl WHERE headline IS NOT NULL),
q AS (SELECT id, h, t, {_words('CLICKBAIT', 'h')} AS cb, {_words('RUMOR', 't')} AS ru, {_words('ATTRIBUTION', 't')} AS att, {_words('HYPE', 'h')} AS hy, len(regexp_extract_all(h, '[！!？?]')) AS m, len(regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)?')) AS f FROM x)
SELECT id, round(greatest(0.0, least(1.0, 0.62 - least(0.30, 0.10 * cb) - least(0.28, 0.12 * ru) * CASE WHEN att > 0 THEN 0.5 ELSE 1.0 END + least(0.20, 0.07 * att) - least(0.12, 0.06 * hy)
 - CASE WHEN m >= 2 THEN 0.10 WHEN m = 1 AND regexp_matches(h, '[！!]$') THEN 0.04 ELSE 0 END - CASE WHEN regexp_matches(h, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{1F000}}-\\x{{1F2FF}}]') THEN 0.08 ELSE 0 END
 + CASE WHEN f >= 3 THEN 0.10 WHEN f >= 1 THEN 0.04 ELSE 0 END + CASE WHEN regexp_matches(t, '[“”"「」]') THEN 0.04 ELSE 0 END - CASE WHEN len(h) < 8 THEN 0.06 ELSE 0 END - CASE WHEN len(h) > 60 THEN 0.04 ELSE 0 END - 0.05)), 6)::DOUBLE AS quality FROM q"""


@query("F24_content_quality", f"WITH {CL_SQL}, {_QUALITY}")
def content_qualities(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of the wording of headlines taken alone."""
    cl = clusters(spark, folder, "headline").filter("headline is not null")
    return cl.select("id", F.round(scoring.content_quality(F.col("headline"), F.lit(""), F.lit(0)), 6).alias("quality"))


@query("F25_corroboration", f"WITH {IT_SQL}, g AS (SELECT it.cluster_id AS id, count(DISTINCT it.grp) FILTER (WHERE s.source_role IN ('reporting', 'wire')) AS n, coalesce(bool_or(s.source_role = 'official'), false) AS o, coalesce(bool_or(s.source_role = 'wire'), false) AS w FROM it LEFT JOIN sources s ON s.id = it.source_id WHERE it.cluster_id IS NOT NULL GROUP BY 1) SELECT id, round(least(1.0, greatest(1 - exp(-0.85 * greatest(n - 1, 0)), CASE WHEN o THEN 0.25 WHEN w THEN 0.15 ELSE 0 END)), 6) AS corroboration FROM g")
def corroborations(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "cluster_id", "grp").filter("cluster_id is not null")
    it = it.join(sources(spark, folder).select(F.col("id").alias("source_id"), "source_role"), "source_id", "left")
    pairs = it.groupBy(F.col("cluster_id").alias("id"), "grp").agg(*[F.max(F.coalesce(F.col("source_role").isin(*r), F.lit(False))).alias(n) for n, r in (("own", ("reporting", "wire")), ("o", ("official",)), ("w", ("wire",)))])
    g = pairs.groupBy("id").agg(F.count_if(F.col("own") & F.col("grp").isNotNull()).alias("n"), F.max("o").alias("o"), F.max("w").alias("w"))
    return g.select("id", F.round(scoring.corroboration(F.col("n"), F.col("o"), F.col("w")), 6).alias("corroboration"))


@query("F26_timing", f"WITH {CL_SQL}, m AS (SELECT max(updated_ts) AS now FROM cl), s AS (SELECT id, first_ts, n_items, greatest(0, last_ts - first_ts) / 3600 AS span, now FROM cl, m) SELECT id, (CASE WHEN first_ts > now + 3600 THEN 0.30 WHEN n_items <= 1 THEN 0.60 WHEN span <= 6 THEN 1.00 WHEN span <= 24 THEN 0.85 WHEN span <= 48 THEN 0.60 ELSE 0.42 END)::DOUBLE AS timing FROM s")
def timings(spark: SparkSession, folder: str) -> DataFrame:
    cl = clusters(spark, folder, "first_ts", "last_ts", "n_items")
    now = F.broadcast(cl.agg(F.max("updated_ts").alias("now")))
    return cl.crossJoin(now).select("id", scoring.timing(F.col("first_ts"), F.col("last_ts"), F.col("n_items"), F.col("now")).cast("double").alias("timing"))


@query("F29_rank", f"WITH {CL_SQL} SELECT id, round((0.55 * (cred / 100) + 0.45 * relevance) * (0.35 + 0.65 * pow(0.5, greatest(0, (updated_ts - last_ts) / 3600) / 18.0)), 5) AS score FROM cl")
def ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks as of each cluster's own update."""
    cl = clusters(spark, folder, "cred", "relevance", "last_ts")
    return cl.select("id", F.round(scoring.rank(F.col("cred"), F.col("relevance"), F.col("last_ts"), F.col("updated_ts")), 5).alias("score"))


@query("D01_parse_time", "SELECT doc_id, epoch(published_at)::BIGINT AS a, epoch(published_at)::BIGINT - 28800 AS b, epoch(date_trunc('day', published_at))::BIGINT - 28800 AS c FROM documents WHERE published_at IS NOT NULL AND epoch(published_at) > 940000000")
def parsed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times written in three notations and read back: with a zone, without one, as a date."""
    from galley.sources.tables import table

    d = table(spark, folder, "documents").select("doc_id", F.col("published_at").cast("timestamp").alias("t")).filter("t is not null and unix_timestamp(t) > 940000000")
    return d.select(
        "doc_id", dates.parse_time(F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("a"),
        dates.parse_time(F.date_format("t", "yyyy-MM-dd HH:mm:ss")).alias("b"), dates.parse_time(F.date_format("t", "yyyy年M月d日")).alias("c"),
    )


_NOW = "SELECT max(fetched_ts) AS now FROM it"


@query("D02_format_time", f"WITH {IT_SQL}, m AS ({_NOW}) SELECT id, CASE WHEN coalesce(published_ts, 0) = 0 THEN '—' WHEN year(make_timestamp((published_ts + 28800) * 1000000)) <> year(make_timestamp((m.now + 28800) * 1000000)) THEN strftime(make_timestamp((published_ts + 28800) * 1000000), '%Y-%m-%d') ELSE strftime(make_timestamp((published_ts + 28800) * 1000000), '%m-%d %H:%M') END AS shown FROM it, m")
def shown_times(spark: SparkSession, folder: str) -> DataFrame:
    """Times of the desk's zone for reading: another year shows as a date."""
    it = items(spark, folder, "published_ts")
    now = F.broadcast(it.agg(F.max("fetched_ts").alias("now")))  # one row
    return it.crossJoin(now).select("id", dates.shown(F.col("published_ts"), F.col("now")).alias("shown"))


@query("D03_period_start", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS start FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders)")
def period_starts(spark: SparkSession, folder: str) -> DataFrame:
    from galley.sources.tables import table

    return table(spark, folder, "orders").select("o_orderkey", dates.period_start(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("start"))


@query("T04_usd", "WITH v AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END AS v FROM orders) SELECT o_orderkey, CASE WHEN v >= 1000000000 THEN '$' || CAST(CAST(round(v / 1000000000, 1) AS DECIMAL(20, 1)) AS VARCHAR) || 'bn' WHEN v >= 1000000 THEN '$' || CAST(CAST(round(v / 1000000, 0) AS BIGINT) AS VARCHAR) || 'm' ELSE '$' || format('{:,}', CAST(round(v, 0) AS BIGINT)) END AS usd FROM v")
def usd(spark: SparkSession, folder: str) -> DataFrame:
    from galley.sources.tables import table

    factor = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 100).otherwise(100_000)
    return table(spark, folder, "orders").select("o_orderkey", text.usd(F.col("o_totalprice").cast("decimal(18,2)") * factor).alias("usd"))


@query("T05_paged_url", f"WITH {IT_SQL} SELECT id, regexp_replace(url || '&start=7&count=3', '&(?:start|count)=[0-9]+', '', 'g') || '&start=200&count=100' AS paged FROM it WHERE url IS NOT NULL")
def paged_urls(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "url").filter("url is not null").select("id", text.paged_url(F.concat("url", F.lit("&start=7&count=3")), F.lit(200)).alias("paged"))


@query("D04_freshness", f"WITH {IT_SQL}, m AS (SELECT max(fetched_ts) AS now FROM it), l AS (SELECT source_id, max(coalesce(published_ts, fetched_ts)) AS last FROM it WHERE coalesce(published_ts, fetched_ts) <= fetched_ts + 300 GROUP BY 1) SELECT s.id AS source_id, CASE WHEN l.last IS NULL THEN 'silent' WHEN now - last <= 36 * 3600 THEN 'fresh' WHEN now - last <= 7 * 86400 THEN 'slow' WHEN now - last <= 90 * 86400 THEN 'stale' ELSE 'zombie' END AS age FROM sources s LEFT JOIN l ON l.source_id = s.id, m")
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "published_ts")
    ts = F.coalesce("published_ts", "fetched_ts")
    now = F.broadcast(it.agg(F.max("fetched_ts").alias("now")))
    last = it.filter(ts <= F.col("fetched_ts") + 300).groupBy("source_id").agg(F.max(ts).alias("last"))
    age = F.col("now") - F.col("last")
    band = F.when(F.col("last").isNull(), "silent").when(age <= 36 * 3600, "fresh").when(age <= 7 * 86400, "slow").when(age <= 90 * 86400, "stale").otherwise("zombie")
    return sources(spark, folder).select(F.col("id").alias("source_id")).join(last, "source_id", "left").crossJoin(now).select("source_id", band.alias("age"))


@query("S10_future_clamp", f"WITH {IT_SQL} SELECT id, CASE WHEN published_ts > fetched_ts + 300 THEN fetched_ts ELSE published_ts END AS ts, coalesce(published_ts > fetched_ts + 300, false) AS clamped FROM it")
def future_clamp(spark: SparkSession, folder: str) -> DataFrame:
    it = items(spark, folder, "published_ts")
    return it.select("id", dates.clamp_future(F.col("published_ts"), F.col("fetched_ts")).alias("ts"), F.coalesce(F.col("published_ts") > F.col("fetched_ts") + 300, F.lit(False)).alias("clamped"))
