"""Rule features, page previews, quotes with offsets, caches, and text and JSON sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import features, text
from galley.operators.evidence import _CLAIM_SQL, lead_claims, similar
from galley.plans.catalog import query
from galley.session import materialize, shared_dir
from galley.sources.snapshots import CL_SQL, IT_SQL, clusters, items
from galley.sources.tables import table

MIN_PARAGRAPH, MAX_PARAGRAPHS, MAX_CHARS = 24, 4, 900
#: Words of page furniture that a preview leaves out.
FURNITURE = "责任编辑|编辑：|来源：|版权|不得转载|转载请|扫码|相关阅读|延伸阅读|copyright|all rights reserved|read more|sign up|subscribe|newsletter|share this|advertisement|cookies|photo:"


def preview(body: Column) -> Column:
    """The first paragraphs that are long enough and no furniture, each once, cut at MAX_CHARS with an ellipsis."""
    paragraphs = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x))
    kept = F.slice(F.array_distinct(F.filter(paragraphs, lambda x: (F.length(x) >= MIN_PARAGRAPH) & ~F.lower(x).rlike(FURNITURE))), 1, MAX_PARAGRAPHS)
    whole = F.array_join(kept, "\n\n")
    return F.when(F.length(whole) > MAX_CHARS, F.concat(F.substring(whole, 1, MAX_CHARS), F.lit("…"))).otherwise(whole)


def _lexicon_sql(t: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({t}), '{'|'.join(terms)}') THEN '{name}' END" for name, terms in features.EVENTS.items()) + "], lambda x: x IS NOT NULL)"


@query("F11_event_labels", f"WITH {IT_SQL} SELECT id, array_to_string({_lexicon_sql('coalesce(title, chr(0))')}, ',') AS events FROM it")
def event_labels(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "title").select("id", F.array_join(features.labels(F.col("title"), features.EVENTS), ",").alias("events"))


_PERIODS_SQL = " || ".join([f"[('{k}:' || x::INT) FOR x IN regexp_extract_all(t, '{p}', 1)]" for k, p in features.PERIODS] + ["list_filter([" + ", ".join(f"CASE WHEN contains(lower(t), '{m}') THEN 'm:{n}' END" for n, m in enumerate(features.MONTHS, 1)) + "], lambda x: x IS NOT NULL)"])


@query("F12_periods", f"WITH {IT_SQL}, x AS (SELECT id, coalesce(summary, '') AS t FROM it) SELECT id, array_to_string(list_sort(list_distinct({_PERIODS_SQL})), ',') AS periods FROM x")
def period_marks(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "summary").select("id", F.array_join(features.periods(F.col("summary")), ",").alias("periods"))


def _quantity_sql() -> str:
    steps = [f"q0 AS (SELECT id, [round(x::DOUBLE * 0.01, 6) FOR x IN regexp_extract_all(t, '{features.POINTS}', 1)] || [round(x::DOUBLE, 6) FOR x IN regexp_extract_all(t, '{features.PERCENT}', 1)] AS pct, []::DOUBLE[] AS num, regexp_replace(regexp_replace(t, '{features.POINTS}', ' ', 'g'), '{features.PERCENT}', ' ', 'g') AS t FROM (SELECT id, coalesce(summary, '') AS t FROM it))"]
    for n, (unit, factor) in enumerate(features.UNITS.items()):
        p = f"({features.PLAIN})\\s*{unit}"
        steps.append(f"q{n + 1} AS (SELECT id, pct, num || [round(x::DOUBLE * {factor:.0f}, 6) FOR x IN regexp_extract_all(t, '{p}', 1)] AS num, regexp_replace(t, '{p}', ' ', 'g') AS t FROM q{n})")
    left = "t"
    for _, p in features.PERIODS:
        left = f"regexp_replace({left}, '{p}', ' ', 'g')"
    return ", ".join(steps) + f" SELECT id, list_sum(list_distinct(pct)) AS pct_sum, len(list_distinct(num))::INT AS n_amounts, list_max(num) AS largest, len(regexp_extract_all({left}, '{features.PLAIN}'))::INT AS n_plain FROM q{len(features.UNITS)}"


@query("F13_quantities", f"WITH {IT_SQL}, {_quantity_sql()}")
def quantities(spark: SparkSession, folder: str) -> DataFrame:
    q = items(spark, folder, "summary").select("id", features.quantities(F.col("summary")).alias("q"))
    total = F.when(F.size("q.pct") > 0, F.aggregate("q.pct", F.lit(0.0), lambda a, x: a + x))
    return q.select("id", F.round(total, 6).alias("pct_sum"), F.size("q.num").alias("n_amounts"), F.array_max("q.num").alias("largest"), F.col("q.n_plain").alias("n_plain"))


@query("T01_preview", f"WITH {IT_SQL}, p AS (SELECT id, [trim(x) FOR x IN string_split(coalesce(body, ''), chr(10))] AS l FROM it WHERE body_state = 'ok'), k AS (SELECT id, [x FOR x IN l IF len(x) >= {MIN_PARAGRAPH} AND NOT regexp_matches(lower(x), '{FURNITURE}')] AS l FROM p), d AS (SELECT id, array_to_string(([x FOR x, i IN l IF list_position(l, x) = i])[1:{MAX_PARAGRAPHS}], chr(10) || chr(10)) AS t FROM k) SELECT id, CASE WHEN len(t) > {MAX_CHARS} THEN substr(t, 1, {MAX_CHARS}) || '…' ELSE t END AS preview FROM d")
def previews(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder, "body", "body_state").filter("body_state = 'ok'").select("id", preview(F.col("body")).alias("preview"))


#: Ids that begin so have their stored offsets, or their hash, spoilt in A34, so that the check has something to find.
SPOILT = ("0", "1")


@query("A34_quote_integrity", f"WITH {_CLAIM_SQL} SELECT count(*) AS n_quotes, count(*) FILTER (WHERE item_id[1] IN ('{SPOILT[0]}', '{SPOILT[1]}')) AS n_broken FROM (SELECT DISTINCT e.item_id FROM e JOIN it ON it.id = e.item_id WHERE len(list_filter(regexp_extract_all(coalesce(it.summary, ''), '[^。！？!?\n]+[。！？!?]?'), lambda x: trim(x) <> '')) > 0)")
def quote_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Stored quotes (offsets in code points, hash), some of them spoilt, against the texts they come from."""
    stored = materialize(quotes(spark, folder).select("item_id", "quote_start", "quote_end", F.substring(F.sha2("quote", 256), 1, 16).alias("quote_hash")), "quotes")
    first = F.substring("item_id", 1, 1)
    spoilt = stored.withColumn("quote_start", F.col("quote_start") + F.when(first == SPOILT[0], 1).otherwise(0)).withColumn("quote_hash", F.when(first == SPOILT[1], F.reverse("quote_hash")).otherwise(F.col("quote_hash")))
    texts = items(spark, folder, "summary").select(F.col("id").alias("item_id"), "summary")
    return spoilt.join(texts, "item_id").agg(F.count("*").alias("n_quotes"), F.count_if(~intact(F.col("summary"), F.col("quote_start"), F.col("quote_end"), F.col("quote_hash"))).alias("n_broken"))


def intact(t: Column, start: Column, end: Column, digest: Column) -> Column:
    """Whether the slice of a text is the quote that was stored, by its hash."""
    return F.coalesce(F.substring(F.sha2(F.substring(t, start + 1, end - start), 256), 1, 16) == digest, F.lit(False))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, summary, quote, quote_start, quote_end): the sentence nearest to the cluster's claim, with offsets."""
    it = items(spark, folder, "cluster_id", "title", "summary").filter("cluster_id is not null and title is not null")
    sentences = F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit("[^。！？!?\\n]+[。！？!?]?"), F.lit(0))
    q = it.select("cluster_id", F.col("id").alias("item_id"), "summary", F.explode(sentences).alias("quote")).withColumn("quote", F.trim("quote")).filter("quote <> ''")
    scored = q.join(lead_claims(spark, folder).select("cluster_id", "grams"), "cluster_id").withColumn("s", similar(F.col("grams"), text.grams("quote")))
    top = scored.groupBy("item_id").agg(F.max(F.struct(F.round("s", 9).alias("r"), "quote", "summary")).alias("x")).select("item_id", "x.quote", "x.summary")
    start = F.instr("summary", F.col("quote")) - 1
    return top.select("item_id", "summary", "quote", start.alias("quote_start"), (start + F.length("quote")).alias("quote_end"))


@query("X02_rendering_cache", f"WITH {IT_SQL}, c AS (SELECT sha1(title) AS k, min(canonical_title) AS t FROM it WHERE canonical_title <> '' AND title IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE coalesce(it.canonical_title, '') = '') AS n_missing, count(c.k) FILTER (WHERE coalesce(it.canonical_title, '') = '') AS n_from_cache FROM it LEFT JOIN c ON c.k = sha1(it.title)")
def rendering_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings kept by content hash: how many missing ones an equal title supplies."""
    it = items(spark, folder, "title", "canonical_title").withColumn("k", F.sha1("title"))
    cache = it.filter("canonical_title <> '' and k is not null").groupBy("k").agg(F.min("canonical_title").alias("t"))
    missing = F.coalesce("canonical_title", F.lit("")) == ""
    # one row per title before the join; a title of a third of all rows is one row
    per = it.groupBy("k").agg(F.count_if(missing).alias("n"))
    return per.join(cache, "k", "left").agg(F.sum("n").alias("n_missing"), F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("n_from_cache"))


@query("S20_jsonl", f"WITH {CL_SQL} SELECT id, headline, len(topics)::INT AS n_topics, rank FROM cl")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Written as JSON lines and read back."""
    cl = clusters(spark, folder, "headline", "topics", "rank").select("id", "headline", "topics", "rank")
    at = f"{shared_dir(spark)}/galley/jsonl-{uuid.uuid4().hex}"
    cl.write.json(at, ignoreNullFields=False)
    back = spark.read.schema(cl.schema).json(at)
    return back.select("id", "headline", F.when(F.col("topics").isNotNull(), F.size("topics")).alias("n_topics"), "rank")


@query("S21_briefing", f"WITH {CL_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY rank DESC, id) AS place FROM cl WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT 10) SELECT place::INT AS place, printf('%d. **%s** (%s, %d items)', place, coalesce(headline, ''), coalesce(cred_code, '-'), coalesce(n_items, 0)) AS line FROM t")
def briefing(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best ranked clusters as lines of a Markdown list."""
    from pyspark.sql.window import Window

    top = clusters(spark, folder, "headline", "rank", "cred_code", "n_items").filter("rank is not null").orderBy(F.desc("rank"), "id").limit(10)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rank"), "id"))  # ten rows
    line = F.format_string("%d. **%s** (%s, %d items)", F.col("place"), F.coalesce("headline", F.lit("")), F.coalesce("cred_code", F.lit("-")), F.coalesce("n_items", F.lit(0)))
    return top.withColumn("place", place).select("place", line.alias("line"))


@query("S22_recovery_check", "SELECT 'items' AS name, count(*) AS n, true AS intact FROM items UNION ALL SELECT 'clusters', count(*), true FROM clusters UNION ALL SELECT 'sources', count(*), true FROM sources")
def recovery_check(spark: SparkSession, folder: str) -> DataFrame:
    """Tables copied and read back: same rows by count and by a checksum over all columns."""
    out = None
    for name in ("items", "clusters", "sources"):
        df = table(spark, folder, name)
        at = f"{shared_dir(spark)}/galley/backup-{uuid.uuid4().hex}"
        df.write.parquet(at)

        def sums(x: DataFrame, tag: str) -> DataFrame:
            return x.agg(F.count("*").alias(f"n_{tag}"), F.bit_xor(F.xxhash64(*x.columns)).alias(f"h_{tag}"))

        one = sums(df, "a").crossJoin(sums(spark.read.schema(df.schema).parquet(at), "b")).select(F.lit(name).alias("name"), F.col("n_a").alias("n"), ((F.col("n_a") == F.col("n_b")) & F.col("h_a").eqNullSafe(F.col("h_b"))).alias("intact"))
        out = one if out is None else out.unionByName(one)
    return out


