"""Evidence: representative claims of clusters, their sources and opposite statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import features, text
from galley.operators.textops import _TOKENS
from galley.plans.catalog import query
from galley.session import materialize, release
from galley.sources.snapshots import IT_SQL, items, sources

#: Similarity from which a text supports a claim, two texts are related, and how a contained text counts.
SUPPORT, RELATED, CONTAINED = 0.38, 0.26, 0.82
#: Fixed value: similarity from which different figures contradict each other.
FIGURES = 0.30
#: Fixed value: similarity of what two texts are about, from which it is the same.
SAME_SUBJECT = 0.48
#: Pairs of opposite words.
OPPOSITES = (
    (("上涨", "增长", "上升", "increase", "increased", "rises", "rose"), ("下跌", "下降", "减少", "decrease", "decreased", "falls", "fell")),
    (("批准", "通过", "获批", "approve", "approved", "passes"), ("拒绝", "否决", "驳回", "reject", "rejected", "blocks")),
    (("达成", "签署", "同意", "agrees", "signed", "reached"), ("破裂", "取消", "退出", "collapses", "cancelled", "withdraws")),
)


def similar(a: Column, b: Column) -> Column:
    """Similarity of two gram sets with allowance for a short text inside a long one."""
    return F.greatest(text.jaccard(a, b), CONTAINED * text.overlap(a, b))


def opposed(a: Column, b: Column) -> Column:
    """Whether one text says the opposite of a word of the other."""
    def has(t: Column, words: tuple[str, ...]) -> Column:
        return F.lower(t).rlike("|".join(words))

    out = F.lit(False)
    for left, right in OPPOSITES:
        out = out | (has(a, left) & has(b, right)) | (has(a, right) & has(b, left))
    return out


def subject(t: Column) -> Column:
    """What a text is about: without the words of direction, longest first, and without numbers."""
    words = sorted({w for pair in OPPOSITES for side in pair for w in side}, key=len, reverse=True)
    masked = F.coalesce(t, F.lit(""))
    for w in words:
        masked = F.regexp_replace(masked, f"(?i){w}", " ")
    return F.regexp_replace(masked, "[0-9]+(?:[.,][0-9]+)?", " ")


def same_subject(a: Column, b: Column) -> Column:
    """Whether two texts are about the same, whatever they say of it; by plain similarity, as a short text lies inside many."""
    return text.jaccard(text.grams(subject(a)), text.grams(subject(b))) >= SAME_SUBJECT


def lead_claims(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, claim_item, claim, grams): the title that stands for each cluster: best tier, then longest."""
    it = items(spark, folder, "cluster_id", "title", "tier").filter("cluster_id is not null and title is not null")
    best = F.min(F.struct("tier", (-F.length("title")).alias("l"), "id", "title"))
    return it.groupBy("cluster_id").agg(best.alias("x")).select("cluster_id", F.col("x.id").alias("claim_item"), F.col("x.title").alias("claim"), text.grams("x.title").alias("grams"))


def relation(claim: Column, title: Column, s: Column, gated: bool = False) -> Column:
    """How a text of similarity `s` bears on a claim; gated, opposite words refute only what is about the same and leave the rest unclear."""
    against = F.when(same_subject(claim, title), "refute").otherwise("unknown") if gated else F.lit("refute")
    return F.when(s < RELATED, F.lit(None)).when(opposed(claim, title), against).when(s >= SUPPORT, "support").otherwise("unknown")


def claim_evidence(spark: SparkSession, folder: str, gated: bool = False) -> DataFrame:
    """Each item of a cluster held against the cluster's lead claim: (cluster_id, item_id, grp, role, similarity, relation)."""
    it = items(spark, folder, "cluster_id", "title", "grp").filter("cluster_id is not null and title is not null")
    role = sources(spark, folder).select(F.col("id").alias("source_id"), F.col("source_role").alias("role"))
    each = it.join(role, "source_id", "left").select("cluster_id", F.col("id").alias("item_id"), "grp", F.coalesce("role", F.lit("reporting")).alias("role"), "title", text.grams("title").alias("g"))
    both = each.join(lead_claims(spark, folder), "cluster_id").withColumn("s", similar(F.col("grams"), F.col("g")))
    return both.select("cluster_id", "item_id", "grp", "role", F.round("s", 6).alias("similarity"), relation(F.col("claim"), F.col("title"), F.col("s"), gated).alias("relation"))


def contradicting(it: DataFrame) -> DataFrame:
    """(cluster_id, item_id, n_opposed, n_figures): how many items of other owners in its cluster contradict each item.

    `it` has id, cluster_id, source_id, grp and title; an item without an owner group counts for its
    source. Titles are related if they are similar or name the same subject. Related titles contradict
    each other by opposite words, else by figures of which none is shared. Equal titles of one owner
    fall together before the pairs; items without a title have nothing to contradict.
    """
    owned = it.filter("cluster_id is not null and title <> ''").select("id", "cluster_id", F.coalesce(F.nullif("grp", F.lit("")), "source_id", F.lit("")).alias("owner"), "title")
    low = F.lower("title")

    def sides(k: int) -> Column:
        return sum((F.when(low.rlike("|".join(pair[k])), 2**n).otherwise(0) for n, pair in enumerate(OPPOSITES)), F.lit(0))

    once = owned.groupBy("cluster_id", "owner", "title").agg(F.count("*").alias("n"))
    full = once.select("cluster_id", "owner", "title", "n", text.grams("title").alias("g"), features.amounts(F.col("title")).alias("f"), features.subjects(F.col("title")).alias("s"), sides(0).alias("up"), sides(1).alias("down"))
    a, b = (full.select("cluster_id", *[F.col(c).alias(f"{c}_{k}") for c in ("owner", "title", "n", "g", "f", "s", "up", "down")]) for k in "ab")
    against = F.col("up_a").bitwiseAND(F.col("down_b")).bitwiseOR(F.col("down_a").bitwiseAND(F.col("up_b"))) != 0
    figures = (F.size("f_a") > 0) & (F.size("f_b") > 0) & ~F.arrays_overlap("f_a", "f_b")
    pairs = a.join(b, "cluster_id").filter("owner_a < owner_b").filter(against | figures).withColumn("like", similar(F.col("g_a"), F.col("g_b")))
    pairs = pairs.withColumn("why", F.when((F.col("like") < RELATED) & ~F.arrays_overlap("s_a", "s_b"), None).when(against, "opposed").when(figures & (F.col("like") >= FIGURES), "figures")).filter("why is not null")
    ends = pairs.select("cluster_id", "why", F.explode(F.array(*[F.struct(F.col(f"owner_{x}").alias("owner"), F.col(f"title_{x}").alias("title"), F.col(f"n_{y}").alias("n")) for x, y in ("ab", "ba")])).alias("x"))
    found = ends.groupBy("cluster_id", "x.owner", "x.title").agg(*[F.sum(F.when(F.col("why") == w, F.col("x.n")).otherwise(0)).alias(f"n_{w}") for w in ("opposed", "figures")])
    return owned.join(found, ["cluster_id", "owner", "title"]).select("cluster_id", F.col("id").alias("item_id"), "n_opposed", "n_figures")


@query("J14_contradictions")
def contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """The items that items of other owners in their cluster contradict."""
    return contradicting(items(spark, folder, "cluster_id", "grp", "title"))


_G = _TOKENS.replace("(t, '", "(title, '").replace("(t,", "(title,")
_CLAIM_SQL = f"""{IT_SQL}, e AS (SELECT it.cluster_id, it.id AS item_id, it.grp, coalesce(s.source_role, 'reporting') AS role, it.title, it.tier, list_distinct({_G}) AS g FROM it LEFT JOIN sources s ON s.id = it.source_id WHERE it.cluster_id IS NOT NULL AND it.title IS NOT NULL),
c AS (SELECT * FROM (SELECT cluster_id, item_id AS claim_item, title AS claim, g AS grams, row_number() OVER (PARTITION BY cluster_id ORDER BY tier, len(title) DESC, item_id) AS n FROM e) WHERE n = 1),
m AS (SELECT e.*, c.claim, c.grams, len(list_intersect(e.g, c.grams)) AS k, len(e.g) AS a, len(c.grams) AS b FROM e JOIN c ON c.cluster_id = e.cluster_id),
x AS (SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0.0 ELSE greatest(k / (a + b - k), 0.82 * (k / least(a, b))) END AS s, {' OR '.join(f"(regexp_matches(lower(claim), '{'|'.join(p)}') AND regexp_matches(lower(title), '{'|'.join(q)}'))" for l, r in OPPOSITES for p, q in ((l, r), (r, l)))} AS opp FROM m),
ev AS (SELECT cluster_id, item_id, grp, role, round(s, 6) AS similarity, CASE WHEN s < 0.26 THEN NULL WHEN opp THEN 'refute' WHEN s >= 0.38 THEN 'support' ELSE 'unknown' END AS relation FROM x)"""


@query("F07_claim_similarity", f"WITH {_CLAIM_SQL} SELECT cluster_id, item_id, similarity FROM ev")
def claim_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return claim_evidence(spark, folder).select("cluster_id", "item_id", "similarity")


@query("F32_relations", f"WITH {_CLAIM_SQL} SELECT cluster_id, item_id, relation FROM ev WHERE relation IS NOT NULL")
def relations(spark: SparkSession, folder: str) -> DataFrame:
    return claim_evidence(spark, folder).filter("relation is not null").select("cluster_id", "item_id", "relation")


#: The status of each claim in SQL, behind _CLAIM_SQL.
STATUS_SQL = """sg AS (SELECT cluster_id, count(*) FILTER (WHERE relation = 'refute') AS n_refute, count(*) FILTER (WHERE relation = 'support') AS n_support, count(*) FILTER (WHERE relation = 'unknown') AS n_unknown, count(DISTINCT CASE WHEN relation = 'support' AND role IN ('reporting', 'wire') THEN grp END) AS independent_groups, count(*) FILTER (WHERE relation = 'support' AND role <> 'official') AS n_other FROM ev GROUP BY 1),
st AS (SELECT cluster_id, n_support, n_refute, n_unknown, independent_groups, CASE WHEN n_refute > 0 THEN 'disputed' WHEN independent_groups >= 2 THEN 'independently_reported' WHEN n_support > 0 AND n_other = 0 THEN 'official_statement' ELSE 'single_report' END AS status FROM sg)"""


@query("A13_claim_status", f"WITH {_CLAIM_SQL}, {STATUS_SQL} SELECT * FROM st")
def claim_status(spark: SparkSession, folder: str) -> DataFrame:
    """The status of each claim from its supporting, opposing and unclear sources."""
    return status_of(claim_evidence(spark, folder))


@query("F32_subject_relations")
def subject_relations(spark: SparkSession, folder: str) -> DataFrame:
    """As F32_relations, but only a text about the same subject refutes a claim."""
    return claim_evidence(spark, folder, True).filter("relation is not null").select("cluster_id", "item_id", "relation")


@query("A13_subject_status")
def subject_status(spark: SparkSession, folder: str) -> DataFrame:
    """As A13_claim_status, over the relations of texts about the same subject."""
    return status_of(claim_evidence(spark, folder, True))


def status_of(ev: DataFrame) -> DataFrame:
    """The status of each claim from its evidence."""
    # per cluster and owner first, then plain sums
    own = ev.groupBy("cluster_id", "grp").agg(*[F.count_if(F.col("relation") == r).alias(f"n_{r}") for r in ("support", "refute", "unknown")], F.max(F.coalesce((F.col("relation") == "support") & F.col("role").isin("reporting", "wire"), F.lit(False))).alias("own"), F.count_if((F.col("relation") == "support") & (F.col("role") != "official")).alias("n_other"))
    g = own.groupBy("cluster_id").agg(*[F.sum(f"n_{r}").alias(f"n_{r}") for r in ("support", "refute", "unknown")], F.count_if(F.col("own") & F.col("grp").isNotNull()).alias("independent_groups"), F.sum("n_other").alias("n_other"))
    status = F.when(F.col("n_refute") > 0, "disputed").when(F.col("independent_groups") >= 2, "independently_reported").when((F.col("n_support") > 0) & (F.col("n_other") == 0), "official_statement").otherwise("single_report")
    return g.select("cluster_id", "n_support", "n_refute", "n_unknown", "independent_groups", status.alias("status"))


@query("J16_best_quote", f"WITH {_CLAIM_SQL}, q AS (SELECT e.cluster_id, e.item_id, c.grams, trim(unnest(regexp_extract_all(coalesce(it.summary, ''), '[^。！？!?\\n]+[。！？!?]?'))) AS quote FROM e JOIN c ON c.cluster_id = e.cluster_id JOIN it ON it.id = e.item_id), t AS (SELECT cluster_id, item_id, quote, grams, list_distinct({_TOKENS.replace('(t, ', '(quote, ').replace('(t,', '(quote,')}) AS g FROM q WHERE quote <> ''), w AS (SELECT cluster_id, item_id, quote, CASE WHEN len(g) = 0 OR len(grams) = 0 THEN 0.0 ELSE greatest(len(list_intersect(g, grams)) / (len(g) + len(grams) - len(list_intersect(g, grams))), 0.82 * (len(list_intersect(g, grams)) / least(len(g), len(grams)))) END AS s FROM t) SELECT cluster_id, item_id, round(max(s), 6) AS similarity, substr(sha256(arg_max(quote, (round(s, 9), quote))), 1, 16) AS quote_hash FROM w GROUP BY 1, 2")
def best_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """For each item the sentence of its summary that comes nearest to the cluster's claim."""
    it = items(spark, folder, "cluster_id", "title", "summary").filter("cluster_id is not null and title is not null")
    sentences = F.regexp_extract_all(F.coalesce("summary", F.lit("")), F.lit("[^。！？!?\\n]+[。！？!?]?"), F.lit(0))
    q = it.select("cluster_id", F.col("id").alias("item_id"), F.explode(sentences).alias("quote")).withColumn("quote", F.trim("quote")).filter("quote <> ''")
    w = q.withColumn("g", text.grams("quote")).join(lead_claims(spark, folder).select("cluster_id", "grams"), "cluster_id").withColumn("s", similar(F.col("grams"), F.col("g")))
    top = w.groupBy("cluster_id", "item_id").agg(F.max(F.struct(F.round("s", 9).alias("r"), "quote", "s")).alias("x"))
    return top.select("cluster_id", "item_id", F.round("x.s", 6).alias("similarity"), F.substring(F.sha2("x.quote", 256), 1, 16).alias("quote_hash"))


def representatives(titles: list[str], limit: int = 6, least: float = 0.52) -> list[str]:
    """Titles in order, without those that are similar to one taken before."""
    import re

    def grams(t: str) -> set[str]:
        out: set[str] = set()
        for run in re.findall("[㐀-䶿一-鿿豈-﫿]+", t):
            run = "".join(c for c in run if c not in text.CJK_STOP) or run
            out |= {run} if len(run) == 1 else {run[i : i + 2] for i in range(len(run) - 1)}
        return out | {w.lower() for w in re.findall(text.LATIN, t)} | set(re.findall(text.NUMBER, t))

    kept: list[tuple[str, set[str]]] = []
    for t in titles:
        g = grams(t)
        if all(_near(g, h) < least for _, h in kept):
            kept.append((t, g))
        if len(kept) >= limit:
            break
    return [t for t, _ in kept]


def _near(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return max(both / len(a | b), CONTAINED * both / min(len(a), len(b))) if a and b and both else 0.0


REPRESENTATIVES, UNLIKE = 6, 0.52


@query("X05_representative_titles")
def representative_titles(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, place, title): up to six titles of each cluster that say different things.

    One title of each cluster is taken a round, and those like it are left out of the next, so
    that no cluster is gathered anywhere; equal titles fall together before.
    """
    it = items(spark, folder, "cluster_id", "title", "tier").filter("cluster_id is not null and title <> ''")
    once = it.groupBy("cluster_id", "title").agg(F.min("tier").alias("tier"))
    return representatives_of(once)


def representatives_of(titles: DataFrame) -> DataFrame:
    """(cluster_id, place, title) of (cluster_id, title, tier): by tier, then the longest first."""
    left = materialize(titles.withColumn("g", text.grams("title")), "titles")
    taken = None
    for place in range(1, REPRESENTATIVES + 1):
        best = left.groupBy("cluster_id").agg(F.min(F.struct("tier", (-F.length("title")).alias("l"), "title", "g")).alias("x"))
        best = materialize(best.select("cluster_id", F.lit(place).alias("place"), F.col("x.title").alias("title"), F.col("x.g").alias("h")), "taken")
        taken = best if taken is None else taken.unionByName(best)
        if place < REPRESENTATIVES:
            near = (F.col("title") == F.col("chosen")) | (similar(F.col("g"), F.col("h")) >= UNLIKE)
            rest = materialize(left.join(best.select("cluster_id", F.col("title").alias("chosen"), "h"), "cluster_id").filter(~near).select("cluster_id", "title", "tier", "g"), "titles")
            release(left)
            left = rest
    return taken.select("cluster_id", "place", "title")
