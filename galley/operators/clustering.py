"""Event clustering: exact set-similarity joins, pair rules, connected groups.

The similarity join is exact and has no frequency cap. A title's grams are ordered from rare
to common; two sets of Jaccard similarity t or more must share a gram within the first
|x| - ceil(t |x|) + 1 of each, so only these prefixes are joined. Common grams stand at the
end of the order and hardly ever enter a prefix. Equal titles fall together before the join,
so a much repeated title costs one row, not a square of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import text
from galley.operators import tiles
from galley.operators.textops import _TOK_SQL, titled
from galley.plans.catalog import query
from galley.session import materialize, release
from galley.sources.snapshots import IT_SQL, items

#: Fixed values of the pair rules.
JACCARD, OVERLAP, OVERLAP_SIZE, NEAR_BITS, NEAR_JACCARD = 0.42, 0.68, 8, 6, 0.25
#: Similarity by the pair rules from which two titles are linked.
LINKED = 0.5
#: Days that reports of one event may lie apart.
WINDOW_DAYS = 3


def rare_first(base: DataFrame) -> DataFrame:
    """(id, n, day, order) of (id, grams, n, day): the grams from rare to common."""
    each = base.select("id", "n", "day", F.explode("grams").alias("gram"))
    # counted before the shuffle; one row per gram
    freq = each.groupBy("gram").agg(F.count("*").alias("df"))
    return each.join(freq, "gram").groupBy("id", "n", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "gram"))), lambda x: x["gram"]).alias("order"))


def similar_sets(sets: DataFrame, least: float, days: int | None = None) -> DataFrame:
    """(a, b, jaccard) of all pairs a < b of (id, grams) with at least this similarity.

    With `days` the sets have a column `day` too, and a pair's days differ by no more. No
    two sets of one day are equal, and none repeats an element; empty sets have no pairs.
    """
    day = F.lit(0).cast("bigint") if days is None else F.col("day")
    base = sets.select("id", "grams", F.size("grams").alias("n"), day.alias("day")).filter("n > 0")
    ranked = rare_first(base)
    keep = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    span = days or 1
    prefix = ranked.select("id", "n", "day", F.floor(F.col("day") / span).alias("block"), F.posexplode(F.slice("order", 1, keep)).alias("at", "gram"))
    a, b = (prefix.select("gram", "block", F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("at").alias(f"at{k}"), F.col("day").alias(f"day_{k}")) for k in "ab")
    if days is not None:  # a set meets those of its own stretch of days and of the two beside it
        b = b.withColumn("block", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)])))
    # sizes of similar sets are close, and behind the first gram that two of them share there
    # must be room for the others that they need to share
    room = f" and least(na - ata, nb - atb) >= {least / (1 + least)} * (na + nb) - 1e-9"
    close = f"a < b and na >= {least} * nb - 1e-9 and nb >= {least} * na - 1e-9 and abs(day_a - day_b) <= {days or 0}" + room
    pairs = a.join(b, ["gram", "block"]).filter(close).select("a", "b").distinct()
    ga, gb = (base.select(F.col("id").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
    return pairs.join(ga, "a").join(gb, "b").withColumn("jaccard", text.jaccard("ga", "gb")).filter(F.col("jaccard") >= least - 1e-12).select("a", "b", "jaccard")


def contained_sets(sets: DataFrame, least: float, size: int, days: int) -> DataFrame:
    """(a, b, overlap) of all pairs a < b of (id, grams, day) of which the smaller set, of `size` grams or more, has this share of its grams in the other.

    The smaller set must have one of its n - ceil(least n) + 1 rarest grams in the other, anywhere
    there. As in `similar_sets` no gram is capped.
    """
    base = sets.select("id", "grams", F.size("grams").alias("n"), "day").filter(F.col("n") >= size)
    ranked = rare_first(base).withColumn("block", F.floor(F.col("day") / days))
    keep = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    small = ranked.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("day").alias("dx"), "block", F.explode(F.slice("order", 1, keep)).alias("gram"))
    large = ranked.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("day").alias("dy"), F.col("block").alias("home"), F.explode("order").alias("gram"))
    large = large.select("y", "ny", "dy", "gram", F.explode(F.array(*[F.col("home") + k for k in (-1, 0, 1)])).alias("block"))
    met = small.join(large, ["gram", "block"]).filter(f"x <> y and nx <= ny and abs(dx - dy) <= {days}")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    ga, gb = (base.select(F.col("id").alias(k), F.col("grams").alias(f"g{k}")) for k in "ab")
    return pairs.join(ga, "a").join(gb, "b").withColumn("overlap", text.overlap("ga", "gb")).filter(F.col("overlap") >= least - 1e-12).select("a", "b", "overlap")


def similarity(j: Column, over: Column, least: Column, bits: Column) -> Column:
    """The cascade of pair rules: plain similarity, containment of a long title, near fingerprints."""
    return F.when(j >= JACCARD, F.greatest(j, F.lit(0.6))).when((over >= OVERLAP) & (least >= OVERLAP_SIZE), F.greatest(0.9 * over, F.lit(0.55))).when((bits <= NEAR_BITS) & (j >= NEAR_JACCARD), F.greatest(F.lit(0.5), 1 - bits / 12)).otherwise(j)


def cascade(sets: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b, s) of the pairs of (id, grams, day) that the pair rules give LINKED or more; `prints` has (id, simhash).

    The rules that need the desk's lexicon of entities (rescue, bridge) aren't among them.
    """
    pairs = similar_sets(sets, NEAR_JACCARD, WINDOW_DAYS).select("a", "b").unionByName(contained_sets(sets, OVERLAP, OVERLAP_SIZE, WINDOW_DAYS).select("a", "b")).distinct()
    full = sets.join(prints.select("id", "simhash"), "id", "left")
    a, b = (full.select(F.col("id").alias(k), F.col("grams").alias(f"g{k}"), F.col("simhash").alias(f"h{k}")) for k in "ab")
    bits = F.when((F.col("ha") != 0) & (F.col("hb") != 0), text.hamming("ha", "hb")).otherwise(64)
    s = similarity(text.jaccard("ga", "gb"), text.overlap("ga", "gb"), F.least(F.size("ga"), F.size("gb")), bits)
    return pairs.join(a, "a").join(b, "b").withColumn("s", s).filter(F.col("s") >= LINKED - 1e-12).select("a", "b", "s")


def connected(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """(node, root): the smallest node of each connected group of (a, b) links.

    Every round each node goes into its least neighbour, if that is less than it, and two jumps
    further; the links between what is left are contracted, so they shrink by a factor a round.
    The order is that of hashes, so that no chain is sorted by it. Nodes without a link take no
    part. Rounds are written to the shared folder and removed after the next; the driver sees one
    flag a round.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    edges = materialize(links.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*").distinct(), "links")
    labels = edges.select(F.col("a").alias("v")).distinct().select("v", F.col("v").alias("root"))
    written: list[DataFrame] = []
    while not edges.isEmpty():
        up = edges.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("v"), F.least(order("a"), F.col("m"))["x"].alias("p"))
        up = materialize(up, "parents")
        for _ in range(2):
            far = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            up = up.join(far, "p").select("v", F.col("q").alias("p"))
        up = materialize(up, "parents")
        pa, pb = (up.select(F.col("v").alias(k), F.col("p").alias(f"p{k}")) for k in "ab")
        rest = materialize(edges.join(pa, "a").join(pb, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
        moved = materialize(labels.join(up.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        for past in (*written, edges):
            release(past)
        edges, labels, written = rest, moved, [moved, up]
    least = labels.groupBy("root").agg(F.min("v").alias("least"))
    named = labels.join(least, "root").select("v", "least")
    return nodes.select(F.col(node).alias("v")).join(named, "v", "left").select(F.col("v").alias(node), F.coalesce("least", "v").alias("root"))


def conflicting(a: Column, b: Column) -> Column:
    """Two gram sets that both name figures but share none of them."""
    fa, fb = (F.filter(x, lambda g: g.rlike("^[0-9]")) for x in (a, b))
    return (F.size(fa) > 0) & (F.size(fb) > 0) & ~F.arrays_overlap(fa, fb)


def seeded(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """(node, seed): groups around seeds, so that no chain of similar pairs drifts away.

    The nodes are taken in order: one linked to an earlier seed belongs to the first such
    seed, any other becomes a seed. The seeds are found in rounds: every open node without a
    smaller open neighbour is one, and closes its neighbours; this gives the same seeds as
    taking the nodes one by one. Each round is written to the shared folder.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "seed-links")
    open_ = materialize(nodes.select(F.col(node).alias("v")), "seed-open")
    seeds: DataFrame | None = None
    while not open_.isEmpty():
        among = both.join(open_.select(F.col("v").alias("a")), "a", "left_semi").join(open_.select(F.col("v").alias("b")), "b", "left_semi")
        later = among.filter("b < a").select(F.col("a").alias("v")).distinct()
        new = materialize(open_.join(later, "v", "left_anti"), "seeds")
        closed = both.join(new.select(F.col("v").alias("b")), "b", "left_semi").select(F.col("a").alias("v")).unionByName(new)
        rest, past = materialize(open_.join(closed.distinct(), "v", "left_anti"), "seed-open"), open_
        release(past)
        open_ = rest
        seeds = new if seeds is None else seeds.unionByName(new)
    if seeds is None:
        return nodes.select(F.col(node), F.col(node).alias("seed"))
    first = both.filter("b < a").join(seeds.select(F.col("v").alias("b")), "b", "left_semi").groupBy(F.col("a").alias("v")).agg(F.min("b").alias("seed"))
    rest = first.join(seeds, "v", "left_anti")
    return rest.unionByName(seeds.select("v", F.col("v").alias("seed"))).select(F.col("v").alias(node), "seed")


def gram_classes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """((id, class) of each item, (id, grams, day, simhash) of one item for each set of grams and day).

    The day is that of publication, or of the fetch where there is none; without either an
    item can't be near another and isn't clustered.
    """
    it = items(spark, folder, "title", "canonical_title", "published_ts", "simhash")
    title = F.coalesce(F.nullif("canonical_title", F.lit("")), "title", F.lit(""))
    sets = it.select("id", "simhash", text.grams(title).alias("grams"), F.floor(F.coalesce("published_ts", "fetched_ts") / 86400).alias("day")).filter("size(grams) > 0 and day is not null")
    # written once, as the tokens are the costly part and both results come from them
    sets = materialize(sets.withColumn("key", F.sha2(F.concat_ws("\u0001", F.col("day").cast("string"), F.array_join("grams", "\u0001")), 256)), "gram-items")
    first = sets.groupBy("key").agg(F.min(F.struct("id", "grams", "day", "simhash")).alias("x")).select("key", "x.*")
    return sets.select("id", "key").join(first.select("key", F.col("id").alias("class")), "key").select("id", "class"), first.select("id", "grams", "day", "simhash")


def with_prints(sets: DataFrame, zero: bool = False) -> DataFrame:
    """(id, grams, day, hash) for tiles; without `zero` a fingerprint of 0 counts as none."""
    return sets.select("id", "grams", "day", (F.col("simhash") if zero else F.nullif("simhash", F.lit(0))).cast("bigint").alias("hash"))


_SETS = f"{IT_SQL}, {_TOK_SQL}, g AS (SELECT tok.id, list_sort(list_distinct(toks)) AS grams, CAST(floor(coalesce(it.published_ts, it.fetched_ts) / 86400) AS BIGINT) AS day FROM tok JOIN it ON it.id = tok.id WHERE len(toks) > 0 AND coalesce(it.published_ts, it.fetched_ts) IS NOT NULL), s AS (SELECT min(id) AS id, grams, day FROM g GROUP BY grams, day), e AS (SELECT id, day, unnest(grams) AS gram, len(grams) AS n FROM s)"
_PAIRS = f"{_SETS}, p AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id AND abs(a.day - b.day) <= 3 GROUP BY 1, 2)"


@query("A29_gram_frequency", f"WITH {IT_SQL}, {_TOK_SQL} SELECT gram, count(*) AS df FROM (SELECT id, unnest(list_distinct(toks)) AS gram FROM tok) GROUP BY 1")
def gram_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return titled(spark, folder).select(F.explode(text.grams("t")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


@query("A30_rare_grams", f"WITH {IT_SQL}, {_TOK_SQL}, f AS (SELECT gram, count(*) AS df FROM (SELECT id, unnest(list_distinct(toks)) AS gram FROM tok) GROUP BY 1) SELECT gram, df FROM f WHERE df <= greatest(2, floor(0.004 * (SELECT count(*) FROM tok)))")
def rare_grams(spark: SparkSession, folder: str) -> DataFrame:
    t = titled(spark, folder)
    cap = F.broadcast(t.agg(F.greatest(F.lit(2), F.floor(0.004 * F.count("*"))).alias("cap")))
    return gram_frequency(spark, folder).join(cap, F.col("df") <= F.col("cap")).select("gram", "df")


def links_of(pairs: DataFrame, value: Column) -> DataFrame:
    """(id, n_links, best) of (a, b) pairs: one row per set that has a partner."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), value.alias("v"))
    return ends.groupBy("id").agg(F.count("*").alias("n_links"), F.max("v").alias("best"))


@query("J13_similarity_join", f"WITH {_PAIRS}, d AS (SELECT a AS id, jaccard FROM p WHERE jaccard >= 0.42 UNION ALL SELECT b, jaccard FROM p WHERE jaccard >= 0.42), l AS (SELECT id, count(*) AS n_links, round(max(jaccard), 6) AS best FROM d GROUP BY 1) SELECT g.id, s.id AS class_id, coalesce(l.n_links, 0) AS n_links, l.best FROM g JOIN s ON s.grams = g.grams AND s.day = g.day LEFT JOIN l ON l.id = s.id")
def similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with its class of equal titles, and the links of the class to similar ones."""
    members, sets = gram_classes(spark, folder)
    links = tiles.links(with_prints(sets), WINDOW_DAYS, "similar")
    return members.join(links.withColumnRenamed("id", "class"), "class", "left").select("id", F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.round("best", 6).alias("best"))


@query("C03_pair_rules", f"WITH {_PAIRS}, x AS (SELECT p.*, a.simhash AS ha, b.simhash AS hb FROM p JOIN it a ON a.id = p.a JOIN it b ON b.id = p.b WHERE jaccard >= 0.25), v AS (SELECT a, b, CASE WHEN jaccard >= 0.42 THEN greatest(jaccard, 0.6) WHEN bit_count(xor(ha, hb)) <= 6 THEN greatest(0.5, 1 - bit_count(xor(ha, hb)) / 12) ELSE jaccard END AS s FROM x), d AS (SELECT a AS id, s FROM v WHERE s >= 0.5 UNION ALL SELECT b, s FROM v WHERE s >= 0.5) SELECT id, count(*) AS n_links, round(max(s), 6) AS best FROM d GROUP BY 1")
def pair_rules(spark: SparkSession, folder: str) -> DataFrame:
    """How many partners the rules on sets and fingerprints give each title, and the best similarity."""
    sets = with_prints(gram_classes(spark, folder)[1], zero=True)
    return tiles.links(sets, WINDOW_DAYS, "prints").withColumn("best", F.round("best", 6))


@query("C05_best_candidates", f"WITH {_PAIRS}, q AS (SELECT a, b, jaccard FROM p WHERE jaccard >= 0.42), d AS (SELECT a AS id, b AS other, jaccard FROM q UNION ALL SELECT b, a, jaccard FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(jaccard, 9) DESC, other DESC) AS place FROM d) SELECT id, other, place FROM r WHERE place <= 6")
def best_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For each title its six most similar ones."""
    return places(with_prints(gram_classes(spark, folder)[1]), "similar")


def places(sets: DataFrame, rule: str) -> DataFrame:
    """(id, other, place) of the six most similar ones of each set."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), F.desc("other")))
    ranked = tiles.best(sets, WINDOW_DAYS, rule, 6).withColumn("place", place)
    return ranked.filter("place <= 6").select("id", "other", F.col("place").cast("bigint").alias("place"))


@query("C08_clusters", f"WITH RECURSIVE {_PAIRS}, q AS (SELECT a, b FROM p WHERE jaccard >= 0.42), l AS (SELECT a AS x, b AS y FROM q UNION SELECT b, a FROM q), r AS (SELECT id AS v, id AS root FROM s UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.v), c AS (SELECT v, min(root) AS root FROM r GROUP BY 1), m AS (SELECT g.id, s.id AS class FROM g JOIN s ON s.grams = g.grams AND s.day = g.day) SELECT m.id, c.root FROM m JOIN c ON c.v = m.class")
def clusters_of_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with the first id of its group of similar titles."""
    members, sets = gram_classes(spark, folder)
    sets = materialize(sets, "gram-sets")
    groups = connected(sets, tiles.chained(with_prints(sets), WINDOW_DAYS, "similar"))
    return members.join(groups.select(F.col("id").alias("class"), "root"), "class").select("id", "root")


@query("C04_conflicts", f"WITH {_PAIRS}, n AS (SELECT id, [x FOR x IN grams IF regexp_matches(x, '^[0-9]')] AS n FROM s), c AS (SELECT p.a, p.b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b WHERE jaccard >= 0.42 AND len(x.n) > 0 AND len(y.n) > 0 AND len(list_intersect(x.n, y.n)) = 0) SELECT id, count(*) AS n_conflicts FROM (SELECT a AS id FROM c UNION ALL SELECT b FROM c) GROUP BY 1")
def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """For each title the similar ones whose figures contradict it."""
    against = tiles.links(with_prints(gram_classes(spark, folder)[1]), WINDOW_DAYS, "figures")
    return against.select("id", F.col("n_links").alias("n_conflicts"))


@query("C06_seeded_clusters")
def seeded_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with the seed of its group: similar to it and not in conflict with it."""
    members, sets = gram_classes(spark, folder)
    sets = materialize(sets, "gram-sets")
    groups = tiles.seeds(with_prints(sets), WINDOW_DAYS, "agreed")
    return members.join(groups.select(F.col("id").alias("class"), "seed"), "class").select("id", "seed")


_CASCADE = f"""{_SETS}, p AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.gram = b.gram AND a.id < b.id AND abs(a.day - b.day) <= 3 GROUP BY 1, 2),
x AS (SELECT p.a, p.b, k / (na + nb - k) AS j, k / least(na, nb) AS o, least(na, nb) AS least_n, CASE WHEN coalesce(a.simhash, 0) = 0 OR coalesce(b.simhash, 0) = 0 THEN 64 ELSE bit_count(xor(a.simhash, b.simhash)) END AS h FROM p JOIN it a ON a.id = p.a JOIN it b ON b.id = p.b),
q AS (SELECT * FROM (SELECT a, b, CASE WHEN j >= 0.42 THEN greatest(j, 0.6) WHEN o >= 0.68 AND least_n >= 8 THEN greatest(0.9 * o, 0.55) WHEN h <= 6 AND j >= 0.25 THEN greatest(0.5, 1 - h / 12) ELSE j END AS s FROM x) WHERE s >= 0.5),
d AS (SELECT a AS id, b AS other, s FROM q UNION ALL SELECT b, a, s FROM q)"""


@query("C03_cascade_links", f"WITH {_CASCADE} SELECT id, count(*) AS n_links, round(max(s), 6) AS best FROM d GROUP BY 1")
def linked_titles(spark: SparkSession, folder: str) -> DataFrame:
    """How many partners the rules on sets, containment and fingerprints give each title, and the best similarity."""
    sets = with_prints(gram_classes(spark, folder)[1])
    return tiles.links(sets, WINDOW_DAYS, "cascade").withColumn("best", F.round("best", 6))


@query("J13_cascade_join", f"WITH {_CASCADE}, l AS (SELECT id, count(*) AS n_links, round(max(s), 6) AS best FROM d GROUP BY 1) SELECT g.id, s.id AS class_id, coalesce(l.n_links, 0) AS n_links, l.best FROM g JOIN s ON s.grams = g.grams AND s.day = g.day LEFT JOIN l ON l.id = s.id")
def cascade_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with its class of equal titles, and the links of the class by the pair rules."""
    members, sets = gram_classes(spark, folder)
    links = tiles.links(with_prints(sets), WINDOW_DAYS, "cascade")
    return members.join(links.withColumnRenamed("id", "class"), "class", "left").select("id", F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.round("best", 6).alias("best"))


@query("C05_cascade_candidates", f"WITH {_CASCADE}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, other DESC) AS place FROM d) SELECT id, other, place FROM r WHERE place <= 6")
def cascade_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For each title the six most similar ones by the pair rules."""
    return places(with_prints(gram_classes(spark, folder)[1]), "cascade")


@query("C08_cascade_clusters", f"WITH RECURSIVE {_CASCADE}, r AS (SELECT id AS v, id AS root FROM s UNION SELECT d.other, r.root FROM r JOIN d ON d.id = r.v), c AS (SELECT v, min(root) AS root FROM r GROUP BY 1), m AS (SELECT g.id, s.id AS class FROM g JOIN s ON s.grams = g.grams AND s.day = g.day) SELECT m.id, c.root FROM m JOIN c ON c.v = m.class")
def cascade_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each item with the first id of its group of titles that the pair rules link."""
    members, sets = gram_classes(spark, folder)
    sets = materialize(sets, "gram-sets")
    groups = connected(sets, tiles.chained(with_prints(sets), WINDOW_DAYS, "cascade"))
    return members.join(groups.select(F.col("id").alias("class"), "root"), "class").select("id", "root")
