"""Evaluation of clusterings and of annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.plans.catalog import query
from galley.sources.snapshots import IT_SQL, items
from galley.sources.tables import table


def b_cubed(labelled: DataFrame) -> DataFrame:
    """(precision, recall, f1) of (predicted, gold) labels, from the counts of label pairs alone."""
    both = labelled.groupBy("predicted", "gold").agg(F.count("*").alias("n"))
    p = both.groupBy("predicted").agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t")).agg(F.sum(F.col("s") / F.col("t")).alias("p"), F.sum("t").alias("all"))
    g = both.groupBy("gold").agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t")).agg(F.sum(F.col("s") / F.col("t")).alias("g"))
    x = p.crossJoin(g).select((F.col("p") / F.col("all")).alias("precision"), (F.col("g") / F.col("all")).alias("recall"))  # single rows
    return x.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def pair_counts(labelled: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn) over all pairs, by counting: no pair is made."""
    def pairs(by: list[str], name: str) -> DataFrame:
        n = labelled.groupBy(*by).agg(F.count("*").alias("n")) if by else labelled.agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias(name))

    x = pairs(["predicted", "gold"], "tp").crossJoin(pairs(["predicted"], "p")).crossJoin(pairs(["gold"], "g")).crossJoin(pairs([], "a"))
    return x.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), (F.col("a") - F.col("p") - F.col("g") + F.col("tp")).alias("tn"))


_LABELS = f"{IT_SQL}, l AS (SELECT CASE WHEN simhash > 0 THEN simhash::VARCHAR ELSE id END AS predicted, cluster_id AS gold FROM it WHERE cluster_id IS NOT NULL)"


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Items grouped by equal fingerprints, against their delivered clusters."""
    it = items(spark, folder, "simhash", "cluster_id").filter("cluster_id is not null")
    return it.select(F.when(F.col("simhash") > 0, F.col("simhash").cast("string")).otherwise(F.col("id")).alias("predicted"), F.col("cluster_id").alias("gold"))


@query("A22_pair_counts", f"WITH {_LABELS}, x AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM l GROUP BY predicted, gold)) AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM l GROUP BY predicted)) AS p, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM l GROUP BY gold)) AS g, (SELECT count(*) * (count(*) - 1) // 2 FROM l) AS a) SELECT tp::BIGINT AS tp, (p - tp)::BIGINT AS fp, (g - tp)::BIGINT AS fn, (a - p - g + tp)::BIGINT AS tn FROM x")
def cluster_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pair_counts(labels(spark, folder))


@query("A23_b_cubed", f"WITH {_LABELS}, b AS (SELECT predicted, gold, count(*) AS n FROM l GROUP BY 1, 2), x AS (SELECT (SELECT sum(s / t) FROM (SELECT sum(n * n) AS s, sum(n) AS t FROM b GROUP BY predicted)) / (SELECT sum(n) FROM b) AS p, (SELECT sum(s / t) FROM (SELECT sum(n * n) AS s, sum(n) AS t FROM b GROUP BY gold)) / (SELECT sum(n) FROM b) AS r) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM x")
def cluster_b_cubed(spark: SparkSession, folder: str) -> DataFrame:
    return b_cubed(labels(spark, folder)).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("A24_agreement", "WITH p AS (SELECT a.label AS x, b.label AS y FROM doc_labels a JOIN doc_labels b ON a.doc_id = b.doc_id AND a.annotator < b.annotator), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE x = y) AS same FROM p), e AS (SELECT coalesce(sum(cx * cy), 0) AS e FROM (SELECT x, count(*)::DOUBLE AS cx FROM p GROUP BY 1) JOIN (SELECT y, count(*)::DOUBLE AS cy FROM p GROUP BY 1) ON x = y) SELECT n::BIGINT AS pairs, round(same / nullif(n, 0), 6) AS agreement, round((same / nullif(n, 0) - e / nullif(n * n, 0)) / nullif(1 - e / nullif(n * n, 0), 0), 6) AS kappa FROM n, e")
def agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of annotators of the same document, and Cohen's kappa."""
    d = table(spark, folder, "doc_labels")
    a, b = d.select("doc_id", F.col("annotator").alias("a"), F.col("label").alias("x")), d.select("doc_id", F.col("annotator").alias("b"), F.col("label").alias("y"))
    m = a.join(b, "doc_id").filter("a < b").groupBy("x", "y").agg(F.count("*").alias("c"))
    n = m.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)), F.lit(0)).alias("same"))
    cx, cy = m.groupBy(F.col("x").alias("k")).agg(F.sum("c").alias("cx")), m.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("cy"))
    e = cx.join(cy, "k").agg(F.coalesce(F.sum(F.col("cx").cast("double") * F.col("cy")), F.lit(0.0)).alias("e"))
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("e"), F.col("n").cast("double") * F.col("n"))
    return n.crossJoin(e).select(F.col("n").alias("pairs"), F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))
