"""Capping the records of dominant contributors with an incremental state table.

The state holds, for every contributor, the records kept so far and the cutoff: the
worst kept record once the contributor is full. A new batch is first filtered against
the cutoffs (what lies behind a cutoff is displaced at once), the rest is merged with
the kept lists, and what the merge pushes out is logged as displaced.

A contributor may hold a third of all rows, so no window runs over the records of a
contributor. The place of a cutoff is found by counting: records are counted by
contributor and score step (pre-aggregated before the shuffle), running totals of
these counts name the one step in which the cutoff lies, a second count by score and
id prefix does the same within that step, and only the records of one such cell are
ranked.

Nulls: a null score ranks last, a null contributor counts as the contributor '', a
record with a null id is left out as it can't be named. Repeated ids count once.
Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.llm.common import source_key
from galley.session import materialize, release
from galley.sources.tables import table
from galley.streaming.state import StateTable

#: Batches into which a stored collection is cut, by arrival, to be fed to the state.
BATCHES = 3
#: Decimals of the score of the first count; characters of the id of the second.
SCORE_STEP, ID_PREFIX = 2, 3

KEPT = "contributor string, score double, record string"


def _ahead(rows: DataFrame, cells: list[str], best_first: list[Column], cap: str) -> DataFrame:
    """One row per contributor: the cell in which the cutoff lies, and the room left in it.

    Contributors with no more than `cap` records have no row.
    """
    counts = rows.groupBy("contributor", cap, *cells).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("contributor").orderBy(*best_first).rowsBetween(Window.unboundedPreceding, 0))
    full = counts.withColumn("upto", upto).filter((F.col("upto") > F.col(cap)) & (F.col("upto") - F.col("n") <= F.col(cap)))
    return full.select("contributor", *[F.col(c).alias(f"cut_{c}") for c in cells], (F.col(cap) - F.col("upto") + F.col("n")).alias("room"))


def keep_best(records: DataFrame, cap: int) -> DataFrame:
    """(contributor, score, record, kept): kept are the best `cap` records of each contributor.

    Best is the greatest score, nulls last, ties by the smaller record id.
    """
    rows = records.withColumn("cap", F.lit(int(cap)).cast("long")).withColumn("step", F.round("score", SCORE_STEP))
    first = _ahead(rows, ["step"], [F.col("step").desc_nulls_last()], "cap")
    rows = rows.join(first, "contributor", "left")
    before = F.when(F.col("step").isNull(), False).otherwise(F.col("cut_step").isNull() | (F.col("step") > F.col("cut_step")))
    rows = rows.withColumn("state", F.when(F.col("room").isNull() | before, "kept").when(F.col("step").eqNullSafe(F.col("cut_step")), "cut").otherwise("out"))

    # only the records at the step of the cutoff go on
    cut = rows.filter(F.col("state") == "cut").select("contributor", "score", "record", "room", F.substring("record", 1, ID_PREFIX).alias("head"))
    second = _ahead(cut, ["score", "head"], [F.col("score").desc_nulls_last(), F.col("head")], "room").withColumnRenamed("room", "left")
    cut = cut.join(second, "contributor", "left")
    better = F.when(F.col("score").isNull() & F.col("cut_score").isNotNull(), False).when(F.col("score").isNotNull() & F.col("cut_score").isNull(), True).otherwise(F.coalesce(F.col("score") > F.col("cut_score"), F.lit(False)))
    same = F.col("score").eqNullSafe(F.col("cut_score"))
    # a contributor without a second cutoff fits as it is
    place = F.when(F.col("cut_head").isNull() | better | (same & (F.col("head") < F.col("cut_head"))), "kept").when(same & (F.col("head") == F.col("cut_head")), "cut").otherwise("out")
    cut = cut.withColumn("place", place)
    last = cut.filter(F.col("place") == "cut").withColumn("at", F.row_number().over(Window.partitionBy("contributor").orderBy("record")))

    parts = [
        rows.filter(F.col("state") != "cut").select("contributor", "score", "record", (F.col("state") == "kept").alias("kept")),
        cut.filter(F.col("place") != "cut").select("contributor", "score", "record", (F.col("place") == "kept").alias("kept")),
        last.select("contributor", "score", "record", (F.col("at") <= F.col("left")).alias("kept")),
    ]
    return reduce(DataFrame.unionByName, parts)


class CapState:
    """The kept records of all contributors, the cutoffs and the log of displaced records.

    `add` takes a batch (contributor, score, record) whose records are new to the state, and its
    number; a number that was added already changes nothing. With a name the state stays in the
    shared folder, and a later run goes on with it.
    """

    def __init__(self, spark: SparkSession, cap: int, name: str | None = None):
        self.spark, self.cap = spark, int(cap)
        self.state = StateTable(spark, name)

    def add(self, batch: DataFrame, number: int | None = None) -> bool:
        last = self.state.last()
        number = (-1 if last is None else last) + 1 if number is None else number
        if self.state.done(number):
            return False
        rows = batch.select("contributor", F.col("score").cast("double").alias("score"), "record")
        behind = None
        if last is not None:
            judged = rows.join(self.cutoffs(), "contributor", "left")
            score, cut = F.coalesce("score", F.lit(float("-inf"))), F.coalesce("cut_score", F.lit(float("-inf")))
            out = F.coalesce((score < cut) | ((score == cut) & (F.col("record") > F.col("cut_record"))), F.lit(False))
            judged = materialize(judged.select("contributor", "score", "record", out.alias("behind")), "cap-judged")
            behind = judged.filter("behind").select("contributor", "score", "record")
            rows = judged.filter("not behind").drop("behind").unionByName(self.kept)
        done = materialize(keep_best(rows, self.cap), "cap-merged")
        displaced = done.filter("not kept").drop("kept")
        self.state.commit(number, {"kept": done.filter("kept").drop("kept"), "displaced": displaced if behind is None else displaced.unionByName(behind)}, whole=("kept",))
        for temporary in (done, *([] if behind is None else [judged])):
            release(temporary)
        return True

    @property
    def kept(self) -> DataFrame:
        return self.state.read("kept", KEPT)

    def cutoffs(self) -> DataFrame:
        """(contributor, cut_score, cut_record): the worst kept record of each full contributor."""
        kept = self.kept.withColumn("s", F.coalesce("score", F.lit(float("-inf"))))
        worst = kept.groupBy("contributor").agg(F.count("*").alias("n"), F.min("s").alias("low"))
        # the worst record: the lowest score, and of its ties the greatest id
        low = kept.join(worst.filter(F.col("n") >= self.cap), "contributor").filter(F.col("s") == F.col("low"))
        return low.groupBy("contributor").agg(F.max("score").alias("cut_score"), F.max("record").alias("cut_record"))

    def log(self) -> DataFrame:
        """All displaced records: (contributor, score, record)."""
        return self.state.log("displaced", KEPT)


def ranked_items(spark: SparkSession, folder: str) -> DataFrame:
    """(contributor, score, record, arrived): each item once, with the rank of its cluster.

    A repeated id counts once, as it first arrived. The rank is that of the cluster's
    row of greatest updated_ts; of rows equal in that, the greatest rank.
    """
    items = table(spark, folder, "items").filter(F.col("id").isNotNull())
    once = items.groupBy(F.col("id").alias("record")).agg(
        F.min(F.struct(F.col("fetched_ts").alias("arrived"), source_key().alias("contributor"), F.col("cluster_id").alias("cluster"))).alias("x")
    ).select("record", "x.*")
    clusters = table(spark, folder, "clusters").filter(F.col("id").isNotNull())
    now = clusters.groupBy(F.col("id").alias("cluster")).agg(F.max(F.struct("updated_ts", "rank"))["rank"].alias("score"))
    # items without a cluster don't join; a made-up key spreads them
    lone = F.concat(F.lit("\u0000"), F.col("record"))
    joined = once.withColumn("cluster", F.coalesce("cluster", lone)).join(now, "cluster", "left")
    return joined.select("contributor", F.when(~F.isnan("score"), F.col("score")).alias("score"), "record", "arrived")


def displaced_items(spark: SparkSession, folder: str, share: float = 0.02, batches: int = BATCHES) -> DataFrame:
    """The items removed when each source keeps at most floor(share * N) of all N items."""
    rows = materialize(ranked_items(spark, folder), "cap-items")
    total = rows.count()
    state = CapState(spark, int(share * total + 1e-9))
    if not total:
        return state.log()
    bounds = rows.approxQuantile("arrived", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    arrived = F.coalesce("arrived", F.lit(-(2**62)))
    number = reduce(lambda a, b: a + F.when(arrived > F.lit(b), 1).otherwise(0), bounds, F.lit(0))
    for k in range(len(bounds) + 1):
        state.add(rows.filter(number == k), k)
    return state.log()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return displaced_items(spark, folder).select(F.col("record").alias("item_id"))


def p3_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: items before and after the cap, and the shares of the whole."""
    rows = ranked_items(spark, folder)
    lost = displaced_items(spark, folder).groupBy("contributor").agg(F.count("*").alias("n_removed"))
    sizes = rows.groupBy("contributor").agg(F.count("*").alias("n_items"))
    out = sizes.join(lost, "contributor", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    return out.select(F.col("contributor").alias("source_id"), "n_items", "n_removed", (F.col("n_items") - F.col("n_removed")).alias("n_kept"))


_BASE_SQL = """
WITH once AS (
  SELECT id, min({'a': coalesce(fetched_ts, -1), 's': lower(trim(coalesce(source_id, ''))), 'c': cluster_id}) AS x
  FROM items WHERE id IS NOT NULL GROUP BY id),
now AS (
  SELECT id, arg_max(coalesce(rank, -1e300), updated_ts) AS rank FROM clusters GROUP BY id),
ranked AS (
  SELECT o.id, o.x.s AS src, count(*) OVER () AS total,
         row_number() OVER (PARTITION BY o.x.s ORDER BY coalesce(n.rank, -1e300) DESC, o.id) AS place
  FROM once o LEFT JOIN now n ON n.id = o.x.c)
"""

SQL = {
    "p3_found": _BASE_SQL + "SELECT id AS item_id FROM ranked WHERE place > floor(0.02 * total)",
    "p3_sources": _BASE_SQL + """
SELECT src AS source_id, count(*) AS n_items,
       count(*) FILTER (WHERE place > floor(0.02 * total)) AS n_removed,
       count(*) FILTER (WHERE place <= floor(0.02 * total)) AS n_kept
FROM ranked GROUP BY src""",
}
QUERIES = {"p3_found": p3_found, "p3_sources": p3_sources}
