"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of every kind, and the marks that cannot be seen, as a Java pattern.
_EDGE = r"[\s\u00a0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+"
#: Plan nodes that may move rows.
_SHUFFLED = re.compile(r"\b(Aggregate|Join|Window|Deduplicate|Sort|RepartitionByExpression|Repartition|RebalancePartitions|GlobalLimit)\b")


def source_key(column: str = "source_id") -> Column:
    """A contributor's key: trimmed of white space of any kind, lower case, null as ''."""
    return F.lower(F.coalesce(F.regexp_replace(F.col(column), f"^{_EDGE}|{_EDGE}$", ""), F.lit("")))


def spread(df: DataFrame) -> DataFrame:
    """A scan over enough tasks for Python work: files of few row groups give few splits.

    A table that arrives as one or two splits would keep most cores idle, so it is
    repartitioned at random; larger tables keep their scan partitions and no shuffle.
    What comes out of a shuffle is left as it is; asking for its partitions would run it.
    """
    if _SHUFFLED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by key over all shuffle partitions of the session.

    A grouping by the same keys needs no other shuffle, and adaptive execution doesn't
    merge these partitions, which hold too little data but enough work for Python.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
