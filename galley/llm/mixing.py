"""Mixing sources to target shares of all tokens.

The texts of each source are encoded with a public tokenizer and packed one after another
into blocks of BLOCK tokens. The mixture has as many slots as the scarcest source allows:
the largest number for which every source fills its share with at most `max_repeats` uses of
each of its blocks, so that the shares meet their targets. Each output shard draws how many
slots every source gets, multinomially from what each source has left (so that the totals
are met exactly): the driver draws for at most GROUPS groups of shards, the executors for the
shards of each group. The slots of a source, numbered through all shards, are mapped to its
blocks by a pseudorandom permutation of each round through the source. Blocks are joined to
slots by (source, index).

Places of texts in the token stream come from sums over buckets of texts and a running sum
within each bucket, so no source is ever sorted in one task. The rows of the target table are
read by the driver (one per source); so are one count per source and bucket sums per source
only in Spark. A source without tokens gets nothing; its share goes to the others in
proportion and shows in the report. Null and empty texts have no tokens. The last block of a
source may be shorter. Sources are compared trimmed and in lower case.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.llm.common import source_key
from galley.llm.tokens import encode
from galley.session import materialize
from galley.sources.tables import table

BLOCK, SHARD_BLOCKS = 512, 64
#: Groups of shards for which the driver draws; slots that a task makes at a time.
GROUPS, AT_ONCE = 512, 100_000
#: Texts of a source that fall into one bucket of the running sums, about.
BUCKET_DOCS, SEED = 20_000, 17

PLAN = "source string, target_share double, max_repeats int, n_tokens long, n_blocks long, n_slots long"


def packed(documents: DataFrame, tokenizer: str = "byte_bpe_50k", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((source, block, n_tokens, ids), (source, n_tokens, n_blocks)) of (doc_id, source, text)."""
    named = documents.filter(F.length("text") > 0).select(F.struct("source", "doc_id").alias("doc"), "text")
    coded = encode(named, tokenizer, key="doc").select("doc.source", "doc.doc_id", "ids", F.size("ids").alias("n"))
    coded = materialize(coded.filter("n > 0"), "mix-ids")
    buckets = max(1, math.ceil(coded.count() / BUCKET_DOCS))
    coded = coded.withColumn("order", F.xxhash64("doc_id", F.lit(SEED))).withColumn("bucket", F.pmod("order", F.lit(buckets)))

    sizes = coded.groupBy("source", "bucket").agg(F.sum("n").alias("size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = coded.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["source", "bucket"])
    placed = placed.select("source", "ids", "n", (F.col("start") + F.col("inside")).alias("at"))

    # the pieces of a text in the blocks it reaches into
    length = F.lit(block)
    pieces = placed.select("source", "ids", "n", "at", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length))).alias("block"))
    lo = F.greatest(F.col("block") * length - F.col("at"), F.lit(0))
    hi = F.least((F.col("block") + 1) * length - F.col("at"), F.col("n"))
    pieces = pieces.select("source", "block", F.greatest(F.col("at"), F.col("block") * length).alias("at"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))
    blocks = pieces.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    blocks = blocks.select("source", "block", F.size("ids").alias("n_tokens"), "ids")
    totals = coded.groupBy("source").agg(F.sum("n").alias("n_tokens")).withColumn("n_blocks", F.ceil(F.col("n_tokens") / length))
    return blocks, totals


@dataclass
class Source:
    name: str
    target: float
    repeats: int
    tokens: int
    blocks: int
    slots: int = 0


def planned(sources: list[Source]) -> list[Source]:
    """Sets the slots of each source: the most for which all shares meet their targets."""
    able = [s for s in sources if s.blocks and s.target > 0 and s.repeats > 0]
    whole = sum(s.target for s in able)
    if not able:
        return sources
    total = min(s.blocks * s.repeats * whole / s.target for s in able)
    exact = [total * s.target / whole for s in able]
    for s, x in zip(able, exact):
        s.slots = min(int(x + 1e-9), s.blocks * s.repeats)
    rest = int(total + 1e-9) - sum(s.slots for s in able)
    for s, x in sorted(zip(able, exact), key=lambda p: p[0].slots - p[1])[: max(0, rest)]:
        s.slots = min(s.slots + 1, s.blocks * s.repeats)
    return sources


def drawn(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """How many of `size` slots each source gets, by its share of what is left and no more than that."""
    n = np.zeros_like(left)
    while (short := size - int(n.sum())) > 0:
        room = left - n
        n += np.minimum(rng.multinomial(short, room / room.sum()), room)
    return n


def groups(sources: list[Source], seed: int = SEED) -> list[tuple[int, list[int], list[int]]]:
    """(first shard, slots by source, first slot of each source) of at most GROUPS groups of whole shards."""
    left = np.array([s.slots for s in sources], np.int64)
    shards = -(-int(left.sum()) // SHARD_BLOCKS)
    each = max(1, -(-shards // GROUPS))
    rng, first, out = np.random.default_rng(seed), np.zeros(len(sources), np.int64), []
    for shard in range(0, shards, each):
        n = drawn(rng, left, min(each * SHARD_BLOCKS, int(left.sum())))
        out.append((shard, n.tolist(), first.tolist()))
        first += n
        left -= n
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key: Feistel rounds, walked into range."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64).copy()
    todo = np.ones(len(out), bool)
    while todo.any():
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> b, x & m
        for r in range(4):
            f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << b) | right
        todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


def _number(text: str) -> int:
    return zlib.crc32(text.encode()) * 0x9E3779B97F4A7C15 % 2**63


def slots(spark: SparkSession, sources: list[Source], seed: int = SEED) -> DataFrame:
    """(shard, place, source, block): every slot with the block that fills it."""
    rows = groups(sources, seed)
    if not rows:
        return spark.createDataFrame([], "shard long, place int, source string, block long")
    names, blocks = [s.name for s in sources], np.array([max(1, s.blocks) for s in sources], np.int64)

    def frame(shard: list[np.ndarray], source: list[np.ndarray], k: list[np.ndarray], place: list[np.ndarray], size: list[np.ndarray]) -> pd.DataFrame:
        at, own, index, where, of = (np.concatenate(x) for x in (shard, source, k, place, size))
        # the slots of a source go through its blocks in rounds, each in an order of its own
        rounds, which = np.unique(np.stack([own, index // blocks[own]], 1), axis=0, return_inverse=True)
        keys = np.array([_number(f"{names[j]}/{r}") for j, r in rounds], np.int64)[which.ravel()]
        starts = np.unique(at, return_inverse=True)
        shard_keys = np.array([_number(f"shard {n}") for n in starts[0]], np.int64)[starts[1].ravel()]
        return pd.DataFrame({"shard": at, "place": permuted(where, of, shard_keys), "source": np.array(names, object)[own], "block": permuted(index % blocks[own], blocks[own], keys)})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, n, first in zip(b["shard"], b["n"], b["first"]):
                rng, left, upto = np.random.default_rng([seed, int(shard)]), np.array(n, np.int64), np.array(first, np.int64)
                parts: list[list[np.ndarray]] = [[], [], [], [], []]
                while left.sum():
                    size = min(SHARD_BLOCKS, int(left.sum()))
                    got = drawn(rng, left, size)
                    own = np.repeat(np.arange(len(got)), got)
                    j = np.arange(size) - np.repeat(np.cumsum(got) - got, got)
                    for part, x in zip(parts, (np.full(size, shard), own, upto[own] + j, np.arange(size), np.full(size, size))):
                        part.append(x)
                    left, upto, shard = left - got, upto + got, shard + 1
                    if len(parts[0]) * SHARD_BLOCKS >= AT_ONCE:
                        yield frame(*parts)
                        parts = [[], [], [], [], []]
                if parts[0]:
                    yield frame(*parts)

    each = spark.createDataFrame(rows, "shard long, n array<long>, first array<long>").repartition(min(len(rows), spark.sparkContext.defaultParallelism))
    return each.mapInPandas(fill, "shard long, place int, source string, block long")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = "byte_bpe_50k") -> tuple[DataFrame, DataFrame]:
    """((shard, place, source, block, n_tokens, ids), the report by source)."""
    spark = documents.sparkSession
    wanted = {}
    for r in targets.select(source_key("source").alias("source"), "target_share", "max_repeats").collect():
        wanted.setdefault(r["source"], (float(r["target_share"] or 0), int(r["max_repeats"] or 0)))
    mine = documents.select("doc_id", source_key("source").alias("source"), "text").filter(F.col("source").isin(*wanted))
    blocks, totals = packed(mine, tokenizer)
    blocks = materialize(blocks, "mix-blocks")
    have = {r["source"]: r for r in totals.collect()}
    sources = planned([Source(n, t, m, have[n]["n_tokens"] if n in have else 0, have[n]["n_blocks"] if n in have else 0) for n, (t, m) in sorted(wanted.items())])
    filled = slots(spark, sources).join(blocks, ["source", "block"]).select("shard", "place", "source", "block", "n_tokens", "ids")

    plan = spark.createDataFrame([(s.name, s.target, s.repeats, int(s.tokens), int(s.blocks), int(s.slots)) for s in sources], PLAN)
    used = filled.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("blocks_used"))
    report = plan.join(used, "source", "left").withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0))).withColumn("blocks_used", F.coalesce("blocks_used", F.lit(0)))
    all_used = F.sum("tokens_used").over(Window.partitionBy())  # one row per source
    reached = F.when(all_used > 0, F.col("tokens_used") / all_used).otherwise(0.0)
    uses = F.when(F.col("n_tokens") > 0, F.col("tokens_used") / F.col("n_tokens")).otherwise(0.0)
    most = F.when(F.col("n_blocks") > 0, F.ceil(F.col("blocks_used") / F.col("n_blocks"))).otherwise(0)
    report = report.select("source", "target_share", reached.alias("share_reached"), "max_repeats", most.alias("repeats"), uses.alias("mean_uses"), "n_tokens", "tokens_used")
    return filled, report


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every slot of the mixture with its tokens."""
    return mix(*_tables(spark, folder))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached, the repeats and the tokens of each source."""
    return mix(*_tables(spark, folder))[1]


SQL: dict[str, str] = {}
QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
