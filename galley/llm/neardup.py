"""Near-duplicate records by sequential Bayesian verification.

1. Word-for-word copies (after normal form) fall together first; one of each goes on.
2. A record is the set of its five-word shingles (Chinese: ten characters). Its min-hashes are
   cut into BANDS bands of ROWS; records that agree in all hashes of a band are candidates.
3. Signatures of candidates (SIGNATURE other min-hashes, a byte of each) are compared batch by
   batch. After each batch a pair is dropped if the posterior probability that its similarity
   reaches the threshold, given the matches so far, is under the chosen miss probability.
4. The surviving pairs are verified exactly on their shingles.

Reordered, inserted and omitted sentences leave most shingles whole; reports of one fixed
wording share few, as their names, dates and figures break the shingles. TESTDATA asks for
texts that share clearly more than half of their wording: with one or two edits a sentence that
is a shingle similarity of THRESHOLD and more.

Band keys are sorted within hash partitions and read as runs. A run of more than HOT records is
not paired in that task: its records go, with their signatures, into blocks of about HOT, every
pair of blocks is a group of its own, and only pairs that survive the pruning come out. No
bucket, partner or candidate is capped. Copies are joined in at the end, only where all pairs
are asked for (p2_found; p2_groups is the form that grows with the records). Summaries shorter
than MIN_LATIN or MIN_HAN letters aren't records; null titles count as empty; of different texts
under one id that of the greatest fingerprint counts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import spread
from galley.llm.encodings import DOUBTFUL, restore
from galley.llm.unify import LOOKALIKES, UNCOMMON, mapping
from galley.operators.clustering import connected
from galley.session import materialize
from galley.sources.tables import table

SHINGLE_WORDS, SHINGLE_HAN = 5, 10
MIN_LATIN, MIN_HAN = 240, 120
THRESHOLD = 0.33
#: A pair at the threshold becomes a candidate with probability 1 - (1 - THRESHOLD**ROWS)**BANDS = 0.99.
BANDS, ROWS = 126, 3
#: Hashes of a signature, those compared at a time, and the probability of dropping a pair that reaches the threshold.
SIGNATURE, BATCH, MISS = 96, 32, 0.001
#: Records of one band key that are paired within a task; more are paired block by block.
HOT = 512
#: Bits of a band key; others that fall together by chance are pruned.
KEY_BITS = 40
SEED = 13

_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+(?:[.,]\d+)*")
_HAN = re.compile("[一-鿿]")
#: Texts of these letters only have no doubtful or unusual ones.
_PLAIN, _PLAIN_TOKEN = re.compile("[\x00->@-~]*"), re.compile("[a-z0-9]+(?:[.,][0-9]+)*")
#: As a place may begin only with a question mark, behind a letter, or with a letter that isn't plain, others are passed at once.
_ODD = re.compile("(?=[?\x7f-\U0010ffff])(?:" + DOUBTFUL.replace("|[A-Za-z]\\?", "|(?<=[A-Za-z])\\?") + ")")
_UNUSUAL = re.compile(UNCOMMON)
_CLEAN = {ord(k): v for k, v in mapping().items()} | {ord(k): v for k, v in LOOKALIKES.items()}


def tokens(text: str) -> list[str]:
    """The words of a text in normal form; Chinese by characters."""
    if _PLAIN.fullmatch(text):
        return _PLAIN_TOKEN.findall(text.lower())
    if _ODD.search(text):
        text, _ = restore(text)
    if _UNUSUAL.search(text):
        text = unicodedata.normalize("NFC", text.translate(_CLEAN))
    return _TOKEN.findall(text.casefold())


def shingle_size(words: list[str]) -> int:
    han = sum(1 for w in words if "一" <= w <= "鿿" and len(w) == 1)
    return SHINGLE_HAN if 2 * han > len(words) else SHINGLE_WORDS


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    k = shingle_size(words)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@lru_cache(maxsize=256)
def _shingles_of(text: str) -> set[tuple[str, ...]]:
    """The shingles of a text in normal form; its pairs come near each other."""
    return shingles(text.split(" "))


@lru_cache(maxsize=1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS + SIGNATURE
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """The shingles of a text as numbers, each once. `known` keeps the numbers of words."""
    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        raw = w.encode()
        known[w] = (zlib.crc32(raw) << 32 | zlib.adler32(raw)) * 0x9E3779B97F4A7C15 % 2**64
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = shingle_size(words)
    n = max(1, len(h) - k + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        mixed *= _P
        mixed += h[j : j + n]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _P
    codes = np.sort((mixed >> np.uint64(32)).astype(np.uint32))
    first = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    return codes[first]


def shingle_lists(texts: list[list[str]], known: dict[str, int]) -> list[np.ndarray]:
    """The numbers of `shingle_codes` for many texts at once; one that a text repeats may come again."""
    if len(known) > 500_000:
        known.clear()
    for w in set().union(*texts).difference(known):
        raw = w.encode()
        known[w] = (zlib.crc32(raw) << 32 | zlib.adler32(raw)) * 0x9E3779B97F4A7C15 % 2**64
    lens = [len(words) for words in texts]
    total = sum(lens)
    h = np.zeros(total + SHINGLE_HAN, np.uint64)
    h[:total] = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, total)
    of_size, out, at = {}, [], 0
    for words, n in zip(texts, lens):
        k = shingle_size(words)
        if n < k:
            out.append(shingle_codes(words, known))
        else:
            if k not in of_size:
                mixed = np.zeros(total, np.uint64)
                for j in range(k):
                    mixed *= _P
                    mixed += h[j : j + total]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _P
                of_size[k] = (mixed >> np.uint64(32)).astype(np.uint32)
            out.append(of_size[k][at : at + n - k + 1])
        at += n
    return out


def min_hashes(codes: np.ndarray, part: slice) -> np.ndarray:
    a, b = (x[part] for x in _coefficients())
    least = None
    for lo in range(0, len(codes), 4096):  # a very long text takes no more room than a page
        x = codes[lo : lo + 4096, None] * a
        x += b
        x = x.min(0)
        least = x if least is None else np.minimum(least, x)
    return least


def signature(codes: np.ndarray) -> bytes:
    """A byte of each of the hashes that no band uses; what agrees by chance is one in 256."""
    h = min_hashes(codes, slice(BANDS * ROWS, None)).astype(np.uint64)
    return ((h * _P) >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(*texts: np.ndarray) -> np.ndarray:
    """A number for each band of the texts, one text after another: its place and the hashes of its rows."""
    h = np.stack([min_hashes(codes, slice(0, BANDS * ROWS)) for codes in texts]).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ h[:, :, r]) * _P
        key ^= key >> np.uint64(31)
    return ((key * _P) >> np.uint64(64 - KEY_BITS)).astype(np.int64).ravel()


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, ...]:
    """For each number of batches compared, the fewest matches with which a pair goes on.

    The prior of the similarity is uniform; a hash agrees if the pair shares it, or by chance.
    """
    s = (np.arange(4000) + 0.5) / 4000
    agree = s + (1 - s) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            logp = m * np.log(agree) + (n - m) * np.log1p(-agree)
            p = np.exp(logp - logp.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (rows of signatures) pass all batches; a pair is dropped at once."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), int)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(signatures: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), SIGNATURE)


def records(texts: DataFrame) -> DataFrame:
    """(id, rep, text, sig): normal form of (id, title, summary), long enough summaries only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            out = []
            for i, title, summary in zip(b["id"], b["title"], b["summary"]):
                han = len(_HAN.findall(summary)) * 4 > len(summary)
                if len(summary) >= (MIN_HAN if han else MIN_LATIN):
                    words = tokens(f"{title or ''}\n{summary}")
                    if words:
                        out.append((i, words))
            for lo in range(0, len(out), 500):
                ids, texts = zip(*out[lo : lo + 500])
                yield pd.DataFrame({"id": ids, "text": [" ".join(words) for words in texts], "sig": [signature(codes) for codes in shingle_lists(texts, known)]})

    # what is too short can't count; it is left out before anything moves
    rows = texts.filter(F.col("id").isNotNull() & (F.length("summary") >= min(MIN_HAN, MIN_LATIN))).select("id", "title", "summary")
    return spread(rows).mapInPandas(run, "id string, text string, sig binary").select("id", F.xxhash64("text").alias("rep"), "text", "sig")


def bands(reps: DataFrame) -> DataFrame:
    """(key, rep): the band keys of (rep, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                keys = band_keys(*shingle_lists([t.split(" ") for t in part["text"]], known))
                yield pd.DataFrame({"key": keys, "rep": np.repeat(part["rep"].to_numpy(), BANDS)})

    return reps.select("rep", "text").mapInPandas(run, "key long, rep long")


def run_pairs(key: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """(pairs x 2): all pairs of records of equal key; keys are sorted."""
    out, at = [np.zeros((0, 2), np.int64)], np.flatnonzero(key[1:] == key[:-1])
    step = 1
    while len(at):
        out.append(np.stack([rep[at], rep[at + step]], 1))
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
    pairs = np.concatenate(out)
    return np.stack([pairs.min(1), pairs.max(1)], 1)


def paired(rows: DataFrame) -> DataFrame:
    """(a, b, key) of (key, rep): pairs of runs of up to HOT records (key null), members of longer ones (b null).

    A run is looked at as a whole, wherever batches end; no more than HOT of its rows are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rep, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        pairs: list[np.ndarray] = []

        def frame(some: list[np.ndarray]) -> pd.DataFrame:
            both = np.concatenate(some)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.r_[True, (both[1:] != both[:-1]).any(1)]] if len(both) else both
            return pd.DataFrame({"a": both[:, 0], "b": pd.array(both[:, 1], "Int64"), "key": pd.array([None] * len(both), "Int64")})

        def members(k: np.ndarray, r: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": r, "b": pd.array([None] * len(r), "Int64"), "key": pd.array(k, "Int64")})

        for b in batches:
            key, rep = np.r_[key, b["key"].to_numpy()], np.r_[rep, b["rep"].to_numpy()]
            if hot is not None:  # the rest of a run that is known to be long
                n = int(np.searchsorted(key, hot, "right"))
                if n:
                    yield members(key[:n], rep[:n])
                if n == len(key):
                    key, rep = key[:0], rep[:0]
                    continue
                key, rep, hot = key[n:], rep[n:], None
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            last = starts[-1]
            long = np.repeat(sizes > HOT, sizes)
            whole = np.arange(len(key)) < last
            if (long & whole).any():
                yield members(key[long & whole], rep[long & whole])
            short = ~long & whole
            pairs.append(run_pairs(key[short], rep[short]))
            if sizes[-1] > HOT:
                hot = key[-1]
                yield members(key[last:], rep[last:])
                key, rep = key[:0], rep[:0]
            else:
                key, rep = key[last:], rep[last:]
            if sum(map(len, pairs)) > 200_000:
                yield frame(pairs)
                pairs = []
        pairs.append(run_pairs(key, rep))
        yield frame(pairs)

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, key long")


def hot_pairs(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b): the pairs of (key, rep), many of a key, that survive the pruning; in blocks of about HOT."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks"))
    rows = members.join(sizes, "key").join(sigs, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "sig")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        mine = group["own"].to_numpy() == group["i"].to_numpy()
        same = group["i"].iloc[0] == group["j"].iloc[0]
        left, right = (group[mine], group) if same else (group[mine], group[~mine])
        out = []
        if len(left) and len(right):
            sl, sr, rl, rr = _matrix(left["sig"]), _matrix(right["sig"]), left["rep"].to_numpy(), right["rep"].to_numpy()
            for k in range(len(rl)):
                ok = survives(np.broadcast_to(sl[k], sr.shape), sr) & ((rl[k] < rr) if same else (rl[k] != rr))
                if ok.any():
                    out.append(np.stack([np.minimum(rl[k], rr[ok]), np.maximum(rl[k], rr[ok])], 1))
        both = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def similar_reps(reps: DataFrame) -> DataFrame:
    """(a, b, similarity): the pairs of different texts (rep, text, sig) that reach the threshold."""
    sigs = reps.select("rep", "sig")
    met = materialize(paired(bands(reps)), "dup-met")
    # partitioned by one of the two, for the join that follows
    candidates = met.filter("b is not null").select("a", "b").repartition("a").distinct()
    judged = candidates.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[survives(_matrix(b["sa"]), _matrix(b["sb"])), ["a", "b"]]

    alive = judged.mapInPandas(prune, "a long, b long")
    hot = met.filter("key is not null").select("key", F.col("a").alias("rep"))
    if not hot.isEmpty():
        alive = alive.unionByName(hot_pairs(hot, sigs)).distinct()
    full = alive.join(reps.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(reps.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y, ta, tb in zip(b["a"], b["b"], b["ta"], b["tb"]):
                sa, sb = _shingles_of(ta), _shingles_of(tb)
                both = len(sa & sb)
                j = both / (len(sa) + len(sb) - both)
                if j >= THRESHOLD:
                    out.append((x, y, j))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return full.mapInPandas(verify, "a long, b long, similarity double")


def members_and_links(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, rep): the record of each id and its text class; (a, b, similarity): class pairs)."""
    found = materialize(records(items), "dup-records")
    reps = found.groupBy("rep").agg(F.min("text").alias("text"), F.min("sig").alias("sig"))
    return found.groupBy("id").agg(F.max("rep").alias("rep")), similar_reps(reps)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = members_and_links(table(spark, folder, "items").select("id", "title", "summary"))
    links = links.select("a", "b")
    first, second = (members.select(F.col("rep").alias(r), F.col("id").alias(i)) for r, i in (("a", "x"), ("b", "y")))
    across = links.join(first, "a").join(second, "b").select("x", "y")
    copies = members.select("rep", F.col("id").alias("x")).join(members.select("rep", F.col("id").alias("y")), "rep").filter("x < y").select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("item_id_a"), F.greatest("x", "y").alias("item_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, class_id, n_links): each record's group of near-duplicates and its links to other texts."""
    members, links = members_and_links(table(spark, folder, "items").select("id", "title", "summary"))
    links = materialize(links, "dup-pairs")
    # texts without a link are a class of their own and take no part in the rounds
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    labels = connected(linked, links, "rep").withColumnRenamed("root", "class")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = members.join(labels, "rep", "left").join(degree, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    names = named.groupBy("class").agg(F.min("id").alias("class_id"))
    return named.join(names, "class").select(F.col("id").alias("item_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


SQL: dict[str, str] = {}
QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
