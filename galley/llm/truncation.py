"""Texts cut off by a field limit or mid-transfer.

Three kinds of evidence are put together.

* Vocabulary trie: the words of the whole corpus form a trie, held as a table of its nodes
  (prefix, words below it). A last word that is no known word, but a proper prefix of known
  ones, was cut in mid-word.
* Endings: for the last words of a text (names and figures made alike; in Chinese the last
  characters) the corpus tells how often a sentence ends there and how often it goes on.
* Length: texts of one source that stop without a full stop at one length point to a field
  limit; for texts with an ellipsis, or cut at any length, the source's own share of cut
  endings is the prior. Whatever the prior, a cut falls on an ending in proportion to how
  often the corpus goes on there, which gives the odds of a cut.

Marks after a cut (dots, a broken tag or reference, half a character) are taken off first; a
broken one is proof by itself. A text that
closes with a full stop, a question mark or the like isn't cut, nor one cut just there.
Garbled text is restored before its end is read; where its end stays garbled, the ending tells
nothing and only length and source count.
Null, empty and blank texts are never cases. All rows count for the statistics, and whole
texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.llm.common import keyed, source_key, spread
from galley.llm.encodings import DOUBTFUL, is_garbled, restore
from galley.session import materialize
from galley.sources.tables import table

#: Words of the long and of the short ending; characters of the two for Chinese.
LATIN, HAN = (4, 2), (6, 3)
#: Keys that a task counts before it hands them on.
FLUSH = 400_000
#: Rate of sentence ends among words, likelihood ratios of a word cut in the middle (lower case, name).
ENDS, MID_WORD, MID_NAME = 1 / 15, 400.0, 15.0
SURE_CUT, SURE_END = 0.05, 0.5
#: Probability of an ending that can't be read.
BLURRED = 0.5
#: Words below a trie node per use of it as a word, from which it counts as no word.
RARE = 300
#: Cuts that fall on an ending, per cut that doesn't.
CHANCE = 0.12

_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+(?:[’'-][^\W\d_一-鿿]+)*|\d+(?:[.,:]\d+)*|[^\s\w]")
_STOPS, _DIGITS = frozenset(".!?。！？…"), frozenset("0123456789")
_BEFORE_ORDINAL = frozenset("am dem den der im vom zum ab bis seit".split())
_HAN = re.compile("[一-鿿]")
_ODD = re.compile(DOUBTFUL)
_MARK = re.compile(r"\s*(?:\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\)|…+|\.{3,}|。{3,})\s*$")
_TAG = re.compile(r"<[^<>]*$|&(?:#\d{0,6}|#x[0-9a-fA-F]{0,5}|[a-z]{2,8})$")
_QUOTED = re.compile(r"[”\"»›’')）\]」』]$")
_CLOSED = re.compile(r"[.!?。！？][”“\"»›’')）\]」』]*$")


def normal(text: str) -> tuple[list[str], list[str], bool]:
    """(tokens, the same with names and figures made alike, whether Chinese)."""
    raw = _TOKEN.findall(text)
    han = len(raw) * 2 > len(text)  # Chinese has a token for nearly every character
    alike, first = [], True
    for t in raw:
        c = t[0]
        if c in _STOPS:
            first = True
            alike.append(t)
            continue
        # the first word of a sentence has its capital by its place
        alike.append("0" if c in _DIGITS else t if first or len(t) == 1 or not c.isupper() else "X")
        first = False
    return raw, alike, han


def split_end(text: str) -> tuple[str, str]:
    """(text without the marks behind a cut, kind of the mark: '', dots, tag, half)."""
    kind, core = "", text.rstrip()
    for _ in range(4):
        if core.endswith("�"):
            kind, core = "half", core.rstrip("�").rstrip()
        elif (m := _TAG.search(core)) and m.start() > 0:
            kind, core = "tag", core[: m.start()].rstrip()
        elif m := _MARK.search(core):
            kind, core = kind or "dots", core[: m.start()].rstrip()
        else:
            break
    return core, kind


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of words, and of endings with how many of them end a sentence, per task."""
    vocabulary: Counter = Counter()
    seen: Counter = Counter()
    ends: Counter = Counter()

    def rows() -> pd.DataFrame:
        out = [("w", w, n, 0) for w, n in vocabulary.items()]
        out += [("e", "\x1f".join(k), n, ends.get(k, 0)) for k, n in seen.items()]
        vocabulary.clear(), seen.clear(), ends.clear()
        return pd.DataFrame(out, columns=["kind", "key", "n", "n_end"])

    for b in batches:
        for text, whole in zip(b["text"], b["whole"]):
            core, mark = split_end(text)
            raw, alike, han = normal(core)
            closed = whole or mark == "dots" or bool(_CLOSED.search(core))
            n = len(alike)
            last = n - (not closed)
            # the last word of a text that doesn't close may be cut; a Chinese character is no word
            vocabulary.update([t.lower() for t in (raw if closed else raw[:-1]) if (len(t) > 1 or t.isascii()) and t[0].isalpha()])
            stops = []
            for k, t in enumerate(alike):
                if t in _STOPS:
                    # the stop of a German ordinal ends no sentence
                    if t == "." and k > 1 and alike[k - 1] == "0" and raw[k - 2] in _BEFORE_ORDINAL:
                        alike[k] = "°"
                    else:
                        stops.append(k)
            closing = [k - 1 for k in stops if k and k <= last and alike[k - 1] not in _STOPS]
            if last == n and n and alike[-1] not in _STOPS:
                closing.append(n - 1)
            for size in HAN if han else LATIN:
                padded = ["."] * (size - 1) + alike
                grams = list(zip(*[padded[k:] for k in range(size)]))
                seen.update(grams[:last])
                ends.update([grams[k] for k in closing])
        if len(seen) > FLUSH:
            yield rows()
    yield rows()


_ENDING = "item_id string, source string, size long, kind string, long string, short string, last string, name boolean, open boolean, quoted boolean, sure boolean, blurred boolean"


def _endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The endings of texts that don't close."""
    for b in batches:
        out = []
        for item, source, text in zip(b["item_id"], b["source"], b["text"]):
            blurred = False
            if _ODD.search(text):
                text, _ = restore(text)
                blurred = is_garbled(text[-12:-1])
            core, kind = split_end(text)
            if not core or _CLOSED.search(core) and kind != "half":
                continue
            raw, alike, han = normal(core)
            if not alike:
                continue
            sizes = HAN if han else LATIN
            keys = ["\x1f".join((["."] * size + alike)[-size:]) for size in sizes]
            word = raw[-1] if raw and raw[-1][0].isalpha() and not _HAN.match(raw[-1]) and core[-1].isalpha() else None
            out.append((item, source, len(text.rstrip()), kind, *keys, word.lower() if word else None, bool(word and word[0].isupper()), core[-1] in ",;:，；：、（(“„«‘-–—/", bool(_QUOTED.search(core)), kind in ("half", "tag") and not blurred, blurred))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ENDING.split(", ")])


def _half_ratio(end: Column, n: Column, prior: Column, weight: float) -> Column:
    return (F.coalesce(end, F.lit(0)) + weight * prior) / (F.coalesce(n, F.lit(0)) + weight)


def truncated(texts: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """(item_id, source, odds) of the texts that don't close, with the odds that each was cut.

    `texts` has (item_id, source, text), one row per text; `complete` has (text): texts that
    are known to be whole, as headlines, and teach which words may come last.
    """
    base = texts.select("item_id", "source", "text").filter(F.length(F.trim("text")) > 0)
    corpus = base.select("text", F.lit(False).alias("whole"))
    if complete is not None:
        corpus = corpus.unionByName(complete.select("text", F.lit(True).alias("whole")).filter(F.length(F.trim("text")) > 0))
    counts = spread(corpus).mapInPandas(_count, "kind string, key string, n long, n_end long")
    # both are read several times; written once, the texts are read once for each
    counts = materialize(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), "cut-counts")
    endings = materialize(spread(base).mapInPandas(_endings, _ENDING), "cut-endings")

    stats = counts.filter(F.col("kind") == "e").select(F.xxhash64("key").alias("k"), "n", "n_end")
    words = counts.filter(F.col("kind") == "w").select(F.col("key").alias("word"), "n")
    # the trie: each node is a prefix with the number of words below it
    # only at depths where a text has its last word; there are as many as words have lengths
    depths = [r["depth"] for r in endings.filter(F.col("last").isNotNull()).select(F.length("last").alias("depth")).distinct().collect()]
    depth = F.filter(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array().cast("array<int>"), lambda k: k < F.length("word"))
    nodes = words.select(F.explode(F.transform(depth, lambda k: F.substring("word", F.lit(1), k))).alias("last"), "n")
    below = nodes.groupBy("last").agg(F.sum("n").alias("n_below"))
    known = words.select(F.col("word").alias("last"), F.col("n").alias("n_word"))

    rows = endings.withColumn("k1", F.xxhash64("long")).withColumn("k2", F.xxhash64("short"))
    rows = rows.join(stats.select(F.col("k").alias("k1"), F.col("n").alias("n1"), F.col("n_end").alias("e1")), "k1", "left")
    rows = rows.join(stats.select(F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("n_end").alias("e2")), "k2", "left")
    # texts without a last word don't meet in the join
    rows = rows.withColumn("last", F.coalesce("last", F.concat(F.lit("\u0000"), F.col("item_id"))))
    rows = rows.join(known, "last", "left").join(below, "last", "left")

    # what the corpus has never seen last is no ending; a closing quotation or bracket is one
    unseen = F.when(F.col("quoted"), 0.9).when(F.col("name"), 0.2).otherwise(0.05)
    short = F.when(F.col("quoted"), F.lit(0.9)).otherwise(_half_ratio(F.col("e2"), F.col("n2"), unseen, 1.0))
    end = F.when(F.col("open"), F.lit(0.002)).otherwise(F.least(F.lit(0.995), F.greatest(F.lit(0.002), _half_ratio(F.col("e1"), F.col("n1"), short, 2.0))))
    # a word cut before an ellipsis has been counted itself
    other = F.coalesce("n_word", F.lit(0)) - F.when(F.col("kind") == "dots", 1).otherwise(0)
    mid = ~F.col("blurred") & F.coalesce(F.col("n_below") > RARE * F.greatest(other, F.lit(0)), F.lit(False))
    end = F.when(F.col("blurred"), F.lit(BLURRED)).when(F.col("quoted"), F.greatest(end, F.lit(0.9))).otherwise(end)
    rows = rows.withColumn("end", end).withColumn("mid", mid)
    looks_cut = F.col("sure") | F.col("mid") & ~F.col("name") | (F.col("end") < SURE_CUT)
    looks_whole = ~looks_cut & (F.col("end") > SURE_END)
    # a limit shows at one length; with dots after a word the length varies, so the source counts
    rows = rows.withColumn("at", F.when(F.col("kind") == "", F.col("size")).otherwise(F.lit(0)))
    sums = [F.sum(looks_cut.cast("long")).alias("c"), F.sum(looks_whole.cast("long")).alias("e")]
    cells = rows.groupBy("source", "kind", "at").agg(*sums)
    whole = Window.partitionBy("source", "kind")
    rate = (F.sum("c").over(whole) + 0.05) / (F.sum("c").over(whole) + F.sum("e").over(whole) + 1.0)
    cells = cells.withColumn("rate", rate).withColumn("prior", (F.col("c") + 2 * F.col("rate")) / (F.col("c") + F.greatest(F.lit(0.0), F.col("e") - CHANCE * F.col("c")) + 2))
    # a space at the limit is trimmed, so a text may be one shorter than its source's limit
    after = Window.partitionBy("source", "kind").orderBy("at").rangeBetween(1, 1)
    limit = F.when((F.col("kind") == "") & (F.max("c").over(after) >= 4), F.max("prior").over(after))
    cells = cells.withColumn("prior", F.greatest("prior", F.coalesce(limit, F.lit(0.0))))
    rows = rows.join(cells.select("source", "kind", "at", "prior"), ["source", "kind", "at"])

    prior = F.least(F.lit(0.995), F.greatest(F.lit(0.005), F.col("prior")))
    odds = prior / (1 - prior) * ENDS * (1 - F.col("end")) / F.col("end")
    odds = odds * F.when(F.col("mid"), F.when(F.col("name"), MID_NAME).otherwise(MID_WORD)).otherwise(1.0)
    return rows.select("item_id", "source", F.when(F.col("sure"), F.lit(1e6)).otherwise(odds).alias("odds"), "end", "prior", "mid", "kind", "size")


def _texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, folder, "items").select("id", "source_id", "title", "summary").filter(F.col("id").isNotNull())
    once = keyed(items, "id").groupBy("id").agg(F.max(F.struct("summary", source_key().alias("source"))).alias("x"))
    texts = once.select(F.col("id").alias("item_id"), "x.source", F.col("x.summary").alias("text"))
    return texts, items.select(F.col("title").alias("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(*_texts(spark, folder)).filter(F.col("odds") > 1).select("item_id")


def p1_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: summaries, cut summaries and their rate."""
    texts, titles = _texts(spark, folder)
    cut = truncated(texts, titles).filter(F.col("odds") > 1).groupBy("source").agg(F.count("*").alias("n_cut"))
    sizes = texts.groupBy("source").agg(F.sum((F.length("text") > 0).cast("long")).alias("n_summaries"))
    out = sizes.join(cut, "source", "left").withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    return out.select(F.col("source").alias("source_id"), "n_summaries", "n_cut", (F.col("n_cut") / F.when(F.col("n_summaries") > 0, F.col("n_summaries"))).alias("rate"))


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found, "p1_sources": p1_sources}
