"""Abusive, hateful and sexually explicit language, scored by subword-bag embeddings.

Every document is cut into lines and sentences. A unit is the average of the embeddings of
its words and their character n-grams (of Chinese text the 1- to 3-grams of characters), fed
to a linear softmax; embeddings and softmax are trained jointly in numpy. Misspelt and
disguised words share most n-grams with the plain ones; spaced-out letters, digits for
letters, look-alikes and invisible characters are undone first. As an offence may follow other
text without a stop, overlapping stretches of long units are scored as well, from running sums
of the same word vectors.

Labels are given to whole documents while one line makes the offence, and some labels are
wrong. So the offending units are found in rounds: first those whose features mark labelled
documents, then those that the model trained so far scores highest. Documents whose label
no unit bears out are left out of the next round, as are units of clean documents that the
model is sure about.

The training set is bounded: at most MAX_DOCS labelled documents of each offensive label and
MAX_CLEAN clean ones, picked by a hash, with all their units. Scoring covers all documents and
whole texts. Null, empty and blank texts score 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import spread
from galley.llm.unify import LOOKALIKES, UNCOMMON, mapping
from galley.sources.tables import table

LABELS = ("ok", "abusive", "hateful", "sexual")
MAX_DOCS, MAX_CLEAN = 1_000, 5_000
BUCKETS, DIMS, ROUNDS, BATCH, RATE, SEED = 1 << 17, 16, 3, 512, 0.25, 11
#: Passes over the training rows in the rounds that look for the offending units, and in the last one.
EPOCHS, LAST_EPOCHS = 4, 8
THRESHOLD = 0.5
#: Score from which a document counts as offensive; a stretch of a long unit must be surer.
FOUND, SURE = 0.25, 0.6
#: A unit of more words (Chinese: more n-grams) is also scored in overlapping stretches of so many.
LONG, STRETCH = (16, 72), (10, 42)
#: Words scored at once in a task.
AT_ONCE = 50_000
#: Log odds of an offending unit in labelled documents, at this quantile of its words and word pairs.
MARKED, PART = 2.0, 0.6

_USER = re.compile(r"^\s*(?:[>|*#-]+\s+)?(?:\[[^\[\]]{2,24}\]|[^\s:：]{2,24}\s?[:：])\s*")
_CUT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n")
_WORD = re.compile(r"[一-鿿]+|[^\W\d_一-鿿]+|\d+")
_HAN = re.compile("[一-鿿]")
_SPACED = re.compile(r"\b(?:[^\W_][ .*_·\-]){2,}[^\W_]\b")
_HAN_SPACED = re.compile(r"(?<=[一-鿿])(?:[^\S\n]|[.*_·\-|~+])+(?=[一-鿿])")
_SPECIAL = re.compile(r"[^\W\d_][0-9@$!|*]|[0-9@$!|*][^\W\d_]")
_UNUSUAL = re.compile(UNCOMMON)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "!": "i", "|": "l"})
_MIXED = re.compile(r"(?=\S*[^\W\d_])(?=\S*[0-9@$!|*])[^\W_一-鿿][^\s一-鿿]*[^\W_一-鿿]|[@$][^\W_一-鿿]+")
_CLEAN = {ord(k): v for k, v in mapping().items()} | {ord(k): v for k, v in LOOKALIKES.items()}


def undisguised(text: str) -> str:
    """The text with spaced-out, digit-for-letter and look-alike spellings undone; lines stay lines."""
    out = text
    if _UNUSUAL.search(out):
        out = unicodedata.normalize("NFC", out.translate(_CLEAN))
    out = out.lower()
    if not out.isascii():
        out = _HAN_SPACED.sub("", out)
    out = _SPACED.sub(lambda m: re.sub(r"[ .*_·\-]", "", m.group()), out)
    if _SPECIAL.search(out):
        # only words with such a sign beside a letter need the closer look
        out = "\n".join(
            " ".join(_MIXED.sub(lambda m: m.group().translate(_LEET).replace("*", ""), w) if _SPECIAL.search(w) else w for w in line.split(" ")) if _SPECIAL.search(line) else line
            for line in out.split("\n")
        )
    return re.sub(r"([^\W\d_])\1{2,}", r"\1", out)


def units(text: str | None) -> list[str]:
    """The lines and sentences of a text, without the names of the writers in front."""
    return [u for line in _CUT.split(text or "") if (u := _USER.sub("", line).strip())]


def _words(plain: str) -> list[str]:
    found = _WORD.findall(plain)
    if plain.isascii():
        return ["#" if w[0] <= "9" else w for w in found]
    out: list[str] = []
    for w in found:
        first = w[0]
        if "一" <= first <= "鿿":
            framed = f"<{w}>"
            for k in range(len(w)):
                three = framed[k : k + 3]
                out += (three[0], three[:2], three)
            out += (framed[-2], framed[-2:], framed[-1])
        else:
            out.append("#" if first.isdigit() else w)
    return out


def words(unit: str) -> list[str]:
    return _words(undisguised(unit))


def unit_words(text: str | None) -> list[list[str]]:
    """The words of each unit of a text that has any; disguises are undone in all units at once."""
    us = units(text)
    return [w for line in undisguised("\n".join(us)).split("\n") if (w := _words(line))] if us else []


def grams(word: str) -> list[int]:
    """The buckets of a word and of its character n-grams."""
    if word == "#" or _HAN.search(word):
        return [zlib.crc32(word.encode()) % BUCKETS]
    framed = f"<{word}>"
    parts = [framed] + [framed[k : k + n] for n in (3, 4, 5) for k in range(len(framed) - n + 1)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def phrases(ws: list[str]) -> list[str]:
    """The words of a unit and pairs of neighbours; of Chinese text the longer n-grams."""
    long = [w for w in ws if len(w) > 1 and _HAN.search(w)]
    if len(long) * 2 > len(ws):
        return long
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


class Model:
    """Embeddings and softmax; scoring keeps what the summed vectors of the words it has met give for each label.

    The softmax is linear, so the labels' sums of a unit's words over the number of its n-grams are those of its mean vector.
    """

    def __init__(self, table_: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.table, self.out, self.bias = table_, out, bias
        self.known: dict[str, int] = {}
        self.sums = np.zeros((1024, len(LABELS) + 1), np.float32)
        self.han = np.zeros(1024, np.uint8)

    def _row(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = self.known[word] = len(self.known)
            if at >= len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.han = np.concatenate([self.han, np.zeros_like(self.han)])
            ids = grams(word)
            self.sums[at, :-1] = self.table[ids].sum(0) @ self.out
            self.sums[at, -1] = len(ids)
            self.han[at] = _HAN.search(word) is not None
        return at

    def _softmax(self, sums: np.ndarray) -> np.ndarray:
        z = sums[:, :-1] / sums[:, -1:] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the words of all units, place of each unit's end)."""
        if len(self.known) > 350_000:
            self.known.clear()
        known, flat, ends = self.known, [], []
        for ws in texts:
            flat += [k if (k := known.get(w)) is not None else self._row(w) for w in ws]
            ends.append(len(flat))
        return np.array(flat, np.int64), np.array(ends, np.int64)

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """(units x labels) probabilities of units given as words, none of them empty."""
        if not texts:
            return np.zeros((0, len(LABELS)), np.float32)
        flat, ends = self.rows(texts)
        return self._softmax(np.add.reduceat(self.sums[flat], np.r_[0, ends[:-1]], axis=0))

    def worst(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each unit the highest score of it and its stretches, and the label of that one."""
        flat, ends = self.rows(texts)
        begins = np.r_[0, ends[:-1]]
        n = ends - begins
        han = (np.add.reduceat(self.han[flat], begins, dtype=np.int64) * 2 > n).astype(int)
        # a long unit is summed in half stretches: two of them that follow each other are a stretch
        half = np.array(STRETCH)[han] // 2
        blocks = np.where(n > np.array(LONG)[han], -(-n // half), 1)
        first = np.cumsum(blocks) - blocks
        own = np.repeat(np.arange(len(n)), blocks)
        within = np.arange(len(own)) - first[own]
        sums = np.add.reduceat(self.sums[flat], begins[own] + half[own] * within, axis=0)
        paired = np.flatnonzero(within < blocks[own] - 1)
        p = self._softmax(np.concatenate([np.add.reduceat(sums, first, axis=0), sums[paired] + sums[paired + 1]]))
        own = np.r_[np.arange(len(n)), own[paired]]
        worst = 1 - p[:, 0]
        worst[len(n) :][worst[len(n) :] < SURE] = 0
        order = np.lexsort((worst, own))
        at = order[np.flatnonzero(np.r_[own[order][1:] != own[order][:-1], True])]
        return worst[at], p[at, 1:].argmax(1) + 1


class Bags:
    """Units of words as numbers, with the n-grams of every word."""

    def __init__(self, docs: list[list[list[str]]]):
        index: dict[str, int] = {}
        self.units = [[np.array([index.setdefault(w, len(index)) for w in u], np.int64) for u in us] for us in docs]
        parts = [grams(w) for w in index]
        self.n_grams = np.array([len(g) for g in parts])
        self.gram, self.gram_end = np.concatenate([np.array(g, np.int64) for g in parts]), np.cumsum(self.n_grams)


def fit(bags: Bags, rows: list[tuple[int, int, int]], rng: np.random.Generator, epochs: int) -> Model:
    """Trains on (document, unit, label) by AdaGrad; rare labels weigh more."""
    each = [bags.units[k][j] for k, j, _ in rows]
    flat, size = np.concatenate(each), np.array([len(ws) for ws in each])
    ends = np.cumsum(size)
    gram, gram_end, n_grams = bags.gram, bags.gram_end, bags.n_grams
    label = np.array([y for _, _, y in rows])
    count = np.bincount(label, minlength=len(LABELS))
    weight = np.sqrt(count.max() / np.maximum(count, 1))[label].astype(np.float32)
    emb = ((rng.random((BUCKETS, DIMS)) - 0.5) / DIMS).astype(np.float32)
    out, bias = np.zeros((DIMS, len(LABELS)), np.float32), np.zeros(len(LABELS), np.float32)
    ge, go, gb = np.full(BUCKETS, 1e-4, np.float32), np.full_like(out, 1e-4), np.full_like(bias, 1e-4)
    gold = np.eye(len(LABELS), dtype=np.float32)[label]

    def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            n = size[part]
            # vectors of the words of the batch, each once, from those of their n-grams
            met, inverse = np.unique(flat[ranges(ends[part] - n, n)], return_inverse=True)
            m = n_grams[met]
            ids = gram[ranges(gram_end[met] - m, m)]
            of_word = np.add.reduceat(emb[ids], np.r_[0, np.cumsum(m)[:-1]], axis=0)
            starts = np.r_[0, np.cumsum(n)[:-1]]
            total = np.add.reduceat(m[inverse], starts)
            mean = np.add.reduceat(of_word[inverse], starts, axis=0) / total[:, None]
            z = mean @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            delta = (z / z.sum(1, keepdims=True) - gold[part]) * weight[part][:, None] / len(part)
            back = np.repeat((delta @ out.T) / total[:, None], n, axis=0)
            d_out, d_bias = mean.T @ delta, delta.sum(0)
            go += d_out**2
            gb += d_bias**2
            out -= RATE * d_out / np.sqrt(go)
            bias -= RATE * d_bias / np.sqrt(gb)
            # gradients of repeated words, then of repeated buckets, are summed before the step
            by_word = np.stack([np.bincount(inverse, back[:, d], len(met)) for d in range(DIMS)], 1)
            uniq, place = np.unique(ids, return_inverse=True)
            spreaded = np.repeat(by_word, m, axis=0)
            grad = np.stack([np.bincount(place, spreaded[:, d], len(uniq)) for d in range(DIMS)], 1).astype(np.float32)
            ge[uniq] += (grad**2).mean(1)
            emb[uniq] -= RATE * grad / np.sqrt(ge[uniq])[:, None]
    return Model(emb, out, bias)


def train(labelled: list[tuple[str, list[str]]]) -> Model | None:
    """A model from (text, labels of its annotators); None if there is nothing to learn from."""
    docs: list[tuple[int, list[list[str]]]] = []
    for text, labels in sorted((t or "", sorted(x)) for t, x in labelled):
        votes = Counter(LABELS.index(x) for x in labels if x in LABELS)
        if not votes:
            continue
        top = votes.most_common()
        if len(top) > 1 and top[0][1] == top[1][1] and 0 in votes:
            continue  # annotators disagree on whether there is an offence
        if us := unit_words(text):
            docs.append((top[0][0], us))
    bad = [k for k, (y, _) in enumerate(docs) if y]
    if not bad or len(bad) == len(docs):
        return None

    # features by the share of offensive and of clean documents that have them
    pos, neg = Counter(), Counter()
    for y, us in docs:
        (pos if y else neg).update({w for u in us for w in phrases(u)})
    n_pos, n_neg = len(bad), len(docs) - len(bad)

    def odds(u: list[str]) -> float:
        # what one document alone has may be a name: it counts for less
        got = [np.log((max(pos[w] - 0.5, 0) + 0.1) / n_pos) - np.log((neg[w] + 0.5) / n_neg) for w in phrases(u)]
        return float(np.quantile(got, PART))

    # wording that clean documents have as well is no offence: such labels are taken as wrong
    marked = {k: [odds(u) for u in docs[k][1]] for k in bad}
    chosen = {k: [int(np.argmax(marked[k]))] for k in bad if max(marked[k]) >= MARKED}
    skip: set[tuple[int, int]] = set()
    bags = Bags([us for _, us in docs])
    model = None
    for turn in range(ROUNDS):
        rows = []
        for k, (y, us) in enumerate(docs):
            if y and k not in chosen:
                continue
            for j in range(len(us)):
                if (k, j) not in skip:
                    rows.append((k, j, y if y and j in chosen[k] else 0))
        model = fit(bags, rows, np.random.default_rng(SEED + turn), LAST_EPOCHS if turn == ROUNDS - 1 else EPOCHS)
        if turn == ROUNDS - 1:
            break
        chosen, skip = {}, set()
        scores = np.split(1 - model.score([u for _, us in docs for u in us])[:, 0], np.cumsum([len(us) for _, us in docs])[:-1])
        for k, (y, us) in enumerate(docs):
            p = scores[k]
            if y:
                able = [j for j in range(len(us)) if marked[k][j] >= MARKED]
                picked = [j for j in able if p[j] > THRESHOLD] or [j for j in able if p[j] == max(p[able]) > 0.2]
                if picked:
                    chosen[k] = picked
                skip |= {(k, j) for j in able if j not in picked and p[j] > 0.3}
            else:
                # only wording that isn't common in clean text can be an offence that has no label
                skip |= {(k, j) for j in range(len(us)) if p[j] > 0.8 and odds(us[j]) >= MARKED}
        if not chosen:
            break
    return model


def training_rows(documents: DataFrame, labels: DataFrame) -> list[tuple[str, list[str]]]:
    """At most MAX_DOCS labelled documents of each offence and MAX_CLEAN clean ones, with all their labels."""
    voted = labels.filter(F.col("label").isin(*LABELS)).groupBy("doc_id").agg(F.collect_list("label").alias("labels"))
    # a document counts for its most frequent label; of ties for one that is no "ok"
    picked = voted.withColumn("kind", F.array_max(F.transform(F.array(*[F.lit(x) for x in LABELS]), lambda x: F.struct(F.size(F.filter("labels", lambda y: y == x)).alias("n"), (x != "ok").alias("bad"), x.alias("label"))))["label"])
    parts = [picked.filter(F.col("kind") == k).orderBy(F.xxhash64("doc_id")).limit(MAX_CLEAN if k == "ok" else MAX_DOCS) for k in LABELS]
    chosen = reduce(DataFrame.unionByName, parts).select("doc_id", "labels")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return [(r["text"], r["labels"]) for r in texts.select("text", "labels").collect()]


def _worst(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the highest score of its units and stretches, and the label of that one."""
    best, kind = np.zeros(len(texts)), np.zeros(len(texts), int)
    flat: list[list[str]] = []
    owner: list[int] = []

    def flush() -> None:
        if flat:
            own = np.array(owner)
            p, label = model.worst(flat)
            order = np.lexsort((p, own))
            at = order[np.flatnonzero(np.r_[own[order][1:] != own[order][:-1], True])]
            at = at[p[at] > best[own[at]]]
            best[own[at]], kind[own[at]] = p[at], label[at]
            flat.clear(), owner.clear()

    n = 0
    for k, t in enumerate(texts):
        for w in unit_words(t) if model else ():
            flat.append(w)
            owner.append(k)
            n += len(w)
            if n > AT_ONCE:
                flush()
                n = 0
    flush()
    return best, kind


_LOADED: list = [None, None]


def _loaded(value: tuple) -> Model:
    """The model of a broadcast value; the tasks of a worker share it, and the words it has met."""
    if _LOADED[0] is not value:
        _LOADED[:] = [value, Model(*value)]
    return _LOADED[1]


def score(documents: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, label): the highest probability of an offence in any unit, and its kind."""
    shared = documents.sparkSession.sparkContext.broadcast((model.table, model.out, model.bias) if model else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _loaded(shared.value) if shared.value else None
        for b in batches:
            best, kind = _worst(m, list(b["text"]))
            label = [LABELS[k] if s >= FOUND else "ok" for k, s in zip(kind, best)]
            yield pd.DataFrame({"key": b["key"], "score": best, "label": label})

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows).mapInPandas(run, f"key {kind}, score double, label string").withColumnRenamed("key", key)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return score(documents.select("doc_id", "text"), train(training_rows(documents, table(spark, folder, "doc_labels"))))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).filter(F.col("score") >= FOUND).select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, score, label) of every document."""
    return _scored(spark, folder).withColumn("score", F.round("score", 4))


def p10_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of offensive documents per source."""
    documents = table(spark, folder, "documents")
    model = train(training_rows(documents, table(spark, folder, "doc_labels")))
    source = F.coalesce("source", F.lit(""))
    scored = score(documents.select(F.struct("doc_id", source.alias("source")).alias("doc"), "text"), model, key="doc")
    return scored.groupBy(F.col("doc.source").alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum((F.col("score") >= FOUND).cast("long")).alias("n_offensive"), F.avg((F.col("score") >= FOUND).cast("double")).alias("rate")
    )


SQL: dict[str, str] = {}
QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources}
