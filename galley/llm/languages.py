"""Languages of texts and of the segments of mixed texts, by a linear-chain CRF.

The words of a text are labelled jointly: every word has features (its form, prefixes,
suffixes, character n-grams, the lexicon of the samples, its script and shape), every pair
of neighbours a learned transition, and forward-backward gives each word the probability of
each language. Runs of one language are segments, their confidence is the mean probability
of their words. A segment counts if it has enough words of its own; names and single foreign
words don't make one.

The model is trained in numpy on clean samples of known language and on pairs of samples
joined as headlines join them, from which the transitions are learned. At most MAX_SAMPLES
samples per language are used; scoring covers all rows.

Text is repaired (wrong encodings) and brought to uniform characters before it is read. Where
bytes were lost, the damaged runs stand as words of their own, and a tagger reads them that was
shown the samples with such damage too, so that it learns what that leaves of each language. A null, empty or blank text, and one without letters, has no language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import keyed, spread
from galley.llm.encodings import HYPOTHESES, lost, restore
from galley.llm.unify import LOOKALIKES, mapping
from galley.sources.tables import table

LANGS = ("en", "zh", "de", "fr", "pt", "es")
MAX_SAMPLES = 2_000
EPOCHS, DAMAGE_EPOCHS, RATE, PENALTY, SEED = 120, 50, 0.08, 0.002, 7
#: Joined samples per sample in training, log odds that a delivered label is right, and the
#: log odds by which the words of a segment must speak for its language against its neighbour's.
MIXED, LABEL_PRIOR, MARGIN = 0.4, 2.5, 12.0
#: A segment needs so many words, and so many of them no names; Chinese counts by characters.
MIN_WORDS, MIN_PLAIN, MIN_HAN = 5, 2, 4

#: Codes and names of the languages beside the two-letter ones.
NAMES = {
    "eng": "en", "english": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "chinese": "zh", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "por": "pt", "portuguese": "pt", "português": "pt", "spa": "es", "spanish": "es", "español": "es",
    "中文": "zh", "英文": "en",
}

_TOKEN = re.compile(r"[一-鿿㐀-䶿]+|[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_HAN = re.compile("[一-鿿㐀-䶿]")
#: Runs of characters that are left where bytes were lost; they stand as words of LOST.
_DAMAGE = re.compile(r"(?:[^\x00-\x7f]|\?)*(?:[\ufffd\ue000-\uf8ff\x80-\x9f]|\?\?)(?:[^\x00-\x7f]|\?)*")
LOST = "\ufffd"
#: Ways in which samples are damaged for training: how they are encoded and read.
DAMAGES = (("utf-8", "ascii"), ("utf-8", "gbk"), ("gbk", "utf-8"), ("ascii", "ascii"))


def label_language(label: str | None) -> str | None:
    """The language a delivered label names in any notation; None if it names none.

    Codes of languages outside LANGS are given back as they are, so they compare as wrong.
    """
    if label is None:
        return None
    first = re.split(r"[-_ ]", label.strip().lower())[0]
    if not first.isalpha() or first in ("und", "xx", "na", "unknown", "none", "null", "mul", "zxx", "mis", "qaa", "other", "n", "nan", "undefined"):
        return None
    return NAMES.get(first, first)


@lru_cache(maxsize=1)
def _clean_table() -> dict[int, str]:
    return {ord(k): v for k, v in mapping().items()}


def readable(text: str) -> str:
    """The text repaired and in uniform characters, for reading only."""
    fixed, _ = restore(text, HYPOTHESES)
    fixed = unicodedata.normalize("NFC", fixed.translate(_clean_table()))
    if any(c in LOOKALIKES for c in fixed):
        fixed = re.sub(r"\w+", lambda m: "".join(LOOKALIKES.get(c, c) for c in m.group()) if len(m.group()) > 1 else m.group(), fixed)
    return fixed


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def damaged_tokens(text: str) -> list[str]:
    """The words of a text in which bytes were lost; a damaged run is a word of as many LOST."""
    out, at = [], 0
    for m in _DAMAGE.finditer(text):
        out += [*tokens(text[at : m.start()]), LOST * len(m.group())]
        at = m.end()
    return out + tokens(text[at:])


def words_of(text: str | None) -> tuple[list[str], bool]:
    """(the words of a text as a tagger reads it, whether bytes were lost)."""
    fixed = readable(text) if text else ""
    gone = bool(fixed) and lost(fixed)
    return damaged_tokens(fixed) if gone else tokens(fixed), gone


def damaged(text: str) -> list[str]:
    """What wrong encodings that lose bytes make of a text, where they lose any."""
    out = []
    for real, wrong in DAMAGES:
        raw = text.encode(real, "replace")
        out.append(raw.decode(wrong, "replace"))
    return [t for t in dict.fromkeys(out) if t != text and lost(t)]


def word_features(word: str) -> list[str]:
    """Features of one word; a run of Chinese characters is one word."""
    if _HAN.match(word):
        return ["script=han"]
    if LOST in word:
        return ["shape=lost", f"lost={min(len(word), 12).bit_length()}"]
    low = word.lower()
    shape = "upper" if word.isupper() and len(word) > 1 else "name" if word[0].isupper() else "lower"
    out = ["bias", "shape=" + shape, "w=" + low]
    for n in (1, 2, 3, 4):
        if len(low) > n:
            out += [f"p{n}={low[:n]}", f"s{n}={low[-n:]}"]
    framed = f"<{low}>"
    out += ["g=" + framed[k : k + 3] for k in range(len(framed) - 2)]
    out += ["c=" + c for c in set(low) if not c.isascii()]
    return out


class Tagger:
    """A trained CRF: feature weights, lexicon weights and transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, start: np.ndarray, step: np.ndarray, lexicon: dict[str, np.ndarray]):
        self.index, self.weights, self.start, self.step, self.lexicon = index, weights, start, step, lexicon
        self.for_damage: Tagger = self
        self.cache: dict[str, np.ndarray] = {}

    def state(self) -> list[tuple]:
        """What makes this tagger and the one for damaged text, to be sent to the executors."""
        return [(t.index, t.weights, t.start, t.step, t.lexicon) for t in (self, self.for_damage)]

    @staticmethod
    def of(state: list[tuple]) -> Tagger:
        out, other = (Tagger(*x) for x in state)
        out.for_damage = other
        return out

    def emission(self, word: str) -> np.ndarray:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            at = [k for f in features_with_lexicon(word, self.lexicon) if (k := self.index.get(f)) is not None]
            got = self.cache[word] = self.weights[at].sum(0) if at else np.zeros(len(LANGS), np.float32)
        return got

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the probabilities (words x languages), by forward-backward."""
        out: list[np.ndarray] = [np.zeros((0, len(LANGS)))] * len(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: len(texts[k]))
        for lo in range(0, len(order), 512):
            part = order[lo : lo + 512]
            size = np.array([len(texts[k]) for k in part])
            emit = np.zeros((len(part), size.max(), len(LANGS)), np.float32)
            for row, k in enumerate(part):
                emit[row, : size[row]] = [self.emission(w) for w in texts[k]]
            prob, _ = forward_backward(emit, size, self.start, self.step)
            for row, k in enumerate(part):
                out[k] = prob[row, : size[row]]
        return out


def features_with_lexicon(word: str, lexicon: dict[str, str]) -> list[str]:
    found = lexicon.get(word.lower())
    return word_features(word) + (["lex=" + found] if found else [])


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top


def forward_backward(emit: np.ndarray, size: np.ndarray, start: np.ndarray, step: np.ndarray, pairs: bool = False):
    """(node probabilities, expected transitions) of padded sequences."""
    n, length, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, length):
        alpha[:, t] = _soft(alpha[:, t - 1][:, :, None] + step[None], 1)[:, 0] + emit[:, t]
    for t in range(length - 2, -1, -1):
        nxt = _soft(step[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)[:, :, 0]
        beta[:, t] = np.where((t + 1 < size)[:, None], nxt, 0)
    total = alpha + beta
    prob = np.exp(total - _soft(total, 2))
    expected = np.zeros((k, k))
    if pairs:
        norm = _soft(alpha[np.arange(n), size - 1], 1)
        for t in range(length - 1):
            on = (t + 1 < size)[:, None, None]
            joint = alpha[:, t][:, :, None] + step[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :] - norm[:, :, None]
            expected += np.where(on, np.exp(np.minimum(joint, 0)), 0).sum(0)
    return prob, expected


def train(samples: list[tuple[str, str]]) -> Tagger:
    """A tagger from (language, text) pairs, with one for damaged text; deterministic."""
    out = _train(samples, False)
    out.for_damage = _train(samples, True)
    return out


def _train(samples: list[tuple[str, str]], with_damage: bool) -> Tagger:
    rng = np.random.default_rng(SEED)
    texts = [(lang, tokens(readable(text))) for lang, text in sorted(samples) if lang in LANGS]
    texts = [(lang, words) for lang, words in texts if words]
    seen: dict[str, set[str]] = {}
    for lang, words in texts:
        for w in words:
            seen.setdefault(w.lower(), set()).add(lang)
    lexicon = {w: next(iter(langs)) for w, langs in seen.items() if len(langs) == 1}

    sequences = [(words, [LANGS.index(lang)] * len(words)) for lang, words in texts]
    for lang, text in sorted(samples):
        if with_damage and lang in LANGS:
            sequences += [(words, [LANGS.index(lang)] * len(words)) for t in damaged(text) if (words := words_of(t)[0])]
    for _ in range(int(MIXED * len(texts))):  # headlines in two languages
        (la, a), (lb, b) = (texts[k] for k in rng.integers(0, len(texts), 2))
        sequences.append((a + b, [LANGS.index(la)] * len(a) + [LANGS.index(lb)] * len(b)))
        if rng.random() < 0.3:  # a foreign quotation inside
            cut = int(rng.integers(0, len(a) + 1))
            sequences.append((a[:cut] + b + a[cut:], [LANGS.index(la)] * cut + [LANGS.index(lb)] * len(b) + [LANGS.index(la)] * (len(a) - cut)))

    index: dict[str, int] = {}
    rows, cols, at = [], [], 0
    size = np.array([len(words) for words, _ in sequences])
    length = size.max()
    gold = np.zeros((len(sequences), length, len(LANGS)), np.float32)
    where = np.full((len(sequences), length), -1)
    known: dict[str, list[int]] = {}
    for s, (words, labels) in enumerate(sequences):
        for t, (w, y) in enumerate(zip(words, labels)):
            got = known.get(w)
            if got is None:
                # the lexicon must not be all the model learns: half of the words go without
                names = features_with_lexicon(w, lexicon if rng.random() < 0.5 else {})
                got = known[w] = [index.setdefault(f, len(index)) for f in names]
            rows += [at] * len(got)
            cols += got
            gold[s, t, y] = 1
            where[s, t] = at
            at += 1
    for lang in LANGS:
        index.setdefault("lex=" + lang, len(index))
    rows, cols = np.array(rows), np.array(cols)
    on = where >= 0
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    weights = np.zeros((len(index), len(LANGS)), np.float32)
    start, step = np.zeros(len(LANGS), np.float32), np.zeros((len(LANGS), len(LANGS)), np.float32)
    moments = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    first = gold[:, 0].sum(0)
    moves = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
    for t in range(1, (DAMAGE_EPOCHS if with_damage else EPOCHS) + 1):
        flat = np.add.reduceat(weights[cols], starts, axis=0)
        emit = np.zeros_like(gold)
        emit[on] = flat[where[on]]
        prob, expected = forward_backward(emit, size, start, step, pairs=True)
        delta = ((prob - gold)[on]).astype(np.float32)
        share = delta[np.argsort(where[on])][rows] / len(sequences)
        grad = np.stack([np.bincount(cols, share[:, k], len(index)) for k in range(len(LANGS))], 1).astype(np.float32)
        adam("w", weights, grad + PENALTY / len(sequences) * weights * 10, t)
        adam("s", start, ((prob[:, 0].sum(0) - first) / len(sequences)).astype(np.float32), t)
        adam("t", step, ((expected - moves) / len(sequences)).astype(np.float32), t)
    return Tagger(index, weights, start, step, lexicon)


def segments(words: list[str], prob: np.ndarray, emit: np.ndarray, label: str | None = None) -> list[tuple[str, int, int, float]]:
    """(language, first word, end, confidence) of the segments that count, in order.

    `label` is the delivered language; it tips the scales for a text that says little.
    """
    if not words:
        return []
    prior = np.array([LABEL_PRIOR if lang == label else 0.0 for lang in LANGS])
    whole = emit.sum(0) + prior
    main = int(whole.argmax())
    runs: list[list] = []
    for k, y in enumerate(prob.argmax(1)):
        if runs and runs[-1][0] == y:
            runs[-1][2] = k + 1
        else:
            runs.append([int(y), k, k + 1])

    def counts(run: list) -> bool:
        y, a, b = run
        if LANGS[y] == "zh":
            return sum(len(w) for w in words[a:b] if _HAN.match(w) or LOST in w) >= MIN_HAN
        return b - a >= MIN_WORDS and sum(words[k][0].islower() and prob[k, y] > 0.7 for k in range(a, b)) >= MIN_PLAIN

    def margin(run: list, other: int) -> float:
        y, a, b = run
        return float((emit[a:b, y] - emit[a:b, other]).sum())

    kept = [r for r in runs if counts(r)]
    # runs that could as well be the language of their neighbours are taken into it
    solid = [r for r in kept if LANGS[r[0]] == "zh" or all(margin(r, o[0]) >= MARGIN for o in kept if o[0] != r[0])]
    if len({r[0] for r in solid}) < 2:
        sure = np.exp(whole - whole.max())
        return [(LANGS[main], 0, len(words), float(sure[main] / sure.sum()))] if not solid else [(LANGS[solid[0][0]], 0, len(words), float(max(prob[a:b, y].mean() for y, a, b in solid)))]
    out: list[list] = []
    for y, a, b in solid:
        sure = float(prob[a:b, y].mean())
        if out and out[-1][0] == LANGS[y]:
            out[-1][2:] = [b, max(out[-1][3], sure)]
        else:
            out.append([LANGS[y], a, b, sure])
    for k in range(1, len(out)):  # words between two segments go with the earlier one
        out[k - 1][2] = out[k][1]
    out[0][1], out[-1][2] = 0, len(words)
    return [tuple(x) for x in out]


def languages_of(tagger: Tagger, texts: list[str | None], labels: list[str | None] | None = None) -> list[list[tuple[str, int, int, float]]]:
    """The segments of each text."""
    read = [words_of(t) for t in texts]
    named = labels or [None] * len(texts)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for model, which in ((tagger, False), (tagger.for_damage, True)):
        at = [k for k, (_, gone) in enumerate(read) if gone == which]
        for k, p in zip(at, model.marginals([read[k][0] for k in at])):
            words = read[k][0]
            emit = np.array([model.emission(x) for x in words]) if words else np.zeros((0, len(LANGS)))
            out[k] = segments(words, p, emit, named[k])
    return out


def tagger_for(samples: DataFrame) -> Tagger:
    """A tagger trained on at most MAX_SAMPLES rows of (lang, text) per language."""
    rows = samples.filter(F.col("lang").isin(*LANGS) & (F.length("text") > 0)).select("lang", "text")
    picked = []
    for lang in LANGS:
        picked += [(r["lang"], r["text"]) for r in rows.filter(F.col("lang") == lang).orderBy(F.xxhash64("text")).limit(MAX_SAMPLES).collect()]
    return train(picked)


def tag(texts: DataFrame, tagger: Tagger, key: str, text: str, label: str) -> DataFrame:
    """(key, segment, lang, confidence, words, first, differs): the segments of each text, numbered from 1.

    `first` marks the first segment of its language; `differs` tells whether the label names no
    language of the text, or the text has several.
    """
    shared = texts.sparkSession.sparkContext.broadcast(tagger.state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Tagger.of(shared.value)
        for b in batches:
            out = []
            named_all = [label_language(x) for x in b["label"]]
            for k, named, segs in zip(b["key"], named_all, languages_of(model, list(b["text"]), named_all)):
                langs = list(dict.fromkeys(s[0] for s in segs))
                differs, met = named not in langs or len(langs) > 1, set()
                for n, (lang, s, e, conf) in enumerate(segs, 1):
                    out.append((k, n, lang, conf, e - s, lang not in met, differs))
                    met.add(lang)
            yield pd.DataFrame(out, columns=["key", "segment", "lang", "confidence", "words", "first", "differs"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).filter(F.length("text") > 0)
    return spread(rows).mapInPandas(run, "key string, segment int, lang string, confidence double, words int, first boolean, differs boolean")


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items").filter(F.col("id").isNotNull())
    return keyed(items.select("id", "title", "lang"), "id").groupBy("id").agg(F.max(F.struct("title", "lang")).alias("x")).select("id", "x.title", F.col("x.lang").alias("label"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return tag(_titles(spark, folder), tagger_for(table(spark, folder, "lang_samples")), "id", "title", "label")


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, segment, lang, confidence) of every title, mixed or not."""
    return _segments(spark, folder).select(F.col("key").alias("item_id"), "segment", "lang", F.round("confidence", 4).alias("confidence"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).filter("differs and first").select(F.col("key").alias("item_id"), "lang")


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_segments": p4_segments}
