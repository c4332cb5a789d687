"""Records spoilt by a wrong character encoding: finding them and restoring the text.

1. Twins. Text is a row of ASCII stretches with runs of other characters between them. The key
   of a run is what stands around it, stripped of all but ASCII letters and digits: the last
   SIDE before it and the first SIDE behind it, so garbled and clean twins have the same keys.
2. Inference. The run of a doubtful text, read back by a hypothesis "these bytes are X, read as
   Y", must be the clean run of another text at the same key: that aligns the two character by
   character. The hypotheses that explain runs are the learned transformations, with the number
   of different keys as support. Marks of lost bytes (question marks between letters) are
   learned in the same way: clean twins have another character there.
3. Application. Only what was learned is applied to the doubtful records, best supported first:
   a stretch counts as garbled if its bytes under Y form valid text in X with characters that
   occur in such texts. A transformation without a twin is used only if the collection bears it
   out by the redundancy of UTF-8: LONG_STRETCH sequences in a row that fit it and no other one
   fits better. Replacement characters, private and control ones are no text in any encoding and
   need no twin. `learned` gives the support of either way.

Joins are on hashes of (key, restored run), so a key seen in a third of all texts costs one row
a task and gives no pairs. Nulls and empty texts are never cases. A lone replacement character
at the very end is the mark of a cut text, not of a wrong encoding. Whole texts are scanned,
however long.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import spread
from galley.session import materialize
from galley.sources.tables import table

#: Hypotheses (encoding of the bytes, encoding they were read in).
HYPOTHESES = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "gbk"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp850"),
    ("utf-8", "cp1251"), ("utf-8", "cp1250"), ("utf-8", "koi8_r"), ("utf-8", "cp1254"), ("gbk", "latin-1"), ("gbk", "cp1252"),
    ("gbk", "mac_roman"), ("gbk", "cp437"),
)
#: ASCII letters and digits on each side of a run that make its key, and those it must have in all.
SIDE, KEY_LENGTH = 6, 6
#: Different keys at which twins must bear a transformation out; sequences in a row that do so without a twin.
SUPPORT, LONG_STRETCH = 1, 4
#: Different runs that a task keeps before it hands them on.
FLUSH = 200_000

# UTF-8 sequences of characters that such texts hold: Latin letters and signs, typographic
# marks, currency, Chinese characters and punctuation.
_TWO = rb"\xc2[\xa0-\xbf]|\xc6\x92|\xcb[\x86\x9c]|\xc3[\x80-\xbf]|\xce[\x94\xb1-\xbf]|\xc5[\x92\x93\xa0\xa1\xb8\xbd\xbe]"
_THREE = rb"\xe2\x80[\x8b-\xaf\xb0-\xba]|\xe2\x82\xac|\xe2\x84[\x80-\xbf]|\xe2[\x91\x96\x97][\x80-\xbf]|\xe3\x80[\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xbc\xbd][\x80-\xbf]"
_UTF8 = re.compile(rb"(?:" + _TWO + rb"|" + _THREE + rb")+")
_UTF8_HAN = re.compile(rb"(?:(?:" + _THREE + rb")[0-9]*){3,}")
_GBK = re.compile(rb"(?:[\xb0-\xf7][\xa1-\xfe]|[\xa1-\xa3][\xa1-\xfe]){2,}")
_HAN = re.compile("[一-鿿]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
#: Characters that make a text worth a look beside Chinese ones.
DOUBTFUL = "[^\\x00-\\x7f -ÿŒœ‐-…€　-〿一-鿿＀-￯]|[ÂÃâ¡-ÿ][\u0080-¿Ā-˿‐-™]|[\u0080-ÿ]{3}|\\?\\?|[A-Za-z]\\?[A-Za-z]|[\u0080-\u009f]"
#: Marks of lost bytes: those that are no text anywhere, and question marks where a character should be.
MARKS = {
    "replaced": re.compile("[\ufffd\ue000-\uf8ff\u0080-\u009f]"),
    "question": re.compile("[0-9A-Za-zÀ-ɏ一-鿿]\\?[A-Za-zÀ-ɏ一-鿿]|\\?{4,}|\\?{2,}[0-9一-鿿]|[一-鿿]\\?{2,}[0-9一-鿿]"),
}
_RUN = re.compile("(?:[^\x00-\x7f]|\\?)+")
_STRIP = re.compile("[^A-Za-z0-9]+")
_ODD = re.compile(DOUBTFUL)
_BROKEN = re.compile("[^\\x00-\\x7f\\u4e00-\\u9fff]*[\\ufffd\\ue000-\\uf8ff\\x80-\\x9f][^\\x00-\\x7f]*")


@lru_cache(maxsize=32)
def _bytes_of(wrong: str) -> dict[str, int]:
    """Character to byte for a one-byte encoding; undefined bytes stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(wrong)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    for b in range(128, 160):  # lenient readers pass such bytes through
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=32)
def _runs_of(wrong: str) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in _bytes_of(wrong)) + "]{2,}")


def _one_byte(text: str, real: str, wrong: str) -> list[tuple[int, int, str]]:
    table_, spans = _bytes_of(wrong), []
    for run in _runs_of(wrong).finditer(text):
        raw = bytes([table_[c] for c in run.group()])
        if real == "utf-8":
            for m in _UTF8.finditer(raw):
                spans.append((run.start() + m.start(), run.start() + m.end(), m.group().decode("utf-8")))
        else:
            for m in _GBK.finditer(raw):
                spans.append((run.start() + m.start(), run.start() + m.end(), m.group().decode("gbk", "replace")))
    return spans


def _as_gbk(text: str) -> list[tuple[int, int, str]]:
    """Stretches of UTF-8 that was read as GBK. Chinese text needs three characters in a row."""
    whole = text.encode("gbk", "replace")
    chinese = _UTF8_HAN.search(whole) is not None
    if not chinese and len(_LATIN.findall(text)) <= len(_HAN.findall(text)):
        return []
    starts = []
    for k, c in enumerate(text):
        starts += [k] * (1 if c < "\x80" else len(c.encode("gbk", "replace")))
    found = []
    if chinese:
        for m in _UTF8_HAN.finditer(whole):
            found.append((starts[m.start()], starts[m.end() - 1] + 1, m.group().decode("utf-8", "replace")))
    else:
        # in Latin text one or two odd characters between letters are enough
        for m in _UTF8.finditer(whole):
            s, e = starts[m.start()], starts[m.end() - 1] + 1
            around = text[max(0, s - 1) : s] + text[e : e + 1]
            if e - s <= 3 and not _HAN.search(around):
                found.append((s, e, m.group().decode("utf-8", "replace")))
    return found


def spans(text: str, order: tuple[tuple[str, str], ...] = HYPOTHESES) -> list[tuple[int, int, str, str]]:
    """The garbled stretches that a transformation explains: (start, end, restored, name).

    Of the hypotheses the one that explains most characters is taken, an earlier one on ties.
    """
    best: list[tuple[int, int, str, str]] = []
    most = 0
    han = _HAN.search(text) is not None
    for real, wrong in order:
        if wrong == "gbk":
            if not han:
                continue
            found = _as_gbk(text)
        else:
            found = _one_byte(text, real, wrong)
        n = sum(e - s for s, e, _ in found)
        if n > most:
            most, best = n, [(s, e, r, f"{real}/{wrong}") for s, e, r in found]
    return best


def lost(text: str, marks: tuple[str, ...] = tuple(MARKS)) -> bool:
    """Whether bytes of the text were lost in a wrong encoding, by marks of these kinds."""
    # 鈥 is what the first bytes of a typographic mark become in GBK; its last byte is lost there
    cut = text.endswith("�") and text.count("�") == 1 and not text.endswith("鈥�")
    body = text[:-1] if cut else text
    return any(MARKS[m].search(body) for m in marks)


def restore(text: str, order: tuple[tuple[str, str], ...] = HYPOTHESES) -> tuple[str, str]:
    """(text with its explained stretches restored, names of the transformations used).

    Text may have gone through wrong encodings several times; every step takes bytes away.
    """
    names = []
    while found := spans(text, order):
        out, at = [], 0
        for s, e, r, name in found:
            out += [text[at:s], r]
            at = e
        new = "".join([*out, text[at:]])
        if len(new.encode()) >= len(text.encode()):
            break
        text = new
        names.append(found[0][3])
    return text, " ".join(names)


def garbled_mask(text: str) -> str:
    """The text with garbled stretches replaced by spaces, for tests of what is left."""
    chars = list(text)
    for s, e, _, _ in spans(text):
        chars[s:e] = " " * (e - s)
    # other characters of a run in which bytes were lost are damage too
    return _BROKEN.sub(" ", "".join(chars))


def is_garbled(text: str | None, order: tuple[tuple[str, str], ...] = HYPOTHESES) -> bool:
    return bool(text) and (lost(text) or bool(spans(text, order)))


def fields(items: DataFrame) -> DataFrame:
    """(item_id, field, text): the titles and summaries of all items."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "summary")])
    rows = items.filter(F.col("id").isNotNull()).select(F.col("id").alias("item_id"), F.explode(pairs).alias("x")).select("item_id", "x.*")
    return rows.filter(F.length("text") > 0)


def keyed_runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, key) of the runs of other than ASCII characters; the key is '' where little stands around."""
    at = [(m.start(), m.end()) for m in _RUN.finditer(text)]
    ends = [0, *[e for _, e in at]]
    parts = [_STRIP.sub("", text[b:e]).lower() for b, e in zip(ends, [*[s for s, _ in at], len(text)])]
    out, left = [], ""
    for k, (s, e) in enumerate(at):
        left = (left + parts[k])[-SIDE:]
        right, j = parts[k + 1], k + 2
        while len(right) < SIDE and j < len(parts):
            right += parts[j]
            j += 1
        right = right[:SIDE]
        out.append((s, e, f"{left}|{right}" if len(left) + len(right) >= KEY_LENGTH else ""))
    return out


def read_back(run: str, real: str, wrong: str) -> str | None:
    """The run before the transformation, if all of it fits."""
    if wrong == "gbk":
        try:
            return run.encode("gbk").decode("utf-8")
        except UnicodeError:
            return None
    table_ = _bytes_of(wrong)
    if not all(c in table_ for c in run):
        return None
    raw = bytes(table_[c] for c in run)
    if not (_UTF8 if real == "utf-8" else _GBK).fullmatch(raw):
        return None
    try:
        return raw.decode(real)
    except UnicodeError:
        return None


def origins(run: str) -> list[tuple[str, str]]:
    """(what the run may have been, names of the transformations that lead there), several steps included."""
    out, todo = [], [(run, "")]
    while todo:
        now, names = todo.pop()
        for real, wrong in HYPOTHESES:
            y = read_back(now, real, wrong)
            if y and len(y.encode()) < len(now.encode()):
                out.append((y, f"{names} {real}/{wrong}".strip()))
                todo.append(out[-1])
    return out


_EVIDENCE = "kind string, item_id string, field string, text string, key string, run string, name string, n long"


def evidence(items: DataFrame) -> DataFrame:
    """One reading of all texts: doubtful ones (kind s), and of their runs what twins could tell.

    c: clean runs with their keys; y: possible originals of a doubtful run with the names of the
    transformations; m: kinds of marks of lost bytes at a key; o: long stretches that fit a transformation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str, str]] = set()
        own: Counter = Counter()

        def rows(texts: list[tuple], last: bool) -> pd.DataFrame:
            out = list(texts)
            if last or len(seen) > FLUSH:
                out += [(k, None, None, None, key, r, name, None) for k, key, r, name in seen]
                seen.clear()
            if last:
                out += [("o", None, None, None, None, None, name, n) for name, n in own.items()]
            return pd.DataFrame(out, columns=[c.split()[0] for c in _EVIDENCE.split(", ")])

        for b in batches:
            texts = []
            for item, field, text in zip(b["item_id"], b["field"], b["text"]):
                odd = _ODD.search(text) is not None or _HAN.search(text) is not None and bool(_as_gbk(text))
                if odd:
                    texts.append(("s", item, field, text, None, None, None, None))
                    for _, _, r, name in spans(text):
                        if name.startswith("utf-8") and len(r) >= LONG_STRETCH:
                            own[name] += 1
                for s, e, key in keyed_runs(text):
                    if not key:
                        continue
                    piece = text[s:e]
                    if not odd:
                        seen.add(("c", key, piece, ""))
                    else:
                        for y, names in origins(piece):
                            seen.add(("y", key, y, names))
                        around = text[max(0, s - 1) : e + 1]
                        for name, mark in MARKS.items():
                            if mark.search(around):
                                seen.add(("m", key, "", name))
            yield rows(texts, False)
        yield rows([], True)

    # text of ASCII letters without a question mark has no runs
    rows = fields(items).filter(F.col("text").rlike("[^\\x00-\\x7f]|\\?"))
    return materialize(spread(rows).mapInPandas(run, _EVIDENCE), "encoding-evidence")


def learned(seen: DataFrame) -> DataFrame:
    """(name, twin_support, own_support): transformations and kinds of marks, borne out by so many keys or long stretches.

    The number of rows is bounded by the number of hypotheses.
    """
    clean = seen.filter("kind = 'c'").select("key", "run")
    at = seen.filter("kind = 'y'").select("key", "run", "name").distinct()
    # a transformation of several steps bears out each of them
    told = at.join(clean.distinct(), ["key", "run"]).select("key", F.explode(F.array_distinct(F.split("name", " "))).alias("name"))
    marks = seen.filter("kind = 'm'").select("key", "name").distinct().join(clean.select("key").distinct(), "key")
    twins = told.distinct().unionByName(marks.select("key", "name")).groupBy("name").agg(F.count("*").alias("twin_support"), F.lit(0).cast("long").alias("own_support"))
    own = seen.filter("kind = 'o'").groupBy("name").agg(F.lit(0).cast("long").alias("twin_support"), F.sum("n").alias("own_support"))
    return twins.unionByName(own).groupBy("name").agg(F.sum("twin_support").alias("twin_support"), F.sum("own_support").alias("own_support"))


def in_use(seen: DataFrame) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
    """(the learned transformations, best supported first; the learned marks)."""
    known = {r["name"]: (r["twin_support"], r["own_support"]) for r in learned(seen).filter((F.col("twin_support") >= SUPPORT) | (F.col("own_support") > 0)).collect()}
    order = [h for h in HYPOTHESES if "/".join(h) in known]
    order.sort(key=lambda h: known["/".join(h)], reverse=True)  # stable: ties as listed
    return tuple(order), tuple(m for m in MARKS if m == "replaced" or m in known)


def found_fields(seen: DataFrame) -> DataFrame:
    """(item_id, field, text, restored, transformation) of the evidence: the garbled fields.

    `restored` is the text as far as transformations restore it; null where they do nothing.
    """
    order, marks = in_use(seen)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, field, text in zip(b["item_id"], b["field"], b["text"]):
                fixed, names = restore(text, order)
                gone = lost(text if not names else fixed, marks)
                if names or gone:
                    out.append((item, field, text, fixed if names else None, f"{names} lost".strip() if gone else names))
            yield pd.DataFrame(out, columns=["item_id", "field", "text", "restored", "transformation"])

    rows = seen.filter("kind = 's'").select("item_id", "field", "text")
    return rows.mapInPandas(scan, "item_id string, field string, text string, restored string, transformation string")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items").select("id", "title", "summary")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return found_fields(evidence(_items(spark, folder))).select("item_id", "field").distinct()


def p6_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """(transformation, twin_support, own_support, used): what was learned, and by which way."""
    out = learned(evidence(_items(spark, folder)))
    used = (F.col("twin_support") >= SUPPORT) | (F.col("own_support") > 0)
    return out.select(F.col("name").alias("transformation"), "twin_support", "own_support", used.alias("used"))


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, field, restored, how): the garbled fields, restored where possible.

    Where bytes were lost, each run takes the one clean run that twins have at its key; the field
    is restored if that can be done for all of them. Of repeated ids the greatest text counts.
    """
    seen = evidence(_items(spark, folder))
    bad = found_fields(seen).groupBy("item_id", "field").agg(F.max(F.struct("text", "restored", "transformation")).alias("x")).select("item_id", "field", "x.*")
    bad = materialize(bad, "encoding-found")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, field, text in zip(b["item_id"], b["field"], b["text"]):
                at = 0
                for n, (s, e, key) in enumerate(keyed_runs(text)):
                    broken = any(m.search(text[max(0, s - 1) : e + 1]) for m in MARKS.values())
                    out.append((item, field, n, text[at:s], text[s:e], key if broken else None, broken))
                    at = e
                out.append((item, field, 1 << 30, text[at:], "", None, False))
            yield pd.DataFrame(out, columns=["item_id", "field", "n", "before", "run", "key", "broken"])

    half = bad.filter("transformation like '%lost'").select("item_id", "field", F.coalesce("restored", "text").alias("text"))
    cut = half.mapInPandas(pieces, "item_id string, field string, n long, before string, run string, key string, broken boolean")
    clean = seen.filter("kind = 'c'").groupBy("key").agg(F.min("run").alias("good"), (F.min("run") == F.max("run")).alias("one")).filter("one").select("key", "good")
    # runs without a key don't meet in the join
    cut = cut.withColumn("key", F.coalesce("key", F.concat(F.lit("\u0000"), "item_id", F.col("n").cast("string")))).join(clean, "key", "left")
    piece = F.struct("n", F.concat("before", F.when(F.col("broken"), F.coalesce("good", "run")).otherwise(F.col("run"))).alias("t"))
    whole = cut.groupBy("item_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("by_twin"), F.max((F.col("broken") & F.col("good").isNull()).cast("int")).alias("open"))
    joined = bad.join(whole.filter("open = 0").drop("open"), ["item_id", "field"], "left")
    gone = F.col("transformation").endswith("lost")
    how = F.when(~gone, F.col("transformation")).when(F.col("by_twin").isNotNull(), F.concat_ws(" ", F.nullif(F.trim(F.expr("left(transformation, length(transformation) - 4)")), F.lit("")), F.lit("twin"))).otherwise("none")
    return joined.select("item_id", "field", F.when(gone, F.col("by_twin")).otherwise(F.col("restored")).alias("restored"), how.alias("how"))


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_mappings": p6_mappings, "p6_restored": p6_restored}
