"""One form for text that looks the same: full-width forms, look-alike letters, decomposed
accents, joined letters, invisible characters and unusual spaces.

Texts that hold a character outside the regular ones are exploded to positioned code
points, joined with the broadcast mapping table (its size is fixed by Unicode), marks are
ordered by their combining class behind their base and composed with it one by one by the table
of pairs, passing over those that don't compose and what these block; parts of Hangul syllables
are composed by their numbers. Texts of regular characters pass through unchanged.

The mapping is built by rule from the Unicode data of the interpreter; only the
look-alike letters are listed. Look-alikes are replaced only inside a word that also holds
Latin letters or consists of look-alikes alone; a single Greek letter on its own stays.
Full-width Chinese punctuation, typographic quotes, dashes and dots, superscripts,
fractions, circled digits and trade signs stay as they are.

Null gives null, empty gives empty. Whole texts are handled, however long.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.llm.common import keyed
from galley.llm.encodings import garbled_mask
from galley.sources.tables import table

#: Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаесіјорѕхуһԛԝԁӏ", "ABESIJKMHOPCTYXaecijopsxyhqwdl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυχ", "ABEZHIKMNOPTYXoavikpux"))
ARMENIAN_CHEROKEE = dict(zip("օսոցհԱᎪᎬᎢᏟᎷᎻᏢᏚᏔ", "ounghUAEICMHPSW"))
OTHERS = dict(zip("ɑɡɩıʟ", "agiil"))
LOOKALIKES = CYRILLIC | GREEK | ARMENIAN_CHEROKEE | OTHERS
#: Stands behind the last character of an exploded text.
END = "\ue0ff"
#: Compatibility kinds that are only another form of a letter or digit.
FORMS = ("<wide>", "<narrow>", "<font>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")
SPACES = "               　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"


def form_of(c: str) -> str | None:
    """What stands for the code point in uniform text; None if it stays as it is."""
    if c in SPACES:
        return " "
    if c in INVISIBLE:
        return ""
    kind = unicodedata.category(c)
    parts = unicodedata.decomposition(c)
    if parts.startswith("<"):
        tag = parts.split()[0]
        if tag in FORMS and (kind[0] in "LN" or "\u2e80" <= c < "\u2fe0") and c not in "№℡™µ":
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and all(unicodedata.category(x)[0] in "LNM" for x in plain):
                return plain
    elif parts and unicodedata.normalize("NFC", c) != c and kind[0] == "L":
        return unicodedata.normalize("NFC", c)  # singletons such as the compatibility ideographs
    return None


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Code point to its uniform form, for all of Unicode."""
    out = {}
    for n in range(0x80, 0x110000):
        if 0xD800 <= n < 0xE000 or 0x4E00 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4:
            continue
        c = chr(n)
        to = form_of(c)
        if to is not None:
            out[c] = to
    return out


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """A character and the mark behind it, to the one composed character; Hangul is left out."""
    out = {}
    for n in range(0xC0, 0x110000):
        if 0x3400 <= n < 0xE000 or 0xF900 <= n < 0xFB00:  # ideographs, syllables, surrogates
            continue
        parts = unicodedata.decomposition(c := chr(n)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
            out["".join(chr(int(p, 16)) for p in parts)] = c
    return out


@lru_cache(maxsize=1)
def marks() -> dict[str, int]:
    """The combining class of every mark that has one."""
    return {c: k for n in range(0x300, 0x1F000) if (k := unicodedata.combining(c := chr(n)))}


def _ranges(chars) -> str:
    """A character class for a regular expression of Java and Python alike."""
    numbers, parts = sorted(map(ord, chars)), []
    for n in numbers:
        if parts and parts[-1][1] == n - 1:
            parts[-1][1] = n
        else:
            parts.append([n, n])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a != b else f"\\x{{{a:x}}}" for a, b in parts)


#: All but the characters that most texts consist of: a quick first look.
UNCOMMON = "[^\\x00-\\x7e\\xa1-\\xac\\xae-\\xff\\u4e00-\\u9fff\\u2012-\\u2026\\u20ac\\u3001\\u3002\\u3008-\\u3011\\uff01\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff1f\\uff5c]"


@lru_cache(maxsize=1)
def suspicious() -> str:
    """A Java pattern for a text that needs the full treatment."""
    return "[" + _ranges(set(mapping()) | set(LOOKALIKES) | set(marks())) + "\\x{1161}-\\x{11c2}]|\\p{Mn}"


def is_odd(text: Column) -> Column:
    return F.coalesce(text.rlike(UNCOMMON) & text.rlike(suspicious()), F.lit(False))


def codes(spark: SparkSession) -> DataFrame:
    """(code point, form, look-alike, class); fixed by Unicode."""
    forms, classes = mapping(), marks()
    # composed letters are taken apart, so that their marks take part in the ordering
    apart = {c: unicodedata.normalize("NFD", c) for c in compositions().values()}
    known = sorted(set(forms) | set(LOOKALIKES) | set(classes) | set(apart))
    rows = [(c, unicodedata.normalize("NFD", forms[c]) if c in forms else apart.get(c), LOOKALIKES.get(c), classes.get(c, 0)) for c in known]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "form", "alike", "ccc"]), "ch string, form string, alike string, ccc int")


def _between(c: Column, low: int, high: int) -> Column:
    return F.coalesce(F.ascii(c).between(low, high), F.lit(False))


def _composed(seat: Column) -> Column:
    """A base and its marks (class, c) in canonical order, as composed text."""
    pairs = compositions()
    known = F.map_from_arrays(*[F.split(F.lit("\u0001".join(x)), "\u0001") for x in (pairs.keys(), pairs.values())])

    def hangul(first: Column, then: Column) -> Column:
        a, b = F.ascii(first), F.ascii(then)
        pair = 0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28
        number = F.when(_between(first, 0x1100, 0x1112) & _between(then, 0x1161, 0x1175), pair)
        number = number.when(_between(first, 0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & _between(then, 0x11A8, 0x11C2), a + b - 0x11A7)
        return F.decode(F.unhex(F.hex(number)), "UTF-16BE")

    def add(state: Column, x: Column) -> Column:
        first = (state["base"] == "") & (state["rest"] == "") & (x["ccc"] == 0)
        free = (state["base"] != "") & ((state["rest"] == "") | (state["last"] < x["ccc"]))
        one = F.when(free, F.coalesce(F.try_element_at(known, F.concat(state["base"], x["c"])), hangul(state["base"], x["c"])))
        base = F.when(first, x["c"]).otherwise(F.coalesce(one, state["base"]))
        stays = first | one.isNotNull()
        return F.struct(
            base.alias("base"),
            F.when(stays, state["rest"]).otherwise(F.concat(state["rest"], x["c"])).alias("rest"),
            F.when(stays, state["last"]).otherwise(x["ccc"]).alias("last"),
        )

    start = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    return F.aggregate(seat, start, add, lambda state: F.concat(state["base"], state["rest"]))


def uniform(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`rows` (keys, text) with the column `uniform`; equal keys must mean equal text.

    Other columns are ignored, whatever their names.
    """
    base = rows.select(*keys, F.col(text).alias("text"))
    odd = is_odd(F.col("text"))
    plain = base.filter(~odd).select(*keys, "text", F.col("text").alias("uniform"))

    table_ = codes(rows.sparkSession)
    # a text becomes hundreds of rows: the few bytes are spread over all tasks first
    each = keyed(base.filter(odd), *keys).dropDuplicates(keys)
    chars = each.select(*keys, "text", F.posexplode(F.array_append(F.split("text", ""), F.lit(END))).alias("pos", "ch"))
    chars = chars.join(F.broadcast(table_), "ch", "left")

    row = Window.partitionBy(*keys).orderBy("pos")
    letter = F.col("ch").rlike("\\p{L}|\\p{Mn}|\\p{Cf}") & ~F.col("ch").rlike("\\p{IsHan}")
    chars = chars.withColumn("word", F.sum(F.when(letter, 0).otherwise(1)).over(row)).withColumn("letter", letter)
    word = Window.partitionBy(*keys, "word")
    real = F.col("letter") & F.col("ch").rlike("\\p{L}")
    latin = F.max(real & (F.col("ch").rlike("\\p{IsLatin}") | F.col("form").rlike("\\p{IsLatin}"))).over(word)
    strange = F.max(real & F.col("alike").isNull() & ~F.col("ch").rlike("\\p{IsLatin}")).over(word)
    size = F.sum(real.cast("int")).over(word)
    chars = chars.withColumn("swap", F.col("letter") & F.col("alike").isNotNull() & (latin | (~strange & (size > 1))))
    form = F.when(F.col("swap"), F.col("alike")).otherwise(F.coalesce("form", "ch"))
    # several characters of one form share its place; a form that vanishes has none; the end mark
    # keeps a place for a text of invisible characters alone
    chars = chars.select(*keys, "text", "pos", F.posexplode(F.split(form, "")).alias("sub", "c")).filter(F.col("c") != "")
    chars = chars.withColumn("c", F.when(F.col("pos") == F.length("text"), "").otherwise(F.col("c")))
    chars = chars.join(F.broadcast(table_.filter("ccc > 0").select(F.col("ch").alias("c"), "ccc")), "c", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    # a mark sits with its base, the parts of a Hangul syllable with the first one
    seat = Window.partitionBy(*keys).orderBy("pos", "sub")
    before = F.lag("c").over(seat)
    follows = _between(F.col("c"), 0x1161, 0x1175) & _between(before, 0x1100, 0x1112) | _between(F.col("c"), 0x11A8, 0x11C2) & (_between(before, 0x1161, 0x1175) | _between(before, 0xAC00, 0xD7A3))
    chars = chars.withColumn("follows", follows).withColumn("base", F.sum(F.when((F.col("ccc") > 0) | F.col("follows"), 0).otherwise(1)).over(seat))
    ordered = F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c")))
    seats = chars.groupBy(*keys, "text", "base").agg(ordered.alias("seat"))
    seats = seats.withColumn("c", F.when(F.size("seat") == 1, F.col("seat")[0]["c"]).otherwise(_composed(F.col("seat"))))
    built = seats.groupBy(*keys, "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "c"))), lambda x: x["c"]), "").alias("uniform"))
    return plain.unionByName(built.select(*keys, "text", "uniform"))


def titles(items: DataFrame) -> DataFrame:
    """(item_id, field, text): titles and canonical titles, each once."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "canonical_title")])
    rows = items.filter(F.col("id").isNotNull()).select(F.col("id").alias("item_id"), F.explode(pairs).alias("x")).select("item_id", "x.*")
    return rows.filter(F.col("text").isNotNull())


def _without_damage(rows: DataFrame) -> DataFrame:
    """The texts with garbled stretches blanked, so that these don't count."""

    def blank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[garbled_mask(t) for t in b["text"]])

    return rows.mapInPandas(blank, "item_id string, field string, text string")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = titles(table(spark, folder, "items").select("id", "title", "canonical_title"))
    odd = _without_damage(rows.filter(is_odd(F.col("text"))))
    done = uniform(odd, ["item_id", "field"])
    return done.filter(F.col("uniform") != F.col("text")).select("item_id", "field").distinct()


def p7_uniform(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, field, uniform): the uniform form of every title and canonical title."""
    rows = titles(table(spark, folder, "items").select("id", "title", "canonical_title"))
    return uniform(rows.dropDuplicates(["item_id", "field"]), ["item_id", "field"]).select("item_id", "field", "uniform")


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_uniform": p7_uniform}
