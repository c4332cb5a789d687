"""Rule features of texts: labels of a lexicon, periods and quantities, as column expressions.

Quantities are read kind by kind; what one kind has taken is blanked before the next reads,
so a percentage or a date never counts as a plain number too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of round-ups, and the marks between their parts.
DIGEST = "早报|晚报|日报|周报|晨报|晨会|午评|晚评|快讯|要闻|速览|盘点|早知道|一周回顾|news roundup|roundup|news digest|in brief|week in review|morning brief|im überblick|kurz & knapp|news kompakt|en bref|l'essentiel"
PARTS = "[；;丨|‖]"
#: A small lexicon of event kinds over the languages of the desk.
EVENTS = {
    "recall": ("recalls", "ruft nach fehler", "rappelle", "召回", "retira", "recolhe"),
    "strike": ("strike at", "streik bei", "une grève", "罢工", "una huelga", "greve na"),
    "fine": ("fines", "strafe von", "inflige", "罚款", "multa"),
    "inquiry": ("inquiry into", "prüft", "enquête sur", "调查", "investiga"),
    "rates": ("central bank", "zentralbank", "banque centrale", "央行", "banco central"),
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Patterns of periods, each with the kind its number stands for.
PERIODS = (("y", "([12][0-9]{3})\\s*年"), ("m", "([0-9]{1,2})\\s*月"), ("d", "([0-9]{1,2})\\s*日"), ("q", "\\bQ([1-4])\\b"), ("h", "\\bH([12])\\b"))
PERCENT = "([0-9]+(?:\\.[0-9]+)?)\\s*(?:%|％|percent)"
POINTS = "([0-9]+(?:\\.[0-9]+)?)\\s*(?:个)?(?:基点|basis points?|bps)"
UNITS = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "万亿": 1e12, "亿": 1e8, "万": 1e4}
PLAIN = "[0-9]+(?:\\.[0-9]+)?"
#: A number that is no part of a word.
PLAIN_ALONE = "(?<![\\p{L}\\p{N}_.])(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+(?:\\.[0-9]+)?)(?![\\p{L}\\p{N}_.])"


def labels(text: Column, lexicon: dict[str, tuple[str, ...]]) -> Column:
    """The labels of which a term occurs, in the lexicon's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(terms)), F.lit(name)) for name, terms in lexicon.items()]))


def periods(text: Column) -> Column:
    """Marks such as m:3 or q:2, sorted, each once; months also by their English names."""
    t = F.coalesce(text, F.lit(""))

    def marks(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), x.cast("int").cast("string")))

    found = [marks(k, p) for k, p in PERIODS]
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower(t), F.lit(m)), F.lit(f"m:{n}")) for n, m in enumerate(MONTHS, 1)]))
    return F.array_sort(F.array_distinct(F.concat(*found, named)))


def _numbers(t: Column, pattern: str, factor: float = 1.0) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: F.round(x.cast("double") * factor, 6))


def quantities(text: Column) -> Column:
    """struct(pct, num, n_plain): percentages, amounts with a unit word, and how many plain numbers are left."""
    t = F.coalesce(text, F.lit(""))
    pct = F.concat(_numbers(t, POINTS, 0.01), _numbers(t, PERCENT))
    left = F.regexp_replace(F.regexp_replace(t, POINTS, " "), PERCENT, " ")
    amounts = []
    for unit, factor in UNITS.items():
        pattern = f"({PLAIN})\\s*{unit}"
        amounts.append(_numbers(left, pattern, factor))
        left = F.regexp_replace(left, pattern, " ")
    for _, pattern in PERIODS:
        left = F.regexp_replace(left, pattern, " ")
    distinct = lambda x: F.array_sort(F.array_distinct(x))
    return F.struct(distinct(pct).alias("pct"), distinct(F.concat(*amounts)).alias("num"), F.regexp_count(left, F.lit(PLAIN)).alias("n_plain"))


def amounts(text: Column) -> Column:
    """The numbers of a text by kind, sorted, each once: pct:, num: and, for plain numbers that are no years, count:."""
    t = F.coalesce(text, F.lit(""))
    left = F.regexp_replace(F.regexp_replace(t, POINTS, " "), PERCENT, " ")
    for unit in UNITS:
        left = F.regexp_replace(left, f"({PLAIN})\\s*{unit}", " ")
    for _, pattern in PERIODS:
        left = F.regexp_replace(left, pattern, " ")
    plain = F.transform(F.regexp_extract_all(left, F.lit(PLAIN_ALONE), F.lit(0)), lambda x: F.replace(x, F.lit(",")))
    plain = F.filter(plain, lambda x: ~(x.rlike("^[0-9]{4}$") & x.cast("double").between(1900, 2100)))
    q = quantities(t)
    marked = lambda kind, x: F.transform(x, lambda v: F.concat(F.lit(kind), v.cast("double").cast("string")))
    return F.array_sort(F.array_distinct(F.concat(marked("pct:", q["pct"]), marked("num:", q["num"]), marked("count:", plain))))


def subjects(text: Column) -> Column:
    """Words with a capital letter, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-z]+"), F.lit(0)))


def digest(text: Column) -> Column:
    """Whether a title is a round-up of several events."""
    t = F.coalesce(text, F.lit(""))
    return F.lower(t).rlike(DIGEST) | (F.regexp_count(t, F.lit(PARTS)) >= 2)


def bridge_keys(subjects: Column, events: Column) -> Column:
    """Every subject with every event, as keys to block on."""
    return F.flatten(F.transform(subjects, lambda s: F.transform(events, lambda e: F.concat(s, F.lit(":"), e))))
