"""Text functions as column expressions: cleaning, tokens, set similarity, fingerprints."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
#: Fixed value: function characters that carry no meaning of their own.
CJK_STOP = "的了是在和与及对为以于不有个我你他她它们这那就都很更最也还又要会能将把被从到并且或而如但因所以了着过吗呢啊吧呀哦嗯"
LATIN = "[A-Za-z][A-Za-z0-9+#.\\-]+"
NUMBER = "[0-9]+(?:\\.[0-9]+)?%?"
#: Fixed value: names of publishers that re-runs append to a title.
PUBLISHERS = "新华网|人民网|中新网|央视网|新浪(?:新闻|财经)?|36氪|IT之家|少数派|Solidot|财联社|每经网|中国新闻网"
#: Fixed value: editors' notes in brackets.
NOTES = "[（(【\\[](?:图|组图|视频|多图|实录|全文|直播|独家|转载|来源[:：][^)）】\\]]{0,20})[)）】\\]]"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&ldquo;": "“", "&rdquo;": "”", "&rsquo;": "’", "&lsquo;": "‘", "&amp;": "&"}
SIMHASH_BITS = 63


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape(c: Column | str) -> Column:
    """All character references resolved, named and numeric, each once; unknown ones stay.

    Each reference that a text has is replaced by its character, the ampersand last.
    """
    t = col(c)
    names = {k: v for k, v in html5.items() if k.endswith(";") and "\u0000" not in v}
    table = F.map_from_arrays(*[F.split(F.lit("\u0000".join(x)), "\u0000") for x in (names.keys(), names.values())])

    def sign(ref: Column) -> Column:
        digits = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "[0-9a-fA-F]+", 0), 16, 10)).otherwise(F.regexp_extract(ref, "[0-9]+", 0)).cast("bigint")
        n = F.when(digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF), digits).otherwise(0xFFFD)
        return F.when(F.substring(ref, 2, 1) == "#", F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.coalesce(F.try_element_at(table, F.substring(ref, 2, 64)), ref))

    refs = F.array_distinct(F.regexp_extract_all(t, F.lit("&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), F.lit(0)))
    last = F.array_sort(F.transform(refs, lambda r: F.struct((r == "&amp;").alias("last"), r.alias("r"))))
    done = F.aggregate(last, t, lambda out, x: F.replace(out, x["r"], sign(x["r"])))
    return F.when(F.contains(t, F.lit("&")), done).otherwise(t)


def clean_text(c: Column | str) -> Column:
    """References resolved, tags to spaces, wide and fixed spaces plain, runs of space single, trimmed; null to ''."""
    t = F.regexp_replace(unescape(F.coalesce(col(c), F.lit(""))), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.translate(t, "　 ", "  "), "\\s+", " "))


def clean_title(c: Column | str) -> Column:
    """`clean_text` without bracketed notes, a publisher's name at the end, and marks at the edges."""
    t = F.regexp_replace(clean_text(c), NOTES, "")
    t = F.regexp_replace(t, f"(?:[-—_|｜]\\s*(?:{PUBLISHERS})\\s*$)", "")
    return F.btrim(t, F.lit(" -—_|｜·、,，。"))


def bigrams(run: Column) -> Column:
    """Two-character windows of a run; a single character stays."""
    return F.when(F.length(run) <= 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))


def tokens(c: Column | str) -> Column:
    """Bigrams of Chinese runs without stop characters, lower-case Latin words, numbers."""
    t = F.coalesce(col(c), F.lit(""))

    def pieces(run: Column) -> Column:
        kept = F.translate(run, CJK_STOP, "")
        return bigrams(F.when(kept == "", run).otherwise(kept))

    runs = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(f"[{CJK}]+"), F.lit(0)), pieces))
    latin = F.transform(F.regexp_extract_all(t, F.lit(LATIN), F.lit(0)), lambda w: F.lower(w))
    return F.concat(runs, latin, F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)))


def grams(c: Column | str) -> Column:
    """The set of tokens, sorted."""
    return F.array_sort(F.array_distinct(tokens(c)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    all_ = F.size(col(a)) + F.size(col(b)) - both
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), both / all_).otherwise(F.lit(0.0))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared elements over the smaller set; 0 if either is empty."""
    least = F.least(F.size(col(a)), F.size(col(b)))
    return F.when(least > 0, F.size(F.array_intersect(col(a), col(b))) / least).otherwise(F.lit(0.0))


def token_code(token: Column) -> Column:
    """The first eight bytes of a token's md5 as a number."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")


def simhash(toks: Column | str) -> Column:
    """63-bit fingerprint of tokens with multiplicity; a bit is set if more tokens have it than not."""
    codes = F.transform(col(toks), token_code)
    # one pass: a counter per bit
    zero = F.array_repeat(F.lit(0), SIMHASH_BITS)
    add = F.aggregate(codes, zero, lambda acc, h: F.transform(acc, lambda x, i: x + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)))
    bits = F.transform(add, lambda x, i: F.when(x > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(F.reverse(bits), F.lit(0).cast("bigint"), lambda acc, b: acc * 2 + b)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def item_id(source: Column | str, title: Column | str) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", col(source), col(title))), 1, 20)


def contains_any(text: Column, words: list[str]) -> Column:
    """The listed words that occur in the text, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def cjk_ratio(c: Column | str) -> Column:
    """Share of Chinese characters among letters."""
    t = F.coalesce(col(c), F.lit(""))
    han = F.regexp_count(t, F.lit(f"[{CJK}]"))
    letters = han + F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when(letters > 0, han / letters).otherwise(F.lit(0.0))


def edge_trim(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), "^\\s+|\\s+$", ""))


def usd(value: Column) -> Column:
    """A decimal amount of dollars in short: billions with one decimal, whole millions, else with commas."""
    part = lambda size, places: F.round(value / F.lit(size).cast("decimal(12,0)"), places).cast(f"decimal(20,{places})").cast("string")
    small = F.concat(F.lit("$"), F.format_number(F.round(value, 0).cast("bigint"), 0))
    return F.when(value >= 10**9, F.concat(F.lit("$"), part(10**9, 1), F.lit("bn"))).when(value >= 10**6, F.concat(F.lit("$"), part(10**6, 0), F.lit("m"))).otherwise(small)


def paged_url(url: Column, start: Column, count: int = 100) -> Column:
    """The url of another page: its own place replaced by `start` and `count`."""
    return F.concat(F.regexp_replace(url, "&(?:start|count)=[0-9]+", ""), F.lit("&start="), start.cast("string"), F.lit(f"&count={count}"))


def filing_title(owner: Column, form: Column, summary: Column) -> Column:
    """Owner and form of a filing, its date and number as its summary names them, as one title; '' without any."""
    found = lambda name: F.regexp_extract(F.coalesce(summary, F.lit("")), f"(?i){name}:\\s*([\\d-]+)", 1)
    parts = F.array(F.trim(F.concat_ws(" ", owner, form)), found("Filed"), found("AccNo"))
    return F.array_join(F.filter(parts, lambda x: x != ""), " · ")


def first_json(reply: str | None) -> str | None:
    """The JSON of a reply: without a fence around it, the whole or else the first balanced object that parses; None without."""
    import json
    import re

    plain = re.sub(r"(?m)^```(?:json)?|```$", "", (reply or "").strip()).strip()

    def parses(t: str) -> bool:
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    if plain and parses(plain):
        return plain
    depth, begin = 0, None
    for at, sign in enumerate(plain):
        if sign == "{":
            begin = at if depth == 0 else begin
            depth += 1
        elif sign == "}":
            depth -= 1
            if depth == 0 and begin is not None and parses(plain[begin : at + 1]):
                return plain[begin : at + 1]
    return None
