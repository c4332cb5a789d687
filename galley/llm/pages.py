"""Main body and boilerplate of page texts by tag-path ratios.

A line's path leads from the page through the kind of its script, the marker in front of
it, its ending and its length step down to its skeleton, the wording with names and figures
left out. Markup around a line (as of a half-stripped page) and indents are taken off first,
as they fall on all kinds of lines.

Text length, punctuation and the kind of neighbouring lines are aggregated per path over all
pages. A leaf seen on few pages is smoothed towards the path above it. The ratios are fused
into one score per path, and lines on paths above the threshold are content:

* prose: share of a path's text that lies in sentences closed by a full stop or the like;
* separators: signs of menus, tags and credits per line;
* apart: share of a path's closed lines that are the last of a page, or stand alone behind its
  text. Rights and imprint lines are sentences too, but stand in footers;
* embedding: share of a path's lines that stand between lines of prose. Subheads and list lines
  have no full stop but stand there; menus and link lists stand together;
* leading: of a path's lines outside the prose, the share that stand right before it and not
  behind it. A subhead belongs to what follows; adverts and prompts trail a report or interrupt
  it, but don't open it.

No list of words is used: what a line says counts only through its path.

Blank lines count for line numbers and are never cases. A null or empty body has no lines.
Whole bodies are used; every page counts for the statistics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import keyed, spread
from galley.session import materialize
from galley.sources.tables import table

#: Lines of a path, and of a leaf, from which on its own ratios weigh as much as those above it.
SMOOTHING, LEAF_SMOOTHING = 2.0, 8.0
THRESHOLD = 0.5
#: Letters up to which a line can be a subhead, and the embedding and leading that make such lines content.
SHORT, EMBEDDED, LEADING = 50, 0.2, 0.25
#: What counts for leading where a path has no lines outside the prose.
UNTOLD = 0.02
#: Share of closed lines in the midst of prose, below which they count for less; weight of a separator.
AMIDST, SEPARATOR = 0.4, 0.6

_WRAP = re.compile(r"^\s*(?:<\w+[^<>]*>\s*)*|\s*(?:</\w+>\s*)*$")
_MARK = re.compile(r"^([•‣▪·*»>–—-]|\d{1,2}[.)])\s+")
_END = re.compile(r"[.!?。！？…][”“\"»’)）」]*$")
_STOP = re.compile(r"[.!?。！？]")
_HAN = re.compile("[一-鿿]")
_SEPARATORS = re.compile(r"\s[|·>/•]\s|\s{2,}\S")
_HAN_GAP = re.compile(r"(?<=[一-鿿])\s(?=[一-鿿])")
_NAME = re.compile(r"\b[A-ZÀ-Þ][\w’'-]*")
_FIGURE = re.compile(r"\d+(?:[.,:]\d+)*")
def bare(line: str) -> str:
    """The line without markup around it and without indent."""
    return _WRAP.sub("", line).strip().replace("­", "")


def features(line: str) -> tuple[str, str, str, int, int, int, str]:
    """(upper path, middle path, leaf path, letters, letters in sentences, separators, kind) of a bare line."""
    han = len(_HAN.findall(line)) * 4 > len(line)
    size = max(1, len(line)) * (3 if han else 1)  # a Chinese character says as much as three letters
    mark = _MARK.match(line)
    body = line[mark.end() :] if mark else line
    closed = bool(_END.search(body))
    separators = len(_SEPARATORS.findall(body))
    if han and not closed:  # Chinese puts a space only between the parts of a label or credit
        separators += len(_HAN_GAP.findall(body))
    figure = bool(re.match(r"\d", body))
    step = "t" if size < 50 else "s" if size < 85 else "m" if size < 200 else "l"
    top = f"{'h' if han else 'a'}{'-' if mark and mark.group(1) in '–—' else 'o' if mark else ''}{'#' if figure else ''}{'.' if closed else ''}{step}{'|' if separators else ''}"
    skeleton = _FIGURE.sub("#", body)
    if not han:  # the first word has its capital by its place
        first, _, rest = skeleton.partition(" ")
        skeleton = f"{first} {_NAME.sub('N', rest)}"
    # closing a line isn't enough for prose: there must be words between the stops
    prose = size if closed and (size >= 25 or len(_STOP.findall(body)) == 1) and separators < 2 else 0
    kind = f"{mark.group(1) if mark else ''}{'#' if figure else ''}{'.' if closed else ''}"
    middle = f"{top}/{body[-2:] if han else skeleton.split(' ')[0]}"
    return top, middle, f"{middle}/{skeleton}", size, prose, separators, kind


_LINE = "key string, line_no long, top string, middle string, leaf string, size int, prose int, separators int, embedded int, opens int, trails int, apart int"


def lines_of(pages: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(key, line_no, top, middle, leaf, size, prose, separators, embedded, opens, trails, apart) of every line that isn't blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, text in zip(b["key"], b["body"]):
                if not text:
                    continue
                rows = []
                for no, line in enumerate(text.split("\n"), 1):
                    if line.strip():
                        rows.append((page, no, *features(bare(line))))
                out += _placed(rows)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _LINE.split(", ")])

    rows = pages.select(F.col(key).alias("key"), F.col(body).alias("body")).filter(F.length("body") > 0)
    return spread(rows).mapInPandas(run, _LINE)


def _placed(rows: list[tuple]) -> list[tuple]:
    """Replaces each line's kind by its place: between prose, right before the first, behind the last; closed, but the last or alone behind the text.

    Runs of lines of one kind are taken together; lines with separators are passed over.
    """

    def passes(order: Iterator[int]) -> tuple[dict[int, bool], dict[int, bool]]:
        seen, any_seen, prose, last, some = {}, {}, False, None, False
        for k in order:
            r = rows[k]
            if last is not None and r[8] != last[8]:
                prose = last[6] > 0
            seen[k], any_seen[k] = prose, some
            some = some or r[6] > 0
            if not r[7]:
                last = r
        return seen, any_seen

    n = len(rows)
    (before, ever_before), (after, ever_after) = passes(range(n)), passes(range(n - 1, -1, -1))
    prose = [r[6] > 0 for r in rows]
    touches = [p and (k > 0 and prose[k - 1] or k + 1 < n and prose[k + 1]) for k, p in enumerate(prose)]
    last_touching = max((k for k in range(n) if touches[k]), default=-1)
    out = []
    for k, r in enumerate(rows):
        # the last closed line, and those before it that stand alone behind the text
        apart = prose[k] and ever_before[k] and (not ever_after[k] or k > last_touching)
        out.append((*r[:8], int(before[k] and after[k]), int(after[k] and not ever_before[k]), int(ever_before[k] and not ever_after[k]), int(apart)))
    return out


def path_scores(lines: DataFrame) -> DataFrame:
    """(leaf, score): the fused and smoothed ratios of every leaf path."""
    what = ("n", "size", "prose", "separators", "embedded", "opens", "trails", "apart", "closed")
    leaf = lines.groupBy("top", "middle", "leaf").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in what[1:-1]], F.sum((F.col("prose") > 0).cast("int")).alias("closed"))
    middle = leaf.groupBy("middle").agg(*[F.sum(c).alias(f"middle_{c}") for c in what])
    # the paths at the top are few: script x marker x ending x length step x signs
    top = leaf.groupBy("top").agg(*[F.sum(c).alias(f"top_{c}") for c in what])
    both = leaf.join(middle, "middle").join(F.broadcast(top), "top")

    def ratio(part: str, of: str) -> Column:
        out = F.col(f"top_{part}") / F.col(f"top_{of}")
        for level in ("middle_", ""):
            weight = F.col(f"{level}n") / (F.col(f"{level}n") + (SMOOTHING if level else LEAF_SMOOTHING))
            out = weight * F.col(f"{level}{part}") / F.col(f"{level}{of}") + (1 - weight) * out
        return out

    one = F.lit(1.0)
    signs = F.least(one, ratio("separators", "n") * SEPARATOR)
    amidst = F.when(F.col("closed") > 0, F.least(one, (1 - ratio("apart", "closed")) / AMIDST)).otherwise(1.0)
    leading = (ratio("opens", "n") + UNTOLD) / (ratio("opens", "n") + ratio("trails", "n") + 2 * UNTOLD)
    place = F.least(one, ratio("embedded", "n") / EMBEDDED, leading / LEADING)
    short = F.when(F.col("size") / F.col("n") < SHORT, place).otherwise(0.0)
    return both.select("leaf", (F.greatest(ratio("prose", "size") * amidst, short) - signs).alias("score"))


def boilerplate(pages: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """(key, line_no, score): the lines that aren't main body."""
    # the paths as numbers, written once, as the lines are read for each level of the paths
    hashed = [F.xxhash64(c).alias(c) for c in ("top", "middle", "leaf")]
    lines = lines_of(pages, key, body)
    rest = [c for c in lines.columns if c not in ("top", "middle", "leaf")]
    lines = materialize(lines.select(*rest, *hashed), "page-lines")
    scores = path_scores(lines)
    return lines.select("key", "line_no", "leaf").join(scores, "leaf").filter(F.col("score") < THRESHOLD).select("key", "line_no", "score")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items").select("id", "body", "body_state")
    rows = items.filter((F.col("body_state") == "ok") & F.col("id").isNotNull() & F.col("body").isNotNull())
    return keyed(rows, "id").groupBy("id").agg(F.max("body").alias("body"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate(_pages(spark, folder)).select(F.col("key").alias("item_id"), "line_no")


SQL: dict[str, str] = {}
QUERIES = {"p5_found": p5_found}
