"""Claims against evidence and titles against each other, by what they name: entities, events, periods, figures.

The rules need the places of what was read in a text, so they run in Arrow batches, one row
per item and claim or per candidate pair. No row waits for another: claims meet the items of
their cluster by a join, titles meet by similarity joins and by keys of entity and event.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import headlines, text
from galley.functions.features import digest
from galley.operators import tiles
from galley.operators.clustering import OVERLAP, OVERLAP_SIZE, NEAR_JACCARD, WINDOW_DAYS, contained_sets, links_of, seeded, similar_sets
from galley.operators.evaluation import b_cubed, pair_counts
from galley.operators.evidence import lead_claims, status_of
from galley.plans.catalog import query
from galley.session import materialize
from galley.sources.snapshots import items, sources

RELATED = "cluster_id string, item_id string, grp string, role string, relation string, similarity double, quote_field string, quote_start int, quote_end int, quote_hash string, quote string"


def held_against(each: DataFrame) -> DataFrame:
    """Relations and quotes of (cluster_id, item_id, grp, role, claim, title, summary, published); unrelated rows fall out.

    A null title or summary counts as empty; an item without owner group counts for its source.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, i, g, role, claim, title, summary, at in zip(*(b[x] for x in ("cluster_id", "item_id", "grp", "role", "claim", "title", "summary", "published"))):
                q = headlines.best_quote(claim, title, summary)
                r = headlines.relation(claim, title, summary, None if pd.isna(at) else int(at), q)
                if r:
                    out.append((c, i, g, role, r, round(q.similarity, 4), q.field, q.start, q.end, hashlib.sha256(q.text.encode()).hexdigest()[:16], q.text))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RELATED.split(", ")])

    return each.select("cluster_id", "item_id", "grp", "role", "claim", "title", "summary", "published").mapInPandas(run, RELATED)


def claim_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The items of each cluster against its lead claim, with the quote that bears on it."""
    it = items(spark, folder, "cluster_id", "title", "summary", "grp", "published_ts").filter("cluster_id is not null")
    role = sources(spark, folder).select(F.col("id").alias("source_id"), F.col("source_role").alias("role"))
    each = it.join(role, "source_id", "left").join(lead_claims(spark, folder).select("cluster_id", "claim"), "cluster_id")
    owner = F.coalesce(F.nullif("grp", F.lit("")), "source_id")
    return held_against(each.select("cluster_id", F.col("id").alias("item_id"), owner.alias("grp"), F.coalesce("role", F.lit("reporting")).alias("role"), "claim", "title", "summary", F.coalesce("published_ts", "fetched_ts").alias("published")))


@query("F32_claim_relations")
def claim_relations(spark: SparkSession, folder: str) -> DataFrame:
    """How each item bears on its cluster's claim, by the sentence that would be quoted."""
    return claim_evidence(spark, folder).drop("quote", "grp", "role")


@query("A13_claim_cards")
def claim_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The status of each claim that some source supports."""
    return status_of(claim_evidence(spark, folder)).filter("n_support > 0")


@query("F31_claim_doubts")
def claim_doubts(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster_id, points, disputed, single_owner): signals against a cluster from its claim; a dispute weighs most."""
    cards = claim_cards(spark, folder)
    disputed, single = F.col("status") == "disputed", F.col("independent_groups") < 2
    return cards.select("cluster_id", (F.when(disputed, 35).otherwise(0)).alias("points"), disputed.alias("disputed"), single.alias("single_owner"))


# ---- titles


TITLED = "id string, day long, grp string, grams array<string>, title string, simhash long"
NAMED = "id string, key string"


def titled_classes(it: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, class), classes) of (id, title, grp, simhash, day): equal titles of one owner and day fall together."""
    sets = it.filter("title <> '' and day is not null").withColumn("grams", text.grams("title")).filter("size(grams) > 0")
    key = F.struct("day", F.coalesce("grp", F.lit("")).alias("grp"), "title")
    first = sets.groupBy(key.alias("k")).agg(F.min(F.struct("id", "grams", "simhash")).alias("x"))
    classes = materialize(first.select("x.id", "k.day", "k.grp", "x.grams", "k.title", "x.simhash"), "titles")
    members = sets.select("id", "day", F.coalesce("grp", F.lit("")).alias("grp"), "title").join(classes.select("day", "grp", "title", F.col("id").alias("class")), ["day", "grp", "title"])
    return members.select("id", "class"), classes


def named(classes: DataFrame) -> DataFrame:
    """(id, key): keys of entity and event on which titles of other wording or script meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k) for i, t in zip(b["id"], b["title"]) for k in headlines.features(t).meeting]
            yield pd.DataFrame(out, columns=["id", "key"])

    return classes.select("id", "title").mapInPandas(run, NAMED)


def read(classes: DataFrame) -> DataFrame:
    """(id, read): what each title names, read once and written down for the pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "read": [pickle.dumps(headlines.features(t)) for t in b["title"]]})

    return materialize(classes.select("id", "title").mapInPandas(run, "id string, read binary"), "read")


def ruled(classes: DataFrame, pairs: DataFrame, rare: DataFrame) -> DataFrame:
    """(a, b, s, against) of candidate pairs: similarity by the pair rules and what speaks against one event.

    A round-up meets only titles of its own owner.
    """
    full = classes.join(read(classes), "id").join(rare, "id", "left")
    a, b = (full.select(*[F.col(c).alias(f"{c}_{k}" if c != "id" else k) for c in ("id", "read", "grp", "grams", "simhash", "rare")]) for k in "ab")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for x, y, tx, ty, ox, oy, gx, gy, hx, hy, rx, ry in zip(*(p[c] for c in ("a", "b", "read_a", "read_b", "grp_a", "grp_b", "grams_a", "grams_b", "simhash_a", "simhash_b", "rare_a", "rare_b"))):
                fx, fy = pickle.loads(tx), pickle.loads(ty)
                if (fx.digest or fy.digest) and ox != oy:
                    continue
                gx, gy = frozenset(gx), frozenset(gy)
                known = not pd.isna(hx) and not pd.isna(hy) and hx and hy
                s = headlines.pair_similarity(fx, fy, gx, gy, (int(hx) ^ int(hy)).bit_count() if known else 64)
                if s >= 0.42:
                    out.append((x, y, s, headlines.conflict(fx, fy, gx, gy, frozenset(rx if rx is not None else ()), frozenset(ry if ry is not None else ()))))
            yield pd.DataFrame(out, columns=["a", "b", "s", "against"])

    return pairs.join(a, "a").join(b, "b").mapInPandas(run, "a string, b string, s double, against string")


def rare_grams(classes: DataFrame) -> DataFrame:
    """(id, rare): the grams of each title that at most max(2, 0.004 n) titles have."""
    cap = F.broadcast(classes.agg(F.greatest(F.lit(2), F.floor(0.004 * F.count("*"))).alias("cap")))  # one row
    each = classes.select("id", F.explode("grams").alias("gram"))
    few = each.groupBy("gram").agg(F.count("*").alias("df")).join(cap, F.col("df") <= F.col("cap")).select("gram")
    return each.join(few, "gram").groupBy("id").agg(F.collect_set("gram").alias("rare"))


def meeting(classes: DataFrame) -> DataFrame:
    """(a, b) of the titles within WINDOW_DAYS that share a key of entity and event."""
    keys = named(classes).join(classes.select("id", "day"), "id").withColumn("block", F.floor(F.col("day") / WINDOW_DAYS))
    left = keys.select("key", "block", F.col("id").alias("a"), F.col("day").alias("da"))
    right = keys.select("key", F.explode(F.array(*[F.col("block") + k for k in (-1, 0, 1)])).alias("block"), F.col("id").alias("b"), F.col("day").alias("db"))
    return left.join(right, ["key", "block"]).filter(f"a < b and abs(da - db) <= {WINDOW_DAYS}").select("a", "b")


def linked(classes: DataFrame) -> DataFrame:
    """(a, b, s) of the titles that tell of one event.

    Two titles with rare words, none of them in common, are in conflict unless they bridge
    scripts, and bridged titles meet by their keys. So pairs by wording must share a rare word,
    or one of them has none; these are found inside tiles. Without a common key they are linked
    by wording or fingerprints alone, except for round-ups, which have no keys.
    """
    grams, marked = marked_grams(classes)
    hash = F.when(digest(F.col("title")), tiles.ANY).otherwise(F.nullif("simhash", F.lit(0)))
    near = tiles.sharing(marked.select("id", grams.alias("grams"), "day", hash.alias("hash")), WINDOW_DAYS)
    pairs = near.unionByName(meeting(classes)).distinct()
    return ruled(classes, pairs, rare_grams(classes)).filter("against is null and s >= 0.5").select("a", "b", "s")


def marked_grams(classes: DataFrame) -> tuple[Column, DataFrame]:
    """The grams of classes with a mark before rare ones, as a column of the classes given back."""
    grams = F.transform("grams", lambda g: F.when(F.array_contains("rare", g), F.concat(F.lit(tiles.MARK), g)).otherwise(g))
    return grams, classes.join(rare_grams(classes), "id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


REASONS = ("figures", "entities", "events", "objects", "words")
_BITS = {kind: {label: 1 << n for n, label in enumerate(names)} for kind, names in (("entities", headlines.ENTITIES), ("events", headlines.EVENTS), ("wide", headlines.EVENTS_BROAD), ("objects", headlines.OBJECTS), ("currencies", headlines.CURRENCIES))}


def noted(classes: DataFrame) -> DataFrame:
    """(id, note): what a title names, as numbers, with its owner and day."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            notes = []
            for t, grp, day in zip(b["title"], b["grp"], b["day"]):
                f = headlines.features(t)
                masks = [sum(bits[label] for label in getattr(f, kind)) for kind, bits in _BITS.items()]
                notes.append(pickle.dumps((*masks, f.cjk, f.latin, f.digest, int(day), grp, tuple(f.numbers), tuple(sorted(f.periods)))))
            yield pd.DataFrame({"id": b["id"], "note": notes})

    return classes.select("id", "title", "grp", "day").mapInPandas(run, "id string, note binary")


class Named:
    """What the titles of one side of a tile name, as arrays. Codes are common to both sides."""

    def __init__(self, s: tiles.Sets, figure: np.ndarray, codes: dict, fill: int):
        read = [pickle.loads(v) for v in s.note]
        column = lambda k, kind: np.array([r[k] for r in read], kind)
        self.entities, self.events, self.wide, self.objects, self.currencies = (column(k, np.int64) for k in range(5))
        self.cjk, self.latin, self.digest, self.day = column(5, bool), column(6, bool), column(7, bool), column(8, np.int64)
        code = lambda v: codes.setdefault(v, len(codes))
        self.grp = np.array([code(r[9]) for r in read], np.int64)
        self.numbers = self.table([[code(n) for n in r[10]] for r in read], fill)
        self.periods = np.array([code(("periods", r[11])) for r in read], np.int64)
        own = figure[s.gram]
        ends = np.searchsorted(s.row[own], np.arange(len(s.n) + 1))
        found = s.gram[own]
        self.figures = self.table([found[a:b] for a, b in zip(ends[:-1], ends[1:])], fill)

    @staticmethod
    def table(lists: list, fill: int) -> np.ndarray:
        out = np.full((len(lists), max(1, max(map(len, lists), default=1))), fill, np.int64)
        for n, v in enumerate(lists):
            out[n, : len(v)] = v
        return out


def _clash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two tables of codes both have some, but none in common; the tables are filled with different negatives."""
    out = (a[:, 0] >= 0) & (b[:, 0] >= 0)
    at = np.flatnonzero(out)
    out[at] = ~(a[at][:, :, None] == b[at][:, None, :]).any((1, 2))
    return out


def opposed(x: tiles.Sets, y: tiles.Sets, grams: pa.Array, ids: pa.Array, rule: str = "") -> pa.Table:
    """(id, against, n): of the titles of both sides, how many like ones can't be the same event, each pair looked at once.

    Shared grams are counted by a product of matrices over the grams that aren't rare, and one by
    one where a rare gram is shared. Titles that only a bridge links are never in conflict.
    """
    every = grams.to_pylist()
    marked = np.array([g.startswith(tiles.MARK) for g in every], bool)
    figure = np.array([headlines._FIGURE.fullmatch(g.removeprefix(tiles.MARK)) is not None for g in every], bool)
    codes: dict = {}
    fx, fy = Named(x, figure, codes, -1), Named(y, figure, codes, -2)
    periods = {n: frozenset(v[1]) for v, n in codes.items() if isinstance(v, tuple)}
    nx, ny = len(x.n), len(y.n)
    plain = np.cumsum(~marked) - 1
    has = []
    for s in (x, y):
        m = np.zeros((len(s.n), int((~marked).sum()) or 1), np.float32)
        own = ~marked[s.gram]
        m[s.row[own], plain[s.gram[own]]] = 1
        has.append(m)
    right = np.ascontiguousarray(has[1].T)
    rare_x, rare_y = marked[x.gram], marked[y.gram]
    index = tiles.Index(y.gram[rare_y], y.row[rare_y])
    with_rare = [np.bincount(s.row[r], minlength=len(s.n)) > 0 for s, r in ((x, rare_x), (y, rare_y))]
    row, gram = x.row[rare_x], x.gram[rare_x]
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    px, py, day = place[x.ids], place[y.ids], fx.day[0]
    # shared grams from which two sizes are looked at: 0.2, or a long title contained by 0.68
    sizes, of_size = np.unique(x.n, return_inverse=True)
    least = np.minimum(sizes[:, None], y.n[None])
    enough = np.minimum(-(-(sizes[:, None] + y.n[None]) // 6), np.where(least >= 8, -(-17 * least // 25), 1 << 20)).astype(np.float32)
    same_day = fy.day == day
    nought = np.zeros((nx + ny) * len(REASONS), np.int64)
    step = max(1, 4_000_000 // ny)
    known: dict[tuple[int, int], bool] = {}

    def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(a * len(codes) + b, return_inverse=True)
        out = np.zeros(len(pairs), bool)
        for n, v in enumerate(pairs.tolist()):
            k = divmod(v, len(codes))
            if k not in known:
                known[k] = headlines.different_periods(periods[k[0]], periods[k[1]])
            out[n] = known[k]
        return out[back.ravel()]

    for lo in range(0, nx, step):
        rows = slice(lo, min(lo + step, nx))
        k = has[0][rows] @ right
        flat = slice(*np.searchsorted(row, (rows.start, rows.stop)))
        begin, count = index.count(gram[flat])
        keys, times = tiles.distinct((np.repeat(row[flat], count) - lo) * ny + index.rows[tiles.spread(begin, count)])
        k.reshape(-1)[keys] += times
        near = k >= enough[of_size[rows]]
        near &= (px[rows, None] < py[None]) | ~same_day[None]
        at = np.flatnonzero(near)
        for part in range(0, len(at), 1_000_000):
            cell = at[part : part + 1_000_000]
            p, q = cell // ny + lo, cell % ny
            either = fx.digest[p] | fy.digest[q]
            own = ~either | (fx.grp[p] == fy.grp[q])
            cell, p, q, either = cell[own], p[own], q[own], either[own]
            both, n = k.reshape(-1)[cell].astype(np.int64), x.n[p] + y.n[q]
            less = np.minimum(x.n[p], y.n[q])
            alike = (np.bitwise_count((x.hash[p] ^ y.hash[q]).view(np.uint64)) <= tiles.BITS) & x.known[p] & y.known[q]
            linked = tiles.similar(both, x.n[p], y.n[q]) | (25 * both >= 17 * less) & (less >= 8) | (5 * both >= n) & alike
            entities, events = fx.entities[p] & fy.entities[q], fx.events[p] & fy.events[q]
            acts = (fx.events[p] & fy.events[q]) | (fx.wide[p] & fy.wide[q])
            # rewritten titles; round-ups have no keys to meet by
            new = np.flatnonzero(~linked & (fx.cjk[p] == fy.cjk[q]) & (entities != 0) & (acts != 0) & (~either | (5 * both >= n)))
            linked[new] = ~differ(fx.periods[p[new]], fy.periods[q[new]]) & ~_clash(fx.numbers[p[new]], fy.numbers[q[new]])
            some = np.flatnonzero(linked)
            cell, p, q, either, entities, events = cell[some], p[some], q[some], either[some], entities[some], events[some]
            across = fx.cjk[p] & fy.latin[q] | fy.cjk[q] & fx.latin[p]
            apart = lambda kind, u, v: (getattr(fx, kind)[u] != 0) & (getattr(fy, kind)[v] != 0) & (getattr(fx, kind)[u] & getattr(fy, kind)[v] == 0)
            figures = np.zeros(len(p), bool)
            for kind, which in (("numbers", np.flatnonzero(across)), ("figures", np.flatnonzero(~across))):
                figures[which] = _clash(getattr(fx, kind)[p[which]], getattr(fy, kind)[q[which]])
            shared = np.zeros(len(p), bool)
            if len(keys):
                shared = keys[np.minimum(np.searchsorted(keys, cell), len(keys) - 1)] == cell
            words = with_rare[0][p] & with_rare[1][q] & ~shared
            met = np.flatnonzero(words & across & ~either & (entities != 0) & (events != 0))
            u, v = p[met], q[met]
            words[met] = differ(fx.periods[u], fy.periods[v]) | apart("objects", u, v) | apart("currencies", u, v) | _clash(fx.numbers[u], fy.numbers[v])
            why = np.select([figures, apart("entities", p, q), apart("events", p, q), apart("objects", p, q), words], range(len(REASONS)), -1)
            told = why >= 0
            p, q, why = p[told], q[told], why[told]
            nought += np.bincount(np.concatenate([p, nx + q]) * len(REASONS) + np.tile(why, 2), minlength=len(nought))
    found = np.flatnonzero(nought)
    who = np.concatenate([x.ids, y.ids])[found // len(REASONS)]
    return pa.table({"id": ids.take(pa.array(who)), "against": pa.array(REASONS).take(pa.array(found % len(REASONS))), "n": pa.array(nought[found])})


def opposing(classes: DataFrame) -> DataFrame:
    """(id, against, n): of each title the like ones within WINDOW_DAYS that can't be the same event; pairs stay inside tiles."""
    grams, marked = marked_grams(classes)
    sets = marked.select("id", grams.alias("grams"), "day", F.nullif("simhash", F.lit(0)).alias("hash")).join(noted(classes), "id")
    sets = materialize(sets, "noted")  # read twice
    each = tiles.over(sets, WINDOW_DAYS, opposed, "", "id string, against string, n long", both=False)
    return each.groupBy("id", "against").agg(F.sum("n").alias("n"))


def event_links(classes: DataFrame) -> DataFrame:
    """(a, b, s, against) of the titles within WINDOW_DAYS that may tell of one event."""
    sets = classes.select("id", "grams", "day")
    near = similar_sets(sets, NEAR_JACCARD, WINDOW_DAYS).select("a", "b")
    inside = contained_sets(sets, OVERLAP, OVERLAP_SIZE, WINDOW_DAYS).select("a", "b")
    met = meeting(classes)
    pairs = near.unionByName(inside).unionByName(met).distinct()
    return ruled(classes, pairs, rare_grams(classes))


def _classes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    it = items(spark, folder, "title", "canonical_title", "published_ts", "grp", "simhash")
    title = F.coalesce(F.nullif("canonical_title", F.lit("")), "title")
    day = F.floor(F.coalesce("published_ts", "fetched_ts") / 86400)
    return titled_classes(it.select("id", title.alias("title"), "grp", "simhash", day.alias("day")))


@query("F16_bridge_keys")
def bridge_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of entity and event of each title."""
    members, classes = _classes(spark, folder)
    return members.join(named(classes).withColumnRenamed("id", "class"), "class").select("id", "key")


@query("C04_event_conflicts")
def event_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """For each title the like ones that can't be the same event, by reason."""
    return opposing(_classes(spark, folder)[1])


@query("C03_event_links")
def all_event_links(spark: SparkSession, folder: str) -> DataFrame:
    """How many titles each title is linked with, and the best similarity: all pair rules, conflicts and round-ups."""
    links = linked(_classes(spark, folder)[1])
    return links_of(links, F.col("s")).withColumn("best", F.round("best", 6))


@query("C08_event_clusters")
def event_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """(id, seed): events of titles that are all like their seed and in no conflict with it, so no chain drifts away."""
    members, classes = _classes(spark, folder)
    return members.join(clustered(classes).withColumnRenamed("id", "class"), "class").select("id", "seed")


def clustered(classes: DataFrame) -> DataFrame:
    """(id, seed) of classes of titles."""
    links = linked(classes).select("a", "b")
    return seeded(classes.select("id"), links)


@query("Q17_event_evaluation")
def event_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The events of titles against the delivered clusters: pairs and B-cubed, one row."""
    gold = items(spark, folder, "cluster_id").filter("cluster_id is not null").select("id", F.col("cluster_id").alias("gold"))
    return evaluated(materialize(event_clusters(spark, folder).withColumnRenamed("seed", "predicted").join(gold, "id"), "evaluated"))


def evaluated(labelled: DataFrame) -> DataFrame:
    """(pair_precision, pair_recall, b_precision, b_recall, b_f1) of (predicted, gold); single rows are joined."""
    p = pair_counts(labelled).select(F.try_divide("tp", F.col("tp") + F.col("fp")).alias("pair_precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("pair_recall"))
    b = b_cubed(labelled).select(F.col("precision").alias("b_precision"), F.col("recall").alias("b_recall"), F.col("f1").alias("b_f1"))
    return p.crossJoin(b)
