"""Links between the sets of near days, found inside tasks: pairs never leave the task that finds them.

Reports of one kind have most of their words in common, so the linked pairs of a day grow with
the square of its titles, while the results (counts, best partners, groups) don't. The sets of
a day are packed into a few rows; a tile is one of these packs against those of the days
around. Inside a tile a set falls into its common grams, the core, and the rest. Sets of equal
core and size form a class, and two sets that share no gram of the rest share what their
classes share. So classes are held against each other by a product of matrices, and only pairs
that share a gram of the rest, hold each other, or have near fingerprints are looked at one by
one. No gram is capped and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.session import materialize, release

#: Sets in a pack: bounds the memory of a tile.
PACK = 12_000
#: Sets of a tile, and pairs looked at one by one, taken at once; grams in a core at most.
ROWS, PAIRS, CORE = 512, 2_000_000, 768
BITS, BANDS = 6, 7


@dataclass
class Sets:
    """Sets as arrays: their grams one after another by number, with the row of each."""

    ids: np.ndarray
    row: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    hash: np.ndarray
    known: np.ndarray
    note: list[bytes]


def pack(key: tuple, t: pa.Table) -> pa.Table:
    """One row of a day's part: ids, grams by number with their dictionary, fingerprints."""
    grams = t["grams"].combine_chunks()
    coded = grams.flatten().dictionary_encode()
    lists = {"id": t["id"].combine_chunks(), "n": grams.value_lengths(), "code": coded.indices, "gram": coded.dictionary, "hash": t["hash"].combine_chunks()} | {c: t[c].combine_chunks() for c in t.column_names if c == "note"}
    batch = pa.table({k: pa.array([v], pa.list_(v.type)) if len(v) == 0 else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in lists.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(batch)
    return pa.table({"day": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def unpack(sides: list[list[bytes]]) -> tuple[list[Sets], pa.Array, pa.Array]:
    """The sets of each side with common numbers for grams and ids; the dictionaries of grams and of ids."""
    read = [[pa.ipc.open_stream(b).read_all().combine_chunks() for b in blobs] for blobs in sides]
    flat = lambda t, c: t[c].combine_chunks().flatten()
    every = [t for side in read for t in side]
    grams = pa.concat_arrays([flat(t, "gram") for t in every]).dictionary_encode()
    ids = pa.concat_arrays([flat(t, "id") for t in every]).dictionary_encode()
    gram_no, id_no, g, i, out = grams.indices.to_numpy(), ids.indices.to_numpy(), 0, 0, []
    for side in read:
        parts = []
        for t in side:
            n, m = flat(t, "n").to_numpy().astype(np.int64), len(flat(t, "gram"))
            h = flat(t, "hash")
            parts.append((id_no[i : i + len(n)], gram_no[g : g + m][flat(t, "code").to_numpy()], n, h.fill_null(0).to_numpy(zero_copy_only=False), h.is_valid().to_numpy(zero_copy_only=False)))
            g, i = g + m, i + len(n)
        who, gram, n, h, known = (np.concatenate(x) for x in zip(*parts))
        note = [v for t in side if "note" in t.column_names for v in flat(t, "note").to_pylist()]
        out.append(Sets(who.astype(np.int64), np.repeat(np.arange(len(n)), n), gram.astype(np.int64), n, h, known, note))
    return out, grams.dictionary, ids.dictionary


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + counts[i] - 1 of all i, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each comes; by sorting, which is faster than numpy's unique here."""
    keys = np.sort(keys)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.diff(np.append(begin, len(keys)))


def chunks(counts: np.ndarray, most: int, rows: int) -> Iterator[slice]:
    """Slices of so many rows at most, whose counts sum to no more than `most` where one row doesn't."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + most, "right")), at + 1), at + rows)
        yield slice(at, to)
        at = to


class Index:
    """The rows of given keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]

    def count(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(self.keys, keys, "left")
        return first, np.searchsorted(self.keys, keys, "right") - first


@dataclass
class Block:
    """Some sets of a tile against all of its other side.

    By class: `near` are pairs of a class and a class of the other side whose cores alone link
    them, with their similarity. By pair: `x`, `y` with similarity `s`, true `linked`, and
    `counted`, whether their classes are among `near`. All similarities that aren't by pair are right.
    """

    rows: np.ndarray
    cls: np.ndarray
    near: tuple[np.ndarray, np.ndarray, np.ndarray]
    x: np.ndarray
    y: np.ndarray
    s: np.ndarray
    linked: np.ndarray
    counted: np.ndarray


def similar(k: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Shared over all grams is 0.42 or more, in whole numbers."""
    return 71 * k >= 21 * (nx + ny)


def blocks(x: Sets, y: Sets, grams: pa.Array, rule: str, core: int | None = None) -> Iterator[tuple[Block, np.ndarray]]:
    """The blocks of a tile, each with the class of every row of `y`.

    Rules: similar (0.42), figures (similar, figures named by both and none in common), prints
    (similar, or fingerprints near at 0.25), cascade (those of prints, and containment), agreed
    (those of cascade without pairs whose figures contradict each other).
    """
    size = len(grams)
    nx, ny = len(x.n), len(y.n)
    in_x, in_y = np.bincount(x.gram, minlength=size), np.bincount(y.gram, minlength=size)
    met = in_x * in_y
    order = np.argsort(-met, kind="stable")
    left = met.sum() - np.cumsum(met[order])
    enough = int(np.searchsorted(-left, -max(100_000, nx * ny // 100))) + 1 if met.sum() > 100_000 else 0
    picked = order[: min(CORE, enough) if core is None else core]
    figure = np.array([g[:1] in "0123456789" and g != "" for g in grams.to_pylist()], bool) if rule in ("figures", "agreed") else np.zeros(size, bool)
    place = np.full(size, -1)
    place[picked] = np.arange(len(picked))

    # classes of equal core and size over both sides
    has = np.zeros((nx + ny, len(picked)), bool)
    named = np.zeros(nx + ny, bool)
    for s, base in ((x, 0), (y, nx)):
        own = place[s.gram] >= 0
        has[base + s.row[own], place[s.gram[own]]] = True
        named[base + s.row[figure[s.gram]]] = True
    n = np.concatenate([x.n, y.n])
    key = np.ascontiguousarray(np.hstack([np.packbits(has, axis=1), n.astype("<i4").view(np.uint8).reshape(-1, 4), named[:, None].view(np.uint8)]))
    _, first, cls = np.unique(key.view(np.dtype((np.void, key.shape[1]))).ravel(), return_index=True, return_inverse=True)
    cls = cls.ravel()
    cx, cy = cls[:nx], cls[nx:]
    weight = np.bincount(cy, minlength=len(first))
    cols = np.flatnonzero(weight)
    col = np.full(len(first), -1)
    col[cols] = np.arange(len(cols))
    matrix, cn, cnamed = has[first].astype(np.float32), n[first], named[first]
    right, ncol = np.ascontiguousarray(matrix[cols].T), cn[cols].astype(np.float32)
    figs = figure[picked]
    del has, key

    rest_x, rest_y = place[x.gram] < 0, place[y.gram] < 0
    index = Index(y.gram[rest_y], y.row[rest_y])
    by_class = Index(cy, np.arange(ny))
    me = np.full(int(max(x.ids.max(), y.ids.max())) + 1, -1)
    me[y.ids] = np.arange(ny)
    self_y = me[x.ids]
    bands = []
    if rule in ("prints", "cascade", "agreed"):
        known = np.flatnonzero(y.known)
        bands = [(b, Index((y.hash[known] >> (9 * b)) & 511, known)) for b in range(BANDS)]

    turn = np.argsort(cx, kind="stable")
    offset = np.concatenate([[0], np.cumsum(x.n)])
    cost = np.bincount(x.row[rest_x], weights=in_y[x.gram[rest_x]], minlength=nx).astype(np.int64)
    for at in chunks(cost[turn], PAIRS, ROWS):
        rows = turn[at]
        names, local = np.unique(cx[rows], return_inverse=True)
        shared = matrix[names] @ right
        both = cn[names].astype(np.float32)[:, None] + ncol[None]
        near = 71 * shared >= 21 * both
        if rule in ("figures", "agreed"):
            common = matrix[names][:, figs] @ right[figs]
            apart = cnamed[names][:, None] & cnamed[cols][None] & (common == 0)
            near &= apart if rule == "figures" else ~apart
        # a class of one, the set itself
        mine = col[names]
        alone = np.zeros(len(names), bool)
        alone[local[self_y[rows] >= 0]] = True
        alone &= (mine >= 0) & (weight[names] == 1)
        near[np.flatnonzero(alone), mine[alone]] = False
        r, c = np.nonzero(near)
        k = shared[r, c].astype(np.int64)
        j = k / (cn[names[r]] + cn[cols[c]] - k)

        # pairs to look at one by one
        flat, of = spread(offset[rows], x.n[rows]), np.repeat(np.arange(len(rows)), x.n[rows])
        own = rest_x[flat]
        flat, of = flat[own], of[own]
        begin, count = index.count(x.gram[flat])
        keys = np.repeat(of, count) * ny + index.rows[spread(begin, count)]
        rest, times = distinct(keys)
        found = [rest, np.flatnonzero(self_y[rows] >= 0) * ny + self_y[rows][self_y[rows] >= 0]]
        for b, idx in bands:
            asks = np.flatnonzero(x.known[rows])
            begin, count = idx.count((x.hash[rows[asks]] >> (9 * b)) & 511)
            for part in chunks(count, PAIRS, len(count)):
                p, q = np.repeat(asks[part], count[part]), idx.rows[spread(begin[part], count[part])]
                close = np.bitwise_count((x.hash[rows[p]] ^ y.hash[q]).view(np.uint64)) <= BITS
                found.append(p[close] * ny + q[close])
        if rule in ("cascade", "agreed"):
            least = np.minimum(cn[names].astype(np.float32)[:, None], ncol[None])
            held = (25 * shared >= 17 * least) & (least >= 8) & ~near
            hr, hc = np.nonzero(held & ~apart if rule == "agreed" else held)
            members = np.argsort(local, kind="stable")
            starts = np.searchsorted(local[members], np.arange(len(names) + 1))
            count = starts[hr + 1] - starts[hr]
            p, q = members[spread(starts[hr], count)], np.repeat(cols[hc], count)
            begin, count = by_class.count(q)
            found.append(np.repeat(p, count) * ny + by_class.rows[spread(begin, count)])
        keys, _ = distinct(np.concatenate(found))
        p, q = keys // ny, keys % ny
        own = np.zeros(len(keys), np.int64)
        own[np.searchsorted(keys, rest)] = times
        xc, yc = local[p], col[cy[q]]
        own += shared[xc, yc].astype(np.int64)
        mx, my = x.n[rows[p]], y.n[q]
        j_true = own / (mx + my - own)
        linked, s = similar(own, mx, my), j_true
        if rule in ("figures", "agreed"):
            flat, of = flat[figure[x.gram[flat]]], of[figure[x.gram[flat]]]
            begin, count = index.count(x.gram[flat])
            same, _ = distinct(np.repeat(of, count) * ny + index.rows[spread(begin, count)])
            apart = apart[xc, yc]
            apart[np.searchsorted(keys, same)] = False
        if rule == "figures":
            linked &= apart
        elif rule != "similar":
            s = np.where(linked, np.maximum(j_true, 0.6), 0.0)
            least = np.minimum(mx, my)
            if rule != "prints":
                held = ~linked & (25 * own >= 17 * least) & (least >= 8)
                s[held] = np.maximum(0.9 * (own[held] / least[held]), 0.55)
                linked |= held
            h = np.bitwise_count((x.hash[rows[p]] ^ y.hash[q]).view(np.uint64)).astype(np.int64)
            alike = ~linked & (4 * own >= mx + my - own) & (h <= BITS) & x.known[rows[p]] & y.known[q]
            s[alike] = np.maximum(0.5, 1 - h[alike] / 12)
            linked |= alike
            j = np.maximum(j, 0.6)
            if rule == "agreed":
                linked &= ~apart
        linked &= q != self_y[rows[p]]
        yield Block(rows, local, (r, cols[c], j), p, q, s, linked, near[xc, yc]), cy


def counted(x: Sets, y: Sets, grams: pa.Array, ids: pa.Array, rule: str, core: int | None = None) -> pa.Table:
    """(id, n_links, best) of the sets of x with a link."""
    n, best = np.zeros(len(x.n), np.int64), np.full(len(x.n), -1.0)
    for b, cy in blocks(x, y, grams, rule, core):
        weight = np.bincount(cy)
        r, c, j = b.near
        by, top = np.bincount(r, weights=weight[c], minlength=len(b.rows)), np.full(len(b.rows), -1.0)
        np.maximum.at(top, r, j)
        n[b.rows] = by[b.cls].astype(np.int64) + np.bincount(b.x, weights=b.linked.astype(np.int64) - b.counted, minlength=len(b.rows)).astype(np.int64)
        each = top[b.cls]
        np.maximum.at(each, b.x[b.linked], b.s[b.linked])
        best[b.rows] = each
    some = n > 0
    return pa.table({"id": ids.take(pa.array(x.ids[some])), "n_links": pa.array(n[some]), "best": pa.array(best[some])})


def firsts(group: np.ndarray, most: int) -> np.ndarray:
    """Which of the rows of sorted groups are among the first ones of their group."""
    if not len(group):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group)))) < most


def ranked(x: Sets, y: Sets, grams: pa.Array, ids: pa.Array, rule: str, most: int = 6, core: int | None = None) -> pa.Table:
    """(id, other, s): the most similar sets of each in x, of equally similar ones those of the greater ids."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    rank = place[y.ids]  # as ids go
    out = []
    lists = None
    for b, cy in blocks(x, y, grams, rule, core):
        if lists is None:  # of each class its last ids: one more than wanted, as one may be the set itself
            order = np.lexsort((-rank, cy))
            order = order[firsts(cy[order], most + 1)]
            lists = Index(cy[order], order)
            last = np.full(cy.max() + 1, -1)
            np.maximum.at(last, cy, rank)
        r, c, j = b.near
        j = np.round(j, 9)
        order = np.lexsort((-last[c], -j, r))
        order = order[firsts(r[order], most + 1)]
        begin, count = lists.count(c[order])
        r, j, q = np.repeat(r[order], count), np.repeat(j[order], count), lists.rows[spread(begin, count)]
        order = np.lexsort((-rank[q], -j, r))
        order = order[firsts(r[order], most + 1)]
        r, j, q = r[order], j[order], q[order]
        base = Index(r, np.arange(len(r)))
        begin, count = base.count(b.cls)
        take = base.rows[spread(begin, count)]
        p, q, s = np.repeat(np.arange(len(b.rows)), count), q[take], j[take]
        other = y.ids[q] != x.ids[b.rows[p]]
        p, q, s = (np.concatenate([u[other], v[b.linked]]) for u, v in ((p, b.x), (q, b.y), (s, np.round(b.s, 9))))
        # what was looked at counts, not what its classes say: it is no less
        order = np.lexsort((-s, q, p))
        p, q, s = p[order], q[order], s[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(p) else np.zeros(0, bool)
        p, q, s = p[new], q[new], s[new]
        order = np.lexsort((-rank[q], -s, p))
        order = order[firsts(p[order], most)]
        out.append((x.ids[b.rows[p[order]]], y.ids[q[order]], s[order]))
    who, other, s = (np.concatenate(v) for v in zip(*out))
    return pa.table({"id": ids.take(pa.array(who)), "other": ids.take(pa.array(other)), "s": pa.array(s)})


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links of a with b: the least of each group."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, further := label[label]):
            label = further
    return label


def grouped(x: Sets, y: Sets, grams: pa.Array, ids: pa.Array, rule: str, core: int | None = None) -> pa.Table:
    """(a, b): as many links as hold the groups of a tile together."""
    label = None
    for b, cy in blocks(x, y, grams, rule, core):
        items, classes = len(ids), int(cy.max()) + 1
        if label is None:  # the ids, then a node for each class of y
            label = np.arange(items + classes)
            seen = np.zeros(classes, bool)
        r, c, _ = b.near
        # a class of x is linked with all of the classes near it: its sets meet the first of them, and these each other
        first = np.full(len(b.rows), -1)
        first[r[::-1]] = c[::-1]
        own = first[b.cls]
        seen[c] = True
        some = own >= 0
        a = np.concatenate([items + c, x.ids[b.rows[some]], x.ids[b.rows[b.x[b.linked]]]])
        o = np.concatenate([items + first[r], items + own[some], y.ids[b.y[b.linked]]])
        label = merge(label, a, o)
    label = merge(label, y.ids[seen[cy]], items + cy[seen[cy]])
    root = label[:items]
    least = np.full(len(label), len(label))
    np.minimum.at(least, root, np.arange(items))
    some = least[root] != np.arange(items)
    return pa.table({"a": ids.take(pa.array(np.flatnonzero(some))), "b": ids.take(pa.array(least[root][some]))})


def earliest(x: Sets, y: Sets, grams: pa.Array, ids: pa.Array, rule: str, core: int | None = None) -> pa.Table:
    """(id, other): the least of the sets that each in x is linked with, where that is less than it."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    rank, least, first = place[y.ids], None, np.full(len(x.n), len(ids))
    for b, cy in blocks(x, y, grams, rule, core):
        if least is None:
            least = np.full(int(cy.max()) + 1, len(ids))
            np.minimum.at(least, cy, rank)
        r, c, _ = b.near
        top = np.full(len(b.rows), len(ids))
        np.minimum.at(top, r, least[c])
        each = top[b.cls]
        np.minimum.at(each, b.x[b.linked], rank[b.y[b.linked]])
        first[b.rows] = each
    some = first < place[x.ids]
    named = np.argsort(place)
    return pa.table({"id": ids.take(pa.array(x.ids[some])), "other": ids.take(pa.array(named[first[some]]))})


#: Links to smaller ids that a set hands on from a tile; of a set with more only the fact is known. Rows of links resolved at once.
MANY, RESOLVED = 16, 1_000_000


def smaller(x: Sets, y: Sets, grams: pa.Array, ids: pa.Array, rule: str, core: int | None = None) -> pa.Table:
    """(id, other): the smaller ones that each in x is linked with; null for other where these are more than MANY."""
    size = len(ids)
    place = np.empty(size, np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(size)
    rank_x, rank, out, members = place[x.ids], place[y.ids], [], None
    for b, cy in blocks(x, y, grams, rule, core):
        if members is None:
            members = np.sort(cy * size + rank)
            least = np.full(int(cy.max()) + 1, size)
            np.minimum.at(least, cy, rank)
        own = rank_x[b.rows]
        r, c, _ = b.near
        last = np.full(int(b.cls.max()) + 1, -1)
        np.maximum.at(last, b.cls, own)
        some = least[c] < last[r]
        of_class = Index(r[some], c[some])
        begin, count = of_class.count(b.cls)
        row, c = np.repeat(np.arange(len(b.rows)), count), of_class.rows[spread(begin, count)]
        begin = np.searchsorted(members, c * size)
        count = np.searchsorted(members, c * size + own[row]) - begin
        single = b.linked & ~b.counted
        p, q = b.x[single], rank[b.y[single]]
        p, q = p[q < own[p]], q[q < own[p]]
        many = np.bincount(row, weights=count, minlength=len(b.rows)) + np.bincount(p, minlength=len(b.rows)) > MANY
        few = ~many[row]
        row, begin, count = row[few], begin[few], count[few]
        p, q = p[~many[p]], q[~many[p]]
        out.append((b.rows[np.concatenate([np.repeat(row, count), p, np.flatnonzero(many)])], np.concatenate([members[spread(begin, count)] % size, q, np.full(many.sum(), -1)])))
    who, other = (np.concatenate(v) for v in zip(*out))
    named = np.argsort(place)
    return pa.table({"id": ids.take(pa.array(x.ids[who])), "other": ids.take(pa.array(named[other], mask=other < 0))})


def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id) of the seeds among the sets with smaller partners, as far as (id, other) of one task tell."""
    t = pa.Table.from_batches(batches, pa.schema([("id", pa.string()), ("other", pa.string())])).combine_chunks()
    both = pa.chunked_array([*t["id"].chunks, *t["other"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    a, b = code[: len(t)], code[len(t) :]
    state = np.zeros(len(both.dictionary) + 1, np.int8)  # open, seed, closed; the last one, of which nothing is known, stays open
    behind = np.zeros(len(state), bool)
    behind[a] = True
    while True:
        blocked = np.zeros(len(state), bool)
        blocked[a[state[b] == 0]] = True
        blocked[-1] = True
        new = np.flatnonzero((state == 0) & ~blocked)
        if not len(new):
            break
        state[new] = 1
        state[a[state[b] == 1]] = 2
    yield from pa.table({"id": both.dictionary.take(pa.array(np.flatnonzero((state == 1) & behind)))}).to_batches()


#: Before a gram that is rare; a fingerprint that asks for all pairs of a set from 0.25 on.
MARK, ANY = "\u0001", -1


def akin(x: Sets, y: Sets, grams: pa.Array, ids: pa.Array, rule: str = "") -> pa.Table:
    """(a, b), a < b: pairs by the rules of cascade that share a marked gram or of which one has none."""
    nx, ny = len(x.n), len(y.n)
    marked = np.array([g.startswith(MARK) for g in grams.to_pylist()], bool)
    plain = np.cumsum(~marked) - 1
    words = (int((~marked).sum()) + 63) // 64 or 1
    bits = []
    for s, n in ((x, nx), (y, ny)):
        has = np.zeros((n, words * 64), bool)
        own = ~marked[s.gram]
        has[s.row[own], plain[s.gram[own]]] = True
        bits.append(np.packbits(has, axis=1).view(np.uint64))
        del has
    rare_x, rare_y = marked[x.gram], marked[y.gram]
    index = Index(y.gram[rare_y], y.row[rare_y])
    lone_x, lone_y = (np.bincount(s.row[r], minlength=len(s.n)) == 0 for s, r in ((x, rare_x), (y, rare_y)))
    lonely = np.flatnonzero(lone_y)
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    in_y = np.bincount(y.gram[rare_y], minlength=len(grams))
    cost = np.bincount(x.row[rare_x], weights=in_y[x.gram[rare_x]], minlength=nx).astype(np.int64) + np.where(lone_x, ny, len(lonely))
    row, gram, out = x.row[rare_x], x.gram[rare_x], []
    for at in chunks(cost, PAIRS // 4, ROWS):
        flat = slice(*np.searchsorted(row, (at.start, at.stop)))
        begin, count = index.count(gram[flat])
        keys, times = distinct(np.repeat(row[flat], count) * ny + index.rows[spread(begin, count)])
        rows = np.arange(at.start, at.stop)
        alone = rows[lone_x[rows]]
        every, _ = distinct(np.concatenate([keys, np.repeat(alone, ny) * ny + np.tile(np.arange(ny), len(alone)), np.repeat(rows, len(lonely)) * ny + np.tile(lonely, len(rows))]))
        k = np.zeros(len(every), np.int64)
        k[np.searchsorted(every, keys)] = times
        p, q = every // ny, every % ny
        later = place[x.ids[p]] < place[y.ids[q]]
        p, q, k = p[later], q[later], k[later]
        for w in range(words):
            k += np.bitwise_count(bits[0][p, w] & bits[1][q, w])
        least = np.minimum(x.n[p], y.n[q])
        hx, hy = x.hash[p], y.hash[q]
        alike = (np.bitwise_count((hx ^ hy).view(np.uint64)) <= BITS) & x.known[p] & y.known[q] | (hx == ANY) | (hy == ANY)
        near = similar(k, x.n[p], y.n[q]) | (25 * k >= 17 * least) & (least >= 8) | (5 * k >= x.n[p] + y.n[q]) & alike
        out.append((x.ids[p[near]], y.ids[q[near]]))
    a, b = (np.concatenate(v) for v in zip(*out))
    return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})


def packed(sets: DataFrame) -> DataFrame:
    """(day, part, blob) of (id, grams, day, hash), with a note of bytes or without, one row a part; written down."""
    many = sets.groupBy("day").agg(F.ceil(F.count("*") / PACK).alias("parts"))
    split = sets.join(many, "day").select("id", "grams", "day", "hash", *(c for c in sets.columns if c == "note"), F.pmod(F.xxhash64("id"), "parts").alias("part"))
    return materialize(split.groupBy("day", "part").applyInArrow(pack, "day long, part long, blob binary"), "packs")


def tiles(packs: DataFrame, days: int, both: bool = True, against: DataFrame | None = None) -> DataFrame:
    """(day, p, q, sides) of packs: a part of a day's sets against one part of each of the days around, or of those from it on.

    The other side are the same packs, or those of `against`.
    """
    spark = packs.sparkSession
    around = packs if against is None else against
    home, other = packs.select("day", F.col("part").alias("p")), around.select(F.col("day").alias("d"), F.col("part").alias("q"))
    other = other.select("d", "q", F.explode(F.sequence(F.col("d") - days, F.col("d") + (days if both else 0))).alias("day"))
    met = other.join(home, "day")
    wanted = met.select("day", "p", "q", "d", F.col("q").alias("part"), F.lit(1).alias("side"))
    own = met.select("day", "p", "q", F.col("day").alias("d"), F.col("p").alias("part"), F.lit(0).alias("side")).distinct()
    of = lambda names, blobs: names.join(blobs.withColumnRenamed("day", "d"), ["d", "part"]).select("day", "p", "q", F.struct("side", "blob").alias("s"))
    full = of(wanted.unionByName(own), packs) if against is None else of(wanted, around).unionByName(of(own, packs))
    # a number of its own, as tasks with few bytes aren't short here
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(tasks, "day", "p", "q").groupBy("day", "p", "q").agg(F.collect_list("s").alias("sides")).select("sides")


def over(sets: DataFrame, days: int, work: Callable[..., pa.Table], rule: str, schema: str, both: bool = True) -> DataFrame:
    """What `work` makes of all tiles of (id, grams, day, hash)."""
    return worked(tiles(packed(sets), days, both), work, rule, schema)


def worked(met: DataFrame, work: Callable[..., pa.Table], rule: str, schema: str) -> DataFrame:
    """What `work` makes of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch["sides"]:
                blobs = [[s["blob"] for s in sides.as_py() if s["side"] == side] for side in (0, 1)]
                (x, y), grams, ids = unpack(blobs)
                yield from work(x, y, grams, ids, rule).to_batches()

    return met.mapInArrow(run, schema)


def links(sets: DataFrame, days: int, rule: str) -> DataFrame:
    """(id, n_links, best) of the sets that have a link."""
    each = over(sets, days, counted, rule, "id string, n_links long, best double")
    return each.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max("best").alias("best"))


def best(sets: DataFrame, days: int, rule: str, most: int) -> DataFrame:
    """(id, other, s): of each set the best, and more where a day is in parts."""
    return over(sets, days, partial(ranked, most=most), rule, "id string, other string, s double")


def chained(sets: DataFrame, days: int, rule: str) -> DataFrame:
    """(a, b): links that join the same groups as all links do."""
    return over(sets, days, grouped, rule, "a string, b string", both=False)


def sharing(sets: DataFrame, days: int) -> DataFrame:
    """(a, b) of the pairs of (id, grams, day, hash) that `akin` finds."""
    return over(sets, days, akin, "", "a string, b string")


def seeds(sets: DataFrame, days: int, rule: str) -> DataFrame:
    """(id, seed) of (id, grams, day, hash): groups around seeds, as `clustering.seeded` has them, without a table of links.

    Every round looks at the open sets of the least ids: those whose smaller open partners are all
    closed are seeds, and close their partners among all. The first rounds take few sets, so the
    seeds of large groups close these before their sets meet each other. A set with many smaller
    partners waits for the next round. A closed set may still find a smaller seed while open sets
    are less than its own.
    """
    left = materialize(sets.select("id", "grams", "day", "hash", F.lit(None).cast("string").alias("seed")), "seeds-left")
    none = F.col("seed").isNull()
    done, share = [], 64
    while True:
        n, low = left.filter(none).agg(F.count("*"), F.min("id")).first()
        if not n:
            done.append(left.select("id", "seed"))
            break
        done.append(left.filter(F.col("seed") < low).select("id", "seed"))
        left = left.filter(none | (F.col("seed") > low))
        some = left.filter(none).select("id", "grams", "day", "hash")
        if share > 1:  # up to about one of `share`; any bound gives the same seeds
            marks = sorted(r[0] for r in some.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // 2000))) == 0).select("id").collect())
            if marks:
                some = some.filter(F.col("id") <= marks[len(marks) // share])
            share //= 8
        mine = packed(some)
        links = materialize(worked(tiles(mine, days), smaller, rule, "id string, other string"), "seeds-links")
        new = some.join(links.select("id").distinct(), "id", "left_anti")
        if links.count() <= RESOLVED:
            new = new.unionByName(some.join(links.coalesce(1).mapInArrow(resolved, "id string"), "id", "left_semi"))
        new = materialize(new, "seeds-new")
        release(mine)
        release(links)
        done.append(new.select("id", F.col("id").alias("seed")))
        rest = left.join(new.select("id"), "id", "left_anti")
        theirs, packs = packed(new), packed(rest.select("id", "grams", "day", "hash"))
        hits = worked(tiles(packs, days, against=theirs), earliest, rule, "id string, other string").groupBy("id").agg(F.min("other").alias("other"))
        left = materialize(rest.join(hits, "id", "left").withColumn("seed", F.least("seed", "other")).drop("other"), "seeds-left")
        release(theirs)
        release(packs)
    return reduce(DataFrame.unionByName, done)
