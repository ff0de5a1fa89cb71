"""k-means over vectors, over PQ sub-spaces, and over one dimension."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from vecpress.functions.arrays import map_batches, reduce_tables, to_lists, to_matrix
from vecpress.operators.knn import _cost, best, ordered_sum
from vecpress.operators.moments import ranges

#: Groups of values for each level, by which places of a codebook's borders are narrowed down.
GROUPS = 32


def nearest(x: np.ndarray, centroids: np.ndarray, spherical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, ties to the lowest number, and its squared distance (or,
    spherical, its inner product)."""
    a, b = best(*_cost("ip" if spherical else "l2", x, centroids), 1)
    exact = -ordered_sum(x[a] * centroids[b]) if spherical else ordered_sum((x[a] - centroids[b]) ** 2)
    order = np.lexsort((b, exact, a))
    first = order[np.searchsorted(a[order], np.arange(len(x)), "left")]
    return b[first], -exact[first] if spherical else exact[first]


def first_rows(x: DataFrame, k: int) -> np.ndarray:
    """The k rows with the smallest ids, as a deterministic start."""
    rows = x.orderBy("vec_id").limit(k).collect()
    return np.array([r["v"] for r in rows], np.float64)


def drawn(x: DataFrame, most: int | None, rows: int | None = None) -> DataFrame:
    """About `most` rows of x by a hash of the id; all of them if that is None or not fewer."""
    if most is None:
        return x
    share = most / max(x.count() if rows is None else rows, 1)
    u = F.xxhash64("vec_id", F.lit(2)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    return x if share >= 1 else x.where(u < share)


def draw(place: int) -> Column:
    """A number from 0 to 1 for each vec_id and place: steps of an odd multiplier around 2**32."""
    return F.pmod(F.pmod("vec_id", F.lit(1 << 31)) * 2654435761 + place * 1013904223, F.lit(1 << 32)) / float(1 << 32)


def _spread(rows: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Numbers of k rows: the heaviest, then each time the one with the most weight by squared
    distance from those that are chosen; ties to the lowest number."""
    chosen = [int(np.argmax(weights))]
    d = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(rows)):
        best = int(np.argmax(weights * d))
        if d[best] == 0:
            break
        chosen.append(best)
        d = np.minimum(d, ((rows - rows[best]) ** 2).sum(1))
    return np.array(chosen)


def spread_rows(x: DataFrame, k: int, rounds: int = 3, seed: int = 0) -> np.ndarray:
    """k rows of x that lie apart, as starts: k-means|| (Bahmani and others).

    From one row drawn, each round draws about 2 k rows, each with a chance in proportion to its
    squared distance from those drawn before, in two passes of sums; the rows nearest to each are
    then its weight, and k of them are picked by weight and distance. Beyond GROUPED starts the
    same is done in two levels: about sqrt(k) groups, each of which picks its share of the k from
    a bounded draw of its rows, a group in each task. A table with fewer different rows gives fewer.
    """
    if k > GROUPED:
        return _spread_in_groups(x, k, rounds, seed)
    first = x.orderBy(draw(seed), "vec_id").limit(1).collect()
    drawn_rows, ids = np.array([r["v"] for r in first], np.float64), {r["vec_id"] for r in first}
    for r in range(1, rounds + 1):
        sent = x.sparkSession.sparkContext.broadcast(drawn_rows)

        def apart(batch, sent=sent) -> dict:
            m = to_matrix(batch.column("v"))
            return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "d": nearest(m, sent.value)[1]}

        phi = reduce_tables(x, lambda m, c=drawn_rows: {"phi": [nearest(m, c)[1].sum()]}, {"phi": np.add})["phi"][0]
        far = map_batches(x.select("vec_id", "v"), apart, "vec_id long, v array<double>, d double")
        got = far.where((F.col("d") > 0) & (draw(seed + r) * float(phi) < 2.0 * k * F.col("d"))).orderBy("vec_id").collect()  # about 2 k rows
        got = [g for g in got if g["vec_id"] not in ids]
        ids |= {g["vec_id"] for g in got}
        if got:
            drawn_rows = np.concatenate([drawn_rows, np.array([g["v"] for g in got], np.float64)])
    weights = reduce_tables(x, lambda m: {"n": np.bincount(nearest(m, drawn_rows)[0], minlength=len(drawn_rows))}, {"n": np.add})["n"]
    return drawn_rows[_spread(drawn_rows, weights, k)]


#: Starts that one level picks, and rows of a group that are drawn for each of its starts.
GROUPED = 2048
DRAWN = 64


def _spread_in_groups(x: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    heads = kmeans(x, round(k**0.5), 2, start=spread_rows(x, round(k**0.5), rounds, seed))
    placed = assign(x, heads).select("vec_id", "cell").join(x, "vec_id")
    sizes = np.bincount([0], minlength=len(heads)) * 0
    for r in placed.groupBy("cell").count().collect():  # a row a group
        sizes[r["cell"]] = r["count"]
    share = np.maximum(1, np.floor(k * sizes / sizes.sum())).astype(int) * (sizes > 0)
    share = np.minimum(share, sizes)
    for g in np.argsort(-sizes, kind="stable").tolist() * 2:
        if share.sum() < k and share[g] < sizes[g]:
            share[g] += min(k - share.sum(), sizes[g] - share[g], max(1, k // len(heads)))
    chance = F.get(F.array(*(F.lit(float(min(1.0, DRAWN * a / n))) if n else F.lit(0.0) for a, n in zip(share, sizes, strict=True))), F.col("cell"))
    wanted = share.tolist()

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        m = to_matrix(rows.column("v"))
        return pa.table({"cell": rows.column("cell").slice(0, 1), "v": to_lists(m[_spread(m, np.ones(len(m)), wanted[rows.column("cell")[0].as_py()])].reshape(1, -1))})

    got = placed.where(draw(seed) < chance).groupBy("cell").applyInArrow(pick, "cell int, v array<double>").orderBy("cell").collect()
    return np.concatenate([np.array(r["v"]).reshape(-1, heads.shape[1]) for r in got])[:k]


class Grouped:
    """Nearest centroids without touching most of them. Centroids lie in about sqrt(k) groups about
    heads; by the triangle inequality a row is no nearer to any of a group than to its head less
    the group's radius, so groups beyond the best distance so far are left out. Equal to `nearest`."""

    def __init__(self, centroids: np.ndarray, groups: int | None = None):
        self.centroids = centroids
        g = groups or max(1, round(len(centroids) ** 0.5))
        heads = centroids[_spread(centroids, np.ones(len(centroids)), g)]
        for _ in range(3):
            own, _ = nearest(centroids, heads)
            n = np.bincount(own, minlength=len(heads))[:, None]
            total = np.zeros_like(heads)
            np.add.at(total, own, centroids)
            heads = np.where(n > 0, total / np.maximum(n, 1), heads)
        own, d = nearest(centroids, heads)
        self.members = [np.flatnonzero(own == i) for i in range(len(heads))]
        some = [i for i, m in enumerate(self.members) if len(m)]
        self.members = [self.members[i] for i in some]
        self.heads, self.radius = heads[some], np.array([np.sqrt(d[m].max()) for m in self.members])
        self.touched = 0

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_heads = np.sqrt(np.maximum(_cost("l2", rows, self.heads)[0], 0))
        # what rounding may have taken from a distance
        off = 1e-7 * (np.sqrt((rows**2).sum(1))[:, None] + np.sqrt((self.heads**2).sum(1))[None, :]) + 1e-12
        least = np.maximum(to_heads - self.radius[None, :] - off, 0)
        best, where = np.full(len(rows), np.inf), np.full(len(rows), len(self.centroids))
        order = np.argsort(to_heads - self.radius[None, :], axis=1)
        for turn in range(len(self.heads)):
            # each row looks at its next nearest group, as long as that may hold a nearer centroid
            group = order[:, turn]
            open_rows = np.flatnonzero(least[np.arange(len(rows)), group] ** 2 <= best)
            if not len(open_rows):
                break
            for g in np.unique(group[open_rows]):
                own = open_rows[group[open_rows] == g]
                cell, d = nearest(rows[own], self.centroids[self.members[g]])
                cell = self.members[g][cell]
                self.touched += len(own) * len(self.members[g])
                better = (d < best[own]) | ((d == best[own]) & (cell < where[own]))
                best[own[better]], where[own[better]] = d[better], cell[better]
        return where, best


#: From so many centroids on rows look for the nearest by groups.
GROUP_FROM = 256


def finder(centroids: np.ndarray, spherical: bool = False) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """`nearest` for these centroids, by groups if there are many."""
    if spherical or len(centroids) < GROUP_FROM:
        return partial(nearest, centroids=centroids, spherical=spherical)
    return Grouped(centroids).nearest


def kmeans(x: DataFrame, k: int, iterations: int = 10, spherical: bool = False, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's iterations from the first k rows, or from `start`; an empty cell keeps its centroid."""
    c = first_rows(x, k) if start is None else start
    for _ in range(iterations):
        sent = x.sparkSession.sparkContext.broadcast(finder(c, spherical))

        def fold(m: np.ndarray, sent=sent, shape: tuple = c.shape) -> dict[str, np.ndarray]:
            own, _ = sent.value(m)
            total = np.zeros(shape)
            np.add.at(total, own, m)
            return {"total": total, "n": np.bincount(own, minlength=shape[0])}

        got = reduce_tables(x, fold, {"total": np.add, "n": np.add})
        n = got["n"][:, None]
        c = np.where(n > 0, got["total"].reshape(c.shape) / np.maximum(n, 1), c)
        if spherical:
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def assign(x: DataFrame, centroids: np.ndarray, spherical: bool = False) -> DataFrame:
    """(vec_id, cell, dist)."""
    sent = x.sparkSession.sparkContext.broadcast(finder(centroids, spherical))

    def run(batch) -> dict:
        cell, dist = sent.value(to_matrix(batch.column("v")))
        return {"vec_id": batch.column("vec_id"), "cell": cell.astype(np.int32), "dist": dist}

    return map_batches(x, run, "vec_id long, cell int, dist double")


def pq_train(x: DataFrame, m: int, ksub: int, iterations: int = 10) -> np.ndarray:
    """(m, ksub, D/m) centroids of all sub-spaces, trained together: one pass an iteration."""
    start = first_rows(x, ksub)
    dims = start.shape[1]
    if dims % m:
        raise AssertionError(f"{dims} dimensions do not divide into {m} sub-spaces")
    books = start.reshape(len(start), m, dims // m).transpose(1, 0, 2).copy()
    for _ in range(iterations):

        def fold(rows: np.ndarray, books: np.ndarray = books) -> dict[str, np.ndarray]:
            parts = rows.reshape(len(rows), m, -1)
            total, n = np.zeros_like(books), np.zeros(books.shape[:2])
            for j in range(m):
                own, _ = nearest(parts[:, j], books[j])
                np.add.at(total[j], own, parts[:, j])
                n[j] += np.bincount(own, minlength=books.shape[1])
            return {"total": total, "n": n}

        got = reduce_tables(x, fold, {"total": np.add, "n": np.add})
        n = got["n"].reshape(m, -1, 1)
        books = np.where(n > 0, got["total"].reshape(books.shape) / np.maximum(n, 1), books)
    return books


def pq_train_rows(rows: np.ndarray, m: int, ksub: int, iterations: int = 10) -> np.ndarray:
    """`pq_train` on a matrix: starts from its first rows; with fewer rows than centroids each row
    is one, and the last one fills the rest."""
    if rows.shape[1] % m:
        raise AssertionError(f"{rows.shape[1]} dimensions do not divide into {m} sub-spaces")
    parts = rows.reshape(len(rows), m, -1).transpose(1, 0, 2)
    out = np.empty((m, ksub, parts.shape[2]))
    for j, part in enumerate(parts):
        c = part[:ksub].copy()
        for _ in range(iterations if len(part) > len(c) else 0):
            own, _ = nearest(part, c)
            total, n = np.zeros_like(c), np.bincount(own, minlength=len(c))[:, None]
            np.add.at(total, own, part)
            c = np.where(n > 0, total / np.maximum(n, 1), c)
        out[j, : len(c)], out[j, len(c) :] = c, c[-1]
    return out


# --- one dimension -----------------------------------------------------------------------


def lloyd_1d(values: np.ndarray, k: int, iterations: int = 100, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Centroids (rising) and mean squared error, from a start at the quantiles. Sorted values
    and prefix sums make an iteration cost k searches."""
    v = np.sort(np.asarray(values, np.float64))
    if k <= 1:
        return np.array([v.mean()]), float(v.var())
    c = np.quantile(v, (np.arange(k) + 0.5) / k)
    sums = np.concatenate([[0.0], np.cumsum(v)])
    for _ in range(iterations):
        edges = np.concatenate([[0], np.searchsorted(v, (c[1:] + c[:-1]) / 2, "left"), [len(v)]])
        n = np.diff(edges)
        new = np.where(n > 0, np.diff(sums[edges]) / np.maximum(n, 1), c)
        moved, c = np.abs(new - c).max(), new
        if moved < tolerance:
            break
    return c, float(np.mean((v - c[levels_of(v, c)]) ** 2))


def levels_of(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest of rising centroids; a midpoint goes to the lower one."""
    return np.searchsorted((centroids[1:] + centroids[:-1]) / 2, values, "left")


def _cell_cost(s0: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Squared error of one cell over places i..j-1, from running sums."""

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.maximum(s2[j] - s2[i] - (s1[j] - s1[i]) ** 2 / np.maximum(s0[j] - s0[i], 1e-300), 0)

    return cost


def _next_layer(layer: np.ndarray, cost: Callable, lo: int, hi: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Least layer[i] + cost(i, end) of each end lo..hi over cuts i in a..b before it, and the cuts. Cuts
    move one way with their ends, so a layer is solved by halving, all segments of a level at once."""
    new, cut = np.full(len(layer), np.inf), np.zeros(len(layer), np.int32)
    lo, hi, a, b = (np.array([e]) for e in (lo, hi, a, b))
    while len(lo):
        mid = (lo + hi) // 2
        size = np.minimum(b, mid - 1) - a + 1
        start = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(start - a, size)
        total = layer[i] + cost(i, np.repeat(mid, size))
        least = np.minimum.reduceat(total, start)
        at = np.flatnonzero(total == np.repeat(least, size))
        own = i[at[np.searchsorted(at, start)]]
        new[mid], cut[mid] = least, own
        lo, hi, a, b = (np.concatenate(e) for e in ((lo, mid + 1), (mid - 1, hi), (a, own), (own, b)))
        lo, hi, a, b = (e[lo <= hi] for e in (lo, hi, a, b))
    return new, cut


def _bounds(sums: list[np.ndarray], most: int, inner: np.ndarray) -> list[np.ndarray]:
    """For each of 1..most cells and each end, no more than the error of so many cells over the groups
    before it: a border inside one of the `inner` groups leaves that whole group out of the sum."""
    cost, n = _cell_cost(*sums), len(inner)
    layers = [np.concatenate([[0.0], cost(np.zeros(n, int), np.arange(1, n + 1))])]
    for _ in range(1, most):
        base = layers[-1].copy()
        base[1:] = np.minimum(base[1:], np.where(inner, layers[-1][:-1], np.inf))
        layers.append(np.minimum(base, _next_layer(base, cost, 1, n, 0, n - 1)[0]))
    return layers


def _windows(v: np.ndarray, sums: list[np.ndarray], ks: list[int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """For each k the least and largest place that each border of an optimal partition can have. Groups
    of values bound the error of all partitions with a border at some place from below, and the
    best partition along groups bounds the optimum from above; where the first is more, no border is."""
    n = len(v)
    at = np.unique(np.concatenate([np.linspace(0, n, groups + 1).astype(int), np.searchsorted(v, np.linspace(v[0], v[-1], groups + 1)), [0, n]]))
    part, inner, most = [e[at] for e in sums], np.diff(at) > 1, max(ks)
    along = _bounds(part, most, np.zeros(len(inner), bool))
    left = _bounds(part, most, inner)
    right = [e[::-1] for e in _bounds([e[-1] - e[::-1] for e in part], most, inner[::-1])]
    out = {}
    for k in ks:
        limit = along[k - 1][-1] * (1 + 1e-9) + 1e-12 * sums[2][-1]  # more than rounding
        out[k] = []
        for j in range(1, k):
            edge = at[left[j - 1] + right[k - j - 1] <= limit]
            inside = np.flatnonzero(inner & (left[j - 1][:-1] + right[k - j - 1][1:] <= limit))
            places = np.concatenate([edge, at[inside] + 1, at[inside + 1] - 1])
            out[k].append((max(j, int(places.min())), min(n - k + j, int(places.max()))))
    return out


def exact_1d(values: np.ndarray, ks: list[int], weights: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Optimal centroids for each k in ks, by dynamic programming over sorted values.

    Optimal cells are contiguous. Of many values only those places are tried as borders that bounds by
    groups of values leave open (`_windows`). k beyond the distinct values gives those values.
    """
    v, at = np.unique(np.asarray(values, np.float64), return_inverse=True)
    w = np.bincount(at, weights if weights is not None else None, len(v)).astype(np.float64)
    n = len(v)
    sums = [np.concatenate([[0.0], np.cumsum(w * v**p)]) for p in (0, 1, 2)]
    cost, inner = _cell_cost(*sums), sorted({k for k in ks if 1 < k < n})
    groups = GROUPS * max(inner, default=0)
    windows = _windows(v, sums, inner, groups) if inner and n > 4 * groups else {}
    out = {k: v if k >= n else sums[1][-1:] / sums[0][-1:] for k in ks}
    whole, cuts = np.concatenate([[0.0], cost(np.zeros(n, int), np.arange(1, n + 1))]), []
    for k in inner:
        if not windows:
            layer = whole if not cuts else layer  # one run of layers serves all k
            for j in range(len(cuts) + 2, k + 1):
                layer, cut = _next_layer(layer, cost, j, n, j - 1, n - 1)
                cuts.append((0, cut))
        else:
            (a, b), cuts = windows[k][0], []
            layer = np.full(n + 1, np.inf)
            layer[a : b + 1] = whole[a : b + 1]
            for lo, hi in [*windows[k][1:], (n, n)]:
                lo = max(lo, a + 1)
                layer, cut = _next_layer(layer, cost, lo, hi, a, b)
                cuts.append((lo, cut[lo : hi + 1].copy()))
                a, b = lo, hi
        edges = [n]
        for lo, cut in reversed(cuts):
            edges.append(int(cut[edges[-1] - lo]))
        edges = np.array([0, *edges[::-1]])
        out[k] = np.diff(sums[1][edges]) / np.diff(sums[0][edges])
    return out


def histogram_1d(values: np.ndarray, ks: list[int], bins: int = 500) -> dict[int, np.ndarray]:
    """Centroids by the same programme over the means of equal-width bins, empty ones left out."""
    v = np.asarray(values, np.float64)
    width = (v.max() - v.min()) / bins
    own = np.zeros(len(v), int) if width == 0 else np.minimum(((v - v.min()) / width).astype(int), bins - 1)
    n = np.bincount(own, minlength=bins)
    used = n > 0
    return exact_1d(np.bincount(own, v, bins)[used] / n[used], ks, n[used])


def histograms(x: DataFrame, bins: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums (D, bins) of all rows in equal-width bins of each dimension."""
    low, high = (e[:, None] for e in ranges(x))
    width = (high - low) / bins

    def fold(m: np.ndarray) -> dict[str, np.ndarray]:
        own = np.where(width == 0, 0, np.minimum((m.T - low) / np.where(width == 0, 1, width), bins - 1)).astype(int)
        flat = (own + np.arange(len(own))[:, None] * bins).ravel()
        return {"n": np.bincount(flat, minlength=len(own) * bins), "total": np.bincount(flat, m.T.ravel(), len(own) * bins)}

    got = reduce_tables(x, fold, {"n": np.add, "total": np.add})
    return got["n"].reshape(-1, bins), got["total"].reshape(-1, bins)


def per_dimension(x: DataFrame, bits: list[int], method: str = "lloyd", sample: int | None = None, restarts: int = 0, seed: int = 0, of: list[int] | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Codebook of each (dimension, bits), or with `of` only of each dimension's own bits, trained on all rows, or on about `sample` drawn by a
    hash of the id. 0 bits is the single level 0. Rows are counted where they are; lloyd and exact
    levels are those on the values themselves (`codebooks`; exact ones of over WHOLE rows almost), histogram levels those on the means of
    500 bins. restarts, seed: more starts of lloyd. Drawn or not, rows are kept while passes need them."""
    from vecpress.operators import codebooks

    x = drawn(x, sample)
    some = [b for b in bits if b]
    books: dict[tuple[int, int], np.ndarray] = {}
    if method == "histogram":
        counted = list(zip(*histograms(x), strict=True))
        for d, (n, total) in enumerate(counted):
            used = n > 0
            found = exact_1d(total[used] / n[used], [1 << b for b in some], n[used]) if some else {}
            books |= {(d, b): np.sort(found[1 << b]) for b in some}
        dims = len(counted)
    else:
        x = x.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            first = x.select("v").head()
            if first is None:
                raise ValueError("no vectors to fit on")
            dims = len(first[0])
            wanted = [(d, 1 << b) for d in range(dims) for b in some if of is None or of[d] == b]
            held = x.count() <= codebooks.WHOLE
            if method == "exact" and held:
                best = codebooks.exact_by_dimension(x, wanted)
            elif method == "exact":
                found = codebooks.exact(x, [1 << b for b in some])
                best = {(d, k): found[k][d] for d, k in wanted}
            elif held:
                best = codebooks.lloyd_by_dimension(x, wanted, restarts, seed)
            else:
                best = codebooks.lloyd_of(codebooks.Bins(x), wanted, restarts=restarts, seed=seed)
            books |= {(d, k.bit_length() - 1): np.sort(c) for (d, k), c in best.items()}
        finally:
            x.unpersist()
    if 0 in bits:
        books |= {(d, 0): np.zeros(1) for d in range(dims)}
    return books
