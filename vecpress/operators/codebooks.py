"""Codebooks of single dimensions from counts of all rows.

One pass counts the values of each dimension in bins: how many, their sum, least and largest. What
a codebook needs is then asked of the bins alone, and where the answer hangs on values inside one
(a border of two cells, or an order statistic, falls between its least and largest value) further
passes split just those bins, each into up to SPLIT parts, until it hangs on none. So results are
those on the values themselves (of `exact`, almost), while a task sends one table of counts and no task or driver holds
a dimension's values. A bin of one value is never split. Levels of a table of at most WHOLE
rows are found by dimension instead, in one pass, by the same steps on single values.

`lloyd` moves all dimensions, and all numbers of levels, in the same passes; it starts from quantiles, or with restarts from seeded ones too, and keeps the start of least
error; `exact` runs the dynamic programme over the bins, a dimension in each task, and splits bins
until each border between its cells lies beside whole bins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecpress.functions.arrays import ROWS, map_batches, reduce_tables, to_lists, to_matrix
from vecpress.operators import kmeans, moments

BINS = 4096
#: Parts of a bin that is split, and counts that one pass makes at most, about.
SPLIT = 256
COUNTS = 4 << 20
#: Rows up to which one task holds the values of a dimension: 8 MB, and 40 MB to count them.
WHOLE = 1 << 20
_PARTS = ("n", "s1", "s2", "mn", "mx")
_COMBINE = {"n": np.add, "s1": np.add, "s2": np.add, "mn": np.minimum, "mx": np.maximum}


class Bins:
    """For each dimension its bins that hold values, in order: n, s1, s2 (sums of values and of
    their squares about `centre`), mn, mx."""

    def __init__(self, x: DataFrame, bins: int = BINS):
        self.x = x
        low, high = moments.ranges(x)
        self.dims, self.centre = len(low), (low + high) / 2
        per = max(2, min(bins, COUNTS // self.dims))
        self.tables: list[np.ndarray] = [np.zeros((0, 5)) for _ in range(self.dims)]
        self._count({d: [(a, b, per)] for d, (a, b) in enumerate(zip(low, high, strict=True))})

    def _count(self, wanted: dict[int, list[tuple[float, float, int]]]) -> None:
        """Adds the bins of some ranges (least value, largest, parts) of some dimensions."""
        edges, ends, at = {}, {}, {}
        total = 0
        for d, ranges in wanted.items():
            cuts = [np.unique(np.append(np.linspace(a, b, parts + 1), b)) for a, b, parts in sorted(ranges)]
            edges[d] = np.concatenate(cuts)
            ends[d] = np.concatenate([np.full(len(c), c[-1]) for c in cuts])
            at[d] = total
            total += len(edges[d])
        centre = self.centre

        def fold(m: np.ndarray) -> dict[str, np.ndarray]:
            out = {"n": np.zeros(total), "s1": np.zeros(total), "s2": np.zeros(total), "mn": np.full(total, np.inf), "mx": np.full(total, -np.inf)}
            for d, cuts in edges.items():
                v = np.sort(m[:, d])
                own = np.searchsorted(cuts, v, "right") - 1
                inside = (own >= 0) & (v <= ends[d][own])
                v, own = v[inside], own[inside]
                if not len(v):
                    continue
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                last = np.append(first[1:], len(v)) - 1
                to = at[d] + own[first]
                out["n"][to], out["mn"][to], out["mx"][to] = last - first + 1, v[first], v[last]
                out["s1"][to], out["s2"][to] = np.add.reduceat(v - centre[d], first), np.add.reduceat((v - centre[d]) ** 2, first)
            return out

        got = reduce_tables(self.x, fold, _COMBINE)
        table = np.stack([got[p] for p in _PARTS], axis=1)
        for d, cuts in edges.items():
            new = table[at[d] : at[d] + len(cuts)]
            both = np.concatenate([self.tables[d], new[new[:, 0] > 0]])
            self.tables[d] = both[np.argsort(both[:, 3], kind="stable")]

    def split(self, wanted: dict[int, np.ndarray]) -> bool:
        """Splits bins (their numbers by dimension) of more than one value; whether there are any."""
        ranges, count = {}, 0
        for d, numbers in wanted.items():
            table = self.tables[d]
            numbers = np.unique(np.asarray(numbers, int))
            numbers = numbers[table[numbers, 3] < table[numbers, 4]] if len(numbers) else numbers
            if len(numbers):
                ranges[d], count = (numbers, table[numbers][:, [0, 3, 4]]), count + len(numbers)
        if not count:
            return False
        most = int(max(2, min(SPLIT, COUNTS // count)))
        for d, (numbers, _) in ranges.items():
            self.tables[d] = np.delete(self.tables[d], numbers, axis=0)
        # no more parts than about one for each value of a large bin
        self._count({d: [(a, b, int(min(most, max(64, n)))) for n, a, b in ends] for d, (_, ends) in ranges.items()})
        return True

    def rows(self) -> int:
        return int(self.tables[0][:, 0].sum())

    def at_ranks(self, ranks: np.ndarray) -> np.ndarray:
        """(dims, ranks): the values at places of each dimension's sorted values."""
        return np.stack(self._at_ranks([(d, ranks) for d in range(self.dims)]))

    def _at_ranks(self, wanted: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """The values at places of some dimensions' sorted values."""
        while True:
            out, cut = [], defaultdict(list)
            for d, ranks in wanted:
                own = np.searchsorted(np.cumsum(self.tables[d][:, 0]), ranks, "right")
                out.append(self.tables[d][own, 3])
                cut[d].append(own)
            if not self.split({d: np.concatenate(own) for d, own in cut.items()}):
                return out

    def quantiles(self, shares: np.ndarray) -> np.ndarray:
        """(dims, shares) between the two values about each share's place, in proportion."""
        return np.stack(self.quantiles_of([(d, shares) for d in range(self.dims)]))

    def quantiles_of(self, wanted: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
        """`quantiles` of some (dimension, shares)."""
        places = [np.asarray(shares) * (self.rows() - 1) for _, shares in wanted]
        low = [np.floor(place).astype(int) for place in places]
        both = self._at_ranks([(d, np.concatenate([e, np.minimum(e + 1, self.rows() - 1)])) for (d, _), e in zip(wanted, low, strict=True)])
        out = []
        for place, e, ab in zip(places, low, both, strict=True):
            (a, b), t = np.split(ab, 2), place - e
            out.append(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
        return out

    def cells(self, mids: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each dimension n, s1, s2 of the cells between rising borders; a value on a border is
        in the lower one."""
        return self.cells_of(list(enumerate(mids)))

    def cells_of(self, wanted: list[tuple[int, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`cells` of some (dimension, borders). Splits the bins that a border cuts."""
        while True:
            cuts = defaultdict(list)
            for d, mids in wanted:
                table = self.tables[d]
                own = np.searchsorted(table[:, 4], mids, "right")  # the first bin that reaches beyond a border
                inside = own < len(table)
                cut = np.zeros(len(own), bool)
                cut[inside] = table[own[inside], 3] <= mids[inside]
                cuts[d].append(own[cut])
            if not self.split({d: np.concatenate(own) for d, own in cuts.items()}):
                break
        out = []
        for d, mids in wanted:
            table = self.tables[d]
            own = np.searchsorted(mids, table[:, 4], "left")
            out.append(tuple(np.bincount(own, table[:, p], len(mids) + 1) for p in range(3)))
        return out


def error(cells: tuple[np.ndarray, np.ndarray, np.ndarray], c: np.ndarray) -> float:
    """Squared error of cells about centroids c, both about the centre."""
    n, s1, s2 = cells
    return float(np.maximum(s2 - 2 * c * s1 + n * c**2, 0).sum())


def lloyd(x: DataFrame | Bins, k: int, iterations: int = 100, tolerance: float = 1e-7, restarts: int = 0, seed: int = 0) -> list[np.ndarray]:
    """For each dimension k rising centroids after Lloyd's iterations from the quantiles
    (i + 1/2) / k; `restarts` more starts take quantiles at seeded shares, and the start of least
    error stays, the first of equal ones. An empty cell keeps its centroid."""
    bins = x if isinstance(x, Bins) else Bins(x)
    found = lloyd_of(bins, [(d, k) for d in range(bins.dims)], iterations, tolerance, restarts, seed)
    return [found[d, k] for d in range(bins.dims)]


def lloyd_of(bins: Bins, wanted: list[tuple[int, int]], iterations: int = 100, tolerance: float = 1e-7, restarts: int = 0, seed: int = 0) -> dict[tuple[int, int], np.ndarray]:
    """`lloyd` of some (dimension, k), all in the same passes."""
    out = {}
    for d, k in wanted:
        if k <= 1:
            out[d, k] = np.array([bins.tables[d][:, 1].sum() / bins.tables[d][:, 0].sum() + bins.centre[d]])
    wanted = [w for w in wanted if w[1] > 1]
    if not wanted:
        return out
    starts = {k: [(np.arange(k) + 0.5) / k] for k in sorted({k for _, k in wanted})}
    for k, shares in starts.items():
        rng = np.random.default_rng(seed)
        shares += [np.sort(rng.random(k)) for _ in range(restarts)]
    best: list[tuple[float, np.ndarray]] | None = None
    for turn in range(restarts + 1):
        c = bins.quantiles_of([(d, starts[k][turn]) for d, k in wanted])
        moving = np.ones(len(wanted), bool)
        for _ in range(iterations):
            some = np.flatnonzero(moving)
            got = bins.cells_of([(wanted[i][0], (c[i][1:] + c[i][:-1]) / 2) for i in some])
            for i, (n, s1, _) in zip(some, got, strict=True):
                new = np.where(n > 0, s1 / np.maximum(n, 1) + bins.centre[wanted[i][0]], c[i])
                moving[i] = np.abs(new - c[i]).max() >= tolerance
                c[i] = new
            if not moving.any():
                break
        got = bins.cells_of([(d, (e[1:] + e[:-1]) / 2) for (d, _), e in zip(wanted, c, strict=True)])
        found = [(error(g, e - bins.centre[d]), e) for (d, _), g, e in zip(wanted, got, c, strict=True)]
        best = found if best is None else [b if b[0] <= f[0] else f for b, f in zip(best, found, strict=True)]
    return out | {w: c for w, (_, c) in zip(wanted, best, strict=True)}


class Held(Bins):
    """All values of one dimension, each a bin of its own, which is never split."""

    def __init__(self, values: np.ndarray):
        v, n = np.unique(values, return_counts=True)
        self.dims, self.centre = 1, np.array([(v[0] + v[-1]) / 2])
        about = v - self.centre[0]
        self.tables = [np.stack([n, n * about, n * about**2, v, v], axis=1)]


def _by_dimension(x: DataFrame, wanted: list[tuple[int, int]], solve: Callable[[np.ndarray, list[int]], dict[int, np.ndarray]]) -> dict[tuple[int, int], np.ndarray]:
    """solve(values, ks) of each wanted dimension's values, which meet in a task, in one pass."""
    of = defaultdict(list)
    for d, k in wanted:
        of[d].append(k)
    if not of:
        return {}

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                m = to_matrix(whole.slice(i, ROWS).column(0))
                own = np.array([d for d in range(m.shape[1]) if d in of], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), to_lists(m.T[own])], names=["d", "v"])

    def each(rows: pa.Table) -> pa.Table:
        d = rows.column("d")[0].as_py()
        found = solve(np.concatenate([c.flatten().to_numpy() for c in rows.column("v").chunks]), of[d])
        return pa.table({"d": pa.array([d] * len(found), pa.int32()), "k": pa.array(list(found), pa.int32()), "c": pa.array([c.tolist() for c in found.values()], pa.list_(pa.float64()))})

    tasks = min(len(of), x.sparkSession.sparkContext.defaultParallelism * 2)
    parts = x.select("v").mapInArrow(apart, "d int, v array<double>").repartition(tasks, "d")
    found = parts.groupBy("d").applyInArrow(each, "d int, k int, c array<double>").collect()  # a row for each codebook
    return {(r["d"], r["k"]): np.array(r["c"]) for r in found}


def lloyd_by_dimension(x: DataFrame, wanted: list[tuple[int, int]], restarts: int = 0, seed: int = 0) -> dict[tuple[int, int], np.ndarray]:
    """`lloyd_of` a table of at most WHOLE rows, in one pass: a dimension's values meet in a task."""

    def solve(values: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
        found = lloyd_of(Held(values), [(0, k) for k in ks], restarts=restarts, seed=seed)
        return {k: c for (_, k), c in found.items()}

    return _by_dimension(x, wanted, solve)


def exact_by_dimension(x: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Optimal centroids of a table of at most WHOLE rows, in one pass, as `lloyd_by_dimension`: borders
    between all values are tried, so that nothing hangs on how they would fall into bins."""

    def solve(values: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
        centre = (values.min() + values.max()) / 2
        return {k: c + centre for k, c in kmeans.exact_1d(values - centre, ks).items()}

    return _by_dimension(x, wanted, solve)


def exact(x: DataFrame | Bins, ks: list[int]) -> dict[int, list[np.ndarray]]:
    """For each k the centroids of each dimension that are optimal among cells which end beside the bins,
    bins at their borders being single values; where other cells err almost as little, those may be
    the better ones by a few millionths."""
    bins = x if isinstance(x, Bins) else Bins(x)
    spark = bins.x.sparkSession
    out: dict[int, list[np.ndarray]] = {}
    for k in ks:
        if k <= 1:
            out[k] = lloyd(bins, 1)
            continue
        todo, found = list(range(bins.dims)), {}
        while todo:
            rows = [(d, (bins.tables[d][:, 1] / bins.tables[d][:, 0]).tolist(), bins.tables[d][:, 0].tolist()) for d in todo]
            frame = spark.createDataFrame(rows, "d int, means array<double>, n array<double>").repartition(min(len(todo), spark.sparkContext.defaultParallelism * 2), "d")

            def solve(batch: pa.RecordBatch, k: int = k) -> dict:
                books = [kmeans.exact_1d(np.array(m.as_py()), [k], np.array(n.as_py()))[k] for m, n in zip(batch.column(1), batch.column(2), strict=True)]
                return {"d": batch.column(0), "c": pa.array([b.tolist() for b in books], pa.list_(pa.float64()))}

            for r in map_batches(frame, solve, "d int, c array<double>").collect():  # a row a dimension
                found[r["d"]] = np.array(r["c"]) + bins.centre[r["d"]]
            wanted = {}
            for d in todo:
                table, mids = bins.tables[d], (found[d][1:] + found[d][:-1]) / 2
                # the bins at a border and those beside it, as long as they hold several values
                own = np.searchsorted(table[:, 4], mids, "right")
                wanted[d] = np.unique(np.clip(np.concatenate([own - 1, own, own + 1]), 0, len(table) - 1))
            open_dims = [d for d in todo if (bins.tables[d][wanted[d], 3] < bins.tables[d][wanted[d], 4]).any()]
            bins.split({d: wanted[d] for d in open_dims})
            todo = open_dims
        out[k] = [found[d] for d in range(bins.dims)]
    return out
