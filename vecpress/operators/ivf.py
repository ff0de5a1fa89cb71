"""Inverted-file search: rows by cell, queries to their nearest cells, exact scores of what the
codes decode to.

Codes are a table (cell, vec_id, code); `models.save_index` writes it partitioned by cell, and
rows of cells that no query probes are then not read. Queries meet the rows of the cells they
probe as strips (`grid`). Codes are computed when they are read: write them if they are searched
more than once.

With `tables` a search looks up partial distances by code field and never decodes a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.functions.arrays import from_binary, map_batches, reduce_tables, to_binary, to_lists, to_matrix
from vecpress.operators import grid, kmeans
from vecpress.operators.codecs import Codec, Product, Scalar, SignBit
from vecpress.operators.knn import SCHEMA, TILE, Nearest, Top, _exact, best, nothing, top

#: Bytes of look-up tables that a task makes at a time, and of the codecs of all cells together.
TABLE_BYTES = 64 << 20
CELL_CODECS_BYTES = 256 << 20
#: Rows of a cell that its own codec is fitted on, about, drawn by a hash of the id.
CELL_ROWS = 16_384


def default_cells(rows: int) -> int:
    return int(min(65536, max(1, round(rows**0.5))))


def default_probes(cells: int) -> int:
    return max(1, round(cells**0.5))


def probe(queries: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str = "l2") -> np.ndarray:
    """(queries, nprobe) cells, nearest first, ties to the lowest number."""
    cost = -(queries @ centroids.T) if metric == "ip" else (centroids**2).sum(1)[None, :] - 2 * queries @ centroids.T + (queries**2).sum(1)[:, None]
    if nprobe >= cost.shape[1]:
        return np.argsort(cost, axis=1, kind="stable")
    # all that may be among the nearest, ties included, then those in order
    limit = np.partition(cost, nprobe - 1, axis=1)[:, nprobe - 1]
    out = np.empty((len(cost), nprobe), np.int64)
    for i, row in enumerate(cost):
        some = np.flatnonzero(row <= limit[i])
        out[i] = some[np.argsort(row[some], kind="stable")[:nprobe]]
    return out


class IVF:
    """codec None keeps rows as they are. per_cell: a codec of its kind fitted on each cell's
    residuals (scalar ranges and product codebooks on all rows of a cell, other kinds on about
    CELL_ROWS of them, one task a cell; together they are held to CELL_CODECS_BYTES); else one codec for the residuals of
    all cells. Centroids are fitted on about
    rows_per_cell rows for each cell, drawn by a hash of the id, or on all rows if that is None
    or more than there are; every row is indexed. spread: they start from rows that lie apart
    (`kmeans.spread_rows`, with `seed`) in place of the first ones."""

    def __init__(self, cells: int | None = None, codec: Codec | None = None, metric: str = "l2", per_cell: bool = False, iterations: int = 10, rows_per_cell: int | None = 256, spread: bool = False, seed: int = 0):
        self.spread, self.seed = spread, seed
        self.cells, self.codec, self.metric, self.per_cell, self.iterations, self.rows_per_cell = cells, codec, metric, per_cell, iterations, rows_per_cell
        if per_cell and codec is None:
            raise ValueError("rows kept as they are have no codec to fit for each cell")

    def fit(self, x: DataFrame) -> IVF:
        rows = x.count()
        cells = self.cells or default_cells(rows)
        drawn = kmeans.drawn(x, self.rows_per_cell and self.rows_per_cell * cells, rows)
        start = kmeans.spread_rows(drawn, cells, seed=self.seed) if self.spread else None
        self.centroids = kmeans.kmeans(drawn, cells, self.iterations, self.metric == "ip", start)
        self.cells = len(self.centroids)
        self.residuals = self._residuals(x)
        if self.per_cell and not isinstance(self.codec, Scalar):
            self.own = self._fit_books() if type(self.codec) is Product else self._fit_cells()
            self.codec.dims = self.centroids.shape[1]
        elif self.per_cell:
            pieces = self.residuals.select("cell", F.posexplode("v").alias("d", "x")).groupBy("cell", "d").agg(F.min("x").alias("a"), F.max("x").alias("b"))
            dims = self.centroids.shape[1]
            self.low, self.high = np.zeros((cells, dims)), np.zeros((cells, dims))
            for r in pieces.collect():  # cells * dims rows
                self.low[r["cell"], r["d"]], self.high[r["cell"], r["d"]] = r["a"], r["b"]
            self.codec.dims = dims
        elif self.codec is not None:
            self.codec.fit(self.residuals.select("vec_id", "v"))
        return self

    def _residuals(self, x: DataFrame) -> DataFrame:
        """(cell, vec_id, v): v less its centroid."""
        spherical = self.metric == "ip"
        sent = x.sparkSession.sparkContext.broadcast((self.centroids, kmeans.finder(self.centroids, spherical)))

        def run(b: pa.RecordBatch) -> dict:
            rows, (centroids, find) = to_matrix(b.column("v")), sent.value
            cell, _ = find(rows)
            return {"cell": cell.astype(np.int32), "vec_id": b.column("vec_id"), "v": to_lists(rows - centroids[cell])}

        return map_batches(x, run, "cell int, vec_id long, v array<double>")

    def _fit_cells(self) -> dict[int, Codec]:
        """A fitted codec for each cell that has rows, from one grouped job."""
        sizes = {r["cell"]: r["count"] for r in self.residuals.groupBy("cell").count().collect()}  # a row a cell
        chance = F.try_element_at(F.create_map(*(F.lit(x) for c, n in sizes.items() for x in (c, min(1.0, CELL_ROWS / n)))), F.col("cell"))
        u = F.xxhash64("vec_id", F.lit(4)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
        plain = pickle.dumps(self.codec)

        def train(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("vec_id")
            fitted = pickle.loads(plain).fit_rows(to_matrix(rows.column("v")))
            return pa.table({"cell": rows.column("cell").slice(0, 1), "codec": pa.array([pickle.dumps(fitted)], pa.binary())})

        fitted = self.residuals.where(u < chance).groupBy("cell").applyInArrow(train, "cell int, codec binary")
        self._bound_codecs(len(sizes))
        return {r["cell"]: pickle.loads(r["codec"]) for r in fitted.collect()}

    def _bound_codecs(self, cells: int) -> None:
        one = len(pickle.dumps(pickle.loads(pickle.dumps(self.codec)).fit_rows(np.eye(self.centroids.shape[1])[:2])))
        if one * cells > CELL_CODECS_BYTES:
            raise ValueError(f"codecs of {cells} cells take {one * cells >> 20} MB; take fewer cells, or one codec for all")

    def _fit_books(self) -> dict[int, Codec]:
        """Product codecs of all cells that have rows, trained together on all rows: they start
        from each cell's first rows, and an iteration is one pass of sums."""
        codec, ksub = self.codec, 1 << self.codec.bits
        order = F.row_number().over(Window.partitionBy("cell").orderBy("vec_id"))
        sizes = {r["cell"]: r["count"] for r in self.residuals.groupBy("cell").count().collect()}  # a row a cell
        self._bound_codecs(len(sizes))
        first = self.residuals.withColumn("rk", order).where(F.col("rk") <= ksub).orderBy("cell", "vec_id").collect()  # ksub rows a cell
        names = sorted(sizes)
        starts: dict[int, list] = {c: [] for c in names}
        for r in first:
            starts[r["cell"]].append(r["v"])
        # a cell of no more rows than centroids keeps its rows; the last one fills the rest
        books = np.stack([kmeans.pq_train_rows(np.array(starts[c]), codec.m, ksub, 0) for c in names])
        moving = np.array([sizes[c] > ksub for c in names])
        place = np.full(len(self.centroids), -1)
        place[names] = np.arange(len(names))
        marked = self.residuals.select("vec_id", F.concat(F.array(F.col("cell").cast("double")), "v").alias("v"))
        for _ in range(codec.iterations if moving.any() else 0):
            sent = self.residuals.sparkSession.sparkContext.broadcast(books)

            def fold(rows: np.ndarray, sent=sent) -> dict[str, np.ndarray]:
                books, at = sent.value, place[rows[:, 0].astype(int)]
                parts = rows[:, 1:].reshape(len(rows), books.shape[1], -1)
                total, n = np.zeros_like(books), np.zeros(books.shape[:3])
                for c in np.unique(at):
                    own = parts[at == c]
                    for j in range(books.shape[1]):
                        idx, _ = kmeans.nearest(own[:, j], books[c, j])
                        np.add.at(total[c, j], idx, own[:, j])
                        n[c, j] += np.bincount(idx, minlength=books.shape[2])
                return {"total": total, "n": n}

            got = reduce_tables(marked, fold, {"total": np.add, "n": np.add})
            n = got["n"].reshape(*books.shape[:3], 1)
            new = np.where(n > 0, got["total"].reshape(books.shape) / np.maximum(n, 1), books)
            books = np.where(moving[:, None, None, None], new, books)
        out = {}
        for c, own in zip(names, books, strict=True):
            out[c] = pickle.loads(pickle.dumps(codec))
            out[c].books, out[c].dims = own, self.centroids.shape[1]
        return out

    def codec_of(self, cell: int) -> Codec:
        """The codec of one cell's residuals."""
        if hasattr(self, "own"):
            return self.own[cell]
        return self._bounded(cell) if self.per_cell else self.codec

    def _by_cell(self, cell: np.ndarray, rows: np.ndarray, method: str) -> np.ndarray:
        """rows through a method of their own cell's codec."""
        out = None
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            part = getattr(self.own[int(c)], method)(rows[at])
            out = np.empty((len(rows), part.shape[1]), part.dtype) if out is None else out
            out[at] = part
        return out

    def _bounded(self, cell: np.ndarray) -> Codec:
        codec = Scalar(self.codec.bits)
        codec.dims, codec.low, codec.high = self.codec.dims, self.low[cell], self.high[cell]
        return codec

    def encode(self, x: DataFrame | None = None) -> DataFrame:
        """(cell, vec_id, code)."""
        sent = self.residuals.sparkSession.sparkContext.broadcast(self.__getstate__())
        rows = self.residuals if x is None else self._residuals(x)

        def run(b: pa.RecordBatch) -> dict:
            own, cell = IVF._from(sent.value), b.column("cell").to_numpy()
            v = to_matrix(b.column("v"))
            if own.codec is None:
                code = v.astype("<f8").view(np.uint8).reshape(len(v), -1)
            elif hasattr(own, "own"):
                code = own._by_cell(cell, v, "_encode")
            else:
                code = (own._bounded(cell) if own.per_cell else own.codec)._encode(v)
            return {"cell": b.column("cell"), "vec_id": b.column("vec_id"), "code": to_binary(code)}

        return map_batches(rows, run, "cell int, vec_id long, code binary")

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "residuals"}

    @classmethod
    def _from(cls, state: dict) -> IVF:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def decode_rows(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.codec is None:
            v = code.copy().view("<f8")
        elif hasattr(self, "own"):
            v = self._by_cell(cell, code, "_decode")
        else:
            v = (self._bounded(cell) if self.per_cell else self.codec)._decode(code)
        return v + self.centroids[cell]

    def search(self, codes: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None, estimate: bool = False, query_bits: int = 4, tables: bool = False, strip: int | None = None) -> DataFrame:
        """(qid, rk, id, score). Squared distances, or inner products, largest first. A query
        with fewer than k rows in its cells has fewer rows. estimate: by the estimator of
        sign-bit or segmented codes, made for the metric of the index, instead of decoded rows.
        tables: by look-up tables of the codec, which no row is decoded for. strip: as in `knn.search`."""
        if k <= 0:
            return nothing(codes)
        if estimate and self.codec.metric != self.metric:
            raise ValueError(f"the codec estimates {self.codec.metric}, the index searches {self.metric}")
        nprobe = min(nprobe or default_probes(self.cells), self.cells)
        metric = self.metric
        sent = codes.sparkSession.sparkContext.broadcast(self.__getstate__())

        def read(rows: pa.RecordBatch, cell: int) -> np.ndarray:
            return IVF._from(sent.value).decode_rows(rows.column("cell").to_numpy(), from_binary(rows.column("code")))

        def make(names: np.ndarray, q: np.ndarray) -> grid.Fold:
            if not estimate and not tables:
                return Nearest(names, q, k, metric, read)
            own = IVF._from(sent.value)
            args = (query_bits,) if isinstance(own.codec, SignBit) else ()
            if tables:
                return LookedUp(names, q, k, metric, own.codec_of, own.centroids)
            return Estimated(names, q, k, own.codec, args, own.centroids)

        found = grid.match(codes.select("cell", "vec_id", "code"), queries, make, SCHEMA, probe=lambda q: probe(q, sent.value["centroids"], nprobe, metric), strip=strip)
        return top(found, k, metric == "l2")


def flat_search(codec: Codec, codes: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact search of decoded codes (vec_id, code)."""
    from vecpress.operators.knn import search

    sent = codes.sparkSession.sparkContext.broadcast(codec)
    return search(codes, queries, k, metric, decode=lambda b: sent.value._decode(from_binary(b.column("code"))))


def table_search(codec: Codec, codes: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Search of codes (vec_id, code) by look-up tables: for each query and field of a code its
    part of the squared distance or inner product for every value of the field, summed over the
    fields in order. Equal to `flat_search` but for the order of sums."""
    if k <= 0:
        return nothing(codes)
    sent = codes.sparkSession.sparkContext.broadcast(codec)
    found = grid.match(codes.select("vec_id", "code"), queries, lambda names, q: LookedUp(names, q, k, metric, lambda cell: sent.value), SCHEMA)
    return top(found, k, metric == "l2")


class LookedUp:
    """A strip's best rows by look-up tables. With centroids codes are of residuals: a query's
    tables are made for what is left of it in each cell, or for itself under inner products."""

    tile = grid.QUERY_ROWS

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, metric: str, codec_of, centroids: np.ndarray | None = None):
        self.names, self.q, self.metric, self.codec_of, self.centroids, self.top = names, q, metric, codec_of, centroids, Top(len(q), k)
        self.kept: tuple | None = None

    def _tables(self, own: np.ndarray, cell: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Tables of the queries `own`; those of the last ones asked for are kept."""
        key = (cell, own[0], own[-1], len(own))
        if self.kept is None or self.kept[0] != key:
            q, plus = self.q[own], np.zeros(len(own))
            if self.centroids is not None and self.metric == "l2":
                q = q - self.centroids[cell]
            elif self.centroids is not None:
                plus = q @ self.centroids[cell]
            tables, start = self.codec_of(cell).tables(q, self.metric)
            self.kept = (key, tables, plus + start)
        return self.kept[1:]

    def add(self, rows: pa.RecordBatch, to: np.ndarray, cell: int) -> None:
        codec = self.codec_of(cell)
        ids, fields = rows.column("vec_id").to_numpy(), codec.fields(from_binary(rows.column("code")))
        tile = int(min(len(to), self.tile, max(1, TABLE_BYTES // codec.table_bytes()), max(1, TABLE_BYTES // (8 * len(ids)))))
        for i in range(0, len(to), tile):
            own = to[i : i + tile]
            tables, start = self._tables(own, cell)
            total = np.repeat(start[:, None], len(ids), 1)
            for j, table in enumerate(tables):
                total += table[:, fields[:, j]]
            cost = total if self.metric == "l2" else -total
            a, b = best(cost, np.zeros_like(cost), self.top.k, self.top.kth(own))
            for j in range(0, len(a), 1 << 16):
                m, n = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                self.top.add(own[m], ids[n], cost[m, n])

    def out(self) -> Iterator[pa.RecordBatch]:
        yield from self.top.batch(self.names, 1.0 if self.metric == "l2" else -1.0)


class Estimated:
    """A strip's best rows by a codec's own estimator, of residuals if there are centroids."""

    tile = TILE

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, codec: Codec, args: tuple, centroids: np.ndarray | None = None):
        self.names, self.q, self.codec, self.args, self.centroids, self.top = names, q, codec, args, centroids, Top(len(q), k)

    def add(self, rows: pa.RecordBatch, to: np.ndarray, cell: int) -> None:
        code, ids = from_binary(rows.column("code")), rows.column("vec_id").to_numpy()
        if self.centroids is None:
            estimated(self.top, self.codec, self.q, to, code, ids, self.args, tile=self.tile)
        elif self.codec.metric == "l2":
            estimated(self.top, self.codec, self.q - self.centroids[cell], to, code, ids, self.args, tile=self.tile)
        else:  # <q, c + r>: the first is known
            estimated(self.top, self.codec, self.q, to, code, ids, self.args, self.q @ self.centroids[cell], self.tile)

    def out(self) -> Iterator[pa.RecordBatch]:
        yield from self.top.batch(self.names, 1.0 if self.codec.metric == "l2" else -1.0)


def estimated(kept: Top, codec, q: np.ndarray, to: np.ndarray, code: np.ndarray, ids: np.ndarray, args: tuple, plus: np.ndarray | None = None, tile: int = TILE) -> None:
    """Keeps the best of queries number `to` by a codec's estimator, `tile` at a time; plus: added
    to a query's scores."""
    for i in range(0, len(to), tile):
        own = to[i : i + tile]
        rows, names = code, ids
        if getattr(codec, "prune", False):  # rows that their norms rule out are not decoded
            least = codec.bound(code, q[own])
            if codec.metric == "ip":
                least = -(least if plus is None else least + plus[own, None])
            some = np.flatnonzero((least <= kept.kth(own)[:, None]).any(0))
            if not len(some):
                continue
            rows, names = code[some], ids[some]
        cost = codec.estimate(rows, q[own], *args)
        if codec.metric == "ip":
            cost = -(cost if plus is None else cost + plus[own, None])
        limit = np.partition(cost, kept.k - 1, axis=1)[:, kept.k - 1] if cost.shape[1] >= kept.k else np.full(len(own), np.inf)
        a, b = np.nonzero(cost <= np.minimum(limit, kept.kth(own))[:, None])  # with all ties
        for j in range(0, len(a), 1 << 16):
            m, n = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            kept.add(own[m], names[n], cost[m, n])


def estimate_search(codec, codes: DataFrame, queries: DataFrame, k: int, *args) -> DataFrame:
    """Top k by a codec's own estimator (sign-bit or segmented codes), of distances or of inner
    products, as the codec's metric says."""
    if k <= 0:
        return nothing(codes)
    sent = codes.sparkSession.sparkContext.broadcast(codec)
    found = grid.match(codes.select("vec_id", "code"), queries, lambda names, q: Estimated(names, q, k, sent.value, args), SCHEMA)
    return top(found, k, codec.metric == "l2")


def codebook_query(books: np.ndarray, queries: DataFrame, k: int, metric: str = "l2", rotation: np.ndarray | None = None) -> DataFrame:
    """(qid, m, rk, id, score): each query's k nearest centroids of each sub-space, numbered
    m * ksub + centroid. Queries are turned by `rotation` first, as rows of a rotated codec are."""
    if metric not in ("l2", "ip"):
        raise ValueError("codebooks are queried under l2 or ip")
    if books.ndim != 3:
        raise ValueError("a codebook is (sub-spaces, centroids, dimensions)")
    sent = queries.sparkSession.sparkContext.broadcast(books)

    def run(b: pa.RecordBatch) -> dict:
        books = sent.value
        m, ksub, width = books.shape
        q = to_matrix(b.column("q"))
        q = q @ rotation if rotation is not None and len(q) else q
        if len(q) and q.shape[1] != m * width:
            raise ValueError(f"queries have {q.shape[1]} dimensions, the codebook {m * width}")
        qid = b.column("qid").to_numpy()
        out = {"qid": [], "m": [], "rk": [], "id": [], "score": []}
        for j in range(m):
            part = q[:, j * width : (j + 1) * width]
            pairs_q, pairs_c = np.repeat(part, ksub, 0), np.tile(books[j], (len(q), 1))
            score = _exact(metric, pairs_q, pairs_c).reshape(len(q), ksub)
            order = np.argsort(score if metric == "l2" else -score, axis=1, kind="stable")[:, :k]
            n = order.shape[1]
            out["qid"].append(np.repeat(qid, n))
            out["m"].append(np.full(order.size, j, np.int32))
            out["rk"].append(np.tile(np.arange(1, n + 1, dtype=np.int32), len(q)))
            out["id"].append((j * ksub + order).ravel())
            out["score"].append(np.take_along_axis(score, order, 1).ravel())
        return {c: np.concatenate(v) for c, v in out.items()}

    return map_batches(queries, run, "qid long, m int, rk int, id long, score double")


def factory_key(name: str, m: int = 8, bits: int = 8, cells: int | None = None) -> str:
    """The name of an index: PQ8x8, SQ8 or Flat, with IVF<cells>, before it."""
    kinds = {"pq": f"PQ{m}x{bits}", "opq": f"OPQ{m},PQ{m}x{bits}", "sq": "SQ8", "flat": "Flat"}
    if name not in kinds:
        raise ValueError(f"unknown kind {name!r}")
    return f"IVF{cells},{kinds[name]}" if cells else kinds[name]


def build(key: str) -> Codec | IVF | None:
    """What a factory key names."""
    from vecpress.operators.codecs import OptimizedProduct, Product

    cells = None
    if key.startswith("IVF"):
        head, key = key.split(",", 1)
        cells = int(head[3:])
    rotate = key.startswith("OPQ")
    kind = key.split(",")[-1]
    if kind == "Flat":
        codec = None
    elif kind.startswith("SQ"):
        codec = Scalar(int(kind[2:]))
    elif kind.startswith("PQ"):
        m, bits = map(int, kind[2:].split("x"))
        codec = (OptimizedProduct if rotate else Product)(m, bits)
    else:
        raise ValueError(f"unknown key {key!r}")
    return IVF(cells, codec) if cells else codec
