"""Vector codecs. `Codec.fit(x)` learns small tables on the driver from one or a few passes of
partial sums; `encode` and `decode` are stateless maps over batches of rows.

x is (vec_id, v array<double>); codes are (vec_id, code BINARY). Matrices are row-major
float64; a codec's kernels `_encode` and `_decode` take and give numpy matrices, so the search
operators decode in the same task that scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecpress.functions import distance
from vecpress.functions.arrays import from_binary, map_batches, reduce_tables, to_binary, to_lists, to_matrix
from vecpress.operators import allocation, bitpack, kmeans, moments

#: Denominators that may vanish. Fixed values of the formats.
RANGE_EPS = 1e-8
NORM_EPS = 1e-12
#: Bytes a row that adapters count for a side norm.
NORM_BYTES = 4


class Codec:
    """dims: of the vectors it was fitted on."""

    name = "codec"
    dims: int

    def fit(self, x: DataFrame) -> Codec:
        raise NotImplementedError

    def code_size(self) -> int:
        """Bytes a row."""
        raise NotImplementedError

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encode(self, x: DataFrame) -> DataFrame:
        sent = x.sparkSession.sparkContext.broadcast(self)
        return map_batches(x, lambda b: {"vec_id": b.column("vec_id"), "code": to_binary(sent.value._encode(to_matrix(b.column("v"))))}, "vec_id long, code binary")

    def decode(self, codes: DataFrame) -> DataFrame:
        sent = codes.sparkSession.sparkContext.broadcast(self)
        return map_batches(codes, lambda b: {"vec_id": b.column("vec_id"), "v": to_lists(sent.value._decode(from_binary(b.column("code"))))}, "vec_id long, v array<double>")

    def reconstruct(self, x: DataFrame) -> DataFrame:
        """(vec_id, v, r): rows and their round trip, in one map."""
        sent = x.sparkSession.sparkContext.broadcast(self)

        def run(b: pa.RecordBatch) -> dict:
            rows = to_matrix(b.column("v"))
            return {"vec_id": b.column("vec_id"), "v": b.column("v"), "r": to_lists(sent.value._decode(sent.value._encode(rows)))}

        return map_batches(x, run, "vec_id long, v array<double>, r array<double>")

    def reconstruct_ids(self, codes: DataFrame, ids: DataFrame) -> DataFrame:
        """(vec_id, v) of the codes whose id is in ids (vec_id); ids without a code give no row. A
        codec that was not fitted, and a negative id, are errors."""
        if not hasattr(self, "dims"):
            raise RuntimeError(f"{self.name} reconstructs after it was fitted")
        wanted = ids.select("vec_id").distinct()
        if not wanted.where("vec_id < 0").isEmpty():
            raise ValueError("ids are not negative")
        return self.decode(codes.join(wanted, "vec_id", "left_semi"))

    def compression_ratio(self) -> float:
        return 4 * self.dims / self.code_size()

    def fit_rows(self, rows: np.ndarray) -> Codec:
        """Fitted on a matrix, in the task that holds it."""
        raise NotImplementedError(f"{self.name} is not fitted on a cell's rows")

    # --- look-up tables: codes of fields, each with its part of a distance for every value

    def fields(self, codes: np.ndarray) -> np.ndarray:
        """(rows, fields) values of packed codes."""
        raise NotImplementedError(f"{self.name} has no look-up tables")

    def table_bytes(self) -> int:
        """Bytes of one query's tables."""
        raise NotImplementedError(f"{self.name} has no look-up tables")

    def tables(self, queries: np.ndarray, metric: str) -> tuple[list[np.ndarray], np.ndarray]:
        """For each field (queries, values), and what each query adds: together the squared
        distance to, or inner product with, what a code decodes to."""
        raise NotImplementedError(f"{self.name} has no look-up tables")


def _part(queries: np.ndarray, values: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances or inner products (queries, values) in one field's dimensions, summed in
    their order."""
    out = np.zeros((len(queries), len(values)))
    for d in range(queries.shape[1]):
        a, b = queries[:, d, None], values[None, :, d]
        out += (a - b) ** 2 if metric == "l2" else a * b
    return out


class Scalar(Codec):
    """4, 8 or 16 bits of each dimension's range; codes beyond the range are clipped."""

    name = "sq"

    def __init__(self, bits: int = 8):
        if bits not in (4, 8, 16):
            raise ValueError("bits must be 4, 8 or 16")
        self.bits = bits

    def fit(self, x: DataFrame) -> Scalar:
        self.low, self.high = moments.ranges(x)
        self.dims = len(self.low)
        return self

    def code_size(self) -> int:
        return -(-self.dims // 2) if self.bits == 4 else self.dims * self.bits // 8

    def levels(self, rows: np.ndarray) -> np.ndarray:
        top = 2**self.bits - 1
        return np.clip(np.rint((rows - self.low) / (self.high - self.low + RANGE_EPS) * top), 0, top).astype(np.int64)

    def values(self, levels: np.ndarray) -> np.ndarray:
        return levels / (2**self.bits - 1) * (self.high - self.low + RANGE_EPS) + self.low

    def fit_rows(self, rows: np.ndarray) -> Scalar:
        self.low, self.high, self.dims = rows.min(0), rows.max(0), rows.shape[1]
        return self

    def fields(self, codes: np.ndarray) -> np.ndarray:
        if self.bits == 16:
            raise NotImplementedError("16-bit codes have no look-up tables")
        return codes if self.bits == 8 else np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : self.dims]

    def table_bytes(self) -> int:
        return 8 * self.dims << self.bits

    def tables(self, queries: np.ndarray, metric: str) -> tuple[list[np.ndarray], np.ndarray]:
        every = self.values(np.repeat(np.arange(1 << self.bits, dtype=np.float64)[:, None], self.dims, 1))
        return [_part(queries[:, d : d + 1], every[:, d : d + 1], metric) for d in range(self.dims)], np.zeros(len(queries))

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        levels = self.levels(rows)
        if self.bits == 4:
            if self.dims % 2:
                levels = np.concatenate([levels, np.zeros((len(levels), 1), np.int64)], axis=1)
            return (levels[:, ::2] << 4 | levels[:, 1::2]).astype(np.uint8)
        return levels.astype("<u2").view(np.uint8).reshape(len(rows), -1) if self.bits == 16 else levels.astype(np.uint8)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        if self.bits == 4:
            levels = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : self.dims]
        else:
            levels = codes.copy().view("<u2") if self.bits == 16 else codes
        return self.values(levels.astype(np.float64))


class Product(Codec):
    """m sub-spaces of contiguous dimensions with 2**bits centroids each."""

    name = "pq"

    def __init__(self, m: int = 8, bits: int = 8, iterations: int = 10, num_chunks: int | None = None, num_clusters: int | None = None):
        if num_chunks is not None:
            if m not in (8, num_chunks):
                raise ValueError("m and num_chunks disagree")
            m = num_chunks
        if num_clusters is not None:
            if num_clusters < 1 or num_clusters & (num_clusters - 1):
                raise ValueError("num_clusters must be a power of two")
            if bits not in (8, num_clusters.bit_length() - 1):
                raise ValueError("bits and num_clusters disagree")
            bits = num_clusters.bit_length() - 1
        self.m, self.bits, self.iterations = m, bits, iterations

    def fit(self, x: DataFrame) -> Product:
        self.books = kmeans.pq_train(x, self.m, 1 << self.bits, self.iterations)
        self.dims = self.m * self.books.shape[2]
        return self

    def code_size(self) -> int:
        return -(-self.m * self.bits // 8)

    def levels(self, rows: np.ndarray) -> np.ndarray:
        parts = rows.reshape(len(rows), self.m, -1)
        return np.stack([kmeans.nearest(parts[:, j], self.books[j])[0] for j in range(self.m)], axis=1)

    def values(self, levels: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][levels[:, j]] for j in range(self.m)], axis=1)

    def _widths(self) -> np.ndarray:
        return np.full(self.m, self.bits)

    def fit_rows(self, rows: np.ndarray) -> Product:
        """With fewer rows than centroids each row is one, and the last one fills the rest."""
        self.books, self.dims = kmeans.pq_train_rows(rows, self.m, 1 << self.bits, self.iterations), rows.shape[1]
        return self

    def fields(self, codes: np.ndarray) -> np.ndarray:
        return bitpack.unpack_dense(codes, self._widths())

    def table_bytes(self) -> int:
        return 8 * self.m << self.bits

    def tables(self, queries: np.ndarray, metric: str) -> tuple[list[np.ndarray], np.ndarray]:
        parts = queries.reshape(len(queries), self.m, -1)
        return [_part(parts[:, j], self.books[j], metric) for j in range(self.m)], np.zeros(len(queries))

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        return bitpack.pack_dense(self.levels(rows), self._widths())

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        return self.values(bitpack.unpack_dense(codes, self._widths()))


class OptimizedProduct(Product):
    """A learned rotation, then product codes trained on the rotated rows. The rotation
    alternates with the codes: the orthogonal matrix that best takes rows to their codes."""

    name = "opq"

    def __init__(self, m: int = 8, bits: int = 8, iterations: int = 10, rounds: int = 4):
        super().__init__(m, bits, iterations)
        self.rounds = rounds

    def fit(self, x: DataFrame) -> OptimizedProduct:
        plain = Product(self.m, self.bits, self.iterations).fit(x)
        self.dims, self.books, self.rotation = plain.dims, plain.books, np.eye(plain.dims)
        best = (self._error(x), self.rotation, self.books)
        for _ in range(self.rounds):

            def cross(rows: np.ndarray) -> dict[str, np.ndarray]:
                turned = rows @ self.rotation
                return {"c": rows.T @ self.values(self.levels(turned))}

            u, _, vt = np.linalg.svd(reduce_tables(x, cross, {"c": np.add})["c"].reshape(self.dims, -1))
            self.rotation = u @ vt
            turned = map_batches(x, lambda b, r=self.rotation: {"vec_id": b.column("vec_id"), "v": to_lists(to_matrix(b.column("v")) @ r)}, "vec_id long, v array<double>")
            self.books = kmeans.pq_train(turned, self.m, 1 << self.bits, self.iterations)
            error = self._error(x)
            if error < best[0]:
                best = (error, self.rotation, self.books)
        _, self.rotation, self.books = best
        return self

    def _error(self, x: DataFrame) -> float:
        def fold(rows: np.ndarray) -> dict[str, np.ndarray]:
            turned = rows @ self.rotation
            return {"e": [((turned - self.values(self.levels(turned))) ** 2).sum()]}

        return float(reduce_tables(x, fold, {"e": np.add})["e"][0])

    def fit_rows(self, rows: np.ndarray) -> OptimizedProduct:
        raise NotImplementedError("a rotation is learned on the whole table")

    def tables(self, queries: np.ndarray, metric: str) -> tuple[list[np.ndarray], np.ndarray]:
        return super().tables(queries @ self.rotation, metric)

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        return super()._encode(rows @ self.rotation)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        return super()._decode(codes) @ self.rotation.T


class SignBit(Codec):
    """One sign bit a dimension of the centred vector, with its squared norm and the factor that
    makes inner products with the signs unbiased (two float32). metric ip: the squared norm is
    kept less that of the vector itself, from which inner products with vectors that are not
    centred follow."""

    name = "rabitq"

    def __init__(self, metric: str = "l2"):
        self.metric = distance.metric(metric)
        if self.metric not in ("l2", "ip"):
            raise ValueError("the metric is l2 or ip")

    def fit(self, x: DataFrame) -> SignBit:
        self.mean = moments.mean(x)
        self.dims = len(self.mean)
        return self

    def code_size(self) -> int:
        return -(-self.dims // 8) + 8

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        o = rows - self.mean
        norm2 = (o**2).sum(1)
        spread = np.abs(o).sum(1) / np.sqrt(self.dims)  # inner product with the unit sign vector
        factor = np.where(spread > 0, norm2 / np.where(spread > 0, spread, 1), 0)
        kept = norm2 - (rows**2).sum(1) if self.metric == "ip" else norm2
        side = np.stack([kept, factor], 1).astype("<f4").view(np.uint8).reshape(len(rows), 8)
        return np.concatenate([np.packbits(o > 0, axis=1), side], axis=1)

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit sign vectors, squared norms, factors."""
        n = -(-self.dims // 8)
        side = codes[:, n:].copy().view("<f4").astype(np.float64)
        signs = (np.unpackbits(codes[:, :n], axis=1)[:, : self.dims] * 2.0 - 1) / np.sqrt(self.dims)
        return signs, side[:, 0], side[:, 1]

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        signs, _, factor = self.parts(codes)
        return signs * factor[:, None] + self.mean

    def estimate(self, codes: np.ndarray, queries: np.ndarray, query_bits: int = 4) -> np.ndarray:
        """Estimated squared distances, or inner products, (queries, rows); query_bits 0 keeps
        queries in full."""
        signs, norm2, factor = self.parts(codes)
        q = queries - self.mean
        near = q
        if query_bits:
            low, high = q.min(1, keepdims=True), q.max(1, keepdims=True)
            step = np.maximum((high - low) / (2**query_bits - 1), 1e-30)
            near = np.rint((q - low) / step) * step + low
        total = norm2[None, :] + (q**2).sum(1)[:, None] - 2 * (near @ signs.T) * factor[None, :]
        return np.maximum(total, 0) if self.metric == "l2" else ((queries**2).sum(1)[:, None] - total) / 2


class MultiBit(Codec):
    """1 to 8 bits a dimension on a random rotation, with levels of the normal distribution; a
    row keeps its norm and the factor that fits its levels to it (two float32)."""

    name = "extended_rabitq"

    def __init__(self, bits: int = 4, seed: int = 0):
        if not 1 <= bits <= 8:
            raise ValueError("bits must be 1 to 8")
        self.bits, self.seed = bits, seed

    def fit(self, x: DataFrame) -> MultiBit:
        self.mean = moments.mean(x)
        self.dims = len(self.mean)
        self.rotation = moments.random_rotation(self.dims, self.seed)
        self.levels, _ = allocation.normal_levels(1 << self.bits)
        return self

    def code_size(self) -> int:
        return -(-self.dims * self.bits // 8) + 8

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        o = rows - self.mean
        norm = np.maximum(np.sqrt((o**2).sum(1)), NORM_EPS)
        s = o / norm[:, None] @ self.rotation * np.sqrt(self.dims)
        own = kmeans.levels_of(s, self.levels)
        near = self.levels[own]
        den = (near**2).sum(1)
        t = np.where(den > NORM_EPS, (s * near).sum(1) / np.where(den > NORM_EPS, den, 1), 1.0)
        side = np.stack([norm, t], 1).astype("<f4").view(np.uint8).reshape(len(rows), 8)
        return np.concatenate([bitpack.pack_dense(own, np.full(self.dims, self.bits)), side], axis=1)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        side = codes[:, -8:].copy().view("<f4").astype(np.float64)
        own = bitpack.unpack_dense(codes[:, :-8], np.full(self.dims, self.bits))
        s = self.levels[own] / np.sqrt(self.dims) * side[:, 1:]
        return s @ self.rotation.T * side[:, :1] + self.mean


class Local(Codec):
    """1 to 8 bits of each row's own range about the mean; a row keeps its low end and step
    (two float32)."""

    name = "lvq"

    def __init__(self, bits: int = 4):
        if not 1 <= bits <= 8:
            raise ValueError("bits must be 1 to 8")
        self.bits = bits

    def fit(self, x: DataFrame) -> Local:
        self.mean = moments.mean(x)
        self.dims = len(self.mean)
        return self

    def code_size(self) -> int:
        return -(-self.dims * self.bits // 8) + 8

    def fit_rows(self, rows: np.ndarray) -> Local:
        self.mean, self.dims = rows.mean(0), rows.shape[1]
        return self

    def levels(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = rows - self.mean
        low, top = r.min(1), 2**self.bits - 1
        step = (r.max(1) - low) / top
        step = np.where(step == 0, np.finfo(np.float32).tiny, step)
        return np.clip(np.rint((r - low[:, None]) / step[:, None]), 0, top).astype(np.int64), low, step

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        own, low, step = self.levels(rows)
        side = np.stack([low, step], 1).astype("<f4").view(np.uint8).reshape(len(rows), 8)
        return np.concatenate([bitpack.pack_dense(own, np.full(self.dims, self.bits)), side], axis=1)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        side = codes[:, -8:].copy().view("<f4").astype(np.float64)
        own = bitpack.unpack_dense(codes[:, :-8], np.full(self.dims, self.bits))
        return side[:, :1] + own * side[:, 1:] + self.mean


class RankAware(Codec):
    """Principal axes with unequal bits: a greedy allocation weighted by variance**(1 + alpha),
    levels by dimension (shared normal, Lloyd or exact), packed densely or in whole bytes. Lloyd
    and exact levels are trained on about `sample` rows drawn by a hash of the id, or on all
    rows if that is None."""

    name = "rankaware"

    def __init__(self, avg_bits: float = 4, alpha: float = 0.5, max_bits: int = 8, packing: str = "ffd", codebook: str = "lloyd", sample: int | None = 200_000):
        if not 1 <= max_bits <= 8 or packing not in ("dense", "ffd") or codebook not in ("gaussian", "lloyd", "exact"):
            raise ValueError("max_bits 1 to 8, packing dense or ffd, codebook gaussian, lloyd or exact")
        self.avg_bits, self.alpha, self.max_bits, self.packing, self.codebook, self.sample = avg_bits, alpha, max_bits, packing, codebook, sample

    def fit(self, x: DataFrame) -> RankAware:
        self.mean, self.axes, self.variance = moments.pca(x)
        self.dims = len(self.mean)
        self.bits = allocation.rank_aware(self.variance, self.avg_bits, self.alpha, self.max_bits)
        if self.codebook == "gaussian":
            self.levels = [allocation.normal_levels(1 << b)[0] * np.sqrt(v) for b, v in zip(self.bits, self.variance, strict=True)]
        else:
            turned = map_batches(x, lambda b: {"vec_id": b.column("vec_id"), "v": to_lists((to_matrix(b.column("v")) - self.mean) @ self.axes)}, "vec_id long, v array<double>")
            wanted = sorted({int(b) for b in self.bits})
            books = kmeans.per_dimension(turned, wanted, self.codebook, self.sample, of=[int(b) for b in self.bits])
            self.levels = [books[d, int(b)] for d, b in enumerate(self.bits)]
        self.byte, self.offset, self.size = bitpack.first_fit_layout([int(b) for b in self.bits])
        if self.packing == "dense":
            self.size = bitpack.dense_bytes(self.bits)
        return self

    def code_size(self) -> int:
        return max(1, self.size)

    def fields(self, codes: np.ndarray) -> np.ndarray:
        return bitpack.unpack_dense(codes, self.bits) if self.packing == "dense" else bitpack.unpack_layout(codes, self.bits, self.byte, self.offset)

    def table_bytes(self) -> int:
        return 8 * sum(len(c) for c in self.levels)

    def tables(self, queries: np.ndarray, metric: str) -> tuple[list[np.ndarray], np.ndarray]:
        """The axes are orthogonal, so distances about the mean are sums over them."""
        y = (queries - (self.mean if metric == "l2" else 0)) @ self.axes
        start = np.zeros(len(queries)) if metric == "l2" else queries @ self.mean
        return [_part(y[:, d : d + 1], c[:, None], metric) for d, c in enumerate(self.levels)], start

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        y = (rows - self.mean) @ self.axes
        own = np.stack([kmeans.levels_of(y[:, d], c) for d, c in enumerate(self.levels)], axis=1)
        if self.packing == "dense":
            return bitpack.pack_dense(own, self.bits)
        return bitpack.pack_layout(own, self.bits, self.byte, self.offset, self.size)

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        own = self.fields(codes)
        y = np.stack([c[own[:, d]] for d, c in enumerate(self.levels)], axis=1)
        return y @ self.axes.T + self.mean


class Segmented(Codec):
    """Principal axes cut into segments of equal bits. Each segment is rotated, put on a grid
    over its own largest entry or on levels of each dimension that are learned (codebook lloyd or
    exact, on about `sample` rows), and its codes are moved step by step while the cosine between
    segment and point grows. A row keeps for each segment its squared norm and the factor that
    scales the point (two float32).

    axes False takes the plain dimensions in place of the principal axes. prune: searches by
    estimate bound a row by its segments' norms first and decode only rows that may be among the
    best; the estimate is then never on the wrong side of that bound."""

    name = "saq"

    def __init__(self, avg_bits: float = 4, joint: bool = True, rounds: int = 6, block: int = 16, max_bits: int = 8, rotate: bool = True, seed: int = 0, metric: str = "l2", codebook: str = "grid", sample: int | None = 200_000, axes: bool = True, prune: bool = False):
        if codebook not in ("grid", "lloyd", "exact"):
            raise ValueError("codebook grid, lloyd or exact")
        self.metric = distance.metric(metric)
        self.avg_bits, self.joint, self.rounds, self.block, self.max_bits, self.rotate, self.seed = avg_bits, joint, rounds, block, max_bits, rotate, seed
        self.codebook, self.sample, self.principal, self.prune = codebook, sample, axes, prune

    def fit(self, x: DataFrame) -> Segmented:
        if self.principal:
            self.mean, self.axes, self.variance = moments.pca(x)
        else:
            got = moments.dim_stats(x)
            self.mean, self.variance, self.axes = got["mean"], got["var"], np.eye(len(got["mean"]))
        self.dims = len(self.mean)
        self.plan = allocation.segments(self.variance, self.avg_bits, self.block, self.max_bits, self.joint)
        self.turns = [moments.random_rotation(n, self.seed + i) if self.rotate else np.eye(n) for i, (n, _) in enumerate(self.plan)]
        if self.codebook != "grid":
            turned = map_batches(x, lambda b: {"vec_id": b.column("vec_id"), "v": to_lists(self._turned(to_matrix(b.column("v"))))}, "vec_id long, v array<double>")
            own = [b for n, b in self.plan for _ in range(n)]
            books = kmeans.per_dimension(turned, sorted({b for b in own if b}), self.codebook, self.sample, of=own)
            self.levels = [_square([books[d, bits] for d in range(own.start, own.stop)], 1 << bits) if bits else np.zeros((own.stop - own.start, 1)) for own, bits, _ in self._pieces()]
        return self

    def _turned(self, rows: np.ndarray) -> np.ndarray:
        y = (rows - self.mean) @ self.axes
        return np.concatenate([y[:, own] @ turn for own, _, turn in self._pieces()], axis=1)

    def code_size(self) -> int:
        return sum(-(-n * b // 8) + 8 for n, b in self.plan)

    def nominal_bytes(self, rows: int) -> int:
        return int(rows * self.dims * self.avg_bits / 8) + NORM_BYTES * rows

    def _pieces(self) -> list[tuple[slice, int, np.ndarray]]:
        at, out = 0, []
        for (n, bits), turn in zip(self.plan, self.turns, strict=True):
            out.append((slice(at, at + n), bits, turn))
            at += n
        return out

    def _levels(self, segment: int) -> np.ndarray:
        """(dimensions, 2**bits) levels of a segment, rising."""
        n, bits = self.plan[segment]
        return np.tile(grid(np.arange(1 << bits), bits), (n, 1)) if self.codebook == "grid" else self.levels[segment]

    def _encode(self, rows: np.ndarray) -> np.ndarray:
        y = (rows - self.mean) @ self.axes
        out = []
        for segment, (own, bits, turn) in enumerate(self._pieces()):
            o = y[:, own] @ turn
            norm2 = (o**2).sum(1)
            if not bits:
                out.append(np.stack([norm2, np.zeros(len(o))], 1).astype("<f4").view(np.uint8).reshape(len(o), 8))
                continue
            levels = self._levels(segment)
            if self.codebook == "grid":
                codes = grid_codes(o, bits)
            else:
                codes = np.stack([kmeans.levels_of(o[:, d], levels[d]) for d in range(o.shape[1])], axis=1)
            codes = adjust(o, codes, bits, self.rounds, levels=levels)
            point = levels[np.arange(o.shape[1]), codes]
            ip = (o * point).sum(1)
            scale = np.where(ip > 0, norm2 / np.where(ip > 0, ip, 1), 0)  # takes the point to the segment
            side = np.stack([norm2, scale], 1).astype("<f4").view(np.uint8).reshape(len(o), 8)
            out += [bitpack.pack_dense(codes, np.full(codes.shape[1], bits)), side]
        return np.concatenate(out, axis=1)

    def unpack(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each segment: its points in the rotated axes, squared norms, scales."""
        at, out = 0, []
        for segment, (n, bits) in enumerate(self.plan):
            size = -(-n * bits // 8)
            side = codes[:, at + size : at + size + 8].copy().view("<f4").astype(np.float64)
            if bits:
                point = self._levels(segment)[np.arange(n), bitpack.unpack_dense(codes[:, at : at + size], np.full(n, bits))]
            else:
                point = np.zeros((len(codes), n))
            out.append((point * side[:, 1:], side[:, 0], side[:, 1]))
            at += size + 8
        return out

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        y = np.concatenate([point @ turn.T for (point, _, _), turn in zip(self.unpack(codes), self.turns, strict=True)], axis=1)
        return y @ self.axes.T + self.mean

    def bound(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Least squared distances, or largest inner products, that the norms of a row's segments
        leave room for (queries, rows). Reads no codes but the norms beside them."""
        q = (queries if self.metric == "ip" else queries - self.mean) @ self.axes
        total = np.repeat((queries @ self.mean)[:, None], len(codes), 1) if self.metric == "ip" else np.zeros((len(q), len(codes)))
        at = 0
        for own, bits, _ in self._pieces():
            at += -(-(own.stop - own.start) * bits // 8)
            size = np.sqrt(codes[:, at : at + 4].copy().view("<f4").astype(np.float64).ravel())[None, :] * (1 + 1e-6)  # as a float32 may round it
            part = np.sqrt((q[:, own] ** 2).sum(1))[:, None]
            total += part * size if self.metric == "ip" else np.maximum(np.abs(part - size) - 2e-6 * size, 0) ** 2
            at += 8
        return total

    def estimate(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The estimates of `_estimate`, if `prune` within `bound`."""
        out = self._estimate(codes, queries)
        if not self.prune:
            return out
        return (np.minimum if self.metric == "ip" else np.maximum)(out, self.bound(codes, queries))

    def _estimate(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Estimated squared distances (queries, rows): for each segment the two squared norms
        less twice the scaled inner product; never below zero. Or inner products: those with the
        mean and with each segment's scaled point."""
        if self.metric == "ip":
            q = queries @ self.axes
            total = np.repeat((queries @ self.mean)[:, None], len(codes), 1)
            for (own, _, turn), (point, _, _) in zip(self._pieces(), self.unpack(codes), strict=True):
                total += q[:, own] @ turn @ point.T
            return total
        q = (queries - self.mean) @ self.axes
        total = np.zeros((len(q), len(codes)))
        for (own, _, turn), (point, norm2, _) in zip(self._pieces(), self.unpack(codes), strict=True):
            part = q[:, own] @ turn
            total += norm2[None, :] + (part**2).sum(1)[:, None] - 2 * part @ point.T
        return np.maximum(total, 0)


def grid_codes(o: np.ndarray, bits: int) -> np.ndarray:
    """Cells of a grid over [-v, v], v the row's largest entry."""
    top = 2**bits - 1
    v = np.abs(o).max(1, keepdims=True)
    step = 2 * v / (top + 1)
    return np.where(step > 0, np.clip(np.floor((o + v) / np.where(step > 0, step, 1)), 0, top), 0).astype(np.int64)


def grid(codes: np.ndarray, bits: int) -> np.ndarray:
    """Middles of the cells, on [-1, 1]."""
    return (codes + 0.5) * (2 / 2**bits) - 1


def adjust(o: np.ndarray, codes: np.ndarray, bits: int, rounds: int, eps: float = 1e-8, levels: np.ndarray | None = None) -> np.ndarray:
    """Moves codes by one level, dimension by dimension, as long as the cosine with o grows; a
    round without a move ends it. Rows go side by side, dimensions one after another. levels:
    (dimensions, 2**bits), rising; the grid's without them."""
    levels = np.tile(grid(np.arange(1 << bits), bits), (o.shape[1], 1)) if levels is None else levels
    codes, top, every = codes.copy(), levels.shape[1] - 1, np.arange(o.shape[1])
    for _ in range(rounds):
        point = levels[every, codes]
        ip, size = (o * point).sum(1), (point**2).sum(1)
        moves = 0
        for d in range(o.shape[1]):
            for sign in (1, -1):
                new = codes[:, d] + sign
                to = levels[d, np.clip(new, 0, top)]
                new_ip = ip + (to - point[:, d]) * o[:, d]
                new_size = size + to**2 - point[:, d] ** 2
                better = (new >= 0) & (new <= top) & (new_ip > 0) & ((ip**2 + eps * size) * new_size < new_ip**2 * size)
                moves += int(better.sum())
                codes[:, d] = np.where(better, new, codes[:, d])
                point[:, d] = np.where(better, to, point[:, d])
                ip, size = np.where(better, new_ip, ip), np.where(better, new_size, size)
        if not moves:
            break
    return codes


def _square(books: list[np.ndarray], width: int) -> np.ndarray:
    """Levels of several dimensions as one matrix; a dimension with fewer repeats its last one."""
    return np.stack([np.concatenate([b, np.full(width - len(b), b[-1])]) for b in books])


def downsample(codes: np.ndarray, bits: int, fewer: int) -> np.ndarray:
    """Codes of a finer grid as those of a coarser one."""
    return codes >> (bits - fewer)


def error_bound(o: np.ndarray, point: np.ndarray, factor: float = 1.9) -> np.ndarray:
    """Bound on the estimate of an inner product with a unit query."""
    norm2, ip = (o**2).sum(1), (o * point).sum(1)
    ratio = norm2 * (point**2).sum(1) / ip**2
    return factor * np.sqrt(norm2) * np.sqrt(np.maximum(ratio - 1, 0) / (o.shape[1] - 1))
