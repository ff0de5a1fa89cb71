"""Segmented codes in blocks of 32 rows, and a search that reads them in three stages.

A block is one row of a table: the ids of its rows, and for each segment a plane of the highest
bits of all codes (short: dimension 0 at bit 7 of the first byte), the other bits (long: a stream
of low bits first) and six factors a row as float32. The last block of a run is filled up with
zero rows, which have no id. `from_blocks` gives the codes back byte for byte.

Factors, for o the row's segment and P the scaled point that its code stands for: |o|^2, the scale,
the error factor of the estimate of <o, q> for a unit q, |P|, and P in terms of the one-bit point h
of the short plane: P = along h + r, |r| beside.

The search keeps, for each query, the k rows of least estimate, and leaves a row as soon as a bound
on its estimate is above the k-th one:

1. lengths: <P, q> is at most |P| |q|; reads factors alone;
2. one bit: <P, q> is along <h, q>, give or take |r| times what is left of q beside h; reads the
   short plane of rows that are left;
3. full codes of the rows that are left, segment by segment; after each one the bounds of the
   others stand in for them.

The bounds hold for every row (rounding is allowed for), so the results are those of the search
without stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.functions.arrays import ROWS, from_binary, to_binary
from vecpress.operators import bitpack, grid
from vecpress.operators.codecs import Segmented
from vecpress.operators.knn import SCHEMA, TILE, Top, best, nothing, top

#: Rows of a block. A fixed value of the format.
BLOCK = 32
FACTORS = ("norm2", "scale", "error", "length", "along", "beside")
#: Width of the error factor's interval. A fixed value of the format.
ERROR_WIDTH = 1.9
#: Blocks that meet queries at a time, and rows of a cell that one task puts into blocks in order of their ids.
SLAB = 64
RUN = 1 << 20
#: Part of the lengths that rounding may add to a bound.
SLACK = 2e-6

_SCHEMA = "cell int, block long, ids array<long>, short array<binary>, long array<binary>, factors array<binary>"


def halves(codec: Segmented, segment: int) -> np.ndarray:
    """(dimensions, 2) the one-bit point: the mean level of the lower and of the upper half."""
    levels = codec._levels(segment)
    return levels.reshape(len(levels), 2, -1).mean(axis=2)


def split(codec: Segmented, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each segment (short, long, factors) of packed codes: bytes by row, and (rows, 6) float32."""
    at, out = 0, []
    for segment, (n, bits) in enumerate(codec.plan):
        size = -(-n * bits // 8)
        side = codes[:, at + size : at + size + 8].copy().view("<f4")
        norm2, scale = side[:, 0].astype(np.float64), side[:, 1].astype(np.float64)
        factors = np.zeros((len(codes), len(FACTORS)), np.float32)
        factors[:, :2] = side
        if not bits:
            empty = np.zeros((len(codes), 0), np.uint8)
            out.append((empty, empty, factors))
            at += size + 8
            continue
        own = bitpack.unpack_dense(codes[:, at : at + size], np.full(n, bits))
        high = own >> (bits - 1)
        low = own & ((1 << (bits - 1)) - 1)
        rest = (low[:, :, None] >> np.arange(bits - 1) & 1).astype(np.uint8).reshape(len(own), -1)
        point = codec._levels(segment)[np.arange(n), own] * scale[:, None]
        h = halves(codec, segment)[np.arange(n), high]
        h2 = (h**2).sum(1)
        along = np.where(h2 > 0, (point * h).sum(1) / np.where(h2 > 0, h2, 1), 0).astype(np.float32)
        length = np.sqrt((point**2).sum(1))
        ratio = np.where(norm2 > 0, length**2 / np.where(norm2 > 0, norm2, 1), 1)
        factors[:, 2] = ERROR_WIDTH * np.sqrt(norm2) * np.sqrt(np.maximum(ratio - 1, 0) / max(n - 1, 1))
        factors[:, 3], factors[:, 4] = length, along
        factors[:, 5] = np.sqrt(((point - along[:, None].astype(np.float64) * h) ** 2).sum(1))
        out.append((np.packbits(high.astype(bool), axis=1), np.packbits(rest, axis=1, bitorder="little"), factors))
        at += size + 8
    return out


def joined(codec: Segmented, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The packed codes of `split` parts."""
    out = []
    for segment, (short, rest, factors) in enumerate(parts):
        n, bits = codec.plan[segment]
        if bits:
            out.append(bitpack.pack_dense(full_codes(short, rest, n, bits), np.full(n, bits)))
        out.append(np.ascontiguousarray(factors[:, :2]).astype("<f4").view(np.uint8).reshape(len(factors), 8))
    return np.concatenate(out, axis=1)


def full_codes(short: np.ndarray, rest: np.ndarray, n: int, bits: int) -> np.ndarray:
    high = np.unpackbits(short, axis=1)[:, :n].astype(np.int64) << (bits - 1)
    if bits == 1:
        return high
    low = np.unpackbits(rest, axis=1, bitorder="little")[:, : n * (bits - 1)].reshape(len(short), n, bits - 1)
    return high | (low.astype(np.int64) << np.arange(bits - 1)).sum(axis=2)


def to_blocks(codec: Segmented, codes: DataFrame) -> DataFrame:
    """Blocks of codes (vec_id, code), or (cell, vec_id, code): a block holds rows of one cell, in
    order of their ids. A cell of more than RUN rows is dealt by hash to several runs."""
    spark = codes.sparkSession
    rows = codes if "cell" in codes.columns else codes.withColumn("cell", F.lit(0))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))  # a row a cell
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("run", F.pmod(F.xxhash64("vec_id", F.lit(19)), F.col("runs")).cast("int"))
    dealt = dealt.select("cell", "run", "vec_id", "code").repartition("cell", "run").sortWithinPartitions("cell", "run", "vec_id")
    sent = spark.sparkContext.broadcast(codec)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, number, held = sent.value, None, 0, []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole blocks of what is held, and with `last` the rest."""
            nonlocal number, held
            ids, code = np.concatenate([i for i, _ in held]), np.concatenate([c for _, c in held])
            count = -(-len(ids) // BLOCK) if last else len(ids) // BLOCK
            used = min(len(ids), count * BLOCK)
            held = [(ids[used:], code[used:])]
            if not count:
                return
            parts = split(codec, code[:used])
            fill = count * BLOCK - used
            shaped = [[np.concatenate([p, np.zeros((fill, p.shape[1]), p.dtype)]).reshape(count, -1) for p in part] for part in parts]
            columns = {
                "cell": pa.array(np.full(count, now[0], np.int32)),
                "block": pa.array(np.arange(number, number + count) + (now[1] << 40)),
                "ids": pa.array([ids[i * BLOCK : (i + 1) * BLOCK] for i in range(count)], pa.list_(pa.int64())),
            }
            for j, name in enumerate(("short", "long", "factors")):
                columns[name] = pa.array([[part[j][i].tobytes() for part in shaped] for i in range(count)], pa.list_(pa.binary()))
            number += count
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    here = (int(at[a, 0]), int(at[a, 1]))
                    if here != now:
                        if held:
                            yield from blocks(True)
                        now, number, held = here, 0, []
                    part = batch.slice(a, b - a)
                    held.append((part.column(2).to_numpy(), from_binary(part.column(3))))
                    yield from blocks(False)
        if held:
            yield from blocks(True)

    return dealt.mapInArrow(build, _SCHEMA)


def _rows(codec: Segmented, batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Ids of the rows of blocks, and for each segment their short and long bytes and factors."""
    lists = batch.column(batch.schema.get_field_index("ids"))
    counts = np.array([len(x) for x in lists.to_pylist()])
    real = (np.arange(BLOCK)[None, :] < counts[:, None]).ravel()
    ids = lists.flatten().to_numpy()
    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("short", "long", "factors")]
    parts = []
    for segment, (n, bits) in enumerate(codec.plan):
        widths = (-(-n // 8) if bits else 0, -(-n * (bits - 1) // 8) if bits else 0)
        planes = [np.frombuffer(b"".join(r[segment] for r in column), np.uint8).reshape(len(real), w)[real] for column, w in zip(columns, widths, strict=False)]
        factors = np.frombuffer(b"".join(r[segment] for r in columns[2]), "<f4").reshape(len(real), -1)[real]
        parts.append((*planes, factors))
    return ids, parts


def from_blocks(codec: Segmented, blocks: DataFrame) -> DataFrame:
    """(cell, vec_id, code) of blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLAB):
                batch = whole.slice(i, SLAB)
                ids, parts = _rows(sent.value, batch)
                counts = [len(x) for x in batch.column(2).to_pylist()]
                cell = np.repeat(batch.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids), to_binary(joined(sent.value, parts))], names=["cell", "vec_id", "code"])

    return blocks.select("cell", "block", "ids", "short", "long", "factors").mapInArrow(run, "cell int, vec_id long, code binary")


class _Slab:
    """Rows of some blocks. What is decoded of a row is kept for the queries that follow."""

    def __init__(self, codec: Segmented, batch: pa.RecordBatch):
        self.codec, (self.ids, self.parts) = codec, _rows(codec, batch)
        self.kept: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

    def _decoded(self, what: str, segment: int, some: np.ndarray, width: int, decode) -> np.ndarray:
        done, held = self.kept.setdefault((what, segment), (np.zeros(len(self.ids), bool), np.empty((len(self.ids), width))))
        new = some[~done[some]]
        if len(new):
            held[new], done[new] = decode(new), True
        return held if len(some) == len(held) else held[some]

    def one_bit(self, segment: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-bit points of the rows `some`, and their squared lengths (1, rows)."""
        (n, _), short = self.codec.plan[segment], self.parts[segment][0]

        def decode(new: np.ndarray) -> np.ndarray:
            h = halves(self.codec, segment)[np.arange(n), np.unpackbits(short[new], axis=1)[:, :n]]
            return np.concatenate([h, np.maximum((h**2).sum(1), 1e-300)[:, None]], axis=1)

        both = self._decoded("h", segment, some, n + 1, decode)
        return both[:, :n], both[:, n][None, :]

    def point(self, segment: int, some: np.ndarray) -> np.ndarray:
        """The points that the full codes of the rows `some` stand for."""
        (n, bits), (short, rest, factors) = self.codec.plan[segment], self.parts[segment]
        levels = self.codec._levels(segment)
        return self._decoded("p", segment, some, n, lambda new: levels[np.arange(n), full_codes(short[new], rest[new], n, bits)] * factors[new, 1].astype(np.float64)[:, None])


class Staged:
    """A strip's rows of least estimate, by three stages. Counts pairs of a query and a row that
    each stage leaves."""

    tile = TILE

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, codec: Segmented, centroids: np.ndarray | None = None, count: bool = False):
        self.names, self.q, self.codec, self.centroids, self.count, self.top = names, q, codec, centroids, count, Top(len(q), k)
        self.left = np.zeros(4, np.int64)

    def add(self, rows: pa.RecordBatch, to: np.ndarray, cell: int) -> None:
        q, plus = self.q, np.zeros(len(self.q))
        if self.centroids is not None and self.codec.metric == "l2":
            q = q - self.centroids[cell]
        elif self.centroids is not None:
            plus = q @ self.centroids[cell]
        for i in range(0, rows.num_rows, SLAB):
            slab = _Slab(self.codec, rows.slice(i, SLAB))
            for j in range(0, len(to), self.tile):
                own = to[j : j + self.tile]
                self._stages(slab, own, q[own], plus[own])

    def _stages(self, slab: _Slab, own: np.ndarray, q: np.ndarray, plus: np.ndarray) -> None:
        codec, l2, ids, parts = self.codec, self.codec.metric == "l2", slab.ids, slab.parts
        turned = (q - codec.mean if l2 else q) @ codec.axes
        start = np.zeros(len(q)) if l2 else -(q @ codec.mean + plus)
        kth, pieces = self.top.kth(own)[:, None], codec._pieces()
        asked = [turned[:, at] @ turn for at, _, turn in pieces]
        size2 = [(a**2).sum(1) for a in asked]
        times = 2.0 if l2 else 1.0
        base = [p[2][None, :, 0].astype(np.float64) + s[:, None] if l2 else np.zeros((len(q), len(ids))) for p, s in zip(parts, size2, strict=True)]
        slack = SLACK * times * sum(np.sqrt(s)[:, None] * p[2][None, :, 3] for p, s in zip(parts, size2, strict=True)) + SLACK * sum(base)

        # lengths
        bounds = [b - times * np.sqrt(s)[:, None] * p[2][None, :, 3] for b, s, p in zip(base, size2, parts, strict=True)]
        bound = start[:, None] + sum(bounds) - slack
        alive = bound <= kth
        self.left[0] += alive.size
        self.left[1] += int(alive.sum())
        # one bit
        some = np.flatnonzero(alive.any(axis=0))
        if not len(some):
            return
        alive, slack = alive[:, some], slack[:, some]
        bounds = []
        for segment, ((_, bits), (_, _, factors)) in enumerate(zip(codec.plan, parts, strict=True)):
            if not bits:
                bounds.append(base[segment][:, some])
                continue
            h, h2 = slab.one_bit(segment, some)
            ip = asked[segment] @ h.T
            rest = np.sqrt(np.maximum(size2[segment][:, None] - ip**2 / h2, 0))
            near = factors[None, some, 4] * ip + factors[None, some, 5] * rest
            bounds.append(base[segment][:, some] - times * near)
        bound = start[:, None] + sum(bounds)
        alive &= bound - slack <= kth
        self.left[2] += int(alive.sum())
        # full codes, segment by segment
        for segment, (_, bits) in enumerate(codec.plan):
            keep = np.flatnonzero(alive.any(axis=0))
            if len(keep) < len(some):
                some, alive, slack, bound = some[keep], alive[:, keep], slack[:, keep], bound[:, keep]
                bounds = [b[:, keep] for b in bounds]
            if not len(some):
                return
            if not bits:
                continue
            point = slab.point(segment, some)
            bound = bound + (base[segment][:, some] - times * (asked[segment] @ point.T)) - bounds[segment]
            alive &= bound - slack <= kth
        self.left[3] += int(alive.sum())
        exact = np.maximum(bound, 0) if l2 else bound
        cost = np.where(alive, exact, np.inf)
        a, b = best(cost, np.zeros_like(cost), self.top.k, self.top.kth(own))
        real = np.isfinite(cost[a, b])
        self.top.add(own[a[real]], ids[some[b[real]]], cost[a[real], b[real]])

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            stages = pa.array(np.arange(4, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([stages, pa.array(self.left), pa.array(np.zeros(4))], names=["qid", "id", "score"])
        else:
            yield from self.top.batch(self.names, 1.0 if self.codec.metric == "l2" else -1.0)


def _spread(blocks: DataFrame) -> DataFrame:
    """Blocks dealt once to all tasks: a run of RUN rows comes from a single one."""
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), blocks.sparkSession.sparkContext.defaultParallelism)
    return blocks.repartition(tasks, "cell", "block")


def staged_search(codec: Segmented, blocks: DataFrame, queries: DataFrame, k: int, centroids: np.ndarray | None = None, probe=None, strip: int | None = None) -> DataFrame:
    """(qid, rk, id, score): the k rows of least estimated distance, or of largest estimated inner
    product. With `probe`, which gives the cells of queries, and the centroids of an index only
    the blocks of probed cells are read, whose codes are of residuals."""
    if k <= 0:
        return nothing(blocks)
    sent = blocks.sparkSession.sparkContext.broadcast((codec, centroids))
    found = grid.match(_spread(blocks), queries, lambda names, q: Staged(names, q, k, sent.value[0], sent.value[1]), SCHEMA, probe=probe, strip=strip, key="block")
    return top(found, k, codec.metric == "l2")


def stage_counts(codec: Segmented, blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(stage, pairs): pairs of a query and a row at the start, and left by the lengths, by one bit
    and by the full codes. They depend on the order in which tasks meet rows."""
    sent = blocks.sparkSession.sparkContext.broadcast(codec)
    found = grid.match(blocks, queries, lambda names, q: Staged(names, q, k, sent.value, count=True), SCHEMA, key="block")
    return found.groupBy(F.col("qid").cast("int").alias("stage")).agg(F.sum("id").alias("pairs"))
