"""Bits for dimensions: greedy, optimal and analytic allocation, and sub-quantizer counts.

Vectors of costs have D times a few entries, whatever the number of rows, so this runs on the
driver. Where gains fall from bit to bit the greedy rule is one ranking of all gains, and its
result the least cost, which SQL can check.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
from pyspark.sql import DataFrame

from vecpress.operators.kmeans import lloyd_1d

MAX_BITS = 8
#: Draws and seed of the standard normal sample behind the shared levels.
NORMAL_DRAWS, NORMAL_SEED = 200_000, 0


@functools.cache
def normal_levels(levels: int) -> tuple[np.ndarray, float]:
    """Lloyd levels of N(0, 1) and their mean squared error over the variance; one level is 0, 1."""
    if levels == 1:
        return np.zeros(1), 1.0
    draws = np.random.default_rng(NORMAL_SEED).standard_normal(NORMAL_DRAWS)
    c, mse = lloyd_1d(draws, levels)
    return c, mse / float(draws.var())


def normal_distortion(max_bits: int = MAX_BITS) -> np.ndarray:
    return np.array([normal_levels(1 << b)[1] for b in range(max_bits + 1)])


def greedy(gains: np.ndarray, budget: int, stop_at_loss: bool = False) -> np.ndarray:
    """Bits of each dimension: each step gives a bit where it gains most, ties to the lowest
    dimension. gains[d, b] is the gain of bit b + 1."""
    bits = np.zeros(len(gains), int)
    heap = [(-g[0], d) for d, g in enumerate(gains)]
    heapq.heapify(heap)
    while budget > 0 and heap:
        gain, d = heapq.heappop(heap)
        if stop_at_loss and gain >= 0:
            break
        bits[d] += 1
        budget -= 1
        if bits[d] < gains.shape[1]:
            heapq.heappush(heap, (-gains[d, bits[d]], d))
    return bits


def rank_aware_gains(variance: np.ndarray, alpha: float, max_bits: int = MAX_BITS) -> np.ndarray:
    dist = normal_distortion(max_bits)
    return variance[:, None] ** (1 + alpha) * (dist[:-1] - dist[1:])[None, :]


def rank_aware(variance: np.ndarray, avg_bits: float, alpha: float = 0.0, max_bits: int = MAX_BITS) -> np.ndarray:
    return greedy(rank_aware_gains(variance, alpha, max_bits), round(avg_bits * len(variance)))


def empirical(costs: np.ndarray, budget: int) -> np.ndarray:
    """Greedy over a cost table (D, bits + 1), stopping when no bit helps."""
    return greedy(costs[:, :-1] - costs[:, 1:], budget, stop_at_loss=True)


def optimal(costs: np.ndarray, budget: int) -> np.ndarray:
    """Least total cost within the budget, by a min-plus programme over dimensions."""
    best = np.zeros(budget + 1)
    picks = []
    for row in costs:
        options = np.full((len(row), budget + 1), np.inf)
        for b, c in enumerate(row):
            if b <= budget:
                options[b, b:] = best[: budget + 1 - b] + c
        picks.append(options.argmin(0))
        best = options.min(0)
    bits, left = [], budget
    for pick in reversed(picks):
        bits.append(int(pick[left]))
        left -= bits[-1]
    return np.array(bits[::-1])


def scalar_costs(x: DataFrame, max_bits: int = 5) -> np.ndarray:
    """(D, max_bits + 1) measured squared error of each dimension under a grid between its ends,
    in one pass. Without bits a row is the mean; the two points of one bit are the ends, which
    often is worse, so the costs of a dimension need not be convex, nor fall."""
    from vecpress.functions.arrays import reduce_tables
    from vecpress.operators import moments

    got = moments.dim_stats(x)
    mean, low, span = got["mean"], got["mn"], got["mx"] - got["mn"]

    def fold(m: np.ndarray) -> dict[str, np.ndarray]:
        errors = [((m - mean) ** 2).sum(0)]
        for bits in range(1, max_bits + 1):
            top = 2**bits - 1
            near = np.rint((m - low) / np.where(span > 0, span, 1) * top) / top * span + low
            errors.append(((m - near) ** 2).sum(0))
        return {"e": np.stack(errors, axis=1)}

    return reduce_tables(x, fold, {"e": np.add})["e"].reshape(-1, max_bits + 1)


def bennett(variance: np.ndarray, budget: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Greedy over the analytic curve variance / 2**bits."""
    curve = variance[:, None] / 2.0 ** np.arange(max_bits + 1)[None, :]
    return greedy(curve[:, :-1] - curve[:, 1:], budget)


def rescore(bits: np.ndarray, costs: np.ndarray) -> float:
    return float(costs[np.arange(len(bits)), bits].sum())


def segments(variance: np.ndarray, avg_bits: float, block: int = 64, max_bits: int = MAX_BITS, joint: bool = True) -> list[tuple[int, int]]:
    """Segment plan [(dimensions, bits)] over blocks of `block` dimensions: by a joint programme
    over blocks or greedily; neighbours with equal bits are one segment."""
    sizes = [min(block, len(variance) - i) for i in range(0, len(variance), block)]
    dist = normal_distortion(max_bits)
    weight = np.array([variance[i : i + block].sum() for i in range(0, len(variance), block)])
    costs = weight[:, None] * dist[None, :]
    unit = int(np.gcd.reduce(sizes))
    budget = int(avg_bits * len(variance)) // unit
    if joint:
        best = np.zeros(budget + 1)
        picks = []
        for row, size in zip(costs, sizes, strict=True):
            step = size // unit
            options = np.full((max_bits + 1, budget + 1), np.inf)
            for b in range(max_bits + 1):
                if b * step <= budget:
                    options[b, b * step :] = best[: budget + 1 - b * step] + row[b]
            picks.append(options.argmin(0))
            best = options.min(0)
        bits, left = [], budget
        for pick, size in zip(reversed(picks), reversed(sizes), strict=True):
            bits.append(int(pick[left]))
            left -= bits[-1] * size // unit
        bits = bits[::-1]
    else:
        bits, left = [0] * len(sizes), budget
        while True:
            gains = [(costs[i, b] - costs[i, b + 1], -i) if b < max_bits and sizes[i] // unit <= left else (0.0, 0) for i, b in enumerate(bits)]
            gain, i = max(gains)
            if gain <= 0:
                break
            bits[-i] += 1
            left -= sizes[-i] // unit
    plan: list[tuple[int, int]] = []
    for size, b in zip(sizes, bits, strict=True):
        plan = [*plan[:-1], (plan[-1][0] + size, b)] if plan and plan[-1][1] == b else [*plan, (size, b)]
    return plan


# --- bits a dimension -> parameters ------------------------------------------------------


def largest_divisor(dims: int, most: int) -> int:
    """The largest divisor of dims that is at most `most`."""
    return next(m for m in range(max(1, min(most, dims)), 0, -1) if dims % m == 0)


def subquantizers(bpd: float, dims: int) -> int:
    """Of 8 bits each; used everywhere."""
    return largest_divisor(dims, round(bpd * dims) // 8)


def subquantizers_floor(bpd: int, dims: int) -> int:
    """Whole bits a dimension, the product floored, then down to a divisor."""
    return largest_divisor(dims, dims * bpd // 8)


def subquantizers_clamped(bpd: float, dims: int, divisible: bool = False) -> int:
    """The floored product within 1..dims, made a divisor only on demand."""
    m = max(1, min(dims, int(bpd * dims) // 8))
    return largest_divisor(dims, m) if divisible else m


def scalar_bits(bpd: float) -> int:
    return 4 if bpd <= 4.5 else 8 if bpd <= 12 else 16


def scalar_bits_exact(bpd: float) -> int:
    return int(bpd) if bpd in (4, 8, 16) else 8
