"""Bit packing: dense fields, most significant bit first, and whole fields in bytes by first fit."""

from __future__ import annotations

import numpy as np


def dense_bytes(widths: np.ndarray) -> int:
    return -(-int(np.sum(widths)) // 8)


def pack_dense(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """(n, D) codes with `widths` bits each to (n, ceil(sum/8)) bytes."""
    bits = [(codes[:, d, None] >> np.arange(w - 1, -1, -1)) & 1 for d, w in enumerate(widths) if w]
    if not bits:
        return np.zeros((len(codes), 0), np.uint8)
    return np.packbits(np.concatenate(bits, axis=1).astype(np.uint8), axis=1)


def unpack_dense(packed: np.ndarray, widths: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1)
    out, at = np.zeros((len(packed), len(widths)), np.int64), 0
    for d, w in enumerate(widths):
        for _ in range(w):
            out[:, d] = out[:, d] << 1 | bits[:, at]
            at += 1
    return out


def first_fit_layout(widths: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(byte, bit offset, bytes) of each field: widest first, ties by number, the fours after the
    threes, each into the first byte with room. Fields of width 0 are at -1, -1."""
    if any(not 0 <= w <= 8 for w in widths):
        raise ValueError("widths must be 0 to 8")
    turn = {w: 3.5 if w == 3 else 3 if w == 4 else w for w in range(9)}
    order = sorted((d for d, w in enumerate(widths) if w), key=lambda d: (-turn[widths[d]], d))
    byte, offset = np.full(len(widths), -1), np.full(len(widths), -1)
    used: list[int] = []
    for d in order:
        at = next((i for i, u in enumerate(used) if u + widths[d] <= 8), len(used))
        if at == len(used):
            used.append(0)
        byte[d], offset[d] = at, used[at]
        used[at] += widths[d]
    return byte, offset, len(used)


def pack_layout(codes: np.ndarray, widths: np.ndarray, byte: np.ndarray, offset: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(codes), size), np.uint8)
    for d, w in enumerate(widths):
        if w:
            out[:, byte[d]] |= (codes[:, d] << (8 - offset[d] - w)).astype(np.uint8)
    return out


def unpack_layout(packed: np.ndarray, widths: np.ndarray, byte: np.ndarray, offset: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed), len(widths)), np.int64)
    for d, w in enumerate(widths):
        if w:
            out[:, d] = packed[:, byte[d]].astype(np.int64) >> (8 - offset[d] - w) & ((1 << w) - 1)
    return out


def optimal_bytes(widths: list[int]) -> int:
    """The fewest bytes that hold whole fields: branch and bound over counts of widths."""
    counts = [sum(w == k for w in widths) for k in range(9)]
    _, _, best = first_fit_layout(widths)
    seen: dict[tuple[int, ...], int] = {}

    def fill(left: list[int], used: int) -> None:
        nonlocal best
        bound = used + -(-sum(k * c for k, c in enumerate(left)) // 8)
        state = tuple(left)
        if bound >= best or seen.get(state, 1 << 30) <= used:
            if not any(left[1:]):
                best = min(best, used)
            return
        seen[state] = used
        widest = max((k for k in range(1, 9) if left[k]), default=0)
        if not widest:
            best = min(best, used)
            return
        # a byte with the widest field, filled in every maximal way
        def rest(room: int, most: int, now: list[int]) -> None:
            fits = [k for k in range(min(most, room), 0, -1) if now[k]]
            if not fits:
                fill(now, used + 1)
            for k in fits:
                after = now.copy()
                after[k] -= 1
                rest(room - k, k, after)

        after = left.copy()
        after[widest] -= 1
        rest(8 - widest, widest, after)

    fill(counts, 0)
    return best


def largest_budget(bits_for, budget_bytes: int, low: int, high: int) -> int:
    """The largest bit budget whose first-fit layout takes at most budget_bytes, by halving."""
    while low < high:
        mid = (low + high + 1) // 2
        if first_fit_layout(list(bits_for(mid)))[2] <= budget_bytes:
            low = mid
        else:
            high = mid - 1
    return low
