"""Suffix arrays by linear grouping, after Baier's published method: suffixes are grouped by their longest Lyndon prefix, and sorted from that.

Groups start as those of the first symbol and are processed from the highest down. Each suffix of the group at hand points to the nearest
one before it that is in a lower group; what is pointed to moves up into a new group just above its old one, the
higher the more pointers it gets. After that, one pass from the least suffix on puts each suffix into the next free place
of its group. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

import numpy as np


def _grouped(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For each suffix the first place of its Lyndon group in the final order, and its previous smaller suffix (or -1)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(symbols[order]) != 0, [True]]))
    starts, ends = cuts[:-1], cuts[1:]
    where = np.empty(n, np.int64)
    where[order] = np.repeat(starts, ends - starts)
    group: list[int] = where.tolist()
    end_of: dict[int, int] = dict(zip(starts.tolist(), ends.tolist(), strict=True))
    start_of: dict[int, int] = {e: s for s, e in end_of.items()}
    # in order of the text; members that have moved on are passed over when their turn comes
    listed: dict[int, list[int]] = {s: order[s:e].tolist() for s, e in end_of.items()}
    prev = [-1] * n
    at = n
    while at:
        low = start_of[at]
        by_pointers: dict[int, list[int]] = {}
        last, pointers = -1, 0
        for i in listed.pop(low):
            if group[i] != low:
                continue
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = prev[j]
            prev[i] = j
            # pointers never go back along the text, so that equal ones are neighbours
            if j == last:
                pointers += 1
                continue
            if last >= 0:
                by_pointers.setdefault(pointers, []).append(last)
            last, pointers = j, 1
        if last >= 0:
            by_pointers.setdefault(pointers, []).append(last)
        for pointers in sorted(by_pointers, reverse=True) if len(by_pointers) > 1 else by_pointers:
            leaving: dict[int, list[int]] = {}
            for j in by_pointers[pointers]:
                g = group[j]
                if g in leaving:
                    leaving[g].append(j)
                else:
                    leaving[g] = [j]
            for g, moved in leaving.items():
                end = end_of[g]
                new = end - len(moved)
                listed[new] = moved
                if new == g:
                    continue
                for j in moved:
                    group[j] = new
                start_of[end], end_of[new] = new, end
                start_of[new], end_of[g] = g, new
        at = low
    return group, prev


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order. The last symbol must be the least, and occur nowhere else."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    free, prev = _grouped(symbols)
    next_place = list(range(n))
    placed = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = free[j]
            out[next_place[g]] = j
            next_place[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out, np.int64)


def neighbours_alike(symbols: np.ndarray, order: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, how many first symbols it shares with the suffix before or after it in ``order``, whichever is more; ``most`` at most.

    No more than ``room`` symbols of a suffix count.
    """
    n = len(order)
    padded = np.concatenate([symbols, np.full(most, -1, symbols.dtype)])
    alike = np.zeros(n, np.int64)
    going = np.arange(n - 1)
    for k in range(most):
        a, b = order[going], order[going + 1]
        same = (padded[a + k] == padded[b + k]) & (room[a] > k) & (room[b] > k)
        going = going[same]
        if not len(going):
            break
        alike[going] = k + 1
    out = np.zeros(n, np.int64)
    out[order[:-1]] = alike[: n - 1]
    out[order[1:]] = np.maximum(out[order[1:]], alike[: n - 1])
    return out
