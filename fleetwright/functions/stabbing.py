"""First stretch of time that a periodic check falls into, for many checks at once in numpy.

Time is cut into cells of one period, and a moment is (cell, residue). A stretch covers an
interval of residues in each cell it touches; a check with residue r goes through the cells from
its first one on and stops at the first in which r is covered. A segment tree over the cells holds
in every node the union of its cells' intervals, so that a check climbs over free stretches of
any number and comes down again: two steps per level, however often the state changes.
"""

from __future__ import annotations

import numpy as np


def _union(node: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint sorted intervals on the line `node * width + residue`."""
    order = np.argsort(node * width + low, kind="stable")
    start, stop = (node * width + low)[order], (node * width + high)[order]
    reach = np.maximum.accumulate(stop)
    first = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((first[1:], [True]))
    return start[first], reach[last]


def _covered(union: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    spot = np.searchsorted(union[0], at, side="right") - 1
    return (spot >= 0) & (at < union[1][np.maximum(spot, 0)])


def first_cells(
    group: np.ndarray, a: np.ndarray, b: np.ndarray, asked_group: np.ndarray, asked: np.ndarray, residue: np.ndarray, period: int, cells: int
) -> np.ndarray:
    """For each check the first cell from `asked` on whose stretches cover its residue, or -1.

    Stretches [a, b) and cells count from the begin of their group, which has `cells` cells.
    """
    out = np.full(len(asked), -1, np.int64)
    if not len(a) or not len(asked):
        return out
    depth = max(cells - 1, 1).bit_length()
    times = (b - 1) // period - a // period + 1
    which = np.repeat(np.arange(len(a)), times)
    cell = a[which] // period + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    low = np.maximum(a[which] - cell * period, 0)
    high = np.minimum(b[which] - cell * period, period)
    # Residues by rank, so that (node, residue) fits into one number.
    ranks = np.unique(np.concatenate((low, high, residue)))
    low, high, place = (np.searchsorted(ranks, x) for x in (low, high, residue))
    width = len(ranks) + 1
    node = group[which] << depth | cell
    levels = []
    for _ in range(depth + 1):
        levels.append(_union(node, low, high, width))
        node = node >> 1
    at = asked_group << depth | asked
    found = np.full(len(asked), -1, np.int64)
    going = np.flatnonzero(asked < cells)
    for level in range(depth + 1):
        # A left child may still be covered by its parent's other half; its parent is tested later.
        odd = going[(at[going] & 1) == 1] if level < depth else going
        hit = odd[_covered(levels[level], at[odd] * width + place[odd])]
        found[hit] = level
        going = np.setdiff1d(going, hit, assume_unique=True)
        if level == depth:
            break
        at[going] = (at[going] + 1) >> 1
        # Behind the last cell of the group.
        going = going[at[going] >> (depth - level - 1) == asked_group[going]]
    for level in range(depth, 0, -1):
        here = np.flatnonzero(found == level)
        left = at[here] << 1
        inside = _covered(levels[level - 1], left * width + place[here])
        at[here] = left + ~inside
        found[here] = level - 1
    done = found == 0
    out[done] = at[done] & ((1 << depth) - 1)
    return out
