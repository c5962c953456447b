"""First-fit decreasing over a histogram of sizes.

Equal items need no order among themselves, so the packing is worked out on (size, count) pairs; its
result is a short table of segments, from which every item finds its bin by its rank among the items
of its size. The work and the result depend on the number of distinct sizes, not on the items.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple


class Segment(NamedTuple):
    """Items of `size` with ranks from first_rank on fill `bins` bins from first_bin on, per_bin each."""

    size: int
    first_rank: int
    per_bin: int
    first_bin: int
    bins: int


def first_fit_decreasing(counts: Mapping[int, int], capacity: int, first_bin: int = 0, ranks: Mapping[int, int] | None = None) -> tuple[list[Segment], int]:
    """(segments, number of bins opened). Bins with equal history are kept as one run of (first, number, room).

    Sizes above the capacity are an error: the caller splits or sets such items aside. `ranks` gives the
    first rank of each size, where earlier ranks are packed already.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    sizes = sorted((s for s, n in counts.items() if n > 0), reverse=True)
    if sizes and (sizes[0] > capacity or sizes[-1] < 0):
        raise ValueError("a size lies outside of 0..capacity")
    least = sizes[-1] if sizes else 0
    runs: list[tuple[int, int, int]] = []
    segments: list[Segment] = []
    opened = first_bin
    for size in sizes:
        left, rank = counts[size], (ranks or {}).get(size, 0)
        kept: list[tuple[int, int, int]] = []

        def put(first: int, bins: int, room: int) -> None:
            nonlocal left, rank
            per = left if size == 0 else room // size
            whole = min(bins, left // per)
            if whole:
                segments.append(Segment(size, rank, per, first, whole))
                left, rank = left - whole * per, rank + whole * per
                keep(first, whole, room - per * size)
            if whole < bins and left:
                segments.append(Segment(size, rank, left, first + whole, 1))
                keep(first + whole, 1, room - left * size)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < bins:
                keep(first + whole, bins - whole, room)

        def keep(first: int, bins: int, room: int) -> None:
            if room >= max(least, 1):
                kept.append((first, bins, room))

        for i, (first, bins, room) in enumerate(runs):
            if not left:
                kept.extend(runs[i:])
                break
            if room < size:
                kept.append((first, bins, room))
            else:
                put(first, bins, room)
        if left:
            need = 1 if size == 0 else -(-left // (capacity // size))
            opened, first = opened + need, opened
            put(first, need, capacity)
        runs = kept
    return segments, opened - first_bin
