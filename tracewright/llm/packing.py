"""Bin packing of items with integer sizes, given as how many there are of each size.

An instance of any length is at most `capacity` numbers, so it is solved exactly
as large ones are: fixed sets and bins are held as patterns with a multiplicity.
"""

from __future__ import annotations

from bisect import bisect_left, insort

#: A pattern: (sizes with how many of each, how many bins look like that).
Pattern = tuple[list[tuple[int, int]], int]


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello and Toth's reduction: (patterns that some best packing has, what remains).

    For an item of size s with room r beside it, a set is fixed if it dominates
    all others with s: s alone, if nothing fits beside it; s with an item of
    exactly r; s with the largest item that fits, if no two others fit together, or
    if no two that fit together are larger than that item while no three fit.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for s in sorted(left, reverse=True):
            while left.get(s):
                partner = _partner(left, s, capacity - s)
                if partner is None:
                    break
                changed = True
                if partner == 0:
                    fixed.append(([(s, 1)], left.pop(s)))
                elif partner == s:
                    fixed.append(([(s, 2)], left[s] // 2))
                    left[s] %= 2
                else:
                    n = min(left[s], left[partner])
                    fixed.append(([(s, 1), (partner, 1)], n))
                    left[s] -= n
                    left[partner] -= n
                left = {k: n for k, n in left.items() if n}
    return fixed, left


def _partner(left: dict[int, int], s: int, room: int) -> int | None:
    """The item that is fixed beside one of size s: 0 for none, None if nothing dominates."""
    others = left | {s: left[s] - 1}
    sizes = sorted(k for k, n in others.items() if n and k <= room)
    if not sizes:
        return 0
    largest = sizes[-1]
    if largest == room:
        return largest
    smallest: list[int] = []
    for k in sizes:
        smallest += [k] * min(3 - len(smallest), others[k])
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return largest
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        a, b = sizes[i], sizes[j]
        if a + b > room:
            j -= 1
        else:
            if i < j or others[a] > 1:
                best = max(best, a + b)
            i += 1
    return largest if largest >= best else None


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, largest first: each item goes to the fullest open bin that has room."""
    open_rooms: list[int] = []
    bins: dict[int, list[Pattern]] = {}

    def put(items: list[tuple[int, int]], n: int, room: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(open_rooms, room)
        bins[room].append((items, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(open_rooms, s)
            if at < len(open_rooms):
                room = open_rooms[at]
                items, held = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    open_rooms.pop(at)
            else:
                room, items, held = capacity, [], -(-n // (capacity // s))
            each = room // s
            full = min(held, n // each)
            if full:
                put([*items, (s, each)], full, room - each * s)
            n -= full * each
            held -= full
            if held and n:
                some = min(n, each)
                put([*items, (s, some)], 1, room - some * s)
                n -= some
                held -= 1
            if held and items:
                put(items, held, room)
    return [p for room in sorted(bins) for p in bins[room]]


def pack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce(counts, capacity)
    return fixed + best_fit(left, capacity)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer bins."""
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity} | {0}):
        alone = sum(n for s, n in counts.items() if s > capacity - k)
        large = {s: n for s, n in counts.items() if capacity - k >= s > capacity / 2}
        small = sum(s * n for s, n in counts.items() if capacity / 2 >= s >= k)
        room = sum(n * (capacity - s) for s, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best
