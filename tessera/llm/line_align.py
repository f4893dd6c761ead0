"""Patience alignment of the lines of two documents: unique lines are anchors, gaps without any are aligned in full."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np

#: Levels of anchors within anchors; a gap that is left is aligned in full.
DEPTH = 50


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


class Matches:
    """Which lines of two documents may be aligned: equal ones that stand next to another such pair, or are in ``alone``."""

    def __init__(self, a: list[int], b: list[int], alone: set[int]):
        self.a, self.b, self.alone = a, b, alone

    def fit(self, p: int, q: int) -> bool:
        a, b = self.a, self.b
        if a[p] != b[q]:
            return False
        return p in self.alone or bool(p and q and a[p - 1] == b[q - 1]) or (p + 1 < len(a) and q + 1 < len(b) and a[p + 1] == b[q + 1])


def anchors(m: Matches, p0: int, p1: int, q0: int, q1: int) -> list[tuple[int, int]]:
    """Longest increasing run of pairs of lines that stand once in either part."""
    ours, theirs = Counter(m.a[p0:p1]), Counter(m.b[q0:q1])
    place = {h: q for q, h in enumerate(m.b[q0:q1], q0) if theirs[h] == 1 and ours.get(h) == 1}
    pairs = [(p, place[h]) for p, h in enumerate(m.a[p0:p1], p0) if h in place and m.fit(p, place[h])]
    return [pairs[i] for i in longest_increasing([q for _, q in pairs])]


class Rows:
    """Rows of the table of fitting pairs of a gap as bits, forward or from its end."""

    def __init__(self, m: Matches, q0: int, q1: int, back: bool):
        self.m, self.width, self.back = m, q1 - q0, back
        self.places: dict[int, int] = {}
        edge = range(max(q0 - 1, 0), min(q1 + 1, len(m.b)))
        bits: dict[int, bytearray] = {}
        for q in edge:  # one place more on either side, as neighbours count
            i = (q1 - q) if back else (q - q0 + 1)
            row = bits.setdefault(m.b[q], bytearray((self.width + 9) // 8))
            row[i >> 3] |= 1 << (i & 7)
        self.places = {h: int.from_bytes(row, "little") for h, row in bits.items()}
        self.full = (1 << self.width) - 1

    def row(self, p: int) -> int:
        """Bit k is set if line p fits the k-th line of the gap."""
        a, at = self.m.a, self.places
        here = at.get(a[p], 0)
        if here and p not in self.m.alone:
            before = at.get(a[p - 1], 0) if p else 0
            after = at.get(a[p + 1], 0) if p + 1 < len(a) else 0
            here &= (before >> 1 | after << 1) if self.back else (before << 1 | after >> 1)
        return here >> 1 & self.full


def _lengths(rows: list[int], width: int) -> np.ndarray:
    """Length of the longest alignment of all rows with the first k columns, for each k; rows are bits."""
    full = (1 << width) - 1
    state = full
    for row in rows:
        hit = state & row
        if hit:
            state = (state + hit | state - hit) & full
    bits = np.unpackbits(np.frombuffer(state.to_bytes(width // 8 + 1, "little"), np.uint8), bitorder="little")[:width]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def aligned_in_full(m: Matches, p0: int, p1: int, q0: int, q1: int) -> list[tuple[int, int]]:
    """A longest alignment of a gap: rows of bits, halved again and again, so that memory grows with its length only."""
    ahead, back = Rows(m, q0, q1, False), Rows(m, q0, q1, True)
    lines = [p for p in range(p0, p1) if ahead.row(p)]
    width, out = q1 - q0, []
    todo = [(0, len(lines), 0, width)]
    while todo:
        i0, i1, k0, k1 = todo.pop()
        if i0 == i1 or k0 == k1:
            continue
        part = (1 << k1 - k0) - 1
        if i1 - i0 == 1:
            if row := ahead.row(lines[i0]) >> k0 & part:
                out.append((lines[i0], q0 + k0 + (row & -row).bit_length() - 1))
            continue
        mid = (i0 + i1) // 2
        first = _lengths([ahead.row(p) >> k0 & part for p in lines[i0:mid]], k1 - k0)
        last = _lengths([back.row(p) >> width - k1 & part for p in reversed(lines[mid:i1])], k1 - k0)
        cut = k0 + int((first + last[::-1]).argmax())
        todo += [(i0, mid, k0, cut), (mid, i1, cut, k1)]
    return out


def align(a: list[int], b: list[int], alone: set[int]) -> dict[int, int]:
    """Places in ``b`` of the lines of ``a`` that are aligned.

    Fitting lines at the ends of a gap go first; then those that are unique in both parts are anchors, the longest run
    of them in order, and the gaps between are treated alike.  A gap without anchors takes a longest common
    subsequence of its fitting lines, however often lines repeat and however long it is.
    Where a line has equal neighbours to go with, it stands next to them, so that blocks are not torn apart.
    """
    m, found = Matches(a, b, alone), []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        p0, p1, q0, q1, depth = todo.pop()
        while p0 < p1 and q0 < q1 and m.fit(p0, q0):
            found.append((p0, q0))
            p0, q0 = p0 + 1, q0 + 1
        while p0 < p1 and q0 < q1 and m.fit(p1 - 1, q1 - 1):
            p1, q1 = p1 - 1, q1 - 1
            found.append((p1, q1))
        if p0 == p1 or q0 == q1:
            continue
        held = anchors(m, p0, p1, q0, q1) if depth < DEPTH else []
        if not held:
            found += aligned_in_full(m, p0, p1, q0, q1)
            continue
        found += held
        for (p, q), (r, s) in zip([(p0 - 1, q0 - 1), *held], [*held, (p1, q1)]):
            todo.append((p + 1, r, q + 1, s, depth + 1))
    aligned = dict(found)
    for p in sorted(aligned, reverse=True):
        q = aligned[p]
        if p - 1 in aligned and q and a[p - 1] == b[q - 1]:
            aligned[p - 1] = q - 1
    for p in sorted(aligned):
        q, follower = aligned[p], aligned.get(p + 1)
        if follower is not None and follower != q + 1 and a[p + 1] == b[q + 1] and aligned.get(p + 2) != follower + 1:
            aligned[p + 1] = q + 1
    return aligned
