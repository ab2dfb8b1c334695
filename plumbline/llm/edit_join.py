"""Pieces of the segment-partition edit join: segments, probes and a banded bit-parallel distance.

If two strings are within ``k`` edits and one is cut into ``k + 1`` segments, some segment stands
unchanged in the other one, at a place that lengths and earlier edits narrow down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache


@lru_cache(maxsize=100_000)
def segments(length: int, k: int) -> tuple[tuple[int, int], ...]:
    """Start and size of the ``k + 1`` segments of a string; the last ones take the remainder."""
    size, longer = divmod(length, k + 1)
    found, at = [], 0
    for i in range(k + 1):
        n = size + (i >= k + 1 - longer)
        found.append((at, n))
        at += n
    return tuple(found)


@lru_cache(maxsize=100_000)
def probes(length: int, shorter: int, k: int) -> tuple[tuple[int, int, int], ...]:
    """(segment, start, size): where a string of ``length`` may hold a segment of one that is ``shorter`` by so many.

    Seen from the left, a segment has moved by no more than the segments before it; from the right, by
    no more than those after it."""
    found = []
    for i, (at, size) in enumerate(segments(length - shorter, k)):
        low = max(at - i, at + shorter - (k - i), 0)
        high = min(at + i, at + shorter + (k - i), length - size)
        found += [(i, start, size) for start in range(low, high + 1)]
    return tuple(found)


def common_probe(indexed: str, probing: str, k: int) -> tuple[int, int] | None:
    """The first (segment, start) under which two strings meet; ``probing`` is not the shorter one."""
    cut = segments(len(indexed), k)
    for i, start, size in probes(len(probing), len(probing) - len(indexed), k):
        if probing[start : start + size] == indexed[cut[i][0] : cut[i][0] + size]:
            return i, start
    return None


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is ``k`` or less.

    Equal ends are taken off; then the ``2k + 1`` diagonals of the band are one small number, whose bits
    are the vertical steps of a column. The cell on the lowest diagonal is followed down to the last row,
    then along it."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    low, high = 0, len(a)
    while low < high and a[low] == b[low]:
        low += 1
    longer = len(b) - len(a)
    while high > low and a[high - 1] == b[high - 1 + longer]:
        high -= 1
    a, b = a[low:high], b[low : high + longer]
    if len(a) <= k:  # few signs are left: all may be replaced
        return len(b) <= k or _distance(a, b) <= k
    band, top = (1 << (2 * k + 1)) - 1, 2 * k
    held: dict[str, int] = {}
    for i, c in enumerate(a):
        held[c] = held.get(c, 0) | 1 << (i + k)
    up, down, score = band >> k << k, 0, k
    last_diagonal = len(a) - k
    spare = k + len(b) - last_diagonal
    for j, c in enumerate(b, 1):
        match = held.get(c, 0) >> (j - 1) & band
        diagonal = ((((match & up) + up) ^ up) | match | down) & band
        right, left = (down | ~(diagonal | up)) & band, diagonal & up
        if j <= last_diagonal:
            score += not diagonal >> top & 1
            if score > spare:
                return False
        else:
            row = len(a) - j + k
            score += (right >> row & 1) - (left >> row & 1)
        up = (left | ~(diagonal >> 1 | right)) & band
        down = diagonal >> 1 & right
    return score <= k


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def keys_of(text: str, k: int, least: int) -> Iterator[tuple[int, int, int, str]]:
    """(length, segment, code, part): what a string is indexed under and probes with.

    Codes below zero are index entries, which also probe for equal lengths; see ``code``."""
    n = len(text)
    for i, (at, size) in enumerate(segments(n, k)):
        yield n, i, -1 - i, text[at : at + size]
    for shorter in range(min(k, n - least) + 1):
        cut = segments(n - shorter, k)
        for i, start, size in probes(n, shorter, k):
            if shorter or start != cut[i][0]:
                yield n - shorter, i, code(i, start, cut[i][0], k), text[start : start + size]


def code(segment: int, start: int, home: int, k: int) -> int:
    """A small number for a probe's segment and how far it has moved (between -k and 2k)."""
    return segment * 4 * (k + 1) + start - home + k
