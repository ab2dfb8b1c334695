"""Suffix arrays of blocks of short texts by two-stage sorting, and what repeats in them.

A suffix that is smaller than its successor is sorted directly; every other one stands in its
bucket (first byte) before those, in the order of its successor, and is placed by scanning the
buckets from small to large. Texts of a block are kept apart: the end of a text is smaller than any
byte. Of each text only the suffixes that start in its windows are ranked, and those behind them as
far as the next directly sorted one, on which their order hangs.
"""

from __future__ import annotations

import numpy as np

_STEP = 8  # bytes that are compared at once


class Block:
    """Texts side by side. ``windows[i]`` suffixes from the start of text ``i`` are of interest."""

    def __init__(self, texts: list[bytes], windows: np.ndarray) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.data = bytes(_STEP).join(texts) + bytes(2 * _STEP)
        self.start = np.cumsum(np.r_[0, sizes[:-1] + _STEP])
        self.end = self.start + sizes
        self.windows = windows
        self.eight = np.ndarray((len(self.data) - _STEP + 1,), dtype=">u8", buffer=self.data, strides=(1,))
        byte = np.frombuffer(self.data, dtype=np.uint8).astype(np.int16)
        for shift in range(_STEP):
            byte[self.end + shift] = -1
        self.byte = byte[: len(byte) - _STEP]
        step = np.sign(np.diff(self.byte)).astype(np.int8)
        place = np.where(step != 0, np.arange(len(step)), len(step) - 1)
        #: For each place the next one whose byte differs from its successor's.
        self.turn = np.minimum.accumulate(place[::-1])[::-1]
        #: Whether the suffix is smaller than its successor.
        self.small = step[self.turn] > 0

    def positions(self) -> np.ndarray:
        """Suffixes to rank, by place."""
        smalls = np.where(self.small, np.arange(len(self.small)), len(self.small))
        next_small = np.minimum.accumulate(smalls[::-1])[::-1]
        last = np.minimum(next_small[self.start + self.windows - 1], self.end - 1)
        counts = last - self.start + 1
        return np.repeat(self.start - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())

    def _text_end(self, places: np.ndarray) -> np.ndarray:
        return self.end[np.searchsorted(self.start, places, side="right") - 1]

    def sort_directly(self, places: np.ndarray, length: int) -> np.ndarray:
        """The suffixes in order of up to ``length`` bytes, eight at a time; only ties are looked at again."""
        order, group = places, np.zeros(len(places), dtype=np.int64)
        end, left = self._text_end(places), np.arange(len(places))
        for depth in range(0, length, _STEP):
            if not len(left):
                break
            at = np.minimum(order[left] + depth, end[left])
            chunk, held = self.eight[at].astype(np.uint64), np.minimum(end[left] - at, _STEP)
            by = np.lexsort((held, chunk, group[left]))
            order[left], end[left] = order[left][by], end[left][by]
            chunk, held, own = chunk[by], held[by], group[left]
            new = np.r_[True, (chunk[1:] != chunk[:-1]) | (held[1:] != held[:-1]) | (own[1:] != own[:-1])]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(left)])
            group[left] = np.repeat(left[first], size)
            left = left[np.repeat(size > 1, size) & (held == _STEP)]
        return order

    def suffix_array(self, length: int) -> np.ndarray:
        """Suffixes of interest and those that their order hangs on, in order of ``length`` bytes."""
        places = self.positions()
        first, small = self.byte[places], self.small[places]
        direct = self.sort_directly(places[small], length)
        induced = places[~small]
        byte, run = first[~small], self.turn[induced] - induced
        by = np.lexsort((run, byte))  # within a bucket, longer runs of its byte hang on shorter ones
        induced, byte, run = induced[by], byte[by], run[by]
        cut = np.flatnonzero(np.r_[True, (byte[1:] != byte[:-1]) | (run[1:] != run[:-1])]) if len(induced) else np.zeros(0, int)
        parts = {}
        for a, b in zip(cut, np.r_[cut[1:], len(induced)].astype(int)):
            parts.setdefault(int(byte[a]), []).append(induced[a:b])
        direct_byte = self.byte[direct]
        rank = np.full(len(self.byte) + 1, -1, dtype=np.int64)
        out, filled = [], 0
        for bucket in sorted(set(parts) | set(np.unique(direct_byte).tolist())):
            low, high = np.searchsorted(direct_byte, [bucket, bucket + 1])
            for group in [*parts.get(bucket, []), direct[low:high]]:
                if group is not None and len(group):
                    if not self.small[group[0]]:
                        group = group[np.argsort(rank[group + 1], kind="stable")]
                    rank[group] = np.arange(filled, filled + len(group))
                    filled += len(group)
                    out.append(group)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def common_prefixes(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Of each pair of suffixes, the bytes in common: exact below ``length`` in steps of eight, else ``length``."""
        common = np.zeros(len(a), dtype=np.int64)
        left = np.arange(len(a))
        for depth in range(0, length, _STEP):
            at = min(depth, length - _STEP)  # the last step overlaps the one before
            left = left[self.eight[a[left] + at] == self.eight[b[left] + at]]
            common[left] = at + _STEP
        return common

    def repeated(self, length: int) -> np.ndarray:
        """For each window of ``length`` bytes, text by text, whether the block holds it at another place too."""
        ranked = self.suffix_array(length)
        text = np.searchsorted(self.start, ranked, side="right") - 1
        ranked = ranked[ranked - self.start[text] < self.windows[text]]
        same = self.common_prefixes(ranked[:-1], ranked[1:], length) >= length
        found = np.zeros(len(self.byte) + 1, dtype=bool)
        found[ranked[:-1][same]] = True
        found[ranked[1:][same]] = True
        places = np.repeat(self.start - np.r_[0, np.cumsum(self.windows)[:-1]], self.windows) + np.arange(self.windows.sum())
        return found[places]
