"""Many byte strings searched at once in the texts of a batch, by numpy.

A string is looked up by its first bytes at every place of the texts: by all of them up to eight, else by a hash of as many
as the largest power of two in its length, ``WIDEST`` at most.  What a hash finds is compared byte by byte.  The time follows the texts and the
finds, not the number of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 16  # places looked at together: their numbers fit the cache
WIDEST = 256
_WORD = np.arange(8)
_MIX, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, none of them NULL, and where each text begins and the last ends."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(WIDEST + 8, np.uint8)])


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number."""
    return data[at[:, None] + _WORD].view("<u8")[:, 0]


def _keys(data: np.ndarray, start: int, end: int, widths: list[int]) -> Iterator[np.ndarray]:
    """For each width, in rising order, the number that so many bytes make, from each place between start and end on."""
    n, at = end - start, 8
    found = np.ndarray((n + max(widths[-1] - 8, 0),), "<u8", data, start, (1,)).astype(np.uint64)
    for width in widths:
        while at < width:
            found = found[:-at] * _MIX + found[at:]
            found = (found ^ (found >> np.uint64(29))) * _STIR
            at *= 2
        yield found[:n] & np.uint64((1 << 8 * width) - 1) if width < 8 else found[:n]


class Sought:
    """The strings, ready to be found; ``data`` holds them one after another, ``offsets`` where each begins and the last ends.
    None may be empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.starts, self.sizes = _padded(data), offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
        width = np.minimum(self.sizes, 8)
        while (wider := (self.sizes >= 2 * width) & (width >= 8) & (width < WIDEST)).any():
            width[wider] *= 2
        self.widths = np.unique(width).tolist()
        own = np.zeros(len(width), np.uint64)
        for start in range(0, len(data), PIECE):
            end = min(len(data), start + PIECE)
            here = np.arange(*np.searchsorted(self.starts, (start, end)))
            for wide, key in zip(self.widths, _keys(self.data, start, end, self.widths), strict=True):
                of = here[width[here] == wide]
                own[of] = key[self.starts[of] - start]
        self.tables = [self._table(own, np.flatnonzero(width == w)) for w in self.widths]

    @staticmethod
    def _table(own: np.ndarray, numbers: np.ndarray) -> tuple:
        """Strings of one width in order of their keys: a filter of hashed keys, its shift, keys, where each key's strings begin, strings."""
        numbers = numbers[np.argsort(own[numbers], kind="stable")]
        keys, first = np.unique(own[numbers], return_index=True)
        bits = max(12, 4 + len(keys).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[(keys * _MIX) >> np.uint64(64 - bits)] = True
        return seen, np.uint64(64 - bits), keys, np.append(first, len(numbers)), numbers

    def _same(self, data: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the text goes on as the string does, eight bytes at a time; strings of eight bytes or more."""
        same, live, step = np.ones(len(at), bool), np.arange(len(at)), 0
        while len(live):
            here = np.minimum(step, self.sizes[number[live]] - 8)
            alike = _eight(data, at[live] + here) == _eight(self.data, self.starts[number[live]] + here)
            same[live[~alike]] = False
            step += 8
            live = live[alike & (self.sizes[number[live]] > step)]
        return same

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, string) of every pair in which the text holds the string, once each, in order of the texts."""
        offsets = offsets.astype(np.int64)
        size, data = len(data), _padded(data)
        pairs = [np.zeros(0, np.int64)]
        for start in range(0, size if self.widths else 0, PIECE):
            end = min(size, start + PIECE)
            low, high = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, end, "left")
            texts = np.repeat(np.arange(low, high), np.diff(offsets[low:high + 1].clip(start, end)))
            found = []
            for width, key, table in zip(self.widths, _keys(data, start, end, self.widths), self.tables, strict=True):
                seen, shift, keys, first, numbers = table
                at = np.flatnonzero(seen[(key * _MIX) >> shift])
                slot = np.searchsorted(keys, key[at]).clip(max=len(keys) - 1)
                known = keys[slot] == key[at]
                at, slot = at[known], slot[known]
                text, at, turn, last = texts[at], at + start, first[slot], first[slot + 1]
                while len(at):  # each turn takes the next string of every key that has one left
                    number = numbers[turn]
                    fits = at + self.sizes[number] <= offsets[text + 1]
                    if width >= 8:
                        fits[fits] = self._same(data, at[fits], number[fits])
                    found.append(text[fits] * len(self.sizes) + number[fits])
                    more = (turn := turn + 1) < last
                    text, at, turn, last = text[more], at[more], turn[more], last[more]
            pairs.append(np.unique(np.concatenate(found)) if found else pairs[0])
        return np.divmod(np.unique(np.concatenate(pairs)), max(len(self.sizes), 1))
