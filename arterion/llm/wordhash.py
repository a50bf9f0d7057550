"""64-bit hashes of all words of a column of texts, by NumPy over the bytes.

A word's hash is sum(v[byte] * R ** place) modulo 2 ** 64, with a value v drawn
for each byte: a difference of two running sums, so all words of a block come
out of a few array operations.  Words are cut at blanks of ASCII; A-Z are
lower-cased.  Texts of any length are worked on by blocks, which end at a blank
where there is one; a word longer than a block is put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
BLOCK = 1 << 18
_WHOLE = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes words; with ``stem``, also the first ``stem`` characters of those that have more."""

    def __init__(self, stem: int = 0):
        draw = np.random.default_rng(20_240_229)
        self.value = draw.integers(1, 1 << 63, 256, np.uint64)
        self.value[65:91] = self.value[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        power, back = np.full(BLOCK + 1, np.uint64(_BASE)), np.full(BLOCK + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        power[0] = back[0] = 1
        self.power, self.back = np.cumprod(power), np.cumprod(back)
        self.stem = stem

    def _block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, stem's hash or 0, start, end) of the words in a block; no word goes over a place in ``cuts``."""
        inside = ~self.gap[data]
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        before[cuts] = False
        after[cuts - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=total[1:])
        first, back = total[start], self.back[start]
        stems = np.zeros(len(start), np.uint64)
        if self.stem and len(start):
            lead = (data & 0xC0) != 0x80  # where a character begins
            at = np.append(np.flatnonzero(lead), np.full(self.stem, len(data)))
            stop = at[np.minimum(np.cumsum(lead)[start] - 1 + self.stem, len(at) - 1)]
            stems = np.where(stop < end, (total[np.minimum(stop, end)] - first) * back, np.uint64(0))
        return (total[end] - first) * back, stems, start, end

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, stems' hashes) of the words of one text of any length."""
        parts, stems, left, length, at = [], [], None, 0, 0  # the hash and length of a word that may go on
        while at < len(data):
            stop = min(len(data), at + BLOCK)
            if stop < len(data):
                gaps = np.flatnonzero(self.gap[data[at:stop]])
                stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
            h, s, start, end = self._block(data[at:stop], np.empty(0, np.int64))
            goes_on = left is not None and bool(len(start)) and start[0] == 0
            if goes_on:
                h[0], s[0] = np.uint64((int(left) + pow(_BASE, length, 1 << 64) * int(h[0])) & _WHOLE), stem
            elif left is not None:
                parts.append(np.array([left], np.uint64))
                stems.append(np.array([stem], np.uint64))
            left = None
            if len(end) and end[-1] == stop - at and stop < len(data):
                length = int(end[-1] - start[-1]) + (length if goes_on and len(h) == 1 else 0)
                left, stem, h, s = h[-1], s[-1], h[:-1], s[:-1]
            parts.append(h)
            stems.append(s)
            at = stop
        if left is not None:
            parts.append(np.array([left], np.uint64))
            stems.append(np.array([stem], np.uint64))
        none = np.empty(0, np.uint64)
        return (np.concatenate(parts), np.concatenate(stems)) if parts else (none, none)

    def groups(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of texts in a row (string or binary; null: empty): the number of words of each text, and the
        hashes and stems' hashes of all their words; a stem's hash is 0 where a word has none."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and offsets[-1] else np.empty(0, np.uint8)
        k = 0
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1)
            part, cuts = data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
            if len(part) > BLOCK:
                h, stems = self._long(part)
                yield np.array([len(h)]), h, stems
            else:
                h, stems, start, _ = self._block(part, cuts)
                yield np.diff(np.searchsorted(start, cuts)), h, stems
            k = end
