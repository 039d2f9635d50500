"""Numpy kernels over the UTF-8 buffers of Arrow string columns.

Every kernel takes whole texts and works on the concatenated bytes of many
documents at once, so no Python code runs per word.  Words are maximal runs of
bytes other than 0x20 and 0x09-0x0D; a word never crosses a document border.
Spans are named by a 64-bit hash over blocks of eight bytes: spans of one length up
to eight bytes never collide, others do with a chance of 2^-64 a pair.  Where a result
must not rest on that, same() compares the bytes themselves.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


def _lean() -> None:
    """Freed memory goes back to the system at once: workers share their machine with an executor's heap."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 16 << 20)  # blocks above are mapped, not kept
        libc.mallopt(-1, 32 << 20)
        pa.set_memory_pool(pa.system_memory_pool())
    except (OSError, AttributeError):
        pass


_lean()
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Spans beyond so many bytes are hashed one by one.
_LONG = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 400_000


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Slice:
    """Bytes of consecutive texts: text k is data[offsets[k]:offsets[k + 1]]; first is the index of text 0 in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def stream(self, lower: bool = False) -> np.ndarray:
        """The bytes (lower: with A-Z as a-z) and eight zeros behind them."""
        name = "_low" if lower else "_raw"
        if name not in self.__dict__:
            self.__dict__[name] = np.concatenate([_LOWER[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        return self.__dict__[name]

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        """The index of the text that holds each byte position; positions ascend."""
        return np.repeat(np.arange(len(self)), np.diff(np.searchsorted(starts, self.offsets)))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The sum of per-byte values in each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column in order; nulls count as empty texts."""
    parts = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    first = 0
    for part in parts:
        part = part.cast(pa.large_string()) if not pa.types.is_large_string(part.type) else part
        part = part.fill_null("") if part.null_count else part
        n = len(part)
        if not n:
            continue
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            j = min(j, n)
            yield Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], first + i)
            i = j
        first += n


@dataclass
class Words:
    """starts, ends: byte places; text: index of the text; counts: words of each text."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    counts: np.ndarray


def spans(part: Slice, inside: np.ndarray) -> Words:
    """Maximal runs of flagged bytes within a text."""
    n = len(part.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(part), np.int64))
    border = np.zeros(n + 1, bool)
    border[part.offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    counts = np.diff(np.searchsorted(starts, part.offsets))
    return Words(starts, ends, np.repeat(np.arange(len(part)), counts), counts)


def words(part: Slice) -> Words:
    return spans(part, ~SEPARATOR[part.data])


def _wide(stream: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of a stream that ends with eight zeros, as one number."""
    return np.ndarray(len(stream) - 7, "<u8", stream, strides=(1,))


def hashes(part: Slice, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes in any slice. lower: A-Z count as a-z."""
    stream = part.stream(lower)
    wide = _wide(stream)
    size = ends - starts
    h = size.astype(np.uint64) * _C1 + np.uint64(0x2545F4914F6CDD1D)
    live, at, left = None, starts, size
    while len(at):
        x = wide[at] & _KEEP[np.minimum(left, 8)]
        g = ((h if live is None else h[live]) ^ x) * _C2
        g = (g ^ (g >> np.uint64(29))) * _C3
        g ^= g >> np.uint64(32)
        if live is None:
            h = g
        else:
            h[live] = g
        more = np.flatnonzero(left > 8)
        if live is None:
            big = left[more] > _LONG
            for k in more[big].tolist():
                h[k] = np.uint64(int.from_bytes(hashlib.blake2b(stream[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little"))
            more = more[~big]
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(h)


def same(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether span k of stream a has the bytes of span k of stream b; both streams end with eight zeros."""
    wide_a, wide_b = _wide(a), _wide(b)
    left = a_ends - a_starts
    out = left == b_ends - b_starts
    live = np.flatnonzero(out & (left > 0))
    at = 0
    while len(live):
        keep = _KEEP[np.minimum(left[live] - at, 8)]
        ok = (wide_a[a_starts[live] + at] ^ wide_b[b_starts[live] + at]) & keep == 0
        out[live[~ok]] = False
        at += 8
        live = live[ok & (left[live] > at)]
        if at >= _LONG:
            for k in live.tolist():
                out[k] = np.array_equal(a[a_starts[k] + at : a_ends[k]], b[b_starts[k] + at : b_ends[k]])
            break
    return out


def hash_of(word: str, lower: bool = False) -> int:
    """The hash that hashes() gives one word."""
    part = next(slices(pa.array([word])))
    return int(hashes(part, np.array([0]), np.array([len(part.data)]), lower)[0])


def grouped(order_key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (text, key) and, for each place in that order, whether it begins a new (text, key)."""
    order = np.lexsort((order_key, text))
    k, t = order_key[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return order, new


ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]")
