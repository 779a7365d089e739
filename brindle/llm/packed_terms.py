"""Counting terms in numpy by their length.

A term of up to 8 bytes is one 64-bit number, one of up to 16 bytes two; they
are radix-sorted by 16-bit digits, and equal neighbours are counted as runs.
Longer terms go to buckets by their length, of byte rows that are sorted as
bytes. Terms hold no zero byte, so zeros at the end of a number or a row are
no part of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Masks that keep the first k bytes of a number.
FIRST = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], np.uint64)


def radix_order(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``order`` sorted by ``key`` of what it points to, stable, by 16-bit digits from the lowest on."""
    for shift in (0, 16, 32, 48):
        digit = (key >> np.uint64(shift)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def numbers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The up to 8 bytes from each start as a number whose order is that of the bytes; ``data`` has 8 bytes to spare."""
    every = np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))
    return every[starts].astype(np.uint64) & FIRST[np.clip(sizes, 0, 8)]


def strings(rows: np.ndarray) -> pa.Array:
    """An Arrow string a row of bytes, without its zeros."""
    there = rows != 0
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(there.sum(axis=1), out=offsets[1:])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows[there])))


class PackedTerms:
    """Terms with the number of the text that each stands in, until they are counted; ``size`` is their number."""

    def __init__(self):
        self.parts: dict[int, list[tuple]] = defaultdict(list)
        self.size = 0

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> None:
        """Add the spans of ``data``; ``text`` is a number below 2^31 for each."""
        size, text = ends - starts, text.astype(np.int32)
        padded = np.append(data, np.zeros(16, np.uint8))
        self.size += len(size)
        at = np.flatnonzero(size <= 8)
        self.parts[1].append((numbers(padded, starts[at], size[at]), text[at]))
        at = np.flatnonzero((size > 8) & (size <= 16))
        self.parts[2].append((numbers(padded, starts[at] + 8, size[at] - 8), numbers(padded, starts[at], size[at]), text[at]))
        at = np.flatnonzero(size > 16)
        if len(at):
            width = 1 << np.ceil(np.log2(size[at])).astype(np.int64)
            for w in np.unique(width).tolist():
                here = at[width == w]
                rows = np.zeros((len(here), w), np.uint8)
                for k, (a, n) in enumerate(zip(starts[here].tolist(), size[here].tolist(), strict=True)):
                    rows[k, :n] = data[a : a + n]
                self.parts[w].append((rows.view(f"S{w}").ravel(), text[here]))

    def runs(self, group: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Per kind of length: (term, group, occurrences, texts) of every distinct term and group; ``group`` is given by text."""
        for width, parts in self.parts.items():
            *keys, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(text):
                continue
            of = np.zeros(len(text), np.int64) if group is None else group[text]
            order = radix_order(np.arange(len(text)), of.astype(np.uint64))
            for key in keys:  # the lowest first
                order = radix_order(order, key) if width <= 2 else order[np.argsort(key[order], kind="stable")]
            keys, of, text = [k[order] for k in keys], of[order], text[order]
            new = np.ones(len(text), bool)
            new[1:] = of[1:] != of[:-1]
            for key in keys:
                new[1:] |= key[1:] != key[:-1]
            first = np.flatnonzero(new)
            new[1:] |= text[1:] != text[:-1]
            if width <= 2:
                rows = np.stack([k[first] for k in reversed(keys)], axis=1).astype(">u8").view(np.uint8).reshape(len(first), 8 * width)
            else:
                rows = np.ascontiguousarray(keys[0][first]).view(np.uint8).reshape(len(first), width)
            yield strings(rows), of[first], np.diff(np.append(first, len(text))), np.add.reduceat(new.astype(np.int64), first)
