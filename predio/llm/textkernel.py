"""Vectorised byte-level text helpers used inside Arrow tasks.

Texts of a batch are handled as one byte array with offsets.  Words are hashed
with a polynomial over random byte values modulo 2**64, so that the hash of any
span comes from two entries of one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer document is handled alone, its words in runs of so many bytes.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of anything but space and the control characters tab to carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters: ASCII letters and every byte of a longer code point.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of a run are kept, those of a longer word are not."""
    if n <= len(_POWERS.get("up", ())):
        return _POWERS["up"], _POWERS["down"]
    size = max(n, CHUNK_BYTES + 1024)
    made = {}
    for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        made[key] = np.multiply.accumulate(steps)
    if size <= CHUNK_BYTES + 1024:
        _POWERS.update(made)
    return made["up"], made["down"]


def text_arrays(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) for runs of rows of about ``CHUNK_BYTES``; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``inside`` within each text, and how many each text has."""
    flags = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = flags[:-1]
    starts = np.flatnonzero(flags & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = flags[1:]
    ends = np.flatnonzero(flags & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the spans of one byte array from ascending ``starts`` to each of ``ends``, run by run."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK_BYTES)))
        base, run = starts[first], slice(first, last)
        block = data[base : max(int(e[run].max()) for e in ends)]
        up, down = _powers(len(block) + 1)
        total = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[block] * up[: len(block)], out=total[1:])
        begin = starts[run] - base
        for hashes, end in zip(out, ends, strict=True):
            stop = end[run] - base
            value = (total[stop] - total[begin]) * down[begin]
            hashes[run] = mix(value ^ ((stop - begin).astype(np.uint64) * _U(0xA24BAED4963EE407)))
        first = last
    return out


def chained(previous: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hash of a sequence one word longer."""
    return mix(previous * _U(0x9FB21C651E98DF25) + following)


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its word shingles; a text with fewer words has its whole sequence as one."""
    chains = [words]
    for k in range(1, width):
        nxt = np.zeros_like(words)
        if len(words) > k:
            nxt[:-k] = chained(chains[-1][:-k], words[k:])
        chains.append(nxt)
    ends = np.cumsum(counts)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        begin = end - n
        if n == 0:
            out.append(words[:0])
        elif n < width:
            out.append(chains[n - 1][begin : begin + 1])
        else:
            out.append(np.unique(chains[width - 1][begin : end - width + 1]))
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each row of a text column, in order, after lower-casing A to Z."""
    for _, data, offsets in text_arrays(column):
        data = lowered(data)
        starts, ends, counts = spans(data, offsets, NOT_SPACE)
        yield from shingles(span_hashes(data, starts, ends)[0], counts, width)
