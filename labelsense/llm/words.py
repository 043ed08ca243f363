"""Words and shingles of whole Arrow columns as 64-bit hashes, computed with numpy inside a task.

A word is a run of bytes other than the six ASCII white-space characters, with A-Z lower-cased on
request. Bytes are read in blocks that end between words, so the memory in use does not depend on
the length of a text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one to one."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _powers(base: np.uint64, size: int) -> np.ndarray:
    factors = np.full(size, base)
    factors[0] = 1
    return np.cumprod(factors)


_tables: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < size:
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _tables["up"], _tables["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text starts; null counts as empty."""
    column = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last; ``separator`` says which bytes part words."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, spans being in order and apart; ``table`` gives a byte's value."""
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        block = data[low : ends[upto - 1]]
        up, down = _power_tables(len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * up[: len(block)], out=sums[1:])
        begin, end = starts[at:upto] - low, ends[at:upto] - low
        hashes[at:upto] = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
        at = upto
    return hashes


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word of all texts, and the first word of each text.

    The bytes are places in ``text_bytes(texts)``; the last array has one entry more than texts.
    """
    data, offsets = text_bytes(texts)
    starts, ends = spans(data, offsets)
    hashes = span_hashes(data, starts, ends, _BYTE_LOWER if lower else _BYTE)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; empty if there are fewer words."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    total = np.full(len(hashes) - size + 1, np.uint64(size))
    for k in range(size):
        total = total * _BASE + hashes[k : len(hashes) - size + 1 + k]
    return mix(total)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text: runs of ``size`` words, or all words if there are fewer."""
    hashes, _, _, firsts = word_hashes(texts)
    for begin, end in zip(firsts[:-1], firsts[1:], strict=True):
        words = hashes[begin:end]
        yield np.unique(windows(words, min(size, max(1, len(words)))))
