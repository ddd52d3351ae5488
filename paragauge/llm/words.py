"""Words, lines and their hashes for whole Arrow batches of texts at once.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Hashes are polynomial over the bytes,
taken from one running sum, so that no text is turned into Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = (2 << 20) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x + _U(0x9E3779B97F4A7C15)).astype(np.uint64)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_RAW = mix(np.arange(1, 257, dtype=np.uint64))
_LOWERED = _RAW[LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    while len(_powers[0]) < n:
        have = len(_powers[0])
        for i, base in enumerate((_BASE, _INVERSE)):
            step = _powers[i][-1:] * base
            _powers[i] = np.concatenate([_powers[i], _powers[i] * step])
        assert len(_powers[0]) == 2 * have
    return _powers[0], _powers[1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the places where texts begin and end; null is empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(
    batch: pa.RecordBatch, column: str = "text", size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text; a longer text stands alone."""
    size = size or SLICE_BYTES
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(off, off[first] + size, "right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield batch.slice(first, end - first)
        first = end


@dataclass
class Spans:
    """Words (or lines) of all texts in order: their bytes, text number and hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def _running(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    part = total[1:]  # filled in place: at eight bytes per byte of text, every copy counts
    np.take(table, data, out=part, mode="clip")
    part *= up[: len(data)]
    return np.cumsum(total, out=total)


def _hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray, lower: bool) -> Spans:
    inside = ~SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = inside[edge]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = _running(data, _LOWERED if lower else _RAW)
    doc = np.searchsorted(off, start, "right") - 1
    return Spans(start, end, doc, _hashes(total, start, end))


def lines(data: np.ndarray, off: np.ndarray) -> Spans:
    """Parts between line feeds, empty ones too; a text without line feed is one line."""
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(off, breaks, "right") - 1
    start = np.concatenate([off[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(off) - 1), at])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    closes = np.ones(len(start), bool)
    closes[:-1] = doc[1:] != doc[:-1]
    end[closes] = off[1:][doc[closes]]
    total = _running(data, _RAW)
    return Spans(start, end, doc, _hashes(total, start, end))


def windows(span: Spans, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text number and hash of each run of ``width`` words within one text."""
    n = max(len(span.doc) - width + 1, 0)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = key * _U(0xD6E8FEB86659FD93) + span.hash[i : i + n]
    whole = span.doc[:n] == span.doc[len(span.doc) - n :] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return at, span.doc[at], mix(key[at])


def within(doc: np.ndarray, key: np.ndarray, docs: int) -> tuple[np.ndarray, int]:
    """Text number in the high bits, hash in the others (over 50 for a slice), and the shift."""
    shift = 64 - max(int(docs - 1).bit_length(), 1)
    return (doc.astype(np.uint64) << _U(shift)) | (key >> _U(64 - shift)), shift


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes of small or sorted numbers cost little."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.empty(0, np.uint8)
    body = pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)
    return x.dtype.str.encode().ljust(4) + len(x).to_bytes(8, "little") + body


def unpack(blob: bytes) -> np.ndarray:
    kind, n = np.dtype(blob[:4].decode().strip()), int.from_bytes(blob[4:12], "little")
    if not n:
        return np.empty(0, kind)
    body = pa.decompress(blob[12:], n * kind.itemsize, codec="zstd", asbytes=True)
    planes = np.frombuffer(body, np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)
