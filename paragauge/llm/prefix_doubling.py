"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. The positions
that are ranked are sampled by content: an anchor is the smallest hash of ``GRAM`` bytes among
``window`` positions in a row, so equal strings have the same anchors inside. The bytes from one
anchor to the next are a phrase, and ranks double over phrases:

1. Every task sends (name of the phrase, position) to hash ranges. A range sorts its names, gives
   those that occur twice a rank and tells the blocks; unique phrases drop out for good.
2. A block pairs the rank at a position with the rank where that chain ends, an offset that doubles
   every round; the pairs are sorted, ranked and thinned in the same way, until no chain that is
   still repeated fits into ``length`` bytes any more.
3. A string of ``length`` bytes that holds a unique chain of its own anchors is unique. What is left
   is past the threshold and judged as a whole. All strings of one first anchor share the bytes
   behind it, so an anchor sends the name of these (96 bits) and the few bytes on either side to a
   hash range, which finds for each shift whether the string occurs twice. Where the phrase at the
   anchor is frequent (``HEAVY``), names of whole strings are sent instead, each once per block, so
   that no range fills up with one passage.

Text travels in compressed blocks, and what is asked and told in packed arrays, one row per block
and range. The number of ranges follows from the bytes of text, so that a range stays small.

Defined cases: a null or empty text has no bytes, no spans and the digest of nothing; a text shorter
than ``length`` keeps all; equal texts of at least ``length`` bytes lose everything, the first copy
too; repeated rows count as other documents; a null key is kept; an empty table gives an empty
result; other columns are not looked at. A text must be smaller than 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.llm import words as W
from paragauge.session import scratch_path

LENGTH = 200
GRAM = 8
BLOCK_BYTES = 8 << 20
#: Positions hashed at a time; a longer text is hashed in overlapping pieces.
CHUNK = 1 << 20
#: Text bytes per hash range; one position in 40 is sent, and a few per cent of the bytes.
RANGE_BYTES = 8 << 20
#: From so many places on a phrase counts as frequent.
HEAVY = 20_000
_U = np.uint64
_SECOND = W.mix(np.arange(1000, 1256, dtype=np.uint64))
#: Low bits that hold the place in a piece, beside the hash, so that of equal hashes the first counts.
_PLACE = _U(24)

_BLOCK = "block long, ids array<long>, n_bytes long, sizes binary, shas binary, text binary"
_ASK = "bucket int, block long, names binary, at binary, span binary"
_TOLD = "block long, at binary, span binary, rank binary, heavy binary, dead_at binary, dead_end binary"
_KNOWN = (
    "kind string, bucket int, block long, names binary, at binary, span binary, alive binary, heavy binary,"
    " dead_at binary, dead_end binary"
)
_FACT = ["alive", "heavy", "dead_at", "dead_end"]
_STRING = (
    "bucket int, block long, low binary, high binary, at binary, least binary, most binary, bytes binary,"
    " whole_low binary, whole_high binary, twice binary"
)
_HIT = "block long, bucket int, at binary, shifts binary, whole binary"
_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def window_of(length: int) -> int:
    """Positions per anchor window: a string holds at least two windows that do not overlap."""
    return min(96, (length - GRAM + 1) // 2)


# Anchors and names -------------------------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on (zeros follow the end)."""
    padded = np.concatenate([data, np.zeros(2 * GRAM, np.uint8)])
    grams = np.empty(len(data), np.uint64)
    for k in range(GRAM):
        part = grams[k::GRAM]
        part[:] = padded[k : k + GRAM * len(part)].view("<u8")
    return W.mix(grams)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in order."""
    size = np.maximum(end - start, 0)
    skip = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - skip, size)


def anchors(data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all texts in order, and the first window start that has each as its smallest."""
    ats, lows = [], []
    reach = window + GRAM - 1
    for first, end in _chunks(off):
        # Window starts first .. end - 1 of one or more texts; the bytes reach further.
        bounds = off[np.searchsorted(off, first, "right") - 1 : np.searchsorted(off, end) + 1]
        starts = np.maximum(bounds[:-1], first)
        ends = np.minimum(bounds[1:] - reach + 1, end)
        here = _ranges(starts, ends)
        if not len(here):
            continue
        piece = data[first : min(end + reach, len(data))]
        keys = _grams(piece)
        keys = (keys >> _PLACE << _PLACE) | np.arange(len(piece), dtype=np.uint64)
        size = 1
        while size < window:
            step = min(size, window - size)
            keys = np.minimum(keys[: len(keys) - step], keys[step:])
            size += step
        at = (keys[here - first] & ((_U(1) << _PLACE) - _U(1))).astype(np.int64) + first
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        ats.append(at[new])
        lows.append(here[new])
    if not ats:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, low = np.concatenate(ats), np.concatenate(lows)
    new = np.ones(len(at), bool)  # a run of windows may go on in the next piece
    new[1:] = at[1:] != at[:-1]
    return at[new], low[new]


def _chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about CHUNK positions: whole texts, or parts of a longer one."""
    first, total = int(off[0]), int(off[-1])
    while first < total:
        end = int(off[np.searchsorted(off, first + CHUNK, "right") - 1])
        if end <= first:
            end = min(first + CHUNK, total)
        yield first, end
        first = end


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray, both: bool = False):
    """Hash of the bytes of each span; with ``both`` a second one of 32 bits. Starts must rise."""
    out = np.empty(len(start), np.uint64)
    second = np.empty(len(start) if both else 0, np.uint32)
    at = 0
    while at < len(start):
        first = int(start[at])
        stop = max(int(np.searchsorted(start, first + CHUNK)), at + 1)
        piece = data[first : int(end[at:stop].max())]
        s, e = start[at:stop] - first, end[at:stop] - first
        out[at:stop] = W._hashes(W._running(piece, W._RAW), s, e)
        if both:
            second[at:stop] = (W._hashes(W._running(piece, _SECOND), s, e) >> _U(32)).astype(np.uint32)
        at = stop
    return (out, second) if both else out


def phrases(data: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases start and end: from an anchor to the next one of the same text."""
    at, _ = anchors(data, off, window)
    doc = np.searchsorted(off, at, "right")
    same = np.flatnonzero(doc[1:] == doc[:-1])
    return at[same], at[same + 1]


# Packed rows -------------------------------------------------------------------------------------


def _rising(x: np.ndarray) -> bytes:
    return W.pack(np.diff(x.astype(np.uint64), prepend=_U(0)))


def _risen(blob: bytes) -> np.ndarray:
    return np.cumsum(W.unpack(blob), dtype=np.uint64)


def _runs(x: np.ndarray) -> bytes:
    """Rising numbers as runs of neighbours."""
    new = np.flatnonzero(np.diff(x, prepend=-2) != 1)
    return W.pack(np.stack([x[new], np.append(new[1:], len(x)) - new], 1).astype(np.int64).ravel())


def _of_runs(blob: bytes) -> np.ndarray:
    runs = W.unpack(blob).astype(np.int64).reshape(-1, 2)
    return _ranges(runs[:, 0], runs[:, 0] + runs[:, 1])


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _parts(name: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted names."""
    bucket = _bucket(name, buckets)
    new = np.flatnonzero(np.diff(bucket, prepend=-1))
    for first, end in zip(new.tolist(), [*new[1:].tolist(), len(name)]):
        yield int(bucket[first]), first, end


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    }
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields],
        names=[name for name, _ in fields],
    )


def _table(schema: str, rows: list[dict]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, rows)])


def _asks(block: int, name: np.ndarray, at: np.ndarray, span: np.ndarray, buckets: int) -> Iterator[dict]:
    order = np.argsort(name)
    name, at, span = name[order], at[order].astype(np.uint32), span[order].astype(np.uint16)
    for bucket, i, j in _parts(name, buckets):
        yield {"bucket": bucket, "block": block, "names": _rising(name[i:j]), "at": W.pack(at[i:j]), "span": W.pack(span[i:j])}


# Blocks ------------------------------------------------------------------------------------------


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts in compressed blocks, with sizes and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in W.slices(batch, size=BLOCK_BYTES):
                data, off = W.raw(part.column("text"))
                body = data.tobytes()
                shas = [hashlib.sha256(body[i:j]).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                row = {
                    "block": number, "ids": part.column("id").to_pylist(), "n_bytes": len(body),
                    "sizes": W.pack(np.diff(off)), "shas": b"".join(shas), "text": _pressed(body),
                }
                yield _batch(_BLOCK, [row])
                number += 1

    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return plain.mapInArrow(run, _BLOCK)


def _pressed(body: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def _body(row: dict) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(W.unpack(row["sizes"]).astype(np.int64))])
    data = pa.decompress(row["text"], int(off[-1]), codec="zstd", asbytes=True) if off[-1] else b""
    return np.frombuffer(data, np.uint8), off


# Doubling ----------------------------------------------------------------------------------------


def _first_asks(stored: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, off = _body(row)
                start, end = phrases(data, off, window)
                rows = list(_asks(row["block"], names(data, start, end), start, end - start, buckets))
                if rows:
                    yield _batch(_ASK, rows)

    return stored.select("block", "sizes", "text").mapInArrow(run, _ASK)


def rank(name: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the names that occur twice or more, from 1, and 0 for the others; and how
    often each occurs."""
    order = np.argsort(name, kind="stable")
    name = name[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    number = np.cumsum(new) - 1
    count = np.bincount(number)[number]
    out, counts = np.empty(len(name), np.uint64), np.empty(len(name), np.int64)
    out[order] = np.where(count > 1, (_U(bucket) << _U(32)) + (number + 1).astype(np.uint64), _U(0))
    counts[order] = count
    return out, counts


def _ranked(asked: DataFrame, first: bool) -> DataFrame:
    """Hash ranges tell every block which of its chains are repeated, and their ranks."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = [_risen(r["names"]) for r in rows]
        sizes = np.cumsum([0, *map(len, found)])
        ranks, counts = rank(np.concatenate(found), rows[0]["bucket"])
        told = []
        for r, i, j in zip(rows, sizes[:-1], sizes[1:]):
            at, span = W.unpack(r["at"]), W.unpack(r["span"])
            order = np.argsort(at)
            at, span, mine, heavy = at[order], span[order], ranks[i:j][order], counts[i:j][order] >= HEAVY
            alive, dead = mine > 0, np.zeros(0, np.int64) if first else np.flatnonzero(mine == 0)
            if alive.any() or len(dead):
                told.append(
                    {
                        "block": r["block"], "at": _rising(at[alive]), "span": W.pack(span[alive]), "rank": W.pack(mine[alive]),
                        "heavy": _rising(at[heavy & alive]) if first else None, "dead_at": _rising(at[dead]), "dead_end": W.pack(span[dead]),
                    }
                )
        return _table(_TOLD, told)

    return asked.groupBy("bucket").applyInArrow(run, _TOLD)


def _paired(told: DataFrame, length: int, buckets: int, first: bool) -> DataFrame:
    """Per block what is known now, and the pairs to rank next: a chain and the one behind it."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        block = rows[0]["block"]
        at, span, ranks = (
            np.concatenate([read(r[c]) for r in rows])
            for c, read in (("at", _risen), ("span", W.unpack), ("rank", W.unpack))
        )
        order = np.argsort(at)
        at, span, ranks = at[order].astype(np.int64), span[order].astype(np.int64), ranks[order]
        dead_at = np.concatenate([_risen(r["dead_at"]) for r in rows]).astype(np.int64)
        dead_end = dead_at + np.concatenate([W.unpack(r["dead_end"]) for r in rows]).astype(np.int64)
        order = np.argsort(dead_at)
        out = [
            {
                "kind": "known", "block": block, "alive": _rising(at) if first else None,
                "heavy": _rising(np.sort(np.concatenate([_risen(r["heavy"]) for r in rows]))) if first else None,
                "dead_at": _rising(dead_at[order]), "dead_end": W.pack((dead_end - dead_at)[order].astype(np.uint16)),
            }
        ]
        behind = np.searchsorted(at, at + span)
        behind[behind == len(at)] = 0
        pair = np.flatnonzero((at[behind] == at + span) & (span + span[behind] <= length - GRAM)) if len(at) else []
        if len(pair):
            other = behind[pair]
            name = W.mix(ranks[pair] + W.mix(ranks[other]) * _U(3) + W.mix(span[pair].astype(np.uint64)))
            out += [{"kind": "ask", **x} for x in _asks(block, name, at[pair], span[pair] + span[other], buckets)]
        return _table(_KNOWN, out)

    return told.groupBy("block").applyInArrow(run, _KNOWN)


# Whole strings -----------------------------------------------------------------------------------


def possible(
    data: np.ndarray, off: np.ndarray, length: int, alive: np.ndarray, dead_at: np.ndarray, dead_end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of strings that hold no unique chain of their own anchors, and from where up to where
    the strings start."""
    window = window_of(length)
    reach = length - window - GRAM + 1  # the last window of a string starts so far behind it
    at, low = anchors(data, off, window)
    if not len(at):
        return at, low, low
    doc = np.searchsorted(off, at, "right") - 1
    next_low = np.append(low[1:], 0)
    open_end = np.append(doc[1:] != doc[:-1], True)
    next_low[open_end] = off[doc[open_end] + 1]
    # Where the shortest unique chain from an anchor, or from any later one, ends. Chains of later
    # texts end behind this text and so rule nothing out here.
    ends = np.full(len(at), np.iinfo(np.int64).max)
    place = np.searchsorted(alive, at).clip(0, max(len(alive) - 1, 0))
    unique = ~open_end & (alive[place] != at if len(alive) else True)
    ends[unique] = at[np.flatnonzero(unique) + 1]
    place = np.searchsorted(at, dead_at)
    ends[place] = np.minimum(ends[place], dead_end)
    least = np.minimum.accumulate(ends[::-1])[::-1]
    # A string is unique if its last anchor lies at or behind that end.
    stop = np.append(low - reach, np.iinfo(np.int64).max)[np.searchsorted(at, least)]
    stop = np.minimum(np.minimum(stop, next_low), off[doc + 1] - length + 1)
    some = stop > low
    return at[some], low[some], stop[some]


def _covered(good: np.ndarray, length: int, total: int) -> np.ndarray:
    """Per byte, whether a repeated string covers it."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, good, 1)
    np.add.at(step, good + length, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _facts(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Of a block, where phrases that are repeated start, where frequent ones do, and where unique
    chains start and end (the shortest one of each start)."""
    alive, heavy = (
        np.sort(np.concatenate([np.empty(0, np.uint64), *[_risen(r[c]) for r in rows if r[c]]])).astype(np.int64)
        for c in ("alive", "heavy")
    )
    at = np.concatenate([np.empty(0, np.uint64), *[_risen(r["dead_at"]) for r in rows]]).astype(np.int64)
    end = at + np.concatenate([np.empty(0, np.int64), *[W.unpack(r["dead_end"]).astype(np.int64) for r in rows]])
    order = np.lexsort((end, at))
    at, end = at[order], end[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return alive, heavy, at[new], end[new]


def _open(row: dict, facts: list[dict], length: int):
    """Text of a block, and its possible strings: anchors, first and last shift, and the starts of
    those with a frequent phrase."""
    data, off = _body(row)
    alive, heavy, dead_at, dead_end = _facts(facts)
    none = np.empty(0, np.int64)
    if not len(alive):
        return data, off, none, none, none, none
    at, low, stop = possible(data, off, length, alive, dead_at, dead_end)
    often = np.isin(at, heavy)
    whole = _ranges(low[often], stop[often])
    at, low, stop = at[~often], low[~often], stop[~often]
    return data, off, at, at - stop + 1, at - low, whole


def _whole_names(data: np.ndarray, start: np.ndarray, length: int):
    """Different names of the strings, in order, whether each is here twice, and its number per start."""
    low, high = names(data, start, start + length, both=True)
    number, first = _numbered(low, high)
    return low[first], high[first], np.bincount(number, minlength=len(first)) > 1, number


def _numbered(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal pairs, in the order of the pairs, and one place of each."""
    order = np.lexsort((high, low))
    new = np.ones(len(low), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    number = np.empty(len(low), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _strings(stored: DataFrame, facts: DataFrame, length: int, buckets: int) -> DataFrame:
    """What blocks ask about whole strings."""
    window = window_of(length)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            data, off, at, least, most, whole = _open(row, right.to_pylist(), length)
            block = row["block"]
            if len(at):
                low, high = names(data, at, at + length - window, both=True)
                order = np.lexsort((high, low))
                for bucket, i, j in _parts(low[order], buckets):
                    mine = order[i:j]
                    a, x, y = at[mine], least[mine], most[mine]
                    # The bytes before the anchor, and those behind what all its strings share.
                    sides = np.stack([a - y, a, a + length - window, a + length - x], 1).reshape(-1, 2)
                    out.append(
                        {
                            "bucket": bucket, "block": block, "low": _rising(low[mine]), "high": W.pack(high[mine]),
                            "at": W.pack(a.astype(np.uint32)), "least": W.pack(x.astype(np.uint16)),
                            "most": W.pack(y.astype(np.uint16)),
                            "bytes": _pressed(data[_ranges(sides[:, 0], sides[:, 1])].tobytes()),
                        }
                    )
            if len(whole):
                low, high, twice, _ = _whole_names(data, whole, length)
                for bucket, i, j in _parts(low, buckets):
                    out.append(
                        {
                            "bucket": bucket, "block": block, "whole_low": _rising(low[i:j]),
                            "whole_high": W.pack(high[i:j]), "twice": np.packbits(twice[i:j]).tobytes(),
                        }
                    )
        return _table(_STRING, out)

    left = stored.select("block", "sizes", "text").groupBy("block")
    return left.cogroup(facts.groupBy("block")).applyInArrow(run, _STRING)


def shifted(low, high, least, most, sides: np.ndarray, window: int) -> np.ndarray:
    """Per anchor and shift whether the string that starts so far before the anchor occurs twice.

    ``sides`` holds per anchor ``most`` bytes before it and ``window - least`` bytes behind the
    shared ones; the string of a shift has ``shift`` of the first and ``window - shift`` of the
    second. Its name grows and shrinks by a byte from one shift to the next.
    """
    n = len(low)
    start = np.cumsum(most + window - least) - (most + window - least)
    out = np.zeros((n, window), bool)
    power = np.cumprod(np.full(window + 1, W._BASE, np.uint64))
    tables = (W._RAW, _SECOND)

    def term(table, at, k):
        return table[sides[at]] * power[k]

    before = [np.zeros(n, np.uint64) for _ in tables]
    after = [np.zeros(n, np.uint64) for _ in tables]
    for k in range(1, window):
        rows = np.flatnonzero(most >= k)
        for sum_, table in zip(before, tables):
            sum_[rows] += term(table, start[rows] + most[rows] - k, k)
    for shift in range(window - 1, -1, -1):
        size = window - shift  # one more byte behind, one less before
        rows = np.flatnonzero(window - least >= size)
        for sum_, table in zip(after, tables):
            sum_[rows] += term(table, start[rows] + most[rows] + size - 1, size)
        if shift + 1 < window:
            rows = np.flatnonzero(most >= shift + 1)
            for sum_, table in zip(before, tables):
                sum_[rows] -= term(table, start[rows] + most[rows] - shift - 1, shift + 1)
        rows = np.flatnonzero((least <= shift) & (shift <= most))
        if not len(rows):
            continue
        one, two = (
            W.mix(k[rows] + W.mix(b[rows]) * _U(3) + W.mix(a[rows]) * _U(5))
            for k, b, a in zip((low, high.astype(np.uint64)), before, after)
        )
        number, _ = _numbered(one, two >> _U(32))
        out[rows, shift] = np.bincount(number)[number] > 1
    return out


def _found(asked: DataFrame, length: int) -> DataFrame:
    """Hash ranges tell the blocks which of the strings occur twice or more."""
    window = window_of(length)

    def run(group: pa.Table) -> pa.Table:
        rows, out = group.to_pylist(), []
        near = [r for r in rows if r["low"] is not None]
        if near:
            low, high, at, least, most = (
                [read(r[c]) for r in near]
                for c, read in (("low", _risen), ("high", W.unpack), ("at", W.unpack), ("least", W.unpack), ("most", W.unpack))
            )
            places = np.cumsum([0, *map(len, low)])
            low, high = np.concatenate(low), np.concatenate(high)
            least, most = np.concatenate(least).astype(np.int64), np.concatenate(most).astype(np.int64)
            sizes = most + window - least
            ends = np.cumsum(sizes)
            sides = b"".join(
                pa.decompress(r["bytes"], int(sizes[i:j].sum()), codec="zstd", asbytes=True)
                for r, i, j in zip(near, places[:-1], places[1:])
            )
            # Anchors whose shared bytes occur once drop out first.
            number, _ = _numbered(low, high)
            some = np.flatnonzero(np.bincount(number)[number] > 1)
            sides = np.frombuffer(sides, np.uint8)[_ranges((ends - sizes)[some], ends[some])]
            hit = shifted(low[some], high[some], least[some], most[some], sides, window)
            good = hit.any(1)
            some, hit = some[good], hit[good]
            cut = np.searchsorted(some, places)
            for r, a, i, j, first in zip(near, at, cut[:-1], cut[1:], places[:-1]):
                if j > i:
                    mine = a[some[i:j] - first]
                    order = np.argsort(mine)
                    bits = np.packbits(hit[i:j][order], axis=1).tobytes()
                    out.append({"block": r["block"], "at": _rising(mine[order]), "shifts": _pressed(bits)})
        whole = [r for r in rows if r["whole_low"] is not None]
        if whole:
            low, high = [_risen(r["whole_low"]) for r in whole], [W.unpack(r["whole_high"]) for r in whole]
            places = np.cumsum([0, *map(len, low)])
            twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(x)) for r, x in zip(whole, low)]
            number, _ = _numbered(np.concatenate(low), np.concatenate(high))
            count = np.bincount(number, weights=1 + np.concatenate(twice))
            hit = count[number] > 1
            out += [
                {"block": r["block"], "bucket": r["bucket"], "whole": np.packbits(hit[i:j]).tobytes()}
                for r, i, j in zip(whole, places[:-1], places[1:])
            ]
        return _table(_HIT, out)

    return asked.groupBy("bucket").applyInArrow(run, _HIT)


def _cut(stored: DataFrame, facts: DataFrame, hits: DataFrame, length: int, buckets: int) -> DataFrame:
    """Documents without the bytes of repeated strings."""
    window = window_of(length)
    row_bytes = (window + 7) // 8

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = right.to_pylist()
        near = [r for r in told if r["hit_at"] is not None]
        bits = {r["bucket"]: np.frombuffer(r["whole"], np.uint8) for r in told if r["whole"] is not None}
        good = [np.empty(0, np.int64)]
        for r in near:
            at = _risen(r["hit_at"]).astype(np.int64)
            packed = pa.decompress(r["shifts"], len(at) * row_bytes, codec="zstd", asbytes=True)
            hit = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(len(at), row_bytes), axis=1, count=window)
            i, shift = np.nonzero(hit)
            good.append(at[i] - shift)
        out = []
        for row in left.to_pylist():
            if bits:
                facts_ = [r for r in told if r["dead_at"] is not None]
                data, off, _, _, _, whole = _open(row, facts_, length)
                low, _, _, number = _whole_names(data, whole, length)
                hit = [np.unpackbits(bits[b], count=j - i) for b, i, j in _parts(low, buckets)]
                good.append(whole[np.concatenate(hit).astype(bool)[number]])
            else:
                data, off = _body(row)
            gone = _covered(np.concatenate(good), length, int(off[-1]))
            for d, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                part = gone[i:j]
                removed = int(part.sum())
                sha = row["shas"][32 * d : 32 * d + 32].hex()
                if removed:
                    sha = hashlib.sha256(data[i:j][~part].tobytes()).hexdigest()
                spans = int((np.diff(part.astype(np.int8), prepend=0) == 1).sum()) if removed else 0
                out.append((row["ids"][d], j - i, removed, spans, sha))
        columns = zip(*out) if out else [[]] * 5
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()])],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    told = facts.unionByName(hits, allowMissingColumns=True)
    left = stored.select("block", "ids", "sizes", "shas", "text").groupBy("block")
    return left.cogroup(told.groupBy("block")).applyInArrow(run, _RESULT)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``key``, n_bytes, n_removed, n_spans, kept_sha256."""
    if length < 2 * GRAM or length > 1 << 15:
        raise ValueError(f"length must lie between {2 * GRAM} and {1 << 15}")
    spark = docs.sparkSession
    path = scratch_path(spark, "repeat-blocks")
    blocks(docs, key, text).write.parquet(path)
    stored = spark.read.schema(_BLOCK).parquet(path)
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES)

    asked, facts, first = _first_asks(stored, window_of(length), buckets), None, True
    while asked is not None:
        path = scratch_path(spark, "repeat-ranks")
        _paired(_ranked(asked, first), length, buckets, first).write.partitionBy("kind").parquet(path)
        now = spark.read.schema(_KNOWN.replace("kind string, ", "") + ", kind string").parquet(path)
        known = now.where("kind = 'known'").select("block", *_FACT)
        facts = known if facts is None else facts.unionByName(known)
        asked = now.where("kind = 'ask'").select("bucket", "block", "names", "at", "span")
        asked, first = None if asked.isEmpty() else asked, False

    hits = _found(_strings(stored, facts, length, buckets), length)
    return _cut(stored, facts, hits.withColumnRenamed("at", "hit_at"), length, buckets).withColumnRenamed("id", key)
