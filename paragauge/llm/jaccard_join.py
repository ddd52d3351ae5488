"""Similarity join of documents on word shingles, by T-occurrence search (DivideSkip).

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 3/4.

1. Every document gets the size and a 128-bit signature of its set; equal sets are one node.
2. Shingle frequencies over all documents give a global order, rare shingles first. The tasks are told
   it by two tables of fixed size: a coarse class per hash slot, and a finer one for the ``HEAVY``
   most frequent shingles. Any order gives the same links; a better one gives smaller clusters.
3. Linked sets share a shingle among their first quarter in that order (prefix), and it is in the first
   seventh of the smaller one. Nodes that share such a one and are of similar size fall into one
   cluster; a cluster holds all links of its nodes.
4. Clusters are packed into blocks of about ``BLOCK`` shingles. Within a cluster, sets that have too few
   shingles in common with all others together are left out, and an inverted index is searched for
   each of the others: the short lists of shingles rare in both sets are merged by a heap that skips,
   and for sets met there the overlap is looked up in the long ones (DivideSkip). Links between two
   groups are searched for from the smaller one, in lists that hold larger groups, so a group of copies
   costs a spanning tree, not pairs.
5. A cluster beyond a block is cut into parts. Each part is joined with itself and with the first
   part; sets that still do not belong to the cluster's largest group are then searched for in all
   parts. That is exact, and no task ever holds more than a few blocks.

Defined cases: letters A-Z count as lower case; a text with fewer words than five has its whole
sequence as one shingle; null, empty and blank texts have no shingles and link with nothing; rows
with equal text are linked; repeated rows each get a row in the result; a null id belongs to its
group without naming it; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.llm import words as W
from paragauge.llm.components import connected
from paragauge.session import scratch_path

WIDTH = 5
#: Shingles whose fine frequency class is broadcast: 5 bytes each.
HEAVY = 1 << 20
#: Bits of a shingle's hash that give its slot in the coarse table: 2 bits per slot, 32 MB.
SLOT_BITS = 27
#: Shingles in one block of the index.
BLOCK = 1 << 21
#: Shingles of prefixes that a task gathers before they are told to the buckets.
TOLD = 1 << 20
#: Bits of the filter that keeps sets without any candidate from travelling.
FILTER_BITS = 1 << 25


def least_overlap(n: int) -> int:
    """Shingles that a set of n must share with any set it links with: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def overlap(n, m):
    """Shingles that sets of n and m must share to link: ceil(3 (n + m) / 7)."""
    return (3 * (n + m) + 6) // 7


def linked(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= 75 * (n + m - shared)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingles of all texts in a row, and the places where sets begin and end."""
    data, off = W.raw(texts)
    n = len(off) - 1
    span = W.words(data, off, lower=True)
    counts = np.bincount(span.doc, minlength=n)
    _, doc, key = W.windows(span, WIDTH)
    parts = [(doc, key)]
    for width in range(1, WIDTH):
        _, doc, key = W.windows(span, width)
        short = counts[doc] == width
        parts.append((doc[short], W.mix(key[short] + np.uint64(width))))
    doc = np.concatenate([p[0] for p in parts])
    key = np.concatenate([p[1] for p in parts])
    order = np.argsort(key)
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    order = order[np.argsort(doc[order].astype(kind), kind="stable")]
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])
    return key[new], bounds


def signatures(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, as signed numbers; 0 for an empty one."""
    out = []
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    for salt in (1, 2):
        total = np.zeros(len(bounds) - 1, np.uint64)
        if len(some):
            spread = W.mix(keys ^ W.mix(np.array([salt], np.uint64)))
            total[some] = np.add.reduceat(spread, bounds[some])
        out.append(total.view(np.int64))
    return out[0], out[1]


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bucketed(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted 64-bit values begins and ends."""
    limits = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // max(buckets, 2))
    return np.concatenate([[0], np.searchsorted(values, limits), [len(values)]])


def _spread(signature: np.ndarray, buckets: int) -> pa.Array:
    """Any bucket for each document; copies lie apart too."""
    return pa.array(((np.arange(len(signature)) * 7 + signature % 5) % buckets).astype(np.int32))


# 1 and 2: signatures and frequencies -----------------------------------------------------------


def sized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (id, n, one, two) of documents, and rows (blob) of shingles by their hash.

    Both kinds have a bucket, so that they pass one exchange together.
    """
    buckets = _partitions(docs)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["id", "n", "one", "two", "bucket", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = []
            for part in W.slices(batch):
                keys, bounds = shingle_sets(part.column("text"))
                one, two = signatures(keys, bounds)
                rows = len(one)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bounds)), pa.array(one), pa.array(two)]
                    + [_spread(one, buckets), pa.nulls(rows, pa.binary())],
                    names=names,
                )
                top.append((keys >> np.uint64(32)).astype(np.uint32))
            top = np.sort(np.concatenate(top)) if top else np.empty(0, np.uint32)
            ends = _bucketed(top.astype(np.uint64) << np.uint64(32), buckets)
            blobs = [W.pack(top[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(buckets, k) for k in kinds[:4]]
                + [pa.array(range(buckets), pa.int32()), pa.array(blobs, pa.binary())],
                names=names,
            )

    plain = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")
    )
    return plain.mapInArrow(
        run, "id long, n long, one long, two long, bucket int, blob binary"
    )


_SIZED = "id long, n long, one long, two long, level int, count long, blob binary"


def by_frequency(messages: DataFrame) -> DataFrame:
    """The documents of ``sized``, and per bucket and frequency class the shingles of it."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table["blob"].drop_null()
        top = np.sort(np.concatenate([W.unpack(b.as_py()) for b in blobs]))
        new = np.ones(len(top), bool)
        new[1:] = top[1:] != top[:-1]
        count = np.diff(np.append(np.flatnonzero(new), len(top)))
        level, top = np.log2(np.maximum(count, 1)).astype(np.int64), top[new]
        out = [(x, W.pack(top[level == x])) for x in np.unique(level[level >= FINE]).tolist()]
        if len(top):
            out.append((0, _segment(top[level > 0], level[level > 0])))
        docs = table.filter(pc.is_null(table["blob"])).select(["id", "n", "one", "two"])
        n = len(out)
        classes = {
            "level": pa.array([x for x, _ in out], pa.int32()),
            "count": pa.array([int((level == x).sum()) for x, _ in out], pa.int64()),
            "blob": pa.array([t for _, t in out], pa.binary()),
        }
        return pa.concat_tables(
            [
                docs.append_column("level", pa.nulls(len(docs), pa.int32()))
                .append_column("count", pa.nulls(len(docs), pa.int64()))
                .append_column("blob", pa.nulls(len(docs), pa.binary())),
                pa.table({c: pa.nulls(n, pa.int64()) for c in ("id", "n", "one", "two")} | classes),
            ]
        )

    return messages.groupBy("bucket").applyInArrow(run, _SIZED)


#: Frequency classes are base-2 logarithms; from this one on they are fine.
FINE = 4


def _segment(top: np.ndarray, level: np.ndarray) -> bytes:
    """First byte and packed bytes of the coarse table that ``top`` falls into, in 2-bit classes."""
    if not len(top):
        return bytes(8) + W.pack(np.empty(0, np.uint8))
    slot = top >> np.uint32(32 - SLOT_BITS)
    coarse = np.where(level >= FINE, 3, np.minimum(level, 2)).astype(np.uint8)
    first = int(slot[0]) // 4
    classes = np.zeros((int(slot[-1]) // 4 - first + 1) * 4, np.uint8)
    np.maximum.at(classes, slot.astype(np.int64) - first * 4, coarse)
    four = classes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return first.to_bytes(8, "little") + W.pack(np.bitwise_or.reduce(four, axis=1).astype(np.uint8))


@dataclass
class Order:
    """Classes of shingles by frequency, told to every task; rare ones have class 0."""

    slots: np.ndarray  # 2 bits per slot
    top: np.ndarray  # upper halves of the most frequent shingles, sorted
    level: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - SLOT_BITS)
        shift = ((slot & np.uint64(3)) << np.uint64(1)).astype(np.uint8)
        found = self.slots[(slot >> np.uint64(2)).astype(np.int64)] >> shift & 3
        fine = np.flatnonzero(found == 3)  # the others are not in the finer table
        if len(self.top) and len(fine):
            half = (keys[fine] >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.top, half), len(self.top) - 1)
            found[fine] = np.where(self.top[at] == half, self.level[at], 3)
        return found


def frequent(classes: DataFrame) -> Order:
    """The two tables; what reaches the driver is bounded by their sizes."""
    slots = np.zeros(1 << SLOT_BITS - 2, np.uint8)
    for row in classes.where("level = 0").select("blob").collect():
        first, part = int.from_bytes(row.blob[:8], "little"), W.unpack(bytes(row.blob[8:]))
        slots[first : first + len(part)] |= part
    fine = classes.where("level > 0")
    total, least = 0, 100
    for level, n in sorted(fine.groupBy("level").agg(F.sum("count")).collect(), reverse=True):
        total += n
        if total > HEAVY:
            break
        least = level
    rows = fine.where(F.col("level") >= least).select("level", "blob").collect()
    tops = [W.unpack(bytes(r.blob)) for r in rows]
    top = np.concatenate(tops) if tops else np.empty(0, np.uint32)
    level = np.repeat([r.level for r in rows], [len(t) for t in tops]).astype(np.uint8)
    order = np.argsort(top)
    return Order(slots, top[order], level[order])


# 3: clusters -----------------------------------------------------------------------------------


def prefixes(docs: DataFrame, text: str, order: Order) -> DataFrame:
    """Rows (node, n, one, two), one per task and different set, and messages of prefixes.

    Both kinds have a bucket, so that they pass one exchange together.
    """
    buckets = _partitions(docs)
    shared = docs.sparkSession.sparkContext.broadcast(order)
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 3
    names = ["node", "n", "one", "two", "bucket", "keys", "nodes", "sizes"]

    def told(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, node, size = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys)
        keys, node, size = keys[order], node[order], size[order]
        first = node.min()
        node = (node - first).astype(np.uint32)
        ends = _bucketed(keys, buckets)
        cut = list(zip(ends, ends[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.nulls(buckets, k) for k in kinds[:4]]
            + [pa.array(range(buckets), pa.int32())]
            + [
                pa.array([W.pack(keys[a:b]) for a, b in cut], pa.binary()),
                pa.array([first.tobytes() + W.pack(node[a:b]) for a, b in cut], pa.binary()),
                pa.array([W.pack(size[a:b]) for a, b in cut], pa.binary()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 33, set()
        count, waiting = 0, []
        for batch in batches:
            for part in W.slices(batch):
                keys, bounds = shingle_sets(part.column("text"))
                one, two = signatures(keys, bounds)
                size = np.diff(bounds)
                fresh = np.zeros(len(one), bool)
                for i, sign in enumerate(zip(one.tolist(), two.tolist(), size.tolist())):
                    if sign[2] and sign not in seen:
                        seen.add(sign)
                        fresh[i] = True
                pick = np.flatnonzero(fresh)
                node = base + count + np.arange(len(pick))
                count += len(pick)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (node, size[pick], one[pick], two[pick])]
                    + [_spread(one[pick], buckets), *[pa.nulls(len(pick), k) for k in kinds[5:]]],
                    names=names,
                )
                mine = np.repeat(fresh, size)
                waiting.append(_prefix(keys[mine], size[pick], node, shared.value))
                if sum(len(x) for x, *_ in waiting) >= TOLD:
                    yield told(waiting)
                    waiting = []
        if sum(len(x) for x, *_ in waiting):
            yield told(waiting)

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "node long, n long, one long, two long, bucket int, keys binary, nodes binary, sizes binary"
    )


def _prefix(keys: np.ndarray, n: np.ndarray, node: np.ndarray, order: Order) -> tuple[np.ndarray, ...]:
    """Of sets of ``n`` sorted shingles each the first quarter in the order: shingle, node, and n twice, plus
    one for the first seventh. Two linked sets share one that is in the first seventh of the smaller."""
    number = np.repeat(np.arange(len(n)), n)
    rare = np.argsort(order.of(keys), kind="stable")  # rare first in each set
    rare = rare[np.argsort(number[rare].astype(np.uint16 if len(n) <= 1 << 16 else np.uint32), kind="stable")]
    place = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
    early = place < (n - least_overlap(n) + 1)[number]
    seventh = place < (n - overlap(n, n) + 1)[number]
    size = (2 * n[number] + seventh).astype(np.uint32)
    return keys[rare[early]], node[number[early]], size[early]


class Forest:
    """Union-find over 0 to n - 1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def _forest_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as the links (a, b), as one star per group."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b = a[new], b[new]
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
        forest.join(x, y)
    root = np.array([forest.find(x) for x in range(len(nodes))], np.int64)
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def neighbours(messages: DataFrame) -> DataFrame:
    """Links (a, b) that hold nodes with a common prefix shingle and similar size together, and the
    nodes of ``prefixes``."""

    def run(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_null(table["keys"])).select(["node", "n", "one", "two"])
        told = table.filter(pc.is_valid(table["keys"]))
        links = _near(told) if len(told) else (np.empty(0, np.int64),) * 2
        nothing = [pa.nulls(len(own), pa.int64())] * 2
        return pa.concat_tables(
            [
                pa.table([*own.columns, *nothing], names=_NODES),
                pa.table(
                    [*[pa.nulls(len(links[0]), pa.int64())] * 4, *(pa.array(x) for x in links)],
                    names=_NODES,
                ),
            ]
        )

    return messages.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} long" for c in _NODES))


_NODES = ["node", "n", "one", "two", "a", "b"]


def _near(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes with a shingle, by size: each with the last one before it that has it in the first
    seventh, if they are of similar size. Any two such nodes in between are joined one by one."""
    keys = np.concatenate([W.unpack(x.as_py()) for x in table["keys"]])
    nodes, sizes = [], []
    for blob, size in zip(table["nodes"], table["sizes"]):
        blob = blob.as_py()
        nodes.append(np.frombuffer(blob[:8], np.int64)[0] + W.unpack(blob[8:]).astype(np.int64))
        sizes.append(W.unpack(size.as_py()).astype(np.int64))
    nodes, sizes = np.concatenate(nodes), np.concatenate(sizes)
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[1:] |= again
    twice[:-1] |= again
    order = order[twice]
    order = order[np.lexsort((nodes[order], sizes[order] >> 1, keys[order]))]
    keys, nodes, sizes, seventh = keys[order], nodes[order], sizes[order] >> 1, sizes[order] & 1 == 1
    last = np.maximum.accumulate(np.where(seventh, np.arange(len(keys)), 0))[:-1]
    near = seventh[last] & (keys[1:] == keys[last]) & (4 * sizes[last] >= 3 * sizes[1:])
    return _forest_links(nodes[last[near]], nodes[1:][near])


# 4: search within a block ----------------------------------------------------------------------


class Groups:
    """Groups of sets that hang together; ``root`` names each set's group. The smaller group is renamed."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = [[x] for x in range(n)]

    def join(self, x: int, y: int) -> None:
        x, y = int(self.root[x]), int(self.root[y])
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.root[self.members[y]] = x
        self.members[x] += self.members[y]
        self.members[y] = []


def merge_skip(lists: memoryview, spans: list[tuple[int, int]], least: int, low: int, steps: list[int] | None = None):
    """(place, occurrences) of the places from ``low`` on that are in ``least`` or more of the lists.

    A heap holds the next place of each list. Where the smallest one occurs too rarely, ``least - 1`` lists
    are taken off and jump by binary search to the smallest place of the others: what lies between
    cannot occur often enough.
    """
    ends, at, heap = [], [], []
    for start, end in spans:
        start = bisect_left(lists, low, start, end)
        if start < end:
            heap.append((lists[start], len(at)))
            at.append(start)
            ends.append(end)
    heapify(heap)
    taken = 0
    while len(heap) >= least:
        top, off = heap[0][0], []
        while heap and heap[0][0] == top:
            off.append(heappop(heap)[1])
        if len(off) >= least:
            yield top, len(off)
            for k in off:
                at[k] += 1
        else:
            while heap and len(off) < least - 1:
                off.append(heappop(heap)[1])
            if not heap:
                break
            for k in off:
                at[k] = bisect_left(lists, heap[0][0], at[k], ends[k])
        taken += len(off)
        for k in off:
            if at[k] < ends[k]:
                heappush(heap, (lists[at[k]], k))
    if steps is not None:
        steps.append(taken)


#: Sets that are tried first, by how many of the lists they stand before the set in.
GUESSES = 3
#: Short lists that two sets must meet in before their other shingles are compared.
MEET = 2
#: Members that are looked at in one go.
LOOK = 1 << 20


def _numbered(keys: np.ndarray, kind: type) -> np.ndarray:
    """Numbers from 0 on in place of keys."""
    order = np.argsort(keys, kind="stable")
    new = np.zeros(len(keys), kind)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), kind)
    out[order] = np.cumsum(new, dtype=kind)
    return out


def _least(size: np.ndarray, smallest: int) -> np.ndarray:
    """Shingles that sets of these sizes must share with any other set, of which none is below ``smallest``."""
    return overlap(size, np.maximum(least_overlap(size), smallest))


def _peeled(size: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members (owner, id) without those that one set has alone, and without sets that have too few left to
    link with any; over and over, as a set that goes takes its members from the others."""
    while len(ids):
        keep = np.bincount(ids)[ids] > 1
        left = np.bincount(owner[keep], minlength=len(size))
        keep &= (left >= _least(size, size[owner[0]]))[owner]
        gone = len(ids) - int(keep.sum())
        owner, ids = owner[keep], ids[keep]
        if 64 * gone <= len(ids):
            break
    return owner, ids


class Lists:
    """For each id, in a row, the sets that have it, ascending."""

    def __init__(self, owner: np.ndarray, ids: np.ndarray, count: int):
        self.order = np.argsort(ids, kind="stable")
        self.sets = owner[self.order]
        self.length = np.bincount(ids, minlength=count)
        self.start = np.cumsum(self.length) - self.length

    def top(self, rank: np.ndarray) -> np.ndarray:
        """The largest rank in each list; -1 for an empty one."""
        out, some = np.full(len(self.length), -1, np.int64), self.length > 0
        if some.any():
            out[some] = np.maximum.reduceat(rank[self.sets], self.start[some])
        return out


class Index:
    """Sets by size without those that cannot link, their members rare first, and lists of sets by member."""

    def __init__(self, sets: list[np.ndarray]):
        self.by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.size = np.array([len(sets[i]) for i in self.by_size], np.int64)
        keys = np.concatenate([sets[i] for i in self.by_size]) if len(sets) else np.empty(0, np.uint64)
        kind = np.int32 if len(keys) < 1 << 31 else np.int64  # half the index's memory
        owner = np.repeat(np.arange(len(self.size), dtype=kind), self.size)
        owner, ids = _peeled(self.size, owner, _numbered(keys, kind))
        del keys
        ids = _numbered(ids, kind)
        count = np.bincount(ids)
        order = np.lexsort((ids, count[ids], owner))
        self.ids = ids = ids[order]
        self.begins, self.ends = (np.searchsorted(owner, np.arange(len(self.size)), x) for x in ("left", "right"))
        self.some = np.flatnonzero(self.ends > self.begins)
        self.lists = Lists(owner, ids, len(count))
        self.marked = np.zeros(len(count), np.int32)
        if not len(ids):
            return
        self.least = _least(self.size, self.size[self.some[0]])
        self.meet = min(MEET, int(self.least[self.some].min()))
        left = self.ends - self.begins
        early = np.arange(len(ids)) - self.begins[owner] < (left - self.least + self.meet)[owner]
        self.early = (left - self.least + self.meet).clip(0, left)
        self.short = Lists(owner[early], ids[early], len(count))

    def members(self, x: int) -> np.ndarray:
        return self.ids[self.begins[x] : self.ends[x]]

    def before(self) -> np.ndarray:
        """For each member the set before its owner in the list; -1 where there is none."""
        order, sets = self.lists.order, self.lists.sets
        out = np.full(len(order), -1, sets.dtype)
        out[order[1:]] = np.where(self.ids[order[1:]] == self.ids[order[:-1]], sets[:-1], -1)
        return out

    def common(self, q: int, others: np.ndarray) -> np.ndarray:
        """Shared members of the set ``q`` and each of the others."""
        mine, out = self.members(q), []
        self.marked[mine] = 1
        length = self.ends[others] - self.begins[others]
        for part in np.array_split(np.arange(len(others)), 1 + int(length.sum()) // LOOK):
            n = length[part]
            off = np.cumsum(n) - n
            at = np.repeat(self.begins[others[part]] - off, n) + np.arange(int(n.sum()))
            out.append(np.add.reduceat(self.marked[self.ids[at]], off) if len(part) else off)
        self.marked[mine] = 0
        return np.concatenate(out)


def search(sets: list[np.ndarray], steps: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets, enough to connect all that hang together; places in ``sets``.

    Sets without enough shingles that others have are left out first. Then each set tries those that stand
    before it in most of its lists, as copies come together. Of the groups that arise, a link between two
    is found from the smaller one: a set only looks at lists that hold a larger group than its own, so a
    group of near copies costs each of its sets a look at its own lists, however large it is. Sets that link
    meet in the lists of shingles that are rare in both. These short lists are merged by a heap that
    skips; what else two sets share is looked up for those that meet there.
    """
    index = Index(sets)
    size, groups, out = index.size, Groups(len(sets)), []
    if not len(index.some):
        return out

    def link(q: int, others: np.ndarray) -> None:
        for c in others[100 * (n := index.common(q, others)) >= 75 * (size[q] + size[others] - n)].tolist():
            if groups.root[c] != groups.root[q]:
                groups.join(c, q)
                out.append((index.by_size[c], index.by_size[q]))

    before = index.before()
    for q in index.some.tolist():
        guesses = before[index.begins[q] : index.ends[q]]
        guesses, votes = np.unique(guesses[guesses >= 0], return_counts=True)
        if steps is not None:
            steps.append(int(size[q]))
        guesses = guesses[np.argsort(-votes, kind="stable")][:GUESSES]
        guesses = guesses[4 * size[guesses] >= 3 * size[q]]
        if len(guesses):
            link(q, guesses)
    del before

    number = np.array([len(m) for m in groups.members], np.int64)
    rank = (number * len(size) + np.arange(len(size)))[groups.root]  # larger groups have larger ranks
    top = index.lists.top(rank)
    owner = np.repeat(index.some, (index.ends - index.begins)[index.some])
    open_ = np.bincount(owner, top[index.ids] > rank[owner], len(size))  # lists with a larger group
    top, view = index.short.top(rank), memoryview(index.short.sets)
    for q in index.some[open_[index.some] >= index.least[index.some]].tolist():
        _search_one(q, index, groups, rank, top, view, link, steps)
    return out


def _search_one(q, index, groups, rank, top, view, link, steps) -> None:
    """Link the set ``q`` with sets of groups that were larger than its own."""
    size, n, short = index.size, int(index.size[q]), index.short
    low = int(np.searchsorted(4 * size, 3 * n))  # smaller or larger sets cannot share enough
    lists = index.members(q)[: index.early[q]]
    lists = lists[top[lists] > rank[q]]
    spans = zip(short.start[lists].tolist(), (short.start[lists] + short.length[lists]).tolist())
    met = np.array([c for c, _ in merge_skip(view, list(spans), index.meet, low, steps)], np.int64)
    met = met[(3 * size[met] <= 4 * n) & (rank[met] > rank[q]) & (groups.root[met] != groups.root[q])]
    if len(met):
        link(q, met)


def searched(rows: DataFrame) -> DataFrame:
    """Links (a, b) within each cluster of a ``task`` of rows (task, cluster, node, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        own, a, b = {}, [], []
        for cluster, node, blob in zip(table["cluster"].to_pylist(), table["node"].to_pylist(), table["shingles"]):
            own.setdefault(cluster, {}).setdefault(node, blob)
        for sets in own.values():
            nodes = sorted(sets)
            found = search([np.frombuffer(sets[x].as_buffer(), np.uint64) for x in nodes])
            a += [nodes[i] for i, _ in found]
            b += [nodes[j] for _, j in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def _filter(candidates: DataFrame) -> np.ndarray:
    """A Bloom filter over signatures; merged word by word, of fixed size."""
    place = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("one", s), F.lit(FILTER_BITS)) for s in (0, 27)]))
    words = (
        candidates.select(place.alias("bit"))
        .select(F.shiftright("bit", 5).alias("word"), F.expr("shiftleft(1L, cast(bit % 32 AS int)) AS mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy().astype(np.uint32)
    return bits


def sets_of(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """(one, two, n, shingles) of the sets that pass the filter, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), shared.value
        for batch in batches:
            for part in W.slices(batch):
                keys, bounds = shingle_sets(part.column("text"))
                one, two = signatures(keys, bounds)
                size = np.diff(bounds)
                passed = size > 0
                for shift in (0, 27):
                    at = (one.view(np.uint64) >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
                    passed &= (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & 1 == 1
                pick = []
                for i in np.flatnonzero(passed).tolist():
                    sign = (one[i], two[i], size[i])
                    if sign not in seen:
                        seen.add(sign)
                        pick.append(i)
                blobs = [keys[bounds[i] : bounds[i + 1]].tobytes() for i in pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[pick]), pa.array(two[pick]), pa.array(size[pick]), pa.array(blobs, pa.binary())],
                    names=["one", "two", "n", "shingles"],
                )

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "one long, two long, n long, shingles binary"
    )


# 5: all together -------------------------------------------------------------------------------


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    store = scratch_path(spark, "jaccard")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{store}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{store}/{name}")

    rows = stored(by_frequency(sized(docs, key, text)), "sized")
    order = frequent(rows.where("blob IS NOT NULL"))
    members = rows.where("blob IS NULL").select("id", "n", "one", "two")
    found = stored(neighbours(prefixes(docs, text, order)), "near")
    clusters = connected(found.where("a IS NOT NULL").select("a", "b"))

    sign = ["one", "two", "n"]
    nodes = stored(
        found.where("a IS NULL").select("node", *sign)
        .join(clusters, "node")
        .groupBy(*sign).agg(F.min("node").alias("node"), F.min("label").alias("cluster")),
        "nodes",
    )
    weights = nodes.groupBy("cluster").agg(F.sum("n").alias("weight"), F.count("*").alias("size"))
    weights = stored(weights.where("size > 1"), "weights")
    total = weights.agg(F.sum("weight")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    placed = nodes.join(weights, "cluster").withColumn(
        "parts", F.when(F.col("weight") > BLOCK, F.ceil(2 * F.col("weight") / BLOCK)).otherwise(F.lit(1))
    )
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select(
        *sign, "node", "cluster", "parts", "part"
    )
    placed = stored(placed, "placed")
    sets = sets_of(docs, text, _filter(placed)).hint("merge").join(placed, sign).drop("one", "two")
    large = placed.where("parts > 1").select("node", "cluster", "part", "parts", "n")
    several_blocks = not large.isEmpty()
    if several_blocks:  # the sets are needed again, so the texts are not taken apart once more
        sets = stored(sets, "sets")

    small = F.concat(F.lit("b"), F.pmod(F.xxhash64("cluster"), F.lit(blocks)))
    own = F.concat_ws("/", F.col("cluster").cast("string"), F.col("part").cast("string"))
    hub = F.concat_ws("/", F.col("cluster").cast("string"), F.lit("0"))
    everywhere = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda p: F.concat_ws("/", F.col("cluster").cast("string"), p.cast("string")),
    )
    several = F.when(F.col("part") == 0, everywhere).otherwise(F.array(own))
    tasks = F.when(F.col("parts") == 1, F.array(small)).otherwise(several)
    links = stored(searched(sets.select(F.explode(tasks).alias("task"), "cluster", "node", "shingles")), "links")
    groups = connected(links)

    if several_blocks:
        labelled = stored(
            large.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "large"
        )
        sums = labelled.groupBy("cluster", "label").agg(F.count("*").alias("size"))
        main = sums.groupBy("cluster").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
        rest = labelled.join(main, "cluster").where("label <> main").select("node", "cluster", "n")
        load = rest.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).alias("turns"))
        rest = rest.join(load, "cluster").withColumn("turn", F.pmod(F.xxhash64("node", F.lit(3)), F.col("turns")))
        turns = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn")
        name = F.concat_ws("/", *[F.col(c).cast("string") for c in ("cluster", "part", "turn")]).alias("task")
        big = sets.where("parts > 1").select("node", "cluster", "part", "parts", "shingles")
        index = big.join(load, "cluster").select("node", "cluster", "part", "shingles", turns)
        queries = big.join(rest.select("node", "turn"), "node").select(
            "node", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
            "shingles", "turn",
        )
        late = searched(index.unionByName(queries).select(name, "cluster", "node", "shingles"))
        groups = connected(links.unionAll(stored(late, "late")))

    classes = members.where("n > 0").groupBy(*sign).agg(F.min("id").alias("rep"))
    labels = nodes.select(*sign, "node").join(groups, "node").select(*sign, "label")
    classes = stored(classes.join(labels, sign, "left"), "classes")
    least = classes.where("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    named = classes.join(least, "label", "left").select(*sign, F.coalesce("least", "rep").alias("component_id"))
    return members.join(named, sign, "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, all columns; a null id stays."""
    found = components(docs, key, text)
    kept = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("__kept")).distinct()
    return docs.join(kept, F.col(f"`{key}`") == F.col("__kept"), "left").where(
        F.col("__kept").isNotNull() | F.col(f"`{key}`").isNull()
    ).drop("__kept")
