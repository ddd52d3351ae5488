"""Exact deduplication by owners of Patricia tries.

Each input task first merges the copies it reads itself, so a text with any number of copies
travels once per task and buffer. These stand-ins are dealt by text length and content hash, sorted
by them, and put whole into one compressed radix trie per (length, hash bucket). A terminal holds
the owning id, the number of rows and the stand-ins of its text. Rows come in hash order, so a trie
that outgrows its budget spills by subtree: terminals whose hash is past are written out and their
nodes freed.

Defined cases: a null text counts as empty; a null id is smaller than any other; rows with equal id
and equal text count separately in ``group_size`` and are all marked ``kept`` if their id owns the
text, while ``deduplicate`` returns one of them; an empty table gives an empty result; other columns
of the input may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.llm import words as W
from paragauge.session import scratch_path

TRIE_BYTES = 64 << 20
BUFFER_BYTES = 32 << 20
#: The same where whole rows are held; what an entry takes beside its text or row; rows sent at once.
ROW_BUFFER_BYTES, ENTRY_BYTES, OUTPUT_BYTES = 8 << 20, 400, 2 << 20
BUCKETS = 1 << 16
LOWER = bytes(W.LOWER.tolist())


class Node:
    __slots__ = ("edge", "children", "terminal")

    def __init__(self, edge: bytes, terminal: Terminal | None = None):
        self.edge, self.children, self.terminal = edge, {}, terminal


def rank(key: int | None) -> tuple[bool, int]:
    """Order of ids; null is the smallest."""
    return (key is not None, key or 0)


class Terminal:
    """One text: the owning id, how many rows it has, and its stand-ins."""

    __slots__ = ("sha", "owner", "size", "reps", "row")

    def __init__(self, sha: bytes):
        self.sha, self.owner, self.size, self.reps, self.row = sha, None, 0, [], None

    def add(self, rep: tuple[int, int], owner: int | None, size: int, row) -> None:
        if not self.reps or rank(owner) > rank(self.owner):
            self.owner, self.row = owner, row
        self.size += size
        self.reps.append(rep)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    if a == b[: len(a)]:
        return len(a)
    if b == a[: len(b)]:
        return len(b)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie over byte strings."""

    def __init__(self):
        self.root, self.bytes = Node(b""), 0

    def insert(self, key: bytes, sha: bytes) -> Terminal:
        """The terminal of ``key``, made if there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(key) - at + 200
                node = child
                break
            rest = key[at : at + len(child.edge)]
            shared = common(child.edge, rest)
            if shared < len(child.edge):
                upper = Node(child.edge[:shared])
                child.edge = child.edge[shared:]
                upper.children[child.edge[0]] = child
                node.children[key[at]] = child = upper
                self.bytes += 200
            node, at = child, at + shared
        if node.terminal is None:
            node.terminal = Terminal(sha)
        return node.terminal

    def spill(self, current: bytes | None) -> Iterator[Terminal]:
        """Terminals of all subtrees without a text of the hash ``current``, which are freed."""
        open_, order = [(self.root, None, None)], []
        while open_:
            node, parent, letter = open_.pop()
            order.append((node, parent, letter))
            open_ += [(child, node, x) for x, child in node.children.items()]
        for node, parent, letter in reversed(order):
            if node.terminal is not None and node.terminal.sha != current:
                yield node.terminal
                node.terminal = None
            if parent is not None and node.terminal is None and not node.children:
                del parent.children[letter]
                self.bytes -= len(node.edge) + 200


def merged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Copies merged inside each task, within a buffer of BUFFER_BYTES of different texts and entries.

    Two kinds of rows: one per input row with its hash and stand-in (``task``, ``rep``), and one per
    stand-in with the text, its largest id and number of rows.
    """
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType(
        [
            T.StructField("member", T.BooleanType()),
            T.StructField("id", T.LongType()),
            T.StructField("sha", T.BinaryType()),
            T.StructField("task", T.LongType()),
            T.StructField("rep", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("text", T.BinaryType()),
        ]
    )
    names = schema.names

    def rows(n: int, **have) -> pa.RecordBatch:
        kinds = dict(zip(names, _KINDS))
        made = [have[c] if c in have else pa.nulls(n, kinds[c]) for c in names]
        return pa.RecordBatch.from_arrays(made, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[bytes, list] = {}
        first = held = 0

        def flush() -> pa.RecordBatch:
            entries = list(seen.values())
            n = len(entries)
            have = {
                "member": pa.array([False] * n),
                "id": pa.array([e[0] for e in entries], pa.int64()),
                "sha": pa.array(list(seen), pa.binary()),
                "task": pa.array([task] * n, pa.int64()),
                "rep": pa.array(range(first, first + n), pa.int64()),
                "size": pa.array([e[1] for e in entries], pa.int64()),
                "n_bytes": pa.array([len(e[2]) for e in entries], pa.int64()),
                "bucket": pa.array([int.from_bytes(k[:2], "big") for k in seen], pa.int32()),
                "text": pa.array([e[2] for e in entries], pa.binary()),
            }
            return rows(n, **have)

        for batch in batches:
            for part in W.slices(batch):
                data, off = W.raw(part.column("text"))
                lowered, off = data.tobytes().translate(LOWER), off.tolist()
                ids, shas, reps = part.column("id").to_pylist(), [], []
                for i, one in enumerate(ids):
                    norm = lowered[off[i] : off[i + 1]]
                    sha = hashlib.sha256(norm).digest()
                    entry = seen.get(sha)
                    if entry is None:
                        seen[sha] = entry = [one, 0, norm, first + len(seen)]
                        held += len(norm) + ENTRY_BYTES
                    elif rank(one) > rank(entry[0]):
                        entry[0] = one
                    entry[1] += 1
                    shas.append(sha)
                    reps.append(entry[3])
                n = len(ids)
                yield rows(
                    n,
                    member=pa.array([True] * n),
                    id=pa.array(ids, pa.int64()),
                    sha=pa.array(shas, pa.binary()),
                    task=pa.array([task] * n, pa.int64()),
                    rep=pa.array(reps, pa.int64()),
                )
                if held > BUFFER_BYTES:
                    yield flush()
                    first, held = first + len(seen), 0
                    seen.clear()
        if seen:
            yield flush()

    return plain.mapInArrow(run, schema)


_KINDS = [
    pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.int32(), pa.binary(),
]


def terminals(batches: Iterator[pa.RecordBatch], carried: int | None = None) -> Iterator[Terminal]:
    """Stand-ins in the order (n_bytes, bucket, sha) or (bucket, n_bytes, sha) through their tries.

    ``carried`` is the place of the text in ``row``, if the stand-ins carry their input rows; a row that
    is kept is copied, as a slice would keep its whole batch.
    """
    trie, at = Trie(), None
    for batch in batches:
        lengths, buckets = batch.column("n_bytes").to_pylist(), batch.column("bucket").to_pylist()
        shas, ids, sizes = (batch.column(c).to_pylist() for c in ("sha", "id", "size"))
        if carried is None:
            texts, rows = batch.column("text"), None
            places = list(zip(batch.column("task").to_pylist(), batch.column("rep").to_pylist()))
        else:
            rows, places = batch.column("row"), [None] * len(shas)
            texts = rows.field(carried)
        for i, sha in enumerate(shas):
            if at != (lengths[i], buckets[i]):
                yield from trie.spill(None)
                trie, at = Trie(), (lengths[i], buckets[i])
            elif trie.bytes > TRIE_BYTES:
                yield from trie.spill(sha)
            if rows is None:
                trie.insert(texts[i].as_py(), sha).add(places[i], ids[i], sizes[i], None)
                continue
            found = trie.insert((texts[i].as_py() or "").encode().translate(LOWER), sha)
            better = not found.reps or rank(ids[i]) > rank(found.owner)
            found.add(None, ids[i], sizes[i], rows.take(pa.array([i])) if better else None)
    yield from trie.spill(None)


def _dealt(stand_ins: DataFrame) -> DataFrame:
    return stand_ins.repartition("n_bytes", "bucket").sortWithinPartitions(
        "n_bytes", "bucket", "sha"
    )


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256."""
    store = scratch_path(docs.sparkSession, "trie-rows")
    merged(docs, key, text).write.partitionBy("member").parquet(store)
    stored = docs.sparkSession.read.schema(
        "id long, sha binary, task long, rep long, size long, n_bytes long, bucket int,"
        " text binary, member boolean"
    ).parquet(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in chunks(terminals(batches), 4096):
            flat = [(*rep, t.owner, t.size) for t in found for rep in t.reps]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*flat)],
                names=["task", "rep", "keep_id", "group_size"],
            )

    owners = _dealt(stored.where(~F.col("member"))).mapInArrow(
        run, "task long, rep long, keep_id long, group_size long"
    )
    members = stored.where("member").select("id", "sha", "task", "rep")
    return members.join(owners, ["task", "rep"]).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def carried(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stand-ins that carry the input row of their largest id: copies merged inside each task.

    The text travels in the row only. Rows that are kept are copied out of their batch, and the buffer
    counts what the copies and their entries really take.
    """
    plain = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("sha", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            plain.schema["row"],
        ]
    )
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By digest: largest id, number of rows, bytes, and where the row is: copied part and place.
        seen: dict[bytes, list] = {}
        parts: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            entries, first = list(seen.values()), [0]
            for part in parts:
                first.append(first[-1] + len(part))
            kept = pa.concat_arrays(parts).take(pa.array([first[e[3]] + e[4] for e in entries]))
            columns = [
                pa.array([e[0] for e in entries], pa.int64()),
                pa.array(list(seen), pa.binary()),
                pa.array([e[1] for e in entries], pa.int64()),
                pa.array([e[2] for e in entries], pa.int64()),
                pa.array([int.from_bytes(k[:2], "big") for k in seen], pa.int32()),
                kept,
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            rows = batch.column("row")
            view = pa.RecordBatch.from_arrays([batch.column("id"), rows, rows.field(place)], names=["id", "row", "text"])
            for part in W.slices(view):
                data, off = W.raw(part.column("text"))
                lowered, off = data.tobytes().translate(LOWER), off.tolist()
                chosen: dict[int, list] = {}
                for i, one in enumerate(part.column("id").to_pylist()):
                    sha = hashlib.sha256(lowered[off[i] : off[i + 1]]).digest()
                    entry = seen.get(sha)
                    if entry is None:
                        seen[sha] = entry = [one, 0, off[i + 1] - off[i], len(parts), i]
                        held += ENTRY_BYTES
                        chosen[id(entry)] = entry
                    elif rank(one) > rank(entry[0]):
                        entry[0], entry[3], entry[4] = one, len(parts), i
                        chosen[id(entry)] = entry
                    entry[1] += 1
                if chosen:
                    parts.append(part.column("row").take(pa.array([e[4] for e in chosen.values()])))
                    held += parts[-1].nbytes
                    for k, entry in enumerate(chosen.values()):
                        entry[4] = k
                if held > ROW_BUFFER_BYTES:
                    yield flush()
                    seen.clear()
                    parts.clear()
                    held = 0
        if seen:
            yield flush()

    return plain.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that own their text, with all input columns; one exchange, no join."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for found in terminals(batches, place):
            rows.append(found.row)
            held += found.row.nbytes
            if held > OUTPUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows)], names=["row"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(rows)], names=["row"])

    stand_ins = carried(docs, key, text)
    schema = T.StructType([stand_ins.schema["row"]])
    # Sorted by the hash first, so that a batch holds texts of all lengths.
    dealt = stand_ins.repartition("n_bytes", "bucket").sortWithinPartitions("bucket", "n_bytes", "sha")
    return dealt.mapInArrow(run, schema).select("row.*")


def chunks(items: Iterator, size: int) -> Iterator[list]:
    while part := list(islice(items, size)):
        yield part
