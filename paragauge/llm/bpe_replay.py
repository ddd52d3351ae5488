"""Byte-level BPE by replaying merges over all different words of a batch at once.

Texts are cut by the tokenizer's pattern. The different pieces that are no token themselves are laid
out as chains of byte symbols. An inverted index holds, for each rank, the places where that merge
applies; ranks are taken in ascending order, all places of a rank are merged, and only the pairs
that touch a merged place are looked up again. A task keeps the pieces it has met lately, at most
twice CACHE of them, so a frequent word is merged once per task; a worker keeps nothing but the
vocabulary when its task ends.

Defined cases: null is empty text; an empty text has no tokens; an empty table gives an empty
result; repeated rows are encoded alike; other columns of the input are not touched. Texts are
encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.llm import words as W

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHE = 130_000
#: Pieces whose merges are replayed together; bounds the memory of the index.
GROUP = 4_000


class Vocabulary:
    """Ranks of a tokenizer and, for every pair of tokens that can merge, the merged rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.letter = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.merge = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pairs = np.append(keys, np.iinfo(np.int64).max)
        self.merged = np.array([pairs[k] for k in keys.tolist()] + [-1], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 if there is none."""
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], -1)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    """The vocabulary file ``name`` of the public tokenizers, or a path."""
    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs})


def replay(pieces: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """Token ids of each piece (none of them empty)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, size, merge = len(data), vocab.size, vocab.merge.get
    ends = np.cumsum([len(p) for p in pieces])
    symbols = vocab.letter[data]
    after = np.arange(1, n + 1)
    after[ends - 1] = -1  # nothing follows within the piece
    before = np.arange(-1, n - 1)
    before[np.concatenate([[0], ends[:-1]])] = -1
    ranks = np.full(n, -1, np.int64)  # of the pair that starts here
    at = np.flatnonzero(after >= 0)
    ranks[at] = vocab.rank(symbols[at], symbols[at + 1])

    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    found = ranks[at]
    cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
    starts = np.concatenate([[0], cuts]) if len(at) else cuts
    index = {
        rank: places.tolist() for rank, places in zip(found[starts].tolist(), np.split(at, cuts))
    }
    heap = sorted(index)

    symbol, after, before, current = (x.tolist() for x in (symbols, after, before, ranks))
    while heap:
        rank = heapq.heappop(heap)
        for here in sorted(index.pop(rank)):
            if current[here] != rank:  # merged away, or part of another pair by now
                continue
            gone = after[here]
            follow = after[here] = after[gone]
            symbol[here], symbol[gone], current[gone], current[here] = rank, -1, -1, -1
            touched = []
            if follow >= 0:
                before[follow] = here
                touched.append((here, rank * size + symbol[follow]))
            if before[here] >= 0:
                touched.append((before[here], symbol[before[here]] * size + rank))
            for place, pair in touched:
                new = current[place] = merge(pair, -1)
                if new >= 0:
                    if new not in index:
                        index[new] = []
                        heapq.heappush(heap, new)
                    index[new].append(place)

    kept = np.array(symbol, np.int64)
    alive = kept >= 0
    ids = kept[alive].tolist()
    counts = np.add.reduceat(alive, np.concatenate([[0], ends[:-1]]), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


class Encoder:
    """Pieces with the number of their ids, and the decimals of those joined by commas."""

    def __init__(self, name: str):
        self.vocab = vocabulary(name)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, tuple[int, str]] = {}
        self.older: dict[str, tuple[int, str]] = {}
        self.token = {str(i): token for i, token in enumerate(self.vocab.bytes)}

    def learn(self, pieces: set[str]) -> None:
        """Afterwards ``known`` has all of ``pieces``; the pieces of some calls ago may be gone."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, rare = self.known, []
        for piece in pieces:
            if piece in known:
                continue
            if piece in self.older:
                known[piece] = self.older[piece]
                continue
            rank = self.vocab.ranks.get(piece.encode())
            if rank is None:
                rare.append(piece)
            else:
                known[piece] = (1, str(rank))
        for group in range(0, len(rare), GROUP):
            some = rare[group : group + GROUP]
            for piece, ids in zip(some, replay([p.encode() for p in some], self.vocab)):
                known[piece] = (len(ids), ",".join(map(str, ids)))

    def decode(self, numbers: str) -> bytes:
        """The bytes of comma-joined ids."""
        return b"".join(map(self.token.__getitem__, numbers.split(","))) if numbers else b""


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS,
           ids: bool = True) -> DataFrame:
    """One row per input row: ``key``, n_tokens, ids (decimals joined by commas), decoded bytes.

    ``ids=False`` leaves out the two long columns and keeps their digests only.
    """
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", ids string, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(ranks)
        cut = own.pattern.findall
        for batch in batches:
            for part in W.slices(batch):
                cuts = [cut(t or "") for t in part.column("text").to_pylist()]
                own.learn(set().union(*cuts))
                known = own.known
                out: list[list] = [[], [], [], [], []]
                for pieces in cuts:
                    found = [known[p] for p in pieces]
                    numbers = ",".join([f[1] for f in found])
                    decoded = own.decode(numbers)
                    out[0].append(sum([f[0] for f in found]))
                    out[1].append(hashlib.sha256(numbers.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded).hexdigest())
                    if ids:
                        out[3].append(numbers)
                        out[4].append(decoded)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                made = [pa.array(v, k) for v, k in zip(out, kinds)][: 5 if ids else 3]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *made],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][
                        : 1 + len(made)
                    ],
                )

    return plain.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(ids: str, ranks: str = RANKS) -> bytes:
    """The bytes of comma-joined ids."""
    return encoder(ranks).decode(ids)
