"""Collocations: phrases of two and three words counted in HAT-tries.

A text is cut into pieces at sentence marks and line ends, and pieces into words. Words occurring at
least ``least`` times in their language get a number (no phrase with a rarer word can occur as often),
and a phrase becomes the sequence of its numbers.

A task counts the phrases of a block of texts in a HAT-trie: a shallow trie over word numbers whose
leaves are hash containers, each for the phrases between two prefixes. A container that grows too
large bursts: it is cut between two first words, or, once it holds one first word only, between two
second words. When all containers together are full, the largest subtrees are spilled whole, as
runs in the order of the phrases. Runs are dealt by the prefix of two words, so that no partition
holds all phrases of a frequent word, and a partition merges its runs and adds the counts up.

Scores are joins of the counted phrases with the counts of their parts. They are exact: products are
decimals of 38 digits (counts up to 10**15).

Defined cases: a null text has no words; a null language is ``und``, one with texts that say so; only
A-Z are lower-cased; white space other than blank, tab and line ends belongs to words; ties are
ordered by phrase; repeated rows are counted as often as they occur; an empty table, and one where
nothing is frequent, give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragauge.llm import words as W
from paragauge.session import scratch_path

LEAST, TOP = 10, 2000
#: A longer phrase with this share (in per cent) of a shorter one's occurrences replaces it.
REPLACES = 50
BLOCK_BYTES = 6 << 20
#: Phrases per container, and in all containers of a task (about 110 bytes each).
CONTAINER, HELD = 1 << 14, 250_000
#: Words of text per merging partition: their phrases, packed, are some 10 MB.
RANGE_WORDS = 1 << 20
NUMBERED = 4096  # hash classes in which words are numbered
SALTS = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2

_READ = "kind string, block long, stream binary, lang string, word string, local int, n long"
_RUN = "bucket int, phrases binary, counts binary"
_COUNTED = "w1 long, w2 long, w3 long, a long"


# Texts to numbers ----------------------------------------------------------------------------------


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word, and whether it follows the word before in one piece."""
    kind = _KIND[data]
    inside = kind == 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = inside[edge]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    breaks = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.empty(0, np.int32)
    follows = np.zeros(len(start), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
    return start, end, doc, follows


def _block(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, numbered: the stream (0 between pieces), and per number its word, language
    (by place in the batch's dictionary) and count."""
    data, off = W.raw(part.column("text"))
    start, end, doc, follows = spans(data, off)
    body = W.LOWER[data[_KIND[data] == 0]]
    ends = np.concatenate([[0], np.cumsum(end - start)])
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]
    ).dictionary_encode()
    langs = part.column("lang").dictionary_encode().indices.to_numpy()
    size = max(len(found.dictionary), 1)
    key = langs[doc].astype(np.int64) * size + found.indices.to_numpy()
    kinds, number, counts = np.unique(key, return_inverse=True, return_counts=True)
    stream = np.zeros(len(start) + int((~follows).sum()), np.uint32)
    stream[np.arange(len(start)) + np.cumsum(~follows) - 1] = number + 1
    words = found.dictionary.take(pa.array(kinds % size)).cast(pa.large_string())
    return stream, words, kinds // size, counts, part.column("lang").dictionary_encode().dictionary


def _read(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Per block one row with the stream of its words, and one row per word."""
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def batch(**have) -> pa.RecordBatch:
        size = len(have["block"])
        return pa.RecordBatch.from_arrays(
            [have[c].cast(k) if c in have else pa.nulls(size, k) for c, k in zip(names, kinds)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part in W.slices(whole, size=BLOCK_BYTES):
                stream, words, langs, counts, known = _block(part)
                n = len(words)
                if not n:
                    continue
                packed = pa.array([W.pack(stream)], pa.binary())
                yield batch(kind=pa.array(["text"]), block=pa.array([block]), stream=packed)
                yield batch(
                    kind=pa.array(["word"]).take(pa.array(np.zeros(n, np.int64))), block=pa.array(np.full(n, block)),
                    lang=known.take(pa.array(langs)), word=words, local=pa.array(np.arange(n)), n=pa.array(counts),
                )
                block += 1

    plain = docs.select(
        F.col(f"`{text}`").cast("string").alias("text"),
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
    )
    return plain.where("text IS NOT NULL").mapInArrow(run, _READ)


# Counting ------------------------------------------------------------------------------------------


class HatTrie:
    """Counts of phrases of two or three numbers below ``base``; a phrase of two ends in 0.

    A phrase is held as one whole number with its words as digits, so the phrases below a prefix are
    those between two numbers. ``lows`` are the lower ends of the containers, in order.
    """

    def __init__(self, base: int, container: int = CONTAINER, held: int = HELD):
        self.base, self.container, self.most = base, container, held
        self.lows: list[int] = [0]
        self.leaves: list[Counter] = [Counter()]
        self.held = 0

    def insert(self, phrases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count the phrases; runs that have to be spilled meanwhile."""
        phrases = np.sort(phrases)
        cuts = [*np.searchsorted(phrases, np.array(self.lows, phrases.dtype)).tolist(), len(phrases)]
        grown = []
        for k, leaf in enumerate(self.leaves):
            if cuts[k + 1] > cuts[k]:
                before = len(leaf)
                leaf.update(phrases[cuts[k] : cuts[k + 1]].tolist())
                self.held += len(leaf) - before
                if len(leaf) > self.container:
                    grown.append(k)
        for k in reversed(grown):
            self.burst(k)
        if self.held > self.most:
            yield self.spill(self.held - self.most // 2)

    def _cut(self, phrase: int, low: int, high: int | None) -> int | None:
        """A prefix near ``phrase`` at which the numbers from ``low`` to ``high`` can be cut in two:
        the beginning of a first word, else of a second word."""
        for size in (self.base * self.base, self.base):
            here = phrase // size * size
            if here > low:
                return here
            if high is None or here + size < high:
                return here + size
        return None

    def burst(self, k: int) -> None:
        """Cut a container at prefixes until its parts are small or hold one prefix only."""
        waiting = [(self.lows[k], self.lows[k + 1] if k + 1 < len(self.lows) else None, self.leaves[k])]
        done = []
        while waiting:
            low, high, leaf = waiting.pop()
            middle = sorted(leaf)[len(leaf) // 2] if len(leaf) > self.container else 0
            at = self._cut(middle, low, high) if len(leaf) > self.container else None
            if at is None:
                done.append((low, leaf))
                continue
            upper = Counter({p: c for p, c in leaf.items() if p >= at})
            lower = Counter({p: c for p, c in leaf.items() if p < at})
            if upper and lower:
                waiting += [(low, at, lower), (at, high, upper)]
            else:  # nothing on one side: the cut is kept, so that the next one falls elsewhere
                done.append((low, lower) if upper else (at, upper))
                waiting.append((at, high, upper) if upper else (low, at, lower))
        done.sort(key=lambda x: x[0])
        self.lows[k : k + 1] = [low for low, _ in done]
        self.leaves[k : k + 1] = [leaf for _, leaf in done]

    def spill(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest subtrees, ``least`` phrases or more together, as one run in order; freed."""
        chosen, freed = [], 0
        for k in sorted(range(len(self.leaves)), key=lambda k: -len(self.leaves[k])):
            if freed >= least:
                break
            chosen.append(k)
            freed += len(self.leaves[k])
        kind = np.int64 if self.base**3 < 1 << 63 else object
        phrases = [np.empty(0, kind)]
        counts = [np.empty(0, np.int64)]
        for k in sorted(chosen):
            leaf = self.leaves[k]
            found = np.fromiter(leaf.keys(), kind, len(leaf))
            order = np.argsort(found, kind="stable")
            phrases.append(found[order])
            counts.append(np.fromiter(leaf.values(), np.int64, len(leaf))[order])
            leaf.clear()
        self.held -= freed
        return np.concatenate(phrases), np.concatenate(counts)


def phrases(stream: np.ndarray, base: int) -> Iterator[np.ndarray]:
    """Phrases of a stream of numbers (0 between pieces and for rare words), slice by slice."""
    kind = np.int64 if base**3 < 1 << 63 else object
    for first in range(0, len(stream), 1 << 18):
        ids = stream[first : first + (1 << 18) + 2].astype(kind)
        own = min(1 << 18, len(stream) - first)
        two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        two = two[two < own]
        start = ids[two] * base + ids[two + 1]
        third = np.append(ids, np.zeros(1, kind))[two + 2]
        yield start * base
        yield (start * base + third)[third > 0]


def pack_phrases(found: np.ndarray, base: int) -> bytes:
    """Rising phrases; those that need more than 64 bits as their three numbers."""
    if found.dtype != object:
        return W.pack(np.diff(found.astype(np.uint64), prepend=np.uint64(0)))
    parts = [found // (base * base), found // base % base, found % base]
    return b"".join(len(b).to_bytes(8, "little") + b for b in (W.pack(p.astype(np.uint64)) for p in parts))


def unpack_phrases(blob: bytes, base: int) -> np.ndarray:
    if base**3 < 1 << 63:
        return np.cumsum(W.unpack(blob), dtype=np.uint64).astype(np.int64)
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 8], "little")
        parts.append(W.unpack(blob[at + 8 : at + 8 + size]).astype(object))
        at += 8 + size
    return (parts[0] * base + parts[1]) * base + parts[2]


def dealt(found: np.ndarray, counts: np.ndarray, base: int, buckets: int) -> Iterator[dict]:
    """A run cut by the hash of its prefixes of two words; each part keeps the order."""
    prefix = (found // base % (1 << 62)).astype(np.uint64)
    bucket = (W.mix(prefix) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    new = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(new.tolist(), [*new[1:].tolist(), len(bucket)]):
        mine = order[i:j]
        yield {
            "bucket": int(bucket[i]),
            "phrases": pack_phrases(found[mine], base),
            "counts": W.pack(counts[mine].astype(np.uint32 if counts[mine].max() < 1 << 32 else np.uint64)),
        }


def merge(runs: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of sorted runs with their counts added up, if they reach ``least``."""
    found, counts = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(found, kind="stable")  # a merge sort: it goes along the runs
    found, counts = found[order], counts[order]
    new = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else []
    total = np.add.reduceat(counts, new) if len(new) else counts
    often = total >= least
    return found[new][often], total[often]


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[c] for r in rows], kinds[k]) for c, k in fields], names=[c for c, _ in fields])


def _runs(texts: DataFrame, numbers: DataFrame, base: int, buckets: int) -> DataFrame:
    """Runs of all blocks; ``numbers`` has the words of a block that have a number."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        local = right.column("local").to_numpy()
        for blob in left.column("stream").to_pylist():
            stream = W.unpack(blob)
            known = np.zeros(int(max(stream.max(initial=0), local.max(initial=0) + 1)) + 1, np.int64)
            known[local + 1] = right.column("id").to_numpy()
            trie = HatTrie(base)
            for part in phrases(known[stream], base):
                for spilled in trie.insert(part):
                    out += dealt(*spilled, base, buckets)
            rest = trie.spill(trie.held)
            out += dealt(*rest, base, buckets)
        return _table(_RUN, out)

    return texts.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(run, _RUN)


def _counted(runs: DataFrame, base: int, least: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        parts = [
            (unpack_phrases(p, base), W.unpack(c).astype(np.int64))
            for p, c in zip(group.column("phrases").to_pylist(), group.column("counts").to_pylist())
        ]
        found, total = merge(parts, least)
        columns = [found // base // base, found // base % base, found % base, total]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["w1", "w2", "w3", "a"])

    return runs.groupBy("bucket").applyInArrow(run, _COUNTED)


def counted(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, f), frequent phrases (w1, w2, w3, a; w3 is 0 for two words) and
    all word occurrences per language (lang, n), as stored tables."""
    spark = docs.sparkSession
    path = scratch_path(spark, "collocation-blocks")
    _read(docs, text, lang).write.partitionBy("kind").parquet(path)

    def stored() -> DataFrame:
        return spark.read.schema(_READ.removeprefix("kind string, ") + ", kind string").parquet(path)

    words = stored().where("kind = 'word'").select("block", "lang", "word", "local", "n")
    sums = words.groupBy("lang", "word").agg(F.sum("n").alias("f"))

    place = F.row_number().over(Window.partitionBy("class").orderBy("lang", "word")) - 1
    classes = F.pmod(F.xxhash64("lang", "word"), F.lit(NUMBERED))
    numbered = sums.where(F.col("f") >= least).withColumn("class", classes)
    words_at = scratch_path(spark, "collocation-words")
    numbered.select(
        (place.cast("long") * NUMBERED + F.col("class") + 1).alias("id"), "lang", "word", "f"
    ).write.parquet(words_at)
    frequent = spark.read.schema("id long, lang string, word string, f long").parquet(words_at)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    size = words.agg(F.sum("n")).first()[0] or 0
    base = (frequent.agg(F.max("id")).first()[0] or 0) + 1
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_WORDS)
    numbers = words.join(frequent, ["lang", "word"]).select("block", "local", "id")
    texts = stored().where("kind = 'text'").select("block", "stream")
    phrases_at = scratch_path(spark, "collocation-phrases")
    _counted(_runs(texts, numbers, base, buckets), base, least).write.parquet(phrases_at)
    return frequent, spark.read.schema(_COUNTED).parquet(phrases_at), totals


# Scores --------------------------------------------------------------------------------------------


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def _first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, with their rank; in shares first, so that no task
    sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    some = salted.withColumn("place", place).where(F.col("place") <= top).drop("place", "share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    words, found, totals = counted(docs, text, lang, least)

    def word(k: int) -> DataFrame:
        return words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), "lang")

    two = found.where("w3 = 0").drop("w3")
    three = found.where("w3 > 0")
    longer = three.select(F.inline(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))))
    longer = longer.groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    pairs = (
        two.join(longer, ["w1", "w2"], "left")
        .where(F.coalesce(100 * F.col("longest") < REPLACES * F.col("a"), F.lit(True)))
        .join(word(1), "w1")
        .join(word(2).drop("lang"), "w2")
        .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    )
    early = two.select("w1", "w2", F.col("a").alias("f12"))
    late = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    first_cut, second_cut = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    triples = (
        three.join(early, ["w1", "w2"])
        .join(late, ["w2", "w3"])
        .join(word(1), "w1")
        .join(word(2).drop("lang"), "w2")
        .join(word(3).drop("lang"), "w3")
        .withColumns({"s1": first_cut, "s2": second_cut})
        .withColumn("second", F.col("s2") < F.col("s1"))
        .select(
            "lang",
            F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"),
            "a",
            F.when(F.col("second"), F.col("f12")).otherwise(F.col("f1")).alias("l"),
            F.when(F.col("second"), F.col("f3")).otherwise(F.col("f23")).alias("r"),
            F.least("s1", "s2").alias("score"),
        )
    )
    best = _first_of_each(pairs.unionByName(triples), top)
    # One row per language; a table of languages is not bounded, so Spark picks the join.
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
