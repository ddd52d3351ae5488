"""Synonyms learned from the corpus itself: word translations by expectation maximisation, pivoted.

Two target words are taken for synonyms if they translate the same source words. Translation
probabilities come from the aligned pairs without any word alignment: in each round a target word of a
pair is shared out over the source words of the pair by the present probabilities, and the shares, summed
over the corpus, are the next ones.

Word pairs are not stored or sent, as they are a hundred times the text. A target word's shares depend on
other target words only through the total of each source word. So target words are dealt to blocks, a block
gets the source words of the pairs it has a word of, once, and a round sends these totals alone. Expected
counts are made anew from the totals of the rounds before, in units that fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.functions import text
from paragauge.session import scratch_path
from paragauge.sources.delimited import numbered

ROUNDS = 5
#: Links below this probability are not pivoted over. As probabilities sum to 1, a word has at most
#: 1 / LEAST others on either side, so that frequent words do not multiply.
LEAST = 0.02
#: Word pairs of a block, and of a block if that leaves cores without one.
BLOCK_PAIRS, SMALL_BLOCK_PAIRS = 1 << 25, 1 << 20
#: Word pairs that are worked off at once.
UNIT_PAIRS = 1 << 19
#: Totals of source words travel in runs of so many.
RUN = 4096
#: Up to so many source words are told to every task to name the links; more are joined.
TOLD_WORDS = 1 << 20

_SUMS = "run int, sums binary"
_LINKS = "id int, e string, n double, p double, back double"


def _counted(pairs: DataFrame, side: str, word: str) -> DataFrame:
    """``(row_id, word, count)``; no exchange if ``pairs`` are dealt by ``row_id``."""
    words = pairs.select("row_id", F.explode(text.tokenize_words(F.col(side))).alias(word))
    return words.groupBy("row_id", word).agg(F.count("*").cast("int").alias(f"c{word}"))


def _n_blocks(pairs: DataFrame) -> int:
    """Blocks for the word pairs of the corpus; a few numbers per segment are summed."""
    words = [F.size(F.array_distinct(text.tokenize_words(F.col(c)))).cast("long") for c in ("source", "target")]
    n_pairs = pairs.agg(F.sum(F.greatest(words[0], F.lit(0)) * F.greatest(words[1], F.lit(0)))).first()[0] or 0
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return max(-(-n_pairs // BLOCK_PAIRS), min(cores, -(-n_pairs // SMALL_BLOCK_PAIRS)), 1)


def _vocabulary(words: DataFrame) -> DataFrame:
    """``(id, f)``: the different source words, numbered from 0. Only a count per task reaches the driver."""
    spark = words.sparkSession
    places = {"_part": F.lit(""), "_task": F.spark_partition_id().cast("long"), "_at": F.monotonically_increasing_id()}
    path = scratch_path(spark, "source-words")
    placed = words.select("f").distinct().withColumns(places)
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    return numbered(placed, "_part", "_task", "_at", "id").select(F.col("id").cast("int").alias("id"), "f")


def _blocks(dealt: DataFrame, vocabulary: DataFrame, n_blocks: int) -> DataFrame:
    """``(block, ids, cfs, es, ces)``: per segment and block the segment's source words and the target words
    of the block, with their counts. Stored in buckets, so that reading whole blocks needs no exchange."""
    spark = dealt.sparkSession
    sources = (
        _counted(dealt, "source", "f").join(vocabulary, "f")
        .groupBy("row_id").agg(F.collect_list(F.struct("id", "cf")).alias("_f"))
    )
    block = F.pmod(F.xxhash64("e"), F.lit(n_blocks)).cast("int")
    targets = (
        _counted(dealt, "target", "e").withColumn("block", block)
        .groupBy("row_id", "block").agg(F.collect_list(F.struct("e", "ce")).alias("_e"))
    )
    rows = targets.join(sources.hint("merge"), "row_id").select(
        "block", F.col("_f.id").alias("ids"), F.col("_f.cf").alias("cfs"),
        F.col("_e.e").alias("es"), F.col("_e.ce").alias("ces"),
    )
    name = f"word_blocks_{uuid4().hex}"
    (
        rows.repartition(n_blocks, "block")
        .write.option("path", scratch_path(spark, "word-blocks")).bucketBy(n_blocks, "block").saveAsTable(name)
    )
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the files stay, and with them what was read
    return stored


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of lists, and the places where the lists start, with the end."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), np.concatenate([[0], np.cumsum(lengths)])


def _within(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, as long as its length."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


class _Block:
    """Segments of a block: their source words, and postings of its target words, ordered by word."""

    def __init__(self, table: pa.Table):
        self.ids, at = _flat(table["ids"], np.int32)
        self.cfs, _ = _flat(table["cfs"], np.int32)
        self.starts, self.lengths = at[:-1], np.diff(at)
        ces, at = _flat(table["ces"], np.int32)
        words = table["es"].combine_chunks().flatten().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.words, self.code, self.ce = words.dictionary, code[order], ces[order]
        self.row = np.repeat(np.arange(len(self.starts)), np.diff(at))[order]

    def units(self) -> Iterator[tuple[int, int]]:
        """Postings of whole words, together at most UNIT_PAIRS word pairs, or of one word with more."""
        first = np.flatnonzero(np.diff(self.code, prepend=-1))
        ends = np.append(first[1:], len(self.code))
        upto = np.cumsum(self.lengths[self.row])[ends - 1]
        begin = done = word = 0
        while word < len(ends):
            last = max(int(np.searchsorted(upto, done + UNIT_PAIRS, "right")), word + 1)
            yield begin, int(ends[last - 1])
            begin, done, word = int(ends[last - 1]), int(upto[last - 1]), last

    def pairs(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Source word and its count for all word pairs of postings, and where each posting's are."""
        row = self.row[begin:end]
        lengths = self.lengths[row]
        at = _within(self.starts[row], lengths)
        return self.ids[at], self.cfs[at].astype(np.float64), np.cumsum(lengths) - lengths, lengths


def _shares(cf, ce, p, starts, lengths) -> np.ndarray:
    """Each target word, shared out over the source words of its segment."""
    weights = cf if p is None else cf * p
    total = np.repeat(np.add.reduceat(weights, starts), lengths)
    return np.repeat(ce, lengths) * cf / total if p is None else np.repeat(ce, lengths) * cf * p / total


class _Unit:
    """Links ``(word, id)`` of the target words of a unit, with their expected counts."""

    def __init__(self, block: _Block, begin: int, end: int, n_ids: int):
        self.block, self.begin, self.end = block, begin, end
        codes = block.code[begin:end]
        self.parts = None
        self.single = block.lengths[block.row[begin:end]].sum() > UNIT_PAIRS
        if self.single:  # one word, however frequent: a place per source word, part by part
            self.id, self.word = np.arange(n_ids), np.full(n_ids, codes[0])
        else:
            ids, cf, starts, lengths = block.pairs(begin, end)
            key = np.repeat(codes.astype(np.int64) - codes[0], lengths) * n_ids + ids
            order = np.argsort(key)
            key = key[order]
            new = np.diff(key, prepend=-1) != 0
            link = np.empty(len(key), np.int64)
            link[order] = np.cumsum(new) - 1
            self.id, self.word = key[new] % n_ids, key[new] // n_ids + codes[0]
            self.parts = [(link, cf, block.ce[begin:end], starts, lengths)]

    def _parts(self) -> Iterator[tuple]:
        if self.parts is not None:
            yield from self.parts
            return
        block = self.block
        ends = np.cumsum(block.lengths[block.row[self.begin : self.end]])
        place = 0
        while place < len(ends):
            done = ends[place - 1] if place else 0
            upto = max(int(np.searchsorted(ends, done + UNIT_PAIRS, "right")), place + 1)
            a, b = self.begin + place, self.begin + upto
            ids, cf, starts, lengths = block.pairs(a, b)
            yield ids, cf, block.ce[a:b], starts, lengths
            place = upto

    def counts(self, totals: list[np.ndarray]) -> np.ndarray:
        """Expected counts after one round more than there are ``totals`` of source words."""
        n = None
        for total in [None, *totals]:
            p = None if total is None else np.divide(n, total[self.id], out=np.zeros(len(n)), where=n > 0)
            n = np.zeros(len(self.id))
            for link, cf, ce, starts, lengths in self._parts():
                n += np.bincount(link, _shares(cf, ce, None if p is None else p[link], starts, lengths), len(n))
        return n

    def present(self) -> np.ndarray:
        """Which links there are: for a single word, the source words of its segments."""
        if not self.single:
            return np.arange(len(self.id))
        seen = np.zeros(len(self.id), bool)
        for ids, *_ in self._parts():
            seen[ids] = True
        return np.flatnonzero(seen)


def _sums(totals, n_ids: int) -> Callable[[pa.Table], pa.Table]:
    """Sums over a block of the expected counts of each source word."""

    def run(table: pa.Table) -> pa.Table:
        block, sums = _Block(table), np.zeros(n_ids)
        for begin, end in block.units():
            unit = _Unit(block, begin, end, n_ids)
            n = unit.counts(totals.value)
            sums += n if unit.single else np.bincount(unit.id, n, n_ids)
        runs = range(0, n_ids, RUN)
        return pa.table(
            {
                "run": pa.array(range(len(runs)), pa.int32()),
                "sums": pa.array([sums[i : i + RUN].tobytes() for i in runs], pa.binary()),
            }
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    whole = sum(np.frombuffer(sums) for sums in table["sums"].to_pylist())
    return pa.table({"run": table["run"][:1], "sums": pa.array([whole.tobytes()], pa.binary())})


def _links(totals, n_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The links of a block, unit by unit, after the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(pa.Table.from_batches(batches))
        for begin, end in block.units():
            unit = _Unit(block, begin, end, n_ids)
            n, there = unit.counts(totals.value[:-1]), unit.present()
            n, ids, words = n[there], unit.id[there], unit.word[there]
            of_word = np.bincount(words - words[0], n)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array(ids, pa.int32()),
                    "e": block.words.take(pa.array(words)),
                    "n": n,
                    "p": n / totals.value[-1][ids],
                    "back": n / of_word[words - words[0]],
                }
            )

    return run


def _learned(pairs: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Links ``(id, e, n, p, back)`` with p of e given the source word and back of the source word given e,
    and the source words ``(id, f)``, with a hint for a join of the two: links are far more than planned for.

    A round's totals, a number per different source word, are added up by Spark and told to all tasks.
    """
    spark = pairs.sparkSession
    dealt = pairs.where("row_id IS NOT NULL").select("row_id", "source", "target")
    n_blocks, dealt = _n_blocks(dealt), dealt.repartition("row_id")
    vocabulary = _vocabulary(_counted(dealt, "source", "f"))
    n_ids = max(vocabulary.count(), 1)
    blocks = _blocks(dealt, vocabulary, n_blocks).groupBy("block")
    totals = []
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(totals)
        sums = blocks.applyInArrow(_sums(told, n_ids), _SUMS).groupBy("run").applyInArrow(_added, _SUMS)
        rows = sorted(sums.collect())
        totals = [*totals, np.concatenate([np.zeros(0), *(np.frombuffer(r.sums) for r in rows)])]
        told.unpersist()
    links = blocks.applyInArrow(_links(spark.sparkContext.broadcast(totals), n_ids), _LINKS)
    return links, vocabulary.hint("broadcast" if n_ids <= TOLD_WORDS else "merge")


def translations(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(f, e, n, p)``: expected count of source word f with target word e, and probability of e given f.

    The work within a segment is the number of different words of its source times those of its target,
    so pairs should be segments, not whole documents.
    """
    links, vocabulary = _learned(pairs, rounds)
    return links.join(vocabulary, "id").select("f", "e", "n", "p")


def _pivot(links: DataFrame, f: str, least: float) -> DataFrame:
    back = links.where(F.col("back") >= least).select(f, F.col("e").alias("word"), "back")
    forth = links.where(F.col("p") >= least).select(f, F.col("e").alias("alt"), "p")
    pivots = back.join(forth.hint("merge"), f).where("word <> alt")
    return pivots.groupBy("word", "alt").agg(F.sum(F.col("back") * F.col("p")).alias("p"))


def pivoted(table: DataFrame, least: float = LEAST) -> DataFrame:
    """``(word, alt, p)``: how probably a source word that stands behind ``word`` is said as ``alt``."""
    total = table.groupBy("e").agg(F.sum("n").alias("total"))
    return _pivot(table.join(total, "e").withColumn("back", F.col("n") / F.col("total")), "f", least)


def learned_synonyms(pairs: DataFrame, rounds: int = ROUNDS, least: float = LEAST, keep: float = LEAST) -> DataFrame:
    """``(word, alt, p)`` with p of ``keep`` or more: a synonym table for METEOR."""
    links, _ = _learned(pairs, rounds)
    return _pivot(links, "id", least).where(F.col("p") >= keep)
