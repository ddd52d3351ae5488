"""Language model: a hierarchical Pitman-Yor process over words, seated as Chinese restaurants.

Every word has a context restaurant for what comes after it, and the start of a text has one; they
all share one parent, the restaurant of single words, whose base is even over the known words and
one unknown. A customer who opens a table in a context restaurant sends a customer to the parent. A
Gibbs sweep takes the customers of one dish out of a restaurant and seats them again one after the
other by the predictive rule (customer by customer up to the 32nd, then in parties of a sixteenth of
those seated, ``PARTY`` at most, all of whom see the tables as the party arrives); the parent's chance of
the dish is taken without the tables that the dish has there from this restaurant. Predictive
probabilities are averaged over the sweeps after ``BURN_IN`` and give each text its log10 probability, and groups of texts their perplexity.

How it runs: a task numbers the words of a block of texts, which is stored, and sends each hash range
of words one message with its (word, context) pairs and training counts; a pair is sent once per
block however frequent it is. A range holds its words with all their contexts, those too that are
only asked for, so seating needs nothing from other ranges but the number of tables per context.
Ranges of contexts sum these up after each sweep: every range of words sends each of them one row
with the contexts it has there, and gets the sums of just these back. So no task and no broadcast
holds all contexts or words. Random numbers belong to a word and a context, so a lost task gives the same
result again, and so does any number of ranges, which follows from the volume of the tokens.
Each range answers every block with one probability per pair, and the block adds them up per text.

Words and contexts are told apart by a hash of 64 bits.

Defined cases: letters A-Z count as lower case; a null or empty text is one token, its end; a null id
is neither held out nor learnt from; without training texts every token has probability 1 (V is 0);
repeated rows are learnt from as often as they occur; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.llm import words as W
from paragauge.session import scratch_path

#: The context of a text's first token: the largest number, so that it comes last in every order.
START = np.uint64((1 << 64) - 1)
BLOCK_BYTES = 12 << 20
SWEEPS, BURN_IN = 4, 2
#: Most customers that are seated at once.
PARTY = 256
#: Packed token streams per range of words, at most.
RANGE_BYTES = 8 << 20
#: Discount and strength of the context restaurants and of their parent.
CONTEXT_RULE, PARENT_RULE = (0.75, 20.0), (0.6, 20.0)
SEED = 17
FOLDS, OUT = 7, 2
END = np.uint64(0x9AE16A3B2F90404F)
_U = np.uint64


@dataclass
class Totals:
    """What restaurants know of the other hash ranges after a sweep."""

    tables: np.ndarray  # per context of the range
    customers: int  # of the parent
    parent_tables: int


# Texts to messages -----------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, ends included, and the number of tokens per text."""
    data, off = W.raw(texts)
    span = W.words(data, off, lower=True)
    sizes = np.bincount(span.doc, minlength=len(off) - 1) + 1
    token = np.full(int(sizes.sum()), END, np.uint64)
    token[np.arange(len(span.doc)) + span.doc] = span.hash
    return token, sizes


def pairs_of(stream: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context of the different pairs of a block, in order, and the pair of every token.

    A context is the number of the word before, or ``words`` at the start of a text.
    """
    before = np.empty(len(stream), np.int64)
    before[1:] = stream[:-1]
    before[np.cumsum(sizes) - sizes] = words
    pairs, pair = np.unique(stream * np.int64(words + 1) + before, return_inverse=True)
    return pairs // (words + 1), pairs % (words + 1), pair


def _limits(ranges: int) -> np.ndarray:
    return np.arange(1, ranges, dtype=np.uint64) * _U((1 << 64) // max(ranges, 2))


def _ends(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Where the hash ranges begin and end in sorted hashes."""
    return np.concatenate([[0], np.searchsorted(hashes, _limits(ranges)), [len(hashes)]])


def _steps(rising: np.ndarray) -> bytes:
    """Rising numbers, packed as differences."""
    return W.pack(np.diff(rising.astype(np.uint64), prepend=_U(0)))


def _rising(blob: bytes) -> np.ndarray:
    return np.cumsum(W.unpack(blob), dtype=np.uint64)


_BLOCK = (
    "block long, ids array<long>, held array<boolean>, train array<boolean>, sizes binary,"
    " words binary, stream binary"
)
_MESSAGE = "block long, bucket int, words binary, per binary, names binary, contexts binary, counts binary"
_STATE = (
    "bucket int, words binary, contexts binary, n_contexts int, pairs binary, counts binary,"
    " blocks array<long>, asked array<binary>, asked_words array<binary>"
)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def encoded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of texts as hashes of words and streams of word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in W.slices(batch, size=BLOCK_BYTES):
                pieces = [tokens(p.column("text")) for p in W.slices(part)]
                token, sizes = (np.concatenate(x) for x in zip(*pieces))
                pieces.clear()
                words, stream = np.unique(token, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number]),
                        pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                        *[pa.array([part.column(c).to_pylist()], pa.list_(pa.bool_())) for c in ("held", "train")],
                        pa.array([W.pack(sizes)], pa.binary()),
                        pa.array([_steps(words)], pa.binary()),
                        pa.array([W.pack(stream.astype(np.uint32))], pa.binary()),
                    ],
                    names=_columns(_BLOCK),
                )
                number += 1

    fold = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS
    plain = docs.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(fold != OUT, F.lit(False)).alias("train"),
        F.coalesce(fold == OUT, F.lit(False)).alias("held"),
    )
    return plain.mapInArrow(run, _BLOCK)


def messages(blocks: DataFrame, buckets: int) -> DataFrame:
    """One row per block and bucket: its words, their contexts (places in ``names``) and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("block", "train", "sizes", "words", "stream")}
                words, stream, sizes = _rising(row["words"]), W.unpack(row["stream"]), W.unpack(row["sizes"])
                owner, context, pair = pairs_of(stream, sizes, len(words))
                train = np.repeat(np.array(row["train"], bool), sizes)
                counts = np.bincount(pair[train], minlength=len(owner)).astype(np.uint32)
                per = np.bincount(owner, minlength=len(words)).astype(np.uint32)
                hashes = np.append(words, START)
                ends = _ends(words, buckets)
                at = np.searchsorted(owner, ends)
                used = [np.unique(context[a:b], return_inverse=True) for a, b in zip(at, at[1:])]
                columns = [
                    [_steps(words[a:b]) for a, b in zip(ends, ends[1:])],
                    [W.pack(per[a:b]) for a, b in zip(ends, ends[1:])],
                    [_steps(hashes[u]) for u, _ in used],
                    [W.pack(place.astype(np.uint32)) for _, place in used],
                    [W.pack(counts[a:b]) for a, b in zip(at, at[1:])],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * buckets), pa.array(range(buckets), pa.int32())]
                    + [pa.array(c, pa.binary()) for c in columns],
                    names=_columns(_MESSAGE),
                )

    return blocks.select("block", "train", "sizes", "words", "stream").mapInArrow(run, _MESSAGE)


# Restaurants -----------------------------------------------------------------------------------


def merged(sent: DataFrame) -> DataFrame:
    """Per bucket its words and contexts, sorted, the pairs with counts, and for each block which
    pairs and words it asks for."""

    def run(table: pa.Table) -> pa.Table:
        each = {c: [W.unpack(x.as_py()) for x in table[c]] for c in ("per", "contexts", "counts")}
        each |= {c: [_rising(x.as_py()) for x in table[c]] for c in ("words", "names")}
        words, word = np.unique(np.concatenate(each["words"]), return_inverse=True)
        contexts, name = np.unique(np.concatenate(each["names"]), return_inverse=True)
        cut = [np.cumsum([len(x) for x in each[c]])[:-1] for c in ("words", "names")]
        asked_words, name = np.split(word, cut[0]), np.split(name, cut[1])
        keys = [
            np.repeat(w, per) * max(len(contexts), 1) + n[c]
            for w, per, n, c in zip(asked_words, each["per"], name, each["contexts"])
        ]
        pairs, pair = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(pair, np.concatenate(each["counts"]), minlength=len(pairs)).astype(np.int64)
        asked = np.split(pair, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table(
            {
                "bucket": table["bucket"].slice(0, 1),
                "words": pa.array([_steps(words)], pa.binary()),
                "contexts": pa.array([_steps(contexts)], pa.binary()),
                "n_contexts": pa.array([len(contexts)], pa.int32()),
                "pairs": pa.array([_steps(pairs)], pa.binary()),
                "counts": pa.array([W.pack(counts)], pa.binary()),
                "blocks": pa.array([table["block"].to_pylist()], pa.list_(pa.int64())),
                "asked": pa.array([[_steps(a) for a in asked]], pa.list_(pa.binary())),
                "asked_words": pa.array([[_steps(a) for a in asked_words]], pa.list_(pa.binary())),
            }
        )

    return sent.groupBy("bucket").applyInArrow(run, _STATE)


def uniform(seeds: np.ndarray, number: int) -> np.ndarray:
    """The random numbers of a draw, one per seed: they depend on nothing else, least of all on how
    the dishes are dealt to tasks."""
    return (W.mix(seeds + W.mix(np.array([number], np.uint64))) >> _U(11)) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The smallest k at which the distribution function of n draws with chance p reaches u."""
    k = np.zeros(len(n), np.int64)
    p = np.minimum(p, 1.0 - 1e-12)
    weight = (1 - p) ** n
    reached = weight.copy()
    open_ = np.flatnonzero((reached < u) & (k < n))
    while len(open_):
        k[open_] += 1
        weight[open_] *= (n[open_] - k[open_] + 1) / k[open_] * p[open_] / (1 - p[open_])
        reached[open_] += weight[open_]
        open_ = open_[(reached[open_] < u[open_]) & (k[open_] < n[open_])]
    return k


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, rule: tuple[float, float],
         seeds: np.ndarray) -> np.ndarray:
    """Tables of each dish after its customers are seated one after the other.

    ``base``: the dish's probability at the parent; ``others``: tables of other dishes there.
    """
    discount, strength = rule
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    seated, t, goal = np.ones(len(at), np.int64), np.ones(len(at), np.int64), customers[at]
    base, others, seeds = base[at], others[at], seeds[at]
    turn = 0
    while len(at):
        party = np.minimum(np.minimum(np.maximum(seated // 16, 1), PARTY), goal - seated)
        new = (strength + discount * (others + t)) * base
        t = t + binomial(party, new / (new + seated - discount * t), uniform(seeds, turn))
        turn += 1
        seated = seated + party
        done = seated == goal
        if done.any():
            tables[at[done]] = t[done]
            more = ~done
            at, seated, t, goal, base, others, seeds = (x[more] for x in (at, seated, t, goal, base, others, seeds))
    return tables


class Range:
    """The restaurants' share of one hash range of words.

    ``pairs``: the number of the word times ``contexts``, plus the number of the context.
    """

    def __init__(self, bucket: int, words: bytes, pairs: bytes, counts: bytes, contexts: int):
        self.bucket = bucket
        self.words, self.pairs, self.counts = W.unpack(words), W.unpack(pairs), W.unpack(counts)
        self.word, self.context = self.pairs // contexts, self.pairs % contexts
        # A pair is known by its word and by the place of its context among the word's contexts, which
        # are in the order of their hashes: the same however words are dealt to ranges.
        place = np.arange(len(self.pairs)) - np.searchsorted(self.word, np.arange(len(self.words)))[self.word]
        self.word_seeds = W.mix(self.words + _U(SEED))
        self.seeds = W.mix(self.word_seeds[self.word] + W.mix(place.astype(np.uint64)))
        self.tables = np.minimum(self.counts, 1)  # one table per dish to begin with
        self._to_parent()
        self.parent_tables = np.minimum(self.customers, 1)

    def _to_parent(self) -> None:
        sums = np.bincount(self.word, self.tables, minlength=len(self.words))
        self.customers = sums.astype(np.int64)

    def parent(self, totals: Totals, known: int) -> np.ndarray:
        """Probability of each word of the range at the parent."""
        discount, strength = PARENT_RULE
        whole = strength + totals.customers
        own = (self.customers - discount * self.parent_tables) / whole
        return own + unknown(totals, known)

    def parent_without(self, totals: Totals, known: int) -> np.ndarray:
        """Probability of each pair's word at the parent, as if the pair's own tables were not there."""
        discount, strength = PARENT_RULE
        customers = self.customers[self.word] - self.tables
        had = self.parent_tables[self.word]
        tables = np.minimum(had, customers)
        whole = strength + totals.customers - self.tables
        rest = (strength + discount * (totals.parent_tables - had + tables)) / whole / (known + 1)
        return (customers - discount * tables) / whole + rest

    def sweep(self, number: int, totals: Totals, known: int) -> None:
        turn = W.mix(np.array([number], np.uint64))
        base = self.parent_without(totals, known)
        others = np.maximum(totals.tables[self.context] - self.tables, 0)
        self.tables = seat(self.counts, base, others, CONTEXT_RULE, W.mix(self.seeds + turn))
        self._to_parent()
        others = np.maximum(totals.parent_tables - self.parent_tables, 0)
        even = np.full(len(self.words), 1 / (known + 1))
        self.parent_tables = seat(self.customers, even, others, PARENT_RULE, W.mix(self.word_seeds + turn))


def unknown(totals: Totals, known: int) -> float:
    """What the parent gives a word it has no customers of."""
    discount, strength = PARENT_RULE
    return (strength + discount * totals.parent_tables) / (strength + totals.customers) / (known + 1)


# Sums per context ------------------------------------------------------------------------------

_SENT = (
    "bucket int, span int, keys binary, tables binary, customers binary, parent_tables binary,"
    " n_customers long, n_parent_tables long, n_train long, known long"
)
_SUMS = "bucket int, span int, keys binary, tables binary, customers binary"


@dataclass
class Learnt:
    n_train: int
    known: int
    totals: list[tuple[int, int]]  # customers and tables of the parent, per sweep


def _range(state: dict) -> Range:
    """The range as it begins."""
    words, pairs = W.pack(_rising(state["words"])), W.pack(_rising(state["pairs"]).astype(np.int64))
    return Range(state["bucket"], words, pairs, state["counts"], max(state["n_contexts"], 1))


def _first(table: pa.Table) -> dict:
    return {c: table[c][0].as_py() for c in table.column_names}


def _sent(own: Range, keys: list[np.ndarray], last: bool) -> pa.Table:
    """The state of a range after a sweep, and what each range of contexts is told of its tables."""
    n = sum(map(len, keys))
    tables = np.bincount(own.context, own.tables, minlength=n).astype(np.int64)
    customers = np.bincount(own.context, own.counts, minlength=n).astype(np.int64) if last else None
    ends = np.cumsum([0, *map(len, keys)])
    told = [(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
    numbers = [int(x) for x in (
        own.customers.sum(), own.parent_tables.sum(), own.counts.sum(), (own.customers > 0).sum()
    )]
    rows = [
        dict(bucket=own.bucket, tables=W.pack(own.tables), parent_tables=W.pack(own.parent_tables))
        | dict(zip(("n_customers", "n_parent_tables", "n_train", "known"), numbers))
    ]
    rows += [
        dict(bucket=own.bucket, span=i, keys=_steps(keys[i]), tables=W.pack(tables[a:b]))
        | (dict(customers=W.pack(customers[a:b])) if last else {})
        for i, a, b in told
    ]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _SENT.split(", ")])
    return pa.Table.from_pylist(rows, schema)


def summed_up(sent: DataFrame) -> DataFrame:
    """Per range of words and of contexts the sums over all ranges of words, in the order asked.

    Contexts go by their hash the first time, by their place in the range of contexts from then on.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [_rising(x.as_py()) for x in table["keys"]]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])

        def over(column: str) -> pa.Array:
            if table[column][0].as_py() is None:
                return pa.nulls(table.num_rows, pa.binary())
            numbers = np.concatenate([W.unpack(x.as_py()) for x in table[column]])
            total = np.bincount(place, numbers, minlength=len(found)).astype(np.int64)
            return pa.array([W.pack(total[p]) for p in places], pa.binary())

        return pa.table(
            {
                "bucket": table["bucket"],
                "span": table["span"],
                "keys": pa.array([_steps(p) for p in places], pa.binary()),
                "tables": over("tables"),
                "customers": over("customers"),
            }
        )

    rows = sent.where("span IS NOT NULL").select(*_columns(_SUMS))
    return rows.groupBy("span").applyInArrow(run, _SUMS)


def _whole(rows: list[dict], column: str) -> np.ndarray:
    parts = [W.unpack(r[column]) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _read(state: DataFrame, store: str, sweep: int) -> DataFrame:
    """What ranges of words were after a sweep, and the sums they were told."""
    spark = state.sparkSession
    own = spark.read.schema(_SENT).parquet(f"{store}/sent-{sweep}").where("span IS NULL")
    sums = spark.read.schema(_SUMS).parquet(f"{store}/sums-{sweep}")
    return own.unionByName(sums, allowMissingColumns=True).withColumn("sweep", F.lit(sweep))


def _restored(own: Range, rows: list[dict]) -> list[dict]:
    """Sets a range to a sweep; returns the sums per context in the order of its contexts."""
    (kept,) = (r for r in rows if r["span"] is None)
    own.tables, own.parent_tables = W.unpack(kept["tables"]), W.unpack(kept["parent_tables"])
    own._to_parent()
    return sorted((r for r in rows if r["span"] is not None), key=lambda r: r["span"])


def learn(state: DataFrame, store: str, buckets: int) -> Learnt:
    """Sweeps over all ranges; each one's state and sums are stored."""
    spark = state.sparkSession
    # Hashes of contexts are told once; they do not travel with the sweeps.
    plain = state.select("bucket", "words", "n_contexts", "pairs", "counts")
    named = state.select(*plain.columns, "contexts")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ({c: b.column(c)[i].as_py() for c in b.schema.names} for b in batches for i in range(b.num_rows)):
            own, contexts = _range(row), _rising(row["contexts"])
            ends = _ends(contexts, buckets)
            keys = [contexts[a:b] for a, b in zip(ends, ends[1:])]
            yield from _sent(own, keys, SWEEPS == 0).to_batches()

    def store_sums(sent: DataFrame, sweep: int) -> tuple:
        sent.write.parquet(f"{store}/sent-{sweep}")
        sent = spark.read.schema(_SENT).parquet(f"{store}/sent-{sweep}")
        summed_up(sent).write.parquet(f"{store}/sums-{sweep}")
        names = ("n_customers", "n_parent_tables", "n_train", "known")
        return tuple(x or 0 for x in sent.agg(*[F.sum(c) for c in names]).first())

    customers, tables, n_train, known = store_sums(named.mapInArrow(begin, _SENT), 0)
    totals = [(customers, tables)]

    def stepped(sweep: int, before: tuple[int, int]):
        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            own = _range(_first(left))
            sums = _restored(own, right.to_pylist())
            own.sweep(sweep - 1, Totals(_whole(sums, "tables"), *before), known)
            keys = {r["span"]: _rising(r["keys"]) for r in sums}
            empty = np.zeros(0, np.uint64)
            return _sent(own, [keys.get(i, empty) for i in range(buckets)], sweep == SWEEPS)

        return step

    for sweep in range(1, SWEEPS + 1):
        right = _read(state, store, sweep - 1).groupBy("bucket")
        both = plain.groupBy("bucket").cogroup(right)
        totals.append(store_sums(both.applyInArrow(stepped(sweep, totals[-1]), _SENT), sweep)[:2])
    return Learnt(n_train, known, totals)


# Scores ----------------------------------------------------------------------------------------


def answers(state: DataFrame, store: str, learnt: Learnt) -> DataFrame:
    """Per block and bucket the averaged log10 probability of each pair and the count of each word."""
    kept = range(BURN_IN + 1, SWEEPS + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first = _first(left)
        own = _range(first)
        count = np.bincount(own.word, own.counts, minlength=len(own.words)).astype(np.int64)
        rows = right.to_pylist()
        last = [r for r in rows if r["sweep"] == SWEEPS and r["span"] is not None]
        discount, strength = CONTEXT_RULE
        whole = strength + _whole(sorted(last, key=lambda r: r["span"]), "customers")
        chance = np.zeros(len(own.pairs))
        for sweep in kept:
            sums = _restored(own, [r for r in rows if r["sweep"] == sweep])
            now = Totals(_whole(sums, "tables"), *learnt.totals[sweep])
            onward = (strength + discount * now.tables) / whole
            mine = (own.counts - discount * own.tables) / whole[own.context]
            chance += mine + onward[own.context] * own.parent(now, learnt.known)[own.word]
        chance = np.log10(chance / len(kept)).astype(np.float32)
        asked = [(_rising(a).astype(np.int64), _rising(w).astype(np.int64))
                 for a, w in zip(first["asked"], first["asked_words"])]
        return pa.table(
            {
                "block": pa.array(first["blocks"], pa.int64()),
                "bucket": pa.array([own.bucket] * len(asked), pa.int32()),
                "chance": pa.array([W.pack(chance[a]) for a, _ in asked], pa.binary()),
                "known": pa.array([W.pack(count[w]) for _, w in asked], pa.binary()),
            }
        )

    told = _read(state, store, kept[0])
    for sweep in kept[1:]:
        told = told.unionByName(_read(state, store, sweep))
    return (
        state.drop("contexts")
        .groupBy("bucket")
        .cogroup(told.groupBy("bucket"))
        .applyInArrow(run, "block long, bucket int, chance binary, known binary")
    )


def summed(blocks: DataFrame, replies: DataFrame, learnt: Learnt, key: str) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n_train, known = learnt.n_train, learnt.known
        order = np.argsort(right["bucket"].to_numpy())
        chance, counts = (
            np.concatenate([W.unpack(right[c][int(i)].as_py()) for i in order]) for c in ("chance", "known")
        )
        sizes, stream = W.unpack(left["sizes"][0].as_py()), W.unpack(left["stream"][0].as_py())
        _, _, pair = pairs_of(stream, sizes, len(counts))
        plain = np.log10((counts + 1) / (n_train + known + 1))
        first = np.cumsum(sizes) - sizes

        def add(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, first) if len(sizes) else values[:0]

        n = len(sizes)
        return pa.table(
            {
                "id": left["ids"].combine_chunks().flatten(),
                "held_out": left["held"].combine_chunks().flatten(),
                "n_tokens": pa.array(sizes.astype(np.int64)),
                "n_known": pa.array(add((counts > 0).astype(np.int64)[stream]).astype(np.int64)),
                "train_tokens": pa.array([n_train] * n, pa.int64()),
                "base_score": pa.array(add(plain[stream])),
                "score": pa.array(add(chance[pair].astype(np.float64))),
            }
        )

    return (
        blocks.select("block", "ids", "held", "sizes", "stream")
        .groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInArrow(
            run,
            "id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
            " base_score double, score double",
        )
        .withColumnRenamed("id", key)
    )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    store = scratch_path(spark, "pitman-yor")
    encoded(docs, key, text).write.parquet(f"{store}/blocks")
    blocks = spark.read.schema(_BLOCK).parquet(f"{store}/blocks")
    size = blocks.agg(F.sum(F.octet_length("stream"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    merged(messages(blocks, buckets)).write.parquet(f"{store}/state")
    state = spark.read.schema(_STATE).parquet(f"{store}/state")
    learnt = learn(state, store, buckets)
    return summed(blocks, answers(state, store, learnt), learnt, key)


def perplexity(scores: DataFrame, *by: str) -> DataFrame:
    """Perplexity per token of groups of scored texts."""
    return scores.groupBy(*by).agg(
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity")
    )
