"""Language-model scoring with a hierarchical Pitman-Yor model.

Every context is a Chinese restaurant whose customers are the tokens seen in it;
each table of a restaurant is a customer of the restaurant of the shorter
context.  Contexts are the word before, then its ending, then nothing.  The word
before is told by 16 bits, eight of a hash of its last two bytes above eight of a
hash of the whole word, so that words that end alike share a parent and there are
65,536 restaurants at most however large the corpus is; words whose bits agree
share a restaurant.  That keeps everything a dish needs in one place: its
customers in all restaurants are stored together, dealt by the word, and only the
totals of the restaurants are global.

Seating is sampled by Gibbs sweeps: the customers of a dish leave all restaurants
and are seated again given the totals of the others after the sweep before, dishes
side by side.  Random numbers are hashes of word, context and sweep, so a lost task seats alike when it is run
again, and a later job replays the sweeps instead of storing them.  The
predictive probabilities of several sweeps are averaged.

Words stand for themselves by 64-bit hashes.  Tokens travel in packed arrays,
one for each batch of documents and shard of words; a shard with very many
tokens is read by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import input_bytes, materialize, mix64, settle, ship, streamed, text_slices, training_row, uniform

#: The end token: the hash of a string that can't be a word.
END = np.uint64(xxhash.xxh64_intdigest(b" "))
CONTEXTS = 1 << 16
#: Bytes of input for each shard of words.
SHARD_BYTES = 8 << 20


def tokenize(texts: list[bytes | None], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and contexts of all tokens of whole texts, and tokens by text.

    A context has eight bits of a hash of the last two bytes of the word before (a
    space before one-byte words) above eight of its own hash; the first token of a
    text has context 0.  Texts are split ``step`` bytes at a time, or one by one."""
    ends = np.cumsum([len(x) if x else 0 for x in texts])
    parts, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        parts.append(_tokenize(texts[at:to]))
        at = to
    return tuple(_joined(parts or [_tokenize([])]))


def _tokenize(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    split = [x.lower().split() if x else [] for x in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for x in split for w in x]
    total = len(flat)
    hashes = np.full(total + len(texts), END, np.uint64)
    contexts = np.zeros(total + len(texts), np.uint16)
    if total:
        lens = np.fromiter(map(len, flat), np.int64, total)
        raw = np.frombuffer(b"".join(flat), np.uint8)
        ends = np.cumsum(lens)
        place = np.arange(total) + np.repeat(np.arange(len(texts)), sizes)
        hashes[place] = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, total)
        last = raw[ends - 1].astype(np.uint64)
        second = np.where(lens > 1, raw[np.maximum(ends - 2, 0)], 32).astype(np.uint64)
        ending = (mix64((last << np.uint64(8)) | second) >> np.uint64(56)).astype(np.uint16)
        contexts[place + 1] = (ending << np.uint16(8)) | (hashes[place] >> np.uint64(56)).astype(np.uint16)
    return hashes, contexts, sizes + 1


def _pairs(words: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
    """Adds up the counts of equal (word, context); sorted by both."""
    order = np.lexsort((contexts, words))
    words = words[order]  # one after the other, so that each lets go of what was given
    contexts = contexts[order]
    counts = counts[order]
    del order
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])][: len(words)])
    return words[first], contexts[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts


def _joined(held: list[tuple]) -> Iterator[np.ndarray]:
    """The columns of ``held``, each in one array; empties the list."""
    columns = list(zip(*held, strict=True))
    held.clear()
    while columns:
        yield np.concatenate(columns.pop(0))


def _blob(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _narrow(numbers: np.ndarray) -> bytes:
    """Counts or places in the narrowest type that holds the largest; what travels is
    held several times over, by the JVM, by Arrow and here."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())) if len(numbers) else np.uint8).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of :func:`_narrow`."""
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n] if n else np.uint8)


_COUNTS = "shard long, words binary, contexts binary, counts binary"
_MODEL = f"{_COUNTS}, tokens long"


def _count_batches(batches, shards: int, flush: int = 600_000):
    held: list[tuple] = []
    size = 0

    def out():
        words, contexts, counts = _pairs(*_joined(held))
        shard = (words % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = [(p, *_blob(words[at], contexts[at]), _narrow(counts[at])) for p in range(shards) if len(at := order[cuts[p] : cuts[p + 1]])]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)], ["shard", "words", "contexts", "counts"])

    for batch in batches:
        for _, texts in text_slices(batch, 0):
            words, contexts, _ = tokenize(texts)
            held.append(_pairs(words, contexts, np.ones(len(words), np.uint8)))
            size += len(held[-1][0])
            if size > flush:
                yield out()
                size = 0
    if held:
        yield out()


def _merge_counts(group: pd.DataFrame) -> pd.DataFrame:
    settle()
    words, contexts, counts = _pairs(
        np.concatenate([np.frombuffer(x, np.uint64) for x in group.words]),
        np.concatenate([np.frombuffer(x, np.uint16) for x in group.contexts]),
        np.concatenate([_numbers(x, len(w) // 8) for x, w in zip(group.counts, group.words, strict=True)]),
    )
    return pd.DataFrame([(group.shard.iloc[0], *_blob(words, contexts), _narrow(counts), counts.sum())], columns=["shard", "words", "contexts", "counts", "tokens"])


@dataclass
class Totals:
    """Customers and tables of all restaurants, the longest contexts first, the
    number of distinct words and of tokens."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    words: int


@dataclass
class Process:
    """The two parameters of each level, the longest contexts first, and how much
    of the base measure is for unseen words."""

    discount: tuple[float, ...] = (0.8, 0.8, 0.75)
    strength: tuple[float, ...] = (5.0, 5.0, 1.0)
    unseen: float = 0.5
    history: list[Totals] = field(default_factory=list)
    burn_in: int = 1

    def base(self, words: int) -> tuple[float, float]:
        return ((1.0 - self.unseen) / words, self.unseen) if words else (0.0, 1.0)

    def back_off(self, level: int, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """For each restaurant of a level: the share left to its parent, and one over its weight."""
        weight = self.strength[level] + totals.customers[level]
        return (self.strength[level] + self.discount[level] * totals.tables[level]) / weight, 1.0 / weight


def binomial(n: np.ndarray, chance: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial draws from uniform ``u`` by inversion; where a draw expects over 100, by
    the normal law."""
    out = np.floor(np.clip(n * chance + np.sqrt(n * chance * (1 - chance)) * _normal(u) + 0.5, 0, n)).astype(np.int64)
    at = np.flatnonzero(n * chance <= 100)
    n, chance, rest = n[at], chance[at], u[at].copy()
    mass, odds = np.exp(n * np.log1p(-chance)), chance / (1 - chance)
    out[at] = k = 0
    open_ = np.arange(len(at))
    while True:
        rest[open_] -= mass[open_]
        open_ = open_[(rest[open_] > 0) & (k < n[open_])]
        if not len(open_):
            return out
        mass[open_] *= odds[open_] * (n[open_] - k) / (k + 1)
        k += 1
        out[at[open_]] = k


def _normal(u: np.ndarray) -> np.ndarray:
    """Standard normal deviates of uniform numbers, nearly: the logistic law's, scaled."""
    return np.log(u / (1 - u)) * math.sqrt(3) / math.pi


def seat(customers: np.ndarray, pull: np.ndarray, parent: np.ndarray, discount: float, keys: np.ndarray) -> np.ndarray:
    """Tables of each dish after taking its customers away and seating them again.

    ``pull`` is the weight of a new table without any of the dish's own: what the
    restaurant gives its parent, times ``parent``, the parent's probability of the dish;
    each table that the dish gets adds ``discount * parent``.  Customers sit down one at a
    time up to 16, then in groups of an eighth of those seated, whose new tables are a
    binomial draw by the chance that the first of them has."""
    tables = np.ones(len(customers), np.int64)
    seated = np.ones(len(customers), np.int64)
    open_ = np.flatnonzero(customers > 1)
    step = 0
    while len(open_):
        n, t = seated[open_], tables[open_]
        w = pull[open_] + discount * t * parent[open_]
        group = np.minimum(customers[open_] - n, np.maximum(1, n // 8))
        chance = w / (w + n - discount * t)
        u = uniform(keys[open_] + np.uint64(step))
        tables[open_] = t + (binomial(group, chance, u) if group.max() > 1 else (u < chance))
        seated[open_] = n + group
        open_ = open_[seated[open_] < customers[open_]]
        step += 1
    return tables


class Shard:
    """The dishes of one shard: counts by (word, context) and their seating.

    Arrays of a place for each pair are views of the stored row or four bytes wide;
    whatever else a sweep needs of them is made for ``CHUNK`` pairs at a time."""

    CHUNK = 1 << 16

    def __init__(self, words: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
        self.pairs = words
        fresh_word = np.r_[True, words[1:] != words[:-1]][: len(words)]
        one = fresh_word | np.r_[True, (contexts[1:] >> 8) != (contexts[:-1] >> 8)][: len(words)]
        self.to_one = np.cumsum(one, dtype=np.int32) - np.int32(1)
        self.first_one = np.flatnonzero(one).astype(np.int32)
        fresh = fresh_word[self.first_one]
        self.to_word = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.first_word = np.flatnonzero(fresh).astype(np.int32)
        self.words = words[self.first_one][self.first_word]
        self.rooms = [contexts, contexts[self.first_one] >> 8, np.zeros(len(self.words), np.uint8)]
        self.customers = [counts, np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.seats([np.ones(len(x), np.int32) for x in (counts, self.to_word, self.words)])
        self.counts = np.add.reduceat(np.add.reduceat(counts, self.first_one, dtype=np.int64), self.first_word) if len(counts) else counts

    def seats(self, tables: list[np.ndarray]) -> None:
        self.tables = tables
        if len(tables[0]):
            self.customers[1] = np.add.reduceat(tables[0], self.first_one, dtype=np.int64)
            self.customers[2] = np.add.reduceat(tables[1], self.first_word, dtype=np.int64)

    def keys(self, level: int, at: slice) -> np.ndarray:
        """Hashes of (word, context) of some dishes of a level, other ones at each."""
        if level == 2:
            return mix64(self.words[at] + np.uint64(1))
        place = at if level == 0 else self.first_one[at]
        with np.errstate(over="ignore"):
            own = mix64(self.pairs[place] ^ (self.rooms[0][place].astype(np.uint64) << np.uint64(40)))
        return own if level == 0 else mix64(own)

    def probabilities(self, process: Process, totals: Totals, level: int, at: slice = slice(None), parents: np.ndarray | None = None) -> np.ndarray:
        """Of the dishes of a level in their own restaurants; ``parents`` has those of the
        next level, if they are known."""
        if level == 2:
            parent = process.base(totals.words)[0]
        else:
            parents = self.probabilities(process, totals, level + 1) if parents is None else parents
            parent = parents[(self.to_one, self.to_word)[level][at]]
        rest, scale = process.back_off(level, totals)
        room = self.rooms[level][at]
        return (self.customers[level][at] - process.discount[level] * self.tables[level][at]) * scale[room] + rest[room] * parent

    def sweep(self, process: Process, totals: Totals, number: int) -> None:
        word = self.probabilities(process, totals, 2)
        parents = [self.probabilities(process, totals, 1, parents=word), word]
        tables, customers = [], self.customers[0]
        for level in range(3):
            out = np.empty(len(customers), np.int32)
            for start in range(0, len(customers), self.CHUNK):
                at = slice(start, start + self.CHUNK)
                parent = parents[level][(self.to_one, self.to_word)[level][at]] if level < 2 else np.full(len(out[at]), process.base(totals.words)[0])
                others = totals.tables[level][self.rooms[level][at]] - self.tables[level][at]
                pull = (process.strength[level] + process.discount[level] * others) * parent
                out[at] = seat(customers[at], pull, parent, process.discount[level], self.keys(level, at) + np.uint64(number << 20))
            tables.append(out)
            if level < 2 and len(out):
                customers = np.add.reduceat(out, (self.first_one, self.first_word)[level], dtype=np.int64)
            elif level < 2:
                customers = np.zeros(0, np.int64)
        self.seats(tables)

    def totals(self) -> list[np.ndarray]:
        sizes = (CONTEXTS, 256, 1)
        return [np.bincount(self.rooms[i], x[i], sizes[i]).astype(np.int64) for x in (self.customers, self.tables) for i in range(3)]


def _shard(row) -> Shard:
    words = np.frombuffer(row["words"], np.uint64)
    return Shard(words, np.frombuffer(row["contexts"], np.uint16), _numbers(row["counts"], len(words)))


def _replay(shard: Shard, process: Process) -> Iterator[tuple[Shard, Totals]]:
    """Sweeps as recorded; after each of those averaged over, the shard and its totals."""
    for number, totals in enumerate(process.history[:-1]):
        shard.sweep(process, totals, number)
        if number >= process.burn_in:
            yield shard, process.history[number + 1]


def _total_batches(batches, process: Process):
    """The totals of the shards of a task after all sweeps so far and one more."""
    sums, words = None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            shard = _shard(batch.slice(i, 1).to_pylist()[0])
            for number, totals in enumerate(process.history):
                shard.sweep(process, totals, number)
            found = shard.totals()
            sums = found if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
            words += len(shard.words)
    if sums is not None:
        rows = [(i, int(k), int(x[k])) for i, x in enumerate(sums) for k in np.flatnonzero(x)]
        rows.append((6, 0, words))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["kind", "place", "n"])


def fit(counts: DataFrame, process: Process, samples: int = 2) -> Process:
    """Runs the sweeps; ``history`` gets the totals of the first seating and of
    every sweep.  What reaches the driver are the totals of 65,793 restaurants at most."""
    for _ in range(process.burn_in + samples + 1):
        totals = Totals([np.zeros(n, np.int64) for n in (CONTEXTS, 256, 1)], [np.zeros(n, np.int64) for n in (CONTEXTS, 256, 1)], 0)
        frozen = Process(process.discount, process.strength, process.unseen, list(process.history), process.burn_in)
        for kind, place, n in counts.drop("tokens").mapInArrow(streamed(lambda it, p=frozen: _total_batches(it, p)), "kind long, place long, n long").groupBy("kind", "place").agg(F.sum("n")).collect():
            if kind < 6:
                (totals.customers if kind < 3 else totals.tables)[kind % 3][place] = n
            else:
                totals.words = n
        process.history.append(totals)
    return process


def _packed_batches(batches, shards: int, copies: dict[int, int]):
    """One row with the ids of each run of documents, and one for each shard with its tokens,
    sorted by word: the distinct words and after them a bit for each token, 1 at a word's first."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part, texts in text_slices(batch, 2, 4 << 20):
            run = (task << 32) | number
            number += 1
            words, contexts, sizes = tokenize(texts)
            docs = np.repeat(np.arange(len(texts), dtype=np.min_scalar_type(len(texts))), sizes)
            del texts
            shard = (words % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((contexts, words, shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            del shard
            words = words[order]
            contexts = contexts[order]
            docs = docs[order]
            del order
            rows = [(-1 - run % shards, 0, run, *_blob(sizes), None, None, part.column(0).to_pylist(), part.column(1).to_pylist())]
            for p in range(shards):
                at = slice(cuts[p], cuts[p + 1])
                if cuts[p] < cuts[p + 1]:
                    fresh = np.r_[True, words[at][1:] != words[at][:-1]]
                    packed = _blob(words[at][fresh], np.packbits(fresh))
                    rows.append((p, run % copies.get(p, 1), run, packed[0] + packed[1], *_blob(contexts[at]), _narrow(docs[at]), None, None))
            types = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(part.column(0).type), pa.list_(pa.bool_()))
            names = ["shard", "copy", "run", "words", "contexts", "docs", "ids", "held"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _score_shard(model: pd.DataFrame, tokens: pd.DataFrame, process: Process) -> pd.DataFrame:
    """Sums of log10 probabilities by run and document over the tokens of one shard."""
    settle()
    columns = ["run", "docs", "known", "base", "score", "ids", "held", "sizes"]
    if len(tokens) and tokens["shard"].iloc[0] < 0:
        return pd.DataFrame([(r.run, None, None, None, None, r.ids, r.held, r.words) for r in tokens.itertuples()], columns=columns)
    empty = {"words": b"", "contexts": b"", "counts": b""}
    shard = _shard(model.iloc[0] if len(model) else empty)
    pair = (np.repeat(np.arange(len(shard.words)), np.diff(np.r_[shard.first_word, len(shard.to_word)]))[shard.to_one] << 16) | shard.rooms[0] if len(shard.words) else np.empty(0, np.int64)
    one = (shard.to_word.astype(np.int64) << 8) | shard.rooms[1] if len(shard.words) else np.empty(0, np.int64)
    sampled = []
    for s, totals in _replay(shard, process):
        back = [process.back_off(level, totals) for level in range(3)]
        word = s.probabilities(process, totals, 2)
        own = [(s.customers[i] - process.discount[i] * s.tables[i]).astype(np.float32 if i == 0 else np.float64) for i in range(2)]
        sampled.append((back, word, own, float(process.base(totals.words)[1] * back[2][0][0])))
    out = []
    for r in tokens.itertuples():
        contexts = np.frombuffer(r.contexts, np.uint16).astype(np.int64)
        docs = _numbers(r.docs, len(contexts))
        n = (len(r.words) - (len(contexts) + 7) // 8) // 8
        unique, fresh = np.frombuffer(r.words, np.uint64, n), np.unpackbits(np.frombuffer(r.words, np.uint8, offset=8 * n), count=len(contexts))
        repeats = np.diff(np.r_[np.flatnonzero(fresh), len(fresh)])
        at = np.searchsorted(shard.words, unique)
        found = at < len(shard.words)
        found[found] = shard.words[at[found]] == unique[found]
        at = np.where(found, at, 0)
        counts = np.where(found, shard.counts[at], 0) if len(shard.words) else np.zeros(n, np.int64)
        word, known = np.repeat(at, repeats), np.repeat(found, repeats)
        probability = np.zeros(len(contexts))
        places = []
        for keys, key in ((pair, (word << 16) | contexts), (one, (word << 8) | (contexts >> 8))):
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            places.append((place, known & (keys[place] == key) if len(keys) else np.zeros(len(key), bool)))
        for back, words, own, unseen in sampled:
            p = np.where(known, words[word], unseen) if len(words) else np.full(len(contexts), unseen)
            for level, room in ((1, contexts >> 8), (0, contexts)):
                place, hit = places[level]
                rest, scale = back[level]
                p = rest[room] * p
                p[hit] += own[level][place[hit]] * scale[room[hit]]
            probability += p
        logs = np.log10(probability / max(len(sampled), 1))
        texts, place = np.unique(docs, return_inverse=True)
        base = np.repeat(np.log10(counts + 1.0), repeats)
        out.append(
            (r.run, _narrow(texts), _narrow(np.bincount(place, known)), *_blob(np.bincount(place, base), np.bincount(place, logs)), None, None, None)
        )
    return pd.DataFrame(out, columns=columns)


def _sum_run(group: pd.DataFrame, tokens: int, words: int) -> pd.DataFrame:
    head = group[group.sizes.notna()].iloc[0]
    sizes = np.frombuffer(head.sizes, np.int64)
    known, base, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
    for r in group[group.sizes.isna()].sort_values(["docs", "base", "score"]).itertuples():
        docs = _numbers(r.docs, len(r.base) // 8)
        known[docs] += _numbers(r.known, len(docs))
        base[docs] += np.frombuffer(r.base, np.float64)
        score[docs] += np.frombuffer(r.score, np.float64)
    base -= sizes * math.log10(tokens + words + 1)
    return pd.DataFrame({"id": head.ids, "held_out": head.held, "n_tokens": sizes, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score})


def score_texts(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", process: Process | None = None, samples: int = 2) -> DataFrame:
    """Trains on the rows of ``df`` for which ``held_out`` is false and scores all.

    Returns ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score``, log10 probabilities of whole
    texts with their end token; ``-score / n_tokens`` is the log10 perplexity.

    A null text is an empty one: its end token alone.  Repeated rows count and come
    out as often as they occur.  Without training rows every token is unseen.  An
    empty table gives an empty result.
    """
    ship(df.sparkSession)
    process = process or Process()
    rows = df.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).cast("string").alias("text"))
    shards = max(12, input_bytes(df, text_col) // SHARD_BYTES)
    texts = rows.filter(~F.col("held")).select("text")
    counts = texts.mapInArrow(streamed(lambda it: _count_batches(it, shards)), _COUNTS).groupBy("shard").applyInPandas(_merge_counts, _MODEL)
    counts = materialize(counts, "lm-counts")
    process = fit(counts, process, samples)
    # Shards with twice the usual tokens are read by several tasks; they are the shards of
    # very frequent words, half of all at most.
    usual = counts.agg(F.avg("tokens")).first()[0] or 1.0
    n = F.when(F.col("tokens") > 2 * usual, F.ceil(F.col("tokens") / usual)).otherwise(F.lit(1).cast("long"))
    copies = {r.shard: r.n for r in counts.filter(F.col("tokens") > 2 * usual).select("shard", n.alias("n")).collect()}
    model = counts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("tokens")
    groups = shards + sum(copies.values()) - len(copies)
    identity = rows.schema["id"].dataType
    packed = T._parse_datatype_string("shard long, copy long, run long, words binary, contexts binary, docs binary")
    packed.add("ids", T.ArrayType(identity)).add("held", T.ArrayType(T.BooleanType()))
    tokens = rows.mapInArrow(streamed(lambda it: _packed_batches(it, shards, copies)), packed)
    parts = T._parse_datatype_string("run long, docs binary, known binary, base binary, score binary")
    parts.add("ids", T.ArrayType(identity)).add("held", T.ArrayType(T.BooleanType())).add("sizes", T.BinaryType())
    # Twice as many partitions as there are groups, so that few tasks get several of them.
    model, tokens = (x.repartition(2 * groups, "shard", "copy") for x in (model, tokens))
    scored = model.groupBy("shard", "copy").cogroup(tokens.groupBy("shard", "copy")).applyInPandas(lambda a, b: _score_shard(a, b, process), parts)
    n, v = int(process.history[0].customers[0].sum()), process.history[0].words
    out = T.StructType([T.StructField("id", identity)])
    for field_ in T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"):
        out.add(field_)
    return scored.groupBy("run").applyInPandas(lambda g: _sum_run(g, n, v), out)


def lm_query(documents: DataFrame) -> DataFrame:
    scored = score_texts(documents, ~training_row("doc_id", 7))
    return scored.withColumnRenamed("id", "doc_id")
