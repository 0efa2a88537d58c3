"""Best-fit packing of token sequences by a configuration linear program.

The histogram of piece lengths, which is no larger than the sequence length,
is all the plan needs.  A configuration is a multiset of lengths that fits one
sequence.  Multiplicative weights solve the covering program over configurations:
each round a knapsack dynamic program prices the best configuration under the
current weights, and lengths that it serves lose weight.  The mean of the rounds
is rounded down to whole sequences; what is left over goes through best fit,
again on the histogram, into the sequences planned and new ones.

Pieces get their places by rank within their length.  Ranks are counted in two
steps, by file and then over files, so a length that many pieces share is never
brought together.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import materialize, ship, streamed, text_slices
from gristmill.llm.wordbpe import load

CAPACITY = 2048
#: The id after every document.
END = 0


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECES = "piece int, start long, length long, ids_crc32 long"


def _piece_batches(batches, path: str, capacity: int, with_ids: bool):
    part_id = TaskContext.get().partitionId()
    for batch in batches:
        for part, texts in text_slices(batch, 1, 4 << 20):
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, all_ids in enumerate(load(path).encode_many(texts, end=END)):
                for at in range(0, len(all_ids), capacity):
                    own = all_ids[at : at + capacity]
                    owner.append(i)
                    piece.append(at // capacity)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(own.astype(np.int64))
            columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part_id] * len(owner), pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Token pieces of every row: ``id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``part`` (the task that made it) and, if asked for, ``ids``."""
    path = vocabulary or vocabulary_path()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([picked.schema["id"]])
    for x in T._parse_datatype_string(_PIECES + ", part long" + (", ids array<long>" if with_ids else "")):
        schema.add(x)
    return picked.mapInArrow(streamed(lambda it: _piece_batches(it, path, capacity, with_ids)), schema)


def _table(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value for every room, by dynamic programming, and the last size
    (an index) of a multiset that has it: -2 for that of a smaller room, -1 for room 0."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes)
    ascending, worth = sizes[order], values[order]
    for room in range(1, capacity + 1):
        n = np.searchsorted(ascending, room, "right")
        best[room], pick[room] = best[room - 1], -2
        if n:
            gain = worth[:n] + best[room - ascending[:n]]
            at = int(gain.argmax())
            if gain[at] > best[room]:
                best[room], pick[room] = gain[at], int(order[at])
    return best, pick


def _trace(pick: np.ndarray, sizes: np.ndarray, most: np.ndarray, room: int, out: list[int]) -> list[int]:
    """Adds to ``out`` the sizes of the best multiset for ``room``, each ``most`` times at most."""
    used = Counter(out)
    while room > 0 and pick[room] != -1:
        item = int(pick[room])
        if item == -2:
            room -= 1
            continue
        if used[item] < most[item]:
            used[item] += 1
            out.append(item)
        room -= int(sizes[item])
    return out


def price(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> list[int]:
    """A multiset of ``sizes`` (indices) of greatest value that fits ``capacity``,
    by dynamic programming over the capacity; a size is used ``most`` times at most."""
    return _trace(_table(values, sizes, capacity)[1], sizes, most, capacity, [])


def covering(sizes: np.ndarray, demand: np.ndarray, worth: np.ndarray, capacity: int, rate: float = 0.25, step: int = 64, tolerance: float = 0.005) -> tuple[Counter, np.ndarray]:
    """Whole numbers of sequences for configurations (tuples of indices), by
    multiplicative weights, until all but ``tolerance`` of the tokens demanded are
    served, and what is left of each length: the remainder of the rounding.

    A length loses weight as its share served grows.  One table prices the best
    configuration with each of the lengths served least (one in ``step`` of those
    open), which is taken for up to ``rate`` of its rarest length's demand,
    whatever room it leaves."""
    chosen: Counter = Counter()
    left = demand.copy()
    while left @ sizes > tolerance * (demand @ sizes):
        share = 1 - left / demand
        open_ = np.flatnonzero(left)
        own = sizes[open_]
        weights = np.exp(-2.0 * (share[open_] - share[open_].min()))
        _, pick = _table(worth[open_] * weights, own, capacity)
        for i in np.lexsort((-own, share[open_]))[: -(-len(own) // step)]:
            if not left[open_[i]]:
                continue
            config = _trace(pick, own, left[open_], capacity - int(own[i]), [int(i)])
            room = capacity - int(own[config].sum())
            used = Counter(config)
            while (at := int(np.searchsorted(own, room, "right")) - 1) >= 0:
                while at >= 0 and used[at] >= left[open_[at]]:
                    at -= 1
                if at < 0:
                    break
                used[at] += 1
                config.append(at)
                room -= int(own[at])
            items, times = np.unique(open_[config], return_counts=True)
            n = min(int((left[items] // times).min()), max(1, int(rate * (demand[items] / times).min())))
            chosen[tuple(sorted(open_[config].tolist()))] += n
            left[items] -= n * times
    return chosen, left


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int, bins: Counter) -> Counter:
    """Adds the lengths ``left`` to ``bins`` (tuple of lengths -> number of
    sequences) by best fit decreasing.  Equal sequences are treated together: as
    many as there are of a length, or of the fullest sequence that still has room."""
    rooms: dict[int, Counter] = {}
    for config, n in bins.items():
        rooms.setdefault(capacity - sum(config), Counter())[config] += n
    keys = sorted(rooms)
    for i in np.argsort(-sizes):
        size, n = int(sizes[i]), int(left[i])
        while n > 0:
            at = bisect.bisect_left(keys, size)
            if at == len(keys):
                per = capacity // size
                whole, rest = divmod(n, per)
                made = [((size,) * per, whole), ((size,) * rest, 1 if rest else 0)]
                n = 0
            else:
                room = keys[at]
                config, have = next(iter(rooms[room].items()))
                times = min(n, have)
                rooms[room][config] -= times
                if not rooms[room][config]:
                    del rooms[room][config]
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(at)
                made = [((*config, size), times)]
                n -= times
            for config, times in made:
                if times:
                    room = capacity - sum(config)
                    if room not in rooms:
                        rooms[room] = Counter()
                        bisect.insort(keys, room)
                    rooms[room][config] += times
    out: Counter = Counter()
    for found in rooms.values():
        for config, n in found.items():
            out[tuple(sorted(config, reverse=True))] += n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, passes: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths) and how many sequences have each; every piece has
    a slot and no slot is left over.  Passes end within a thousandth of the least
    number of sequences that sizes allow; the best of them counts."""
    bins: Counter = Counter({(capacity,): histogram.get(capacity, 0)}) if histogram.get(capacity) else Counter()
    rest = sorted((n, k) for n, k in histogram.items() if n < capacity and k > 0)
    if rest:
        sizes, demand = (np.array(x, np.int64) for x in zip(*rest, strict=True))
        # A length over a half needs a sequence of its own, which the bound by sizes alone misses.
        worth = sizes / capacity + 0.5 * (2 * sizes > capacity)
        least = max(sizes @ demand / capacity, demand[2 * sizes > capacity].sum())
        best: Counter = Counter()
        for _ in range(passes):
            configs, left = covering(sizes, demand, worth, capacity)
            packed = best_fit(sizes, left, capacity, Counter({tuple(int(sizes[i]) for i in config): n for config, n in configs.items()}))
            if not best or packed.total() < best.total():
                best = packed
            if best.total() <= 1.001 * least + 1:
                break
            # Lengths that left room gain worth, so that the next pass pairs them first.
            room = np.zeros(len(sizes))
            for config, n in packed.items():
                np.add.at(room, np.searchsorted(sizes, config), n * (1 - sum(config) / capacity))
            room /= demand
            worth = worth * np.exp(room - room.mean())
        bins.update(best)
    return sorted((c, n) for c, n in bins.items() if n)


class Slots:
    """Where the piece of a length and rank goes."""

    def __init__(self, configs: list[tuple[tuple[int, ...], int]]):
        rows: dict[int, list] = {}
        first = 0
        for config, times in configs:
            offset = 0
            for length in config:
                rows.setdefault(length, []).append((times, first, offset))
                offset += length
            first += times
        self.by_length = {}
        for length, found in rows.items():
            times, base, offset = (np.array(x, np.int64) for x in zip(*found, strict=True))
            self.by_length[length] = (np.cumsum(times) - times, base, offset)

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, base, offset = self.by_length[length]
        at = np.searchsorted(before, ranks, "right") - 1
        return base[at] + ranks - before[at], offset[at]


def _place_batches(batches, slots: Slots):
    for batch in batches:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            at = lengths == length
            sequence[at], offset[at] = slots.place(int(length), ranks[at])
        keep = [n for n in batch.schema.names if n not in ("rank", "part")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Packs every row of ``df`` into sequences of at most ``capacity`` tokens.

    Returns for each piece ``id_col``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, if asked for, ``ids``.

    A null or empty text is one piece, its end id.  Only texts longer than
    ``capacity`` are cut.  Repeated rows are packed as often as they occur; an
    empty table gives an empty result; other columns are not looked at.
    """
    ship(df.sparkSession)
    made = materialize(pieces(df, id_col, text_col, capacity, vocabulary, with_ids), "pieces")
    by_part = made.groupBy("length", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("part")
    before = materialize(by_part.withColumn("before", F.sum("n").over(order) - F.col("n")), "lengths")
    histogram = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}
    slots = Slots(plan(histogram, capacity))
    local = F.row_number().over(Window.partitionBy("part", "length").orderBy("id", "piece", "ids_crc32"))
    ranked = made.withColumn("local", local).join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    columns = [c for c in made.columns if c != "part"]
    schema = T.StructType([made.schema[c] for c in columns]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    placed = ranked.select(*columns, "rank").mapInArrow(streamed(lambda it: _place_batches(it, slots)), schema)
    return placed.withColumnRenamed("id", id_col)


def packing_query(documents: DataFrame) -> DataFrame:
    return pack(documents)
