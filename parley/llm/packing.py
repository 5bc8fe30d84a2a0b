"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Documents become ids with an end id; longer ones are cut into pieces of CAPACITY. The histogram of piece lengths (at
most CAPACITY entries, whatever the corpus) goes to the driver. A configuration is a multiset of lengths that fits one
sequence. Multiplicative weights keep a price for each length; a knapsack dynamic program over the capacity finds the
configuration worth most, and the lengths it covers become cheaper. The average of the configurations is the fractional
solution; its counts are rounded down, a configuration being used only as far as pieces are left, and the rest is
packed best-fit decreasing. The histogram's solution gives each length a list of places; a piece finds its own by its
rank among the pieces of its length, which Spark counts in buckets, so a length with very many pieces is split.

Defined results: null and empty texts are one end id; a document of exactly CAPACITY ids is one piece; equal lengths are
ordered by doc_id and piece; repeated rows keep their pieces each; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import default_vocabulary, word_ids

CAPACITY = 2048
END = 0
#: Rounds of multiplicative weights in a pass, passes over what rounding leaves, how steeply prices fall, share of the scarcest need met in a round, rounds between bounds.
ROUNDS, PASSES, SHARPNESS, STEP, DUAL = 240, 2, 4.0, 0.5, 50


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit) of every piece."""
    tail = end.to_bytes(4, "little")

    def run(batches):
        ids_of = word_ids(vocabulary or default_vocabulary())
        try:
            for batch in common.slices(batches):
                doc = batch.column("doc_id")
                out = ([], [], [], [], [], [])
                for row, text in enumerate(common.as_bytes(batch.column("text"))):
                    ids = ids_of.encode(text) + tail
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(out[0], pa.int64())), *(pa.array(c, k) for c, k in zip(out[1:], kinds))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        finally:
            ids_of.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, ids binary")


def price(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[Counter, float]:
    """The configuration worth most, and its worth: an unbounded knapsack over the capacity."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for room in range(int(lengths[0]), capacity + 1):
        n = upto[room]
        gain = value[room - lengths[:n]]
        gain += worth[:n]
        k = int(gain.argmax())
        if gain[k] > value[room - 1]:
            value[room], taken[room] = gain[k], k
        else:
            value[room] = value[room - 1]
    found: Counter = Counter()
    room = capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
            continue
        found[int(taken[room])] += 1
        room -= int(lengths[taken[room]])
    return found, float(value[capacity])


@dataclass
class Plan:
    """Sequences as (lengths in one, how many); the first `programmed` of the entries come from the program. `bound`: no packing needs fewer."""

    entries: list[tuple[tuple[int, ...], int]]
    programmed: int
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.entries)

    @property
    def share(self) -> float:
        """Share of the sequences that the program supplied."""
        return sum(n for _, n in self.entries[: self.programmed]) / max(1, self.sequences)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Packs every piece of the histogram: the program with best-fit for what rounding leaves, or best-fit alone if that needs fewer sequences."""
    left = {length: n for length, n in histogram.items() if n > 0}
    whole = [((capacity,), left.pop(capacity))] if capacity in left else []
    total = sum(length * n for length, n in left.items())
    bound = -(-total // capacity)
    program: list[tuple[tuple[int, ...], int]] = []
    rest = dict(left)
    for _ in range(PASSES):
        lengths = np.array(sorted(rest), dtype=np.int64)
        need = np.array([rest[int(x)] for x in lengths], dtype=np.int64)
        if need.sum() < 2 * len(lengths) or len(lengths) < 2:
            break
        used, dual = fractional(need, lengths, capacity, rounds)
        if not program:
            bound = max(bound, int(np.ceil(dual - 1e-6)))
        rounded, after = round_down(used, need, lengths)
        program += rounded
        rest = {int(x): int(n) for x, n in zip(lengths, after) if n > 0}
        if not rounded:
            break
    full = sum(n for _, n in whole)
    # Beside the whole program: its sequences without waste alone, all or half of them; and none. The fewest sequences count, then the program's share.
    tight = [(config, n) for config, n in program if sum(config) == capacity]
    tried = []
    for chosen in (program, tight, [(config, n // 2) for config, n in tight if n > 1], []):
        over = Counter(left)
        for config, n in chosen:
            for length in config:
                over[length] -= n
        entries = chosen + best_fit({length: n for length, n in over.items() if n}, capacity)
        tried.append(Plan(whole + entries, len(whole) + len(chosen) if chosen else 0, bound + full))
    return min(tried, key=lambda p: (p.sequences, -p.share))


def fractional(need: np.ndarray, lengths: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[tuple, float]], float]:
    """Configurations (index and count of each length) with fractional numbers of sequences, and a lower bound from the prices.

    In each round the configuration worth most at the prices is used until it has met STEP of what its scarcest length needs, and the
    prices of its lengths fall with the share of their need that is met; lengths whose need is met are not bought. Every DUAL rounds all
    lengths are priced: prices over the worth of the best configuration are feasible in the dual program, so needs times prices bound
    every packing from below.
    """
    met, used, dual = np.zeros(len(lengths)), Counter(), 0.0
    for turn in range(rounds):
        worth = np.exp(-SHARPNESS * met / need) * lengths
        if turn % DUAL == 0:
            dual = max(dual, float((need * worth).sum()) / price(worth, lengths, capacity)[1])
        open_ = np.flatnonzero(met < need)
        if not len(open_):
            break
        config, _ = price(worth[open_], lengths[open_], capacity)
        config = Counter({int(open_[k]): n for k, n in config.items()})
        step = STEP * min(need[k] / n for k, n in config.items())
        for k, n in config.items():
            met[k] += step * n
        used[tuple(sorted(config.items()))] += step
    return sorted(used.items(), key=lambda x: -x[1]), dual


def round_down(used: list[tuple[tuple, float]], need: np.ndarray, lengths: np.ndarray) -> tuple[list, np.ndarray]:
    """Whole counts of the configurations, the most used first, none beyond the pieces that are left."""
    rest, plan = need.copy(), []
    for config, amount in used:
        times = min([int(amount), *(int(rest[k] // n) for k, n in config)])
        if times > 0:
            for k, n in config:
                rest[k] -= times * n
            plan.append((tuple(int(lengths[k]) for k, n in config for _ in range(n)), times))
    return plan, rest


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal open sequences are handled together."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                per = capacity // length
                for config, times in (((length,) * per, n // per), ((length,) * (n % per), 1)):
                    if config and times:
                        left = capacity - length * len(config)
                        room.setdefault(left, {})
                        room[left][config] = room[left].get(config, 0) + times
                break
            config, times = room[fit].popitem()
            if not room[fit]:
                del room[fit]
            per = min(fit // length, n)
            moved = min(times, n // per)
            if times > moved:
                room.setdefault(fit, {})[config] = times - moved
            grown, left = config + (length,) * per, fit - length * per
            room.setdefault(left, {})
            room[left][grown] = room[left].get(grown, 0) + moved
            n -= moved * per
    return [(config, times) for configs in room.values() for config, times in configs.items()]


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): rank r of a length lies in sequence first + r - first rank."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for length in config:
            rows.append((length, rank[length], times, sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> tuple[DataFrame, DataFrame]:
    """The stored pieces with their ids, and the place of each piece (join them on doc_id, piece and start for sequences)."""
    made, _ = common.store(pieces(docs, vocabulary, capacity, end), "pieces")
    return made, assign(made, capacity)


def assign(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces without their ids, with sequence_id and offset."""
    spark = made.sparkSession
    counted = made.groupBy("length").count().collect()  # at most `capacity` rows
    found = places(solve({r["length"]: r["count"] for r in counted}, capacity).entries)
    total = sum(r["count"] for r in counted)
    parts = max(1, -(-total // 4_000))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")
    keyed = made.withColumn("bucket", bucket)
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select(F.col("length").alias("l"), F.col("bucket").alias("b"), "before")
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    narrow = keyed.drop("ids").withColumn("inner", inner)
    ranked = narrow.join(sizes, (narrow["length"] == sizes["l"]) & (narrow["bucket"] == sizes["b"])).withColumn("rank", F.col("before") + F.col("inner")).drop("l", "b", "before", "inner", "bucket")
    by_length: dict[int, list] = {}
    for row in found:
        by_length.setdefault(row[0], []).append(row[1:])
    table = spark.sparkContext.broadcast({length: np.array(rows, dtype=np.int64) for length, rows in by_length.items()})

    def place(batches):
        """Look each rank up among the places of its length (the table's size is bounded by the solver's rounds)."""
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cut) if len(order) else []:
                rows = table.value[int(length[at[0]])]
                k = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                sequence[at], offset[at] = rows[k, 2] + rank[at] - rows[k, 0], rows[k, 3]
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, kinds + ", sequence_id long, offset long")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
