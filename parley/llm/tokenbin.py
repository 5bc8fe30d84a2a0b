"""Token ids in files: blocks of ids, each coded by itself with context mixing and a range coder, and checksummed.

Models of order 2 and order 1 each guess the next id (the one that last followed the same two ids, the same id, in this
block), with a confidence that grows with hits and falls with misses. Order 0 puts ids into classes of like frequency;
how often each class occurs is learnt in the block as it goes, and within a class the segment's frequencies hold. The
hit rates of the guesses, learnt for every pair of confidences, mix the three into shares of the coding interval. All
models start anew in every block, which has its own crc32 and can be decoded alone (`open_block`). The blocks of a
segment are coded side by side, one id of each at a time, by array operations; no block sees another.

File: segments, each of them: magic, lengths, zlib-packed head (documents' ids and lengths, the ids that occur with their
frequencies, block sizes and checksums), digits of the blocks. Defined results: null and empty texts are one end id;
repeated rows and equal doc_ids keep a row each; null doc_ids come first; an empty table writes nothing; extra columns
are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, files
from .tokens import default_vocabulary, word_ids

MAGIC = b"CTXIDS02"
END = 1
BLOCK = 1024
#: Ids of one segment: the blocks that are coded side by side, and what a task holds in memory.
SEGMENT = 2 << 20
#: Bytes of text that a writing task takes at most, and ids that a reading task takes.
PART_BYTES, PART_IDS = 256 << 20, 64 << 20
#: Words and parts of words that a writing worker remembers at most, some 200 bytes each.
WORDS = 800_000
#: Bytes of text that are encoded together (a longer text alone), and ids up to which a table finds their ranks.
GROUP, _TABLE = 4 << 20, 1 << 22
#: Places for guesses in a block and order; classes of order 0, and the least share of each in 2**_SHARE.
_SLOTS, _CLASSES, _LEAST, _SHARE = 512, 16, 96, 15
#: Largest chance of a guess in 2**16, and the rank from which ids are never guessed.
_TOP, _NONE = 63_488, (1 << 14) - 1
_U = np.uint64
_KEEP, _FULL, _SHORT = _U((1 << 47) - 1), _U((1 << 63) - 1), _U(1 << 47)


class Order0:
    """The ids of a segment by falling frequency, in classes of about equal weight; frequencies within a class add up to 2**bits."""

    def __init__(self, known: np.ndarray, freq: np.ndarray, kind: np.ndarray, bits: int):
        self.known, self.freq, self.kind, self.bits = known, freq, kind, bits
        first = np.searchsorted(kind, kind)
        total = np.concatenate(([0], np.cumsum(freq)))
        low = total[:-1] - total[first] if len(known) else freq
        #: Place within the class, frequency and class of each rank in one number.
        self.packed = (low << 32) + (freq << 5) + kind
        self.inverse = np.repeat(np.arange(len(known), dtype=np.int32), freq)
        self.begin = total[np.searchsorted(kind, np.arange(_CLASSES))]

    @staticmethod
    def of(ids: np.ndarray) -> Order0:
        if len(ids) and int(ids.max()) < _TABLE:
            count = np.bincount(ids)
            known = np.flatnonzero(count)
            count = count[known]
        else:
            known, count = np.unique(ids, return_counts=True)
        order = np.argsort(-count, kind="stable")
        known, count = known[order].astype(np.int64), count[order].astype(np.int64)
        middle = np.cumsum(count) - (count + 1) // 2
        # By weight, but the many rare ids at the end are spread over more classes than they weigh.
        most = max(1 << 13, -(-2 * len(known) // _CLASSES))
        kind = np.minimum(middle * _CLASSES // max(1, int(count.sum())), _CLASSES - 1 - np.arange(len(known))[::-1] // most)
        # A class never holds more ids than half its places.
        bits = max(14, int(np.bincount(kind, minlength=1).max() - 1).bit_length() + 1)
        freq = np.zeros(len(known), dtype=np.int64)
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            freq[own] = 1 + count[own] * ((1 << bits) - len(own)) // count[own].sum()
            freq[own[0]] += (1 << bits) - freq[own].sum()
        return Order0(known, freq, kind, bits)

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        most = int(self.known.max(initial=0))
        if most < _TABLE:
            table = np.zeros(most + 1, dtype=np.int32)
            table[self.known] = np.arange(len(self.known))
            return table.take(ids)
        by_id = np.argsort(self.known)
        return by_id[np.searchsorted(self.known[by_id], ids)]


class Mixer:
    """The models of all blocks side by side: guesses with confidences, hit rates, and how often each class occurs."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.row = np.arange(lanes, dtype=np.int64) * _SLOTS + np.array([[0], [lanes * _SLOTS]])
        self.guess = np.full(2 * lanes * _SLOTS, _NONE << 2, dtype=np.uint16)
        start = np.array([0, 12_000, 30_000, 52_000])
        two, one = np.divmod(np.arange(16), 4)
        #: For both confidences, and whether both guess alike: chance of order 2, chance of order 1 if order 2 fails (upper half).
        self.rate = np.tile(np.concatenate((start[two] + (start[one] << 16), start[two])), lanes).astype(np.uint32)
        k = np.arange(1, _CLASSES)[:, None]
        self.bounds = np.zeros((_CLASSES + 1, lanes), dtype=np.uint16)
        self.bounds[1:-1], self.bounds[-1] = (k << _SHARE) // _CLASSES, 1 << _SHARE
        self.inner = self.bounds[1:-1].view(np.int16)
        self.k, self.below = k.astype(np.int16), (k * _LEAST).astype(np.int16)
        self.rise = np.int16((1 << _SHARE) - _CLASSES * _LEAST)
        self.step = np.zeros((_CLASSES - 1, lanes), dtype=np.int16)
        self.prev = np.zeros((2, lanes), dtype=np.int64)

    def predict(self, live: int) -> tuple[np.ndarray, np.ndarray]:
        """Of 2**16, for the first `live` blocks: the share of order 2, and of order 2 and 1 together."""
        one, two = self.prev[:, :live]
        h = one * 0x9E35
        self.at = np.empty_like(self.prev[:, :live])
        np.right_shift(h, 4, out=self.at[1])
        h += two * 0x6A2D
        np.right_shift(h, 3, out=self.at[0])
        self.at &= _SLOTS - 1
        self.at += self.row[:, :live]
        self.entry = self.guess.take(self.at)
        self.said, self.sure = self.entry >> np.uint16(2), self.entry & np.uint16(3)
        state = (self.sure[0] << np.uint16(2)) + self.sure[1] + ((self.said[0] == self.said[1]).view(np.uint8) << np.uint8(4))
        self.state = (self.lane[:live] << 5) + state
        both = self.rate.take(self.state)
        self.two, self.one = both & np.uint32(65_535), both >> np.uint32(16)
        return self.two.astype(_U), (self.two + (((np.uint32(65_536) - self.two) * self.one) >> np.uint32(16))).astype(_U)

    def class_of(self, live: int, value: np.ndarray) -> np.ndarray:
        return (self.inner[:, :live] <= value.astype(np.int16)).view(np.int8).sum(axis=0, dtype=np.int8).astype(np.int64)

    def class_bounds(self, live: int, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of each block's class in 2**_SHARE."""
        at, flat = kind * len(self.lane) + self.lane[:live], self.bounds.ravel()
        low = flat.take(at).astype(np.int64)
        return low, flat.take(at + len(self.lane)) - low

    def learn(self, live: int, own: np.ndarray, kind: np.ndarray, hit: np.ndarray) -> None:
        two, one = self.two.view(np.int32), self.one.view(np.int32)
        two = two + ((hit[0] * np.int32(_TOP) - two) >> 4)
        one = one + (((hit[1] * np.int32(_TOP) - one) * ~hit[0]) >> 4)
        self.rate[self.state] = (two + (one << 16)).view(np.uint32)
        fresh = (np.minimum(own, _NONE).astype(np.uint16) << np.uint16(2)) + np.uint16(1)
        # A hit makes surer; a miss less sure, and a guess that was hardly sure gives way, as most do.
        kept = np.flatnonzero((self.sure > 1) | hit)
        new = np.empty_like(self.entry)
        new[:] = fresh
        right = hit.take(kept)
        new.ravel()[kept] = self.entry.take(kept) + np.where(right, self.sure.take(kept) < 3, -1)
        self.guess[self.at] = new
        # Each bound moves 1/64 of the way to where it would stand if only this class occurred.
        step, inner = self.step[:, :live], self.inner[:, :live]
        np.subtract(kind.astype(np.int16), self.k, out=step)
        step >>= 15  # all bits where the class is below
        step &= self.rise
        step += self.below
        step -= inner
        step >>= 6
        inner += step
        self.prev[1, :live] = self.prev[0, :live]
        self.prev[0, :live] = own


def _lanes(n: int) -> list[int]:
    """Block sizes of n ids, whole blocks first."""
    return [BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else [])


def _turned(grid: np.ndarray) -> np.ndarray:
    """Rows as columns, some at a time, so that what is read and written stays near."""
    out = np.empty(grid.shape[::-1], dtype=grid.dtype)
    for i in range(0, grid.shape[0], 64):
        for j in range(0, grid.shape[1], 64):
            out[j : j + 64, i : i + 64] = grid[i : i + 64, j : j + 64].T
    return out


def encode(ids: np.ndarray) -> tuple[Order0, list[np.ndarray]]:
    """The frequencies of the ids, and the 16-bit digits of each block."""
    sizes, order0 = _lanes(len(ids)), Order0.of(ids)
    lanes = len(sizes)
    grid = np.zeros((lanes, BLOCK), dtype=np.int32)
    grid.ravel()[: len(ids)] = order0.ranks(ids)
    grid = _turned(grid)
    mixer, bits = Mixer(lanes), order0.bits
    low, span = np.zeros(lanes, dtype=_U), np.full(lanes, (1 << 63) - 1, dtype=_U)
    # A block's digits lie one after the other, so that its next one is near the last.
    digits = np.zeros((lanes, 3 * BLOCK + 8), dtype=np.int32)
    flat, at = digits.ravel(), np.arange(lanes, dtype=np.int64) * digits.shape[1]

    def shift(some: np.ndarray) -> None:
        value, place = low[some], at[some]
        flat[place] = value >> _U(47)
        at[some] = place + 1
        low[some] = (value & _KEEP) << _U(16)
        span[some] <<= _U(16)

    for t in range(max(sizes, default=0)):
        live = lanes if t < sizes[-1] else lanes - 1
        own = grid[t, :live]
        two, both = mixer.predict(live)
        of = order0.packed.take(own)
        kind = of & 31
        begin, width = mixer.class_bounds(live, kind)
        unit = span[:live] >> _U(16)
        guessed = unit * both
        part = (span[:live] - guessed) >> _U(_SHARE + bits)
        begin = guessed + part * ((begin << bits) + width * (of >> 32)).view(_U)
        size = part * (width * (of >> 5 & 0x7FFFFFF)).view(_U)
        hit = mixer.said == own
        by2 = hit[0] & (two > 0)
        some = np.flatnonzero(by2)
        begin[some], size[some] = 0, unit[some] * two[some]
        some = np.flatnonzero(hit[1] & ~by2 & (both > two))
        begin[some] = unit[some] * two[some]
        size[some] = guessed[some] - begin[some]
        mixer.learn(live, own, kind, hit)
        low[:live] += begin
        span[:live] = size
        over = np.flatnonzero(low > _FULL)
        if len(over):
            flat[at[over] - 1] += 1
            low[over] &= _FULL
        some = np.flatnonzero(span[:live] < _SHORT)
        while len(some):
            shift(some)
            some = some[span[some] < _SHORT]
    for _ in range(4):
        shift(np.arange(lanes))
    used = at - np.arange(lanes) * digits.shape[1]
    digits = digits[:, : used.max(initial=0)]
    while len(over := np.flatnonzero((digits[:, 1:] >> 16).any(axis=1))):  # carries run to the front
        some = digits[over]
        some[:, :-1] += some[:, 1:] >> 16
        some[:, 1:] &= 0xFFFF
        digits[over] = some
    digits = digits.astype("<u2")
    return order0, [digits[i, :n] for i, n in enumerate(used.tolist())]


def decode(order0: Order0, sizes: list[int], blocks: list[np.ndarray]) -> np.ndarray:
    """The ids of whole blocks and at last one shorter block; any of a segment's blocks will do."""
    lanes, bits = len(sizes), order0.bits
    digits = np.zeros((lanes, max((len(b) for b in blocks), default=0) + 4), dtype=np.uint16)
    for i, b in enumerate(blocks):
        digits[i, : len(b)] = b
    flat, at = digits.ravel(), np.arange(lanes, dtype=np.int64) * digits.shape[1] + 4
    # The first digit lies at bits 47 to 62, as the encoder's shift takes it; a bit of the last one waits.
    head = digits[:, :4].astype(_U).T
    code = (head[0] << _U(47)) + (head[1] << _U(31)) + (head[2] << _U(15)) + (head[3] >> _U(1))
    spare = head[3] & _U(1)
    span = np.full(lanes, (1 << 63) - 1, dtype=_U)
    mixer = Mixer(lanes)
    grid = np.zeros((BLOCK, lanes), dtype=np.int32)
    most = (1 << (_SHARE + bits)) - 1
    for t in range(max(sizes, default=0)):
        live = lanes if t < sizes[-1] else lanes - 1
        two, both = mixer.predict(live)
        now = code[:live]
        unit = span[:live] >> _U(16)
        guessed = unit * both
        part = (span[:live] - guessed) >> _U(_SHARE + bits)
        plain = now >= guessed
        # Negative where a guess was right; what follows from it is then replaced.
        rest, part_ = (now - guessed).view(np.int64), part.view(np.int64)
        value = (rest / part_).astype(np.int64)  # a quotient of doubles, off by one at most
        left = rest - value * part_
        value += (left >= part_).view(np.int8) - (left < 0).view(np.int8)
        value = np.minimum(value, most)
        kind = mixer.class_of(live, value >> bits)
        begin, width = mixer.class_bounds(live, kind)
        begin <<= bits
        # Below 2**53 the floor of a quotient of doubles is exact for such small divisors.
        own = order0.inverse.take(order0.begin.take(kind) + ((value - begin) / width).astype(np.int64), mode="clip").astype(np.int64)
        of = order0.packed.take(own)
        begin = guessed + part * (begin + width * (of >> 32)).view(_U)
        size = part * (width * (of >> 5 & 0x7FFFFFF)).view(_U)
        some = np.flatnonzero(~plain)
        first = unit[some] * two[some]
        by2 = now[some] < first
        begin[some] = np.where(by2, _U(0), first)
        size[some] = np.where(by2, first, guessed[some] - first)
        own[some] = np.where(by2, mixer.said[0][some], mixer.said[1][some])
        kind[some] = order0.kind.take(own[some])
        mixer.learn(live, own, kind, mixer.said == own)
        grid[t, :live] = own
        code[:live] -= begin
        span[:live] = size
        some = np.flatnonzero(span[:live] < _SHORT)
        while len(some):
            place = at[some]
            digit = flat.take(place, mode="clip").astype(_U)
            at[some] = place + 1
            code[some] = (code[some] << _U(16)) + (spare[some] << _U(15)) + (digit >> _U(1))
            spare[some] = digit & _U(1)
            size = span[some] << _U(16)
            span[some] = size
            some = some[size < _SHORT]
    return order0.known.astype(np.uint32).take(_turned(grid).ravel()[: sum(sizes)])


def pack_segment(docs: list, lengths: list[int], ids: np.ndarray) -> bytes:
    order0, blocks = encode(ids)
    sizes = _lanes(len(ids))
    raw = np.ascontiguousarray(ids, dtype="<u4")
    sums = [zlib.crc32(raw[i * BLOCK : i * BLOCK + s]) for i, s in enumerate(sizes)]
    head = zlib.compress(json.dumps({"docs": docs, "lengths": lengths, "known": order0.known.tolist(), "freq": order0.freq.tolist(), "kind": order0.kind.tolist(), "bits": order0.bits, "digits": [len(b) for b in blocks], "sizes": sizes, "crc32": sums}).encode(), 6)
    body = b"".join(b.tobytes() for b in blocks)
    return MAGIC + len(head).to_bytes(8, "little") + len(body).to_bytes(8, "little") + head + body


def _opened(data: bytes) -> tuple[dict, Order0, list[np.ndarray]]:
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    n = int.from_bytes(data[8:16], "little")
    head = json.loads(zlib.decompress(data[24 : 24 + n]))
    digits = np.frombuffer(data, dtype="<u2", offset=24 + n)
    order0 = Order0(*(np.array(head[c], dtype=np.int64) for c in ("known", "freq", "kind")), head["bits"])
    return head, order0, np.split(digits, np.cumsum(head["digits"])[:-1]) if head["digits"] else []


def _check(ids: np.ndarray, sizes: list[int], sums: list[int]) -> np.ndarray:
    at, raw = 0, np.ascontiguousarray(ids, dtype="<u4")
    for size, crc in zip(sizes, sums):
        if zlib.crc32(raw[at : at + size]) != crc:
            raise ValueError("a block of token ids does not match its checksum")
        at += size
    return ids


def open_segment(data: bytes) -> tuple[list, list[int], np.ndarray]:
    head, order0, blocks = _opened(data)
    return head["docs"], head["lengths"], _check(decode(order0, head["sizes"], blocks), head["sizes"], head["crc32"])


def open_block(data: bytes, i: int) -> np.ndarray:
    """The ids of one block of a segment, decoded alone."""
    head, order0, blocks = _opened(data)
    return _check(decode(order0, head["sizes"][i : i + 1], blocks[i : i + 1]), head["sizes"][i : i + 1], head["crc32"][i : i + 1])


def _tasks(spark, most: int, least: int) -> int:
    """As many tasks as bound each one's share, and enough to keep all cores busy where there is work for them."""
    return max(1, most, min(least, 4 * spark.sparkContext.defaultParallelism))


def _groups(batches):
    """The rows of batches of (doc_id, text), some megabytes of text at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + GROUP, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Writes the files in ascending doc_id order; returns the stored manifest, one line per segment."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _tasks(docs.sparkSession, -(-total // PART_BYTES), total >> 22)
    placed = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        ids_of = word_ids(vocabulary or default_vocabulary(), WORDS)
        out = files.Writer(folder, files.own_name("ids", ".ctx"))
        part, lines = TaskContext.get().partitionId(), []
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def flush():
            nonlocal held, size
            data = pack_segment(held[0], held[1], np.concatenate(held[2]))
            lines.append((part, len(lines), out.name, out.write(data), len(data), size))
            held, size = ([], [], []), 0

        for batch in _groups(batches):
            docs = batch.column(0).to_pylist()
            ids, lengths = ids_of.encode_all(common.as_bytes(batch.column(1)))
            ids = np.insert(ids, np.cumsum(lengths), end)
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            at = first = 0
            while at < len(docs):
                to = max(int(np.searchsorted(ends, first + SEGMENT - size, side="right")), at + (not size))
                if to > at:
                    for column, value in zip(held, (docs[at:to], lengths[at:to].tolist(), [ids[first : ends[to - 1]]])):
                        column.extend(value)
                    size += int(ends[to - 1]) - first
                    at, first = to, int(ends[to - 1])
                if at < len(docs):
                    flush()
        if size:
            flush()
        out.close()
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*lines)) or [()] * 6, kinds)], names=["part", "segment", "file", "offset", "length", "n_ids"])

    manifest, _ = common.store(placed.mapInArrow(run, "part int, segment int, file string, offset long, length long, n_ids long"), "manifest")
    return manifest


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) of every document in the files."""
    # The running total goes over groups of parts, then parts of a group, then lines of a part.
    part = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("some", F.floor(F.sqrt("part")))
    some = part.groupBy("some").agg(F.sum("n").alias("all"))
    ahead = lambda n, by: F.sum(n).over(by) - F.col(n)
    before = some.select("some", ahead("all", Window.orderBy("some")).alias("of_some"))  # a row for a few thousand parts
    parts = part.withColumn("of_part", ahead("n", Window.partitionBy("some").orderBy("part"))).join(before, "some").select("part", (F.col("of_some") + F.col("of_part")).alias("of_part"))
    base = manifest.withColumn("of_line", ahead("n_ids", Window.partitionBy("part").orderBy("segment"))).join(parts, "part").withColumn("base", F.col("of_part") + F.col("of_line"))

    def run(batches):
        source = files.Reader(folder)
        for batch in batches:
            for name, offset, length, first in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "base"))):
                docs, lengths, ids = open_segment(source.read(name, offset, length))
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - lengths + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        source.close()

    size = manifest.agg(F.count("*"), F.sum("n_ids")).first()
    tasks = _tasks(manifest.sparkSession, -(-(size[1] or 0) // PART_IDS), size[0])
    return base.repartition(tasks, "file", "segment").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    folder = common.new_path(docs.sparkSession, "ids")
    return read(write(docs, folder, vocabulary, end), folder)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
