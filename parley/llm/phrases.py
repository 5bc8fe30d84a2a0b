"""Phrase collocation mining by direct-address tiling, level by level.

Texts are cut into pieces and words. Words of a language that occur MIN_COUNT times or more get ids in order of their
frequency; every other word, and the end of a piece, breaks the id sequence (a phrase that occurs often enough has only
such words). Neighbouring ids are pairs. The plane of pairs is cut into tiles of SIDE x SIDE: as ids are ranked, a few
tiles hold most pairs, and these are counted by direct address, in dense arrays with numpy's bincount. Pairs of the other
tiles are counted as sorted coordinates (COO). Each task counts its own pairs first, Spark adds the counts up. Frequent
pairs are ranked again and become the ids of the next level, whose neighbours share a word: so level k holds the phrases of
k words. Frequent words and pairs go along to the tasks while they number at most KNOWN; beyond that Spark joins them.

Each phrase keeps the counts of its first and of its last words, so cuts need no further counts. A phrase that is held by a
longer one of nearly its count is also held by one a word longer, so that one level suffices to find it.

Defined results: null texts and texts without words have none; a null language is `und`; repeated rows count each; scores
of equal value are ordered by count, then by the phrase's bytes; an empty table gives no phrases; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_COUNT, LONGEST, TOP, HELD = 100, 5, 2000, 100
#: Side of a tile; a chunk's share of a tile's cells from which the tile is counted densely; dense tiles that a task keeps.
SIDE, DENSE, TILES = 1024, 16, 12
#: Frequent words or pairs up to which a task holds them all (some 60 MB); pairs that are counted in one go.
KNOWN, CHUNK = 400_000, 1 << 20
_KEPT_COO = 2_000_000
_BREAK = b"\xff"  # stands in no UTF-8 text
#: A to Z in lower case, a tab as a space, signs that end a piece as the break.
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else ord(chr(b).lower()) if b < 128 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words, and a break between pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split(b" ")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n); the row with a null word holds the language's occurrences of all words."""

    def run(batches):
        tally: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for part in common.slices([batch], 500):
                for lang, text in zip(part.column("lang").to_pylist(), common.as_bytes(part.column("text"))):
                    tally[lang].update(words_of(text))
                if sum(map(len, tally.values())) > 300_000:
                    yield from _counted(tally)
                    tally.clear()
        yield from _counted(tally)

    return _rows(docs).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(tally: dict[str, Counter]):
    for lang, counts in tally.items():
        counts.pop(_BREAK, None)
        counts.pop(b"", None)
        words, values = list(counts), list(counts.values())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) + 1), pa.string()), pa.array([*words, None], pa.binary()), pa.array([*values, sum(values)], pa.int64())], names=["lang", "word", "n"])


def ranked(counts: DataFrame, name: str) -> DataFrame:
    """Stored with an id: 0 for the most frequent row, and on without gaps (ties in the order of the other columns).

    Rows are sorted by Spark in ranges; the ranges' sizes give every range its first id.
    """
    keys = [c for c in counts.columns if c in ("lang", "word", "l", "r")]
    in_order, _ = common.store(counts.orderBy(F.desc("n"), *keys).withColumn("part", F.spark_partition_id()), f"{name}_sorted")
    sizes = {r["part"]: r["count"] for r in in_order.groupBy("part").count().collect()}  # one row a range
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    first = in_order.sparkSession.createDataFrame(starts, "part int, start long")
    own = Window.partitionBy("part").orderBy(F.desc("n"), *keys)
    out = in_order.join(F.broadcast(first), "part").withColumn("id", F.col("start") + F.row_number().over(own) - 1).drop("part", "start")
    return common.store(out, name)[0]


def encode(docs: DataFrame, vocabulary: DataFrame, known: int = KNOWN) -> DataFrame:
    """(ids): every text as word ids, -1 for a break or a rarer word."""
    if vocabulary.count() <= known:
        held: dict[str, dict[bytes, int]] = defaultdict(dict)
        listed = vocabulary.select("lang", "word", "id").toArrow()  # at most `known` rows
        for lang, word, at in zip(*(listed.column(i).to_pylist() for i in range(3))):
            held[lang][word] = at
        shared = docs.sparkSession.sparkContext.broadcast(dict(held))

        def run(batches):
            for batch in common.slices(batches, 500):
                out = []
                for lang, text in zip(batch.column("lang").to_pylist(), common.as_bytes(batch.column("text"))):
                    ids = shared.value.get(lang, {})
                    words = [w for w in words_of(text) if w]
                    out.append(np.fromiter((ids.get(w, -1) for w in words), dtype=np.int64, count=len(words)))
                yield _listed(out)

        return _rows(docs).mapInArrow(run, "ids array<long>")

    def spread(batches):
        for at, batch in enumerate(common.slices(batches, 50)):
            for j, (row, lang, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), common.as_bytes(batch.column("text")))):
                words = [w for w in words_of(text) if w]
                for a in range(0, len(words), 50_000):
                    part = words[a : a + 50_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([lang] * n), pa.array(range(a, a + n), pa.int64()), pa.array(part, pa.binary())], names=["row", "lang", "at", "word"])

    rows, _ = common.store(_rows(docs).withColumn("row", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())), "rows_of_texts")
    placed = rows.mapInArrow(spread, "row string, lang string, at long, word binary").join(vocabulary.select("lang", "word", "id"), ["lang", "word"], "left")
    return placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("ids")).select("ids")


def _listed(arrays: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))], names=["ids"])


class Tiles:
    """Counts of pairs of ids: dense tiles by bincount, other pairs as sorted coordinates."""

    def __init__(self, side: int = SIDE, dense: int = DENSE, tiles: int = TILES):
        self.side, self.least, self.limit = side, max(1, side * side // dense), tiles
        self.dense: dict[int, np.ndarray] = {}
        self.coo: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        side = self.side
        tile = (left // side << 32) | (right // side)
        local = (left % side) * side + right % side
        names, inverse, sizes = np.unique(tile, return_inverse=True, return_counts=True)
        for i in np.argsort(-sizes, kind="stable").tolist():
            name = int(names[i])
            if name not in self.dense:
                if sizes[i] < self.least or len(self.dense) >= self.limit:
                    continue
                self.dense[name] = np.zeros(side * side, dtype=np.int64)
            self.dense[name] += np.bincount(local[inverse == i], minlength=side * side)
        rest = ~np.isin(names, list(self.dense))[inverse] if self.dense else slice(None)
        codes, counts = np.unique((left[rest] << 32) | right[rest], return_counts=True)
        self.coo.append((codes, counts))
        self.size += len(codes)
        if self.size > _KEPT_COO:
            self.merge()

    def merge(self) -> None:
        if self.coo:
            codes, where = np.unique(np.concatenate([c for c, _ in self.coo]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([n for _, n in self.coo]), minlength=len(codes)).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
            self.coo, self.size = [(codes, counts)], len(codes)

    def take_coo(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.merge()
        codes, counts = self.coo[0] if self.coo else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.coo, self.size = [], 0
        return codes >> 32, codes & 0xFFFFFFFF, counts

    def take_dense(self):
        for name, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield (name >> 32) * self.side + at // self.side, (name & 0xFFFFFFFF) * self.side + at % self.side, cells[at]
        self.dense = {}


def count_pairs(sequences: DataFrame) -> DataFrame:
    """(l, r, n) of neighbouring ids; ids stay below 2**31."""

    def run(batches):
        tiles, held, size = Tiles(), [], 0

        def count():
            ids = np.concatenate(held)
            good = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            tiles.add(ids[good], ids[good + 1])

        for batch in common.slices(batches, 2000):
            column = batch.column("ids")
            flat = column.flatten().to_numpy()
            lengths = np.diff(column.offsets.to_numpy())
            # A break behind every sequence.
            ids = np.insert(flat, np.cumsum(lengths), -1) if len(lengths) else flat
            held.append(ids)
            size += len(ids)
            if size > CHUNK:
                count()
                held, size = [], 0
                if tiles.size > _KEPT_COO // 2:
                    yield from _pairs(*tiles.take_coo())
        if held:
            count()
        yield from _pairs(*tiles.take_coo())
        for part in tiles.take_dense():
            yield from _pairs(*part)

    return sequences.mapInArrow(run, "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def _pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray):
    for a in range(0, len(left), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (left, right, n)], names=["l", "r", "n"])


def climb(sequences: DataFrame, frequent: DataFrame, known: int = KNOWN) -> DataFrame:
    """(ids): the sequences of the next level; place i holds the id of the pair of ids i and i + 1, or -1."""
    if frequent.count() <= known:
        listed = frequent.select(F.shiftleft("l", 32).bitwiseOR(F.col("r")).alias("code"), "id").orderBy("code").toArrow()  # at most `known` rows
        shared = sequences.sparkSession.sparkContext.broadcast([listed.column(i).to_numpy() for i in range(2)])

        def run(batches):
            codes, ids = shared.value
            for batch in common.slices(batches, 2000):
                column = batch.column("ids")
                flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
                out = np.full(len(flat), -1, dtype=np.int64)
                last = np.zeros(len(flat) + 1, dtype=bool)
                last[offsets[1:] - 1] = True  # the last place of a sequence has no right neighbour (an empty one marks a last place again, or the spare one)
                good = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0) & ~last[: max(0, len(flat) - 1)])
                want = (flat[good] << 32) | flat[good + 1]
                at = np.minimum(np.searchsorted(codes, want), max(0, len(codes) - 1))
                hit = codes[at] == want if len(codes) else np.zeros(len(want), dtype=bool)
                out[good[hit]] = ids[at[hit]]
                # Runs of breaks tell no more than one does.
                keep = (out >= 0) | (np.concatenate(([0], out[:-1])) >= 0)
                sizes = np.add.reduceat(np.concatenate((keep, [False])).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if len(offsets) > 1 else np.zeros(0, np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(out[keep]))], names=["ids"])

        return sequences.mapInArrow(run, "ids array<long>")

    pairs = F.transform(F.sequence(F.lit(0), F.size("ids") - 2), lambda i: F.struct(i.alias("at"), F.get("ids", i).alias("l"), F.get("ids", i + 1).alias("r")))
    stored, _ = common.store(sequences.where(F.size("ids") > 1).withColumn("row", F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())), "rows_of_ids")
    placed = stored.select("row", F.explode(pairs).alias("p")).select("row", "p.*").join(frequent.select("l", "r", "id"), ["l", "r"], "left")
    return placed.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(-1)).alias("id")))), lambda x: x["id"]).alias("ids")).select("ids")


def mine(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, held: int = HELD, known: int = KNOWN) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, dropped) of all phrases of 2 to `longest` words that occur `least` times."""
    counts, _ = common.store(count_words(docs).where((F.col("n") >= least) | F.col("word").isNull()), "word_counts")
    totals = counts.where("word IS NULL").select("lang", F.col("n").alias("total"))
    vocabulary = ranked(counts.where((F.col("n") >= least) & F.col("word").isNotNull()), "vocabulary")
    sequences, path = common.store(encode(docs, vocabulary, known), "sequences")
    # first: counts of the first 1, 2, .. words; last: of the last k, k - 1, .. words.
    level = vocabulary.select("id", "lang", F.array(F.col("word").cast("string")).alias("words"), F.array("n").alias("first"), F.array("n").alias("last"), F.col("n").alias("a"))
    candidates, gone = None, None
    for size in range(2, longest + 1):
        frequent = ranked(count_pairs(sequences).where(F.col("n") >= least), f"pairs{size}")
        left = level.select(F.col("id").alias("l"), "lang", F.col("words").alias("lw"), F.col("first").alias("lf"), F.col("a").alias("la"))
        right = level.select(F.col("id").alias("r"), F.element_at("words", -1).alias("rw"), F.col("last").alias("rl"), F.col("a").alias("ra"))
        joined = frequent.join(left, "l").join(right, "r")
        level, _ = common.store(joined.select("id", "lang", F.concat("lw", F.array("rw")).alias("words"), F.concat("lf", F.array("n")).alias("first"), F.concat(F.array("n"), "rl").alias("last"), F.col("n").alias("a"), "l", "r", "la", "ra"), f"phrases{size}")
        if size > 2:
            near = lambda side: level.where(100 * F.col("a") >= held * F.col(f"{side}a")).select(F.lit(size - 1).alias("size"), F.col(side).alias("id"))
            found = near("l").union(near("r"))
            gone = found if gone is None else gone.union(found)
        now = level.select(F.lit(size).alias("size"), "id", "lang", "words", "first", "last", "a")
        candidates = now if candidates is None else candidates.union(now)
        if size < longest:
            above, new = common.store(climb(sequences, frequent, known), f"sequences{size}")
            common.drop(docs.sparkSession, path)
            sequences, path = above, new
    common.drop(docs.sparkSession, path)
    if gone is not None:
        candidates = candidates.join(gone.distinct().withColumn("dropped", F.lit(True)), ["size", "id"], "left")
    else:
        candidates = candidates.withColumn("dropped", F.lit(None).cast("boolean"))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), _cut))
    scored = candidates.join(F.broadcast(totals), "lang").withColumn("best", best)  # a row a language
    return scored.select("lang", F.array_join("words", " ").alias("phrase"), "words", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def _cut(k):
    """The score of a cut after k words, exact: products have up to 38 digits."""
    l, r = F.get("first", k - 1), F.get("last", k)  # noqa: E741
    wide = lambda c: c.cast("decimal(16,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("a")) * wide(F.col("total")), wide(l) * wide(r))
    return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))


def top(mined: DataFrame, limit: int = TOP) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = mined.where(~F.col("dropped"))
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
