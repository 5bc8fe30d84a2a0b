"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are the runs of letters and digits of the lower-cased text; characters beyond ASCII count as letters, but for general
and East Asian punctuation and spaces. In scripts that are written without spaces (SOLO) every character is a word. Every n-gram
of an item is a seed, named by a 64-bit hash. One scan of the corpus gives the places of the seeds in every document;
where the benchmark's seeds take no more than FILTER_BYTES they go along as a filter (and once more, the rare ones, to cut
out the words around them), a larger benchmark meets all n-grams of the corpus in the shuffle. Spark counts in how many rows a seed stands, and an item keeps the seeds that are rare for
it (at most FACTOR times the median of its seeds' counts, or FLOOR): a phrase that is common everywhere does not
name a passage, while the seeds of an item that leaked into very many documents stay. If an item had only common seeds,
its median would be as common, so every item keeps at least half of its seeds. Rare seeds are joined with their places;
places of an item in a document that lie near each other make one passage, which is aligned locally with the item's
words (+2 match, -1 mismatch, -1 gap). The score is a share of the best possible one; a hit needs THRESHOLD of it, and of
short items a share worth EVIDENCE words (a character of SOLO counting half a word, and STRICT at most), as a few words in
common say little.

Defined results: null or empty texts and empty benchmark items match nothing; equal scores go to the smallest item_id,
then the earliest passage; an item shorter than the n-gram has its whole word sequence as its one seed; repeated rows
keep a row each; an empty benchmark or corpus gives no contamination; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

N = 3
THRESHOLD, EVIDENCE, STRICT = 0.33, 5.5, 0.95
FLOOR, FACTOR = 20, 20
#: Bytes of seeds (8 each) up to which they are sent to every task as a filter.
FILTER_BYTES = 64 << 20
_SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Blocks of characters that stand between words, and of scripts written without spaces, by first and last code point.
BETWEEN = ((0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
SOLO = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
#: Bytes of text that are hashed in one go.
_CHUNK = 2 << 20
_BASE = 0xE7037ED1A0B428DB


def _within(codes: np.ndarray, blocks) -> np.ndarray:
    out = np.zeros(len(codes), dtype=bool)
    for first, last in blocks:
        out |= (codes >= first) & (codes <= last)
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of UTF-8 text."""
    lead = np.flatnonzero(data >= 0xE0)  # characters of three or four bytes; shorter ones are in neither list of blocks
    lead = lead[lead < len(data) - 2]
    if not len(lead):
        return common.word_spans(data, _SIGNS)
    four = (data[lead] >= 0xF0) & (lead < len(data) - 3)
    bits = [data[lead + i].astype(np.int64) & 0x3F for i in (1, 2)]
    last = data[np.minimum(lead + 3, len(data) - 1)].astype(np.int64) & 0x3F
    codes = np.where(four, ((((data[lead].astype(np.int64) & 7) << 6 | bits[0]) << 6 | bits[1]) << 6) | last, ((data[lead].astype(np.int64) & 0xF) << 6 | bits[0]) << 6 | bits[1])
    # Bytes of one word carry one mark; neighbouring words of one character carry 2 and 3 in turn.
    mark = np.where(_SIGNS[data], 0, 1).astype(np.int8)
    between, solo = _within(codes, BETWEEN), _within(codes, SOLO)
    turn = (2 + np.arange(len(lead)) % 2).astype(np.int8)
    for i in range(4):
        here = (between | solo) & ((i < 3) | four)
        mark[lead[here] + i] = np.where(solo, turn, 0)[here]
    edge = np.flatnonzero(np.diff(mark, prepend=0, append=0))
    start, end = edge[:-1], edge[1:]
    words = mark[start] > 0
    return start[words], end[words]


def word_codes(text: str) -> tuple[np.ndarray, float]:
    """A 64-bit hash of every word of a text, in order, and how many words they are worth."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    start, end = word_spans(data)
    alone = sum(_within(np.array([ord(c)]), SOLO)[0] for c in text if ord(c) >= 0x0E00)
    return common.word_hashes(data, start, end), len(start) - alone / 2


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    return common.rolling(codes, n, _BASE).view(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best Smith-Waterman score (match 2, mismatch -1, gap -1), a row of the matrix at a time."""
    best, row = 0, np.zeros(len(passage) + 1, dtype=np.int32)
    steps = np.arange(len(passage) + 1, dtype=np.int32)
    for w in item:
        reach = np.maximum(row[:-1] + np.where(passage == w, 2, -1), row[1:] - 1)
        full = np.concatenate(([0], np.maximum(reach, 0))).astype(np.int32)
        row = np.maximum(np.maximum.accumulate(full + steps) - steps, 0)
        best = max(best, int(row.max()))
    return best


def items_of(benchmark: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, words, seeds, needed): word hashes, distinct seed hashes and the score that counts, of every item that has words.

    Shorter items take one seed of their own length, so `sizes` of seeds may be 1 to n.
    """

    def run(batches):
        for batch in batches:
            found = [word_codes(t or "") for t in batch.column(1).to_pylist()]
            words, needed = [w for w, _ in found], [min(max(threshold, STRICT), max(threshold, EVIDENCE / max(worth, 1.0))) for _, worth in found]
            seeds = [np.unique(grams(w, min(n, max(1, len(w))))).tolist() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.view(np.int64).tolist() for w in words], pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64())), pa.array(needed, pa.float64())], names=["item_id", "words", "seeds", "needed"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id long, words array<long>, seeds array<long>, needed double").where(F.size("words") > 0)


class Seeds:
    """Finds n-grams in texts: those of `known`, or all of them."""

    def __init__(self, sizes: list[int], known: np.ndarray | None):
        self.sizes, self.known = sizes, known
        if known is not None:
            self.known = np.unique(known)
            self.bits = np.zeros(1 << 20, dtype=bool)
            self.bits[known & (len(self.bits) - 1)] = True

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Some neighbouring texts, hashed in one go: their word hashes, the first word of each text (and the end), and
        for all n-grams found the text, the hash and the place among all words."""
        data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        start, end = word_spans(data)
        codes = common.word_hashes(data, start, end)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        row = np.searchsorted(begin, start, "right") - 1
        out: list[list[np.ndarray]] = [[], [], []]
        for size in self.sizes:
            found = grams(codes, size)
            at = np.flatnonzero(row[: len(found)] == row[size - 1 :]) if len(found) else np.zeros(0, dtype=np.int64)
            if self.known is not None:
                at = at[self.bits[found[at] & (len(self.bits) - 1)]]
                near = np.minimum(np.searchsorted(self.known, found[at]), max(0, len(self.known) - 1))
                at = at[self.known[near] == found[at]] if len(self.known) else at[:0]
            for column, value in zip(out, (row[at], found[at], at)):
                column.append(value)
        return codes, np.searchsorted(start, begin), [np.concatenate(c) for c in out]


def _chunks(batch: pa.RecordBatch):
    """(number of the first row, lower-cased texts) of neighbouring rows, some _CHUNK bytes at a time."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column("text").to_pylist()):
        held.append((text or "").lower().encode("utf-8", "replace"))
        size += len(held[-1])
        if size > _CHUNK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def places_of(rows: DataFrame, kind: str, seeds: Seeds) -> DataFrame:
    """(doc_id, tkey, seed, at): where the n-grams stand in every row; at counts words."""

    def run(batches):
        for batch in batches:
            for first, texts in _chunks(batch):
                _, begin, (row, seed, at) = seeds.find(texts)
                of = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(seed), pa.array(at - begin[row])], names=["doc_id", "tkey", "seed", "at"])

    return rows.mapInArrow(run, f"doc_id {kind}, tkey long, seed long, at long")


def stretches_of(rows: DataFrame, kind: str, seeds: Seeds, around: int) -> DataFrame:
    """(doc_id, tkey, first, stretch): the word hashes of every row within `around` words of a seed; overlapping stretches are one."""

    def run(batches):
        for batch in batches:
            for first, texts in _chunks(batch):
                codes, begin, (row, _, at) = seeds.find(texts)
                order = np.argsort(at, kind="stable")
                row, at = row[order], at[order]
                lo, hi = np.maximum(at - around, begin[row]), np.minimum(at + around + 1, begin[row + 1])
                # Places come in order, so a stretch ends where the next begins beyond its end.
                cut = np.flatnonzero((row[1:] != row[:-1]) | (lo[1:] > hi[:-1])) + 1 if len(at) else np.zeros(0, dtype=np.int64)
                heads, tails = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])) - 1
                if not len(at):
                    continue
                for some in np.array_split(np.arange(len(heads)), 1 + len(heads) // 5000):
                    of, a, b = row[heads[some]], lo[heads[some]], hi[tails[some]]
                    words = [codes[x:y].view(np.int64) for x, y in zip(a.tolist(), b.tolist())]
                    offsets = pa.array(np.concatenate(([0], np.cumsum(b - a))).astype(np.int32))
                    at_row = pa.array(of + first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at_row), batch.column(1).take(at_row), pa.array(a - begin[of]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(words)))], names=["doc_id", "tkey", "first", "stretch"])

    return rows.mapInArrow(run, f"doc_id {kind}, tkey long, first long, stretch array<long>")


def scores(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, tkey, item_id, score, start_word, end_word) of the best item of every row that reaches the threshold."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", common.text_key(F.col("text")).alias("tkey"), "text")
    items, _ = common.store(items_of(benchmark, n, threshold), "items")
    seeds = items.select("item_id", F.explode("seeds").alias("seed"))
    sizes = sorted({n, *(r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < n).distinct().collect())})  # at most n values
    few = seeds.select("seed").distinct()
    bounded = few.count() * 8 <= filter_bytes
    listed = lambda df: df.toArrow().column("seed").to_numpy()  # noqa: E731  (only where bounded; eight bytes a seed)
    # Equal rows have equal places, which count once.
    places, _ = common.store(places_of(rows, kind, Seeds(sizes, listed(few) if bounded else None)), "places")
    held = places.select("doc_id", "tkey", "seed").distinct().groupBy("seed").agg(F.count("*").alias("rows"))
    counted = seeds.join(held, "seed", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    usual = counted.groupBy("item_id").agg(F.median("rows").alias("usual"))
    rare, _ = common.store(counted.join(usual, "item_id").where(F.col("rows") <= F.greatest(F.lit(float(FLOOR)), FACTOR * F.col("usual"))).select("seed", "item_id"), "rare_seeds")
    length = items.select("item_id", F.size("words").alias("length"))
    hits = places.distinct().join(rare, "seed").join(length, "item_id").select("doc_id", "tkey", "item_id", "at", (F.col("length") + F.floor(F.col("length") / 2) + n).cast("int").alias("around"))
    # Places further apart than an item and a half start another passage.
    in_order = Window.partitionBy("doc_id", "tkey", "item_id").orderBy("at")
    cut = hits.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(in_order) > F.col("around"), F.lit(True)).cast("int")).withColumn("no", F.sum("new").over(in_order))
    passages = cut.groupBy("doc_id", "tkey", "item_id", "no").agg(F.greatest(F.min("at") - F.first("around"), F.lit(0)).alias("a"), (F.max("at") + F.first("around")).alias("b"), F.count("*").alias("seeds"))
    passages, _ = common.store(passages.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "item_id", "a", "b"), "passages")
    around = items.select(F.max(F.size("words"))).first()[0] or 0
    if bounded:
        # The texts stay where they are: a second scan with the rare seeds as filter sends what lies around them.
        near = stretches_of(rows, kind, Seeds(sizes, listed(rare.select("seed").distinct())), 2 * around + n)
    else:
        wanted = passages.select(F.col("d").alias("doc_id"), F.col("t").alias("tkey")).distinct()
        near = stretches_of(rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["tkey"] == wanted["tkey"]), "left_semi"), kind, Seeds(sizes, None), n)
    near, _ = common.store(near, "stretches")
    met = near.distinct().join(passages, near["doc_id"].eqNullSafe(F.col("d")) & (near["tkey"] == F.col("t")) & (F.col("a") < F.col("first") + F.size("stretch")) & (F.col("b") > F.col("first")))
    lo, hi = F.greatest("a", "first"), F.least(F.col("b"), F.col("first") + F.size("stretch"))
    pairs = met.select("doc_id", "tkey", "item_id", lo.alias("start_word"), hi.alias("end_word"), F.slice("stretch", (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int")).alias("passage")).join(items.select("item_id", "words", "needed"), "item_id")

    def score(batches):
        for batch in batches:
            item, passage, needed = batch.column("words"), batch.column("passage"), batch.column("needed").to_pylist()
            found = [_share(item[i].values.to_numpy(), passage[i].values.to_numpy(), needed[i]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "tkey", "item_id", "start_word", "end_word")), pa.array(found, pa.float64())], names=["doc_id", "tkey", "item_id", "start_word", "end_word", "score"])

    scored = pairs.select("doc_id", "tkey", "item_id", "start_word", "end_word", "words", "passage", "needed").mapInArrow(score, f"doc_id {kind}, tkey long, item_id long, start_word long, end_word long, score double").where("score > 0")
    best = F.max_by(F.struct("item_id", "score", "start_word", "end_word"), F.struct("score", -F.col("item_id"), -F.col("start_word")))
    return scored.groupBy("doc_id", "tkey").agg(best.alias("m")).select("doc_id", "tkey", "m.*")


def _share(item: np.ndarray, passage: np.ndarray, needed: float) -> float:
    """The alignment's share of the item's best score; 0 where it is less than needed."""
    if np.isin(item, passage).sum() < needed * len(item):
        return 0.0
    share = align(item, passage) / (2 * len(item))
    return share if share >= needed else 0.0


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, contaminated, item_id and score (null where none)."""
    found = scores(docs, benchmark, **how)
    rows = docs.select("doc_id", common.text_key(F.col("text")).alias("tkey"))
    hit = found.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "item_id", F.round("score", 6).alias("score"), "start_word", "end_word")
    return rows.join(hit, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["tkey"] == F.col("t")), "left").select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "score", "start_word", "end_word")


def keep_clean(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that match no item."""
    return common.matched(docs, found, "left_anti")
