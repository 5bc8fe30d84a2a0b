"""Substring dedup: every window of 20 words whose sequence also starts earlier in the corpus is removed.

Rabin-Karp hashes are taken of every window. To shuffle few of them, each window names one short run inside it, the one
of RUN words with the smallest hash (equal windows name equal runs, and neighbouring windows mostly the same one). Spark
counts the runs; only windows whose run occurs at least twice can repeat. The windows that name one run form a stretch.
First whole stretches are counted by their 128-bit hashes (two independent ones of every word, combined in order): a stretch that also starts earlier goes whole. What is left,
stretches that are the first of their kind, is counted window by window where their run has other stretches too (every
window's first place lies in one of these). Later windows are covered, and covers merge into maximal intervals.

Defined results: null and empty texts have no words; a text of fewer than 20 words has no window; of rows with equal
doc_id and equal text neither starts earlier, so both stay (they are digested alike); a null doc_id comes before all
others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, RUN = 20, 8
_B1, _B2, _B3 = 0xB5026F5AA96619E9, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


def chosen_runs(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of words, and for each window the place of the run it names (the first of equals)."""
    runs = common.rolling(hashes, run, _B3)
    span = window - run + 1
    if len(runs) < span:
        return runs, np.zeros(0, dtype=np.int64)
    return runs, np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1) + np.arange(len(runs) - span + 1)


def _hashes(text: bytes, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each seed the hash of every word; two seeds make 128 bits."""
    data = np.frombuffer(text, dtype=np.uint8)
    start, end = common.word_spans(data)
    return [common.word_hashes(data, start, end, seed) for seed in seeds]


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def removed(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(whole, cut): word count and digest of every row as it stands, and of the rows that lose words the kept text.

    whole: rid (a row's own number), doc_id, n_words, sha256. cut: rid, n_removed, spans (start and end word of each
    removal interval), kept_text, kept_sha256.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", common.text_key(F.col("text")).alias("tkey"), "text")

    def survey(batches):
        """One row per document: its count and digest, and the distinct runs that its windows name, with how often."""
        for batch in batches:
            n, sha, runs, times = [], [], [], []
            for text in common.as_bytes(batch.column("text")):
                words = text.split()
                n.append(len(words))
                sha.append(_digest(words))
                if len(words) < window:
                    runs.append(np.zeros(0, dtype=np.int64))
                    times.append(runs[-1])
                    continue
                hashes, place = chosen_runs(_hashes(text)[0], window, run)
                value, count = np.unique(hashes[np.unique(place)].view(np.int64), return_counts=True)
                runs.append(value)
                times.append(count)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.zeros(0, dtype=np.int64)]))) for x in (runs, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), *lists], names=["doc_id", "tkey", "n_words", "sha256", "runs", "times"])

    plain = rows.mapInArrow(survey, f"doc_id {kind}, tkey long, n_words long, sha256 string, runs array<long>, times array<long>")
    surveyed, _ = common.store(plain.withColumn("rid", F.monotonically_increasing_id()), "survey")
    repeated = not surveyed.groupBy("doc_id", "tkey").count().where("count > 1").isEmpty()
    if repeated:  # rows with the same doc_id and text share one number, and one of them is looked at
        same = surveyed.groupBy(F.col("doc_id").alias("d"), F.col("tkey").alias("t")).agg(F.min("rid").alias("least"))
        surveyed = surveyed.join(same, surveyed["doc_id"].eqNullSafe(F.col("d")) & (surveyed["tkey"] == F.col("t"))).withColumn("own", F.col("rid") == F.col("least")).withColumn("rid", F.col("least")).drop("d", "t", "least")
    else:
        surveyed = surveyed.withColumn("own", F.lit(True))
    named = surveyed.where("own").select("rid", F.explode(F.arrays_zip("runs", "times")).alias("r")).select("rid", F.col("r.runs").alias("run"), F.col("r.times").alias("times"))
    # Written and read again, so that the join deals out both sides and a run with very many rows can be split.
    twice, twice_path = common.store(named.groupBy("run").agg(F.sum("times").alias("n")).where("n > 1").select(F.col("run").alias("twice")), "twice")
    suspects = named.select("rid", "run").join(twice, F.col("run") == F.col("twice")).groupBy("rid").agg(F.collect_list("run").alias("twice"))
    suspects, suspects_path = common.store(suspects.join(surveyed.where("own").select("rid", F.col("doc_id").alias("d"), F.col("tkey").alias("t")), "rid"), "suspects")
    found = rows.join(suspects, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["tkey"] == F.col("t"))).select("rid", "doc_id", "text", "twice")
    candidates, _ = common.store(found.dropDuplicates(["rid"]) if repeated else found, "candidates")
    common.drop(spark, suspects_path, twice_path)

    def stretches(batches):
        """A row for each stretch of windows that name one place of a run that occurs twice."""
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for at, (text, twice) in enumerate(zip(common.as_bytes(batch.column("text")), batch.column("twice"))):
                words = _hashes(text, (0, 1))
                runs, place = chosen_runs(words[0], window, run)
                edge = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
                start, end = edge[:-1], edge[1:]
                key = runs[place[start]].view(np.int64)
                hit = np.isin(key, twice.values.to_numpy(zero_copy_only=False))
                start, end = start[hit], end[hit]
                g = [common.span_hashes(w, start, end + window - 1, b).view(np.int64) for w, b in zip(words, (_B1, _B2))]
                for column, value in zip(out, (np.full(len(start), at), key[hit], start, end - start, *g)):
                    column.append(value)
            yield _gathered(batch, out, ["run", "at", "n", "h1", "h2"])

    found = candidates.mapInArrow(stretches, f"rid long, doc_id {kind}, run long, at long, n long, h1 long, h2 long")
    marked, _ = common.store(_mark_later(found), "stretches")
    shared = marked.where("not later").groupBy("run").agg(F.count("*").alias("c")).where("c > 1").select(F.col("run").alias("shared"))
    open_stretches = marked.where("not later").select("rid", "run", "at", "n").join(shared, F.col("run") == F.col("shared")).groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    texts = candidates.select("rid", "doc_id", "text")

    def windows(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for at, (text, spans) in enumerate(zip(common.as_bytes(batch.column("text")), batch.column("spans"))):
                words = _hashes(text, (0, 1))
                begin, count = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n"))
                hit = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                for column, value in zip(out, (np.full(len(hit), at), hit, *(common.rolling(w, window, b)[hit].view(np.int64) for w, b in zip(words, (_B1, _B2))))):
                    column.append(value)
            yield _gathered(batch, out, ["at", "h1", "h2"])

    single = texts.join(open_stretches, F.col("rid") == F.col("r")).select("rid", "doc_id", "text", "spans").mapInArrow(windows, f"rid long, doc_id {kind}, at long, h1 long, h2 long")
    later, _ = common.store(_mark_later(single).where("later").select("rid", "at", F.lit(1).cast("long").alias("n")), "windows")
    lost = marked.where("later").select("rid", "at", "n").unionByName(later).groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text, spans in zip(common.as_bytes(batch.column("text")), batch.column("spans")):
                words = text.split()
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                begin, count = (spans.values.field(f).to_numpy(zero_copy_only=False) for f in ("at", "n"))
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + count + window - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                for column, value in zip(out, (int(gone.sum()), edge.tolist(), b" ".join(kept).decode(), _digest(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())))], names=["rid", "n_removed", "spans", "kept_text", "kept_sha256"])

    done = texts.join(lost, F.col("rid") == F.col("r")).select("rid", "text", "spans").mapInArrow(cut, "rid long, n_removed long, spans array<long>, kept_text string, kept_sha256 string")
    return surveyed.select("rid", "doc_id", "n_words", "sha256"), done


def _gathered(batch: pa.RecordBatch, out: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    """One batch of findings: rid and doc_id of the rows in out[0], and the other columns."""
    flat = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, dtype=np.int64)) for c in out]
    return pa.RecordBatch.from_arrays([batch.column("rid").take(flat[0]), batch.column("doc_id").take(flat[0]), *flat[1:]], names=["rid", "doc_id", *names])


def _mark_later(found: DataFrame) -> DataFrame:
    """Adds `later`: the same hashes also start earlier (smaller doc_id, or the same document and an earlier word)."""
    found, _ = common.store(found, "found")
    known = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "at")
    first = found.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written and read again: see `twice`.
    first, _ = common.store(first, "first")
    joined = found.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return joined.withColumn("later", F.coalesce(known > F.col("first"), F.lit(False))).drop("h1", "h2", "g1", "g2", "first")


def digest(whole: DataFrame, cut: DataFrame) -> DataFrame:
    lost = cut.select(F.col("rid").alias("r"), "n_removed", F.col("kept_sha256").alias("kept"))
    joined = whole.join(lost, F.col("rid") == F.col("r"), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha256").alias("kept_sha256"))
