"""Ranked lexical search: a stated set of queries against all documents, by dense blocked matrix multiplication.

One pass over the texts keeps, of every document, its number of terms and its counts of the query terms alone; counts of
documents and terms follow from it. Then documents come in tiles: their impacts (whole numbers) on a tile of the queries'
vocabulary make a dense float64 matrix, and one BLAS product with the terms' weights gives the partial scores of all
queries. A vocabulary tile has so few terms that no partial sum reaches 2**53, so products and sums are exact; partial
scores are added as 64-bit integers. Every task keeps each query's best documents so far, with the smaller doc_id before
among equal scores, and Spark ranks what the tasks kept.

Queries come in blocks of bounded vocabulary (VOCABULARY terms, by the query's hash), each of which is searched on its own.

Defined results: null and empty texts and queries, and those without terms, match nothing; repeated documents rank one
after the other, a null doc_id before others; queries of one item_id (a repeated row) are ranked each, their rows
side by side; a null item_id is searched like any other; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 50
#: Terms with repeats that a block of queries may hold on average; documents and terms in a tile; queries in a product.
VOCABULARY, DOCUMENTS, TERMS, QUERIES = 200_000, 512, 2048, 1024
#: Length normalisation in hundredths and saturation in twentieths: m = 100 - B + (B * n * N) div L, impact = (SCALE * tf) div (1000 * tf + K * m).
B, K, SCALE = 50, 20, 1_000_000_000
#: ASCII letters (in lower case) and digits and all other characters beyond ASCII belong to terms.
_TABLE = bytes((ord(chr(b).lower()) if chr(b).isalnum() else 0x20) if b < 128 else b for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - B + (B * n * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + K * m)


def counted(docs: DataFrame, vocabulary: list[bytes], own: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, ids, tfs): terms of every document that has any, and its counts of vocabulary terms by their number."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        known = shared.value
        for batch in common.slices(batches, 500):
            keep, sizes, ids, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(common.as_bytes(batch.column("text"))):
                terms = terms_of(text)
                if not terms:
                    continue
                found = Counter(map(known.get, terms))
                found.pop(None, None)
                keep.append(row)
                sizes.append(len(terms))
                ids.extend(found)
                tfs.extend(found.values())
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "ids", "tfs"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, ids array<long>, tfs array<long>")


class Best:
    """The best documents of every query so far; equal scores by place in `order` (the ids' own order)."""

    def __init__(self, queries: int, top: int):
        self.top, self.least = top, np.zeros(queries, dtype=np.int64)
        self.found: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, scores: np.ndarray, first: int, ids: list) -> None:
        """scores: queries (from `first` on) x documents. A score that equals the last kept one stays in, so ties are settled by id."""
        least = self.least[first : first + len(scores)]
        rows, places = np.nonzero((scores >= np.maximum(least, 1)[:, None]))
        if not len(rows):
            return
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for some in np.split(np.arange(len(rows)), cuts):
            q = first + int(rows[some[0]])
            new = [(-int(s), ids[p] is not None, ids[p] if ids[p] is not None else 0) for s, p in zip(scores[rows[some], places[some]].tolist(), places[some].tolist())]
            kept = sorted(self.found[q] + new)[: self.top]
            self.found[q] = kept
            if len(kept) == self.top:
                self.least[q] = -kept[-1][0]


def multiply(matrix, doc_at: np.ndarray, ids: np.ndarray, impact: np.ndarray, n_docs: int, queries: int, tile: int):
    """Scores (queries x documents) of one tile of documents, exact.

    matrix(first, last) gives the weights of the queries on terms first to last, a tile of the vocabulary.
    """
    out = np.zeros((queries, n_docs), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    ids, doc_at, impact = ids[order], doc_at[order], impact[order]
    at = 0
    while at < len(ids):
        first = int(ids[at]) // tile * tile
        end = int(np.searchsorted(ids, first + tile))
        dense = np.zeros((tile, n_docs))
        dense[ids[at:end] - first, doc_at[at:end]] = impact[at:end]
        out += (matrix(first) @ dense).astype(np.int64)
        at = end
    return out


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best documents of every query."""
    asked = queries.select("item_id", F.col("text").cast("string").alias("text")).withColumn("row", F.row_number().over(Window.partitionBy("item_id", "text").orderBy(F.lit(1))))
    asked, _ = common.store(asked.withColumn("block", F.xxhash64("item_id", "text", "row")), "queries")
    size = asked.agg(F.sum(F.length("text") / 2)).first()[0] or 0  # at least as many as terms
    blocks = max(1, math.ceil(size / vocabulary))
    found = None
    for b in range(blocks):
        part = _block(docs, asked.where(F.pmod("block", F.lit(blocks)) == b), top)
        if part is not None:
            found = part if found is None else found.union(part)
    kind = {"item_id": dict(queries.dtypes)["item_id"], "doc_id": dict(docs.dtypes)["doc_id"]}
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind['item_id']}, rank int, doc_id {kind['doc_id']}, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = asked.select(F.col("block").alias("q"), "item_id")
    return best.join(named, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, top: int) -> DataFrame | None:
    """(q, doc_id, score): what tasks keep for one block of queries."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = sorted((r["block"], sorted(set(terms_of((r["text"] or "").encode())))) for r in asked.collect())  # bounded: a block of queries
    names = sorted({t for _, terms in rows for t in terms})
    if not names:
        return None
    small, _ = common.store(counted(docs, names), "term_counts")
    n_docs, n_terms = small.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), dtype=np.int64)
    for r in small.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # at most a row a query term
        df[r["id"]] = r["count"]
    weights = np.array([weight(int(d), n_docs) for d in df], dtype=np.int64)
    # The tile is so narrow that its largest partial sum stays below 2**53.
    tile = max(1, min(TERMS, len(names), (2**53 - 1) // max(1, int(weights.max()) * (SCALE // 1000))))
    place = {t: i for i, t in enumerate(names)}
    pairs = [(q, place[t]) for q, (_, terms) in enumerate(rows) for t in terms]
    shared = spark.sparkContext.broadcast((np.array(pairs, dtype=np.int64).reshape(-1, 2), weights))
    keys = [k for k, _ in rows]

    def run(batches):
        at, w = shared.value
        best = Best(len(keys), top)
        kept: dict[tuple[int, int], np.ndarray] = {}

        def matrix(first: int, low: int, high: int) -> np.ndarray:
            if (first, low) not in kept:
                mine = at[(at[:, 1] >= first) & (at[:, 1] < first + tile) & (at[:, 0] >= low) & (at[:, 0] < high)]
                made = np.zeros((high - low, tile))
                made[mine[:, 0] - low, mine[:, 1] - first] = w[mine[:, 1]]
                if sum(m.nbytes for m in kept.values()) > 200 << 20:
                    kept.clear()
                kept[(first, low)] = made
            return kept[(first, low)]

        for batch in common.slices(batches, DOCUMENTS):
            lists = batch.column("ids")
            ids, tfs = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            impact = impacts(tfs, batch.column("n").to_numpy()[of], n_docs, n_terms).astype(np.float64)
            docs_here = batch.column("doc_id").to_pylist()
            for low in range(0, len(keys), QUERIES):
                high = min(low + QUERIES, len(keys))
                best.add(multiply(lambda first: matrix(first, low, high), of, ids, impact, batch.num_rows, high - low, tile), low, docs_here)  # noqa: B023
        out = [(keys[q], d if has else None, -s) for q, found in enumerate(best.found) for s, has, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind_of), pa.array([x[2] for x in out], pa.int64())], names=["q", "doc_id", "score"])

    kind_of = small.select("doc_id").limit(0).toArrow().schema.field(0).type
    return small.mapInArrow(run, f"q long, doc_id {kind}, score long")
