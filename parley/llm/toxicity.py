"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, with calibrated votes.

Terms are the character n-grams (GRAM) of the lower-cased text's words with their two ends; a shorter word is a term
itself. From a bounded, hash-chosen sample of labelled rows (EXAMPLES per class) every term is taken that LEAST examples
have and that tells the classes apart, whichever it leans to: its z, the difference of its shares in standard errors, is
SIGNIFICANT or more. There is no other bound on terms. A term's weight is its inverse document frequency, counted over all
documents, times z*z / (9 + z*z). The examples' unit vectors form an inverted index: every term's list of examples, cut
into blocks of similar examples, with the largest weight of every term in a block. A document takes the blocks of the highest bounds first and is done if no
other block can still hold one of its K nearest, else it takes them all: the neighbours are exact. Their
similarity-weighted votes, with the evidence's weight, go through a logistic calibration fitted on the examples (each
without itself), weighted back to the labelled rows' class shares.

Defined results: null and empty texts, and texts without any term, score what examples without a term show; repeated
rows score alike; without labelled rows of both classes every score is the share of label 1 (0 without labels); ties in
similarity go to the earlier example of the index; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bound on the labelled rows of each class that are fitted on, neighbours, examples in a block of the index.
EXAMPLES, K, BLOCK = 2000, 15, 64
#: Blocks that are tried first; if another one may hold a nearer example, all lists are summed up.
FIRST = 2
#: Characters of a term, examples that must have it, standard errors by which its shares must differ.
GRAM, LEAST, SIGNIFICANT = 5, 3, 2.0
_GAPS = re.compile(r"[\W_]+")
#: Words whose terms a worker remembers.
_WORDS = 200_000


def words_of(text: str) -> list[str]:
    return _GAPS.sub(" ", text.lower()).split()


def grams(word: str) -> list[str]:
    whole = f" {word} "
    return [whole[i : i + GRAM] for i in range(len(whole) - GRAM + 1)] or [whole]


class Terms:
    """The chosen terms of a text, with their counts and weights."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.weights, place = weights, {t: i for i, t in enumerate(terms)}
        self.known = common.Recent(lambda word: [place[g] for g in grams(word) if g in place], _WORDS)

    def counts(self, text: str) -> dict[int, int]:
        found: dict[int, int] = defaultdict(int)
        words = Counter(words_of(text))
        for places, n in zip(self.known.all(list(words)), words.values()):
            for i in places:
                found[i] += n
        return found

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.counts(text)
        at = np.array(sorted(found), dtype=np.int64)
        if not len(at):
            return at, np.zeros(0)
        return at, (1 + np.log([found[i] for i in at.tolist()])) * self.weights[at]


class Index:
    """Examples in blocks; every term has its list of examples and weights, cut at the blocks, and the largest weight in each block."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        lead = [int(at[w.argmax()]) if len(at) else n_terms for at, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (lead[i], ids[i]))
        self.ids, self.labels = np.array(ids, dtype=np.int64)[order], np.array(labels)[order]
        self.blocks = max(1, -(-len(order) // BLOCK))
        term = np.concatenate([np.zeros(0, np.int64), *[vectors[i][0] for i in order]])
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        weight = np.concatenate([np.zeros(0), *[vectors[i][1] / np.linalg.norm(vectors[i][1]) for i in order if len(vectors[i][0])]])
        listed = np.lexsort((place, term))
        self.place, self.weight = place[listed], weight[listed]
        key = term[listed] * self.blocks + self.place // BLOCK
        self.start = np.searchsorted(key, np.arange(n_terms * self.blocks + 1))
        self.whole = self.start[:: self.blocks].tolist()  # a term's list over all blocks
        self.bound = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.bound, key, self.weight)
        self.bound = self.bound.reshape(n_terms, self.blocks)

    def _sum(self, start: list[int], end: list[int], w: np.ndarray, skip: int) -> np.ndarray:
        """Similarities of all places from stretches of the lists, each with its weight."""
        place = np.concatenate([self.place[a:b] for a, b in zip(start, end)])
        weight = np.concatenate([self.weight[a:b] for a, b in zip(start, end)])
        weight *= np.repeat(w, np.subtract(end, start))
        sim = np.bincount(place, weights=weight, minlength=len(self.ids))
        if skip >= 0:
            sim[skip] = 0
        return sim

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest examples with a term in common."""
        w = w / np.linalg.norm(w)
        bound = w @ self.bound[at]
        first = np.argsort(-bound, kind="stable")[:FIRST]
        key = (at[:, None] * self.blocks + first).ravel()
        sim = self._sum(self.start[key].tolist(), self.start[key + 1].tolist(), np.repeat(w, len(first)), skip)
        rest = np.delete(bound, first).max(initial=0.0) * (1 + 1e-9)  # slack for rounding
        least = np.partition(sim, len(sim) - k)[len(sim) - k] if len(sim) > k else 0.0
        if rest >= least and rest > 0:  # another block may hold one of the nearest
            sim = self._sum([self.whole[t] for t in at.tolist()], [self.whole[t + 1] for t in at.tolist()], w, skip)
            least = np.partition(sim, len(sim) - k)[len(sim) - k] if len(sim) > k else 0.0
        near = np.flatnonzero(sim > max(1e-9, least * (1 - 1e-9)))
        near = near[np.lexsort((near, -np.round(sim[near], 12)))][:k]  # equal but for rounding is a tie
        return near, sim[near]


def signals(index: Index, share: float, at: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(vote, weight of the evidence, neighbours, similarities)."""
    if not len(at):
        return 0.0, 0.0, at, w
    where, sim = index.nearest(at, w, K, skip)
    if not len(where):
        return 0.0, 0.0, where, sim
    close = sim.astype(float) ** 2
    vote = float((close * index.labels[where]).sum() / close.sum())
    return vote, float(np.log1p(np.linalg.norm(w))), where, sim


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, slightly ridged."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def shape(vote, strength):
    return np.column_stack([vote, strength, np.multiply(vote, strength), np.equal(strength, 0)])


def sample(docs: DataFrame, labels: DataFrame, bound: int = EXAMPLES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most about `bound` labelled rows of each class, and each class's labelled rows."""
    open_rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    open_rows, _ = common.store(open_rows, "labelled")
    have = {int(r["toxic"]): r["count"] for r in open_rows.groupBy("toxic").count().collect()}
    chosen = None
    for y, n in sorted(have.items()):
        part = open_rows.where(F.col("toxic") == y)
        part = part if n <= bound else part.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        chosen = open_rows
    # Bounded by the sample: at most about 2 x bound ids go to every task.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return texts, have


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, ids, tfs): the chosen terms of every document by their number, and how often it has them."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(terms), dict(docs.dtypes)["doc_id"]

    def run(batches):
        finder = Terms(shared.value, np.ones(len(shared.value)))
        for batch in common.slices(batches):
            found = [finder.counts(text) if text else {} for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids, tfs = (np.fromiter((x for f in found for x in part(f)), dtype=np.int32, count=ends[-1]) for part in (dict.keys, dict.values))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids, tfs))], names=["doc_id", "ids", "tfs"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, tfs array<int>")


def model(docs: DataFrame, labels: DataFrame) -> tuple[dict, DataFrame | None]:
    """What the labelled rows teach, and the documents' counts of the chosen terms (null where nothing can be fitted)."""
    picked, have = sample(docs, labels)
    picked, _ = common.store(picked, "examples")
    n = {y: 0 for y in (0, 1)} | {int(r["toxic"]): r["count"] for r in picked.groupBy("toxic").count().collect()}
    share = have.get(1, 0) / max(1, sum(have.values()))
    if not n[0] or not n[1]:
        return {"share": share, "index": None}, None

    def count(batches):
        tally: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in {g for word in set(words_of(text or "")) for g in grams(word)}:
                    tally[g][y] += 1
            if len(tally) > 500_000:
                yield _tally(tally)
                tally.clear()
        yield _tally(tally)

    seen = picked.select(F.col("toxic").cast("int"), "text").repartition(max(8, sum(n.values()) // 250)).mapInArrow(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p1, p0 = (F.col("n1") + 0.5) / (n[1] + 1), (F.col("n0") + 0.5) / (n[0] + 1)
    pooled = (F.col("n0") + F.col("n1") + 1) / (n[0] + n[1] + 2)
    ratio = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / (n[0] + 1) + 1 / (n[1] + 1)))
    chosen = seen.where(F.col("n0") + F.col("n1") >= LEAST).withColumn("z", ratio).where(F.abs("z") >= SIGNIFICANT).orderBy("term").select("term", "z").toArrow()  # bounded by the sample's texts
    terms, z = chosen.column("term").to_pylist(), chosen.column("z").to_numpy()
    counts, _ = common.store(counted(docs, terms), "term_counts")

    def frequency(batches):
        df = np.zeros(len(terms) + 1, dtype=np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            df[:-1] += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["i", "n"])

    df = np.zeros(len(terms) + 1)
    for r in counts.select("ids").mapInArrow(frequency, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row a term
        df[r["i"]] = r["n"]
    weights = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 1) * z * z / (9 + z * z)
    rows = sorted((r["doc_id"], int(r["toxic"]), r["text"] or "") for r in picked.toLocalIterator())
    finder = Terms(terms, weights)
    vectors = [finder.vector(t) for _, _, t in rows]
    index = Index([r[0] for r in rows], [r[1] for r in rows], vectors, len(terms))
    place = {int(d): i for i, d in enumerate(index.ids)}
    got = [signals(index, share, at, w, place[rows[i][0]])[:2] for i, (at, w) in enumerate(vectors)]
    y = np.array([r[1] for r in rows], dtype=float)
    weight = np.where(y == 1, have[1] / n[1], have[0] / n[0])
    beta = logistic(shape(*np.array(got).T), y, weight / weight.mean())
    return {"share": share, "index": index, "terms": terms, "weights": weights, "beta": beta}, counts


def _tally(tally: dict) -> pa.RecordBatch:
    values = list(tally.values())
    return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], names=["term", "n0", "n1"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, evidence (doc_ids of the three nearest examples) and evidence_labels of every row."""
    fit, counts = model(docs, labels)
    if counts is None:
        return docs.select("doc_id", F.lit(float(fit["share"])).alias("score"), F.array().cast("array<long>").alias("evidence"), F.array().cast("array<int>").alias("evidence_labels"))
    fitted = docs.sparkSession.sparkContext.broadcast({k: fit[k] for k in ("share", "index", "weights", "beta")})

    def run(batches):
        m = fitted.value
        for batch in common.slices(batches):
            votes, near, marks = [], [], []
            lists, tfs = batch.column("ids"), batch.column("tfs").flatten().to_numpy()
            ids, ends = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()
            every = (1 + np.log(tfs)) * m["weights"][ids]
            for a, b in zip(ends - ends[0], ends[1:] - ends[0]):
                order = np.argsort(ids[a:b])
                vote, strength, where, _ = signals(m["index"], m["share"], ids[a:b][order], every[a:b][order])
                votes.append((vote, strength))
                near.append(m["index"].ids[where[:3]].tolist())
                marks.append(m["index"].labels[where[:3]].tolist())
            x = shape(*np.array(votes).reshape(-1, 2).T)
            scores = 1 / (1 + np.exp(-np.clip(m["beta"][0] + x @ m["beta"][1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int32()))], names=["doc_id", "score", "evidence", "evidence_labels"])

    return counts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, evidence array<long>, evidence_labels array<int>")


def digest(scored: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "evidence_labels")
