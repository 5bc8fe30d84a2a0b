"""Edited copies of test items, and benchmarks used in turn."""

import random

from pyspark.sql import functions as F

from parley.llm import decontam

SF = "/root/testdata/sf0.01"


def test_edited_copies_are_found(spark):
    """All items with every tenth to third word replaced, put into documents; and nothing but copies is found."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items, rnd = bench.collect(), random.Random(5)
    alone = {r["doc_id"] for r in decontam.report(docs, bench).where("contaminated").collect()}
    texts = [r["text"] or "" for r in docs.where("doc_id < 200").collect() if r["doc_id"] not in alone]
    words = [w for t in texts for w in t.split()]
    rows = []
    for rate in (0, 10, 20, 30):
        for item in items:
            edited = [rnd.choice(words) if 100 * rnd.random() < rate else w for w in item["text"].split()]
            rows.append((10**6 + len(rows), rate, item["item_id"], f"{rnd.choice(texts)} {' '.join(edited)} {rnd.choice(texts)}"))
    made = spark.createDataFrame([(d, t) for d, _, _, t in rows], "doc_id long, text string")
    found = {r["doc_id"]: r["item_id"] for r in decontam.report(docs.union(made), bench).where("contaminated").collect()}
    for rate, least in ((0, 1.0), (10, 1.0), (20, 0.95), (30, 0.9)):
        own = [found.get(d) == i for d, r, i, _ in rows if r == rate]
        assert sum(own) >= least * len(own), rate
    held = docs.join(bench.select(F.lower("text").alias("item")), F.lower("text").contains(F.col("item")), "left_semi")
    assert alone >= {r["doc_id"] for r in held.collect()} and len(alone) < 0.1 * docs.count()


def test_benchmarks_in_turn(spark):
    """A worker that is used again knows the items of the benchmark at hand, not of the last one."""
    docs = spark.createDataFrame([(i, f"some words before number{i} stands here and after it come more words") for i in range(20)], "doc_id long, text string")
    for i in range(4):
        bench = spark.createDataFrame([(i, f"before number{i} stands here")], "item_id long, text string")
        assert [r["doc_id"] for r in decontam.scores(docs, bench, threshold=0.9).collect()] == [i]
