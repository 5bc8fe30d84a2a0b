"""What the pipeline's near-dedup keeps, on rows whose right answer is known."""

import numpy as np

import corpus_pipeline

SCHEMA = "doc_id long, text string"


def words(seed, n=120):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, n)]


def kept(spark, rows):
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)


def test_every_group_keeps_one_row_with_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(words(s)) for s in range(5))
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, d), (None, e), (3, e)]
    assert kept(spark, rows) == sorted([(None, a), (None, b), (7, c), (7, d), (3, e)], key=str)


def changed(text, rng, every):
    """The text with one word in `every` replaced, evenly spread: each takes five of its shingles."""
    return [f"z{rng.integers(1 << 40)}" if i % every == every // 2 else w for i, w in enumerate(text)]


def similarity(a, b):
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_planted_pairs_of_0_8_are_found_and_those_below_stay(spark):
    rng = np.random.default_rng(9)
    rows, near, far = [], [], []
    for i in range(400):
        one = words(1000 + i, 460)
        near_copy, far_copy = changed(one, rng, 46), changed(one, rng, 28)
        assert 0.8 <= similarity(one, near_copy) < 0.81 and 0.65 < similarity(one, far_copy) < 0.72
        rows += [(4 * i, " ".join(one)), (4 * i + 1, " ".join(near_copy)), (4 * i + 2, " ".join(far_copy))]
    got = {d for d, _ in kept(spark, rows)}
    found = sum(4 * i in got and 4 * i + 1 not in got for i in range(400))
    print("recall of pairs at 0.80 to 0.81:", found / 400)
    assert found >= 0.99 * 400
    assert all(4 * i + 2 in got for i in range(400))


def test_a_group_too_large_for_one_task_is_compared_with_its_leaders(spark):
    rng = np.random.default_rng(10)
    one = words(7, 600)
    rows = [(0, " ".join(one))] + [(i, " ".join([*one[:-1], f"x{i}"])) for i in range(1, 90)] + [(500 + i, " ".join(changed(one, rng, 34))) for i in range(3)]
    got = {d for d, _ in kept(spark, rows)}
    assert got == {0, 500, 501, 502}


def test_a_large_group_of_edited_copies_keeps_what_one_pass_in_order_keeps(spark, monkeypatch):
    """Copies that are near the first text but often not near each other; against the plain loop."""
    from parley.llm import simhash

    monkeypatch.setattr(simhash, "LEADERS", 20)
    monkeypatch.setattr(simhash, "PART", 30)
    rng = np.random.default_rng(11)
    one = words(8, 400)
    texts = [one] + [[f"z{rng.integers(1 << 40)}" if rng.random() < 0.018 else w for w in one] for _ in range(150)]
    stay = []
    for i, text in enumerate(texts):
        if all(similarity(text, texts[k]) < 0.8 for k in stay):
            stay.append(i)
    assert 20 < len(stay) < 145
    assert [d for d, _ in sorted(kept(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]))] == stay
