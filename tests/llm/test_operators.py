"""The ten operators and the pipeline on small tables with nulls, empty texts, ties, repeats and extra columns, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from parley.llm import decontam, packing, pii, quality, sharding, simhash, substring, tokenbin, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, record string, rid long"
LONG = "zyx " * 3000 + "mail me+x@ab.example.org now 10.0.0.256 10.0.0.25, 4111 1111 1111 1111; +1 (555) 123-4567 "
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", "   \n\t ", "That it.", PASSAGE, PASSAGE, "lead in " + PASSAGE + " and out", LONG, "A.b,C " * 40, PASSAGE.upper(), "é ü ß " * 30 + PASSAGE[:200], "a@b.c_d@e.fg x"]


def rows():
    out = [(i, t, "en", "s", 0, "r", 1) for i, t in enumerate(TEXTS)]
    return [*out, out[4], out[4], (None, PASSAGE, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(d, t or "") for d, t, *_ in rows()]


def test_sharding(docs, empty):
    got = sharding.digest(sharding.shard(docs, 5, bucket_bytes=512)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.digest(sharding.shard(empty, 5)).count() == 0


def test_substring(docs, empty):
    first, words = {}, [(d, t.encode().split()) for d, t in texts()]
    order = lambda d: (d is not None, d or 0)
    for d, w in words:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, ((True, 1 << 60), 0)), (order(d), i))
    want = Counter()
    for d, w in words:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (order(d), i):
                gone.update(range(i, i + 20))
        want[(d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())] += 1
    assert Counter(tuple(r) for r in substring.digest(*substring.removed(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert substring.digest(*substring.removed(empty)).count() == 0


def test_substring_keeps_words_that_only_look_alike(spark):
    """Words whose letters mirror each other (alike under polynomial hashes modulo 2**64) are different words."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(19))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"x y {shared} {one}"), (2, f"u v {shared} {two}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.digest(*substring.removed(docs)).collect()] == [0, 0]


def test_extra_columns_with_clashing_names(spark):
    import corpus_pipeline

    names = ["d", "t", "tkey", "fp", "group", "__t", "__d", "__k", "__cuts", "parley_key", "root", "kept", "seed", "item_id", "more", "b_email", "belief"]
    rows = [(i, f"{PASSAGE} tail{i} " * (1 + i % 2), "en", *[i] * len(names)) for i in range(6)]
    docs = spark.createDataFrame([*rows, (None,) * (len(names) + 3)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` long" for n in names))
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.personal_data):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and all(r[n] == r["doc_id"] for r in out.collect() for n in names)


def test_simhash(docs, empty, spark):
    got = simhash.digest(simhash.near_groups(docs, k=4, seeds=(42,), radius=4, blocks=7, equal=3)).collect()
    up = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

    def fp(t):
        w = t.encode().translate(up).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    items = [(d, fp(t)) for d, t in texts()]
    group = list(range(len(items)))
    for _ in items:
        for i, (_, a) in enumerate(items):
            for j, (_, b) in enumerate(items):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((d for (d, _), h in zip(items, group) if h == g and d is not None), default=None) for g in set(group)}
    assert Counter(tuple(r) for r in got) == Counter((d, f"{f:016x}", least[g]) for (d, f), g in zip(items, group))
    assert simhash.near_groups(empty).count() == 0
    # tiles give the same groups as whole buckets
    fps = spark.createDataFrame([(f"{(1 << i % 3) | (i << 40):016x}",) for i in range(200)], "fp string")
    from parley.llm.components import components

    assert sorted(components(simhash.links(fps, 1, 4, 7, 3, tile=16)).collect()) == sorted(components(simhash.links(fps, 1, 4, 7, 3)).collect())


def test_toxicity(docs, empty, spark):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(toxicity.score(docs, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.digest(toxicity.score(empty, labels)).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    rng = np.random.default_rng(1)
    vectors = [(np.sort(rng.choice(20, 5, replace=False)), rng.random(5) + 0.1) for _ in range(300)]
    index = toxicity.Index(list(range(300)), [i % 2 for i in range(300)], vectors, 20)
    dense = np.zeros((300, 20))
    place = {int(d): i for i, d in enumerate(index.ids)}
    for i, (at, w) in enumerate(vectors):
        dense[place[i], at] = w / np.linalg.norm(w)
    for at, w in vectors[:40]:
        q = np.zeros(20)
        q[at] = w / np.linalg.norm(w)
        assert np.allclose(index.nearest(at, w, 7)[1], np.sort(dense @ q)[::-1][:7], atol=1e-5)


def base_spans(t):
    luhn = lambda s: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True), "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9](?:[ -]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m.group())]


def test_pii(docs, empty):
    got = pii.digest(pii.detect(docs)).collect()
    want = Counter((d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)).encode()).hexdigest()) for d, t in texts())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[7]["text"].endswith("mail <EMAIL> now 10.0.0.256 <IP>, <CARD>; <PHONE> ") and clean[0]["text"] is None and len(clean[7].asDict()) == 7
    assert pii.digest(pii.detect(empty)).count() == 0


def test_pii_finds_by_context_what_no_seed_stood_beside(spark):
    """Round 1 trusts `email:`, which finds eight disguised addresses; these make `ping` trusted, which finds one that only `ping` stands before."""
    hidden = [f"user{i} [at] corp{i} [dot] com" for i in range(8)]
    texts = [f"send word to email: a{i}@b{i}.org" for i in range(24)] + [f"Email: {h} or so" for h in hidden] + [f"you may ping {h} then" for h in hidden]
    texts += ["you may ping zoe [at] only [dot] net then", "the build was yan [at] nowhere [dot] net today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(docs)).collect()}
    where = lambda d, v: f"email:{texts[d].index(v)}:{texts[d].index(v) + len(v)}"
    assert all(got[24 + i] == where(24 + i, h) and got[32 + i] == where(32 + i, h) for i, h in enumerate(hidden))
    assert got[40] == where(40, "zoe [at] only [dot] net") and got[41] == ""
    alone = spark.createDataFrame([(0, texts[40])], "doc_id long, text string")
    assert pii.digest(pii.detect(alone)).first()["spans"] == ""


@pytest.mark.parametrize("filter_bytes", [0, 1 << 20])
def test_decontamination(docs, empty, spark, filter_bytes):
    bench = spark.createDataFrame([(1, PASSAGE), (2, ""), (3, None), (None, "x y z"), (4, "quite other words that nobody wrote anywhere at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.report(docs, bench, filter_bytes=filter_bytes).collect() if r["contaminated"]}
    assert got == {(4, 1), (5, 1), (6, 1), (9, 1), (10, 1), (None, 1)}  # 10 holds 28 of the 60 words
    assert decontam.report(empty, bench).count() == 0 and not decontam.report(docs, bench.limit(0)).where("contaminated").count()
    # the row-wise alignment equals the plain recurrence
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15), dtype=int)
        for i in range(9):
            for j in range(14):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b) == h.max()


def test_warc(spark):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "http://www.a.com/b?c#d", big, 0), (5, None, big, 0), (5, "http://b.com:bad/", big, 0), (2, "http://a.com/", "small", 0), (3, "http://a.com/", "small", 0), (4, "u", None, 0), (None, "http://c.org", big, 0)], "page_id long, url string, html string, run long")
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {(1, 2000, "revisit", 5), (5, 2000, "response", None), (2, 5, "response", None), (3, 5, "response", None), (4, 0, "response", None), (None, 2000, "revisit", 5)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    # over all ranges the merged index is in order of key, time and page
    many = spark.createDataFrame([(i, f"http://h{i * 7 % 5}.org/{i * 13 % 9}", f"p{i}") for i in range(200)], "page_id long, url string, html string").repartition(7)
    folder = warc.common.new_path(spark, "archives")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    lines = warc.merge(warc.write(many, folder), range_lines=30).orderBy("range_no", "place").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [(r["urlkey"], r["stamp"], r["page_id"]) for r in lines]
    assert len(keys) == 200 and keys == sorted(keys)
    assert len({r["range_no"] for r in lines}) > 3 and len({r["run"] for r in lines}) > 1
    for k in range(6):
        runs = [sorted(np.random.default_rng(k * 7 + i).integers(0, 30, i * 3).tolist()) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def reference_ids(end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenbin.default_vocabulary())
    return [(d, [*t.encode(x, add_special_tokens=False).ids, end]) for d, x in texts()]


def test_token_files(docs, empty):
    got = tokenbin.digest(tokenbin.round_trip(docs)).orderBy("start").collect()
    pack = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(i), pack(i)) for d, i in reference_ids(1))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(d for d, _ in texts() if d is not None)
    assert tokenbin.round_trip(empty).count() == 0
    rng = np.random.default_rng(3)
    for n in (0, 1, 1023, 1024, 5000):
        ids = rng.integers(0, 49408, n)
        data = tokenbin.pack_segment([7], [n], ids)
        assert np.array_equal(tokenbin.open_segment(data)[2], ids)
        if n > 1024:  # a block needs no other one
            assert all(np.array_equal(tokenbin.open_block(data, i), ids[i * 1024 : i * 1024 + 1024]) for i in range(-(-n // 1024)))
    with pytest.raises(ValueError):
        tokenbin.open_segment(data[:-40] + bytes(x ^ 1 for x in data[-40:]))


def test_packing(docs, empty):
    got = packing.digest(packing.pack(docs)[1]).collect()
    want = Counter((d, p, len(i[p * 2048 : p * 2048 + 2048]), zlib.crc32(np.array(i[p * 2048 : p * 2048 + 2048], dtype="<u4").tobytes())) for d, i in reference_ids(0) for p in range(-(-len(i) // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == want
    rooms = defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for room in rooms.values():
        at = 0
        for offset, length in sorted(room):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.digest(packing.pack(empty)[1]).count() == 0
    sizes = Counter(np.random.default_rng(4).integers(1, 2049, 3000).tolist())
    plan = packing.solve(dict(sizes))
    assert Counter(x for c, n in plan.entries for x in c for _ in range(n)) == sizes and all(sum(c) <= 2048 for c, _ in plan.entries)
    assert plan.bound <= plan.sequences <= 1.02 * plan.bound
    # Lengths that leave no easy fit: the program beats best-fit decreasing, and the bound holds.
    sizes = Counter(np.random.default_rng(0).integers(500, 1200, 100_000).tolist())
    plan = packing.solve(dict(sizes))
    assert plan.bound <= plan.sequences < 0.99 * sum(n for _, n in packing.best_fit(dict(sizes), 2048)) and plan.share > 0.3
    assert packing.solve({}).sequences == 0 and packing.solve({2048: 3, 1: 1}).sequences == 4


def test_quality(docs, empty):
    got = quality.digest(quality.assess(docs)).collect()
    want = Counter()
    for d, t in texts():
        w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want[(d, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))] += 1
    assert Counter(tuple(r)[:7] for r in got) == want and not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.assess(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, whole, sf)
    assert set(kept.columns) == set(whole.columns) and 0 < kept.count() < whole.count()
    one = corpus_pipeline.near_dedup(spark, whole.union(whole.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")), sf)
    assert one.where("doc_id >= 1000000").count() == 0 and one.count() <= whole.select("text").distinct().count()
    assert corpus_pipeline.run(spark, sf).where("length > 2048").count() == 0
