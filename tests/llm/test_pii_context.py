"""Contextual extraction of personal data: no bounds on words, distances or rounds, every mention of what is believed, against a plain loop."""

import re
from collections import defaultdict

from parley.llm import pii

SEEDS = [f"send word to email: a{i}@b{i}.org" for i in range(24)]


def plain(texts):
    """The same method in Python: email candidates alone, words before and behind, rounds until nothing is new."""
    seed = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    shape = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?:(?: ?[\[(](?:dot|DOT)[\])] ?| ?\.)[A-Za-z0-9-]+)+")
    graph, places, known = defaultdict(set), [], set()
    for d, text in enumerate(texts):
        for is_seed, form in ((True, seed), (False, shape)):
            found, ends = list(form.finditer(text)), 0
            for k, m in enumerate(found):
                before, after = text[ends : m.start()], text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
                ends = m.end()
                places.append((d, m.start(), m.end(), m.group()))
                if is_seed:
                    known.add(m.group())
                if w := re.search(r"([^\W\d_]{2,}[:=]?)\s*$", before):
                    graph["<" + w[1].lower()].add(m.group())
                if w := re.match(r"\s+([^\W\d_]{2,})", after):
                    graph[">" + w[1].lower()].add(m.group())
    while True:
        good = [v for v in graph.values() if len(v & known) >= pii.SUPPORT and sum(1 if x in known else pii.PRIOR for x in v) / len(v) >= pii.TRUST]
        more = set().union(*good) - known if good else set()
        if not more:
            break
        known |= more
    out = defaultdict(list)
    for d, s, e, v in sorted(set(places)):
        if v in known:
            out[d].append(f"email:{s}:{e}")
    return {d: ",".join(out[d]) for d in range(len(texts))}


def spans(spark, texts):
    return {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}


def test_long_parts_and_distances(spark):
    texts = [*SEEDS, "email: " + "l" * 80 + " [at] corp [dot] com x", "email: bob [at] " + "d" * 80 + " [dot] com x", "email:" + " " * 45 + "bob [at] far [dot] com", "email: bob [at] a.b.c.d.e.f.g.com", "email:\n \nno [at] thin [dot] com"]
    got = spans(spark, texts)
    assert got == plain(texts)
    assert all(got[i] for i in range(24, 28))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert clean[27] == "email: <EMAIL>" and clean[24] == "email: <EMAIL> x"


def test_every_mention_of_what_is_believed(spark):
    hidden = [f"user{i} [at] corp{i} [dot] com" for i in range(8)]
    texts = [*SEEDS, *[f"Email: {h} or so, and {i}{'q' * i} {h}" for i, h in enumerate(hidden)], "un [at] known [dot] com"]
    got = spans(spark, texts)
    assert got == plain(texts) and sum(len(got[24 + i].split(",")) for i in range(8)) == 16 and got[32] == ""


def test_a_chain_of_words_longer_than_six_rounds(spark):
    """Every word stands before five addresses of the word before and five new ones."""
    texts, held = list(SEEDS), [f"a{i}@b{i}.org" for i in range(5)]
    words = ["alpha", "bravo", "carol", "delta", "early", "fancy", "grand", "house", "inner", "jolly"]
    for w in words:
        new = [f"{w}{i} [at] corp{i} [dot] com" for i in range(5)]
        texts += [f"12 {w} {h} 34" for h in held + new]
        held = new
    got = spans(spark, texts)
    assert got == plain(texts) and all(got[d] for d in range(len(texts)))


def test_a_pattern_with_few_known_ones_finds_nothing(spark):
    texts = [*SEEDS[:5], *[f"email: {i} x{i} [at] y{i} [dot] com" for i in range(3)], *[f"email: z{i} [at] y{i} [dot] com" for i in range(30)]]
    got = spans(spark, texts)
    assert got == plain(texts) and not any(got[d] for d in range(5, len(texts)))


def test_long_texts_of_numbers_take_linear_time(spark):
    text = "; ".join(str(i) for i in range(60_000)) + "; 4111 1111 1111 1111"
    assert spans(spark, [text])[0].startswith("card:")
