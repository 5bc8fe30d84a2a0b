"""URL filters, phrases and search on small tables with nulls, empty and long texts, ties, repeats and extra columns, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import phrases, search, urlfilter

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Casino-Win.example.net/EN/1?x=1#y", "http://blog.tionsh.example.net/en/5", "https://example.org/es/9", "https://m.example.org/es", "https://x.example.org/en/12",
    "http://xexample.org/es/1", "https://a.example.com/fr/1", "https://a.example.com/de/1#top", "https://a.example.com?/fr/", "ftp://h.org#/a", "http://org/", "http://org.net/x", "a://b://c/d", "https://Ünï.example.net/é/" + "x" * 5000, "https://casino-win.example.net/EN/1",
]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def numbers(url):
    host, path = cut(url)
    if not host and not path:
        return []
    out = []
    for k, text in enumerate((host, path)):
        codes = [2, *map(ord, text), 3]
        for n in urlfilter.SIZES:
            for i in range(len(codes) - n + 1):
                total = 10 * k + n
                for c in codes[i : i + n]:
                    total = total * urlfilter.FACTOR + c
                out.append(total % urlfilter.BUCKETS)
    return sorted(set(out))


def fitted(rows):
    x, y = np.zeros((len(rows), urlfilter.BUCKETS)), np.array([label for _, label in rows], dtype=float)
    for i, (url, _) in enumerate(rows):
        at = numbers(url)
        x[i, at] = 1 / math.sqrt(max(1, len(at)))
    w, b = np.zeros(urlfilter.BUCKETS), 0.0
    for _ in range(urlfilter.STEPS):
        miss = 1 / (1 + np.exp(-(b + x @ w))) - y
        w, b = w - urlfilter.RATE * (x.T @ miss / len(rows) + urlfilter.RIDGE * w), b - urlfilter.RATE * miss.mean()
    return w, b


def test_urls(spark):
    table = urlfilter.labelled(spark)
    weights = urlfilter.train(table.union(table).union(spark.createDataFrame([(None, 1), ("http://x.y/", 7), ("http://x.y/", None)], "url string, label int")))
    w, b = fitted(sorted((r["url"], r["label"]) for r in table.collect()))
    assert np.abs(weights[:-1] - w).max() < 1e-9 and abs(weights[-1] - b) < 1e-9
    pages = spark.createDataFrame([(i, u, "h", u) for i, u in enumerate([*URLS, URLS[4], None])], "page_id long, url string, host string, Path string")
    got = {r["page_id"]: r for r in urlfilter.digest(urlfilter.judge(pages, weights)).collect()}
    assert len(got) == len(URLS) + 2
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    for i, url in enumerate([*URLS, URLS[4], None]):
        host, path = cut(url)
        fits = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
        at = numbers(url)
        score = 1 / (1 + math.exp(-(b + w[at].sum() / math.sqrt(max(1, len(at))))))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, fits[1])
        assert abs(got[i]["score"] - score) < 1e-5 and got[i]["verdict"] == (fits[2] or ("block" if score >= 0.5 else "allow"))
    assert got[4]["verdict"] == "block" and got[5]["verdict"] == "allow"


def test_urls_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "url string, label int")
    page = spark.createDataFrame([(1, "http://a.net/b")], "page_id long, url string")
    verdict = lambda table: urlfilter.judge(page, urlfilter.train(table)).first()["verdict"]
    assert verdict(none) == "allow"
    assert verdict(spark.createDataFrame([("http://q.net/", 1)], "url string, label int")) == "block"
    assert urlfilter.judge(page.limit(0), urlfilter.train(none)).count() == 0


def phrase_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["New", "new", "York", "ünü", "\x00x", "a\u00a0b", "it's"]
    texts = [None, "", " \t ", ".,;:!?\n", "New York City. new york\tcity; NEW york", "a a a a a a", "x\x0by\x0cz"]
    texts += ["".join(rng.choice(words[: rng.choice((4, 37))]) + rng.choice((" ", " ", " ", "\t", ". ", "  ", "\n")) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += ["b c d e f g " * 900, "New York City. new york\tcity; NEW york"]
    return [(i, t, (None, "en", "fr", "und")[i % 4], "p", 1) for i, t in enumerate(texts)]


def brute_phrases(rows, least, longest, top):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    many = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))
    found = defaultdict(list)
    for (lang, words), a in many.items():
        if any(o[0] == lang and len(o[1]) > len(words) and b >= a and inside(words, o[1]) for o, b in many.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


@pytest.mark.parametrize("known", [phrases.KNOWN, 10])
def test_phrases(spark, known):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Phrase string, n long")
    got = phrases.top(phrases.mine(docs, least=5, known=known), 40)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, 5, 40)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.top(phrases.mine(docs)).count() == 0


def test_products_beyond_64_bits(spark):
    """The largest counts that the arithmetic has to hold: 10**13 words, one of which is in every pair."""
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(9_999_999_999_999, 9_999_999_999_999, [9_999_999_999_998, 5], [5, 9_999_999_999_997], 2)], "a long, total long, first array<long>, last array<long>, size int")
    got = row.select(phrases._cut(F.lit(1)).alias("c")).first()["c"]
    assert got["score"] == 1000 * 9_999_999_999_999**2 // (9_999_999_999_998 * 9_999_999_999_997)


def test_tiles():
    rng = np.random.default_rng(5)
    tiles, want = phrases.Tiles(side=8, dense=4, tiles=2), Counter()
    for _ in range(6):
        left, right = rng.zipf(1.5, 300) % 60, rng.zipf(1.5, 300) % 60
        tiles.add(left, right)
        want.update(zip(left.tolist(), right.tolist()))
    assert 0 < len(tiles.dense) <= 2
    got = Counter()
    for a, b, n in [tiles.take_coo(), *tiles.take_dense()]:
        got.update({(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), n.tolist())})
    assert got == want


def search_rows():
    rng = random.Random(4)
    words = [f"t{i}" for i in range(40)] + ["É", "é", "A1", "it's", "a_b", "x\u2019y"]
    texts = [None, "", " .,- ", "É É é", "a1 A1 it s"] + [" ".join(rng.choice(words[: rng.choice((3, 46))]) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["t1 " * 30_000 + "t2", "t3"]
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "t1 t2 t3", 1)]


def brute_search(rows, queries, top):
    terms = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    docs = [(d, t) for d, t in ((d, Counter(terms(text))) for d, text, *_ in rows) if t]
    n_docs, n_terms = len(docs), sum(sum(t.values()) for _, t in docs)
    df = Counter(x for _, t in docs for x in t)
    out = []
    for item, text, *_ in queries:
        scored = []
        for d, t in docs:
            m = 50 + 50 * sum(t.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * t[x] // (1000 * t[x] + 20 * m)) for x in set(terms(text)) if x in t)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if has else None, -s) for i, (s, has, d) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("vocabulary", [search.VOCABULARY, 20])
def test_search(spark, vocabulary):
    rows = search_rows()
    queries = [(1, "t1 t2 t1 T3"), (2, None), (3, ""), (4, "zzz"), (5, "é it's a1"), (6, " ".join(f"t{i}" for i in range(40))), (6, "t5"), (6, "t5"), (None, "t9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score long")
    asked = spark.createDataFrame([(*q, 0) for q in queries], "item_id long, text string, rank long")
    got = search.search(docs, asked, top=7, vocabulary=vocabulary)
    assert Counter(tuple(r) for r in got.collect()) == brute_search(rows, queries, 7)


def test_search_of_nothing(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs, asked).count() == 0
    assert search.search(asked.withColumnRenamed("item_id", "doc_id"), asked.limit(0)).count() == 0


def test_partial_sums_stay_exact():
    """Tiles of few terms: sums beyond 2**53 over all terms are added as whole numbers."""
    rng = np.random.default_rng(6)
    w, terms, docs = rng.integers(1, 1 << 20, size=(3, 90)), 90, 5
    ids, at = np.repeat(np.arange(terms), docs), np.tile(np.arange(docs), terms)
    impact = rng.integers(1, 1 << 30, size=terms * docs)
    tile = 8
    made = lambda first: np.pad(w, ((0, 0), (0, tile)))[:, first : first + tile].astype(float)
    got = search.multiply(made, at, ids, impact.astype(float), docs, 3, tile)
    assert (got == w @ impact.reshape(terms, docs)).all()
