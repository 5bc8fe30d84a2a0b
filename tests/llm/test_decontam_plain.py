"""Decontamination against a plain loop; short items, scripts without spaces, punctuation beyond ASCII."""

import random
import re
import statistics
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import decontam

_WORD = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]|(?:[0-9a-z]|[^\x00-\x7f฀-໿က-႟ក-៿ -⁯　-ヿ㐀-䶿一-鿿豈-﫿＀-／：-＠［-｀｛-･\U00020000-\U000323af])+")
_SOLO = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]")


def words(text):
    return _WORD.findall((text or "").lower())


def aligned(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), dtype=int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def plain(docs, items, threshold=decontam.THRESHOLD, n=decontam.N):
    """doc_id -> (item_id, score) of the best item, by the documented method in single steps."""
    texts = {d: words(t) for d, t in docs}
    best = {}
    held = {i: words(t) for i, t in items if words(t)}
    seeds = {i: {tuple(w[k : k + min(n, len(w))]) for k in range(max(1, len(w) - n + 1))} for i, w in held.items()}
    sizes = {len(s) for v in seeds.values() for s in v} | {n}
    places = defaultdict(list)
    for d, w in texts.items():
        for size in sizes:
            for k in range(len(w) - size + 1):
                places[tuple(w[k : k + size])].append((d, k))
    rows = {s: len({d for d, _ in places[s]}) for v in seeds.values() for s in v}
    for i, w in held.items():
        usual = statistics.median(rows[s] for s in seeds[i])
        rare = [s for s in seeds[i] if rows[s] <= max(decontam.FLOOR, decontam.FACTOR * usual)]
        worth = len(w) - len(_SOLO.findall(dict(items)[i])) / 2
        needed = min(max(threshold, decontam.STRICT), max(threshold, decontam.EVIDENCE / max(worth, 1)))
        around = len(w) + len(w) // 2 + n
        by = defaultdict(set)
        for s in rare:
            for d, k in places[s]:
                by[d].add(k)
        for d, ks in by.items():
            ks, groups = sorted(ks), []
            for k in ks:
                if groups and k - groups[-1][-1] <= around:
                    groups[-1].append(k)
                else:
                    groups.append([k])
            for g in groups:
                score = aligned(w, texts[d][max(0, g[0] - around) : g[-1] + around]) / (2 * len(w))
                if score >= needed and (d not in best or (score, -i) > (best[d][1], -best[d][0])):
                    best[d] = (i, score)
    return best


@pytest.mark.parametrize("filter_bytes", [0, 1 << 20])
def test_like_a_plain_loop(spark, filter_bytes):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)] + ["日", "本", "語", "で", "す"]
    line = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(line(rnd.choice((2, 6, 9, 14, 30))))) for i in range(12)] + [(20, None), (21, " .,; "), (22, "日本語です 日本")]
    docs = []
    for d in range(60):
        text = line(rnd.randrange(1, 90))
        if d % 2:
            part = (items[rnd.randrange(12)][1]).split()
            part = [rnd.choice(vocabulary) if rnd.random() < 0.2 else w for w in part]
            at = rnd.randrange(len(text))
            text[at:at] = part
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, docs[1][1])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["score"]) for r in decontam.report(*frames, filter_bytes=filter_bytes).where("contaminated").collect()}
    want = plain(docs, items)
    assert set(got) == set(want) and len(want) >= 10
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-6 for d in want)


def test_short_items_need_more_than_a_common_phrase(spark):
    items = [(1, "What is the capital city of Norway"), (2, "How many legs does a spider have"), (3, "the sum of two even numbers is even")]
    docs = [(1, "last year they moved the capital city of Bergen north"), (2, "how many legs does a table need"), (3, "the sum of two parts is what we want"), (4, "so: what is the capital city of Norway?"), (5, "asked what is the capital town of Norway again"), (6, "how many legs does one spider have then")]
    got = {r["doc_id"]: r["item_id"] for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert got == {4: 1, 5: 1, 6: 2}


def test_scripts_without_spaces(spark):
    item = "日本の首都である東京はどの地方にありますか"
    thai = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"
    docs = [(1, f"昨日の試験では「{item}」という問題が出ました。"), (2, "昨日は日本の首都について少し話しました。"), (3, "เขาบอกว่า" + thai + "และสวยงาม"), (4, "“To be” — or not: to be or what then is it that we are asked"), (5, f"{item[:9]}それ{item[11:]}")]
    items = [(1, item), (2, thai), (3, "to be or what then is it that we are")]
    got = {r["doc_id"]: r["item_id"] for r in decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert got == {1: 1, 3: 2, 4: 3, 5: 1}


def test_word_spans_are_those_of_the_pattern():
    rnd = random.Random(9)
    signs = "aZ9 .-é‘“—日本。、กข　 ſ\U00020001\U0001f600ｆ！ﾞ￿"
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(12))).lower()
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        start, end = decontam.word_spans(data)
        assert [text.encode()[a:b].decode() for a, b in zip(start, end)] == words(text), text
