"""Verdicts of the fertility bands on texts whose right answer is known."""

import numpy as np
import pytest

from parley.llm import quality

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {
    "en": "the ing er on and in sh that wh ou st re en tion le ed ha ly", "de": "en er der ein sch ge ung be zu die keit lich te an und tz",
    "fr": "le de en ou ch que eau tion re la ment elle vi par eux oui", "es": "el de la os que ción ar do en al se mente as ci es ll",
}
SIGNS = ("$$$", "&&&", "%%%", "###", "***")


def prose(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return ["".join(rng.choice(parts, int(rng.integers(1, 5)))) for _ in range(n)]


def corpus(count, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i, lang in enumerate(lang for lang, n in count.items() for _ in range(n)):
        out.append((i, " ".join(prose(rng, lang, int(rng.integers(60, 400)))), lang))
    return out


def signed(rng, lang, n):
    return " ".join(w + str(rng.choice(SIGNS)) for w in prose(rng, lang, n))


@pytest.mark.parametrize("each", [25, 220])
def test_sign_ridden_text_is_rejected_and_clean_text_kept(spark, each):
    rng = np.random.default_rng(6)
    rows = corpus({lang: each for lang in SYLLABLES})
    for i, lang in enumerate(SYLLABLES):
        rows += [(10_000 + 10 * i, signed(rng, lang, 120), lang), (10_001 + 10 * i, " | ".join(prose(rng, lang, 200)), lang), (10_002 + 10 * i, " ".join(prose(rng, lang, 120)), lang)]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(len(SYLLABLES)):
        assert [kept[10_000 + 10 * i + j] for j in range(3)] == [False, False, True]
    assert sum(kept[i] for i in range(4 * each)) >= 0.99 * 4 * each


def test_small_languages_keep_clean_text_and_do_not_flip_at_a_count(spark):
    rng = np.random.default_rng(7)
    # A script that the vocabularies split into bytes: far from the mostly English corpus.
    letters = [chr(c) for c in range(0x1400, 0x1440)]
    far = [" ".join("".join(rng.choice(letters, 5)) for _ in range(90)) for _ in range(3)]
    rows = corpus({"en": 300}) + [(9000 + i, t, "iu") for i, t in enumerate(far)]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[9000 + i] for i in range(3))
    # The bounds of a language of 199 and of 200 equal documents differ by next to nothing.
    base = [(i, "en", 100, 480, 2.2, 0.0, 0.7) for i in range(1000)]
    schema = "doc_id long, lang string, n_words long, word_chars long, chars_per_token double, fallback_share double, token_entropy double"
    low = []
    for n in (199, 200):
        found = spark.createDataFrame(base + [(5000 + i, "es", 100, 500, 1.6 + 0.01 * (i % 9), 0.0, 0.7) for i in range(n)], schema).selectExpr("*", "false AS base_failed")
        low.append({r["band_lang"]: r for r in quality.bands(quality.excess(found)).collect()}["es"]["chars_per_token_low"])
    assert abs(low[0] - low[1]) < 0.01


def test_text_that_tokenises_better_than_its_language_is_kept(spark):
    """Plain English in a corpus of invented words, whichever language it is said to be; the same word again and again is not."""
    plain = (
        "Every morning the small bakery on the corner opened its doors before the sun came up, and people who worked early stopped there for bread. The owner knew most of them by name and asked about their families "
        "while she wrapped the loaves in brown paper. In winter the windows were covered with steam and children drew pictures on the glass. Nobody could remember a time when the shop had been closed for more than a day."
    )
    rows = corpus({lang: 200 for lang in SYLLABLES}) + [(9000 + i, plain, lang) for i, lang in enumerate(("en", "de", None))] + [(9100, "information " * 200, "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [kept[9000 + i] for i in range(3)] == [True, True, True] and not kept[9100]
