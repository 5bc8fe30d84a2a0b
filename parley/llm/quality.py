"""Quality rules: plain text counts, and tokeniser fertility with rejection bands per language.

Each word is encoded by public vocabularies as it stands in running text (with the space before it). A document's
fertility features are characters per token, the share of byte-fallback tokens and the entropy of its tokens. For
every language the median and the spread of each feature over all documents that pass the base rules give the band,
drawn towards the whole corpus as if PRIOR of its documents were among the language's own, so no size of a language
flips a verdict; the band spans both medians while the language has few documents. Two more figures follow from the features and have
bands: tokens per word, which signs hung on words raise, and the entropy in excess of what a text of this many tokens
has (a curve fitted over all those documents), which signs repeated between words lower. A document is kept if it
passes the base rules and all five figures lie in the bands; characters per token have no upper and tokens per word no
lower bound.

Defined results: null and empty texts have zero counts and fail the base rules; a null language is a language of its
own; repeated rows keep a row each; an empty table gives an empty table; extra columns travel along.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Widths of a band below and above the median in robust spreads (quartile distance / 1.349), and the least spread of each figure.
#: A side without a width has no bound: text that tokenises better than its language's is not rejected for that.
BAND_WIDTH = {"chars_per_token": (8.0, None), "fallback_share": (8.0, 8.0), "token_entropy": (8.0, 8.0), "tokens_per_word": (None, 8.0), "entropy_excess": (5.0, 12.0)}
LEAST_SPREAD = {"chars_per_token": 0.08, "fallback_share": 0.01, "token_entropy": 0.05, "tokens_per_word": 0.05, "entropy_excess": 0.05}
#: Documents of the whole corpus that count into each language's median and spread.
PRIOR = 3.0
#: Words that a worker remembers.
_LIMIT = 240_000
_WHITE = re.compile(r"\s")
_FEATURES = ("chars_per_token", "fallback_share", "token_entropy")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SIGNS = tuple(s.encode() for s in "#*$%&|<>")
_MEMO: dict[str, "Fertility"] = {}


class Fertility(common.Recent):
    """Word -> (subword ids, byte-fallback tokens, byte-level tokens, characters)."""

    def __init__(self, pieces: str, ranks: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

        self.spaced = np.zeros(max(known.values()) + 1, dtype=bool)
        self.spaced[[i for token, i in known.items() if token.startswith(b" ")]] = True
        super().__init__(lambda word: self.many([word])[0], _LIMIT)

    def many(self, words: list[bytes]) -> list[tuple[bytes, int, int, int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.pieces.encode(texts, num_threads=1)
        ends = np.cumsum([0, *map(len, found)])
        ids = np.fromiter(chain.from_iterable(found), dtype="<u2", count=int(ends[-1]))
        flat, fallback = ids.tobytes(), np.concatenate(([0], np.cumsum(self.fallback[ids])))
        bounds = ends.tolist()
        parts = [flat[2 * a : 2 * b] for a, b in zip(bounds, bounds[1:])]
        return list(zip(parts, np.diff(fallback[ends]).tolist(), self._byte_tokens(texts), map(len, texts)))

    def _byte_tokens(self, texts: list[str]) -> list[int]:
        """Byte-level tokens of each word with the space before it. Words are encoded as one text: every word's first token,
        and no other, starts with a space. Words that hold white space of other kinds are encoded alone."""
        if _WHITE.search("".join(texts)) is None:
            tokens = np.array(self.bytes.encode_ordinary(" " + " ".join(texts)))
            first = np.flatnonzero(self.spaced[tokens])
            if len(first) == len(texts):
                return np.diff(first, append=len(tokens)).tolist()
        return [len(self.bytes.encode_ordinary(" " + t)) for t in texts]


def fertility(pieces: str | None = None, ranks: str | None = None) -> Fertility:
    import public_tokenizers

    pieces, ranks = pieces or public_tokenizers.path("piece_bpe_32k.model"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if pieces + ranks not in _MEMO:
        _MEMO[pieces + ranks] = Fertility(pieces, ranks)
    return _MEMO[pieces + ranks]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text, the first one included."""
    if len(words) < 3:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes, memo: Fertility) -> tuple:
    words = text.split()
    n_symbols = sum(text.count(s) for s in _SIGNS)
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    got = memo.all(words)
    chars = sum([g[3] for g in got])
    ids = np.frombuffer(b"".join([g[0] for g in got]), dtype="<u2")
    if len(ids):
        share = np.bincount(ids)
        share = share[share > 0] / len(ids)
        entropy = float(-(share * np.log2(share)).sum()) / max(1.0, float(np.log2(len(ids))))
        features = (chars / max(1, sum([g[2] for g in got])), sum([g[1] for g in got]) / len(ids), entropy)
    else:
        features = (0.0, 0.0, 0.0)
    return (len(words), chars, n_symbols, dup, repeat_words(words), *features)


def features(docs: DataFrame, pieces: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, tkey, lang, the base counts and the fertility features of every row, without the text."""
    rows = docs.select("doc_id", common.text_key(F.col("text")).alias("tkey"), (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"), "text")

    def run(batches):
        memo = fertility(pieces, ranks)
        try:
            for batch in common.slices(batches):
                found = [measure(t, memo) for t in common.as_bytes(batch.column("text"))]
                cols = list(zip(*found)) if found else [()] * 8
                kinds = [pa.int64()] * 5 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "tkey", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *_FEATURES])
        finally:
            memo.forget()

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, tkey long, lang string, {BASE}, " + ", ".join(f"{f} double" for f in _FEATURES))


def excess(found: DataFrame) -> DataFrame:
    """Adds tokens_per_word and entropy_excess (bits) to the features; the curve is fitted over all rows that pass the base rules."""
    tokens = F.greatest(F.col("word_chars") / F.when(F.col("chars_per_token") > 0, F.col("chars_per_token")), F.lit(1.0))
    # Entropy levels off with length: a constant and two falling powers of the number of tokens.
    basis = [F.lit(1.0), F.pow(tokens, F.lit(-0.5)), F.pow(tokens, F.lit(-0.25))]
    bits = F.col("token_entropy") * F.greatest(F.log2(tokens), F.lit(1.0))
    sums = found.where("not base_failed").agg(*[F.sum(x * y) for x in basis for y in (*basis, bits)]).first()
    m = np.array([x or 0.0 for x in sums]).reshape(3, 4)
    fit = np.linalg.lstsq(m[:, :3], m[:, 3], rcond=1e-12)[0]
    curve = sum(F.lit(float(c)) * x for c, x in zip(fit, basis))
    return found.withColumn("tokens_per_word", F.coalesce(tokens / F.when(F.col("n_words") > 0, F.col("n_words")), F.lit(0.0))).withColumn("entropy_excess", F.coalesce(bits - curve, F.lit(0.0)))


def bands(found: DataFrame) -> DataFrame:
    """Per language: low and high bound of each figure, from quartiles over all rows that pass the base rules."""
    good = found.where("not base_failed")
    quart = [F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000).alias(f) for f in BAND_WIDTH]
    whole = good.agg(*quart).first()
    by = good.groupBy(F.coalesce("lang", F.lit("")).alias("band_lang")).agg(F.count("*").alias("n"), *quart)

    def bound(f: str, sign: int):
        n, own, least = F.col("n"), F.col(f), LEAST_SPREAD[f]
        low, middle, high = (float(x) for x in (whole[f] or [0, 0, 0]))
        part = n / (n + PRIOR)
        apart = (1 - part) * (own[1] - middle)
        within = part * F.pow((own[2] - own[0]) / 1.349, F.lit(2.0)) + (1 - part) * max((high - low) / 1.349, least) ** 2
        # The last factor: quartiles of few documents say little.
        spread = F.sqrt(F.greatest(within + apart * apart, F.lit(least**2)) * (1 + PRIOR / n))
        return (own[1] - apart + sign * BAND_WIDTH[f][sign > 0] * spread).alias(f"{f}_{'high' if sign > 0 else 'low'}")

    return by.select("band_lang", *[bound(f, sign) for f in BAND_WIDTH for sign in (-1, 1) if BAND_WIDTH[f][sign > 0]])


def judge(found: DataFrame) -> DataFrame:
    """Adds base_failed and kept to the features."""
    found = found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    full = excess(found)
    by, _ = common.store(bands(full), "bands")
    by = F.broadcast(by) if by.count() <= 1000 else by
    inside = F.lit(True)
    for f in BAND_WIDTH:
        low, high = BAND_WIDTH[f]
        inside = inside & (F.col(f) >= F.col(f"{f}_low") if low else F.lit(True)) & (F.col(f) <= F.col(f"{f}_high") if high else F.lit(True))
    joined = full.join(by, F.coalesce("lang", F.lit("")) == F.col("band_lang"), "left")
    # A language in which every row fails the base rules has no band and keeps nothing.
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(*found.columns, "kept")


def assess(docs: DataFrame, pieces: str | None = None, ranks: str | None = None) -> DataFrame:
    """Features and verdict of every row (with tkey, the text's key)."""
    found, _ = common.store(features(docs, pieces, ranks), "fertility")
    return judge(found)


def digest(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *_FEATURES)


def keep_good(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs whose verdict is kept."""
    return common.matched(docs, verdicts.where("kept").select("doc_id", "tkey").distinct(), "left_semi")
