"""Token-id files: memory of a whole segment, ids of many texts at a time, and segments with many rare ids."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import tokenbin
from parley.llm.tokens import WordIds, default_vocabulary

TEXTS = [
    "", " ", "The the\tTHE\n\n the", "It's 'tis don't. can''t 3's they'll", "a1b22 c, d...e!! (f)", "x<|endoftext|>y <|", "z" * 300 + "," * 250,
    "École élève; naïve × ÷ ª µ º ß\x85\xa0|", "  before", "after  ", "中文 and English 日本", "", "one\x0btwo\x0cthree\rfour", "'", "#*$ %&|<>",
]


def test_a_whole_segment_takes_little_memory():
    ids = np.resize(np.random.default_rng(1).integers(0, 3000, 50_000), tokenbin.SEGMENT)
    tracemalloc.start()
    try:
        data = tokenbin.pack_segment([1], [len(ids)], ids)
        back = tokenbin.open_segment(data)[2]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(back, ids)
    assert peak < 70e6


def test_many_texts_at_a_time_equal_the_library():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(default_vocabulary()), WordIds(default_vocabulary(), limit=20)
    for group in (TEXTS, TEXTS[::-1], TEXTS[:1], TEXTS[:2], TEXTS[10:11], [], TEXTS * 3):
        ids, lengths = words.encode_all([t.encode() for t in group])
        expected = [whole.encode(t, add_special_tokens=False).ids for t in group]
        assert lengths.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [x for own in expected for x in own]


def test_texts_are_grouped_by_size(monkeypatch):
    monkeypatch.setattr(tokenbin, "GROUP", 10)
    texts = ["abcd", None, "efgh", "x" * 30, "", "ij", "k" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    assert [b.column(1).to_pylist() for b in tokenbin._groups([batch, batch.slice(7)])] == [["abcd", None, "efgh"], ["x" * 30], ["", "ij"], ["k" * 9]]


@pytest.mark.parametrize("often, rare", [(300_000, 40_000), (700_000, 300_000), (0, 60_000)])
def test_many_rare_ids(often, rare):
    ids = np.concatenate((np.zeros(often, dtype=np.int64), np.random.default_rng(2).permutation(rare)))
    assert (tokenbin.Order0.of(ids).freq > 0).all()
    assert np.array_equal(tokenbin.open_segment(tokenbin.pack_segment([1], [len(ids)], ids))[2], ids)
