"""Ids of many documents packed together: the same bytes as one by one, and back; the encoder's two-generation cache."""

import random

import numpy as np
import pytest

from feedloom.llm import common, tokenfile

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_documents_packed_together_equal_one_by_one():
    r = np.random.default_rng(3)
    counts = np.r_[r.integers(0, 9, 200), 0, 1, 4, 5000, 0]
    ranks = (r.integers(0, 1 << 32, counts.sum(), dtype=np.uint64) >> (8 * r.integers(0, 4, counts.sum())).astype(np.uint64)).astype(np.uint32)
    control, data = tokenfile.pack_documents(ranks, counts)
    ends = np.cumsum(counts)
    assert [(c, d) for c, d in zip(control, data)] == [tokenfile.pack_ranks(ranks[e - n:e]) for e, n in zip(ends, counts)]
    assert (tokenfile.unpack_documents(control, data, counts) == ranks).all()
    parts = list(tokenfile.runs_of(counts))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(counts))) and list(tokenfile.runs_of(counts[:0])) == []


def test_long_documents_are_packed_in_runs(monkeypatch):
    monkeypatch.setattr(tokenfile, "CODED_IDS", 10)
    counts = np.array([3, 3, 3, 3, 50, 0, 0, 10, 1])
    assert [(p.start, p.stop) for p in tokenfile.runs_of(counts)] == [(0, 3), (3, 4), (4, 5), (5, 8), (8, 9)]


@pytest.mark.parametrize("units", [2, 10, 1000])
def test_a_small_cache_gives_the_same_ids(monkeypatch, units):
    monkeypatch.setattr(tokenfile, "CACHE_UNITS", units)
    monkeypatch.setattr(tokenfile, "CACHE_TAILS", 2)
    r = random.Random(units)
    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["the", "The", "river,", "river", "né", "né!?", "日本。", "x" * 300, "it's", "'s", "...", "a.\nB", "12,5", "", "don't\n\nknow", "end.", "ß))))", "word\n"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(300)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]
    assert len(encoder) <= units and len(encoder.old) <= units and len(encoder.tails) <= 2


def test_line_feeds_between_words_cut_a_text():
    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    marks = ["\n", "\n", "\n\n", " \n", "\n ", "\t\n", "\n\t", "\n\xa0", "\u2003\n", "\n\x1c", "\x1c\x1c\n", "\x85\n", " ", " ", "  ", ""]
    words = ["the", "river.", "né,", "日本", "it's", "12", "...", "x" * 300, "", "End"]
    texts = ["a.\nB c\nd", "\na", "a\n", "a \nb\nc", "\n", "\n\n", "a\n\n", " \n\na\nb"]
    texts += ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]

    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]
    encoder.encode(["\n".join([a, b]) + " " + b for a in words for b in words])      # kept by word, not by pair of words
    assert len(encoder) <= 3 * len(words)


def test_a_worker_drops_what_is_forgotten():
    common.per_worker("test_kept", list).append(1)
    assert common.per_worker("test_kept", list) == [1]
    common.forget("test_kept")
    common.forget("test_kept")
    assert common.per_worker("test_kept", list) == []


def test_new_words_of_many_texts_share_calls_of_the_model(monkeypatch):
    encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    calls, merge = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda text: calls.append(text) or merge(text))
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéßж") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(w + r.choice(["", "", ",", "."]) for w in words[a:a + 50]) for a in range(0, 3000, 50)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
    assert encoder.encode(texts) == want and len(calls) < 100
    assert encoder.encode(texts) == want and len(calls) < 100


@pytest.mark.parametrize("units, pieces", [(1, 1), (3, 2), (1 << 15, 64)])
def test_texts_looked_up_in_parts_have_the_same_ids(monkeypatch, units, pieces):
    monkeypatch.setattr(tokenfile, "UNITS", units)
    monkeypatch.setattr(tokenfile, "PIECES", pieces)
    r = random.Random(11)
    words = ["The", "river", "river,", "né!", "\0", "a\0b", "日本", "x" * 300, "x" * 300 + ".", "it's", "a\nb", "a\nb\n\nc", "12", "", "Ā", "ĀĠ,", "<|endoftext|>", "ab\t"]
    texts = ["", *[" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(500)]]
    for bar in (True, False):
        encoder = tokenfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
        assert encoder.bar is not None
        if not bar:     # a vocabulary that merges every byte: word by word
            encoder.bar = None
        want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() for t in texts]
        assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]
