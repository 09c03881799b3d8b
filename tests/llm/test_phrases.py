"""Collocations against brute force: nulls, empty and very long texts, repeats, colliding fingerprints, an empty table, clashing columns."""

import random
import re
from collections import Counter

import pytest

from feedloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, row long, bucket int, blob string, phrase string, n int, f long, place string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, 8, "x", "y", 9, 10, "z") for i, t, lang in rows], SCHEMA)


def expected(rows, longest=3, least=10, share=50, first=2000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i:i + n])] += 1
    frequent = {k: v for k, v in f.items() if v >= least and len(k[1]) >= 2}
    out = []
    for (lang, p), a in frequent.items():
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [v for (other, q), v in frequent.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * v >= share * a for v in longer):
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:first])]
    return ranked


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = "The of New York über né a b c x\x00y  q".split(" ")
    out = [(i, r.choice([" ", "  ", "\t"]).join(r.choice(words) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, ""])) for i in range(60)]
    out += [(100, None, "en"), (101, "", None), (102, "   \t", "en"), (103, ".,;:!?", "en"), (None, "new york " * 30, "en"), (None, "new york " * 30, "en")]
    out += [(104, "a b c " * 40, "fr"), (105, "a b c " * 40, "fr"), (106, "one two. three four " * 12, "fr"), (107, "A B\rC D\x0bE F\x0cG H;" * 15, "en")]
    return out


def test_collocations_equal_brute_force(spark, rows):
    assert got(phrases.collocations(frame(spark, rows))) == expected(rows)


def test_parameters(spark, rows):
    assert got(phrases.collocations(frame(spark, rows), longest=4, least=5, share=80, first=7)) == expected(rows, 4, 5, 80, 7)


@pytest.mark.parametrize("bits", [1, 7])
def test_colliding_fingerprints_are_told_apart(spark, rows, bits):
    assert got(phrases.collocations(frame(spark, rows), bits=bits)) == expected(rows)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 64)
    monkeypatch.setattr(phrases, "CHUNK", 256)
    monkeypatch.setattr(phrases, "PIECE", 32)
    r = random.Random(8)
    long = [" ".join(r.choice("abc de f ghi".split()) for _ in range(4000)), "ab " * 500 + "." + "x" * 900 + " y" * 300, "one two,three" * 200, "z" * 2000]
    rows = [(i, t, "en") for i, t in enumerate(long)]
    # workers take the changed module constants with the functions
    assert got(phrases.collocations(frame(spark, rows))) == expected(rows)


def test_segments_own_each_start_once():
    text = b"aa bb  cc\tdd. ee " * 9000
    old, phrases.SEGMENT = phrases.SEGMENT, 1000
    try:
        parts = list(phrases.segments(text, 3))
    finally:
        phrases.SEGMENT = old
    assert parts[0][0] == 0 and all(a + own == b for (a, own, _), (b, _, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] == len(text)
    assert all(text[a:a + len(x)] == x and len(x) >= own for a, own, x in parts)


def test_planes_round_trip():
    import numpy as np
    r = np.random.default_rng(1)
    columns = [np.sort(r.integers(0, 1 << 62, 500)).astype(np.uint64), r.integers(0, 3, 500), np.zeros(500, int), r.integers(0, 1 << 40, 500)]
    blob = b"xy" + phrases.packed(columns) + phrases.packed(columns)
    first, at = phrases.unpacked(blob, 2, 4, (0, 1, 2, 3))
    second, end = phrases.unpacked(blob, at, 4, (0, 3))
    assert all((a == b).all() for a, b in zip(first, columns, strict=True)) and end == len(blob)
    assert (second[0] == columns[0]).all() and (second[1] == columns[3]).all()


def test_empty_table(spark):
    assert got(phrases.collocations(frame(spark, []))) == []
