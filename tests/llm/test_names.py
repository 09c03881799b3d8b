"""Different texts of one CRC-32, both without an id, are different documents."""

import random
import zlib

import pytest

from feedloom.llm import jaccard, substrings, suffixes


@pytest.fixture(scope="module")
def rows():
    r = random.Random(0)
    base = " ".join(f"word{r.randint(0, 9999)}" for _ in range(118))
    short = {zlib.crc32(t.encode()): t for t in (f"one two {i}" for i in range(120_000))}
    long = next(t for t in (f"{base} end {i}" for i in range(10_000_000)) if zlib.crc32(t.encode()) in short)
    return [(None, long), (None, short[zlib.crc32(long.encode())]), (1, long)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_word_windows(spark, rows):
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substrings.dedup_windows(frame(spark, rows)).collect())
    assert got == [(False, 120, 0), (True, 3, 0), (True, 120, 120)]


def test_byte_strings(spark, rows):
    size, small = len(rows[0][1]), len(rows[1][1])
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in suffixes.dedup_bytes(frame(spark, rows)).collect())
    assert got == [(False, size, 0), (True, small, 0), (True, size, size)]


def test_components(spark, rows):
    got = sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect() if r.n_shingles != 1)
    assert got == [(False, 116, 1), (True, 116, 1)]
    assert [(r.doc_id, r.component_id) for r in jaccard.near_duplicates(frame(spark, rows)).collect() if r.n_shingles == 1] == [(None, None)]
    kept = {r.text for r in jaccard.first_of_each(frame(spark, rows)).collect()}
    assert kept == {rows[0][1], rows[1][1]}
