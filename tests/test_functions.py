"""Kernels against independent arithmetic."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import columns, seeded, stats, text


def poisson_tail_exact(n, lam):
    return 1.0 if n <= 0 else max(0.0, 1.0 - math.fsum(
        math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) for k in range(n)))


def test_poisson_tail_matches_direct_sum(spark):
    cases = [(0, 2.0), (1, 0.5), (3, 0.5), (5, 2.0), (7, 7.0), (40, 30.0), (900, 880.0), (5000, 5100.0)]
    df = spark.createDataFrame(cases, "n int, lam double")
    for row in df.select("n", "lam", stats.poisson_tail(F.col("n"), F.col("lam")).alias("p")).collect():
        assert row.p == pytest.approx(poisson_tail_exact(row.n, row.lam), rel=1e-9, abs=1e-12)


def test_poisson_far_tail_keeps_digits_and_large_rates_do_not_underflow(spark):
    df = spark.createDataFrame([(60, 1.0), (2000, 1500.0)], "n int, lam double")
    far, large = [r.p for r in df.select(stats.poisson_tail(F.col("n"), F.col("lam")).alias("p")).collect()]
    lead = math.exp(60 * math.log(1.0) - 1.0 - math.lgamma(61))
    assert lead < far < lead * 1.02
    assert 0 < large < 1e-30


def test_log_factorial(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 10, 14, 15, 16, 100, 12345)], "n int")
    for row in df.select("n", stats.log_factorial(F.col("n")).alias("v")).collect():
        assert row.v == pytest.approx(math.lgamma(row.n + 1), rel=1e-12, abs=1e-12)


def test_seeded_uniform_is_a_plain_md5_draw(spark):
    df = spark.createDataFrame([("abc",), ("xyz",)], "k string")
    for row in df.select("k", seeded.seeded_uniform(7, F.col("k")).alias("u")).collect():
        bits = int(hashlib.md5(f"7|{row.k}".encode()).hexdigest()[:13], 16)
        assert row.u == bits / 16 ** 13


def test_student_t_known_values():
    assert stats.student_t_two_sided(0.0, 10) == 1.0
    assert stats.student_t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.student_t_two_sided(12.7062047364, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.student_t_two_sided(1.959963985, 1e9) == pytest.approx(0.05, abs=1e-7)


def test_binomial_draws_follow_the_distribution():
    u = (np.arange(20000) + 0.5) / 20000
    for n, k in ((100, 3), (10_000, 40), (10 ** 8, 5 * 10 ** 5)):
        draws = stats.binomial_quantiles(u, n, k)
        assert draws.mean() == pytest.approx(k, rel=2e-3)
        assert draws.std() == pytest.approx(math.sqrt(k * (1 - k / n)), rel=1e-2)
    assert (stats.binomial_quantiles(u, 10, 0) == 0).all() and (stats.binomial_quantiles(u, 10, 10) == 10).all()


def test_sorted_median_even_and_odd(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0],), ([1.0, 2.0, 4.0, 9.0],)], "a array<double>")
    assert [r.m for r in df.select(stats.sorted_median(F.col("a")).alias("m")).collect()] == [2.0, 3.0]


def test_folded_text_matches_across_case_and_lookalikes(spark):
    rows = [("I like ALPHAPAY",), ("alphapays",), ("xalphapay",), ("alpha-PAY!",), ("ſuper",), ("",)]
    df = spark.createDataFrame(rows, "t string").withColumn("f", text.folded(F.col("t")))
    hit = [r.h for r in df.select(text.mentions_any(F.col("f"), ["alphapay", "alpha-pay", "super"]).alias("h")).collect()]
    assert hit == [True, False, False, True, True, False]


def test_floor_to_bin_per_row_width(spark):
    df = spark.sql("select timestamp_ntz'2024-01-05 19:45:30' t, 3 h union all select timestamp_ntz'2024-01-05 19:45:30', 1")
    got = {r.h: str(r.b) for r in df.select("h", columns.floor_to_bin(F.col("t"), F.col("h")).alias("b")).collect()}
    assert got == {3: "2024-01-05 18:00:00", 1: "2024-01-05 19:00:00"}


def test_word_count_one_line_and_dictionary(spark, tmp_path):
    from feedloom.sources.files import read_dictionary
    df = spark.createDataFrame([("a b  c",), ("one\ntwo",)], "t string")
    out = df.select(text.word_count(F.col("t")).alias("n"), text.one_line(F.col("t")).alias("l")).collect()
    assert [tuple(r) for r in out] == [(4, "a b  c"), (1, "one two")]
    (tmp_path / "aliases.yaml").write_text("alphapay:\n  - alphapay\n  - alpha pay\n")
    assert read_dictionary(str(tmp_path / "aliases.yaml")) == {"alphapay": ["alphapay", "alpha pay"]}
