import math

import pytest
from pyspark.sql import functions as F

from rulewright.functions import pvalues
from rulewright.operators import profile
from rulewright.sources import scratch


@pytest.mark.parametrize("stat, p", [(164.8445853547484, 9.891452325709224e-38), (46.8264096696591, 7.756112316055935e-12), (0.15230422845961583, 0.6963430091535003)])
def test_chi2_golden(stat, p):
    assert pvalues.chi2_sf(stat, 1) == pytest.approx(p, rel=1e-12)
    assert pvalues.gamma_sf(0.5, stat / 2) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("r, p", [(0.3521866555212368, 4.781340463772632e-16), (-0.18709604766761376, 2.5496494196245586e-05), (0.008638596264379928, 0.8472056625403448)])
def test_pearson_golden(r, p):
    assert pvalues.pearson_p(r, 500) == pytest.approx(p, rel=1e-10)


@pytest.mark.parametrize("u, p", [(31172.0, 0.9639522535), (30152.0, 0.4986091627), (29833.0, 0.3820236847), (23061.5, 4.0534414729e-07)])
def test_mwu_normal_golden(u, p):
    assert pvalues.mwu_p(u, 247, 253, 0) == pytest.approx(p, rel=1e-9)


def test_mwu_exact_counts_all_orders():
    assert pvalues.mwu_p(0, 3, 5, 0) == pytest.approx(2 / math.comb(8, 3))
    assert pvalues.mwu_orders(24, 4, 6) == math.comb(10, 4)
    assert pvalues.mwu_p(7.5, 3, 5, 0) == 1.0
    assert pvalues.mwu_p(5, 0, 5, 0) is None
    assert pvalues.mwu_p(12.5, 5, 5, 10**3 - 10) == 1.0  # all tied


def test_pearson_of_few_rows():
    assert pvalues.pearson_p(1.0, 2) == 1.0
    assert pvalues.pearson_p(0.3, 1) is None


def test_profile_edges(spark):
    rows = [(i % 2, None, 5.0, "01"[i % 2], f"c{i % 25}", float(i), float("nan") if i % 3 else 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "y int, gone double, same double, text01 string, many string, x double, nan double")
    got = {r["feature"]: r for r in profile.profile_table(df, "y").collect()}
    assert got["gone"]["feature_type"] == "binary" and got["gone"]["n_valid"] == 0 and got["gone"]["level_counts"] == "{}"
    assert got["same"]["feature_type"] == "continuous" and got["same"]["direction"] == "neg" and got["same"]["pointbiserial_r"] is None
    assert got["same"]["method"] == "mwu" and got["same"]["mwu_p"] == 1.0
    assert got["text01"]["feature_type"] == "binary" and got["text01"]["p_value"] < 1e-9
    assert got["many"]["n_unique"] == 25 and '"__OTHER__":10' in got["many"]["level_counts"]
    assert got["x"]["median"] == 24.5 and got["x"]["n_valid"] == 50
    assert got["nan"]["feature_type"] == "binary" and got["nan"]["missing_rate"] == pytest.approx(33 / 50)
    assert sorted(r["rank"] for r in got.values()) == list(range(1, 7))


def test_one_level_and_one_class(spark):
    df = spark.createDataFrame([(i % 2, "a") for i in range(6)], "y int, f string")
    row = profile.profile_table(df, "y").first()
    assert (row["chi2_stat"], row["chi2_p"]) == (0.0, 1.0)
    row = profile.profile_table(spark.createDataFrame([(1, "a"), (1, "b")], "y int, f string"), "y").first()
    assert row["chi2_stat"] is None and row["p_value"] is None


def test_cumulative_is_exact_across_buckets(spark):
    values = [(i * 7919) % 1000 for i in range(3000)]
    df = spark.createDataFrame([(v % 2, float(v)) for v in values], "y int, x double")
    h = profile.histogram(df, "y")
    got = {r["num"]: r["before"] for r in profile.cumulative(profile._continuous(h, profile.classify_features(h))).collect()}
    assert all(got[float(v)] == sum(w < v for w in values) for v in set(values))


def plain_orders(u, m, n):
    """By the recurrence on the largest value: it belongs to one sample or the other."""
    table = {}

    def count(u, m, n):
        if u < 0:
            return 0
        if not m or not n:
            return 1
        if (u, m, n) not in table:
            table[u, m, n] = count(u - n, m - 1, n) + count(u, m, n - 1)
        return table[u, m, n]

    return count(u, m, n)


@pytest.mark.parametrize("m", range(1, 9))
def test_orders_are_counted_exactly(m):
    for n in (m, m + 1, 17, 40):
        assert [pvalues.mwu_orders(u, m, n) for u in range(-1, m * n + 1, 7)] == [plain_orders(u, m, n) for u in range(-1, m * n + 1, 7)]


@pytest.mark.parametrize("n", [4999, 5000, 5001, 1_000_000, 10**12])
def test_exact_p_of_a_small_and_a_huge_sample(n):
    """At both sides of the cells that once were the limit, and far beyond: all 8 values below, or all but one order of them."""
    assert pvalues.mwu_p(0, 8, n, 0) == pytest.approx(2 / math.comb(n + 8, 8), rel=1e-12)
    assert pvalues.mwu_p(8 * n - 1, 8, n, 0) == pytest.approx(4 / math.comb(n + 8, 8), rel=1e-12)
    assert pvalues.mwu_p(n / 2, 1, n, 0) == 1.0 and pvalues.mwu_p(n // 10, 1, n, 0) == pytest.approx(2 * (n // 10 + 1) / (n + 1))
    middle = pvalues.mwu_p(math.ceil(4 * n + math.sqrt(8 * n * (n + 9) / 12)), 8, n, 0)
    assert middle == pytest.approx(math.erfc(math.sqrt(0.5)), rel=0.03)  # one deviation from the middle


def test_exact_p_in_a_profile(spark):
    rows = [(int(i < 5), float(i * 7919 % 10_007)) for i in range(9000)]
    got = profile.profile_table(spark.createDataFrame(rows, "y int, x double"), "y").first()
    assert got["mwu_p"] == pytest.approx(pvalues.mwu_p(got["mwu_u"], 5, 8995, 0)) and got["method_note"] == ""


def test_ranks_of_very_many_values_in_small_tasks(spark):
    """2,000,000 distinct values of one feature and a hot value of another, ordered by 64 tasks."""
    n = 2_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        id_ = F.col("id")
        df = spark.range(n).select((id_ % 2).cast("int").alias("y"), F.pmod(id_ * 7919, F.lit(n)).cast("double").alias("x"), F.when(id_ % 3 == 0, 0.5).otherwise((id_ % 1000).cast("double")).alias("hot"))
        h = profile.histogram(df, "y")
        with scratch.temporary_tables():
            cum = profile.cumulative(profile._continuous(h, profile.classify_features(h)))
            bad = cum.where((F.col("ordinal") == 0) & (F.col("before") != F.col("num").cast("long"))).count()
            assert bad == 0 and cum.count() == n + 1001
            u = {r["ordinal"]: r["mwu_u"] for r in profile.mann_whitney_u(cum).collect()}
            assert u[0] == n * n // 8 + n // 4  # odd numbers against even ones: each odd 2i + 1 beats i + 1 of them
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_medians_are_exact(spark):
    values = [(i * 7919) % 1001 for i in range(2000)]
    df = spark.createDataFrame([(float(v), None if v % 2 else "a", "x") for v in values], "x double, z string, t string")
    assert profile.medians(df, ["x", "t"]) == {"x": sorted(values)[999] / 2 + sorted(values)[1000] / 2, "t": None}
