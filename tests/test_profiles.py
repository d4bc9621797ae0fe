"""Merged profiles against the profile of the whole table."""

import statistics

import pytest

from pyspark.sql import functions as F

from saltmarsh.operators import profiles as pf, quality


def table(spark, count=4000):
    rows = [(i, str(i % 700) if i % 5 else None, float(i % 37) if i % 3 else None, "x" if i % 2 else "y") for i in range(count)]
    return spark.createDataFrame(rows + rows[:100], "i bigint, t string, d double, k string")


def test_merged_loads_equal_the_whole(spark, tmp_path):
    whole = table(spark)
    for load in range(3):
        part = whole.filter(F.pmod("i", F.lit(3)) == load)
        pf.store_profile(pf.load_profile(part), str(tmp_path), str(load))
        pf.store_profile(pf.load_profile(part), str(tmp_path), str(load))  # the same load again counts once
    merged = {r.column_name: r for r in pf.described(pf.merged(pf.stored_profiles(spark, str(tmp_path)))).collect()}
    direct = {r.column_name: r for r in pf.described(pf.load_profile(whole)).collect()}
    values = {"i": [r.i for r in whole.collect()], "d": [r.d for r in whole.collect() if r.d is not None]}
    for name, one in merged.items():
        assert (one.rows, one.nulls, one.least, one.most) == (direct[name].rows, direct[name].nulls, direct[name].least, direct[name].most)
    for name, column in values.items():
        assert merged[name].mean == pytest.approx(statistics.mean(column)) and merged[name].stddev == pytest.approx(statistics.stdev(column))
        below = sum(v < merged[name].quantile for v in column) / len(column)
        upto = sum(v <= merged[name].quantile for v in column) / len(column)
        assert below - pf.RANK_ERROR <= 0.5 <= upto + pf.RANK_ERROR
    for name, exact in (("i", 4000), ("t", 700 - 140), ("d", 37), ("k", 2), (pf.WHOLE, 4000)):
        assert merged[name].distinct_count == pytest.approx(exact, rel=pf.DISTINCT_ERROR), name
    assert merged["k"].mean is None and merged["k"].quantile is None


def test_profile_of_nothing(spark):
    got = {r.column_name: r for r in pf.described(pf.merged(pf.load_profile(table(spark).limit(0)))).collect()}
    assert got["i"].rows == 0 and got["i"].mean is None and got["i"].distinct_count == 0


@pytest.mark.parametrize("copies,unique", [(990, True), (1010, False), (900, True)])
def test_roles_count_exactly_near_the_limit(spark, copies, unique):
    """10,000 rows, of which a little more or less than a tenth repeats another one's number."""
    frame = spark.range(10_000).select(F.when(F.col("id") < copies + 10, 5).otherwise(F.col("id")).alias("number"), F.lit(1.5).alias("other"))
    share = quality.distinct_share(frame, "number").first()
    expected = share["distinct_count"] > 0.9 * share["row_count"]
    assert quality._mostly_distinct(frame, "number", 0.9) == expected == quality._mostly_distinct(frame, "number", 0.91)
    assert quality._mostly_distinct(frame, "number", 0.99) and not quality._mostly_distinct(frame, "number", 0.5)
    assert unique is (share["distinct_count"] / share["row_count"] > 0.9)
