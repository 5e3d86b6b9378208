"""Exact order statistics, without and with ranges."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators.quantiles import column_quantiles, order_statistics, quantiles, share

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def check(found, values):
    values = np.sort(np.asarray([v for v in values if v is not None and v == v], dtype=float))
    np.testing.assert_allclose(found, np.quantile(values, PROBS), rtol=0, atol=1e-9)


@pytest.mark.parametrize("options", [{}, {"small": 50, "ranges": 7}])
def test_matches_numpy(spark, options):
    rng = np.random.default_rng(3)
    smooth = rng.exponential(50, 3000)
    lumpy = np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 30, 3000)).astype(float)
    df = spark.createDataFrame(list(zip(smooth.tolist(), lumpy.tolist())), "a double, b double").repartition(5)
    found = quantiles(df, {"a": PROBS, "b": PROBS}, **options)[()]
    check(found["a"], smooth)
    check(found["b"], lumpy)


@pytest.mark.parametrize("options", [{}, {"small": 40, "ranges": 5}])
def test_groups_nulls_and_hot_values(spark, options):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.pmod("id", F.lit(2)).cast("string")).alias("g"),
        F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 4 == 0, 1.0).otherwise(F.col("id") % 97).alias("x"),
    )
    found = quantiles(df, {"x": PROBS}, ["g"], **options)
    rows = df.collect()
    assert set(found) == {(None,), ("0",), ("1",)}
    for (group,), per in found.items():
        check(per["x"], [r["x"] for r in rows if r["g"] == group])


def test_edges(spark):
    df = spark.createDataFrame([(None, 2.0), (float("nan"), 2.0)], "empty double, one double")
    found = column_quantiles(df, ["empty", "one"], (0.25, 0.75))
    assert found == {"empty": [None, None], "one": [2.0, 2.0]}
    assert column_quantiles(df.where("false"), ["one"], (0.5,)) == {"one": [None]}
    with pytest.raises(ValueError):
        column_quantiles(df, ["nothing"], (0.5,))
    with pytest.raises(ValueError):
        quantiles(spark.range(20), {"id": (0.5,)}, ["id"], max_groups=10)


def test_exact_ranks_of_large_integers(spark):
    base = 2**52 - 500
    df = spark.range(1000).select((F.lit(base) - F.col("id") * 3).alias("h"))
    wanted = {"h": [(k / 1000, lambda n, k=k: k) for k in (0, 17, 500, 999)]}
    for options in ({}, {"small": 10, "ranges": 4}):
        n, values = order_statistics(df, wanted, **options)[()]["h"]
        assert n == 1000
        assert [int(v) for v in values] == [base - 3 * (999 - k) for k in (0, 17, 500, 999)]


@pytest.mark.parametrize("options", [{}, {"small": 10, "ranges": 3}])
def test_types_are_kept(spark, options):
    base = 2**62
    df = spark.range(101).select(
        (F.lit(base) + F.col("id")).alias("whole"), (F.col("id").cast("decimal(30,10)") + F.lit("12345678901234567890.0000000001").cast("decimal(30,10)")).alias("exact"),
        (F.col("id") / 3).alias("double"), F.col("id").cast("float").alias("float"), F.col("id").cast("byte").alias("byte"),
    )
    middle = {c: [(0.5, lambda n: 50)] for c in df.columns}
    found = {c: values[0] for c, (_, values) in order_statistics(df, middle, **options)[()].items()}
    assert found == {"whole": base + 50, "exact": Decimal("12345678901234567940.0000000001"), "double": 50 / 3, "float": 50.0, "byte": 50}
    between = quantiles(df, {"exact": (0.125,), "byte": (0.125,)}, typed=True, **options)[()]
    assert between == {"exact": [Decimal("12345678901234567902.5000000001")], "byte": [12.5]}


def test_ranges_are_one_partitioning(spark):
    """No value list anywhere in the plans, however many columns."""
    df = spark.range(2000).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_007)).alias(f"c{i}") for i in range(12)])
    found = order_statistics(df, {c: [share(p) for p in PROBS] for c in df.columns}, small=0, ranges=6)[()]
    rows = np.array(df.collect())
    for i, c in enumerate(df.columns):
        check([float(v) for v in found[c][1]], rows[:, i])


def test_share_is_linear():
    assert share(0.25)[1](5) == 1.0
