"""Running totals and fills: the range-partitioned path equals the plain window."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators.ordered import fill, row_numbers, running_sums

KEYS = ([], ["k"])


def sample(spark):
    return spark.range(600).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(
            (F.col("id") % 5).cast("string")).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(40)).alias("t"),
        F.when(F.col("id") % 4 == 1, F.col("id").cast("double")).alias("x"), F.lit(1).cast("long").alias("one"),
    )


def rows(df, *names):
    return sorted(df.select(*names).collect(), key=str)


@pytest.mark.parametrize("keys", KEYS)
def test_running_sums(spark, keys):
    df = sample(spark)
    order = [F.col("t"), F.col("id")]
    plain = running_sums(df, order, {"r": "id", "c": "one"}, keys)
    spread = running_sums(df, order, {"r": "id", "c": "one"}, keys, small=0, ranges=6)
    assert rows(plain, "id", "r", "c") == rows(spread, "id", "r", "c")


@pytest.mark.parametrize("keys", KEYS)
@pytest.mark.parametrize("backward", [False, True])
def test_fill(spark, keys, backward):
    df = sample(spark)
    plain = fill(df, "x", ["t", "id"], keys, backward)
    spread = fill(df, "x", ["t", "id"], keys, backward, small=0, ranges=6)
    assert rows(plain, "id", "x") == rows(spread, "id", "x")
    assert spread.columns == df.columns
    # what was present stays
    kept = spread.alias("a").join(df.alias("b"), "id").where("b.x IS NOT NULL AND a.x <> b.x")
    assert kept.count() == 0


def test_all_missing_stays_missing(spark):
    df = sample(spark).withColumn("x", F.lit(None).cast("double"))
    assert fill(df, "x", ["t", "id"], small=0, ranges=3).where("x IS NOT NULL").count() == 0


def test_row_numbers(spark):
    df = row_numbers(sample(spark), [F.col("t"), F.col("id")], "n", small=0, ranges=5)
    assert [r["n"] for r in df.orderBy("n").select("n").collect()] == list(range(1, 601))
