"""Neighbour imputation over several columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import impute_knn as module
from tabulon.operators.impute_knn import impute_neighbours


def expected(x, k):
    """Cell by cell, by definition; rows are numbered from 0."""
    out = x.copy()
    means = [np.nan if np.isnan(c).all() else np.nanmean(c) for c in x.T]
    for i, j in zip(*np.nonzero(np.isnan(x))):
        found = []
        for r in range(len(x)):
            shared = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if not np.isnan(x[r, j]) and shared.any():
                found.append((np.sqrt(((x[i] - x[r])[shared] ** 2).sum() * (x.shape[1] / shared.sum())), r))
        out[i, j] = np.mean([x[r, j] for _, r in sorted(found)[:k]]) if found else means[j]
    return out


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(160, 4)) * 3)  # whole numbers tie often
    x[rng.random(x.shape) < 0.25] = np.nan
    x[7] = x[8] = np.nan
    x[20:50] = x[20]  # copies
    return x


def frame(spark, x):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], "t") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, v0 string").repartition(5)


def found(df):
    return np.array([[np.nan if r[c] is None else r[c] for c in "abcd"] for r in df.orderBy("id").collect()], dtype=float)


@pytest.mark.parametrize(("k", "donors", "gaps"), [(1, 2048, 256), (5, 16, 3), (1000, 16, 256)])
def test_cells_equal_brute_force(spark, values, monkeypatch, k, donors, gaps):
    monkeypatch.setattr(module, "DONOR_ROWS", donors)
    monkeypatch.setattr(module, "GAP_ROWS", gaps)
    filled = impute_neighbours(frame(spark, values), list("abcd"), k, "id")
    assert filled.columns == ["id", "a", "b", "c", "d", "v0"]
    np.testing.assert_allclose(found(filled), expected(values, k), rtol=1e-12)


def test_edges(spark, values):
    empty = values.copy()
    empty[:, 2] = np.nan
    np.testing.assert_allclose(found(impute_neighbours(frame(spark, empty), list("abcd"), 3, "id")), expected(empty, 3), rtol=1e-12)
    whole = np.nan_to_num(values)
    np.testing.assert_array_equal(found(impute_neighbours(frame(spark, whole), list("abcd"))), whole)
    assert impute_neighbours(frame(spark, values).limit(0), list("abcd")).collect() == []
    lone = impute_neighbours(frame(spark, values), ["a"], 3, "id").select("id", "a").orderBy("id").collect()
    np.testing.assert_allclose([r.a for r in lone], np.where(np.isnan(values[:, 0]), np.nanmean(values[:, 0]), values[:, 0]))
    nan = frame(spark, values).withColumn("a", F.coalesce("a", F.lit(float("nan"))))
    np.testing.assert_allclose(found(impute_neighbours(nan, list("abcd"), 5, "id")), expected(values, 5), rtol=1e-12)
    with pytest.raises(ValueError):
        impute_neighbours(frame(spark, values), ["v0"])


def test_cells_equal_brute_force_without_layers(spark, values, monkeypatch):
    monkeypatch.setattr(module, "COPIES", 0)
    monkeypatch.setattr(module, "DONOR_ROWS", 16)
    np.testing.assert_allclose(found(impute_neighbours(frame(spark, values), list("abcd"), 5, "id")), expected(values, 5), rtol=1e-12)


def test_rows_at_one_distance_are_not_all_met(spark, monkeypatch):
    """A row with one column left has thousands of donors at distance zero; only the k that win ties are met."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 6, 4000), rng.random(4000) * 100, rng.integers(0, 4, 4000), np.zeros(4000)])
    x[rng.random(4000) < 0.3, 1] = np.nan
    x[rng.random(4000) < 0.3, 2] = np.nan
    x[rng.random(4000) < 0.1, 0] = np.nan
    frozen, plain = {}, module.freeze
    monkeypatch.setattr(module, "freeze", lambda df, label: frozen.setdefault(label, plain(df, label)))
    monkeypatch.setattr(module, "DONOR_ROWS", 32)
    monkeypatch.setattr(module, "GAP_ROWS", 64)
    filled = impute_neighbours(frame(spark, x), list("abc"), 5, "id").orderBy("id").limit(300).collect()
    met = frozen["pairs"].groupBy("gap").count().agg(F.avg("count"), F.max("count")).first()
    assert met[0] < 40 and met[1] < 100  # blocks of donors a block of gaps; 100 hold all donors once
    alone = [r for r in range(300) if np.isnan(x[r, 1:3]).all() and not np.isnan(x[r, 0])]
    assert alone
    for r in alone:
        for i, name in ((1, "b"), (2, "c")):
            near = sorted(np.flatnonzero(~np.isnan(x[:, i]) & ~np.isnan(x[:, 0])), key=lambda d: (abs(x[r, 0] - x[d, 0]), d))[:5]  # noqa: B023
            assert np.isclose(filled[r][name], x[near, i].mean())


def test_layers_are_the_columns_by_which_patterns_meet():
    assert module.layers_of({"111": 9, "110": 2, "001": 1}) == [("111", "001"), ("111", "110")]
    assert module.layers_of({"10": 1, "01": 1}) == []  # nothing shared
    assert module.layers_of({"111": 5}) == []  # no gaps
    many = {f"{i:06b}": 100 if i == 63 else 1 for i in range(1, 64)}
    assert module.layers_of(many) is None  # 62 copies of most rows


def test_equal_rows_are_searched_for_once(monkeypatch):
    sizes, plain = [], module.searched
    monkeypatch.setattr(module, "searched", lambda x, *rest: sizes.append(len(x)) or plain(x, *rest))
    y = np.array([[1.0, 10.0], [2.0, 20.0], [9.0, 90.0]])
    block = (np.zeros(2, bool), np.stack([y.min(axis=0), y.max(axis=0)]), np.array([7, 8, 9]), y)
    x = np.array([[9.0, np.nan]] * 500 + [[1.0, np.nan]] * 500)
    out = module.found_of(np.arange(1000), x, np.array([False, True]), [block], 2).to_pylist()
    assert sizes == [2]
    assert [r["donor"] for r in out] == [[9, 8]] * 500 + [[7, 8]] * 500 and out[0]["value"] == [90.0, 20.0] and out[0]["cell"] == [1, 1]


def test_a_missing_key_disturbs_no_other_row(spark):
    rows = [(1, 1.0, None), (None, 1.0, 50.0), (3, 1.0, 30.0), (4, 9.0, 90.0), (None, 9.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double").coalesce(1)
    for k, first in ((1, 30.0), (2, 40.0)):  # a row without a key is a donor, the last of a tie; its own gap takes the mean
        filled = [tuple(r) for r in impute_neighbours(df, ["a", "b"], k, "id").collect()]
        assert sorted(filled, key=str) == sorted([(1, 1.0, first), *rows[1:4], (None, 9.0, (50.0 + 30.0 + 90.0) / 3)], key=str)
