"""Queries on what only larger tables hold."""

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from tabulon.models import boosting, optimise, training
from tabulon.models.catalogue import hyperparameters
from tabulon.operators import impute_knn, knn, knn_blocks
from tabulon.queries.catalog import QUERIES


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_order_statistics_of_products_beyond_64_bits(spark, tmp_path):
    rows = [(key, 1, "A", 1.5 + key) for key in (1, 5, 2_000_001, 9_000_000, 36_000_000)]
    folder = stored(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_extendedprice double")
    found = {r.place: r.whole for r in QUERIES["order_statistics"](spark, folder).collect()}
    assert found == {p: Decimal(k * 4611686018427 + 1) for p, k in ((0, 1), (25, 5), (50, 2_000_001), (75, 9_000_000), (100, 36_000_000))}


def test_many_rows_of_few_dimensions_are_not_scanned_by_every_query(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(0, 40, 2)], float(i % 3)) for i in range(900)]  # many ties and copies
    points = spark.createDataFrame(rows, "id long, v array<double>, y double")
    key = lambda found: sorted(tuple(r) for r in found.collect())
    scanned = key(knn.knn_join(points, points, "id", "id", "v", 5, "y"))
    monkeypatch.setattr(knn, "SCAN_ROWS", 800)
    monkeypatch.setattr(knn, "GAPS", 100)
    monkeypatch.setattr(knn, "_broadcast_join", lambda *_: pytest.fail("scanned"))
    assert key(knn.knn_join(points, points, "id", "id", "v", 5, "y")) == scanned


def test_rows_of_equal_bins_are_one_weighted_cell(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(a * b + e), bool(c)) for a, b, e, c in zip(rng.integers(0, 4, 600), rng.integers(0, 3, 600), rng.normal(size=600), rng.random(600) < 0.2)]
    table = spark.createDataFrame(rows, "__f0 double, __f1 double, label double, __check boolean").repartition(5)
    booster = boosting.Booster(table, ["__f0", "__f1"], boosting.settings_of({**hyperparameters("xgboost_regressor"), "n_estimators": 2}, False), 0)
    assert booster.blocks.agg({"n": "sum"}).first()[0] == 24  # 4 * 3 cells that fit, and as many that check
    booster.grow()
    for which, check in enumerate((False, True)):
        y = np.array([r[2] for r in rows if r[3] == check])
        assert np.isclose(booster.losses[0][which], 0.5 * ((y - booster.base[0]) ** 2).mean())


def test_svr_keeps_its_rows_as_they_are(spark, monkeypatch):
    """Kernel features are made a batch at a time, not held for all rows."""
    seen = []
    monkeypatch.setattr(training, "summed_gradient", lambda data, loss, theta, tasks: seen.append(data) or optimise.summed_gradient(data, loss, theta, tasks))
    rows = [(float(i % 17) / 17, float(i % 5) / 5, float(i % 17)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = training.fit_model(df, "y", "svr", {"n_components": 40, "max_iter": 30})
    assert len(seen[0].first()["x"]) == 2
    scored = model.transform(df)
    assert scored.where("abs(prediction - y) > 3").count() == 0


def test_pairs_of_blocks_are_compared_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(50, 20)), rng.normal(size=(30, 20))
    sizes, plain = [], knn._nearest
    monkeypatch.setattr(knn_blocks, "PAIRS", 200)
    monkeypatch.setattr(knn_blocks, "_nearest", lambda a, b, ids, k: sizes.append(len(a) * len(b)) or plain(a, b, ids, k))
    cells = {"ids": np.arange(50), "q_ids": np.arange(30), "vectors": x, "q_vectors": q, "carried": np.zeros(50)}
    batch = pa.RecordBatch.from_pylist([{c: v.tobytes() for c, v in cells.items()}] * 2, schema=pa.schema([(c, pa.binary()) for c in cells]))
    found = pa.Table.from_batches(knn_blocks.compared(batch, 3)).to_pylist()
    assert max(sizes) <= 200 and len(found) == 2 * 30 * 3
    near = np.argsort(((q[:, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, :3]
    assert [r["r"] for r in found[:90]] == near.ravel().tolist()


def test_gaps_meet_only_donor_blocks_within_reach():
    grid = np.arange(400.0).reshape(20, 20)  # twenty blocks of one column, twenty donors each
    blocks = np.stack([np.column_stack([b.min(keepdims=True), [0.0]]) for b in grid] + [np.column_stack([b.max(keepdims=True), [1.0]]) for b in grid]).reshape(2, 20, 2).swapaxes(0, 1)
    sizes, without, missing = np.full(20, 20), np.zeros((20, 2), bool), np.array([False, True])
    near = impute_knn.within_reach(np.array([[105.0, np.nan], [110.0, np.nan]]), missing, blocks, sizes, without, 5)
    assert 5 in np.flatnonzero(near) and near.sum() <= 3
    assert impute_knn.within_reach(np.array([[105.0, np.nan], [110.0, np.nan]]), missing, blocks, sizes, without, 1000).all()  # all donors count
    without[5, 1] = True  # a block that has no value to give
    assert not impute_knn.within_reach(np.array([[105.0, np.nan], [110.0, np.nan]]), missing, blocks, sizes, without, 5)[5]
