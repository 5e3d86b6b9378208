"""The join of blocks and the ranking in single precision."""

import numpy as np
import pytest

from tabulon.operators import knn
from tabulon.operators.knn import _nearest
from tabulon.operators.knn_blocks import block_join


def exact(q, r, ids, k):
    dist = np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2))
    return [(i, int(ids[j]), round(dist[i, j], 9)) for i in range(len(q)) for j in np.lexsort((ids, dist[i]))[:k]]


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "equal", "large", "missing", "few"])
def test_ranking_in_single_precision_is_exact(monkeypatch, kind):
    monkeypatch.setattr(knn, "TILE_REFERENCES", 64)
    monkeypatch.setattr(knn, "TILE_QUERIES", 16)
    monkeypatch.setattr(knn, "MEASURED", 300)
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(50, 20)), rng.normal(size=(400, 20))
    if kind == "copies":
        r[100:300] = r[0]
        q[:20] = r[0] + 1e-9 * rng.normal(size=(20, 20))
    elif kind == "far":
        q, r = q * 1e-7 + 1e5, r * 1e-7 + 1e5
    elif kind == "equal":
        q, r = np.ones_like(q), np.ones_like(r)
    elif kind == "large":
        q, r = q * 1e60, r * 1e60
    elif kind == "missing":
        q[3, 2] = np.nan
    elif kind == "few":
        r = r[:3]
    ids = rng.permutation(len(r)).astype("int64")
    rows, refs, dist = _nearest(q, r, ids, 5)
    mine = [(int(i), int(ids[j]), round(d, 9)) for i, j, d in zip(rows, refs, dist)]
    assert mine == [x for x in exact(q, r, ids, 5) if not np.isnan(x[2])]


def test_a_query_returns_for_each_group_of_blocks_not_for_each_block(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v, 0.0) for i, v in enumerate(rng.normal(size=(400, 20)).tolist())]
    ref = spark.createDataFrame(rows, "r long, v array<double>, y double").repartition(1)
    q = ref.select(ref.r.alias("q"), "v")
    found = block_join(q, ref, 3, chunk_rows=5, block_rows=5).collect()
    assert len(found) <= 400 * 3 * 10  # 80 blocks of references
    best = {}
    for f in found:
        best.setdefault(f["q"], []).append((f["distance"], f["r"]))
    points = np.array([v for _, v, _ in rows])
    want = exact(points, points, np.arange(400), 3)
    assert [(i, j, round(d, 9)) for i in range(400) for d, j in sorted(best[i])[:3]] == want
