"""Hard negatives: the curve, the bounds, and results against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import hard_negatives as module
from tabulon.llm.hard_negatives import Page, hard_negatives
from tabulon.llm.hilbert import hilbert_index


@pytest.mark.parametrize(("dims", "bits"), [(1, 6), (2, 4), (3, 3), (5, 2), (8, 1)])
def test_hilbert_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    index = hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_product():
    rng = np.random.default_rng(0)
    rows = rng.integers(-300, 300, (5, 40, 6))
    zones = [{"block": i, "low": r.min(axis=0).tobytes(), "high": r.max(axis=0).tobytes(), "kinds": np.array([i % 2, 7]).tobytes()} for i, r in enumerate(rows)]
    page, anchors = Page(zones, 6), rng.integers(-300, 300, (9, 6))
    low, high = page.bounds(anchors)
    products = np.einsum("ad,brd->abr", anchors, rows)
    assert (low <= products.min(axis=2)).all() and (high >= products.max(axis=2)).all()
    assert page.has(np.array([0, 1, 7, 3])).tolist() == [[True, False] * 2 + [True], [False, True] * 2 + [False], [True] * 5, [False] * 5]


def expected(rows, anchors, positives=5, negatives=5, low=80, high=100):
    """By definition, over (id, label, whole vector) of distinct usable rows."""
    out = []
    for a, label, v in anchors:
        scored = [(-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows if i != a and len(w) == len(v)]
        for s, p, _ in sorted({(s, i, 0) for s, i, m in scored if m == label})[:positives]:
            near = sorted({(t, i) for t, i, m in scored if m != label and -low * s <= -100 * t <= -high * s})
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(near[:negatives])]
    return sorted(out)


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


@pytest.mark.parametrize("block", [8, 512])
def test_results_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_ROWS", block)
    monkeypatch.setattr(module, "ANCHOR_ROWS", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    rows = {i: (i, int(i % 4), (centres[i % 6] + 0.4 * rng.normal(size=5)).tolist()) for i in range(300)}
    rows |= {i: (i, i % 3, rows[4][2]) for i in range(300, 340)}  # ties
    rows |= {340: (340, 9, [0.0] * 5), 341: (341, 1, [0.5, 1.0]), 342: (342, 2, [0.5, 0.9]), 343: (343, 1, [0.4, 1.0]), 344: (344, 1, []), 345: (345, 2, []), 350: (350, 1, [])}
    bad = [(346, None, [1.0] * 5), (347, 1, None), (348, 1, [1.0, None, 0.0, 0.0, 0.0]), (349, 1, [float("nan")] * 5), (None, 1, [1.0] * 5), (10, 2, rows[10][2])]
    schema = "vec_id long, label int, embedding array<double>"
    frame = spark.createDataFrame([*rows.values(), *bad], schema).withColumns({c: F.lit("x") for c in ("id", "score", "rank", "block")}).repartition(5)
    usable = [(i, m, whole(v)) for i, m, v in rows.values()]
    anchors = [r for r in usable if r[0] % 10 == 0 or r[0] == 341]
    found = hard_negatives(frame, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 341))
    assert sorted(map(tuple, found.collect())) == expected(usable, anchors)
    wide = hard_negatives(frame, F.col("vec_id") < 12, positives=2, negatives=9, low=-50, high=250)
    assert sorted(map(tuple, wide.collect())) == expected(usable, usable[:12], 2, 9, -50, 250)
    assert hard_negatives(frame.limit(0), F.lit(True)).collect() == []
    assert hard_negatives(frame, F.lit(None).cast("boolean")).collect() == []


def test_huge_numbers_are_held(spark):
    rows = [(0, 1, [3e9, 1.0]), (1, 1, [2e9, 1.0]), (2, 2, [1.9e9, 5.0]), (3, 2, [1e300, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    found = hard_negatives(frame, F.col("vec_id") == 0, scale=0.5).collect()
    assert [(r.negative_id, r.negative_score) for r in found] == [(2, 1_500_000_000 * 950_000_000)]


def test_zone_maps_leave_out_blocks(spark, monkeypatch):
    """Rows around far centres: most blocks of other labels are out of every window."""
    monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    rng, seen = np.random.default_rng(2), []
    centres = 8 * rng.normal(size=(20, 4))
    rows = [(i, i % 3, (centres[i % 20] + 0.1 * rng.normal(size=4)).tolist()) for i in range(1000)]
    monkeypatch.setattr(module, "chosen", lambda *a, plain=module.chosen: seen.append(plain(*a)) or seen[-1])
    frame = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    found = hard_negatives(frame, F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, found)) == expected([(i, m, whole(v)) for i, m, v in rows], [(i, m, whole(v)) for i, m, v in rows if i % 50 == 0])
    read = [sum(len(r.ids) // 8 for r in frame.collect()) for frame in seen]
    assert len(read) == 2 and sum(read) < 0.25 * 2 * 20 * 1000 / 16
