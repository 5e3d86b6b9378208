"""Bins of features that meet the target are counted in each batch."""

from collections import Counter

import numpy as np
import pytest

from tabulon.operators.select import _joint_cells


@pytest.mark.parametrize("text", [False, True])
def test_cells_of_a_batch_are_counted_before_they_leave_it(spark, text):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else float(i % 3), *(None if x < 0.1 else float(x) for x in rng.random(2).round(1))) for i in range(3000)]
    df = spark.createDataFrame(rows, "y double, v0 double, v1 double").repartition(2)
    if text:
        df = df.selectExpr("CAST(y AS STRING) AS y", "v0", "v1")
    cuts, own = [np.array([0.3, 0.5]), np.array([])], np.array([0.0, 1.0])
    cells = _joint_cells(df, cuts, None if text else own).collect()
    assert len(cells) <= 2 * (3 + 1) * 3  # two batches, three and one bins, three classes or bins of the target
    found = Counter()
    for c in cells:
        found[c["c"], c["b"], c["y"]] += c["n"]
    want = Counter()
    for y, *values in rows:
        for c, v in enumerate(values):
            if y is not None and v is not None:
                want[c, sum(v > e for e in cuts[c]), str(y) if text else str(sum(y > e for e in own))] += 1
    assert found == want
