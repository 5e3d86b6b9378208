"""State that fades away is zero, since arithmetic on subnormal numbers is slow."""

import numpy as np

from tabulon.models.catalogue import hyperparameters
from tabulon.models.network import blocks_of, settings_of, train


def test_faded_state_is_zero(spark):
    settings = settings_of(hyperparameters("mlp_regressor", {
        "hidden_layer_sizes": (4,), "solver": "sgd", "alpha": 0.05, "learning_rate_init": 0.2, "batch_size": 1, "max_iter": 1,
    }))
    rows = spark.range(10500).selectExpr("0D AS __f0", "0D AS __f1", "0D AS label")  # nothing to learn: weights only decay
    theta, _, _ = train(blocks_of(rows, [(0.0, 1.0)] * 2, 0.0, 42), 2, 0, settings)
    size = np.abs(theta)
    assert not ((size > 0) & (size < 1e-230)).any()
