"""Fitting a differentiable loss: gradients summed on the executors, L-BFGS steps on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: (parameters, features, labels) -> (summed loss, summed gradient)
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


#: Bytes of the tasks' sums that the driver adds up itself; more are added up by tasks first.
DIRECT_BYTES = 64 << 20


def added_up(parts: DataFrame, size: int, tasks: int) -> np.ndarray:
    """The sum of the tasks' arrays of ``size`` doubles (part, sums), in a fixed order, so that repeated fits agree."""
    if tasks * size * 8 > DIRECT_BYTES:
        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(b, np.float64) for b in frame.sort_values("part")["sums"])
            return pd.DataFrame({"part": frame["part"].iloc[:1], "sums": [total.tobytes()]})

        group = F.pmod("part", F.lit(max(1, math.isqrt(tasks))))
        parts = parts.groupBy(group.alias("g")).applyInPandas(add, "part int, sums binary")
    total = np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: r.part):
        total += np.frombuffer(row.sums, np.float64)
    return total


def summed_gradient(data: DataFrame, loss: Loss, theta: np.ndarray, tasks: int) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows of (x array, y) in ``tasks`` partitions, one array for each task."""
    size = len(theta)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size + 1)
        for batch in batches:
            if len(batch):
                value, part = loss(theta, np.stack(batch["x"].to_numpy()), batch["y"].to_numpy())
                sums += np.append(part, value)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [sums.tobytes()]})

    total = added_up(data.mapInPandas(partial, "part int, sums binary"), size + 1, tasks)
    return float(total[size]), total[:size]


def minimise(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float = 1e-6,
    memory: int = 10,
) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    theta = start.copy()
    value, gradient = evaluate(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        direction, alphas = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (y @ s)
            alphas.append(a)
            direction -= a * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.linalg.norm(gradient))
        for (s, y), a in zip(steps, reversed(alphas)):
            direction += s * (a - (y @ direction) / (y @ s))
        slope = gradient @ direction
        if slope <= 0:
            direction, slope, steps = gradient, gradient @ gradient, []
        rate = 1.0
        for _ in range(20):
            trial = theta - rate * direction
            new_value, new_gradient = evaluate(trial)
            if new_value <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            return theta
        s, y = trial - theta, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps[-(memory - 1):], (s, y)]
        done = abs(value - new_value) <= tol * max(1.0, abs(value))
        theta, value, gradient = trial, new_value, new_gradient
        if done:
            break
    return theta


def unpack(theta: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in shapes:
        weight = theta[at:at + a * b].reshape(a, b)
        at += a * b
        layers.append((weight, theta[at:at + b]))
        at += b
    return layers


def tube_loss(epsilon: float, smooth: float = 0.01) -> Loss:
    """Epsilon-insensitive linear loss with rounded corners."""
    def loss(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        error = x @ theta[:-1] + theta[-1] - y
        beyond = np.maximum(np.abs(error) - epsilon, 0.0)
        value = np.where(beyond < smooth, beyond * beyond / (2 * smooth), beyond - smooth / 2).sum()
        slope = np.sign(error) * np.minimum(beyond / smooth, 1.0)
        return float(value), np.append(x.T @ slope, slope.sum())

    return loss
