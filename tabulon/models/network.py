"""Feed-forward networks by mini-batch Adam.

Rows are scaled, shuffled once and written in blocks. An epoch is one pass: every task takes its blocks' mini-batches in a
fresh order and steps along their gradients; its parameters and moments are one array, and the tasks' arrays are averaged
by rows, added up in a tree. One task of rows is plain mini-batch training. Rows held out measure each epoch in the pass of
the next one, so stopping early costs no pass of its own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..session import discard, freeze
from .optimise import added_up, minimise, unpack

BLOCK_ROWS = 65_536
#: Adam's decay rates and guard, and the momentum of plain steps (fixed values).
BETA1, BETA2, GUARD, MOMENTUM = 0.9, 0.999, 1e-8, 0.9
BLOCK = pa.schema([("block", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("held", pa.binary())])

#: State below this, as that of a unit that is never active decays to, is zero: arithmetic on subnormal numbers is many times slower.
FADED, STEPS_BETWEEN = 1e-200, 64

#: A layer's values from its sums, in the sums' place where the operation can write there.
ACTIVATIONS = {
    "relu": lambda v: np.maximum(v, 0.0, out=v), "tanh": lambda v: np.tanh(v, out=v), "logistic": lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500))), "identity": lambda v: v,
}
#: Slopes from the activation's own value.
SLOPES = {"relu": lambda a: a > 0, "tanh": lambda a: 1 - a * a, "logistic": lambda a: a * (1 - a), "identity": np.ones_like}


def outputs(layers: list, x: np.ndarray, activation: str) -> list[np.ndarray]:
    """The values of every layer, the inputs first; the last one is linear."""
    values = [x]
    for i, (weight, bias) in enumerate(layers):
        z = values[-1] @ weight
        z += bias
        values.append(z if i == len(layers) - 1 else ACTIVATIONS[activation](z))
    return values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def losses(z: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its slope by output: half the squared error, or minus the log-likelihood of a softmax."""
    if not classes:
        error = z[:, 0] - y
        return 0.5 * error * error, error[:, None]
    p, own = softmax(z), y.astype(np.int64)
    rows = np.arange(len(y))
    slope = p.copy()
    slope[rows, own] -= 1
    return -np.log(np.maximum(p[rows, own], 1e-15)), slope


def network_loss(shapes: list[tuple[int, int]], activation: str = "relu", classes: int = 0):
    """(parameters, features, labels) -> (summed loss, summed gradient)."""
    def loss(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        layers = unpack(theta, shapes)
        values = outputs(layers, x, activation)
        each, back = losses(values[-1], y, classes)
        parts: list[np.ndarray] = []
        for i in range(len(layers) - 1, -1, -1):
            parts = [(values[i].T @ back).ravel(), back.sum(axis=0), *parts]
            if i:
                back = back @ layers[i][0].T
                back *= SLOPES[activation](values[i])
        return float(each.sum()), np.concatenate(parts)

    return loss


def weight_places(shapes: list[tuple[int, int]]) -> np.ndarray:
    """1 for weights, 0 for biases: only the former are held down."""
    return np.concatenate([np.append(np.ones(a * b), np.zeros(b)) for a, b in shapes])


@dataclass
class NetworkSettings:
    hidden: tuple[int, ...]
    activation: str
    solver: str
    alpha: float
    rate: float
    batch: int
    epochs: int
    tol: float
    patience: int
    held_share: float  # rows that only decide when to stop; 0 stops on the training loss
    seed: int


def settings_of(p: dict) -> NetworkSettings:
    batch = 200 if p["batch_size"] == "auto" else int(p["batch_size"])
    return NetworkSettings(
        tuple(p["hidden_layer_sizes"]), p["activation"], p["solver"], p["alpha"], p["learning_rate_init"], batch, p["max_iter"], p["tol"],
        p["n_iter_no_change"], p["validation_fraction"] if p["early_stopping"] else 0.0, p["random_state"],
    )


def blocks_of(rows: DataFrame, centres: list[tuple[float, float]], held_share: float, seed: int) -> DataFrame:
    """Shuffled blocks of scaled rows (__f0..., label), and which rows are held out."""
    names = [f"__f{i}" for i in range(len(centres))]
    shift, scale = (np.array(v) for v in zip(*centres))
    mixed = F.xxhash64(*names, "label", F.lit(seed))
    tasks = max(1, rows.count() // BLOCK_ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part, held = 0, TaskContext.get().partitionId(), []
        for batch in [*batches, None]:
            if batch is not None:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                held.append(((x - shift) / scale, batch.column("label").to_numpy(zero_copy_only=False)))
            if held and (batch is None or sum(len(h[1]) for h in held) >= BLOCK_ROWS):
                x, y = (np.concatenate(p) for p in zip(*held))
                out = np.random.default_rng([seed, part, seen]).permutation(len(y)) < round(held_share * len(y))
                yield pa.RecordBatch.from_pylist([{"block": part << 32 | seen, "x": x.tobytes(), "y": y.tobytes(), "held": out.tobytes()}], schema=BLOCK)
                seen, held = seen + 1, []

    # equal rows are dealt by a second hash of the partition they come from, so that no copies crowd one task
    dealt = rows.select(*names, "label").repartition(tasks, F.pmod(mixed + F.monotonically_increasing_id(), F.lit(1 << 20)))
    return freeze(dealt.sortWithinPartitions(mixed).mapInArrow(pack, "block long, x binary, y binary, held binary"), "network-blocks")


def train(blocks: DataFrame, d: int, classes: int, s: NetworkSettings) -> tuple[np.ndarray, list[tuple[int, int]], list[float]]:
    """(parameters, shapes, the measure that decides by epoch: held-out loss, else training loss)."""
    widths = [d, *s.hidden, classes or 1]
    shapes = list(zip(widths[:-1], widths[1:]))
    random = np.random.default_rng(s.seed)
    theta = np.concatenate([np.append(random.uniform(-1, 1, a * b) * math.sqrt(6.0 / (a + b)), np.zeros(b)) for a, b in shapes])
    loss, weights = network_loss(shapes, s.activation, classes), weight_places(shapes)
    size, tasks, held_down = len(theta), blocks.rdd.getNumPartitions(), s.alpha * weights

    def passed(state: np.ndarray, epoch: int, steps: float, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Averaged (parameters, moments) after an epoch, and (loss, rows, held-out loss, held-out rows, steps)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = state.copy(), np.zeros(5)
            parameters, first, second = own[:size], own[size : 2 * size], own[2 * size :]
            for batch in batches:
                for row in batch.to_pylist():
                    y, held = np.frombuffer(row["y"]), np.frombuffer(row["held"], bool)
                    x = np.frombuffer(row["x"]).reshape(len(y), d)
                    if held.any():  # measured with the parameters all tasks start from
                        sums[2:4] += loss(state[:size], x[held], y[held])[0], held.sum()
                    free = np.flatnonzero(~held)
                    order = np.random.default_rng([s.seed, epoch, row["block"]]).permutation(free) if learn else free[:0]
                    x, y = x[order], y[order]
                    for at in range(0, len(order), s.batch):
                        if not sums[4] % STEPS_BETWEEN:
                            own[np.abs(own) < FADED] = 0.0
                        n = min(s.batch, len(order) - at)
                        value, gradient = loss(parameters, x[at : at + n], y[at : at + n])
                        decayed = held_down * parameters
                        gradient = (gradient + decayed) / n
                        sums += value + 0.5 * float((decayed * parameters).sum()), n, 0, 0, 1
                        if s.solver == "sgd":
                            first[:] = MOMENTUM * first - s.rate * gradient
                            parameters += MOMENTUM * first - s.rate * gradient
                            continue
                        t = steps + sums[4]
                        first[:] = BETA1 * first + (1 - BETA1) * gradient
                        second[:] = BETA2 * second + (1 - BETA2) * gradient * gradient
                        rate = s.rate * math.sqrt(1 - BETA2**t) / (1 - BETA1**t)
                        parameters -= rate * first / (np.sqrt(second) + GUARD)
            out = np.concatenate([own * sums[1], sums])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()])], names=["part", "sums"])

        total = added_up(blocks.mapInArrow(run, "part int, sums binary"), 3 * size + 5, tasks)
        return total[:-5] / max(total[-4], 1), total[-5:]

    if s.solver == "lbfgs":
        return _whole_batch(blocks, d, s, loss, weights, theta, tasks), shapes, []
    state, steps = np.concatenate([theta, np.zeros(2 * size)]), 0.0
    curve, best, kept = [], (math.inf, 0), state
    for epoch in range(s.epochs + (s.held_share > 0)):
        after, (fit_loss, n, held_loss, n_held, taken) = passed(state, epoch, steps, epoch < s.epochs)
        if s.held_share and n_held:
            measure, measured = held_loss / n_held, state  # of the epochs before this one
        else:
            measure, measured = fit_loss / max(n, 1), after
        curve.append(measure)
        if measure < best[0] - s.tol:
            best, kept = (measure, epoch), measured
        elif epoch - best[1] >= s.patience:
            break
        if not s.held_share:
            kept = after
        state, steps = after, steps + taken / tasks
    return kept[:size], shapes, curve


def _whole_batch(blocks: DataFrame, d: int, s: NetworkSettings, loss, weights: np.ndarray, theta: np.ndarray, tasks: int) -> np.ndarray:
    """Quasi-Newton steps on the gradient of all rows."""
    size = len(theta)

    def evaluate(at: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size + 2)
            for batch in batches:
                for row in batch.to_pylist():
                    y = np.frombuffer(row["y"])
                    value, gradient = loss(at, np.frombuffer(row["x"]).reshape(len(y), d), y)
                    sums += np.concatenate([gradient, [value, len(y)]])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()])], names=["part", "sums"])

        total = added_up(blocks.mapInArrow(run, "part int, sums binary"), size + 2, tasks)
        held, n = s.alpha * weights * at, max(total[-1], 1)
        return (total[-2] + 0.5 * float(held @ at)) / n, (total[:-2] + held) / n

    return minimise(evaluate, theta, s.epochs)


class Network(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``__prediction`` and, for classes, ``__probability`` from the columns ``__f0``, ``__f1``, ..."""

    layers = Param(Params._dummy(), "layers", "weights, scaling and activation as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, layers: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        about = json.loads(self.getOrDefault(self.layers))
        layers = [(np.array(w), np.array(b)) for w, b in about["layers"]]
        shift, scale = (np.array(v) for v in zip(*about["centres"]))
        classes, (mean, spread) = about["classes"], about["target"]

        @F.pandas_udf("array<double>" if classes else "double")
        def last(rows: pd.DataFrame) -> pd.Series:
            x = (rows.to_numpy(dtype=np.float64) - shift) / scale
            z = outputs(layers, x, about["activation"])[-1]
            return pd.Series(list(softmax(z)) if classes else z[:, 0] * spread + mean)

        inputs = F.struct(*[F.col(f"__f{i}") for i in range(len(shift))])
        if not classes:
            return df.withColumn("__prediction", last(inputs))
        scored = df.withColumn("__out", last(inputs))
        best = F.array_position("__out", F.array_max("__out")) - 1
        return scored.withColumns({"__prediction": best.cast("double"), "__probability": F.col("__out")}).drop("__out")


def fit_network(rows: DataFrame, d: int, classes: int, s: NetworkSettings) -> tuple[Network, list[float]]:
    """Fit on complete rows (__f0..., label); the network and its measure by epoch."""
    aggs = [f(c) for c in [f"__f{i}" for i in range(d)] for f in (F.avg, F.stddev_pop)]
    moments = rows.agg(F.avg("label"), F.stddev_pop("label"), *aggs).first()
    if moments[0] is None:
        raise ValueError("no complete rows to train on")
    centres = [(moments[2 + 2 * i], moments[3 + 2 * i] or 1.0) for i in range(d)]
    mean, spread = (0.0, 1.0) if classes else (moments[0], moments[1] or 1.0)
    blocks = blocks_of(rows.withColumn("label", (F.col("label") - mean) / spread), centres, s.held_share, s.seed)
    theta, shapes, curve = train(blocks, d, classes, s)
    discard(blocks)
    layers = [(w.tolist(), b.tolist()) for w, b in unpack(theta, shapes)]
    about = {"layers": layers, "centres": centres, "classes": classes, "target": [mean, spread], "activation": s.activation}
    return Network(layers=json.dumps(about)), curve
