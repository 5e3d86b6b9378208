"""Second-order gradient boosting over histograms.

Features are binned once; rows of equal bins get equal margins, so that they are combined into one cell, with a count for
each class or the label's mean and spread; cells lie packed in blocks of bins, labels, weights and margins. Rows that are
drawn anew for each round stay single. A pass sums gradient, hessian and count by
node, feature and bin, one array for each task, and only for the smaller of two siblings: the other is the parent minus
it. Splits are found on the driver from these sums, whose size doesn't depend on the number of rows: 6 KB for each open leaf
and feature. Trees grow by level (all leaves that gain) or best first, up to a number of leaves; the latter computes the
children of all waiting leaves in one pass, so that the best of them is known without a pass for each split.

A split sends missing values to the side that gains more. A leaf weighs -G / (H + reg_lambda); a split gains
(GL^2 / (HL + reg_lambda) + GR^2 / (HR + reg_lambda) - G^2 / (H + reg_lambda)) / 2 and must gain more than ``gamma``.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..operators.quantiles import order_statistics
from ..session import discard, freeze
from .optimise import added_up

#: Bins of a feature; the last number stands for a missing value.
BINS, MISSING = 255, 255
CELLS = BINS + 1
BLOCK_ROWS = 65_536
#: Rounds after which margins are written anew; passes replay the trees since.
STORE_EVERY = 10
BINARY = ("x", "y", "weight", "spread", "margin", "checked")
BLOCK = ", ".join(["block long", "n int", *(f"{c} binary" for c in BINARY)])
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in BINARY)])
CELL = pa.schema([("cell", pa.binary()), ("n", pa.int64()), ("total", pa.float64()), ("squares", pa.float64())])
CELL_KINDS = "cell binary, n long, total double, squares double"


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Bins below or at ``cut`` (values below ``threshold``) go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, threshold: float, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.threshold[node], self.missing_left[node] = feature, cut, threshold, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for own, empty in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.missing_left, True), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                own.append(empty)
        return self.left[node], self.right[node]

    def leaves(self, x: np.ndarray, by: str) -> np.ndarray:
        """The leaf of each row, by bins (``cut``) or by values (``threshold``)."""
        feature, left, right = (np.array(a) for a in (self.feature, self.left, self.right))
        cut, side = np.array(getattr(self, by)), np.array(self.missing_left)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            seen = x[rows, feature[at]]
            goes = seen <= cut[at] if by == "cut" else seen < cut[at]
            goes = np.where(seen == MISSING if by == "cut" else np.isnan(seen), side[at], goes)
            node[rows] = np.where(goes, left[at], right[at])
        return node

    def values(self, x: np.ndarray, by: str) -> np.ndarray:
        return np.array(self.value)[self.leaves(x, by)]

    def depth(self, node: int = 0) -> int:
        return 0 if self.feature[node] < 0 else 1 + max(self.depth(self.left[node]), self.depth(self.right[node]))


@dataclass
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: np.ndarray  # gradient, hessian, rows
    right: np.ndarray


@dataclass
class Settings:
    rounds: int
    rate: float
    leaves: int | None  # best first up to so many leaves; by level without
    depth: int | None
    reg_lambda: float
    gamma: float
    least_hessian: float
    least_rows: int
    row_share: float
    feature_share: float
    seed: int
    patience: int


def settings_of(p: dict, leaf_wise: bool) -> Settings:
    depth = p.get("max_depth")
    return Settings(
        p["n_estimators"], p["learning_rate"], p["num_leaves"] if leaf_wise else None, None if depth is None or depth < 0 else int(depth),
        p["reg_lambda"], p.get("gamma", 0.0), p["min_child_weight"], p.get("min_child_samples", 1), p["subsample"], p["colsample_bytree"],
        p["random_state"], p.get("patience", 10),
    )


# --- bins and blocks ------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Ascending edges of each feature; a value lies in the bin of the number of edges not above it.

    A feature of at most BINS distinct values has an edge at each of them, any other at its exact quantiles.
    """
    guessed = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    few = [c for c in names if guessed[c] <= 2 * BINS]
    sets = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}  # some 2 * BINS values each
    edges = {c: np.unique(sets[c]) for c in few if len(sets[c]) <= BINS}
    many = [c for c in names if c not in edges]
    if many:
        places = [(k / BINS, lambda n, k=k: k * n // BINS) for k in range(BINS)]
        for c, (_, values) in order_statistics(rows, {c: places for c in many})[()].items():
            edges[c] = np.unique([v for v in values if v is not None])
    return [edges[c][1:] for c in names]


def binned(batch: pa.RecordBatch, names: list[str], edges: list[np.ndarray]) -> np.ndarray:
    """The bins of a batch, a row for each of its rows."""
    x = np.empty((batch.num_rows, len(names)), np.uint8)
    for i, (name, own) in enumerate(zip(names, edges)):
        values = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
        x[:, i] = np.where(np.isnan(values), MISSING, np.searchsorted(own, values, "right"))
    return x


def merged(cells: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of bytes once, in ascending order, with their sums added in the order given."""
    width = cells.shape[1]
    if width > 8:
        keys = np.ascontiguousarray(cells).view(f"V{width}").ravel()
    else:  # as whole numbers
        keys = np.zeros((len(cells), 8), np.uint8)
        keys[:, :width] = cells
        keys = keys.view(np.uint64).ravel()
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return cells[first], np.column_stack([np.bincount(at, c, len(first)) for c in sums.T])


def combined(rows: DataFrame, names: list[str], edges: list[np.ndarray], centre: float | None) -> DataFrame:
    """(cell, n, total, squares): rows of equal bins that fit or check alike, with the sums of label - centre and of its square.

    Without a ``centre`` labels are numbers of classes, and rows of a cell share theirs. A cell is its bins, whether it checks
    and two bytes of the class. Each batch is combined before the shuffle; the order of every sum is fixed.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, check = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "__check"))
                own = y.astype(np.uint16) if centre is None else np.zeros(len(y), np.uint16)
                gap = np.zeros(len(y)) if centre is None else y - centre
                cells = np.column_stack([binned(batch, names, edges), check.astype(np.uint8), own >> 8, own & 255]).astype(np.uint8)
                yield as_cells(*merged(cells, np.column_stack([np.ones(len(y)), gap, gap * gap])))

    def as_cells(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        keys = pa.array([c.tobytes() for c in cells], pa.binary())
        return pa.RecordBatch.from_arrays([keys, pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2])], schema=CELL)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] | None = None  # the last cell may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                cells = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                sums = np.column_stack([batch.column(c).to_numpy() for c in ("n", "total", "squares")])
                if kept is not None:
                    cells, sums = np.vstack([kept[0], cells]), np.vstack([kept[1], sums])
                starts = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
                cells, sums = cells[starts], np.add.reduceat(sums, starts, axis=0)
                kept = cells[-1:], sums[-1:]
                yield as_cells(cells[:-1], sums[:-1])
        if kept is not None:
            yield as_cells(*kept)

    parts = rows.select(*names, "label", "__check").mapInArrow(count, CELL_KINDS)
    return freeze(parts.repartition("cell").sortWithinPartitions("cell", "n", "total", "squares").mapInArrow(add, CELL_KINDS), "boosting-cells")


def packed(rows: DataFrame, names: list[str], edges: list[np.ndarray], base: np.ndarray, combine: bool = False, classes: int = 0) -> DataFrame:
    """Blocks of rows (features, label, __check): bins, labels, weights, margins and which rows only check.

    With ``combine`` rows of equal bins are one, which weighs as many; its label is their mean.
    """
    d, centre = len(names), None if classes else float(base[0])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = TaskContext.get().partitionId() << 32, []

        def out() -> pa.RecordBatch:
            nonlocal seen, held
            x, y, weight, spread, check = (np.concatenate(part) for part in zip(*held))
            margin = np.ascontiguousarray(np.broadcast_to(base, (len(y), len(base))))
            cells = [seen, len(y), *(v.tobytes() for v in (x, y, weight, spread, margin, check))]
            seen, held = seen + 1, []
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

        for batch in batches:
            if combine and batch.num_rows:
                cells = np.frombuffer(b"".join(batch.column("cell").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                n, total, squares = (batch.column(c).to_numpy().astype(np.float64) for c in ("n", "total", "squares"))
                if centre is None:
                    y, spread = cells[:, d + 1] * 256.0 + cells[:, d + 2], np.zeros(len(n))
                else:
                    y, spread = centre + total / n, np.maximum(squares - total * total / n, 0.0)
                held.append((cells[:, :d], y, n, spread, cells[:, d].astype(bool)))
            elif batch.num_rows:
                y = batch.column("label").to_numpy(zero_copy_only=False)
                held.append((binned(batch, names, edges), y, np.ones(len(y)), np.zeros(len(y)), batch.column("__check").to_numpy(zero_copy_only=False)))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield out()
        if held:
            yield out()

    full = combined(rows, names, edges, centre) if combine else rows.select(*names, "label", "__check")
    blocks = freeze(full.coalesce(max(1, full.count() // BLOCK_ROWS)).mapInArrow(pack, BLOCK), "boosting-blocks")  # no task of a pass without a whole block
    if combine:
        discard(full)
    return blocks


def unpacked(row: dict, d: int, k: int) -> tuple[np.ndarray, ...]:
    """(bins, labels, weights, spreads of labels, margins, whether a row only checks) of a block."""
    return (
        np.frombuffer(row["x"], np.uint8).reshape(-1, d), *(np.frombuffer(row[c], np.float64) for c in ("y", "weight", "spread")),
        np.frombuffer(row["margin"], np.float64).reshape(-1, k), np.frombuffer(row["checked"], bool),
    )


def added(margin: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    if not rounds:
        return margin
    return margin + sum(np.column_stack([tree.values(x, "cut") for tree in trees]) for trees in rounds)


# --- objectives -----------------------------------------------------------------------------------


def probabilities(margin: np.ndarray) -> np.ndarray:
    """Of all classes: a logistic of one margin, or a softmax of several."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return np.hstack([1 - p, p])
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, y: np.ndarray, classification: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradients, hessians, loss) of each row; half the squared error, or minus the log-likelihood."""
    if not classification:
        error = margin[:, 0] - y
        return error[:, None], np.ones((len(y), 1)), 0.5 * error * error
    p, own = probabilities(margin), y.astype(np.int64)
    loss = -np.log(np.maximum(p[np.arange(len(y)), own], 1e-15))
    if margin.shape[1] == 1:
        return (p[:, 1] - y)[:, None], np.maximum(p[:, 1:] * p[:, :1], 1e-16), loss
    return p - (own[:, None] == np.arange(p.shape[1])), np.maximum(2 * p * (1 - p), 1e-16), loss


# --- sums -----------------------------------------------------------------------------------------


class Booster:
    """One fit: the blocks, the finished rounds, and the passes over them."""

    def __init__(self, rows: DataFrame, names: list[str], s: Settings, classes: int):
        self.s, self.d, self.classification = s, len(names), classes > 0
        self.edges = bin_edges(rows, names)
        self.k = classes if classes > 2 else 1
        if classes > 2:
            shares = {int(r.label): r["count"] for r in rows.where("not __check").groupBy("label").count().collect()}  # one for each class
            n = sum(shares.values())
            self.base = np.log(np.array([max(shares.get(c, 0), 0.5) / n for c in range(classes)]))
        else:
            mean = rows.where("not __check").agg(F.avg("label")).first()[0]
            if mean is None:
                raise ValueError("no complete rows to train on")
            odds = min(max(mean, 1e-6), 1 - 1e-6)
            self.base = np.array([math.log(odds / (1 - odds)) if classes else mean])
        self.blocks = packed(rows, names, self.edges, self.base, s.row_share == 1, classes)
        self.tasks = self.blocks.rdd.getNumPartitions()
        self.rounds: list[list[Tree]] = []
        self.stored = 0
        self.gains, self.splits = np.zeros(self.d), np.zeros(self.d, np.int64)
        self.losses: list[tuple[float, float]] = []  # of fitting and checking rows, before each round

    def histograms(self, trees: list[Tree], wanted: list[list[int]], features: list[np.ndarray]) -> list[list[np.ndarray]]:
        """For each class and wanted node, the sums of (gradient, hessian, rows) by feature and bin."""
        s, d, k, classification = self.s, self.d, self.k, self.classification
        since, number = self.rounds[self.stored :], len(self.rounds)
        sizes = [len(nodes) * len(own) * CELLS * 3 for nodes, own in zip(wanted, features)]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((3, len(nodes), len(own), CELLS)) for nodes, own in zip(wanted, features)]
            losses = np.zeros(4)
            for batch in batches:
                for row in batch.to_pylist():
                    x, y, weight, spread, margin, check = unpacked(row, d, k)
                    g, h, loss = gradients(added(margin, x, since), y, classification)
                    g, h, loss = g * weight[:, None], h * weight[:, None], loss * weight + spread / 2
                    losses += [loss[~check].sum(), weight[~check].sum(), loss[check].sum(), weight[check].sum()]
                    used = ~check
                    if s.row_share < 1:
                        used = used & (np.random.default_rng([s.seed, number, row["block"]]).random(len(y)) < s.row_share)
                    for c, tree in enumerate(trees):
                        place = np.full(len(tree.feature), -1)
                        place[wanted[c]] = np.arange(len(wanted[c]))
                        at = place[tree.leaves(x, "cut")]
                        own = np.flatnonzero((at >= 0) & used)
                        if not len(own):
                            continue
                        for j, f in enumerate(features[c]):
                            cell = at[own] * CELLS + x[own, f]
                            for i, values in enumerate((g[own, c], h[own, c], weight[own])):
                                sums = np.bincount(cell, values, len(wanted[c]) * CELLS)
                                total[c][i, :, j] += sums.reshape(-1, CELLS)
            out = np.concatenate([losses, *(t.ravel() for t in total)])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()])], names=["part", "sums"])

        parts = self.blocks.mapInArrow(add, "part int, sums binary")
        total = added_up(parts, 4 + sum(sizes), self.tasks)
        self.loss = total[0] / max(total[1], 1), total[2] / total[3] if total[3] else math.nan
        out, start = [], 4
        for nodes, own, size in zip(wanted, features, sizes):
            cells = total[start : start + size].reshape(3, len(nodes), len(own), CELLS)
            out.append([cells[:, i] for i in range(len(nodes))])
            start += size
        return out

    def best_split(self, cells: np.ndarray, features: np.ndarray) -> Split | None:
        """The split of largest gain; ties to the first feature, the lowest cut, missing values left."""
        s = self.s
        whole, missing = cells[:, 0].sum(axis=1), cells[:, :, MISSING]
        below = np.cumsum(cells[:, :, :BINS], axis=2)[:, :, :-1]
        left = np.stack([below + missing[:, :, None], below], axis=3)  # (3, features, cuts, side of the missing)
        right = whole[:, None, None, None] - left

        def score(part: np.ndarray) -> np.ndarray:
            weight = part[1] + s.reg_lambda
            return np.divide(part[0] ** 2, weight, out=np.zeros_like(weight), where=weight > 0)

        fits = (left[2] >= s.least_rows - 0.5) & (right[2] >= s.least_rows - 0.5) & (left[2] > 0.5) & (right[2] > 0.5)
        fits &= (left[1] >= s.least_hessian) & (right[1] >= s.least_hessian)
        whole_score = float(whole[0] ** 2 / (whole[1] + s.reg_lambda)) if whole[1] + s.reg_lambda > 0 else 0.0
        gain = np.where(fits, (score(left) + score(right) - whole_score) / 2, -np.inf)
        if not gain.size or gain.max() <= max(s.gamma, 1e-12 * abs(whole_score)):
            return None
        j, cut, side = np.unravel_index(int(gain.argmax()), gain.shape)
        return Split(float(gain[j, cut, side]), int(features[j]), int(cut), bool(side == 0), left[:, j, cut, side], right[:, j, cut, side])

    def grow(self) -> list[Tree]:
        """One tree for each margin, all of them in the same passes."""
        random = np.random.default_rng([self.s.seed, len(self.rounds)])
        size = max(1, math.ceil(self.s.feature_share * self.d))
        features = [np.sort(random.permutation(self.d)[:size]) if size < self.d else np.arange(self.d) for _ in range(self.k)]
        growing = [Growth(self, own) for own in features]
        while any(g.wanted for g in growing):
            found = self.histograms([g.tree for g in growing], [g.wanted for g in growing], features)
            if growing[0].first_pass:
                self.losses.append(self.loss)
            for g, cells in zip(growing, found):
                g.receive(cells)
        return [g.finished() for g in growing]

    def store(self) -> None:
        """Write the margins of the rounds so far and drop the blocks before."""
        d, k, since = self.d, self.k, self.rounds[self.stored :]

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x, _, _, _, margin, _ = unpacked(row, d, k)
                    row["margin"] = np.ascontiguousarray(added(margin, x, since)).tobytes()
                    yield pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        before, self.blocks = self.blocks, freeze(self.blocks.mapInArrow(advance, BLOCK), "boosting-blocks")
        discard(before)
        self.stored, self.tasks = len(self.rounds), self.blocks.rdd.getNumPartitions()

    def fit(self, checking: bool) -> dict:
        """All rounds, or as many as the checking rows gain from; the ensemble as plain lists."""
        best, stopped = (math.inf, 0), False
        while len(self.rounds) < self.s.rounds and not stopped:
            trees = self.grow()
            if checking:  # the pass for this round's roots has measured the rounds before
                loss = self.losses[-1][1]
                best = min(best, (loss, len(self.rounds)))
                stopped = len(self.rounds) - best[1] >= self.s.patience
            if all(tree.feature[0] < 0 for tree in trees) and self.s.row_share == 1 and self.s.feature_share == 1:
                break  # nothing gains any more
            self.rounds.append(trees)
            if len(self.rounds) - self.stored == STORE_EVERY:
                self.store()
        kept = self.rounds[: best[1]] if stopped else self.rounds
        discard(self.blocks)
        return {
            "classification": self.classification, "base": self.base.tolist(), "gains": self.gains.tolist(), "splits": self.splits.tolist(),
            "rounds": [[[t.feature, t.threshold, t.missing_left, t.left, t.right, t.value] for t in trees] for trees in kept],
        }


class Growth:
    """One tree on its way: which splits are settled, and whose sums it waits for.

    Nodes are numbered as in ``tree``, which also holds splits that were tried ahead and may not be kept.
    """

    def __init__(self, booster: Booster, features: np.ndarray):
        self.b, self.s, self.features, self.tree = booster, booster.s, features, Tree()
        self.cells: dict[int, np.ndarray] = {}
        self.splits: dict[int, Split | None] = {}
        self.parent, self.depth, self.totals = {0: -1}, {0: 0}, {0: np.zeros(3)}
        self.settled: set[int] = set()
        self.queue: list[tuple[float, int]] = []
        self.wanted, self.first_pass = [0], True

    def receive(self, cells: list[np.ndarray]) -> None:
        """Sums of the wanted nodes; their siblings follow from the parents."""
        known = []
        for node, own in zip(self.wanted, cells):
            self.cells[node] = own
            known.append(node)
            if node:
                up = self.parent[node]
                other = self.tree.left[up] + self.tree.right[up] - node
                self.cells[other] = self.cells.pop(up) - own
                known.append(other)
            else:
                self.totals[0], self.first_pass = own[:, 0].sum(axis=1), False
        for node in sorted(known):
            self.splits[node] = self.b.best_split(self.cells[node], self.features) if self.deeper(node) else None
            if self.splits[node] is None:
                del self.cells[node]
            if node == 0 or self.parent[node] in self.settled:
                self.offer(node)
        self.settle()

    def deeper(self, node: int) -> bool:
        """Whether the depth allows this node to split."""
        return self.s.depth is None or self.depth[node] < self.s.depth

    def offer(self, node: int) -> None:
        if (split := self.splits[node]) is not None:
            heapq.heappush(self.queue, (-split.gain if self.s.leaves else float(node), node))

    def expand(self, node: int) -> tuple[int, int]:
        """The children of a node that has a split, settled or not."""
        if self.tree.feature[node] < 0:
            split = self.splits[node]
            edges = self.b.edges[split.feature]
            threshold = float(edges[split.cut]) if split.cut < len(edges) else math.inf
            children = self.tree.split(node, split.feature, split.cut, threshold, split.missing_left)
            for child, total in zip(children, (split.left, split.right)):
                self.parent[child], self.depth[child], self.totals[child] = node, self.depth[node] + 1, total
        return self.tree.left[node], self.tree.right[node]

    def settle(self) -> None:
        """Take the best splits as long as all waiting leaves are known, then ask for what is missing."""
        limit = self.s.leaves or math.inf
        while self.queue and len(self.settled) + 1 < limit:
            node = heapq.heappop(self.queue)[1]
            children = self.expand(node)
            self.settled.add(node)
            if children[0] in self.splits:
                for child in children:
                    self.offer(child)
            elif self.s.leaves and self.deeper(children[0]):
                break  # a child may gain more than any other leaf
        self.wanted = []
        if len(self.settled) + 1 >= limit:
            return
        for _, node in self.queue:  # best first: one pass for the children of all waiting leaves
            self.expand(node)
        for up in sorted({self.parent[n] for n in self.parent} - {-1}):
            pair = self.tree.left[up], self.tree.right[up]
            if pair[0] not in self.splits and self.deeper(pair[0]):
                self.wanted.append(min(pair, key=lambda n: (self.totals[n][2], n)))

    def finished(self) -> Tree:
        """The tree of the settled splits, with its leaves weighed."""
        out, moved = Tree(), {0: 0}
        for node in sorted(self.settled, key=lambda n: (self.depth[n], n)):
            split = self.splits[node]
            moved[self.tree.left[node]], moved[self.tree.right[node]] = out.split(
                moved[node], split.feature, split.cut, self.tree.threshold[node], split.missing_left
            )
            self.b.gains[split.feature] += split.gain
            self.b.splits[split.feature] += 1
        for node, at in moved.items():
            g, h, _ = self.totals[node]
            weight = float(h) + self.s.reg_lambda
            out.value[at] = -self.s.rate * float(g) / weight if weight > 0 else 0.0
        return out


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``__prediction`` and, for classes, ``__probability`` from the columns ``__f0``, ``__f1``, ...; nulls are scored, too."""

    ensemble = Param(Params._dummy(), "ensemble", "the trees as JSON", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, ensemble: str = "", features: int = 0):
        super().__init__()
        self._set(**self._input_kwargs)

    def about(self) -> dict:
        return json.loads(self.getOrDefault(self.ensemble))

    def _transform(self, df: DataFrame) -> DataFrame:
        about = self.about()
        base, classification = np.array(about["base"]), about["classification"]
        rounds = [[Tree(f, [0] * len(f), t, m, a, b, v) for f, t, m, a, b, v in trees] for trees in about["rounds"]]

        @F.pandas_udf("array<double>")
        def margins(rows: pd.Series) -> pd.Series:
            x = np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), -1)
            total = np.tile(base, (len(x), 1))
            for trees in rounds:
                total += np.column_stack([tree.values(x, "threshold") for tree in trees])
            return pd.Series(list(probabilities(total) if classification else total))

        n = self.getOrDefault(self.features)
        scored = df.withColumn("__margins", margins(F.array(*[F.col(f"__f{i}") for i in range(n)])))
        if not classification:
            return scored.withColumn("__prediction", F.get("__margins", F.lit(0))).drop("__margins")
        best = F.array_position("__margins", F.array_max("__margins")) - 1
        return scored.withColumns({"__prediction": best.cast("double"), "__probability": F.col("__margins")}).drop("__margins")


def fit_boosted(rows: DataFrame, d: int, classes: int, s: Settings, checks: str | None = None) -> BoostedTrees:
    """Fit on rows (__f0..., label); rows where the column ``checks`` holds only decide when to stop."""
    names = [f"__f{i}" for i in range(d)]
    check = F.coalesce(F.col(checks).cast("boolean"), F.lit(False)) if checks else F.lit(False)
    rows = rows.select(*names, "label", check.alias("__check"))
    ensemble = Booster(rows, names, s, classes).fit(checks is not None)
    return BoostedTrees(ensemble=json.dumps(ensemble), features=d)
