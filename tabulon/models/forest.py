"""Random forests over cells of equal bins.

A tree sees a row only by its bins. Rows of equal bins (and class) are counted once, and a bootstrap draws them together: n
rows that are each drawn Poisson(1) times are drawn Poisson(n) times. For numbers, every distinct label of a cell is drawn on
its own and the cell keeps their weight, sum and squares. What a tree is grown from is its draws by cell, whose number is
bounded by CELLS whatever the number of rows; each tree grows in its own group, all nodes of a level at a time. Features with
more cells are left to Spark's own forest.

Draws come from a hash of tree, cell and label, so that they don't depend on partitions.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.quantiles import order_statistics
from ..session import discard, freeze

#: Bins of a feature, as Spark's forests have them.
BINS = 32
#: Cells of equal bins that trees are grown from; more go to Spark's forest.
CELLS = 40_000
#: Counted rows of a task that draws, draws of one step, and sums of a level that are held at once.
TASK_ROWS, STEP_DRAWS, LEVEL_SUMS = 65_536, 1 << 20, 1 << 22
#: A split must gain more than this share of its node's impurity, which is what rounding leaves.
ROUNDING = 1e-12
DRAWS = pa.schema([("tree", pa.int32()), ("cell", pa.int64()), ("label", pa.float64()), ("weight", pa.float64()), ("total", pa.float64()), ("squares", pa.float64())])
DRAWS_KINDS = "tree int, cell long, label double, weight double, total double, squares double"
TREE_KINDS = "tree int, nodes binary, importance array<double>"


@dataclass
class ForestSettings:
    trees: int
    depth: int
    least_rows: int
    features: int  # drawn for each node
    seed: int


# --- cells ----------------------------------------------------------------------------------------


def thresholds(rows: DataFrame, names: list[str]) -> list[list[float]]:
    """Ascending thresholds of each feature; a value lies in the bin of the number of thresholds below it.

    Few distinct values are parted half-way, many at their exact quantiles.
    """
    guessed = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    few = [c for c in names if guessed[c] <= 2 * BINS]
    sets = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    held = {c: np.unique(sets[c]) for c in few if len(sets[c]) <= BINS}
    found = {c: np.unique(v[:-1] / 2 + v[1:] / 2) for c, v in held.items()}
    if many := [c for c in names if c not in found]:
        places = [(k / BINS, lambda n, k=k: max(k * n // BINS - 1, 0)) for k in range(1, BINS)]
        for c, (_, values) in order_statistics(rows, {c: places for c in many})[()].items():
            found[c] = np.unique([float(v) for v in values if v is not None])
    return [found[c].tolist() for c in names]


def bin_of(value: Column, own: list[float], first: int = 0) -> Column:
    """The bin of a value by halving."""
    if not own:
        return F.lit(first).cast("long")
    middle = len(own) // 2
    return F.when(value <= F.lit(own[middle]), bin_of(value, own[:middle], first)).otherwise(bin_of(value, own[middle + 1 :], first + middle + 1))


def cell_of(names: list[str], edges: list[list[float]]) -> Column:
    """All bins as digits of one number."""
    cell = F.lit(0).cast("long")
    for name, own in zip(names, edges):
        cell = cell * (len(own) + 1) + bin_of(F.col(name), own)
    return cell


def bins_of(cells: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    x, rest = np.empty((len(cells), len(edges)), np.int16), cells
    for i in range(len(edges) - 1, -1, -1):
        rest, x[:, i] = np.divmod(rest, len(edges[i]) + 1)
    return x


# --- draws ----------------------------------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number (splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def poisson(n: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson(n) by row from uniform numbers ``u`` (rows, draws), by the inverse of the distribution."""
    out = np.empty(u.shape)
    order = np.argsort(n, kind="stable")
    values, starts = np.unique(n[order], return_index=True)
    for mean, rows in zip(values, np.split(order, starts[1:])):
        reach = 10 * np.sqrt(mean) + 20
        low = max(0, int(mean - reach))
        k = np.arange(low, int(mean + reach) + 1)
        log = np.cumsum(np.append(0.0, np.log(mean) - np.log(k[1:])))
        share = np.cumsum(np.exp(log - log.max()))
        out[rows] = low + np.searchsorted(share / share[-1], u[rows], "right")
    return out


def drawn(counted: DataFrame, s: ForestSettings, classification: bool, centre: float) -> DataFrame:
    """(tree, cell, label, weight, total, squares): what the bootstrap of each tree draws from the counted rows."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = mixed(np.arange(s.trees, dtype=np.uint64) + mixed(np.array([s.seed], np.int64).view(np.uint64)))
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, STEP_DRAWS // s.trees)):
                step = batch.slice(at, max(1, STEP_DRAWS // s.trees))
                cell, y, n = (step.column(c).to_numpy() for c in ("cell", "label", "n"))
                own = mixed(mixed(cell.view(np.uint64)) ^ (y + 0.0).view(np.uint64))
                weight = poisson(n, (mixed(own[:, None] ^ trees[None, :]) >> np.uint64(11)) * 2.0**-53)
                new = np.append(True, cell[1:] != cell[:-1]) | classification
                first, gap = np.flatnonzero(new), (0.0 if classification else y - centre)
                sums = [np.add.reduceat(v, first, axis=0) for v in (weight, (weight.T * gap).T, (weight.T * gap * gap).T)]
                row, tree = np.nonzero(sums[0])
                label = y[first][row] if classification else np.zeros(len(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip((tree, cell[first][row], label, *(v[row, tree] for v in sums)), DRAWS)], schema=DRAWS
                )

    dealt = counted.repartitionByRange(counted.count() // TASK_ROWS + 1, "cell", "label").sortWithinPartitions("cell", "label")
    return dealt.mapInArrow(draw, DRAWS_KINDS)


# --- trees ----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1, the right child follows the left one. Bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray  # share of each class, or the mean

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[self.feature[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = self.left[at] + (x[rows, self.feature[at]] > self.cut[at])
        return node

    def pack(self) -> bytes:
        return zlib.compress(b"".join([self.feature.astype(np.int16).tobytes(), self.cut.astype(np.int16).tobytes(), self.left.astype(np.int32).tobytes(), self.value.tobytes()]))

    @classmethod
    def unpack(cls, data: bytes, width: int) -> Tree:
        raw = zlib.decompress(data)
        n = len(raw) // (8 + 8 * width)
        feature, cut = np.frombuffer(raw, np.int16, 2 * n).reshape(2, n)
        return cls(feature, cut, np.frombuffer(raw, np.int32, n, 4 * n), np.frombuffer(raw, np.float64, n * width, 8 * n).reshape(n, width))


def weight_of(sums: np.ndarray, classification: bool) -> np.ndarray:
    return sums.sum(axis=-1) if classification else sums[..., 0]


def impurity(sums: np.ndarray, classification: bool) -> np.ndarray:
    """Weight times Gini's impurity, or the sum of squares about the mean."""
    weight = weight_of(sums, classification)
    safe = np.where(weight > 0, weight, 1.0)
    return np.maximum(weight - (sums * sums).sum(axis=-1) / safe if classification else sums[..., 2] - sums[..., 1] ** 2 / safe, 0.0)


def best_splits(at: np.ndarray, nodes: int, x: np.ndarray, sums: np.ndarray, allowed: np.ndarray, sizes: list[int], s: ForestSettings, classification: bool) -> tuple[np.ndarray, ...]:
    """(gain times weight, feature, cut) of each node from its cells; ties to the first feature and the lowest cut."""
    best, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    for f, size in enumerate(sizes):
        if size < 2:
            continue
        place = at * size + x[:, f]
        cells = np.stack([np.bincount(place, v, nodes * size).reshape(nodes, size) for v in sums.T], axis=2)
        left = np.cumsum(cells, axis=1)
        whole, left = left[:, -1:], left[:, :-1]
        right = whole - left
        before = impurity(whole, classification)
        gain = before - impurity(left, classification) - impurity(right, classification)
        fits = (weight_of(left, classification) >= s.least_rows) & (weight_of(right, classification) >= s.least_rows)
        gain = np.where(fits & allowed[:, f : f + 1] & (gain > ROUNDING * before), gain, 0.0)
        own = gain.argmax(axis=1)
        gain = gain[np.arange(nodes), own]
        more = gain > best
        best[more], feature[more], cut[more] = gain[more], f, own[more]
    return best, feature, cut


def grown(cells: np.ndarray, sums: np.ndarray, edges: list[list[float]], s: ForestSettings, classification: bool, centre: float, random: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """A tree and its features' importance from cells and their sums: weights by class, or (weight, total, squares)."""
    x, sizes, d = bins_of(cells, edges), [len(e) + 1 for e in edges], len(edges)
    order = np.arange(len(cells))  # cells by node of the level
    at, wholes, features, cuts, lefts, gains, levels = np.zeros(len(cells), np.int64), [], [], [], [], [], [0]
    nodes, seen = 1, 0
    chunk = max(1, LEVEL_SUMS // (max(sizes) * sums.shape[1]))
    while nodes:
        whole = np.column_stack([np.bincount(at, v, nodes) for v in sums[order].T])
        best, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        allowed = random.random((nodes, d)).argsort(axis=1).argsort(axis=1) < s.features
        for low in range(0, nodes if len(levels) <= s.depth else 0, chunk):
            high = min(low + chunk, nodes)
            a, b = np.searchsorted(at, [low, high])
            own = order[a:b]
            best[low:high], feature[low:high], cut[low:high] = best_splits(at[a:b] - low, high - low, x[own], sums[own], allowed[low:high], sizes, s, classification)
        split = feature >= 0
        seen += nodes
        rank = np.cumsum(split) - 1
        for held, values in ((wholes, whole), (features, feature), (cuts, cut), (lefts, np.where(split, seen + 2 * rank, 0)), (gains, best)):
            held.append(values)
        levels.append(seen)
        goes = split[at]
        order, at = order[goes], at[goes]
        at = 2 * rank[at] + (x[order, feature[at]] > cut[at])
        sorting = np.argsort(at, kind="stable")
        order, at, nodes = order[sorting], at[sorting], 2 * int(split.sum())
    whole, feature, cut, left, gain = (np.concatenate(v) for v in (wholes, features, cuts, lefts, gains))
    weight = weight_of(whole, classification)
    value = whole / weight[:, None] if classification else (centre + whole[:, 1] / weight)[:, None]
    says = value.argmax(axis=1) if classification else value[:, 0]
    for low, high in zip(levels[-2::-1], levels[:0:-1]):  # leaves that say the same are one, from the last level up
        up = low + np.flatnonzero(feature[low:high] >= 0)
        a = left[up]
        feature[up[(feature[a] < 0) & (feature[a + 1] < 0) & (says[a] == says[a + 1])]] = -1
    inner = np.zeros(len(feature), bool)
    inner[0] = True
    for low, high in zip(levels[:-1], levels[1:]):
        up = low + np.flatnonzero(inner[low:high] & (feature[low:high] >= 0))
        inner[left[up]] = inner[left[up] + 1] = True
    inner &= feature >= 0
    importance = np.bincount(feature[inner], gain[inner], d)
    return Tree(feature, cut, left, value), importance / importance.sum() if importance.sum() else importance


def trees_of(draws: DataFrame, edges: list[list[float]], s: ForestSettings, classes: int, centre: float) -> DataFrame:
    """(tree, nodes, importance) of every tree that drew rows, one group each."""
    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cell", "label", "weight", "total", "squares"])
        cells, at = np.unique(frame["cell"].to_numpy(), return_inverse=True)
        weight = frame["weight"].to_numpy()
        if classes:
            sums = np.bincount(at * classes + frame["label"].to_numpy().astype(np.int64), weight, len(cells) * classes).reshape(-1, classes)
        else:
            sums = np.column_stack([np.bincount(at, frame[c].to_numpy(), len(cells)) for c in ("weight", "total", "squares")])
        tree = int(frame["tree"].iloc[0])
        made, importance = grown(cells, sums, edges, s, classes > 0, centre, np.random.default_rng([s.seed & 0xFFFFFFFF, tree]))
        return pd.DataFrame({"tree": [tree], "nodes": [made.pack()], "importance": [importance]})

    return draws.repartition(s.trees, "tree").groupBy("tree").applyInPandas(grow, TREE_KINDS)


class Forest(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``__prediction`` and, for classes, ``__probability`` from the columns ``__f0``, ``__f1``, ..."""

    ensemble = Param(Params._dummy(), "ensemble", "thresholds, importance and packed trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, ensemble: str = ""):
        super().__init__()
        self._set(**self._input_kwargs)

    def about(self) -> dict:
        return json.loads(self.getOrDefault(self.ensemble))

    def _transform(self, df: DataFrame) -> DataFrame:
        about = self.about()
        edges, classes = about["edges"], about["classes"]
        packed = [base64.b64decode(t) for t in about["trees"]]

        @F.pandas_udf("array<double>" if classes else "double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = [Tree.unpack(t, classes or 1) for t in packed]
            known, values = np.zeros(0, np.int64), np.zeros((0, classes or 1))
            for batch in batches:
                cells, at = np.unique(batch.to_numpy(), return_inverse=True)
                new = np.setdiff1d(cells, known, assume_unique=True)
                if len(known) + len(new) > 4 * CELLS:
                    known, values, new = known[:0], values[:0], cells
                if len(new):  # rows of one cell score alike
                    x = bins_of(new, edges)
                    known, values = np.append(known, new), np.concatenate([values, sum(tree.value[tree.leaves(x)] for tree in trees) / len(trees)])
                    order = np.argsort(known)
                    known, values = known[order], values[order]
                found = values[np.searchsorted(known, cells)][at]
                yield pd.Series(list(found)) if classes else pd.Series(found[:, 0])

        scored = df.withColumn("__out", scores(cell_of([f"__f{i}" for i in range(len(edges))], edges)))
        if not classes:
            return scored.withColumnRenamed("__out", "__prediction")
        best = F.array_position("__out", F.array_max("__out")) - 1
        return scored.withColumns({"__prediction": best.cast("double"), "__probability": F.col("__out")}).drop("__out")


def fit_forest(rows: DataFrame, d: int, classes: int, s: ForestSettings) -> Forest | None:
    """Fit on complete rows (__f0..., label); None where the features make too many cells."""
    names = [f"__f{i}" for i in range(d)]
    centre = rows.agg(F.avg("label")).first()[0]
    if centre is None:
        raise ValueError("no complete rows to train on")
    centre = float(f"{centre:.4g}")  # whatever the order in which labels were added
    edges = thresholds(rows, names)
    if np.prod([len(e) + 1.0 for e in edges]) >= 2.0**62:
        return None
    celled = rows.select(cell_of(names, edges).alias("cell"), "label")
    if celled.agg(F.approx_count_distinct("cell", 0.02)).first()[0] > CELLS:
        return None
    counted = freeze(celled.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")), "forest-cells")
    made = sorted(trees_of(drawn(counted, s, classes > 0, centre), edges, s, classes, centre).collect(), key=lambda r: r.tree)
    discard(counted)
    if not made:  # no tree drew a row
        return None
    importance = np.sum([r.importance for r in made], axis=0)
    importance = importance / importance.sum() if importance.sum() else importance
    trees = [base64.b64encode(r.nodes).decode() for r in made]
    return Forest(ensemble=json.dumps({"edges": edges, "classes": classes, "importance": importance.tolist(), "trees": trees}))
