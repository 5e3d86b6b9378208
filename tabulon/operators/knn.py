"""Exact nearest neighbours.

A reference that fits a checked size is broadcast and scanned in numpy blocks. A larger one of many
dimensions, where every cell would be visited, goes through a join of blocks; one of few dimensions and
many rows, which a scan would compare with every query, is cut into cells around pivots; the triangle inequality tells each query which cells can hold one of its
neighbours, and only those are visited. Cells are split into chunks and their queries into blocks, so
every task sees a bounded piece however crowded a cell is. Copies of one vector are reduced to the k
with the smallest ids, which are the only ones that can be among k neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import col, require
from ..functions.hashing import hash_order
from ..session import freeze
from .lookup import lookup_join
from .quantiles import order_statistics

BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows of a reference of few dimensions that every query is compared with.
SCAN_ROWS = 50_000
MAX_PIVOTS = 4000
#: Distances to pivots that a task holds at a time.
GAPS = 2_000_000
CHUNK_ROWS = 2048
BLOCK_ROWS = 4096
SALTS = 64
SLACK = 1e-9
#: Dimensions from which on cells can't be left out.
CELL_DIMS = 16
#: Pairs ranked at a time in double precision; queries and references of a product in single precision.
PAIRS, TILE_QUERIES, TILE_REFERENCES = 1_000_000, 256, 4096
#: Queries answered at a time, and pairs measured at a time.
STEP_QUERIES, MEASURED = 16_384, 200_000


def _nearest(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of queries: (query row, reference row, distance) of the k nearest, ties by id.

    A matrix product ranks roughly; every reference within rounding error of the k-th is then
    measured exactly. Vectors of many dimensions are ranked in single precision, a tile at a time.
    """
    k = min(k, len(r))
    if not len(q) or not k:
        none = np.zeros(0, dtype="int64")
        return none, none, np.zeros(0)
    tiled = _tiles(q, r) if q.shape[1] > CELL_DIMS else None
    step = max(1, PAIRS // len(r)) if tiled is None else TILE_QUERIES
    parts = []
    for at in range(0, len(q), step):
        if tiled is None:
            near, far = _within_reach(q[at:at + step], r, k)
            parts.append((near + at, far))
        else:
            parts.append(_reached(tiled[0][at:at + step], tiled[1], k, tiled[2], at))
    rows, refs = (np.concatenate(p) for p in zip(*parts))
    dist = np.empty(len(rows))
    for at in range(0, len(rows), MEASURED):
        gaps = q[rows[at:at + MEASURED]] - r[refs[at:at + MEASURED]]
        dist[at:at + MEASURED] = np.sqrt((gaps * gaps).sum(axis=1))
    order = np.lexsort((ids[refs], dist, rows))
    rows, refs, dist = rows[order], refs[order], dist[order]
    first = np.searchsorted(rows, np.arange(len(q)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], refs[keep], dist[keep]


def _within_reach(q: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    qq, rr = (q * q).sum(axis=1)[:, None], (r * r).sum(axis=1)[None, :]
    rough = np.maximum(qq + rr - 2 * (q @ r.T), 0)
    cut = np.partition(rough, k - 1, axis=1)[:, k - 1:k]
    return np.nonzero(rough <= cut + SLACK * (qq + rr.max()))


def _tiles(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Queries and references in single precision, whose product is larger the nearer they are, and twice its rounding error.

    Both are moved to the references' mean and scaled to lengths of at most one; None where that is not possible.
    """
    centre = r.mean(axis=0)
    a, b = q - centre, r - centre
    longest = np.sqrt(max((a * a).sum(axis=1).max(), (b * b).sum(axis=1).max()))
    if not 1e-100 < longest < 1e100:
        return None
    # cancellation against a far centre is covered by the error that single precision has for moved vectors
    if longest < 1e-6 * np.abs(centre).max():
        return None
    a, b = a / longest, b / longest
    half = (b * b).sum(axis=1)[:, None] / 2
    left = np.concatenate([a, np.full((len(a), 1), -1.0)], axis=1).astype("float32")
    return left, np.concatenate([b, half], axis=1).astype("float32"), 4 * (q.shape[1] + 8) * 2.0**-24


def _reached(a: np.ndarray, b: np.ndarray, k: int, slack: float, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row + ``at``, reference row) of all pairs that may be among the k largest products of their query."""
    first = max(TILE_REFERENCES // 4, k)
    cut, held, size = None, [], 0
    buffer = np.empty(len(a) * max(first, TILE_REFERENCES), dtype="float32")

    def narrowed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, refs, near = (np.concatenate(p) for p in zip(*held))
        order = np.lexsort((-near, rows))
        rows, refs, near = rows[order], refs[order], near[order]
        kth = near[np.searchsorted(rows, np.arange(len(a))) + k - 1]
        keep = near >= kth[rows] - slack
        cut[:] = kth - slack
        return rows[keep], refs[keep], near[keep]

    start = 0
    while start < len(b):
        part = b[start:start + (TILE_REFERENCES if start else first)]
        near = np.matmul(a, part.T, out=buffer[:len(a) * len(part)].reshape(len(a), len(part)))
        if cut is None:
            cut = np.partition(near, len(part) - k, axis=1)[:, len(part) - k] - slack
        places = np.flatnonzero(near >= cut.astype("float32")[:, None])
        rows, refs = np.divmod(places, len(part))
        held.append((rows, refs + start, near.ravel()[places]))
        size += len(rows)
        start += len(part)
        if size > 8 * k * len(a):
            held = [narrowed()]
            size = len(held[0][0])
            if size > MEASURED and len(a) > 1:  # very many equally near: fewer queries at a time
                middle = len(a) // 2
                halves = (_reached(a[:middle], b, k, slack, at), _reached(a[middle:], b, k, slack, at + middle))
                return tuple(np.concatenate(p) for p in zip(*halves))
    rows, refs, _ = narrowed()
    return rows + at, refs


def _in_steps(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The results of :func:`_nearest` for a few thousand queries after the other, query rows counted from the first."""
    for start in range(0, len(q), STEP_QUERIES):
        rows, refs, dist = _nearest(q[start:start + STEP_QUERIES], r, ids, k)
        yield rows + start, refs, dist


def _block_neighbours(queries: pd.DataFrame, ref: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    if queries.empty:
        return pd.DataFrame({"q": [], "r": [], "distance": [], "y": []})
    matrix, ids, carried = ref
    own = queries["q"].to_numpy()
    points = np.stack(queries["v"].to_numpy()).astype("float64")
    parts = [
        pd.DataFrame({"q": own[rows], "r": ids[refs], "distance": dist, "y": carried[refs]})
        for rows, refs, dist in _in_steps(points, matrix, ids, k)
    ]
    return pd.concat(parts)


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["v"].to_numpy()).astype("float64"), pdf["r"].to_numpy(), pdf["y"].to_numpy()


RESULT = "q bigint, r bigint, distance double, y double"


def _first_copies(ref: DataFrame, k: int) -> DataFrame:
    """At most k rows per distinct vector, those with the smallest ids; hot vectors thin out in salted parts first."""
    salted = ref.withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(SALTS)))
    for keys in (["v", "salt"], ["v"]):
        order = Window.partitionBy(*keys).orderBy("r")
        salted = salted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    return salted.drop("salt")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(
    queries: DataFrame,
    reference: DataFrame,
    query_id: str,
    reference_id: str,
    features: str,
    k: int = 5,
    carry: str | None = None,
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    pivots: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, neighbour_id, distance, rank[, carry]): the k nearest by Euclidean distance, ties by id.

    Ids are whole numbers; ``features`` is an array column on both sides. With ``exclude_self`` a
    reference row with the query's own id is not its neighbour.
    """
    require(queries, query_id, features)
    require(reference, reference_id, features, *([carry] if carry else []))
    vector = col(features).cast("array<double>")
    q = queries.select(col(query_id).cast("bigint").alias("q"), vector.alias("v")).where("v IS NOT NULL")
    y = col(carry).cast("double") if carry else F.lit(0.0)
    ref = reference.select(col(reference_id).cast("bigint").alias("r"), vector.alias("v"), y.alias("y")).where(
        "v IS NOT NULL"
    )
    wanted = k + 1 if exclude_self else k
    n, dims = ref.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n * (dims + 2) * 8 <= broadcast_bytes and (dims > CELL_DIMS or n <= SCAN_ROWS):
        found = _broadcast_join(q, ref, wanted)
    elif dims <= CELL_DIMS:
        found = _cell_join(q, ref, n, wanted, pivots, chunk_rows, block_rows)
    else:
        from .knn_blocks import block_join

        found = block_join(q, _first_copies(ref, wanted), wanted, chunk_rows, block_rows)
    if exclude_self:
        found = found.where(F.col("q") != F.col("r"))
    best = _best(found, k)
    names = [F.col("q").alias("query_id"), F.col("r").alias("neighbour_id"), "distance", F.col("rank").cast("long")]
    return best.select(*names, *([F.col("y").alias(carry)] if carry else []))


def _broadcast_join(q: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    local = ref.toPandas()  # size checked by the caller
    if local.empty:
        return q.sparkSession.createDataFrame([], RESULT)
    shared = q.sparkSession.sparkContext.broadcast(_arrays(local))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _block_neighbours(batch, shared.value, k)

    return q.mapInPandas(search, RESULT)


def _cell_join(
    q: DataFrame, ref: DataFrame, n: int, k: int, pivots: int | None, chunk_rows: int, block_rows: int
) -> DataFrame:
    spark = q.sparkSession
    slim = _first_copies(ref, k)
    count = pivots or int(min(MAX_PIVOTS, max(1, n ** 0.5)))
    chosen = slim.orderBy(hash_order(["r"]), "r").limit(count).toPandas()
    centres = np.unique(np.stack(chosen["v"].to_numpy()).astype("float64"), axis=0)
    shared = spark.sparkContext.broadcast(centres)

    def to_centres(v: np.ndarray) -> np.ndarray:
        c = shared.value
        square = (v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (v @ c.T)
        return np.sqrt(np.maximum(square, 0))

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, GAPS // len(shared.value))
        for batch in batches:
            for start in range(0, len(batch), step):
                yield batch.iloc[start:start + step]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            if len(batch):
                gap = to_centres(np.stack(batch["v"].to_numpy()).astype("float64"))
                cell = gap.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), gap=gap[np.arange(len(cell)), cell])

    placed = freeze(
        slim.mapInPandas(assign, "r bigint, v array<double>, y double, cell int, gap double"), "cells"
    )
    # per cell (at most `count`): size, radius and the distance within which it holds k rows
    kth = order_statistics(placed, {"gap": [(0.0, lambda m: min(k, m) - 1), (1.0, lambda m: m - 1)]}, ["cell"])
    cells = {g[0]: per["gap"] for g, per in kth.items()}
    sizes = np.zeros(len(centres), dtype="int64")
    reach, radius = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for c, (m, (near, far)) in cells.items():
        sizes[c], radius[c] = m, far
        if m >= k:
            reach[c] = near
    layout = spark.sparkContext.broadcast((reach, radius))

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach, radius = layout.value
        for batch in slices(batches):
            if not len(batch):
                continue
            gap = to_centres(np.stack(batch["v"].to_numpy()).astype("float64"))
            bound = (gap + reach[None, :]).min(axis=1)
            slack = 1e-6 * (1 + np.abs(gap))
            rows, cell = np.nonzero(gap - radius[None, :] <= bound[:, None] + slack)
            yield pd.DataFrame(
                {"q": batch["q"].to_numpy()[rows], "v": batch["v"].to_numpy()[rows], "cell": cell.astype("int32")}
            )

    # equal query vectors are searched once, under the smallest of their ids
    distinct = freeze(q.groupBy("v").agg(F.min("q").alias("q")), "queries")
    pairs = freeze(distinct.mapInPandas(candidates, "q bigint, v array<double>, cell int"), "pairs")
    blocks = {r["cell"]: -(-r["count"] // block_rows) for r in pairs.groupBy("cell").count().collect()}
    rows = [(int(c), int(-(-sizes[c] // chunk_rows)), int(blocks[c])) for c in blocks if sizes[c]]
    plan = F.broadcast(spark.createDataFrame(rows, "cell int, chunks bigint, blocks bigint"))  # one row per cell

    left = pairs.join(plan, "cell").select(
        "q", "v", "cell", F.pmod(F.xxhash64("q"), F.col("blocks")).alias("block"),
        F.explode(F.expr("sequence(0L, chunks - 1L)")).alias("chunk"),
    )
    right = placed.join(plan, "cell").select(
        "r", "v", "y", "cell", F.pmod(F.xxhash64("r"), F.col("chunks")).alias("chunk"),
        F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"),
    )

    def search(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if lhs.empty or rhs.empty:
            return pd.DataFrame({"q": [], "r": [], "distance": [], "y": []})
        return _block_neighbours(lhs, _arrays(rhs), k)

    keys = ["cell", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, RESULT)
    best = _best(found, k).drop("rank")
    # give the result of each distinct vector to all queries that carry it
    neighbours = best.groupBy("q").agg(F.collect_list(F.struct("r", "distance", "y")).alias("near"))  # k per query
    lookup = distinct.join(neighbours, "q").select("v", "near")
    return lookup_join(q, lookup, ["v"]).select("q", F.explode("near").alias("n")).select("q", "n.*")
