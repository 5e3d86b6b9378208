"""Nearest neighbours of large references: an exact join of blocks, and an approximate one by p-stable hashing.

The exact join packs both sides into blocks and lays them on a grid: every pair of groups of blocks meets in one task. It is
meant for many dimensions, where no cell can be left out.

The approximate join hashes every vector into several tables, each by several projections onto random directions (Datar et
al. 2004), and compares only vectors that share a bucket. The width of the steps and the number of projections are chosen
from the exact neighbours of a few sample queries, so that the wanted recall is reached with the fewest comparisons, and the
recall on those queries is measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import col, require
from ..functions.hashing import hash_order
from ..session import freeze
from .knn import RESULT, _arrays, _best, _block_neighbours, _first_copies, _nearest
from .lookup import lookup_join

#: Queries whose exact neighbours tune the hashes, and rows that tell how far apart vectors are in general.
PILOT, SPREAD = 200, 200
TABLES, MOST_PROJECTIONS = 10, 16
#: Rows of a block of queries and of references, and bytes of vectors that a task holds of either side.
BLOCK_ROWS, CHUNK_ROWS, CELL_BYTES = 32_768, 32_768, 16 * 1024 * 1024
#: Pairs of rows that are handed to one ranking, which works through them in tiles.
PAIRS = 64_000_000
PACKED = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("carried", pa.binary())])


def packed(rows: DataFrame, size: int) -> DataFrame:
    """(ids, vectors, carried) of ``size`` rows (i, v, y) each, one row for each block."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(part: list[tuple]) -> pa.RecordBatch:
            ids, vectors, carried = zip(*part)
            cells = [np.array(ids, np.int64).tobytes(), np.array(vectors, np.float64).tobytes(), np.array(carried, np.float64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], schema=PACKED)

        for batch in batches:
            carried = batch.column("y").to_numpy(zero_copy_only=False)
            held += zip(batch.column("i").to_pylist(), batch.column("v").to_pylist(), carried)
            while len(held) >= size:
                yield out(held[:size])
                held = held[size:]
        if held:
            yield out(held)

    return rows.select("i", "v", "y").mapInArrow(pack, "ids binary, vectors binary, carried binary")


def compared(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest references of each query, for every pair of groups of a batch; cells are read in place."""
    kinds = {"ids": np.int64, "q_ids": np.int64, "vectors": np.float64, "q_vectors": np.float64, "carried": np.float64}
    for at in range(batch.num_rows):
        ids, own, matrix, points, carried = (np.frombuffer(batch.column(c)[at].as_buffer(), kind) for c, kind in kinds.items())
        matrix, points = matrix.reshape(len(ids), -1), points.reshape(len(own), -1)
        step = max(1, PAIRS // max(1, len(ids)))
        for start in range(0, len(own), step):
            rows, refs, distance = _nearest(points[start : start + step], matrix, ids, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[start : start + step][rows]), pa.array(ids[refs]), pa.array(distance), pa.array(carried[refs])], names=["q", "r", "distance", "y"]
            )


def grid(blocks: DataFrame, asked: DataFrame) -> tuple[int, int]:
    """(groups of reference blocks, groups of query blocks): no group far beyond CELL_BYTES, and enough pairs of groups for all cores."""
    sides = [df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0))).first() for df in (blocks, asked)]
    groups = [min(max(1, n), max(1, math.ceil(size / CELL_BYTES))) for n, size in sides]
    wanted = 4 * blocks.sparkSession.sparkContext.defaultParallelism
    while groups[0] * groups[1] < wanted:
        room = [i for i in (0, 1) if groups[i] < sides[i][0]]
        if not room:
            break
        grown = max(room, key=lambda i: sides[i][1] / groups[i])
        groups[grown] += 1
    return groups[0], groups[1]


def block_join(q: DataFrame, ref: DataFrame, k: int, chunk_rows: int = 2048, block_rows: int = 4096) -> DataFrame:
    """(q, r, distance, y): the k nearest of each group of references to each query (q, v); references are (r, v, y).

    Blocks of either side are dealt to groups, and every pair of groups meets in one task: a block moves once for each
    group of the other side, not once for each of its blocks.
    """
    blocks = freeze(packed(ref.select(F.col("r").alias("i"), "v", "y"), chunk_rows), "reference-blocks")
    asked = freeze(packed(q.select(F.col("q").alias("i"), "v", F.lit(0.0).alias("y")), block_rows), "query-blocks")
    across, down = grid(blocks, asked)

    def dealt(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias(own)
        return df.select("ids", "vectors", "carried", mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    laid, sent = dealt(blocks, "across", across, "down", down), dealt(asked, "down", down, "across", across)
    schema = pa.schema([("q", pa.int64()), ("r", pa.int64()), ("distance", pa.float64()), ("y", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sides = {"ids": (left, "ids"), "q_ids": (right, "ids"), "vectors": (left, "vectors"), "q_vectors": (right, "vectors"), "carried": (left, "carried")}
        cells = [pa.array([b"".join(cell.as_buffer() for cell in side.column(c))], pa.binary()) for side, c in sides.values()]
        return pa.Table.from_batches(compared(pa.RecordBatch.from_arrays(cells, names=list(sides)), k), schema)

    keys = ["across", "down"]
    return laid.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(search, RESULT)


def collision(distance: np.ndarray, width: float) -> np.ndarray:
    """Chance that one projection puts two vectors at this distance into the same step."""
    t = width / np.maximum(distance, 1e-12)
    erf = np.vectorize(math.erf)
    return erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - np.exp(-t * t / 2))


def tuned(near: np.ndarray, far: np.ndarray, tables: int, recall: float) -> tuple[int, float]:
    """(projections of a table, width of a step): the wanted recall of the near ones with the fewest of the far ones."""
    best = (np.inf, 1, float(near.max(initial=1.0)) * 100 or 1.0)
    scale = float(np.median(near)) or 1.0
    for projections in range(1, MOST_PROJECTIONS + 1):
        for width in scale * np.geomspace(0.5, 64, 57):
            if (1 - (1 - collision(near, width) ** projections) ** tables).mean() >= recall:
                met = (1 - (1 - collision(far, width) ** projections) ** tables).mean()
                if met < best[0] - 1e-12:
                    best = (met, projections, float(width))
                break  # wider steps only meet more
    return best[1], best[2]


def approximate_knn_join(
    queries: DataFrame, reference: DataFrame, query_id: str, reference_id: str, features: str, k: int = 5, carry: str | None = None,
    exclude_self: bool = False, recall: float = 0.95, tables: int = TABLES, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """(query_id, neighbour_id, distance, rank[, carry]) of nearly all nearest neighbours, and what was measured.

    The report holds ``recall`` (share of the exact neighbours of the sample queries that were found), ``projections``,
    ``width``, ``tables`` and ``compared`` (expected share of all pairs). A query may have fewer than k rows. All
    distances are exact, ties go to the smaller id. Buckets of any size are compared whole, in blocks. Ids are whole
    numbers; rows with a null vector take no part.
    """
    require(queries, query_id, features)
    require(reference, reference_id, features, *([carry] if carry else []))
    spark = queries.sparkSession
    vector = col(features).cast("array<double>")
    q = queries.select(col(query_id).cast("bigint").alias("q"), vector.alias("v")).where("v IS NOT NULL")
    y = col(carry).cast("double") if carry else F.lit(0.0)
    wanted = k + 1 if exclude_self else k
    ref = reference.select(col(reference_id).cast("bigint").alias("r"), vector.alias("v"), y.alias("y")).where("v IS NOT NULL")
    ref = freeze(_first_copies(ref, wanted), "references")
    sample = freeze(q.orderBy(hash_order(["q"], seed), "q").limit(PILOT), "sample")
    dims = ref.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    fitting = max(1, CELL_BYTES // (8 * max(1, dims)))  # rows of a block
    block_rows, chunk_rows = min(BLOCK_ROWS, fitting), min(CHUNK_ROWS, fitting)
    exact = _best(block_join(sample, ref, wanted), wanted)
    truth = exact.where(F.col("q") != F.col("r")).collect() if exclude_self else exact.collect()  # PILOT times k rows
    near = np.array([r["distance"] for r in truth]) if truth else np.ones(1)
    points = [np.array(r["v"], dtype=float) for r in ref.orderBy(hash_order(["r"], seed), "r").limit(SPREAD).collect()]
    if not points:
        empty = spark.createDataFrame([], f"query_id long, neighbour_id long, distance double, rank long{f', {carry} double' if carry else ''}")
        return empty, {"recall": 1.0, "projections": 0, "width": 0.0, "tables": tables, "compared": 0.0}
    far = np.array([np.linalg.norm(a - b) for i, a in enumerate(points) for b in points[:i]] or [1.0])
    projections, width = tuned(near, far, tables, recall)
    random = np.random.default_rng(seed)
    directions = random.normal(size=(len(points[0]), tables * projections))
    offsets = random.uniform(0, width, tables * projections)
    mixers = random.integers(1, 1 << 62, projections, dtype=np.int64) * 2 + 1

    def hashed(rows: DataFrame, names: list[str]) -> DataFrame:
        """Every row once for each table, with its bucket."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, len(directions)))
                steps = np.floor((x @ directions + offsets) / width).astype(np.int64).reshape(n, tables, projections)
                with np.errstate(over="ignore"):
                    keys = (steps * mixers).sum(axis=2) * tables + np.arange(tables)
                at = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in names], pa.array(keys.ravel())], names=[*names, "bucket"])

        kinds = {"q": "q bigint", "r": "r bigint", "v": "v array<double>", "y": "y double"}
        return rows.select(*names).mapInArrow(run, ", ".join([*[kinds[c] for c in names], "bucket bigint"]))

    left, right = freeze(hashed(q, ["q", "v"]), "hashed-queries"), freeze(hashed(ref, ["r", "v", "y"]), "hashed-references")
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).join(right.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")), "bucket")
    # only buckets that don't fit one block are cut; the others have one block on either side
    cuts = freeze(
        sizes.select("bucket", F.ceil(F.col("n") / block_rows).alias("blocks"), F.ceil(F.col("m") / chunk_rows).alias("chunks")).where("blocks > 1 OR chunks > 1"), "large-buckets"
    )
    one = F.lit(1).cast("long")
    left = lookup_join(left, cuts, ["bucket"], derived=False).select(
        "q", "v", "bucket", F.pmod(F.xxhash64("q"), F.coalesce("blocks", one)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", one) - 1)).alias("chunk"),
    )
    right = lookup_join(right, cuts, ["bucket"], derived=False).select(
        "r", "v", "y", "bucket", F.pmod(F.xxhash64("r"), F.coalesce("chunks", one)).alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", one) - 1)).alias("block"),
    )

    def search(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if lhs.empty or rhs.empty:
            return pd.DataFrame({"q": [], "r": [], "distance": [], "y": []})
        return _block_neighbours(lhs, _arrays(rhs), wanted)

    keys = ["bucket", "block", "chunk"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, RESULT)
    met = met.groupBy("q", "r").agg(F.min("distance").alias("distance"), F.min("y").alias("y"))  # met in several tables
    if exclude_self:
        met = met.where(F.col("q") != F.col("r"))
    order = Window.partitionBy("q").orderBy("distance", "r")
    best = freeze(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "approximate")
    mine = best.join(F.broadcast(sample.select("q")), "q").select("q", "r").collect()  # PILOT times k rows
    order = sorted((r["q"], r["distance"], r["r"]) for r in truth)
    kept: dict[int, list[int]] = {}
    for a, _, b in order:
        if len(kept.setdefault(a, [])) < k:
            kept[a].append(b)
    expected = {(a, b) for a, own in kept.items() for b in own}
    found = len(expected & {(r["q"], r["r"]) for r in mine}) / len(expected) if expected else 1.0
    report = {
        "recall": found, "projections": projections, "width": width, "tables": tables,
        "compared": float((1 - (1 - collision(far, width) ** projections) ** tables).mean()),
    }
    names = [F.col("q").alias("query_id"), F.col("r").alias("neighbour_id"), "distance", F.col("rank").cast("long")]
    return best.select(*names, *([F.col("y").alias(carry)] if carry else [])), report
