"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks, and every block of queries meets every block of candidates. Each round scores all pairs
and counts, per query, the scores that fall into the bins of the query's current interval. The bin that holds the k-th
largest score becomes the next interval, until the k-th score is known. A last pass keeps what lies above it and breaks
ties by id. A block reports bins from the top only until its own count reaches what is still wanted: lower bins cannot
hold the k-th score, so a round shuffles at most k bins per query and block, whatever the number of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import freeze

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192
BIN_BITS = 10
MOST = 1 << 61


def whole_components(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id, values): floor(scale * x) of every component; rows with an unusable vector or no id are left out."""
    good = F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & F.forall(
        vector_column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    def whole(x: Column) -> Column:
        wide = F.lit(float(scale)) * x.cast("double")  # from 2**53 on every double is whole
        return F.when(F.abs(wide) < float(1 << 53), F.floor(wide).cast("double")).otherwise(wide)

    values = F.transform(vector_column, whole)
    return (
        vectors.where(good)
        .select(F.col(id_column).cast("long").alias("id"), values.alias("values"))
        .dropDuplicates(["id", "values"])
    )


def packed(rows: DataFrame, side: str, blocks: int) -> DataFrame:
    """One row per block and vector length: ids and matrix as bytes, largest absolute component."""
    name = f"{side}_block"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        matrix = np.array(frame["values"].tolist(), dtype=np.float64).reshape(len(frame), -1)
        most = float(np.abs(matrix).max(initial=0))
        kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
        return pd.DataFrame({
            name: frame[name].iloc[:1], "dim": np.int32(matrix.shape[1]), f"{side}_kind": kind, f"{side}_most": most,
            f"{side}_ids": frame["id"].to_numpy(np.int64).tobytes(), f"{side}_matrix": matrix.astype(kind).tobytes(),
        })

    dealt = rows.withColumns({name: F.pmod(F.xxhash64(F.lit(side), "id"), F.lit(blocks)).cast("int"), "dim": F.size("values")})
    return freeze(
        dealt.groupBy(name, "dim").applyInPandas(
            pack, f"{name} int, dim int, {side}_kind string, {side}_most double, {side}_ids binary, {side}_matrix binary"
        ),
        f"topk-{side}",
    )


def scores(q: np.ndarray, c: np.ndarray, dim: int, most: float) -> np.ndarray:
    """Integer inner products; exact at any size, held within +-2**61."""
    if most * dim < 1 << 53:
        return np.rint(q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    wide = np.array([[int(x) for x in row] for row in c], dtype=object).reshape(len(c), dim).T
    each = np.array([[int(x) for x in row] for row in q], dtype=object).reshape(len(q), dim) @ wide
    return np.clip(each, -MOST, MOST).astype(np.int64)  # whole numbers of Python until here


def pair_scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the table of scores of one pair of blocks."""
    dim = int(row.dim)
    sides = []
    for side in "qc":
        ids = np.frombuffer(getattr(row, f"{side}_ids"), np.int64)
        sides.append((ids, np.frombuffer(getattr(row, f"{side}_matrix"), getattr(row, f"{side}_kind")).reshape(len(ids), dim)))
    (q_ids, q), (c_ids, c) = sides
    return q_ids, c_ids, scores(q, c, dim, float(row.q_most) * float(row.c_most))


def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(query_id, bin, n) of the scores inside each query's interval, from the top until the wanted count is met."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            q_ids, c_ids, s = pair_scores(row)
            low, need = np.asarray(row.lows, np.int64), np.asarray(row.needs, np.int64)
            bins = (s - low[:, None]) >> int(row.shift)
            used = (bins >= 0) & (bins < row.bins) & (q_ids[:, None] != c_ids[None, :])
            flat = (np.arange(len(q_ids))[:, None] * row.bins + bins)[used]
            counts = np.bincount(flat, minlength=len(q_ids) * row.bins).reshape(len(q_ids), -1)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            at, which = np.nonzero((counts > 0) & (above < need[:, None]))
            yield pd.DataFrame({"query_id": q_ids[at], "bin": which.astype(np.int32), "n": counts[at, which]})


def selected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores above each query's k-th score, and of those equal to it the wanted number with the smallest ids."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            q_ids, c_ids, s = pair_scores(row)
            order = np.argsort(c_ids, kind="stable")
            c_ids, s = c_ids[order], s[:, order]
            low, need = np.asarray(row.lows, np.int64)[:, None], np.asarray(row.needs, np.int64)[:, None]
            other = q_ids[:, None] != c_ids[None, :]
            tied = (s == low) & other
            at, which = np.nonzero(((s > low) & other) | (tied & (np.cumsum(tied, axis=1) <= need)))
            yield pd.DataFrame({"query_id": q_ids[at], "vec_id": c_ids[which], "score": s[at, which]})


def exact_topk(
    queries: DataFrame, candidates: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding",
    scale: float = 256.0,
) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Ties go to the smaller id; a query never meets its own id; a query with fewer
    than k candidates returns all of them. Rows with a null id, a null vector, or a null or non-finite component take no
    part; repeated rows count once; vectors meet vectors of their own length only, so empty vectors score 0 among
    themselves; products beyond 2**61 are held there; of several vectors of one query id the smallest is the query. Empty tables give no rows; other columns are ignored.
    """
    spark = candidates.sparkSession
    q_rows = whole_components(queries, id_column, vector_column, scale).groupBy("id").agg(F.min("values").alias("values"))
    c_rows = whole_components(candidates, id_column, vector_column, scale)
    q_count, c_count = q_rows.count(), c_rows.count()
    nq, nc = max(1, math.ceil(q_count / QUERY_BLOCK)), max(1, math.ceil(c_count / CANDIDATE_BLOCK))
    # few candidates still use all cores: smaller blocks, same result
    nc = max(nc, min(int(spark.sparkContext.defaultParallelism), math.ceil(c_count / 512) or 1))
    q_blocks, c_blocks = packed(q_rows, "q", nq), packed(c_rows, "c", nc)
    most = c_blocks.agg(F.max("c_most"), F.max("dim")).first(), q_blocks.agg(F.max("q_most")).first()
    reach = int(min(float(MOST), (most[0][0] or 0) * (most[1][0] or 0) * (most[0][1] or 0))) + 1
    bits = (2 * reach).bit_length()
    grid_c = c_blocks.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    grid_q = q_blocks.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    block = F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(nq)).cast("int")
    state = q_rows.select(
        F.col("id").alias("query_id"), block.alias("q_block"), F.size("values").alias("dim"),
        F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("need"),
    )

    def pairs(shift: int, bins: int) -> DataFrame:
        """Every pair of blocks with the state of its queries, which is in the order of the block's ids."""
        rows = F.sort_array(F.collect_list(F.struct("query_id", "low", "need")))
        laid = state.groupBy("q_block", "dim").agg(rows.alias("rows")).select(
            "q_block", "dim", F.col("rows.low").alias("lows"), F.col("rows.need").alias("needs")
        )
        return (
            grid_q.join(laid, ["q_block", "dim"]).join(grid_c, ["q_block", "c_block", "dim"])
            .withColumns({"shift": F.lit(shift), "bins": F.lit(bins)})
            .repartition(nq * nc, "q_block", "c_block", "dim")
        )

    shift = bits
    while shift > 0:
        fine = max(0, shift - BIN_BITS)
        counts = pairs(fine, 1 << (shift - fine)).mapInPandas(histograms, "query_id long, bin int, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        here = (
            counts.withColumn("upto", above).join(state.select("query_id", "need"), "query_id")
            .where("upto >= need and upto - n < need")
            .select("query_id", F.col("bin").cast("long").alias("at"), (F.col("upto") - F.col("n")).alias("before"))
        )
        # a query with too few candidates never meets its need and keeps the lowest bin
        low = F.col("low") + F.coalesce("at", F.lit(0).cast("long")) * F.lit(1 << fine).cast("long")
        need = F.col("need") - F.coalesce("before", F.lit(0).cast("long"))
        state = freeze(
            state.join(here, "query_id", "left")
            .select("query_id", "q_block", "dim", low.alias("low"), need.alias("need")),
            "topk-state",
        )
        shift = fine
    best = pairs(0, 1).mapInPandas(selected, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
