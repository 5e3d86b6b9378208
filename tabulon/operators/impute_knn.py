"""Neighbour imputation over several numeric columns.

The distance of two rows is taken over the columns both have and scaled up for the others. Rows that miss the same columns
and lie close to each other are packed together, so that a block of them meets a block of donors in a few matrix operations.
The bounds of a donor block tell how near and how far its rows can be: a block of rows with gaps meets only the donor blocks
that can hold one of its k nearest, the nearest first, and stops where no other can be nearer. The bests of parts are merged.

Two rows meet by the columns that both have. Few columns leave many rows at one distance, so donors are laid out once for each
set of columns by which rows of two patterns meet, and rows equal in these are cut to the k that win ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import col, double, require, require_numeric, unused
from ..session import freeze

#: Rows of a block of donors, and of a block of rows with one pattern of missing columns; the latter search in pieces.
DONOR_ROWS, GAP_ROWS, PIECE_ROWS = 2048, 4096, 64
#: Donor blocks that a block of rows meets in one task.
PART_BLOCKS = 512
#: Patterns of missing columns, and copies of a donor for sets of shared columns on average, up to which donors are laid out by these sets.
PATTERNS, COPIES = 64, 32
#: Bits of a place along the curve, and the most that a column has of them.
CURVE_BITS, COLUMN_BITS = 62, 20
SLACK = 1e-9
BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("layer", pa.int32()), ("pattern", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary()), ("values", pa.binary())])
BLOCK_KINDS = "block long, n long, layer int, pattern binary, bounds binary, ids binary, values binary"
PAIRS = pa.schema([("gap", pa.int64()), ("part", pa.int64()), ("block", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("distance", pa.list_(pa.float64())), ("donor", pa.list_(pa.int64())), ("value", pa.list_(pa.float64())), ("cell", pa.list_(pa.int32()))])
FOUND_KINDS = "id long, distance array<double>, donor array<long>, value array<double>, cell array<int>"
LAST_ID = (1 << 63) - 1


def matrix_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of a batch (id, v0, v1, ...); missing values are NaN."""
    values = np.empty((batch.num_rows, width))
    for i in range(width):
        values[:, i] = batch.column(f"v{i}").to_numpy(zero_copy_only=False)
    return batch.column("id").to_numpy(), values


def nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, present: np.ndarray, column: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, distance, donor, value) of the k nearest donors of one missing column, ties to the smaller id.

    Products of matrices rank roughly; whatever lies within rounding error of the k-th is then measured exactly.
    """
    donors = np.flatnonzero(~np.isnan(y[:, column]) & (~np.isnan(y[:, present])).any(axis=1))
    if not len(donors) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
    a, b = x[:, present], y[donors][:, present]
    held = ~np.isnan(b)
    b0 = np.where(held, b, 0.0)
    scale = y.shape[1] / held.sum(axis=1)
    squares = (a * a) @ held.T + (b0 * b0).sum(axis=1)
    rough = np.maximum(squares - 2 * a @ b0.T, 0.0) * scale
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if len(donors) > k else np.full((len(a), 1), np.inf)
    row, at = np.nonzero(rough <= limit + SLACK * (squares * scale).max(axis=1, keepdims=True))
    gaps = np.where(held[at], a[row] - b0[at], 0.0)
    total = np.zeros(len(row))
    for i in range(gaps.shape[1]):  # column by column, so that the order of the sum is fixed
        total += gaps[:, i] * gaps[:, i]
    distance = np.sqrt(total * scale[at])
    who = ids[donors][at]
    order = np.lexsort((who, distance, row))
    row, distance, who, at = row[order], distance[order], who[order], at[order]
    first = np.searchsorted(row, np.arange(len(a)))
    keep = np.arange(len(row)) - first[row] < k
    return own[row[keep]], distance[keep], who[keep], y[donors][at[keep], column]


def gaps_between(own: np.ndarray, other: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) distance of a row within the bounds ``own`` and one within each of ``other``, over the columns ``held``.

    Bounds are (lowest, highest) by column; infinite where no column is shared.
    """
    apart = np.maximum(np.maximum(other[:, 0] - own[1], own[0] - other[:, 1]), 0.0)
    across = np.maximum(np.abs(other[:, 1] - own[0]), np.abs(own[1] - other[:, 0]))
    shared = held.sum(axis=1)
    scale = np.divide(held.shape[1], shared, out=np.full(len(held), np.inf), where=shared > 0)
    with np.errstate(invalid="ignore"):
        least, most = (np.sqrt(np.where(shared > 0, np.where(held, v * v, 0.0).sum(axis=1) * scale, np.inf)) for v in (apart, across))
    return least, most


def within_reach(bounds: np.ndarray, missing: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, without: np.ndarray, k: int) -> np.ndarray:
    """Which donor blocks can hold one of the k nearest donors of a missing column of a row within ``bounds``.

    ``blocks`` are bounds, ``without`` the columns that a block's rows miss.
    """
    held = ~without & ~missing
    least, most = gaps_between(bounds, blocks, held)
    near = np.zeros(len(blocks), bool)
    for column in np.flatnonzero(missing):
        useful = ~without[:, column] & held.any(axis=1)
        order = np.flatnonzero(useful)[np.argsort(most[useful], kind="stable")]
        enough = np.searchsorted(np.cumsum(sizes[order]), k)
        reach = most[order[enough]] if enough < len(order) else np.inf
        near |= useful & (least <= reach * (1 + SLACK) + SLACK)
    return near


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each different row comes first, in that order; the place in it of every row)."""
    by = np.lexsort(x.T)
    starts = np.append(True, (x[by[1:]] != x[by[:-1]]).any(axis=1))
    first, group = by[starts], np.empty(len(x), np.int64)
    group[by] = np.cumsum(starts) - 1
    order = np.argsort(first)
    return first[order], np.argsort(order)[group]


def rows_within(own: np.ndarray, y: np.ndarray, held: np.ndarray, reach: float, k: int) -> np.ndarray:
    """Rows of ``y`` that can be among the k nearest of a row within the bounds ``own``, and no further than ``reach``."""
    least, most = gaps_between(own, np.stack([y, y], axis=1), np.broadcast_to(held, y.shape))
    if len(y) > k:
        reach = min(reach, np.partition(most, k - 1)[k - 1])
    return np.flatnonzero(least <= reach * (1 + SLACK) + SLACK)


def searched(x: np.ndarray, missing: np.ndarray, blocks: list[tuple], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each missing column (distances, donors, values) of the k nearest donors of every row of ``x``, without values where there are fewer.

    The rows miss the same columns; blocks are (pattern, bounds, ids, values).
    """
    present = np.flatnonzero(~missing)
    without, bounds = np.stack([b[0] for b in blocks]), np.stack([b[1] for b in blocks])
    own, held = np.stack([x.min(axis=0), x.max(axis=0)]), ~without & ~missing
    least, _ = gaps_between(own, bounds, held)
    for column in np.flatnonzero(missing):
        best = none = (np.full((len(x), k), np.inf), np.full((len(x), k), LAST_ID), np.full((len(x), k), np.nan))
        for at in np.argsort(least, kind="stable"):
            reach = best[0][:, k - 1].max()
            if least[at] > reach * (1 + SLACK) + SLACK or np.isinf(least[at]):
                break
            if without[at, column]:
                continue
            ids, y = blocks[at][2:]
            close = rows_within(own, y, held[at], reach, k)
            row, *found = nearest(x, np.arange(len(x)), y[close], ids[close], present, int(column), k)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            new = [v.copy() for v in none]
            for part, v in zip(new, found):
                part[row, place] = v
            both = [np.hstack(v) for v in zip(best, new)]
            order = np.lexsort((both[1], both[0]), axis=1)[:, :k]
            best = tuple(np.take_along_axis(v, order, axis=1) for v in both)
        yield best


def found_of(own: np.ndarray, x: np.ndarray, missing: np.ndarray, blocks: list[tuple], k: int) -> pa.RecordBatch:
    """The k nearest donors of all missing cells of a block of rows; equal rows are searched for once."""
    first, copy = distinct(x[:, ~missing])
    pieces = [list(searched(x[first[at : at + PIECE_ROWS]], missing, blocks, k)) for at in range(0, len(first), PIECE_ROWS)]
    distance, donor, value = (np.concatenate([np.stack(v, axis=1) for v in part])[copy] for part in zip(*(zip(*p) for p in pieces)))
    near = ~np.isnan(value)  # by row, missing column and rank
    cell = np.broadcast_to(np.flatnonzero(missing).astype(np.int32)[:, None], near.shape)
    ends = pa.array(np.append(0, np.cumsum(near.sum(axis=(1, 2)))), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(v[near])) for v in (distance, donor, value, cell)]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *lists], schema=FOUND)


def layers_of(counts: dict[str, int]) -> list[tuple[str, str]] | None:
    """(columns of donors, columns of those by which they are compared) wherever rows of two patterns meet for a missing cell.

    ``counts`` is the number of rows by the columns that they have ("1") and miss ("0"). None if donors would be copied too often.
    """
    layers = set()
    for given in counts:
        for asked in counts:
            shared = "".join("1" if a == b == "1" else "0" for a, b in zip(given, asked))
            if "1" in shared and shared != given:  # it has what the other lacks
                layers.add((given, shared))
    copies = sum(counts[given] for given, _ in layers)
    return sorted(layers) if copies <= COPIES * sum(counts.values()) else None


def layered(donors: DataFrame, names: list[str], layers: list[tuple[str, str]], k: int) -> DataFrame:
    """Donors in every layer of their pattern; of those equal in its columns the k with the smallest ids, since no other can be among the k nearest."""
    if not layers:
        return donors.where(F.lit(False)).withColumn("layer", F.lit(0))
    numbers: dict[str, list[str]] = {}
    for i, (given, _) in enumerate(layers):
        numbers.setdefault(given, []).append(str(i))
    cases = " ".join(f"WHEN '{given}' THEN array({', '.join(own)})" for given, own in numbers.items())
    copies = donors.withColumn("layer", F.explode(F.expr(f"CASE {pattern_sql(names)} {cases} END")))
    within = [", ".join(["-1", *(str(at) for at, (_, shared) in enumerate(layers) if shared[i] == "1")]) for i in range(len(names))]
    shown = [F.expr(f"CASE WHEN layer IN ({own}) THEN {n} END") for own, n in zip(within, names)]
    order = F.row_number().over(Window.partitionBy("layer", *shown).orderBy("id"))
    return copies.withColumn("__rank", order).where(F.col("__rank") <= k).select("id", *names, "layer")


def pattern_sql(names: list[str]) -> str:
    return f"concat({', '.join(f'if({n} IS NULL, 0, 1)' for n in names)})"


def scale_of(rows: DataFrame, names: list[str]) -> tuple[int, list[float], list[float]]:
    """(bits of a column on the curve, where each column's steps begin, how wide the values spread); outliers share the outer steps."""
    bits = min(COLUMN_BITS, max(1, CURVE_BITS // len(names)))
    ends = [e or [0.0, 0.0] for e in rows.approxQuantile(names[: CURVE_BITS // bits], [0.01, 0.99], 0.001)]
    return bits, [2 * low - high for low, high in ends], [high - low for low, high in ends]


def placed(rows: DataFrame, names: list[str], scale: tuple[int, list[float], list[float]], shown: np.ndarray | None) -> DataFrame:
    """Rows in the order of their kind, their place along a curve through cubes of equal sides (Morton 1966) and the widest column.

    Kinds are patterns of missing columns, or layers; ``shown`` tells which columns place the rows of each layer.
    """
    bits, lows, spreads = scale
    side = 3 * max(spreads) / (1 << bits) or 1.0
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "kind long", "place long", "fine double"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, layer = matrix_of(batch, len(names))[1], batch.column("layer").to_numpy()
            kind, at, fine = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), np.zeros(len(values))
            if shown is None:
                for i in range(len(names)):
                    kind = kind * 3 + np.isnan(values[:, i])  # a hash where there are many columns: blocks are cut by pattern anyway
            else:
                kind, values = layer.astype(np.int64), np.where(shown[layer], values, np.nan)
            for i, low in enumerate(lows):
                step = np.nan_to_num(np.clip((values[:, i] - low) / side, 0, (1 << bits) - 1)).astype(np.int64)
                for bit in range(bits):
                    at |= ((step >> bit) & 1) << (bit * len(lows) + i)
            for i in np.argsort(spreads, kind="stable"):
                fine = np.where(np.isnan(values[:, i]), fine, values[:, i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind), pa.array(at), pa.array(fine)], names=[*batch.schema.names, "kind", "place", "fine"])

    dealt = rows.mapInArrow(place, kinds).repartitionByRange("kind", "place", "fine", "id")
    return dealt.sortWithinPartitions("kind", "place", "fine", "id").select("id", *names, "layer")


def packed(rows: DataFrame, names: list[str], scale: tuple[int, list[float], list[float]], shown: np.ndarray | None, size: int, label: str) -> DataFrame:
    """Blocks of up to ``size`` neighbouring rows of one layer with one pattern of missing columns, and their bounds."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = TaskContext.get().partitionId() << 32, []
        for batch in [*batches, None]:
            if batch is not None:
                held.append((*matrix_of(batch, len(names)), batch.column("layer").to_numpy()))
            if not held or (batch is not None and sum(len(h[0]) for h in held) < size):
                continue
            ids, values, layer = (np.concatenate(part) for part in zip(*held))
            gaps = np.isnan(values)
            new = (gaps[1:] != gaps[:-1]).any(axis=1) | (layer[1:] != layer[:-1])
            starts = np.append(np.flatnonzero(np.append(True, new)), len(ids)) if len(ids) else np.zeros(1, np.int64)
            cuts = [(at, min(at + size, end)) for begin, end in zip(starts[:-1], starts[1:]) for at in range(begin, end, size)]
            rest = cuts.pop() if cuts and batch is not None else (len(ids), len(ids))  # may go on in the next batch
            for a, b in cuts:
                bounds = np.stack([values[a:b].min(axis=0), values[a:b].max(axis=0)])
                cells = {"pattern": gaps[a], "bounds": bounds, "ids": ids[a:b], "values": values[a:b]}
                yield pa.RecordBatch.from_pylist([{"block": seen, "n": b - a, "layer": layer[a], **{c: v.tobytes() for c, v in cells.items()}}], schema=BLOCKS)
                seen += 1
            held = [tuple(v[slice(*rest)] for v in (ids, values, layer))] if rest[1] > rest[0] else []

    return freeze(placed(rows, names, scale, shown).mapInArrow(pack, BLOCK_KINDS), label)


def impute_neighbours(df: DataFrame, columns: Sequence[str], k: int = 5, key: str | None = None) -> DataFrame:
    """``df`` with the missing cells of ``columns`` filled by the mean of the k nearest rows that have the column.

    Distances are Euclidean over the columns both rows have, times the root of (all columns / those). A whole-number
    ``key`` identifies rows and breaks ties; without one, rows are numbered as they are read. With fewer than k donors all
    of them count; a cell whose row shares no column with any donor gets the column's mean, and a column without any value
    stays empty. Filled columns become doubles. NaN counts as missing.
    """
    columns = list(columns)
    require_numeric(df, *columns)
    number = unused(df.columns, "__row")
    if key is None:
        df = freeze(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    else:
        require(df, key)
        df = df.withColumn(number, col(key).cast("bigint"))
    width, names = len(columns), [f"v{i}" for i in range(len(columns))]
    rows = df.select(col(number).alias("id"), *[double(df, c).alias(n) for c, n in zip(columns, names)])
    means = rows.agg(*[F.avg(n) for n in names]).first()
    some_missing = F.expr(" OR ".join(f"{n} IS NULL" for n in names))
    some_present = F.expr(" OR ".join(f"{n} IS NOT NULL" for n in names))

    scale = scale_of(rows, names)
    patterns = rows.groupBy(F.expr(pattern_sql(names)).alias("had")).count().limit(PATTERNS + 1).collect()
    layers = layers_of({r["had"]: r["count"] for r in patterns}) if len(patterns) <= PATTERNS else None
    shown = None if layers is None else np.array([[c == "1" for c in shared] for _, shared in layers]).reshape(-1, width)
    given = rows.where(some_present).withColumn("id", F.coalesce("id", F.lit(LAST_ID)))
    given = given.withColumn("layer", F.lit(0)) if layers is None else layered(given, names, layers, k)
    donors = packed(given, names, scale, shown, DONOR_ROWS, "donors")
    gaps = packed(rows.where(some_missing & some_present & F.col("id").isNotNull()).withColumn("layer", F.lit(0)), names, scale, None, GAP_ROWS, "gaps")
    about = donors.select("block", "n", "layer", "pattern", "bounds").orderBy("block").toPandas()  # a row for each block
    numbers, sizes = about["block"].to_numpy(), about["n"].to_numpy()
    without = np.array([np.frombuffer(p, bool) for p in about["pattern"]]).reshape(-1, width)
    compared = None if shown is None else shown[about["layer"].to_numpy()]
    layout = df.sparkSession.sparkContext.broadcast((numbers, sizes, without, np.array([np.frombuffer(b) for b in about["bounds"]]).reshape(-1, 2, width), compared))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *about, compared = layout.value
        for batch in batches:
            for row in batch.to_pylist():
                own, missing = np.frombuffer(row["bounds"]).reshape(2, width), np.frombuffer(row["pattern"], bool)
                numbers, sizes, without, bounds = about if compared is None else (v[(compared == (~about[2] & ~missing)).all(axis=1)] for v in about)
                near = numbers[within_reach(own, missing, bounds, sizes, without, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), row["block"])), pa.array(np.arange(len(near)) // PART_BLOCKS), pa.array(near)], schema=PAIRS)

    pairs = freeze(gaps.select("block", "pattern", "bounds").mapInArrow(reach, "gap long, part long, block long"), "pairs")

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        blocks = [
            (np.frombuffer(r["pattern"], bool), np.frombuffer(r["bounds"]).reshape(2, width), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"]).reshape(-1, width))
            for r in given.sort_by("block").to_pylist()
        ]
        out = []
        for row in asked.to_pylist() if blocks else ():
            own, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["values"]).reshape(-1, width)
            out.append(found_of(own, x, np.frombuffer(row["pattern"], bool), blocks, k))
        return pa.Table.from_batches(out, FOUND)

    parts = pairs.select(F.col("gap").alias("own_gap"), F.col("part").alias("own_part")).distinct()
    asked = gaps.select(F.col("block").alias("own_gap"), "pattern", "ids", "values").join(parts, "own_gap")
    given = donors.drop("n", "layer").join(pairs, "block")
    met = asked.groupBy("own_gap", "own_part").cogroup(given.groupBy("gap", "part")).applyInArrow(meet, FOUND_KINDS)
    near = met.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("distance", "donor", "value", "cell"))).alias("near"))
    first = [F.expr(f"slice(array_sort(filter(near, x -> x.cell = {i})), 1, {k})").alias(f"{i}") for i in range(width)]
    mean = [F.expr(f"aggregate(`{i}`, 0D, (a, x) -> a + x.value) / nullif(size(`{i}`), 0)").alias(f"{i}") for i in range(width)]
    best = near.select("id", *first).select("id", *mean)
    filled = df.join(best.withColumnRenamed("id", "__id"), col(number) == F.col("__id"), "left")
    values = {
        c: F.coalesce(double(df, c), F.col(f"`{i}`"), F.lit(None if means[i] is None or math.isnan(means[i]) else means[i]).cast("double"))
        for i, c in enumerate(columns)
    }
    return filled.select(*[values[c].alias(c) if c in values else col(c) for c in df.columns if c != number])
