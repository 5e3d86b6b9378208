"""Hard negatives from candidate blocks in Hilbert order, chosen by zone maps.

Vectors are written as Parquet blocks along a Hilbert curve through their dimensions of largest spread, and every block
has a zone map: the least and the largest value of each dimension, and its labels. Interval arithmetic over a zone map
bounds the inner products of an anchor with all rows of the block from both sides, so that an anchor reads only the blocks
that can hold something of its windows. Both searches (positives, then negatives) first read the few blocks with the best
bounds; the scores found there raise the thresholds by which all other blocks are chosen.

Anchors travel to the blocks, which stay where they are for a search; a block is never copied for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .hilbert import hilbert_index
from .tables import freeze
from .topk import scores

#: Rows of a candidate block, anchors that travel together, blocks whose zone maps lie together.
BLOCK_ROWS, ANCHOR_ROWS, PAGE_BLOCKS = 512, 256, 64
#: Dimensions of the curve, and blocks that each search reads first.
CURVE_DIMS, PROBE = 8, 3
#: Whole numbers beyond this are held there, and so are scores.
MOST = 1 << 61
BLOCKS = "page int, block long, dim int, ids binary, labels binary, matrix binary, low binary, high binary, kinds binary"
REQUESTS = "block long, dim int, ids binary, labels binary, matrix binary, floors binary, tops binary"
ROWS = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("curve", pa.int64())])

BLOCK = pa.schema([("page", pa.int32()), ("block", pa.int64()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "matrix", "low", "high", "kinds"))])
REQUEST = pa.schema([("block", pa.int64()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "matrix", "floors", "tops"))])


def one_row(schema: pa.Schema, cells: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)


def whole_vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix of floor(scale * x)) of the usable rows, one for each vector length."""
    vectors = batch.column("vector")
    ok = np.asarray(vectors.is_valid()) & np.asarray(batch.column("id").is_valid()) & np.asarray(batch.column("label").is_valid())
    sizes = np.array([len(v) if v is not None else -1 for v in vectors.to_pylist()]) if pa.types.is_null(vectors.type) else np.asarray(
        vectors.value_lengths().fill_null(-1)
    )
    flat = vectors.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan), np.float64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    ids = np.asarray(batch.column("id").fill_null(0)).astype(np.int64)
    labels = np.asarray(batch.column("label").fill_null(0)).astype(np.int64)
    for dim in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == dim))
        matrix = values[starts[rows][:, None] + np.arange(dim)]
        good = np.isfinite(matrix).all(axis=1)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(scale * matrix[good]), -float(MOST), float(MOST)).astype(np.int64)
        yield ids[rows[good]], labels[rows[good]], whole


def spread(rows: DataFrame, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: the dimensions of largest variance, their means and their deviations."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, _, whole in whole_vectors(batch, scale):
                x = whole.astype(np.float64)
                part = np.stack([np.full(x.shape[1], float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
                held[x.shape[1]] = held.get(x.shape[1], 0) + part
        for dim, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), *map(pa.array, part)], names=["dim", "at", "n", "s", "ss"])

    found: dict[int, list] = {}
    totals = rows.mapInArrow(sums, "dim int, at int, n double, s double, ss double").groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])
    variance = F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n")), F.lit(0.0))
    order = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("variance"), "at"))
    best = totals.select("dim", "at", (F.col("s") / F.col("n")).alias("mean"), variance.alias("variance")).withColumn("o", order)
    for r in best.where(F.col("o") <= CURVE_DIMS).orderBy("dim", "o").collect():  # at most CURVE_DIMS rows for each vector length
        found.setdefault(r.dim, []).append((r.at, r["mean"], math.sqrt(r.variance)))
    return {dim: tuple(map(np.array, zip(*rows))) for dim, rows in found.items()}


def placed(rows: DataFrame, scale: float, layout: dict) -> DataFrame:
    """(id, label, dim, vector, curve) of the usable rows: whole vectors as bytes, and their places on the curve."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, whole in whole_vectors(batch, scale):
                dim = whole.shape[1]
                curve = np.zeros(len(ids), np.int64)
                if dim:
                    at, mean, deviation = layout[dim]
                    bits = min(8, 62 // len(at))
                    cells = (whole[:, at] - mean) / np.maximum(deviation, 1e-9) * (1 << (bits - 2)) / 1.5 + (1 << (bits - 1))
                    curve = hilbert_index(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits)
                size = dim * 8
                data = whole.astype("<i8").tobytes()
                cut = [data[i * size : (i + 1) * size] for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids), pa.array(labels), pa.array(np.full(len(ids), dim, np.int32)), pa.array(cut, pa.binary()), pa.array(curve),
                ], schema=ROWS)

    return rows.mapInArrow(place, "id long, label long, dim int, vector binary, curve long")


def narrow(matrix: np.ndarray) -> bytes:
    """A matrix of whole numbers in the fewest bytes that hold it; the size tells the kind."""
    most = int(max(matrix.max(initial=0), -matrix.min(initial=0)))
    return matrix.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def widened(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {0: "<i8", 2: "<i2", 4: "<i4", 8: "<i8"}[len(data) // (n * dim) if n * dim else 0]
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, dim)


def blocks_of(rows: DataFrame, n: int) -> DataFrame:
    """Parquet blocks in the order of the curve; equal places are dealt by id, repeated rows are written once."""
    cores = int(rows.sparkSession.sparkContext.defaultParallelism)
    pages = max(math.ceil(n / (BLOCK_ROWS * PAGE_BLOCKS)), min(cores, math.ceil(n / BLOCK_ROWS)), 1)
    order = ["dim", "curve", "id", "label", "vector"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId()
        seen, last, held = 0, None, []

        def out() -> pa.RecordBatch:
            dim = held[0][2]
            matrix = np.frombuffer(b"".join(h[3] for h in held), "<i8").reshape(len(held), dim)
            ids, labels = (np.array([h[i] for h in held], "<i8") for i in (0, 1))
            data = [ids.tobytes(), labels.tobytes(), narrow(matrix), matrix.min(axis=0).tobytes(), matrix.max(axis=0).tobytes(), np.unique(labels).tobytes()]
            return one_row(BLOCK, [page, page << 32 | seen, dim, *data])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "dim", "vector"))):
                if row == last:
                    continue
                if held and (len(held) == BLOCK_ROWS or held[0][2] != row[2]):
                    yield out()
                    seen, held = seen + 1, []
                held.append(row)
                last = row
        if held:
            yield out()

    return freeze(rows.repartitionByRange(pages, *order).sortWithinPartitions(*order).mapInArrow(pack, BLOCKS), "negative-blocks")


class Page:
    """Zone maps of the blocks of one page that have one vector length."""

    def __init__(self, zones: list[dict], dim: int):
        self.blocks, self.dim = np.array([z["block"] for z in zones], np.int64), dim
        n = len(zones)
        self.low, self.high = (np.frombuffer(b"".join(z[c] for z in zones), "<i8").reshape(n, dim).astype(np.float64) for c in ("low", "high"))
        labels = [np.frombuffer(z["kinds"], "<i8") for z in zones]
        self.owner, self.labels = np.repeat(np.arange(n), [len(x) for x in labels]), np.concatenate(labels)
        self.many = np.array([len(x) > 1 for x in labels])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product that each anchor may have inside each block."""
        up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
        low, high = up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T
        reach = up @ np.maximum(np.abs(self.low), np.abs(self.high)).T - down @ np.maximum(np.abs(self.low), np.abs(self.high)).T
        slack = np.where(reach < float(1 << 52), 0.0, reach * 1e-9)  # below 2**52 every sum is exact
        return low - slack, high + slack

    def has(self, labels: np.ndarray) -> np.ndarray:
        """Whether each block holds a row of each label."""
        distinct, back = np.unique(labels, return_inverse=True)
        at = np.minimum(np.searchsorted(distinct, self.labels), len(distinct) - 1)
        table = np.zeros((len(distinct), len(self.blocks)), bool)
        same = distinct[at] == self.labels
        table[at[same], self.owner[same]] = True
        return table[back]


def anchor_rows(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix, floors, tops) of a group of anchors; windows that aren't used have a floor above their top."""
    n, dim = len(row["ids"]), row["dim"]
    matrix = np.frombuffer(b"".join(row["vectors"]), "<i8").reshape(n, dim)
    wide = max(map(len, row["floors"]), default=0)
    floors, tops = np.full((n, wide), 1, np.int64), np.zeros((n, wide), np.int64)
    for i, (f, t) in enumerate(zip(row["floors"], row["tops"])):
        floors[i, : len(f)], tops[i, : len(t)] = f, t
    return np.array(row["ids"], np.int64), np.array(row["labels"], np.int64), matrix, floors, tops


def request(block: int, dim: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, floors: np.ndarray, tops: np.ndarray) -> pa.RecordBatch:
    return one_row(REQUEST, [int(block), dim, ids.tobytes(), labels.tobytes(), narrow(matrix), floors.tobytes(), tops.tobytes()])


def wanted_blocks(page: Page, labels: np.ndarray, matrix: np.ndarray, floors: np.ndarray, tops: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(which anchors need which blocks, upper bounds) by the zone maps alone."""
    low, high = page.bounds(matrix)
    held = page.has(labels)
    fits = held if same else (~held | page.many[None, :])
    inside = np.zeros_like(fits)
    for j in range(floors.shape[1]):
        inside |= (high >= floors[:, j : j + 1]) & (low <= tops[:, j : j + 1]) & (floors[:, j] <= tops[:, j])[:, None]
    return fits & inside, high


def chosen(anchors: DataFrame, pages: DataFrame, same: bool, probed: DataFrame | None) -> DataFrame:
    """Requests (anchors for a block) for every block that a window may reach, but for those probed already."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row["zones"], row["dim"])
                ids, labels, matrix, floors, tops = anchor_rows(row)
                need, _ = wanted_blocks(page, labels, matrix, floors, tops, same)
                done = {(a, b) for a, bs in zip(row["ids"], row["probed"]) for b in bs}
                for at in np.flatnonzero(need.any(axis=0)):
                    who = np.array([i for i in np.flatnonzero(need[:, at]) if (row["ids"][i], int(page.blocks[at])) not in done], np.int64)
                    if len(who):
                        yield request(page.blocks[at], page.dim, ids[who], labels[who], matrix[who], floors[who], tops[who])

    return meetings(anchors, pages, probed).mapInArrow(choose, REQUESTS)


def best_blocks(anchors: DataFrame, pages: DataFrame, same: bool) -> DataFrame:
    """(id, block): the PROBE blocks of largest upper bound that a window of the anchor may reach."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row["zones"], row["dim"])
                ids, labels, matrix, floors, tops = anchor_rows(row)
                need, high = wanted_blocks(page, labels, matrix, floors, tops, same)
                order = np.argsort(np.where(need, -high, np.inf), axis=1, kind="stable")[:, :PROBE]
                at = np.repeat(np.arange(len(ids)), order.shape[1])
                keep = need[at, order.ravel()]
                at, which = at[keep], order.ravel()[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(page.blocks[which]), pa.array(high[at, which])], names=["id", "block", "bound"])

    found = meetings(anchors, pages, None).mapInArrow(choose, "id long, block long, bound double")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("bound"), "block"))
    return found.withColumn("o", order).where(F.col("o") <= PROBE).select("id", "block")


def meetings(anchors: DataFrame, pages: DataFrame, probed: DataFrame | None) -> DataFrame:
    """Every group of anchors with every page of zone maps of its vector length; only the anchors are copied."""
    if probed is None:
        anchors = anchors.withColumn("probed", F.array().cast("array<long>"))
    else:
        anchors = anchors.join(probed.groupBy("id").agg(F.collect_list("block").alias("probed")), "id", "left")  # PROBE blocks each
        anchors = anchors.withColumn("probed", F.coalesce("probed", F.array().cast("array<long>")))
    rows = F.collect_list(F.struct("id", "label", "vector", "floors", "tops", "probed"))  # ANCHOR_ROWS at most
    groups = anchors.groupBy("dim", "anchor_group").agg(rows.alias("r")).select(
        "dim", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.col("r.vector").alias("vectors"),
        F.col("r.floors").alias("floors"), F.col("r.tops").alias("tops"), F.col("r.probed").alias("probed"),
    )
    numbers = pages.groupBy("dim").agg(F.collect_list("page").alias("all_pages"))
    sent = groups.join(numbers, "dim").select("*", F.explode("all_pages").alias("page")).drop("all_pages")
    return sent.join(pages.select("page", "dim", "zones"), ["page", "dim"])


def probes(anchors: DataFrame, probed: DataFrame) -> DataFrame:
    """Requests for the blocks that are read first: one for each block and group of anchors."""
    rows = F.collect_list(F.struct("id", "label", "vector", "floors", "tops"))
    grouped = anchors.join(probed, "id").groupBy("block", "dim", "anchor_group").agg(rows.alias("r")).select(
        "block", "dim", F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.col("r.vector").alias("vectors"),
        F.col("r.floors").alias("floors"), F.col("r.tops").alias("tops"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield request(row["block"], row["dim"], *anchor_rows(row))

    return grouped.mapInArrow(pack, REQUESTS)


def found_scores(requests: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, other, score): of each block, the k best scores of each window of each anchor, ties to the smaller id."""
    asked = requests.select("block", "dim", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "matrix", "floors", "tops")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a_ids, a_labels = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["a_labels"], "<i8")
                ids, labels, dim = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), row["dim"]
                a, b = widened(row["a_matrix"], len(a_ids), dim), widened(row["matrix"], len(ids), dim)
                order = np.argsort(ids, kind="stable")
                ids, labels, b = ids[order], labels[order], b[order]
                s = scores(a, b, max(dim, 1), float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)))
                fits = (a_labels[:, None] == labels[None, :]) == same
                fits &= a_ids[:, None] != ids[None, :]
                floors, tops = (np.frombuffer(row[c], "<i8").reshape(len(a_ids), -1) for c in ("a_floors", "a_tops"))
                taken = np.zeros_like(fits)
                for j in range(floors.shape[1]):
                    window = fits & (s >= floors[:, j : j + 1]) & (s <= tops[:, j : j + 1])
                    taken |= best_of(s, window, k)
                at, which = np.nonzero(taken)
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[at]), pa.array(ids[which]), pa.array(s[at, which])], names=["id", "other", "score"])

    return asked.join(blocks.select("block", "ids", "labels", "matrix"), "block").mapInArrow(score, "id long, other long, score long")


def best_of(s: np.ndarray, window: np.ndarray, k: int) -> np.ndarray:
    """The k largest scores of each row inside the window; of equal ones those further left."""
    if not window.any():
        return window
    least = np.iinfo(np.int64).min
    held = np.where(window, s, least)
    if held.shape[1] > k:
        cut = np.partition(held, held.shape[1] - k, axis=1)[:, -k][:, None]
        above = window & (held > cut)
        tied = window & (held == cut)
        return above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1)[:, None]))
    return window


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that satisfy ``anchor``.

    Components become floor(scale * x); a score is the whole inner product with the anchor, the higher the better, ties to
    the smaller id. An anchor's positives are its best other rows of the same label. A negative has another label and
    ``low * positive_score <= 100 * negative_score <= high * positive_score``; for each anchor and positive the best are
    returned, so a positive without any gives no row. Ids and labels are whole numbers.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors meet vectors of
    their own length only, and empty ones score 0 among themselves. Repeated rows count once. Different rows of one id are
    each a candidate, never for their own id; as an anchor the smallest of them (by label, then bytes) counts. Numbers
    beyond 2**61 are held there. Other columns are ignored, an empty table gives no rows. Nothing is capped: a block is
    left out only if its bounds prove that no window reaches it.
    """
    spark = rows.sparkSession
    plain = rows.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    layout = spread(plain.select("id", "label", "vector"), scale)
    candidates = freeze(placed(plain.select("id", "label", "vector"), scale, layout), "negative-rows")
    blocks = blocks_of(candidates, candidates.count())
    zones = F.collect_list(F.struct("block", "low", "high", "kinds")).alias("zones")  # PAGE_BLOCKS or a few more
    pages = freeze(blocks.groupBy("page", "dim").agg(zones), "negative-zones")

    keep = F.min(F.struct("label", "vector", "dim", "curve")).alias("r")
    own = placed(plain.where("anchor").select("id", "label", "vector"), scale, layout).groupBy("id").agg(keep).select("id", "r.*")
    own = freeze(own, "negative-anchors")
    groups = max(1, math.ceil(own.count() / ANCHOR_ROWS))
    # neighbours on the curve travel together; ties and copies are dealt by id
    near = own.repartitionByRange(groups, "dim", "curve", "id").withColumn("anchor_group", F.spark_partition_id())
    near = freeze(near.drop("curve"), "negative-anchors")

    def search(anchors: DataFrame, k: int, same: bool, raised: Callable[[DataFrame], DataFrame]) -> DataFrame:
        probed = freeze(best_blocks(anchors, pages, same), "negative-probed")
        first = freeze(found_scores(probes(anchors, probed), blocks, k, same), "negative-first")
        higher = freeze(raised(first), "negative-windows")
        rest = found_scores(chosen(higher, pages, same, probed), blocks, k, same)
        return first.unionByName(rest)

    def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))
        return found.withColumn("rank", order).where(F.col("rank") <= k)

    everything = near.withColumns({"floors": F.array(F.lit(-MOST)), "tops": F.array(F.lit(MOST))})

    def above_kth(first: DataFrame) -> DataFrame:
        kth = ranked(first.distinct(), ["id"], positives).groupBy("id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
        floor = F.when(F.col("n") == positives, F.col("s")).otherwise(F.lit(-MOST))
        return near.join(kth, "id", "left").select(*near.columns, F.array(floor).alias("floors"), F.array(F.lit(MOST)).alias("tops"))

    friends = freeze(ranked(search(everything, positives, True, above_kth).distinct(), ["id"], positives), "negative-positives")
    floor = -F.floor(-(F.col("score").cast("decimal(20,0)") * low) / F.lit(100).cast("decimal(3,0)")).cast("long")
    top = F.floor(F.col("score").cast("decimal(20,0)") * high / F.lit(100).cast("decimal(3,0)")).cast("long")
    windows = freeze(
        friends.select("id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), floor.alias("floor"), top.alias("top")), "negative-friends"
    )

    def with_windows(limits: DataFrame) -> DataFrame:
        lists = limits.groupBy("id").agg(F.collect_list(F.struct("floor", "top")).alias("w"))  # as many as positives
        return near.join(lists, "id").select(*near.columns, F.col("w.floor").alias("floors"), F.col("w.top").alias("tops"))

    def inside(found: DataFrame) -> DataFrame:
        met = found.distinct().join(windows, "id").where("score between floor and top")
        return ranked(met, ["id", "positive_id"], negatives)

    def above_found(first: DataFrame) -> DataFrame:
        kth = inside(first).groupBy("id", "positive_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
        raised = F.when(F.col("n") == negatives, F.col("s")).otherwise(F.col("floor"))
        return with_windows(windows.join(kth, ["id", "positive_id"], "left").select("id", raised.alias("floor"), "top"))

    others = search(with_windows(windows), negatives, False, above_found)
    return inside(others).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
