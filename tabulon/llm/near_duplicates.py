"""Near-duplicate documents by HyperMinHash, and by a shingle prefix filter where sets are small.

1. Each text becomes a sketch: its shingles fall into buckets, and a bucket keeps the leading-zero count and a few mantissa
   bits of its smallest hash. Texts with equal shingle sets are one class, represented by its smallest id.
2. Sets of SHORT shingles or more give bands of registers. Smaller ones, and those that are near enough in size to link to
   them, give their rarest shingles as bands: two sets that link share one of these for certain.
3. Members of a band are paired with the smallest representative in it. Pairs that pass the length bound and, for large
   sets, the collision-corrected estimate are confirmed on full shingle sets.
4. In each band that still holds several parts, the members outside the largest part meet the others, block by block,
   and links that connect something are kept. A pair of large sets is compared in the first band that it shares.
5. Confirmed links give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import freeze, steps
from .words import U, mix, shingle_codes, words_of

REGISTERS = 256
MANTISSA = 10
#: Share of links at the threshold that may differ in all bands if registers are independent.
MISSED = 1e-8
#: Shingles from which a sketch fills so many buckets that its bands are nearly independent; smaller sets link exactly.
SHORT = 200
#: Band number of a shingle, and counters by which shingles are ordered from rare to common.
SHINGLE, COUNTER_BITS = -1, 17
#: 64-bit words of the bitmap by which pairs of small sets are ruled out.
BITMAP = 16
#: Spread of the estimate that a candidate may fall short by, in standard deviations.
SLACK = 4.5
#: Shingles (8 bytes each) and members of one block.
BLOCK_SHINGLES, BLOCK_MEMBERS = 500_000, 512
#: Nodes up to which the list of candidates is broadcast (8 bytes each) instead of shuffled against the texts.
BROADCAST_NODES = 500_000
SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"


def places(percent: int) -> np.ndarray:
    """Registers of each band, far apart: neighbours of a sparse sketch were filled from the same bucket.

    Bands have as many registers as the threshold allows.
    """
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISSED]
    rows = max(fits, default=1)
    bands = REGISTERS // rows
    return (np.arange(bands * rows) * 97 % REGISTERS).reshape(bands, rows)


def text_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, codes): sorted distinct shingle codes of each text."""
    words = words_of(texts, lower=True)
    owner, codes = shingle_codes(words, size)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        codes[a:b].sort()
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return np.searchsorted(owner[first], np.arange(len(texts) + 1)), codes[first]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def sketches(bounds: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Registers (leading zeros, then mantissa) of each set; an empty bucket takes over the next full one."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    h = mix(codes + U(0x5851F42D4C957F2D))
    least = np.full(n * REGISTERS, np.iinfo(U).max, U)
    np.minimum.at(least, owner * REGISTERS + (h & U(REGISTERS - 1)).astype(np.int64), h >> U(8))  # 56 bits are left
    least = least.reshape(n, REGISTERS)
    full = least != np.iinfo(U).max
    exponent = np.frexp(np.where(full, least, U(0)).astype(np.float64))[1].astype(np.int64)  # number of bits
    zeros = 56 - exponent
    shift = exponent - 1 - MANTISSA
    mantissa = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(U), least << np.maximum(-shift, 0).astype(U))
    registers = (zeros.astype(np.uint16) << MANTISSA) | (mantissa & U((1 << MANTISSA) - 1)).astype(np.uint16)
    place = np.where(full, np.arange(REGISTERS), 10 * REGISTERS)
    ahead = np.minimum.accumulate(np.concatenate([place, place + REGISTERS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    return np.take_along_axis(registers, ahead % REGISTERS, axis=1)


def signatures(documents: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                bounds, codes = text_sets(step.column("text"), size)
                regs = sketches(bounds, codes)
                yield pa.RecordBatch.from_arrays([
                    step.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sums(mix(codes), bounds).view(np.int64)),
                    pa.array(sums(mix(codes ^ U(0xA5A5A5A5A5A5A5A5)), bounds).view(np.int64)),
                    pa.array([row.tobytes() for row in regs], pa.binary()),
                ], names=["doc_id", "n_shingles", "k1", "k2", "sketch"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, SIGNED)


def registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


BAND = "rep long, n_shingles long, no short, band long"


def band_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(rep, n_shingles, no, band) rows; a band's key is the fingerprint of its number and registers."""
    chosen = places(percent)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = registers_of(batch.column("sketch")).astype(U)
            reps = batch.column("rep").to_numpy()
            for band, own in enumerate(chosen):
                key = np.full(len(reps), band + 1, U)
                for place in own:
                    key = mix(key * U(0x9E3779B97F4A7C15) + regs[:, place])
                no = np.full(len(reps), band, np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(reps), batch.column("n_shingles"), pa.array(no), pa.array(key.view(np.int64))], names=["rep", "n_shingles", "no", "band"])

    return classes.select("rep", "n_shingles", "sketch").mapInArrow(bands, BAND)


def counter(codes: np.ndarray) -> np.ndarray:
    return (mix(codes) >> U(64 - COUNTER_BITS)).astype(np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur in sets (codes)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            total += np.bincount(counter(np.frombuffer(b"".join(batch.column("codes").to_pylist()), U)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = sets.select("codes").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return total


def shingle_rows(sets: DataFrame, percent: int) -> DataFrame:
    """Rows as of :func:`band_rows` with a set's rarest shingles for bands.

    Sets of n shingles that link share at least percent * n / 100, so one is among the first n - that + 1 of either in any
    order that all sets follow. Shingles that occur once are left out.
    """
    often = np.minimum(shingle_counts(sets), np.iinfo(np.uint32).max).astype(np.uint32)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("codes").to_pylist()
            n = np.array([len(x) // 8 for x in raw], np.int64)
            codes, owner = np.frombuffer(b"".join(raw), U), np.repeat(np.arange(len(n)), n)
            times = often[counter(codes)]
            order = np.lexsort((codes, times, owner))
            rank = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
            own = n[owner]
            at = order[(rank < own + percent * own // -100 + 1) & (times[order] > 1)]
            no = np.full(len(at), SHINGLE, np.int16)
            key = mix(codes[at] ^ U(0x3C6EF372FE94F82B))
            yield pa.RecordBatch.from_arrays([
                batch.column("rep").take(pa.array(owner[at])), pa.array(n[owner[at]]), pa.array(no), pa.array(key.view(np.int64)),
            ], names=["rep", "n_shingles", "no", "band"])

    return sets.select("rep", "codes").mapInArrow(prefixes, BAND)


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate without the registers that are expected to agree by accident."""
    ratio = np.maximum(n, m) / np.minimum(n, m)
    accidental = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2 * REGISTERS
    return np.clip((matches - accidental) / (REGISTERS - accidental), 0, 1)


def may_link(percent: int, regs: np.ndarray, n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` pass the length bound and, unless a set is small, the estimate against row i."""
    low, high = np.minimum(n[i], n[others]), np.maximum(n[i], n[others])
    long_enough = 100 * low >= percent * high
    others, low = others[long_enough], low[long_enough]
    if not len(others):
        return others
    guess = estimate((regs[i] == regs[others]).sum(axis=1), n[i], n[others])
    share = percent / 100
    spread = np.sqrt(share * (1 - share) * (1 / REGISTERS + 2 / low))
    return others[(low < SHORT) | (guess >= share - SLACK * spread)]


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle; sets differ in at least as many shingles as their bitmaps in bits."""
    bits = np.zeros((len(sets), BITMAP * 64), bool)
    for k, own in enumerate(sets):
        bits[k, (own % U(BITMAP * 64)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(U)


def may_agree(percent: int, bits: np.ndarray, n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` can't be ruled out against row i by length or bitmap; no link is lost."""
    others = others[100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])]
    apart = np.bitwise_count(bits[i] ^ bits[others]).sum(axis=1, dtype=np.int64)
    return others[(100 + percent) * apart <= (100 - percent) * (n[i] + n[others])]


def linked(percent: int, a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Groups:
    def __init__(self, names: list[int]):
        self.of = {x: x for x in names}

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.of[max(x, y)] = min(x, y)


def block_links(percent: int, rows: list[dict], no: int) -> list[tuple[int, int]]:
    """Links that connect parts of one block: rows marked ``outside`` against all rows.

    In a block of band ``no``, pairs that share an earlier band are left to it; in one of a shingle, all are compared.
    """
    sets = [np.frombuffer(r["codes"], U) for r in rows]
    n = np.array([len(s) for s in sets])
    if no == SHINGLE:
        bits = bitmaps(sets)
    else:
        regs, earlier = np.stack([np.frombuffer(r["sketch"], np.uint16) for r in rows]), places(percent)[: no + 1]
    groups = Groups([r["part"] for r in rows])
    outside = np.array([r["outside"] for r in rows])
    found = []
    for i in np.flatnonzero(outside):
        others = np.concatenate([np.flatnonzero(~outside), np.flatnonzero(outside[: i]) if i else np.zeros(0, np.int64)])
        others = may_agree(percent, bits, n, int(i), others) if no == SHINGLE else may_link(percent, regs, n, int(i), others)
        if len(others) and no != SHINGLE:
            same = (regs[i][earlier] == regs[others][:, earlier]).all(axis=2)
            others = others[same.argmax(axis=1) == no]
        for j in others:
            x, y = rows[i]["part"], rows[int(j)]["part"]
            if groups.find(x) != groups.find(y) and linked(percent, sets[i], sets[j]):
                groups.join(x, y)
                found.append((rows[i]["rep"], rows[int(j)]["rep"]))
    return found


LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def confirmed_in_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """blocks: one row per block with its band ``no`` and ``rows``, a list of (rep, part, outside, sketch, codes)."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, rows in zip(batch.column("no").to_pylist(), batch.column("rows"), strict=True):
                found = block_links(percent, rows.as_py(), no)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=LINK)

    return blocks.select("no", "rows").mapInArrow(confirm, "u long, v long")


def confirmed_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (rep, leader) that hold on full sets."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, row in enumerate(batch.select(["sketch", "codes", "l_sketch", "l_codes"]).to_pylist()):
                sets = [np.frombuffer(row[c], U) for c in ("codes", "l_codes")]
                regs = np.stack([np.frombuffer(row[c], np.uint16) for c in ("sketch", "l_sketch")])
                n = np.array([len(s) for s in sets])
                if len(may_link(percent, regs, n, 0, np.array([1]))) and linked(percent, *sets):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("rep", "leader")], schema=LINK)

    sides = members.select("rep", "sketch", "codes")
    leaders = members.select(F.col("rep").alias("leader"), F.col("sketch").alias("l_sketch"), F.col("codes").alias("l_codes"))
    return pairs.join(sides, "rep").join(leaders, "leader").mapInArrow(confirm, "u long, v long")


def sets_of(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(rep, codes) of the documents in ``nodes`` (node)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                bounds, codes = text_sets(step.column("text"), size)
                sets = [codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([step.column("rep"), pa.array(sets, pa.binary())], names=["rep", "codes"])

    wanted = nodes.select(F.col("node").alias("rep"))
    if nodes.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").where("text is not null")
    return texts.join(wanted, "rep", "left_semi").mapInArrow(read, "rep long, codes binary")


def near_duplicate_links(documents: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between class representatives; enough of them to connect all that are connected."""
    small = classes.where(F.col("n_shingles") <= (SHORT - 1) * 100 // percent).select(F.col("rep").alias("node")).distinct()
    small = freeze(sets_of(documents, freeze(small, "small-nodes"), size).groupBy("rep").agg(F.min("codes").alias("codes")), "small-sets")
    large = classes.where(F.col("n_shingles") >= SHORT)
    bands = freeze(band_rows(large, percent).unionByName(shingle_rows(small, percent)), "bands")
    leaders = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = freeze(bands.join(leaders.select("band", "leader"), "band"), "met")
    star = freeze(met.where("rep <> leader").select("rep", "leader").distinct(), "band-stars")
    nodes = freeze(star.select(F.explode(F.array("rep", "leader")).alias("node")).distinct(), "nodes")
    sets = sets_of(documents, nodes, size).groupBy("rep").agg(F.min("codes").alias("codes"))
    members = freeze(sets.join(classes.select("rep", "sketch"), "rep"), "members")
    first = freeze(confirmed_pairs(star, members, percent), "links")

    part = first.groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("part"))  # a leader is the smallest of its band
    placed = freeze(met.drop("leader").join(part, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "placed")
    parts = placed.groupBy("band", "no", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    most = F.max(F.struct("n", "part", "w"))
    open_bands = parts.groupBy("band", "no").agg(most.alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n_parts"))
    blocks_for = lambda n, w: F.ceil(F.greatest(n / BLOCK_MEMBERS, w / BLOCK_SHINGLES)).cast("int")
    open_bands = open_bands.where("n_parts > 1").select(
        "band", "no", F.col("main.part").alias("main"), blocks_for(F.col("n"), F.col("w")).alias("nb"),
        blocks_for(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("nq"),
    )
    dealt = placed.join(open_bands, ["band", "no"]).withColumns({
        "outside": F.col("part") != F.col("main"),
        "b": F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), "q": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("nq")).cast("int"),
    })
    dealt = freeze(dealt.select("rep", "part", "band", "no", "outside", "b", "q", "nb", "nq"), "open-bands")
    single = (F.col("nb") == 1) & (F.col("nq") == 1)
    asking = dealt.where(F.col("outside") & ~single).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    asked = dealt.where(~single).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("outside", F.lit(False))
    dealt = dealt.where(single).unionByName(asking).unionByName(asked).join(members, "rep")
    row = F.struct("rep", "part", "outside", F.when(F.col("no") != SHINGLE, F.col("sketch")).alias("sketch"), "codes")
    second = confirmed_in_blocks(dealt.groupBy("band", "no", "q", "b").agg(F.collect_list(row).alias("rows")), percent)
    return first.union(freeze(second, "links"))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ASCII letters are lower-cased; words are runs between ASCII white space; a text's set holds its distinct runs of
    ``size`` words, or its whole sequence if shorter. Documents are linked when 100 * intersection >= percent * union of
    the full sets; component_id is the smallest doc_id reachable. Null and empty texts have empty sets and stand alone.
    Rows with a null doc_id stand alone, too, and are kept; copies and repeated rows share a component; other columns are
    ignored; an empty table gives no rows. Links of a set of fewer than SHORT shingles are all found; one of two larger sets
    is missed if all bands differ (1 in 10**8 at the threshold if registers were independent; sparse sketches miss more).
    """
    signed = freeze(signatures(documents, size), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles")
    classes = freeze(classes.agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "classes")
    links = near_duplicate_links(documents, classes, size, percent)
    reached = components(links).select(F.col("node").alias("rep"), "component")
    named = classes.join(reached, "rep", "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n_shingles").alias("c_n"), F.coalesce("component", "rep").alias("component_id"),
    )
    # ids, too: the same id with different texts is one node
    whole = signed.select("doc_id", "n_shingles", "k1", "k2").join(
        named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") == F.col("c_n")) & F.col("doc_id").isNotNull(), "left"
    )
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
