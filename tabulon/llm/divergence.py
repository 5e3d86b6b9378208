"""How far the sources of a language differ in their words, from quadtrees over the group-term counts.

The groups (language and source) and the terms of a language span a sparse matrix of counts, which is kept as quadtrees
of ``side`` x ``side`` cells. Two groups are compared by walking their trees jointly: quadrants in which both are all zero
end the walk, and since all their cells have the same price, they are priced together from the number of cells. Only
cells in which either group holds something are visited.

All arithmetic is in whole numbers: ``p = 1 + floor(10**9 * (count + 1) / (N + V))`` and ``floor((p - q)**2 / q)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.lookup import lookup_join
from .k2tree import QuadTree, joint_cells
from .tables import freeze, steps, text_buffers

SIDE, LEAST_DOCUMENTS, TOP_TERMS = 64, 3, 200
SCALE = 10**9
#: Bytes of text that one vectorised step takes, and pairs of tiles whose sums a task holds.
STEP, HELD_TILES = 512 << 10, 64
#: Fixed: ASCII other than letters separates, capitals become small.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[65:91] += 32
LETTERS[:65] = LETTERS[91:97] = LETTERS[123:128] = 32
COUNTS = pa.schema([("lang", pa.large_string()), ("source", pa.large_string()), ("term", pa.large_string()), ("n", pa.int64()), ("documents", pa.int64())])
TREES = pa.schema([
    ("lang", pa.string()), ("col", pa.int64()), ("tile", pa.int64()), ("bitmaps", pa.binary()), ("counts", pa.binary()),
    ("row_sums", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("lang_counts", pa.list_(pa.int64())), ("opens", pa.bool_()),
])


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division in three digits of 1000; totals below 9 * 10**15."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of each step, and each group once with a null term."""
    for batch in batches:
        for step in steps(batch, limit=STEP):
            data, offsets = text_buffers(step.column("text"))
            plain = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LETTERS[data])])
            words = pc.ascii_split_whitespace(plain.cast(pa.large_string()))
            flat, owner = pc.list_flatten(words), np.asarray(pc.list_parent_indices(words))
            full = np.asarray(pc.binary_length(flat)) > 0
            coded = flat.filter(pa.array(full)).dictionary_encode()
            term, owner, n_terms = np.asarray(coded.indices, np.int64), owner[full], max(1, len(coded.dictionary))
            keys = pa.StructArray.from_arrays([step.column("lang"), step.column("source")], names=["lang", "source"])
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault((k["lang"], k["source"]), len(names)) for k in keys.to_pylist()], np.int64)
            inside, times = np.unique(owner * n_terms + term, return_counts=True)  # a term of a document
            cell, back = np.unique(group[inside // n_terms] * n_terms + inside % n_terms, return_inverse=True)
            n, documents = np.zeros(len(cell), np.int64), np.bincount(back, minlength=len(cell))
            np.add.at(n, back, times)
            langs, sources = (pa.array([k[i] for k in names], pa.large_string()) for i in (0, 1))
            at = pa.array(cell // n_terms)
            yield pa.RecordBatch.from_arrays([
                langs.take(at), sources.take(at), coded.dictionary.cast(pa.large_string()).take(pa.array(cell % n_terms)), pa.array(n), pa.array(documents, pa.int64()),
            ], schema=COUNTS)
            zero = pa.array(np.zeros(len(names), np.int64))
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(names), pa.large_string()), zero, zero], schema=COUNTS)


def planted(rows: DataFrame, side: int) -> DataFrame:
    """Trees of ``side`` terms of a language each, cut from rows (lang, lang_n, term, g, n) that are sorted so.

    A row for each tree and tile of ``side`` groups with its counts summed by group; the first tile of a tree ``opens`` it.
    """
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 32, 0
        lang, terms, lang_counts, cells = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            g, column, n = (np.array(c, np.int64) for c in zip(*cells))
            for i, tile in enumerate(np.unique(g // side)):
                own = g // side == tile
                sums = np.zeros(side, np.int64)
                np.add.at(sums, g[own] % side, n[own])
                tree = QuadTree.build(g[own] % side, column[own], n[own], side).to_bytes()
                values = [lang, part | seen, int(tile), *tree, sums, terms, lang_counts, i == 0]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, TREES, strict=True)], schema=TREES)

        for batch in batches:
            for of, total, term, g, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "lang_n", "term", "g", "n"))):
                if of != lang or not terms or term != terms[-1]:
                    if terms and (of != lang or len(terms) == side):
                        yield from out()
                        seen, terms, lang_counts, cells = seen + 1, [], [], []
                    lang = of
                    terms.append(term)
                    lang_counts.append(total)
                cells.append((g, len(terms) - 1, n))
        if terms:
            yield from out()

    return rows.mapInArrow(
        plant, "lang string, col long, tile long, bitmaps binary, counts binary, row_sums array<long>, terms array<string>, lang_counts array<long>, opens boolean"
    )


def tree_of(row: dict, side: int, bitmaps: str = "bitmaps", counts: str = "counts") -> QuadTree:
    return QuadTree.from_bytes(row[bitmaps], row[counts], side) if row[bitmaps] is not None else QuadTree.empty(side)


def leaning_terms(trees: DataFrame, side: int) -> DataFrame:
    """(lang, g, term, value) of the cells whose group uses the term more than its language does."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("term", pa.string()), ("value", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, columns, counts = tree_of(row, side).cells()
                p = scaled(counts, np.array(row["totals"], np.int64)[rows])
                q = scaled(np.array(row["lang_counts"], np.int64)[columns], np.int64(row["lang_total"]))
                at = np.flatnonzero(p > q)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["lang"]] * len(at), pa.string()), pa.array(rows[at] + row["tile"] * side),
                    pa.array(row["terms"], pa.string()).take(pa.array(columns[at])), pa.array(gap(p[at], q[at])),
                ], schema=schema)

    return trees.mapInArrow(read, "lang string, g long, term string, value long")


def visited_pairs(pairs: DataFrame, side: int) -> DataFrame:
    """(lang, g, other, cells, value): for two groups, the cells met on the joint walks and their summed value, both ways."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("other", pa.int64()), ("cells", pa.int64()), ("value", pa.int64())])

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), (cells, there, back) in held.items():
            g, other = np.nonzero(cells)
            own, far = g + a * side, other + b * side
            for x, y, value in ((own, far, there), (far, own, back)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(g), pa.string()), pa.array(x), pa.array(y), pa.array(cells[g, other]), pa.array(value[g, other]),
                ], schema=schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["lang"], row["tile"], row["other_tile"]
                if key not in held:
                    if len(held) == HELD_TILES:
                        yield from out(held)
                        held.clear()
                    held[key] = np.zeros((3, side, side), np.int64)
                total_a, total_b = (np.array(row[c], np.int64) for c in ("totals", "other_totals"))
                same = key[1] == key[2]
                a = tree_of(row, side)
                b = a if same else tree_of(row, side, "other_bitmaps", "other_counts")
                i, j, x, y = joint_cells(a, b, len(total_a), len(total_b), same)
                p, q = scaled(x, total_a[i]), scaled(y, total_b[j])
                for sums, value in zip(held[key], (1, gap(p, q), gap(q, p))):
                    np.add.at(sums, (i, j), value)
        yield from out(held)

    found = pairs.mapInArrow(walk, "lang string, g long, other long, cells long, value long")
    return found.groupBy("lang", "g", "other").agg(F.sum("cells").alias("cells"), F.sum("value").alias("value"))


def source_divergence(
    documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, side: int = SIDE,
    text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    Part ``pair``: one row for each other source of the language, the sum over all kept terms. Part ``term``: kept terms that
    the source uses more than its whole language, the ``top`` of largest value. Terms are runs of letters (ASCII letters
    made small, and all characters beyond ASCII); a language keeps those of at least ``least_documents`` of its documents.
    Ranks go by value, ties by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty strings; a group whose documents have no terms is compared like any
    other, and a language without kept terms has pairs of value 0. Each row is a document, repeated ones too; texts of any
    length count whole; other columns are ignored; an empty table gives no rows. The result has a row for every ordered
    pair of sources of a language. A language may have 10**9 terms and 9 * 10**15 occurrences.
    """
    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)

    rows = documents.select(
        named(lang_column).alias("lang"), named(source_column).alias("source"), F.col(text_column).cast("string").alias("text")
    )
    cells = rows.mapInArrow(term_counts, "lang string, source string, term string, n long, documents long")
    cells = freeze(cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "group-terms")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = freeze(cells.where("term is null").select("lang", "source", number.cast("long").alias("g")), "groups")

    term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    kept = (
        cells.where("term is not null")
        .withColumns({"lang_documents": F.sum("documents").over(term), "lang_n": F.sum("n").over(term)})
        .where(F.col("lang_documents") >= least_documents)
    )
    # rows of a term stay together; frequent terms first, so that quadrants are dense or empty
    laid = lookup_join(kept, groups, ["lang", "source"], derived=False).select("lang", "lang_n", "term", "g", "n").repartition("lang", "term")
    trees = freeze(planted(laid.sortWithinPartitions("lang", F.desc("lang_n"), "term"), side), "count-trees")

    opened = trees.where("opens")
    langs = opened.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"), F.sum(F.aggregate("lang_counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    sums = trees.select("lang", "tile", F.posexplode("row_sums").alias("at", "n")).groupBy("lang", (F.col("tile") * side + F.col("at")).alias("g")).agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    priced = groups.join(sums, ["lang", "g"], "left").join(langs, "lang", "left").select(
        "lang", "source", "g", F.coalesce("v", none).alias("v"), (F.coalesce("n", none) + F.coalesce("v", none)).alias("total"),
        (F.coalesce("lang_n", none) + F.coalesce("v", none)).alias("lang_total"),
    )
    priced = freeze(priced, "priced-groups")

    tiles = priced.groupBy("lang", F.floor(F.col("g") / side).alias("tile")).agg(  # ``side`` groups each
        F.transform(F.sort_array(F.collect_list(F.struct("g", "total"))), lambda x: x["total"]).alias("totals"), F.max("lang_total").alias("lang_total")
    )
    tiles = freeze(tiles, "tiles")
    terms = leaning_terms(trees.join(tiles, ["lang", "tile"]), side)
    place = Window.partitionBy("lang", "g").orderBy(F.desc("value"), "term")
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    terms = terms.join(priced.select("lang", "g", "source"), ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # every tile of a tree's columns, also one whose groups have none of the terms
    columns = opened.select("lang", "col").join(tiles.select("lang", "tile", "totals"), "lang")
    full = columns.join(trees.select("lang", "col", "tile", "bitmaps", "counts"), ["lang", "col", "tile"], "left")
    far = full.select("lang", "col", *[F.col(c).alias(f"other_{c}") for c in ("tile", "totals", "bitmaps", "counts")])
    both = full.join(far, ["lang", "col"]).where("tile <= other_tile and (bitmaps is not null or other_bitmaps is not null)")
    met = visited_pairs(both, side)
    # all-zero cells of a pair have one price
    own = priced.select("lang", "g", "source", "v", F.expr(f"CASE WHEN v > 0 THEN 1 + {SCALE}L div total ELSE 1L END").alias("p"))
    others = own.select("lang", F.col("g").alias("other"), F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = own.join(others, "lang").where("g <> other").join(met, ["lang", "g", "other"], "left")
    value = F.coalesce("value", none) + (F.col("v") - F.coalesce("cells", none)) * F.expr("((p - q) * (p - q)) div q")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(place)).unionByName(terms)
