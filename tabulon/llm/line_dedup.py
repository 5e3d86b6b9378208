"""Line dedup by a segment-partition edit join.

Two lines within ``max_edits`` edits agree in one of ``max_edits + 1`` segments of the shorter one, at a place that the
lengths and the number of segments before and after restrict to a few. Each distinct line therefore gives one index key
per segment and a few probe keys per admissible length; lines whose keys meet are candidates. They are confirmed with a
banded bit-parallel edit distance. Edits are counted on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import freeze, steps, text_buffers
from .words import BYTE_BASE, CODES, SPACE, U, mix, power_size, powers

MAX_EDITS = 1
#: Lines of fewer bytes are compared exactly only: an edit changes their meaning.
LEAST_BYTES = 30
#: Lines on either side of one block of candidates.
BLOCK = 256
#: Candidate lines up to which their list is broadcast (8 bytes each) when texts are fetched.
BROADCAST_LINES = 2_000_000


class Lines:
    """Lines of several texts: byte ranges, owners, numbers within the text, fingerprints; blank lines have none."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_buffers(texts)
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(offsets, breaks, "right") - 1
        filled = np.flatnonzero(np.diff(offsets) > 0)
        starts = np.concatenate([offsets[filled], breaks + 1])
        own = np.concatenate([filled, owner])
        order = np.lexsort((starts, own))
        self.start, self.owner = starts[order], own[order]
        last = np.append(self.owner[1:] != self.owner[:-1], True) if len(order) else np.zeros(0, bool)
        self.stop = np.where(last, offsets[1:][self.owner], np.append(self.start[1:], 0) - 1) if len(order) else starts
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.number = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        up, _ = powers(BYTE_BASE, power_size(len(self.data)))
        self.sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(CODES[self.data] * up[: len(self.data)], out=self.sums[1:])
        visible = np.append(0, np.cumsum(~SPACE[self.data]))
        self.filled = np.flatnonzero(visible[self.stop] > visible[self.start])
        self.code = self.part(self.start, self.stop)

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Fingerprints of byte ranges."""
        _, down = powers(BYTE_BASE, power_size(len(self.data)))
        return mix((self.sums[stop] - self.sums[start]) * down[start] + (stop - start).astype(U) * U(0x632BE59BD9B4E019))

    def distinct(self) -> np.ndarray:
        """One of each group of equal lines that are long enough for edits."""
        long_enough = self.filled[(self.stop - self.start)[self.filled] >= LEAST_BYTES]
        return long_enough[np.unique(self.code[long_enough], return_index=True)[1]]


def segment(lengths: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of segment i of lines of these lengths; the last ones are longer by one."""
    base, longer = lengths // parts, lengths % parts
    short = parts - longer
    return i * base + np.maximum(0, i - short), base + (i >= short)


def key_rows(documents: DataFrame, edits: int) -> DataFrame:
    """(key, line, probe): index keys of each distinct line's segments and probe keys of its substrings."""
    def keyed(own: np.ndarray, lengths: np.ndarray, i: int, code: np.ndarray, probe: bool) -> pa.RecordBatch:
        key = mix(code ^ mix(lengths.astype(U) * U(64) + U(i + 1)))
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), probe))], names=["key", "line", "probe"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                lines = Lines(step.column("text"))
                at = lines.distinct()
                start, size, code = lines.start[at], (lines.stop - lines.start)[at], lines.code[at]
                for i in range(edits + 1):
                    place, width = segment(size, edits + 1, i)
                    yield keyed(code, size, i, lines.part(start + place, start + place + width), False)
                    for less in range(edits + 1):
                        shorter = size - less
                        place, width = segment(shorter, edits + 1, i)
                        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                            fits = (shorter >= LEAST_BYTES) & (place + shift >= 0) & (place + shift + width <= size)
                            begin = (start + place + shift)[fits]
                            yield keyed(code[fits], shorter[fits], i, lines.part(begin, begin + width[fits]), True)

    return documents.mapInArrow(cut, "key long, line long, probe boolean")


def line_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, number, line) of every line that isn't blank."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                lines = Lines(step.column("text"))
                at = lines.filled
                yield pa.RecordBatch.from_arrays([
                    step.column("doc_id").take(pa.array(lines.owner[at])), pa.array(lines.number[at].astype(np.int32)),
                    pa.array(lines.code[at].view(np.int64)),
                ], names=["doc_id", "number", "line"])

    return documents.mapInArrow(read, "doc_id long, number int, line long")


def line_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, bytes) of the wanted lines (line)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                lines = Lines(step.column("text"))
                at = lines.distinct()
                raw = [lines.data[a:b].tobytes() for a, b in zip(lines.start[at], lines.stop[at], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines.code[at].view(np.int64)), pa.array(raw, pa.binary())], names=["line", "bytes"])

    if wanted.count() <= BROADCAST_LINES:
        wanted = F.broadcast(wanted)
    return documents.mapInArrow(read, "line long, bytes binary").join(wanted, "line", "left_semi").groupBy("line").agg(F.min("bytes").alias("bytes"))


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    For each diagonal of the band, one integer has a bit for every place where the lines differ; a run of equal bytes is
    crossed at once by looking for the next set bit. ``reach[d]`` is how far diagonal d gets with the edits spent.
    """
    if len(a) > len(b):
        a, b = b, a
    gap = len(b) - len(a)
    if gap > edits:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = {}
    for d in range(-edits, edits + 1):  # row i meets column i + d
        low, high = max(0, -d), min(len(a), len(b) - d)
        unlike = np.ones(len(a) + 1, bool)
        if high > low:
            unlike[low:high] = x[low:high] != y[low + d : high + d]
        differ[d] = int.from_bytes(np.packbits(unlike, bitorder="little").tobytes(), "little")

    def slide(d: int, row: int) -> int:
        rest = differ[d] >> row
        return row + (rest & -rest).bit_length() - 1 if rest else len(a)

    reach = {0: slide(0, 0)}
    for _ in range(edits):
        if reach.get(gap, -1) >= len(a):
            return True
        grown = {}
        for d in range(-edits, edits + 1):
            rows = [reach[k] + more for k, more in ((d - 1, 0), (d, 1), (d + 1, 1)) if k in reach]
            if rows:
                row = min(max(rows), len(a), len(b) - d)
                if row >= max(0, -d):
                    grown[d] = slide(d, row) if row < len(a) else row
        reach = grown
    return reach.get(gap, -1) >= len(a)


def late_lines(blocks: DataFrame, edits: int) -> DataFrame:
    """(line) of lines within the edits of a line that is first met earlier; blocks have ``rows`` of candidates."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                rows = {(r["line"], r["probe"]): r for r in rows.as_py()}.values()
                index = [r for r in rows if not r["probe"]]
                late = set()
                for p in rows:
                    for r in index if p["probe"] else ():
                        if r["line"] == p["line"]:
                            continue
                        after = p if (p["doc_id"], p["number"]) > (r["doc_id"], r["number"]) else r
                        if after["line"] not in late and within(p["bytes"], r["bytes"], edits):
                            late.add(after["line"])
                yield pa.RecordBatch.from_arrays([pa.array(sorted(late), pa.int64())], names=["line"])

    return blocks.select("rows").mapInArrow(confirm, "line long").distinct()


def line_dedup(documents: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """One row per document: doc_id, n_lines, removed (numbers of the lines to remove, from 0, ascending).

    Lines end at line feeds. A line is removed if an equal line stands earlier (smaller doc_id, or the same document and
    a smaller number), or if its first occurrence comes after that of a different line within ``max_edits`` byte edits;
    the latter holds for lines of LEAST_BYTES or more. Blank lines always stay. Null and empty texts have no lines. Rows
    with a null id lose nothing and are no source; doc_id is taken to identify a text, so repeated rows get equal
    results; other columns are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null and text is not null")
    keys = key_rows(known.select("text"), max_edits)
    meeting = keys.groupBy("key").agg(
        F.min("line").alias("low"), F.max("line").alias("high"),
        F.sum(F.col("probe").cast("int")).alias("probes"), F.sum((~F.col("probe")).cast("int")).alias("indexed"),
    ).where("low <> high and probes > 0 and indexed > 0")
    meeting = freeze(meeting.select("key", F.ceil(F.col("indexed") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("probes") / BLOCK).cast("int").alias("nq")), "line-keys")
    met = freeze(keys.join(meeting, "key").distinct(), "line-candidates")
    lines = line_rows(known)
    classes = freeze(
        lines.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count(F.lit(1)).alias("times"))
        .select("line", "first.doc_id", "first.number", "times"), "line-classes",
    )
    wanted = freeze(met.select("line").distinct(), "lines-wanted")
    texts = line_texts(known, wanted).join(classes, "line").select("line", "bytes", "doc_id", "number")
    side = lambda n, seed: F.pmod(F.xxhash64("line", F.lit(seed)), F.col(n)).cast("int")
    probing = met.where("probe").withColumns({"q": side("nq", 1), "b": F.explode(F.sequence(F.lit(0), F.col("nb") - 1))})
    indexed = met.where("not probe").withColumn("b", side("nb", 2)).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    row = F.struct("line", "probe", "bytes", "doc_id", "number")
    dealt = probing.unionByName(indexed).join(freeze(texts, "line-texts"), "line")
    late = freeze(late_lines(dealt.groupBy("key", "q", "b").agg(F.collect_list(row).alias("rows")), max_edits), "late-lines")
    marked = classes.join(late.withColumn("late", F.lit(True)), "line", "left").where("late or times > 1").select(
        "line", F.col("doc_id").alias("first_doc"), F.col("number").alias("first_number"), F.coalesce("late", F.lit(False)).alias("late")
    )
    gone = lines.join(marked, "line").where("late or doc_id <> first_doc or number <> first_number").select("doc_id", "number").distinct()
    lists = gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("number")).alias("removed"))
    count = F.when(F.length(F.coalesce("text", F.lit(""))) == 0, 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    counted = rows.select("doc_id", count.cast("long").alias("n_lines"))
    return counted.join(lists, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
