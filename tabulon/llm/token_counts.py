"""Token counts of whole texts by a sentencepiece model; huge texts in overlapping chunks that resynchronise.

A text beyond ``chunk_bytes`` is cut into chunks that overlap, each chunk is encoded on its own with the place of every
token, and neighbours are spliced at a token that both hold at the same place of the overlap. Such a splice is proven
right, not merely plausible: a byte-pair encoding is the one of the whole text exactly if every two neighbouring tokens
encode to themselves (the first merge across their border would also happen in their two texts alone). Up to the shared
token all neighbours come from the left chunk, from it on from the right one, so each pair stands in a valid encoding.
Where two chunks share no token of the overlap, the document is cut again with wider chunks and overlaps, at last whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tables import freeze, shuffle_partitions, steps, text_buffers, worker_state

CHUNK_BYTES, OVERLAP_BYTES = 32 << 10, 512
#: How much wider chunks and overlaps become where neighbours don't align.
WIDEN = 8
STEP = 256 << 10
COUNTED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("key", pa.int64()), ("text", pa.large_string()),
])
CHUNKS = pa.schema([
    ("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int64()), ("begin", pa.int64()), ("next_begin", pa.int64()),
    ("previous_end", pa.int64()), ("text", pa.large_string()),
])
PARTS = pa.schema([
    ("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()),
    ("head", pa.list_(pa.int64())), ("head_first", pa.int64()), ("tail", pa.list_(pa.int64())), ("tail_first", pa.int64()),
])
ID_BITS = 21


class PieceCounter:
    """A sentencepiece model with the width of each piece in characters."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(n)], bool)
        value = [int(self.model.id_to_piece(i)[3:5], 16) if self.byte[i] else 0 for i in range(n)]
        lead = [int(v & 0xC0 != 0x80) for v in value]
        self.widths = np.array([lead[i] if self.byte[i] else len(self.model.id_to_piece(i)) for i in range(n)], np.int64)
        self.spliceable, self.prefix = self.traits(path)

    def traits(self, path: str) -> tuple[bool, int]:
        """Whether places and splices are proven for this model, and the characters put before a text."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as layout
        except ImportError:
            return False, 0
        proto = layout.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trainer, rules = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        piece = proto.SentencePiece
        plain = kinds <= {piece.NORMAL, piece.UNKNOWN, piece.CONTROL, piece.BYTE} and len(proto.pieces) < 1 << ID_BITS
        same = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        pairs = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
        return plain and same and pairs, int(rules.add_dummy_prefix)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def places(self, text: str, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first and last character + 1) of the tokens of a chunk whose first character is number ``begin``."""
        ids = np.array(self.model.encode(text), np.int64)
        ends = np.cumsum(self.widths[ids]) + (begin - self.prefix)
        return ids, ends - self.widths[ids], ends


def counter(path: str) -> PieceCounter:
    state = worker_state()
    if (name := f"piece counter {path}") not in state:
        state[name] = PieceCounter(path)
    return state[name]


def cut_text(data: np.ndarray, stride: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first byte, byte after the last, begin, next chunk's begin, previous chunk's end) by chunk; the last three count characters."""
    def whole(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return max(at, 0)

    def characters(a: int, b: int) -> int:
        return int(np.count_nonzero(data[a:b] & 0xC0 != 0x80))

    n = max(1, -(-len(data) // stride))
    cuts = [whole(min(i * stride, len(data))) for i in range(n)] + [len(data)]
    starts = [0, *(whole(c - overlap) for c in cuts[1:n])]
    ends = np.cumsum([characters(a, b) for a, b in zip(cuts, cuts[1:])]).tolist()
    begins = [0, *(ends[i] - characters(starts[i + 1], cuts[i + 1]) for i in range(n - 1))]
    return [
        (starts[i], cuts[i + 1], begins[i], begins[i + 1] if i + 1 < n else ends[-1], ends[i - 1] if i else 0) for i in range(n)
    ]


def token_counts(
    documents: DataFrame, model: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text",
    chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: the number of ids that the model gives its whole text.

    ``model`` is the path of a sentencepiece file on every executor. A null text counts as empty and has no tokens; rows
    with a null id and repeated rows are each counted; other columns are ignored; an empty table gives no rows. Texts of
    any length are counted in chunks spread over tasks; a text in which chunks never align (one letter repeated without
    end) is encoded whole at last, and so is every text of a model for which splices aren't proven (unigram models,
    models that rewrite characters).
    """
    spark = documents.sparkSession
    if not counter(model).spliceable:
        chunk_bytes = 1 << 40

    def count_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of ordinary texts; huge ones pass under a key of their own."""
        pieces, key = counter(model), TaskContext.get().partitionId() << 40
        for batch in batches:
            for step in steps(batch, limit=STEP):
                _, offsets = text_buffers(step.column("text"))
                sizes = np.diff(offsets)
                huge = sizes > chunk_bytes
                texts = step.column("text").cast(pa.large_string())
                n = np.zeros(len(sizes), np.int64)
                n[~huge] = pieces.counts([t or "" for t in texts.filter(pa.array(~huge)).to_pylist()])
                keys = key + np.cumsum(huge)
                key = int(keys[-1])
                yield pa.RecordBatch.from_arrays([
                    step.column("id"), pa.array(sizes), pa.array(n, mask=huge), pa.array(keys, mask=~huge),
                    texts.take(pa.array(np.arange(len(sizes)), mask=~huge)),
                ], schema=COUNTED)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of tokens of each chunk, and those inside the overlaps with the previous and the next chunk."""
        pieces = counter(model)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, begins, ends = pieces.places(row["text"], row["begin"])
                # a token is known by place and id; a byte of a character outside the vocabulary never splices
                names = np.where(pieces.byte[ids], -2 - 2 * np.arange(len(ids)), begins << ID_BITS | ids)
                inner = np.flatnonzero(begins >= row["begin"])
                first = int(inner[0]) if len(inner) else len(ids)
                head = names[first : int(np.searchsorted(ends, row["previous_end"], "right"))]
                tail_first = int(np.searchsorted(begins, row["next_begin"]))
                tail = names[tail_first:]
                yield pa.RecordBatch.from_pydict({
                    **{name: [row[name]] for name in ("key", "doc_id", "n_bytes", "chunk")}, "n": [len(ids)],
                    "head": [head if row["chunk"] else head[:0]], "head_first": [first],
                    "tail": [np.where(tail < 0, tail - 1, tail)], "tail_first": [tail_first],
                }, schema=PARTS)

    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = freeze(rows.mapInArrow(count_short, "doc_id long, n_bytes long, n_tokens long, key long, text string"), "token-counts")
    done = [counted.where("key is null").select("doc_id", "n_bytes", "n_tokens")]
    huge = counted.where("key is not null").select("key", "doc_id", "n_bytes", "text")
    longest = huge.agg(F.max("n_bytes")).first()[0] or 0
    stride, overlap = chunk_bytes, min(overlap_bytes, chunk_bytes)
    while longest:
        whole = stride >= longest

        def cut(batches: Iterator[pa.RecordBatch], stride: int = stride, overlap: int = overlap) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffers(batch.column("text"))
                for i in range(batch.num_rows):
                    own = data[offsets[i] : offsets[i + 1]]
                    same = [batch.column(name)[i].as_py() for name in ("key", "doc_id", "n_bytes")]
                    for chunk, (a, b, *places) in enumerate(cut_text(own, stride, overlap)):
                        cells = [*same, chunk, *places, own[a:b].tobytes().decode(errors="replace")]
                        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, CHUNKS, strict=True)], schema=CHUNKS)

        spread = huge.mapInArrow(cut, "key long, doc_id long, n_bytes long, chunk long, begin long, next_begin long, previous_end long, text string")
        spread = spread.repartition(shuffle_partitions(spark), "key", "chunk")
        parts = freeze(
            spread.mapInArrow(
                encode, "key long, doc_id long, n_bytes long, chunk long, n long, head array<long>, head_first long, tail array<long>, tail_first long"
            ), "token-chunks",
        )
        left = parts.select("key", (F.col("chunk") + 1).alias("chunk"), F.col("n").alias("left_n"), F.col("tail").alias("left_tail"), F.col("tail_first").alias("left_first"))
        shared = F.get(F.array_intersect("head", "left_tail"), F.lit(0))
        # tokens that the left chunk counts from the shared one on, and the right chunk before it
        twice = F.col("left_n") - F.col("left_first") - F.array_position("left_tail", shared) + F.col("head_first") + F.array_position("head", shared)
        none = F.lit(None).cast("long")
        joints = parts.join(left, ["key", "chunk"]).select(
            "key", none.alias("doc_id"), none.alias("n_bytes"), F.lit(0).cast("long").alias("n"), twice.alias("twice")
        )
        each = parts.select("key", "doc_id", "n_bytes", "n", F.lit(0).cast("long").alias("twice")).unionByName(joints)
        summed = freeze(
            each.groupBy("key").agg(
                F.sum("n").alias("n"), F.sum("twice").alias("twice"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                F.bool_and(F.col("twice").isNotNull()).alias("aligned"),
            ), "token-sums",
        )
        done.append(summed.where("aligned").select("doc_id", "n_bytes", (F.col("n") - F.col("twice")).alias("n_tokens")))
        if whole:
            break
        rest = summed.where("not aligned")
        huge = huge.join(rest.select("key"), "key", "left_semi")
        longest = rest.agg(F.max("n_bytes")).first()[0] or 0
        stride, overlap = stride * WIDEN, overlap * WIDEN
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
