"""Token ids of documents as files of Simple-8b blocks.

Documents are range-partitioned by id once; each task tokenises its range in order and writes blocks of whole documents.
Part totals (one number for each task) give every document its place among all ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .simple8b import pack_block, unpack
from .tables import shuffle_partitions, steps, worker_state

#: Distinct chunks of text whose ids a Python worker remembers (about 300 bytes each); it forgets all of them when full.
REMEMBERED = 600_000
BLOCK = "part int, first long, n_ids long, doc_ids binary, counts binary, offsets binary, words binary"


#: Latin letters whose lower case is Latin, too, and ASCII punctuation other than apostrophes and angle brackets: one piece
#: each to any splitter by class.
LETTERS = "".join(c for c in map(chr, range(65, 0x250)) if c.isalpha() and c not in "\u00aa\u00b5\u00ba\u0130" and ord(c.lower()) < 0x250)
LATIN = re.compile(f"[{LETTERS}]+")
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class ChunkEncoder:
    """Ids of texts through a tokenizers file, each distinct white-space chunk encoded once.

    ASCII white space ends a piece for the supported files, so a text's ids are the ids of its chunks in order. Chunks of
    Latin letters with trailing punctuation skip the library's normaliser and splitter: their lower-case pieces go to its
    model at once. That the library cuts all of them so is proven once for each worker; else the full way is used alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Known(self.chunk)
        self.pieces: dict[bytes, bytes] = {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): "".join(piece for piece, _ in level.pre_tokenize_str(c)) for c in LETTERS + TAIL.decode()}
        self.plain = self.cuts_by_class()

    def cuts_by_class(self) -> bool:
        """Whether each run of letters, and of punctuation, is one piece to the library: its lower-case bytes."""
        library, tail = self.tokenizer, TAIL.decode()
        if library.pre_tokenizer is None or library.truncation or library.padding:
            return False
        if any(set(t.content) <= set(LETTERS + tail) for t in library.get_added_tokens_decoder().values()):
            return False

        def pieces(text: str) -> list[str]:
            text = library.normalizer.normalize_str(text) if library.normalizer else text
            return [piece for piece, _ in library.pre_tokenizer.pre_tokenize_str(text)]

        def alike(*runs: str) -> bool:
            return pieces("".join(runs)) == [run.lower().translate(self.bytes) for run in runs]

        pairs = ["".join(a + b for a in chars for b in chars) for chars in (LETTERS, tail)]
        return all(map(alike, LETTERS + tail)) and all(map(alike, pairs)) and all(alike(a, b) for a in LETTERS for b in tail)

    def piece(self, piece: bytes) -> bytes:
        """Ids of one piece of letters or of punctuation."""
        if (ids := self.pieces.get(piece)) is None:
            text = piece.decode() if piece.isascii() else piece.decode().translate(self.bytes)
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def chunk(self, chunk: bytes) -> bytes:
        body = chunk.rstrip(TAIL)
        if not self.plain or not (body.isalpha() or LATIN.fullmatch(body.decode())):
            return self.ids(chunk.decode()).tobytes()
        ids = self.piece(body.lower() if body.isascii() else body.decode().lower().encode())
        if len(body) < len(chunk):
            ids += self.piece(chunk[len(body) :])
        return ids

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.pieces.clear()
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, text.encode().split())) if text else b"", "<u4") for text in texts]


class Known(dict):
    """Ids by chunk; a chunk that is asked for the first time is encoded."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


def encoder(path: str) -> ChunkEncoder:
    state = worker_state()
    if (name := f"chunk encoder {path}") not in state:
        state[name] = ChunkEncoder(path)
    return state[name]


def write_tokens(documents: DataFrame, tokenizer: str, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the ids of every text, each ended by ``end_id``, in ascending order of id (null first, ties by text)."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for step in steps(batch):
                each = coder.encode(step.column("text").to_pylist())
                counts = np.array([len(ids) + 1 for ids in each], np.int64)
                ids = np.concatenate([x for own in each for x in (own, end)])
                words, offsets = pack_block(ids)
                keys = step.column("id").to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": [pa.array(keys, pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).tobytes()],
                    "counts": [counts.tobytes()], "offsets": [offsets.tobytes()], "words": [words.astype("<u8").tobytes()],
                }, schema=SCHEMA)
                first += len(ids)

    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    dealt.mapInArrow(blocks, BLOCK).write.parquet(path)


#: Stands for a null id inside a block.
NULL_ID = -(1 << 63)
SCHEMA = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), *((n, pa.binary()) for n in ("doc_ids", "counts", "offsets", "words"))])
READ = pa.schema([("part", pa.int32()), ("inside", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.int64)
            ids = unpack(np.frombuffer(row["words"], "<u8")).astype("<u4")
            ends = np.cumsum(counts)
            keys = np.frombuffer(row["doc_ids"], np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(keys), row["part"], np.int32)), pa.array(row["first"] + ends - counts),
                pa.array(keys, mask=keys == NULL_ID), pa.array(counts),
                pa.array([ids[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)], pa.binary()),
            ], schema=READ)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens, ids (little-endian 32-bit)."""
    files = spark.read.schema(BLOCK).parquet(path)
    inside = files.mapInArrow(unpacked, "part int, inside long, doc_id long, n_tokens long, ids binary")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each writing task
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    return inside.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")


def tokenize_documents(documents: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the ids of all documents as Simple-8b files and return what the files hold, see :func:`read_tokens`.

    Null and empty texts have the end id only. Rows with a null id come first; repeated rows are kept, one after another;
    other columns are ignored; an empty table gives no rows. Texts of any length stay in one block.
    """
    spark = documents.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(documents, tokenizer, path, end_id)
    return read_tokens(spark, path)
