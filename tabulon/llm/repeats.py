"""Repeated word sequences across documents: routing to shards and putting results together.

A window of ``length`` words is routed by its minimiser, the smallest fingerprint of ``gram`` words in it. Neighbouring
windows with one minimiser form a segment. Only minimisers that occur again matter; their segments are reduced to distinct
ones, each standing for its first place, and every later copy of a segment is a repeat as a whole. Distinct segments that
share a minimiser may still share windows: they meet in a shard, where an index finds the shared windows. A minimiser with
very many distinct segments has them halved by the place of their windows about it: a half is routed by the words that all
its windows hold, copies are taken out again, and what is still too many is halved again, so that no shard grows with a
frequent phrase. A half of one window has one segment only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import freeze, steps
from .words import Words, sequence_codes, sequence_sums, window_minima, words_of

#: Distinct segments of one minimiser that go to a shard together; more are halved.
TOGETHER = 256
MASK = (1 << 64) - 1
HALVES = [
    pa.field("route", pa.int64()), pa.field("segment", pa.int64()), pa.field("doc_id", pa.int64()), pa.field("start", pa.int32()),
    pa.field("n", pa.int32()), pa.field("codes", pa.binary()), pa.field("low", pa.int32()), pa.field("high", pa.int32()),
]
#: Words of a shard (8 bytes each).
SHARD_WORDS = 400_000
#: Documents whose segments are fetched by a broadcast list of places (about 12 bytes a place) instead of a shuffle.
BROADCAST_PLACES = 3_000_000


@dataclass
class Shard:
    """Segments of one shard, one after another; a segment's words are ``codes[bounds[i]:bounds[i + 1]]``."""

    codes: np.ndarray
    bounds: np.ndarray
    docs: np.ndarray
    starts: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, document, word in document) of every word."""
        own = np.repeat(np.arange(len(self.docs)), np.diff(self.bounds))
        return own, self.docs[own], self.starts[own] + np.arange(len(own)) - self.bounds[own]


def segments(words: Words, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(owner, first window, windows, minimiser) of every run of windows whose minimiser stands at one place."""
    n = len(words.codes)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    sums = sequence_sums(words.codes)
    grams = sequence_codes(sums, np.arange(n - gram + 1), gram)
    least, spot = window_minima(grams, length - gram + 1)
    owners = words.owners()
    inside = owners[: len(least)] == owners[length - 1 :][: len(least)]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    new = np.ones(len(at), bool)
    new[1:] = (spot[at[1:]] != spot[at[:-1]]) | (owners[at[1:]] != owners[at[:-1]])
    first = np.flatnonzero(new)
    return owners[at[first]], at[first], np.diff(np.append(first, len(at))), least[at[first]]


def segment_rows(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(route, segment, doc_id, start, n): every segment with its fingerprint, place and number of words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                words = words_of(step.column("text"))
                own, first, windows, route = segments(words, length, gram)
                n = windows + length - 1
                code = sequence_codes(sequence_sums(words.codes), first, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(route.view(np.int64)), pa.array(code.view(np.int64)), step.column("doc_id").take(pa.array(own)),
                    pa.array((first - words.bounds[own]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ], names=["route", "segment", "doc_id", "start", "n"])

    return documents.mapInArrow(cut, "route long, segment long, doc_id long, start int, n int")


def fetched(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(route, doc_id, start, codes): the word fingerprints of segments at ``places`` (route, doc_id, start, n)."""
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("route", "start", "n")).alias("wanted"))
    if places.count() <= BROADCAST_PLACES:
        wanted = F.broadcast(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                words = words_of(step.column("text"))
                lists = step.column("wanted")
                each = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                own = np.repeat(np.arange(step.num_rows), each)
                start = flat.field("start").to_numpy()
                first = words.bounds[own] + start
                last = np.minimum(first + flat.field("n").to_numpy(), words.bounds[own + 1])
                codes = [words.codes[a:b].tobytes() for a, b in zip(first, last, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    flat.field("route"), step.column("doc_id").take(pa.array(own)), pa.array(start), pa.array(codes, pa.binary()),
                ], names=["route", "doc_id", "start", "codes"])

    return documents.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        read, "route long, doc_id long, start int, codes binary"
    )


def halves(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(route, segment, doc_id, start, n, codes, low, high): the windows of segments, parted by their offset before the minimiser.

    ``low`` to ``high`` are the offsets that a segment's windows may have, which its two parts halve. All windows of a part
    hold the same words about the minimiser, and equal windows have the same offset: those words are the part's route.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                own, low, high = np.frombuffer(row["codes"], np.uint64), row["low"], row["high"]
                sums = sequence_sums(own)
                spot = int(window_minima(sequence_codes(sums, np.arange(len(own) - gram + 1), gram), length - gram + 1)[1][0])
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = spot - min(b, spot), spot - max(a, spot + length - len(own))
                    if a > b or first > last:  # no offsets, or no windows
                        continue
                    shared = int(sequence_codes(sums, np.array([spot - a]), length - (b - a))[0])
                    n = last - first + length
                    route = (shared ^ (row["route"] & MASK) ^ ((a + 1) * 0x9E3779B97F4A7C15)) & MASK
                    code = int(sequence_codes(sums, np.array([first]), n)[0])
                    made.append((route, code, row["doc_id"], row["start"] + first, n, own[first : first + n].tobytes(), a, b))
            if made:
                route, code, *rest = zip(*made)
                signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (route, code)]
                yield pa.RecordBatch.from_arrays([*signed, *(pa.array(v, f.type) for v, f in zip(rest, HALVES[2:], strict=True))], schema=pa.schema(HALVES))

    return rows.mapInArrow(split, "route long, segment long, doc_id long, start int, n int, codes binary, low int, high int")


def shard_repeats(rows: DataFrame, find: Callable[[Shard], np.ndarray], length: int, shards: int) -> DataFrame:
    """(doc_id, start, stop) of runs of windows that start earlier elsewhere in their shard.

    ``find`` gives, for every word of a shard, whether a window starting there is such a repeat.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start"], kind="stable")
        codes = [np.frombuffer(c, np.uint64) for c in frame["codes"]]
        bounds = np.cumsum([0, *map(len, codes)])
        shard = Shard(np.concatenate(codes), bounds, frame["doc_id"].to_numpy(np.int64), frame["start"].to_numpy(np.int64))
        own, docs, places = shard.places()
        at = np.flatnonzero(find(shard))
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (own[at[1:]] != own[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first, len(at))[1:] - 1
        return pd.DataFrame({
            "doc_id": docs[at[first]], "start": places[at[first]].astype(np.int32), "stop": (places[at[last]] + length).astype(np.int32),
        })

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, start int, stop int")


def repeated_spans(documents: DataFrame, find: Callable[[Shard], np.ndarray], length: int, gram: int) -> DataFrame:
    """(doc_id, start, stop) of words covered by windows of ``length`` words that start earlier in the corpus.

    ``documents`` is (doc_id, text) without null ids. Spans may overlap.
    """
    rows = segment_rows(documents, length, gram)
    again = rows.groupBy("route").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("route")
    found = freeze(rows.join(again, "route", "left_semi"), "segments")
    copies, places = distinct_segments(found)
    spans, hot = copies, places.where(F.col("variants") > TOGETHER)
    rows = fetched(documents, places.where(F.col("variants") <= TOGETHER))
    words = places.where(F.col("variants") <= TOGETHER).agg(F.sum("n")).first()[0] or 0
    if hot.limit(1).count():
        parts = fetched(documents, hot).withColumns({"low": F.lit(0), "high": F.lit(length - gram)})
        while parts is not None:
            parts = freeze(halves(parts, length, gram), "halves")
            copies, places = distinct_segments(parts)
            spans = spans.unionByName(copies)
            first = parts.join(places.select("route", "segment", "doc_id", "start", "variants"), ["route", "segment", "doc_id", "start"])
            rows = rows.unionByName(first.where(F.col("variants") <= TOGETHER).select("route", "doc_id", "start", "codes"))
            words += places.where(F.col("variants") <= TOGETHER).agg(F.sum("n")).first()[0] or 0
            more = places.where(F.col("variants") > TOGETHER).limit(1).count()
            parts = first.where(F.col("variants") > TOGETHER).select("route", "doc_id", "start", "codes", "low", "high") if more else None
    return spans.unionByName(shard_repeats(rows, find, length, int(words // SHARD_WORDS) + 1))


def distinct_segments(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of all copies (doc_id, start, stop) but the first of each segment, and the first places where a route has several segments."""
    classes = found.groupBy("route", "segment").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("times"))
    classes = freeze(classes.select("route", "segment", "first.doc_id", "first.start", "n", "times"), "segment-classes")
    copied = classes.where("times > 1").select("route", "segment", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
    copies = found.join(copied, ["route", "segment"]).where("doc_id <> first_doc or start <> first_start")
    copies = copies.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop"))
    shared = freeze(classes.groupBy("route").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "shared-routes")
    return copies, freeze(classes.join(shared, "route").select("route", "segment", "doc_id", "start", "n", "variants"), "places")


def earlier(groups: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a member of the same group stands at an earlier place."""
    order = np.lexsort((places, docs, groups))
    fresh = np.ones(len(order), bool)
    fresh[1:] = groups[order[1:]] != groups[order[:-1]]
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    late = np.zeros(len(order), bool)
    late[order] = (docs[order] != docs[head]) | (places[order] != places[head])
    return late


def without_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words outside all spans, joined by one space."""
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if own.is_valid:
                    depth = np.zeros(len(words) + 1, np.int32)
                    at = own.values
                    np.add.at(depth, np.minimum(at.field("start").to_numpy(), len(words)), 1)
                    np.add.at(depth, np.minimum(at.field("stop").to_numpy(), len(words)), -1)
                    hit = np.cumsum(depth[:-1]) > 0
                    words = [words[i] for i in np.flatnonzero(~hit)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = documents.join(lists, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(documents: DataFrame, find: Callable[[Shard], np.ndarray], length: int, gram: int) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = freeze(repeated_spans(rows.where("doc_id is not null and text is not null"), find, length, gram), "spans")
    return without_spans(rows, spans)


__all__ = ["Shard", "earlier", "remove_repeats", "repeated_spans", "without_spans"]
