"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item window is a set of shingles, each at a fixed offset, and a document holds the window only if it holds all of them.
So the window's rarest shingle is a necessary prefix of length one. The join runs in three steps:

1. The documents' shingles meet the benchmark's shingles; what is left of the corpus is its occurrences of benchmark
   shingles, written once.
2. Shingles are ordered by their number of occurrences. Windows with a shingle that never occurs are dropped, all others
   are joined by their rarest shingle alone. The offset gives the only possible start, which has to fit into the document.
3. A candidate is confirmed when every other shingle of the window stands at its place.

Shingles are compared by 64-bit codes. Nothing is shuffled but occurrences of benchmark shingles and one narrow row for
each document; both sides of every shuffle are keyed by document or by (document, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import freeze

SHINGLE = 3
#: A benchmark with more shingle rows than this is joined by shuffle instead of broadcast (about 32 bytes a row).
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case A-Z, then runs of digits, letters a-z and non-ASCII characters; null has none."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(split, lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Codes of all runs of ``size`` words."""
    def code(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(size)])

    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, code)


def item_windows(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """Distinct windows (window_id, length, offset, code) exploded to shingles, with the items of each window."""
    items = benchmark.select(F.col(id_column).alias("item"), words_of(F.col(text_column)).alias("words"))
    length = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    cut = (
        items.where(F.col("item").isNotNull() & (F.size("words") > 0))
        .select("item", "words", length.alias("length"), F.explode(starts).alias("at"))
        .select("item", F.expr("slice(words, at, length)").alias("words"))
    )
    return freeze(
        cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.concat_ws(" ", "words").alias("window_id"), "words", F.size("words").alias("length"), "items"),
        "windows",
    )


def documents_keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Identical rows share a key; rows of one id with different texts don't."""
    return documents.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("key"), F.col(text_column).alias("text"))


def occurrences(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """Every occurrence of an item window in a document: id, key, start (from 0), length, items."""
    windows = item_windows(benchmark, window, item_column, text_column)
    size = F.least(F.lit(SHINGLE), F.col("length"))
    parts = []
    sizes = [r[0] for r in windows.select(size.alias("k")).distinct().collect()]  # at most SHINGLE values
    for k in sizes:
        parts.append(
            windows.where(size == k).select("window_id", "length", F.posexplode(shingles(F.col("words"), k)).alias("offset", "code"))
            .withColumn("k", F.lit(k))
        )
    keyed = documents_keyed(documents, id_column, text_column)
    if not parts:
        return keyed.limit(0).select("id", "key", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(None).cast(windows.schema["items"].dataType).alias("items"))
    needed = parts[0]
    for part in parts[1:]:
        needed = needed.unionByName(part)
    needed = freeze(needed, "window-shingles")
    small = needed.count() <= BROADCAST_ROWS
    sized = F.broadcast if small else (lambda df: df)

    found = None
    split = keyed.select("id", "key", words_of(F.col("text")).alias("words"))
    for k in sizes:
        wanted = sized(needed.where(F.col("k") == k).select("code").distinct())
        at = split.select("id", "key", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"), k)).alias("at", "code"))
        at = at.join(wanted, "code", "left_semi").withColumn("k", F.lit(k))
        found = at if found is None else found.unionByName(at)
    found = freeze(found, "shingle-occurrences")

    counts = found.groupBy("code", "k").agg(F.count(F.lit(1)).alias("n_found"))
    ranked = needed.join(sized(counts), ["code", "k"], "left")
    prefix = ranked.groupBy("window_id", "length", "k").agg(
        F.min(F.struct(F.coalesce("n_found", F.lit(0)).alias("n_found"), F.col("offset"), F.col("code"))).alias("rarest"),
        F.sort_array(F.collect_list(F.struct("offset", "code"))).alias("shingles"),
    )
    prefix = freeze(prefix.where("rarest.n_found > 0").select(
        "window_id", "length", "k", F.col("rarest.offset").alias("offset"), F.col("rarest.code").alias("code"), "shingles",
    ), "window-prefixes")
    candidates = (
        found.join(sized(prefix), ["code", "k"])
        .withColumn("start", F.col("at") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
        .select("id", "key", "start", "length", "window_id", "k", F.explode("shingles").alias("s"))
        .select("id", "key", "start", "length", "window_id", "k", (F.col("start") + F.col("s.offset")).alias("at"), F.col("s.code").alias("code"))
    )
    places = found.select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), F.col("at").alias("f_at"), F.col("code").alias("f_code"), F.col("k").alias("f_k")).distinct()
    confirmed = (
        candidates.distinct().join(
            places, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key").eqNullSafe(F.col("f_key"))) & (F.col("at") == F.col("f_at"))
            & (F.col("code") == F.col("f_code")) & (F.col("k") == F.col("f_k")), "left_semi",
        )
        .groupBy("id", "key", "start", "length", "window_id", "k").agg(F.count(F.lit(1)).alias("met"))
        .where(F.col("met") == F.col("length") - F.col("k") + 1)
    )
    return confirmed.join(sized(windows.select("window_id", "items")), "window_id").select("id", "key", "start", "length", "items")


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: id, key, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    A window is ``window`` consecutive words of an item; a shorter item is one window, an item without words none. A word
    inside any occurrence of a window is hit. Null and empty texts have no words and are never contaminated; rows with a
    null id keep their row; repeated rows get the same result each; items with a null id are ignored; equal items all
    count. Empty tables: no rows, or no hits. Other columns are ignored.
    """
    hits = freeze(occurrences(documents, benchmark, window, id_column, item_column, text_column), "hits")
    words = (
        hits.select("id", "key", F.explode(F.expr("sequence(start, start + length - 1)")).alias("at")).distinct()
        .groupBy("id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    items = (
        hits.select("id", "key", F.explode("items").alias("item")).distinct()
        .groupBy("id", "key").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    )
    per_document = words.join(items, words["id"].eqNullSafe(items["id"]) & words["key"].eqNullSafe(items["key"])).select(
        words["id"].alias("h_id"), words["key"].alias("h_key"), "n_hit", "items"
    )
    count = F.regexp_count(F.col("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    every = documents_keyed(documents, id_column, text_column).select("id", "key", F.coalesce(count, F.lit(0)).cast("long").alias("n_words"))
    joined = every.join(per_document, F.col("id").eqNullSafe(F.col("h_id")) & F.col("key").eqNullSafe(F.col("h_key")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(id_column), "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``documents`` that hold no window of the benchmark, all columns kept."""
    hits = freeze(occurrences(documents, benchmark, window), "hits").select("id", "key").distinct()
    text = F.xxhash64(documents["text"])
    return documents.join(hits, documents["doc_id"].eqNullSafe(hits["id"]) & (text == hits["key"]), "left_anti")
