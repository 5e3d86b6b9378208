"""One registered query per operator, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .decontaminate import decontaminate
from .divergence import source_divergence
from .fm_index import substring_dedup
from .hard_negatives import hard_negatives
from .line_dedup import line_dedup
from .mixing import mix
from .near_duplicates import near_duplicates
from .quality import quality_scores
from .suffix_array import suffix_array_dedup
from .tables import small_batches, table
from .token_counts import token_counts
from .tokens import tokenize_documents
from .topk import exact_topk
from .toxicity import ToxicityModel, fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP7_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op7_exact_topk", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM benchmark
), bs AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 8))) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM bs),
ns AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM ds),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.x = bw.x),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def public_tokenizer(name: str) -> str:
    """Path of a vocabulary file of the installed collection."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op6_token_output")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    held = tokenize_documents(table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=2)
    return held.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, folder: str) -> ToxicityModel:
    return fit_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels").where(~held_out(F.col("doc_id"))))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_toxicity(table(spark, folder, "documents").select("doc_id", "text"), toxicity_model(spark, folder))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op4_near_duplicates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=5, percent=85)


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (SELECT doc_id, unnest(range(1, len(w) - {window} + 2)) AS s, w FROM w WHERE len(w) >= {window}),
k AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + {window} - 1], ' ')) AS x FROM g),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS o FROM k),
hit AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(s, s + {window})) AS p FROM r WHERE o > 1) GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w) AS n, array_to_string(list_filter(w, lambda x, i: p IS NULL OR NOT list_contains(p, i)), ' ') AS t,
    coalesce(len(p), 0) AS m
  FROM w LEFT JOIN hit USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(t) AS kept_sha256 FROM kept
"""


def kept_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op1_suffix_array_dedup", OP2_SQL.replace("{window}", "50"))
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return kept_digest(suffix_array_dedup(table(spark, folder, "documents"), window=50))


@query("op2_substring_dedup", OP2_SQL.replace("{window}", "20"))
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return kept_digest(substring_dedup(table(spark, folder, "documents"), window=20))


@query("op5_line_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


#: Shares of all tokens by domain, and the domain of a labelled document.
TARGETS = {"high": 0.8, "low": 0.15, "toxic": 0.05}


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return table(spark, folder, "labels").select("doc_id", domain.alias("domain"))


@query("op10_mixing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), domain_labels(spark, folder), TARGETS)
    shares = [F.round(F.col("posterior")[i], 6).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return mixed.select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").where(~held_out(F.col("doc_id")))
    scored = quality_scores(table(spark, folder, "documents"), labels)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round("text_odds", 6).alias("text_odds"), F.round("page_odds", 6).alias("page_odds"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op11_token_counts")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizer("piece_bpe_32k.model"), limit=4096)


OP12_SQL = """
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
  SELECT a.id AS anchor_id, c.id AS other, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good a JOIN good c ON a.id <> c.id WHERE a.id % 100 = 0
), friends AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), met AS (
  SELECT f.*, other AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY f.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM friends f JOIN scored s ON s.anchor_id = f.anchor_id AND NOT same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (
  SELECT s.lang, s.source, coalesce(sum(c.n), 0) AS n FROM s LEFT JOIN (c SEMI JOIN k USING (lang, term)) c ON c.lang = s.lang AND c.source = s.source GROUP BY ALL
), x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS BIGINT) AS p,
    1 + CAST(1000000000 * (k.n + 1) // (v.n + v.v) AS BIGINT) AS lang_p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - lang_p) * (p - lang_p) // lang_p AS BIGINT) AS value FROM x WHERE n > 0 AND p > lang_p
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""


@query("op13_source_divergence", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"), least_documents=3, top=200)
