"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. Document rates start at 1 and
minimise the squared distance between expected domain token totals and their targets by projected gradient steps. The
distance is scaled by the inverse of the tokens that domains hold and share among the documents whose rate can still move,
so rare domains are pulled as fast as common ones and documents at the least rate don't slow the others. A pass tries
several step lengths at once and sums a handful of numbers for each: the gradient of a document follows from its posterior
and the errors of the few steps so far, so no rates are stored in between. The steps end when each domain is near its
target; targets that can't be met are reported with what is missing.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import freeze, steps
from .text_model import TextModel, best_temperature, fit_text_model, softmax, text_features

#: Labelled rows that the classifier may read.
FIT_ROWS = 20_000
#: Most passes, error of a domain's total as a share of its target, and passes without a better step that end the fit.
PASSES, TOLERANCE, PATIENCE = 60, 1e-3, 6
#: Step lengths that one pass tries, and the weight of the documents at the least rate in the scale of a step.
LENGTHS, HELD = (1 / 16, 1 / 4, 1.0, 4.0), 0.01
#: Share of labelled rows that only set the temperature of the posteriors.
CALIBRATION = 4


def posteriors(documents: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every document from ``labelled`` (doc_id, domain)."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = freeze(documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "domain-rows")
    weights = F.array(*[(F.col("domain") == d).cast("double") for d in domains])
    apart = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0
    model = fit_text_model(rows.where(~apart).withColumn("weights", weights), len(domains))
    index = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    held = rows.where(apart).select(index.alias("label"), "text")

    def score_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                scores = model.scores(text_features(step.column("text"))[0])
                yield pa.RecordBatch.from_arrays([step.column("label"), pa.array(scores.tolist(), pa.list_(pa.float64()))], names=["label", "scores"])

    sample = held.mapInArrow(score_held, "label int, scores array<double>").collect()  # at most fit_rows short rows
    if sample:
        model.temperature = best_temperature(np.array([r.scores for r in sample]), model.priors, np.array([r.label for r in sample]))
    return scored(documents, model)


def scored(documents: DataFrame, model: TextModel) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                counts, tokens = text_features(step.column("text"))
                p = softmax(model.scores(counts))
                yield pa.RecordBatch.from_arrays(
                    [step.column("doc_id"), step.column("key"), pa.array(tokens, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "key", "n_tokens", "posterior"],
                )

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(score, "doc_id long, key long, n_tokens long, posterior array<double>")


def rates_after(moves: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after a projected step for each row of scaled errors in ``moves``."""
    rate = np.full(len(p), max(1.0, least))
    for move in moves:
        rate = np.maximum(least, rate - p @ move)
    return rate


def fit_errors(rows: DataFrame, targets: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The steps of the best fit (scaled errors of the domain totals), and the totals that it reaches."""
    k = len(targets)
    width = k + 2 * k * k

    def tried(moves: np.ndarray, direction: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each step length: domain totals, tokens shared by domains in documents above the least rate, and in all."""
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(lengths), width))
            for batch in batches:
                n, p = batch.column("n_tokens").to_numpy(), batch.column("posterior").flatten().to_numpy().reshape(-1, k)
                rate, slope = rates_after(moves, p, least), p @ direction
                shared = (n[:, None] * p).T @ p
                for own, length in zip(total, lengths):
                    here = np.maximum(least, rate - length * slope)
                    free = here > least
                    own += np.concatenate([(n * here) @ p, ((n * free)[:, None] * p).T @ p, shared], axis=None)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["total"])

        each = rows.select("n_tokens", "posterior").mapInArrow(add, "total array<double>").select(F.posexplode("total").alias("at", "x"))
        sums = np.zeros(len(lengths) * width)
        for r in each.groupBy("at").agg(F.sum("x").alias("x")).collect():  # one row for each number of a pass
            sums[r["at"]] = r.x
        return [(own[:k], own[k : k + k * k].reshape(k, k), own[k + k * k :].reshape(k, k)) for own in sums.reshape(-1, width)]

    bound = np.maximum(targets, TOLERANCE * targets.sum())
    moves, direction, lengths = np.zeros((0, k)), np.zeros(k), np.ones(1)
    reached, lowest, idle = np.zeros(k), np.inf, 0
    for _ in range(PASSES if targets.sum() else 0):
        found = tried(moves, direction, lengths)
        left = [float(np.abs((now - targets) / bound).max()) for now, _, _ in found]
        best = int(np.argmin(left))
        if left[best] < lowest * (1 - TOLERANCE):
            if direction.any():
                moves = np.vstack([moves, lengths[best] * direction])
            lowest, idle, (reached, free, shared) = left[best], 0, found[best]
            direction = np.linalg.pinv(free + HELD * shared, rcond=1e-9, hermitian=True) @ (reached - targets)
            lengths = np.array(LENGTHS)
        else:
            idle, lengths = idle + 1, lengths / 200  # shorter than all that were tried
            if idle == 1:  # the plain scale, in which documents at the least rate may leave it
                direction, lengths = np.linalg.pinv(shared, rcond=1e-9, hermitian=True) @ (reached - targets), np.array(LENGTHS)
        if lowest < TOLERANCE or idle == PATIENCE:
            break
    return moves, reached


def mix(
    documents: DataFrame, labelled: DataFrame, targets: dict[str, float], growth: float = 1.0, least_rate: float = 0.0, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per document: doc_id, key, n_tokens, posterior, rate, copies.

    ``targets`` gives each domain's share of ``growth`` times all tokens (words between white space). ``posterior`` has
    the domains in sorted order. A warning names the totals if one misses its target by more than TOLERANCE. ``copies`` is the rate rounded down or up by a hash of the row, so that its expectation
    is the rate; ``key`` is the fingerprint of the text. Null and empty texts have no tokens and posteriors near the
    priors. A document with several domains counts as the first by name; unknown domains and null ids among the labels
    are ignored; without labels all posteriors are equal. Repeated rows get equal results; other columns are ignored; an
    empty table gives no rows.
    """
    domains = sorted(targets)
    rows = freeze(posteriors(documents, labelled, domains, fit_rows), "posteriors")
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shares = np.array([targets[d] for d in domains]) / sum(targets.values())
    aims = shares * tokens * growth
    moves, reached = fit_errors(rows, aims, least_rate)
    if (np.abs(reached - aims) > TOLERANCE * np.maximum(aims, TOLERANCE * aims.sum())).any():
        held = ", ".join(f"{d} {x:.0f} of {y:.0f}" for d, x, y in zip(domains, reached, aims, strict=True))
        warnings.warn(f"mixing misses its targets (tokens reached and wanted): {held}", stacklevel=2)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, len(domains))
            yield batch.append_column("rate", pa.array(rates_after(moves, p, least_rate)))

    rated = rows.mapInArrow(rate, "doc_id long, key long, n_tokens long, posterior array<double>, rate double")
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed_documents(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], growth: float, least_rate: float) -> DataFrame:
    """The rows of ``documents``, each as often as its copies say, all columns kept."""
    copies = mix(documents, labelled, targets, growth, least_rate).where("copies > 0")
    copies = copies.groupBy(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key")).agg(F.max("copies").alias("m_copies"))
    text = F.xxhash64(documents["text"])
    joined = documents.join(copies, documents["doc_id"].cast("long").eqNullSafe(F.col("m_id")) & (text == F.col("m_key")))
    return joined.withColumn("m_at", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select(*[joined[c] for c in documents.columns])
