"""Document quality by co-training.

Two views of a document teach each other: what it says (hashed words and punctuation marks) and what its page says about it
(source, language, size and lines). Each round, the surest documents of either view, a share of all unlabelled ones per
class, become pseudo-labels of the other view. What the views learnt is kept only where their combined scores then rank labelled
rows that are kept apart better than before; the rounds end when neither view helps. Both views are calibrated on further
labelled rows and combined; every document gets a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tables import freeze, steps
from .text_model import FEATURES, TextModel, text_counts

#: Labelled rows that the fit may read.
FIT_ROWS = 20_000
#: A view labels documents of which it is this sure, the surest GROWTH of all unlabelled ones per class and round.
ROUNDS, SURE, GROWTH = 2, 0.95, 0.05
#: In the last round, the pseudo-labels of a class weigh together this share of its true ones.
PSEUDO = 0.5
CLASSES = 2
#: A text of any length has the evidence of this many words of its own.
WORDS = 16
#: Hashed places of page values.
PAGES = 1 << 14
#: Log-odds are ranked in steps of 1 / FINE, up to EDGE steps either way; counts are summed in whole parts of 1 / PARTS.
FINE, EDGE, PARTS = 64, 1 << 14, 1 << 16
#: Of the labelled rows, by hash: these eighths calibrate, these verify the rounds, the others teach.
CALIBRATE, VERIFY = (0, 1), (2, 3)


def page_places(text: Column, source: Column, lang: Column) -> Column:
    """The page's view as a few hashed values: where it is from, and its size and lines in powers of two."""
    body = F.coalesce(text, F.lit(""))
    size, lines = F.length(body), F.regexp_count(body, F.lit("\n")) + 1
    power = lambda x: F.floor(F.log2(x + 1)).cast("string")
    values = {
        "source": F.coalesce(source.cast("string"), F.lit("none")), "lang": F.coalesce(lang.cast("string"), F.lit("none")),
        "size": power(size), "lines": power(lines), "line": power(size / lines),
    }
    return F.array(*[F.pmod(F.xxhash64(F.lit(name), value), F.lit(PAGES)).cast("int") for name, value in values.items()])


def views(documents: DataFrame) -> DataFrame:
    """(doc_id, text, page); source and lang count as unknown where the table has no such column."""
    of = lambda name: F.col(name) if name in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", page_places(F.col("text"), of("source"), of("lang")).alias("page"))


@dataclass
class Counts:
    """Occurrences of a view's features and number of documents, by class."""

    features: np.ndarray
    documents: np.ndarray

    def plus(self, other: Counts, shares: np.ndarray) -> Counts:
        return Counts(self.features + other.features * shares[:, None], self.documents + other.documents * shares)

    def text_model(self, smoothing: float = 0.5) -> TextModel:
        total = self.features + smoothing
        return TextModel(np.log(total / total.sum(axis=1, keepdims=True)), np.log((self.documents + 1) / (self.documents.sum() + CLASSES)))

    def page_model(self) -> PageModel:
        odds = np.log(self.features + 1) - np.log(self.documents + 2)[:, None]
        seen = self.features.sum(axis=0) > 0  # a value without a label says nothing
        return PageModel(np.where(seen, odds[1] - odds[0], 0.0), float(np.log((self.documents[1] + 1) / (self.documents[0] + 1))))


@dataclass
class PageModel:
    """Log-odds of each page value and of the class."""

    values: np.ndarray
    prior: float


def step_odds(step: pa.RecordBatch, text: TextModel, page: PageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words, places of page values, and the log-odds of either view, that of a text at its mean evidence by word."""
    counts = text_counts(step.column("text"))
    places = np.array(step.column("page").to_pylist(), dtype=np.int64).reshape(step.num_rows, -1)
    said = WORDS * (counts @ (text.features[1] - text.features[0])) / np.maximum(1.0, counts.sum(axis=1))
    return counts, places, said, page.prior + page.values[places].sum(axis=1)


def odds_of(rows: DataFrame, text: TextModel, page: PageModel, keep: list[str]) -> DataFrame:
    """The kept columns and the log-odds of either view: text_odds, page_odds."""
    schema = rows.select(*keep).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                _, _, said, placed = step_odds(step, text, page)
                yield pa.RecordBatch.from_arrays([*[step.column(c) for c in keep], pa.array(said), pa.array(placed)], names=[*keep, "text_odds", "page_odds"])

    wide = rows.select(*dict.fromkeys([*keep, "text", "page"]))
    return wide.mapInArrow(score, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, text_odds double, page_odds double")


def count_views(rows: DataFrame, classes: Callable[[pa.RecordBatch], tuple]) -> tuple[Counts, Counts]:
    """Counts of the text view and of the page view over all rows.

    ``classes`` gives a step's (word counts, page places, class for the text view, class for the page view); a row of class
    -1 doesn't count. Sums are of whole numbers, so that the order of tasks changes nothing.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, FEATURES + 1 + PAGES + 1), np.int64)
        for batch in batches:
            for step in steps(batch):
                counts, places, for_text, for_page = classes(step)
                for k in range(CLASSES):
                    mine = counts[for_text == k].astype(np.float64)
                    # a long text says no more about its class than several short ones
                    mine *= PARTS / np.sqrt(np.maximum(1.0, mine.sum(axis=1, keepdims=True)))
                    total[k, :FEATURES] += np.rint(mine, out=mine).sum(axis=0).astype(np.int64)
                    total[k, FEATURES] += PARTS * len(mine)
                    own = places[for_page == k]
                    total[k, FEATURES + 1 : -1] += PARTS * np.bincount(own.ravel(), minlength=PAGES)
                    total[k, -1] += PARTS * len(own)
        k, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(place, pa.int64()), pa.array(total[k, place])], names=["k", "place", "total"])

    sums = rows.mapInArrow(count, "k long, place long, total long").groupBy("k", "place").agg(F.sum("total").alias("total"))
    total = np.zeros((CLASSES, FEATURES + 1 + PAGES + 1))
    for row in sums.collect():  # one row for each class and feature at most
        total[row.k, row.place] = row.total / PARTS
    return Counts(total[:, :FEATURES], total[:, FEATURES]), Counts(total[:, FEATURES + 1 : -1], total[:, -1])


def ranks(odds: list[np.ndarray], calibration: list[np.ndarray]) -> list[np.ndarray]:
    """How sure either view is of each document: its calibrated log-odds in steps, 0 below SURE."""
    found = []
    for own, (weight, bias) in zip(odds, calibration, strict=True):
        own = own * max(0.0, weight) + bias
        found.append(np.clip(np.rint(np.where(np.abs(own) >= np.log(SURE / (1 - SURE)), own, 0.0) * FINE), -EDGE, EDGE).astype(np.int64))
    return found


def surest(pool: DataFrame, text: TextModel, page: PageModel, calibration: list[np.ndarray], growth: float) -> list[tuple[int, int]]:
    """For the text view and the page view: the rank down to which documents count as bad, and that from which as good."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 2 * EDGE + 1), np.int64)
        for batch in batches:
            for step in steps(batch):
                for view, own in enumerate(ranks(step_odds(step, text, page)[2:], calibration)):
                    found[view] += np.bincount(own + EDGE, minlength=2 * EDGE + 1)
        view, rank = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(view, pa.int64()), pa.array(rank - EDGE, pa.int64()), pa.array(found[view, rank])], names=["view", "rank", "n"])

    held = np.zeros((2, 2 * EDGE + 1))
    for row in pool.mapInArrow(count, "view long, rank long, n long").groupBy("view", "rank").agg(F.sum("n").alias("n")).collect():
        held[row.view, row.rank + EDGE] = row.n
    limits = []
    for own in held:
        wanted = growth * own.sum()  # the rank at which the share is reached goes in whole
        bad, good = np.searchsorted(np.cumsum(own), wanted) - EDGE, EDGE - np.searchsorted(np.cumsum(own[::-1]), wanted)
        limits.append((min(int(bad), -1), max(int(good), 1)))
    return limits


def area(odds: np.ndarray, good: np.ndarray) -> float:
    """Share of the pairs of a good and a bad row that are in order; ties count half."""
    _, place, n = np.unique(odds, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    n_good, n_bad = int(good.sum()), int((~good).sum())
    return float((rank[good].sum() - n_good * (n_good + 1) / 2) / (n_good * n_bad)) if n_good and n_bad else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias."""
    x, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (p - y) + ridge * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def collected(rows: DataFrame, text: TextModel, page: PageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of both views, labels, which rows verify) of labelled rows in the order of their ids, at most FIT_ROWS."""
    found = sorted(odds_of(rows, text, page, ["doc_id", "label", "verifies"]).collect())
    odds = np.array([[r.text_odds, r.page_odds] for r in found]).reshape(-1, 2)
    return odds, np.array([r.label > 0 for r in found], dtype=bool), np.array([r.verifies for r in found], dtype=bool)


@dataclass
class Combination:
    """Weight and bias that calibrate each view, and two weights and a bias that combine them."""

    each: list[np.ndarray]
    both: np.ndarray

    @staticmethod
    def fit(odds: np.ndarray, good: np.ndarray, prior: float) -> Combination:
        if good.all() or not good.any():
            return Combination([np.array([0.0, prior])] * 2, np.array([0.0, 0.0, prior]))
        y = good.astype(float)
        each = [logistic(odds[:, [k]], y) for k in range(2)]
        return Combination(each, logistic(np.column_stack([odds[:, k] * each[k][0] + each[k][1] for k in range(2)]), y))

    def calibrated(self, text_odds, page_odds) -> list:
        return [x * float(w[0]) + float(w[1]) for x, w in zip((text_odds, page_odds), self.each, strict=True)]

    def total(self, text_odds, page_odds):
        said, placed = self.calibrated(text_odds, page_odds)
        return said * float(self.both[0]) + placed * float(self.both[1]) + float(self.both[2])


def verified(odds: np.ndarray, good: np.ndarray, verifies: np.ndarray) -> float:
    """How well the combination that the calibrating rows give ranks the verifying rows."""
    combination = Combination.fit(odds[~verifies], good[~verifies], 0.0)
    return area(combination.total(*odds[verifies].T), good[verifies])


def co_train(taught: DataFrame, apart: DataFrame, pool: DataFrame, rounds: int) -> tuple[TextModel, PageModel, Combination]:
    """Models of both views and their combination; ``taught`` and ``apart`` have a label, ``pool`` has none."""
    def true_classes(step: pa.RecordBatch) -> tuple:
        label = np.array(step.column("label").to_pylist(), dtype=np.int64)
        return text_counts(step.column("text")), np.array(step.column("page").to_pylist(), dtype=np.int64).reshape(len(label), -1), label, label

    true = count_views(taught, true_classes)
    models = [true[0].text_model(), true[1].page_model()]
    odds, good, verifies = collected(apart, *models)
    best = verified(odds, good, verifies)
    if not (true[0].documents > 0).all() or not best:
        rounds = 0
    for done in range(1, rounds + 1):
        calibration = Combination.fit(odds[~verifies], good[~verifies], 0.0).each
        limits = surest(pool, *models, calibration, GROWTH * done)

        def told_classes(step: pa.RecordBatch, models=tuple(models), calibration=calibration, limits=limits) -> tuple:
            counts, places, *odds = step_odds(step, *models)
            said, placed = (np.where(own <= low, 0, np.where(own >= high, 1, -1)) for own, (low, high) in zip(ranks(odds, calibration), limits, strict=True))
            return counts, places, placed, said  # each view learns from the other

        more = []
        for mine, told in zip(true, count_views(pool, told_classes), strict=True):
            allowed = PSEUDO * done / rounds * mine.documents
            more.append(mine.plus(told, np.minimum(1.0, allowed / np.maximum(1.0, told.documents))))
        tried = [more[0].text_model(), more[1].page_model()]
        new, _, _ = collected(apart, *tried)
        # either view alone may have learnt something, or both
        choices = [(True, True), (True, False), (False, True)]
        mixed = [np.column_stack([(new if take else odds)[:, k] for k, take in enumerate(choice)]) for choice in choices]
        gains = [verified(x, good, verifies) for x in mixed]
        at = int(np.argmax(gains))
        if gains[at] <= best:
            break
        models, odds, best = [new_one if take else old for new_one, old, take in zip(tried, models, choices[at], strict=True)], mixed[at], gains[at]
    return *models, Combination.fit(odds[~verifies], good[~verifies], models[1].prior)


def quality_scores(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, text_odds, page_odds (calibrated log-odds of either view), score (0 to 1).

    ``labels`` (doc_id, quality) holds the rows to learn from; of several labels of a document the lowest counts. The fit
    reads at most ``fit_rows`` labelled rows, the first by a hash of doc_id; all other documents, also those without an id,
    are the unlabelled ones that the views label for each other. Every document is scored on its whole text, however long;
    texts beyond a step's bytes are taken one at a time. Null and empty texts have no evidence of words; missing metadata is
    a value of its own; without labels, or with one class only, all scores follow the smoothed share of good labels. Repeated
    rows get equal results; further columns are ignored; an empty table gives no rows.
    """
    rows = views(documents)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("label"))
    chosen = freeze(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "quality-labels")
    fit = freeze(rows.join(F.broadcast(chosen), "doc_id"), "quality-rows")
    pool = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("text", "page")
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(8))
    apart = fit.where(part.isin(*CALIBRATE, *VERIFY)).withColumn("verifies", part.isin(*VERIFY))
    text, page, combination = co_train(fit.where(~part.isin(*CALIBRATE, *VERIFY)), apart, pool, rounds)
    odds = odds_of(rows, text, page, ["doc_id"])
    said, placed = combination.calibrated(F.col("text_odds"), F.col("page_odds"))
    total = combination.total(F.col("text_odds"), F.col("page_odds"))
    bounded = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))
    return odds.select("doc_id", said.alias("text_odds"), placed.alias("page_odds"), (1 / (1 + F.exp(-bounded))).alias("score"))
