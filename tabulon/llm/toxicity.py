"""Toxicity by a weighted finite-state grammar over clauses.

The insult lexicon is induced from labelled rows: word beginnings and whole words that toxic texts share and clean texts
don't, kept where their tail probability survives the number of candidates. Texts are scanned for the lexicon; only
clauses with a match go through the grammar, which marks insults and threats as targeted, negated or reported. The arc
weights of the grammar are learnt by a logistic regression held towards stated priors: a match counts with its evidence times
the weight of its path, and neither a negation nor reported speech ever raises a path's weight.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import freeze, steps, worker_state
from .transducers import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT, clause_grammar, match
from .words import mix, shingle_codes, words_of

#: Fixed word lists of the grammar.
TARGETS = "you your yours u he she they them him her us we du dich dir ihr euch sie tu te toi vous vos ton ta tes usted ustedes tú vosotros ellos".split()
NEGATIONS = "not no never nor neither without isn't aren't don't nicht kein keine nie ohne ne pas jamais sans nunca sin ni jamás".split()
REPORTS = "said says say told tells reported reports quoted quotes wrote claims claimed sagte sagt schrieb berichtet dit disait écrit rapporte dijo dice escribió informó".split()
THREATS = "kill hurt murder shoot stab strangle beat burn destroy töten umbringen schlagen verletzen tuer frapper blesser détruire matar golpear herir destruir".split()
INSULTS = "idiot idiots stupid moron morons loser losers scum trash garbage worthless pathetic disgusting clown fool imbecile dumb idiotisch dummkopf trottel abschaum wertlos ekelhaft erbärmlich imbécile crétin ordure minable dégoûtant basura estúpido imbécil escoria patético asqueroso".split()
#: Evidence of a listed insult before any label is seen; labels that speak against it take it out.
LISTED = 3.0
#: Texts that a piece has to stand in to be tested, and the share of them that has to be toxic.
LEAST_TEXTS, LEAST_SHARE = 4, 0.8
#: What the arc weights are before any label is seen; a path's weight is their sum, and nothing below zero.
PRIOR = {"insult": 1.0, "threat": 1.0, "target": 0.2, "negation": -0.8, "reported_speech": -0.6}
#: How firmly arc weights, slope and bias are held there; the insult's arc is the unit of all others.
HOLD = np.array([1e9, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])
#: Log-odds without a match, and what the logarithm of one and all weighted evidence adds, before any label is seen.
BIAS, SLOPE = -3.0, 2.0
#: Marks of a match: insult or threat, then targeted, negated, reported; and the arcs of each.
MARKS = [(kind, *(m for m, on in zip("tnr", bits) if on)) for kind in (INSULT, THREAT) for bits in itertools.product((0, 1), repeat=3)]
ARCS = np.array([[INSULT in m, THREAT in m, "t" in m, "n" in m, "r" in m] for m in MARKS], dtype=float)
PLACES = {frozenset(m): k for k, m in enumerate(MARKS)}
#: Labelled rows that the fit may read; the bound holds at every size.
FIT_ROWS = 20_000
STEM = range(3, 11)
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+(?:'[a-z]+)?")
CLAUSE_ENDS = ".!?;\n"
CLAUSE_END = re.compile(f"[{CLAUSE_ENDS}]")


@dataclass
class ToxicityModel:
    stems: dict[str, float]  # word beginning, or a whole word ended by "$", and its evidence
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = BIAS
    slope: float = SLOPE

    def score(self, evidence: float) -> float:
        """From the weighted evidence of all matches, 0 to 1."""
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + self.slope * math.log1p(evidence)))))


def pieces(text: str) -> set[str]:
    """Word beginnings and whole words (ended by "$") of a text."""
    out = set()
    for word in set(WORD.findall(text.lower())):
        out.add(word + "$")
        out.update(word[:k] for k in STEM if k < len(word))
    return out


def piece_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            (toxic if label else clean).update(pieces(text))
    rows = [(p, n, clean.get(p, 0)) for p, n in toxic.items()]
    for p, n in clean.items():
        if p not in toxic:
            rows.append((p, 0, n))
    for at in range(0, len(rows), 200_000):
        yield pd.DataFrame(rows[at : at + 200_000], columns=["piece", "toxic", "clean"])


MINIMA = ["least0", "least1", "least2"]


def shingle_minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest fingerprint of five words under three hashes."""
    for batch in batches:
        for step in steps(batch):
            words = words_of(step.column("text"), lower=True)
            owner, codes = shingle_codes(words, 5)
            for j, name in enumerate(MINIMA):
                least = np.full(step.num_rows, np.iinfo(np.int64).max)
                np.minimum.at(least, owner, mix(codes + np.uint64(j)).view(np.int64))
                step = step.append_column(name, pa.array(least))
            yield step


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row of each group of copies or near copies, so that no text votes twice: rows of one label that share two minima."""
    rows = rows.mapInArrow(shingle_minima, "doc_id long, text string, label int, " + ", ".join(f"{n} long" for n in MINIMA))
    for pair in itertools.combinations(MINIMA, 2):
        others = [n for n in MINIMA if n not in pair]
        rows = rows.groupBy("label", *pair).agg(F.min(F.struct("doc_id", "text", *others)).alias("r")).select("label", *pair, "r.*")
    return rows.select("doc_id", "text", "label")


def induce(rows: DataFrame) -> dict[str, float]:
    """Lexicon from rows (text, label)."""
    sizes = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    n_toxic, n = int(sizes[0] or 0), int(sizes[1])
    if not n_toxic or n_toxic == n:
        return {f"{w}$": LISTED for w in INSULTS}
    base = n_toxic / n
    counts = rows.mapInPandas(piece_counts, "piece string, toxic long, clean long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = freeze(counts, "pieces")
    tested = counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).count()
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # Chernoff bound on the binomial tail, times the number of pieces tested
    gain = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = (F.col("toxic") + F.col("clean")) * gain
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n - n_toxic + 1.0))
    strong = freeze(
        counts.where((share > base) & (share >= LEAST_SHARE)).where(evidence > math.log(2.0 * max(1, tested)))
        .select("piece", "toxic", odds.alias("odds")), "strong-pieces",
    )
    beginnings = lambda most: F.transform(F.sequence(F.lit(STEM[0]), F.greatest(F.lit(STEM[0]), most)), lambda k: F.substring("piece", F.lit(1), k))
    plain = F.least(F.lit(STEM[-1]), F.length(F.rtrim(F.col("piece"), F.lit("$"))))
    begun = strong.select("toxic", "piece", F.explode(F.array_distinct(beginnings(F.least(plain, F.length("piece") - 1)))).alias("start"))
    begun = begun.where("start <> piece")
    inside = begun.groupBy(F.col("start").alias("piece")).agg(F.max("toxic").alias("inside"))
    told = strong.join(inside, "piece", "left").where(F.coalesce("inside", F.lit(0)) < LEAST_SHARE * F.col("toxic"))  # else a longer piece says as much
    told = freeze(told.select("piece", "odds"), "told-pieces")
    covered = begun.join(told.select(F.col("piece").alias("start")), "start", "left_semi").select("piece")
    rows = told.join(covered, "piece", "left_anti").orderBy("piece").collect()  # none begins another; all from FIT_ROWS texts
    listed = {f"{w}$": (0, 0) for w in INSULTS} | {
        r.piece: (r.toxic, r.clean) for r in counts.where(F.col("piece").isin([f"{w}$" for w in INSULTS])).collect()
    }
    stems = {w: LISTED for w, (toxic, clean) in listed.items() if toxic >= clean}
    return stems | {r.piece: max(r.odds, stems.get(r.piece, 0.0)) for r in rows}


class Scanner:
    """Finds lexicon matches in a text and runs the grammar over their clauses."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.model, self.grammar = model, clause_grammar(model.weights)
        self.symbols = {w: s for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}
        self.automaton = ahocorasick.Automaton()
        for piece in [*model.stems, *(f"{w}$" for w in THREATS)]:
            self.automaton.add_word(piece.rstrip("$"), piece.rstrip("$"))
        self.automaton.make_automaton()

    def evidence(self, word: str) -> float:
        """Evidence of the word's entry in the lexicon, 0 without one."""
        stems = self.model.stems
        if (whole := stems.get(word + "$")) is not None:
            return whole
        return next((stems[word[:k]] for k in range(min(len(word), STEM[-1]), STEM[0] - 1, -1) if word[:k] in stems), 0.0)

    def clauses(self, text: str) -> list[tuple[str, list[tuple[int, str, float]], list[float]]]:
        """(clause, hits, evidence of each hit) of every clause with a match."""
        low = text.lower()
        found, done = [], 0
        for end, piece in self.automaton.iter(low):
            start = end - len(piece) + 1
            if start < done or (start and WORD.fullmatch(low[start - 1])):
                continue
            begin = max(done, max(low.rfind(c, done, start) for c in CLAUSE_ENDS) + 1)
            stop = CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            clause = low[begin:done]
            words = WORD.findall(clause)
            each = [self.evidence(w) for w in words]
            symbols = [INSULT if x else self.symbols.get(w, OTHER) for w, x in zip(words, each, strict=True)]
            if hits := match(self.grammar, symbols):
                found.append((clause, hits, [each[place] or 1.0 for place, _, _ in hits]))
        return found

    def total(self, text: str | None) -> tuple[float, int]:
        """Evidence of all matches times the weights of their paths, and the number of matched clauses."""
        clauses = self.clauses(text) if text else []
        return sum(x * max(0.0, weight) for _, hits, each in clauses for (_, _, weight), x in zip(hits, each, strict=True)), len(clauses)

    def features(self, text: str | None) -> list[float]:
        """Evidence by marks."""
        sums = [0.0] * len(MARKS)
        for _, hits, each in self.clauses(text) if text else []:
            for (_, marks, _), evidence in zip(hits, each, strict=True):
                sums[PLACES[frozenset(marks)]] += evidence
        return sums


def scanner(model: ToxicityModel) -> Scanner:
    """The worker's scanner of a model; automata are not pickled."""
    state, key = worker_state(), repr(sorted(model.stems.items())) + repr(model.weights)
    if state.get("scanner key") != key:
        state["scanner key"], state["scanner"] = key, Scanner(model)
    return state["scanner"]


def fit_weights(evidence: np.ndarray, y: np.ndarray) -> tuple[dict[str, float], float, float]:
    """Arc weights, slope and bias by projected Gauss-Newton steps, held towards the priors and on their side of zero."""
    prior = np.array([*PRIOR.values(), SLOPE, BIAS])
    signs = np.sign(prior[:-1])

    def held(beta: np.ndarray) -> np.ndarray:
        return np.append(np.where(beta[:-1] * signs < 0, 0.0, beta[:-1]), beta[-1])

    def state(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        path = ARCS @ beta[:5]
        total = evidence @ np.maximum(0.0, path)
        z = np.clip(beta[6] + beta[5] * np.log1p(total), -30, 30)
        slopes = (evidence @ (ARCS * (path > 0)[:, None])) * (beta[5] / (1 + total))[:, None]
        loss = np.logaddexp(0, z).sum() - (y * z).sum() + (HOLD * (beta - prior) ** 2).sum() / 2
        return float(loss), z, np.column_stack([slopes, np.log1p(total), np.ones(len(y))])

    beta = prior.copy()
    loss, z, slopes = state(beta)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z))
        step = np.linalg.solve((slopes * (p * (1 - p))[:, None]).T @ slopes + np.diag(HOLD), slopes.T @ (p - y) + HOLD * (beta - prior))
        for length in 0.5 ** np.arange(12):
            tried = held(beta - length * step)
            better = state(tried)
            if better[0] < loss:
                break
        if not better[0] < loss - 1e-9:
            break
        beta, (loss, z, slopes) = tried, better
    return dict(zip(PRIOR, map(float, beta[:5]), strict=True)), float(beta[5]), float(beta[6])


def training_rows(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """At most ``fit_rows`` labelled rows (doc_id, text, label), the first in the order of a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text is not null")
    return freeze(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxic-rows")


def fit_toxicity(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Lexicon and weights from ``labels`` (doc_id, toxic); pass only the labels that may be learnt from.

    Without labels, or with one class only, the listed insults and the priors stay. Of several labels of a document the
    highest holds.
    """
    rows = freeze(distinct_texts(training_rows(documents, labels, fit_rows)), "toxic-fit")
    model = ToxicityModel(induce(rows))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scanner(model)
        for batch in batches:
            yield pd.DataFrame({"x": [own.features(t) for t in batch["text"]], "y": batch["label"].astype(float)})

    sample = rows.mapInPandas(features, "x array<double>, y double").collect()  # at most fit_rows short rows
    if len({r.y for r in sample}) == 2:
        model.weights, model.slope, model.bias = fit_weights(np.array([r.x for r in sample]), np.array([r.y for r in sample]))
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """All rows and columns of ``documents`` with toxic_score (0 to 1) and toxic_clauses.

    Null and empty texts have no clauses and get the score of the bias alone. Columns of those two names are replaced;
    every other column, whatever its name, is passed on and never looked at; whole texts are read, whatever their length.
    """
    @F.pandas_udf("score double, clauses int")
    def score(texts: pd.Series) -> pd.DataFrame:
        own, rows = scanner(model), []
        for text in texts:
            evidence, n = own.total(text)
            rows.append((model.score(evidence), n))
        return pd.DataFrame(rows, columns=["score", "clauses"])

    clean = documents.drop("toxic_score", "toxic_clauses")
    scored = clean.withColumn("_toxicity", score(F.col(text_column)))
    return scored.withColumns({"toxic_score": F.col("_toxicity.score"), "toxic_clauses": F.col("_toxicity.clauses")}).drop("_toxicity")
