"""Token files, exact search, classifiers, mixing and the pipeline."""

import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import mixing as mixing_module, quality, toxicity
from tabulon.llm.mixing import mix, mixed_documents
from tabulon.llm.near_duplicates import near_duplicates
from tabulon.llm.quality import quality_scores
from tabulon.llm.queries import QUERIES
from tabulon.llm.simple8b import pack_block, read_ids, unpack
from tabulon.llm.text_model import FEATURES, TextModel
from tabulon.llm.tokens import ChunkEncoder, tokenize_documents
from tabulon.llm.topk import exact_topk
from tabulon.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity, Scanner
from tabulon.llm.transducers import clause_grammar, match


@pytest.mark.parametrize("n", [0, 1, 241, 70_000])
@pytest.mark.parametrize("most", [1, 2, 300, 49_408, 2**59, 2**60, 2**64 - 1])
def test_simple8b_round_trip(n, most):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, most, n, dtype=np.uint64) if most > 1 else np.zeros(n, np.uint64)
    ids[::97] = most - 1
    words, offsets = pack_block(ids)
    assert (unpack(words) == ids).all() and len(unpack(words)) == n
    assert (read_ids(words, offsets, n // 3, n - n // 4) == ids[n // 3 : n - n // 4]).all()


def test_token_files(documents, nothing, texts):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, start = Tokenizer.from_file(path), 0
    rows = sorted(tokenize_documents(documents, path).collect(), key=lambda r: r.start)
    order = [None, *sorted([*texts, 3])]
    assert [r.doc_id for r in rows] == order
    for r in rows:
        text = texts[3 if r.doc_id is None else r.doc_id]
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens) == (start, len(ids)) and zlib.crc32(r.ids) == zlib.crc32(ids.tobytes())
        start += len(ids)
    assert tokenize_documents(nothing, path).collect() == []


def test_letters_encode_as_the_library_does():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    coder = ChunkEncoder(path)
    assert coder.plain
    coder.encode([" ".join(f"{a}{b}{c}" for a in "bdfgklmnprstvz" for b in "aeiouy" for c in ("", *"bcdfghjklmnpqrstvwxyz!,.;:?)"))])
    assert len(coder.known) > 2000
    words = [f"{chr(c)}liyev {chr(c)}we, a{chr(c)}a {chr(c)}" for c in range(0xA1, 0x250)]
    for text, ids in zip(words, coder.encode(words), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=6).tolist() for i in range(700)}
    vectors |= {i: vectors[5] for i in range(700, 900)}  # ties
    rows = [*vectors.items(), (900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, []), (904, [1e300] * 6), (None, [1.0] * 6), (3, vectors[3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    found = exact_topk(frame.where("vec_id % 50 = 0 and vec_id < 900"), frame.where("vec_id <> 904"), 5).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors.items()}
    expected = []
    for q in range(0, 900, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == expected
    assert exact_topk(frame.limit(0), frame, 5).collect() == []
    few = exact_topk(frame.where("vec_id in (1, 903)"), frame.where("vec_id in (1, 2, 903, 904)"), 5).collect()
    assert [(r.query_id, r.vec_id) for r in few if r.query_id == 1 and r.vec_id == 2] and not [r for r in few if r.query_id == 903]


def test_clause_grammar():
    grammar = clause_grammar({"insult": 1.0, "threat": 2.0, "target": 0.5, "negation": -3.0, "reported_speech": -1.0})
    assert match(grammar, list("oIo")) == [(1, "I", 1.0)]
    assert match(grammar, list("YI")) == [(1, "It", 1.5)]
    assert match(grammar, list("YNI")) == [(2, "Int", -1.5)]
    assert match(grammar, list("RoI")) == [(2, "Ir", 0.0)]
    assert match(grammar, list("Too")) == []
    assert match(grammar, list("ToY")) == [(2, "Tt", 2.5)]
    assert match(grammar, list("NToY")) == [(3, "Tnt", -0.5)] and match(grammar, list("RTooooY")) == []


def test_toxicity(spark, documents, nothing, texts):
    rng = np.random.default_rng(2)
    bad = {i: f"{' '.join(texts[i % 20].split()[: int(rng.integers(5, 25))])} {('zorkelan', 'zorkelum', 'zorkelit')[i % 3]} you." for i in range(100, 140)}
    frame = documents.unionByName(spark.createDataFrame([*bad.items()], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(20), *range(100, 130)]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(frame, labels)
    assert any(piece.startswith("zorkel") for piece in model.stems)
    rows = score_toxicity(frame, model).collect()
    assert len(rows) == len(texts) + 2 + 40 and all(0 <= r.toxic_score <= 1 for r in rows)
    assert all((r.toxic_score >= 0.5) == ((r.doc_id or 0) >= 100) for r in rows)
    assert score_toxicity(nothing, model).collect() == []
    unlearnt = fit_toxicity(documents, labels.limit(0))
    assert unlearnt.weights == ToxicityModel({}).weights and len(Scanner(unlearnt).clauses("You are a moron. Fine, you idiot!")) == 2


def test_path_weights_score_clauses():
    rng = np.random.default_rng(6)
    evidence = np.zeros((600, len(toxicity.MARKS)))
    evidence[np.arange(600), rng.integers(0, len(toxicity.MARKS), 600)] = rng.gamma(2.0, 2.0, 600)
    for strange in (False, True):  # labels that call negated insults toxic, too, must not raise them
        real = np.array([1.0, 1.5, 0.5, 0.4 if strange else -0.9, -0.7])
        z = 3 * np.log1p(evidence @ np.maximum(0, toxicity.ARCS @ real)) - 4
        weights, slope, bias = toxicity.fit_weights(evidence, (rng.random(600) < 1 / (1 + np.exp(-z))).astype(float))
        assert abs(weights["insult"] - 1) < 1e-3 and weights["negation"] <= 0 and weights["reported_speech"] <= 0 and slope > 0
        if not strange:
            assert weights["negation"] < -0.3 and weights["reported_speech"] < -0.3 and weights["target"] > 0
        own = Scanner(ToxicityModel({"idiot$": 3.0}, weights, bias, slope))
        plain, *weaker = (own.total(t)[0] for t in ("You are an idiot.", "You are not an idiot.", "He said you are an idiot.", "You will kill it."))
        assert plain > 0 and all(w <= plain for w in weaker[:2])
        assert own.total("Never kill you.")[0] <= own.total("I kill you.")[0] and own.total("")[0] == own.total(None)[0] == 0


def test_clauses_of_long_texts_are_cut_once():
    own = Scanner(ToxicityModel({"idiot": 3.0}))
    for text, clauses in (("an idiot, " * 30_000, 1), ("an idiot. " * 30_000, 30_000), ("plain words " * 30_000 + "idiots! idiot", 2)):
        start = time.perf_counter()
        assert len(own.clauses(text)) == clauses
        assert time.perf_counter() - start < 10  # a search for each end from each match takes minutes
    assert [c for c, _, _ in own.clauses("Fine; you idiot.idiot\nno IDIOTS here")] == [" you idiot", "idiot", "no idiots here"]


def test_quality(spark, documents, nothing, texts):
    rng = np.random.default_rng(3)
    junk = {i: "### ".join(texts[i % 20].split()[: int(rng.integers(20, 60))]) + "$$$" for i in range(200, 260)}
    good = {i: " ".join(rng.permutation(texts[i % 20].split())) for i in range(300, 360)}
    frame = documents.unionByName(spark.createDataFrame([*junk.items(), *good.items()], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in [*range(200, 240), *range(300, 340)]] + [(None, 0)], "doc_id long, quality int")
    rows = quality_scores(frame, labels, rounds=2).collect()
    assert len(rows) == len(texts) + 122 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and (240 <= r.doc_id < 260 or r.doc_id >= 340)]
    assert np.mean([(r.score >= 0.5) == (r.doc_id >= 300) for r in held]) >= 0.95
    assert quality_scores(nothing, labels).collect() == []
    assert quality_scores(documents, labels.limit(0)).count() == len(texts) + 2
    none = {r.doc_id: r.score for r in quality_scores(frame, labels, rounds=0).collect() if r.doc_id is not None}
    order = lambda scores: quality.area(np.array([scores[r.doc_id] for r in held]), np.array([r.doc_id >= 300 for r in held]))
    assert order({r.doc_id: r.score for r in held}) >= order(none)


def test_views_learn_from_all_unlabelled_documents(spark, documents):
    rows = quality.views(documents).select("text", "page")
    rng = np.random.default_rng(4)
    text = TextModel(rng.normal(size=(2, FEATURES)), np.zeros(2))
    page = quality.PageModel(rng.normal(size=quality.PAGES), 0.1)
    calibration = [np.array([2.0, 0.0]), np.array([3.0, 0.1])]
    whole = pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()], pa.schema([("text", pa.string()), ("page", pa.list_(pa.int32()))]))
    counts, places, *odds = quality.step_odds(whole, text, page)
    own = quality.ranks(odds, calibration)
    limits = quality.surest(rows, text, page, calibration, 0.2)
    for (low, high), held in zip(limits, own, strict=True):
        assert low <= -1 and high >= 1
        for inside, further in ((held <= low, held < low), (held >= high, held > high)):
            assert further.sum() < 0.2 * len(held)  # the last rank goes in whole
        for sign, inside in ((-1, held <= low), (1, held >= high)):
            assert inside.sum() >= 0.2 * len(held) or (inside == (held * sign > 0)).all()  # all sure ones, where they are few
    told = lambda step: (*quality.step_odds(step, text, page)[:2], *[(o > 0).astype(int) for o in quality.step_odds(step, text, page)[2:]])
    said, placed = quality.count_views(rows, told)
    for k in range(2):
        mine = counts[(odds[0] > 0) == k].astype(float)
        mine /= np.sqrt(np.maximum(1, mine.sum(axis=1, keepdims=True)))
        assert np.allclose(said.features[k], mine.sum(axis=0), atol=1e-3) and said.documents[k] == len(mine)
        assert (placed.features[k] == np.bincount(places[(odds[1] > 0) == k].ravel(), minlength=quality.PAGES)).all()
    assert said.documents.sum() == placed.documents.sum() == rows.count()


def test_area_counts_ordered_pairs():
    rng = np.random.default_rng(5)
    odds, good = rng.integers(0, 9, 60).astype(float), rng.random(60) < 0.4
    pairs = [(a > b) + 0.5 * (a == b) for a in odds[good] for b in odds[~good]]
    assert abs(quality.area(odds, good) - np.mean(pairs)) < 1e-12 and quality.area(odds, good | True) == 0.0


def test_mixing(spark, documents, nothing, texts):
    more = {i: f"{texts[i % 20]} {' '.join(texts[i % 7].split()[i % 5 : 9])}" for i in range(400, 480)}
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in [*range(20), *range(400, 470)]] + [(5, "other"), (None, "a")], "doc_id long, domain string")
    documents = documents.where("doc_id is null or doc_id <> 31")  # one text would hold nearly all tokens
    documents = documents.unionByName(spark.createDataFrame([*more.items()], "doc_id long, text string"), allowMissingColumns=True)
    marked = documents.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.repeat(F.lit(" !"), 40))).otherwise(F.col("text")))
    rows = mix(marked, labels, {"a": 0.25, "b": 0.75}).collect()
    tokens = sum(r.n_tokens for r in rows)
    totals = [sum(r.rate * r.n_tokens * r.posterior[k] for r in rows) / tokens for k in range(2)]
    assert len(rows) == len(texts) + 81 and np.allclose(totals, [0.25, 0.75], atol=0.05)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    assert mix(nothing, labels, {"a": 1.0}).collect() == []
    assert mix(documents, labels.limit(0), {"a": 1.0, "b": 1.0}).count() == len(rows)
    kept = mixed_documents(marked, labels, {"a": 0.5, "b": 0.5}, 1.5, 1.0)
    assert kept.columns == marked.columns and {r.doc_id for r in kept.collect()} == {*texts, *more, None} - {31}


def mixed_totals(spark, shares, soft, least, targets, growth=1.0):
    """Shares of tokens after mixing, by the rates that the errors of the fit give; and those that the fit reports."""
    rng = np.random.default_rng(5)
    label, tokens = rng.choice(3, 5000, p=shares), rng.integers(20, 400, 5000)
    p = np.full((5000, 3), soft / 2)
    p[np.arange(5000), label] = 1 - soft
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "n_tokens long, posterior array<double>")
    aims = np.array(targets) * tokens.sum() * growth
    fitted = mixing_module.fit_errors(rows, aims, least)
    errors, reached = fitted if isinstance(fitted, tuple) else (fitted, aims)
    rates = mixing_module.rates_after(errors, p, least)
    assert rates.min() >= least
    return (tokens * rates) @ p / aims, reached / aims


@pytest.mark.parametrize("soft", [0.0, 0.05, 0.08])
def test_rare_domains_reach_their_targets(spark, soft):
    found, reported = mixed_totals(spark, [0.598, 0.4, 0.002], soft, 0.0, [0.8, 0.15, 0.05])
    assert np.allclose(found, 1, atol=1e-3) and np.allclose(reported, found)


def test_targets_out_of_reach_are_reported(spark):
    found, reported = mixed_totals(spark, [0.5, 0.4, 0.1], 0.0, 1.0, [0.8, 0.15, 0.05])
    assert found[1] > 2 and np.allclose(reported, found)
    docs = spark.createDataFrame([(i, "a b c d") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="misses its targets"):
        mix(docs, labels, {"x": 0.1, "y": 0.9})


def test_pipeline_follows_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    result = corpus_pipeline.run(spark, folder).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    kept = {r.doc_id for r in result}
    dirty = {r.doc_id for r in QUERIES["op9_benchmark_decontamination"](spark, folder).where("contaminated").collect()}
    toxic = {r.doc_id for r in QUERIES["op8_toxicity"](spark, folder).where("predicted = 1").collect()}
    civil = docs.where(~F.col("doc_id").isin([*toxic]))
    first = {r.doc_id for r in near_duplicates(civil, percent=corpus_pipeline.SIMILAR).where("kept").collect()}
    assert kept == first - dirty
    assert kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    starts = sorted((r.start, r.n_tokens) for r in result)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
