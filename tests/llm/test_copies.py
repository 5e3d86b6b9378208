"""Repeats, near copies, lines and benchmark windows against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import line_dedup as lines_module, near_duplicates as near_module, repeats
from tabulon.llm.components import components
from tabulon.llm.decontaminate import clean_documents, decontaminate
from tabulon.llm.fm_index import repeated_windows as by_fm_index, substring_dedup
from tabulon.llm.line_dedup import line_dedup, within
from tabulon.llm.near_duplicates import estimate, near_duplicates, sketches, text_sets
from tabulon.llm.suffix_array import repeated_windows as by_suffix_array, suffix_array_dedup


def without_repeats(texts: dict, length: int) -> dict:
    seen, gone, words = {}, defaultdict(set), {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(texts):
        for s in range(len(words[i]) - length + 1):
            if seen.setdefault(tuple(words[i][s : s + length]), (i, s)) != (i, s):
                gone[i].update(range(s, s + length))
    return {i: (len(w), len(gone[i]), b" ".join(x for k, x in enumerate(w) if k not in gone[i]).decode()) for i, w in words.items()}


@pytest.mark.parametrize("dedup,length", [(substring_dedup, 20), (suffix_array_dedup, 50)])
def test_repeats(documents, nothing, texts, dedup, length, monkeypatch):
    expected = without_repeats(texts, length)
    rows = dedup(documents, length).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        whole = (texts[3] or "").split()
        assert (r.n_words, r.n_removed, r.kept) == (expected[r.doc_id] if r.doc_id is not None else (len(whole), 0, " ".join(whole)))
    assert dedup(nothing, length).collect() == []
    # every shared minimiser counts as very frequent, and places are fetched by a shuffle
    monkeypatch.setattr(repeats, "TOGETHER", 1)
    monkeypatch.setattr(repeats, "BROADCAST_PLACES", 0)
    assert sorted(dedup(documents, length).collect(), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(20))
def test_shard_indexes(seed):
    rng = np.random.default_rng(seed)
    kinds, length = int(rng.integers(2, 50)), 5
    base = rng.integers(0, kinds, 40)
    parts = [np.concatenate([rng.integers(0, kinds, 6), base[k : k + 12], rng.integers(0, kinds, 6)]) for k in rng.integers(0, 25, 6)]
    codes = [(p.astype(np.uint64) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15) for p in parts]
    shard = repeats.Shard(np.concatenate(codes), np.cumsum([0, *map(len, codes)]), np.arange(6), rng.integers(0, 5, 6))
    own, docs, places = shard.places()
    first, expected = {}, np.zeros(len(own), bool)
    for i in range(len(own) - length + 1):
        if own[i] == own[i + length - 1]:
            expected[i] = first.setdefault(shard.codes[i : i + length].tobytes(), (docs[i], places[i])) != (docs[i], places[i])
    assert (by_fm_index(shard, length) == expected).all()
    assert (by_suffix_array(shard, length, 2) == expected).all()


def shingle_sets(texts: dict) -> dict:
    out = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(documents, nothing, texts, block, monkeypatch):
    monkeypatch.setattr(near_module, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near_module, "BROADCAST_NODES", 0 if block == 2 else 1000)
    sets = shingle_sets(texts)
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    rows = near_duplicates(documents).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)
    assert group[22] == 0 and group[20] == 3 and group[26] == 26
    if block == 512:
        assert near_duplicates(nothing).collect() == []


@pytest.mark.parametrize("percent,cases", [
    (85, [(6, 0, 1), (9, 0, 1), (17, 0, 3), (30, 2, 2), (34, 3, 3)]), (80, [(4, 0, 1), (8, 1, 1), (18, 2, 2), (27, 3, 3), (160, 20, 20)]),
])
def test_small_sets_link_exactly(spark, percent, cases):
    texts = {}
    for shared, *extra in cases:
        for _ in range(100):
            at = len(texts)
            body = [f"w{at}x{i}" for i in range(shared + 4)]
            for side in (0, 1):
                texts[at + side] = " ".join([*body, *(f"e{at}x{i}x{side}" for i in range(extra[side]))])
    sets = shingle_sets(texts)
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    rows = near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), percent=percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i - i % 2 if linked(i, i - i % 2) else i for i in texts}


@pytest.mark.parametrize("percent", [1, 30, 50, 80, 85, 95, 100])
def test_bands_follow_the_threshold(percent):
    chosen = near_module.places(percent)
    assert len(set(chosen.ravel().tolist())) == chosen.size
    assert (1 - (percent / 100) ** chosen.shape[1]) ** len(chosen) <= 1e-8 or chosen.shape[1] == 1


def test_sketch_estimates_jaccard():
    import pyarrow as pa

    words = [f"w{i}" for i in range(3000)]
    bounds, codes = text_sets(pa.array([" ".join(words), " ".join(words[300:] + [f"x{i}" for i in range(300)])]), 5)
    regs, n = sketches(bounds, codes), np.diff(bounds)
    truth = len(np.intersect1d(codes[: n[0]], codes[n[0] :])) / len(np.union1d(codes[: n[0]], codes[n[0] :]))
    assert abs(estimate((regs[0] == regs[1]).sum(), n[0], n[1]) - truth) < 0.12


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (9, 8), (20, 21), (22, 21), (30, 30), (5, 4)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {3: 3, 4: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20, 22: 20}


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        a, b = (bytes(rng.choice([97, 98], int(rng.integers(0, 9))).tolist()) for _ in range(2))
        for k in range(4):
            assert within(a, b, k) == (distance(a, b) <= k)


@pytest.mark.parametrize("edits,block", [(1, 256), (2, 1)])
def test_lines(spark, nothing, edits, block, monkeypatch):
    monkeypatch.setattr(lines_module, "BLOCK", block)
    monkeypatch.setattr(lines_module, "BROADCAST_LINES", 0 if block == 1 else 1000)
    line = "the quick brown fox jumps over the lazy dog"
    texts = {
        0: f"{line}\nshort\n\nshort", 1: f"{line}!\nshorx\n", 2: f"a{line}x", 3: line.replace("brown", "brawn"), 4: "", 5: None,
        6: line.replace("fox", "cat"), 7: f"{'y' * 50_000}\n{'y' * 49_999}z", 8: "\n\n", 9: line[: len(line) - 2],
    }
    first, places = {}, []
    for i, t in texts.items():
        for n, x in enumerate(t.encode().split(b"\n") if t else []):
            if x.strip():
                first.setdefault(x, (i, n))
                places.append((i, n, x))
    big = [x for x in first if len(x) >= lines_module.LEAST_BYTES]
    near = lambda a, b: distance(a, b) <= edits if max(len(a), len(b)) < 1000 else within(a, b, edits)
    late = {a for a in big for b in big if first[a] > first[b] and near(a, b)}
    expected = defaultdict(list)
    for i, n, x in places:
        if x in late or first[x] != (i, n):
            expected[i].append(n)
    frame = spark.createDataFrame([*texts.items(), (None, line)], "doc_id long, text string").withColumn("line", F.lit(1))
    rows = line_dedup(frame, edits).collect()
    assert {r.doc_id: r.removed for r in rows} == {**{i: expected[i] for i in texts}, None: []}
    assert {r.doc_id: r.n_lines for r in rows}[0] == 4 and {r.doc_id: r.n_lines for r in rows}[5] == 0
    if block == 256:
        assert line_dedup(nothing).collect() == []


def test_benchmark_windows(spark, documents, nothing, texts):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = {i: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    items = {
        1: " ".join(texts[1].split()[5:30]), 2: "ONE, Two", 3: None, 4: " -- ", 5: "never seen anywhere", 10: " ".join(texts[1].split()[5:30]),
        6: " ".join(texts[31].split()[-12:]), 7: "ab " * 12,
    }
    hit, found = defaultdict(set), defaultdict(set)
    for item, t in items.items():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(10, len(w))
        for window in {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else ():
            for i, own in words.items():
                for s in range(len(own) - n + 1):
                    if tuple(own[s : s + n]) == window:
                        hit[i].update(range(s, s + n))
                        found[i].add(str(item))
    benchmark = spark.createDataFrame([*items.items(), (None, texts[2])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate(documents, benchmark).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        i = 3 if r.doc_id is None else r.doc_id
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(words[i]), len(hit[i]), sorted(found[i]), len(hit[i]) > 0)
    assert {1, 29, 30, 31, 33} <= set(hit)
    clean = clean_documents(documents, benchmark)
    assert clean.columns == documents.columns and clean.count() == sum(not r.contaminated for r in rows)
    assert decontaminate(nothing, benchmark).collect() == []
    assert not any(r.contaminated for r in decontaminate(documents, benchmark.limit(0)).collect())


@pytest.mark.parametrize(("dedup", "length"), [(suffix_array_dedup, 50), (substring_dedup, 20)])
def test_frequent_phrase_is_halved(spark, dedup, length, monkeypatch):
    """Many different texts about one phrase: what is routed again stays near the number of segments, not of windows."""
    made, plain = [], repeats.halves

    def counted(rows, *about):
        out = plain(rows, *about)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(repeats, "TOGETHER", 8)
    monkeypatch.setattr(repeats, "halves", counted)
    phrase = [f"common{i}" for i in range(length + 15)]
    texts = {d: " ".join([f"a{d}x{i}" for i in range(40)] + phrase + [f"b{d}x{i}" for i in range(40)]) for d in range(60)}
    found = {r.doc_id: r for r in dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), length).collect()}
    assert found[0].n_removed == 0 and all(found[d].n_removed == len(phrase) for d in range(1, 60))
    assert all(found[d].kept == " ".join(w for w in texts[d].split() if not w.startswith("common")) for d in range(1, 60))
    assert made and all(out <= 2 * came for came, out in made)
