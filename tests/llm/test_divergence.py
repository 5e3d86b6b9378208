"""Source divergence: trees, joint walks, and results against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm.divergence import scaled, source_divergence
from tabulon.llm.k2tree import QuadTree, joint_cells
from tabulon.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("filled", [0, 1, 5, 60, 256])
def test_trees_hold_their_matrix(filled):
    rng = np.random.default_rng(filled)
    matrix = np.zeros(256, np.int64)
    matrix[rng.permutation(256)[:filled]] = rng.integers(1, 10**12, filled)
    matrix = matrix.reshape(16, 16)
    at = np.nonzero(matrix)
    tree = QuadTree.from_bytes(*QuadTree.build(*at, matrix[at], 16).to_bytes(), 16)
    back = np.zeros((16, 16), np.int64)
    rows, columns, counts = tree.cells()
    back[rows, columns] = counts
    assert (back == matrix).all()
    if filled == 1:
        assert [len(bits) for bits in tree.levels] == [4] * 4  # empty quarters hold nothing


@pytest.mark.parametrize("same", [True, False])
def test_joint_walk_meets_every_cell_that_holds_something(same):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(1, 9, (8, 8)) * (rng.random((8, 8)) < 0.2) for _ in "ab")
    b = a if same else b
    trees = [QuadTree.build(*np.nonzero(m), m[np.nonzero(m)], 8) for m in (a, b)]
    found = Counter(zip(*(x.tolist() for x in joint_cells(*trees, 8, 7, same))))
    expected = Counter((i, j, a[i, t], b[j, t]) for i in range(8) for j in range(7) for t in range(8) if (a[i, t] or b[j, t]) and (not same or i < j))
    assert found == expected
    empty = QuadTree.empty(8)
    assert all(len(x) == 0 for x in joint_cells(empty, empty, 8, 8, True))
    assert len(joint_cells(trees[0], empty, 8, 3, False)[0]) == 3 * np.count_nonzero(a)


def test_prices_are_exact():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 9 * 10**15, 1000)
    count = np.minimum(rng.integers(0, 9 * 10**15, 1000) % total, total - 1)
    assert scaled(count, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]


def expected(rows, least=3, top=200):
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
        groups[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: c for (m, s), c in groups.items() if m == lang}
        whole = sum(own.values(), Counter())

        def p(counts, term):
            return 1 + 10**9 * (counts[term] + 1) // (sum(counts[t] for t in kept) + len(kept))

        prices = {s: {t: p(c, t) for t in kept} for s, c in own.items()}
        base = {t: p(whole, t) for t in kept}
        for s in own:
            pairs = [(-sum((prices[s][t] - q) ** 2 // q for t, q in prices[o].items()), o.encode(), o) for o in own if o != s]
            terms = [(-((prices[s][t] - q) ** 2 // q), t.encode(), t) for t, q in base.items() if own[s][t] and prices[s][t] > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mü", "日本", "xİ") for b in "abcdefgh"]
    out = []
    for i in range(160):
        source = f"s{min(rng.randrange(14), rng.randrange(14))}"
        out.append((" ".join(rng.choice(words) for _ in range(rng.randrange(40))) + rng.choice(["", ".", "\x00A1b_", "\x1c"]), rng.choice(["en", "de"]), source))
    out += [(None, "en", "s1"), ("", "en", "quiet"), ("only once", "fr", "a"), ("", "fr", "b"), (None, None, None), ("ka ka", None, "s0"), out[0], out[0], ("ab " * 30_000, "de", "s3")]
    return out


@pytest.mark.parametrize(("side", "least", "top"), [(64, 3, 200), (4, 3, 5), (2, 1, 200)])
def test_results_equal_brute_force(spark, rows, side, least, top):
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("x") for c in ("term", "g", "n", "value")})
    found = source_divergence(frame.repartition(3), least, top, side)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == expected(rows, least, top)


def test_no_documents(spark):
    assert source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_source_divergence"])
def test_query_matches_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.sql(ORACLES[name])
    df = QUERIES[name](spark, folder).select(*found.columns)
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
