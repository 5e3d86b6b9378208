"""Token counts: spliced chunks give what the model gives for whole texts."""

import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tabulon.llm import token_counts as module
from tabulon.llm.queries import QUERIES
from tabulon.llm.token_counts import cut_text, token_counts

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
WHOLE = SentencePieceProcessor(model_file=PATH)


def expected(texts):
    return sorted((len((t or "").encode()), len(WHOLE.encode(t or ""))) for t in texts)


def found(rows):
    return sorted((r.n_bytes, r.n_tokens) for r in rows)


def strange_texts():
    rng = random.Random(3)
    letters = "abcdeéßжя日本語한국어😀▁ \t\n\r\x00.,<>0x41"
    out = ["a" * 3000, "ab" * 2000, " " * 2500, "▁" * 900, "日本語" * 700, "😀" * 500, "\x07" * 800, "<0x41><s>" * 300, "word " * 600]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 4000))) for _ in range(30)]
    return out + ["".join(rng.choice("ab ") for _ in range(rng.randint(500, 4000))) for _ in range(10)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (200, 200), (1000, 60)])
def test_spliced_counts_equal_whole_counts(spark, chunk, overlap):
    texts = strange_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = token_counts(frame, PATH, chunk_bytes=chunk, overlap_bytes=overlap).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(WHOLE.encode(t)) for i, t in enumerate(texts)}


def test_every_row_is_counted(documents, nothing, texts):
    rows = token_counts(documents, PATH, limit=100, chunk_bytes=500, overlap_bytes=64).collect()
    assert found(rows) == expected([*texts.values(), texts[3], texts[3]])
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows) and sum(r.doc_id is None for r in rows) == 1
    assert token_counts(nothing, PATH).collect() == []


def test_models_without_proven_splices_encode_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(module.PieceCounter, "traits", lambda self, path: (False, 0))
    monkeypatch.setattr(module, "worker_state", dict)
    frame = spark.createDataFrame([(1, "ab cd " * 500)], "doc_id long, text string")
    assert found(token_counts(frame, PATH, chunk_bytes=100).collect()) == expected(["ab cd " * 500])


def test_cuts_are_whole_characters_and_cover_the_text():
    data = module.np.frombuffer("aé日😀".encode() * 50, module.np.uint8)
    text = data.tobytes().decode()
    at = 0
    for a, b, begin, following, previous in cut_text(data, 37, 11):
        own = data[a:b].tobytes().decode()
        assert text[begin : begin + len(own)] == own and begin <= at <= begin + len(own) and previous in (0, at)
        at = begin + len(own)
        assert following <= at
    assert at == len(text)


def test_query_counts_whole_texts(spark, folder):
    rows = QUERIES["op11_token_counts"](spark, folder).collect()
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        t.doc_id: (len((t.text or "").encode()), n := len(WHOLE.encode(t.text or "")), n > 4096) for t in texts
    }
