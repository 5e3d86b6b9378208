import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "ior", "ul")]
#: Names that operators use themselves.
CLASHES = ("key", "id", "route", "line", "rep", "part", "rate", "score", "start", "n_tokens", "toxic_score")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> dict:
    """Ordinary texts, copies, near copies, shared passages, an empty, a blank, a null and a long text."""
    rng = random.Random(7)
    out: dict = {i: prose(rng, rng.randint(30, 200)) for i in range(20)}
    words = out[0].split()
    passage = prose(rng, 70)
    out |= {20: out[3], 21: out[3], 22: " ".join([*words[:10], "other", *words[11:]]), 23: " ".join(words[:-2]).upper()}
    out |= {24: f"{out[4]} {passage}", 25: f"{passage}\n{out[5]}", 26: "", 27: " \n\t ", 28: None, 29: "one two", 30: "ab " * 60}
    out |= {31: prose(rng, 20_000), 32: "Grüße\x1caß 3x <|endoftext|> don't İ 'S", 33: "one two", 34: f"{out[6]}\n{out[7]}"}
    return out


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts with clashing columns, one repeated row, and a row without an id."""
    rows = [(i, t, "en", f"src{(i or 0) % 3}") for i, t in [*texts.items(), (3, texts[3]), (None, texts[3])]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({name: F.lit("clash") for name in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
