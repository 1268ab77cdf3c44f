from __future__ import annotations

import random

import pytest


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Documents with copies, near copies, shared passages, personal data, and the edge cases."""
    rng = random.Random(5)
    base, passage, line = sentence(rng, 150), sentence(rng, 90), sentence(rng, 12)
    docs: list[str | None] = [None, "", "   ", "one", "one two", "One Two", base, base, base.upper()]
    w = base.split()
    for k in range(12):  # near copies, each with its own change, some too far
        x = list(w)
        for _ in range(1 + k % 6):
            x[rng.randrange(len(x))] = f"edit{k}"
        docs.append(" ".join(x))
    docs += [f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}" for _ in range(8)]
    docs += [f"{line}\n{sentence(rng, 60)}" for _ in range(5)]
    docs += ["ab" * 1500, "x" * 900, passage + passage, sentence(rng, 3000)]
    docs += ["mail anna.b@example.org or +49 (30) 123-4567 89, card 4111 1111-1111 1111, host 10.0.0.255 not 300.1.1.1, 1234567890123456", "a@b@c.de x_d@e.f-g.h +1 1.2.3.4 5@", "9" * 400 + "." + "1" * 50]
    return list(enumerate(docs))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr"][i % 2], "s", len(t or ""), "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("doc_id < 0")
