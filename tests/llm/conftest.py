import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    out = []
    for i in range(n):
        w = f"w{rng.randrange(words)}"
        out.append(w + rng.choice(["", "", "", "", ".", ",", ".\n"]))
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(3, 160)) for _ in range(60)]
    passage = prose(rng, 70, 5000)
    texts += [texts[0], texts[0].upper(), texts[1], texts[2] + " tail", "start " + texts[3]]
    for k in range(12):  # a family of near copies
        base = texts[4].split(" ") * 2
        base[k * 3] = f"edit{k}"
        texts.append(" ".join(base))
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}" for _ in range(3)]
    texts += [None, "", "   \n\t ", "one", "two words", "É é ß", prose(rng, 30_000)]
    texts += ["All rights reserved.\n" + prose(rng, 30) for _ in range(9)]
    out = [(i, t, rng.choice(["en", "de", None]), "a" if i % 3 else rng.choice(["b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[5], out[70]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kept string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
