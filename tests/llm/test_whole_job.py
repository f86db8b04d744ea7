"""Jobs that were once done in part: boilerplate on few pages, long clean texts, outliers in rates, cuts at any offset."""

import random

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import toxic_rows
from tidemark.llm import outliers, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_boilerplate_of_few_pages_goes(spark):
    """A line on 1 % of a source's pages is dropped; one on four pages, or on 5 of 6000, stays."""
    docs = [(i, f"page {i}" + "\nLicensed to all." * (i % 100 == 0) + "\nOn four pages." * (i < 4) + "\nOn five." * (i < 5), "en", "a", 0) for i in range(6000)]
    out = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, SCHEMA), "").collect()
    texts = "\n".join(r.text for r in out)
    assert "Licensed" not in texts and texts.count("On four pages.") == 4 and texts.count("On five.") == 5


def test_length_alone_is_not_toxic():
    texts, labels = toxic_rows()
    bags = [[words for _, _, words in toxicity.sentence_spans(t)] for _, t in texts]
    model = toxicity._fit(bags, np.array([y for *_, y in labels]))
    clean = " ".join(t for (_, t), (*_, y) in zip(texts, labels, strict=True) if not y)
    assert clean.count(".") > 5000
    assert model.score(clean) < 0.3 and model.score(clean * 3) == model.score(clean)
    assert model.score(clean + " w1 w2 grumbling w3. w4 sneerer.") >= 0.7


def words(rng, n):
    vocabulary = random.Random(1)
    known = ["".join(vocabulary.choices("abcdefghij", k=vocabulary.randrange(3, 9))) for _ in range(2000)]
    return rng.choices(known, k=n)


def test_each_statistic_rejects(spark):
    """Texts that differ from the others in one statistic each; a single odd symbol, line or repeat is none."""
    rng = random.Random(6)
    lines = lambda ws, k: "\n".join(" ".join(ws[i : i + k]) for i in range(0, len(ws), k))
    good = [lines(words(rng, rng.randrange(150, 400)), 8) for _ in range(400)]
    base = words(rng, 240)
    odd = {
        "length": lines(words(rng, 40_000), 8),
        "long words": lines([w * 5 for w in base], 8),
        "symbols": lines([w + "#" * (i % 7 < 2) for i, w in enumerate(base)], 8),
        "lines": lines(base[:200], 4).replace("\n", "\nok\n"),
        "repeats": lines(base + base[:25], 8),
    }
    fine = {"symbol": lines(base, 8) + " #", "line": lines(base, 8) + "\nof the" * 2, "repeat": lines([*base, *base[:5]], 8)}
    texts = [*good, *odd.values(), *fine.values()]
    got = outliers.quality_outliers(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()
    by = {r.doc_id: r for r in got}
    names = dict(enumerate([*odd, *fine], len(good)))
    assert {names[i]: by[i].kept for i in names} == {**dict.fromkeys(odd, False), **dict.fromkeys(fine, True)}
    assert not any(by[i].base_failed for i in names)
    assert sum(by[i].kept for i in range(len(good))) >= 390


def test_small_cells_are_held_against_their_language(spark):
    """Rows of rare sources and languages are judged by all rows of their language, or of the table."""
    rng = random.Random(8)
    docs = [(i, " ".join(words(rng, rng.randrange(150, 400))), "en", "hot") for i in range(400)]
    spoilt = " ".join(w + "#$" for w in words(rng, 250))
    docs += [(1000, spoilt, "en", "rare"), (1001, " ".join(words(rng, 250)), "en", "rare"), (1002, spoilt, "xx", "rare"), (1003, " ".join(words(rng, 250)), None, None), (1004, spoilt, "en", None)]
    got = {r.doc_id: r for r in outliers.quality_outliers(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert {i: got[i].kept for i in range(1000, 1005)} == {1000: False, 1001: True, 1002: False, 1003: True, 1004: False}
    assert sum(got[i].kept for i in range(400)) >= 390
