import random

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_operators import components


def test_stages(spark, rows, tmp_path):
    rng = random.Random(3)
    docs = [*rows, *[(500 + i, prose(rng, 60) + " you grumbler. " * 3, "en", "a", 0) for i in range(60)], *[(700 + i, prose(rng, 60), "en", "a", 0) for i in range(200)]]
    labels = [(i, 1, int(500 <= i < 600)) for i, *_ in docs if i >= 500]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        before = frame
        frame = stage(spark, frame, str(tmp_path))
        path = str(tmp_path / f"out-{name}")
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        seen[name] = (before, frame)
        if name != "packing":
            assert frame.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not ids(seen["toxicity"][1]) & set(range(500, 560)) and ids(seen["toxicity"][1]) >= set(range(700, 900))
    assert ids(seen["line_dedup"][1]) == ids(seen["line_dedup"][0])
    given = [(r.doc_id, r.text) for r in seen["near_dedup"][0].select("doc_id", "text").collect()]
    kept = ids(seen["near_dedup"][1])
    assert kept == {i for i, (_, top) in components(given, 5, 80).items() if i == top} and 60 not in kept
    before, after = seen["substring_dedup"]
    assert ids(before) == ids(after)
    chars = lambda df: sum(len(r.text or "") for r in df.collect())
    assert chars(after) < chars(before)
    assert ids(seen["packing"][1]) == ids(after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"][1].count()


def test_stages_on_odd_tables(spark, tmp_path):
    """No rows; null ids, sources and texts; a caller's columns with the operators' names."""
    names = ["_maybe", "_row", "_fp", "_fw", "_id", "_site", "_n_removed", "node"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    own = [f"{n}!" for n in names]
    text = "some line\n" + " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1, *own), (None, text, None, None, None, *own), (None, None, None, None, None, *own), (4, "", "en", "a", 0, *own), (5, text, "en", "a", 1, *own)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            got = out.collect()
            if name == "packing":
                assert len(got) == len(given)
                continue
            assert out.schema.simpleString() == docs.schema.simpleString()
            assert all([r[n] for n in names] == own for r in got)
            ids = [r.doc_id for r in got]
            assert len(ids) == len(given) if name != "near_dedup" else 5 not in ids and {i for i in ids} == {i for i, *_ in given} - {5}
