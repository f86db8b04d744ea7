"""Null and string ids, repeated rows, ties and empty tables, where other tests have none."""

import public_tokenizers
import pytest

from tidemark.llm import linededup, outliers, packing, pieces, sharding

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXT = " ".join(f"word{i % 37} and so on." for i in range(60))


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids(spark, kind):
    ids = ["a", None, "b", "b"] if kind == "string" else [1, None, 2, 2]
    df = spark.createDataFrame([(i, TEXT, "en", "s") for i in ids] + [(None, None, None, None)], f"doc_id {kind}, text string, lang string, source string")
    want = sorted(map(str, [*ids, None]))
    for out in (pieces.token_counts(df, PIECES), pieces.piece_digests(df, PIECES), outliers.quality_outliers(df), packing.pack_documents(df, WORDS), sharding.assign_shards(df)):
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == want and dict(out.dtypes)["doc_id"] == {"long": "bigint"}.get(kind, kind)
    assert {r.n_tokens for r in pieces.token_counts(df, PIECES).filter("n_bytes = 0").collect()} == {0}


def test_ties_by_distance(spark):
    """Rows at one distance share a verdict, whatever their number."""
    df = spark.createDataFrame([(i, TEXT, "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    assert len({(r.kept, r.distance) for r in outliers.quality_outliers(df).collect()}) == 1


def test_pages(spark):
    schema = "page_id long, url string, html string"
    line = "<p>Shared by all</p>"
    rows = [(None if i == 3 else i, "http://a.b/x", f"{line}<p>own {i}</p>") for i in range(8)] + [(9, None, None), (None, "not an address", line)]
    out = linededup.page_line_dedup(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 10 and sum(r.n_dropped for r in out) == 8
    assert {r.page_id for r in out} == {None, 0, 1, 2, 4, 5, 6, 7, 9} and [r.text for r in out if r.page_id == 9] == [None]
    none = linededup.page_line_dedup(spark.createDataFrame([], schema))
    assert none.count() == 0 and none.columns == ["page_id", "host", "text", "n_lines", "n_dropped"]
