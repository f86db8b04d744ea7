"""Whitening, the tokenization automaton and fill-in-the-middle against plain versions and the libraries."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import automaton, middle, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")
sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def by_hand(vectors):
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    y = np.array(x, float) - np.array(sums) / n
    values, vectors_ = np.linalg.eigh(y.T @ y / n)
    return good, n, dev, y, values[::-1], vectors_[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(12, 12)) / 4
    vectors = [(i, (rng.normal(size=12) @ mix).astype("float32").tolist()) for i in range(300)]
    vectors += [vectors[3], (7, vectors[8][1]), (None, vectors[9][1])]  # repeated rows, ids and a null id
    vectors += [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [0.0] * 11 + [float("-inf")])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, component string").repartition(5)
    got = whitening.whiten(df).collect()
    good, n, dev, y, values, axes = by_hand(vectors)
    assert n == 303 and len(got) == 8 * n
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(good, dev, strict=True))
    want = y @ axes[:, :8] / np.sqrt(values[:8])
    for k in range(8):
        one = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == k + 1}
        mine = np.array([one[i, d] for (i, _), d in zip(good, dev, strict=True)])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-9
    assert {r.component: r.explained for r in got} == {k + 1: pytest.approx(values[k] / values.sum(), rel=1e-9) for k in range(8)}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9 and {r.n for r in got} == {n}


def test_covariance_is_exact(spark):
    """Large entries beside small ones: sums beyond 64 bits stay whole."""
    rows = [([2.0**38 * (i % 2), float(i % 3), -1.0],) for i in range(50)]
    x = spark.createDataFrame(rows, "v array<double>").select(whitening.fixed(F.col("v")).alias("x"))
    model = whitening.fit(x)
    ints = [[math.floor(1024 * c) + 100_000 for c in v] for (v,) in rows]
    var = lambda i: (50 * sum(r[i] ** 2 for r in ints) - sum(r[i] for r in ints) ** 2) / 2500
    assert model.trace == sum(map(var, range(3))) and model.sums == tuple(map(sum, zip(*ints, strict=True)))


def test_odd_vectors(spark):
    schema = "vec_id string, embedding array<double>"
    for rows in ([], [("a", None)], [("a", [])], [("a", [1.0, 2.0])] * 3):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns[0] == "vec_id"
    few = whitening.whiten(spark.createDataFrame([("a", [1.0, 0.0, 5.0]), ("b", [2.0, 0.5, 5.0])], schema)).collect()
    assert {(r.component, round(abs(r.whitened), 9)) for r in few} == {(1, 1.0)}  # two points have one component
    for bad in ([("a", [1.0]), ("b", [1.0, 2.0])], [("a", [1e300])]):
        with pytest.raises(Exception, match="differ in length|beyond"):
            whitening.whiten(spark.createDataFrame(bad, schema)).collect()


def library(text):
    model = library.model
    ids = model.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False))


library.model = Tokenizer.from_file(WORDS)


def odd_texts():
    rng = random.Random(4)
    fixed = ["<|endoftext|>a<|startoftext|>", "x<|endoftext|>́", "<|endoftext|", "  \t\x0b x　y z\x1c\x85q", "É é ß İ Σ ΑΣ ǅ é ½ ٣ 中文字", "it's 'S don't I'LL '' 's's", "a" * 3000, "ab" * 700 + "!" * 900, "́x ́", "😀👩‍👩‍👧 �​ p", "", "\n", "\x00\x01\x7f", "Å Å ﬁ"]
    letters = "abehinorst"
    return fixed + ["".join(rng.choices(letters + "'!. <|>é́中0９\n", k=rng.randrange(1, 60))) for _ in range(1500)] + ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(1500)]


def test_automaton_is_the_library(spark, docs, rows):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:] for r in automaton.bpe_digests(df, WORDS).collect()} == {i: library(t) for i, t in enumerate(texts)}
    got = automaton.bpe_digests(docs, WORDS).collect()
    assert sorted(map(tuple, got)) == sorted((i, *library(t)) for i, t, *_ in rows)
    assert automaton.bpe_digests(docs.limit(0), WORDS).count() == 0
    ids = automaton.bpe_digests(spark.createDataFrame([("a", None), (None, "x")], "doc_id string, text string"), WORDS).collect()
    assert {(r.doc_id, r.n_tokens) for r in ids} == {("a", 0), (None, 1)}


def test_long_texts_go_block_by_block(monkeypatch):
    coder = automaton.AutomatonCoder(WORDS, automaton.automaton(WORDS))
    text = " ".join(t for t in odd_texts()[200:900] if t) + " " + "word" * 600
    monkeypatch.setattr(automaton, "BLOCK", 97)
    monkeypatch.setattr(automaton.blocks, "__defaults__", (97,))
    assert automaton._digests(coder, [text, None, "a b"]) == [library(text), library(""), library("a b")]
    assert [x for x in automaton.blocks(" ab\n\ncd " * 50, 7)] and "".join(automaton.blocks("abc def", 2)) == "abcdef"


def test_encode_and_decode_columns(spark):
    texts = [None, "", "Hello <|endoftext|> World's 12", "né"]
    tables = automaton.broadcast_automaton(spark, WORDS)
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("ids", automaton.encode_bpe(F.col("text"), WORDS, tables))
    got = df.withColumn("back", automaton.decode_bpe(F.col("ids"), WORDS, tables)).collect()
    for r in got:
        ids = library.model.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.back == library.model.decode(ids, skip_special_tokens=False)


def merged(word, merges):
    """The merges as they are defined: always the first pair of the best rank."""
    parts, rank = list(word), {m: i for i, m in enumerate(merges)}
    while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_gadgets_make_what_merges_make(seed):
    """Random merge lists, with merges of a token with itself and tokens that never come up."""
    rng = random.Random(seed)
    letters = ["a", "b", "c", "a_", "b_", "c_"]
    tokens, merges = list(letters), []
    while len(merges) < rng.randrange(2, 40):
        u, v = rng.choice([t for t in tokens if not t.endswith("_")]), rng.choice(tokens)
        if u + v not in tokens and len(u + v) < 9:
            merges.append((u, v))
            tokens.append(u + v)
    table = automaton.compile_merges({t: i for i, t in enumerate(tokens)}, merges, "_")
    words = [rng.choices("abc", k=rng.randrange(1, 14)) for _ in range(300)]
    words = [[*w[:-1], w[-1] + "_"] for w in words]
    read = [[table.symbols[s] for s in w] for w in words]
    want = [merged(w, merges) for w in words]
    assert [[tokens[i] for i in ids] for ids in table.encode(read)] == want
    assert [[tokens[i] for i in table._alone(w)] for w in read] == want


def fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    raw = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(raw[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, docs, rows):
    extra = [(1000 + i, t) for i, t in enumerate([" a", "a ", "\t\n", "x<M>y", "é é　é中 b\x0b", "<P", "a<<P>", "\x1f q"] * 12)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*extra, (None, "null id")], "doc_id long, text string")).withColumn("form", F.lit("clash"))
    out = middle.fill_in_middle(both).join(both.select(F.col("doc_id").alias("d"), F.col("text")), F.col("doc_id").eqNullSafe(F.col("d"))).withColumn("output", middle.render(F.col("text"), F.col("pieces"))).collect()
    given = {r[0]: r[1] for r in rows} | dict(extra) | {None: "null id"}
    assert {r.doc_id for r in out} == set(given) and {r.form for r in out} == {"plain", "spm", "psm"}
    for r in out:
        n, form, pre, mid, output = fim_by_hand(r.doc_id, given[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, pre, mid, output)
        assert r.output_sha256 == sha(output) and r.restored_sha256 == sha(given[r.doc_id] or "")
    assert middle.fill_in_middle(docs.limit(0)).count() == 0
    assert middle.fill_in_middle(docs).count() == len(rows)


def test_pieces_are_cut_where_they_lie():
    table = [middle.Piece(0, 0, 4), middle.Piece(2, 0, 3), middle.Piece(0, 4, 2)]
    text = b"abcdef"
    whole = b"".join(middle.stream(table, text))
    assert whole == b"abcd<S>ef"
    for i in range(len(whole) + 1):
        for j in range(i, len(whole) + 1):
            parts = middle.cut_at(table, [i, j])
            assert [b"".join(middle.stream(p, text)) for p in parts] == [whole[:i], whole[i:j], whole[j:]]
