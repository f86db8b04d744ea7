"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, no rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, exactdedup, linededup, neardup, outliers, packing, pieces, sharding, substring, toxicity

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(common.WORD)


def lower(t):
    return t.encode().lower().decode()


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t or "")].append(i)
    want = sorted((i, max(groups[n := lower(t or "")]), len(groups[n]), i == max(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted(map(tuple, exactdedup.exact_dedup(docs, "max").collect())) == want
    least = {(r.doc_id, r.keep_id) for r in exactdedup.exact_dedup(docs, "min").collect()}
    assert least == {(i, min(groups[lower(t or "")])) for i, t, *_ in rows}


def test_exact_dedup_sees_through_equal_digests(docs, rows):
    weak = lambda text: F.unhex(F.lpad(F.hex(F.crc32(text.cast("binary")) % 4), 2, "0"))
    strong = {(r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_dedup(docs).collect()}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_dedup(docs, digest=weak).collect()} == strong


def test_index_takes_more_runs(spark, tmp_path):
    index = exactdedup.DigestIndex(spark, str(tmp_path / "index"))
    keyed = lambda ids: spark.createDataFrame([(i, f"t{i % 3}") for i in ids], "doc_id long, text string").withColumn("digest", exactdedup.sha256_digest(F.col("text")))
    index.flush(keyed(range(3, 9)))
    index.compact()
    index.flush(keyed([0, 9]))
    assert {(r.keep_id, r.n) for r in index.compact().collect()} == {(0, 4), (4, 2), (5, 2)}
    assert index.lookup(hashlib.sha256(b"t0").digest()).first().keep_id == 0


def test_levels_and_filters_of_the_index(spark, tmp_path):
    """Runs are merged level by level and deleted; look-ups skip files by range and filter, and a filter turns rows away."""
    index = exactdedup.DigestIndex(spark, str(tmp_path / "index"), fan=2)
    keyed = lambda ids: spark.createDataFrame([(i, f"t{i % 40}") for i in ids], "doc_id long, text string").withColumn("digest", exactdedup.sha256_digest(F.col("text")))
    shape = []
    for k in range(4):
        index.flush(keyed(range(10 * k, 10 * k + 10)))
        shape.append([len(level) for level in index.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1]]
    index.flush(keyed([5, 100, 100]))
    merged = {r.digest: (r.keep_id, r.n) for r in index.compact().collect()}
    assert len(index.runs) == 1 and len(merged) == 40 and merged[hashlib.sha256(b"t5").digest()] == (5, 2) and merged[hashlib.sha256(b"t20").digest()] == (20, 3)
    assert [p.name for p in (tmp_path / "index").glob("level*/run*")] == ["run-00009"]
    marked = common.with_maybe(keyed(range(40)), index.filter(), "_maybe", "digest")
    assert {r.doc_id for r in marked.filter("_maybe").collect()} >= {5, 20} and marked.filter("_maybe").count() < 6
    index.drop()
    assert not (tmp_path / "index").exists()


def test_line_dedup(docs, rows):
    site = lambda r: r[3]
    pages, hits = Counter(map(site, rows)), Counter()
    for r in rows:
        hits.update((site(r), x) for x in {x for x in (r[1] or "").split("\n") if x.strip(" \t\r")})
    bad = {k for k, n in hits.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    assert bad
    want = []
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        keep = None if lines is None else [x for x in lines if (site(r), x) not in bad]
        want.append((r[0], None if keep is None else "\n".join(keep), len(lines or []), len(lines or []) - len(keep or [])))
    got = linededup.line_dedup(docs, F.col("source"), 0.1, 3).select("doc_id", "text", "_n_lines", "_n_dropped").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_substring_dedup(docs, rows):
    first, cover = {}, defaultdict(set)
    texts = sorted({(i, t) for i, t, *_ in rows}, key=lambda x: x[0])
    for i, t in texts:
        parts = substring.sentences(t or "")[0]
        words = [p.split() for p in parts]
        for a in range(len(parts)):
            b = next((b for b in range(a + 2, len(parts) + 1) if sum(map(len, words[a:b])) >= substring.WORDS), None)
            if b and words[a]:
                content = " ".join(w for ws in words[a:b] for w in ws)
                if content in first:
                    cover[i].update(range(a, b))
                first.setdefault(content, i)
    want = sorted((i, None if t is None else "".join(p for k, p in enumerate(substring.sentences(t)[0]) if k not in cover[i])) for i, t, *_ in rows)
    out = substring.substring_dedup(docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == want
    assert out.columns[:6] == docs.columns


@pytest.mark.parametrize("text", ["", "a", " lead. And, then\n\nmore " + "word " * 40, "x　y. z", "\n\n", "中文。日本語、ไทย no spaces"])
def test_sentences_tile_the_text(text):
    parts, words = substring.sentences(text)
    assert "".join(parts) == text and len(words) == len(parts) + 1


def test_passages_are_found_wherever_they_stand(spark):
    """Passages of over 50 words without a stop, and texts without spaces, pasted at any offset."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows, lost = [], {}
    for i in range(40):
        passage = [word() for _ in range(55)] if i % 2 else ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(120))]
        for k in range(2):
            before, after = [word() for _ in range(rng.randrange(30))], [word() for _ in range(rng.randrange(30))]
            rows.append((2 * i + k, " ".join([*before, *passage, *after])))
        lost[2 * i + 1] = len(" ".join(passage))
    out = {r.doc_id: r for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert all(out[2 * i].text == texts[2 * i] for i in range(40))
    assert sum(len(texts[i]) - len(out[i].text) >= 0.5 * n for i, n in lost.items()) >= 39


def test_clashing_columns_and_string_ids(spark):
    text = "a shared line\n" + " ".join(f"w{i}" for i in range(60))
    cols = ["_id", "_copy", "_maybe", "_row", "_out", "_ranges", "_site", "_all", "_drop", "_stay", "_n_removed", "_N_LINES", "digest", "node", "n"]
    d = spark.createDataFrame([(f"id{i}", text, "S", *[f"{c}{i}" for c in cols]) for i in range(6)], "doc_id string, text string, source string, " + ", ".join(f"{c} string" for c in cols))
    own = lambda df: sorted(tuple(r[c] for c in ("doc_id", *cols)) for r in df.collect())
    for out in (substring.substring_dedup(d), linededup.line_dedup(d, F.col("source"))):
        assert out.columns[: len(d.columns)] == d.columns and len(out.columns) == len(d.columns) + 2 and own(out) == own(d)
    assert {r.doc_id for r in substring.substring_dedup(d).collect() if " w30 " in r.text} == {"id0"}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exactdedup.exact_dedup(d).collect()} == {(f"id{i}", "id5", 6) for i in range(6)}
    assert {r.component_id for r in neardup.near_duplicates(d).collect()} == {"id0"}


def components(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])
    comp = {i: i for i in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (3, 93)])
def test_near_duplicates(docs, rows, width, percent):
    want = components(rows, width, percent)
    got = neardup.near_duplicates(docs, width, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_that_stars_miss(spark, monkeypatch):
    """Families around a base: many members lie too far from any centre and link among themselves only."""
    rng = random.Random(3)
    rows = []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(160)]
        for i in range(40):
            words = list(base)
            for k in rng.sample(range(160), rng.choice([1, 2, 3, 4, 6, 8])):
                words[k] = f"e{family}x{k}" if i % 2 else f"u{family}x{i}x{k}"
            rows.append((family * 40 + i, " ".join(words)))
    asked = []
    inner = neardup._prefix_pairs
    monkeypatch.setattr(neardup, "_prefix_pairs", lambda *a: asked.append(inner(*a)) or asked[-1])
    monkeypatch.setattr(neardup, "forget", lambda *a: None)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85, 90):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, 3, percent).collect()}
        assert got == components(rows, 3, percent)
    # Components are bridged, and far fewer pairs are compared than there are.
    assert all(0 < p.count() < 4 * 40 * 39 / 2 / 3 for p in asked)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 800, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:700], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    same = np.mean(neardup.signature(a, 512) == neardup.signature(b, 512))
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1
    assert len(neardup.signature(a[:1], 64)) == 64 and (neardup.signature(a[:1], 64) == a[0]).all()
    for percent in (50, 80, 85, 93, 100):
        bands, rows = neardup.bands_for(percent)
        assert bands <= neardup.BANDS and (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.comp for r in neardup.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pieces(docs, rows):
    model = pieces.PieceCoder.of(PIECES).model
    got = {r.doc_id: r for r in pieces.piece_digests(docs, PIECES).collect()}
    counts = {r.doc_id: r for r in pieces.token_counts(docs, PIECES).collect()}
    for i, t, *_ in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert (counts[i].n_tokens, counts[i].n_bytes) == (len(ids) - 2, len((t or "").encode())) and counts[i].over_limit == (len(ids) - 2 > 4096)


def test_pieces_round_trip(docs):
    back = docs.filter("text is not null").select("text", pieces.decode_ids(pieces.encode_ids(F.col("text"), PIECES), PIECES).alias("back")).filter("text <> back")
    assert back.isEmpty()


HARD = [" ", "  ", "\n", "a", "Word", "▁", "É", "\t", "日本", "\x00", "<s>", "<|endoftext|>", " ", "😀", ".", "'s", "İ", "Σ", "²", "K", "́"]


def test_hard_texts_encode_as_the_libraries_do():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(HARD, rng.integers(0, 14))) for _ in range(3000)]
    p, w = pieces.PieceCoder.of(PIECES), packing.WordCoder.of(WORDS)
    assert [x.tolist() for x in p.encode(texts)] == p.model.encode(texts)
    assert [x.tolist() for x in w.encode(texts)] == [x.ids for x in w.model.encode_batch(texts, add_special_tokens=False)]


def test_small_caches_change_nothing():
    cache = common.Cache(5)
    make = lambda keys: [k.upper().encode() for k in keys]
    for keys in (["aa", "bb"], ["bb", "cc", "dd"], ["aa"]):
        known = cache.get_all(keys, make)
        assert [known[k] for k in keys] == make(keys)


@pytest.mark.parametrize("per_salt", [packing.PER_SALT, 3])
def test_packing(docs, rows, per_salt, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", per_salt)
    model = packing.WordCoder.of(WORDS).model
    out = packing.pack_documents(docs, WORDS, max_len=64).toPandas()
    ids = {i: np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, *_ in rows}
    copies = Counter(i for i, *_ in rows)
    for i, part in out.groupby("doc_id"):
        assert part["length"].sum() == copies[i] * len(ids[i]) and (part["doc_tokens"] == len(ids[i])).all()
        for r in part.itertuples():
            assert zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 64
    assert sorted(out["sequence_id"].unique()) == list(range(out["sequence_id"].nunique()))


def test_patterns_hold_every_length():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(range(1, 101), rng.integers(0, 5000, 100), strict=True) if n}
    patterns = packing.shortest_pack_first(histogram, 100)
    held = Counter()
    for n, lengths in patterns:
        assert sum(lengths) <= 100
        for x in lengths:
            held[x] += n
    assert held == Counter(histogram) and packing.shortest_pack_first({}, 100) == []
    tokens = sum(k * n for k, n in histogram.items())
    assert tokens / (100 * sum(n for n, _ in patterns)) > 0.97


def test_shards(spark, docs, rows, tmp_path):
    out = sharding.assign_shards(docs, 4, 512, str(tmp_path / "map")).toPandas()
    assert len(out) == len(rows) and sorted(out["text_crc32"]) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    sharding.assign_shards(docs, 4, 512, str(tmp_path / "map")).count()
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).version == 2
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 0).owner.tolist() == [i % 4 for i in range(512)]


def test_rebalancing():
    weight = np.random.default_rng(3).lognormal(3, 1, 1024)
    even = sharding.SlotMap.fresh(8, 1024).rebalanced(weight, 8)
    load = np.bincount(even.owner, weights=weight, minlength=8)
    assert load.max() - load.min() < 0.001 * load.mean()
    grown = even.rebalanced(weight, 9, only_into=8)
    moved = grown.owner != even.owner
    assert (grown.owner[moved] == 8).all() and np.bincount(grown.owner, weights=weight, minlength=9)[8] > 0.9 * weight.sum() / 9


def test_text_stats(docs, rows):
    got = {r.doc_id: r.s for r in docs.select("doc_id", outliers.text_stats(F.col("text")).alias("s")).collect()}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        cover = {j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert tuple(got[i]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))


def test_outliers(spark, docs, rows):
    import random

    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(["river", "stone", "cloud", "meadow", "lantern", "as", "of", "the", f"n{rng.randrange(999)}"]) for _ in range(rng.randrange(40, 400))), "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{c}###%%%" for c in good[i][1].split()[: 50 + i]), "en", "s") for i in range(10)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality_outliers(table).collect()}
    assert not any(got[i].kept for i, *_ in bad) and sum(got[i].kept for i, *_ in good) >= 297
    small = outliers.quality_outliers(docs).collect()
    assert len(small) == len(rows) and all(not r.kept for r in small if r.base_failed)


def toxic_rows():
    import random

    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(300)}"
    texts, labels = [], []
    for i in range(900):
        sentences = [[word() for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(3, 12))]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                sentences[rng.randrange(len(sentences))].append(rng.choice(["grumbling", "grumbles", "sneerer"]))
        texts.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity(spark, docs, nothing):
    texts, labels = toxic_rows()
    d, y = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, y).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out for i, _ in held) and sum(r.held_out for r in out.values()) == len(held)
    assert np.mean([out[i].predicted == t for i, t in held]) > 0.97
    model = toxicity.train_toxicity(d, y)
    found = toxicity.offending_sentences(d, model).collect()
    assert found and np.mean([bool(re.search("grumbl|sneer", r.sentence)) for r in found]) > 0.95
    assert model.score(None) == model.score("") == pytest.approx(0.2, abs=0.05)
    none = toxicity.toxicity(docs, y.limit(0)).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


def test_no_rows(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exactdedup.exact_dedup(nothing), linededup.line_dedup(nothing, F.col("source")), substring.substring_dedup(nothing), neardup.near_duplicates(nothing), pieces.piece_digests(nothing, PIECES), pieces.token_counts(nothing, PIECES),
        packing.pack_documents(nothing, WORDS), sharding.assign_shards(nothing), outliers.quality_outliers(nothing), toxicity.toxicity(nothing, labels),
    ):
        assert out.count() == 0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f g h", "en", "s"), (1, "a b c d e f g h", "en", "s"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert {(r.doc_id, r.keep_id) for r in exactdedup.exact_dedup(d).collect()} == {(None, 1), (1, 1), (None, None)}
    assert neardup.near_duplicates(d, 3, 85).count() == 3 and substring.substring_dedup(d).count() == 3 and sharding.assign_shards(d).count() == 3


def test_filters_miss_nothing(spark):
    keys = spark.range(0, 5000, 7)
    out = common.with_maybe(spark.range(5000), common.key_filter(keys, "id"), "m", "id")
    assert out.filter("m").join(keys, "id").count() == keys.count() and out.filter("m").count() < 1.02 * keys.count()


def test_lines_of_pages_by_host(spark):
    page = lambda i: f"<html><head><style>p{{}}</style></head><body><nav><li>Home</li></nav><!-- <p>x</p> --><p>own <b>words</b> {i}</p>two\nlines<BR/>end</body></html>"
    rows = [(i, f"http://u@A.example:80/p{i}", page(i)) for i in range(8)] + [(20, "https://b.example/x", page(20)), (21, None, page(21)), (22, "mailto:x", None)]
    out = {r.page_id: r for r in linededup.page_line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0].host == "a.example" and [x for x in out[3].text.split("\n") if x] == ["own words 3"]
    assert [x for x in out[20].text.split("\n") if x] == ["Home", "own words 20", "two", "lines", "end"] and out[20].n_dropped == 0
    assert out[21].host is None and (out[22].text, out[22].n_lines, out[22].n_dropped) == (None, 0, 0) and out[3].n_dropped == 4


def test_least_determinant_of_all_subsets(spark):
    """Against the determinants of all subsets: outliers in a cluster, which means and covariances take in."""
    rng = np.random.default_rng(4)
    for seed in range(3):
        clean = rng.normal([6, 1.5, 0.5, 0.5, 0.5], [1, 0.3, 0.3, 0.3, 0.3], (12, 5))
        x = np.vstack([clean, rng.normal([9, 4, 4, 4, 4], 0.1, (3, 5))])
        best = min(itertools.combinations(range(15), 12), key=lambda k: np.linalg.det(np.cov(x[list(k)].T, bias=True)))
        rows = spark.createDataFrame([("s", "l", *map(float, v)) for v in x], "stratum string, _lang string, x0 double, x1 double, x2 double, x3 double, x4 double")
        (got,) = outliers.mcd_estimates(rows).collect()
        want = x[list(best)]
        assert set(best) == set(range(12)) and np.allclose(got.center, want.mean(axis=0))
        assert np.allclose(np.array(got.inverse).reshape(5, 5), np.linalg.inv(np.cov(want.T, bias=True)), rtol=0.05, atol=0.05)


def test_a_large_cell_has_estimates_of_its_own(spark):
    """A (language, source) of over 200 rows is judged by its own rows, a small one by its language."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    rows = [(i, text(rng.randrange(80, 120)), "en", "a") for i in range(260)] + [(1000 + i, text(rng.randrange(900, 1100)), "en", "b") for i in range(260)] + [(2000, text(100), "en", "c"), (2001, text(1000), "en", "a"), (2002, text(100), "en", "b")]
    out = {r.doc_id: r for r in outliers.quality_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[2001].kept and not out[2002].kept and out[2000].kept
    assert len({out[i].stratum for i in (0, 1000, 2000)}) == 3
    assert sum(not out[i].kept for i in [*range(260), *range(1000, 1260)]) <= 5


def test_sentences_of_many_texts_at_once():
    """Sentences cut by arrays are those of the rule told token by token, in texts of any script and white space."""
    token = re.compile(rf"\s*(?:[{substring._UNSPACED}]|[^\s{substring._UNSPACED}]+)\s*|\s+")

    def plain(text):
        parts, now = [], []
        for t in token.findall(text):
            now.append(t)
            word = t.strip()
            if "\n" in t or (word and (word[-1] in substring._STOPS or zlib.crc32(word.encode()) % substring.CUT == 0)):
                parts.append(now)
                now = []
        parts += [now] if now else []
        return ["".join(p[i : i + substring.MOST]) for p in parts for i in range(0, len(p), substring.MOST)]

    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "\u3000", "\xa0", "\x1c", "a", "bc ", "d\u00e9f", "\u03a9 ", "\u6f22", "\u3002", "!", ".", "\U0001f600", "\U00020000", "x" * 40, "w "]
    texts = ["", " \n ", "", *["".join(rng.choice(bits) for _ in range(rng.choice([1, 3, 40, 200]))) for _ in range(200)], ""]
    found = substring.Sentences.of(texts)
    assert [found.parts(i) for i in range(len(texts))] == [plain(t) for t in texts]
    text, first, end, keys = found.runs()
    own = [(i, a, b, k) for i, t in enumerate(texts) for a, b, k in zip(*substring.runs(t), strict=True)]
    assert len(own) > 500 and list(zip(text, first, end, keys, strict=True)) == own
    for i, a, b, k in own[::50]:
        assert k == xxhash.xxh3_128_digest(b"".join(xxhash.xxh3_128_digest(" ".join(p.split())) for p in plain(texts[i])[a:b]))


def test_words_are_parted_before_they_are_looked_up():
    """Case and punctuation make no new words, where the library's ids allow it."""
    coder = packing.WordCoder(WORDS)
    assert packing.part_words(["Foo,foo.", "", "FOO(foo)!?", "d'Été.é"]).to_pylist() == ["foo , foo .", "", "foo ( foo )!?", "d 'Été . é"]
    coder.encode(["Foo,foo.", "FOO(foo)!?\nfoo;"])
    assert set(coder.words.known) == {"foo", ",", ".", "(", ")!?", ";"}
    rng = random.Random(5)
    bits = ["a", "B", "Foo", "É", "é", "W̊", "İ", "İ", "İ,", "ß", "'s", "'S", "''", "'re", "d", "1", "42", ",", "!", "×", "÷", " ", "\n", "\t", "<|", "<|startoftext|>", "<|ENDOFTEXT|>", "|>", "“", "—", "漢", "Σ", "≠", "x̸", "\U0001f600", "\x85", "\xa0", "@", "\x00"]
    for _ in range(500):
        texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 12]))) for _ in range(3)]
        assert [x.tolist() for x in coder.encode(texts)] == [coder.model.encode(t, add_special_tokens=False).ids for t in texts]
