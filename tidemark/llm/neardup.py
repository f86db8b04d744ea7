"""Near-duplicate classes: one-permutation MinHash, banded buckets, stars of candidate links.

A document's words give a set of shingles. One hash of each shingle serves the whole signature: the
range of hashes is cut into bins and a bin keeps its least hash; empty bins borrow from bins chosen
by a fixed hash of (bin, attempt), the optimal densification. Bands of bins make buckets. Within a
bucket each member is paired with one centre, not with each other member; every pair is confirmed
on the full sets.

A star alone could miss a link between two members that are both too far from the centre. So the
confirmed links give components, and members of a bucket that lie in different components go on
to an exact step: two sets that are similar enough share one of their rarest shingles (the prefix of
each, rarest first among the members left), and only sets that share one there, in components of
their own, are compared. A set whose own shingles alone rule a link out has no prefix left and is
compared with nothing. A pair that shares a bucket is hence always settled, without rounds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, claim, key_filter, slices, with_maybe
from tidemark.sources.scratch import cut, forget

#: Most bands of a signature. Each costs a row for each distinct set.
BANDS = 56

_WORD = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of texts that a task turns into sets at a time.
SLICE = 1_000_000


def bands_for(percent: int, most: int = BANDS, miss: float = 1e-6) -> tuple[int, int]:
    """Bands, and bins in each: the longest bands of which ``most`` suffice.

    With them a pair at the threshold shares no bucket with a chance of at most ``miss``.
    """

    def needed(rows: int) -> int:
        same = (percent / 100) ** rows
        return 1 if same >= 1 else math.ceil(math.log(miss) / math.log1p(-same))

    rows = max((r for r in range(1, 33) if needed(r) <= most), default=1)
    return needed(rows), rows


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads bits (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes.

    A-Z are lower-cased. A text with fewer words than ``width`` has its word sequence as the one
    shingle; a text without words has none.
    """
    words = [_WORD.findall(t.encode().lower().decode()) for t in texts]
    place: dict[str, int] = {}
    flat = np.fromiter((place.setdefault(w, len(place)) for ws in words for w in ws), dtype=np.int64)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in place), dtype=np.uint64, count=len(place))
    h = known[flat] if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):

        def rolled(n: int) -> np.ndarray:
            acc = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
            for j in range(n):
                acc = _mixed(acc * _ODD + h[j : j + len(acc)])
            return acc

        full, out, at = rolled(width), [], 0
        for ws in words:
            n = len(ws)
            if n >= width:
                out.append(np.unique(full[at : at + n - width + 1]))
            elif n:
                acc = np.array([n], dtype=np.uint64)
                for j in range(n):
                    acc = _mixed(acc * _ODD + h[at + j : at + j + 1])
                out.append(acc)
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One least hash for each bin of a sorted, not empty set, densified."""
    edges = np.array([(i << 64) // bins for i in range(bins)], dtype=np.uint64)
    first = np.searchsorted(hashes, edges)
    least = hashes[np.minimum(first, len(hashes) - 1)]
    ends = np.append(edges[1:], np.uint64(2**64 - 1))
    empty = (first == len(hashes)) | (least < edges) | ((least >= ends) & (np.arange(bins) < bins - 1))
    out, todo, attempt = least.copy(), np.flatnonzero(empty), 0
    while len(todo):
        attempt += 1
        donor = (_mixed((todo.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        good = ~empty[donor]
        out[todo[good]] = least[donor[good]]
        todo = todo[~good]
    return out


def sketch(text: Column, width: int, bands: int, rows: int) -> Column:
    """Struct ``n_shingles, node, bands``: size and 128-bit digest of the set, and its bucket keys."""
    salt = np.arange(bands, dtype=np.uint64)

    @F.pandas_udf("n_shingles long, node binary, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("neardup")
        for batch in batches:
            out = []
            for texts in slices(batch, SLICE):
                for s in shingle_sets(texts, width):
                    if not len(s):
                        out.append((0, None, None))
                        continue
                    sig = signature(s, bands * rows).reshape(bands, rows)
                    key = salt + np.uint64(1)
                    with np.errstate(over="ignore"):
                        for j in range(rows):
                            key = _mixed(key * _ODD + sig[:, j])
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), key.view(np.int64)))
            sizes, nodes, keys = list(zip(*out, strict=True)) or [()] * 3
            yield pd.DataFrame({"n_shingles": pd.array(list(sizes), dtype="int64"), "node": pd.Series(list(nodes), dtype=object), "bands": pd.Series(list(keys), dtype=object)})

    return run(text)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """``node, set``: digest and sorted shingles of each text that has words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("neardup")
        for batch in batches:
            for part in slices(batch["text"], SLICE):
                sets = [s for s in shingle_sets(part, width) if len(s)]
                yield pd.DataFrame({"node": pd.Series([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], dtype=object), "set": pd.Series([s.view(np.int64) for s in sets], dtype=object)})

    return texts.select("text").mapInPandas(run, "node binary, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b, ...`` whose full sets (``node, set``) are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("_sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("_sa")), "a")
    # 100 * common >= percent * (sizes - common)
    similar = F.size(F.array_intersect("_sa", "_sb")) * (100 + percent) >= percent * (F.size("_sa") + F.size("_sb"))
    return both.filter(similar).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """``node, comp``: the least node that each end of the links ``a, b`` reaches.

    Labels spread over the links, then each label takes over its own label's label, so that chains
    halve; each turn is written to the shared folder.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("cb"))
        spread = labels.join(around.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("cb", "comp")).alias("mid"))
        jumped = spread.join(labels.select(F.col("node").alias("mid"), F.col("comp").alias("top")), "mid", "left")
        turn = cut(jumped.select("node", "was", F.least("mid", F.coalesce("top", "mid")).alias("comp")), "labels")
        forget(labels)
        labels = turn
        if turn.filter("was <> comp").isEmpty():
            forget(both)
            return labels.select("node", "comp")


def _stars(classes: DataFrame) -> DataFrame:
    """``band, node, n, head, head_n``: each member of a bucket but its centre, which is ``head``.

    The member that meets most others over all its buckets is the centre in each of them: it is
    close to the middle of its family, and stars of different buckets have the same pairs. Buckets
    are counted with a map-side combine before any member is shuffled.
    """
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    counts = cut(banded.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "bucket-sizes")
    shared = cut(with_maybe(banded, key_filter(counts, "band"), "_maybe", "band").filter("_maybe").drop("_maybe").join(counts, "band"), "buckets")
    ranked = cut(shared.join(shared.groupBy("node").agg(F.sum("m").alias("weight")), "node").select("band", "node", "n", "weight"), "members")
    heads = ranked.groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("head"))
    stars = cut(ranked.join(heads, "band").filter("node <> head.node").select("band", "node", "n", F.col("head.node").alias("head"), F.col("head.n").alias("head_n")), "stars")
    forget(counts, shared, ranked)
    return stars


def _left_over(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``node, n, comp, prefix``: members that share a bucket with members of other components.

    A centre has met its bucket. To be linked with any of the others, whose sets have ``least``
    shingles or more, a set must share ``need`` of its own; so one of its ``prefix`` rarest is shared.
    """
    placed = stars.join(labels, "node", "left").select("band", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    members = placed.join(mixed.select("band", "least"), "band").groupBy("node").agg(F.min("n").alias("n"), F.min("comp").alias("comp"), F.min("least").alias("least"))
    other = F.greatest("least", F.expr(f"(n * {percent} + 99) div 100"))
    need = F.ceil((F.col("n") + other) * percent / (100 + percent) - 1e-6)
    return members.select("node", "n", "comp", (F.col("n") - need + 1).alias("prefix"))


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, ca, cb``: pairs of members in components ``ca <> cb`` that share a shingle of both prefixes."""
    shingles = sets.join(members, "node").select("node", "n", "comp", "prefix", F.explode("set").alias("shingle"))
    common = shingles.groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    # A window holds one document's set. Shingles that no other member has come first and pair with nothing.
    own = W.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "shingle"))
    prefixes = cut(shingles.join(common, "shingle").withColumn("place", place).filter("place <= prefix").select("shingle", "node", "n", "comp", "place"), "prefixes")
    # Members of the component that most holders of a shingle are in need no comparison with each other.
    by_comp = prefixes.groupBy("shingle", "comp").agg(F.count("*").alias("c"))
    tops = by_comp.groupBy("shingle").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    near = cut(prefixes.join(tops.select("shingle", F.col("top.comp").alias("top")), "shingle"), "prefixes")
    x, y = near.filter("comp <> top").alias("x"), near.alias("y")
    joined = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.node") < F.col("y.node")))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        # At the first shingle that two sets share, no more can be common than is left in both.
        & (percent * (F.col("x.n") + F.col("y.n")) <= (100 + percent) * (1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")))),
    )
    pairs = cut(joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct(), "pairs")
    forget(prefixes, near)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of ``width``-word
    shingles. ``component_id`` is the smallest id reachable; rows alike in set are one class from the
    start. A text without words (null, empty, white space) is linked with nothing.

    Two sets at the threshold share no bucket, and so may be missed, with a chance of at most 1e-6; at 5
    percent above it the chance is under 1e-8. Rows that repeat an id and text stay together; a null id is never
    the smallest of others. No rows give none; other columns are ignored.
    """
    rows = cut(docs.select("doc_id", sketch(F.col("text"), width, *bands_for(percent)).alias("s")).select("doc_id", "s.*"), "sketches")
    classes = cut(rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    stars = _stars(classes)

    # Sets of the classes that are in some pair; other documents are left out before their texts move.
    paired = stars.select("node").union(stars.select("head")).distinct()
    wanted = cut(classes.select("node", "first_id").join(paired, "node"), "wanted")
    few = with_maybe(docs.select("doc_id", "text"), key_filter(wanted, "first_id"), "_maybe", "doc_id").filter("_maybe")
    sets = cut(full_sets(few, width).dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi"), "sets")

    sized = stars.filter(100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n"))
    links = cut(_confirmed(sized.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), sets, percent), "links")
    labels = components(links)
    pairs = _prefix_pairs(cut(_left_over(stars, labels, percent), "left-over"), sets, percent)
    bridges = cut(_confirmed(pairs, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "bridges")
    tops = components(bridges).select(F.col("node").alias("comp"), F.col("comp").alias("top"))

    named = classes.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("comp", "node").alias("comp"))
    named = named.join(tops, "comp", "left").select("node", "first_id", F.coalesce("top", "comp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    found = cut(named.join(least, "comp").select("node", "component_id"), "components")
    forget(classes, stars, wanted, sets, links, pairs, bridges, labels, tops)
    out = rows.select("doc_id", "n_shingles", "node").join(found, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
