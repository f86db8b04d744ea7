"""Quality rules: text statistics, and robust multivariate outliers by language and source.

The location and scatter of each stratum come from the minimum covariance determinant. Three starts (medians
with quartile ranges, means with covariances, medians with spatial signs) are concentrated: keep the
share ``h`` of rows with the least Mahalanobis distance, estimate from those, and repeat. The start
whose covariance has the least determinant goes on. Each step is one aggregation over all rows by
(stratum, start, bin of the distance), of sums and cross products, so no stratum is gathered anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, slices
from tidemark.sources.scratch import cut

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
#: A variance under this is none; it is also the ridge where all rows are alike in a statistic.
NONE = 1e-6

_WORD, _SYMBOL = re.compile(WORD), re.compile(r"[#*$%&|<>]")


def chi_square_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    c = 2 / (9 * d)
    return d * (1 - c + NormalDist().inv_cdf(p) * c**0.5) ** 3


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0]


def _repeat_words(words: list[list[str]]) -> np.ndarray:
    """For each text, its words inside windows of five words found twice or more in it.

    Windows get exact numbers by pairing: numbers of words, of pairs, of fours, then of fives.
    """
    each = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    place: dict[str, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for ws in words for w in ws), dtype=np.int64)
    if len(ids) < 5:
        return np.zeros(len(words), dtype=np.int64)
    doc = np.repeat(np.arange(len(words)), each)
    twos = _paired(ids[:-1], ids[1:])
    fives = _paired(_paired(twos[:-2], twos[2:])[:-1], ids[4:])
    starts = np.flatnonzero(doc[:-4] == doc[4:])
    key = _paired(doc[starts], fives[starts])
    again = starts[np.bincount(key, minlength=1)[key] > 1] if len(key) else starts
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    return np.bincount(doc, weights=np.cumsum(cover)[:-1] > 0, minlength=len(words)).astype(np.int64)


def text_stats(text: Column) -> Column:
    """Struct of the five counts over the whole text; null and empty texts have zeros."""

    @F.pandas_udf(", ".join(f"{s} long" for s in STATS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for texts in slices(batch):
                words = [_WORD.findall(t) for t in texts]
                dup = []
                for t in texts:
                    lines = [x for x in t.split("\n") if _WORD.search(x)]
                    dup.append(len(lines) - len(set(lines)))
                parts.append(pd.DataFrame({"n_words": [len(w) for w in words], "word_chars": [sum(map(len, w)) for w in words], "n_symbols": [len(_SYMBOL.findall(t)) for t in texts], "n_dup_lines": dup, "n_repeat_words": _repeat_words(words)}))
            yield pd.concat(parts, ignore_index=True).astype("int64") if parts else pd.DataFrame({s: pd.Series(dtype="int64") for s in STATS})

    return run(text)


def transformed() -> list[Column]:
    """The statistics as a vector: log length, log word length, and roots of three rates."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _solved(cov: Column, spare: Column) -> Column:
    """Inverse of a flat covariance matrix, and the logarithm of its determinant; ``spare`` has the variances of ``_spare``.

    Lengths take theirs where they have no scatter, rates are raised to theirs.
    """

    @F.pandas_udf("inverse array<double>, logdet double")
    def run(cov: pd.Series, spare: pd.Series) -> pd.DataFrame:
        out = []
        for c, least in zip(cov, spare, strict=True):
            m, least = np.asarray(c, dtype=float).reshape(DIM, DIM), np.asarray(least, dtype=float)
            own = m.diagonal()
            need = np.where(np.arange(DIM) < 2, own < NONE, own < least)
            full = m + np.diag(np.where(need, np.maximum(least - own, 0), 0) + NONE * 1e-3)
            out.append((np.linalg.inv(full).ravel(), float(np.linalg.slogdet(full)[1])))
        return pd.DataFrame({"inverse": pd.Series([x for x, _ in out], dtype=object), "logdet": np.array([x for _, x in out], dtype=float)})

    return run(cov, spare)


def _spare(rows: DataFrame) -> DataFrame:
    """``stratum, spare``: variances for statistics without scatter of their own.

    For the two lengths they are pooled over the language (all rows for a stratum of many), by
    quartiles, or plain if those are equal. For the roots of rates it is what chance alone gives in a text of
    the stratum's median length n: the root of a count has a variance of 1/4, so that of count / n has
    1 / (4 n), and five times that for repeated words, which come by windows of five.
    """

    def pooled(i: int) -> Column:
        q = F.percentile_approx(f"x{i}", [0.25, 0.75], 1000)
        return F.coalesce(F.nullif(F.pow((q[1] - q[0]) / 1.349, 2), F.lit(0.0)), F.nullif(F.var_pop(f"x{i}"), F.lit(0.0)))

    langs = rows.groupBy("_lang").agg(pooled(0).alias("a0"), pooled(1).alias("a1"))
    whole = rows.agg(pooled(0).alias("b0"), pooled(1).alias("b1"))
    chance = 1 / (4 * F.greatest(F.expm1(F.percentile_approx("x0", 0.5, 1000)), F.lit(1.0)))
    own = rows.groupBy("stratum").agg(chance.alias("c"), F.min("_lang").alias("_lang"), F.max("_lang").alias("_last"))
    own = own.withColumn("_lang", F.when(F.col("_lang") == F.col("_last"), F.col("_lang")))
    # One row for each language, and one row.
    joined = own.join(F.broadcast(langs), "_lang", "left").crossJoin(F.broadcast(whole))
    return joined.select("stratum", F.array(*[F.coalesce(f"a{i}", f"b{i}", F.lit(NONE)) for i in range(2)], "c", "c", 5 * F.col("c")).alias("spare"))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x0..`` under ``center`` and ``inverse``."""
    d = [F.col(f"x{i}") - F.col("center")[i] for i in range(DIM)]
    terms = [F.col("inverse")[i * DIM + j] * d[i] * d[j] * (1 if i == j else 2) for i in range(DIM) for j in range(i, DIM)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def strata(rows: DataFrame, min_rows: int) -> DataFrame:
    """``_cell, stratum, members``: a (language, source) with too few rows looks up its language, then all.

    ``members`` are the strata that a cell's rows help to estimate: its own if it is large enough, and
    its language and all wherever some small cell looks these up.
    """
    cells = rows.groupBy("_cell", "_lang").agg(F.count("*").alias("n"))
    langs = cells.groupBy("_lang").agg(F.sum("n").alias("n_lang"), (F.min("n") < min_rows).alias("asked"))
    whole = langs.agg((F.min("n_lang") < min_rows).alias("asked_all"))
    own, lang = F.when(F.col("n") >= min_rows, F.col("_cell")), F.when(F.col("n_lang") >= min_rows, F.col("_lang"))
    members = F.array_compact(F.array(own, F.when(F.col("asked"), lang), F.when(F.col("asked_all"), F.lit("all"))))
    return cells.join(langs, "_lang").crossJoin(F.broadcast(whole)).select("_cell", F.coalesce(own, lang, F.lit("all")).alias("stratum"), members.alias("members"))


_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
_SUMS = [f"s{i}" for i in range(DIM)] + [f"s{i}{j}" for i, j in _PAIRS]


def _moments() -> list[Column]:
    return [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS]


def _mean_cov() -> tuple[list[Column], Column]:
    """Center and flat covariance from sums."""
    center = [F.col(f"s{i}") / F.col("n") for i in range(DIM)]
    return center, F.array(*[F.col(f"s{min(i, j)}{max(i, j)}") / F.col("n") - center[i] * center[j] for i in range(DIM) for j in range(DIM)])


def _estimates(sums: DataFrame, center: list[Column], cov: Column, *keys: str) -> DataFrame:
    return sums.select(*keys, F.array(*center).alias("center"), _solved(cov, F.col("spare")).alias("_s")).select(*keys, "center", "_s.inverse", "_s.logdet")


def _starts(rows: DataFrame, spare: DataFrame) -> DataFrame:
    """``stratum, start, center, inverse, logdet`` of the three starts."""
    spreads = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIM)]
    first = cut(rows.groupBy("stratum").agg(*spreads, *_moments()).join(spare, "stratum"), "mcd-starts")
    median = [F.col(f"q{i}")[1] for i in range(DIM)]
    width = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(NONE**0.5)) for i in range(DIM)]
    diagonal = F.array(*[F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)])
    z = [(F.col(f"x{i}") - median[i]) / width[i] for i in range(DIM)]
    scaled = rows.join(first.select("stratum", *[f"q{i}" for i in range(DIM)]), "stratum").select("stratum", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    norm = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, DIM)), F.col("z0") * F.col("z0"))
    signs = scaled.withColumn("_r", norm).groupBy("stratum").agg(*[F.coalesce(F.avg(F.try_divide(F.col(f"z{i}") * F.col(f"z{j}"), F.col("_r"))), F.lit(0.0)).alias(f"u{i}{j}") for i, j in _PAIRS])
    signed = F.array(*[DIM * width[i] * width[j] * F.col(f"u{min(i, j)}{max(i, j)}") for i in range(DIM) for j in range(DIM)])
    number = lambda df, k: df.withColumn("start", F.lit(k))
    out = _estimates(number(first, 0), median, diagonal, "stratum", "start")
    out = out.unionByName(_estimates(number(first, 1), *_mean_cov(), "stratum", "start"))
    return cut(out.unionByName(_estimates(number(first.join(signs, "stratum"), 2), median, signed, "stratum", "start")), "mcd")


def _concentrated(rows: DataFrame, estimate: DataFrame, spare: DataFrame, h: float) -> DataFrame:
    """One step for each stratum and start of ``estimate``."""
    keys = ["stratum", "start"]
    binned = rows.join(estimate, "stratum").withColumn("_bin", F.floor(16 * F.log2(_distance() + 1e-9)))
    by_bin = binned.groupBy(*keys, "_bin").agg(*_moments())
    w = W.partitionBy(*keys)
    ranked = by_bin.withColumn("_before", F.sum("n").over(w.orderBy("_bin")) - F.col("n")).withColumn("_all", F.sum("n").over(w))
    kept = ranked.filter(F.col("_before") < h * F.col("_all")).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _SUMS])
    return cut(_estimates(kept.join(spare, "stratum"), *_mean_cov(), *keys), "mcd")


def mcd_estimates(rows: DataFrame, h: float = 0.75, steps: int = 6, trial_steps: int = 2) -> DataFrame:
    """``stratum, center, inverse, scale``: the robust estimates from ``stratum, _lang, x0..x4``.

    After ``trial_steps`` the start with the least determinant (the first of equal ones) takes the other
    steps. ``scale`` makes the median distance that of a chi-square law. Medians are approximate to
    1/1000 of the rows; a tie in distance falls on one side as a whole, and the share kept is at
    least ``h``.
    """
    spare = cut(_spare(rows), "spare")
    estimate = _starts(rows, spare)
    for step in range(steps):
        if step == trial_steps:
            best = estimate.groupBy("stratum").agg(F.min(F.struct("logdet", "start")).alias("_b")).select("stratum", F.col("_b.start").alias("start"))
            estimate = cut(estimate.join(best, ["stratum", "start"]), "mcd")
        estimate = _concentrated(rows, estimate, spare, h)
    median = rows.join(estimate, "stratum").groupBy("stratum").agg(F.percentile_approx(_distance(), 0.5, 1000).alias("_median"))
    return estimate.join(median, "stratum").select("stratum", "center", "inverse", F.greatest(F.col("_median") / chi_square_quantile(0.5, DIM), F.lit(1.0)).alias("scale"))


def quality_outliers(docs: DataFrame, quantile: float = 0.99999, min_rows: int = 200, h: float = 0.75) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept``, ``stratum`` and ``distance`` of each row.

    ``base_failed``: fewer than 10 words, or more than 20 in 100 words inside repeated windows.
    Estimates come from all rows that pass. A row is kept if it passes and its squared distance,
    scaled, is at most the chi-square ``quantile``. Null language or source is a value of its own.
    Rows alike, and rows at the same distance, get the same verdict. Null and empty texts have no words and fail the base
    rules; ids may be null, and no rows give none.
    """
    nulls = {"ignoreNullFields": "false"}  # a cell without source is not its language
    cell, lang = F.to_json(F.struct("lang", "source"), nulls), F.to_json(F.struct("lang"), nulls)
    counted = docs.select("doc_id", cell.alias("_cell"), lang.alias("_lang"), text_stats(F.col("text")).alias("s")).select("doc_id", "_cell", "_lang", "s.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = cut(counted.withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(transformed())}), "text-stats")
    fit = rows.filter(~F.col("base_failed"))
    found = cut(strata(fit, min_rows), "strata")
    estimates = cut(mcd_estimates(fit.join(found, "_cell").withColumn("stratum", F.explode("members")).select("stratum", "_lang", *[f"x{i}" for i in range(DIM)]), h), "mcd")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    cutoff = chi_square_quantile(quantile, DIM)
    return (
        rows.join(found.drop("members"), "_cell", "left")
        .join(estimates, "stratum", "left")
        .withColumn("distance", distance)
        .select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "stratum", "distance")
    )
