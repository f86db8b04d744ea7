"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its words and their beginnings (insults come
inflected and compounded); a document is toxic if any sentence is, so their probabilities combine by
noisy-or: 1 - prod(1 - p). What a sentence without any feature has, the background, counts once a document
and is taken out of each sentence, so length alone never makes a text toxic. Only features whose documents' labels differ clearly from the average
get a weight, so rare words of toxic training documents are not learned by heart. Training maximises the likelihood of
the document labels, and the fitted sentence scores then point at the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import claim, small_batches
from tidemark.sources.scratch import cut, forget

#: At most so many labelled documents are fitted on, and so many features have a weight.
SAMPLE, WORDS = 6000, 30_000
#: Lengths of word beginnings that are features, beside whole words.
BEGINNINGS = (4, 5, 6)

_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"[^\W\d_]+")


def sentence_spans(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Begin, end and distinct lower-case words of each sentence that has words."""
    for m in _SENTENCE.finditer(text):
        if words := set(_TOKEN.findall(m[0].lower())):
            yield m.start(), m.end(), words


def features(word: str) -> list[str]:
    """The word, and its beginnings marked by a dash."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class ToxicityModel:
    """Feature weights and a bias; the prior is the score of a text without words, and of all texts without weights."""

    bias: float = -20.0
    prior: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        """The sum of a word's features; a bounded number of words is remembered."""
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) >= 100_000:
                self._memo.clear()
            got = self._memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Begin, end and probability of each sentence."""
        z = [(a, b, self.bias + sum(map(self.weight, words))) for a, b, words in sentence_spans(text)]
        return [(a, b, float(1 / (1 + np.exp(-min(max(s, -60.0), 60.0))))) for a, b, s in z]

    def score(self, text: str | None) -> float:
        """Noisy-or over the document's background and what its sentences have above it, summed as log(1 + e^z)."""
        if not self.weights:
            return self.prior
        ground = math.log1p(math.exp(self.bias))
        total, any_words = ground, False
        for m in _SENTENCE.finditer((text or "").lower()):
            words = set(_TOKEN.findall(m[0]))
            if words:
                any_words = True
                if (w := sum(map(self.weight, words))) > 0:
                    z = self.bias + w
                    total += (z if z > 30 else math.log1p(math.exp(z))) - ground
        return float(-math.expm1(-total)) if any_words else self.prior


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``text, toxic`` of the labelled documents to learn from: remainders of crc32(doc_id) by 3 other
    than 1, and of those the ``sample`` that come first in a hash order of their ids."""
    chosen = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: A feature needs so many training documents, and labels so many standard deviations from the average.
MIN_DOCS, LEAST_Z = 4, 4.5


def _counts(bags: Iterable[list[set[str]]], labels: Iterable[int]) -> Iterator[tuple[str, int, int]]:
    """``feature, documents, toxic documents``, in parts; the empty feature is that of all documents with words."""
    df: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    for bag, label in zip(bags, labels, strict=True):
        own = {f for words in bag for w in words for f in features(w)} | {""}
        df.update(own)
        if label:
            toxic.update(own)
        if len(df) > 300_000:
            yield from ((f, n, toxic[f]) for f, n in df.items())
            df, toxic = Counter(), Counter()
    yield from ((f, n, toxic[f]) for f, n in df.items())


def _numbers(bag: list[set[str]], place: dict[str, int]) -> tuple[list[int], list[int]]:
    """Sentences of a document that have chosen features, numbered from 0, and the features, pair by pair."""
    sent, feat, at = [], [], 0
    for words in bag:
        if own := [place[f] for w in words for f in features(w) if f in place]:
            sent += [at] * len(own)
            feat += own
            at += 1
    return sent, feat


def _weights(y: np.ndarray, n_sentences: int, doc_of: np.ndarray, sent: np.ndarray, feat: np.ndarray, names: list[str], steps: int = 200, ridge: float = 0.05) -> ToxicityModel:
    """Noisy-or likelihood, as in ``score``, by gradient steps (Adam) with a ridge on the weights.

    ``doc_of`` is the document of each sentence with features, ``sent`` and ``feat`` are pairs of such a sentence and a
    feature; of other sentences the number alone counts.
    """
    prior = float(y.mean())
    w, bias = np.zeros(len(names)), float(np.log(prior / max(1.0, n_sentences / len(y))))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    share = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior))  # both labels weigh alike
    for step in range(1, steps + 1):
        z = bias + np.bincount(sent, weights=w[feat], minlength=len(doc_of))
        ground, p0 = np.logaddexp(0, bias), 1 / (1 + np.exp(-np.clip(bias, -60, 60)))
        above = z >= bias
        total = ground + np.bincount(doc_of, weights=np.where(above, np.logaddexp(0, z) - ground, 0.0), minlength=len(y))  # -log(1 - P)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        up = share * np.where(y == 1, 1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), -1.0)
        g = np.where(above, up[doc_of] * p, 0.0)
        rest = np.where(above, up[doc_of] * p0, 0.0)
        grad = np.append(np.bincount(feat, weights=g[sent], minlength=len(names)) - ridge * w, up.sum() * p0 + g.sum() - rest.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        delta = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w + delta[:-1], bias + delta[-1]
    return ToxicityModel(float(bias), prior, {t: float(w[i]) for i, t in enumerate(names) if abs(w[i]) > 1e-3})


def _fit(bags: list[list[set[str]]], y: np.ndarray) -> ToxicityModel:
    """A model from bags of words by sentence that are in memory, chosen and weighed as in ``train_toxicity``."""
    counts = {f: (n, t) for f, n, t in _counts(bags, y.tolist())}
    prior = float(y.mean())
    z = {f: abs(t - n * prior) / (n * prior * (1 - prior)) ** 0.5 for f, (n, t) in counts.items() if f and n >= MIN_DOCS}
    names = sorted((f for f in z if z[f] >= LEAST_Z), key=lambda f: (-z[f], f))[:WORDS]
    place, doc_of, sent, feat = {f: i for i, f in enumerate(names)}, [], [], []
    for d, bag in enumerate(bags):
        s, f = _numbers(bag, place)
        sent += [len(doc_of) + k for k in s]
        feat += f
        doc_of += [d] * (s[-1] + 1 if s else 0)
    return _weights(y, sum(map(len, bags)), np.array(doc_of, np.int64), np.array(sent, np.int64), np.array(feat, np.int64), names)


def _bags(texts: Iterable[str | None]) -> Iterator[list[set[str]]]:
    for text in texts:
        yield [words for _, _, words in sentence_spans(text or "")]


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fits the model on the bounded sample of ``training_rows``; its texts stay in the tasks that read them.

    Features are counted there and summed by feature; the chosen ones, WORDS at most, go back to the tasks, which
    turn each document into pairs of numbers. Those alone meet in one task for the fit.
    Without usable labels every score is 0; with labels of one kind it is that label's. Null texts, and texts
    without words, play no part; rows that repeat an id and label are learned from as often as they are there.
    """
    small_batches(docs.sparkSession)
    rows = cut(training_rows(docs, labels, sample), "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        for batch in batches:
            both = [(b, int(t)) for b, t in zip(_bags(batch["text"]), batch["toxic"], strict=True) if b]
            yield pd.DataFrame(list(_counts([b for b, _ in both], [t for _, t in both])), columns=["feature", "n", "t"]).astype({"feature": object, "n": "int64", "t": "int64"})

    counts = cut(rows.mapInPandas(count, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t")), "toxicity-counts")
    total = counts.filter("feature = ''").first()
    prior = total.t / total.n if total and total.n else 0.0
    if prior in (0.0, 1.0):
        forget(rows, counts)
        return ToxicityModel(bias=20.0 if prior else -20.0, prior=prior)
    z = (F.col("t") - F.col("n") * prior) / F.sqrt(F.col("n") * (prior * (1 - prior)))
    best = counts.filter((F.col("feature") != "") & (F.col("n") >= MIN_DOCS)).withColumn("z", F.abs(z)).filter(F.col("z") >= LEAST_Z)
    names = [r.feature for r in best.orderBy(F.col("z").desc(), "feature").limit(WORDS).collect()]
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        for batch in batches:
            out = [(int(t), len(bag), *_numbers(bag, place.value)) for bag, t in zip(_bags(batch["text"]), batch["toxic"], strict=True) if bag]
            yield pd.DataFrame(out, columns=["toxic", "n", "sent", "feat"]).astype({"toxic": "int64", "n": "int64", "sent": object, "feat": object})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("toxicity")
        y, n, doc_of, sent, feat = [], 0, [], [], []
        for batch in batches:
            for label, k, s, f in zip(batch["toxic"], batch["n"], batch["sent"], batch["feat"], strict=True):
                first = len(doc_of)
                doc_of += [len(y)] * (int(s[-1]) + 1 if len(s) else 0)
                sent.append(np.asarray(s, dtype=np.int64) + first)
                feat.append(np.asarray(f, dtype=np.int64))
                y.append(label)
                n += k
        model = _weights(np.array(y, np.int64), n, np.array(doc_of, np.int64), np.concatenate(sent), np.concatenate(feat), names)
        weights = [("", model.bias), (" ", model.prior), *model.weights.items()]
        yield pd.DataFrame(weights, columns=["word", "weight"])

    pairs = rows.mapInPandas(numbers, "toxic long, n long, sent array<int>, feat array<int>")
    got = pairs.repartition(1).mapInPandas(fit, "word string, weight double").collect()
    forget(rows, counts)
    weights = {r.word: r.weight for r in got}
    return ToxicityModel(weights.pop("", -20.0), weights.pop(" ", 0.0), weights)


def toxicity_score(text: Column, model: ToxicityModel, spark) -> Column:
    """Score of each whole text; null and texts without words have the prior."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # WORDS weights at most

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        for batch in batches:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, repeated ones too. Scores see the text and nothing else.

    Null and empty texts, and texts without words, have the share of toxic labels as their score; a null id is not held
    out. No rows give none; without labels all scores are 0.
    """
    model = train_toxicity(docs, labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """``doc_id, begin, end, sentence, p`` of the sentences with at least that probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, a, b, t[a:b], p) for i, t in zip(batch["doc_id"], batch["text"], strict=True) if t for a, b, p in shared.value.sentences(t) if p >= threshold]
            yield pd.DataFrame(rows, columns=["doc_id", "begin", "end", "sentence", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, begin long, end long, sentence string, p double")
