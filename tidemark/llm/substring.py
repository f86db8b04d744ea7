"""Substring dedup by sliding spans of consecutive sentences.

A text is cut into sentences by what it says there and not by where it stands: after stops (those of
clauses too), line ends, and words whose hash meets a condition, so that a passage lifted into
another text shares whole sentences with its source wherever it was pasted. Every run of
sentences (the shortest that starts at a sentence, has two sentences or more and enough words) is
hashed; runs are joined over the corpus, and sentences covered by any run that is not the first of
its kind are removed.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import claim, free_names, key_filter, slices, small_batches, with_maybe
from tidemark.sources.scratch import cut

#: A run has this many words at least. One word in CUT (on average) ends a sentence by its hash; where none does,
#: and no stop, a sentence ends after MOST words.
WORDS, CUT, MOST = 25, 6, 10
#: Characters of whole texts that a task cuts at a time.
SLICE = 250_000

#: Scripts without spaces between words, with their punctuation: each character counts as a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_STOPS = ".!?,;:\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: What a code point is: white space, a word by itself, a stop (added to the others).
_SPACE, _ALONE, _STOP = 1, 2, 4


def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for low, high in zip(_UNSPACED[::3], _UNSPACED[2::3], strict=True):
        out[ord(low) : ord(high) + 1] = _ALONE
    out[[c for c in range(1 << 16) if chr(c).isspace()]] = _SPACE  # the ideographic one too
    out[[ord(c) for c in _STOPS]] += _STOP
    return out


_CLASS = _classes()


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_CRC = _crc_table()


def _crc32(raw: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of ``raw``: short ones side by side, a byte of each at a time."""
    data, out = np.frombuffer(raw, np.uint8), np.zeros(len(begin), np.uint32)
    long = end - begin > 32
    for i in np.flatnonzero(long).tolist():
        out[i] = zlib.crc32(raw[begin[i] : end[i]])
    left = np.flatnonzero(~long & (begin < end))
    at, stop, crc = begin[left], end[left], np.full(len(left), 0xFFFFFFFF, np.uint32)
    while len(left):
        crc = _CRC[(crc ^ data[at]) & 255] ^ (crc >> 8)
        at = at + 1
        more = at < stop
        out[left[~more]] = ~crc[~more]
        left, at, stop, crc = left[more], at[more], stop[more], crc[more]
    return out


@dataclass
class Sentences:
    """The sentences of some texts, one after the other: parts that together are the texts."""

    raw: bytes  # all texts in UTF-8
    at: np.ndarray  # where a sentence begins in it, and its end
    words: np.ndarray  # words before a sentence, and in all
    text: np.ndarray  # the first sentence of each text, and their number
    _core: tuple[np.ndarray, np.ndarray]  # first and last word of a sentence in ``raw``
    _plain: np.ndarray  # whether its words have one space between them

    @classmethod
    def of(cls, texts: Sequence[str]) -> Sentences:
        whole = "".join(texts)
        raw = whole.encode("utf-8", "surrogatepass")
        code = np.frombuffer(raw, np.uint8) if len(raw) == len(whole) else np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        edge = np.concatenate([[0], np.cumsum(size)])
        classes = _CLASS[code]
        kind = classes & 3
        # A word begins behind a space, another kind or at the edge of a text. A token is a word and the white space behind it; the first
        # has that before it as well, and a text without words is one token.
        around = np.full(len(code) + 2, _SPACE, np.uint8)
        around[1:-1] = kind
        inner = edge[(edge > 0) & (edge < len(code))]
        before, after = around[:-2].copy(), around[2:].copy()
        before[inner], after[inner - 1] = _SPACE, _SPACE
        begin = np.flatnonzero((kind == _ALONE) | ((kind == 0) & (before != 0)))
        end = np.flatnonzero((kind == _ALONE) | ((kind == 0) & (after != 0))) + 1
        blank = edge[:-1][(size > 0) & (np.diff(np.searchsorted(begin, edge)) == 0)]
        if len(blank):
            place = np.searchsorted(begin, blank)
            begin, end = np.insert(begin, place, blank), np.insert(end, place, blank)
        first = np.searchsorted(begin, edge)  # tokens of a text
        start = begin.copy()
        start[first[:-1][size > 0]] = edge[:-1][size > 0]
        last = first[1:][size > 0] - 1

        if len(raw) == len(whole):
            byte = np.arange(len(code) + 1, dtype=np.int32)
        else:
            byte = np.zeros(len(code) + 1, np.int64)
            np.cumsum(1 + (code >= 0x80).view(np.uint8) + (code >= 0x800) + (code >= 0x10000), out=byte[1:])
        has = begin < end
        ends = np.zeros(len(begin), bool)
        ends[np.searchsorted(start, np.flatnonzero(code == 10), side="right") - 1] = True
        ends |= has & (classes[np.maximum(end, 1) - 1] >= _STOP) if len(code) else ends
        ask = np.flatnonzero(has & ~ends)
        ends[ask[_crc32(raw, byte[begin[ask]], byte[end[ask]]) % CUT == 0]] = True
        ends[last] = True
        to = np.flatnonzero(ends) + 1
        since = np.concatenate([[0], to])[: len(to)]
        pieces = (to - since - 1) // MOST + 1
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        to = np.minimum(np.repeat(since, pieces) + MOST * (nth + 1), np.repeat(to, pieces))
        since = np.concatenate([[0], to])[: len(to)]

        gap = begin[1:] - end[:-1]
        odd = (gap > 1) | ((gap == 1) & (code[end[:-1]] != 32)) if len(gap) else np.zeros(0, bool)
        odds = np.concatenate([[0], np.cumsum(odd)])
        plain = odds[to - 1] == odds[since]
        count = np.concatenate([[0], np.cumsum(has)])
        return cls(raw, byte[np.append(start[since], len(code))], count[np.concatenate([[0], to])], np.searchsorted(to, first, side="right"), (byte[begin[since]], byte[end[to - 1]]), plain)

    def parts(self, i: int) -> list[str]:
        """The sentences of a text."""
        at = self.at[self.text[i] : self.text[i + 1] + 1].tolist()
        return [self.raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at[:-1], at[1:], strict=True)]

    def runs(self, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Text, first sentence, end (both counted in the text) and digest of the run at each sentence that has one."""
        n = len(self.words) - 1
        text = np.repeat(np.arange(len(self.text) - 1), np.diff(self.text))
        ends = np.maximum(np.searchsorted(self.words, self.words[:-1] + words), np.arange(n) + 2)
        first = np.flatnonzero((ends <= self.text[1:][text]) & (np.diff(self.words) > 0))
        ends, text, digest = ends[first], text[first], xxhash.xxh3_128_digest
        each = [digest(self.raw[a:b]) for a, b in zip(self._core[0].tolist(), self._core[1].tolist(), strict=True)]
        for i in np.flatnonzero(~self._plain).tolist():
            each[i] = digest(" ".join(self.raw[self._core[0][i] : self._core[1][i]].decode("utf-8", "surrogatepass").split()).encode("utf-8", "surrogatepass"))
        all_ = b"".join(each)
        return text, first - self.text[text], ends - self.text[text], [digest(all_[i:j]) for i, j in zip((16 * first).tolist(), (16 * ends).tolist(), strict=True)]


def sentences(text: str) -> tuple[list[str], np.ndarray]:
    """Parts that together are the text, and the words before each part and in all."""
    found = Sentences.of([text])
    return found.parts(0), found.words


def runs(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """First sentence, end and digest of the run at each sentence; white space counts as one space."""
    return Sentences.of([text]).runs(words)[1:]


def _keyed(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns), ``text``, ``_id`` and ``_copy``, which tells rows of one id apart.

    A null id comes before all others; ids that are not whole numbers are ordered as strings.
    """
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ids = docs.select(F.struct("*").alias("_row"), "text", key.alias("_id"))
    again = cut(docs.select(key.alias("_id")).groupBy("_id").count().filter("count > 1").select("_id"), "repeated-ids")
    return with_maybe(ids, key_filter(again, "_id"), "_again", "_id").withColumn("_copy", F.when(F.col("_again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).drop("_again")


def spans(keyed: DataFrame) -> DataFrame:
    """``_id, _copy, first, end, h1, h2, again``: the runs of each text; ``again`` where the text has it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        for batch in batches:
            at = 0
            # Texts stay in Arrow's buffer; those of a slice alone are strings.
            for texts in slices((x.as_py() for x in batch.column("text")), SLICE):
                text, first, end, keys = Sentences.of(texts).runs()
                again, bounds = np.zeros(len(keys), bool), np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = keys[a:b]
                    if len(set(own)) < b - a:
                        seen: set[bytes] = set()
                        for i, k in enumerate(own, a):
                            again[i] = k in seen
                            seen.add(k)
                h, row = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2), pa.array(at + text)
                made = {"first": first.astype(np.int32), "end": end.astype(np.int32), "h1": h[:, 0], "h2": (h[:, 1] >> 32).astype(np.int32), "again": again}
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(row), batch.column("_copy").take(row), *map(pa.array, made.values())], names=["_id", "_copy", *made])
                at += len(texts)

    kind = keyed.schema["_id"].dataType.simpleString()
    return keyed.select("_id", "_copy", "text").mapInArrow(run, f"_id {kind}, _copy long, first int, end int, h1 long, h2 int, again boolean")


def _without(text: Column, ranges: Column) -> Column:
    """Struct of the text without the sentences in ``ranges``, and how many sentences it had and lost."""

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def run(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        claim("substring")
        out, every = [], zip(text, ranges, strict=True)
        for texts in slices(text, SLICE):
            found = Sentences.of(texts)
            for i, n in enumerate(np.diff(found.text).tolist()):
                t, rs = next(every)
                if rs is None:
                    out.append((t, n, 0))
                    continue
                drop = np.zeros(n + 1, dtype=np.int64)
                for r in rs:
                    drop[r["first"]] += 1
                    drop[r["end"]] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                out.append((t if t is None or not gone.any() else "".join(p for p, g in zip(found.parts(i), gone, strict=True) if not g), n, int(gone.sum())))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])

    return run(text, ranges)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the text cut, and two more: how many sentences it had and lost.

    These are ``_n_sentences`` and ``_n_removed``, with more underscores in front where ``docs`` has such
    columns. The first of equal runs is the one in the smallest ``doc_id``, earliest there. Each row stays,
    with an empty text if all of it repeats; null stays null, and no rows give none. Rows that share an id are not held
    against each other: they count as one document.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    found = cut(spans(keyed), "spans")
    shared = cut(found.filter("not again").groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "shared-spans")
    # Only runs that may be shared are shuffled again.
    maybe = with_maybe(found.filter("not again"), key_filter(shared, "h1", "h2"), "_maybe", "h1", "h2").filter("_maybe")
    far = maybe.join(shared, ["h1", "h2"]).filter("_id <> _first").select("_id", "_copy", "first", "end")
    near = found.filter("again").select("_id", "_copy", "first", "end")
    drop = cut(far.unionByName(near).groupBy("_id", "_copy").agg(F.collect_list(F.struct("first", "end")).alias("_ranges")), "covered")

    marked = with_maybe(keyed, key_filter(drop, "_id", "_copy"), "_maybe", "_id", "_copy")
    names = free_names(docs, "_n_sentences", "_n_removed")

    def result(df: DataFrame, ranges: Column) -> DataFrame:
        cut_text = df.withColumn("_out", _without(F.col("text"), ranges))
        return cut_text.select(*[F.col("_out.text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_out.n_sentences").alias(names[0]), F.col("_out.n_removed").alias(names[1]))

    none = F.lit(None).cast("array<struct<first:int,end:int>>")
    return result(marked.filter("not _maybe"), none).unionByName(result(marked.filter("_maybe").join(drop, ["_id", "_copy"], "left"), F.col("_ranges")))
