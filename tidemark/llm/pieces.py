"""SentencePiece encoding and decoding, and token counts.

The pieces of the model never continue past a white-space marker, so a text falls into marked
words (a run of markers and what follows up to the next marker) that are segmented on their own.
A newline belongs to no piece and always becomes a byte piece, so it parts words as well.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ChunkTable, claim, slices

MARK = "▁"
#: Marked words of a text in which spaces are already markers; newlines stand alone.
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def marked_words(text: str) -> list[str]:
    """The chunks of a text as the model sees it: spaces are markers, one marker comes first."""
    return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceCoder:
    """The sentencepiece library with a table of distinct marked words; one for each Python worker."""

    _made: dict[str, PieceCoder] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("the model has pieces that cross white space; its texts can't be cut into marked words")
        self.lead = len(self.model.encode("\n"))
        self.table = ChunkTable(self._encode)

    @classmethod
    def of(cls, path: str) -> PieceCoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        # The library puts a marker before each text: it stands for the chunk's first one. A chunk
        # without a marker is encoded behind a newline, whose ids are then cut off.
        led = [c[0] != MARK for c in chunks]
        got = self.model.encode(["\n" + c if x else c[1:] if len(c) > 1 else "\n" for c, x in zip(chunks, led, strict=True)], num_threads=1)
        return [ids[self.lead :] if x else ids if len(c) > 1 else ids[: self.lead - 1] for ids, c, x in zip(got, chunks, led, strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, each = self.table.ids([marked_words(t) for t in texts])
        return np.split(ids, np.cumsum(each)[:-1])


def encode_decode(text: Column, model: str) -> Column:
    """Struct of the encoding with begin and end ids and of its decoding.

    ``n_tokens`` (all ids), ``ids_sha256`` (of little-endian unsigned 32-bit ids) and
    ``decoded_sha256`` (of the decoded text). Null is an empty text, whose ids are begin and end.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("pieces", PieceCoder._made.clear)
        coder = PieceCoder.of(model)
        ends = np.array([coder.model.bos_id()], "<u4").tobytes(), np.array([coder.model.eos_id()], "<u4").tobytes()
        for batch in batches:
            rows = []
            for texts in slices(batch):
                for ids in coder.encode(texts):
                    raw = ends[0] + ids.astype("<u4").tobytes() + ends[1]
                    back = coder.model.decode(np.frombuffer(raw, "<u4").tolist())
                    rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_ids(text: Column, model: str) -> Column:
    """The ids themselves, with begin and end ids."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("pieces", PieceCoder._made.clear)
        coder = PieceCoder.of(model)
        for batch in batches:
            yield pd.Series([[coder.model.bos_id(), *ids.tolist(), coder.model.eos_id()] for texts in slices(batch) for ids in coder.encode(texts)], dtype=object)

    return run(text)


def decode_ids(ids: Column, model: str) -> Column:
    """Texts of id arrays; null gives null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("pieces", PieceCoder._made.clear)
        coder = PieceCoder.of(model)
        for batch in batches:
            yield pd.Series([None if x is None else coder.model.decode([int(i) for i in x]) for x in batch], dtype=object)

    return run(ids)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``; rows may repeat.

    Ids may be null and of any type; no rows give none, other columns are ignored."""
    return docs.select("doc_id", encode_decode(F.col("text"), model).alias("e")).select("doc_id", "e.*")


def frequent_lengths(docs: DataFrame, model: str, entries: int = 65_536, per_task: int = 4096, longest: int = 64, counted: int = 200_000) -> dict[str, int]:
    """The first tier: token counts of the most frequent marked words of all texts.

    Each task counts the words of its whole texts in a table of at most ``counted`` words, forgetting
    the rarer half when that is full, and hands on its ``per_task`` most frequent ones; only these sums are
    shuffled. A word that is missing in the end only costs an encoding by the second tier. At most ``entries`` words of at most
    ``longest`` characters, so the table stays under 20 MB whatever the corpus.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("pieces", PieceCoder._made.clear)
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                words = [w for w in marked_words(text or "") if len(w) <= longest]
                for at in range(0, len(words), counted):
                    seen.update(words[at : at + counted])
                    if len(seen) > counted:
                        seen = Counter(dict(seen.most_common(counted // 2)))
        top = [(w, n) for w, n in seen.most_common(per_task) if n > 1]
        yield pd.DataFrame(top, columns=["word", "n"]).astype({"word": object, "n": "int64"})

    sums = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r.word for r in sums.orderBy(F.col("n").desc(), "word").limit(entries).collect()]
    return dict(zip(words, map(len, PieceCoder.of(model)._encode(words)), strict=True)) if words else {}


def count_tokens(text: Column, model: str, frequent: Broadcast, misses: int = 300_000) -> Column:
    """Number of ids of each whole text, without begin and end ids; null and empty give 0.

    A word is looked up in the broadcast table of frequent words, then in the worker's own cache of
    at most ``misses`` words; what is in neither is encoded by the library. No word is shuffled.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("pieces", PieceCoder._made.clear)
        coder, common = PieceCoder.of(model), frequent.value
        cache: dict[str, int] = {}
        for batch in batches:
            counts = []
            for texts in slices(batch):
                words = [marked_words(t) for t in texts]
                new = list({w for ws in words for w in ws if w not in common and w not in cache})
                if len(cache) + len(new) > misses:
                    cache = {w: cache[w] for ws in words for w in ws if w in cache}
                cache.update(zip(new, map(len, coder._encode(new)), strict=True) if new else ())
                for ws in words:
                    counts.append(sum(common[w] if w in common else cache[w] for w in ws))
            yield pd.Series(counts, dtype="int64")

    return run(text)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, repeated ones too.

    A null text counts as empty, with 0 bytes and tokens; ids may be null and of any type. No rows give none; other
    columns are ignored.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model))
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), count_tokens(text, model, table).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
