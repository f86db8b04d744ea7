"""Packing of tokenized documents into sequences: shortest pack first over the length histogram."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, claim, joined_ids, slices, small_batches
from tidemark.sources.scratch import cut

#: Pieces of one length are ranked in groups of about so many, so no length is ranked in one task.
PER_SALT = 1_000
#: Characters of whole texts that a task tokenizes at a time.
SLICE = 1_000_000


#: Letters up to Latin Extended-B.
_PLAIN = re.compile(r"[A-Za-z\u00c0-\u024f]+")


def part_words(texts: list[str]) -> pa.Array:
    """The texts with a space between letters and other ASCII characters, and A-Z in lower case: fewer distinct words.

    A pre-token is letters, a digit or a run of others, so it ends where letters do; before letters it ends too, but for an
    apostrophe, which may begin one that has letters. Texts with marks that may combine (from U+0300 on) keep
    their case, for some marks combine with one case only. Those that may name a special token stay as they are.
    """
    column = pa.array([t.replace("\n", " ") for t in texts], pa.large_string())
    _, edges, data = column.buffers()
    edge = np.frombuffer(edges, np.int64)[: len(texts) + 1]
    if not edge[-1]:
        return column
    raw = np.frombuffer(data, np.uint8)[: edge[-1]]
    size = np.diff(edge)
    low = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    letter = ((low >= 97) & (low <= 122)).view(np.uint8)
    # Two bytes from C3 to C9 are a letter, but for the signs of multiplication and division, and for the capital I with a dot,
    # whose lower case ends with a mark.
    wide = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC9) & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))) & ~((raw[:-1] == 0xC4) & (raw[1:] == 0xB0))
    letter[:-1] |= wide.view(np.uint8)
    letter[1:] |= wide.view(np.uint8)
    other = (raw < 0x80) & (raw != 32) & ~letter.view(bool)
    parts = (letter[:-1].view(bool) & other[1:]) | (other[:-1] & (raw[:-1] != 39) & letter[1:].view(bool))
    whole = np.array(["<|" in t for t in texts])
    marks = np.concatenate([[0], np.cumsum(raw >= 0xCC)])
    cased = whole | (marks[edge[1:]] > marks[edge[:-1]])
    for i in np.flatnonzero(cased).tolist():
        low[edge[i] : edge[i + 1]] = raw[edge[i] : edge[i + 1]]
    for i in np.flatnonzero(whole).tolist():
        parts[edge[i] : edge[i + 1]] = False
    parts[(edge[1:-1] - 1)[(edge[1:-1] > 0) & (edge[1:-1] < edge[-1])]] = False  # between two texts
    at = np.flatnonzero(parts) + 1
    edge = edge + np.searchsorted(at, edge)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(edge), pa.py_buffer(np.insert(low, at, 32))])


class WordCoder:
    """A ``tokenizers`` file that lower-cases and whose pre-tokens never cross white space.

    Distinct words are encoded once per worker and batch cache. Most are letters (see ``part_words``), which are encoded many
    in one text, where the tokens that end a word tell them apart. All other words go through the library one by one.
    """

    _made: dict[str, WordCoder] = {}

    def __init__(self, path: str, memory: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        # The same model for words of letters that are normal already: they are parted at spaces alone.
        self.letters = Tokenizer(self.model.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.array([str(self.model.id_to_token(i)).endswith("</w>") for i in range(self.model.get_vocab_size())])
        self.words = Cache(2 * memory)  # some 200 bytes for 8 characters

    @classmethod
    def of(cls, path: str, memory: int = 4_000_000) -> WordCoder:
        if path not in cls._made:
            cls._made[path] = cls(path, memory)
        return cls._made[path]

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(words, add_special_tokens=False)] if words else []

    def _joined(self, roots: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(roots), 500):
            part = roots[i : i + 500]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, stops = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(part) and stops[-1] == len(raw) else self._each(part)
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        low = [w.lower() if w.isascii() or (_PLAIN.fullmatch(w) and unicodedata.is_normalized("NFC", w)) else "" for w in words]
        plain = [w.isalpha() for w in low]
        roots = iter(self._joined([w for w, p in zip(low, plain, strict=True) if p]))
        rest = iter(self._each([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(roots) if p else next(rest) for p in plain]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Spaces and newlines part the words here; other white space stays for the library."""
        parts = pc.split_pattern(part_words(texts), " ")
        coded = parts.values.dictionary_encode()
        # Words have no spaces, so they may become one string and be parted again: quicker than one by one.
        _, edges, data = coded.dictionary.buffers()
        edge = np.frombuffer(edges, np.int64)[: len(coded.dictionary) + 1]
        table = np.insert(np.frombuffer(data or b"", np.uint8)[: edge[-1]], edge[1:-1], 32).tobytes().decode().split(" ") if len(edge) > 1 else []
        known = self.words.get_all(table, self._encode)
        ids, each = joined_ids([known[w] for w in table], coded.indices.to_numpy(), np.diff(parts.offsets.to_numpy()))
        return np.split(ids, np.cumsum(each)[:-1])


def cut_pieces(docs: DataFrame, model: str, max_len: int = 2048, end_id: int = 1, memory: int = 4_000_000) -> DataFrame:
    """Tokenizes whole texts, adds ``end_id`` and cuts them at multiples of ``max_len``.

    Rows ``doc_id, start, length, ids_crc32, doc_tokens``. Null and empty texts have the end id alone. Ids
    may be null and of any type. A worker remembers words of ``memory`` characters, twice over, some 25 bytes each; it affects speed only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", WordCoder._made.clear)
        coder = WordCoder.of(model, memory)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out, at = [], 0
            # Texts stay in Arrow's buffer; those of a slice alone are strings.
            for texts in slices((x.as_py() for x in batch.column("text")), SLICE):
                for i, ids in enumerate(coder.encode(texts)):
                    raw = ids.astype("<u4").tobytes() + end
                    n = len(raw) // 4
                    for k in range(0, n, max_len):
                        part = raw[4 * k : 4 * (k + max_len)]
                        out.append((at + i, k, len(part) // 4, zlib.crc32(part), n))
                at += len(texts)
            table = np.array(out, dtype=np.int64).reshape(-1, 5)
            columns = [batch.column("doc_id").take(pa.array(table[:, 0])), *(pa.array(table[:, k]) for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns ``(count, lengths)`` for a histogram of lengths.

    Lengths go longest first, each into the pack with the most space left (the shortest pack); a
    new pack opens only when none has space. Packs alike are counted, not listed: the work grows
    with the number of distinct lengths and not with the number of documents.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pack: tuple[int, ...], space: int) -> None:
        (open_packs[space] if space else done).append((count, pack))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in open_packs.items() if packs), default=0)
            if space < length:
                each = max_len // length
                whole, rest = divmod(left, each)
                if whole:
                    put(whole, (length,) * each, max_len - each * length)
                if rest:
                    put(1, (length,) * rest, max_len - rest * length)
                break
            count, pack = open_packs[space].pop()
            used = min(count, left)
            if used < count:
                open_packs[space].append((count - used, pack))
            put(used, (*pack, length), space - length)
            left -= used
    return done + [p for packs in open_packs.values() for p in packs]


def pattern_places(patterns: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """For runs of ranks of a length: where they go. With ``j = r - first``, rank r lies in sequence ``sequence + j // copies``
    at ``offset + j % copies * length``. A pack is one row per distinct length, which are 63 at most in 2,048 tokens."""
    rows, used, sequence = [], defaultdict(int), 0
    for count, pack in patterns:
        offset = 0
        for length, same in groupby(pack):  # longest first, so equal ones are neighbours
            copies = len(list(same))
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += count * copies
            offset += copies * length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"]).astype("int64").sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, max_len: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``max_len`` tokens.

    The driver sees the histogram (``max_len`` rows at most); the patterns come back to the pieces by
    the rank of each piece among those of its length. Ranks are counted within salts and shifted by
    the salts' sizes; a length has as many salts as its pieces need, so a length that a third of all
    pieces have is spread over many tasks. Equal rows get places of their own; no pieces give no rows.
    """
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = pattern_places(shortest_pack_first(histogram, max_len))
    salts = spark.createDataFrame([(k, -(-n // PER_SALT)) for k, n in histogram.items()], "length long, _salts long")  # max_len rows at most
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_salts"))).drop("_salts")
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    shift = cut(sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")), "pack-sizes")
    # A single sorted key finds the run: rank below 2^48 within the length. The table is bounded by the lengths: each opens two
    # packs and splits one at most, and a pack has 63 rows, whatever the number of pieces.
    known = spark.sparkContext.broadcast(((places["length"].to_numpy() << 48) + places["first"].to_numpy(), *(places[c].to_numpy() for c in ("first", "copies", "sequence", "offset"))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, copies, sequence, offset = known.value
        size = length.to_numpy("int64")
        at = np.searchsorted(keys, (size << 48) + rank.to_numpy("int64"), side="right") - 1
        packs, nth = np.divmod(rank.to_numpy("int64") - first[at], copies[at])
        return pd.DataFrame({"sequence_id": sequence[at] + packs, "offset": offset[at] + nth * size})

    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")).cast("long") - 1
    # A row per length and PER_SALT pieces. Not hinted: Spark broadcasts it while it is small.
    return (
        salted.withColumn("_rank", rank)
        .join(shift.drop("_n"), ["length", "_salt"])
        .withColumn("_place", place("length", F.col("_rank") + F.col("_before")))
        .select(*pieces.columns, "_place.sequence_id", "_place.offset")
    )


def pack_documents(docs: DataFrame, model: str, max_len: int = 2048, end_id: int = 1, memory: int = 4_000_000) -> DataFrame:
    """One row per piece of each document with its place in a sequence; texts are tokenized once."""
    return pack(cut(cut_pieces(docs, model, max_len, end_id, memory), "pieces"), max_len)
