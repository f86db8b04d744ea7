"""Small shared parts: words, fixed-size key filters, text chunks encoded once per batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most bits of a key filter, whose broadcast side has a row of two longs for each 64 bits at most (2^20 rows, 32 MB).
FILTER_BITS = 1 << 26


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where ``df`` has such columns (whatever their case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does that (and is quick) where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


@dataclass
class KeyFilter:
    """A one-hash Bloom filter: a table ``(_fw, _fb)`` of 64-bit words, and its number of bits."""

    words: DataFrame
    bits: int


def key_filter(keys: DataFrame, *cols: str, most: int = FILTER_BITS) -> KeyFilter:
    """A filter of the keys with 32 bits or more for each, ``most`` in all.

    Its size is bounded by ``most`` whatever the number of keys, so it may be broadcast. From ``most``
    keys on it lets nearly all rows pass, which costs a shuffle of them; none of the keys is ever missed.
    ``keys`` should be a written table: it is counted first.
    """
    bits = min(most, 1 << max(20, (32 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(*cols), F.lit(bits))
    words = (
        keys.select(F.floor(place / 64).alias("_fw"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("_b"))
        .groupBy("_fw")
        .agg(F.bit_or("_b").alias("_fb"))
    )
    return KeyFilter(words, bits)


def with_maybe(df: DataFrame, filt: KeyFilter, name: str, *cols: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false if the row's key is surely not in the filter."""
    place = F.pmod(F.xxhash64(*cols), F.lit(filt.bits))
    hit = F.coalesce(F.getbit("_fb", (place % 64).cast("int")) == 1, F.lit(False))
    return (
        df.withColumn("_fp", place)
        .join(F.broadcast(filt.words), F.floor(F.col("_fp") / 64) == F.col("_fw"), "left")
        .withColumn(name, hit)
        .drop("_fp", "_fw", "_fb")
    )


def slices(texts: Iterable[str | None], limit: int = 4_000_000) -> Iterator[list[str]]:
    """Lists of whole texts of about ``limit`` characters, so that temporary arrays stay small."""
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of this session have ``most`` bytes or so, not 10,000 whole texts.

    A batch is held by the JVM, outside its heap and in buffers that grow by doubling, and again by the Python
    worker. A text longer than that is a batch of its own. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > most:
        spark.conf.set(name, f"{most}b")


_holders: dict[str, Callable[[], object]] = {}


#: Fixed values of malloc.h.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3


def claim(operator: str, clear: Callable[[], object] = bool) -> None:
    """Called by an operator's task as it begins: what other operators hold in this Python worker goes.

    Spark keeps workers for later stages, so tokenizers and caches of one stage would take memory from
    all that follow. ``clear`` drops what ``operator`` holds itself.
    """
    if not _holders:
        # glibc raises its threshold for memory that goes back to the system each time a large array is freed.
        with contextlib.suppress(AttributeError):
            ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, 1 << 18)
            ctypes.CDLL(None).mallopt(M_TRIM_THRESHOLD, 1 << 20)
    others = [o for o in _holders if o != operator]
    for other in others:
        _holders.pop(other)()
    _holders[operator] = clear
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


class Cache:
    """What keys were found to be, for one Python worker; at most ``most`` characters of keys.

    When full, only keys of the call at hand stay: that costs time and never changes a result.
    """

    def __init__(self, most: int):
        self.most, self.size, self.known = most, 0, {}

    def get_all(self, keys: Iterable[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dictionary that has all ``keys``; those that are new are made in one call."""
        keys = list(keys)
        new = [k for k in keys if k not in self.known]
        grown = self.size + sum(map(len, new))
        if grown > self.most:
            self.known = {k: self.known[k] for k in keys if k in self.known}
            grown = sum(map(len, self.known)) + sum(map(len, new))
        self.known.update(zip(new, make(new), strict=True) if new else ())
        self.size = grown
        return self.known


def joined_ids(parts: list[bytes], flat: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and each text's number of ids.

    ``parts`` has the ids (unsigned 32 bits) of each distinct chunk, ``flat`` the chunk numbers of
    all texts in order, ``per_text`` how many of them each text has.
    """
    if not len(flat):
        return np.zeros(0, np.uint32), np.zeros(len(per_text), np.int64)
    width = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    table, begin = np.frombuffer(b"".join(parts), dtype="<u4"), np.concatenate([[0], np.cumsum(width)[:-1]])
    each = width[flat]
    ends = np.cumsum(each)
    out = table[np.arange(ends[-1]) + np.repeat(begin[flat] - (ends - each), each)]
    return out, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])])


class ChunkTable:
    """Ids of texts by way of their distinct chunks: each chunk is encoded once, then looked up."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], most: int = 4_000_000):
        self.encode, self.cache = encode, Cache(most)

    def ids(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For lists of chunks (one for each text): all ids in order, and each text's number of ids."""
        place: dict[str, int] = {}
        flat = np.fromiter((place.setdefault(c, len(place)) for text in chunks for c in text), dtype=np.int64)
        known = self.cache.get_all(place, lambda new: [np.asarray(x, dtype="<u4").tobytes() for x in self.encode(new)])
        return joined_ids([known[c] for c in place], flat, np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks)))
