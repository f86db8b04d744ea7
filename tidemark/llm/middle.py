"""Fill-in-the-middle over piece tables.

A document is a list of descriptors ``(buffer, start, length)`` over buffers that never change: buffer 0 is its
UTF-8 text, the others are the sentinels. Cuts split descriptors, an arrangement permutes them and adds
sentinels, the inverse permutation takes them back, and digests stream through them: no text is put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Arrangements of prefix (0), middle (1) and suffix (2) behind their sentinels, by form.
FORMS: dict[str, tuple[tuple[int, bytes], ...]] = {
    "psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)),
    "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE)),
}


class Piece(NamedTuple):
    """A stretch of a buffer: 0 is the document, k the sentinel k - 1."""

    buffer: int
    start: int
    length: int


def cut_at(table: Sequence[Piece], places: Sequence[int]) -> list[list[Piece]]:
    """The table's parts between places (rising, in bytes from its beginning): descriptors that a place lies in are split."""
    out: list[list[Piece]] = [[]]
    at, todo = 0, list(places)
    for piece in table:
        while todo and todo[0] < at + piece.length:
            k = todo.pop(0) - at
            if k:
                out[-1].append(Piece(piece.buffer, piece.start, k))
            out.append([])
            piece, at = Piece(piece.buffer, piece.start + k, piece.length - k), at + k
        if piece.length:
            out[-1].append(piece)
        at += piece.length
    return out + [[] for _ in todo]


def arrange(parts: Sequence[list[Piece]], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of the form, each behind its sentinel."""
    out: list[Piece] = []
    for k, sentinel in FORMS[form]:
        out += [Piece(1 + SENTINELS.index(sentinel), 0, len(sentinel)), *parts[k]]
    return out


def restore(output: memoryview | bytes, form: str) -> list[Piece]:
    """Descriptors over an output that give its text back: the stretches behind the sentinels, permuted back.

    Texts that hold a sentinel are left plain, so each stands once in other outputs.
    """
    if form == "plain":
        return [Piece(0, 0, len(output))] if len(output) else []
    raw = bytes(output)
    starts = [raw.index(s) for _, s in FORMS[form]]
    ends = [*starts[1:], len(raw)]
    back = {k: Piece(0, a + len(s), b - a - len(s)) for (k, s), a, b in zip(FORMS[form], starts, ends, strict=True)}
    return [back[k] for k in range(3) if back[k].length]


def stream(table: Sequence[Piece], text: memoryview | bytes) -> Iterator[memoryview]:
    """The bytes of a table, piece by piece, without a copy."""
    buffers = [memoryview(text), *map(memoryview, SENTINELS)]
    for p in table:
        yield buffers[p.buffer][p.start : p.start + p.length]


def digest(table: Sequence[Piece], text: memoryview | bytes) -> str:
    sha = hashlib.sha256()
    for part in stream(table, text):
        sha.update(part)
    return sha.hexdigest()


def token_ends(text: bytes) -> np.ndarray:
    """Where tokens end: a token is a word with the ASCII white space before it, or white space at the end."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    return np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(raw)) if len(raw) else np.zeros(0, np.int64)


def draws(doc_id: object, seed: int = 42) -> tuple[int, ...]:
    """Four numbers of 32 bits from the seed and the id; a null id counts as an empty one."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(raw[8 * k : 8 * k + 8], 16) for k in range(4))


def plan(doc_id: object, text: bytes, rate: int = 50, spm: int = 80, seed: int = 42) -> tuple[str, int, list[list[Piece]]]:
    """Form, number of tokens, and the descriptors of prefix, middle and suffix (of all of it, if plain)."""
    h = draws(doc_id, seed)
    whole = [Piece(0, 0, len(text))] if text else []
    ends = np.concatenate([[0], token_ends(text)])
    n = len(ends) - 1
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return "plain", n, [whole]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("spm" if h[3] % 100 < spm else "psm"), n, cut_at(whole, [int(ends[a]), int(ends[b])])


def _chars(table: Sequence[Piece], text: bytes) -> int:
    """Code points: bytes that continue none."""
    return sum(len(bytes(part).translate(None, _TAIL)) for part in stream(table, text))


_TAIL = bytes(range(0x80, 0xC0))
DESCRIPTORS = "array<struct<buffer:int,start:long,length:long>>"


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """A row per row of ``docs``: ``doc_id, n, form, pieces`` (descriptors), ``prefix_chars, middle_chars, output_sha256`` and
    ``restored_sha256`` (of the text that output and form give back; a difference fails the job).

    ``rate`` per cent of the texts are arranged, ``spm`` per cent of those suffix first. Cuts fall between tokens.
    Null and empty texts have no token and are plain, so are texts that hold a sentinel. Repeated rows
    give equal rows, a null id draws as an empty one, other columns are ignored, no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for doc_id, value in zip(ids, batch.column("text"), strict=True):
                held = value.as_buffer()
                text = held.to_pybytes() if held is not None else b""
                form, n, parts = plan(doc_id.as_py(), text, rate, spm, seed)
                table = parts[0] if form == "plain" else arrange(parts, form)
                sha = digest(table, text)
                output = b"".join(stream(table, text)) if form != "plain" else text
                back = digest(restore(output, form), output)
                if form != "plain" and back != hashlib.sha256(text).hexdigest():
                    raise ValueError(f"document {doc_id} is not restored")
                chars = (None, None) if form == "plain" else (_chars(parts[0], text), _chars(parts[1], text))
                rows.append((n, form, [p._asdict() for p in table], *chars, sha, back))
            kinds = [pa.int64(), pa.string(), _PIECES, pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n", "form", "pieces", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, pieces {DESCRIPTORS}, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def render(text: Column, pieces: Column) -> Column:
    """The output text of descriptors; null pieces give null. Stays in the JVM."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    names = F.array(*[F.lit(s.decode()).cast("binary") for s in SENTINELS])

    def part(p: Column) -> Column:
        own = F.substring(raw, (p["start"] + 1).cast("int"), p["length"].cast("int"))
        return F.when(p["buffer"] == 0, own).otherwise(F.get(names, p["buffer"] - 1))

    return F.decode(F.aggregate(F.transform(pieces, part), F.lit("").cast("binary"), lambda a, b: F.concat(a, b)), "UTF-8")
