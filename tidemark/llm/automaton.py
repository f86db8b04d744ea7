"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens and accepts the sequences that the merges make of some word. It starts as one state
that any symbol leads back to. Each merge ``(u, v)``, in the order of the file, adds a gadget: after ``u`` a state
without the arc ``v``, and an arc ``uv`` wherever ``u`` may be read. Of all ways to cut a word into tokens one
alone is a path, and so is one alone of each of its beginnings: a pass from left to right has one state a place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Cache, claim, small_batches

#: Symbols of words in one table-driven pass, and the longest word for it; longer ones are read alone.
CELLS, LONGEST = 400_000, 400
#: Characters of texts that a task holds as words at a time.
BLOCK = 1_000_000
#: Printable ASCII needs no normalization but lower case, and its characters are byte symbols of their own.
_ASCII = re.compile(r"[!-~]+")


#: Decimal ids and labels, both joined by spaces.
Rendered = tuple[str, str]


@dataclass(frozen=True)
class Automaton:
    """Its tables. Their size depends on the merges alone (23 MB for 49,000), so they may be broadcast.

    ``arcs`` is a bit for each class of states (those with the same arcs) and class of tokens (those that the
    same states have). ``edges`` is the sorted trie of all tokens as sequences of symbols.
    """

    symbols: dict[str, int]
    labels: list[str]
    start: int
    after: np.ndarray  # token: class of the state that it leads to
    kind: np.ndarray  # token: its class
    width: np.ndarray  # token: its symbols
    arcs: np.ndarray
    n_kinds: int
    edges: np.ndarray  # node * symbols + symbol
    to: np.ndarray  # node that the edge leads to
    ends: np.ndarray  # node: the token that ends there, or -1

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        at = state.astype(np.int64) * self.n_kinds + self.kind[token]
        return (self.arcs[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def encode(self, words: list[list[int]]) -> list[np.ndarray]:
        """Token ids of words given as symbols, read side by side in groups of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        order, at = sorted(range(len(words)), key=lambda i: len(words[i])), 0
        while at < len(order):
            most = len(words[order[at]])
            upto = at
            while upto < len(order) and (k := max(most, len(words[order[upto]]))) <= LONGEST and (upto - at + 1) * k <= CELLS:
                most, upto = k, upto + 1
            group = order[at:upto] or order[at : at + 1]
            got = self._side_by_side([words[i] for i in group]) if upto > at else [self._alone(words[group[0]])]
            for i, ids in zip(group, got, strict=True):
                out[i] = ids
            at += len(group)
        return out

    def _side_by_side(self, words: list[list[int]]) -> list[np.ndarray]:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n, most = len(words), int(lens.max(initial=0))
        read = np.zeros((n, most), np.int64)
        read[np.arange(most) < lens[:, None]] = np.fromiter((s for w in words for s in w), dtype=np.int64, count=int(lens.sum()))
        state, last = np.zeros((n, most + 1), np.int32), np.zeros((n, most + 1), np.int32)
        state[:, 0] = self.start
        radix = len(self.symbols)
        for i in range(most):
            rows = np.flatnonzero(lens > i)
            node = np.zeros(len(rows), np.int64)
            for j in range(i, most):
                key = node * radix + read[rows, j]
                found = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                on = self.edges[found] == key
                rows, node = rows[on], self.to[found[on]]
                token = self.ends[node]
                hit = np.flatnonzero(token >= 0)
                hit = hit[self.has_arc(state[rows[hit], i], token[hit])]
                state[rows[hit], j + 1], last[rows[hit], j + 1] = self.after[token[hit]], token[hit]
                more = lens[rows] > j + 1
                rows, node = rows[more], node[more]
                if not len(rows):
                    break
        back, at, rows, count = np.zeros((n, most), np.int32), lens.copy(), np.flatnonzero(lens > 0), np.zeros(n, np.int64)
        while len(rows):
            token = last[rows, at[rows]]
            back[rows, count[rows]] = token
            count[rows] += 1
            at[rows] -= self.width[token]
            rows = rows[at[rows] > 0]
        return [b[:c][::-1] for b, c in zip(back, count, strict=True)]

    @cached_property
    def _steps(self) -> dict[int, int]:
        return dict(zip(self.edges.tolist(), self.to.tolist(), strict=True))

    def _alone(self, word: list[int]) -> np.ndarray:
        """One long word, in a time that is linear in its length."""
        steps, ends, radix = self._steps, self.ends.tolist(), len(self.symbols)
        state, last = [self.start] + [0] * len(word), [0] * (len(word) + 1)
        for i in range(len(word)):
            here, node, j = state[i], 0, i
            while j < len(word) and (node := steps.get(node * radix + word[j])) is not None:
                j += 1
                if (token := ends[node]) >= 0:
                    at = here * self.n_kinds + int(self.kind[token])
                    if self.arcs[at >> 3] >> (at & 7) & 1:
                        state[j], last[j] = int(self.after[token]), token
        ids, j = [], len(word)
        while j:
            ids.append(last[j])
            j -= int(self.width[last[j]])
        return np.array(ids[::-1], np.int32)


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Automaton:
    """One gadget for each merge. ``suffix`` marks tokens that end a word: nothing is read after them.

    All arcs of a token lead to one state, so a gadget changes the state after ``u`` alone. That state is copied
    if it is also that after other tokens. Its arcs are bits in columns by token, and columns alike are held once.
    """
    made = {u + v: (u, v) for u, v in merges}
    if len(made) != len(merges) or any(x not in vocab for x in made):
        raise ValueError("each merge must make a token of its own")
    inner = [t for t in vocab if t not in made and not t.endswith(suffix)]
    base = [t for t in vocab if t not in made]
    spelled = {t: (i,) for i, t in enumerate(base)}
    states = 2 + len(inner) + sum(not x.endswith(suffix) for x in made)
    columns = np.zeros((1024, -(-states // 8)), np.uint8)  # class of tokens by state
    kind, shared, n_kinds = {}, [len(base), 0], 2  # class 1: tokens that no word can have
    columns[0, 0] = 0b10  # state 1 is the start, state 0 has no arcs
    after, users, n_states = {}, [0, 1], 2
    for t in base:
        kind[t], after[t] = 0, 0 if t.endswith(suffix) else 1
        users[after[t]] += 1
    for u, v in merges:
        x, s = u + v, after[u]
        spelled[x] = spelled[u] + spelled[v]
        after[x] = 0 if x.endswith(suffix) else after[v]
        users[after[x]] += 1
        if not columns[kind[v], s >> 3] >> (s & 7) & 1:
            kind[x] = 1
            shared[1] += 1
            continue
        if users[s] > 1:  # a copy for u
            new, n_states = n_states, n_states + 1
            columns[:n_kinds, new >> 3] |= (columns[:n_kinds, s >> 3] >> (s & 7) & 1) << (new & 7)
            users[s] -= 1
            users.append(1)
            after[u] = s = new
        if shared[kind[v]] > 1:  # a column of its own for v
            if n_kinds == len(columns):
                columns = np.concatenate([columns, np.zeros_like(columns)])
            columns[n_kinds] = columns[kind[v]]
            shared[kind[v]] -= 1
            shared.append(1)
            kind[v], n_kinds = n_kinds, n_kinds + 1
        columns[kind[v], s >> 3] &= ~(1 << (s & 7)) & 255
        kind[x] = kind[u]
        shared[kind[x]] += 1
    tokens = sorted(vocab, key=vocab.__getitem__)
    if [vocab[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ids must run from 0 without gaps")
    unlike: dict[bytes, int] = {}
    kinds = np.array([unlike.setdefault(columns[k].tobytes(), len(unlike)) for k in range(n_kinds)])
    columns = np.frombuffer(b"".join(unlike), np.uint8).reshape(len(unlike), -1)
    rows: dict[bytes, int] = {}
    classes = np.zeros(n_states, np.int32)
    for s in range(n_states):
        bits = np.packbits(columns[:, s >> 3] >> (s & 7) & 1, bitorder="little")
        classes[s] = rows.setdefault(bits.tobytes(), len(rows))
    trie: dict[int, int] = {}
    ends = [-1]
    for t in tokens:
        node = 0
        for s in spelled[t]:
            key = node * len(base) + s
            if key not in trie:
                trie[key] = len(ends)
                ends.append(-1)
            node = trie[key]
        ends[node] = vocab[t]
    edges = np.array(sorted(trie), np.int64)
    return Automaton(
        symbols={t: i for i, t in enumerate(base)},
        labels=tokens,
        start=int(classes[1]),
        after=classes[[after[t] for t in tokens]].astype(np.int32),
        kind=kinds[[kind[t] for t in tokens]].astype(np.int32),
        width=np.array([len(spelled[t]) for t in tokens], np.int32),
        arcs=np.frombuffer(b"".join(rows), np.uint8),
        n_kinds=8 * -(-len(unlike) // 8),
        edges=edges,
        to=np.array([trie[k] for k in edges.tolist()], np.int64),
        ends=np.array(ends, np.int64),
    )


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Of a ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or not model.get("end_of_word_suffix"):
        raise ValueError("the automaton is for BPE with word ends, without unknown tokens, prefixes, fallback or dropout")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return compile_merges(model["vocab"], merges, model["end_of_word_suffix"])


def broadcast_automaton(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(automaton(path))


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text cut at spaces and newlines into parts of about ``size`` characters; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut < 0:
            found = [p for p in (text.find(" ", at + size), text.find("\n", at + size)) if p >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class AutomatonCoder:
    """Words to ids and labels for one Python worker: the library normalizes and splits, the automaton encodes.

    Distinct words are encoded once as long as the cache has them. Strings of added tokens in a text are those tokens.
    """

    _made: dict[str, AutomatonCoder] = {}

    def __init__(self, path: str, tables: Automaton):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.tables = model.normalizer, model.pre_tokenizer, tables
        added = model.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added.values()):
            raise ValueError("added tokens must be matched as they stand")
        self.added = {t.content: i for i, t in added.items()}
        self.labels = dict(enumerate(tables.labels)) | {i: t for t, i in self.added.items()}
        self.suffix = next(s[1:] for s in tables.symbols if len(s) > 1)
        ascii_ = ["".join(p for p, _ in self.pieces(c)) for c in map(chr, range(33, 127))]
        self.plain = _split_ascii if ascii_ == [c.lower() for c in map(chr, range(33, 127))] else None
        # Some 300 bytes for a word of 8 characters.
        self.words, self.parts = Cache(4_000_000), Cache(2_000_000)

    @classmethod
    def of(cls, path: str, tables: Broadcast) -> AutomatonCoder:
        if path not in cls._made:
            cls._made[path] = cls(path, tables.value)
        return cls._made[path]

    def pieces(self, word: str) -> list[tuple[str, tuple[int, int]]]:
        return self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word) if self.normalizer else word)

    def _parts(self, word: str) -> list[str]:
        if word in self.added:
            return [word]
        return self.plain(word.lower()) if self.plain and _ASCII.fullmatch(word) else [p for p, _ in self.pieces(word)]

    def _coded(self, parts: list[str]) -> list[Rendered]:
        symbols, own = self.tables.symbols, [p for p in parts if p not in self.added]
        got = iter(self.tables.encode([[*map(symbols.__getitem__, p[:-1]), symbols[p[-1] + self.suffix]] for p in own]))
        ids = [[self.added[p]] if p in self.added else next(got).tolist() for p in parts]
        return [(" ".join(map(str, x)), " ".join(map(self.labels.__getitem__, x))) for x in ids]

    def _render(self, words: list[str]) -> list[Rendered | None]:
        """Ids and labels of words, each without white space or an added token; none for a word without a part."""
        parts = list(map(self._parts, words))
        known = self.parts.get_all({p for ps in parts for p in ps}, self._coded)
        return [known[ps[0]] if len(ps) == 1 else (" ".join([known[p][0] for p in ps]), " ".join([known[p][1] for p in ps])) if ps else None for ps in parts]

    def _words(self, texts: list[str]) -> pa.ListArray:
        for t in self.added:
            texts = [x.replace(t, f" {t} ") for x in texts]
        return pc.split_pattern(pa.array([x.replace("\n", " ") for x in texts], pa.large_string()), " ")

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        parts = self._words(texts).to_pylist()
        known = self.words.get_all({w for ws in parts for w in ws if w}, self._render)
        return [[int(i) for w in ws if w and (k := known[w]) for i in k[0].split(" ")] for ws in parts]

    def rendered(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids and labels of each text."""
        parts = self._words(texts)
        coded = parts.values.dictionary_encode()
        table = coded.dictionary.to_pylist()
        known = self.words.get_all([w for w in table if w], self._render)
        values = [known[w] if w else None for w in table]
        there = np.array([v is not None for v in values], bool)
        at = coded.indices.to_numpy()
        keep = there[at] if len(at) else np.zeros(0, bool)
        offsets = pa.array(np.concatenate([[0], np.cumsum(keep)])[parts.offsets.to_numpy()], pa.int32())
        index = pa.array(at[keep])
        return tuple(pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([v[k] if v else "" for v in values], pa.string()).take(index)), " ") for k in (0, 1))


def _split_ascii(word: str) -> list[str]:
    return _WORD_PARTS.findall(word)


#: How the tokenizer file splits words of printable ASCII in lower case. A fixed value: the file's pattern without
#: what needs no match there. The coder compares it with the library before use.
_WORD_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _digests(coder: AutomatonCoder, texts: Iterable[str | None]) -> list[tuple[int, str, str]]:
    """``n_tokens`` and the digests of ids and labels. Long texts are hashed block by block."""
    count, ids, labels = [], [], []
    held: list[tuple[int, str]] = []

    def flush() -> None:
        if held:
            for (i, _), a, b in zip(held, *coder.rendered([x for _, x in held]), strict=True):
                raw, back = a.as_buffer(), b.as_buffer()
                if raw.size:
                    if count[i]:
                        ids[i].update(b" ")
                        labels[i].update(b" ")
                    count[i] += raw.to_pybytes().count(b" ") + 1
                    ids[i].update(raw)
                    labels[i].update(back)
            held.clear()

    size = 0
    for i, text in enumerate(texts):
        count.append(0)
        ids.append(hashlib.sha256())
        labels.append(hashlib.sha256())
        for block in blocks(text or ""):
            held.append((i, block))
            size += len(block)
            if size >= BLOCK:
                flush()
                size = 0
    flush()
    return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(count, ids, labels, strict=True)]


def bpe_digests(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256`` (of decimal ids joined by a space) and
    ``decoded_sha256`` (of the arc labels joined by a space, which is the library's decoding).

    Null and empty texts have no tokens and digests of the empty string; repeated rows and null ids give rows of
    their own, other columns are ignored, and no rows give none.
    """
    tables = broadcast_automaton(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("automaton", AutomatonCoder._made.clear)
        coder = AutomatonCoder.of(model, tables)
        for batch in batches:
            rows = _digests(coder, (x.as_py() for x in batch.column("text")))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_bpe(text: Column, model: str, tables: Broadcast) -> Column:
    """Ids of whole texts; null and empty give an empty array."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("automaton", AutomatonCoder._made.clear)
        coder = AutomatonCoder.of(model, tables)
        for batch in batches:
            yield pd.Series([[i for block in blocks(text or "") for i in coder.ids([block])[0]] for text in batch], dtype=object)

    return run(text)


def decode_bpe(ids: Column, model: str, tables: Broadcast) -> Column:
    """The labels of the arcs, joined by spaces as the library does; null gives null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("automaton", AutomatonCoder._made.clear)
        labels = AutomatonCoder.of(model, tables).labels
        for batch in batches:
            yield pd.Series([None if x is None else " ".join(labels[int(i)] for i in x) for x in batch], dtype=object)

    return run(ids)
