"""Operator 6: byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique, so one id per prefix is stored. An
Aho-Corasick automaton over the vocabulary gives the tokens that are suffixes of a prefix, longest
first; the first that may follow the stored token of the shorter prefix is the one. Two tokens may
follow each other if merging their joint bytes gives exactly these two. Back-pointers then emit the
ids, the same as merging in rank order, in time that grows with the word and not with its square.

The vocabulary is a ``tokenizers`` file with byte-level BPE; its path has to exist on every worker. Special
tokens in a text are found first, as that library does. Words are split by the library's fixed pattern.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridterrain.llm.workers import worker_cache

# Fixed value: the pattern of byte-level pre-tokenization.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words kept with their ids, and tested pairs kept, in a worker; a full table is emptied.
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH = 600_000, 400_000, 64


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Awkward(Exception):
    """A blank next to other white space: the text has to be split as a whole."""


def is_awkward(run: str) -> bool:
    """Whether what stands between two blanks is empty, or begins or ends with white space."""
    return not run or run[0].isspace() or run[-1].isspace()


class Bpe:
    """A vocabulary with its merges, automaton and tables; ``words`` and ``runs`` map text to packed ids."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        unpack = lambda token: bytes(letters[c] for c in token)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take blanks or whole words are not supported")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = {i: unpack(t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.single = {self.bytes[vocab[c]]: vocab[c] for c in letters if c in vocab}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            if token not in self.special and self.merged(self.bytes[i]) == [i]:
                self.suffixes.add_word(self.bytes[i].decode("latin-1"), (len(self.bytes[i]), i))
        self.suffixes.make_automaton()
        self.find = regex.compile(WORD_PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else (lambda text: [text])
        self.words = Filled(lambda word: np.array(self.encode_word(word), "<u4").tobytes())
        self.runs = Filled(self._run)

    def merged(self, data: bytes) -> list[int]:
        """Ids by merging the pair of lowest rank, the leftmost first, until none is left."""
        ids = [self.single[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            rank, at, new = min((*self.ranks[p][:1], i, self.ranks[p][1]) if (p := (ids[i], ids[i + 1])) in self.ranks else (len(self.ranks), i, -1) for i in range(len(ids) - 1))
            if new < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand directly after ``a`` in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def encode_word(self, word: str) -> list[int]:
        data = word.encode().decode("latin-1")
        last: list[tuple[int, int] | None] = [None] * (len(data) + 1)
        for end, (length, token) in self.suffixes.iter(data):
            end += 1
            if last[end] is None:
                start = end - length
                if not start or (last[start] and self.follows(last[start][1], token)):
                    last[end] = (start, token)
        ids, at = [], len(data)
        while at:
            at, token = last[at]
            ids.append(token)
        return ids[::-1]

    def _join(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(text)))

    def _run(self, run: str) -> bytes:
        if is_awkward(run):
            raise Awkward
        return self._join(" " + run)

    def _encode_plain(self, text: str) -> bytes:
        """A text without special tokens. No word crosses a blank that stands alone, so runs between blanks are looked up."""
        first, *runs = text.split(" ")
        try:
            if runs and is_awkward(first):
                raise Awkward
            return self._join(first) + b"".join(map(self.runs.__getitem__, runs))
        except Awkward:
            return self._join(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._encode_plain(part) for part in self.parts(text))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Filled(dict):
    """Values made on demand by key; long keys are not kept and a full table is emptied, which bounds it."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[key] = value


def add_encoding(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each whole text (binary, little-endian unsigned 32-bit) and, if asked, the decoded text.

    A null or empty text has no ids and decodes to an empty text. Columns of these names are replaced.
    """
    added = [ids] + ([decoded] if decoded else [])
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(ids, F.lit(b"")).schema
    schema = schema.add(decoded, "string") if decoded else schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_cache(f"bpe:{path}", lambda: Bpe(path))
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                packed = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
                columns = [part.column(c) for c in kept] + [pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=kept + added)

    return docs.mapInArrow(encode, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of packed ids; null ids are an empty text."""
    kept = [c for c in docs.columns if c != decoded]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(decoded, "string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_cache(f"bpe:{path}", lambda: Bpe(path))
        for batch in batches:
            texts = [bpe.decode(i or b"") for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, decoded])

    return docs.mapInArrow(decode, schema)
