"""BPE encoding and decoding with the vocabulary and merges of a public tokenizer file.

A pre-token becomes a doubly linked list of symbols. A priority queue holds the merges of neighbouring symbols by
rank; an entry whose symbols have changed since it was pushed is stale and skipped. Decoding concatenates the
strings of the vocabulary. No pre-token reaches over a space, and what stands between spaces repeats, so each worker
keeps the packed ids of recent such chunks, and of the pre-tokens in them, in bounded caches.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Chunks, and pre-tokens, that a worker remembers in each of two generations, and characters that they have at most.
REMEMBERED = 100_000
REMEMBERED_LENGTH = 64
#: Texts of a batch that goes back to Spark.
ROWS = 500


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    table = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def tokenizer_spec(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs, checked to be of the supported kind."""
    with open(path, encoding="utf-8") as f:
        full = json.load(f)
    model, steps = full["model"], full["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in full["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        raise ValueError(f"{path}: only lower-casing byte-level BPE with a split pattern is supported")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]],
        "suffix": model.get("end_of_word_suffix") or "",
        "split": steps[0]["pattern"]["Regex"],
        "added": {a["content"]: a["id"] for a in full["added_tokens"]},
        "joined_by": " " if full["decoder"] is None else None,
    }


class Memory:
    """Packed ids of recent strings: two generations, of which the older is forgotten when the younger is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, word: str, make: Callable[[str], bytes]) -> bytes:
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = make(word)
            if len(word) <= REMEMBERED_LENGTH:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return found


class Tokenizer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: dict):
        if spec["joined_by"] is None:
            raise ValueError("only files without a decoder are supported: their tokens are joined by a space")
        self.vocab: dict[str, int] = spec["vocab"]
        self.suffix = spec["suffix"]
        self.joined_by = spec["joined_by"]
        self.added: dict[str, int] = spec["added"]
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        #: Rank and result of the merge of two tokens.
        self.merges = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(spec["merges"])}
        self.letters = byte_letters()
        # \s in the pattern is Unicode white space, which Python's own \s exceeds by four control characters.
        self.split = regex.compile(spec["split"].replace(r"\s", r"\p{White_Space}"))
        # Runs of white space that are anything but one plain space.
        self.space = regex.compile(r" \p{White_Space}+|[^\P{White_Space} ]\p{White_Space}*")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.chunks, self.words = Memory(), Memory()
        #: The string of each id, by place where ids are dense.
        self.table = [self.strings.get(i) for i in range(max(self.strings, default=-1) + 1)]

    def normalise(self, text: str) -> str:
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # Lower-casing goes by character: a final sigma is no special case.
        return text.replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        marks = [self.letters[b] for b in word.encode("utf-8", "replace")]
        if not marks:
            return []
        marks[-1] += self.suffix
        symbol = [i for m in marks if (i := self.vocab.get(m)) is not None]
        n = len(symbol)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        merges = self.merges
        queue = [(*m, i) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        queue = [(rank, i, made) for rank, made, i in queue]
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j < 0 or merges.get((symbol[i], symbol[j])) != (rank, made):
                continue  # stale: one of the two has been merged meanwhile
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, symbol[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbol[h], made))):
                heapq.heappush(queue, (m[0], h, m[1]))
        return [s for s in symbol if s >= 0]

    def _merged(self, word: str) -> bytes:
        return np.array(self.merge(word), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.words(w, self._merged) for w in self.split.findall(chunk)])

    def packed(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        out: list[bytes] = []
        for i, piece in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(np.array([self.added[piece]], "<u4").tobytes())
            elif piece:
                chunks = self.normalise(piece).split(" ")
                young = self.chunks.young
                found = list(map(young.get, chunks))
                if None in found:
                    found = [self.chunks(c, self._chunk) if f is None else f for c, f in zip(chunks, found, strict=True)]
                out += found
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings of ids, special tokens included; an id without a string is an error."""
        return self.joined_by.join(map(self.table.__getitem__, ids))


def _tokenizer(df: DataFrame, path: str):
    """Function that gives the worker's tokenizer; only the driver reads the file."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))
    own: list[Tokenizer] = []

    def get() -> Tokenizer:
        if not own:
            own.append(Tokenizer(shared.value))
        return own[0]

    return get


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with the ids of every whole text, packed as little-endian unsigned 32-bit integers, and their number.

    Null texts count as empty and have no ids. Rows, repeats and other columns stay; old columns of the two names
    are replaced. Texts are encoded one by one, so memory is bounded by the longest.
    """
    tokenizer = _tokenizer(df, path)

    def run(column: pa.Array) -> list[pa.Array]:
        t = tokenizer()
        packed = [t.packed(x.as_py() or "") for x in column]
        return [pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]

    return append_columns(df, [text], [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())], run, ROWS)


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of packed ids; null ids give null."""
    tokenizer = _tokenizer(df, path)

    def run(column: pa.Array) -> list[pa.Array]:
        t = tokenizer()
        return [pa.array([None if x is None else t.decode(np.frombuffer(x, "<u4").tolist()) for x in column.to_pylist()], pa.string())]

    return append_columns(df, [ids], [T.StructField(text, T.StringType())], run, ROWS)
