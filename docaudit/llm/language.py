"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton holds a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in the sample; the number of phrases, times the bits that point into the sample, over the
length of the text estimates the cross entropy (Ziv and Merhav). The language with the smallest estimate wins.

Greedy parsing needs only forward transitions: where one is missing, the phrase ends and the next starts at the
root. This folds into one table ``state x letter -> next state and phrases ended``, so whole batches of texts are
parsed in step, one array lookup for each position and language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

#: Bounds of the sample that the models are fitted on: documents of each language, letters of each document and language.
SAMPLE_DOCUMENTS = 96
DOCUMENT_LETTERS = 1_500
LANGUAGE_LETTERS = 40_000
#: Letters with a column of their own in the table, the most frequent of the sample; others count as one unknown letter.
LETTERS = 200
#: Letters parsed in step, and texts below which a scalar loop is faster than steps.
BLOCK = 6_000_000
FEW = 24

UNKNOWN = "und"


@dataclass
class Model:
    """One table for all languages; ``roots`` and ``bits`` by language, ``letters`` gives a letter's column."""

    languages: list[str]
    letters: str
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray

    @property
    def width(self) -> int:
        return len(self.letters) + 1


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    go: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for ch in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and ch not in go[at]:
            go[at][ch] = new
            at = link[at]
        if at >= 0:
            below = go[at][ch]
            if length[below] == length[at] + 1:
                link[new] = below
            else:
                copy = len(go)
                go.append(dict(go[below]))
                length.append(length[at] + 1)
                link.append(link[below])
                while at >= 0 and go[at].get(ch) == below:
                    go[at][ch] = copy
                    at = link[at]
                link[below] = link[new] = copy
        last = new
    return go


def normalised(text: str) -> str:
    """Lower-case letters, every run of other characters being one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(samples: dict[str, str]) -> Model:
    """Automata of normalised sample texts by language, as one table."""
    samples = {k: v for k, v in sorted(samples.items()) if v}
    count: dict[str, int] = {}
    for text in samples.values():
        for ch in text:
            count[ch] = count.get(ch, 0) + 1
    letters = "".join(sorted(sorted(count, key=lambda c: (-count[c], c))[:LETTERS]))
    column = {c: i + 1 for i, c in enumerate(letters)}
    width = len(letters) + 1
    automata = [automaton(t) for t in samples.values()]
    table = np.zeros(sum(map(len, automata)) * width, np.int32)
    roots, base = [], 0
    for go in automata:
        root = base * width
        roots.append(root)
        # Entry: 4 * (next state * width) + phrases ended. A letter that even the root lacks is a phrase of its own.
        first = np.full(width, 4 * root + 1, np.int32)
        for ch, to in go[0].items():
            if ch in column:
                first[column[ch]] = 4 * (base + to) * width
        for s, moves in enumerate(go):
            row = first + (1 if s else 0)
            for ch, to in moves.items():
                if ch in column:
                    row[column[ch]] = 4 * (base + to) * width
            table[(base + s) * width : (base + s + 1) * width] = row
        base += len(go)
    bits = np.array([math.log2(len(t) + 1) for t in samples.values()])
    return Model(list(samples), letters, table, np.array(roots, np.int64), bits)


def train(df: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> Model:
    """Fit on a bounded sample of the labelled rows of ``df``, chosen by a hash of ``order``.

    At most ``SAMPLE_DOCUMENTS`` documents a language and ``DOCUMENT_LETTERS`` characters of each reach the driver.
    Rows without text or label teach nothing; without any row the model knows no language.
    """
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "text")
    rows = (
        df.select(F.col(lang).alias("lang"), F.col(order).alias("key"), F.substring(text, 1, DOCUMENT_LETTERS).alias("text"))
        .filter("lang IS NOT NULL AND text rlike '[\\\\p{L}]'")
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= SAMPLE_DOCUMENTS)
        .collect()
    )
    parts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        parts.setdefault(r["lang"], []).append(normalised(r["text"]))
    return fit({k: " ".join(v)[:LANGUAGE_LETTERS] for k, v in parts.items()})


def parse(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text for each language (rows: languages), and letters of each text."""
    column = {c: i + 1 for i, c in enumerate(model.letters)}
    blank = column.get(" ", 0)
    points = np.frombuffer("\n".join(t.replace("\n", " ") for t in texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    size = len(points)
    n = len(texts)
    if not size:
        return np.zeros((len(model.languages), n), np.int64), np.zeros(n, np.int64)
    to_code = np.zeros(int(points.max()) + 1, np.uint8)
    present = np.zeros(len(to_code), bool)
    present[points] = True
    letter = np.zeros(len(to_code), bool)
    for p in np.flatnonzero(present).tolist():
        if (c := chr(p)).isalpha():
            letter[p] = True
            to_code[p] = column.get(c, 0)
    is_letter = letter[points]
    cut = np.flatnonzero(points == 10)
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [size]])
    # A run of other characters is one space, and none stands at the start of a text.
    keep = is_letter.copy()
    keep[1:] |= ~is_letter[1:] & is_letter[:-1]
    keep[first[first < size]] &= is_letter[first[first < size]]
    keep[cut] = False
    code = np.where(is_letter, to_code[points], blank).astype(np.uint8)[keep]
    total = np.concatenate([[0], np.cumsum(keep)])
    start, end = total[first], total[last]
    seen = np.concatenate([[0], np.cumsum(is_letter)])
    letters = seen[last] - seen[first]
    return _walk(code, start, end - start, model), letters


def _walk(code: np.ndarray, start: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    k, n = len(model.languages), len(start)
    order = np.argsort(-length, kind="stable")
    start, sizes = start[order], length[order]
    state = np.repeat(model.roots[:, None], n, axis=1)
    count = np.zeros((k, n), np.int64)
    table, step = model.table, 0
    # active[t]: texts longer than t, a prefix as they are sorted by length
    while n and step < sizes[0]:
        active = int(np.searchsorted(-sizes, -step, side="left"))
        if active < FEW:
            break
        until = int(sizes[active - 1])
        at = start[:active] + step
        s, c = state[:, :active].copy(), count[:, :active].copy()
        for _ in range(step, until):
            v = table.take(s + code.take(at))
            c += v & 3
            s = (v >> 2).astype(np.int64)
            at += 1
        state[:, :active], count[:, :active] = s, c
        step = until
    if n and step < sizes[0]:
        flat = memoryview(table)
        for i in range(int(np.searchsorted(-sizes, -step, side="left"))):
            rest = code[start[i] + step : start[i] + sizes[i]].tobytes()
            for lang in range(k):
                s, c = int(state[lang, i]), 0
                for x in rest:
                    v = flat[s + x]
                    c += v & 3
                    s = v >> 2
                state[lang, i] = s
                count[lang, i] += c
    count += state != model.roots[:, None]
    out = np.empty_like(count)
    out[:, order] = count
    return out


def blocks(texts: list[str]) -> list[list[int]]:
    """Positions of texts, longest first, in blocks of at most ``BLOCK`` characters (or one text)."""
    out: list[list[int]] = []
    room = 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if len(texts[i]) > room or not out:
            out.append([])
            room = max(BLOCK, len(texts[i]))
        out[-1].append(i)
        room -= len(texts[i]) + 1
    return out


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the margin of the winner, 1 - best / second best."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return lang, score
    whole = [t or "" for t in texts]
    for block in blocks(whole):
        counts, letters = parse([whole[i] for i in block], model)
        cost = counts * model.bits[:, None]
        best = cost.argmin(axis=0)
        lowest = cost.min(axis=0)
        second = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else np.full(len(block), np.inf)
        for j, i in enumerate(block):
            if letters[j]:
                lang[i] = model.languages[best[j]]
                score[i] = 1 - lowest[j] / second[j] if second[j] else 0.0
    return lang, score


def identify(df: DataFrame, model: Model, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score (0 to 1) of every whole text.

    Null texts and texts without a letter get ``und`` and 0, as do all texts if the model knows no language. Equal
    costs go to the language that sorts first, with score 0. Old columns of the two names are replaced; rows,
    repeats and other columns stay. The model is bounded by its sample and travels as a broadcast variable.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        lang, score = predict(column.to_pylist(), shared.value)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return append_columns(df, [text], [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], run)
