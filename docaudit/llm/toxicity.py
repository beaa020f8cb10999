"""Toxicity of texts after noisy-channel deobfuscation.

Disguised words (``1d!0t``, ``s t u p i d``, ``looooser``) are restored before they are scored. Each disguised span
is a lattice: a character may be the letter it looks like, a separator to skip, or a repetition to drop, each at a
cost. Viterbi decoding finds the cheapest path under a character trigram model that is counted over all documents.
The restored words are scored by features (whole words and their beginnings) that were learnt from labelled texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.session import ship_package

from .common import append_columns

#: Letters that a character may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
#: Costs (negative log likelihood) of a look-alike, a skipped separator, a dropped repetition, a skipped look-alike.
LOOK_COST, SKIP_COST, REPEAT_COST, LOSS_COST = 1.0, 0.5, 2.0, 5.0

#: Labelled documents of each class, at most, that the classifier is fitted on.
SAMPLE_DOCUMENTS = 20_000
#: Toxic documents that must hold a feature, and the deviations by which its rate is lowered: of many features some
#: are in toxic documents by chance.
LEAST_DOCUMENTS = 3
STEPS = 1_000
DEVIATIONS = 2.5
#: Lengths of word beginnings that are features, beside whole words.
BEGINNINGS = (4, 5, 6)
#: Tokens whose weight a worker remembers, in each of two generations.
REMEMBERED = 200_000

WORDS = re.compile(r"[^\W\d_]+")
#: Three or more single characters with separators between them.
SPACED = re.compile(r"(?<!\S)[\w@$!|+](?:[ .\-_*]{1,3}+[\w@$!|+](?![\w@$!|+])){2,}+")
#: A token with a look-alike or separator between or before letters, or three equal letters.
DISGUISED = re.compile(r"[^\W\d_].*?[0134578@$!|+*._\-].*?[^\W\d_]|(?:^|\W)[0134578@$!|+][^\W\d_]|[^\W\d_][0134578@$!|]$|([^\W\d_])\1\1", re.S)
EDGES = re.compile(r"^[^\w@$!|+]+|(?:([^\w\s])\1+|[^\w@$!|+])+$")


def _fold_table() -> dict[int, int]:
    """Code of letters: 1 to 26 for a to z with or without accents; others count as 0."""
    table = {}
    for p in range(0x61, 0x250):
        base = unicodedata.normalize("NFKD", chr(p))[0]
        if "a" <= base <= "z":
            table[p] = ord(base) - 96
    return table


FOLD = _fold_table()


def _code(ch: str) -> int:
    return FOLD.get(ord(ch), 0)


def trigram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all whole texts; runs of other characters are one boundary. Null texts are empty."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        codes = np.zeros(0x250, np.uint8)
        for p, c in FOLD.items():
            codes[p] = c
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                texts = whole.column(0).slice(at, 1_000).to_pylist()
                points = np.frombuffer((" " + "  ".join(t or "" for t in texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                c = codes[np.where(points < len(codes), points, 0)]
                c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int32)
                if len(c) > 2:
                    total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["gram", "n"])

    counts = np.zeros(27**3, np.int64)
    for r in df.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]
    return counts


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a letter after two others, from smoothed trigrams mixed with bigrams."""
    tri = counts.reshape(27, 27, 27).astype(float)
    bi = tri.sum(axis=0) + 0.5
    bi /= bi.sum(axis=1, keepdims=True)
    context = tri.sum(axis=2, keepdims=True)
    return -np.log((tri + 20 * bi[None, :, :]) / (context + 20))


def restore(span: str, costs: np.ndarray) -> str:
    """The cheapest reading of a disguised lower-case span, in letters a to z; empty if it has none.

    A state is the last two letters read. Work grows linearly with the span.
    """
    # state -> (cost, letters read as a linked list)
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before = ""
    for ch in span:
        options: list[tuple[int, float]] = []
        own = _code(ch)
        if own:
            options.append((own, 0.0))
        options += [(ord(x) - 96, LOOK_COST) for x in LOOKS_LIKE.get(ch, "")]
        skip = REPEAT_COST if own and ch == before else None if own else LOSS_COST if options else SKIP_COST
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letter, extra in options:
                total = cost + extra + costs[a, b, letter]
                if (b, letter) not in after or total < after[b, letter][0]:
                    after[b, letter] = (total, (letter, path))
            if skip is not None and ((a, b) not in after or cost + skip < after[a, b][0]):
                after[a, b] = (cost + skip, path)
        states, before = after or states, ch
    path = min(((cost + costs[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])[1]
    out = []
    while path:
        out.append(chr(path[0] + 96))
        path = path[1]
    return "".join(reversed(out))


def token_words(token: str, costs: np.ndarray) -> list[str]:
    """Words of a lower-case token, and its restored form if it is disguised."""
    words = WORDS.findall(token)
    if DISGUISED.search(token):
        core = EDGES.sub("", token)
        if core and DISGUISED.search(core) and (found := restore(core, costs)):
            words.append(found)
    return words


def spaced_words(text: str, costs: np.ndarray) -> list[str]:
    """Restored forms of letters that stand apart in a lower-case text, also without the first or last letter, which may be words."""
    return [w for m in SPACED.finditer(text) if (found := restore(m[0], costs)) for w in (found, found[1:], found[:-1]) if w]


def features(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in BEGINNINGS if len(word) >= n]]


def text_features(text: str, costs: np.ndarray) -> set[str]:
    low = text.lower()
    return {f for token in set(low.split()) for w in token_words(token, costs) for f in features(w)} | {f for w in spaced_words(low, costs) for f in features(w)}


@dataclass
class Model:
    """Letter costs, the rate of toxic texts for each feature that speaks for toxicity, and the score of the others."""

    costs: np.ndarray
    rates: dict[str, float]
    base: float
    threshold: float = 0.5
    young: dict[str, float] = field(default_factory=dict)
    old: dict[str, float] = field(default_factory=dict)

    def _rate(self, words: list[str]) -> float:
        return max((self.rates.get(f, 0.0) for w in words for f in features(w)), default=0.0)

    def token(self, token: str) -> float:
        found = self.old.get(token)
        if found is None:
            found = self._rate(token_words(token, self.costs))
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[token] = found
        return found

    def score(self, text: str | None) -> float:
        """``raw`` on a scale on which the threshold is one half."""
        r, t = self.raw(text), self.threshold
        return 0.5 * r / t if r < t else 0.5 + 0.5 * (r - t) / (1 - t)

    def raw(self, text: str | None) -> float:
        """The rate of the strongest feature of the restored text, at least ``base``."""
        low = (text or "").lower()
        best, known = self.base, self.young
        for t in set(low.split()):
            r = known.get(t)
            if r is None:
                r = self.token(t)
                known = self.young
            if r > best:
                best = r
        return max(best, self._rate(spaced_words(low, self.costs)))


def lower_rate(clean: int, toxic: int, weights: tuple[float, float] = (1.0, 1.0)) -> float:
    """Lower end of the Wilson interval of the rate of toxic documents, from as many documents as were seen.

    Documents of the sample count with the weight of their class in the rate. Clean ones that are not in the sample are
    taken to hold the feature by the rule of succession: that none was seen does not mean that there is none.
    """
    n, z = clean + toxic, DEVIATIONS**2
    p = weights[1] * toxic / (weights[0] * clean + weights[0] - 1 + weights[1] * toxic)
    return (p + z / (2 * n) - DEVIATIONS * (p * (1 - p) / n + z / (4 * n * n)) ** 0.5) / (1 + z / n)


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE_DOCUMENTS`` labelled documents of each class, chosen by a hash of the key.

    Each class weighs as much as all its labelled keys, so that the model is that of all rows at any size of the input.
    A document with several labels counts as toxic if one says so; rows without label or key teach nothing. Without
    a toxic document the model knows no feature and every score is 0.
    """
    spark = docs.sparkSession
    ship_package(spark)
    costs = letter_costs(counts)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    total = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    weights = tuple(max(1.0, total.get(c, 0) / SAMPLE_DOCUMENTS) for c in (0, 1))
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy("_toxic").orderBy(F.xxhash64("_key"), "_key")))
    # Bounded by the sample: at most two classes of SAMPLE_DOCUMENTS keys.
    sample = F.broadcast(ranked.filter(F.col("_rank") <= SAMPLE_DOCUMENTS).select("_key", "_toxic"))
    rows = docs.join(sample, docs[key] == F.col("_key")).select(F.col(text).alias("text"), F.col("_toxic").alias("toxic"))

    def count(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            seen = [0, 0]
            for b in batches:
                for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    here = text_features(x.as_py() or "", costs)
                    found[y].update(here if only is None else here & only)
                    seen[y] += 1
            names = [*found[0].keys() | found[1].keys()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*names, ""]), pa.array([*(found[0][f] for f in names), seen[0]], pa.int64()), pa.array([*(found[1][f] for f in names), seen[1]], pa.int64())],
                names=["feature", "clean", "toxic"],
            )

        return run

    schema = "feature string, clean long, toxic long"
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic")]
    common = rows.filter("toxic = 1").mapInArrow(count(None), schema).groupBy("feature").agg(*sums).filter((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("feature") != ""))
    wanted = {r["feature"] for r in common.select("feature").collect()}  # bounded by the sample
    table = {r["feature"]: (r["clean"], r["toxic"]) for r in rows.mapInArrow(count(wanted), schema).groupBy("feature").agg(*sums).collect()}
    clean, toxic = table.pop("", (0, 0)) if table else (0, 0)
    prior = weights[1] * toxic / (weights[0] * clean + weights[1] * toxic) if toxic else 0.0
    rates = {f: lower_rate(c, t, weights) for f, (c, t) in table.items()}
    model = Model(costs, {f: r for f, r in rates.items() if r > prior}, prior / 2)
    if toxic:
        model.threshold = best_threshold(rows, model, weights)
    return model


def best_threshold(rows: DataFrame, model: Model, weights: tuple[float, float]) -> float:
    """The raw score, in steps of a ``STEPS``-th, at which texts of least weight fall on the wrong side; the middle of equals."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STEPS + 1), np.int64)
        for b in batches:
            for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                total[y, int(shared.value.raw(x.as_py()) * STEPS)] += 1
        y, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(total[y, step])], names=["toxic", "step", "n"])

    total = np.zeros((2, STEPS + 1), np.int64)
    for r in rows.mapInArrow(run, "toxic int, step int, n long").groupBy("toxic", "step").agg(F.sum("n").alias("n")).collect():
        total[r["toxic"], r["step"]] = r["n"]
    wrong = weights[0] * (total[0].sum() - np.concatenate([[0], np.cumsum(total[0])])) + weights[1] * np.concatenate([[0], np.cumsum(total[1])])
    best = np.flatnonzero(wrong[1:-1] == wrong[1:-1].min()) + 1
    return float((best[0] + best[-1]) / 2 / STEPS)


def score(df: DataFrame, model: Model, text: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the toxicity (0 to 1) of every whole text.

    Null and empty texts, as all texts without a telling feature, get half the rate of toxic documents among the labelled ones.
    Rows, repeats and other columns stay; an old column of the name is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([shared.value.score(x.as_py()) for x in column], pa.float64())]

    return append_columns(df, [text], [T.StructField(score_col, T.DoubleType())], run)
