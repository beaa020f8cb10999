"""Small documents with all that operators must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "th on and ing er st re", "de": "ung ich sch ver ein heit ge", "fr": "eau tre que oi ment ou ez"}


def sentence(rng: random.Random, lang: str, words: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words))


def rows(seed: int = 7, n: int = 60) -> list[tuple]:
    """Documents of three languages with copies, near copies, repeated lines, a hot source, nulls, empty and long texts."""
    rng = random.Random(seed)
    out: list[tuple] = []
    license_line = "All rights of this invented notice are reserved by nobody at all."
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        lines = [sentence(rng, lang, rng.randint(9, 40)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            lines.insert(1, license_line)
        out.append((i, "\n".join(lines), lang, "big" if i % 3 else f"s{i % 5}", None))
    for i in range(n, n + 12):  # copies, copies in capitals, near copies
        text = out[i % 5][1]
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        out.append((i, (text, text.upper(), " ".join(words))[i % 3], out[i % 5][2], "big", None))
    out += [(200, None, "en", None, None), (201, "", None, "big", 0), (202, " \n\t ", "de", "s1", 3), (203, "123 456 !!", "fr", None, 10)]
    out += [(204, sentence(rng, "en", 6_000), None, "s2", None), (205, "one two", "en", "s1", 7), (206, "one two", "en", "s1", 7)]
    return out


def documents(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
