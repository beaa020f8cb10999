import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.llm import bpe, language

from .helpers import SYLLABLES, documents, empty, rows, sentence

PATH = "/opt/tokenizers/word_bpe_49k.json"
ODD = ["", " ", "<|startoftext|>a<|endoftext|>", "ΑΣ Σ", "it's I'LL don'T 12 ½", "日本 語🎉", "é 　x\x85y", "İ ǅ", "z" * 300, "\x00\x1c"]


def phrases(text: str, sample: str) -> int:
    """Greedy parse into longest substrings of the sample, letter by letter."""
    count, at = 0, 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + max(n, 1)
    return count


@pytest.mark.parametrize("few", [0, 1_000])
def test_phrases_are_those_of_a_greedy_parse(monkeypatch, few):
    monkeypatch.setattr(language, "FEW", few)  # in step, or one by one
    rng = random.Random(3)
    samples = {k: language.normalised(sentence(rng, k, 300)) for k in SYLLABLES}
    model = language.fit(samples)
    texts = [sentence(rng, k, n) for k in SYLLABLES for n in (1, 7, 90)] + ["", "ß1ß", "  Qx—th", "TH\nON", "ж x"]
    counts, letters = language.parse(texts, model)
    for i, t in enumerate(texts):
        assert letters[i] == sum(c.isalpha() for c in t)
        for k, lang in enumerate(model.languages):
            got = counts[k, i] - (t.endswith("\n"))
            assert got == phrases(language.normalised(t), samples[lang]), (t, lang)


def test_languages_of_texts_that_were_not_learnt(spark):
    docs = documents(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.train(docs.filter(~held))
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(rows())
    for doc_id, text, lang, *_ in rows():
        r = found[doc_id]
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif lang and doc_id < 60 and zlib.crc32(str(doc_id).encode()) % 3 == 1:
            assert r["lang_pred"] == lang


def test_language_edges(spark):
    model = language.train(empty(spark))
    assert model.languages == []
    clash = documents(spark).withColumn("Score", F.lit("old")).withColumn("lang_pred", F.lit(1))
    out = language.identify(clash, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert {r["lang_pred"] for r in out.collect()} == {"und"}
    one = language.fit({"en": "th on and"})
    assert language.identify(empty(spark), one).count() == 0
    assert language.predict(["on"], one) == (["en"], np.array([1.0]))
    tie = language.fit({"a": "xy", "b": "xy"})
    assert language.predict(["xy"], tie)[0] == ["a"] and math.isclose(language.predict(["xy"], tie)[1][0], 0)


def test_ids_and_texts_are_those_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(PATH)
    texts = [*ODD, *(r[1] for r in rows())]
    docs = documents(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    out = bpe.decode(bpe.encode(docs.withColumn("n_tokens", F.lit("old")), PATH), PATH)
    for r in out.collect():
        want = theirs.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded"] == theirs.decode(want, skip_special_tokens=False)


def test_white_space_between_chunks():
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(PATH)
    mine = bpe.Tokenizer(bpe.tokenizer_spec(PATH))
    for text in (" a  b", "a\u3000b\u00a0 c\n\n d\t", "a\x1cb", "it's 's s's", "\u2028x\u200by ", "a<|endoftext|> b", "  ", "ǅ İ ΑΣ"):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == mine.encode(text) == want and mine.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark):
    assert bpe.encode(empty(spark), PATH).count() == 0
    ids = spark.createDataFrame([(1, None)], "doc_id long, token_ids binary")
    assert bpe.decode(ids, PATH).first()["decoded"] is None


def test_bounded_memory_of_pretokens(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    t = bpe.Tokenizer(bpe.tokenizer_spec(PATH))
    words = "one two three four five one two six seven one".split()
    assert t.encode(" ".join(words)) == [i for w in words for i in t.merge(w)]
    assert all(len(m.young) <= 3 and len(m.old) <= 3 for m in (t.chunks, t.words))
    assert t.encode("x" * 500) == t.merge("x" * 500) and "x" * 500 not in t.chunks.young
