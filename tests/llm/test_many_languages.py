"""More languages than fit a model of all buckets."""

from __future__ import annotations

import numpy as np
import pytest

from flowbalance.llm.op5_language import BUCKETS, LEAST_BUCKETS, SIZES, identify, learn


def invented(n, seed=3):
    """A lexicon of 12 words for each of ``n`` languages, and a text of 40 words of each."""
    rng = np.random.default_rng(seed)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for _ in range(n)]
    return [(f"l{k:03d}", " ".join(rng.choice(w, 40))) for k, w in enumerate(words)]


def test_130_languages_are_told_apart(spark):
    rows = [(k, text, lang) for k, (lang, text) in enumerate(invented(130))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = learn(docs)
    assert len(langs) == 130 and model.shape == (len(SIZES) * BUCKETS // 2, 130)
    got = identify(docs, langs, model).select("row.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) == 130


def test_halved_buckets_are_those_of_a_smaller_model(spark):
    docs = spark.createDataFrame([(text, lang) for lang, text in invented(4)], "text string, lang string")
    langs, small = learn(docs, 1 << 12)
    assert small.shape[0] == len(SIZES) << 12
    same, halved = learn(docs, 1 << 14, most_cells=4 * len(SIZES) << 12)
    assert langs == same and np.array_equal(small, halved)


def test_no_model_beyond_the_least_buckets(spark):
    docs = spark.createDataFrame([("ab cd", f"l{k}") for k in range(5)], "text string, lang string")
    with pytest.raises(ValueError, match="over 4 languages"):
        learn(docs, most_cells=4 * len(SIZES) * LEAST_BUCKETS)
