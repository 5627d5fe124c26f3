"""Legal input that once gave wrong answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbalance.llm import op9_pack
from flowbalance.llm.op1_nearest import nearest
from flowbalance.llm.op3_urls import RULES, judge_urls
from flowbalance.llm.op7_quality import fit, score


def test_large_page_ids_beside_a_null(spark):
    rows = [(9007199254740993, "http://a.net/"), (None, "http://b.org/fr/"), (-9007199254740993, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string").coalesce(1)
    got = {r.page_id: (r.host, r.verdict) for r in judge_urls(pages, RULES).collect()}
    assert got == {9007199254740993: ("a.net", "block"), None: ("b.org", "allow"), -9007199254740993: ("", "allow")}


def test_labels_without_documents_use_up_no_sample(spark):
    docs = spark.createDataFrame([(k, "good clean words here" if k % 2 else "bad dirty junk there") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, 1) for k in range(1000, 21000)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in score(docs, fit(docs, labels, sample=64)).collect()}
    assert min(got[k] for k in range(1, 200, 2)) > 0.5 > max(got[k] for k in range(0, 200, 2))


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e30, 1e150])
def test_recall_at_any_magnitude(spark, scale):
    x = np.random.default_rng(7).standard_normal((900, 24)) * scale
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list[int]] = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        assert r.score == np.cumsum(x[r.query_id] * x[r.vec_id])[-1]
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i, found in got.items():
        score = np.cumsum(x * x[i], axis=1)[:, -1]
        order = [j for j in np.lexsort((np.arange(900), -score)) if j != i][:10]
        assert found == order
    assert len(got) == 45


def test_products_that_overflow(spark):
    rows = [(0, [1e200, 1e200]), (1, [-1e200, 1e200]), (2, [1e200, 1.0]), (3, [1.0, 1.0]), (4, [1e300, 0.0]), (5, [-1e200, -1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, str(r.score)) for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(2, "inf"), (4, "inf"), (3, "2e+200"), (5, "-inf"), (1, "nan")]


def test_packing_ends_where_no_exchange_helps(spark, monkeypatch):
    """Words of known lengths; groups of 50 pieces, so that rounds have to follow."""
    lengths = np.random.default_rng(3).integers(100, 600, 1500)
    docs = spark.createDataFrame([(k, str(n - 1)) for k, n in enumerate(lengths.tolist())], "doc_id long, text string")
    pieces = docs.selectExpr("doc_id", "0 AS piece", "0L AS start", "CAST(text AS LONG) + 1 AS length", "0L AS ids_crc32").toArrow()
    monkeypatch.setattr(op9_pack, "_pieces", lambda *_: _given(pieces))
    got = op9_pack.pack(docs.coalesce(1), "", "", "", group=50).toPandas()
    fills = got.groupby("sequence_id")["length"].sum()
    assert len(got) == 1500 and fills.max() <= 1024 and sorted(got["doc_id"]) == list(range(1500))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()[:-1]]
    assert len(fills) <= 1.01 * lengths.sum() / 1024


def _given(pieces):
    def rows(batches):
        for batch in batches:
            yield from pieces.to_batches()

    return rows
