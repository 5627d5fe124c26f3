"""The pipeline's stages against brute-force versions."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES, exact_dedup, language_id, mixing, near_dedup, run
from flowbalance.llm.op9_pack import encoder
from tests.llm.helpers import DOCS, EDGES, edge_docs, near_components, no_docs, squeezed

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def crowded() -> list[tuple]:
    """A row many times over, and documents without an id: copies, near copies and others."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(10_000)}" for _ in range(100)]
    near = [" ".join([*base[:k], "other", *base[k + 1:]]) for k in (0, 50, 99)]
    rows = [(7, " ".join(base), "en", "a", 1)] * 20 + [(None, " ".join(base), "en", "a", 1)] * 5 + [(None, near[0], "en", "b", 1)] * 5
    rows += [(8, near[1], "en", "a", 1), (9, near[2] + " \n", "en", "a", 1), (9, near[2], "en", "a", 1)]
    rows += [(k % 3 or None, " ".join(f"w{draw.randrange(10_000)}" for _ in range(draw.randrange(6, 60))), "en", draw.choice("ab"), 1) for k in range(60)]
    return rows


def first_rows(rows: list[tuple], groups: dict, longest: bool) -> Counter:
    """(doc_id, text) of the one row that each group keeps."""
    found: dict = {}
    for k, r in enumerate(rows):
        place = (-len(r[1] or "") if longest else 0, r[0] is None, r[0] or 0)
        found[groups[k]] = min(found.get(groups[k], (place, r[:2])), (place, r[:2]), key=lambda x: x[0])
    return Counter(x[1] for x in found.values())


def test_dedup_keeps_one_row_of_a_group_whatever_its_id(spark):
    rows = crowded()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = exact_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == first_rows(rows, {k: squeezed(r[1]) for k, r in enumerate(rows)}, True)
    same = {k: c for k, (_, c) in near_components([(k, r[1]) for k, r in enumerate(rows)], 5).items()}
    got = near_dedup(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == first_rows(rows, same, False) and len(got) == 61


def test_mixing_decides_for_each_row(spark):
    """Rows without an id, and repeated ones, hold most of their sources."""
    draw = random.Random(12)
    rows = [(None, "w " * draw.randrange(1, 30), "en", "a", 1) for _ in range(200)] + [(5, "w " * 9, "en", "b", 1)] * 150 + [(k, "w " * 4, "en", "b", 1) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing(spark, docs, "")
    assert got.columns == docs.columns
    words = {r.source: r.words for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("words")).collect()}
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    aim = {"b": max(1.5 * sum(size.values()) / 4, 1.5 * sum(size.values()) - 2 * size["a"])}
    aim["a"] = 1.5 * sum(size.values()) - aim["b"]
    assert words == {s: pytest.approx(aim[s], abs=15) for s in aim}


def edges(spark):
    """With the names of the pipeline's own columns, as it once had them and as it has them now."""
    return edge_docs(spark).withColumns({c: F.lit("clash") for c in ("of", "copy", "row", "place", "same", "one", "stays", "corpus_pipeline_row_copies")})


def kept_by_dedup(rows: list[tuple]) -> list[tuple]:
    """Brute force of the first three stages."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    left = list(first_rows(rows, {k: squeezed(r[1]) for k, r in enumerate(rows)}, True).elements())
    same = {k: c for k, (_, c) in near_components(list(enumerate(x[1] for x in left)), 5).items()}
    return list(first_rows(left, same, False).elements())


def pieces(text: str) -> Counter:
    """(start, length) of the pieces of a text."""
    n = len(encoder(*FILES)(text)) + 1
    ends = [n - 1024 * k for k in range(-(-n // 1024) - 1, -1, -1)]
    return Counter((a, b - a) for a, b in zip([0, *ends], ends, strict=False))


def test_stages_on_edges(spark):
    docs, texts = edges(spark), Counter((r[0], r[1]) for r in EDGES)
    got = language_id(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({k: n for k, n in texts.items() if any(c.isalpha() for c in k[1] or "")})
    langs = {(r.doc_id, r.lang) for r in got.collect()}
    assert (3, "en") in langs and (1, "en") in langs  # a missing language is found, a given one stays
    assert got.columns[:5] == docs.columns[:5]
    nothing = language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert nothing.count() == got.count()  # nothing learned, nothing lost
    exact = first_rows(EDGES, {k: squeezed(r[1]) for k, r in enumerate(EDGES)}, True)
    assert Counter((r.doc_id, r.text) for r in exact_dedup(spark, docs, "").collect()) == exact
    same = {k: c for k, (_, c) in near_components([(k, r[1]) for k, r in enumerate(EDGES)], 5).items()}
    assert Counter((r.doc_id, r.text) for r in near_dedup(spark, docs, "").collect()) == first_rows(EDGES, same, False)
    mixed = mixing(spark, docs, "")
    assert mixed.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(rows) <= set(texts) and all(n <= 2 * texts[k] for k, n in rows.items())


def test_run_on_edges(spark, tmp_path):
    """What comes out are the pieces of texts that brute force keeps, each up to twice."""
    edges(spark).write.parquet(f"{tmp_path}/some/documents.parquet")
    no_docs(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    got: dict = {}
    for r in run(spark, f"{tmp_path}/some").collect():
        got.setdefault(r.doc_id, Counter())[r.start, r.length] += 1
    want = {d: pieces(t) for d, t in kept_by_dedup(EDGES)}
    assert got and set(got) <= set(want)
    for d, found in got.items():
        times = {n / want[d][k] for k, n in found.items()}
        assert set(found) == set(want[d]) and times <= {1, 2} and len(times) == 1
    assert 10 in got and 11 in got  # the longest
    assert run(spark, f"{tmp_path}/none").count() == 0
    assert [name for name, _ in STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
