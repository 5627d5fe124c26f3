"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, operator by operator."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from flowbalance.llm.op1_nearest import nearest
from flowbalance.llm.op2_suffix import remove_repeats
from flowbalance.llm.op3_urls import RULES, judge_urls
from flowbalance.llm.op4_minhash import near_groups
from flowbalance.llm.op5_language import identify, learn
from flowbalance.llm.op6_mix import mix
from flowbalance.llm.op7_quality import fit, score
from flowbalance.llm.op8_private import replace_private
from flowbalance.llm.op9_pack import pack
from flowbalance.llm.op10_exact import exact_groups
from tests.llm.helpers import EDGES, edge_docs, near_components, no_docs, squeezed, without_repeats

FILES = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
WITH_ID = [r for r in EDGES if r[0] is not None]


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups(spark, bits):
    """Narrow hashes make chunks of equal hash and different content; the result is the same."""
    got = exact_groups(edge_docs(spark), bits).collect()
    assert len(got) == len(EDGES)
    groups = Counter(squeezed(r[1]) for r in EDGES)
    best = {}
    for r in EDGES:
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[squeezed(r[1])] = min(best.get(squeezed(r[1]), (key, r[0])), (key, r[0]), key=lambda x: x[0])
    want = sorted((r[0] or -1, best[squeezed(r[1])][1] or -1, groups[squeezed(r[1])], hashlib.sha256(squeezed(r[1])).hexdigest()) for r in EDGES)
    assert sorted((g.doc_id or -1, g.keep_id or -1, g.group_size, g.text_sha256) for g in got) == want
    assert all(g.kept == (g.doc_id == g.keep_id) for g in got)
    assert exact_groups(no_docs(spark), bits).count() == 0


def test_near_groups(spark):
    got = near_groups(edge_docs(spark), width=4).collect()
    assert len(got) == len(EDGES)
    want = near_components(WITH_ID, 4)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got if g.doc_id is not None} == want
    nameless = [g for g in got if g.doc_id is None]
    assert [(g.n_shingles, g.component_id, g.kept) for g in nameless] == [(3, None, True)]
    assert near_groups(no_docs(spark)).count() == 0


def test_remove_repeats(spark):
    got = remove_repeats(edge_docs(spark), length=40, gram=8).collect()
    key = lambda x: (x[0] or -1, x[1:])
    assert sorted(map(tuple, got), key=key) == sorted(without_repeats([r if r[0] != 10 else (10, r[1], *r[2:]) for r in EDGES], 40), key=key)
    assert remove_repeats(no_docs(spark)).count() == 0


def test_urls(spark):
    rows = [(1, "https://Sub.Example.NET/en/x?q=1"), (2, "http://example.net/de/"), (3, "http://a.org/fr/1"), (4, "http://a.org/fr"), (5, None), (6, "no scheme"),
            (7, "ftp://x.example.com/de/#a"), (8, "http://net"), (9, "http://net/"), (10, "http://xnet/"), (11, "://"), (12, "http://example.net:80/en/"), (None, "http://a.net/\nb"), (9, "http://net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "rest")})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES).collect()]
    assert got == [
        (1, "sub.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "a.org", "/fr/1", "org/fr/", "allow"),
        (4, "a.org", "/fr", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "x.example.com", "/de/", "example.com/de/", "block"),
        (8, "net", "", None, "allow"), (9, "net", "/", "net/", "block"), (10, "xnet", "/", None, "allow"), (11, "", "", None, "allow"),
        (12, "example.net:80", "/en/", None, "allow"), (None, "a.net", "/\nb", "net/", "block"), (9, "net", "/", "net/", "block")]
    partial = [("block", "a.com/en"), ("allow", "a.com/english"), ("block", "a.com/english"), ("allow", "com")]
    got = judge_urls(spark.createDataFrame([(1, "x://a.com/ens"), (2, "x://a.com/english/1"), (3, "x://b.a.com"), (4, "x://com")], "page_id long, url string"), partial, "block").collect()
    assert [(r.rule, r.verdict) for r in got] == [("a.com/en", "block"), ("a.com/english", "block"), ("com", "allow"), ("com", "allow")]
    assert judge_urls(pages.where("false"), RULES).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, [("maybe", "a.com/")])


def test_language(spark):
    docs = edge_docs(spark)
    langs, model = learn(docs)
    assert langs == ["de", "en", "es"]  # the fr text has no letter, so nothing was learned
    got = identify(docs, langs, model).select("row.doc_id", "row.text", "row.score", F.col("lang_pred").alias("pred"), F.col("score").alias("s")).collect()
    assert len(got) == len(EDGES)
    for r in got:
        wordless = not any(c.isalpha() for c in r.text or "")
        assert (r.pred == "und") == wordless and 0 <= r.s <= 1 and r.score == "clash"
    assert {r.pred for r in got if r.doc_id in (1, 2, 11)} == {"en"}
    assert {r.lang_pred for r in identify(docs, *learn(docs.where("false"))).collect()} == {"und"}
    assert identify(no_docs(spark), langs, model).count() == 0


def test_mixing(spark):
    docs = edge_docs(spark)
    got = mix(docs, [3, 1, 2]).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted(r[0] or -1 for r in EDGES)
    sizes = {r[0]: len((r[1] or "").encode().split()) for r in EDGES}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    assert sum({r.source_size: 0 for r in got}) == sum(len((r[1] or "").encode().split()) for r in EDGES)
    assert [tuple(r) for r in sorted(mix(docs.repartition(7), [3, 1, 2]).collect(), key=str)] == [tuple(r) for r in sorted(got, key=str)]
    assert mix(no_docs(spark), [3, 1, 2]).count() == 0
    empty = mix(docs.where("doc_id in (4, 5)"), [3, 1, 2]).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0), (0.0, 0)]
    with pytest.raises(ValueError):
        mix(docs, [1], share=(5, 2), most=2)


def test_quality(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (10, 0), (11, 0), (4, None), (None, 1), (999, 1), (1, 1)], "doc_id long, label int")
    model = fit(docs, labels)
    got = score(docs, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1] > 0.5 > by_id[10] and by_id[4] == by_id[5]
    assert {r.score for r in score(docs, fit(docs, labels.where("false"))).collect()} == {0.5}
    assert score(no_docs(spark), model).count() == 0


def test_private(spark):
    got = replace_private(edge_docs(spark), "k").collect()
    texts = Counter((r[0], r[1]) for r in EDGES)
    assert Counter((r.doc_id, r.text) for r in got) == texts and all(r.n_entities == 0 for r in got)
    assert replace_private(no_docs(spark), "k").count() == 0


def test_packing(spark):
    docs = edge_docs(spark)
    got = pack(docs, *FILES).collect()
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(FILES[0])
    ids = Counter()
    for r in EDGES:
        found = np.array([*slow.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        n = -(-len(found) // 1024)
        cuts = [0, *(len(found) - 1024 * k for k in range(n - 1, -1, -1))]
        ids.update((r[0], k, a, b - a, zlib.crc32(found[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:k]) for k in range(len(parts))]
        assert sum(p[1] for p in parts) <= 1024
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 1024) + 1
    assert pack(no_docs(spark), *FILES).count() == 0


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (None, [1.0, 1.0]), (9, [-1.0, 0.5]), (10, [1.0, 2.0, 3.0]), (1, [1.0, 0.0]), (20, [5.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("raw", "code", "rank", "score", "dim")})
    got = nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
