"""Merkle manifest, conversation repair and n-gram Jaccard join against brute-force versions."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbalance.llm import op13_jaccard
from flowbalance.llm.common import cut_by
from flowbalance.llm.op11_merkle import butterfly, manifest
from flowbalance.llm.op12_repair import damaged, folded, lr_table, parsed, repair, stacks, transfer
from flowbalance.llm.op13_jaccard import bands, set_keys, similar_groups, sketched_apart, sketches
from tests.llm.helpers import EDGES, edge_docs, no_docs, word_set

# ---- op11


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: tuple) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes: list[str]) -> tuple[str, list[list]]:
    """(root, per leaf the siblings left and right of its way)."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for i in range(0, len(nodes), 3):
            run = nodes[i:i + 3]
            for k in range(len(run)):
                for x in own[i + k]:
                    paths[x].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(digest("".join(run)))
            owners.append(sum(own[i:i + 3], []))
        nodes, own = above, owners
    return nodes[0], paths


def manifest_of(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = [tree([leaf(r) for r in ordered[s]]) for s in sources]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), upper in zip(sources, trees, above, strict=True):
        for r, path in zip(ordered[s], paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for left, right in path + upper:
                node = digest(left + node + right)
            out.append((r[0], leaf(r), subroot, root, digest("".join(a + b for a, b in path + upper)), node, node == root))
    return out


def tampered(docs):
    return manifest, (docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))


def by_id(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_on_edges(spark, levels):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in EDGES]
    make, args = tampered(edge_docs(spark).repartition(3))
    got = make(*args, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_id(got.collect()) == by_id(manifest_of(rows))
    make, args = tampered(no_docs(spark))
    assert make(*args, levels).count() == 0


def test_manifest_of_many_blocks_and_sources(spark):
    """Sources of 1 to 90 leaves in blocks of three, a repeated row and rows without an id."""
    draw = random.Random(11)
    rows = [(k if draw.random() < 0.9 else None, draw.choice(["a", "b", "é", None, *"cdefghijk"] if k > 200 else ["a"]), "en", k, draw.choice(["x\ny", "z", None])) for k in range(300)]
    rows += [(5, "a", "en", 5, "same\n")] * 40
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    make, args = tampered(docs)
    got = by_id(make(*args, 1).collect())
    assert got == by_id(manifest_of(rows))
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28, 82])
def test_butterfly_gives_every_node_its_proof(spark, n):
    names = [digest(str(k)) for k in range(n)]
    nodes = spark.createDataFrame([(0, k, n, x) for k, x in enumerate(names)], "tree long, place long, total long, node string")
    rounds = next(r for r in range(9) if 3 ** r >= n)
    got = {r.place: (r.node, list(zip(r.lefts, r.rights, strict=True))) for r in butterfly(nodes, "tree", rounds).collect()}
    root, paths = tree(names)
    assert got == {k: (root, paths[k]) for k in range(n)}


# ---- op12

TURNS = "conv_id long, turn long, role string, text string"


def damage(rows: list[tuple]) -> dict:
    convs: dict = {}
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        convs.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        convs[conv_id] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return convs


AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple], faults: list[str]) -> tuple:
    """(cost, audit, repaired rows), by searching whole edit strings state by state."""
    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for r in AFTER[state].replace("s", ""):
                    best[r] = min(best.get(r, (9 ** 9,)), (cost + 2, audit + "I", (*out, (FULL[r], ""))))
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after: dict = {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 3, "D", ())]
            if fault in ("", "truncated"):
                more = cost + (fault != "")
                ways += [(role[0], more, "K", ((role, text),))] if role and role[0] in AFTER[state] else []
                ways += [(r, more + 2, "R", ((FULL[r], text),)) for r in AFTER[state].replace("s", "")]
            for to, price, edit, made in ways:
                after[to] = min(after.get(to, (9 ** 9,)), (price, audit + edit, out + made))
        best = inserted(after)
    return min(v for k, v in best.items() if k in ("", "a"))


def repair_of(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv_id, turns in damage(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(f"{len(t[1].encode())}:{t[1]}{t[2]}")))
        numbers = [t[0] for t in turns if t[0] is not None]
        faults, seen = [], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, left = cheapest(turns, faults)
        out.append((conv_id, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, digest("\n".join(f"{r}:{t}" for r, t in left))))
    return out


def repaired_rows(df):
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    return repair(damaged(df, F.crc32(key) % 20))


def test_repair_on_edges(spark):
    draw = random.Random(12)
    roles, texts = ["user", "assistant", "system", None, "tool", "", "urge", "assistant"], ["a.", "b?", "c", " ", "", None, "d! ", "é…", "x" * 100_000 + "."]
    rows = [(c, draw.choice([None, *range(40)]), draw.choice(roles), draw.choice(texts)) for c in [*range(25), None] for _ in range(draw.choice([1, 2, 3, 5, 9, 40]))]
    rows += [(c, 0, "user", "gone.") for c in range(300, 400)]  # some lose all their rows
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("kind", "lost", "at", "audit", "cost", "copy", "same", "gaps")})
    got = repaired_rows(df.repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = by_id(repair_of(rows))
    assert by_id(got.collect()) == want
    assert any(r[7] == "" and r[8] == digest("") for r in want)
    assert repaired_rows(df.where("false")).count() == 0


def test_repair_of_a_long_conversation(spark):
    """One conversation over many tasks and segments."""
    draw = random.Random(13)
    rows = [(7, k, draw.choice(["user", "assistant"]), f"x{k}{draw.choice(['.', ''])}") for k in range(5000)] + [(8, 0, "user", "hi.")]
    got = repaired_rows(spark.createDataFrame(rows, TURNS).repartition(9)).collect()
    assert by_id(got) == by_id(repair_of(rows))


def test_segments_fold_to_the_whole():
    draw = random.Random(14)
    for _ in range(50):
        rows = "".join(draw.choice("sua-") + draw.choice("00123") for _ in range(draw.randrange(30)))
        cuts = sorted(2 * draw.randrange(len(rows) // 2 + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert {e: (c, a) for s, e, c, a in folded([transfer(p) for p in parts]) if s == 0} == parsed({0: (0, "")}, rows)


def test_stacks_have_the_same_numbers_in_every_process():
    """Driver and workers hash strings differently."""
    code = "from flowbalance.llm.op12_repair import stacks; print(stacks())"
    found = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": seed}, capture_output=True, check=True).stdout for seed in "123"}
    assert len(found) == 1


def test_grammar_by_its_table():
    """The stacks accept just what the grammar's regular expression does."""
    table, ends = stacks()
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            at: int | None = 0
            for c in word:
                at = table[at].get(c) if at is not None else None
            assert (at in ends) == bool(re.fullmatch("(s?(ua)+)?", "".join(word)))
    moves, reduces = lr_table((("x", ("(", "x", ")")), ("x", ("y",))))
    assert moves[0, "("] and all(t in ("$", ")") for _, t in reduces)


# ---- op13


def jaccard_of(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = {d: word_set(t, width) for d, t in rows}
    ids, label = sorted(sets), {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), root(d)) for d in ids]


def groups(spark, rows, width, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(map(tuple, similar_groups(df, width, percent).collect()))


def test_jaccard_on_edges(spark):
    got = similar_groups(edge_docs(spark), width=4, percent=85)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [tuple(r) for r in got.collect()]
    named = [(r[0], r[1]) for r in EDGES if r[0] is not None]
    want = {r[0]: r for r in jaccard_of(named, 4, 85)}
    assert len(rows) == len(EDGES) and {r[0]: r for r in rows if r[0] is not None} == want
    assert [r for r in rows if r[0] is None] == [(None, 3, None)]
    assert similar_groups(no_docs(spark)).count() == 0


def test_jaccard_of_chains(spark):
    """Chains of edits, from sets of one element to some hundred."""
    draw, rows = random.Random(15), []
    for _ in range(60):
        words = [f"w{draw.randrange(10 ** 6)}" for _ in range(draw.choice([3, 4, 6, 8, 9, 10, 12, 15, 20, 40, 80, 200]))]
        for _ in range(draw.choice([2, 3, 8])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(draw.choice([0, 1, 1, 2])):
                i, way = draw.randrange(len(words)), draw.random()
                words[i:i + 1] = [f"w{draw.randrange(10 ** 6)}"] if way < 0.3 else [words[i], f"w{draw.randrange(10 ** 6)}"] if way < 0.6 else []
                words = words or ["w"]
    assert groups(spark, rows, 4, 85) == jaccard_of(rows, 4, 85)
    assert groups(spark, rows, 1, 60) == jaccard_of(rows, 1, 60)


def test_jaccard_over_few_words(spark):
    """Subsets of 40 words: many empty segments and shared ones."""
    draw = random.Random(16)
    rows = [(k, " ".join(draw.sample([f"t{i}" for i in range(40)], draw.randrange(1, 30)))) for k in range(300)]
    assert groups(spark, rows, 1, 70) == jaccard_of(rows, 1, 70)


def test_texts_of_one_document_link_for_it(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:30], "x", *base[31:]])), (2, "quite another text of some words"), (3, "quite another text of some words")]
    assert {r[0]: r[2] for r in groups(spark, rows, 1, 85)} == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    """No pair over the threshold is without a common key that one of the two looks up."""
    draw = random.Random(17)
    for _ in range(150):
        n = draw.choice([1, 2, 3, 5, 7, 8, 12, 20, 50, 150])
        whole = np.array([draw.getrandbits(64) for _ in range(2 * n)], np.uint64)
        one = np.unique(whole[:n])
        both = draw.randrange(-(-percent * n // 100), n + 1)
        extra = draw.randrange(0, 1 + max(0, min(n, 100 * both // percent - n)))
        other = np.unique(np.concatenate([one[:both], whole[n:n + extra]]))
        if 100 * both < percent * (n + extra):
            continue
        key, of, looked, least = set_keys(np.concatenate([one, other]), np.array([0, len(one), len(one) + len(other)]), percent)
        seen = [set(key[of == k].tolist()) for k in (0, 1)]
        if set(one.tolist()) != set(other.tolist()):
            assert seen[0] & seen[1] & set(key[looked].tolist())
            assert all(len(seen[0] & seen[1]) >= least[of == k].min() for k in (0, 1))


def test_bands_hold_every_linked_pair():
    for percent in (60, 85, 99):
        starts, differ = bands(400, percent)
        band = np.searchsorted(starts, np.arange(1000), side="right") - 1
        for low in range(1, 400):
            for high in range(low, 100 * low // percent + 1):
                assert band[high] - band[low] in (0, 1)
                least = -(-percent * (low + high) // (100 + percent))
                assert low + high - 2 * least <= differ[band[low]]


def test_the_jaccard_join_gives_back_its_shuffles(spark):
    """Shuffles of steps whose results are written out leave the disk, without a garbage collection of the driver."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = manager.getAllBlocks()
        return {str(found.apply(k)).split("_")[1] for k in range(found.size()) if str(found.apply(k)).startswith("shuffle_")}

    held = shuffles()
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:50 + i % 7])) for i in range(40)] + [(99, "alone")], "doc_id long, text string")
    found = similar_groups(docs, 4, 85)
    for _ in range(50):
        if len(shuffles() - held) <= 2:
            break
        time.sleep(0.2)
    assert len(shuffles() - held) <= 2 and spark.conf.get(key) == before
    assert {r.component_id for r in found.collect()} == {0, 99}


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    draw = np.random.default_rng(5)
    for _ in range(300):
        n, m = draw.integers(1, 700, 2).tolist()
        both = int(draw.integers(0, min(n, m) + 1))
        values = draw.integers(0, 1 << 63, n + m - both).astype(np.uint64)
        one, other = values[:n], values[n - both:]
        made = sketches(np.concatenate([one, other]), np.array([0, n, n + m]))
        assert sketched_apart(*made) <= n + m - 2 * both
    far = sketches(draw.integers(0, 1 << 63, 800).astype(np.uint64), np.array([0, 400, 800]))
    assert sketched_apart(*far) > 800 * 15 // 185 and sketched_apart(far[0], far[0]) == 0


def test_sets_dealt_once_stay_where_they_are(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    rows = spark.range(300).select((F.col("id") % 100).alias("id"), F.array("id").alias("set"))
    dealt = cut_by(rows, "id")
    assert dealt.count() == 100 and spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    pairs = spark.range(50).select(F.col("id").alias("u"), (F.col("id") * 3).alias("v"))
    found = pairs.join(dealt.withColumnRenamed("id", "v").hint("merge"), "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 34 and plan.count("Exchange hashpartitioning") == 1
    among = spark.createDataFrame([(3,), (3,), (7,), (1000,)], "id long")
    assert sorted(r.id for r in cut_by(rows, "id", among).collect()) == [3, 7]


def near_misses(groups: int, copies: int) -> list[tuple]:
    """Groups of 40 words each, of which a copy has 5 from other groups: similar to the others of its group, mostly under 85 percent."""
    draw = random.Random(19)
    base = [[f"w{g}x{k}" for k in range(40)] for g in range(groups)]
    rows = []
    for g in range(groups):
        for _ in range(copies):
            words = draw.sample(base[g], 35) + [draw.choice(draw.choice(base)) for _ in range(5)]
            rows.append((len(rows), " ".join(words)))
    return rows


def test_near_misses_move_no_blocks_of_sets(spark, monkeypatch):
    """Sets that only chains of shared keys hold together aren't dealt to each other."""
    rows = near_misses(40, 6)

    def none_asked(percent):
        def links(block):
            raise ValueError("compared in blocks")

        return links

    monkeypatch.setattr(op13_jaccard, "_block_links", none_asked)
    monkeypatch.setattr(op13_jaccard, "BLOCK", 8)
    assert groups(spark, rows, 1, 85) == jaccard_of(rows, 1, 85)


def hidden_pairs(groups: int, decoys: int) -> list[tuple]:
    """Pairs of linked sets among sets that have a part of their keys each, so that some pairs are first in no bucket."""
    draw, rows = random.Random(21), []
    for g in range(groups):
        base = [f"w{g}x{k}" for k in range(40)]
        for other in [0, 3, *([9] * decoys)]:
            words = draw.sample(base, 40 - other) + [f"v{draw.randrange(10 ** 9)}" for _ in range(other)]
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("crowd", [1, 32])
def test_links_that_first_sets_hide(spark, monkeypatch, crowd):
    """By blocks and by pairs."""
    found, apart = [], op13_jaccard._apart

    def counted(*args):
        found.append(apart(*args).localCheckpoint())
        return found[-1]

    monkeypatch.setattr(op13_jaccard, "CROWD", crowd)
    monkeypatch.setattr(op13_jaccard, "_apart", counted)
    rows = hidden_pairs(12, 80)
    assert groups(spark, rows, 1, 85) == jaccard_of(rows, 1, 85)
    assert found[0].count() > 0


@pytest.mark.parametrize("percent", [60, 85])
def test_linked_sets_share_one_of_their_rarest(spark, percent):
    draw = random.Random(20)
    sets = []
    for _ in range(40):
        words = draw.sample(range(120), draw.choice([1, 3, 8, 20, 40]))
        for _ in range(4):
            sets.append(sorted({draw.randrange(120) if draw.random() < 0.1 else w for w in words}))
    held = spark.createDataFrame([(k, k % 50, len(s), h) for k, s in enumerate(sets) for h in s], "no long, part long, n long, h long")
    rare = defaultdict(set)
    for r in op13_jaccard._rarest(held, percent).collect():
        rare[r.no].add(r.h)
    assert sum(map(len, rare.values())) < sum(map(len, sets)) / 2
    linked = 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(set(sets[a]) & set(sets[b]))
        if a % 50 != b % 50 and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            linked += 1
            assert rare[a] & rare[b]
    assert linked > 20


def test_links_between_components_merge_them(spark):
    labels = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (9, 8)], "id long, label long")
    links = spark.createDataFrame([(3, 5), (5, 7), (2, 3), (7, 6)], "u long, v long")
    got = {r.id: r.label for r in op13_jaccard._merged(labels, links).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 8}
    assert op13_jaccard._merged(labels, links.where("u = 2")).count() == 4
