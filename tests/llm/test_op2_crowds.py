"""op2 on anchors with many contexts: few rows a context, and shards that sort only what may repeat."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from flowbalance.llm import op2_suffix
from tests.llm.helpers import without_repeats


def letters(draw: random.Random, n: int) -> str:
    return "".join(draw.choices("abcdefghij klmnop", k=n))


def test_near_copies_make_few_rows_a_context(spark, monkeypatch):
    draw = random.Random(11)
    base, boiler = letters(draw, 1500), letters(draw, 399)
    rows = []
    for k in range(40):  # copies with one byte changed
        at = draw.randrange(1500)
        rows.append((k, base[:at] + "#" + base[at + 1:]))
    for k in range(40, 60):  # a byte short of a repeat
        rows.append((k, letters(draw, 300) + chr(0x100 + k) + boiler + chr(0x200 + k) + letters(draw, 300)))
    rows += [(60, rows[40][1]), (61, rows[3][1]), (62, None)]
    counts: dict = {}

    def counted(df, real=op2_suffix.cut):
        out = real(df)
        counts[len(counts)] = out.columns, out.count()
        return out

    monkeypatch.setattr(op2_suffix, "cut", counted)
    got = op2_suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowd=4).collect()
    assert sorted(map(tuple, got)) == sorted(without_repeats(rows, 400))
    contexts = max(n for columns, n in counts.values() if "lo" in columns and "times" in columns)
    assert max(n for _, n in counts.values()) <= 24 * contexts  # a window each would be up to 337


def contexts_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    runs = op2_suffix.window_runs(data, offsets, length, gram)
    cut_out = [data[a:a + n - 1 + length].tobytes() for a, n in zip(runs["lo"], runs["n"], strict=True)]
    # contexts of a shard are different
    first = np.sort(np.unique(np.stack((runs["anchor"], runs["context"])), axis=1, return_index=True)[1])
    kept = [cut_out[k] for k in first]
    return np.frombuffer(b"".join(kept), np.uint8), np.cumsum([0, *map(len, kept)]), runs["off"][first], runs["anchor"][first].view(np.int64), kept


def test_what_is_left_out_never_repeats():
    draw, length = np.random.default_rng(12), 24
    for case in range(60):
        base = draw.integers(97, 99 + case % 4, 150).astype(np.uint8)
        texts = []
        for _ in range(12):
            text = base[draw.integers(0, 60):draw.integers(90, 150)].copy()
            text[draw.integers(0, len(text), 2)] = 35
            texts.append(text.tobytes())
        data, offsets, off, anchor, kept = contexts_of(texts, length, 6)
        for width in (1, 3, 8, 19):
            first, end = op2_suffix.may_repeat(data, offsets, off, anchor, length, width)
            seen: dict = {}
            for k, text in enumerate(kept):
                for i in range(len(text) - length + 1):
                    seen.setdefault((anchor[k], text[i:i + length]), []).append((k, i))
            repeats = [place for at in seen.values() if len(at) > 1 for place in at]
            assert all(first[k] <= i < end[k] for k, i in repeats)
            if width == 1:
                assert {(k, edge) for k in np.flatnonzero(end) for edge in (first[k], end[k] - 1)} <= set(repeats)


def test_shards_sort_only_what_may_repeat(monkeypatch):
    """Contexts with one anchor and nothing else in common are not sorted."""
    draw = random.Random(13)
    anchor, length = letters(draw, 64), 400
    texts = [(letters(draw, 300) + anchor + letters(draw, 300)).encode() for _ in range(50)]
    texts.append(texts[0][:600] + b"#" * 64)
    sorted_bytes = []

    def watched(t, n, real=op2_suffix.repeated):
        sorted_bytes.append(len(t))
        return real(t, n)

    monkeypatch.setattr(op2_suffix, "repeated", watched)
    n = len(texts)
    shard = pa.table({"level": pa.array([0] * n, pa.int32()), "anchor": pa.array([7] * n), "context": pa.array(range(n)), "off": pa.array([300] * n, pa.int32()), "bytes": pa.array(texts, pa.binary())})
    got = op2_suffix._sorted_shard(length, 43)(shard).to_pylist()
    assert [(r["context"], [(r["first"] + s["a"], r["first"] + s["b"]) for s in r["spans"]]) for r in got] == [(0, [(0, 200)]), (50, [(0, 200)])]
    assert sum(sorted_bytes) <= 2 * 700 + 1
