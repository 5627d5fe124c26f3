"""Documents that test every operator's edges, and brute-force versions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm fire. "
CLASHES = ("row", "body", "hash", "id", "label", "lang_pred", "score", "found", "u", "v", "key", "size", "kept", "text_sha256", "n", "stamp", "copies", "deal", "bin")

EDGES = [
    (1, PROSE * 3, "en", "a", 1), (2, PROSE * 3, "en", "a", 1), (3, PROSE * 3 + "  \n", None, "b", None),
    (4, None, "en", None, None), (5, "", "de", "b", 0), (6, " \t\n", None, "c", 3), (7, "7 8 9 ...", "fr", None, 9),
    (8, "Ä ö", "de", "é", 3), (9, "word", "en", "a", 4), (None, "no id here at all, none", "en", "a", 1),
    (10, "x" * 200_000, "en", "a", 200_000), (11, "lang " * 30_000, "en", "b", 1), (12, PROSE * 3, "en", "a", 1),
    (12, PROSE * 3, "en", "a", 1), (13, "a😀b ñandú\x00 end", "es", "b", 1),
]


def edge_docs(spark: SparkSession, rows: list = EDGES) -> DataFrame:
    """With further columns that have the names of the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def no_docs(spark: SparkSession) -> DataFrame:
    return edge_docs(spark).where("false")


def squeezed(text: str | None) -> bytes:
    return (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")


def word_set(text: str | None, width: int) -> set:
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def near_components(rows: list[tuple], width: int) -> dict:
    """doc_id -> (set size, smallest id reachable), from all pairs."""
    sets = {r[0]: word_set(r[1], width) for r in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def without_repeats(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, bytes, removed, spans, sha256 of what stays) of each row."""
    bodies = [(r[1] or "").encode() for r in rows]
    seen: dict[bytes, int] = {}
    for b in bodies:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for r, b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
