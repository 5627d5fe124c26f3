"""URL filters: a trie over reversed host labels and path segments, longest match wins.

The rules are a parameter, not data: their number is checked against ``MOST_RULES`` before the trie is
broadcast. A rule ``host/path`` fits its host and all subdomains where the url's path starts with
the rule's path. More host labels win over fewer, then the longer path, then block over allow.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets
the default verdict. Hosts are compared as written (a port belongs to the host), A-Z lower-cased.
Repeated rows are judged each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import LOWER, UPPER

#: About 100 MB of trie; longer lists are better joined as a table.
MOST_RULES = 200_000
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def trie(rules: list[tuple[str, str]]) -> dict:
    """Nested dicts: host labels from the last one, then whole path segments; '' holds the path's root,
    and a node's None the (rest of a segment, rule, verdict) that end there, longest rest first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast")
    root: dict = {}
    for verdict, rule in sorted(rules, key=lambda x: x[0] != "block"):
        if verdict not in ("allow", "block"):
            raise ValueError(f"{verdict}: neither allow nor block")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *whole, rest = (slash + path).split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(None, [])
        if all(e[0] != rest for e in ends):
            ends.append((rest, rule, verdict))
            ends.sort(key=lambda e: -len(e[0]))
    return root


def longest(root: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    node, paths = root, []
    if host:
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                paths.append(node["/"])
    segments = path.split("/")
    for node in reversed(paths):
        best = None
        for i, segment in enumerate(segments):
            rest = None
            for end in node.get(None, ()):
                if "/".join(segments[i:]).startswith(end[0]):
                    best, rest = end, end
                    break
            node = node.get(segment) if i < len(segments) - 1 else None
            if node is None:
                break
        if best:
            return best[1], best[2]
    return None, None


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict."""
    shared = pages.sparkSession.sparkContext.broadcast(trie(rules))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        for batch in batches:
            found = [longest(root, h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] or default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["page_id", "host", "path", "rule", "verdict"])

    after = F.expr("substring(url, instr(url, '://') + 3)")
    rest = F.when(F.instr("url", "://") > 0, after).otherwise("")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    return parts.mapInArrow(verdicts, "page_id long, host string, path string, rule string, verdict string")
