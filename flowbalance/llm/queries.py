"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import run as pipeline
from flowbalance.llm.common import table
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
from flowbalance.llm.op11_merkle import manifest
from flowbalance.llm.op12_repair import damaged, repair
from flowbalance.llm.op13_jaccard import similar_groups


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = identify(docs.select("doc_id", "text"), *learn(docs.where(~held_out)))
    return found.select("row.doc_id", "lang_pred", "score").withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=[3, 1, 2], share=(3, 2), most=2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs.where(~held_out), labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(table(spark, sf_dir, "documents"), key="surrogates")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered, F.replace("text", F.lit("\n"), F.lit("")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    return repair(damaged(table(spark, sf_dir, "conversations"), F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_nearest": op1_nearest,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_near_dedup": op4_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality": op7_quality,
    "op8_private": op8_private,
    "op9_pack_sequences": op9_pack_sequences,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_jaccard_join": op13_jaccard_join,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII characters, byte by byte and bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS BIGINT))"
    bits = f"lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN {_POLYNOMIAL} ELSE 0 END)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), {bits})), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _climbed(name: str, start: str, tree: str) -> str:
    """Levels of trees: ``name`` has (tree, level, i, h, n); ``start`` selects the leaves."""
    return f"""{name} AS ({start} UNION ALL
        SELECT {tree}, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {tree}, level, i // 3, n)"""


def _folded(name: str, source: str, nodes: str, tree: str) -> str:
    """Nodes ``x`` of ``source(k, tree, i, x, proof)`` led up through the levels of ``nodes``."""
    sibling = f"FROM {nodes} s WHERE s.{tree} IS NOT DISTINCT FROM f.{tree} AND s.level = f.level AND s.i // 3 = f.i // 3 AND s.i"
    left, right = (f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) {sibling} {side} f.i), '')" for side in "<>")
    return f"""{name} AS (SELECT k, {tree}, 0 AS level, i, x, proof FROM {source} UNION ALL
        SELECT k, {tree}, level + 1, i // 3, sha256(l || x || r), proof || l || r FROM (SELECT f.*, {left} AS l, {right} AS r FROM {name} f
            WHERE (SELECT max(n) FROM {nodes} s WHERE s.{tree} IS NOT DISTINCT FROM f.{tree} AND s.level = f.level) > 1))"""


_SHIFT = "CASE st WHEN '' THEN initial IN ('s', 'u') WHEN 's' THEN initial = 'u' WHEN 'u' THEN initial = 'a' ELSE initial = 'u' END"
_NEXT = "CASE st WHEN 'u' THEN 'a' ELSE 'u' END"
_NAME = "CASE st WHEN 'u' THEN 'assistant' ELSE 'user' END"

ORACLES: dict[str, str] = {
    "op1_nearest": """
        WITH vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        good AS (SELECT DISTINCT vec_id, v FROM vectors WHERE vec_id IS NOT NULL AND v IS NOT NULL
            AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
            FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
            (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20""",
    "op3_url_filter": f"""
        WITH cut AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op10_exact_dedup": r"""
        WITH norm AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
        grouped AS (SELECT doc_id, sha256(body) AS text_sha256, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE leaves AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, source, {_leaf("text")} AS h,
            CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS altered FROM documents),
        placed AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
            WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, h)),
        {_climbed("low", "SELECT source, 0 AS level, i, h, n FROM placed", "source")},
        subroots AS MATERIALIZED (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM low WHERE n = 1),
        {_climbed("high", "SELECT 0 AS one, 0 AS level, j AS i, subroot AS h, m AS n FROM subroots", "one")},
        tops AS (SELECT h AS root FROM high WHERE n = 1),
        first AS (SELECT k, source, i, coalesce(altered, h) AS x, '' AS proof FROM placed),
        {_folded("up", "first", "low", "source")},
        inner_roots AS (SELECT u.k, 0 AS one, s.j AS i, u.x, u.proof FROM up u JOIN subroots s ON s.source IS NOT DISTINCT FROM u.source
            WHERE u.level = (SELECT max(l.level) FROM low l WHERE l.source IS NOT DISTINCT FROM u.source)),
        {_folded("above", "inner_roots", "high", "one")}
        SELECT p.doc_id, p.h AS leaf, s.subroot, root, sha256(a.proof) AS proof_sha256, a.x AS folded_root, a.x = root AS verified
        FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN above a ON a.k = p.k AND a.level = (SELECT max(level) FROM high) CROSS JOIN tops""",
    "op12_conversation_repair": f"""
        WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
        dealt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM kinds WHERE kind <> 0),
        rows_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
            regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM dealt),
        judged AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM rows_),
        facts AS (SELECT conv_id, max(i) AS n, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
            count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM judged GROUP BY conv_id),
        put(st, after, more, audit, made) AS (VALUES ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
            ('', 'u', 2, 'I', chr(10) || 'user:'), ('s', 'u', 2, 'I', chr(10) || 'user:'), ('a', 'u', 2, 'I', chr(10) || 'user:'), ('u', 'a', 2, 'I', chr(10) || 'assistant:'),
            ('', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        best AS (SELECT f.conv_id, 0 AS i, p.after AS st, {{'cost': p.more, 'audit': p.audit, 'made': p.made}} AS b FROM facts f JOIN put p ON p.st = '' UNION ALL
            SELECT conv_id, i, after, min({{'cost': cost + more, 'audit': a || audit, 'made': m || made}}) FROM (
                SELECT x.conv_id, x.i, p.after, x.e.c AS cost, x.e.a AS a, x.e.m AS m, p.more, p.audit, p.made FROM (
                    SELECT r.conv_id, CAST(r.i AS INTEGER) AS i, unnest(list_filter([
                        {{'st': st, 'c': b.cost + 3, 'a': b.audit || 'D', 'm': b.made, 'ok': true}},
                        {{'st': initial, 'c': b.cost + CASE WHEN fault = 3 THEN 1 ELSE 0 END, 'a': b.audit || 'K', 'm': b.made || chr(10) || role || ':' || text, 'ok': fault IN (0, 3) AND {_SHIFT}}},
                        {{'st': {_NEXT}, 'c': b.cost + 2 + CASE WHEN fault = 3 THEN 1 ELSE 0 END, 'a': b.audit || 'R', 'm': b.made || chr(10) || {_NAME} || ':' || text, 'ok': fault IN (0, 3)}}],
                        lambda o: o.ok)) AS e
                    FROM best JOIN judged r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i + 1) x JOIN put p ON p.st = x.e.st)
            GROUP BY conv_id, i, after),
        done AS (SELECT best.conv_id, min(b) AS b FROM best JOIN facts f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = f.n WHERE st IN ('', 'a') GROUP BY best.conv_id)
        SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
            coalesce(f.illegal, 0) AS illegal, CAST(coalesce(d.b.cost, 0) AS BIGINT) AS cost, coalesce(d.b.audit, '') AS audit, sha256(coalesce(substr(d.b.made, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_jaccard_join": rf"""
        WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM split),
        flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, w.v FROM reach r JOIN ways w ON w.u = r.other)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)""",
}
