"""The thin queries: each operator over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from signalframe.llm import chat, decontamination, exact_dedup, filter_audit, lattice_lm, line_dedup, merkle, packing, parity_join, quality, substring_dedup, token_counts, url_filter
from signalframe.llm.common import read, ship_package


#: The listed URLs of ``op3_url_filters``: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under the subword lattice model learned from the training split."""
    return lattice_lm.score_documents(read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of Jaccard 0.9 on word trigrams, by parity sketches."""
    return parity_join.similar_components(read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url, by a blocked Bloom filter and an exact hash join."""
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents by prefix dynamic programming."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document the benchmark's windows hit, by an FM-index for each shard."""
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens by linear grouping."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-word windows of earlier ones, by a de Bruijn graph."""
    return substring_dedup.report(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and selection of every document by ordinal cumulative-link regression."""
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates the template, rendered by growing prefixes and read back."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    return chat.digests(given.unionByName(tricky))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document by Grace hash deduplication."""
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in all 120 orders, for each source, by decision diagrams of failure masks."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that five documents or more hold, by keep bitmaps of range-partitioned hashes."""
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, a fifth of them tampered with, by bitmap ranks and slot arrays."""
    return merkle.report(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark, query is not op6_best_fit_packing)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_lattice_lm, op2_ngram_jaccard_join, op3_url_filters, op4_token_counts, op5_decontamination, op6_best_fit_packing, op7_substring_dedup, op8_quality_classifier, op9_chat_formatting, op10_exact_dedup, op11_filter_audit, op12_line_dedup, op13_merkle_manifest, pipeline]
    return {q.__name__: _shipped(q) for q in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": OP2_SQL,
        "op3_url_filters": OP3_SQL,
        "op5_decontamination": OP5_SQL,
        "op7_substring_dedup": OP7_SQL,
        "op9_chat_formatting": OP9_SQL,
        "op10_exact_dedup": OP10_SQL,
        "op11_filter_audit": OP11_SQL,
        "op12_line_dedup": OP12_SQL,
        "op13_merkle_manifest": op13_sql(),
    }


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP3_SQL = r"""
WITH r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), u AS (
  SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), f AS (
  SELECT s.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC) AS k
  FROM s JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM s LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (n)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + 12], ' '))) AS t FROM b WHERE len(w) > 0
), x AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))
), h AS (
  SELECT DISTINCT r, i, x.n, item_id FROM x JOIN p ON x.n = p.n AND x.t = p.t
), c AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, r, i, md5(array_to_string(w[i : i + 49], ' ')) AS t FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), g AS (
  SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY t) AS first FROM x) WHERE first < doc_id
), c AS (
  SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(range(i, i + 50)) AS k FROM g) GROUP BY r
), k AS (
  SELECT r, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS body FROM (
    SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
  ) a ANTI JOIN (SELECT r, unnest(gone) AS i FROM c) b USING (r, i) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT conv_id, turn, role, text, length(text) + length(regexp_replace(text, '[^\\\[\]<]', '', 'g')) AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       (3 + sum(escaped + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 WHEN 'system' THEN 17 END))::BIGINT AS formatted_chars,
       false AS history_rewritten
FROM t GROUP BY conv_id
"""

OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
         regexp_matches(t, '[#$%&*|]'), d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS bad, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN g USING (doc_id)
), c AS (
  SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS v FROM o, (SELECT unnest(range(1, 6)) AS step)
), x AS (
  SELECT c.*, filter_order, coalesce((SELECT min(step) FROM s WHERE s.filter_order = o.filter_order AND bad[v]), 6) AS first FROM c, o
), r AS (
  SELECT part, filter_order, step, v, coalesce(sum(n) FILTER (first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (bad[v] AND first < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (bad[v] AND len(list_filter(bad, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (first = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (first = step), 0)::BIGINT AS toxic_lost
  FROM x JOIN s USING (filter_order) GROUP BY part, filter_order, step, v
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, v))::BIGINT AS shapley FROM r
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS w FROM documents
), l AS (
  SELECT doc_id, r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, r, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS i FROM d)
), k AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT r, i, line, coalesce(doc_id <> keeper, false) AS gone FROM l LEFT JOIN k USING (k)
), s AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS body FROM j GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(body, '')) AS kept_sha256 FROM d JOIN s USING (r)
"""


def op13_sql(levels: int = 5, upper: int = 3) -> str:
    """The manifest of sources of at most 16 ** ``levels`` documents, at most 16 ** ``upper`` of them; a level is a pair of tables."""

    def tree(name: str, high: int) -> list[str]:
        out = []
        for k in range(high):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT s, i // 16 AS i, list(h ORDER BY i) AS slots, any_value(n) AS n FROM {name}{k} GROUP BY s, i // 16)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT s, i, CASE WHEN n = 1 THEN slots[1] ELSE sha256(array_to_string(slots, '')) END AS h, CASE WHEN n = 1 THEN 1 ELSE (n + 15) // 16 END AS n FROM {name}r{k})")
        return out

    def climb(name: str, high: int, begin: str, s: str, i: str) -> list[str]:
        out, last = [], begin
        for k in range(high):
            at = f"(a.{i} // {16**k}) % 16 + 1"
            swapped = f"list_transform(slots, lambda d, k: CASE WHEN k = {at} THEN node ELSE d END)"
            others = f"list_filter(slots, lambda d, k: k <> {at})"
            out.append(f"{name}p{k} AS (SELECT a.* EXCLUDE (node, proof), CASE WHEN r.n = 1 THEN node ELSE sha256(array_to_string({swapped}, '')) END AS node, CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string({others}, '') END AS proof FROM {last} a JOIN {name}r{k} r ON r.s = {s} AND r.i = a.{i} // {16 ** (k + 1)})")
            last = f"{name}p{k}"
        return out

    def leaf(text: str) -> str:
        parts = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(strlen(({p})::VARCHAR) || ':' || ({p})::VARCHAR, '-')" for p in parts) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # no crc32 in DuckDB: bit by bit over the decimal digits
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
    parts = [
        f"l AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, {leaf('text')} AS leaf, xor({crc}, 4294967295) % 5 = 0 AS hit, {leaf(lowered)} AS forged FROM documents)",
        "a0 AS (SELECT s, i, leaf AS h, n FROM l)",
        *tree("a", levels),
        f"b0 AS (SELECT 0 AS s, s AS i, h, count(*) OVER () AS n FROM a{levels})",
        *tree("b", upper),
        "start AS (SELECT doc_id, s, i, leaf, CASE WHEN hit THEN forged ELSE leaf END AS node, '' AS proof FROM l)",
        *climb("a", levels, "start", "a.s", "i"),
        *climb("b", upper, f"ap{levels - 1}", "0", "s"),
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u.h AS verified FROM bp{upper - 1} p JOIN a{levels} t ON t.s = p.s CROSS JOIN b{upper} u"
