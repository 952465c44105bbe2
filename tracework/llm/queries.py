"""The corpus queries that ``__spark_entry__`` registers, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, merkle, mixing, pii, prefixfree, quality, simhash, substrings, tokencount, urlrules, vectorcodes
from .common import table
from .digest_sql import codes_sql, manifest_sql

#: Rules of op5: action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
TOKENIZER = "word_bpe_49k.json"


def op1_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(table(spark, sf_dir, "conversations"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rules_frame(spark, RULES))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # the other queries work without it

    return tokencount.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixfree.dedup_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (op1_preference_chat, op2_embedding_dedup, op3_pii, op4_quality, op5_url_rules, op6_simhash, op7_decontaminate, op8_token_counts, op9_substring_dedup, op10_mixing, op11_suffix_dedup, op12_vector_codes, op13_merkle)}

_WORDS = r"coalesce(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), [])"

ORACLE_SQL = {
    "op1_preference_chat": r"""
WITH turns_in AS (
  SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t FROM conversations),
talks AS (
  SELECT conv_id, list(t ORDER BY turn, t.role, t.text) AS turns FROM turns_in WHERE conv_id IS NOT NULL GROUP BY conv_id),
pairs AS (
  SELECT row_number() OVER () AS id, * FROM (
    SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id,
           any_value(turns) FILTER (conv_id % 2 = 0) AS chosen, any_value(turns) FILTER (conv_id % 2 != 0) AS rejected
    FROM talks GROUP BY 1
    UNION ALL SELECT NULL, [t], NULL FROM turns_in WHERE conv_id IS NULL)),
shared AS (
  SELECT id, pair_id, chosen, rejected, coalesce(chosen, []) AS c, coalesce(rejected, []) AS r,
         len(list_filter(range(1, least(len(coalesce(chosen, [])), len(coalesce(rejected, []))) + 1), lambda i: chosen[1:i] = rejected[1:i])) AS n
  FROM pairs),
cut AS (SELECT *, c[1:n] AS p, c[n + 1:] AS cc, r[n + 1:] AS rr FROM shared),
turns AS (
  SELECT id, kind, i, u[i].role AS role, u[i].text AS text
  FROM (SELECT id, kind, u, unnest(range(1, len(u) + 1)) AS i
        FROM (SELECT id, 'p' AS kind, p AS u FROM cut UNION ALL SELECT id, 'c', cc FROM cut UNION ALL SELECT id, 'r', rr FROM cut))),
lines AS (
  SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM turns),
placed AS (
  SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12 + length(role) + 1 AS begins FROM lines),
texts AS (
  SELECT id, kind, string_agg(line, '' ORDER BY i) AS text,
         string_agg(CAST(CAST(begins AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begins + length(text) + 10 AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (role = 'assistant') AS mask
  FROM placed GROUP BY id, kind)
SELECT s.pair_id, s.chosen IS NOT NULL AND s.rejected IS NOT NULL AS paired, CAST(s.n AS BIGINT) AS n_prompt_turns,
       coalesce(p.text, '') AS prompt, coalesce(c.text, '') AS chosen_completion, coalesce(c.mask, '') AS chosen_mask,
       coalesce(r.text, '') AS rejected_completion, coalesce(r.mask, '') AS rejected_mask
FROM cut s LEFT JOIN texts p ON p.id = s.id AND p.kind = 'p'
LEFT JOIN texts c ON c.id = s.id AND c.kind = 'c' LEFT JOIN texts r ON r.id = s.id AND r.kind = 'r'
""",
    "op5_url_rules": r"""
WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
met AS (
  SELECT p.page_id, p.url, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN met m ON m.page_id = p.page_id AND m.url = p.url AND m.n = 1
""",
    "op9_substring_dedup": rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, s, hash(array_to_string(w[s:s + 19], ' ')) AS h, md5(array_to_string(w[s:s + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h, g ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM later) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(g), 0) AS r, w, g FROM docs d LEFT JOIN gone USING (doc_id)),
words AS (
  SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, w, unnest(range(1, n + 1)) AS i FROM kept WHERE n > 0) LEFT JOIN (SELECT doc_id, unnest(g) AS i, 1 AS x FROM gone) USING (doc_id, i)
  WHERE x IS NULL GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN words USING (doc_id)
""",
    "op10_mixing": rf"""
WITH RECURSIVE named AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-9223372036854775808') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS lot
  FROM documents),
sized AS (
  SELECT doc_id, source, size, CASE WHEN nth = 0 THEN lot ELSE CAST('0x' || substr(md5(CAST(lot AS VARCHAR) || ':' || CAST(nth AS VARCHAR)), 1, 15) AS BIGINT) END AS lot
  FROM (SELECT *, row_number() OVER (PARTITION BY source, lot) - 1 AS nth FROM named)),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weights AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sizes),
filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
  FROM weights WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest AS l, weights AS w FROM filling WHERE NOT cap * weights <= rest * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1),
goal AS (
  SELECT source, source_size,
         CASE WHEN cap * weights <= rest * weight THEN CAST(cap AS DOUBLE) ELSE CAST(l AS DOUBLE) * weight / w END AS target
  FROM filling LEFT JOIN level ON TRUE),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM goal),
swept AS (
  SELECT s.*, b.source_size, b.target, b.rounds, CAST(floor(b.target) AS BIGINT) - b.rounds * b.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.lot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
spare AS (SELECT source, any_value(budget) - coalesce(sum(size) FILTER (upto <= budget), 0) AS spare FROM swept GROUP BY source),
further AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.source, w.size ORDER BY w.lot) AS place
  FROM swept w JOIN spare p ON w.source IS NOT DISTINCT FROM p.source WHERE upto > budget AND size BETWEEN 1 AND spare),
classes AS (
  SELECT source, size, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS pos FROM further GROUP BY source, size),
filled AS (
  SELECT source, CAST(0 AS BIGINT) AS pos, CAST(spare AS BIGINT) AS rest, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS take FROM spare
  UNION ALL
  SELECT f.source, c.pos, f.rest - least(c.n, f.rest // c.size) * c.size, c.size, least(c.n, f.rest // c.size)
  FROM filled f JOIN classes c ON c.source IS NOT DISTINCT FROM f.source AND c.pos = f.pos + 1),
extra AS (
  SELECT w.doc_id, w.source, w.lot FROM further w JOIN filled f ON w.source IS NOT DISTINCT FROM f.source AND w.size = f.size WHERE place <= take),
taken AS (
  SELECT w.*, least(w.rounds + CASE WHEN upto <= budget OR e.lot IS NOT NULL THEN 1 ELSE 0 END, 3) AS copies
  FROM swept w LEFT JOIN extra e ON e.doc_id IS NOT DISTINCT FROM w.doc_id AND e.source IS NOT DISTINCT FROM w.source AND e.lot = w.lot)
SELECT doc_id, size, source_size, target, size * copies AS taken, CAST(copies AS BIGINT) AS copies
FROM taken
""",
    # hexadecimal digits are cut into pieces, as a place far within a long text is slow to reach
    "op11_suffix_dedup": """
WITH docs AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
pieces AS (SELECT doc_id, n, p, substr(h, 2 * p + 1, 2798) AS piece FROM (SELECT doc_id, h, n, unnest(range(0, n - 399, 1000)) AS p FROM docs WHERE n >= 400)),
windows AS MATERIALIZED (SELECT doc_id, p + j AS s, hash(substr(piece, 2 * j + 1, 800)) AS a FROM (SELECT doc_id, p, piece, unnest(range(0, least(1000, n - 399 - p))) AS j FROM pieces)),
again AS (SELECT a FROM windows GROUP BY a HAVING count(*) > 1),
hits AS (SELECT doc_id, s FROM windows JOIN again USING (a)),
runs AS (SELECT doc_id, s, sum(f) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 400 THEN 0 ELSE 1 END AS f FROM hits)),
spans AS (SELECT doc_id, r, min(s) AS b, max(s) + 400 AS e FROM runs GROUP BY doc_id, r),
edges AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept, max(e) AS last FROM edges JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
""",
    "op12_vector_codes": codes_sql(),
    "op13_merkle": manifest_sql(),
}
