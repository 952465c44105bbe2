"""SQL of the manifest and of the vector codes, whose levels and rounds are written out one by one."""

from __future__ import annotations


def _field(c: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str, heights: int) -> str:
    """Levels 0 to ``heights`` over (g, i, n, h): each node with what stands beside it in its run; a lone node stays as it is."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(heights):
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}s{k} AS (SELECT g, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"
        )
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 8)")
    return ",\n".join(out)


def _climb(name: str, start: str, tree: str, heights: int, group: str, place: str) -> str:
    """From ``start`` (with ``proof`` and ``fold``) up the levels of ``tree``."""
    out = [f"{name}0 AS ({start})"]
    for k in range(heights):
        out.append(
            f"{name}{k + 1} AS (SELECT c.* REPLACE (CASE WHEN s.n = 1 THEN proof ELSE proof || s.l || s.r END AS proof, CASE WHEN s.n = 1 THEN fold ELSE sha256(s.l || fold || s.r) END AS fold) "
            f"FROM {name}{k} c JOIN {tree}s{k} s ON s.g = c.{group} AND s.i = c.{place} // {8**k})"
        )
    return ",\n".join(out)


def manifest_sql(heights: int = 7, group_heights: int = 3) -> str:
    """For groups of up to 8**heights rows and up to 8**group_heights groups; ids are distinct."""
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH docs AS (
  SELECT doc_id, coalesce('g' || lang, '') AS g, {_leaf("text")} AS leaf, {_leaf("t2")} AS leaf2
  FROM (SELECT *, CASE WHEN {crc} % 3 = 0 THEN {low} ELSE text END AS t2 FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM docs),
{_tree("t", "SELECT g, i, n, leaf AS h FROM leaves", heights)},
subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t{heights}),
{_tree("u", "SELECT 'all' AS g, i, n, h FROM subroots", group_heights)},
{_climb("c", "SELECT g, i, doc_id, leaf, '' AS proof, leaf2 AS fold FROM leaves", "t", heights, "g", "i")},
{_climb("d", f"SELECT c.doc_id, c.leaf, s.h AS subroot, 'all' AS g, s.i AS i, c.proof, c.fold FROM c{heights} c JOIN subroots s ON s.g = c.g", "u", group_heights, "g", "i")}
SELECT d.doc_id, d.leaf, d.subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = r.h AS verified
FROM d{group_heights} d CROSS JOIN u{group_heights} r
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds over a table of components; ids are distinct and vectors equally long."""
    out = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pieces AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM pieces QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries})",
    ]
    apart = "CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for n in range(rounds + 1):
        out.append(
            f"near{n} AS MATERIALIZED (SELECT vec_id, label, p, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT a.vec_id, a.label, a.p, a.x, b.e, {apart} AS d FROM pieces a JOIN book{n} b ON a.p = b.p) GROUP BY vec_id, label, p)"
        )
        if n < rounds:
            out.append(f"sum{n} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS c FROM near{n}, range(1, len(x) + 1) t(i) GROUP BY p, e, i)")
            out.append(f"mean{n} AS (SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM sum{n} GROUP BY p, e)")
            out.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m ON m.p = b.p AND m.e = b.e)")
    out.append(f"told AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id, label)")
    out.append(f"book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})")
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM told, book\n"
