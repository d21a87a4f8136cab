"""DuckDB SQL of the operators whose results SQL can express, over whole tables."""

from __future__ import annotations

import re

#: CRC-32 of the decimal text {t}: each character, then eight shifts of one bit.
CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({t}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
       "lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END))")


def manifest_sql() -> str:
    """Hash trees as lists of nodes a level; V(x) stands for a field as text with its length."""
    crc = CRC.format(t="CAST(doc_id AS VARCHAR)")
    sql = f"""WITH RECURSIVE rows AS (
  SELECT doc_id, lang, source, n_chars, text, CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(concat(V(doc_id), V(source), V(lang), V(n_chars), V(text))) AS leaf,
    sha256(concat(V(doc_id), V(source), V(lang), V(changed), V(text))) AS changed_leaf FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM ranked GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(concat(nodes[i + 1], nodes[i + 2]))) FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(concat(nodes[i + 1], nodes[i + 2]))) FROM tops WHERE len(nodes) > 1),
steps AS (
  SELECT lang, 0 AS tree, level, nodes, len(nodes) AS n FROM trees WHERE len(nodes) > 1
  UNION ALL SELECT lang, 1, level, nodes, len(nodes) FROM subroots, tops WHERE len(nodes) > 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tree, level) AS step FROM steps),
climb AS (
  SELECT doc_id, r.lang, leaf, changed_leaf AS node, '' AS proof, 1 AS step, r.place, s.place AS top_place FROM ranked r JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, c.lang, leaf,
    CASE WHEN p % 2 = 1 THEN sha256(concat(nodes[p], node)) ELSE sha256(concat(node, nodes[p + 2])) END,
    concat(proof, CASE WHEN p % 2 = 1 THEN nodes[p] ELSE nodes[p + 2] END), c.step + 1, place, top_place
  FROM (SELECT c.*, s.nodes, (CASE WHEN s.tree = 0 THEN c.place ELSE c.top_place END) >> s.level AS p FROM climb c JOIN numbered s ON c.lang IS NOT DISTINCT FROM s.lang AND c.step = s.step) c),
done AS (SELECT * FROM climb QUALIFY step = max(step) OVER (PARTITION BY lang))
SELECT doc_id, leaf, subroot, t.nodes[1] AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.nodes[1] AS verified
FROM done d JOIN subroots s ON d.lang IS NOT DISTINCT FROM s.lang, tops t WHERE len(t.nodes) = 1"""
    return re.sub(r"V\((\w+)\)", r"CASE WHEN \1 IS NULL THEN '-' ELSE concat(strlen(CAST(\1 AS VARCHAR)), ':', \1) END", sql)


def codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Integer k-means with its rounds written out; distances are exact in doubles as long as they are below 2^53."""
    out = [f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)),
books0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut QUALIFY e < {entries})"""]
    for k in range(rounds + 1):
        out.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * {entries} + e) AS found
  FROM cut JOIN books{k} USING (p) GROUP BY vec_id, p)""")
        if k < rounds:
            out.append(f"""means{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, found % {entries} AS e, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{k}) GROUP BY ALL)
  GROUP BY p, e),
books{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM books{k} b LEFT JOIN means{k} m USING (p, e))""")
    out.append(f"""told AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(found % {entries} AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(found // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM books{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM told JOIN kept USING (vec_id), digest""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]
