"""SQL that builds up from the operators' parameters."""

from __future__ import annotations

from collections.abc import Sequence

from civicspark.llm.secrets import Rule


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS t FROM documents),
items AS (SELECT row_number() OVER () AS no, item_id, {_TERMS} AS t FROM benchmark),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(t) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (SELECT no, item_id, term, count(*) AS times FROM (SELECT no, item_id, unnest(t) AS term FROM items) GROUP BY ALL),
weight AS (SELECT no, item_id, term, times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM wanted JOIN df USING (term), total),
scored AS (SELECT no, item_id, doc_id, row_id,
                  CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM weight JOIN tf USING (term) JOIN docs USING (row_id), total GROUP BY no, item_id, doc_id, row_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


#: A conversation's turns are known by the MD5 of their role and text; a node's path is their list.
TRIE = """
WITH turns AS (SELECT conv_id, list(md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))
                                    ORDER BY turn NULLS FIRST) AS t,
                      list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS size
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT conv_id, t, size, CAST(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                lambda c: CAST(ascii(c) AS BIGINT))),
                lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
                lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS BIGINT) AS crc FROM turns),
heads AS (SELECT conv_id, t, size, CAST(xor(crc, 4294967295::BIGINT) % 6 AS BIGINT) AS h FROM bits),
convs AS (SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t,
                 list_concat(coalesce(b.size[1:c.h], []), c.size[c.h + 1:]) AS size
          FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (SELECT conv_id, d, t[1:d] AS path, CASE WHEN d > 0 THEN size[d] ELSE 0 END AS size, d = len(t) AS ends
             FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM convs)),
nodes AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM prefixes GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
ancestors AS (SELECT path[1:k] AS path, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_nodes)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM ancestors GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""


def secret_spans(base: Sequence[Rule], more: Sequence[Rule]) -> str:
    """Spans by splitting each text at the matches of each rule and adding up the lengths."""

    def found(i: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
SELECT row_id, {i} AS ord, '{rule.name}' AS kind, {rule.least} AS least,
       unnest(list_zip(regexp_split_to_array(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}', 0))],
                       regexp_extract_all(t, '{pattern}', 0), regexp_extract_all(t, '{pattern}', {rule.group}),
                       range(len(regexp_extract_all(t, '{pattern}', 0))))) AS m
FROM docs WHERE regexp_matches(t, '{pattern}')"""

    counts = ",\n       ".join(f"count(*) FILTER (kind = '{r.name}') AS n_{r.name}" for r in base)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(found(i, r) for i, r in enumerate([*base, *more]))}),
placed AS (
  SELECT *, sum(length(m[1]) + length(m[2])) OVER (PARTITION BY row_id, ord ORDER BY m[4]) AS stop FROM matches),
spans AS (
  SELECT row_id, ord, kind, stop - length(m[2]) AS start, concat(kind, ':', stop - length(m[2]), ':', stop) AS span
  FROM placed WHERE length(m[3]) >= least)
SELECT doc_id, {counts},
       sha256(coalesce(string_agg(span, ',' ORDER BY start, ord) FILTER (ord < {len(base)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, ord), '') AS spans, sha256(any_value(t)) AS blob
FROM docs LEFT JOIN spans USING (row_id) GROUP BY row_id, doc_id"""
