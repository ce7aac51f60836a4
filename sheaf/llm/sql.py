"""The queries' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

#: A-Z lower-cased and nothing else.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     i AS (SELECT DISTINCT item_id, least(10, len(w)) AS z, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g
           FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
     s AS (SELECT DISTINCT z FROM i),
     g AS (SELECT doc_id, p, z, array_to_string(w[p:p + z - 1], ' ') AS g
           FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS p FROM d, s WHERE len(w) >= z)),
     h AS (SELECT DISTINCT g.doc_id, g.p, g.z, i.item_id FROM g JOIN i USING (g, z)),
     n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + z)) AS q FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
     r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
     c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM g SEMI JOIN r USING (h)),
     a AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
     k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM a ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {LOW} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3, "op5_substring_dedup": OP5, "op9_exact_dedup": OP9}
