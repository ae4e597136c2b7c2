"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from . import decontaminate, ranked_search

SUBSTRING_DEDUP = r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start FROM docs WHERE len(w) >= 20),
windows AS (SELECT p.doc_id, p.start, array_to_string(d.w[p.start:p.start + 19], ' ') AS s FROM places p JOIN docs d USING (doc_id)),
later AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

# equal sets meet as one class, so copies make no pairs; links of classes are closed by recursion
JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM docs WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles GROUP BY doc_id),
classes AS (SELECT h, min(doc_id) AS c, any_value(n) AS n FROM sets GROUP BY h),
own AS (SELECT c, n, s FROM shingles JOIN classes ON doc_id = c),
links AS (
  SELECT a.c AS u, b.c AS v FROM own a JOIN own b ON a.s = b.s AND a.c < b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(c, root) AS (SELECT c, c FROM classes UNION SELECT e.v, r.root FROM reach r JOIN edges e ON e.u = r.c WHERE r.root < e.v),
roots AS (SELECT c, min(root) AS root FROM reach GROUP BY c)
SELECT doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id)::BIGINT AS component_id
FROM docs LEFT JOIN sets s USING (doc_id) LEFT JOIN classes USING (h) LEFT JOIN roots USING (c)
"""

ORACLES = {"op1_substring_dedup": SUBSTRING_DEDUP, "op8_jaccard_join": JACCARD_JOIN, "op9_decontamination": decontaminate.ORACLE, "op12_ranked_search": ranked_search.ORACLE}
