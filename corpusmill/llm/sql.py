"""DuckDB statements for the operators whose whole result SQL can express; doc_id is taken as a key."""

from __future__ import annotations

SUBSTRING = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, w, count(*) OVER f AS n, sha256(string_agg(w, ' ') OVER f) AS h FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT h, min(doc_id) AS d FROM win WHERE n = 50 GROUP BY h),
bad AS (SELECT win.doc_id, i, w, CASE WHEN n = 50 AND d < win.doc_id THEN 1 ELSE 0 END AS b FROM win LEFT JOIN firsts USING (h)),
marked AS (SELECT doc_id, i, w, max(b) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS dead FROM bad),
kept AS (SELECT doc_id, count(*) AS n_words, sum(dead)::BIGINT AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (dead = 0) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""WITH bi AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
tests AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: array_to_string(ws[k:k + 9], ' '))) AS h, least(len(ws), 10) AS l FROM bi WHERE len(ws) > 0),
lens AS (SELECT DISTINCT l FROM tests),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
frames AS (SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM words),
hits AS (SELECT DISTINCT doc_id, i, t.l, item_id FROM (SELECT doc_id, i, l, array_to_string(ten[1:l], ' ') AS h FROM frames, lens WHERE len(ten) >= l) f JOIN tests t ON t.h = f.h AND t.l = f.l),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
g AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p"""


def clusters(rounds: int = 5, centroids: int = 40) -> str:
    """Lloyd rounds spelt out; every sum stays exact in doubles and longs at the sizes the statement is run on."""
    far = "list_dot_product(f, f) - 2 * list_dot_product(f, g) + list_dot_product(g, g)"
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS f FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, g) - 1 AS cluster, g FROM (SELECT sha256('2:' || vec_id) AS h, f AS g FROM kept WHERE vec_id IS NOT NULL ORDER BY h, g LIMIT {centroids}))",
    ]
    near = "(SELECT vec_id, f, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT k.r, vec_id, f, cluster, {far} AS d FROM (SELECT *, row_number() OVER () AS r FROM kept) k, c{k}) GROUP BY r, vec_id, f)"
    for k in range(rounds):
        parts += [
            f"a{k} AS {near.format(far=far, k=k)}",
            f"m{k} AS (SELECT cluster, list(x ORDER BY i) AS g FROM (SELECT cluster, i, floor(sum(f[i]) / count(*)) AS x FROM a{k}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster)",
            f"c{k + 1} AS (SELECT c.cluster, coalesce(m.g, c.g) AS g FROM c{k} c LEFT JOIN m{k} m USING (cluster))",
        ]
    parts.append(f"last AS {near.format(far=far, k=rounds)}")
    digest = "sha256(array_to_string(list_transform(g, lambda x: x::BIGINT), ','))"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, l.cluster::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY l.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, {digest} AS centroid_sha256
FROM last l JOIN c{rounds} USING (cluster)"""


#: Every pair measured; the graph search finds these rows where its lists are complete, as they are on tables of one block.
NEIGHBOURS = """WITH kept AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM pairs WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20"""
