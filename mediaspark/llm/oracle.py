"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RULES = [("com", "/en/"), ("example.com", "/en/7"), ("net", "/de/"), ("example.net", "/de/8"), ("org", "/es/")]
_FITS = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for (h, p), v in zip(_RULES, ("block", "allow", "block", "block", "block"), strict=True))

URL_FILTERS = f"""WITH u AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages), r AS ({_FITS}),
    m AS (SELECT u.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY u.page_id),
    o AS (SELECT u.page_id, CASE WHEN host || path LIKE '%spam-farm.%' THEN '*spam-farm.*' WHEN host || path LIKE '%-pills.%' THEN '*-pills.*' WHEN host || path LIKE '%casino-%' THEN '*casino-*' END AS own FROM u)
    SELECT u.page_id, u.host, u.path, m.rule, CASE WHEN m.rule IS NOT NULL THEN m.v WHEN o.own IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, o.own AS method_rule FROM u JOIN o ON u.page_id = o.page_id LEFT JOIN m ON u.page_id = m.page_id"""

_COMPONENTS = "reach(node, root) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.node = e.a)"

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE [w[i:i + 4] for i in range(1, len(w) - 3)] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c)), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
    SELECT node AS doc_id, min(root) AS class_id, node = min(root) AS kept FROM reach GROUP BY node"""

EGO_JOIN = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}, c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
    SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.node = c.component_id AS kept FROM c LEFT JOIN n ON c.node = n.a"""

DECONTAMINATION = f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w] ELSE [w[k:k + 12] for k in range(1, len(w) - 11)] END) AS s FROM i), sizes AS (SELECT DISTINCT len(s) AS n FROM win),
    dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM d, sizes WHERE len(w) >= n), hit AS (SELECT dw.doc_id, dw.pos, dw.n, win.item_id FROM dw JOIN win ON dw.w[dw.pos:dw.pos + dw.n - 1] = win.s),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) x GROUP BY doc_id), it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) x GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""

ORACLE = {"op1_url_filters": URL_FILTERS, "op3_minhash_near_dedup": NEAR_DEDUP, "op5_ego_join": EGO_JOIN, "op8_benchmark_decontamination": DECONTAMINATION}
