"""SQL for DuckDB with the results of the queries whose operators it can express. All of it compares all pairs: it is for small tables."""

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _parts(rows: str) -> str:
    """CTE `parts (node, root)`: each node with the smallest one that it reaches over `links (x, y)`, both ways."""
    return f"""reach AS (SELECT id AS node, id AS root FROM ({rows}) UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node),
    parts AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""


OP1 = f"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
    sets AS (SELECT doc_id, unnest(list_distinct(CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END)) AS g FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    sized AS (SELECT * FROM sets JOIN sizes USING (doc_id)),
    links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    {_parts("SELECT doc_id AS id FROM documents")}
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, p.root AS component_id, p.root = d.doc_id AS kept
FROM documents d JOIN parts p ON p.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

OP4 = f"""WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    {_parts("SELECT vec_id AS id FROM embeddings")}
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, p.root AS component_id, p.root = e.vec_id AS kept
FROM embeddings e JOIN parts p ON p.node = e.vec_id"""

OP6 = f"""WITH words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents)),
    wins AS (SELECT * FROM (SELECT doc_id, pos, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) WHERE n = 13),
    firsts AS (SELECT g, min(doc_id) AS m FROM wins GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM wins JOIN firsts USING (g), range(13) r(k) WHERE m < doc_id),
    told AS (SELECT w.doc_id, w.pos, w.word, g.pos IS NOT NULL AS lost FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos),
    kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (lost) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT lost) AS t FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)"""
