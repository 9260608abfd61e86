"""DuckDB SQL for the queries that SQL can express on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


#: The smallest id that each node of links(a, b), both ways, reaches.
_REACH = """reach(node, id) AS (SELECT a, a FROM links UNION SELECT a, id FROM reach JOIN links ON links.b = reach.node),
least AS (SELECT node, min(id) AS id FROM reach GROUP BY node)"""

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS m, any_value(q.n) AS n, count(*) AS o FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o WHERE 100 * o >= 85 * (m + n - o)), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least.id, doc_id) AS component_id FROM s LEFT JOIN least ON least.node = s.doc_id"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p, v q WHERE p.vec_id <> q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9), {_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least.id, vec_id) AS component_id, coalesce(least.id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.node = vec_id"""


def _escaped(column: str) -> str:
    return rf"replace(replace({column}, '\', '\\'), '<|', '<\|')"


CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x) AS said, coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '') AS loss,
  sum(24 + length(replace({_escaped("r")}, chr(10), '<|nl|>')) + length({_escaped("x")})) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

DECONTAMINATION = rf"""WITH b AS (SELECT item_id, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT doc_id, item_id, i, dw.l FROM dw JOIN bw ON dw.l = bw.l AND dw.s = bw.s),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(q.n, 0) AS n_items, sha256(coalesce(q.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""
