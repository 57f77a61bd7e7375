"""DuckDB SQL for the numbered queries that SQL can express."""

_ESCAPED = r"regexp_replace({}, '(<)(\\*(?:\|im_start\|>|\|im_end\|>|/?s>))|(\[)(\\*/?INST\])', '\1\3\\\2\4', 'g')"

SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d),
k AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS key FROM p),
r AS (SELECT doc_id, pos FROM k WHERE pos + 34 <= n QUALIFY count(*) OVER (PARTITION BY key) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM r),
kept AS (SELECT p.doc_id, count(*) FILTER (WHERE gone.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE gone.pos IS NULL) AS t
  FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS m FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
s AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), o AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT s.vec_id, coalesce(n_links, 0) AS n_links, component_id, s.vec_id = component_id AS kept FROM s LEFT JOIN o ON s.vec_id = o.a""",
    "op8_chat": f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op13_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
s AS (SELECT count(DISTINCT r) AS docs, count(*) AS total FROM t),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t GROUP BY r, term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
p AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) <= 10""",
    "op12_prefix_trie": r"""
WITH c AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
z AS (SELECT conv_id, turns, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, CAST(3988292384 AS BIGINT) * (xor(a, x) & 1))) AS crc FROM c),
h AS (SELECT conv_id, turns, (4294967295 - crc) % 4 AS h FROM z),
r AS (SELECT h.conv_id, list_concat(coalesce(l.turns, [])[1:h.h], h.turns[h.h + 1:]) AS t FROM h LEFT JOIN c AS l ON l.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(t) AS n, unnest(range(0, len(t) + 1)) AS depth, t FROM r),
q AS (SELECT conv_id, n, depth, t[1:depth] AS path FROM p),
v AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth) AS ends FROM q GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(v.path[depth].text, '[^\x20\x09-\x0D]+')) END AS own FROM v LEFT JOIN k ON v.path = k.path),
s AS (SELECT path[1:a] AS path, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT path, own, n_children, unnest(range(0, depth + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN s ON s.path = w.path LEFT JOIN v AS u ON w.depth > 0 AND u.path = w.path[1:w.depth - 1]""",
}
