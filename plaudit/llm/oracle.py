"""SQL for the queries that SQL can express."""

# Words, distinct 3-word shingles, an inverted index for the intersections, a recursive closure.
NGRAM_JACCARD = r"""
WITH RECURSIVE
lowered AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s
  FROM lowered),
ids AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM ids a JOIN ids b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common c JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(a, b) AS (
  SELECT x, y FROM both_ways
  UNION
  SELECT r.a, l.y FROM reached r JOIN both_ways l ON l.x = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
  least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reached r ON r.a = s.doc_id
GROUP BY s.doc_id, s.s
"""

# Turns in order; the template adds 8 + 8 + 8 characters to each turn, escapes add their own.
CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n
  FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(n) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learnt
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""

# crc32 over UTF-8: every byte enters by xor, then eight shifts (marked -1).  Text here is ASCII or
# Latin-1 letters, whose UTF-8 is 195 and the code point less 64.
CRC32 = """xor(4294967295, list_reduce(
  flatten(list_prepend([4294967295], list_transform(string_split({x}, ''), lambda c: CASE
    WHEN ord(c) < 128 THEN [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]
    ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, ord(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END))),
  lambda s, k: CASE WHEN k >= 0 THEN xor(s, k) ELSE xor(s >> 1, (s & 1) * 3988292384) END))"""

# Whole rebuilt turn lists as keys; a node's subtree by way of its descendants' smallest members.
PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT conv_id, w, CAST({CRC32.format(x="CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w
  FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
members AS (
  SELECT conv_id, d, len(w) = d AS ends, w[1:d] AS s, CASE WHEN d > 0 THEN w[1:d - 1] END AS p
  FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, s, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM members GROUP BY d, s, p),
children AS (SELECT d - 1 AS d, p AS s, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * strlen(coalesce(n.s[n.d].t, '')) AS saved
  FROM nodes n LEFT JOIN children c USING (d, s)),
subtrees AS (
  SELECT m.d, m.s, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM counted u JOIN members m ON m.conv_id = u.conv_id AND m.d <= u.d GROUP BY m.d, m.s)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM counted n JOIN subtrees t ON t.d = n.d AND t.s = n.s LEFT JOIN nodes q ON q.d = n.d - 1 AND q.s = n.p
"""

# Words one edit apart: equal after one deletion at the same place, or one deletion from the other.
SPELLING_VARIANTS = f"""
WITH RECURSIVE
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, CAST({CRC32.format(x="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS BIGINT) AS h FROM runs),
spoilt AS (
  SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN v b ON a.rest = b.word),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN ranked r ON r.word = v.word AND r.r = 1),
walk(word, reached, form) AS (
  SELECT word, word, form FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.form)
SELECT f.word, f.form, w.reached AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word AND w.form IS NULL
"""

SQL: dict[str, str] = {
    "op3_chat_formatting": CHAT, "op9_ngram_jaccard": NGRAM_JACCARD,
    "op11_prefix_trie": PREFIX_TRIE, "op13_spelling_variants": SPELLING_VARIANTS,
}
