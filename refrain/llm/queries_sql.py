"""SQL that checks what SQL can express; CRC-32 by its table (polynomial: fixed value)."""

_CRC_TABLE = """
crc_table AS (SELECT list_transform(range(256), lambda byte: list_reduce([byte] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)"""


def _crc(codes: str) -> str:
    """CRC-32 of a list of bytes, with crc_table in reach."""
    return f"xor(list_reduce([4294967295] || ({codes}), lambda c, byte: xor(c >> 8, crcs[(xor(c, byte) & 255) + 1])), 4294967295)"


_LETTERS = "list_transform(string_split(w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x)::BIGINT - 64] END)"

OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
    FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc(f"list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda x: ord(x)::BIGINT) || flatten({_LETTERS})")} AS h
    FROM lowered, crc_table),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN w[1 : (h % length(w))::INT] || w[(h % length(w))::INT + 2 :] ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS best_word, max(n) AS best_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best_word END AS form,
    CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
followed AS (SELECT word, form, word AS root, form AS next FROM forms
    UNION ALL SELECT o.word, o.form, o.next, f.form FROM followed o JOIN forms f ON o.next = f.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN followed r ON f.word = r.word AND r.next IS NULL
"""

OP13_SQL = f"""
WITH {_CRC_TABLE},
convs AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT c.conv_id, c.own, coalesce(b.own, []) AS head, ({_crc("list_transform(string_split(c.conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} % 6)::INT AS h
    FROM crc_table, convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100),
rebuilt AS (SELECT conv_id, list_concat(head[1 : h], own[h + 1 :]) AS turns FROM headed),
prefixes AS (SELECT conv_id, d AS depth, turns[1 : d] AS path, len(turns) = d AS ends
    FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(coalesce(path[depth].text, ''))) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY path, depth),
children AS (SELECT path[1 : depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
above AS (SELECT path[1 : d] AS path, saved, n_children FROM (SELECT path, saved, n_children, unnest(range(depth + 1)) AS d FROM counted)),
sums AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON n.path = s.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1 : n.depth - 1]
"""
