"""Comparison SQL of the spelling, chat and trie queries; DuckDB has no crc32, so it is built from its polynomial."""
CRC = """tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)))"""


def crc32(hexed):
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({hexed}) + 1, 2),
         lambda i: CAST('0x' || {hexed}[i:i + 1] AS BIGINT))), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"""


SQL: dict[str, str] = {}
SQL["op11_spelling"] = f"""
WITH RECURSIVE {CRC},
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[a-zÀ-ÿ]+')) AS w FROM documents),
many AS (SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') AS d, count(*) AS k FROM run WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, k, {crc32("x")} AS h FROM (SELECT w, k, hex(encode(d || ':' || w)) AS x FROM many), tab),
slip AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM hashed),
word AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM slip WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
cut AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS x FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word)),
near AS (SELECT a.w, a.n, b.w AS o, b.n AS o_n FROM cut a JOIN cut b USING (i, x) WHERE a.w <> b.w
         UNION SELECT a.w, a.n, b.w, b.n FROM cut a JOIN word b ON a.x = b.w
         UNION SELECT b.w, b.n, a.w, a.n FROM cut a JOIN word b ON a.x = b.w),
top AS (SELECT w, count(*) AS n_near, first(o ORDER BY o_n DESC, o) AS o, max(o_n) AS o_n FROM near GROUP BY w),
formed AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= 5 * n THEN o END AS form, CASE WHEN o_n >= 5 * n THEN o_n END AS form_n
           FROM word LEFT JOIN top USING (w)),
walk AS (SELECT w, w AS root FROM formed UNION SELECT walk.w, f.form FROM walk JOIN formed f ON f.w = walk.root WHERE f.form IS NOT NULL),
last AS (SELECT walk.w, root FROM walk JOIN formed f ON f.w = walk.root WHERE f.form IS NULL)
SELECT w AS word, form, root, n, n_near, form_n FROM formed JOIN last USING (w)
"""


SQL["op12_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (SELECT *, row_number() OVER w - 1 AS pos, lag(role) OVER w AS before FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
j AS (SELECT *, CASE role WHEN 'system' THEN pos > 0 WHEN 'user' THEN pos > 0 AND before NOT IN ('system', 'assistant')
                          WHEN 'assistant' THEN pos = 0 OR before <> 'user' ELSE TRUE END AS bad FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + 1 + 11 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars,
       NOT bool_or(bad) AS order_ok, min(pos) FILTER (WHERE bad) AS bad_turn
FROM j GROUP BY conv_id
"""


SQL["op13_prefix_trie"] = f"""
WITH {CRC},
own AS (SELECT conv_id AS c, list(coalesce(role, '') || chr(0) || coalesce(text, '') ORDER BY turn NULLS FIRST, role, text) AS t
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, own.t AS own_turns, {crc32("x")} % 4 AS h FROM (SELECT c, t, hex(encode(CAST(c AS VARCHAR))) AS x FROM own) own, tab),
r AS (SELECT h.c, list_concat(coalesce(b.t, [])[1:h], own_turns[h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
pre AS (SELECT c, len(s) AS size, d, s[1:d] AS p, CASE WHEN d > 0 THEN s[1:d - 1] END AS up,
               CASE WHEN d > 0 THEN len(regexp_extract_all(split_part(s[d], chr(0), 2), '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
        FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
node AS (SELECT p, min(d) AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends_sha256
         FROM pre GROUP BY p),
kids AS (SELECT up AS p, count(*) AS k FROM node WHERE up IS NOT NULL GROUP BY up),
full_node AS (SELECT node.*, coalesce(k, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
below AS (SELECT p[1:d] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
          FROM (SELECT p, saved, n_children, unnest(range(0, depth + 1)) AS d FROM full_node) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
       f.ends_sha256
FROM full_node f JOIN below b USING (p) LEFT JOIN node u ON u.p = f.up
"""
