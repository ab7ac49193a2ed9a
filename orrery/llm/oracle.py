"""SQL (DuckDB) for the queries whose results SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"

OP1 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(24 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM chats"""

_STRIPPED = """trim(x, '.,;:!?"''()[]|')"""
OP2 = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN {_STRIPPED} = '' THEN x ELSE {_STRIPPED} END) AS ws FROM documents),
shingle AS (SELECT DISTINCT doc_id, ws[i + 1 : i + 5] AS s FROM doc, unnest(range(greatest(1, len(ws) - 4))) t(i) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE common.n >= CAST(0.8 AS DOUBLE) * (x.n + y.n - common.n) - CAST(1e-9 AS DOUBLE)),
reach(a, b) AS (SELECT doc_id, doc_id FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT reach.a AS doc_id, min(reach.b) AS class_id, coalesce(any_value(degree.n), 0) AS n_links FROM reach LEFT JOIN degree ON degree.a = reach.a GROUP BY reach.a"""

_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, ws[i + 1 : i + least(13, len(ws))] AS w FROM item, unnest(range(greatest(1, len(ws) - 12))) t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT len(w) AS n FROM win),
doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
spot AS (SELECT doc_id, i, n, ws[i + 1 : i + n] AS w FROM doc CROSS JOIN lens, unnest(range(greatest(0, len(ws) - n + 1))) t(i)),
hit AS (SELECT doc_id, i, n, item FROM spot JOIN win ON spot.w = win.w),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(range(i, i + n)) u(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN covered ON covered.doc_id = doc.doc_id LEFT JOIN found ON found.doc_id = doc.doc_id"""

_SPACED = "list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP12 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, {_SPACED} AS ws FROM doc),
origin AS (SELECT text, min(doc_id) AS origin FROM doc GROUP BY text),
mark AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(split.text, '[^A-Z]', '', 'g')) > 10 * length(split.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(split.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN split.doc_id > origin THEN 16 ELSE 0 END AS mask
  FROM split JOIN origin ON origin.text = split.text LEFT JOIN mark ON mark.doc_id = split.doc_id),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM masked GROUP BY part, mask),
f(letter, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o, last, own, earlier, step) AS (
  SELECT '', '', 0, 0, 0 UNION ALL SELECT o || f.letter, f.letter, f.own, orders.earlier + orders.own, step + 1 FROM orders, f WHERE step < 5 AND position(f.letter IN o) = 0),
steps AS (SELECT whole.o AS filter_order, part.step, part.own, part.earlier FROM orders whole JOIN orders part ON part.step > 0 AND whole.step = 5 AND starts_with(whole.o, part.o))
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n_toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM cell CROSS JOIN steps GROUP BY part, filter_order, step, own"""

_DELETED = "w[1 : i - 1] || w[i + 1 :]"
OP13 = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS t),
doc AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, regexp_extract_all({_LOWERED}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+') AS ws FROM documents),
run AS (SELECT d, w, count(*) AS k FROM (SELECT d, unnest(ws) AS w FROM doc) GROUP BY d, w),
octets AS (SELECT d, w, k, hex(encode(d || ':' || w)) AS x FROM run),
hashed AS (SELECT w, k, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i : i + 1] AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), CAST(4294967295 AS BIGINT)) AS h FROM octets, crc),
word AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS w, k FROM hashed) WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
place AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM word),
gap AS (SELECT w, n, w[1 : i - 1] || '?' || w[i + 1 :] AS g FROM place),
cut AS (SELECT DISTINCT w, n, {_DELETED} AS g FROM place),
near AS (SELECT a.w AS a, b.w AS b, b.n FROM gap a JOIN gap b ON a.g = b.g AND a.w <> b.w
  UNION ALL SELECT cut.w, word.w, word.n FROM cut JOIN word ON word.w = cut.g UNION ALL SELECT word.w, cut.w, cut.n FROM cut JOIN word ON word.w = cut.g),
best AS (SELECT a, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS b FROM near GROUP BY a),
form AS (SELECT w AS word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN b END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM word LEFT JOIN best ON best.a = word.w),
chain(word, root, step) AS (SELECT word, word, 0 FROM form UNION ALL SELECT chain.word, form.form, step + 1 FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM chain WHERE chain.word = form.word) AS root, n, n_near, form_n FROM form"""

ORACLE_SQL = {"op1_chat_format": OP1, "op2_jaccard_join": OP2, "op8_decontaminate": OP8, "op12_filter_audit": OP12, "op13_spelling_variants": OP13}
