"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), [])"

OP10 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, len(ws) AS n_words FROM w),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, n_words - 18)) AS s FROM p)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
each AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, n_words + 1)) AS i FROM p)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS t
         FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM p LEFT JOIN kept USING (doc_id)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, n) AS head FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(x, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM f
"""

OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

_ROLE = r'(?:[A-Z][a-z]*|"(?:[^"\\\n]|\\.)*")'
_CONTROL = rf"(\\*(?:### {_ROLE}:|</turn>))"

OP6 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, r)),
g AS (SELECT *,
  -- A text is escaped if taking backslashes off would change it, or if it would end its turn early.
  CASE WHEN regexp_matches(text, '\\(### |</turn>)') OR contains(text || chr(10) || '</turn>' || chr(10), chr(10) || '</turn>' || chr(10) ) AND
            strpos(text || chr(10) || '</turn>' || chr(10), chr(10) || '</turn>' || chr(10)) <= length(text)
       THEN regexp_replace(text, '{_CONTROL.replace("'", "''")}', '\\\1', 'g') ELSE text END AS shown FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || upper(substr(role, 1, 1)) || substr(role, 2) || ':' || chr(10) || shown || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""

#: CRC-32 of an ASCII string: eight shifts for every byte.
_BIT = "list_reduce([xor({c}, {b}), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"


def _crc32(text: str) -> str:
    each = _BIT.format(c="c", b="b")
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ord({text}[i]) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {each}), 4294967295)"


def _encoded(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
         CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS now
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (SELECT tree, 0 AS level, idx, n, leaf AS x FROM p
  UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 2, n),
sub AS (SELECT tree, level, x, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, x FROM sub
  UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
path AS (
  SELECT p.doc_id, p.leaf, l.level, (p.idx >> l.level) & 1 AS bit, s.x FROM p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) l USING (tree)
  LEFT JOIN low s ON s.tree = p.tree AND s.level = l.level AND s.idx = xor(p.idx >> l.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, 1000 + t.level, (sub.idx >> t.level) & 1, s.x FROM p JOIN sub USING (tree) CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t
  LEFT JOIN top s ON s.level = t.level AND s.idx = xor(sub.idx >> t.level, 1)),
steps AS (SELECT doc_id, leaf, list({{'bit': bit, 'x': coalesce(x, '')}} ORDER BY level) AS steps FROM path GROUP BY doc_id, leaf),
walk AS (SELECT doc_id, leaf, now AS x, coalesce(steps, []) AS rest FROM p LEFT JOIN steps USING (doc_id, leaf)
  UNION ALL SELECT doc_id, leaf, sha256(CASE WHEN rest[1].bit = 0 THEN x || rest[1].x ELSE rest[1].x || x END), rest[2:] FROM walk WHERE len(rest) > 0)
SELECT p.doc_id, p.leaf, sub.x AS subroot, root.x AS root,
       sha256(coalesce(array_to_string(list_transform(steps, lambda s: s.x), ''), '')) AS proof_sha256, w.x AS folded_root, w.x = root.x AS verified
FROM p JOIN sub USING (tree) CROSS JOIN (SELECT x FROM top WHERE n = 1) root
JOIN (SELECT doc_id, leaf, x FROM walk WHERE len(rest) = 0) w USING (doc_id, leaf) LEFT JOIN steps USING (doc_id, leaf)
"""

OP12 = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT k, {_crc32('k')} % 20 AS kind FROM (SELECT DISTINCT k FROM o)),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role0 END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text, role0, sha256(text0) AS x0, c
      FROM o JOIN kinds USING (k) CROSS JOIN (VALUES (0), (1)) AS copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)),
p AS (SELECT coalesce('=' || conv_id, '') AS key, conv_id, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, x0, c) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
          WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'd'
          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault,
        substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY key ORDER BY i) AS before FROM p),
stats AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key),
-- States: 0 nothing, 1 system, 2 user, 3 assistant.  Up to two inserts before a row or at the end; more come to a state that fewer reach.
ins(s, t, k, roles) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''),
  (0, 2, 'I', 'u'), (1, 2, 'I', 'u'), (3, 2, 'I', 'u'), (2, 3, 'I', 'a'), (0, 3, 'II', 'ua'), (1, 3, 'II', 'ua')),
-- Edits of one row: from state, to state, initial, own role kept as '='.
ed(s, t, k, c, role, cost) AS (
  SELECT s, s, 'D', CAST(NULL AS VARCHAR), '', 3 FROM (VALUES (0), (1), (2), (3)) AS a(s)
  UNION ALL VALUES (0, 2, 'R', NULL, 'user', 2), (1, 2, 'R', NULL, 'user', 2), (3, 2, 'R', NULL, 'user', 2), (2, 3, 'R', NULL, 'assistant', 2),
    (0, 1, 'K', 's', '=', 0), (0, 2, 'K', 'u', '=', 0), (1, 2, 'K', 'u', '=', 0), (3, 2, 'K', 'u', '=', 0), (2, 3, 'K', 'a', '=', 0)),
step AS (SELECT ins.s, ed.t, ins.k || ed.k AS k, 2 * length(ins.k) + ed.cost AS cost, ed.c, ed.k AS edit, ins.roles, ed.role FROM ins JOIN ed ON ed.s = ins.t),
walk AS (
  SELECT key, n, CAST(0 AS BIGINT) AS i, 0 AS s, {{'cost': CAST(0 AS BIGINT), 'k': ''}} AS best, CAST([] AS VARCHAR[]) AS body
  FROM (SELECT DISTINCT key, n FROM f)
  UNION ALL
  SELECT key, n, i, s, best, body FROM (
    SELECT w.key, w.n, f.i, step.t AS s, {{'cost': w.best.cost + step.cost + CASE WHEN f.fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, 'k': w.best.k || step.k}} AS best,
      w.body || CASE roles WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] WHEN 'ua' THEN ['user:', 'assistant:'] ELSE [] END
        || CASE WHEN edit = 'D' THEN [] WHEN step.role = '=' THEN [f.role || ':' || f.text] ELSE [step.role || ':' || f.text] END AS body
    FROM walk w JOIN f ON f.key = w.key AND f.i = w.i + 1 JOIN step ON step.s = w.s AND (step.c IS NULL OR step.c = f.c) AND (f.fault NOT IN ('b', 'd') OR edit = 'D'))
  QUALIFY row_number() OVER (PARTITION BY key, s ORDER BY best) = 1),
fin AS (SELECT key, best.cost + 2 * length(ins.k) AS cost, best.k || ins.k AS audit,
        body || CASE ins.roles WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] WHEN 'ua' THEN ['user:', 'assistant:'] ELSE [] END AS body
      FROM walk JOIN ins ON ins.s = walk.s AND ins.t IN (0, 3) WHERE i = n
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY best.cost + 2 * length(ins.k), best.k || ins.k) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS key FROM conversations) LEFT JOIN stats USING (key) LEFT JOIN fin USING (key)
"""

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_KINDS = (("email", _EMAIL), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
_STARTS = "CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT)"
_NEAR = r"regexp_extract_all(lower(regexp_replace({}, '[^\x20\x09-\x0D@]*@[^\x20\x09-\x0D]*', ' ', 'g')), '[\p{{L}}\p{{M}}]{{3,}}')"
_LEFT = _NEAR.format(r"CASE WHEN length(gaps[i]) > 160 THEN regexp_replace(right(gaps[i], 160), '^[\p{L}\p{M}]+', '') ELSE gaps[i] END")
_RIGHT = _NEAR.format(r"CASE WHEN length(gaps[i + 1]) > 160 THEN regexp_replace(left(gaps[i + 1], 160), '[\p{L}\p{M}]+$', '') ELSE gaps[i + 1] END")

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({' UNION ALL '.join(f"SELECT r, text, {no} AS no, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM d" for no, (kind, p) in enumerate(_KINDS))}),
y AS (SELECT r, text, no, kind, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM x),
z AS (SELECT *, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits FROM y),
m AS (SELECT r, text, no, kind, {_STARTS} AS a, length(hit) AS n, kind || ':' || CASE kind WHEN 'email' THEN lower(hit) WHEN 'ip' THEN hit ELSE digits END AS entity,
        list_slice(list_reverse({_LEFT}), 1, 8) || list_slice({_RIGHT}, 1, 8) AS terms
      FROM z WHERE CASE kind WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: coalesce(TRY_CAST(p AS INT) <= 255, false)))
        WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
        WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda j:
          CASE WHEN j % 2 = 1 THEN CAST(reverse(digits)[j] AS INT) ELSE (2 * CAST(reverse(digits)[j] AS INT)) // 10 + (2 * CAST(reverse(digits)[j] AS INT)) % 10 END)) % 10 = 0
        ELSE true END),
pairs AS (SELECT DISTINCT r, text, entity, term FROM (SELECT r, text, entity, unnest(terms) AS term FROM m)),
co AS (SELECT entity, term, count(*) AS n_both FROM pairs GROUP BY ALL HAVING count(DISTINCT text) >= 3),
ents AS (SELECT entity, count(DISTINCT r) AS n_entity FROM m GROUP BY ALL),
terms AS (SELECT term, count(*) AS n_term FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]{{3,}}')) AS term FROM d) GROUP BY ALL),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
flagged AS (SELECT entity, term FROM co JOIN ents USING (entity) JOIN terms USING (term) CROSS JOIN total
  WHERE n_entity < n AND log2(n * n_both / (CAST(n_entity AS DOUBLE) * n_term)) / log2(n / n_entity) >= 0.9),
listed AS (SELECT DISTINCT r, text, term FROM pairs JOIN flagged USING (entity, term)),
tx AS (SELECT r, regexp_extract_all(text, '{_EMAIL}|[\p{{L}}\p{{M}}]+') AS hits, string_split_regex(text, '{_EMAIL}|[\p{{L}}\p{{M}}]+') AS gaps FROM (SELECT DISTINCT r, text FROM listed)),
ty AS (SELECT r, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM tx),
tm AS (SELECT r, {_STARTS} AS a, length(hits[i]) AS n FROM ty JOIN listed USING (r) WHERE lower(hits[i]) = listed.term),
base AS (SELECT r, count(*) FILTER (no = 0) AS n_email, count(*) FILTER (no = 1) AS n_ip, count(*) FILTER (no = 2) AS n_card, count(*) FILTER (no = 3) AS n_phone,
           string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, no) AS s FROM m GROUP BY r),
alls AS (SELECT r, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, no) AS s
         FROM (SELECT r, no, kind, a, n FROM m UNION ALL SELECT r, 4, 'term', a, n FROM tm) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base.s, '')) AS base_sha256, coalesce(alls.s, '') AS spans
FROM d LEFT JOIN base USING (r) LEFT JOIN alls USING (r)
"""
