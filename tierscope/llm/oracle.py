"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from tierscope.llm import chat, licenses

SQL: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op1_benchmark_decontamination"] = f"""
WITH items AS (
  SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
sized AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.i, g.k, x.item_id FROM grams g JOIN windows x USING (k, s)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL["op3_warc_transactions"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s,
             max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('{_BASE32}', 1 + (((('0x' || substr(s, 1 + 10 * (i // 8), 10))::UBIGINT)
         >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM q
"""

_ESCAPED = r"length(regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g'))"
SQL["op4_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum({len(chat.TURN + chat.TEXT + chat.END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]::VARCHAR[]"


_TEMPLATES = ", ".join(f"({i}, {_quoted(t.label)}, {_quoted(t.text)}, {_list(t.needs)}, {_list(t.lacks)})"
                       for i, t in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
SQL["op8_license_scan"] = f"""
WITH written AS (
  SELECT t, label, {_WORDS.format('text')} AS all_words, needs, lacks
  FROM (VALUES {_TEMPLATES}) v(t, label, text, needs, lacks)),
templates AS (
  SELECT t, label, list_distinct(all_words) AS w, needs, lacks, len(list_distinct(all_words)) AS size,
         ceil({licenses.THRESHOLD} * len(list_distinct(all_words)) - 1e-9)::BIGINT AS need,
         ceil(len(all_words) / {licenses.THRESHOLD} - 1e-9)::BIGINT AS width
  FROM written),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {_PHRASES}) v(p, label)),
docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT doc_id, label, i - 1 AS first
  FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM docs, phrases WHERE len(w) >= len(p))
  WHERE w[i:i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
asked AS (
  SELECT t, unnest(w) AS word, 1 AS own FROM templates UNION ALL SELECT t, unnest(lacks), 0 FROM templates),
said AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM docs),
held AS (SELECT doc_id, t, place, word, own FROM said JOIN asked USING (word)),
likely AS (
  SELECT doc_id, t FROM held JOIN templates USING (t)
  GROUP BY doc_id, t, need HAVING count(DISTINCT CASE WHEN own = 1 THEN word END) >= need),
parted AS (
  SELECT doc_id, t, place, word, own, sum(1 - own) OVER (PARTITION BY doc_id, t ORDER BY place) AS part
  FROM held SEMI JOIN likely USING (doc_id, t)),
blocks AS (
  SELECT a.doc_id, any_value(label) AS label, count(DISTINCT b.word) / any_value(size) AS containment
  FROM parted a JOIN templates USING (t)
  JOIN parted b ON a.doc_id = b.doc_id AND a.t = b.t AND a.part = b.part AND b.own = 1
       AND b.place BETWEEN a.place AND a.place + width - 1
  WHERE a.own = 1 GROUP BY a.doc_id, a.t, a.place
  HAVING count(DISTINCT b.word) >= any_value(need)
     AND count(DISTINCT CASE WHEN list_contains(needs, b.word) THEN b.word END) = any_value(len(needs))),
scored AS (SELECT doc_id, max(containment) AS score FROM blocks GROUP BY doc_id),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM blocks) GROUP BY doc_id)
SELECT doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score
FROM docs d LEFT JOIN base USING (doc_id) LEFT JOIN scored USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""

SQL["op6_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o WHERE 100 * c >= 80 * (na + nb - c)),
r(doc_id, m) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, m AS component_id FROM s JOIN c USING (doc_id)
"""

SQL["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL
    AND len([c FOR c IN x IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN x IF c <> 0]) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r(vec_id, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.vec_id WHERE r.m < e.b),
c AS (SELECT vec_id, min(m) AS m FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = vec_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

# CRC-32 of an ASCII string (reflected polynomial 0xEDB88320) as table and fold; needs crc in FROM.
_CRC_TABLE = """
crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT)),
    lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"""

SQL["op13_prefix_trie"] = f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS giver, {_CRC.format("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, role, text
  FROM (SELECT i.conv_id, 0 AS part, pos, role, text FROM ids i JOIN turns t ON t.conv_id = i.giver AND t.pos <= i.h
        UNION ALL
        SELECT i.conv_id, 1, pos, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h)),
steps AS (
  SELECT conv_id, 0 AS d, []::VARCHAR[] AS path, 0 AS size, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = i.conv_id) AS top
  FROM ids i
  UNION ALL
  SELECT conv_id, d, list(length(role) || ':' || role || text) OVER (PARTITION BY conv_id ORDER BY d),
         length(text), count(*) OVER (PARTITION BY conv_id) FROM rebuilt),
nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (top = d), '')) AS ends_sha256
  FROM steps GROUP BY path),
named AS (SELECT s.conv_id AS member, n.* FROM steps s JOIN nodes n USING (path)),
pairs AS (
  SELECT DISTINCT a.path AS path, b.path AS below, b.depth - a.depth AS down, b.n_convs, b.size
  FROM named a JOIN named b ON a.member = b.member AND b.depth >= a.depth),
childless AS (SELECT path FROM pairs GROUP BY path HAVING max(down) = 0),
sums AS (
  SELECT p.path, count(*) FILTER (down = 1) AS n_children, count(c.path) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
  FROM pairs p LEFT JOIN childless c ON c.path = p.below GROUP BY p.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN nodes up ON n.depth > 0 AND up.path = n.path[:n.depth - 1]
"""

_TO = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}


def _way(state, edit, cost, line):
    """Struct of cost, edits and repaired text: one edit before the best way on from a state (0 to 3)."""
    v = f"v[{state + 1}]"
    text = v + ".t" if line is None else f"({line} || CASE WHEN {v}.t = '' THEN '' ELSE chr(10) || {v}.t END)"
    return f"{{'c': {v}.c + {cost}, 'a': '{edit}' || {v}.a, 't': {text}}}"


def _row_ways(s):
    """All ways from state s through one row, from ways v behind it."""
    asked, then = [("'user'", 2), ("'user'", 2), ("'assistant'", 3), ("'user'", 2)][s]
    keep = "CASE" + "".join(f" WHEN initial = '{i}' AND fault NOT IN ('B', 'D') THEN {_way(to[s], 'K', extra, line)}"
                            for i, to in _TO.items() if to[s] is not None
                            for extra, line in [("(fault = 'T')::BIGINT", "role || ':' || text")]) + " END"
    change = (f"CASE WHEN fault NOT IN ('B', 'D') THEN "
              + _way(then, "R", "2 + (fault = 'T')::BIGINT", f"{asked} || ':' || text") + " END")
    return f"list_min(list_filter([{_way(s, 'D', 3, None)}, {keep}, {change}], lambda x: x IS NOT NULL))"


def _insert_ways(s):
    asked, then = [("'user:'", 2), ("'user:'", 2), ("'assistant:'", 3), ("'user:'", 2)][s]
    return f"list_min([v[{s + 1}], {_way(then, 'I', 2, asked)}])"


_FOUR = lambda way: "[" + ", ".join(way(s) for s in range(4)) + "]"

SQL["op11_conversation_repair"] = f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM keyed)),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS k FROM damaged),
marked AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS pos,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'B' WHEN k > 1 THEN 'D'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'T' ELSE '-' END AS fault,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '-' END AS initial
  FROM seen),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ways AS (
  SELECT i.conv_id, (SELECT count(*) FROM marked m WHERE m.conv_id IS NOT DISTINCT FROM i.conv_id) AS pos,
         [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {{'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}},
          {{'c': 2::BIGINT, 'a': 'I', 't': 'assistant:'}}, {{'c': 0::BIGINT, 'a': '', 't': ''}}] AS v
  FROM ids i
  UNION ALL
  SELECT conv_id, pos, {_FOUR(_insert_ways)} AS v FROM (
    SELECT conv_id, pos, {_FOUR(_insert_ways)} AS v FROM (
      SELECT conv_id, pos, {_FOUR(_insert_ways)} AS v FROM (
        SELECT w.conv_id, w.pos - 1 AS pos, {_FOUR(_row_ways)} AS v
        FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.pos = w.pos)))),
neighbours AS (
  SELECT conv_id, turn, fault, coalesce(lag(initial) OVER o || initial NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'B') AS blank, count(*) FILTER (fault = 'D') AS duplicate,
         count(*) FILTER (fault = 'T') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM neighbours GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, v[1].c AS cost, v[1].a AS audit,
       sha256(v[1].t) AS repaired_sha256
FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.pos = 0
"""
