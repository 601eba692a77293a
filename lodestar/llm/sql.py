"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

import re

from .licenses import PHRASES, TEMPLATES
from .rules import RULES as THRESHOLDS
from .rules import OTHER_SCRIPT, STOP_WORDS, WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = rf"""
WITH d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, {_SPACED})), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM s),
o AS (SELECT most, weight, sum(most) OVER f AS used, sum(weight) OVER () - sum(weight) OVER f AS rest FROM w WINDOW f AS (ORDER BY most / weight, r ROWS UNBOUNDED PRECEDING)),
t AS (SELECT (sum(source_size)::BIGINT * 150)::DOUBLE / 100 AS total FROM s),
l AS (SELECT max((total - used::DOUBLE) / rest::DOUBLE) AS level FROM t, (SELECT used, rest FROM o UNION ALL SELECT 0, (SELECT sum(weight) FROM w)) WHERE rest > 0),
g AS (SELECT source, source_size, least(weight * level, most::DOUBLE) AS target FROM w, l),
p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (coin < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM p
"""


def _verdict() -> str:
    tests = ["n_words > 0"]
    for _, measure, least, most in THRESHOLDS:
        above, below = measure.split(" / ")
        value = f"{above}::DOUBLE / nullif({below}, 0)"
        tests += [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
    return "coalesce(" + " AND ".join(tests) + ", false)"


RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT rid, t FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM windows JOIN twice USING (rid, t)) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclamations,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len([x FOR x IN w IF lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}) OR regexp_matches(x, '{OTHER_SCRIPT}')]) AS n_stop_words
  FROM d LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept FROM f
"""


def _escaped(column: str, marks: str) -> str:
    return f"(2 * length({column}) - length(translate({column}, '{marks}', '')))"


CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(15 + {_escaped('role', chr(92) + '#<:')} + {_escaped('text', chr(92) + '#<')})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


_TEMPLATES = ", ".join(f"({sorted(set(_plain_words(t)))}, '{label}')" for t, label in TEMPLATES)
_PHRASES = ", ".join(f"({_plain_words(p)}, '{label}')" for p, label in PHRASES)

LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_PLAIN} AS w FROM documents),
phrases AS (FROM (VALUES {_PHRASES}) AS v(p, label)),
templates AS (FROM (VALUES {_TEMPLATES}) AS v(t, label)),
places AS (SELECT rid, i, label FROM (SELECT rid, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, phrases WHERE len(w) >= len(p)) WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT rid, count(*) AS n, min(i) - 1 AS low, max(i) - 1 AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rid),
lines AS (SELECT rid, list_distinct({_PLAIN}) AS w FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM d)),
met AS (SELECT rid, label, len(list_intersect(w, t)) AS shared, len(t) AS n FROM lines, templates WHERE list_has_any(w, t)),
good AS (SELECT rid, label, shared::DOUBLE / n AS share FROM met WHERE shared >= ceil(0.8 * n - 1e-9)),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM good UNION SELECT rid, label FROM places) GROUP BY rid),
best AS (SELECT rid, max(share) AS share FROM good GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN best USING (rid)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hexed, {1 + 5 * i}, 5))::INT >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = kept OR kept IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept OR kept IS NULL THEN NULL ELSE kept END AS refers_to FROM k
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM v) WHERE len(w) >= size)),
h AS (SELECT rid, i, x.size, item_id FROM x JOIN v USING (size, t)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM h) GROUP BY rid),
g AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN g USING (rid)
"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS nt FROM d),
asked AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY q, t),
held AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY rid, t),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM held, s GROUP BY t, nd),
x AS (SELECT rid, t, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * nd) // nt))) AS part FROM held JOIN d USING (rid) JOIN f USING (t), s),
z AS (SELECT q, rid, doc_id, sum(c * part)::BIGINT AS score FROM asked JOIN x USING (t) GROUP BY ALL HAVING sum(c * part) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM z)
SELECT item_id, rank, doc_id, score FROM r JOIN b USING (q) WHERE rank <= 20
"""

#: CRC-32 from its polynomial, byte by byte; words one edit apart share a word with one letter masked, or one is the other with a letter taken out.
SPELLING = rf"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
runs AS (SELECT d, r, count(*) AS n FROM (SELECT doc_id::VARCHAR AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY d, r),
coded AS (SELECT r, n, hex(encode(coalesce(d, '') || ':' || r)) AS x FROM runs),
hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1])), 4294967295) AS h FROM coded, c),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS less, length(word) AS l FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.l = b.l AND a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.less = w.word UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.less = w.word),
ranked AS (SELECT near.word, other, n, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS r, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN w ON w.word = other),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN ranked.n >= 2 * w.n THEN other END AS form, CASE WHEN ranked.n >= 2 * w.n THEN ranked.n END AS form_n FROM w LEFT JOIN ranked ON w.word = ranked.word AND r = 1),
walk AS (SELECT word, word AS root FROM formed UNION SELECT walk.word, form FROM walk JOIN formed ON walk.root = formed.word WHERE form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN (SELECT word, root FROM walk JOIN (SELECT word AS root FROM formed WHERE form IS NULL) USING (root)) USING (word)
"""
