"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from learnspark.llm.quality_rules import DELTA, LEVELS, MIN_WORDS, RISK, RULES

WORD = r"[^\x20\x09-\x0D]+"

_THREADS = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
ln AS (SELECT id, i, regexp_extract(line, '^((?:[ \t]?>)+)[ \t]?') AS marks, line FROM (SELECT id, unnest(regexp_split_to_array(text, '\r?\n')) AS line, unnest(range(1, len(regexp_split_to_array(text, '\r?\n')) + 1)) AS i FROM m)),
lv AS (SELECT id, i, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS line FROM ln),
quoting AS (SELECT id, max(level) > 0 AS quoted FROM lv GROUP BY 1),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS island FROM lv),
blk AS (SELECT id, level, island, min(i) AS pos, string_agg(line, chr(10) ORDER BY i) AS passage FROM isl GROUP BY 1, 2, 3),
own0 AS (SELECT id, trim(string_agg(passage, chr(10) ORDER BY pos) FILTER (level = 0)) AS own FROM blk GROUP BY 1),
own AS (SELECT m.*, CASE WHEN quoted THEN coalesce(own0.own, '') ELSE text END AS own FROM m LEFT JOIN quoting USING (id) LEFT JOIN own0 USING (id)),
said AS (SELECT DISTINCT conv_id, turn, level, NORMAL(passage) AS p, list_filter(list_transform(string_split(passage, chr(10)), lambda x: NORMAL(x)), lambda x: x <> '') AS ls FROM blk JOIN m USING (id) WHERE level > 0 AND NORMAL(passage) <> ''),
parts AS (SELECT conv_id, turn, unnest(list_concat([own], regexp_split_to_array(own, '\n[ \t]*\n'), string_split(own, chr(10)))) AS o FROM own WHERE own IS NOT NULL AND conv_id IN (SELECT conv_id FROM said)),
whole AS (SELECT conv_id, NORMAL(o) AS p, min(turn) AS origin FROM parts GROUP BY 1, 2),
held AS (SELECT conv_id, turn, list_filter(list_transform(string_split(own, chr(10)), lambda x: NORMAL(x)), lambda x: x <> '') AS ls FROM own WHERE own IS NOT NULL),
run AS (SELECT s.conv_id, s.turn, s.level, s.p, s.ls, min(h.turn) AS origin FROM said s JOIN held h ON h.conv_id = s.conv_id AND len(s.ls) > 1
        AND len(list_filter(range(1, len(h.ls) - len(s.ls) + 2), lambda k: h.ls[k:k + len(s.ls) - 1] = s.ls)) > 0 GROUP BY ALL),
linked AS (SELECT s.conv_id, s.turn, s.level, s.p, min(CASE WHEN least(w.origin, r.origin) < s.turn THEN least(w.origin, r.origin) END) AS origin
           FROM said s LEFT JOIN whole w ON w.conv_id = s.conv_id AND w.p = s.p LEFT JOIN run r ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.level = s.level AND r.p = s.p AND r.ls = s.ls GROUP BY 1, 2, 3, 4),
lev AS (SELECT conv_id, turn, level, max(origin) AS origin, count(*) AS n, count(origin) AS k FROM linked GROUP BY 1, 2, 3),
heads AS (SELECT conv_id, turn, min_by(origin, level) FILTER (origin IS NOT NULL) AS quoted, CAST(sum(n) AS BIGINT) AS n_quotes, CAST(sum(k) AS BIGINT) AS n_linked FROM lev GROUP BY 1, 2),
places AS (SELECT p.conv_id, p.turn, quoted, n_quotes, n_linked FROM (SELECT DISTINCT conv_id, turn FROM m) p LEFT JOIN heads h ON h.conv_id = p.conv_id AND h.turn = p.turn),
here AS (SELECT *, coalesce(quoted, lag(turn) OVER w) AS parent, max(CASE WHEN quoted IS NOT NULL THEN turn END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM places WHERE conv_id IS NOT NULL AND turn IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
paths(conv_id, head, path, up) AS (
  SELECT s.conv_id, s.turn, [s.turn], q.head FROM here s JOIN here q ON q.conv_id = s.conv_id AND q.turn = s.quoted WHERE s.quoted IS NOT NULL
  UNION ALL SELECT p.conv_id, p.head, list_concat([p.up], p.path), q.head FROM paths p JOIN here s ON s.conv_id = p.conv_id AND s.turn = p.up JOIN here q ON q.conv_id = s.conv_id AND q.turn = s.quoted WHERE p.up IS NOT NULL)
SELECT o.conv_id, o.turn, role, h.parent AS parent_turn, coalesce(h.n_quotes, p.n_quotes, 0) AS n_quotes, coalesce(h.n_linked, p.n_linked, 0) AS n_linked, coalesce(b.path, []) AS branch, own AS text
FROM own o LEFT JOIN here h ON h.conv_id = o.conv_id AND h.turn = o.turn LEFT JOIN places p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.turn IS NOT DISTINCT FROM o.turn
LEFT JOIN paths b ON b.conv_id = h.conv_id AND b.head = h.head AND b.up IS NULL
"""


def _normal(found) -> str:
    """Quote-free text in one line, A-Z in lower case."""
    return rf"trim(regexp_replace(translate({found[1]}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"


THREADS = re.sub(r"NORMAL\((\w+)\)", _normal, _THREADS)

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
told AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM words),
gone AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g FROM told)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (g) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT g) AS kept FROM gone GROUP BY 1) USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
least_ AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM e WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN least_ ON id = vec_id
"""


def _first_level() -> str:
    levels = [f"greatest(ceil(({lenient}::DOUBLE - {num}::DOUBLE / greatest({den}, 1)) / {(lenient - strict) / (LEVELS - 1)!r}::DOUBLE - 1e-9), 0)" for num, den, lenient, strict in RULES.values()]
    return f"CAST(least({LEVELS}, {', '.join(levels)}) AS INT)"


QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS w FROM d),
words AS (SELECT doc_id, i, w[i] AS word, lag(w[i]) OVER (PARTITION BY doc_id ORDER BY i) AS before, CASE WHEN i + 2 <= len(w) THEN w[i:i + 2] END AS tri
          FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
twice AS (SELECT *, tri IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, tri) > 1 AS again FROM words),
covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM twice),
counts AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (c) AS n_repeat_words, count(*) FILTER (word = before) AS n_stutter FROM covered GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
m0 AS (SELECT d.doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
              length(regexp_replace(t, '[^!?]', '', 'g')) AS n_bangs, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, coalesce(n_stutter, 0) AS n_stutter
       FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN lines USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_first_level()} AS first_level FROM m0),
held AS (SELECT doc_id, any_value(lang) AS lang, min(first_level) AS lev FROM m JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) WHERE NOT base_failed AND q = 1 GROUP BY 1),
total AS (SELECT lang, count(*) AS n FROM held GROUP BY 1),
steps AS (SELECT total.lang, n, j, (SELECT count(*) FROM held WHERE held.lang IS NOT DISTINCT FROM total.lang AND lev <= j) AS k FROM total, range({LEVELS}) r(j)),
tails AS (SELECT lang, j, k < {RISK} * n AND (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM range(k + 1) q(i)) <= {DELTA}::DOUBLE / (SELECT count(*) FROM total) AS passes FROM steps),
accepted AS (SELECT lang, coalesce(min(j) FILTER (NOT passes), {LEVELS}) - 1 AS a FROM tails GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first_level > coalesce(a, -1) AS kept, m.lang, first_level
FROM m LEFT JOIN accepted ON accepted.lang IS NOT DISTINCT FROM m.lang
"""

#: CRC-32 of the conversation's decimal id, bit by bit: -1 stands for one bit shifted out.
_CRC = "xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [ascii(s), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295), 4294967295)"

PREFIXES = f"""
WITH own AS (SELECT conv_id, list([md5(coalesce(role, '') || chr(0) || coalesce(text, '')), CAST(strlen(coalesce(text, '')) AS VARCHAR)] ORDER BY turn NULLS FIRST, role, text) AS w
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, w, {_CRC} % 9 AS h FROM own),
made AS (SELECT h.conv_id, list_concat(coalesce(b.w, [])[1:h], h.w[h + 1:]) AS w FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
pre AS (SELECT conv_id, d, len(w) AS n, array_to_string(list_transform(w[1:d], lambda x: x[1]), '') AS node, CASE WHEN d > 0 THEN CAST(w[d][2] AS BIGINT) ELSE 0 END AS size
        FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM made)),
nodes AS (SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY 1),
kids AS (SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT left(node, 32 * t) AS top, saved, k IS NULL AS leaf FROM (SELECT node, saved, k, unnest(range(0, depth + 1)) AS t FROM nodes LEFT JOIN kids USING (node))),
sums AS (SELECT top AS node, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, 32 * (n.depth - 1)) LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node
"""

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
grams AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) s(k))),
f AS (SELECT lang, phrase, k AS size, count(*) AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY 1),
cand AS (SELECT lang, phrase, size, f, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM cand, range(1, 4) s(k) WHERE k < size),
scores AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, f, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cand, range(2, 4) s(k) WHERE k < size)),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inside i ON i.lang = f.lang AND i.phrase = f.phrase WHERE 100::HUGEINT * i.f >= 80::HUGEINT * f.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN total USING (lang) ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op1_quote_threads": THREADS, "op3_substring": SUBSTRING, "op5_int8_tiles": EMBEDDINGS, "op10_risk_rules": QUALITY, "op11_prefix_trie": PREFIXES, "op12_collocations": COLLOCATIONS}
