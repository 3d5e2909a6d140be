"""DuckDB SQL for the operators that SQL can state; the others are tested against plain versions.

The SQL compares windows by their text where the operators compare hashes.
"""

from __future__ import annotations

from kinloom.llm.quality_rules import BOILERPLATE, END_MARKS, MAX_LOST, NAVIGATION, SEPARATORS, SHORT

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]"


def _count(chars: str) -> str:
    return f"(length(x) - length(translate(x, '{chars}', '')))"


QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT rid, sum(least(3, coalesce(next - i, 3))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM twice) GROUP BY rid),
l AS (SELECT rid, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM m),
u AS (SELECT rid, i, x, lower(x) AS low, len(string_split_regex(trim(x, {_BLANKS}), '[ \t]+')) AS n FROM l),
v AS (SELECT *, n <= {SHORT} AND NOT regexp_matches(trim(x, {_BLANKS}), '{END_MARKS.replace("'", "''")}') AS bare FROM u),
t AS (SELECT *, bare AND (coalesce(lag(bare, 2) OVER q AND lag(bare) OVER q, false) OR coalesce(lag(bare) OVER q AND lead(bare) OVER q, false) OR coalesce(lead(bare) OVER q AND lead(bare, 2) OVER q, false)) AS entry FROM v WINDOW q AS (PARTITION BY rid ORDER BY i)),
good AS (SELECT rid, sum(length(array_to_string(regexp_extract_all(x, '{_WORD}+'), ''))) AS chars FROM t WHERE NOT (5 * {_count('#*$%&')} > 2 * n OR 5 * {_count('!')} > 2 * n OR 5 * {_count(SEPARATORS)} > n OR entry
  OR (n <= 12 AND regexp_matches(low, '{NAVIGATION}')) OR (n <= 30 AND regexp_matches(low, '{BOILERPLATE}'))) GROUP BY rid),
b AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM m),
f AS (SELECT b.*, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, coalesce(good.chars, 0) AS chars FROM b LEFT JOIN cover USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars - chars <= {MAX_LOST} * word_chars AS kept FROM f"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, upper(sha1(body)) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex),
bits AS (SELECT hex, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789ABCDEF', c)]), '') AS b FROM f),
digest AS (SELECT hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
  + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT) + CAST(substr(b, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (hex) JOIN digest USING (hex)"""

LINE_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, sha256(text) AS sha, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, sha, unnest(lines) AS raw, generate_subscripts(lines, 1) AS i FROM d),
s AS (SELECT rid, doc_id, sha, i, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM l),
w AS (SELECT rid, doc_id, sha, i, lead(i) OVER q AS i2, lead(i, 2) OVER q AS i3, x || chr(10) || lead(x) OVER q || chr(10) || lead(x, 2) OVER q AS g FROM s WHERE x <> '' WINDOW q AS (PARTITION BY rid ORDER BY i)),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, sha, rid, i) AS place FROM w WHERE g IS NOT NULL),
later AS (SELECT rid, i, i2, i3 FROM a WHERE place > 1),
gone AS (SELECT rid, i FROM later UNION SELECT rid, i2 FROM later UNION SELECT rid, i3 FROM later),
kept AS (SELECT rid, string_agg(raw, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = l.rid AND gone.i = l.i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, CASE WHEN sha IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

BALL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT rid, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM h),
i AS (SELECT row_number() OVER () AS qid, item_id, list_distinct({_TERMS}) AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT qid, item_id, unnest(w) AS t FROM i),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM h) GROUP BY rid, t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), g),
x AS (SELECT tf.rid, tf.t, (1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * h.n * g.docs) // g.terms)) AS x FROM tf JOIN h USING (rid), g),
s AS (SELECT q.qid, q.item_id, x.rid, CAST(sum(wt.w * x.x) AS BIGINT) AS score FROM q JOIN wt USING (t) JOIN x USING (t) GROUP BY ALL),
r AS (SELECT s.item_id, h.doc_id, s.score, row_number() OVER (PARTITION BY s.qid ORDER BY s.score DESC, h.doc_id) AS rank FROM s JOIN h USING (rid) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""

_PLAIN = f"translate(text, '{_UPPER}', '{_LOWER}')"
COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_PLAIN}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, pid, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM w),
u AS (SELECT lang, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM t WINDOW q AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM u UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM u WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM u WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS one, array_to_string(w[cut + 1:k], ' ') AS two FROM c, (VALUES (1), (2)) AS cuts (cut) WHERE cut < k),
y AS (SELECT x.lang, x.phrase, x.a, cut, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * x.a * x.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = x.one JOIN f AS r ON r.lang = x.lang AND r.phrase = x.two),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM y) WHERE place = 1),
m AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, z.a DESC, z.phrase) AS rank FROM z LEFT JOIN m ON m.lang = z.lang AND m.phrase = z.phrase WHERE most IS NULL OR 100 * most < 50 * z.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
