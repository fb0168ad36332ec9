"""DuckDB SQL that the text queries are checked against."""

STATEMENTS: dict[str, str] = {}

STATEMENTS["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, MIN(doc_id) AS keep_id, COUNT(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

STATEMENTS["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5)
           / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM d GROUP BY source),
w AS (
  SELECT *, CAST(CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
         CAST(source_size AS DOUBLE) * 2 AS most
  FROM s),
l AS (
  SELECT *, most / weight AS fills_at,
         (1.5::DOUBLE * SUM(source_size) OVER () - coalesce(SUM(most) OVER b, 0))
           / (SUM(weight) OVER () - coalesce(SUM(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT first(level ORDER BY fills_at, source NULLS LAST) AS level FROM l WHERE level < fills_at),
t AS (
  SELECT source, source_no, source_size, least(most, coalesce((SELECT level FROM o) * weight, most)) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / CAST(source_size AS DOUBLE) END AS rate FROM t),
n AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS p, target - floor(rate) * source_size AS need FROM r),
x AS (
  SELECT d.doc_id, d.size, n.source_no, n.source_size, n.target, n.whole, n.need,
         CASE WHEN n.p > 0 AND d.size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
f AS (
  SELECT *, coalesce(SUM(size) OVER (PARTITION BY source_no ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) <= need, false) AS taken1
  FROM x WHERE q IS NOT NULL),
g AS (
  SELECT *, need - coalesce(SUM(CASE WHEN taken1 THEN size END) OVER (PARTITION BY source_no), 0) AS gap FROM f),
h AS (
  SELECT doc_id FROM (
    SELECT doc_id, size, gap,
           SUM(size) OVER (PARTITION BY source_no ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM g WHERE NOT taken1 AND size <= gap) y
  WHERE upto - size * 0.5::DOUBLE <= gap),
e AS (SELECT doc_id FROM f WHERE taken1 UNION ALL SELECT doc_id FROM h)
SELECT x.doc_id, x.size, x.source_size, x.target,
       CAST(x.size * (x.whole + CASE WHEN e.doc_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM x LEFT JOIN e ON x.doc_id = e.doc_id
"""

# (kind, pattern in RE2's syntax, group, least characters of the group)
SECRET_KINDS = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]


def _secret_kind(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, {number} AS kind_no, '{kind}' AS kind, ends - length(m) AS start, ends AS "end"
  FROM (
    SELECT doc_id, m, regexp_extract(m, '{pattern}', {group}) AS part,
           SUM(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY place) AS ends
    FROM (
      SELECT doc_id, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS place
      FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps
        FROM d WHERE regexp_matches(t, '{pattern}')) x) y) z
  WHERE length(part) >= {least}"""


STATEMENTS["op6_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_secret_kind(n, *kind) for n, kind in enumerate(SECRET_KINDS))}),
j AS (
  SELECT doc_id, COUNT(*) FILTER (kind_no = 0) AS n_assign, COUNT(*) FILTER (kind_no = 1) AS n_access,
         COUNT(*) FILTER (kind_no = 2) AS n_hex,
         string_agg(CASE WHEN kind_no < 3 THEN kind || ':' || start || ':' || "end" END, ',' ORDER BY start, kind_no) AS base,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, kind_no) AS spans
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""

# Method of moments at one level; t has n and k of every member.
_STRENGTH = """(
  SELECT CASE WHEN COUNT(*) < 2 OR between_ <= 0 OR within <= 0 THEN 1000.0::DOUBLE
              ELSE least(1000.0::DOUBLE, greatest(1.0::DOUBLE, within / between_ - 1)) END
  FROM (
    SELECT *, (kk - (k / n) * k - (g - 1) * within) / (n - nn / n) AS between_
    FROM (
      SELECT *, (k / n) * (1 - k / n) AS within
      FROM (
        SELECT COUNT(*) AS g, CAST(SUM(n) AS DOUBLE) AS n, CAST(SUM(k) AS DOUBLE) AS k,
               SUM(CAST(k * k AS DOUBLE) / n) AS kk, CAST(SUM(n * n) AS DOUBLE) AS nn
        FROM {t} WHERE n > 0) a) b) c
  GROUP BY between_, within, g)"""

STATEMENTS["op5_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
h AS (
  SELECT host, COUNT(bad) AS n, CAST(coalesce(SUM(bad), 0) AS BIGINT) AS k
  FROM p LEFT JOIN (SELECT doc_id, CAST(toxic = 1 OR quality = 0 AS INT) AS bad FROM labels) l ON page_id = doc_id
  GROUP BY host),
hosts AS (
  SELECT *, regexp_extract(host, '([^.]*)$', 1) AS suffix, regexp_extract(host, '((?:[^.]*[.])?[^.]*)$', 1) AS domain FROM h),
domains AS (SELECT suffix, domain, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(k) AS BIGINT) AS k FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(k) AS BIGINT) AS k FROM domains GROUP BY suffix),
strengths AS (SELECT {suffixes} AS s1, {domains} AS s2, {hosts} AS s3),
overall AS (SELECT CAST(SUM(k) + 1 AS DOUBLE) / (SUM(n) + 10) AS m FROM suffixes),
m1 AS (SELECT suffix, (k + m * s1) / (n + s1) AS above FROM suffixes, overall, strengths),
m2 AS (SELECT domain, (k + above * s2) / (n + s2) AS above FROM domains JOIN m1 USING (suffix), strengths),
ab AS (
  SELECT host, above * s3 + k AS a, (1 - above) * s3 + n - k AS b FROM hosts JOIN m2 USING (domain), strengths),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound FROM ab),
f AS (
  SELECT *,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN lower_bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM f JOIN r USING (host)
"""
for _name in ("suffixes", "domains", "hosts"):
    STATEMENTS["op5_url_filter"] = STATEMENTS["op5_url_filter"].replace("{" + _name + "}", _STRENGTH.replace("{t}", _name))

# A document's shingles are looked for anywhere in it; a part of less than five words must stand in it whole.
STATEMENTS["op1_decontamination"] = r"""
WITH cut AS (
  SELECT item_id, text, regexp_extract(text, '(?s)^(.*[.?!])\s+[^.?!]*[.?!]?\s*$', 1) AS head FROM benchmark),
parts AS (
  SELECT item_id, 'q' AS part, CASE WHEN head = '' THEN text ELSE head END AS t FROM cut
  UNION ALL
  SELECT item_id, 'a', CASE WHEN head = '' THEN text ELSE substr(text, length(head) + 1) END FROM cut),
words AS (SELECT item_id, part, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM parts),
long_parts AS (
  SELECT DISTINCT item_id, part, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5) x),
sizes AS (SELECT item_id, part, COUNT(*) AS n FROM long_parts GROUP BY item_id, part),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5) x),
hits AS (
  SELECT doc_id, item_id, part, COUNT(*) * 1.0::DOUBLE / n AS share
  FROM doc_shingles JOIN long_parts USING (s) JOIN sizes USING (item_id, part)
  GROUP BY doc_id, item_id, part, n),
short_parts AS (SELECT item_id, part, ' ' || array_to_string(w, ' ') || ' ' AS s FROM words WHERE len(w) < 5),
candidates AS (SELECT DISTINCT doc_id, item_id FROM hits WHERE share >= 0.8),
short_hits AS (
  SELECT c.doc_id, c.item_id, s.part, 1.0::DOUBLE AS share
  FROM candidates c JOIN short_parts s USING (item_id) JOIN docs d USING (doc_id)
  WHERE contains(' ' || array_to_string(d.w, ' ') || ' ', s.s)),
every AS (SELECT * FROM hits WHERE share >= 0.8 UNION ALL SELECT * FROM short_hits)
SELECT q.doc_id, q.item_id, round(q.share, 6) AS question_overlap, round(a.share, 6) AS answer_overlap
FROM every q JOIN every a ON q.doc_id = a.doc_id AND q.item_id = a.item_id AND q.part = 'q' AND a.part = 'a'
"""

STATEMENTS["op13_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(range(8 * length(key)), lambda i:
               CAST(ascii(substr(key, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT) >> CAST(i % 8 AS BIGINT) & 1),
             lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS kind
  FROM keyed),
conv AS (SELECT conv_id, row_number() OVER () AS conv_no FROM (SELECT DISTINCT conv_id FROM conversations) x),
damaged AS (
  SELECT conv_no, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed JOIN conv ON hashed.conv_id IS NOT DISTINCT FROM conv.conv_id),
numbered AS (
  SELECT *, row_number() OVER w AS i, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair
  FROM damaged
  WINDOW w AS (PARTITION BY conv_no ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy)),
faults AS (
  SELECT conv_no, turn, i, role, text, pair,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_no, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM numbered),
ins(q, q2, letters, cost, turns) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
         (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'),
         (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 2, 'I', 5, chr(10) || 'user:')),
edits(q, q2, letter, initial, new_role, cost) AS (
  VALUES (0, 0, 'D', '', '', 2), (1, 1, 'D', '', '', 2), (2, 2, 'D', '', '', 2), (3, 3, 'D', '', '', 2),
         (0, 1, 'K', 's', '', 0), (0, 2, 'K', 'u', '', 0), (1, 2, 'K', 'u', '', 0), (3, 2, 'K', 'u', '', 0),
         (2, 3, 'K', 'a', '', 0),
         (0, 2, 'R', '', 'user', 1), (1, 2, 'R', '', 'user', 1), (3, 2, 'R', '', 'user', 1), (2, 3, 'R', '', 'assistant', 1)),
paths AS (
  SELECT conv_no, CAST(0 AS BIGINT) AS i, 0 AS q, {'cost': 0, 'audit': '', 'kept': ''} AS best FROM conv
  UNION ALL
  SELECT conv_no, i, q2, best FROM (
    SELECT p.conv_no, f.i, e.q2, min({
             'cost': p.best.cost + n.cost + e.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END,
             'audit': p.best.audit || n.letters || e.letter,
             'kept': p.best.kept || n.turns || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text
                     ELSE chr(10) || e.new_role || ':' || f.text END}) AS best
    FROM paths p JOIN faults f ON p.conv_no = f.conv_no AND p.i + 1 = f.i
    JOIN ins n ON p.q = n.q JOIN edits e ON n.q2 = e.q
    WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR substr(f.role, 1, 1) = e.initial)
    GROUP BY p.conv_no, f.i, e.q2) x),
counts AS (
  SELECT conv_no, COUNT(*) AS n, coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps,
         COUNT(*) FILTER (fault = 'blank') AS blank, COUNT(*) FILTER (fault = 'duplicate') AS duplicate,
         COUNT(*) FILTER (fault = 'truncated') AS truncated, COUNT(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_no),
ends AS (
  SELECT p.conv_no, min({'cost': p.best.cost + n.cost, 'audit': p.best.audit || n.letters, 'kept': p.best.kept || n.turns}) AS best
  FROM paths p JOIN ins n ON p.q = n.q AND n.q2 IN (0, 3)
  LEFT JOIN counts ON p.conv_no = counts.conv_no
  WHERE p.i = coalesce(counts.n, 0) GROUP BY p.conv_no)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost,
       best.audit AS audit, sha256(substr(best.kept, 2)) AS repaired_sha256
FROM conv JOIN ends ON conv.conv_no = ends.conv_no LEFT JOIN counts ON conv.conv_no = counts.conv_no
"""

STATEMENTS["op12_inner_products"] = r"""
WITH v AS (
  SELECT row_number() OVER () AS no, vec_id,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.no, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.no <> c.no WHERE q.vec_id % 100 = 0),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
