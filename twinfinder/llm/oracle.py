"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# Every two sets of word 5-grams that share one are counted and compared exactly; classes are closed step by step.
OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN NULL WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS grams
  FROM w
), s AS MATERIALIZED (
  SELECT grams, min(doc_id) AS id, count(*) AS members, len(grams) AS n FROM g WHERE grams IS NOT NULL GROUP BY grams
), t AS MATERIALIZED (SELECT id, n, unnest(grams) AS gram FROM s),
p AS (
  SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM t a JOIN t b ON a.gram = b.gram AND a.id <> b.id AND a.n * 4 <= b.n * 5 AND b.n * 4 <= a.n * 5 GROUP BY a.id, b.id
), l AS MATERIALIZED (SELECT a, b FROM p WHERE shared * 5 >= (na + nb - shared) * 4),
r AS (SELECT id, id AS other FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, min(other) AS class_id FROM r GROUP BY id),
k AS (SELECT a AS id, count(*) AS links FROM l GROUP BY a)
SELECT g.doc_id, coalesce(class_id, g.doc_id) AS class_id, coalesce(links, 0)::BIGINT AS links,
       coalesce(members - 1, 0)::BIGINT AS copies, coalesce(class_id, g.doc_id) = g.doc_id AS keep
FROM g LEFT JOIN s ON g.grams = s.grams LEFT JOIN c ON c.id = s.id LEFT JOIN k ON k.id = s.id
"""

OP4 = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), names AS (
  SELECT host,
    CASE WHEN numeric THEN '' WHEN kind THEN two ELSE labels[-1] END AS suffix,
    CASE WHEN numeric THEN name WHEN kind THEN array_to_string(labels[-3:], '.') ELSE two END AS dom
  FROM (
    SELECT *, regexp_matches(two, '^(ac|co|com|edu|go|gob|gov|ltd|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$') AS kind
    FROM (
      SELECT host, name, string_split(name, '.') AS labels, array_to_string(string_split(name, '.')[-2:], '.') AS two,
             regexp_matches(name, '^[0-9.]+$|^\[') AS numeric
      FROM (SELECT DISTINCT host, regexp_replace(host, '^.*@|:[0-9]*$|\.$', '', 'g') AS name FROM p)))
), o AS (
  SELECT host, (quality = 0)::INT AS bad
  FROM (SELECT host, try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) AS BIGINT) AS doc_id FROM p)
  JOIN labels USING (doc_id) WHERE quality IS NOT NULL
), h AS (
  SELECT host, count(*) AS n, sum(bad) AS bad, any_value(suffix) AS suffix, any_value(dom) AS dom
  FROM o JOIN names USING (host) GROUP BY host
), t AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM h, t GROUP BY suffix),
s1 AS (
  SELECT 1.0 / greatest(0.001, least(0.5, coalesce(
    sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS w FROM s0
),
s AS (SELECT suffix, (m * w + bad) / (w + n) AS m, w + n AS size FROM s0, s1),
d0 AS (SELECT dom, suffix, sum(n) AS n, sum(bad) AS bad, any_value(s.m) AS m FROM h JOIN s USING (suffix) GROUP BY dom, suffix),
d1 AS (
  SELECT 1.0 / greatest(0.001, least(0.5, coalesce(
    sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS w FROM d0
),
d AS (SELECT dom, (m * w + bad) / (w + n) AS m, w + n AS size FROM d0, d1),
h0 AS (SELECT host, n, bad, m FROM h JOIN d USING (dom)),
h1 AS (
  SELECT 1.0 / greatest(0.001, least(0.5, coalesce(
    sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0))) - 1 AS w FROM h0
),
b AS (SELECT host, (m * w + bad) / (w + n) AS m, w + n AS size FROM h0, h1),
-- A host without outcomes has the mean of its domain, else its suffix, else all pages, and the spread of all levels between.
k AS (
  SELECT 1 - 1 / (h1.w + 1) AS of_host, 1 - 1 / (d1.w + 1) AS of_domain, 1 - 1 / (s1.w + 1) AS of_suffix, t.m AS m
  FROM h1, d1, s1, t WHERE (SELECT count(*) FROM h) > 0
), unseen AS (
  SELECT host, coalesce(
    d.m - 1.645 * sqrt(d.m * (1 - d.m) * (1 - (1 - 1 / (d.size + 1)) * of_host)),
    s.m - 1.645 * sqrt(s.m * (1 - s.m) * (1 - (1 - 1 / (s.size + 1)) * of_host * of_domain)),
    k.m - 1.645 * sqrt(k.m * (1 - k.m) * (1 - of_host * of_domain * of_suffix))) AS bound
  FROM names JOIN k ON true LEFT JOIN d ON d.dom = names.dom LEFT JOIN s ON s.suffix = names.suffix WHERE host <> ''
), r AS (
  SELECT page_id, p.host, path,
    CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    coalesce(m - 1.645 * sqrt(m * (1 - m) / (size + 1)), unseen.bound) AS bound
  FROM p LEFT JOIN b ON p.host = b.host LEFT JOIN unseen ON p.host = unseen.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def _fill(parents: str, name: str, weight: str, source: str) -> str:
    """Children of `source` (with room and allot of the parent) with their own allot."""
    part = f"PARTITION BY {parents} " if parents else ""
    return f"""
  SELECT * EXCLUDE (allot, w, ratio, level, full_), least(room, CASE WHEN full_ THEN room WHEN w > 0 THEN
         floor(w * max(level) FILTER (NOT full_) OVER ({part}))::BIGINT ELSE 0 END)::BIGINT AS allot
  FROM (SELECT *, coalesce(room <= w * level, false) AS full_ FROM (
    SELECT *, CASE WHEN w > 0 THEN
             (allot - coalesce(sum(room) OVER ({part}ORDER BY ratio NULLS LAST, {name}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER ({part}ORDER BY ratio NULLS LAST, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           END AS level
    FROM (SELECT *, CASE WHEN w > 0 THEN room::DOUBLE / w END AS ratio FROM (
      SELECT *, CASE WHEN room > 0 THEN {weight} ELSE 0.0::DOUBLE END AS w FROM {source}))))"""


_DOMAIN = "CASE domain WHEN 'd0' THEN 1.0::DOUBLE WHEN 'd1' THEN 2.0 WHEN 'd2' THEN 3.0 ELSE 1.0 END"
_LANG = "CASE l WHEN 'en' THEN 2.0::DOUBLE WHEN 'de' THEN 1.0 WHEN 'fr' THEN 1.0 WHEN 'es' THEN 4.0 ELSE 1.0 END"

OP6 = f"""
WITH r AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 3) AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents
), leaf AS (SELECT domain, l, s, sum(n_tokens)::BIGINT AS supply, 3 * sum(n_tokens)::BIGINT AS room FROM r GROUP BY ALL),
b AS (
  SELECT least(floor(sum(supply)::BIGINT * 0.6::DOUBLE),
               coalesce(sum(room) FILTER (({_DOMAIN}) > 0 AND ({_LANG}) > 0), 0))::BIGINT AS budget FROM leaf
),
t0 AS (
  SELECT domain, coalesce(sum(room) FILTER (({_LANG}) > 0), 0)::BIGINT AS room, any_value(budget) AS allot FROM leaf, b GROUP BY domain
),
t1 AS ({_fill("", "domain", _DOMAIN, "t0")}),
u0 AS (SELECT domain, l, sum(leaf.room)::BIGINT AS room, any_value(allot) AS allot FROM leaf JOIN t1 USING (domain) GROUP BY ALL),
u1 AS ({_fill("domain", "l", _LANG, "u0")}),
v0 AS (SELECT domain, l, s, leaf.supply, leaf.room, allot FROM leaf JOIN u1 USING (domain, l)),
v1 AS ({_fill("domain, l", "s", "1.0::DOUBLE", "v0")}),
plan AS (
  SELECT domain, l, s, floor(allot / greatest(supply, 1))::INT AS whole,
         allot - floor(allot / greatest(supply, 1)) * greatest(supply, 1) AS rest FROM v1
), k AS (
  SELECT r.*, whole, rest, md5('7|' || whole || '|' || coalesce(doc_id::VARCHAR, '')) AS key FROM r JOIN plan USING (domain, l, s)
), c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY key) AS so_far FROM k),
d AS (SELECT *, whole + (rest > 0 AND so_far <= rest)::INT AS times FROM c)
SELECT doc_id, domain, lang, source, unnest(range(times))::INT AS epoch, n_tokens::BIGINT AS n_tokens FROM d WHERE times > 0
"""

_CONTROL = r"\[/?(?:SYS|INST)\]|</?s>|\[TURN [0-9A-F]*\]|\[/TURN\]"

OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), u AS (
  SELECT *, CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                 ELSE 14 + 2 * strlen(role) END + 3 + length(text)
            + len(regexp_extract_all(text, '{_CONTROL}')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

OP12 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(first_doc < doc_id, false)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(first_doc < doc_id, false)), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""

# The CRC of a feature, byte by byte over its hexadecimal form, with a table of 256 registers.
OP11 = r"""
WITH RECURSIVE z AS (
  SELECT b, b::BIGINT AS c, 0 AS i FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i + 1 FROM z WHERE i < 8
), crc AS (SELECT list(c ORDER BY b) AS tab FROM z WHERE i = 8),
w AS MATERIALIZED (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
), f AS MATERIALIZED (
  SELECT kind, id, unnest(list_concat(words, list_concat(
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))) AS feature
  FROM w
), d AS MATERIALIZED (
  SELECT feature, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(feature)) // 2),
      lambda i: ('0x' || substr(hex(feature), 2 * i::BIGINT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c & 255, b) + 1)::INT]))) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), crc
), n AS (SELECT kind, bucket, count(*) AS n FROM f JOIN d USING (feature) GROUP BY ALL),
g AS (
  SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN n s ON s.kind = 0 AND s.bucket = b LEFT JOIN n t ON t.kind = 1 AND t.bucket = b,
       (SELECT coalesce(sum(n) FILTER (kind = 0), 0)::DOUBLE AS ss, coalesce(sum(n) FILTER (kind = 1), 0)::DOUBLE AS tt FROM n)
), m AS (
  SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM f JOIN d USING (feature) JOIN g USING (bucket) WHERE kind = 0 GROUP BY id
), q AS (
  SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN m USING (id) WHERE kind = 0
), e AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM q WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM q LEFT JOIN e USING (doc_id)
"""



def _square(a: str, b: str) -> str:
    return " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, 9))


def _ball_codes() -> str:
    """Lloyd's rounds without any bounds: every part against all entries of its codebook."""
    nearest = f"""
  SELECT vec_id, label, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT *, {_square("x", "c")} AS d FROM parts JOIN {{book}} USING (part)) GROUP BY ALL"""
    steps = ["""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, p AS part, e[8 * p + 1 : 8 * p + 8] AS x FROM v, range(8) r(p)
), b0 AS MATERIALIZED (
  SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)
)"""]
    for turn in range(6):
        means = ", ".join(f"floor(sum(x[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 9))
        steps.append(f"""a{turn} AS MATERIALIZED ({nearest.format(book=f"b{turn}")}
), b{turn + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m, c) AS c
  FROM b{turn} LEFT JOIN (SELECT part, entry, [{means}] AS m FROM a{turn} GROUP BY part, entry) USING (part, entry)
)""")
    steps.append(f"""a6 AS MATERIALIZED ({nearest.format(book="b6")}
), r AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a6 GROUP BY vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b6) AS codebooks_sha256
FROM r""")
    return ", ".join(steps)


ORACLE: dict[str, str] = {
    "op1_exact_topk": OP1,
    "op2_ngram_join": OP2,
    "op4_url_filter": OP4,
    "op6_mixing": OP6,
    "op7_chat": OP7,
    "op11_importance": OP11,
    "op12_line_dedup": OP12,
    "op13_ball_codes": _ball_codes(),
}
