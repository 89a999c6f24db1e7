"""SQL counterparts of the registered queries, written independently of the operators."""

from __future__ import annotations

from textwrap import dedent

# The style sheet that HTML reports begin with.
STYLE = (
    ":root { color-scheme: light dark; font: 1rem/1.5 system-ui; }",
    ".group + .group { border-top: 2px dotted; }",
    ".file { display: grid; gap: 0.25rem; padding: 0.5rem 0; }",
    "img { height: 8rem; object-fit: contain; }",
    "code { overflow-wrap: anywhere; }",
)

HASH = "CASE WHEN strlen({t}) < 20 THEN lower(hex(encode({t}))) ELSE sha1({t}) END"
TEXT_HASH = (
    "CASE WHEN regexp_replace(lower({t}), '\\s+', '', 'g') <> '' "
    "THEN sha256(regexp_replace(lower({t}), '\\s+', '', 'g')) END"
)

IDX = f"""
idx AS (
  SELECT source AS repo, doc_id AS seq, {HASH.format(t='text')} AS hash,
         source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size,
         doc_id * 1000 AS last_modified, 'text/' || lang AS mime, {TEXT_HASH.format(t='text')} AS pdf_hash
  FROM documents
)"""

GROUPS = f"""{IDX},
groups AS (
  SELECT 'exact' AS kind, hash || ':' || size AS group_key, *,
         count(*) OVER (PARTITION BY hash, size) AS copies
  FROM idx QUALIFY copies > 1
)"""

RANKED = f"""{GROUPS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY group_key
         ORDER BY size DESC, last_modified, lower(path), path, repo) AS rank
  FROM groups
)"""

LOG = """
log AS (
  SELECT 'events' AS repo, event_id AS seq, event_type AS hash, user_id::VARCHAR AS path,
         floor(value)::BIGINT AS size, epoch_us(ts) // 1000 AS last_modified, event_type = 'error' AS missing
  FROM events
)"""

STATE = f"""{LOG},
state AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY seq DESC) = 1)"""

DOCS = f"""
docs AS (
  SELECT CASE WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'a' ELSE 'b' END AS repo,
         d.doc_id AS seq, {HASH.format(t='text')} AS hash,
         lang || '/' || (d.doc_id // 2) || '.txt' AS path, strlen(text)::BIGINT AS size,
         d.doc_id * 1000 AS last_modified, coalesce(toxic, 0) = 1 AS missing, 'text/' || lang AS mime,
         lang, quality, n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

TWO = f"""{DOCS},
a AS (SELECT * FROM docs WHERE repo = 'a'),
b AS (SELECT * FROM docs WHERE repo = 'b')"""

SCAN = f"""{DOCS},
listing AS (SELECT repo, path, size, last_modified, mime FROM docs WHERE coalesce(quality, 1) = 1),
state AS (
  SELECT repo, seq, hash, path, CASE WHEN lang = 'es' THEN n_chars ELSE size END AS size,
         last_modified - CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS last_modified, missing, mime
  FROM docs WHERE quality IS NOT NULL
),
changes AS (
  SELECT coalesce(l.repo, s.repo) AS repo, coalesce(l.path, s.path) AS path, l.size, l.mime,
         CASE WHEN l.path IS NULL THEN CASE WHEN NOT s.missing THEN 'deleted' END
              WHEN s.path IS NULL THEN 'added'
              WHEN l.size <> s.size OR l.last_modified > s.last_modified THEN 'changed'
              WHEN s.missing THEN 'reappeared' ELSE 'unchanged' END AS status,
         s.hash AS old_hash, s.last_modified AS old_modified
  FROM listing l FULL JOIN state s ON l.repo = s.repo AND l.path = s.path
)"""


def _word(test: str) -> str:
    bits = f"list_transform(range(64), lambda i: CASE WHEN {test} THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END)"
    return f"list_sum({bits})::UBIGINT"


def _hex16(word: str) -> str:
    return f"lpad(lower(to_hex({word})), 16, '0')"


EMB = f"""
emb AS (
  SELECT vec_id AS seq, label, {_word('embedding[i+1]::DOUBLE > 0')} AS w0,
         {_word('embedding[i+1]::DOUBLE > 0.05')} AS w1, {_word('embedding[i+1]::DOUBLE > -0.05')} AS w2
  FROM embeddings
)"""


def _hamming_pairs(words: list[str], bits: int, threshold: int) -> str:
    """All pairs of distinct fingerprints, tested one by one."""
    distance = " + ".join(f"bit_count(xor(a.{w}, b.{w}))::INTEGER" for w in words)
    shown = {side: " || ".join(_hex16(f"{side}.{w}") for w in words) for side in "ab"}
    return f"""
    WITH {EMB},
    nodes AS (SELECT {", ".join(words)}, min(seq) AS seq, count(*) AS copies FROM emb GROUP BY {", ".join(words)})
    SELECT {shown["a"]} AS earlier, {shown["b"]} AS later, ({distance})::INTEGER AS distance,
           a.copies AS earlier_copies, b.copies AS later_copies
    FROM nodes a JOIN nodes b ON a.seq < b.seq
    WHERE (1.0::DOUBLE - ({distance}) / {bits}.0::DOUBLE) * 100.0 >= {threshold}"""


def _hamming_clusters(words: list[str], bits: int, threshold: int, kind: str) -> str:
    """Greedy leaders in row order: the recursion carries the list of leaders."""
    distance = " + ".join(f"bit_count(xor(l.{w}, n.{w}))::INTEGER" for w in words)
    fields = ", ".join(f"{w}: n.{w}" for w in words)
    shown = " || ".join(_hex16(f"leader.{w}") for w in words)
    return f"""{EMB},
nodes AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM emb),
walk AS (
  SELECT rn, seq, {{seq: n.seq, {fields}}} AS leader, [{{seq: n.seq, {fields}}}] AS leaders FROM nodes n WHERE rn = 1
  UNION ALL
  SELECT rn, seq, coalesce(hit, me), CASE WHEN hit IS NULL THEN list_append(leaders, me) ELSE leaders END
  FROM (
    SELECT n.rn, n.seq, {{seq: n.seq, {fields}}} AS me, w.leaders,
           list_filter(w.leaders, lambda l: (1.0::DOUBLE - ({distance}) / {bits}.0::DOUBLE) * 100.0 >= {threshold})[1] AS hit
    FROM walk w JOIN nodes n ON n.rn = w.rn + 1
  )
),
clusters AS (
  SELECT '{kind}' AS kind, {shown} AS group_key, count(*) OVER (PARTITION BY leader.seq) AS copies, seq
  FROM walk QUALIFY copies > 1
)"""


TOLERANCE = """
src AS (
  SELECT event_type || '/' || user_id AS key, value AS v, event_id AS seq,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM events
),
walk AS (
  SELECT key, rn, seq, seq AS leader, [{v: v, seq: seq}] AS leaders FROM src WHERE rn = 1
  UNION ALL
  SELECT key, rn, seq, coalesce(hit.seq, seq),
         CASE WHEN hit IS NULL THEN list_append(leaders, {v: v, seq: seq}) ELSE leaders END
  FROM (
    SELECT s.key, s.rn, s.seq, s.v, w.leaders, list_filter(w.leaders, lambda l: abs(l.v - s.v) <= 2.0)[1] AS hit
    FROM walk w JOIN src s ON s.key = w.key AND s.rn = w.rn + 1
  )
),
clusters AS (
  SELECT 'audio' AS kind, key || '@{"seq":' || leader || '}' AS group_key,
         count(*) OVER (PARTITION BY leader) AS copies, seq
  FROM walk QUALIFY copies > 1
)"""


def _size_text(n: str) -> str:
    """Bytes with a unit, from integers only: tenths are rounded half up."""
    cases = []
    for z, unit in enumerate("KMGTPE", 1):
        one = 1024**z
        tenths = f"(({n}::HUGEINT * 20 + {one}) // {2 * one})"
        below = f"WHEN {n} < {one * 1024} " if z < 6 else "ELSE "
        text = f"({tenths} // 10) || '.' || ({tenths} % 10) || ' {unit}B'"
        cases.append(f"{below}THEN {text}" if z < 6 else f"{below}{text}")
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' {' '.join(cases)} END"


def _date_text(ms: str) -> str:
    return f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S')"


def _views() -> list[list[int]]:
    """The eight orientations as cell numbers, from the coordinates of their corners."""
    cell = lambda x, y: 9 * y + x
    maps = [
        lambda x, y: cell(x, y), lambda x, y: cell(8 - x, y), lambda x, y: cell(x, 8 - y),
        lambda x, y: cell(8 - x, 8 - y), lambda x, y: cell(y, x), lambda x, y: cell(8 - y, x),
        lambda x, y: cell(y, 8 - x), lambda x, y: cell(8 - y, 8 - x),
    ]
    return [[m(x, y) for y in range(9) for x in range(9)] for m in maps]


GRID = """
grids AS (
  SELECT vec_id, list_transform(range(81), lambda i:
         (floor(abs(embedding[(i % 64) + 1]::DOUBLE) * 1000) % 256)::INTEGER) AS grid
  FROM embeddings
)"""
_VIEWS_SQL = ", ".join(f"list_transform({v}, lambda i: grid[i + 1])" for v in _views())
CANONICAL = f"{GRID},\ncanonical AS (SELECT vec_id, grid, list_max([{_VIEWS_SQL}]) AS best FROM grids)"


def _dhash(grid: str) -> str:
    left, right = f"{grid}[(i // 8) * 9 + i % 8 + 1]", f"{grid}[(i // 8) * 9 + i % 8 + 2]"
    return _hex16(_word(f"{left} > {right}"))


def _eta(key: str, n: int) -> str:
    return f"""
    WITH {LOG},
    w AS (
      SELECT {key}, seq, last_modified AS ts,
             row_number() OVER k AS done, count(*) OVER (PARTITION BY {key}) AS total,
             last_modified - first_value(last_modified) OVER (k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS span,
             last_modified - min(last_modified) OVER (PARTITION BY {key}) AS elapsed
      FROM log WINDOW k AS (PARTITION BY {key} ORDER BY last_modified, seq)
    ),
    e AS (
      SELECT *, least(done, {n}) - 1 AS recent_count, elapsed * (total - done) // done AS overall,
             CASE WHEN done > 1 THEN span * (total - done) // (least(done, {n}) - 1) END AS recent
      FROM w
    ),
    b AS (
      SELECT *, floor(recent * (recent_count / 1000.0::DOUBLE)
                      + overall * (1.0::DOUBLE - recent_count / 1000.0::DOUBLE))::BIGINT AS blend
      FROM e
    )
    SELECT {key}, seq, done, total, recent_count, span, elapsed,
           CASE WHEN elapsed > 5000 THEN
             CASE WHEN recent IS NULL THEN overall ELSE greatest(blend, recent) END END AS remaining_millis
    FROM b"""


_AXIS = "greatest(0::DOUBLE, least(({n} + 0.5::DOUBLE) * 8::DOUBLE / 9::DOUBLE - 0.5::DOUBLE, 7::DOUBLE))"
_HTML_TOP = "\n".join([
    "<!DOCTYPE html>", "<html>", "<head>", "<title>Duplicate/Similar Files Report</title>", "<style>", *STYLE, "</style>",
    "</head>", "<body>", "<h1>Duplicate/Similar Files Report</h1>", "<p>Type: Similarity (Threshold: 70%)</p>",
])
_PLAIN = "SELECT repo, path, size, mime FROM idx"
_SYNC = f"""
    WITH {TWO},
    held AS (SELECT DISTINCT hash, size FROM b WHERE NOT missing),
    rows_a AS (
      SELECT a.*, EXISTS (SELECT 1 FROM held h WHERE h.hash = a.hash AND h.size = a.size) AS is_held,
             EXISTS (SELECT 1 FROM b WHERE b.path = a.path AND NOT b.missing) AS taken
      FROM a WHERE NOT a.missing
    ),
    turns AS (SELECT *, min(CASE WHEN NOT taken THEN path END) OVER (PARTITION BY hash, size) AS first_free FROM rows_a),
    plan AS (
      SELECT CASE WHEN is_held THEN 'equal' WHEN first_free IS NULL OR path < first_free THEN 'skip'
                  WHEN path = first_free THEN 'copy' ELSE 'equal' END AS action,
             repo, path, path AS target,
             CASE WHEN is_held THEN 'in target' WHEN first_free IS NULL OR path < first_free THEN 'target exists'
                  WHEN path = first_free THEN 'not in target' ELSE 'copied before' END AS reason, hash, size
      FROM turns
    ),
    gone AS (
      SELECT 'delete' AS action, repo, path, hash, size FROM b
      WHERE NOT missing
        AND EXISTS (SELECT 1 FROM a WHERE a.missing AND a.hash = b.hash AND a.size = b.size)
        AND NOT EXISTS (SELECT 1 FROM a WHERE NOT a.missing AND a.hash = b.hash AND a.size = b.size)
    )"""

_FALLBACK = f"""
    WITH {IDX},
    keyed AS (
      SELECT 'exact' AS kind, hash || ':' || size AS group_key, * FROM idx
      UNION ALL
      SELECT 'fallback', 'fallback:' || pdf_hash || ':' || size, * FROM idx WHERE pdf_hash IS NOT NULL
    ),
    groups AS (SELECT *, count(*) OVER (PARTITION BY kind, group_key) AS copies FROM keyed QUALIFY copies > 1),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY kind, group_key
             ORDER BY size DESC, last_modified, lower(path), path, repo) AS rank FROM groups
    )"""

_LINES = f"""
    lines AS (
      SELECT l_returnflag AS repo, l_orderkey || '/' || l_linenumber AS path,
             l_partkey || '|' || l_suppkey AS content, epoch_ms(l_shipdate) AS last_modified,
             (l_quantity * 100)::INTEGER AS width, (l_linenumber * 100)::INTEGER AS height
      FROM lineitem
    ),
    hashed AS (SELECT *, {HASH.format(t='content')} AS hash, strlen(content) AS size FROM lines)"""

_STATS = """
    SELECT repo, counter, value::BIGINT AS value FROM (
      UNPIVOT (
        SELECT repo, sum(n)::BIGINT AS "Lines", sum(n - paths)::BIGINT AS "Changes", sum(alive)::BIGINT AS files,
               sum(paths - alive)::BIGINT AS missing, sum(greatest(alive - 1, 0))::BIGINT AS duplicates
        FROM (
          SELECT repo, size % 10 AS bucket, hash, sum(n) AS n, count(*) AS paths,
                 count(*) FILTER (WHERE NOT missing) AS alive
          FROM counted GROUP BY ALL
        ) GROUP BY repo
      ) ON "Lines", "Changes", files, missing, duplicates INTO NAME counter VALUE value
    )"""
_COUNTED = """
    counted AS (
      SELECT *, count(*) OVER (PARTITION BY repo, path) AS n FROM {log}
      QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY seq DESC) = 1
    )"""
_EVENT_STATS = f"WITH {LOG}, {_COUNTED.format(log='log')} {_STATS}"
_DOC_STATS = f"WITH {IDX}, flagged AS (SELECT *, FALSE AS missing FROM idx), {_COUNTED.format(log='flagged')} {_STATS}"

ORACLE: dict[str, str] = {
    "exact_groups": f"WITH {GROUPS} SELECT kind, group_key, copies, repo, path, size, hash FROM groups",
    "exact_ranked": f"WITH {RANKED} SELECT kind, group_key, copies, repo, path, size, hash, rank FROM ranked",
    "lines_ranked": f"""
    WITH {_LINES}
    SELECT hash || ':' || size AS group_key, count(*) OVER (PARTITION BY hash, size) AS copies, repo, path,
           row_number() OVER (PARTITION BY hash, size ORDER BY width::BIGINT * height DESC, last_modified,
                              lower(path), path, repo) AS rank,
           width || 'x' || height AS image
    FROM hashed QUALIFY copies > 1""",
    "hot_groups_ranked": f"""
    WITH o AS (
      SELECT o_orderstatus AS repo, o_custkey || '/' || o_orderkey AS path,
             {HASH.format(t='o_orderpriority')} || ':' || strlen(o_orderpriority) AS group_key,
             epoch_ms(o_orderdate) AS last_modified FROM orders
    )
    SELECT group_key, count(*) OVER (PARTITION BY group_key) AS copies, repo, path,
           row_number() OVER (PARTITION BY group_key ORDER BY last_modified, lower(path), path, repo) AS rank
    FROM o QUALIFY copies > 1""",
    "dimension_filter": f"""
    WITH {_LINES}
    SELECT hash || ':' || size AS group_key, count(*) OVER (PARTITION BY hash, size) AS copies, repo, path
    FROM hashed WHERE width >= 2500 AND height < 400 QUALIFY copies > 1""",
    "fallback_groups": f"{_FALLBACK} SELECT kind, group_key, copies, repo, path, size, hash FROM groups",
    "fallback_removal": f"""{_FALLBACK}
    SELECT CASE WHEN min(rank) = 1 THEN 'keep' ELSE 'remove' END AS action, repo, path, 1::BIGINT AS times
    FROM ranked GROUP BY repo, path""",
    "removal_plan": f"""
    WITH {RANKED}
    SELECT CASE WHEN rank = 1 THEN 'keep' ELSE 'remove' END AS action, repo, path,
           CASE WHEN rank = 1 THEN 'first' ELSE group_key END AS reason FROM ranked""",
    "move_plan": f"""
    WITH {IDX},
    named AS (SELECT * REPLACE (seq || '/' || repo || '.txt' AS path) FROM idx),
    ranked AS (
      SELECT *, hash || ':' || size AS group_key, count(*) OVER (PARTITION BY hash, size) AS copies,
             row_number() OVER (PARTITION BY hash, size ORDER BY last_modified, lower(path), path, repo) AS rank
      FROM named QUALIFY copies > 1
    ),
    others AS (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY group_key, rank) AS turn FROM ranked WHERE rank > 1
    )
    SELECT CASE WHEN turn = 1 THEN 'move' ELSE 'skip' END AS action, repo, path,
           '/archive/' || repo || '.txt' AS target,
           CASE WHEN turn = 1 THEN group_key ELSE 'target exists' END AS reason FROM others""",
    "keep_plan": f"""
    WITH {RANKED} SELECT 'remove' AS action, repo, path, 'not kept' AS reason FROM ranked WHERE rank > 2""",
    "removal_log": f"""
    WITH {RANKED}
    SELECT i.repo, i.path, coalesce(r.rank > 1, FALSE) AS missing,
           CASE WHEN r.rank > 1 THEN (SELECT max(seq) + 1 FROM idx) ELSE i.seq END AS seq
    FROM idx i LEFT JOIN ranked r ON i.repo = r.repo AND i.path = r.path""",
    "group_numbers": f"""
    WITH {GROUPS}
    SELECT dense_rank() OVER (ORDER BY group_key) AS group_no, group_key, repo, path FROM groups""",
    "groups_table": f"""
    WITH {RANKED}
    SELECT kind, group_key, copies, rank, repo, path, {_size_text('size')} AS size_text,
           {_date_text('last_modified')} AS modified, hash, size FROM ranked""",
    "latest_state": f"WITH {STATE} SELECT path, seq, hash, size, missing FROM state",
    "live_state": f"WITH {STATE} SELECT path, seq, hash, size FROM state WHERE NOT missing",
    "index_stats": _EVENT_STATS,
    "index_stats_documents": _DOC_STATS,
    "merge_stats": f"""
    SELECT counter, sum(value)::BIGINT AS value FROM (({_EVENT_STATS}) UNION ALL ({_DOC_STATS})) GROUP BY counter""",
    "prune_drop": f"WITH {STATE} SELECT path, seq, hash, size % 7 AS bucket FROM state WHERE NOT missing",
    "prune_keep": f"WITH {STATE} SELECT path, seq, hash, missing, size % 10 AS bucket FROM state",
    "lookup_path": f"""
    WITH {LOG} SELECT path, seq, hash, last_modified FROM log WHERE path = '8'
    ORDER BY last_modified DESC, seq DESC LIMIT 1""",
    "lookup_hash": f"WITH {STATE} SELECT path, seq, missing FROM state WHERE hash = 'error'",
    "lookup_hash_size": f"WITH {STATE} SELECT path, seq, missing FROM state WHERE hash = 'click' AND size = 12",
    "lookup_contents": f"""
    WITH {TWO} SELECT repo, path, hash, missing FROM a
    WHERE EXISTS (SELECT 1 FROM b WHERE b.hash = a.hash AND b.size = a.size)""",
    "json_log": f"WITH {IDX} SELECT path, hash, size, last_modified, mime, FALSE AS missing FROM idx",
    "quarantine": f"""
    WITH {IDX}
    SELECT hash, size, count(*) AS n, min(path) AS path FROM idx WHERE mime <> 'text/fr' GROUP BY hash, size
    UNION ALL SELECT 'bad', 0, count(*), '' FROM idx WHERE mime = 'text/fr'""",
    "parquet_log": f"WITH {STATE} SELECT path, seq, hash, size % 7 AS bucket FROM state WHERE NOT missing",
    "catalog": f"""
    WITH {DOCS}
    SELECT CASE repo WHEN 'a' THEN 'first' ELSE 'third' END AS repo, path, hash, size, missing FROM docs
    WHERE repo = 'b' OR NOT missing""",
    "catalog_changes": f"""
    WITH {TWO},
    about AS (
      SELECT * FROM (VALUES ('first', '/data/first', 'parquet', FALSE), ('copy', '/archive/copy', 'json', TRUE))
      AS t(repo, base, codec, compressed)
    )
    SELECT about.repo, path, hash, size, missing, base, codec, compressed FROM a CROSS JOIN about""",
    "fallback_hash": """
    WITH r AS (SELECT doc_id, repeat(text, 100) AS content FROM documents)
    SELECT doc_id, CASE WHEN strlen(content) > 1048576
                        THEN 'fallback:' || sha256(encode(content)[1048577:1150976]) END AS fallback_hash
    FROM r""",
    "update_repo": f"""
    WITH d AS (
      SELECT lang || '/' || doc_id AS path, lang, text, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS now FROM documents
    )
    SELECT path, {HASH.format(t='now')} AS hash, strlen(now)::BIGINT AS size, lang = 'es' AS missing
    FROM d WHERE lang IN ('fr', 'es')""",
    "scan_format": """
    WITH d AS (SELECT source || '/' || lang || '/' || doc_id AS path, strlen(text)::BIGINT AS size, source, lang FROM documents)
    SELECT 'file' AS kind, path, size FROM d
    UNION ALL SELECT 'again', path, size FROM d WHERE source = 'src1'
    UNION ALL SELECT DISTINCT 'dir', source, NULL::BIGINT FROM d
    UNION ALL SELECT DISTINCT 'dir', source || '/' || lang, NULL::BIGINT FROM d""",
    "log_format": f"""
    WITH {LOG} SELECT path, hash, size, last_modified, missing, NULL::VARCHAR AS corrupt FROM log""",
    "verified_removal": f"""
    WITH d AS (SELECT lang || '/' || doc_id AS path, doc_id, {HASH.format(t='text')} AS hash, strlen(text) AS size, lang FROM documents),
    g AS (
      SELECT *, first_value(path) OVER w AS keep_path, row_number() OVER w AS rank, count(*) OVER (PARTITION BY hash, size) AS copies
      FROM d WINDOW w AS (PARTITION BY hash, size ORDER BY doc_id, lower(path), path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
    SELECT run::INTEGER AS run, path,
           CASE WHEN left(keep_path, 2) IN ('fr', 'es') THEN 'skipped' WHEN run = 1 THEN 'done' ELSE 'gone' END AS status,
           CASE left(keep_path, 2) WHEN 'fr' THEN 'the copy to keep has another content' WHEN 'es' THEN 'the copy to keep is missing'
                ELSE CASE WHEN run = 1 THEN '' ELSE 'already removed' END END AS message,
           keep_path
    FROM g, (VALUES (1), (2)) t(run) WHERE rank > 1 AND copies > 1""",
    "incremental_groups": f"""
    WITH {STATE}
    SELECT hash, size, count(*) AS copies FROM state WHERE NOT missing GROUP BY hash, size HAVING count(*) > 1""",
    "repaired_log": f"""
    WITH {LOG},
    lines AS (
      SELECT *, '{{"h":"' || hash || '","p":"' || path || '","s":' || size || ',"l":' || last_modified || ',"d":' || missing || '}}' AS line
      FROM log
    )
    SELECT 'good' AS kind, path, hash, size, last_modified, missing, NULL::VARCHAR AS text FROM lines WHERE seq % 7 <> 0
    UNION ALL
    SELECT 'bad', NULL, NULL, NULL, NULL, NULL, left(line, length(line) // 2) FROM lines WHERE seq % 7 = 0""",
    "stored_groups": f"""
    WITH {DOCS}
    SELECT 'exact' AS kind, hash || ':' || size AS group_key, count(*) OVER (PARTITION BY hash, size) AS copies, repo, path
    FROM docs WHERE NOT missing QUALIFY copies > 1""",
    "valid_names": r"""
    SELECT doc_id, regexp_full_match(source, '[\p{L}\p{Nd}_]+') AS source_valid,
           regexp_full_match(split_part(text, ' ', 1), '[\p{L}\p{Nd}_]+') AS word_valid
    FROM documents""",
    "first_seen_stream": f"WITH {LOG} SELECT DISTINCT hash, size FROM log",
    "filter_mime": f"WITH {IDX} {_PLAIN} WHERE contains(mime, '/fr')",
    "filter_name": f"WITH {IDX} {_PLAIN} WHERE contains(path, 'src1/')",
    "filter_size": f"WITH {IDX} {_PLAIN} WHERE size >= 2000",
    "filter_size_equal": f"WITH {IDX} {_PLAIN} WHERE size = 613",
    "filter_unknown": f"WITH {IDX} {_PLAIN} WHERE FALSE",
    "filter_none": f"WITH {IDX} {_PLAIN}",
    "files_ls": f"""
    WITH {IDX} SELECT repo || '/' || 'de' AS parent, seq || '.txt' AS name, size, {_date_text('last_modified')} AS modified
    FROM idx WHERE contains(path, '/de/')""",
    "mime_types": f"WITH {IDX} SELECT DISTINCT mime FROM idx",
    "files_rm": f"WITH {IDX} SELECT 'delete' AS action, repo, path, 'selected' AS reason FROM idx WHERE size < 500",
    "files_cp": f"""
    WITH {IDX} SELECT 'copy' AS action, repo, path, '/backup/' || replace(path, '.txt', '.bak') AS target,
           'selected' AS reason FROM idx WHERE contains(mime, 'text/fr')""",
    "files_mv": f"""
    WITH {IDX},
    t AS (SELECT seq::VARCHAR AS repo, mime || '/x.' || repo AS path, '/moved/' || mime || '/x.txt' AS target FROM idx),
    n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY repo, path) AS turn FROM t)
    SELECT CASE WHEN turn = 1 THEN 'move' ELSE 'conflict' END AS action, repo, path, target,
           CASE WHEN turn = 1 THEN 'selected' ELSE 'target used before' END AS reason FROM n""",
    "changes": f"WITH {SCAN} SELECT repo, path, status, old_hash FROM changes WHERE status IS NOT NULL",
    "to_read": f"WITH {SCAN} SELECT repo, path, size FROM changes WHERE status IN ('added', 'changed')",
    "reappeared": f"""
    WITH {SCAN} SELECT repo, path, old_hash AS hash, old_modified AS last_modified, FALSE AS missing
    FROM changes WHERE status = 'reappeared'""",
    "tombstones": f"""
    WITH {SCAN} SELECT repo, path, old_hash AS hash, TRUE AS missing FROM changes WHERE status = 'deleted'""",
    "tombstones_failed_dir": f"""
    WITH {SCAN} SELECT repo, path, old_hash AS hash, TRUE AS missing FROM changes
    WHERE status = 'deleted' AND NOT starts_with(path, 'fr/') AND NOT starts_with(path, 'de/')""",
    "update_stats": f"""
    WITH {SCAN},
    c AS (SELECT CASE WHEN status IN ('changed', 'reappeared') THEN 'added' ELSE status END AS counter, mime
          FROM changes WHERE status IS NOT NULL)
    SELECT counter, count(*) AS value FROM c GROUP BY counter
    UNION ALL SELECT mime, count(*) FROM c WHERE counter = 'added' GROUP BY mime""",
    "enrich": f"""
    SELECT doc_id::VARCHAR AS path, {HASH.format(t='text')} AS hash,
           CASE WHEN lang = 'es' THEN sha1(source) END AS fingerprint,
           CASE WHEN lang = 'fr' THEN md5(source) END AS video_hash,
           CASE WHEN lang = 'en' THEN {TEXT_HASH.format(t='text')} END AS pdf_hash,
           CASE WHEN lang = 'de' AND strlen(text) > 10
                THEN sha256(unhex(substr(hex(encode(text)), 21, 204800))) END AS audio_hash,
           FALSE AS missing
    FROM documents""",
    "mime_histogram": "SELECT 'text/' || lang AS mime, count(*) AS value FROM documents GROUP BY lang",
    "needs_fingerprint": "SELECT vec_id::VARCHAR AS path, 'image/l0' AS mime FROM embeddings WHERE label = 0",
    "diff_status": f"""
    WITH {TWO},
    c AS (SELECT hash, size, bool_or(NOT missing) AS any_live, min(path) FILTER (WHERE NOT missing) AS match
          FROM b GROUP BY hash, size)
    SELECT a.repo, a.path, a.hash, a.size,
           CASE WHEN any_live IS NULL THEN 'new' WHEN any_live THEN 'equal' ELSE 'deleted_in_target' END AS status, match
    FROM a LEFT JOIN c ON a.hash = c.hash AND a.size = c.size WHERE NOT a.missing""",
    "diff_copy": f"""
    WITH {TWO}
    SELECT 'copy' AS action, repo, path, '/new/' || path AS target, 'not in target' AS reason FROM a
    WHERE NOT missing AND NOT EXISTS (SELECT 1 FROM b WHERE b.hash = a.hash AND b.size = a.size)""",
    "diff_move": f"""
    WITH {TWO},
    m AS (SELECT a.*, NOT missing AND contains(mime, '/en')
                 AND NOT EXISTS (SELECT 1 FROM b WHERE b.hash = a.hash AND b.size = a.size) AS moved FROM a)
    SELECT repo, path, missing OR moved AS missing,
           CASE WHEN moved THEN (SELECT max(seq) + 1 FROM a) ELSE seq END AS seq FROM m""",
    "diff_delete": f"""
    WITH {TWO}
    SELECT 'delete' AS action, repo, path FROM a WHERE NOT missing
      AND EXISTS (SELECT 1 FROM b WHERE NOT b.missing AND b.hash = a.hash AND b.size = a.size)""",
    "sync_plan": f"{_SYNC} SELECT action, repo, path, target, reason, hash, size FROM plan",
    "sync_mirror": f"""{_SYNC}
    SELECT action, repo, path, hash, size FROM plan UNION ALL SELECT action, repo, path, hash, size FROM gone""",
    "sync_counters": f"""{_SYNC},
    everything AS (SELECT action FROM plan UNION ALL SELECT action FROM gone)
    SELECT count(*) FILTER (WHERE action = 'equal') AS equal,
           count(*) FILTER (WHERE action IN ('copy', 'skip')) AS new,
           count(*) FILTER (WHERE action = 'delete') AS deleted,
           count(*) FILTER (WHERE action = 'copy') AS copied,
           count(*) FILTER (WHERE action = 'delete') AS removed,
           count(*) FILTER (WHERE action = 'skip') AS skipped, 0::BIGINT AS errors FROM everything""",
    "sync_log": f"""{_SYNC},
    added AS (SELECT 'b' AS repo, path, hash, size, FALSE AS missing FROM plan WHERE action = 'copy')
    SELECT * FROM added
    UNION ALL
    SELECT b.repo, b.path, b.hash, b.size,
           b.missing OR EXISTS (SELECT 1 FROM gone g WHERE g.path = b.path) FROM b
    WHERE NOT EXISTS (SELECT 1 FROM added d WHERE d.path = b.path)""",
    "text_hash_groups": f"""
    WITH {IDX}
    SELECT 'text' AS kind, pdf_hash AS group_key, count(*) OVER (PARTITION BY pdf_hash) AS copies, repo, path
    FROM idx WHERE pdf_hash IS NOT NULL QUALIFY copies > 1""",
    "content_hash": f"""
    SELECT doc_id, {HASH.format(t='text')} AS content_hash, {TEXT_HASH.format(t='text')} AS text_hash,
           CASE WHEN strlen(text) > 10 THEN sha256(unhex(substr(hex(encode(text)), 21, 204800))) END AS audio_hash,
           CASE WHEN strlen(text) > 1048576
                THEN 'fallback:' || sha256(unhex(substr(hex(encode(text)), 2097153, 204800))) END AS fallback_hash,
           sha1(lower(hex(encode(text)))) AS hex_sha1
    FROM documents""",
    "hamming_pairs": _hamming_pairs(["w0"], 64, 70),
    "hamming_pairs_90": _hamming_pairs(["w0"], 64, 90),
    "hamming_pairs_80": _hamming_pairs(["w0"], 64, 80),
    "video_pairs_85": _hamming_pairs(["w0", "w1", "w2"], 192, 85),
    "hamming_clusters": f"WITH RECURSIVE {_hamming_clusters(['w0'], 64, 70, 'image')} SELECT * FROM clusters",
    "hamming_clusters_crowded": f"WITH RECURSIVE {_hamming_clusters(['w0'], 64, 70, 'image')} SELECT * FROM clusters",
    "temporal_clusters": f"""
    WITH RECURSIVE {_hamming_clusters(['w0', 'w1', 'w2'], 192, 70, 'video')} SELECT * FROM clusters""",
    "tolerance_clusters": f"WITH RECURSIVE {TOLERANCE} SELECT * FROM clusters",
    "find_similar": f"""
    SELECT kind, group_key, copies, 'embeddings' AS repo, seq::VARCHAR AS path, seq FROM (
      WITH RECURSIVE {_hamming_clusters(['w0'], 64, 75, 'image')} SELECT * FROM clusters)
    UNION ALL
    SELECT kind, group_key, copies, 'embeddings', seq::VARCHAR, seq FROM (
      WITH RECURSIVE {_hamming_clusters(['w0', 'w1', 'w2'], 192, 75, 'video')} SELECT * FROM clusters)
    UNION ALL
    SELECT * FROM (
      WITH {IDX} SELECT 'text', pdf_hash, count(*) OVER (PARTITION BY pdf_hash) AS copies, repo, path, seq
      FROM idx WHERE pdf_hash IS NOT NULL QUALIFY copies > 1)
    UNION ALL
    SELECT c.kind, c.group_key, c.copies, 'events', e.user_id::VARCHAR, c.seq FROM (
      WITH RECURSIVE {TOLERANCE} SELECT * FROM clusters) c JOIN events e ON e.event_id = c.seq""",
    "canonical_grid": f"WITH {CANONICAL} SELECT vec_id, array_to_string(best, ',') AS canonical FROM canonical",
    "dhash": f"""
    WITH {CANONICAL} SELECT vec_id, {_dhash('grid')} AS raw, {_dhash('best')} AS fingerprint FROM canonical""",
    "grid9": f"""
    WITH p AS (
      SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 1000) % 256)::INTEGER) AS px
      FROM embeddings
    ),
    c AS (SELECT vec_id, px, i, {_AXIS.format(n='i % 9')} AS cx, {_AXIS.format(n='i // 9')} AS cy FROM p, range(81) t(i)),
    d AS (
      SELECT *, floor(cx)::INTEGER AS x0, floor(cy)::INTEGER AS y0, least(floor(cx)::INTEGER + 1, 7) AS x1,
             least(floor(cy)::INTEGER + 1, 7) AS y1, cx - floor(cx) AS fx, cy - floor(cy) AS fy FROM c
    ),
    e AS (
      SELECT vec_id, i, fy, px[y0 * 8 + x0 + 1] * (1 - fx) + px[y0 * 8 + x1 + 1] * fx AS top,
             px[y1 * 8 + x0 + 1] * (1 - fx) + px[y1 * 8 + x1 + 1] * fx AS bottom FROM d
    )
    SELECT vec_id, string_agg(floor(top * (1 - fy) + bottom * fy + 0.5::DOUBLE)::INTEGER::VARCHAR, ',' ORDER BY i) AS grid
    FROM e GROUP BY vec_id""",
    "formatting": f"""
    WITH t AS (
      SELECT l_orderkey, l_linenumber, floor(pow(l_extendedprice, 2))::BIGINT + l_orderkey AS n, l_shipdate,
             lower(l_returnflag) AS dir, l_linestatus || '.' || l_orderkey AS name FROM lineitem
    )
    SELECT l_orderkey, l_linenumber, {_size_text('n')} AS size_text,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date_text,
           dir || '/' || name[1] || '.jpg' AS jpg, dir AS parent, name, '/base/' || dir || '/' || name AS joined
    FROM t""",
    "media": """
    WITH p AS (SELECT page_id, string_split(url, '/')[-1] AS last FROM pages)
    SELECT page_id, 'text/html' AS mime,
           '{' || CASE WHEN trim(last) <> '' THEN '"title":"' || last || '",' ELSE '' END
               || '"pages":"' || page_id || '"}' AS attributes,
           coalesce(try_cast(last AS DOUBLE), -10.0) AS duration
    FROM p""",
    "rolling_eta": _eta("path", 10),
    "rolling_eta_hot": _eta("hash", 1000),
    "report_md": f"""
    WITH {RANKED},
    numbered AS (SELECT *, dense_rank() OVER (ORDER BY group_key) AS group_no FROM ranked)
    SELECT 0::BIGINT AS group_no, 0::BIGINT AS rank,
           E'# Duplicate/Similar Files Report\\n\\nType: Exact Duplicates\\n' AS text
    UNION ALL
    SELECT group_no, rank,
           CASE WHEN rank = 1 THEN '## Group ' || group_no || chr(10) || 'Hash: `' || hash || '` ('
                || {_size_text('size')} || E')\\n\\n' ELSE '' END
           || '- **Repo:** ' || repo || E'\\n  - **Path:** `' || path || E'`\\n  - **Size:** '
           || {_size_text('size')} || E'\\n  - **Modified:** ' || {_date_text('last_modified')} || chr(10)
           || CASE WHEN rank = copies THEN E'\\n---\\n' ELSE '' END
    FROM numbered""",
    "report_html": f"""
    WITH RECURSIVE {_hamming_clusters(['w0'], 64, 70, 'image')},
    numbered AS (
      SELECT *, dense_rank() OVER (ORDER BY group_key) AS group_no,
             row_number() OVER (PARTITION BY group_key ORDER BY seq) AS rank,
             'file:/data/embeddings/' || seq AS link
      FROM clusters
    )
    SELECT 0::BIGINT AS group_no, 0::BIGINT AS rank, '{_HTML_TOP}' AS text
    UNION ALL SELECT 9223372036854775807::BIGINT, 0::BIGINT, E'</body>\\n</html>'
    UNION ALL
    SELECT group_no, rank,
           CASE WHEN rank = 1 THEN E'<div class="group">\\n<h2>Group ' || group_no || E'</h2>\\n' ELSE '' END
           || E'<div class="file">\\n<strong>Repo:</strong> embeddings<br>\\n<strong>Path:</strong> <code>' || seq
           || E'</code><br>\\n<strong>Size:</strong> 64 B<br>\\n<strong>Modified:</strong> ' || {_date_text('(seq * 1000)')}
           || E'<br>\\n<a href="' || link || E'" target="_blank">Open original</a><br>\\n<img src="' || link
           || E'" alt="thumbnail">\\n</div>' || CASE WHEN rank = copies THEN E'\\n</div>' ELSE '' END
    FROM numbered""",
    "latest_stream": f"WITH {STATE} SELECT path, seq, hash, size, missing FROM state",
    "duplicates_stream": f"""
    WITH {LOG}
    SELECT path, seq, hash, size, min(seq) OVER (PARTITION BY hash, size) AS first_seq
    FROM log QUALIFY seq > first_seq""",
}
ORACLE["incremental_stats"] = ORACLE["index_stats"]
ORACLE["reconciled_status"] = f"SELECT * EXCLUDE (match) FROM ({ORACLE['diff_status']})"
ORACLE["stored_status"] = ORACLE["diff_status"]
ORACLE["contents_stream"] = ORACLE["duplicates_stream"]
ORACLE = {name: sql if "<style>" in sql else dedent(sql).strip() for name, sql in ORACLE.items()}
