"""DuckDB SQL of the queries that SQL can express; it imports nothing from the code under test."""

from __future__ import annotations

NEAR_DUPLICATES = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.k >= 75 * (x.n + y.n - c.k)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(l.m, s.doc_id)) AS kept
FROM sizes s LEFT JOIN least_of l ON l.a = s.doc_id"""

TOP_K = """WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: the text between matches gives their places."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {kind} AS kind, start, start + length(m) AS stop, v AS value FROM (
    SELECT doc_id, source, m[i] AS m, v[i] AS v,
           CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, source, m, v, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS gaps
      FROM docs) x) y) z
  WHERE length(v) >= {least}"""


_LIVE = "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

_URL = r"""(?i)([a-z0-9+.-]://|www\.)[^\s?#=&@:<>"']*(:[0-9]+/[^\s?#=&@:<>"']*)?"""
_NO_UUID = "regexp_replace({v}, '(?i)(^|[/_+-])[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}($|[/_+-])', '\\1\\3', 'g')"
_PARTS = f"string_split_regex({_NO_UUID.format(v=_NO_UUID.format(v='value'))}, '[/_+-]')"
_ORDINARY = "^(([A-Z]?[a-z]+)*|[A-Z]+[a-z]*|[0-9]+|([A-Z]?[a-z]+|[A-Z]+)[0-9]{1,4}|[0-9]{1,4}[A-Za-z]{1,3})$"
_RANDOM = f"length(array_to_string(list_filter({_PARTS}, lambda p: NOT regexp_matches(p, '{_ORDINARY}')), ''))"

SECRETS = f"""WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS (
  {_spans(0, _ASSIGN, 2, 8)}
  UNION ALL {_spans(1, 'AKIA[A-Z0-9]+', 0, 16)}
  UNION ALL {_spans(2, '[0-9a-f]+', 0, 32)}),
runs AS ({_spans(3, '[A-Za-z0-9+/_-]{20,}', 0, 20)}),
urls AS ({_spans(4, _URL, 0, 0)}),
own AS (
  SELECT * FROM (SELECT *, {_RANDOM} AS n FROM runs r WHERE {_LIVE}) r WHERE (n >= 16 OR n >= 0.6 * length(value))
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND r.start < b.stop)
  AND NOT EXISTS (SELECT 1 FROM urls u WHERE u.doc_id = r.doc_id AND u.start <= r.start AND u.stop >= r.start + 2)),
found AS (SELECT * FROM base UNION ALL SELECT * EXCLUDE (n) FROM own),
owners AS (SELECT value, count(DISTINCT source) AS n, count(DISTINCT (source, doc_id)) AS repos FROM found GROUP BY value),
judged AS (
  SELECT f.doc_id, f.kind, f.start, f.stop, o.n >= 3 OR o.repos >= 100 AS example, NOT (o.n >= 3 OR o.repos >= 100) AND ({_LIVE.replace('value', 'f.value')}) AS live
  FROM found f JOIN owners o ON f.value = o.value),
shown AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS s FROM judged WHERE kind < 3 OR live),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base, string_agg(s, ',' ORDER BY start, kind) AS spans,
         count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example) AS n_example
  FROM shown GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs d LEFT JOIN per_doc p ON p.doc_id = d.doc_id"""


def _seeds(table: str, key: str, words: str) -> str:
    """(key, mask, pos, seed): the selected words of every window, by mask."""
    parts = []
    for mask, (span, picks) in enumerate(((6, (0, 1, 3, 4, 5)), (7, (0, 1, 3, 5, 6)), (10, (0, 1, 2, 5, 7, 8, 9)))):
        seed = " || ' ' || ".join(f"{words}[i + {k}]" for k in picks)
        each = f"list_transform(range(1, len({words}) - {span - 2}), lambda i: {{'pos': i, 'seed': {seed}}})"
        parts.append(f"SELECT {key}, {mask} AS mask, s.pos AS pos, s.seed AS seed FROM (SELECT {key}, unnest({each}) AS s FROM {table} WHERE len({words}) >= {span}) x{mask}")
    return " UNION ALL ".join(parts)


# For items of at least six words; shorter ones, sought whole, are held against brute force in the tests.
DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS v FROM benchmark),
ds AS ({_seeds('d', 'doc_id', 'w')}),
bs AS ({_seeds('b', 'item_id', 'v')}),
diagonals AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.pos - bs.pos AS g FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
sides AS (SELECT x.doc_id, x.item_id, x.g, d.w, b.v FROM diagonals x JOIN d ON d.doc_id = x.doc_id JOIN b ON b.item_id = x.item_id),
cells AS (
  SELECT doc_id, item_id, g, n, lo, c.p AS p, c.same AS same FROM (
    SELECT doc_id, item_id, g, len(v) AS n, greatest(0, -g) AS lo,
           unnest(list_transform(range(greatest(0, -g), least(len(v), len(w) - g)), lambda i: {{'p': i, 'same': v[i + 1] = w[i + 1 + g]}})) AS c
    FROM sides) x),
sums AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, g ORDER BY p) AS total FROM cells),
gains AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY doc_id, item_id, g ORDER BY p)) AS gain FROM sums),
tops AS (SELECT doc_id, item_id, g, max(gain) AS top FROM gains GROUP BY 1, 2, 3),
ends AS (SELECT x.doc_id, x.item_id, x.g, min(x.p) AS e FROM gains x JOIN tops t ON t.doc_id = x.doc_id AND t.item_id = x.item_id AND t.g = x.g AND x.gain = t.top WHERE t.top > 0 GROUP BY 1, 2, 3),
lows AS (SELECT x.doc_id, x.item_id, x.g, e.e, min(x.total) AS low FROM gains x JOIN ends e ON e.doc_id = x.doc_id AND e.item_id = x.item_id AND e.g = x.g WHERE x.p <= e.e GROUP BY 1, 2, 3, 4),
cuts AS (
  SELECT l.doc_id, l.item_id, l.g, l.e + 1 AS stop, CASE WHEN l.low >= 0 THEN min(x.lo) ELSE min(x.p) FILTER (WHERE x.total = l.low) + 1 END AS start
  FROM lows l JOIN gains x ON x.doc_id = l.doc_id AND x.item_id = l.item_id AND x.g = l.g AND x.p <= l.e GROUP BY l.doc_id, l.item_id, l.g, l.e, l.low),
found AS (
  SELECT c.doc_id, c.item_id, c.start + c.g AS doc_start, c.stop + c.g AS doc_end, c.start AS item_start, c.stop AS item_end, x.n, count(*) FILTER (WHERE x.same) AS matched
  FROM cuts c JOIN gains x ON x.doc_id = c.doc_id AND x.item_id = c.item_id AND x.g = c.g AND x.p >= c.start AND x.p < c.stop GROUP BY ALL),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_start, doc_end DESC, item_start DESC, item_end DESC) AS rn
  FROM found WHERE item_end - item_start >= least(12, n) AND matched >= 0.8 * (item_end - item_start))
SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(doc_start AS INTEGER) AS doc_start, CAST(doc_end AS INTEGER) AS doc_end,
       CAST(item_start AS INTEGER) AS item_start, CAST(item_end AS INTEGER) AS item_end, CAST(matched AS INTEGER) AS matched FROM kept WHERE rn = 1"""


# -- centroid clustering -----------------------------------------------------------------------


def _lloyd(rounds: int) -> str:
    """Assignments a1, a2, ... and the centroids c1, c2, ... after each of them; the last assignment moves none."""
    out = []
    for r in range(1, rounds + 2):
        out.append(f"""a{r} AS (
  SELECT rid, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT v.rid, c.j, CAST(list_sum(list_transform(list_zip(v.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r - 1} c) z GROUP BY rid)""")
        if r <= rounds:
            out.append(f"""c{r} AS (
  SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r - 1} c LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT a.j, i, sum(v.x[i]) AS s, count(*) AS n FROM a{r} a JOIN v ON v.rid = a.rid, range(1, 65) t(i) GROUP BY a.j, i) s GROUP BY j) m ON m.j = c.j)""")
    return ",\n".join(out)


CENTROIDS = f"""WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT j, x AS c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS j, x FROM v) z WHERE j < 16),
{_lloyd(3)}
SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a4 a JOIN v ON v.rid = a.rid JOIN c3 c ON c.j = a.j"""

# -- CRC-32 by its table, for conversations and sharding ---------------------------------------------

_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: xor(a >> 8, table_[(xor(a, b) & 255) + 1])), 4294967295)"


# -- conversation repair: a walk over the rows with the best edits for each of four states ----------------------

_ROW_KEY = " || ".join(f"length({c}) || '=' || {c}" for c in ("coalesce(CAST(conv AS VARCHAR), ' ')", "coalesce(CAST(turn AS VARCHAR), ' ')", "role", "text"))
_FAR = "{'c': 1000000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}"
_FREE = "fault NOT IN ('blank', 'duplicate')"
_LATE = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"


def _edit(state: str, letter: str, cost: str, line: str | None = None) -> str:
    lines = f"{state}.r || [{line}]" if line else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {lines}}}"


def _insert(state: str, role: str) -> str:
    return _edit(state, "I", "5", f"'{role}:'")


def _delete(state: str) -> str:
    return _edit(state, "D", "2")


def _keep(state: str, letter: str) -> str:
    return f"CASE WHEN {_FREE} AND ini = '{letter}' THEN {_edit(state, 'K', _LATE, "role || ':' || text")} ELSE {_FAR} END"


def _rerole(state: str, role: str) -> str:
    return f"CASE WHEN {_FREE} THEN {_edit(state, 'R', f'1 + {_LATE}', f"'{role}:' || text")} ELSE {_FAR} END"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


CONVERSATIONS = f"""WITH RECURSIVE crc(table_) AS ({_CRC_TABLE}),
raw AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, {_crc('k')} % 20 AS kind FROM raw, crc),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS ini, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, substr(sha256({_ROW_KEY}), 1, 32), copy) AS i FROM damaged),
faulty AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY conv ORDER BY i) AS earlier FROM placed),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND earlier || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv),
walk(conv, i, z, s, u, a) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}}, {_FAR}, {_FAR}, {_FAR} FROM faulty
  UNION ALL
  SELECT conv, i, {_delete('z')}, {_least(_delete('s'), _keep('z', 's'))},
         {_least(_delete('u'), *[_rerole(p, 'user') for p in 'zsa'], *[_keep(p, 'u') for p in 'zsa'])},
         {_least(_delete('a'), _rerole('u', 'assistant'), _keep('u', 'a'))}
  FROM (
    SELECT f.conv, f.i, f.role, f.text, f.ini, f.fault, z, s, {_least('u1', _insert('a1', 'user'))} AS u, a1 AS a FROM (
      SELECT conv, i, z, s, u1, {_least('a', _insert('u1', 'assistant'))} AS a1 FROM (
        SELECT conv, i, z, s, {_least('u', *[_insert(p, 'user') for p in 'zsa'])} AS u1, a FROM walk) x1) x2
    JOIN faulty f ON f.conv IS NOT DISTINCT FROM x2.conv AND f.i = x2.i + 1) x3),
ends AS (
  SELECT w.conv, {_least('z', 'a', _insert('u', 'assistant'), "{'c': s.c + 10, 'a': s.a || 'II', 'r': s.r || ['user:', 'assistant:']}")} AS best
  FROM walk w JOIN counts c ON c.conv IS NOT DISTINCT FROM w.conv AND c.n = w.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit,
       sha256(coalesce(array_to_string(e.best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv IS NOT DISTINCT FROM o.conv_id"""

# -- rendezvous sharding ---------------------------------------------------------------------------


def _as_key(*cols: str) -> str:
    return " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || '=' || CAST({c} AS VARCHAR), '-')" for c in cols)


def _best_shard(n: int) -> str:
    u = "(CAST('0x' || substr(sha256(k || '@' || CAST(s AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"
    return f"CAST((list_sort(list_transform(range({n}), lambda s: {{'score': 1.0::DOUBLE / ln({u}), 's': s}}))[1]).s AS INTEGER)"


SHARDING = f"""WITH crc(table_) AS ({_CRC_TABLE}),
d AS (SELECT doc_id, coalesce(text, '') AS t, {_as_key('doc_id')} AS k FROM documents),
c AS (
  SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, {_crc('t')} AS text_crc32, {_best_shard(8)} AS shard, {_best_shard(9)} AS grown_shard
  FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(sha256({_as_key('doc_id', 'size', 'text_crc32', 'shard', 'grown_shard')}), 1, 13) AS BIGINT),
                          doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM c"""

ORACLE = {
    "op11_centroids": CENTROIDS,
    "op12_conversations": CONVERSATIONS,
    "op13_sharding": SHARDING,
    "op5_decontaminate": DECONTAMINATE,
    "op2_secret_scan": SECRETS,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op9_top_k": TOP_K,
}
