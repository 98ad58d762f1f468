"""DuckDB SQL oracles, one per registered query (same column names and types).

The driver registers the parquet tables as views; each string here is a complete
statement over those views. The derived fixtures are rebuilt as CTEs with the
same rules as ``tallyfold.sources.updates``. Nothing is imported from the code under
test: all values are written out here.
"""

from __future__ import annotations

# Fixed values of the fixtures and formats.
_INT = "[+-]?[0-9]+"
_DECIMAL = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_HEX = r"[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+"
_PATH_TEXTS = (
    "['5', '+5', '-7', '1.5', ' 1', '1d', '0x10', '1e3', '1e400', '9223372036854775807', "
    "'9223372036854775808', 'NaN', 'Inf', '', 'abc', '-inf', '.5', '5.']"
)
_N_PATH_TEXTS = 18
_SQLSTATES = "['08000', '08003', '08006', '40000', '40001', '40P01', '57P03', '22000', '23505', '42P01', 'XX999']"
_N_CODES = 11
_RETRY = "'08000', '08003', '08006', '40000', '40001', '40P01', '57P03'"

# The signing key padded to a SHA-256 block, against the two HMAC constants.
_KEY = b"tallyfold-test-key".ljust(64, b"\0")
_IPAD, _OPAD = ("".join(f"{k ^ x:02x}" for k in _KEY) for x in (0x36, 0x5C))


def hmac_sql(col: str) -> str:
    return f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({col}))))"


def f3_sql(col: str) -> str:
    """F3 for the value range of the driver tables (DuckDB prints shortest digits)."""
    return f"regexp_replace(CAST({col} AS VARCHAR), '\\.0$', '')"


def value_text_sql(t: str = "type", d: str = "delta", v: str = "value") -> str:
    return f"coalesce(CASE WHEN {t} = 'counter' THEN CAST({d} AS VARCHAR) WHEN {t} = 'gauge' THEN {f3_sql(v)} END, '')"


def int_parse_sql(t: str) -> str:
    return f"CASE WHEN regexp_full_match({t}, '{_INT}') THEN TRY_CAST({t} AS BIGINT) END"


def float_parse_sql(t: str) -> str:
    return f"""CASE WHEN lower({t}) IN ('inf', '+inf', 'infinity', '+infinity') THEN CAST('inf' AS DOUBLE)
            WHEN lower({t}) IN ('-inf', '-infinity') THEN CAST('-inf' AS DOUBLE)
            WHEN lower({t}) = 'nan' THEN CAST('nan' AS DOUBLE)
            WHEN (regexp_full_match({t}, '{_DECIMAL}') OR regexp_full_match({t}, '{_HEX}'))
                 AND NOT isnan(TRY_CAST({t} AS DOUBLE)) AND NOT isinf(TRY_CAST({t} AS DOUBLE))
            THEN TRY_CAST({t} AS DOUBLE) END"""


E_ID = "'metric name (id) is empty'"
E_TYPE = "'metric type is empty'"
E_INV = "'metric type is not valid'"
E_NOVAL = "'metric has no value'"
E_BAD = "'metric value is not parseable'"
E_NOTFOUND = "'metric is not found'"
E_NONFINITE = "'metric value is not finite'"


def key_error_sql(i: str = "id", t: str = "type") -> str:
    return (f"CASE WHEN {i} IS NULL OR {i} = '' THEN {E_ID} WHEN {t} IS NULL OR {t} = '' THEN {E_TYPE} "
            f"WHEN {t} NOT IN ('counter', 'gauge') THEN {E_INV} END")


UPDATES = """updates AS (
  SELECT event_id AS seq, ts,
         event_type || '_' || CAST(user_id AS VARCHAR) AS id,
         CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'counter' ELSE 'gauge' END AS type,
         CASE WHEN event_type IN ('click', 'view', 'signup')
              THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS delta,
         CASE WHEN NOT (event_type IN ('click', 'view', 'signup')) THEN value END AS value
  FROM events)"""

DIRTY = """dirty AS (
  SELECT u.seq, u.ts, u.seq // 100 AS batch_id, u.seq % 100 AS pos,
         CASE WHEN u.seq % 997 = 0 THEN '' WHEN u.seq % 59 = 0 THEN 'shared' ELSE u.id END AS id,
         CASE WHEN u.seq % 887 = 0 THEN '' WHEN u.seq % 883 = 0 THEN 'histogram' ELSE u.type END AS type,
         CASE WHEN u.seq % 881 = 0 THEN NULL
              WHEN u.type = 'counter' AND u.seq % 61 = 0 THEN NULL
              WHEN u.type = 'gauge' AND u.seq % 67 = 0 THEN CAST(9 AS BIGINT)
              ELSE u.delta END AS delta,
         CASE WHEN u.seq % 881 = 0 THEN NULL
              WHEN u.type = 'counter' AND u.seq % 61 = 0 THEN 1.5
              WHEN u.type = 'gauge' AND u.seq % 67 = 0 THEN NULL
              ELSE u.value END AS value
  FROM updates u)"""

GATED = """gated AS (SELECT * FROM dirty WHERE type IN ('counter', 'gauge'))"""

VALIDATED = """validated AS (
  SELECT *,
         CASE WHEN id IS NULL OR id = '' THEN 'metric name (id) is empty'
              WHEN type IS NULL OR type = '' THEN 'metric type is empty'
              WHEN type NOT IN ('counter', 'gauge') THEN 'metric type is not valid'
              WHEN value IS NULL AND delta IS NULL THEN 'metric has no value' END AS error
  FROM dirty)"""

ACCEPTED = """accepted AS (
  SELECT v.* EXCLUDE (error) FROM validated v
  WHERE v.batch_id NOT IN (SELECT batch_id FROM validated WHERE error IS NOT NULL))"""


def fold_sql(source: str) -> str:
    """A1 + A2 + A3 over a relation with seq, id, type, delta, value."""
    return f"""SELECT id, type,
       CASE WHEN count(delta) = count(*) THEN CAST(sum(delta) AS BIGINT) END AS delta,
       arg_max_null(value, seq) AS value
FROM {source} GROUP BY id, type"""


def state_cte(name: str, source: str) -> str:
    return f"{name} AS ({fold_sql(source)})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def with_more(*ctes: str, tail: str) -> str:
    """``WITH`` list whose ``tail`` starts with further CTEs and ends in the SELECT."""
    return "WITH " + ",\n".join(ctes) + ",\n" + tail


RUNNING = """SELECT seq, id, type,
       CASE WHEN count(*) FILTER (WHERE delta IS NULL) OVER w = 0
            THEN CAST(sum(delta) OVER w AS BIGINT) END AS delta,
       value
FROM {source}
WINDOW w AS (PARTITION BY id, type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

TEXTS_CTE = f"""texts AS (
  SELECT seq, list_extract({_PATH_TEXTS}, CAST(seq % {_N_PATH_TEXTS} + 1 AS INTEGER)) AS text FROM dirty)"""

REQUESTS = """requests AS (
  SELECT seq AS request_id, id,
         CASE WHEN seq % 3 = 0 AND type IN ('counter', 'gauge')
              THEN CASE WHEN type = 'counter' THEN 'gauge' ELSE 'counter' END ELSE type END AS type
  FROM dirty)"""


def newest_last_sql(source: str) -> str:
    """Rows of each window's newest ts, then the last row per (window, id)."""
    return f"""newest AS (
  SELECT w.* FROM {source} w
  JOIN (SELECT window_start, max(ts) AS mts FROM {source} GROUP BY window_start) m
    ON w.window_start = m.window_start AND w.ts = m.mts)
SELECT window_start, id, seq, type, delta, value FROM (
  SELECT *, row_number() OVER (PARTITION BY window_start, id ORDER BY seq DESC) AS rn FROM newest) x
WHERE rn = 1"""


_LI_GAUGES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LI_COUNTERS = ("l_partkey",)


def lineitem_long_sql(cols: str) -> str:
    parts = [f"SELECT {cols}, '{c}' AS id, 'gauge' AS type, CAST(NULL AS BIGINT) AS delta, CAST({c} AS DOUBLE) AS value FROM li"
             for c in _LI_GAUGES]
    parts += [f"SELECT {cols}, '{c}' AS id, 'counter' AS type, CAST({c} AS BIGINT) AS delta, CAST(NULL AS DOUBLE) AS value FROM li"
              for c in _LI_COUNTERS]
    return "\nUNION ALL\n".join(parts)


WEEK_US = 7 * 86400 * 1000000
LI_WINDOWED = f"""li AS (
  SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS ts,
         strftime(make_timestamp((epoch_us(l_shipdate) // {WEEK_US}) * {WEEK_US}), '%Y-%m-%d %H:%M:%S') AS window_start,
         l_quantity, l_extendedprice, l_discount, l_tax, l_partkey
  FROM lineitem)"""

DAY_WINDOW = "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"

PATH_INGEST = f"""paths AS (
  SELECT seq, '/update/' || type || '/' || id || '/' || list_extract({_PATH_TEXTS}, CAST(seq % {_N_PATH_TEXTS} + 1 AS INTEGER)) AS path
  FROM dirty),
parts AS (SELECT seq, path, string_split(path, '/') AS p FROM paths),
parsed AS (
  SELECT seq, path, (len(p) = 5 AND p[1] = '' AND p[2] = 'update') AS routed,
         CASE WHEN len(p) = 5 AND p[1] = '' AND p[2] = 'update' THEN p[3] END AS type,
         CASE WHEN len(p) = 5 AND p[1] = '' AND p[2] = 'update' THEN p[4] END AS id,
         CASE WHEN len(p) = 5 AND p[1] = '' AND p[2] = 'update' THEN p[5] END AS text
  FROM parts),
vals AS (
  SELECT *, CASE WHEN type = 'counter' THEN {int_parse_sql('text')} END AS delta,
            CASE WHEN type = 'gauge' THEN {float_parse_sql('text')} END AS value
  FROM parsed),
errs AS (
  SELECT *, CASE WHEN NOT routed THEN {E_NOTFOUND}
                 ELSE coalesce({key_error_sql()},
                               CASE WHEN delta IS NULL AND value IS NULL THEN {E_BAD} END,
                               CASE WHEN value IS NOT NULL AND (isnan(value) OR isinf(value)) THEN {E_NONFINITE} END) END AS error
  FROM vals)
SELECT seq, path, id, type,
       CASE WHEN error IS NULL THEN delta END AS delta,
       CASE WHEN error IS NULL THEN value END AS value,
       error,
       CASE WHEN error IS NULL THEN 200
            WHEN error IN ({E_ID}, {E_NOTFOUND}) THEN 404
            WHEN error IN ({E_TYPE}, {E_INV}, {E_NOVAL}, {E_BAD}, {E_NONFINITE}) THEN 400
            ELSE 500 END AS status
FROM errs"""

LOOKUP_BULK = f"""j AS (
  SELECT r.request_id, r.id, r.type, s.delta, s.value, (s.id IS NOT NULL) AS found,
         {key_error_sql('r.id', 'r.type')} AS key_error
  FROM requests r LEFT JOIN state s ON r.id = s.id AND r.type = s.type)
SELECT request_id, id, type, found,
       CASE WHEN found AND key_error IS NULL THEN {value_text_sql()} END AS text,
       coalesce(key_error, CASE WHEN NOT found THEN {E_NOTFOUND} END) AS error,
       CASE WHEN coalesce(key_error, CASE WHEN NOT found THEN {E_NOTFOUND} END) IS NULL THEN 200
            WHEN coalesce(key_error, CASE WHEN NOT found THEN {E_NOTFOUND} END) IN ({E_ID}, {E_NOTFOUND}) THEN 404
            WHEN coalesce(key_error, CASE WHEN NOT found THEN {E_NOTFOUND} END) IN ({E_TYPE}, {E_INV}) THEN 400
            ELSE 500 END AS status
FROM j"""

METRIC_JSON_SQL = f"""'{{"id":' || to_json(id) || ',"type":' || to_json(type)
       || coalesce(',"delta":' || CAST(delta AS VARCHAR), '')
       || coalesce(',"value":' || {f3_sql('value')}, '') || '}}'"""

LOOKUP_JSON = f"""j AS (
  SELECT r.request_id, r.id, r.type, s.found, s.text,
         {key_error_sql('r.id', 'r.type')} AS key_error
  FROM requests r LEFT JOIN (SELECT id, type, true AS found, {METRIC_JSON_SQL} AS text FROM state) s
    ON r.id = s.id AND r.type = s.type)
SELECT request_id, id, type, coalesce(found, false) AS found,
       CASE WHEN found AND key_error IS NULL THEN text END AS text,
       coalesce(key_error, CASE WHEN found IS NULL THEN {E_NOTFOUND} END) AS error,
       CASE WHEN coalesce(key_error, CASE WHEN found IS NULL THEN {E_NOTFOUND} END) IS NULL THEN 200 ELSE 404 END AS status
FROM j"""

VALUE_PATH_LOOKUP = f"""paths AS (SELECT request_id, '/value/' || type || '/' || id AS path FROM requests),
parsed AS (SELECT request_id, path, string_split(path, '/') AS p FROM paths),
r AS (
  SELECT request_id, path,
         CASE WHEN len(p) = 4 AND p[1] = '' AND p[2] = 'value' THEN p[4] END AS id,
         CASE WHEN len(p) = 4 AND p[1] = '' AND p[2] = 'value' THEN p[3] END AS type,
         CASE WHEN NOT (len(p) = 4 AND p[1] = '' AND p[2] = 'value') THEN {E_NOTFOUND} END AS prior
  FROM parsed),
j AS (
  SELECT r.request_id, r.path, r.id, r.type, r.prior, s.delta, s.value, (s.id IS NOT NULL) AS found,
         {key_error_sql('r.id', 'r.type')} AS key_error
  FROM r LEFT JOIN state s ON r.id = s.id AND r.type = s.type),
e AS (SELECT *, coalesce(prior, key_error, CASE WHEN NOT found THEN {E_NOTFOUND} END) AS error FROM j)
SELECT request_id, path, id, type, found,
       CASE WHEN found AND key_error IS NULL AND prior IS NULL THEN {value_text_sql()} END AS text,
       error,
       CASE WHEN error IS NULL THEN 200 WHEN error IN ({E_ID}, {E_NOTFOUND}) THEN 404
            WHEN error IN ({E_TYPE}, {E_INV}) THEN 400 ELSE 500 END AS status
FROM e"""

JSON_LOOKUP_BODIES = f"""b AS (
  SELECT request_id,
         CASE WHEN request_id % 13 = 0 THEN NULL ELSE id END AS id,
         CASE WHEN request_id % 13 = 0 THEN NULL ELSE type END AS type,
         CASE WHEN request_id % 13 = 0 THEN 'invalid JSON was passed' END AS prior
  FROM requests),
j AS (
  SELECT b.request_id, b.id, b.type, b.prior, s.found, s.text, {key_error_sql('b.id', 'b.type')} AS key_error
  FROM b LEFT JOIN (SELECT id, type, true AS found, {METRIC_JSON_SQL} AS text FROM state) s
    ON b.id = s.id AND b.type = s.type),
e AS (SELECT *, coalesce(prior, key_error, CASE WHEN found IS NULL THEN {E_NOTFOUND} END) AS error FROM j)
SELECT request_id, id, type, coalesce(found, false) AS found,
       CASE WHEN found AND key_error IS NULL AND prior IS NULL THEN text END AS text,
       error,
       CASE WHEN error IS NULL THEN 200 WHEN error = 'invalid JSON was passed' THEN 400 ELSE 404 END AS status
FROM e"""

AGENT_REPORTS = f"""long AS ({lineitem_long_sql("window_start, ts, seq")}),
newest AS (
  SELECT w.* FROM long w
  JOIN (SELECT window_start, max(ts) AS mts FROM long GROUP BY window_start) m
    ON w.window_start = m.window_start AND w.ts = m.mts),
last AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY window_start, id ORDER BY seq DESC) AS rn FROM newest) x
  WHERE rn = 1),
bodies AS (
  SELECT window_start, '[' || string_agg({METRIC_JSON_SQL}, ',' ORDER BY id) || ']' AS body
  FROM last GROUP BY window_start)
SELECT window_start, body, {hmac_sql('body')} AS signature FROM bodies"""


def plain_float_sql(x: str) -> str:
    """F3 over the whole range: DuckDB's shortest digits, written without an exponent."""
    t = f"CAST(abs({x}) AS VARCHAR)"
    mant = f"split_part({t}, 'e', 1)"
    digits = f"replace(regexp_replace({mant}, '\\.0$', ''), '.', '')"
    point = f"(length(split_part({mant}, '.', 1)) + CASE WHEN contains({t}, 'e') THEN CAST(split_part({t}, 'e', 2) AS INTEGER) ELSE 0 END)"
    return f"""CASE WHEN {point} <= 0 THEN '0.' || repeat('0', -{point}) || {digits}
            WHEN {point} >= length({digits}) THEN {digits} || repeat('0', {point} - length({digits}))
            ELSE substr({digits}, 1, {point}) || '.' || substr({digits}, {point} + 1) END"""


_WIDE = "[" + ", ".join(f"CAST('1e{k}' AS DOUBLE)" for k in range(-300, 301, 25)) + "]"
GAUGE_TEXT_WIDE = f"""SELECT l_orderkey, l_linenumber, {plain_float_sql('a')} AS scaled, {plain_float_sql('b')} AS whole
FROM (SELECT l_orderkey, l_linenumber,
             CAST(l_extendedprice AS DOUBLE) * list_extract({_WIDE}, CAST(l_orderkey % 25 + 1 AS INTEGER)) AS a,
             CAST(l_partkey AS DOUBLE) * CAST('45035996273704960' AS DOUBLE) + CAST(l_orderkey AS DOUBLE) AS b
      FROM lineitem) x"""

# What becomes of each hard body, written out: form, error, ids, deltas.
_BAD = "'invalid JSON was passed'"
STRICT = f"""outcomes(form, error, ids, deltas) AS (VALUES
  (0, NULL, 'a', '1'), (1, {_BAD}, NULL, NULL), (2, {_BAD}, NULL, NULL), (3, NULL, 'a', '2'), (4, NULL, '', ''),
  (5, NULL, '', ''), (6, NULL, 'b', '3'), (7, NULL, 'a', '5'), (8, {_BAD}, NULL, NULL), (9, {_BAD}, NULL, NULL),
  (10, {_BAD}, NULL, NULL), (11, {_BAD}, NULL, NULL), (12, {_BAD}, NULL, NULL), (13, NULL, 'a', '-9223372036854775808'),
  (14, {_BAD}, NULL, NULL), (15, {E_ID}, '-', '-'), (16, {E_NOVAL}, 'a,b', '1,-'), (17, NULL, 'c', '6'), (18, {_BAD}, NULL, NULL))
SELECT u.seq AS batch_id, o.form, o.error, CASE WHEN o.error IS NULL THEN 200 ELSE 400 END AS status, o.ids, o.deltas
FROM updates u JOIN outcomes o ON u.seq % 19 = o.form"""

# Parts as they arrive; the watermark before a part is a day behind the latest update of all earlier parts.
REPORT_LATE = f"""arrived AS (
  SELECT *, CAST(floor((seq - (SELECT min(seq) FROM updates)) * 4 / (SELECT max(seq) - min(seq) + 1 FROM updates)) AS INTEGER) + CASE WHEN seq % 13 = 0 THEN 1 ELSE 0 END AS part,
         date_trunc('day', ts) + INTERVAL 1 DAY AS window_end
  FROM updates),
marks AS (SELECT p.part, (SELECT date_trunc('millisecond', max(a.ts)) - INTERVAL 1 DAY FROM arrived a WHERE a.part < p.part) AS mark FROM range(6) p(part)),
counted AS (SELECT a.* FROM arrived a JOIN marks m ON m.part = a.part WHERE m.mark IS NULL OR a.window_end > m.mark)
SELECT {DAY_WINDOW} AS window_start, id, type, count(*) AS polls,
       CASE WHEN count(delta) = count(*) THEN CAST(sum(delta) AS BIGINT) END AS delta,
       arg_max_null(value, seq) AS value
FROM counted WHERE window_end <= (SELECT mark FROM marks WHERE part = 5) GROUP BY {DAY_WINDOW}, id, type"""

# The first write makes the metric; later counters add, later gauges replace, and what has no delta to add to changes nothing.
ID_STORE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM gated),
firsts AS (SELECT * FROM ranked WHERE rn = 1),
later AS (SELECT id, coalesce(sum(delta) FILTER (WHERE type = 'counter'), 0) AS more, count(*) FILTER (WHERE type = 'gauge') AS gauges,
                 arg_max_null(value, seq) FILTER (WHERE type = 'gauge') AS last_value FROM ranked WHERE rn > 1 GROUP BY id),
state AS (
  SELECT f.id, f.type, CAST(f.delta + coalesce(l.more, 0) AS BIGINT) AS delta, CASE WHEN l.gauges > 0 THEN l.last_value ELSE f.value END AS value
  FROM firsts f LEFT JOIN later l ON f.id = l.id)"""

RESTORE_SERVE = f"""restored AS (
  SELECT id, type, delta, value FROM (
    SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY seq DESC) AS rn FROM updates WHERE ts < TIMESTAMP '2024-01-16 00:00:00') x WHERE rn = 1),
late AS ({fold_sql("(SELECT * FROM updates WHERE ts >= TIMESTAMP '2024-01-16 00:00:00') u")}),
state AS (
  SELECT coalesce(r.id, l.id) AS id, coalesce(r.type, l.type) AS type,
         CASE WHEN r.id IS NULL THEN l.delta WHEN l.id IS NULL THEN r.delta ELSE r.delta + l.delta END AS delta,
         CASE WHEN l.id IS NULL THEN r.value ELSE l.value END AS value
  FROM restored r FULL JOIN late l ON r.id = l.id AND r.type = l.type)
SELECT id, type, 'ID: ' || id || ' Type: ' || type || ' Value: ' || {value_text_sql()} AS line FROM state"""

LARGE_FORMS = ", ".join(f"('{f}')" for f in ("one", "seven", "spread", "merged", "states"))

ORACLE: dict[str, str] = {
    "updates": with_(UPDATES) + "SELECT seq, id, type, delta, value FROM updates",
    "metric_state": with_(UPDATES) + fold_sql("updates"),
    "metric_state_dirty": with_(UPDATES, DIRTY, GATED) + fold_sql("gated"),
    "accepted_state": with_(UPDATES, DIRTY, VALIDATED, ACCEPTED) + fold_sql("accepted"),
    # J1 must reproduce the single fold of all updates.
    "upsert_merge": with_(UPDATES) + fold_sql("updates"),
    "upsert_merge_dirty": with_(UPDATES, DIRTY, GATED) + fold_sql("gated"),
    "upsert_merge_union": with_(UPDATES, DIRTY, GATED) + fold_sql("gated"),
    "upsert_merge_buckets": with_(UPDATES, DIRTY, GATED) + fold_sql("gated"),
    "id_store_state": with_(UPDATES, DIRTY, GATED, ID_STORE) + "SELECT id, type, delta, value FROM state",
    "id_store_lookup": with_more(UPDATES, DIRTY, GATED, REQUESTS, ID_STORE, tail=LOOKUP_BULK),
    "restore_serve": with_more(UPDATES, tail=RESTORE_SERVE),
    "running_result": with_(UPDATES, DIRTY, GATED) + RUNNING.format(source="gated"),
    # W1 seeded with the state at the split must equal the tail of the full W1.
    "running_seeded": with_(UPDATES, DIRTY, GATED)
    + "SELECT * FROM ("
    + RUNNING.format(source="gated")
    + ") r WHERE seq IN (SELECT seq FROM gated WHERE ts >= TIMESTAMP '2024-01-16 00:00:00')",
    "running_sparse": with_(UPDATES, DIRTY, GATED, "sparse AS (SELECT * REPLACE (seq * 1000003 AS seq) FROM gated)")
    + RUNNING.format(source="sparse"),
    "metric_state_large": with_(UPDATES, f"forms(form) AS (VALUES {LARGE_FORMS})")
    + """SELECT form, id, type, CASE WHEN count(delta) = count(*) THEN CAST(sum(delta) AS BIGINT) END AS delta, arg_max_null(value, seq) AS value
FROM updates, forms WHERE type = 'counter' GROUP BY form, id, type""",
    "duplicate_keys": with_(UPDATES, DIRTY, GATED) + "SELECT id, type, count(*) AS rows FROM gated GROUP BY id, type HAVING count(*) > 1",
    "lookup_state": with_(UPDATES, state_cte("state", "updates"))
    + "SELECT id, type, delta, value FROM state WHERE id = 'click_8' AND type = 'counter'",
    "gauge_text_wide": GAUGE_TEXT_WIDE,
    "json_strict_outcome": with_more(UPDATES, tail=STRICT),
    "json_update_saved_row": with_(UPDATES, DIRTY, VALIDATED, "ok AS (SELECT * FROM validated WHERE error IS NULL)", "ran AS (" + RUNNING.format(source="ok") + ")")
    + f"""SELECT v.seq, v.error, CASE WHEN v.error IS NULL THEN 200 ELSE 400 END AS status, r.saved
FROM validated v LEFT JOIN (SELECT seq, {METRIC_JSON_SQL} AS saved FROM ran) r ON v.seq = r.seq""",
    "snapshot_array_restore": with_(UPDATES)
    + """SELECT id, type, delta, value FROM (
  SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY seq DESC) AS rn FROM updates) x WHERE rn = 1""",
    "stream_results": with_(UPDATES) + RUNNING.format(source="updates"),
    "stream_results_store": with_(UPDATES) + RUNNING.format(source="updates"),
    # However often a body comes, it counts once.
    "request_replay": with_(UPDATES, DIRTY, VALIDATED, ACCEPTED) + fold_sql("accepted"),
    "report_late": with_more(UPDATES, tail=REPORT_LATE),
    "report_live": with_(UPDATES)
    + f"""SELECT {DAY_WINDOW} AS window_start, id, type, count(*) AS polls,
       CASE WHEN count(delta) = count(*) THEN CAST(sum(delta) AS BIGINT) END AS delta,
       arg_max_null(value, seq) AS value
FROM updates GROUP BY {DAY_WINDOW}, id, type""",
    "type_conflicts": with_(UPDATES, DIRTY, GATED)
    + """SELECT id,
       CASE WHEN min(seq) FILTER (WHERE type = 'counter') < min(seq) FILTER (WHERE type = 'gauge')
            THEN 'counter' ELSE 'gauge' END AS first_type,
       count(*) FILTER (WHERE type = 'counter') AS n_counter,
       count(*) FILTER (WHERE type = 'gauge') AS n_gauge
FROM gated GROUP BY id
HAVING count(*) FILTER (WHERE type = 'counter') > 0 AND count(*) FILTER (WHERE type = 'gauge') > 0""",
    "validate": with_(UPDATES, DIRTY, VALIDATED) + "SELECT seq, batch_id, pos, id, type, error FROM validated",
    "validate_key_only": with_(UPDATES, DIRTY) + f"SELECT seq, {key_error_sql()} AS error FROM dirty",
    "batch_accept": with_(UPDATES, DIRTY, VALIDATED, ACCEPTED)
    + "SELECT seq, batch_id, pos, id, type, delta, value FROM accepted",
    "batch_first_error": with_(UPDATES, DIRTY, VALIDATED)
    + """SELECT batch_id, min(pos) AS first_pos, arg_min(error, pos) AS error, count(*) AS n_bad
FROM validated WHERE error IS NOT NULL GROUP BY batch_id""",
    "json_update_outcome": with_(UPDATES, DIRTY, VALIDATED)
    + "SELECT seq, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status FROM validated",
    "keep_last": with_(UPDATES, DIRTY)
    + """SELECT batch_id, id, seq, type, delta, value FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, id ORDER BY seq DESC) AS rn FROM dirty) x WHERE rn = 1""",
    "report_window": with_(UPDATES)
    + f"""SELECT {DAY_WINDOW} AS window_start, id, type, count(*) AS polls,
       CASE WHEN count(delta) = count(*) THEN CAST(sum(delta) AS BIGINT) END AS delta,
       arg_max_null(value, seq) AS value
FROM updates GROUP BY {DAY_WINDOW}, id, type""",
    "report_polls": with_(UPDATES)
    + f"""SELECT {DAY_WINDOW} AS window_start, 'PollCount' AS id, 'counter' AS type, count(DISTINCT ts) AS delta
FROM updates GROUP BY {DAY_WINDOW}""",
    "latest_sample": with_more(
        UPDATES,
        f"w AS (SELECT {DAY_WINDOW} AS window_start, ts, seq, id, type, delta, value FROM updates)",
        tail=newest_last_sql("w"),
    ),
    "latest_sample_wide": with_more(
        LI_WINDOWED, "long AS (" + lineitem_long_sql("window_start, ts, seq") + ")", tail=newest_last_sql("long")
    ),
    "agent_reports": with_more(LI_WINDOWED, tail=AGENT_REPORTS),
    "wide_to_long": with_("li AS (SELECT * FROM lineitem)") + lineitem_long_sql("l_orderkey, l_linenumber"),
    "cpu_explode": """SELECT vec_id, 'CPUutilization' || CAST(pos AS VARCHAR) AS id, 'gauge' AS type, CAST(v AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings) x""",
    "hmac_sign": f"SELECT event_id, {hmac_sql('props')} AS signature FROM events",
    "hmac_check": with_(
        f"""signed AS (
  SELECT event_id, props AS body,
         CASE WHEN event_id % 70 = 0 THEN '' WHEN event_id % 50 = 0 THEN sha256(encode(props))
              ELSE {hmac_sql('props')} END AS signature
  FROM events)"""
    )
    + f"SELECT event_id, CASE WHEN signature IS NULL OR signature = '' THEN true ELSE signature = {hmac_sql('body')} END AS accepted FROM signed",
    "parse_value": with_(UPDATES, DIRTY, TEXTS_CTE)
    + f"SELECT seq, text, {int_parse_sql('text')} AS as_int, {float_parse_sql('text')} AS as_float FROM texts",
    "path_ingest": with_more(UPDATES, DIRTY, tail=PATH_INGEST),
    "lookup_bulk": with_more(UPDATES, DIRTY, REQUESTS, state_cte("state", "updates"), tail=LOOKUP_BULK),
    "lookup_rejected": with_more(
        UPDATES, DIRTY, VALIDATED, "requests AS (SELECT seq AS request_id, id, type FROM validated WHERE error IS NOT NULL)", state_cte("state", "updates"), tail=LOOKUP_BULK
    ),
    "lookup_json": with_more(UPDATES, DIRTY, REQUESTS, state_cte("state", "updates"), tail=LOOKUP_JSON),
    "value_path_lookup": with_more(UPDATES, DIRTY, REQUESTS, state_cte("state", "updates"), tail=VALUE_PATH_LOOKUP),
    "json_lookup_bodies": with_more(UPDATES, DIRTY, REQUESTS, state_cte("state", "updates"), tail=JSON_LOOKUP_BODIES),
    "lookup_miss": with_(UPDATES, DIRTY, REQUESTS, state_cte("state", "updates"))
    + """SELECT r.request_id, r.id, r.type FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.id = r.id AND s.type = r.type)""",
    "lookup_one": with_(UPDATES, state_cte("state", "updates"))
    + "SELECT id, type, delta, value FROM state WHERE id = 'click_8' AND type = 'counter'",
    "listing": with_(UPDATES, state_cte("state", "updates"))
    + f"SELECT id, type, 'ID: ' || id || ' Type: ' || type || ' Value: ' || {value_text_sql()} AS line FROM state",
    "metric_count": with_(UPDATES, state_cte("state", "updates")) + "SELECT count(*) AS total FROM state",
    "path_export": with_(UPDATES, DIRTY, GATED, state_cte("gstate", "gated"))
    + f"""SELECT id, type,
       CASE WHEN error IS NULL THEN '/update/' || type || '/' || id || '/' ||
            (CASE WHEN type = 'counter' THEN CAST(delta AS VARCHAR) ELSE {f3_sql('value')} END) END AS path,
       error
FROM (SELECT *, CASE WHEN type = 'counter' AND delta IS NULL THEN 'no metric''s data has been passed: field Delta is nil'
                     WHEN type = 'gauge' AND value IS NULL THEN 'no metric''s data has been passed: field Value in nil'
                     WHEN type IS NULL OR type NOT IN ('counter', 'gauge') THEN 'error occurred during route construction' END AS error
      FROM gstate) x""",
    "value_text": with_(UPDATES, DIRTY, GATED, state_cte("gstate", "gated"))
    + f"SELECT id, type, {value_text_sql()} AS text FROM gstate",
    "gauge_text": "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"{f3_sql(c)} AS {c}_text" for c in _LI_GAUGES)
    + " FROM lineitem",
    "debug_text": with_(UPDATES, state_cte("state", "updates"))
    + """SELECT id, type,
       CASE WHEN type = 'gauge' AND value IS NOT NULL
                 THEN printf('{ID: %s, MType: %s, Value: %s}', id, type, printf('%.0f', round_even(value, 0)))
            WHEN type <> 'gauge' AND delta IS NOT NULL
                 THEN printf('{ID: %s, MType: %s, Delta: %s}', id, type, CAST(delta AS VARCHAR)) END AS line
FROM state""",
    "metric_json": with_(UPDATES, DIRTY, GATED, state_cte("gstate", "gated"))
    + f"""SELECT id, type,
       '{{"id":' || to_json(id) || ',"type":' || to_json(type)
       || coalesce(',"delta":' || CAST(delta AS VARCHAR), '')
       || coalesce(',"value":' || {f3_sql('value')}, '') || '}}' AS json
FROM gstate""",
    "json_single_ingest": with_(UPDATES, DIRTY)
    + "SELECT seq, id, type, delta, value, CAST(NULL AS VARCHAR) AS decode_error FROM dirty",
    "json_batch_ingest": with_(UPDATES, DIRTY) + "SELECT seq, batch_id, pos, id, type, delta, value FROM dirty",
    "batch_outcome": with_(UPDATES, DIRTY, VALIDATED)
    + """SELECT batch_id, arg_min(error, pos) FILTER (WHERE error IS NOT NULL) AS error,
       CASE WHEN count(error) > 0 THEN 400 ELSE 200 END AS status
FROM validated GROUP BY batch_id""",
    "json_pipeline_state": with_(UPDATES, DIRTY, VALIDATED, ACCEPTED) + fold_sql("accepted"),
    "signed_pipeline_state": with_(UPDATES, DIRTY, VALIDATED, ACCEPTED)
    + fold_sql("(SELECT * FROM accepted WHERE batch_id % 7 <> 0) a"),
    "gzip_roundtrip": with_(UPDATES) + "SELECT id, type, delta, value FROM updates",
    "stream_fold_update": with_(UPDATES) + fold_sql("updates"),
    "sqlstate_class": f"""SELECT event_id, sqlstate,
       CASE WHEN sqlstate IN ({_RETRY}) THEN 'retryable' ELSE 'non_retryable' END AS class
FROM (SELECT event_id,
             CASE WHEN event_id % {_N_CODES + 1} < {_N_CODES}
                  THEN list_extract({_SQLSTATES}, CAST(event_id % {_N_CODES + 1} + 1 AS INTEGER)) END AS sqlstate
      FROM events) x""",
    "snapshot_roundtrip": with_(UPDATES) + fold_sql("updates"),
    "stream_state": with_(UPDATES) + fold_sql("updates"),
}
