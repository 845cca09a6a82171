"""SQL (DuckDB dialect) for the expected result of each registered query.

Expected rows are computed from the columns of ``events`` and never by reading
the derived log text, so a wrong parser cannot agree with itself.
``printf('%.2f', x)`` rounds on the exact binary value, half to even.
"""

from __future__ import annotations

BASE = """
base AS (
  SELECT event_id AS i, user_id AS u, ts, event_type AS e, CAST(round(value * 100) AS BIGINT) AS cents,
    '10.0.' || (user_id % 7) || '.' || user_id AS ip,
    CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method,
    CAST(CASE WHEN event_type = 'error' THEN 500 + event_id % 4 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS INT) AS status
  FROM events)"""

ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
ISO_HOUR = "strftime(ts, '%Y-%m-%d %H:00')"

ACCESS = BASE + f""",
log AS (
  SELECT 'access.log' AS source, 'web' || (u % 3) || '.log' AS host, i AS line_no, ip, {ISO} AS stamp, {ISO_HOUR} AS hour,
    method, '/api/' || e || '/' || (i % 23) AS path, status,
    CAST(CASE WHEN i % 13 = 0 THEN 0 ELSE i * 37 % 10000 END AS BIGINT) AS bytes,
    CASE WHEN i % 5 <> 0 THEN CAST(cents AS DOUBLE) / 1000 END AS rt,
    CASE WHEN i % 5 <> 0 AND i % 7 <> 0 THEN CAST(cents * 5 AS DOUBLE) / 10000 END AS urt,
    CASE WHEN i % 5 <> 0 AND i % 7 <> 0 THEN CAST(cents * 2 AS DOUBLE) / 10000 END AS uht,
    CASE WHEN i % 5 <> 0 AND i % 7 <> 0 THEN CAST(cents AS DOUBLE) / 100000 END AS uct
  FROM base WHERE i % 97 <> 0 AND i % 101 <> 0)"""

# access lines of three hosts, each in its own zone
SHIFT = "INTERVAL (CASE u % 3 WHEN 1 THEN 330 WHEN 2 THEN -480 ELSE 0 END) MINUTE"
ZONED = ACCESS.replace("strftime(ts, ", f"strftime(ts + {SHIFT}, ").replace(
    "SELECT 'access.log' AS source", f"SELECT 'access.log' AS source, strftime(ts + {SHIFT}, '%Y-%m-%d') AS day")

ERROR = BASE + f""",
log AS (
  SELECT 'error.log' AS source, i AS line_no, {ISO} AS stamp, {ISO_HOUR} AS hour,
    CASE WHEN i % 5 = 0 THEN 'crit' WHEN i % 5 < 3 THEN 'error' ELSE 'warn' END AS level,
    u AS pid, i % 16 AS tid, CASE WHEN i % 6 <> 0 THEN i END AS cid,
    CASE WHEN i % 17 <> 0 THEN ip END AS client,
    CASE WHEN i % 17 = 0 THEN 'accept() failed (24: Too many open files)'
      ELSE 'upstream timed out (110) while reading, client: ' || ip || ', server: s' || (i % 3) END AS message,
    CASE WHEN i % 17 = 0 THEN 'accept() failed (N: Too many open files)'
      ELSE 'upstream timed out (N) while reading, client: N.N.N.N, server: sN' END AS form
  FROM base WHERE i % 89 <> 0)"""

CONTAINER = BASE + f""",
log AS (
  SELECT 'pod.log' AS source, i AS line_no,
    CASE WHEN plain THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE {ISO} || '.000' END AS stamp,
    CASE WHEN plain THEN strftime(ts, '%H:00') ELSE {ISO_HOUR} END AS hour,
    CASE WHEN e = 'error' AND NOT plain THEN 'stderr' ELSE 'stdout' END AS stream,
    CASE WHEN NOT plain AND i % 4 <> 0 THEN 'F' END AS flag,
    CASE e WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'UNKNOWN'
      ELSE 'INFO' END AS level,
    CASE WHEN plain THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || word || '] started ' || (i % 10)
      ELSE word || ' worker ' || u || ' handled deadbeef ' || (i % 50) END AS message,
    CASE WHEN plain THEN 'N-N-N N:N:N [' || word || '] started N' ELSE word || ' worker N handled HASH N' END AS form
  FROM (SELECT *, i % 9 = 0 AND i > 60 AS plain,
    CASE e WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'note'
      ELSE 'INFO' END AS word FROM base)
  WHERE i % 83 <> 0)"""

API = BASE + f""",
log AS (
  SELECT 'api.log' AS source, i AS line_no, {ISO} || 'Z' AS stamp, {ISO_HOUR} AS hour, level,
    CASE WHEN NOT plain AND i % 12 <> 0 THEN method END AS method,
    CASE WHEN NOT plain THEN '/api/' || e || '/' || (i % 23) END AS path,
    CAST(CASE WHEN plain OR i % 10 IN (0, 3) THEN NULL ELSE status END AS BIGINT) AS status,
    CASE WHEN NOT plain AND i % 8 <> 0 THEN CAST(cents * 10 AS DOUBLE) / 1000 END AS duration,
    CASE WHEN plain THEN {ISO} || 'Z [' || upper(level) || '] plain ' || (i % 6) ELSE 'm' || (i % 9) END AS message,
    CASE WHEN NOT plain THEN 'r' || i END AS request_id,
    CASE WHEN NOT plain THEN CAST(i % 5 AS VARCHAR) END AS shard
  FROM (SELECT *, i % 19 = 0 AS plain,
    CASE e WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level FROM base)
  WHERE i % 79 <> 0 AND i % 103 <> 0)"""

DATABASE = BASE + f""",
kinds AS (
  SELECT *, CASE WHEN i % 73 = 0 THEN 'startup' WHEN e = 'error' AND i % 3 = 0 THEN 'lock' WHEN e = 'error' THEN 'error'
      WHEN e = 'signup' AND i % 4 = 0 THEN 'warning' WHEN e = 'signup' AND i % 4 = 1 THEN 'replication'
      WHEN e = 'signup' THEN 'checkpoint' WHEN e = 'view' THEN 'autovacuum'
      WHEN i % 10 = 7 THEN 'duration' ELSE 'statement' END AS event,
    CASE i % 6 WHEN 0 THEN 'UPDATE items SET n = ' || i || ' WHERE id IN (1, 2, ' || i || ')'
      WHEN 1 THEN 'COMMIT' WHEN 2 THEN 'INSERT INTO audit VALUES (''u' || u || ''', ' || i || ')'
      ELSE 'SELECT * FROM t' || (i % 4) || ' WHERE id = ' || i END AS sql,
    CASE i % 6 WHEN 0 THEN 'UPDATE items SET n = ? WHERE id IN (?)' WHEN 1 THEN 'COMMIT'
      WHEN 2 THEN 'INSERT INTO audit VALUES (''?'', ?)'
      ELSE 'SELECT * FROM t' || (i % 4) || ' WHERE id = ?' END AS shape
  FROM base WHERE i % 71 <> 0),
log AS (
  SELECT 'postgresql.log' AS source, i AS line_no, event,
    CASE WHEN event = 'startup' THEN '' ELSE {ISO} || '.000' END AS stamp,
    CASE WHEN event = 'startup' THEN 'unknown' ELSE {ISO_HOUR} END AS hour,
    CASE WHEN event = 'startup' THEN 0 ELSE u % 40 END AS pid,
    CASE event WHEN 'startup' THEN 'INFO' WHEN 'lock' THEN 'ERROR' WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARNING'
      ELSE 'LOG' END AS level,
    CASE event WHEN 'startup' THEN 'LOG:  starting' WHEN 'lock' THEN 'deadlock detected by process ' || i
      WHEN 'error' THEN 'relation "t' || (i % 7) || '" does not exist'
      WHEN 'warning' THEN 'pool "p' || (i % 3) || '" has ' || (i % 40) || ' waiters'
      WHEN 'replication' THEN 'replication lag: ' || printf('%.2f', CAST(cents AS DOUBLE) / 100) || ' '
        || CASE WHEN i % 8 = 1 THEN 's' ELSE 'MB' END
      WHEN 'checkpoint' THEN 'checkpoint complete: wrote ' || (i % 900) || ' buffers; write='
        || printf('%.3f', CAST(cents AS DOUBLE) / 1000) || ' s, sync=' || printf('%.4f', CAST(cents * 5 AS DOUBLE) / 10000)
        || ' s, total=' || printf('%.3f', CAST(cents * 2 AS DOUBLE) / 1000) || ' s'
      WHEN 'autovacuum' THEN 'autovacuum: for table "public.t' || (i % 5) || '": ' || (i % 50) || ' dead tuples, '
        || (i % 70) || ' live tuples'
      WHEN 'duration' THEN 'duration: ' || printf('%.3f', CAST(cents * 1007 AS DOUBLE) / 1000) || ' ms'
      ELSE CASE WHEN i % 10 = 3 THEN 'statement: ' || sql
        ELSE 'duration: ' || printf('%.3f', CAST(cents * 1007 AS DOUBLE) / 1000) || ' ms  statement: ' || sql END END AS message,
    CASE WHEN event = 'statement' THEN
      CASE i % 6 WHEN 0 THEN 'items' WHEN 1 THEN NULL WHEN 2 THEN 'audit' ELSE 't' || (i % 4) END END AS tbl,
    CASE WHEN event = 'statement' THEN
      CASE i % 6 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'COMMIT' WHEN 2 THEN 'INSERT' ELSE 'SELECT' END END AS stmt_type,
    CASE WHEN event = 'duration' OR (event = 'statement' AND i % 10 <> 3) THEN CAST(cents * 1007 AS DOUBLE) / 1000 END AS duration_ms,
    CASE WHEN event = 'statement' THEN shape END AS normalized,
    CASE WHEN event = 'autovacuum' THEN 'public.t' || (i % 5) END AS vacuum_table,
    CASE WHEN event = 'autovacuum' THEN i % 50 END AS dead_tuples,
    CASE WHEN event = 'autovacuum' THEN i % 70 END AS live_tuples,
    CASE WHEN event = 'replication' THEN printf('%.2f', CAST(cents AS DOUBLE) / 100) END AS lag_value,
    CASE WHEN event = 'replication' THEN CASE WHEN i % 8 = 1 THEN 's' ELSE 'M' END END AS lag_unit,
    CASE WHEN event = 'checkpoint' THEN CAST(cents * 2 AS DOUBLE) / 1000 END AS total_s,
    CASE WHEN event = 'checkpoint' THEN CAST(cents AS DOUBLE) / 1000 END AS write_s,
    CASE WHEN event = 'checkpoint' THEN CAST(cents * 5 AS DOUBLE) / 10000 END AS sync_s,
    CASE WHEN event = 'checkpoint' THEN i % 900 END AS buffers
  FROM kinds)"""

SYSLOG = BASE + f""",
kinds AS (
  SELECT *, CASE WHEN i % 67 = 0 THEN 'mark' WHEN i % 59 = 0 THEN 'blank' ELSE e END AS k FROM base),
fenced AS (
  SELECT *, last_value(CASE WHEN k = 'signup' THEN i WHEN k IN ('view', 'blank') THEN NULL ELSE -1 END IGNORE NULLS)
    OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fence FROM kinds),
swallowed AS (SELECT * FROM fenced WHERE k = 'view' AND fence >= 0),
log AS (
  SELECT 'syslog' AS source, i AS line_no, {ISO} AS stamp, {ISO_HOUR} AS hour, 'host' || (u % 3) AS hostname,
    CASE k WHEN 'error' THEN 'sshd' WHEN 'click' THEN 'CRON' WHEN 'purchase' THEN 'app' ELSE 'kernel' END AS process,
    CASE k WHEN 'error' THEN u + 1000 WHEN 'click' THEN i WHEN 'purchase' THEN u END AS pid,
    CASE k WHEN 'error' THEN 'Failed password for invalid user u' || (i % 12) || ' from ' || ip || ' port ' || (i % 60000) || ' ssh2'
      WHEN 'signup' THEN 'WARNING: CPU ' || (i % 8) || ' at drivers/gpu/drm' WHEN 'view' THEN 'trace line ' || i
      WHEN 'click' THEN 'session opened for job ' || (i % 5) ELSE 'level=error out of memory in pool ' || (i % 6) END AS message,
    CASE k WHEN 'error' THEN 'Failed password for invalid user u' || (i % 12) || ' from N.N.N.N port N ssh2'
      WHEN 'signup' THEN 'WARNING: CPU N at drivers/gpu/drm' WHEN 'view' THEN 'trace line N'
      WHEN 'click' THEN 'session opened for job N' ELSE 'level=error out of memory in pool N' END AS form,
    CASE k WHEN 'error' THEN 'WARN' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'ERROR' ELSE 'INFO' END AS severity,
    CASE k WHEN 'error' THEN 'security' WHEN 'click' THEN 'cron' WHEN 'purchase' THEN 'other' ELSE 'kernel' END AS category,
    k = 'error' AS is_auth_failure,
    CASE WHEN k = 'error' THEN ip END AS source_ip,
    CASE WHEN k = 'error' THEN 'u' || (i % 12) END AS usr,
    CASE WHEN k = 'signup' THEN 1 ELSE 0 END AS trace_line_count,
    CASE k WHEN 'error' THEN 'security' WHEN 'signup' THEN 'kernel_warning' WHEN 'purchase' THEN 'oom' END AS anomaly_type,
    CASE k WHEN 'error' THEN 'SSH failed password' WHEN 'signup' THEN 'Kernel driver warning'
      WHEN 'purchase' THEN 'Out of memory' ELSE '' END AS anomaly_detail
  FROM fenced WHERE k NOT IN ('mark', 'blank') AND NOT (k = 'view' AND coalesce(fence, -1) >= 0))"""

# syslog of three hosts, a source each; and with times that lack the year, where no line continues a trace
SYSLOG_BY_HOST = SYSLOG.replace("OVER (ORDER BY i ROWS", "OVER (PARTITION BY u % 3 ORDER BY i ROWS").replace(
    "SELECT 'syslog' AS source", "SELECT 'node' || (u % 3) || '.log' AS source")
SYSLOG_BSD = SYSLOG.replace(" AND NOT (k = 'view' AND coalesce(fence, -1) >= 0)", "").replace(
    f"{ISO} AS stamp", "strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') AS stamp, ts").replace(
    f"{ISO_HOUR} AS hour", "strftime(ts, '%H:00') AS hour")

CSV = BASE + """,
log AS (
  SELECT 'table.csv' AS source, i + 1 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
    strftime(ts, '%H:00') AS hour, strftime(ts, '%Y-%m-%d') AS day,
    CASE WHEN e = 'error' THEN 'ERROR' WHEN e = 'signup' THEN 'WARN' WHEN e = 'view' AND i > 60 THEN NULL ELSE 'INFO' END AS level,
    ip, '/api/' || e AS endpoint, method, CAST(status AS VARCHAR) AS status,
    CASE WHEN i % 8 = 0 THEN 'n/a' ELSE printf('%.3f', CAST(cents * 10 AS DOUBLE) / 1000) END AS duration_text,
    CASE WHEN i % 8 <> 0 THEN CAST(cents * 10 AS DOUBLE) / 1000 END AS duration,
    CAST(i * 37 % 10000 AS BIGINT) AS bytes, 'u' || (u % 20) AS usr, 'a "q", ' || (i % 6) AS message, 'z' || (i % 3) AS zone
  FROM base WHERE i % 61 <> 0 AND i % 53 <> 0)"""


def query(cte: str, body: str) -> str:
    return f"WITH {cte.strip()}\n{body}"


def rounded(expr: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {expr}) AS DOUBLE)"


def pct(part: str, whole: str) -> str:
    return rounded(f"CAST({part} AS DOUBLE) / {whole} * 100", 2)


def freq(cte: str, label: str, where: str = "TRUE", name: str = "label", count: str = "value", limit: str = "") -> str:
    return query(cte, f"""SELECT {label} AS "{name}", CAST(count(*) AS BIGINT) AS "{count}" FROM log
        WHERE ({where}) AND ({label}) IS NOT NULL GROUP BY 1 {limit}""")


def share(cte: str, label: str, name: str, of_labelled: bool = False, extra: str = "", keep_null: bool = False) -> str:
    total = f"(SELECT count({label}) FROM log)" if of_labelled else "(SELECT count(*) FROM log)"
    where = "" if keep_null else f"WHERE {label} IS NOT NULL"
    return query(cte, f"""SELECT k AS "{name}", n AS count, {pct('n', total)} AS pct{extra}
        FROM (SELECT {label} AS k, CAST(count(*) AS BIGINT) AS n FROM log {where} GROUP BY 1)""")


def percentile(v: str, p: str) -> str:
    n = f"count({v})"
    at = f"CAST(least(floor({n} * {p}::DOUBLE), {n} - 1) AS BIGINT) + 1"
    return f"list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL))[{at}]"


def mean(v: str, places: int = 5) -> str:
    return f"CAST(sum(CAST({v} AS DECIMAL(18,{places}))) AS DOUBLE) / count({v})"


def stats(v: str, digits: int = 3, prefix: str = "", only: tuple[str, ...] | None = None) -> str:
    """Columns count, avg, min, p50, p95, p99, max of a value."""
    def guarded(expr: str) -> str:
        return f"CASE WHEN count({v}) > 0 THEN {rounded(expr, digits)} END"
    cols = {
        "count": f"CAST(count({v}) AS BIGINT)", "avg": guarded(mean(v)), "min": guarded(f"min({v})"),
        "p50": guarded(percentile(v, "0.50")), "p95": guarded(percentile(v, "0.95")),
        "p99": guarded(percentile(v, "0.99")), "max": guarded(f"max({v})"),
    }
    return ", ".join(f'{e} AS "{prefix}{n}"' for n, e in cols.items() if only is None or n in only)


def equal_count(cte: str, v: str, label: str, step: str = "greatest(1, n // least(n, 20))") -> str:
    ranked = f"""{cte},
ranked AS (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS n
  FROM (SELECT {v} AS v FROM log WHERE {v} IS NOT NULL)),
cut AS (
  SELECT CAST(rn // ({step}) AS BIGINT) AS bucket, max(v) AS top, CAST(count(*) AS BIGINT) AS value FROM ranked GROUP BY 1)"""
    return query(ranked, f"SELECT bucket, {label} AS label, value FROM cut")


INDEXED = "(SELECT *, CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS entry_idx FROM log)"


def bookkeeping(cte: str, lines: str, errors: str) -> str:
    return query(cte, f"""SELECT CAST({lines} AS BIGINT) AS total_lines, CAST(count(*) AS BIGINT) AS parsed,
      CAST({errors} AS BIGINT) AS parse_errors, min(nullif(stamp, '')) AS time_start, max(nullif(stamp, '')) AS time_end FROM log""")


# --- files of a day ---------------------------------------------------------------------------

_API_LEVEL = "CASE e WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warning' ELSE 'info' END"
API_TEXT = f"""CASE WHEN i % 79 = 0 THEN '{{"broken": ' WHEN i % 103 = 0 THEN 'nothing to see'
    WHEN i % 19 = 0 THEN {ISO} || 'Z [' || upper({_API_LEVEL}) || '] plain ' || (i % 6)
    ELSE '{{"time":"' || {ISO} || 'Z","level":"","severity":"' || {_API_LEVEL} || '"'
      || CASE WHEN i % 12 = 0 THEN '' ELSE ',"http_method":"' || method || '"' END || ',"url":"/api/' || e || '/' || (i % 23) || '","status":'
      || CASE i % 10 WHEN 0 THEN 'null' WHEN 1 THEN '"' || status || '"' WHEN 2 THEN status || '.7' WHEN 3 THEN '"200.5"'
           ELSE CAST(status AS VARCHAR) END
      || CASE WHEN i % 8 = 0 THEN '' ELSE ',"duration":' || printf('%.3f', CAST(cents * 10 AS DOUBLE) / 1000) END
      || ',"msg":"m' || (i % 9) || '","req_id":"r' || i || '","shard":' || (i % 5) || '}}' END"""
CSV_TEXT = """CASE WHEN i % 61 = 0 THEN ',,,,' WHEN i % 53 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ','
    || CASE WHEN e = 'error' THEN 'ERROR' WHEN e = 'signup' THEN 'WARN' ELSE 'INFO' END || ',' || ip || ',/api/' || e || ',' || method
    || ', ' || status || ' ,' || CASE WHEN i % 8 = 0 THEN 'n/a' ELSE printf('%.3f', CAST(cents * 10 AS DOUBLE) / 1000) END || ','
    || (i * 37 % 10000) || ',u' || (u % 20) || ',"a ""q"", ' || (i % 6) || '",z' || (i % 3) END"""
# each event's line in the file of its log and day; ok tells the entries, hit the lines that have a mark of the file's type
FILES = BASE + f""",
dealt AS (
  SELECT 'access-web' || (u % 3) || '-' || strftime(ts, '%Y-%m-%d') || '.log' AS source, 'nginx_access' AS type, i, ts, 0 AS head,
    i % 97 <> 0 AND i % 101 <> 0 AS ok, i % 97 = 0 AS bad, i % 97 <> 0 AND i % 101 <> 0 AS hit,
    strftime(ts + {SHIFT}, '%Y-%m-%dT%H:%M:%S') AS stamp, 'x' AS content, e FROM base
  UNION ALL SELECT 'error-' || strftime(ts, '%Y-%m-%d') || '.log', 'nginx_error', i, ts, 0, i % 89 <> 0, i % 89 = 0, i % 89 <> 0, {ISO}, 'x', e FROM base
  UNION ALL SELECT 'api-' || strftime(ts, '%Y-%m-%d') || '.log', 'api_backend', i, ts, 0, i % 79 <> 0 AND i % 103 <> 0,
    i % 79 = 0 OR i % 103 = 0, i % 79 = 0 OR i % 103 <> 0, {ISO} || 'Z', {API_TEXT}, e FROM base
  UNION ALL SELECT 'table-' || strftime(ts, '%Y-%m-%d') || '.csv', 'csv', i, ts, 1, i % 61 <> 0 AND i % 53 <> 0, i % 61 = 0,
    i % 61 <> 0 AND i % 53 <> 0, strftime(ts, '%Y-%m-%d %H:%M:%S'), {CSV_TEXT}, e FROM base),
filed AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY i) - 1 + head AS BIGINT) AS line_no FROM dealt)"""
