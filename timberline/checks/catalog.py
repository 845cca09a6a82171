"""The registered queries: report outputs and operators over logs written from ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.checks import expected as x
from timberline.functions.clock import event_hour, event_instant
from timberline.functions.rules import level_from_words
from timberline.operators import frequency as fq
from timberline.operators import stats
from timberline.operators.context import context
from timberline.operators.detect import detect_types
from timberline.operators.entries import bookkeeping, client_of, entries, exclude_clients
from timberline.operators.positions import entry_index
from timberline.operators.search import pick, search
from timberline.operators.search_index import build, search_index
from timberline.operators.parse_csv import parse_csv
from timberline.operators.parse_system import parse_syslog
from timberline.plans import analyze as an
from timberline.plans import hours
from timberline.plans.options import Options
from timberline.plans.store import LogStore
from timberline.sinks.files import as_json, text_summary
from timberline.sinks.history import history_rows, list_reports
from timberline.sinks.timeline import read_ranked, write_clustered
from timberline.sources import derived
from timberline.sources.lines import lines_of
from timberline.sources.scratch import scratch_dir
from timberline.streaming import rollup

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}

LOGS = {
    "access": ("nginx_access", derived.access_lines), "error": ("nginx_error", derived.error_lines),
    "container": ("container", derived.container_lines), "api": ("api_backend", derived.api_lines),
    "database": ("postgres", derived.database_lines), "syslog": ("syslog", derived.system_lines),
    "csv": ("csv", derived.csv_lines),
}


def parsed(log: str, spark: SparkSession, sf_dir: str, options: Options = Options()) -> DataFrame:
    log_type, write = LOGS[log]
    return an.parse(write(spark, sf_dir), log_type, options)


def add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        EXPECTED[name] = sql


def output(log: str, key: str, sql: str, name: str | None = None, options: Options = Options(),
           shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register one report output."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = an.REPORTS[LOGS[log][0]][key](parsed(log, spark, sf_dir, options), options)
        return shape(df) if shape else df
    add(name or f"{log}_{key.replace('.', '_')}", run, sql)


def _codes(df: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("status_codes", lambda s: F.concat_ws(":", s["status"].cast("string"), s["count"].cast("string"))), "|")
    return df.withColumn("status_codes", text)


def _joined(*names: str) -> Callable[[DataFrame], DataFrame]:
    def shape(df: DataFrame) -> DataFrame:
        for n in names:
            df = df.withColumn(n, F.array_join(n, ","))
        return df
    return shape


# --- typed rows: the parse jobs -------------------------------------------------------------

def _typed(log: str, columns: list[str], sql: str) -> None:
    add(f"{log}_entries", lambda s, d: entries(parsed(log, s, d)).select("line_no", *columns), x.query(getattr(x, log.upper()), sql))


_typed("access", ["ip", "timestamp", "method", "path", "protocol", "status", "bytes", "referrer", "user_agent", "response_time",
                  "upstream_response_time", "upstream_header_time", "upstream_connect_time"],
       """SELECT line_no, ip, stamp AS "timestamp", method, path, 'HTTP/1.1' AS protocol, status, bytes,
  CASE WHEN rt IS NOT NULL THEN '-' END AS referrer, CASE WHEN rt IS NOT NULL THEN 'ua/1.0' END AS user_agent,
  rt AS response_time, urt AS upstream_response_time, uht AS upstream_header_time, uct AS upstream_connect_time FROM log""")
_typed("error", ["timestamp", "level", "pid", "tid", "cid", "client", "message"],
       """SELECT line_no, stamp AS "timestamp", level, pid, tid, cid, client, message FROM log""")
_typed("container", ["timestamp", "stream", "flag", "level", "message"],
       """SELECT line_no, stamp AS "timestamp", stream, flag, level, message FROM log""")
add("api_entries", lambda s, d: entries(parsed("api", s, d)).select(
    "line_no", "timestamp", "level", "method", "path", "status", "duration", "message", "request_id",
    F.try_element_at("extra", F.lit("shard")).alias("shard"), F.size("extra").alias("extra_keys")),
    x.query(x.API, """SELECT line_no, stamp AS "timestamp", level, method, path, status, duration, message, request_id, shard,
  CAST(CASE WHEN shard IS NULL THEN 0 ELSE 1 END AS INT) AS extra_keys FROM log"""))
_typed("database", ["timestamp", "pid", "level", "event", "message", "table", "stmt_type", "duration_ms", "slow", "normalized",
                    "vacuum_table", "dead_tuples", "live_tuples", "lag_value", "lag_unit"],
       """SELECT line_no, stamp AS "timestamp", pid, level, event, message, tbl AS "table", stmt_type, duration_ms,
  coalesce(duration_ms >= 10000, FALSE) AS slow, normalized, vacuum_table, dead_tuples, live_tuples, lag_value, lag_unit FROM log""")
_typed("syslog", ["timestamp", "hostname", "process", "pid", "message", "severity", "category", "is_auth_failure", "source_ip",
                  "user", "trace_line_count", "anomaly_type", "anomaly_detail"],
       """SELECT line_no, stamp AS "timestamp", hostname, process, pid, message, severity, category, is_auth_failure, source_ip,
  usr AS "user", CAST(trace_line_count AS INT) AS trace_line_count, anomaly_type, anomaly_detail FROM log""")
add("csv_entries", lambda s, d: entries(parsed("csv", s, d)).select(
    "line_no", "timestamp", "level", "message", "ip", "endpoint", "method", "status", "duration", "bytes", "user",
    F.try_element_at("extra", F.lit("zone")).alias("zone")),
    x.query(x.CSV, """SELECT line_no, stamp AS "timestamp", level, message, ip, endpoint, method, status,
  duration_text AS duration, CAST(bytes AS VARCHAR) AS bytes, usr AS "user", zone FROM log"""))

# --- line totals ----------------------------------------------------------------------------

_ALL = "(SELECT count(*) FROM base)"
_TOTALS = {
    "access": (x.ACCESS, _ALL, "(SELECT count(*) FROM base WHERE i % 97 = 0)"),
    "error": (x.ERROR, _ALL, "(SELECT count(*) FROM base WHERE i % 89 = 0)"),
    "container": (x.CONTAINER, _ALL, "(SELECT count(*) FROM base WHERE i % 83 = 0)"),
    "api": (x.API, _ALL, "(SELECT count(*) FROM base WHERE i % 79 = 0 OR i % 103 = 0)"),
    "database": (x.DATABASE, _ALL, "(SELECT count(*) FROM base WHERE i % 71 = 0)"),
    "syslog": (x.SYSLOG, _ALL, "(SELECT count(*) FROM kinds WHERE k = 'mark') + (SELECT count(*) FROM swallowed)"),
    "csv": (x.CSV, f"{_ALL} + 1", "(SELECT count(*) FROM base WHERE i % 61 = 0)"),
}
for _log, (_cte, _lines, _bad) in _TOTALS.items():
    add(f"{_log}_bookkeeping", lambda s, d, log=_log: bookkeeping(parsed(log, s, d)), x.bookkeeping(_cte, _lines, _bad))

# --- access log -----------------------------------------------------------------------------

_A = x.ACCESS
_HOURS = _A + f""",
hours AS (SELECT hour, count(*) AS requests, {x.stats('rt', 3)}, max(rt) AS top, {x.mean('rt')} AS exact,
  CAST(count(*) FILTER (WHERE rt > 30) AS BIGINT) AS slow_count FROM log GROUP BY 1),
bad AS (SELECT * FROM hours WHERE count > 0 AND (exact > 10 OR top > 30))"""
output("access", "summary", x.query(_HOURS, f"""SELECT CAST(count(*) AS BIGINT) AS total_requests,
  CAST(count(DISTINCT ip) AS BIGINT) AS unique_ips, CAST(count(DISTINCT path) AS BIGINT) AS unique_paths,
  CAST(sum(bytes) AS BIGINT) AS total_bytes,
  CASE WHEN sum(bytes) < 1024 THEN printf('%.2f B', CAST(sum(bytes) AS DOUBLE))
    WHEN sum(bytes) < 1048576 THEN printf('%.2f KB', CAST(sum(bytes) AS DOUBLE) / 1024)
    WHEN sum(bytes) < 1073741824 THEN printf('%.2f MB', CAST(sum(bytes) AS DOUBLE) / 1048576)
    ELSE printf('%.2f GB', CAST(sum(bytes) AS DOUBLE) / 1073741824) END AS total_bytes_human,
  {x.pct("count(*) FILTER (WHERE status >= 400)", "count(*)")} AS error_rate,
  CASE WHEN max(rt) > 30 THEN 'critical' WHEN {x.percentile('rt', '0.95')} > 10 OR max(rt) > 10 THEN 'degraded'
    ELSE 'healthy' END AS health,
  CAST((SELECT count(*) FROM bad) AS BIGINT) AS incident_count, {x.stats('rt')} FROM log"""))
output("access", "upstream_timing", x.query(_A, " UNION ALL ".join(
    f"SELECT '{v}' AS metric, {x.stats(v)} FROM log" for v in ("rt", "urt", "uht", "uct"))))
output("access", "charts.status_distribution", x.freq(_A, "CAST(status AS VARCHAR)"))
output("access", "charts.hourly_timeline", x.freq(_A, "hour"))
output("access", "charts.method_distribution", x.freq(_A, "method"))
output("access", "charts.top_endpoints", x.freq(_A, "path"))
output("access", "charts.top_ips", x.freq(_A, "ip"))
output("access", "charts.response_time_histogram", x.equal_count(_A, "rt", f"'≤' || CAST({x.rounded('top', 2)} AS VARCHAR)"))
output("access", "charts.bytes_distribution", x.equal_count(_A, "bytes", "'≤' || CAST(top AS VARCHAR)"))
output("access", "charts.rt_scatter", x.query(_A, f"""SELECT stamp AS t, {x.rounded('rt', 3)} AS rt, path, status FROM {x.INDEXED}
  WHERE entry_idx % greatest(1, (SELECT count(*) FROM log) // 500) = 0 AND rt IS NOT NULL"""))
_EP = f"""SELECT path, CAST(count(*) AS BIGINT) AS count, {x.pct('count(*) FILTER (WHERE status >= 400)', 'count(*)')} AS error_rate,
  {x.stats('rt', 3, 'rt_')} FROM log GROUP BY 1"""
output("access", "tables.endpoint_performance", x.query(_A, _EP))
output("access", "charts.endpoint_rt", x.query(_A, f"""SELECT path AS label, rt_avg AS avg, rt_p95 AS p95, rt_max AS max, count
  FROM ({_EP})"""))
output("access", "tables.ip_details", x.query(_A + """,
codes AS (SELECT ip, string_agg(status || ':' || n, '|' ORDER BY n DESC, f) AS status_codes FROM (
  SELECT ip, status, count(*) AS n, min(line_no) AS f FROM log GROUP BY 1, 2) GROUP BY 1)""",
    f"""SELECT ip, total, first_seen, last_seen, total_bytes, avg AS avg_rt, min AS min_rt, max AS max_rt, p95 AS p95_rt, status_codes
  FROM (SELECT ip, CAST(count(*) AS BIGINT) AS total, min(stamp) AS first_seen, max(stamp) AS last_seen,
    CAST(sum(bytes) AS BIGINT) AS total_bytes, {x.stats('rt', 3, '', ('avg', 'min', 'max', 'p95'))} FROM log GROUP BY 1)
  JOIN codes USING (ip)"""), shape=_codes)
output("access", "tables.status_codes", x.share(_A, "CAST(status AS VARCHAR)", "code"))
output("access", "tables.top_endpoints", x.share(_A, "path", "path"))
output("access", "tables.hourly_performance", x.query(_HOURS, """SELECT hour, CAST(requests AS BIGINT) AS requests, avg AS avg_rt,
  p95 AS p95_rt, max AS max_rt, CASE WHEN coalesce(max, 0) > 30 THEN 'critical' WHEN coalesce(avg, 0) > 10 THEN 'degraded'
  ELSE 'healthy' END AS status FROM hours"""))
output("access", "tables.incidents", x.query(_HOURS, """SELECT hour AS period,
  CASE WHEN top > 30 OR exact > 30 THEN 'critical' ELSE 'degraded' END AS severity, avg AS avg_rt, p95 AS p95_rt, max AS max_rt,
  count AS request_count, slow_count FROM bad"""))
_STRICT = Options(slow=5.0, critical=20.0)
output("access", "tables.incidents", x.query(_HOURS.replace("rt > 30", "rt > 20").replace("exact > 10 OR top > 30", "exact > 5 OR top > 20"),
       """SELECT hour AS period, CASE WHEN top > 20 OR exact > 20 THEN 'critical' ELSE 'degraded' END AS severity, avg AS avg_rt,
  p95 AS p95_rt, max AS max_rt, count AS request_count, slow_count FROM bad"""), "access_incidents_own_thresholds", _STRICT)
output("access", "dimensions", x.query(_A, " UNION ALL ".join(
    f"SELECT '{n}' AS dim, CAST({c} AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS value FROM log GROUP BY 2"
    for n, c in (("status", "status"), ("method", "method"), ("path", "path"), ("ip", "ip"), ("hour", "hour")))))
_SKIP = ("10.0.1.1", "10.0.2.2", "10.0.3.3")
_SKIP_SQL = ", ".join(f"'{a}'" for a in _SKIP)
output("access", "charts.top_ips", x.freq(_A, "ip", f"ip NOT IN ({_SKIP_SQL})"), "access_top_ips_excluding", Options(exclude=_SKIP))
add("access_bookkeeping_excluding", lambda s, d: bookkeeping(parsed("access", s, d), exclude=_SKIP),
    x.query(_A, f"""SELECT CAST((SELECT count(*) FROM base) AS BIGINT) AS total_lines, CAST(count(*) AS BIGINT) AS parsed,
  CAST((SELECT count(*) FROM base WHERE i % 97 = 0) AS BIGINT) AS parse_errors, min(stamp) AS time_start, max(stamp) AS time_end
  FROM log WHERE ip NOT IN ({_SKIP_SQL})"""))


def _exclude_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with an error event are the exclusion table: an anti join."""
    listed = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error' AND user_id % 2 = 0").select(
        F.expr("concat('10.0.', user_id % 7, '.', user_id)").alias("address"))
    kept = exclude_clients(entries(parsed("access", spark, sf_dir)), listed)
    return fq.frequencies(kept, F.col("ip"))


add("access_top_ips_excluding_table", _exclude_by_table, x.freq(
    _A, "ip", "ip NOT IN (SELECT ip FROM base WHERE e = 'error' AND u % 2 = 0)"))
add("access_event_hours", lambda s, d: entries(parsed("access", s, d)).groupBy(
    event_hour(F.col("timestamp")).alias("hour")).agg(F.count("*").alias("requests")),
    x.query(_A, """SELECT CAST(date_trunc('hour', CAST(stamp AS TIMESTAMP)) AS TIMESTAMP) AS hour, CAST(count(*) AS BIGINT) AS requests
  FROM log GROUP BY 1"""))
add("access_entry_index", lambda s, d: entry_index(entries(parsed("access", s, d)).select("source", "line_no"), 512).select(
    "line_no", "entry_idx"), x.query(_A, f"SELECT line_no, entry_idx FROM {x.INDEXED}"))
add("access_search", lambda s, d: search(an.ACCESS["tables.top_endpoints"](parsed("access", s, d), Options()), "ERROR/1"),
    x.query(_A, f"""SELECT * FROM (SELECT path, n AS count, {x.pct('n', '(SELECT count(*) FROM log)')} AS pct
  FROM (SELECT path, CAST(count(*) AS BIGINT) AS n FROM log GROUP BY 1)) WHERE contains(lower(path), 'error/1')"""))
add("access_click_filter", lambda s, d: pick(entries(parsed("access", s, d)), {"method": "PUT", "status": 404}).select(
    "line_no", "ip", "path"), x.query(_A, "SELECT line_no, ip, path FROM log WHERE method = 'PUT' AND status = 404"))

def _indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "search")
    build(entries(parsed("access", spark, sf_dir)).select("line_no", "ip", "method", "path", "status"), path, rows_per_block=256)
    return search_index(spark, path, "Signup/12")


add("access_search_index", _indexed_search, x.query(_A, """SELECT line_no, ip, method, path, status FROM log
  WHERE contains(lower(path), 'signup/12')"""))

# --- error log ------------------------------------------------------------------------------

_E = x.ERROR
output("error", "summary", x.query(_E, """SELECT CAST(count(*) AS BIGINT) AS total_errors,
  CAST(count(DISTINCT client) AS BIGINT) AS unique_clients, CAST(count(*) FILTER (WHERE level = 'crit') AS BIGINT) AS crit_count,
  CAST(count(*) FILTER (WHERE level = 'error') AS BIGINT) AS error_count,
  CAST(count(*) FILTER (WHERE level = 'warn') AS BIGINT) AS warn_count FROM log"""))
output("error", "charts.level_distribution", x.freq(_E, "level"))
output("error", "charts.hourly_timeline", x.freq(_E, "hour"))
output("error", "charts.top_clients", x.freq(_E, "client"))
output("error", "charts.top_messages", x.freq(_E, "form"))
output("error", "tables.levels", x.share(_E, "level", "level", extra=", CASE k WHEN 'crit' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS severity"))
output("error", "tables.top_clients", x.share(_E, "client", "client"))
output("error", "tables.top_messages", x.freq(_E, "form", name="message", count="count"))

# --- container log --------------------------------------------------------------------------

_C = x.CONTAINER
output("container", "summary", x.query(_C, f"""SELECT CAST(count(*) AS BIGINT) AS total_entries,
  CAST(count(*) FILTER (WHERE stream = 'stdout') AS BIGINT) AS stdout_count,
  CAST(count(*) FILTER (WHERE stream = 'stderr') AS BIGINT) AS stderr_count,
  CAST(count(*) FILTER (WHERE level = 'ERROR') AS BIGINT) AS error_count,
  CAST(count(*) FILTER (WHERE level = 'WARN') AS BIGINT) AS warn_count,
  {x.pct("count(*) FILTER (WHERE level = 'ERROR')", "count(*)")} AS error_rate FROM log"""))
output("container", "charts.level_distribution", x.freq(_C, "level"))
output("container", "charts.stream_distribution", x.freq(_C, "stream"))
output("container", "charts.hourly_timeline", x.freq(_C, "hour"))
output("container", "charts.top_errors", x.freq(_C, "form", "level = 'ERROR'"))
output("container", "tables.levels", x.share(_C, "level", "level"))


def _samples(cte: str, where: str, level: str = "level", length: int = 200) -> str:
    return x.query(cte, f"""SELECT stamp AS "timestamp", {level} AS level, left(message, {length}) AS message, entry_idx
  FROM {x.INDEXED} WHERE {where}""")


output("container", "tables.error_samples", _samples(_C, "level = 'ERROR'"))

# --- API log --------------------------------------------------------------------------------

_P = x.API
_RANK = ", CASE k WHEN 'error' THEN 4 WHEN 'warning' THEN 3 ELSE 2 END AS severity"
output("api", "summary", x.query(_P, f"""SELECT CAST(count(*) AS BIGINT) AS total_entries,
  CAST(count(*) FILTER (WHERE level = 'error') AS BIGINT) AS error_count,
  CAST(count(*) FILTER (WHERE level = 'warning') AS BIGINT) AS warn_count,
  CAST(count(DISTINCT path) AS BIGINT) AS unique_endpoints,
  {x.pct("count(*) FILTER (WHERE level = 'error')", "count(*)")} AS error_rate,
  avg AS avg_duration, p95 AS p95_duration, p99 AS p99_duration, max AS max_duration
  FROM log, (SELECT {x.stats('duration')} FROM log) GROUP BY ALL"""))
output("api", "charts.level_distribution", x.freq(_P, "level"))
output("api", "charts.hourly_timeline", x.freq(_P, "hour"))
output("api", "charts.top_endpoints", x.freq(_P, "path"))
output("api", "charts.method_distribution", x.freq(_P, "method"))
output("api", "charts.status_distribution", x.freq(_P, "CAST(status AS VARCHAR)"))
output("api", "charts.duration_histogram", x.equal_count(
    _P, "duration", f"'≤' || CAST({x.rounded('top', 2)} AS VARCHAR) || 's'", "greatest(1, n // 20)"))
_API_LABEL = "CASE WHEN length(left(message, 100)) > 80 THEN left(message, 80) || '...' ELSE left(message, 100) END"
output("api", "charts.top_errors", x.freq(_P, _API_LABEL, "level = 'error'"))
output("api", "tables.levels", x.share(_P, "level", "level", extra=_RANK))
_ENDPOINT = "CASE WHEN path IS NOT NULL THEN concat_ws(' ', method, path) END"
output("api", "tables.endpoint_details", x.query(_P, f"""SELECT {_ENDPOINT} AS endpoint, CAST(count(*) AS BIGINT) AS count,
  CAST(count(*) FILTER (WHERE level = 'error') AS BIGINT) AS errors,
  {x.pct("count(*) FILTER (WHERE level = 'error')", "count(*)")} AS error_rate,
  {x.stats('duration', 3, '', ('avg',)).replace('"avg"', 'avg_duration')},
  {x.stats('duration', 3, '', ('p95',)).replace('"p95"', 'p95_duration')},
  {x.stats('duration', 3, '', ('max',)).replace('"max"', 'max_duration')} FROM log WHERE path IS NOT NULL GROUP BY 1"""))
output("api", "tables.endpoint_statuses", x.query(_P, f"""SELECT {_ENDPOINT} AS endpoint, status, CAST(count(*) AS BIGINT) AS count
  FROM log WHERE path IS NOT NULL AND status IS NOT NULL GROUP BY 1, 2"""))
output("api", "tables.error_samples", _samples(_P, "level = 'error'"))

# --- database log ---------------------------------------------------------------------------

_D = x.DATABASE


def _n(where: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {where}) AS BIGINT)"


output("database", "summary", x.query(_D, f"""SELECT CAST(count(*) AS BIGINT) AS total_entries,
  {_n("event = 'statement'")} AS statements, {_n("event = 'error'")} AS errors, {_n("event = 'warning'")} AS warnings,
  {_n("event = 'checkpoint'")} AS checkpoints, {_n("duration_ms >= 10000")} AS slow_queries,
  {_n("stmt_type = 'SELECT'")} AS read_queries, {_n("stmt_type IN ('INSERT', 'UPDATE')")} AS write_queries,
  {_n("stmt_type = 'COMMIT'")} AS tx_ops, CAST(count(DISTINCT tbl) AS BIGINT) AS unique_tables,
  CAST(count(DISTINCT nullif(pid, 0)) AS BIGINT) AS unique_pids, {_n("event = 'lock'")} AS lock_events,
  {_n("event = 'autovacuum'")} AS autovacuum_events, {_n("event = 'replication'")} AS replication_events FROM log"""))
output("database", "charts.level_distribution", x.freq(_D, "level"))
output("database", "charts.stmt_type_distribution", x.freq(_D, "stmt_type"))
output("database", "charts.top_tables", x.freq(_D, "tbl"))
output("database", "charts.hourly_timeline", x.freq(_D, "hour"))
output("database", "charts.hourly_stmts", x.freq(_D, "hour", "stmt_type IS NOT NULL"))
output("database", "charts.hourly_errors", x.freq(_D, "hour", "level = 'ERROR'"))
output("database", "charts.top_warnings", x.freq(_D, "'pool \"X\" has N waiters'", "level = 'WARNING'"))
output("database", "charts.top_errors", x.query(_D, """SELECT left(message, 120) AS label, CAST(1 AS BIGINT) AS value FROM log
  WHERE level = 'ERROR'"""))
_CLASS = """CASE WHEN duration_ms < 1 THEN '< 1ms' WHEN duration_ms < 10 THEN '1-10ms' WHEN duration_ms < 50 THEN '10-50ms'
  WHEN duration_ms < 100 THEN '50-100ms' WHEN duration_ms < 500 THEN '100-500ms' WHEN duration_ms < 1000 THEN '500ms-1s'
  WHEN duration_ms < 5000 THEN '1-5s' WHEN duration_ms >= 5000 THEN '> 5s' END"""
output("database", "charts.duration_histogram", x.freq(_D, _CLASS))
output("database", "charts.top_tables_by_duration", x.query(_D, f"""SELECT tbl AS label,
  {x.rounded('CAST(sum(CAST(duration_ms AS DECIMAL(18,3))) AS DOUBLE)', 2)} AS value FROM log
  WHERE tbl IS NOT NULL AND duration_ms IS NOT NULL GROUP BY 1"""))
output("database", "charts.hourly_ckpt", x.freq(_D, "hour", "event = 'checkpoint'"))
output("database", "charts.lock_by_type", x.freq(_D, "'deadlock'", "event = 'lock'"))
output("database", "charts.lock_by_hour", x.freq(_D, "hour", "event = 'lock'"))
output("database", "charts.autovacuum_by_table", x.freq(_D, "vacuum_table"))
output("database", "charts.autovacuum_by_hour", x.freq(_D, "hour", "event = 'autovacuum'"))
output("database", "charts.replication_by_hour", x.freq(_D, "hour", "event = 'replication'"))
output("database", "checkpoint_metrics", x.query(_D, f"""SELECT CAST(count(*) AS BIGINT) AS count,
  {x.rounded(x.mean('total_s'), 3)} AS total_avg, {x.rounded('max(total_s)', 3)} AS total_max,
  {x.rounded(x.mean('write_s'), 3)} AS write_avg, {x.rounded(x.mean('sync_s'), 3)} AS sync_avg,
  CAST(CAST(printf('%.0f', CAST(sum(buffers) AS DOUBLE) / count(buffers)) AS DOUBLE) AS BIGINT) AS buffers_avg
  FROM log WHERE event = 'checkpoint'"""))
output("database", "duration_stats", x.query(_D, f"SELECT {x.stats('duration_ms', 2)} FROM log"))
output("database", "slow_queries", x.query(_D, """SELECT stamp AS "timestamp", pid, duration_ms, tbl AS "table", stmt_type,
  left(message, 300) AS message FROM log WHERE duration_ms >= 10000"""))
output("database", "normalized_queries", x.query(_D, f"""SELECT normalized, CAST(count(*) AS BIGINT) AS count,
  {x.rounded('coalesce(CAST(sum(CAST(duration_ms AS DECIMAL(18,3))) AS DOUBLE), 0) / count(*)', 2)} AS avg_duration_ms,
  min(tbl) AS sample_table, min(stmt_type) AS sample_stmt_type FROM log WHERE event = 'statement' GROUP BY 1"""))
output("database", "lock_events", x.query(_D, """SELECT stamp AS "timestamp", pid, level, left(message, 200) AS message
  FROM log WHERE event = 'lock'"""))
output("database", "autovacuum_events", x.query(_D, """SELECT stamp AS "timestamp", pid, vacuum_table AS "table", dead_tuples,
  live_tuples, left(message, 200) AS message FROM log WHERE event = 'autovacuum'"""))
output("database", "replication_events", x.query(_D, """SELECT stamp AS "timestamp", pid, level, left(message, 200) AS message,
  lag_value, lag_unit FROM log WHERE event = 'replication'"""))
output("database", "event_totals", x.query(_D, f"""SELECT {_n("event = 'lock'")} AS lock_total,
  {_n("event = 'autovacuum'")} AS autovacuum_total, {_n("event = 'replication'")} AS replication_total FROM log"""))
_LAG = "CAST(lag_value AS DOUBLE)"
_LAG_COLUMNS = f"""CAST(count(lag_value) AS BIGINT) AS count,
  {x.rounded('CAST(sum(CAST(lag_value AS DECIMAL(18,2))) AS DOUBLE) / count(lag_value)', 2)} AS avg,
  {x.rounded(f'max({_LAG})', 2)} AS max, {x.rounded(f'min({_LAG})', 2)} AS min"""
output("database", "lag_stats", x.query(_D, f"SELECT {_LAG_COLUMNS} FROM log WHERE event = 'replication'"))
output("database", "lag_stats_by_unit", x.query(_D, f"""SELECT CASE lag_unit WHEN 'M' THEN 'MB' ELSE lag_unit END AS lag_unit, {_LAG_COLUMNS}
  FROM log WHERE event = 'replication' GROUP BY 1"""))
output("database", "tables.levels", x.share(_D, "level", "level"))
output("database", "tables.statement_types", x.share(_D, "stmt_type", "stmt_type", of_labelled=True))
output("database", "tables.top_tables", x.share(_D, "tbl", "table", of_labelled=True))
output("database", "tables.error_samples", _samples(_D, "level = 'ERROR'"))
output("database", "tables.warning_samples", x.query(_D, """SELECT stamp AS "timestamp", 'WARNING' AS level,
  left(message, 200) AS message FROM log WHERE level = 'WARNING'"""))

# --- syslog ---------------------------------------------------------------------------------

_S = x.SYSLOG
output("syslog", "summary", x.query(_S, f"""SELECT CAST(count(*) AS BIGINT) AS total_entries,
  CAST(count(DISTINCT process) AS BIGINT) AS unique_processes, {_n('is_auth_failure')} AS auth_failures,
  CAST(count(DISTINCT source_ip) AS BIGINT) AS unique_source_ips, CAST(count(DISTINCT usr) AS BIGINT) AS unique_users_targeted,
  {_n("category = 'kernel' AND severity = 'WARN'")} AS kernel_warnings, {_n('trace_line_count > 0')} AS kernel_trace_blocks,
  CAST(sum(trace_line_count) AS BIGINT) AS kernel_trace_lines, {_n("severity = 'ERROR'")} AS error_count,
  {_n("severity = 'WARN'")} AS warn_count, {_n("severity = 'DEBUG'")} AS debug_count,
  CAST(count(DISTINCT hostname) AS BIGINT) AS unique_hostnames, CAST(count(anomaly_type) AS BIGINT) AS total_anomalies,
  CAST(count(DISTINCT anomaly_type) AS BIGINT) AS anomaly_types,
  {x.pct('count(*) FILTER (WHERE is_auth_failure)', 'count(*)')} AS auth_failure_rate FROM log"""))
output("syslog", "severity_distribution", x.freq(_S, "severity"))
output("syslog", "category_distribution", x.freq(_S, "category"))
output("syslog", "anomaly_summary", x.share(_S, "anomaly_type", "type"))
output("syslog", "charts.process_distribution", x.freq(_S, "process"))
output("syslog", "charts.hourly_timeline", x.freq(_S, "hour"))
output("syslog", "charts.top_source_ips", x.freq(_S, "source_ip"))
output("syslog", "charts.top_targeted_users", x.freq(_S, "usr"))
output("syslog", "charts.auth_fail_messages", x.query(_S, """SELECT CASE WHEN length(m) > 80 THEN left(m, 80) || '...' ELSE m END AS label,
  CAST(count(*) AS BIGINT) AS value FROM (SELECT left(message, 100) AS m FROM log WHERE is_auth_failure) GROUP BY m"""))
output("syslog", "charts.top_errors", x.freq(_S, "form", "severity IN ('ERROR', 'WARN')",
                                             limit="ORDER BY count(*) DESC, min(line_no) LIMIT 20"))
output("syslog", "charts.anomaly_timeline", x.freq(_S, "hour", "anomaly_type IS NOT NULL"))
output("syslog", "charts.anomaly_types", x.freq(_S, "anomaly_type"))
output("syslog", "tables.processes", x.share(_S, "process", "process"))
output("syslog", "tables.auth_failures_detail", x.query(_S, f"""SELECT stamp AS "timestamp", source_ip, usr AS "user",
  left(message, 150) AS message, entry_idx FROM {x.INDEXED} WHERE is_auth_failure"""))
output("syslog", "tables.top_source_ips", x.freq(_S, "source_ip", name="ip", count="count"))
output("syslog", "tables.error_samples", x.query(_S, f"""SELECT stamp AS "timestamp", severity AS level, left(message, 200) AS message,
  entry_idx FROM {x.INDEXED} WHERE severity = 'ERROR' ORDER BY entry_idx LIMIT 500"""))
output("syslog", "tables.anomaly_samples", x.query(_S, f"""SELECT anomaly_type AS type, arg_min(anomaly_detail, entry_idx) AS detail,
  left(arg_min(message, entry_idx), 200) AS sample_message, CAST(count(*) AS BIGINT) AS count, min(entry_idx) AS entry_idx
  FROM {x.INDEXED} WHERE anomaly_type IS NOT NULL GROUP BY 1"""))
output("syslog", "tables.anomaly_fingerprints", x.freq(_S, "form", "anomaly_type IS NOT NULL", "fingerprint", "count",
                                                       "ORDER BY count(*) DESC, min(line_no) LIMIT 50"))
output("syslog", "hour_by_severity", x.query(_S, "SELECT hour, severity, CAST(count(*) AS BIGINT) AS count FROM log GROUP BY 1, 2"))
output("syslog", "trace_sizes", x.query(_S, """SELECT 'syslog' AS source, fence AS line_no, CAST(count(*) AS BIGINT) AS swallowed
  FROM swallowed GROUP BY 2"""))

# --- CSV log --------------------------------------------------------------------------------

_T = x.CSV
output("csv", "summary", x.query(_T, f"""SELECT CAST(count(*) AS BIGINT) AS total_entries,
  'bytes,duration,endpoint,ip,level,message,method,status,timestamp,user' AS columns,
  '{derived.CSV_HEADER}' AS all_columns, {_n("level = 'ERROR'")} AS error_count,
  {x.pct("count(*) FILTER (WHERE level = 'ERROR')", 'count(*)')} AS error_rate, {_n("level = 'INFO'")} AS matches_found,
  {_n("level = 'WARN'")} AS no_match_count,
  {x.rounded(x.mean('duration'), 2)} AS avg_duration, {x.rounded(x.percentile('duration', '0.95'), 2)} AS p95_duration,
  {x.rounded(x.percentile('duration', '0.99'), 2)} AS p99_duration, {x.rounded('max(duration)', 2)} AS max_duration,
  {x.rounded('min(duration)', 2)} AS min_duration,
  CAST(count(DISTINCT ip) AS BIGINT) AS unique_ips, CAST(count(DISTINCT endpoint) AS BIGINT) AS unique_endpoints,
  CAST(sum(bytes) AS BIGINT) AS total_bytes,
  CASE WHEN sum(bytes) < 1048576 THEN printf('%.1f KB', CAST(sum(bytes) AS DOUBLE) / 1024)
    WHEN sum(bytes) < 1073741824 THEN printf('%.1f MB', CAST(sum(bytes) AS DOUBLE) / 1048576)
    ELSE printf('%.1f GB', CAST(sum(bytes) AS DOUBLE) / 1073741824) END AS total_bytes_human FROM log"""),
       shape=_joined("columns", "all_columns"))
output("csv", "charts.hourly_timeline", x.freq(_T, "hour"))
output("csv", "charts.daily_timeline", x.freq(_T, "day"))
output("csv", "charts.level_distribution", x.query(_T, "SELECT level AS label, CAST(count(*) AS BIGINT) AS value FROM log GROUP BY 1"))
output("csv", "charts.message_distribution", x.freq(_T, "message"))
output("csv", "charts.status_distribution", x.freq(_T, "status"))
output("csv", "charts.method_distribution", x.freq(_T, "method"))
output("csv", "charts.duration_histogram", x.query(_T + """,
top AS (SELECT max(duration) / 10 AS step FROM log),
filled AS (SELECT CAST(least(floor(duration / step), 9) AS INT) AS bucket, count(*) AS n FROM log, top
  WHERE duration IS NOT NULL GROUP BY 1)""", """SELECT CAST(b AS INT) AS bucket,
  printf('%.1f', b * step) || '-' || printf('%.1f', (b + 1) * step) AS label, CAST(coalesce(n, 0) AS BIGINT) AS value
  FROM range(10) AS r(b) CROSS JOIN top LEFT JOIN filled ON filled.bucket = b"""))
output("csv", "charts.top_ips", x.freq(_T, "ip"))
output("csv", "charts.top_endpoints", x.freq(_T, "endpoint"))
output("csv", "tables.daily_performance", x.query(_T, f"""SELECT day AS date, CAST(count(*) AS BIGINT) AS requests,
  {_n("level = 'ERROR'")} AS errors, {_n("level = 'WARN'")} AS warnings, {_n("level = 'INFO'")} AS info,
  {x.pct("count(*) FILTER (WHERE level = 'ERROR')", 'count(*)')} AS error_rate FROM log GROUP BY 1"""))
output("csv", "tables.levels", x.share(_T, "level", "level", keep_null=True))
output("csv", "tables.error_samples", _samples(_T, "level = 'ERROR'"))
output("csv", "tables.message_summary", x.share(_T, "message", "message"))
output("csv", "tables.status_codes", x.share(_T, "status", "status"))
output("csv", "tables.ip_details", x.query(_T, f"""SELECT ip, CAST(count(*) AS BIGINT) AS total, min(stamp) AS first_seen,
  max(stamp) AS last_seen, {_n("level = 'ERROR'")} AS error_count, CAST(count(DISTINCT usr) AS BIGINT) AS unique_users,
  {x.pct("count(*) FILTER (WHERE level = 'ERROR')", 'count(*)')} AS error_rate FROM log GROUP BY 1"""))
output("csv", "tables.endpoint_details", x.query(_T, f"""SELECT endpoint, CAST(count(*) AS BIGINT) AS total,
  CAST(count(DISTINCT ip) AS BIGINT) AS unique_ips, {_n("level = 'ERROR'")} AS error_count,
  CAST(count(DISTINCT usr) AS BIGINT) AS unique_users,
  {x.pct("count(*) FILTER (WHERE level = 'ERROR')", 'count(*)')} AS error_rate FROM log GROUP BY 1"""))
for _key, _pair in (("ip_endpoints", ("ip", "endpoint")), ("ip_methods", ("ip", "method")), ("ip_levels", ("ip", "level")),
                    ("endpoint_ips", ("endpoint", "ip")), ("endpoint_methods", ("endpoint", "method"))):
    output("csv", f"tables.{_key}", x.query(_T, f"""SELECT {_pair[0]}, {_pair[1]}, CAST(count(*) AS BIGINT) AS count FROM log
  WHERE {_pair[1]} IS NOT NULL GROUP BY 1, 2"""))
output("csv", "tables.all_rows", x.query(_T, """SELECT source, line_no, stamp AS "timestamp", level, message, ip, endpoint, method, status,
  duration_text AS duration, CAST(bytes AS VARCHAR) AS bytes, usr AS "user", '{"zone":"' || zone || '"}' AS extra FROM log"""),
       shape=lambda df: df.withColumn("extra", F.to_json("extra")))

def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(parse_csv(derived.result_lines(spark, sf_dir))).select("line_no", "timestamp", "level", "message", "ip")


add("csv_result_rules", _results, x.query(x.BASE, """SELECT i + 1 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", ip,
  CASE WHEN i % 9 IN (0, 6, 7) THEN 'INFO' WHEN i % 9 IN (1, 2) THEN 'WARN' WHEN i % 9 IN (3, 4, 5) THEN 'ERROR' END AS level,
  CASE i % 9 WHEN 0 THEN 'Match found' WHEN 1 THEN 'no id ' || (i % 5) WHEN 2 THEN 'No match' WHEN 3 THEN 'bad input ' || (i % 4)
    WHEN 4 THEN 'denied ' || (i % 7) WHEN 5 THEN 'expired' WHEN 6 THEN 'Token issued' WHEN 7 THEN 'plain, ' || i END AS message FROM base"""))


def _two_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(parse_csv(derived.two_tables(spark, sf_dir)).where("NOT is_header"))
    return rows.select("source", "line_no", "timestamp", "level", "message", "ip", "duration", F.try_element_at("extra", F.lit("ts")).alias("ts"),
                       F.try_element_at("extra", F.lit("Date")).alias("date"), F.array_join("mapped", ",").alias("mapped"))


add("csv_two_headers", _two_headers, x.query(x.BASE, """SELECT CASE i % 2 WHEN 0 THEN 'a.csv' ELSE 'b.csv' END AS source, i // 2 + 1 AS line_no,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", CASE WHEN i % 2 = 1 THEN upper(e) END AS level, 'm' || (i % 5) AS message, ip,
  CASE WHEN i % 2 = 0 THEN printf('%.2f', CAST(cents AS DOUBLE) / 100) END AS duration,
  CASE WHEN i % 2 = 0 THEN 't' || i END AS ts, CASE WHEN i % 2 = 1 THEN 'd' || i END AS date,
  CASE i % 2 WHEN 0 THEN 'timestamp,message,ip,duration' ELSE 'timestamp,level,message,ip' END AS mapped FROM base"""))

_WORD = """CASE i % 10 WHEN 0 THEN 'a FATAL b' WHEN 1 THEN 'kernel panic' WHEN 2 THEN 'ERR' WHEN 3 THEN 'an error' WHEN 4 THEN 'Warning!'
  WHEN 5 THEN 'info:' WHEN 6 THEN '[DBG]' WHEN 7 THEN 'x TRACE y' WHEN 8 THEN 'errors, warned' ELSE 'debug fatal' END"""
add("level_words", lambda s, d: derived.events(s, d).selectExpr("event_id AS i").selectExpr("i", f"{_WORD} AS text").select(
    "i", level_from_words(F.col("text"), with_trace=False).alias("level"), level_from_words(F.col("text")).alias("with_trace")),
    x.query(x.BASE, """SELECT i, CASE i % 10 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN'
  WHEN 5 THEN 'INFO' WHEN 6 THEN 'DEBUG' WHEN 7 THEN 'UNKNOWN' WHEN 8 THEN 'UNKNOWN' ELSE 'FATAL' END AS level,
  CASE i % 10 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'FATAL' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN'
  WHEN 5 THEN 'INFO' WHEN 6 THEN 'DEBUG' WHEN 7 THEN 'TRACE' WHEN 8 THEN 'UNKNOWN' ELSE 'FATAL' END AS with_trace FROM base"""))

# --- syslog: times without year, several hosts, every anomaly rule ----------------------------

add("syslog_bsd_entries", lambda s, d: entries(parse_syslog(derived.system_lines(s, d, bsd=True))).select(
    "line_no", "timestamp", event_instant(F.col("timestamp"), year=2024).alias("instant"), "hostname", "process", "pid", "message", "severity",
    "category", "trace_line_count", "anomaly_type"), x.query(x.SYSLOG_BSD, """SELECT line_no, stamp AS "timestamp",
  CAST(date_trunc('second', ts) AS TIMESTAMP) AS instant, hostname, process, pid, message, severity, category,
  CAST(trace_line_count AS INT) AS trace_line_count, anomaly_type FROM log"""))
add("syslog_bsd_hours", lambda s, d: an.SYSLOG["charts.hourly_timeline"](parse_syslog(derived.system_lines(s, d, bsd=True)), Options()),
    x.freq(x.SYSLOG_BSD, "hour"))


def _host_syslog(key: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return an.SYSLOG[key](parse_syslog(derived.system_lines(spark, sf_dir, by_host=True)), Options(by=("source",)))
    add(f"batch_syslog_{key.split('.')[-1]}", run, x.query(x.SYSLOG_BY_HOST, sql))


_host_syslog("severity_distribution", "SELECT source, severity AS label, CAST(count(*) AS BIGINT) AS value FROM log GROUP BY 1, 2")
_host_syslog("charts.top_errors", """SELECT source, form AS label, CAST(count(*) AS BIGINT) AS value FROM log WHERE severity IN ('ERROR', 'WARN')
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(line_no)) <= 20""")
_host_syslog("tables.error_samples", """SELECT source, stamp AS "timestamp", severity AS level, left(message, 200) AS message, entry_idx
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS BIGINT) AS entry_idx FROM log)
  WHERE severity = 'ERROR' QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= 500""")
_host_syslog("tables.anomaly_samples", """SELECT source, anomaly_type AS type, arg_min(anomaly_detail, entry_idx) AS detail,
  left(arg_min(message, entry_idx), 200) AS sample_message, CAST(count(*) AS BIGINT) AS count, min(entry_idx) AS entry_idx
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS BIGINT) AS entry_idx FROM log)
  WHERE anomaly_type IS NOT NULL GROUP BY 1, 2""")
_host_syslog("hour_by_severity", "SELECT source, hour, severity, CAST(count(*) AS BIGINT) AS count FROM log GROUP BY 1, 2, 3")
# type and description that the rules give to derived.ANOMALY_TEXTS, in their order
_FOUND = [
    ("kernel_warning", "Kernel driver warning"), ("kernel_warning", "DRM assertion failure"), ("kernel_warning", "Kernel tainted with WARN flag"),
    ("kernel_bug", "Kernel BUG triggered"), ("kernel_oops", "Kernel RIP (possible oops)"), ("service_failure", "systemd service failure"),
    ("service_failure", "Process exited with error status"), ("service_crash_loop", "Service deactivated (watch for restart loop)"),
    ("display_server", "Xwayland crash"), ("display_server", "GDM assertion failure"), ("display_server", "GNOME Shell assertion failure"),
    ("display_server", "GNOME session registration failure"), ("application_error", "GLib critical error"), ("application_error", "Assertion failure"),
    ("application_error", "Application error"), ("network_issue", "Network/service timeout"), ("network_issue", "Network unreachable/refused"),
    ("network_issue", "Network carrier issue"), ("security", "SSH failed password"), ("security", "Authentication failure"),
    ("security", "Invalid user login attempt"), ("security", "Permission/access denied"), ("security", "Unauthorized sudo attempt"),
    ("hardware", "Intel GPU driver warning"), ("network_issue", "Network/service timeout"), ("hardware", "Machine Check Exception"),
    ("hardware", "Thermal event"), ("livepatch", "Livepatch update failure"), ("livepatch", "Livepatch API failure"), ("oom", "Out of memory"),
    ("oom", "OOM killer invoked"), ("filesystem", "Disk I/O error"), ("filesystem", "ext4 filesystem error"), ("filesystem", "XFS filesystem error"),
    (None, ""), ("generic_error", None),
]


def _found(column: int) -> str:
    def text(v: str | None) -> str:
        return "NULL" if v is None else f"'{v}'"
    return f"[{', '.join(text(f[column]) for f in _FOUND)}][i % {len(_FOUND)} + 1]"


add("syslog_anomaly_rules", lambda s, d: entries(parse_syslog(derived.anomaly_lines(s, d))).select("line_no", "anomaly_type", "anomaly_detail"),
    x.query(x.BASE, f"""SELECT i AS line_no, {_found(0)} AS anomaly_type,
  coalesce({_found(1)}, 'Error from app: level=error plain ' || i) AS anomaly_detail FROM base"""))

# --- several sources ------------------------------------------------------------------------

_FIRST = "FROM base WHERE i < 50"
_DETECTED = f"""
SELECT 'access.log' AS source, 'nginx_access' AS log_type, n / 50.0::DOUBLE AS confidence, 'nginx_access:' || n AS scores
  FROM (SELECT count(*) AS n {_FIRST} AND i % 97 <> 0 AND i % 101 <> 0)
UNION ALL SELECT 'error.log', 'nginx_error', n / 50.0::DOUBLE, 'nginx_error:' || n || ',api_backend:' || n
  FROM (SELECT count(*) AS n {_FIRST} AND i % 89 <> 0)
UNION ALL SELECT 'pod.log', 'container', n / 50.0::DOUBLE, 'container:' || n || ',api_backend:' || n
  FROM (SELECT count(*) AS n {_FIRST} AND i % 83 <> 0)
UNION ALL SELECT 'api.log', 'api_backend', n / 50.0::DOUBLE, 'api_backend:' || n
  FROM (SELECT count(*) AS n {_FIRST} AND (i % 79 = 0 OR i % 103 <> 0))
UNION ALL SELECT 'postgresql.log', 'postgres', n / 50.0::DOUBLE, 'postgres:' || n || ',api_backend:' || n
  FROM (SELECT count(*) AS n {_FIRST} AND i % 71 <> 0)
UNION ALL SELECT 'syslog', 'syslog', n / 50.0::DOUBLE, 'syslog:' || n || ',api_backend:' || n
  FROM (SELECT count(*) AS n {_FIRST} AND i % 67 <> 0 AND i % 59 <> 0)
UNION ALL SELECT 'table.csv', 'csv', (n + 1) / 50.0::DOUBLE, 'api_backend:' || n || ',csv:' || (n + 1)
  FROM (SELECT count(*) AS n FROM base WHERE i < 49 AND i % 61 <> 0 AND i % 53 <> 0)"""


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("scores", F.array_join(F.transform(
        "scores", lambda s: F.concat_ws(":", s["type"], s["score"].cast("string"))), ",")).drop("filled")


add("detect_types", lambda s, d: _scores(detect_types(derived.all_lines(s, d))), x.query(x.BASE, _DETECTED))
add("typed_sources", lambda s, d: an.typed_sources(derived.all_lines(s, d)),
    x.query(x.BASE, f"SELECT source, log_type, confidence, CAST(NULL AS VARCHAR) AS error FROM ({_DETECTED})"))


def _renamed(cte: str, log: str) -> str:
    """One log's CTEs under names of their own, so that several logs fit in one query."""
    out = cte.strip().split("\n", 1)[1]
    out = out[out.index("FROM events)") + len("FROM events),"):]
    for name in ("log", "kinds", "fenced", "swallowed"):
        for before, after in ((f"\n{name} AS (", f"\n{log}_{name} AS ("), (f"FROM {name}", f"FROM {log}_{name}")):
            out = out.replace(before, after)
    return out.strip()


_ORDER = [("access", x.ACCESS, "nginx_access"), ("error", x.ERROR, "nginx_error"), ("container", x.CONTAINER, "container"),
          ("api", x.API, "api_backend"), ("database", x.DATABASE, "postgres"), ("syslog", x.SYSLOG, "syslog"), ("csv", x.CSV, "csv")]
_EVERY = x.BASE.strip() + ",\n" + ",\n".join(_renamed(cte, log) for log, cte, _ in _ORDER)
_BAD = {log: bad.replace("FROM kinds", "FROM syslog_kinds").replace("FROM swallowed", "FROM syslog_swallowed")
        for log, (_, _, bad) in _TOTALS.items()}
_SUMMARY = {
    "access": "method || ' ' || path || ' → ' || status", "error": "message", "container": "'[' || stream || '] ' || message",
    "api": "level || ': ' || message", "database": "level || ': ' || message", "syslog": "process || ': ' || message",
    "csv": """left('{"timestamp":"' || stamp || '","ip":"' || ip || '","endpoint":"' || endpoint || '","method":"' || method
      || '","status":"' || status || '","duration":"' || duration_text || '","bytes":"' || bytes || '","user":"' || usr, 120)""",
}
add("batch_overview", lambda s, d: an.batch_overview(derived.all_lines(s, d)), x.query(
    _EVERY + f",\nkind AS ({_DETECTED})", "SELECT source, log_type, confidence, CAST(NULL AS VARCHAR) AS error, t.* EXCLUDE (src) FROM kind JOIN ("
    + " UNION ALL ".join(f"""SELECT any_value(source) AS src, CAST({_TOTALS[log][1]} AS BIGINT) AS total_lines,
  CAST(count(*) AS BIGINT) AS parsed, CAST({_BAD[log]} AS BIGINT) AS parse_errors, min(nullif(stamp, '')) AS time_start,
  max(nullif(stamp, '')) AS time_end FROM {log}_log""" for log, _, _ in _ORDER) + ") t ON t.src = source"))
_TIMELINE = " UNION ALL ".join(f"""SELECT stamp AS "timestamp", '{t}' AS type, source, {_SUMMARY[log]} AS summary, line_no
  FROM {log}_log""" for log, _, t in _ORDER)
add("correlate_timeline", lambda s, d: an.correlate(derived.all_lines(s, d)).select(
    "timestamp", "type", "source", "summary", "line_no"), x.query(_EVERY, _TIMELINE))
add("correlate_type_counts", lambda s, d: an.type_counts(an.correlate(derived.all_lines(s, d))),
    x.query(_EVERY, f"SELECT type, CAST(count(*) AS BIGINT) AS events FROM ({_TIMELINE}) GROUP BY 1"))
add("correlate_totals", lambda s, d: an.timeline_totals(an.correlate(derived.all_lines(s, d))), x.query(
    _EVERY, f"SELECT CAST(count(*) AS BIGINT) AS total_events, CAST(count(DISTINCT source) AS BIGINT) AS sources FROM ({_TIMELINE})"))


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source of its own, its lines numbered without gaps."""
    parts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    return lines_of(parts, "line", "place", "doc_id")


add("document_lines", _document_lines, """SELECT CAST(doc_id AS VARCHAR) AS source, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no,
  unnest(parts) AS value FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)""")


def _by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.parse(derived.access_lines(spark, sf_dir, by_host=True), "nginx_access")


_PER_HOST = Options(by=("source",))


def _host_output(key: str, sql: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = an.ACCESS[key](_by_host(spark, sf_dir), _PER_HOST)
        return shape(df) if shape else df
    add(f"batch_access_{key.split('.')[-1]}", run, x.query(_A, sql))


_host_output("charts.top_ips", """SELECT host AS source, ip AS label, CAST(count(*) AS BIGINT) AS value FROM log GROUP BY 1, 2""")
_host_output("tables.status_codes", f"""SELECT host AS source, CAST(status AS VARCHAR) AS code, CAST(count(*) AS BIGINT) AS count,
  {x.pct('count(*)', 'sum(count(*)) OVER (PARTITION BY host)')} AS pct FROM log GROUP BY 1, 2""")
_host_output("upstream_timing", " UNION ALL ".join(
    f"SELECT host AS source, '{v}' AS metric, {x.stats(v)} FROM log GROUP BY 1" for v in ("rt", "urt", "uht", "uct")))
_host_output("tables.endpoint_performance", f"""SELECT host AS source, path, CAST(count(*) AS BIGINT) AS count,
  {x.pct('count(*) FILTER (WHERE status >= 400)', 'count(*)')} AS error_rate, {x.stats('rt', 3, 'rt_')} FROM log GROUP BY 1, 2""")
_HOSTS = ["web0.log", "web1.log", "web2.log"]
_COMPARED = {"total_requests": "count(*)", "unique_ips": "count(DISTINCT ip)", "total_bytes": "sum(bytes)"}
add("batch_compare", lambda s, d: an.compare(
    {"summary": an.ACCESS["summary"](_by_host(s, d), _PER_HOST)}, list(_COMPARED), _HOSTS),
    x.query(_A, " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(f"CAST({f} FILTER (WHERE host = '{h}') AS DOUBLE) AS \"{h}\"" for h in _HOSTS)
        + " FROM log" for m, f in _COMPARED.items())))


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = entries(parsed("access", spark, sf_dir)).select("source", "ip")
    c = entries(parsed("csv", spark, sf_dir)).select("source", "ip")
    sys = entries(parsed("syslog", spark, sf_dir))
    return an.shared_clients(a.unionByName(c).unionByName(sys.select("source", client_of(sys).alias("ip"))))


add("batch_shared_clients", _shared, x.query(_EVERY, """SELECT ip AS client, CAST(count(DISTINCT source) AS BIGINT) AS sources,
  CAST(count(*) AS BIGINT) AS rows FROM (SELECT source, ip FROM access_log UNION ALL SELECT source, ip FROM csv_log
  UNION ALL SELECT source, source_ip FROM syslog_log WHERE source_ip IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT source) > 1"""))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines around every critical error of the web-server error log."""
    lines = derived.error_lines(spark, sf_dir)
    picked = entry_index(entries(an.parse(lines, "nginx_error")).select("source", "line_no", "level")).where("level = 'crit'")
    return context(lines, picked, 2, 2).select("entry_idx", "center_line", "line_num", "is_match", "content")


add("error_context", _context, x.query(_E + f""",
lines AS (SELECT i AS line_num, CASE WHEN i % 89 = 0 THEN 'broken ' || i ELSE strftime(ts, '%Y/%m/%d %H:%M:%S') || ' ['
    || CASE WHEN i % 5 = 0 THEN 'crit' WHEN i % 5 < 3 THEN 'error' ELSE 'warn' END || '] ' || u || '#' || (i % 16) || ':'
    || CASE WHEN i % 6 = 0 THEN '' ELSE ' *' || i END || ' ' || CASE WHEN i % 17 = 0 THEN 'accept() failed (24: Too many open files)'
    ELSE 'upstream timed out (110) while reading, client: ' || ip || ', server: s' || (i % 3) END END AS content FROM base),
centers AS (SELECT line_no AS center_line, entry_idx FROM {x.INDEXED} WHERE level = 'crit')""",
    """SELECT entry_idx, center_line, line_num, line_num = center_line AS is_match, content FROM centers JOIN lines
  ON line_num BETWEEN center_line - 2 AND center_line + 2"""))

# --- real files: catalog, typed store, hourly states, timeline, line index --------------------


def _store(spark: SparkSession, sf_dir: str) -> LogStore:
    store = LogStore(spark, scratch_dir(spark, "store"))
    store.add(derived.daily_files(spark, sf_dir))
    return store


def _file_name() -> Column:
    return F.regexp_extract("source", "source=([^/]+)/", 1).alias("source")


def _files_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _store(spark, sf_dir).overview()
    return out.select(_file_name(), *[c for c in out.columns if c != "source"])


add("files_overview", _files_overview, x.query(x.FILES + f""",
seen AS (SELECT source, any_value(type) AS type, any_value(head) AS head, count(*) FILTER (WHERE line_no < 50) + any_value(head) AS n,
  count(*) FILTER (WHERE hit AND line_no < 50) + any_value(head) AS hits FROM filed GROUP BY 1)""",
    f"""SELECT source, s.type AS log_type, {x.rounded('least(1.0::DOUBLE, hits / n::DOUBLE)', 2)} AS confidence, CAST(NULL AS VARCHAR) AS error,
  CAST(count(*) + any_value(s.head) AS BIGINT) AS total_lines, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS parsed,
  CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS parse_errors, min(stamp) FILTER (WHERE ok) AS time_start,
  max(stamp) FILTER (WHERE ok) AS time_end FROM filed JOIN seen s USING (source) GROUP BY source, s.type, hits, n"""))
_ZONED_HOURS = _HOURS.replace(x.ACCESS, x.ZONED)
add("files_hourly_performance", lambda s, d: hours.hourly_performance(_store(s, d).hours()), x.query(
    _ZONED_HOURS, """SELECT hour, CAST(requests AS BIGINT) AS requests, avg AS avg_rt, p95 AS p95_rt, max AS max_rt,
  CASE WHEN coalesce(max, 0) > 30 THEN 'critical' WHEN coalesce(avg, 0) > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM hours"""))
add("files_incidents", lambda s, d: hours.incidents(_store(s, d).hours()), x.query(_ZONED_HOURS, """SELECT hour AS period,
  CASE WHEN top > 30 OR exact > 30 THEN 'critical' ELSE 'degraded' END AS severity, avg AS avg_rt, p95 AS p95_rt, max AS max_rt,
  count AS request_count, slow_count FROM bad"""))
add("files_daily_performance", lambda s, d: hours.daily(_store(s, d).hours()), x.query(x.ZONED, f"""SELECT day, CAST(count(*) AS BIGINT) AS requests,
  {x.pct('count(*) FILTER (WHERE status >= 400)', 'count(*)')} AS error_rate, CAST(sum(bytes) AS BIGINT) AS total_bytes, {x.stats('rt')}
  FROM log GROUP BY 1"""))


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct clients and paths per day, exactly, and whether the merged sketches are within 5 % of them."""
    store = _store(spark, sf_dir)
    rows = entries(store.table("nginx_access").withColumn("day", F.left("timestamp", F.lit(10))))
    exact = rows.groupBy("day").agg(F.count_distinct("ip").alias("ips"), F.count_distinct("path").alias("paths"))
    near = hours.distinct_estimates(store.distinct(), ["day"])
    return exact.join(near, "day").select(
        "day", "ips", "paths", (F.abs(F.col("unique_ips") - F.col("ips")) <= 0.05 * F.col("ips")).alias("ips_near"),
        (F.abs(F.col("unique_paths") - F.col("paths")) <= 0.05 * F.col("paths")).alias("paths_near"))


add("files_distinct_estimates", _estimates, x.query(x.ZONED, """SELECT day, CAST(count(DISTINCT ip) AS BIGINT) AS ips,
  CAST(count(DISTINCT path) AS BIGINT) AS paths, TRUE AS ips_near, TRUE AS paths_near FROM log GROUP BY 1"""))


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access files as a stream, a few at a time; files of later days come before earlier ones."""
    folder, out = derived.daily_files(spark, sf_dir), scratch_dir(spark, "rollup")
    rollup.start(spark, f"{folder}/source=access-*", out, scratch_dir(spark, "rollup-state"), "60 days", files_per_batch=40).awaitTermination()
    return hours.hourly_performance(rollup.read(spark, out))


add("stream_hourly_performance", _arriving, x.query(
    _HOURS, """SELECT hour, CAST(requests AS BIGINT) AS requests, avg AS avg_rt, p95 AS p95_rt, max AS max_rt,
  CASE WHEN coalesce(max, 0) > 30 THEN 'critical' WHEN coalesce(avg, 0) > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM hours"""))


def _event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of all files by real time, clustered and ranked."""
    path, keys = scratch_dir(spark, "timeline"), an.timeline_order(by_time=True)
    write_clustered(_store(spark, sf_dir).timeline(by_time=True), keys, path)
    return read_ranked(spark, path, keys).select("rank", "instant", "timestamp", "type", _file_name(), "line_no")


add("correlate_event_time", _event_time, x.query(x.FILES, """SELECT CAST(row_number() OVER (ORDER BY date_trunc('second', ts), source, line_no) AS BIGINT) AS rank,
  CAST(date_trunc('second', ts) AS TIMESTAMP) AS instant, stamp AS "timestamp", type, source, line_no FROM filed WHERE ok"""))


def _stored_context(log_type: str, level: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _store(spark, sf_dir)
        picked = entry_index(entries(store.table(log_type)).select("source", "line_no", "level")).where(F.col("level") == level)
        return store.context(picked, 5, 5).select(_file_name(), "entry_idx", "center_line", "line_num", "is_match", "content")
    return run


def _stored_context_sql(log_type: str, header: str) -> str:
    return x.query(x.FILES + f""",
text AS (SELECT source, line_no AS line_num, content FROM filed WHERE type = '{log_type}'{header}),
centers AS (SELECT source, line_no AS center_line, entry_idx FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS BIGINT) AS entry_idx FROM filed WHERE ok AND type = '{log_type}')
  WHERE e = 'error')""", """SELECT source, entry_idx, center_line, line_num, line_num = center_line AS is_match, content
  FROM centers JOIN text USING (source) WHERE line_num BETWEEN center_line - 5 AND center_line + 5""")


add("api_context", _stored_context("api_backend", "error"), _stored_context_sql("api_backend", ""))
add("csv_context", _stored_context("csv", "ERROR"), _stored_context_sql(
    "csv", f"\n  UNION ALL SELECT DISTINCT source, CAST(0 AS BIGINT), '{derived.CSV_HEADER}' FROM filed WHERE type = 'csv'"))

# --- sinks ----------------------------------------------------------------------------------

add("report_as_json", lambda s, d: as_json(an.ACCESS["charts.method_distribution"](parsed("access", s, d), Options()), "json"),
    x.query(_A, """SELECT '{"label":"' || method || '","value":' || count(*) || '}' AS json FROM log GROUP BY method"""))
add("report_text_summary", lambda s, d: text_summary(an.ERROR["summary"](parsed("error", s, d), Options()), "Error log").withColumn(
    "line_no", F.col("line_no").cast("bigint")),
    x.query(_E, """SELECT CAST(n AS BIGINT) AS line_no, line FROM (
  SELECT 0 AS n, 'Error log' AS line UNION ALL SELECT 1, 'total_errors: ' || count(*) FROM log
  UNION ALL SELECT 2, 'unique_clients: ' || count(DISTINCT client) FROM log
  UNION ALL SELECT 3, 'crit_count: ' || count(*) FROM log WHERE level = 'crit'
  UNION ALL SELECT 4, 'error_count: ' || count(*) FROM log WHERE level = 'error'
  UNION ALL SELECT 5, 'warn_count: ' || count(*) FROM log WHERE level = 'warn')"""))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of two reports, listed newest first with a text filter."""
    rows = None
    for n, log in enumerate(("error", "container", "api")):
        p = parsed(log, spark, sf_dir)
        t = LOGS[log][0]
        row = history_rows(an.REPORTS[t]["summary"](p, Options()), bookkeeping(p), t, an.LABELS[t], f"run {n}",
                           F.timestamp_seconds(F.lit(n)))
        rows = row if rows is None else rows.unionByName(row)
    return list_reports(rows, query="LOG").select("label", "log_type", "total_entries", "error_rate", "total_lines", "parsed")


def _history_part(label: str, log: str, t: str, entries_: str, rate: str) -> str:
    return f"""SELECT '{label}' AS label, '{t}' AS log_type, {entries_} AS total_entries, {rate} AS error_rate,
  CAST((SELECT count(*) FROM base) AS BIGINT) AS total_lines, CAST(count(*) AS BIGINT) AS parsed FROM {log}_log"""


add("report_history", _history, x.query(_EVERY, " UNION ALL ".join((
    _history_part("run 0", "error", "nginx_error", "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)"),
    _history_part("run 1", "container", "container", "CAST(count(*) AS BIGINT)",
                  x.pct("count(*) FILTER (WHERE level = 'ERROR')", "count(*)")),
    _history_part("run 2", "api", "api_backend", "CAST(count(*) AS BIGINT)",
                  x.pct("count(*) FILTER (WHERE level = 'error')", "count(*)"))))))

# --- the statistics on the given tables themselves ------------------------------------------

add("orders_price_by_status", lambda s, d: stats.describe(
    s.read.parquet(f"{d}/orders.parquet").where("o_totalprice IS NOT NULL"), ["o_orderstatus"], F.col("o_totalprice"), digits=2
).select("o_orderstatus", "count", "avg", "min", "p50", "p95", "p99", "max"),
    f"SELECT o_orderstatus, {x.stats('o_totalprice', 2)} FROM orders GROUP BY 1".replace("DECIMAL(18,5)", "DECIMAL(18,2)"))
add("lineitem_price_histogram", lambda s, d: stats.equal_count_histogram(
    s.read.parquet(f"{d}/lineitem.parquet"), F.col("l_extendedprice")),
    x.equal_count("log AS (SELECT l_extendedprice FROM lineitem)", "l_extendedprice", x.rounded("top", 2)).replace(
        " AS label", " AS upper"))
