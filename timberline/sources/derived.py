"""Log lines written from the columns of an ``events`` table.

One line per event, ``line_no = event_id``. They give every parser as many
lines as the table has rows, with known values behind each line, so a parsed
result can be checked against the columns it was written from. Some events
become garbage, blank lines or lines with missing parts.

The first lines of each log are regular enough for its type to be detected.
Decimals are written from whole hundredths (``cents``), never by formatting a
double, so the text is the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.sources.lines import spread
from timberline.sources.scratch import scratch_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "user_id", "ts", "event_type", "value"]
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "event_id AS i", "user_id AS u", "ts", "event_type AS e",
        "cast(rint(value * 100) AS bigint) AS cents",
        "concat('10.0.', user_id % 7, '.', user_id) AS ip",
        "CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' ELSE 'GET' END AS method",
        "CASE WHEN event_type = 'error' THEN 500 + event_id % 4 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status",
    )


def _decimal(units: str, places: int) -> str:
    """SQL for whole units of 10**-places as decimal text."""
    scale = 10**places
    return f"concat(({units}) div {scale}, '.', lpad(({units}) % {scale}, {places}, '0'))"


def _lines(df: DataFrame, source: str, value: str) -> DataFrame:
    return df.selectExpr(f"{source} AS source", "i AS line_no", f"{value} AS value")


def access_lines(spark: SparkSession, sf_dir: str, by_host: bool = False, zoned: bool = False) -> DataFrame:
    """Web-server access lines; ``by_host`` spreads them over three sources, ``zoned`` puts each in a zone of its own."""
    timing = f"""CASE WHEN i % 5 = 0 THEN '' ELSE concat(' "-" "ua/1.0" rt=', {_decimal('cents', 3)},
        CASE WHEN i % 7 = 0 THEN '' ELSE concat(' urt=', {_decimal('cents * 5', 4)}, ' uht=',
        {_decimal('cents * 2', 4)}, ' uct=', {_decimal('cents', 5)}) END) END"""
    local = "timestampadd(MINUTE, CASE u % 3 WHEN 1 THEN 330 WHEN 2 THEN -480 ELSE 0 END, ts)" if zoned else "ts"
    zone = "CASE u % 3 WHEN 1 THEN '+0530' WHEN 2 THEN '-0800' ELSE '+0000' END" if zoned else "'+0000'"
    value = f"""CASE WHEN i % 97 = 0 THEN concat('garbage ', i) WHEN i % 101 = 0 THEN '   ' ELSE
        concat(ip, ' - - [', date_format({local}, 'dd/MMM/yyyy:HH:mm:ss'), ' ', {zone}, '] "', method, ' /api/', e, '/', i % 23,
        ' HTTP/1.1" ', status, ' ', CASE WHEN i % 13 = 0 THEN '-' ELSE string(i * 37 % 10000) END, {timing}) END"""
    source = "concat('web', u % 3, '.log')" if by_host else "'access.log'"
    return _lines(_base(spark, sf_dir), source, value)


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = """CASE WHEN i % 89 = 0 THEN concat('broken ', i) ELSE
        concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [',
        CASE WHEN i % 5 = 0 THEN 'crit' WHEN i % 5 < 3 THEN 'error' ELSE 'warn' END, '] ', u, '#', i % 16, ':',
        CASE WHEN i % 6 = 0 THEN '' ELSE concat(' *', i) END, ' ',
        CASE WHEN i % 17 = 0 THEN 'accept() failed (24: Too many open files)' ELSE
        concat('upstream timed out (110) while reading, client: ', ip, ', server: s', i % 3) END) END"""
    return _lines(_base(spark, sf_dir), "'error.log'", value)


def container_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = """CASE e WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG'
        WHEN 'click' THEN 'note' ELSE 'INFO' END"""
    value = f"""CASE WHEN i % 83 = 0 THEN 'no time here'
        WHEN i % 9 = 0 AND i > 60 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' [', {level}, '] started ', i % 10)
        ELSE concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '.000Z ',
        CASE WHEN e = 'error' THEN 'stderr' ELSE 'stdout' END, CASE WHEN i % 4 = 0 THEN '' ELSE ' F' END, ' ',
        {level}, ' worker ', u, ' handled deadbeef ', i % 50) END"""
    return _lines(_base(spark, sf_dir), "'pod.log'", value)


def api_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = "CASE e WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'warning' ELSE 'info' END"
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    value = f"""CASE WHEN i % 79 = 0 THEN '{{"broken": ' WHEN i % 103 = 0 THEN 'nothing to see'
        WHEN i % 19 = 0 THEN concat({stamp}, 'Z [', upper({level}), '] plain ', i % 6)
        ELSE concat('{{"time":"', {stamp}, 'Z","level":"","severity":"', {level}, '"',
        CASE WHEN i % 12 = 0 THEN '' ELSE concat(',"http_method":"', method, '"') END,
        ',"url":"/api/', e, '/', i % 23, '","status":',
        CASE i % 10 WHEN 0 THEN 'null' WHEN 1 THEN concat('"', status, '"') WHEN 2 THEN concat(status, '.7')
        WHEN 3 THEN '"200.5"' ELSE string(status) END,
        CASE WHEN i % 8 = 0 THEN '' ELSE concat(',"duration":', {_decimal('cents * 10', 3)}) END,
        ',"msg":"m', i % 9, '","req_id":"r', i, '","shard":', i % 5, '}}') END"""
    return _lines(_base(spark, sf_dir), "'api.log'", value)


def database_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = """CASE i % 6 WHEN 0 THEN concat('UPDATE items SET n = ', i, ' WHERE id IN (1, 2, ', i, ')')
        WHEN 1 THEN 'COMMIT' WHEN 2 THEN concat('INSERT INTO audit VALUES (''u', u, ''', ', i, ')')
        ELSE concat('SELECT * FROM t', i % 4, ' WHERE id = ', i) END"""
    body = f"""CASE WHEN e = 'error' AND i % 3 = 0 THEN concat('ERROR:  deadlock detected by process ', i)
        WHEN e = 'error' THEN concat('ERROR:  relation "t', i % 7, '" does not exist')
        WHEN e = 'signup' AND i % 4 = 0 THEN concat('WARNING:  pool "p', i % 3, '" has ', i % 40, ' waiters')
        WHEN e = 'signup' AND i % 4 = 1 THEN concat('LOG:  replication lag: ', {_decimal('cents', 2)}, ' ',
            CASE WHEN i % 8 = 1 THEN 's' ELSE 'MB' END)
        WHEN e = 'signup' THEN concat('LOG:  checkpoint complete: wrote ', i % 900, ' buffers; write=',
            {_decimal('cents', 3)}, ' s, sync=', {_decimal('cents * 5', 4)}, ' s, total=', {_decimal('cents * 2', 3)}, ' s')
        WHEN e = 'view' THEN concat('LOG:  autovacuum: for table "public.t', i % 5, '": ', i % 50,
            ' dead tuples, ', i % 70, ' live tuples')
        WHEN i % 10 = 3 THEN concat('LOG:  statement: ', {verb})
        WHEN i % 10 = 7 THEN concat('LOG:  duration: ', {_decimal('cents * 1007', 3)}, ' ms')
        ELSE concat('LOG:  duration: ', {_decimal('cents * 1007', 3)}, ' ms  statement: ', {verb}) END"""
    value = f"""CASE WHEN i % 71 = 0 THEN 'psql: junk' WHEN i % 73 = 0 THEN 'LOG:  starting' ELSE
        concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '.000 UTC [', u % 40, '] ', {body}) END"""
    return _lines(_base(spark, sf_dir), "'postgresql.log'", value)


def system_lines(spark: SparkSession, sf_dir: str, by_host: bool = False, bsd: bool = False) -> DataFrame:
    """Syslog lines; ``by_host`` spreads them over three sources, ``bsd`` writes times without year."""
    stamp = """concat(date_format(ts, 'MMM'), ' ', lpad(dayofmonth(ts), 2, ' '), date_format(ts, ' HH:mm:ss'))""" if bsd else (
        """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")""")
    source = "concat('node', u % 3, '.log')" if by_host else "'syslog'"
    body = """CASE e WHEN 'error' THEN concat('sshd[', u + 1000, ']: Failed password for invalid user u', i % 12,
            ' from ', ip, ' port ', i % 60000, ' ssh2')
        WHEN 'signup' THEN concat('kernel: WARNING: CPU ', i % 8, ' at drivers/gpu/drm')
        WHEN 'view' THEN concat('kernel: trace line ', i)
        WHEN 'click' THEN concat('CRON[', i, ']: session opened for job ', i % 5)
        ELSE concat('app[', u, ']: level=error out of memory in pool ', i % 6) END"""
    value = f"""CASE WHEN i % 67 = 0 THEN '-- mark --' WHEN i % 59 = 0 THEN '' ELSE
        concat({stamp}, ' host', u % 3, ' ', {body}) END"""
    return _lines(_base(spark, sf_dir), source, value)


def anomaly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog lines whose messages go through all anomaly rules, event by event."""
    texts = ", ".join(f"'{t}'" for t in ANOMALY_TEXTS)
    value = f"""concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), ' host', u % 3, ' app[', u, ']: ',
        element_at(array({texts}), int(i % {len(ANOMALY_TEXTS)}) + 1), ' ', i)"""
    return _lines(_base(spark, sf_dir), "'syslog'", value)


# one message per rule, in the order of the rules; the last two match none
ANOMALY_TEXTS = [
    "WARNING: at drivers/gpu", "drm_WARN_ON(x)", "Tainted: [W]", "BUG: soft lockup", "RIP: 0010", "systemd[1] unit Failed",
    "exited with status 3", "systemd[1] x Deactivated successfully", "Xwayland exited unexpectedly", "GDM assertion x failed",
    "gnome-shell assertion y failed", "Unable to register client", "GLib-GIO ** critical", "assertion z failed", "Error: job failed",
    "operation timed out", "connection refused", "carrier lost", "Failed password for x", "authentication failure x", "invalid user bob",
    "permission denied", "sudo: bob NOT in sudoers", "i915 0000 WARN", "timeout waiting for PHY", "MCE seen", "thermal event",
    "livepatch update failed", "POST request to livepatch", "out of memory", "killed process", "I/O error on disk", "ext4 fs error",
    "xfs metadata error", "all is well", "level=error plain",
]


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV rows with a ``results`` column and no level."""
    told = """CASE i % 9 WHEN 0 THEN "{'matched': 'Y'}" WHEN 1 THEN concat("{'matched': 'N', 'error': 'no id ", i % 5, "'}")
        WHEN 2 THEN "{'matched': 'N'}" WHEN 3 THEN concat("{'error': 'bad input ", i % 4, "'}")
        WHEN 4 THEN concat("{'detail': ErrorDetail(string='denied ", i % 7, "', code='x')}")
        WHEN 5 THEN "{'non_field_errors': [ErrorDetail(string='expired', code='c')]}" WHEN 6 THEN "{'Token': 'abc'}"
        WHEN 7 THEN concat('plain, ', i) ELSE '' END"""
    header = spark.range(1).selectExpr("'results.csv' AS source", "bigint(0) AS line_no", "'timestamp,results,ip' AS value")
    rows = _base(spark, sf_dir).selectExpr(
        "'results.csv' AS source", "i + 1 AS line_no", f"""concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',"', {told}, '",', ip) AS value""")
    return header.unionByName(rows)


# two headers for one format: names that stand for one column compete, the longest wins
TWO_HEADERS = {"a.csv": "ts,time,msg,client_ip,elapsed", "b.csv": "Date,LogLevel,Body,ip,request_time"}


def two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV rows of two sources, even and odd events, each with a header of its own."""
    heads = spark.createDataFrame([(s, 0, h) for s, h in TWO_HEADERS.items()], "source string, line_no bigint, value string")
    rows = _base(spark, sf_dir).selectExpr(
        "CASE i % 2 WHEN 0 THEN 'a.csv' ELSE 'b.csv' END AS source", "i div 2 + 1 AS line_no",
        f"""CASE i % 2 WHEN 0 THEN concat('t', i, ',', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',m', i % 5, ',', ip, ',', {_decimal('cents', 2)})
        ELSE concat('d', i, ',', upper(e), ',m', i % 5, ',', ip, ',', date_format(ts, 'yyyy-MM-dd HH:mm:ss')) END AS value""")
    return heads.unionByName(rows)


CSV_HEADER = "timestamp,level,ip,path,http_method,status,duration,bytes,user,message,zone"


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV rows; the header is line 0, so event ``i`` is line ``i + 1``."""
    value = f"""CASE WHEN i % 61 = 0 THEN ',,,,' WHEN i % 53 = 0 THEN '' ELSE
        concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',',
        CASE WHEN e = 'error' THEN 'ERROR' WHEN e = 'signup' THEN 'WARN' WHEN e = 'view' AND i > 60 THEN '' ELSE 'INFO' END,
        ',', ip,
        ',/api/', e, ',', method, ', ', status, ' ,',
        CASE WHEN i % 8 = 0 THEN 'n/a' ELSE {_decimal('cents * 10', 3)} END, ',', i * 37 % 10000, ',u', u % 20,
        ',"a ""q"", ', i % 6, '",z', i % 3) END"""
    header = spark.range(1).selectExpr("'table.csv' AS source", "bigint(0) AS line_no", f"'{CSV_HEADER}' AS value")
    rows = _base(spark, sf_dir).selectExpr("'table.csv' AS source", "i + 1 AS line_no", f"{value} AS value")
    return header.unionByName(rows)


def _daily(lines: DataFrame, events_: DataFrame, name: str, shift: int = 0) -> DataFrame:
    """Lines of one log cut into a file per day of their event: ``(source, line_no, value)``, numbers not consecutive."""
    days = events_.selectExpr(f"event_id + {shift} AS line_no", "date_format(ts, 'yyyy-MM-dd') AS day")
    return lines.join(days, "line_no").selectExpr(f"{name} AS source", "line_no", "value")


def daily_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with real text files: the access log of three hosts in three zones, error log, API log and table, one file a day.

    A file is written by one task, as a log is by one host; files are dealt to all tasks.
    """
    base = events(spark, sf_dir).select("event_id", "ts")
    stem = "concat('access-', substring_index(source, '.', 1), '-', day, '.log')"
    out = _daily(access_lines(spark, sf_dir, by_host=True, zoned=True), base, stem)
    out = out.unionByName(_daily(error_lines(spark, sf_dir), base, "concat('error-', day, '.log')"))
    out = out.unionByName(_daily(api_lines(spark, sf_dir), base, "concat('api-', day, '.log')"))
    # a row without a level does not count as a table row when the type is detected
    full = csv_lines(spark, sf_dir).where("line_no > 0").selectExpr("source", "line_no", "regexp_replace(value, '^([^,]+),,', '$1,INFO,') AS value")
    rows = _daily(full, base, "concat('table-', day, '.csv')", 1)
    heads = base.selectExpr("concat('table-', date_format(ts, 'yyyy-MM-dd'), '.csv') AS source").distinct().selectExpr(
        "source", "bigint(0) AS line_no", f"'{CSV_HEADER}' AS value")
    out = out.unionByName(rows).unionByName(heads)
    path = scratch_dir(spark, "logs")
    out.repartition("source").sortWithinPartitions("source", "line_no").select("source", "value").write.partitionBy("source").text(path)
    return path


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven logs together, as one multi-source ``lines`` frame."""
    out = access_lines(spark, sf_dir)
    for more in (error_lines, container_lines, api_lines, database_lines, system_lines, csv_lines):
        out = out.unionByName(more(spark, sf_dir))
    return out
