from pyspark.sql import functions as F

from timberline.operators.entries import bookkeeping, entries, exclude_clients, parse_address_list
from timberline.operators.parse_app import parse_api, parse_container
from timberline.operators.parse_csv import parse_csv
from timberline.operators.parse_database import parse_database
from timberline.operators.parse_system import parse_syslog
from timberline.operators.parse_web import parse_access, parse_error
from timberline.sources.lines import lines_from_files, lines_from_text

FULL = ('172.20.8.41 - priya [03/Nov/2024:06:17:52 +0100] "PUT /cart/77/items HTTP/2.0" 207 58812 "https://shop.test/cart" "probe/2.4" '
        "rt=1.75 urt=1.5 uht=0.75 uct=0.25")
SHORT = '10.44.3.9 - - [03/Nov/2024:06:18:01 +0100] "DELETE /session HTTP/1.1" 403 0'
DASH = '10.44.3.9 - - [03/Nov/2024:06:18:02 +0100] "OPTIONS /ping HTTP/1.1" 304 -'


def parse(spark, parser, *lines):
    return parser(lines_from_text(spark, "\n".join(lines))).orderBy("line_no")


def rows(df):
    return [r.asDict(recursive=True) for r in entries(df).orderBy("line_no").collect()]


def test_access(spark):
    got = rows(parse(spark, parse_access, FULL, SHORT, DASH, "junk", SHORT.replace(" 0", " x"), FULL + " extra=1"))
    assert len(got) == 4
    assert (got[0]["ip"], got[0]["timestamp"], got[0]["status"], got[0]["bytes"]) == ("172.20.8.41", "2024-11-03T06:17:52", 207, 58812)
    assert (got[0]["response_time"], got[0]["upstream_connect_time"]) == (1.75, 0.25)
    assert (got[0]["referrer"], got[0]["user_agent"]) == ("https://shop.test/cart", "probe/2.4")
    assert got[1]["response_time"] is None and got[1]["referrer"] is None
    assert got[2]["bytes"] == 0
    assert got[3]["response_time"] == 1.75


def test_error(spark):
    got = rows(parse(
        spark, parse_error,
        '2024/11/03 06:20:11 [error] 88#91: *4407 open() failed, client: 172.20.8.41, server: shop.test, request: "PUT /cart HTTP/2.0"',
        "2024/11/03 06:20:12 [alert] 88#91: worker process left on signal 9",
        "2024/11/03 06:20:13 [warn] 3#4: peer 10.1.2.3 answers late", "no"))
    assert [r["client"] for r in got] == ["172.20.8.41", None, "10.1.2.3"]
    assert (got[0]["pid"], got[0]["tid"], got[0]["cid"], got[0]["level"]) == (88, 91, 4407, "error")
    assert got[1]["cid"] is None and got[1]["timestamp"] == "2024-11-03T06:20:12"


def test_container(spark):
    got = rows(parse(
        spark, parse_container,
        "2024-11-03T07:02:09.118204Z stderr F FATAL: volume is full", "2024-11-03T07:02:10Z stdout ERROR bad",
        "2024-11-03 07:05:00 [INFO] Listening at /run/app.sock", "2024-11-03 07:05:00", "short"))
    assert [(r["stream"], r["flag"], r["level"]) for r in got] == [
        ("stderr", "F", "FATAL"), ("stdout", None, "ERROR"), ("stdout", None, "INFO")]
    assert got[0]["timestamp"] == "2024-11-03T07:02:09.118204"
    assert got[2]["message"] == "2024-11-03 07:05:00 [INFO] Listening at /run/app.sock"


def test_syslog(spark):
    got = rows(parse(
        spark, parse_syslog,
        "Nov  3 05:41:07 edge7 sshd[8120]: Failed password for olga from 172.30.4.5 port 40022 ssh2",
        "2024-11-03T05:41:09.007+01:00 edge7 sshd[8121]: Failed password for invalid user deploy from 10.44.3.9 port 40031 ssh2",
        "Nov  3 05:42:00 edge7 cron: nothing to do", "not syslog"))
    assert [r["severity"] for r in got] == ["WARN", "WARN", "INFO"]
    assert (got[0]["source_ip"], got[0]["user"], got[0]["pid"]) == ("172.30.4.5", "172.30.4.5", 8120)
    assert (got[1]["user"], got[1]["anomaly_type"], got[1]["anomaly_detail"]) == ("deploy", "security", "SSH failed password")
    assert (got[2]["pid"], got[2]["category"], got[2]["anomaly_type"]) == (None, "cron", None)


def test_syslog_anomaly_generic(spark):
    got = rows(parse(
        spark, parse_syslog, "Feb 23 16:45:00 h app: FATAL stop", "Feb 23 16:45:00 h app: ERROR seen",
        "Feb 23 16:45:00 h app: WARNING seen", "Feb 23 16:45:00 h kernel: Hardware name: Box"))
    assert [r["anomaly_type"] for r in got] == ["fatal_error", "generic_error", "generic_warning", "kernel_trace_block"]
    assert [r["anomaly_detail"] for r in got] == ["Fatal: FATAL stop", "Error from app: ERROR seen", "Warning from app: WARNING seen", ""]


def test_api_json(spark):
    got = rows(parse(
        spark, parse_api,
        '{"timestamp":"2031-02-23T16:45:00Z","level":"INFO","method":"GET","path":"/a","status":200,"duration":0.5,"message":"ok","request_id":"r1","k":{"x":1}}',
        '{"time":"2031-02-23T16:45:00Z","severity":"error","http_method":"PUT","url":"/carts/9","status":503,"duration":2.25,"msg":"no stock left"}',
        '{"level":0,"severity":"","lvl":50,"status":200.7,"duration":"2.5","message":"0"}',
        '{"status":"200.5","duration":true,"message":0,"msg":"second"}', '{"status":"404"}', '{"broken": '))
    assert len(got) == 5
    assert got[0]["extra"] == {"k": '{"x":1}'} and got[0]["level"] == "info"
    assert (got[1]["method"], got[1]["path"], got[1]["status"], got[1]["message"]) == ("PUT", "/carts/9", 503, "no stock left")
    assert (got[2]["level"], got[2]["status"], got[2]["duration"], got[2]["message"]) == ("50", 200, 2.5, "0")
    assert (got[3]["level"], got[3]["status"], got[3]["duration"], got[3]["message"]) == ("info", None, 1.0, "second")
    assert got[4]["status"] == 404 and got[4]["timestamp"] == ""


def test_api_text(spark):
    got = rows(parse(
        spark, parse_api, "2031-02-23T16:45:00Z [ERROR] Upstream gone", "2031-02-23 16:45:00 WARN slow",
        'x 2031/02/23 16:45:00.5 "level": "debug" y', "2031-02-23T16:45:00Z nothing"))
    assert [r["level"] for r in got] == ["error", "warn", "debug"]
    assert got[0]["message"] == "2031-02-23T16:45:00Z [ERROR] Upstream gone" and got[0]["extra"] == {}
    assert got[2]["timestamp"] == "2031/02/23 16:45:00.5"


def test_database_events(spark):
    head = "2031-02-23 16:45:01.782 UTC [6071] "
    got = rows(parse(
        spark, parse_database,
        head + "LOG:  duration: 231.250 ms  statement: SELECT * FROM parcels WHERE id = 77", head + "LOG:  statement: BEGIN",
        head + "LOG:  duration: 12000 ms", head + "ERROR:  deadlock detected", head + 'ERROR:  relation "x" does not exist',
        head + 'LOG:  autovacuum: for table "public.parcels": 61 dead tuples, 933 live tuples',
        head + "LOG:  replication lag: 12.5 ms", head + "LOG:  checkpoint complete: wrote 10 buffers; total=1.5 s",
        head + "LOG:  database system is ready to accept connections", head + "LOG:  database system was in recovery",
        head + "LOG:  listening on IPv4", head + "WARNING:  careful", head + "LOG:  hm", "PostgreSQL 16.1 on linux", "x"))
    assert [r["event"] for r in got] == [
        "statement", "statement", "duration", "lock", "error", "autovacuum", "replication", "checkpoint", "ready", "recovery",
        "listen", "warning", "other", "startup"]
    assert (got[0]["table"], got[0]["stmt_type"], got[0]["duration_ms"], got[0]["slow"]) == ("parcels", "SELECT", 231.25, False)
    assert got[0]["timestamp"] == "2031-02-23T16:45:01.782" and got[2]["slow"] is True
    assert (got[5]["vacuum_table"], got[5]["dead_tuples"], got[5]["live_tuples"]) == ("public.parcels", 61, 933)
    assert (got[6]["lag_value"], got[6]["lag_unit"]) == ("12.5", "ms")
    assert (got[13]["pid"], got[13]["level"], got[13]["timestamp"]) == (0, "INFO", "")


def test_csv_rows(spark):
    df = parse(spark, parse_csv, "timestamp,level,message,zone", '2031-02-23 10:00:00,INFO,"left, right"', ",,", "",
               '2031-02-23 10:00:01,ERROR,"a ""red"" box",z1,too,many')
    got = rows(df)
    assert [r["message"] for r in got] == ["left, right", 'a "red" box']
    assert [r["extra"] for r in got] == [{"zone": None}, {"zone": "z1"}]
    totals = bookkeeping(df).first()
    assert (totals["total_lines"], totals["parsed"], totals["parse_errors"]) == (5, 2, 1)


def test_csv_headers_of_several_sources(spark):
    files = [("a", "time,timestamp,date\n1,2,3"), ("b", "client_ip,ip,Status Code\n9.9.9.9,8.8.8.8,200"), ("c", "request_time,rt\n5,6"),
             ("d", "one\n1")]
    df = parse_csv(lines_from_files(spark, files))
    got = {r["source"]: r for r in rows(df)}
    assert got["a"]["timestamp"] == "2" and got["a"]["extra"] == {"time": "1", "date": "3"}
    assert got["b"]["ip"] == "9.9.9.9" and got["b"]["extra"] == {"ip_raw": "8.8.8.8"} and got["b"]["status"] == "200"
    assert (got["c"]["timestamp"], got["c"]["duration"]) == ("5", "6")
    assert "d" not in got


def test_csv_results_rules(spark):
    values = ["{'matched': 'Y', 'error': 'x'}", "{'matched': 'N', 'error': 'no such id'}", "{'matched': 'N'}", "{'error': 'boom'}",
              "{'detail': ErrorDetail(string='denied'}", "{'non_field_errors': [ErrorDetail(string='bad form'}", "{'Token': 1}", "{'other': 1}"]
    lines = ["id,results"] + [f'{i},"{v}"' for i, v in enumerate(values)] + ["9,"]
    got = rows(parse(spark, parse_csv, *lines))
    assert [(r["level"], r["message"]) for r in got] == [
        ("INFO", "Match found"), ("WARN", "no such id"), ("WARN", "No match"), ("ERROR", "boom"), ("ERROR", "denied"),
        ("ERROR", "bad form"), ("INFO", "Token issued"), ("INFO", "{'other': 1}"), (None, None)]
    with_level = rows(parse(spark, parse_csv, "level,results", "DEBUG,\"{'matched': 'Y'}\""))
    assert with_level[0]["level"] == "DEBUG" and with_level[0]["message"] is None


def test_exclusion(spark):
    df = parse(spark, parse_access, FULL, SHORT, DASH, "bad", "")
    totals = bookkeeping(df, exclude=["10.44.3.9"]).first()
    assert (totals["parsed"], totals["parse_errors"]) == (1, 1)
    assert parse_address_list(" 10.0.0.1, ,10.0.0.2") == ["10.0.0.1", "10.0.0.2"]
    many = ["10.44.3.9"] + [f"172.16.{i // 250}.{i % 250}" for i in range(500)]
    for listed in (["10.44.3.9"], many):
        assert [r["ip"] for r in exclude_clients(entries(df), listed).collect()] == ["172.20.8.41"]
    # entries without an address stay
    err = entries(parse(spark, parse_error, "2031/02/23 16:45:00 [crit] 1#5: accept() failed"))
    assert exclude_clients(err, many).count() == 1


def test_parsing_has_no_shuffle_and_single_regex(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(FULL,)], "value string").write.text(path)
    raw = spark.read.text(path).select(F.lit("a").alias("source"), F.lit(0).cast("bigint").alias("line_no"), "value")
    plan = entries(parse_access(raw)).where("status >= 400").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_replace") == 1
