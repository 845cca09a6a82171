import random

from pyspark.sql import functions as F

from timberline.functions import clock, numeric, rules, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def run(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr.alias("r")).collect()]


def test_rounding_equals_exact_binary_rounding(spark):
    rng = random.Random(3)
    values = [i / 200 for i in range(3000)] + [rng.random() * 1000 for _ in range(2000)]
    values += [2.675, 3.125, 12.345, 0.0005, 1.015, 1.005, -2.5, -0.125, 123456789.125]
    df = column(spark, values, "double")
    for digits in (1, 2, 3):
        assert run(df, numeric.round_exact(F.col("v"), digits)) == [round(v, digits) for v in values]


def test_safe_conversion(spark):
    df = column(spark, ["12", " 7 ", "-3", "1.5", "abc", "", None, "1_0", "5d"])
    assert run(df, numeric.to_int(F.col("v"))) == [12, 7, -3, None, None, None, None, None, None]
    df = column(spark, ["1.5", "2", "1e3", ".5", "nan", "inf", "x", "5d", None])
    assert run(df, numeric.to_float(F.col("v"))) == [1.5, 2.0, 1000.0, 0.5, None, None, None, None, None]


def test_exact_total_does_not_depend_on_order(spark):
    values = [0.1] * 10 + [1e9, 0.2, 0.3]
    a, b = (column(spark, v, "double").agg(numeric.exact_total(F.col("v"))).first()[0] for v in (values, values[::-1]))
    assert a == b == 1000000001.5


def test_human_bytes(spark):
    df = column(spark, [0, 512, 1024, 1536, 1048576, 5 * 1024**3, 1024**5], "bigint")
    assert run(df, numeric.human_bytes(F.col("v"))) == [
        "0.00 B", "512.00 B", "1.00 KB", "1.50 KB", "1.00 MB", "5.00 GB", "1.00 PB"]
    assert run(df, numeric.human_bytes(F.col("v"), 1))[3] == "1.5 KB"


def test_number_labels(spark):
    df = column(spark, [1.5, 20.0, 12000000.0, 0.25, 3.1], "double")
    assert run(df, numeric.number_label(F.col("v"))) == ["1.5", "20.0", "12000000.0", "0.25", "3.1"]


def test_access_time(spark):
    df = column(spark, ["23/Feb/2031:16:45:00 +0330", "5/Foo/2025:01:02:03 +0000", "23/Feb/2031:16:45:00", "odd text", "1/2 x"])
    assert run(df, clock.access_time(F.col("v"))) == [
        "2031-02-23T16:45:00", "2025-00-05T01:02:03", "23/Feb/2031:16:45:00", "odd text", "1/2 x"]


def test_error_time(spark):
    df = column(spark, ["2031/02/23 16:45:00", "23/Feb/2031 16:45:00", "nothing"])
    assert run(df, clock.error_time(F.col("v"))) == ["2031-02-23T16:45:00", "2031-02-23T16:45:00", "nothing"]


def test_hour_and_day_keys(spark):
    values = ["2031-02-23T16:45:00", "Feb 23 16:45:00", "", None, "2031-02-23 9:00", "2031-02-23 10:00:00", "invalid",
              "2031-02-23 10:00:00 UTC", "2031-02-23T1"]
    df = column(spark, values)
    assert run(df, clock.hour_key(F.col("v"))) == [
        "2031-02-23 16:00", "16:00", "unknown", "unknown", "9::00", "10:00", "unknown", "UT:00", "2031-02-23 00:00"]
    assert run(df, clock.day_key(F.col("v"))) == [
        "2031-02-23", "unknown", "unknown", "unknown", "2031-02-23", "2031-02-23", "unknown", "2031-02-23", "2031-02-23"]
    assert run(df, clock.database_hour_key(F.col("v")))[0] == "2031-02-23 16:00"
    assert run(df, clock.database_hour_key(F.col("v")))[5] == "2031-02-23 10:00"


def test_event_time(spark):
    df = column(spark, ["2031-02-23T16:45:00Z", "2031/02/23 01:00:00", "Feb 23 16:45:00", "2025-99-18T16:45:00"])
    got = run(df, clock.event_hour(F.col("v")).cast("string"))
    assert got == ["2031-02-23 16:00:00", "2031-02-23 01:00:00", None, None]


def test_levels(spark):
    df = column(spark, ["FATAL: x", "an err here", "warning", "info", "dbg", "a TRACE b", "nothing", "panicking"])
    assert run(df, rules.level_from_words(F.col("v"))) == [
        "FATAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE", "UNKNOWN", "UNKNOWN"]
    assert run(df, rules.level_from_words(F.col("v"), with_trace=False))[5] == "UNKNOWN"


def test_syslog_severity(spark):
    df = column(spark, ["kernel PANIC now", "level=crit disk", "an Error", "level=warning x", "WARNING: y", "level=notice",
                        "level=debug", "DEBUG z", "level=info", "plain", "lvl=err", "severity = warn", "lvl=errors"])
    got = run(df, rules.syslog_severity(F.col("v"), F.lower("v")))
    assert got == ["FATAL", "ERROR", "ERROR", "WARN", "WARN", "NOTICE", "DEBUG", "DEBUG", "INFO", "INFO", "ERROR", "WARN", "ERROR"]


def test_service_categories(spark):
    df = column(spark, ["kernel", "systemd-logind", "NetworkManager", "sshd", "CRON", "postfix/smtp", "dpkg", "telegraf",
                        "gnome-shell", "myapp"])
    assert run(df, rules.service_category(F.col("v"))) == [
        "kernel", "system", "network", "security", "cron", "mail", "package", "monitoring", "desktop", "other"]


def test_auth_failures(spark):
    df = column(spark, ["Failed password for x", "pam: authentication failure", "Invalid user bob", "Connection closed by 1.2.3.4 [preauth]",
                        "not valid", "refused", "unauthorized", "session opened", "connection closed normally"])
    assert run(df, rules.is_auth_failure(F.col("v"), F.lower("v"))) == [True] * 7 + [False] * 2


# one message per anomaly rule, in rule order
ANOMALY_TEXTS = [
    "WARNING: CPU 1 at drivers/gpu", "drm_WARN_ON(x)", "Tainted: [W]", "BUG: null", "RIP: 0010", "systemd[1]: unit Failed",
    "exited with status 3", "systemd[1]: Deactivated successfully", "Xwayland exited unexpectedly", "GDM assertion x failed",
    "gnome-shell assertion x failed", "Unable to register client", "GLib-GObject **", "assertion x failed", "Error: it failed",
    "request timed out", "host unreachable", "carrier lost", "Failed password", "authentication failure", "invalid user",
    "access denied", "sudo: bob : user NOT in sudoers", "i915 gave a WARN", None, "MCE seen", "thermal event",
    "livepatch has failed", "POST request to livepatch", "out of memory", "killed process 3", "I/O error", "ext4 had error", "xfs error",
]


def test_anomaly_rules_in_order(spark):
    texts = [t for t in ANOMALY_TEXTS if t]
    df = column(spark, texts)
    got = run(df, rules.anomaly_rule(F.col("v"), F.lower("v")))
    assert got == [i for i, t in enumerate(ANOMALY_TEXTS) if t]
    # a PHY timeout is a timeout first, so its own rule is never reached
    assert run(column(spark, ["timeout waiting for PHY"]), rules.anomaly_rule(F.col("v"), F.lower("v"))) == [15]


def test_fingerprints(spark):
    df = column(spark, ["from 10.0.0.1 pid 42 at 0xdeadbeef id deadbeefcafe  ok"])
    assert run(df, text.syslog_fingerprint(F.col("v"))) == ["from N.N.N.N pid N at HEX id HASH ok"]
    df = column(spark, ["worker 12 deadbeef abc123ff deadbeef12"])
    assert run(df, text.container_fingerprint(F.col("v"))) == ["worker N HASH abcNff deadbeefN"]
    assert run(df, text.digits_to_n(F.col("v"))) == ["worker N deadbeef abcNff deadbeefN"]
    assert run(column(spark, ['pool "p1" has 3']), text.warning_fingerprint(F.col("v"))) == ['pool "X" has N']


def test_normalize_sql(spark):
    long_list = ", ".join(str(i) for i in range(20000))
    df = column(spark, ["SELECT * FROM t WHERE id = 42 AND name = 'bob'", "SELECT * FROM t WHERE id IN (1, 2, 3)",
                        f"SELECT 1 FROM t WHERE id IN ({long_list})", "VALUES (1, 2, 3, 4)"])
    got = run(df, text.normalize_sql(F.col("v")))
    assert got[0] == "SELECT * FROM t WHERE id = ? AND name = '?'"
    assert got[1] == "SELECT * FROM t WHERE id IN (?)"
    assert got[2] == "SELECT ? FROM t WHERE id IN (?)"
    assert got[3] == "VALUES (?, ?)"


def test_csv_fields(spark):
    import csv
    import io
    lines = ["a,b,c", 'x,"hello, world",z', '"foo ""bar"" baz",2', ",,", '"open, to the end', '"q"tail,1', 'a"b,c', "", '"",x', "one"]
    df = column(spark, lines)
    want = [next(csv.reader(io.StringIO(v)), [""]) for v in lines]
    assert run(df, text.csv_fields(F.col("v"))) == want


def test_strip_cuts_unicode_space(spark):
    values = ["  a b \t", " x ", "\x1c", "plain"]
    assert run(column(spark, values), text.strip(F.col("v"))) == [v.strip() for v in values]
