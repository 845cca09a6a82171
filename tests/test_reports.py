import json

import pytest
from pyspark.sql import functions as F

from timberline.operators.search import pick, search, sort_by
from timberline.plans import analyze as an
from timberline.plans.options import Options
from timberline.sinks import files, history
from timberline.sources.lines import lines_from_files, lines_from_text
from tests.test_operators import DETECTION


def access(rt, n=1, hour=10, status=200):
    line = f'10.0.0.1 - - [23/Feb/2031:{hour}:00:00 +0330] "GET /a HTTP/1.1" {status} 10 "-" "ua" rt={rt}'
    return [line] * n


def summary(spark, lines, **options):
    p = an.parse(lines_from_text(spark, "\n".join(lines)), "nginx_access")
    return an.ACCESS["summary"](p, Options(**options)).first()


def test_health(spark):
    assert summary(spark, access(100))["health"] == "critical"
    assert summary(spark, access(15))["health"] == "degraded"
    assert summary(spark, access(0.1))["health"] == "healthy"
    assert summary(spark, access(15), slow=20.0)["health"] == "healthy"
    assert summary(spark, access(15), slow=5.0, critical=12.0)["health"] == "critical"


def test_incidents(spark):
    p = an.parse(lines_from_text(spark, "\n".join(access(1, 3, 10) + access(40, 1, 11) + access(12, 2, 12))), "nginx_access")
    got = [(r["period"], r["severity"], r["slow_count"]) for r in an.ACCESS["tables.incidents"](p, Options()).collect()]
    assert got == [("2031-02-23 11:00", "critical", 1), ("2031-02-23 12:00", "degraded", 0)]


@pytest.mark.parametrize("log_type", list(an.REPORTS))
def test_every_output_runs_alone_and_per_source(spark, log_type):
    lines = lines_from_files(spark, [("a", "\n".join(DETECTION[log_type])), ("b", "\n".join(DETECTION[log_type]))])
    parsed = an.parse(lines, log_type).persist()
    try:
        for by in ((), ("source",)):
            for name, df in an.report(parsed, log_type, Options(by=by)).items():
                if by and name != "trace_sizes":
                    assert df.columns[0] == "source", name
                df.collect()
    finally:
        parsed.unpersist()


def test_analyze(spark):
    out = an.analyze(lines_from_text(spark, "\n".join(DETECTION["syslog"])))
    assert out["type"].first()["detected_type"] == "syslog"
    assert out["summary"].first()["total_entries"] == 3
    with pytest.raises(ValueError, match="auto-detect"):
        an.analyze(lines_from_text(spark, "words\nwords"))
    with pytest.raises(ValueError, match="No such log type"):
        an.analyze(lines_from_text(spark, "words"), "nope")


def test_batch(spark):
    content = [("w.log", "\n".join(access(1, 4))), ("s.log", "\n".join(DETECTION["syslog"])), ("blank", "\n  \n"), ("odd", "a\nb\nc")]
    lines = lines_from_files(spark, content).unionByName(
        spark.createDataFrame([("blank", 0, "  ")], "source string, line_no bigint, value string"))
    out = an.batch(lines)
    assert set(out) == {"sources", "nginx_access", "syslog"}
    errors = {r["source"]: r["error"] for r in out["sources"]["sources"].collect()}
    assert errors["w.log"] is None and errors["blank"] == "blank holds no lines to read" and "auto-detect" in errors["odd"]
    r = out["nginx_access"]["summary"].first()
    assert (r["source"], r["total_requests"]) == ("w.log", 4)
    view = {r["source"]: r for r in an.batch_overview(lines).collect()}
    assert view["s.log"]["parsed"] == 3 and view["odd"]["parsed"] is None
    forced = {r["source"]: r for r in an.typed_sources(lines, "nope").collect()}
    assert forced["w.log"]["error"] == "No such log type: nope"


def test_correlate(spark):
    lines = lines_from_files(spark, [
        ("w.log", "\n".join(access(1, 3))), ("s.log", "2031-02-23T09:00:00 h app: first\n2031-02-23T23:00:00 h app: last"), ("odd", "x\ny")])
    got = an.correlate(lines).collect()
    assert [r["type"] for r in got] == ["syslog"] + ["nginx_access"] * 3 + ["syslog"]
    assert got[0]["summary"] == "app: first" and got[1]["summary"] == "GET /a → 200"
    assert json.loads(got[0]["entry"])["process"] == "app"
    assert {r["type"]: r["events"] for r in an.type_counts(an.correlate(lines)).collect()} == {"syslog": 2, "nginx_access": 3}
    with pytest.raises(ValueError, match="nothing to correlate"):
        an.correlate(lines_from_text(spark, "x\ny"))


def test_many_sources_take_the_join_path(spark, monkeypatch):
    monkeypatch.setattr(an, "_NAMED_SOURCES", 1)
    lines = lines_from_files(spark, [("w.log", "\n".join(access(1, 3))), ("s.log", "\n".join(DETECTION["syslog"]))])
    parts = an.split_by_type(lines, an.typed_sources(lines))
    assert {t: p.count() for t, p in parts.items()} == {"nginx_access": 3, "syslog": 3}


def test_register_own_type(spark):
    def parse_words(lines):
        return lines.select("source", "line_no", F.lit(True).alias("parsed"), F.lit(False).alias("blank"),
                            F.lit("").alias("timestamp"), F.col("value").alias("word"))
    an.register("words", "Words", parse_words, {"summary": lambda df, o: df.groupBy(*o.by).count()})
    try:
        assert an.analyze(lines_from_text(spark, "a\nb"), "words")["summary"].first()["count"] == 2
    finally:
        for table in (an.LABELS, an.PARSERS, an.REPORTS):
            table.pop("words")


def test_csv_blocks_without_columns_are_empty(spark):
    p = an.parse(lines_from_text(spark, "alpha,beta\n1,2\n3,4"), "csv")
    out = an.report(p, "csv")
    for name in ("tables.levels", "tables.status_codes", "charts.top_ips", "charts.hourly_timeline", "charts.duration_histogram"):
        assert out[name].count() == 0, name
    r = out["summary"].first()
    assert (r["total_entries"], r["columns"], r["all_columns"], r["error_count"]) == (2, [], ["alpha", "beta"], None)


@pytest.mark.parametrize("by", [(), ("source",)])
def test_csv_summary_sorts_no_rows(spark, by):
    lines = lines_from_files(spark, [
        ("b.csv", "ts,level,ip,path,duration,zone\nt1,ERROR,1,/a,2.5,x\nt2,INFO,2,/a,,x\nt3,INFO,1,/b,1.5,\n,,\n"),
        ("a.csv", "ip,zone,bytes\n3,z,10\n1,,20\n"), ("c.csv", "ab,ac\n,\n")])
    df = an.TABLE["summary"](an.parse(lines, "csv"), Options(by=by))
    # rows may be sorted by hashable keys of folded values, never by client and endpoint
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "SortAggregate" in x and ("ip#" in x or "endpoint#" in x)]
    assert not [x for x in plan.split("\n") if "Sort [" in x and "ip#" in x]
    got = {r["source"] if by else None: (r["total_entries"], r["all_columns"], r["unique_ips"], r["unique_endpoints"], r["error_count"],
                                         r["max_duration"], r["total_bytes"]) for r in df.collect()}
    b, a = ["ts", "level", "ip", "path", "duration", "zone"], ["ip", "zone", "bytes"]
    if by:
        assert got == {"b.csv": (3, b, 2, 2, 1, 2.5, None), "a.csv": (2, a, 2, None, None, None, 30)}
    else:
        # a header without entries is not among the columns
        assert got == {None: (5, a, 3, 2, 1, 2.5, 30)}


def test_csv_levels_told_by_results(spark):
    p = an.parse(lines_from_text(spark, "id,results\n1,\"{'matched': 'Y'}\"\n2,"), "csv")
    got = [tuple(r) for r in an.TABLE["tables.levels"](p, Options()).collect()]
    assert got == [("INFO", 1, 50.0), ("UNKNOWN", 1, 50.0)]


def test_sinks(spark, tmp_path):
    p = an.parse(lines_from_text(spark, "\n".join(access(1, 3))), "nginx_access")
    out = {n: an.ACCESS[n](p, Options()) for n in ("summary", "tables.ip_details", "charts.method_distribution")}
    files.write_json(out, str(tmp_path / "json"))
    files.write_csv(out, str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "json/charts.method_distribution")).first()["value"] == 3
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv/tables.ip_details")).first()
    assert json.loads(row["status_codes"]) == [{"status": 200, "count": 3}]
    text = [r["line"] for r in files.text_summary(out["summary"], "Access").orderBy("line_no").collect()]
    assert text[0] == "Access" and "total_requests: 3" in text


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    p = an.parse(lines_from_text(spark, "\n".join(access(1, 3))), "nginx_access")
    for n, t in enumerate(("nginx_access", "nginx_access", "syslog")):
        row = history.history_rows(an.ACCESS["summary"](p, Options()), an.bookkeeping(p), t, an.LABELS[t], f"Run {n}",
                                   F.timestamp_seconds(F.lit(n)))
        history.save(row, path)
    h = history.read(spark, path)
    assert [r["label"] for r in history.list_reports(h).collect()] == ["Run 2", "Run 1", "Run 0"]
    assert [r["label"] for r in history.list_reports(h, "run 1").collect()] == ["Run 1"]
    assert [r["log_type"] for r in history.list_reports(h, log_type="syslog").collect()] == ["syslog"]
    assert history.list_reports(h, limit=2).count() == 2


def test_search_and_sort(spark):
    df = spark.createDataFrame([("Alpha", 1, [1]), ("beta", 2, [77])], "name string, n int, l array<int>")
    assert [r["name"] for r in search(df, "ALPH").collect()] == ["Alpha"]
    assert [r["name"] for r in search(df, "77").collect()] == ["beta"]
    assert [r["name"] for r in pick(df, {"n": 2}).collect()] == ["beta"]
    assert [r["name"] for r in sort_by(df, "n").collect()] == ["beta", "Alpha"]


def _plain(df):
    return sorted(map(repr, (tuple(r.asDict(recursive=True).items()) for r in df.collect())))


# the outputs that have a limit, and one plain one
PER_SOURCE = ("charts.top_errors", "tables.anomaly_fingerprints", "tables.error_samples", "summary")


@pytest.mark.parametrize("log_type", ["syslog", "nginx_access"])
def test_per_source_outputs_equal_single_reports(spark, log_type):
    def many(tag):  # more message forms than any top-k keeps
        own = "\n".join(DETECTION[log_type])
        if log_type == "syslog":
            word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
            own += "\n" + "\n".join(f"Nov  3 05:41:07 h{tag} app: ERROR {tag} {word(i)}" for i in range(600) for _ in range(1 + i % 3))
        return own

    texts = {"a": many("x"), "b": many("y")}
    both = an.report(an.parse(lines_from_files(spark, list(texts.items())), log_type), log_type, Options(by=("source",)))
    for source, text in texts.items():
        alone = an.report(an.parse(lines_from_files(spark, [(source, text)]), log_type), log_type)
        for name, df in both.items():
            if name in PER_SOURCE:
                assert _plain(df.where(F.col("source") == source).drop("source")) == _plain(alone[name].drop("source")), name


def test_sources_of_several_types(spark):
    lines = lines_from_files(spark, [("w.log", "\n".join(access(1, 4))), ("s.log", "\n".join(DETECTION["syslog"]))])
    with pytest.raises(ValueError, match="batch"):
        an.analyze(lines)
    assert an.timeline_totals(an.correlate(lines)).first().asDict() == {"total_events": 7, "sources": 2}


def test_totals_of_absurd_numbers(spark):
    line = '10.0.0.7 - - [03/Nov/2024:06:17:52 +0100] "GET /a HTTP/1.1" 200 9223372036854775807 "-" "ua" rt=1'
    p = an.parse(lines_from_text(spark, "\n".join([line] * 3)), "nginx_access")
    assert an.ACCESS["summary"](p, Options()).first()["total_bytes"] == 2**63 - 1
    assert an.ACCESS["tables.ip_details"](p, Options()).first()["total_bytes"] == 2**63 - 1


@pytest.mark.parametrize("log_type", list(an.REPORTS))
def test_entry_index_of_every_type(spark, log_type):
    from timberline.operators.entries import entries
    from timberline.operators.positions import entry_index

    typed = entries(an.parse(lines_from_text(spark, "\n".join(DETECTION[log_type])), log_type))
    got = [r["entry_idx"] for r in entry_index(typed).orderBy("line_no").collect()]
    assert got == list(range(len(got))) and got


def test_equal_names_stay_apart(spark, tmp_path):
    from timberline.operators.entries import entries
    from timberline.sources.lines import read_lines

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text("timestamp,level\n1,INFO\n2,WARN\n")
    paths = [str(tmp_path / f / "t.csv") for f in ("a", "b")]
    lines = read_lines(spark, paths)
    assert lines.select("source", "line_no").distinct().count() == 6
    assert entries(an.parse(lines, "csv")).count() == 4
    with pytest.raises(ValueError, match="one name"):
        read_lines(spark, paths, full_path=False)
    twice = lines_from_files(spark, [("t", "x\ny"), ("t", "z")])
    assert {r["source"] for r in twice.collect()} == {"t", "t (2)"}
