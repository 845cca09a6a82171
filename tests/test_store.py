"""The log store: one read of the text, batches, replaced files, line index; and the streaming rollup."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from timberline.functions.clock import event_instant
from timberline.operators.entries import entries
from timberline.operators.search import search
from timberline.operators.search_index import blocks_of, build, search_index
from timberline.plans import analyze as an
from timberline.plans import hours
from timberline.plans.options import Options
from timberline.plans.store import LogStore
from timberline.sinks.timeline import read_ranked, write_clustered
from timberline.sources.lines import lines_from_files, lines_from_text, read_lines
from timberline.streaming import rollup


def access(day, hour, n, zone="+0000", rt=0.5, status=200):
    return f'10.1.0.{n % 9} - - [{day:02d}/Feb/2031:{hour:02d}:{n % 60:02d}:07 {zone}] "GET /item/{n % 4} HTTP/1.1" {status} {n} "-" "agent" rt={rt + n / 1000:.3f}'


def error(day, hour, n):
    return f"2031/02/{day:02d} {hour:02d}:{n % 60:02d}:07 [error] 7#1: *{n} no upstream, client: 10.1.0.{n % 9}"


def write(folder, name, lines, end="\n"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(end.join(lines) + (end if lines else ""))


@pytest.fixture
def logs(tmp_path):
    folder = str(tmp_path / "logs in+out")
    write(folder, "a é.log", [access(3, h, n) for h in range(4) for n in range(40)] + ["", "junk"])
    write(folder, "b.log", [error(3, h, n) for h in range(4) for n in range(30)])
    write(folder, "c.log", [access(3, h, n, "+0200", status=500) for h in range(2, 6) for n in range(40)], "\r\n")
    write(folder, "empty.log", [])
    write(folder, "odd.log", ["no log", "at all"])
    return folder


def test_reports_equal_those_of_the_lines(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    files = {os.path.basename(r["path"]): r for r in store.add(logs).collect()}
    assert {n: r["log_type"] for n, r in files.items()} == {
        "a é.log": "nginx_access", "b.log": "nginx_error", "c.log": "nginx_access", "empty.log": None, "odd.log": None}
    assert "holds no lines" in files["empty.log"]["error"] and "No log type" in files["odd.log"]["error"] and files["b.log"]["error"] is None
    lines = read_lines(spark, logs)
    assert sorted(map(tuple, store.lines().collect())) == sorted(map(tuple, lines.collect()))
    want = {(r["source"], r["line_no"]): r for r in an.parse(lines.where(F.contains("source", F.lit("c.log"))), "nginx_access").collect()}
    got = {(r["source"], r["line_no"]): r for r in store.table("nginx_access").where(F.contains("source", F.lit("c.log"))).collect()}
    assert got == want
    options = Options(slow=0.4, critical=0.52, exclude=("10.1.0.3",))
    both = store.batch(options)
    plain = an.batch(lines, options=options)
    for t in ("nginx_access", "nginx_error"):
        for name in plain[t]:
            assert sorted(map(str, both[t][name].collect())) == sorted(map(str, plain[t][name].collect())), name
    overview = [(os.path.basename(r["source"]), r["total_lines"], r["parsed"], r["parse_errors"]) for r in store.overview().collect()]
    assert overview[1:3] == [("b.log", 120, 120, 0), ("c.log", 160, 160, 0)] and overview[0][1:] == (162, 160, 1)


def test_a_second_run_reads_nothing_and_a_changed_file_replaces_itself(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.add(logs)
    before = set(os.listdir(tmp_path / "store" / "lines"))
    assert store.add(logs).count() == 0 and set(os.listdir(tmp_path / "store" / "lines")) == before
    write(logs, "d.log", [error(4, 1, n) for n in range(25)])
    added = store.add(logs).collect()
    assert [os.path.basename(r["path"]) for r in added] == ["d.log"]
    # only the new file's text is in the new batch
    new = (set(os.listdir(tmp_path / "store" / "lines")) - before).pop()
    assert spark.read.parquet(str(tmp_path / "store" / "lines" / new)).count() == 25
    write(logs, "b.log", [error(3, 9, n) for n in range(12)])
    store.add(logs)
    own = entries(store.table("nginx_error"))
    assert own.count() == 37 and own.where(F.contains("source", F.lit("b.log"))).agg(F.min("timestamp")).first()[0] == "2031-02-03T09:00:07"
    assert store.files().where(F.endswith("path", F.lit("b.log"))).count() == 1
    assert store.lines().where(F.contains("source", F.lit("b.log"))).count() == 12


def test_unfinished_batches_do_not_count(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.add(f"{logs}/b.log")
    for name in ("lines", "splits", "files", "entries/nginx_error"):
        folder = tmp_path / "store" / name
        done = next(f for f in os.listdir(folder) if f.startswith("batch="))
        shutil.copytree(folder / done, folder / "batch=leftover")
    assert store.files().count() == 1 and store.lines().count() == 120 and store.table("nginx_error").count() == 120


def test_days_and_types_read_their_files_only(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.add(logs)
    write(logs, "later.log", [access(9, 1, n) for n in range(30)])
    store.add(logs)
    one = store.table("nginx_access", days=["2031-02-09"])
    assert one.count() == 30
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2031-02-09" in plan
    # the lines of one source come from the table files that hold it
    late = store.files().where(F.endswith("path", F.lit("later.log")))
    assert len(store.lines(late).inputFiles()) < len(store.lines().inputFiles())
    picked = entries(store.table("nginx_access")).where(F.contains("source", F.lit("later.log")) & F.col("line_no").isin(0, 17)).select(
        "source", "line_no", F.col("line_no").alias("entry_idx"))
    near = store.context(picked, 2, 2)
    assert sorted((r["center_line"], r["line_num"], r["is_match"]) for r in near.collect()) == [
        (0, 0, True), (0, 1, False), (0, 2, False), (17, 15, False), (17, 16, False), (17, 17, True), (17, 18, False), (17, 19, False)]
    parts = {f for f in near.inputFiles() if "/lines/" in f}
    assert parts and len(parts) < len(store.lines().inputFiles())


def test_states_merge_over_batches(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.add(f"{logs}/a é.log")
    store.add(f"{logs}/c.log")
    o = Options(slow=0.4, critical=0.52)
    typed = store.table("nginx_access")
    assert hours.hourly_performance(store.hours(), o).collect() == an.ACCESS["tables.hourly_performance"](typed, o).collect()
    assert hours.incidents(store.hours(), o).collect() == an.ACCESS["tables.incidents"](typed, o).collect()
    assert hours.timeline(store.hours(), o).collect() == an.ACCESS["charts.hourly_timeline"](typed, o).collect()
    total = hours.daily(store.hours(["2031-02-03"]), o).first()
    assert (total["requests"], total["error_rate"]) == (320, 50.0)


def test_timeline_by_time_keeps_the_order_of_files(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.add(logs)
    keys, path = an.timeline_order(by_time=True), str(tmp_path / "timeline")
    write_clustered(store.timeline(by_time=True), keys, path)
    rows = sorted(read_ranked(spark, path, keys).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 441))
    # 02:00 +0200 is 00:00: equal instants go by file, then by line
    want = sorted(rows, key=lambda r: (r["instant"], r["place"], r["line_no"]))
    assert [(r["source"], r["line_no"]) for r in rows] == [(r["source"], r["line_no"]) for r in want]
    assert [os.path.basename(r["source"])[0] for r in rows[:3]] == ["a", "b", "c"]


def test_correlate_in_the_given_order(spark):
    # names sort the other way round
    files = [("z.log", "\n".join(error(1, 1, n) for n in (1, 2, 3))), ("a.log", "\n".join(access(1, 1, n) for n in (1, 2, 3)))]
    out = an.correlate(lines_from_files(spark, files), order=["z.log", "a.log"]).select("source", "line_no").collect()
    assert [tuple(r) for r in out] == [(s, i) for i in range(3) for s in ("z.log", "a.log")]
    moved = [("z.log", "\n".join(access(1, 5, n, "+0500") for n in (1, 2, 3))), ("a.log", "\n".join(access(1, 1, n) for n in (1, 2, 3)))]
    by_time = an.correlate(lines_from_files(spark, moved), order=["z.log", "a.log"], by_time=True).select("source", "line_no").collect()
    assert [tuple(r) for r in by_time[:3]] == [("z.log", 0), ("z.log", 1), ("z.log", 2)]


def test_report_names_scores_and_excluded_clients(spark):
    lines = lines_from_text(spark, "\n".join(error(1, 1, n) for n in range(10)))
    r = an.analyze(lines, options=Options(exclude=("10.1.0.2",)))["type"].first()
    assert r["detected_type"] == "nginx_error" and r["excluded_ips"] == ["10.1.0.2"]
    assert [tuple(s) for s in r["detection_scores"]] == [("nginx_error", 10), ("api_backend", 10)]


def test_pasted_text_and_file_agree(spark, tmp_path):
    text = "\n\n first \x0b still \x85 one\r\nsecond\r\rthird \n"
    with open(tmp_path / "t.log", "w", newline="") as f:
        f.write(text)
    want = [tuple(r) for r in read_lines(spark, str(tmp_path / "t.log")).orderBy("line_no").select("line_no", "value").collect()]
    for lines in (lines_from_text(spark, text), lines_from_files(spark, [("t.log", text)])):
        assert [tuple(r) for r in lines.orderBy("line_no").select("line_no", "value").collect()] == want
    assert lines_from_text(spark, "").count() == 0


def test_instants(spark):
    cases = [
        ("2031-02-03T04:05:06Z", None, "2031-02-03 04:05:06"), ("2031-02-03T04:05:06.250+05:30", None, "2031-02-02 22:35:06.250000"),
        ("2031/02/03 04:05:06", "-0800", "2031-02-03 12:05:06"), ("2031-02-03T04:05:06", "CEST", "2031-02-03 04:05:06"),
        ("2031-02-03 04:05:06,123", "UTC", "2031-02-03 04:05:06"), ("2031-02-30T04:05:06", None, None), ("Feb  3 04:05:06", None, "2031-02-03 04:05:06"),
        ("nonsense", "+0100", None), (None, None, None), ("2031-02-03T04:05:06-03", "+0900", "2031-02-03 07:05:06"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, z string")
    got = df.select(event_instant(F.col("t"), F.col("z"), year=2031).cast("string").alias("i")).collect()
    for r, (_, _, want) in zip(got, cases):
        assert (r["i"] or "")[:19] == (want or "")[:19]


def test_rollup_of_arriving_files(spark, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        rollup.start(spark, folder, out, state, late="3 hours").awaitTermination()
        return [tuple(r) for r in hours.hourly_performance(rollup.read(spark, out)).select("hour", "requests", "max_rt").collect()]

    first = [access(3, h, n) for h in (1, 2) for n in range(20)] + ["junk", ""]
    write(folder, "one.log", first)
    assert run() == [("2031-02-03 01:00", 20, 0.519), ("2031-02-03 02:00", 20, 0.519)]
    assert run() == [("2031-02-03 01:00", 20, 0.519), ("2031-02-03 02:00", 20, 0.519)]  # nothing new
    # a late file inside the watermark corrects its hour; zones count
    late = [access(3, 1, n, rt=4.0) for n in range(5)] + [access(3, 8, n, "+0500") for n in range(7)]
    write(folder, "two.log", late)
    assert run() == [("2031-02-03 01:00", 25, 4.004), ("2031-02-03 02:00", 20, 0.519), ("2031-02-03 03:00", 7, 0.506)]
    # a repeated batch writes the same again
    last = max(os.listdir(f"{state}/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    os.remove(f"{state}/commits/{last}")
    if os.path.exists(f"{state}/commits/.{last}.crc"):
        os.remove(f"{state}/commits/.{last}.crc")
    assert run() == [("2031-02-03 01:00", 25, 4.004), ("2031-02-03 02:00", 20, 0.519), ("2031-02-03 03:00", 7, 0.506)]
    typed = an.parse(lines_from_text(spark, "\n".join(first + late)), "nginx_access")
    whole = an.ACCESS["tables.hourly_performance"](typed.where("zone = '+0000' OR zone IS NULL"), Options()).collect()
    assert [(r["hour"], r["requests"]) for r in whole] == [("2031-02-03 01:00", 25), ("2031-02-03 02:00", 20)]


def test_search_index_gives_the_rows_of_the_plain_search(spark, tmp_path):
    rows = [(i, f"Name {i % 37} of {'Ünder' if i % 5 == 0 else 'plain'} row", {"k": f"v{i % 11}"} if i % 3 else None, i / 8) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string, extra map<string,string>, x double").repartitionByRange(3, "id")
    path = str(tmp_path / "index")
    build(df, path, rows_per_block=50)
    total = spark.read.parquet(f"{path}/rows").select("_block").distinct().count()
    assert 60 <= total <= 63
    for text in ("name 12 of", "ÜNDER ROW", '"k":"v3"', "17.5", "no such thing", "ab", "", "Name 36 of plain", "2999"):
        want = sorted(r["id"] for r in search(df, text).collect())
        assert sorted(r["id"] for r in search_index(spark, path, text).collect()) == want, text
    assert blocks_of(spark, path, "2999").count() == 1 and blocks_of(spark, path, "no such thing").count() == 0 and blocks_of(spark, path, "ab") is None


def test_sketches_merge(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.add(f"{logs}/a é.log")
    store.add(f"{logs}/c.log")
    rows = entries(store.table("nginx_access"))
    exact = rows.agg(F.count_distinct("ip").alias("unique_ips"), F.count_distinct("path").alias("unique_paths")).first()
    assert hours.distinct_estimates(store.distinct()).first() == exact
    assert hours.distinct_estimates(store.distinct(["2031-02-03"]), ["source"]).count() == 2
