import random

from pyspark.sql import functions as F

from timberline.operators import frequency as fq
from timberline.operators import stats
from timberline.operators.context import context, context_of_entry
from timberline.operators.detect import detect_types
from timberline.operators.entries import entries
from timberline.operators.parse_system import parse_syslog, trace_sizes
from timberline.operators.positions import entry_index, last_before
from timberline.sources.lines import lines_from_files, lines_from_text, read_lines, spread


def at(values, p):
    s = sorted(values)
    return s[min(int(len(s) * p), len(s) - 1)] if s else None


def test_percentiles_against_sorted_lists(spark):
    rng = random.Random(5)
    groups = {n: [round(rng.choice([rng.random() * 10, rng.random() * 1e4, -rng.random()]), 3) for _ in range(n)]
              for n in (1, 2, 3, 5, 19, 20, 40, 100, 101, 400)}
    groups[7] = [2.5] * 7
    rows = [(n, v) for n, vs in groups.items() for v in vs] + [(999, None), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    got = {r["g"]: r for r in stats.describe(df, ["g"], F.col("v")).collect()}
    for n, vs in groups.items():
        r = got[n]
        assert (r["count"], r["min"], r["max"]) == (len(vs), min(vs), max(vs))
        assert (r["p50"], r["p95"], r["p99"]) == (at(vs, 0.5), at(vs, 0.95), at(vs, 0.99)), n
        assert abs(r["avg"] - sum(vs) / len(vs)) < 1e-3
    assert got[7]["rows"] == 8
    assert (got[999]["rows"], got[999]["count"], got[999]["avg"], got[999]["p95"]) == (1, 0, None, None)


def test_global_describe_of_nothing(spark):
    r = stats.describe(spark.createDataFrame([], "v double"), [], F.col("v")).first()
    assert (r["rows"], r["count"], r["avg"], r["p50"]) == (0, 0, None, None)


def test_equal_count_histogram_against_slices(spark):
    rng = random.Random(9)
    for n in (1, 7, 20, 39, 41, 100, 417):
        vs = [round(rng.choice([1.0, rng.random() * 50]), 2) for _ in range(n)]
        s, step = sorted(vs), max(1, n // min(n, 20))
        want = [(round(s[min(i + step, n) - 1], 2), min(i + step, n) - i) for i in range(0, n, step)]
        df = spark.createDataFrame([(v,) for v in vs], "v double")
        got = [(r["upper"], r["value"]) for r in stats.equal_count_histogram(df, F.col("v")).collect()]
        assert got == want, n


def test_equal_width_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(-3.0,)], "v double")
    got = stats.equal_width_histogram(df, F.col("v")).collect()
    assert len(got) == 10 and sum(r["value"] for r in got) == 12
    assert got[0]["value"] == 2 and got[9]["value"] == 2 and got[9]["upper"] == 10.0


def test_duration_classes(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0)], "v double")
    got = [(r["label"], r["value"]) for r in stats.duration_classes(df, F.col("v")).collect()]
    assert got == [(c[0], 1) for c in stats.DURATION_CLASSES]


def test_frequencies_break_ties_by_first_appearance(spark):
    rows = [("s", i, v) for i, v in enumerate(["b", "a", "a", "b", "c", None])]
    df = spark.createDataFrame(rows, "source string, line_no bigint, v string").repartition(3)
    assert [tuple(r) for r in fq.frequencies(df, F.col("v")).collect()] == [("b", 2), ("a", 2), ("c", 1)]
    got = [tuple(r) for r in fq.shares(df, F.col("v"), label_name="v").collect()]
    assert got == [("b", 2, 33.33), ("a", 2, 33.33), ("c", 1, 16.67)]
    got = [tuple(r) for r in fq.shares(df, F.col("v"), label_name="v", of_labelled=True).collect()]
    assert got[0] == ("b", 2, 40.0)


def test_status_lists(spark):
    rows = [("s", 0, "x", 404), ("s", 1, "x", 200), ("s", 2, "x", 200), ("s", 3, "x", 500)]
    df = spark.createDataFrame(rows, "source string, line_no bigint, ip string, status int")
    r = fq.status_lists(df, F.col("ip"), F.col("status"), "ip").first()
    assert [(s["status"], s["count"]) for s in r["status_codes"]] == [(200, 2), (404, 1), (500, 1)]


def test_entry_index_across_blocks(spark):
    rng = random.Random(1)
    rows = [(s, n) for s in ("a", "b") for n in sorted(rng.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "source string, line_no bigint").repartition(4)
    got = {(r["source"], r["line_no"]): (r["entry_idx"], r["entry_total"])
           for r in entry_index(df, block_lines=16, with_total=True).collect()}
    for s in ("a", "b"):
        for i, n in enumerate(sorted(n for t, n in rows if t == s)):
            assert got[(s, n)] == (i, 120)


def test_last_before_across_blocks(spark):
    rng = random.Random(2)
    values = [rng.choice([None, None, None, n]) for n in range(300)]
    df = spark.createDataFrame([("a", n, v) for n, v in enumerate(values)], "source string, line_no bigint, v bigint").repartition(4)
    got = {r["line_no"]: r["p"] for r in last_before(df, F.col("v"), "p", block_lines=8).collect()}
    last = None
    for n, v in enumerate(values):
        assert got[n] == last
        last = n if v is not None else last


def test_traces_against_a_line_by_line_reading(spark):
    """Random start, continuation, other, broken and blank lines; small blocks."""
    rng = random.Random(4)
    texts = {
        "start": "2031-02-23T10:00:00 h kernel: WARNING: CPU 1", "cont": "2031-02-23T10:00:00 h kernel: more",
        "other": "2031-02-23T10:00:00 h app: fine", "broken": "mark", "blank": "", "bsd": "Feb 23 10:00:00 h kernel: more"}
    kinds = [rng.choice(list(texts)) for _ in range(600)]
    inside, swallowed, kept = False, [], []
    for n, k in enumerate(kinds):
        if k == "blank":
            continue
        if inside and k == "cont":
            swallowed.append(n)
            continue
        inside = k == "start"
        if k != "broken":
            kept.append(n)
    df = spark.createDataFrame([("s", n, texts[k]) for n, k in enumerate(kinds)], "source string, line_no bigint, value string")
    parsed = parse_syslog(df.repartition(4), block_lines=16)
    assert sorted(r["line_no"] for r in entries(parsed).collect()) == kept
    assert sorted(r["line_no"] for r in parsed.where("trace_line IS NOT NULL").collect()) == swallowed
    assert sum(r["swallowed"] for r in trace_sizes(parsed).collect()) == len(swallowed)


def test_line_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(8)
    for name, n in (("a.log", 4000), ("b.log", 700), ("c.log", 1)):
        with open(tmp_path / name, "w") as f:
            for i in range(n):
                f.write("" if i % 50 == 7 else f"{i} " + "x" * rng.randrange(60))
                f.write("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 4701
    assert len({(r["source"], r["line_no"]) for r in rows}) == 4701
    assert all(r["value"] == "" and r["line_no"] % 50 == 7 or r["value"].split(" ")[0] == str(r["line_no"]) for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_undecodable_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"ok \xff\xfe end\n")
    assert read_lines(spark, str(tmp_path / "x.log")).first()["value"] == "ok �� end"


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    assert spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


def test_spread_follows_the_rows(spark):
    even = spread(spark.range(0, 1000, 1, 5), most=100)
    assert even.rdd.getNumPartitions() == 10
    assert sorted(r["id"] for r in even.collect()) == list(range(1000))
    # enough partitions, but one of them holds nearly all rows
    odd = spark.range(0, 900, 1, 1).union(spark.range(900, 910, 1, 7)).selectExpr("id", "id % 3 AS `a.b`", "map('k', id) AS m")
    assert odd.rdd.getNumPartitions() == 8
    dealt = spread(odd, most=100)
    assert dealt.rdd.getNumPartitions() == 10
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 200
    assert sorted(tuple(r) for r in dealt.select("id", "`a.b`", "m.k").collect()) == [(i, i % 3, i) for i in range(910)]
    assert spread(spark.range(0), most=100).count() == 0


def test_context(spark):
    lines = lines_from_text(spark, "\n".join(f"line {i}" for i in range(10)))
    picked = spark.createDataFrame([("pasted", 0, 0), ("pasted", 5, 3)], "source string, line_no bigint, entry_idx bigint")
    got = context(lines, picked, 2, 1).orderBy("entry_idx", "line_num").collect()
    assert [r["line_num"] for r in got] == [0, 1, 3, 4, 5, 6]
    assert [r["line_num"] for r in got if r["is_match"]] == [0, 5]
    one = context_of_entry(lines, picked, "pasted", 3, 1, 1).collect()
    assert [(r["content"], r["is_match"]) for r in one] == [("line 4", False), ("line 5", True), ("line 6", False)]
    try:
        context_of_entry(lines, picked, "pasted", 99)
        raise AssertionError("no error")
    except ValueError as ex:
        assert str(ex) == "invalid entry index"


DETECTION = {
    "nginx_access": ['198.51.100.7 - - [23/Feb/2031:16:45:00 +0330] "GET / HTTP/1.1" 200 1'] * 3,
    "nginx_error": ["2031/02/23 16:45:00 [error] 1#5: bad"] * 3,
    "container": ["2031-02-23T16:45:01.118273Z stdout F hello"] * 3,
    "syslog": ["Feb 23 16:45:00 mill4 sshd[1]: hello"] * 3,
    "postgres": ["2031-02-23 16:45:01.782 UTC [1] LOG:  hello"] * 3,
    "api_backend": ['{"level":"info","message":"x"}'] * 3,
    "csv": ["timestamp,level,message,user", "2031-02-23,INFO,started,bob", "2031-02-23,INFO,done,bob", "2031-02-23,INFO,done,amy"],
    None: ["just some words"] * 3,
}


def test_detection_of_all_types_in_one_job(spark):
    files = [(str(t), "\n".join(v)) for t, v in DETECTION.items()] + [("few", DETECTION["syslog"][0])]
    got = {r["source"]: r for r in detect_types(lines_from_files(spark, files)).collect()}
    for t in DETECTION:
        assert got[str(t)]["log_type"] == t
    assert got["nginx_access"]["confidence"] == 1.0 and got["None"]["confidence"] == 0.0
    assert got["few"]["log_type"] is None


def test_ragged_csv_is_vetoed(spark):
    text = "alpha,beta,gamma\n1,2,3,4,5\n1\n1,2,3,4\n5,6\n"
    assert detect_types(lines_from_text(spark, text)).first()["log_type"] is None
