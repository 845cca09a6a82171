"""Awkward texts through detection and all parsers: very long lines, many fields, control characters."""

import pytest

from timberline.operators.detect import detect_types
from timberline.operators.entries import entries
from timberline.plans import analyze as an
from timberline.sources.lines import LINES_SCHEMA

N = 100_000
TEXTS = {
    "fields": ",".join(["1"] * N), "quoted": ",".join(['"a b"'] * N), "quotes": '"' * N, "half": '"a""' * N, "brackets": "[" * N + "]" * N,
    "braces": "{" * N, "json": '{"a":' * 500 + "1" + "}" * 500, "blanks": "a" + " " * N + "b", "commas": "," * N, "padded": "a , " * N,
    "digits": "1." * N, "words": "word " * N, "one": "x" * N, "numbers": "1 " * N,
    "control": "".join(map(chr, range(1, 32))) + "\x7f\x85  end", "marks": "\x01\x02\x03" * 1000,
    "access": '10.0.0.1 - - [18/Jul/2025:14:30:00 +0500] "GET /' + "p" * N + ' HTTP/1.1" 200 5 "' + "r" * N + '" "' + "u" * N + '" rt=1.5',
    "error": "2025/07/18 14:30:00 [error] 1#2: *3 " + "client: " * N,
    "container": "2025-07-18T14:30:00.000Z stdout F " + "deadbeef " * N,
    "syslog": "Jul 18 14:30:00 host kernel: " + "WARNING: assertion failed " * (N // 10),
    "database": "2025-07-18 14:30:00.000 UTC [5] LOG:  duration: 5.5 ms  statement: SELECT * FROM t WHERE id IN (" + "1, " * N + "1)",
    "vacuum": '2025-07-18 14:30:00.000 UTC [5] LOG:  autovacuum: for table "public.t": ' + "9 dead tuples, " * N,
    "api": '{"time":"2025-07-18T14:30:00Z","msg":"' + "m" * N + '","level":"info"}',
    "results": "2025-07-18,\"{'error': '" + "e" * N + "'}\"",
}
NAMES = sorted(TEXTS)


@pytest.fixture(scope="module")
def lines(spark):
    """Each text in the middle of a container log and again as the first line of a source."""
    plain = [f"2025-07-18T14:30:0{i}.000Z stdout F fine {i}" for i in range(8)]
    rows = [(f"mid {n}", i, v) for n in NAMES for i, v in enumerate([*plain[:4], TEXTS[n], *plain[4:]])]
    rows += [(f"top {n}", i, v) for n in NAMES for i, v in enumerate([TEXTS[n], *plain])]
    rows += [("nulls", 0, None), ("nulls", 1, "")]
    return spark.createDataFrame(rows, LINES_SCHEMA).repartition(4).cache()


def test_detection(lines):
    found = {r["source"]: r for r in detect_types(lines).collect()}
    assert len(found) == 2 * len(NAMES) + 1
    assert all(found[f"mid {n}"]["log_type"] in ("container", "api_backend") for n in NAMES)
    assert found["nulls"]["log_type"] is None


def test_four_fields_make_a_table_row(spark):
    cases = {"a,b,c,d": 1, "a,b,c": 0, '"x","y z" , "q",1': 1, "1,1,1,1,1": 1, ", ,b,c,d": 0, 'a," ",b,c': 1, "a, ,b,c": 1, 'a,,b,c,d': 0, 'a,"b,c,d': 0,
             ' "a" ,b,c,d': 1, "a ,b ,c ,d": 1, '""," ",1,2': 1, 'a,b,c, "d"': 1, 'a,b,c,"': 0}
    rows = [(s, 0, "h1,h2,h3,h4") for s in cases] + [(s, i, s) for s in cases for i in (1, 2)]
    import re

    plain = re.compile(r'^(?:"[^"]*"|[^",]+)(?:\s*,\s*(?:"[^"]*"|[^",]+)){3,}')
    for text, want in cases.items():
        assert bool(plain.search(text.strip())) == bool(want), text
    from timberline.operators.detect import _matches
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(s.strip(),) for s in cases], "t string").select("t", _matches(F.col("t"), "csv").alias("m")).collect()
    names = re.compile(r'^"?[a-zA-Z_][a-zA-Z0-9_]*"?\s*,\s*"?[a-zA-Z_][a-zA-Z0-9_]*"?\s*,\s*"?[a-zA-Z_][a-zA-Z0-9_]*"?')
    for r, (s, want) in zip(got, cases.items()):
        assert r["m"] == (bool(want) or bool(names.search(s.strip()))), s
    assert detect_types(spark.createDataFrame(rows, LINES_SCHEMA)).count() == len(cases)


@pytest.mark.parametrize("log_type", list(an.PARSERS))
def test_parsers(lines, log_type):
    typed = an.parse(lines, log_type)
    rows = typed.select("source", "line_no", "parsed", "blank").collect()
    assert len(rows) == lines.count()
    own = {"nginx_access": "access", "nginx_error": "error", "container": "container", "syslog": "syslog", "postgres": "database", "api_backend": "api"}
    if log_type in own:
        found = {(r["source"], r["line_no"]): r["parsed"] for r in rows}
        assert found[f"mid {own[log_type]}", 4] and found[f"top {own[log_type]}", 0]
    # every column of every row is computed
    assert entries(typed).select(*[c for c, t in typed.dtypes if not t.startswith("map") and c not in ("parsed", "blank")]).distinct().count() > 0
