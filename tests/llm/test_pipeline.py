"""corpus_pipeline.run and its stages against plain Python, stage by stage."""

import collections
import hashlib
import math
import random
import re

import pytest
import xxhash

import corpus_pipeline

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, stays boolean, root string"
SPACE = " \t\n\x0b\f\r"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _rows():
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ré", "SO", "ta", "vu") for b in range(60)]

    def lines(n):
        return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(8, 16))) for _ in range(n)]

    rows = []

    def add(doc_id, text, source="s1", lang="en"):
        rows.append((doc_id, text, lang, source, len(text or "")))

    for i in range(40):
        add(10 * i + 5, "\n".join(lines(rnd.randrange(6, 14))), rnd.choice(["s1", "s2", "s3", "s4", None, ""]), rnd.choice(["en", "fr", None]))
    for i in range(0, 30, 3):  # near copies: one word of each changed
        base = rows[i][1].split(" ")
        for k in range(rnd.randrange(1, 4)):
            own = list(base)
            own[rnd.randrange(len(own))] = f"edit{i}x{k}"
            # a fresh first line keeps the shared lines from being the whole text
            add(1000 + 10 * i + k, " ".join(w.replace("\n", " ") for w in own), rnd.choice(["s1", "s5"]))
    for k in range(3):
        add(2000 + k, rows[1][1].replace("\n", " "), "s2")  # copies of each other
    add(None, " ".join(lines(9)))
    add(None, rows[-1][1], "s3")
    add(None, rows[-1][1] + " tail", "s3")
    add(7, " ".join(lines(8)))  # an id that stands twice with different texts, one of them a near copy of 8
    add(7, " ".join(lines(8)))
    add(8, rows[-1][1] + " more")
    add(6, rows[-1][1] + " most")
    rows.append(rows[3])  # a repeated row
    rows.append((9, " ".join(lines(8)), "en", "s2", 1))
    rows.append((9, rows[-1][1], "de", "s1", 2))  # equal id and text, other columns
    for text in (None, "", " \n ", "few words only", "again and again " * 60, "\n".join(["the same line"] * 30)):
        add(3000 + len(rows), text)
    return rows


def _quality(rows):
    """No cell has 100 documents, so only the base rules decide."""
    def keep(text):
        w = WORD.findall(text or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        again = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for j in range(i, i + 3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    return [r for r in rows if keep(r[1])]


def _line_dedup(rows):
    def key(line):
        return _lower(line).strip(SPACE)

    last = 2**63 - 1
    owner = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), last), last if r[0] is None else r[0])
    out = []
    for r in rows:
        own = last if r[0] is None else r[0]
        text = "\n".join(x for x in (r[1] or "").split("\n") if len(key(x)) < 10 or owner[key(x)] == own)
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def _near_dedup(rows):
    def shingles(text):
        w = _lower(text).encode().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def least(r):
        return tuple((x is not None, x if x is not None else 0) for x in (r[2], r[3], r[4]))

    sets, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or (a and b and len(a & b) / len(a | b) >= 0.8):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]

    def order(r):
        text = "" if not WORD.search(r[1] or "") else r[1]
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return (r[0] is None, r[0] or 0, h - 2**64 if h >= 2**63 else h)

    out = []
    for g in set(group):
        own = [r for r, of in zip(rows, group) if of == g]
        first = min(map(order, own))
        out.append(min((r for r in own if order(r) == first), key=least))
    return out


def _targets(rows):
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        among = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / among for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            return size, target
        full |= over


def _mixed(rows):
    size, target = _targets(rows)
    out = collections.Counter()
    for source in size:
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (
            hashlib.md5(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
        for turn in range(2):
            at = turn * size[source]
            for r in own:
                n = len(WORD.findall(r[1] or ""))
                if n and at + n / 2 <= target[source] + 1e-9:
                    out[r] += 1
                at += n
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 7, True, "clash") for r in rows], SCHEMA)


def _same(got, want):
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def chain():
    rows = _rows()
    kept = _quality(rows)
    lines = _line_dedup(kept)
    single = _near_dedup(lines)
    return rows, kept, lines, single, _mixed(single)


def test_stages(spark, chain):
    rows, kept, lines, single, mixed = chain
    # the fixture exercises every stage
    assert len(rows) - len(kept) >= 5 and lines != kept and len(single) < len(lines) - 10 and max(mixed.values()) == 2
    given = [rows, kept, lines, single]
    want = [kept, lines, single, list(mixed.elements())]
    for (name, stage), have, wanted in zip(corpus_pipeline.STAGES, given, want):
        out = stage(spark, _frame(spark, have), "unused")
        assert out.columns == corpus_pipeline.COLUMNS, name
        _same(out, wanted)


def test_run(spark, chain, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, *_, mixed = chain
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r, n in mixed.items():
        want[r[0]] += n * (len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    got = collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert math.ceil(sum(want.values()) / 1024) <= len(by_sequence)


def test_stages_of_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, _frame(spark, []), "unused").count() == 0, name


def test_near_dedup_drops_by_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", "s", 1), (None, f"{text} x", "a", "s", 1), (None, f"{text} y", "a", "s", 1), (2, f"{text} z", "a", "s", 1),
            (2, " ".join(f"other{i}" for i in range(60)), "a", "s", 1), (None, "null null null", "a", "s", 1), (None, "null null null", None, "s", 1)]
    out = corpus_pipeline.near_dedup(spark, _frame(spark, rows), "unused")
    _same(out, [rows[0], rows[4], rows[6]])
