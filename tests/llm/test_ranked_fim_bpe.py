"""Ranked search, fill-in-middle and BPE against plain versions on awkward texts."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import bpe, fim, ranked

SCHEMA = "doc_id long, text string, lang string, n long, score string, rank string, item_id string, ids string, form string, output string"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _texts():
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma9", "Éna", "naïve", "x-y", "o'neil", "中文", "KELVIN", "İz", "🙂", "Σας", "ΟΔΟΣ", "ﬁne", "éte", "꟒", "1234"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    texts += ["".join(rnd.choice(words + [" ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "<P>", "<S", ">", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"])
                      for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", " ", " \n\t ", "a", " a", "a ", "<P>", "x <M> y", "\x00\x01\x02", "beta " * 3000 + "alpha", "q" * 3000,
              "".join(rnd.choice("etaoin") for _ in range(5000)), "\n" * 5000, "a<|endoftext|><|endoftext|> b", "'S 's 'LL it's"]
    texts += [f"{chr(i)}alpha{chr(i)}" for i in range(32)]
    return texts


ROWS = [(i, t) for i, t in enumerate(_texts())]
ROWS += [ROWS[3], ROWS[3], (None, ROWS[4][1]), (None, None), (ROWS[5][0], "alpha beta gamma9")]
CLASH = (None, 7, "c", "c", "c", "c", "c", "c")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sha(data):
    return hashlib.sha256(data).hexdigest()


# ranked search


def _ranked(rows, items, k):
    own = [(i, collections.Counter(TERM.findall(_lower(t)))) for i, t in rows]
    n_docs, length = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    wanted = collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall(_lower(text)))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc_id, c in own:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * n_docs) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "alpha beta"), (2, "Alpha BETA gamma9"), (3, "gamma9 alpha beta éna"), (3, "naïve"), (4, ""), (5, None), (6, "absent words"), (None, "alpha 中文"),
         (7, "alpha beta gamma9 kelvin"), (7, "alpha beta gamma9 kelvin"), (8, "alpha"), (9, " ".join(f"t{i}" for i in range(700)) + " alpha beta x y")]


@pytest.mark.parametrize("k, most_items", [(50, 512), (3, 4), (1, 1)])
def test_search(spark, docs, k, most_items):
    items = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, score string")
    got = ranked.search(docs, items, k, most_items).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == _ranked(ROWS, ITEMS, k)


def test_search_of_empty_tables(spark, docs, none):
    items = spark.createDataFrame([i for i in ITEMS], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0
    assert ranked.search(docs, items.where("text = ''")).count() == 0


def test_many_ties_and_partitions(spark):
    rows = [(i, "same words here" if i % 3 else "same") for i in range(4000)]
    items = [(i, "same words") for i in range(5)]
    got = ranked.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == _ranked(rows, items, 50)


def test_graph_covers_each_item_once():
    rnd = random.Random(4)
    items = [sorted(rnd.sample(range(60), rnd.randrange(0, 25))) for _ in range(80)] + [list(range(40))] * 3
    graph = ranked.mine(items, 60)
    for own, nodes in zip(items, graph.items):
        assert sorted(t for n in nodes for t in graph.terms_of(n)) == own
    # sharing saves additions, and every shared set has more than one use
    uses = graph.uses()
    assert min(uses[60:]) >= 1 and (uses[60:] > 1).any()
    assert len(graph.pairs) + sum(map(len, graph.items)) < 0.9 * sum(map(len, items))
    impact = np.array([[rnd.randrange(1000) for _ in range(9)] for _ in range(60)])
    got = dict(ranked.evaluate(graph, impact, uses))
    for i, own in enumerate(items):
        assert (got[i] == impact[own].sum(axis=0)).all() if own else i not in got


# fill-in-middle


def _fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim(docs, none):
    out = fim.transformed(docs, ("lang",))
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got), key=repr) == sorted(
        (_fim(*r) for r in ROWS), key=repr)
    assert sorted((r["doc_id"], r["back"]) for r in got if r["doc_id"] is not None) == sorted((i, t or "") for i, t in ROWS if i is not None)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.transformed(none).count() == 0


def test_fim_of_long_texts():
    for text in ("ab\n c " * 300_000, " " * 1_000_000, "x" * 1_000_000, "\n" * 65 + "y"):
        for doc_id in range(6):
            assert fim.transform_text(doc_id, text) == _fim(doc_id, text)[1:]


def test_wavelet_rank():
    rnd = random.Random(8)
    for n in (0, 1, 63, 64, 65, 128, 1000):
        values = np.array([rnd.randrange(8) for _ in range(n)], dtype=np.uint8)
        matrix = fim.WaveletMatrix(values, 3)
        for c in range(8):
            assert matrix.rank(c, np.arange(n + 1)).tolist() == [int((values[:i] == c).sum()) for i in range(n + 1)]


# BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe(docs, none, library):
    got = bpe.encoded(docs, ("lang",), decode=True).collect()
    want = []
    for doc_id, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    alone = bpe.decoded(bpe.encoded(docs)).select("doc_id", "decoded").collect()
    assert sorted(map(tuple, alone), key=repr) == sorted(((w[0], w[2]) for w in want), key=repr)
    assert bpe.encoded(none).count() == 0
    assert bpe.decoded(docs.select("doc_id", F.lit(None).cast("binary").alias("ids"))).where("decoded is not null").count() == 0


def test_bpe_on_every_code_point(library):
    own = bpe.vocabulary("word_bpe_49k.json")
    texts = [f"a{chr(i)}b {chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(texts), 50_000):
        part = texts[at:at + 50_000]
        for text, made in zip(part, library.encode_batch(part, add_special_tokens=False)):
            assert own.encode(text) == np.array(made.ids, dtype="<u4").tobytes(), repr(text)


def test_bpe_merges_of_long_words(library):
    own, rnd = bpe.vocabulary("word_bpe_49k.json"), random.Random(6)
    for n in (1, 2, 3, 95, 96, 97, 98, 300, 20_000):
        for _ in range(8):
            word = "".join(rnd.choice("etaoinshrdlé") for _ in range(n))
            want = np.array(library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert own.encode(word) == want
            parts = [own.inner[b] for b in word.encode()[:-1]] + [own.last[word.encode()[-1]]]
            if n < 1000:
                assert own.scanned(list(parts)) == own.heaped(list(parts))
