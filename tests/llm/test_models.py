"""Trained operators and scans against plain loops: bit classifiers, base phrases, trees, passages, nearest neighbours."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import language, licenses, neighbours, quality, toxicity

CLASH = "lang_pred string, score string, held string, labels string"
AWKWARD = [None, "", " \n\t", "x", "\x00", "\x02\x03", "ÀÉ ñ", "12 34 56", "word " * 200_000, "a" * 300_000, "中文 字", "😀"]


# language


def _grams(text):
    """Hashed counts of byte n-grams by slicing."""
    raw = [b if b >= 128 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode()]
    letters = [b for i, b in enumerate(raw) if i == 0 or b != 32 or raw[i - 1] != 32]
    counts = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            code = 0
            for b in letters[i:i + n]:
                code = code * 256 + b
            counts[((code + (n << 25)) * 2654435761 % 2**32) >> 18] += 1
    return counts


def test_gram_counts_by_slicing():
    for text in ("the cat", "Éa  b\n\n1c", "x", "", "über den Wolken 99 luft", "中文 字"):
        got = language.gram_counts(text)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(_grams(text))


def test_language_by_plain_loops(spark):
    rnd = random.Random(3)
    words = {"aa": "ba be bi bo bu".split(), "bb": "kra kre kri".split(), "cc": "ñot ñet zit".split(), "dd": "wum wem wam".split()}
    train = [(lang, " ".join(rnd.choice(w) for _ in range(20))) for lang, w in words.items() for _ in range(12)]
    rows = [(i, t, lang, *[None] * 4) for i, (lang, t) in enumerate(train)]
    rows += [(100 + i, t, "aa" if i % 2 else None, *[None] * 4) for i, t in enumerate(AWKWARD)] + [rows[0], rows[0], (None, "ba be", None, *[None] * 4)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {CLASH}")
    is_train = F.col("doc_id") < 48
    got = {(r.doc_id, r.lang_pred): r.score for r in language.identify(docs, is_train).collect()}
    # the same model by loops: log likelihood ratios per bit, margins, weighted exponential loss
    used = train + [train[0], train[0]]
    counts = {lang: collections.Counter() for lang in words}
    for lang, text in used:
        counts[lang].update(_grams(text))
    langs, buckets = sorted(words), 1 << 14
    share = {a: [(counts[a][g] + 0.5) / (sum(counts[a].values()) + 0.5 * buckets) for g in range(buckets)] for a in langs}
    code = language.codewords(4)
    assert len({tuple(row) for row in code}) == 4 and all(set(col) == {-1, 1} for col in code.T)

    def bit_score(bit, g):
        plus = [share[a][g] for a, c in zip(langs, code[:, bit]) if c > 0]
        minus = [share[a][g] for a, c in zip(langs, code[:, bit]) if c < 0]
        return math.log(sum(plus) / len(plus)) - math.log(sum(minus) / len(minus))

    bits = range(code.shape[1])
    scores = [[bit_score(b, g) for g in range(buckets)] for b in bits]
    expected = [[sum(p * s for p, s in zip(share[a], scores[b])) * code[i][b] for b in bits] for i, a in enumerate(langs)]
    scale = [1 / max(sum(abs(expected[i][b]) for i in range(4)) / 4, 1e-9) for b in bits]
    weight = [[max(expected[i][b] * scale[b], 0.05) for b in bits] for i in range(4)]
    weight = [[w / sum(row) for w in row] for row in weight]
    for doc_id, text, *_ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert got[doc_id, "und"] == 0.0
            continue
        if len(text) > 1000:
            assert any(k[0] == doc_id for k in got)
            continue
        own = _grams(text)
        margin = [sum(n * scores[b][g] for g, n in own.items()) / sum(own.values()) * scale[b] for b in bits]
        loss = [sum(w * math.exp(-max(-8, min(8, c * m))) for w, c, m in zip(weight[i], code[i], margin)) for i in range(4)]
        best = min(range(4), key=lambda i: loss[i])
        near = sum(math.exp(-4 * (x - loss[best])) for x in loss)
        assert got[doc_id, langs[best]] == pytest.approx(1 / near, abs=1e-9)
    assert language.identify(docs.limit(0), is_train).count() == 0


def test_equal_losses_go_to_the_first_language():
    model = language.Model(["a", "b"], np.array([[1.0], [-1.0]]), np.zeros((1 << 14, 1)), np.ones((2, 1)), np.ones(1), 0.1)
    assert model.decode(["text"]) == [("a", 0.5, True)]


# licences


def test_base_phrases_by_regex(spark):
    rnd = random.Random(4)
    parts = ["cc", "by", "CC", "By", "general", "public", "license", "All", "rights", "reserved", "mit", "-", ".", "_", "é", "cc0", "\n", "  ", "x", "\x00"]
    texts = ["".join(rnd.choice(parts) + rnd.choice([" ", " ", "", "-", "\n"]) for _ in range(rnd.randrange(1, 60))) for _ in range(400)]
    texts += AWKWARD + ["cc by " * 50_000, "general public license " * 3, "cc cc by by", "lesser general public license", "All-Rights/Reserved"]
    rows = [(i, t, *[None] * 4) for i, t in enumerate(texts)] + [(0, texts[0], *[None] * 4), (None, "cc by", *[None] * 4)]
    got = licenses.scan(spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")).collect()
    assert len(got) == len(rows)
    word, phrases = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in phrases.items() for i in range(len(words)) if words[i:i + phrase.count(" ") + 1] == phrase.split()] \
            if len(words) < 1000 else None
        r = by_id[doc_id]
        assert r.n_words == len(words) and 0 <= r.score <= 1
        if places is not None:
            assert r.n_base == len(places)
            assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
            assert r.base_labels == ",".join(sorted({label for _, label in places}))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert by_id[texts.index("cc by " * 50_000)].n_base == 50_000


# quality


def test_trees_by_walking():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 7] < -0.2)).astype(float)
    forest = quality.boost(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + math.exp(-max(-30, min(30, total))))

    assert forest.score(x) == pytest.approx([walk(r) for r in x], abs=1e-12)
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    held = rng.normal(size=(200, len(quality.STATISTICS)))
    assert ((forest.score(held) > 0.5) == ((held[:, 2] > 0.3) ^ (held[:, 7] < -0.2))).mean() > 0.85


def test_quality_and_toxicity_of_awkward_texts(spark):
    rnd = random.Random(6)
    good = [". ".join(" ".join(rnd.choice("the river runs over old stones and under trees".split()) for _ in range(8)).capitalize() for _ in range(6)) for _ in range(60)]
    bad = [" ".join(rnd.choice(["$$$", "###", "buy", "zorgvile", "NOW", "<|>"]) for _ in range(50)) for _ in range(60)]
    texts = good + bad + AWKWARD
    rows = [(i, t, *[None] * 4) for i, t in enumerate(texts)] + [(3, good[0], *[None] * 4), (None, good[1], *[None] * 4)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")
    labels = spark.createDataFrame([(i, int(i < 60), int(60 <= i < 120)) for i in range(0, 120)] + [(500, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    train = F.col("doc_id") % 4 != 0
    for module, right in ((quality, lambda i: i < 60), (toxicity, lambda i: i >= 60)):
        got = module.classify(docs, labels, train).select("doc_id", "score").collect()
        assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        held = [(r.score >= 0.3) == right(r.doc_id) for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 4 == 0]
        assert sum(held) / len(held) > 0.95
        # the same again, also from other partitions; nothing learnt gives one score for all
        again = module.classify(docs.repartition(5), labels, train).select("doc_id", "score").collect()
        assert sorted((r.doc_id or -1, round(r.score, 12)) for r in got) == sorted((r.doc_id or -1, round(r.score, 12)) for r in again)
        assert {r.score for r in module.classify(docs, labels.limit(0), train).select("score").collect()} == {0.5}
        assert module.classify(docs.limit(0), labels, train).count() == 0


# toxicity


def _passage_score(model, text):
    """The most toxic passage by loops over words and n-grams."""
    words, buckets, w = (text or "").lower().split(), len(model.gram_scores), model.window

    def bucket(gram):
        code = 2166136261
        for c in gram:
            code = ((code ^ ord(c)) * 16777619) % 2**32
        return (((code ^ (code >> 15)) * 2654435761 % 2**32) >> 8) % buckets

    def word_score(word):
        marked = "\x02" + word + "\x03"
        grams = [marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        return sum(model.gram_scores[bucket(g)] for g in grams) / len(grams)

    n = max(1, len(words) // w)
    passages = [words[i * w:(i + 1) * w if i < n - 1 else None] for i in range(n)]
    best = max(sum(map(word_score, p)) / len(p) if p else 0.0 for p in passages)
    return 1 / (1 + math.exp(-max(-30, min(30, best + model.bias))))


def test_toxic_passages_by_loops():
    rng, rnd = np.random.default_rng(7), random.Random(7)
    model = toxicity.Model(rng.normal(size=1 << 12), -0.3, 4)
    words = ["ab", "c", "Ünder", "x\x02y", "\x03", "long" * 20, "😀", "q\x00"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 23))) for _ in range(120)] + [None, "", " \n"]
    assert model.score(texts) == pytest.approx([_passage_score(model, t) for t in texts], abs=1e-9)


# nearest neighbours


def _recall(spark, x, step=40, k=20):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collections.defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % step == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in range(0, len(x), step):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores, kind="stable")[:k].tolist()))
        total += k
    return hits / total


def _mixed(n, seed):
    """Unit vectors with a common mean; some much longer, and a dense third."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24)) + 2 * rng.normal(size=24)
    x[:n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5:9] *= 10
    return x


def test_nearest_with_mixed_norms_and_a_dense_third(spark):
    assert _recall(spark, _mixed(3000, 1)) >= 0.9


def test_cells_are_bounded(spark):
    x = _mixed(6000, 2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, embedding array<double>")
    dims = 25
    halves = neighbours.packed(rows, 10.0, dims)
    for cell in (100, 400):
        sizes = neighbours.cells(halves, dims, 6000, 4, cell, 3).groupBy("cell").count().collect()
        assert sum(r["count"] for r in sizes) == 4 * 6000 and max(r["count"] for r in sizes) <= 1.5 * cell
