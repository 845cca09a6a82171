"""Operators against brute-force versions on one small table of awkward documents."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from timberline.llm import language, licenses, lines, mixing, neighbours, overlaps, packing, quality, rules, simhash, toxicity

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines string, h1 string, size string"

PIPELINE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rnd = random.Random(3)
    words = ["al", "bo", "cid", "dor", "Éna", "fu,", "gar.", "HOP", "ilk", "jam"]

    def prose(n):
        return "\n".join(" ".join(rnd.choice(words) + str(rnd.randrange(60)) for _ in range(rnd.randrange(5, 30))) for _ in range(n))

    texts = [prose(rnd.randrange(1, 9)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].replace("\n", " \n"), texts[2] + " end", None, "", " \n\t", "\n\n", "x", "A shared line here\n" + prose(3),
              " a SHARED line here \t\n" + prose(2), "same same " * 3000, "$$$ *** " * 80, "İstanbul KELVIN K A\u0085b"]
    rows = [(i * 3, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", None, ""]), 0, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[3], None, None, 0, None, None, None)]


DOCS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_line_dedup(docs, none):
    space = " \t\n\x0b\f\r"
    owner = {}
    for row in DOCS:
        for x in (row[1] or "").split("\n"):
            k = _lower(x).strip(space)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, 2**63 - 1), 2**63 - 1 if row[0] is None else row[0])
    want = []
    for row in DOCS:
        own, all_lines = 2**63 - 1 if row[0] is None else row[0], (row[1] or "").split("\n")
        kept = [x for x in all_lines if len(_lower(x).strip(space)) < 10 or owner[_lower(x).strip(space)] == own]
        want.append((row[0], len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    for batches, fanout in ((4, 2), (1, 2)):
        out = lines.line_dedup(docs, ("source",), batches=batches, fanout=fanout).select(
            "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert lines.line_dedup(none).count() == 0


def test_simhash(docs, none):
    def brute(text):
        w = [x.encode() for x in WORD.findall(_lower(text))]
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    fps = [brute(r[1]) for r in DOCS]
    group = list(range(len(DOCS)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = collections.defaultdict(lambda: 2**70)
    for g, r in zip(group, DOCS):
        least[g] = min(least[g], 2**70 if r[0] is None else r[0])
    got = simhash.near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    want = [(r[0], f, least[g]) for r, f, g in zip(DOCS, fps, group)]
    assert sorted(map(repr, ((r[0], r[1] % 2**64, r[2]) for r in got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(none).count() == 0


def test_links_are_complete(spark):
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    values = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for s in seeds for _ in range(5)}
    signed = {v - 2**64 if v >= 2**63 else v for v in values}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4}


def test_near_copies_are_complete(spark, docs, none):
    rnd = random.Random(5)
    rows = []
    for g in range(30):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 9, 40, 120, 300]))]
        for _ in range(6):  # one edit costs up to 5 shingles
            own = list(base)
            for _ in range(rnd.randrange(1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(400)}"
            rows.append((len(rows) * 7 % 180, " ".join(own)))

    def sets(text):
        w = _lower(text).encode().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for table, given in ((docs, [r[:2] for r in DOCS]), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        members, group = [sets(t) for _, t in given], list(range(len(given)))
        far = 0
        for i, a in enumerate(members):
            for j, b in enumerate(members[:i]):
                if 10 * len(a & b) >= 8 * len(a | b):
                    far += (simhash.fingerprint(given[i][1]) ^ simhash.fingerprint(given[j][1])).bit_count() > 4
                    group = [group[j] if g == group[i] else g for g in group]
        least = collections.defaultdict(lambda: 2**70)
        for g, (doc_id, _) in zip(group, given):
            least[g] = min(least[g], 2**70 if doc_id is None else doc_id)
        got = overlaps.near_copies(table).select("doc_id", "component_id").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, least[g])) for g, (d, _) in zip(group, given))
    assert far > 20  # similar pairs that a distance of 4 bits does not reach
    assert overlaps.near_copies(none).count() == 0


def test_pipeline_drops_similar_documents(spark):
    words = [f"w{i}" for i in range(200)]
    near = [w if i not in (20, 90) else "x" for i, w in enumerate(words)]
    assert overlaps.similarity(" ".join(words), " ".join(near)) > 0.8
    assert (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(near))).bit_count() > 4
    table = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, " ".join(near), "en", "s", 0)], PIPELINE_SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, table, "").collect()] == [1]


def test_mixing(docs, none):
    size = collections.Counter()
    for r in DOCS:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    mixed = mixing.mix(docs, block_docs=4, shard_blocks=3)
    rows = mixed.collect()
    assert len(rows) == len(DOCS)
    taken, target, longest = collections.Counter(), {}, max(r["size"] for r in rows)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and len(r["draws"]) <= 2
        assert all(d["shard"] is not None for d in r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs, block_docs=4, shard_blocks=3).collect()))
    assert mixing.mix(none).count() == 0


def test_split_tree_margins(spark):
    quotas = {"sa": 40, "sb": 9, "n": 0}
    leaves = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "skey string, quota long"), 3).collect()
    by_source, by_shard = collections.Counter(), collections.Counter()
    for r in leaves:
        by_source[r.skey] += r.blocks
        by_shard[r.shard] += r.blocks
    assert all(by_source[s] == n for s, n in quotas.items()) and set(by_shard.values()) <= {6, 7}


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    ids = {r[0]: tok.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in DOCS if r[0] is not None}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start:p.start + p.length], dtype="<u4")
        assert p.doc_tokens == len(ids[p.doc_id]) and zlib.crc32(own.tobytes()) == p.ids_crc32
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for found, whole in ((by_doc, lambda k: len(ids[k])), (by_sequence, lambda k: None)):
        for k, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == whole(k) if whole(k) else at <= 1024
    assert set(by_doc) == set(ids) and packing.pack(none).count() == 0


def test_added_tokens_keep_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    end = "<|endoftext|>"
    for text in (end, f"{end} at the start", f"a {end} b", f"twice {end}{end}\n in a row", f"x  {end}\n\n {end[:-1]}", f"<{end}>'s", ""):
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids
    assert encode(f"a {end} b").tolist() == [64, 220, 50256, 275]


def test_runs_that_the_fast_library_refuses():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    for text in (" " * 2_000_000, "\n" * 2_000_000, "ab" + " " * 1_200_000 + "cd <|endoftext|>"):
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_toxicity_of_texts_that_hold_the_word_marks():
    bad = ["ab\x02cd ef", "\x02\x03 \x03\x02 x", "".join(map(chr, range(32))) + "x", "\x00", "\x02" * 50]
    clean, toxic = [f"good plain words {i}" for i in range(40)], [f"zorgvile scum {i}" for i in range(40)]
    model = toxicity.fit([*clean, *toxic, *bad], np.array([0] * 40 + [1] * 40 + [0] * len(bad), dtype=float))
    assert np.isfinite(model.gram_scores).all() and np.isfinite(model.bias)
    scores = model.score([*bad, None, "", "good plain words", "zorgvile scum"])
    assert ((scores >= 0) & (scores <= 1)).all() and scores[-1] > 0.5 > scores[-2]
    # a text scores the same alone and among others
    for text in bad:
        assert model.score([text])[0] == pytest.approx(model.score(["other words", text, "more"])[1])


def test_repeated_ids_teach_the_same_rows_in_every_run(spark):
    rows = [(i % 5, f"text {i}", float(i)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, y int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats double")
    got = [quality.first_rows(docs.repartition(n).join(labels, "doc_id"), F.xxhash64("text"), 20)["text"].to_list() for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 20


def test_columns_of_many_values_are_no_languages(spark):
    rows = spark.createDataFrame([(f"l{i}", "some text") for i in range(30)], "lang string, text string")
    with pytest.raises(ValueError):
        language.fit(rows, most_languages=29)
    assert len(language.fit(rows, most_languages=30).languages) == 30


def test_scratch_folder_must_be_shared_on_a_cluster():
    from timberline.llm import common

    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.scratch_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:/shared/"
    assert common.scratch_dir(Session()) == "hdfs:/shared"


def test_rule_measures(docs, none):
    got = collections.Counter()
    for r in rules.measures(docs).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)] += 1
    want = collections.Counter()
    for d in DOCS:
        t = d[1] or ""
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        want[(d[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(cover))] += 1
    assert got == want
    out = rules.quality_rules(docs).collect()
    assert len(out) == len(DOCS) and all(not r.kept for r in out if r.base_failed)
    assert rules.quality_rules(none).count() == 0


def test_licenses(docs, none):
    machine = licenses.automaton()
    assert licenses.postfix("mit or apache-2.0 and ( bsd-3-clause )".split()) == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert licenses.postfix(["mit", "or"]) is None and licenses.postfix(["(", "mit"]) is None
    out = licenses.scan_text("# SPDX-License-Identifier: (GPL-2.0 WITH classpath-exception OR MIT)\nAll rights reserved; CC BY cc by", machine)
    assert out[1] == 3 and out[4] == "cc-by,reserved" and out[5] == "cc-by,gpl,mit,reserved"
    assert out[7][0][1:] == (True, "gpl-2.0 classpath-exception with mit or", 1)
    assert licenses.scan_text(None, machine)[:7] == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan(docs).count() == len(DOCS) and licenses.scan(none).count() == 0


def test_every_tag_of_a_line_is_parsed():
    machine = licenses.automaton()
    out = licenses.scan_text("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0 OR Apache-2.0 x", machine)
    assert out[5] == "apache,gpl,mit" and [e[:3] for e in out[7]] == [("mit", True, "mit"), ("gpl-2.0 or apache-2.0", True, "gpl-2.0 apache-2.0 or")]
    out = licenses.scan_text("é SPDX_License_Identifier: MIT\nspdx  license\nidentifier isc or\nlicense expression", machine)
    assert [e[:2] for e in out[7]] == [("mit", True), ("isc or", False), ("", False)] and out[5] == "mit"


def test_language(spark, none):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat and the dog were in the garden with them", "en"), ("le chat et le chien dans le jardin avec eux", "fr"),
        ("der Hund und die Katze waren in dem Garten", "de")] * 5)] + [(90, None, "en"), (91, "12 34", "fr"), (92, "the dog", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table, F.col("doc_id") < 9).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:15]) and got[92].lang_pred == "en"
    assert got[90].lang_pred == got[91].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(none, F.lit(True)).count() == 0


def test_classifiers(spark, docs, none):
    rnd = random.Random(4)
    bad, good = ["grumf", "blarg"], ["sun", "tree", "lake", "bird", "road", "wind"]
    rows = []
    for i in range(160):
        words = [rnd.choice(good) + rnd.choice("aeiou") for _ in range(rnd.randrange(20, 60))]
        if i % 2:
            words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice("aeiou")
        rows.append((i, " ".join(words).upper() + "!!" if i % 3 == 0 else " ".join(words), i % 3 != 0, i % 2))
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2]), r[3]) for r in rows], "doc_id long, quality int, toxic int")
    train = F.col("doc_id") < 120
    for classify, at in ((quality.classify, 2), (toxicity.classify, 3)):
        got = {r.doc_id: r.score for r in classify(table, labels, train).collect()}
        assert sum((got[r[0]] >= 0.3) == bool(r[at]) for r in rows[120:]) >= 37
        assert classify(docs, labels, train).count() == len(DOCS) and classify(none, labels, train).count() == 0
        assert {r.score for r in classify(table, labels.limit(0), train).collect()} == {0.5}


def test_statistics_of_very_long_texts():
    words = [f"w{i}" for i in random.Random(6).choices(range(1500), k=2_000_001)]
    got = dict(zip(quality.STATISTICS, quality.statistics(" ".join(words))))
    triples = set(zip(words, words[1:], words[2:]))
    assert got["repeated_triples"] == pytest.approx(1 - len(triples) / (len(words) - 2))
    assert got["repeated_pairs"] == pytest.approx(1 - len(set(zip(words, words[1:]))) / (len(words) - 1))
    assert dict(zip(quality.STATISTICS, quality.statistics("12345abc 678")))["words_with_letter"] == 0.5


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0])]
    got = collections.defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        scores = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-round(float(scores[i]), 9), i))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        hits += len(set(want) & {v for _, v, _ in found})
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
    assert hits >= 0.9 * 400
    assert neighbours.nearest(spark.createDataFrame(rows[400:404], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
