"""The outlier estimate against plain numpy, and shards of the mix."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import mixing, rules

NAMES = list(rules.FLOOR)


def _vectors(seed, n):
    """Correlated statistics: mean word length and variety rise together, and so do symbols and capitals."""
    rng = np.random.default_rng(seed)
    a, b, c, d = (rng.normal(size=n) for _ in range(4))
    x = np.stack([1600 + 60 * a, 400 + 80 * b, 100 + 25 * c, 120 + 30 * d, 500 + 90 * (0.97 * b + 0.24 * c), 950 + 30 * (0.98 * a + 0.2 * d)], axis=1)
    far = np.arange(0, 24)
    # against the correlation, but inside 2.3 spreads in every single statistic
    x[far, 0], x[far, 5] = 1600 + 60 * 2.1, 950 - 30 * 2.1
    alone = np.arange(24, 34)  # far off in one
    x[alone, 1] = 2000
    return np.rint(x).astype(np.int64)


def _plain(x, share, steps, joint=True):
    """Squared distances from a minimum-covariance-determinant estimate by concentration steps."""
    floor = np.array([rules.FLOOR[k] for k in NAMES], dtype=float)
    ordered = np.sort(x, axis=0)
    n = len(x)
    low, middle, high = (np.quantile(ordered, q, axis=0) for q in (0.25, 0.5, 0.75))
    mean, cov = middle, np.diag(((high - low) / 1.349) ** 2 + floor**2)
    for _ in range(steps):
        d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
        own = x[np.argsort(d, kind="stable")[:int(np.ceil(share * n))]]
        mean = own.mean(axis=0)
        cov = np.cov(own.T, bias=True) * rules.consistency(share, x.shape[1]) + np.diag(floor**2)
    if not joint:
        cov = np.diag(np.diag(cov))
    return ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)


def test_estimate_equals_plain_numpy(spark):
    cells = {"a": _vectors(1, 600), "b": _vectors(2, 400) + 50, "small": _vectors(3, 60)}
    rows = [(f"{cell}{i}", cell, False, *map(int, v)) for cell, x in cells.items() for i, v in enumerate(x)]
    rows += [("failed", "a", True, *[0] * len(NAMES))]
    frame = spark.createDataFrame(rows, "id string, cell string, base_failed boolean, " + ", ".join(f"x_{k} long" for k in NAMES))
    got = {r.id: r.distance for r in rules.distances(frame).select("id", "distance").collect()}
    cutoff = 3 * rules.chi2_point(0.999, len(NAMES))
    assert cutoff == pytest.approx(3 * 22.4577, rel=1e-4)
    assert got["failed"] is None and all(got[f"small{i}"] is None for i in range(60))
    for cell in ("a", "b"):
        want, alone = _plain(cells[cell], 0.75, 4), _plain(cells[cell], 0.75, 4, joint=False)
        own = np.array([got[f"{cell}{i}"] for i in range(len(want))])
        assert ((own > cutoff) == (want > cutoff)).all()
        assert np.abs(np.log(own[:34] / want[:34])).max() < 0.25
        # the joint outliers fall to the covariance only; the others to both
        assert (own[:34] > cutoff).all() and not (alone[:24] > cutoff).any() and (alone[24:34] > cutoff).all()
        assert (own[34:] > cutoff).mean() < 0.01


def test_clean_and_junk_documents(spark):
    import random

    rnd = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in ("a", "or", "in", "une") for c in ("t", "ma", "sel")]

    def prose(n):
        return "\n".join(" ".join(rnd.choice(words).capitalize() if i == 0 else rnd.choice(words) for i in range(rnd.randrange(7, 14))) + "." for _ in range(n))

    rows = [(i, prose(rnd.randrange(8, 40)), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(rnd.choice(["###", "$$$", "<|>", "%%%", rnd.choice(words)]) + str(rnd.randrange(900)) for _ in range(200)), "en", "s") for i in range(25)]
    rows += [(2000 + i, "few", "en", "s") for i in range(3)] + [(None, None, None, None), (1, "", None, "t")]
    out = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = collections.Counter((r.doc_id // 1000, r.kept) for r in out if r.doc_id is not None and r.doc_id != 1)
    assert kept[0, True] >= 395 and kept[1, False] == 25 and kept[2, False] == 3
    assert all(not r.kept and r.base_failed and r.distance is None for r in out if r.n_words < 50)


def test_long_words_are_clamped(spark):
    rows = [(1, "x" * 10_000_000), (2, " ".join(["y"] * 100))]
    frame = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = rules._features(rules.measures(frame)).collect()
    assert {r.doc_id: r.x_length for r in got} == {1: 8000, 2: 0}


# mixing


def test_every_shard_has_its_share(spark):
    rng = np.random.default_rng(5)
    shares = {"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 60))), [*shares][int(rng.choice(4, p=[*shares.values()]))]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block_docs=4, shard_blocks=40).select("doc_id", "source", "size", "target", F.inline("draws")).collect()
    by_shard, words, target = collections.defaultdict(collections.Counter), collections.Counter(), {}
    for r in got:
        by_shard[r.shard][r.source] += r["size"]
        words[r.source] += r["size"]
        target[r.source] = r.target
    assert len(by_shard) >= 32
    whole = sum(words.values())
    for source, t in target.items():
        assert abs(words[source] - t) <= 60
        own = np.array([c[source] / sum(c.values()) for c in by_shard.values()])
        # near the source's share in all shards, early and late ones alike
        assert abs(own.mean() - words[source] / whole) < 0.02 and own.std() < 0.15  # about 25 blocks a shard
        ordered = [by_shard[s][source] for s in sorted(by_shard)]
        third = len(ordered) // 3
        assert abs(sum(ordered[:third]) - sum(ordered[-third:])) < 0.35 * sum(ordered[:third])
    sizes = [sum(c.values()) for c in by_shard.values()]
    assert max(sizes) < 1.5 * min(sizes)
    # each draw of a document lies in a place of its own
    assert len({(r.shard, r.place) for r in got}) == len(got)


def test_tree_of_many_sources_is_sparse(spark):
    quotas = spark.createDataFrame([(f"s{i}", 1 + (i % 7 == 0)) for i in range(3000)] + [("none", 0)], "skey string, quota long")
    leaves = mixing.split_tree(quotas, 7).collect()
    assert all(r.blocks > 0 for r in leaves) and len(leaves) <= 3000 + 429
    per_shard, per_source = collections.Counter(), collections.defaultdict(list)
    for r in leaves:
        per_shard[r.shard] += r.blocks
        per_source[r.skey].append((r.first, r.blocks))
    assert len(per_shard) == 128 and max(per_shard.values()) - min(per_shard.values()) <= 1
    for i in range(3000):
        spans = sorted(per_source[f"s{i}"])
        assert [f for f, _ in spans] == [sum(b for _, b in spans[:k]) for k in range(len(spans))]
        assert sum(b for _, b in spans) == 1 + (i % 7 == 0)
