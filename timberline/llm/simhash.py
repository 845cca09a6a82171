"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; two link at `distance` or fewer differing bits. The bits are cut into `segments` parts that form
a ring. If two fingerprints differ in at most t bits, then from some part on, every chain of l consecutive parts holds
at most l * t / m of them (the strong form of the pigeonhole principle). Chains of two parts are the join key: with 5
parts and t = 4 the first part agrees and the second differs in one bit at most, so one side stores its 5 keys of two
parts and the other looks up the 14 spellings of each. Chains of three and four parts and the full distance are
checked on what the keys bring together.

Equal fingerprints are folded to one class before anything is joined, so copies cost one row however many there are.
Links go only into components; pairs of documents are never listed.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; a null id keeps its row and
its component has the least non-null id (null if there is none); repeated rows stay rows; an empty table gives an empty
result; only the id, the text and the columns in `carry` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm import common
from timberline.llm.components import components

SEED = 42
BITS = 64


def shingle_hashes(text: str | None, words_each: int = 4) -> np.ndarray:
    """The hashes of all shingles of the text, repeated ones included; none for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_each + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(
        starts[:n].tolist(), ends[min(words_each, len(words)) - 1:].tolist())], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at:at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles of the text."""
    return majority(shingle_hashes(text, words_each))


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = (), words_each: int = 4) -> DataFrame:
    """doc_id, `carry` and fp, the fingerprint as a signed long."""
    rows = docs.select("doc_id", *carry, "text")
    schema = rows.drop("text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words_each) for t in batch.column("text")], dtype=np.uint64)
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _parts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each part."""
    at, out = 0, []
    for i in range(segments):
        width = BITS // segments + (i < BITS % segments)
        out.append((at, width))
        at += width
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(fps: DataFrame, distance: int = 4, segments: int = 5) -> DataFrame:
    """(a, b), a < b: the distinct values of column fp that differ in 1 to `distance` bits. Exact, by pigeonring keys.

    The key takes chains of one part (no difference) and two (one at most), so `distance` lies between segments / 2
    and segments - 1.
    """
    if not segments <= 2 * distance < 2 * segments:
        raise ValueError("the keys take a first part without and a second with one difference")
    parts = _parts(segments)

    def part(i: int) -> Column:
        shift, width = parts[i % segments]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    def key(i: int, second: Column) -> Column:
        return part(i) * F.lit(1 << 20) + second + F.lit(i << 40)

    spellings = [key(i, part(i + 1).bitwiseXOR(F.lit(flip)))
                 for i in range(segments) for flip in [0, *(1 << b for b in range(parts[(i + 1) % segments][1]))]]
    asked = fps.select(F.col("fp").alias("a"), F.explode(F.array(*spellings)).alias("key"))
    held = fps.select(F.col("fp").alias("b"), F.explode(F.array(*(key(i, part(i + 1)) for i in range(segments)))).alias("key"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("key", 40).cast("int")
    within = F.bit_count(differ) <= distance
    for length in range(3, segments):
        masks = [_signed(sum(((1 << parts[(i + j) % segments][1]) - 1) << parts[(i + j) % segments][0] for j in range(length)))
                 for i in range(segments)]
        mask = F.element_at(F.array(*(F.lit(m).cast("long") for m in masks)), start + 1)
        within = (F.bit_count(differ.bitwiseAND(mask)) <= length * distance // segments) & within
    joined = asked.join(held, (asked["key"] == held["key"]) & (F.col("a") < F.col("b")))
    return joined.select("a", "b", asked["key"].alias("key")).where(within).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), words_each: int = 4, distance: int = 4,
                    segments: int = 5) -> DataFrame:
    """One row per document: doc_id, `carry`, fp, component_id (the least doc_id that links reach)."""
    prints = common.stored(fingerprints(docs, carry, words_each), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.xxhash64("fp"))
    classes = common.stored(classes, "classes")
    found = links(classes.select("fp"), distance, segments)
    # the hash of one long is a bijection: it only shuffles the order of nodes, as contraction wants
    roots = components(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", *carry, "fp", "component_id")
