"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte n-grams (1 to 3, of
the lower-cased text, everything but letters folded to one blank) tells languages with +1 from those with -1 by the mean
log likelihood ratio of the grams. It is fitted from gram counts per language, so all training rows are used:
tasks count their own rows, Spark adds (language, gram) counts, and the model is languages x 16,384 numbers however
large the corpus is.

Decoding is loss-weighted: a bit weighs for a language as much as its classifier is expected to be right on that
language (its mean margin under the language's own gram distribution). The nearest codeword has the smallest
weighted exponential loss; if the next one is almost as near, the document is flagged ambiguous.

Defined results: a text that is null or has no letter is `und` with score 0; so is everything if there is no training row;
rows with null language or text teach nothing; repeated rows count repeatedly; only the id, text, language and the columns
in `carry` are read, and the language only of training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
_CHUNK = 1 << 22  # bytes of text counted at a time
UNKNOWN = "und"


def _letters_only() -> np.ndarray:
    """Byte -> itself for letters and bytes of longer characters, else a blank."""
    table = np.full(256, 32, dtype=np.uint8)
    for byte in range(256):
        if byte >= 128 or chr(byte).isalpha():
            table[byte] = byte
    return table


_TABLE = _letters_only()


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    head = text[:64]
    return any(c.isalpha() for c in head) or any(c.isalpha() for c in text[64:])


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, n = 1 to 3 bytes. Grams with two blanks in a row are left out."""
    raw = _TABLE[np.frombuffer((" " + text.lower() + " ").encode(), dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    letters = raw[keep].astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(letters), _CHUNK):
        part = letters[at:at + _CHUNK + 2]
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, 4):
            code = code[:len(part) - n + 1] * np.uint32(256) + part[n - 1:] if n > 1 else part
            own = code[:min(len(code), _CHUNK)]
            mixed = (own + np.uint32(n << 25)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return counts


def codewords(n: int, least_bits: int = 15, seed: int = 11) -> np.ndarray:
    """n codewords of +1 and -1 as rows. Every split of the languages for up to 6 of them; else the random code with
    the largest least distance out of 50, of about 10 log2(n) bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1] + [1 if bits >> i & 1 else -1 for i in range(n - 1)] for bits in range(2 ** (n - 1) - 1)]
        return np.array(columns, dtype=float).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = max(least_bits, int(10 * np.log2(n)))
    for _ in range(50):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        gram = code @ code.T
        np.fill_diagonal(gram, -bits)
        if (bits - gram.max()) / 2 > apart:
            best, apart = code, (bits - gram.max()) / 2
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    gram_scores: np.ndarray  # grams x bits
    weights: np.ndarray  # languages x bits
    scale: np.ndarray  # bits: margins are about 1 after it
    ambiguous_below: float

    def decode(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = []
        for text in texts:
            if not self.languages or not has_letter(text):
                out.append((UNKNOWN, 0.0, False))
                continue
            counts = gram_counts(text)
            seen = np.flatnonzero(counts)
            n = counts[seen]
            margins = (n @ self.gram_scores[seen]) / max(1, n.sum()) * self.scale
            loss = (self.weights * np.exp(-np.clip(self.code * margins, -8, 8))).sum(axis=1)
            order = np.argsort(loss, kind="stable")
            near = np.exp(-4 * (loss - loss[order[0]]))
            gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
            out.append((self.languages[order[0]], float(1 / near.sum()), bool(gap < self.ambiguous_below)))
        return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counts = gram_counts(text.as_py())
                totals[lang] = totals[lang] + counts if lang in totals else counts
        for lang, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen), pa.array(counts[seen])], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, ambiguous_below: float = 0.1, smoothing: float = 0.5, most_languages: int = 256) -> Model:
    """A model from all rows (lang, text) that have both. What reaches the driver is languages x grams counts; a column with over
    `most_languages` values is not one of languages and raises."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.select("lang").distinct().limit(most_languages + 1).count()
    if found > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")
    counted = count_grams(rows).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.full((len(languages), BUCKETS), smoothing)
    at = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, (counted["lang"].map(at).to_numpy(dtype=int), counted["gram"].to_numpy(dtype=int)), counted["n"].to_numpy(dtype=float))
    share = counts / counts.sum(axis=1, keepdims=True) if languages else counts
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape), np.ones(code.shape[1]), ambiguous_below)
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    gram_scores = np.log((share.T @ plus) / plus.sum(axis=0)) - np.log((share.T @ minus) / minus.sum(axis=0))
    margin = (share @ gram_scores) * code  # what each language's own texts are expected to score
    scale = 1 / np.maximum(np.abs(margin).mean(axis=0), 1e-9)
    weights = np.maximum(margin * scale, 0.05)
    return Model(languages, code, gram_scores, weights / weights.sum(axis=1, keepdims=True), scale, ambiguous_below)


def identify(docs: DataFrame, train: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `carry`, lang_pred, score, ambiguous for every row of docs; the model learns from the rows where `train`."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(train).select("lang", "text")))
    rows = docs.select("doc_id", *carry, "text")
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.decode(batch.column("text").to_pylist())
            langs, scores, unsure = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(unsure, pa.bool_())], names=schema.names)

    return rows.select(*kept, "text").mapInArrow(run, schema)
