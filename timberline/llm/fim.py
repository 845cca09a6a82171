"""Fill-in-middle transformation over a wavelet matrix of character classes.

A text is a sequence of code points, each of one of eight classes: what it is (white space, ASCII letter or digit, other ASCII,
beyond ASCII) and whether a unit ends with it. A unit is a run of non-blank characters with the white space before it; white
space at the end is a unit of its own. The classes are held in a wavelet matrix: one bit vector per bit of the class, with counts
of ones before every 64 bits, each level stably parted by the bit of the one above. rank(class, i) is the number
of its characters before i. The number of unit borders up to i is the sum of the ranks of the four ending classes; a cut after
k units is the least i with k borders, found by bisection on those sums, a few dozen places at a time and both cuts at once.

Whether a text is left plain, in which order the parts stand and after how many units the cuts lie follow from sha256 of
seed and id alone, so reruns agree. One pass, no shuffle; a task holds one text's matrix (a few bytes a character) at a time.

Defined results: null text counts as empty; empty texts and texts that hold a mark are plain; a null id is hashed as the word
null; repeated rows give equal rows; an empty table gives an empty result; only id, text and the columns in `carry` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = ("<P>", "<S>", "<M>")
_BLANK, _PLAIN, _SIGN, _FAR = 0, 2, 4, 6  # classes; 1 more where a unit ends
_ENDING = (_BLANK + 1, _PLAIN + 1, _SIGN + 1, _FAR + 1)
_FAN = 64  # places that one step of the bisection looks at
_KIND = np.full(129, _SIGN, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _PLAIN
_KIND[128] = _FAR


class WaveletMatrix:
    """Rank over a sequence of small numbers."""

    def __init__(self, values: np.ndarray, levels: int):
        self.n, self.levels = len(values), levels
        self.words, self.before, self.zeros = [], [], []
        for level in range(levels):
            bit = (values >> (levels - 1 - level)) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
            padded[:self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each place."""
        word = at >> 6
        inside = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(inside)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often `value` stands before each place of `at`."""
        low, high = np.zeros(1, dtype=np.int64), at
        for level in range(self.levels):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            if value >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + ones_low, self.zeros[level] + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    made = _KIND[np.minimum(codes, 128)]
    ends = made != _BLANK
    ends[:-1] &= made[1:] == _BLANK
    if len(made) and made[-1] == _BLANK:
        ends[-1] = True
    return made | ends


def borders(matrix: WaveletMatrix, at: np.ndarray) -> np.ndarray:
    """Units that end before each place."""
    return sum(matrix.rank(c, at) for c in _ENDING)


def cuts(matrix: WaveletMatrix, units: list[int]) -> list[int]:
    """Where each number of units ends: the least place with so many borders before it."""
    want = np.array(units, dtype=np.int64)[:, None]
    low = np.zeros(len(units), dtype=np.int64)  # too few borders before low - 1, or low is 0
    span = matrix.n + 1  # the answer lies in low .. low + span - 1
    while span > 1:
        step = -(-span // _FAN)
        looked = np.minimum(low[:, None] + step * np.arange(1, _FAN + 1) - 1, matrix.n)
        found = borders(matrix, looked.ravel()).reshape(looked.shape) >= want
        low, span = low + step * found.argmax(axis=1), step
    return np.minimum(low, matrix.n).tolist()


def plan(doc_id: int | None, n: int, seed: int) -> tuple[int, int, int, int]:
    """(units before the first cut, before the second, and two numbers from 0 to 99)."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3 % 100, h4 % 100


def transform_text(doc_id: int | None, text: str | None, plain_from: int = 50, suffix_first: int = 80,
                   seed: int = 42) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, characters of the middle, output) of one document."""
    text = text or ""
    matrix = WaveletMatrix(classes(text), 3)
    n = int(borders(matrix, np.array([matrix.n]))[0])
    first, second, dice, order = plan(doc_id, n, seed)
    if not text or dice >= plain_from or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    a, b = cuts(matrix, [first, second])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if order < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transformed(docs: DataFrame, carry: tuple[str, ...] = (), plain_from: int = 50, suffix_first: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, `carry`, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    A text is plain for `plain_from` to 99 of 100 hashes; otherwise the suffix stands first for `suffix_first` of 100.
    """
    rows = docs.select("doc_id", *carry, "text")
    kept = rows.columns[:-1]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [transform_text(i.as_py(), t.as_py(), plain_from, suffix_first, seed) for i, t in zip(part.column(0), part.column(len(kept)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *(pa.array(c, k) for c, k in zip(zip(*made), kinds))],
                                                 names=schema.names)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No part holds a mark, so the first one found is the border."""
    def after(mark: str) -> Column:
        return F.instr(output, mark)

    p, s, m = (after(mark) for mark in MARKS)

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start + 3, end - start - 3)

    last = F.substring(output, m + 3, F.char_length(output))
    return F.when(form == "psm", F.concat(between(p, s), last, between(s, m))).when(
        form == "spm", F.concat(between(p, m), last, between(s, p))).otherwise(output)
