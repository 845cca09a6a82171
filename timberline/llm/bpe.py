"""BPE encoding and decoding by a contiguous rank array.

A text is cut at added tokens, brought to NFC and lower case, split into words by the vocabulary's pattern, and every word is
merged by itself. A word of up to `_SHORT` bytes is an array of parts, one per boundary, beside the array of the ranks
of adjacent parts: scan the ranks for the minimum (the first of equal ones), delete the boundary there, refresh the rank on
either side, until no adjacent pair has a rank. Scanning is quadratic, so a longer word takes the same merges from a
heap of (rank, place) over linked parts. No word holds white space, so runs between it that come again are looked up in a
bounded table, and so are the words of new runs.

Decoding joins the tokens of the ids with blanks, which is what a vocabulary file without a decoder asks for; ids that the
vocabulary does not have are left out.

Unicode: the splitting here uses Python's tables. A text with code points that those do not know as assigned is normalised and
split by the vocabulary file's own definition, since newer characters may be letters there; its words are merged here.

Both directions are narrow: no shuffle, a task holds one slice of a batch, and a lost task repeats itself exactly. Defined
results: null and empty texts have no ids; null ids decode to null; repeated rows are encoded each; an empty table gives an
empty result; only the id, the text (or ids) and the columns in `carry` are read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SHORT = 96
_NONE = 1 << 40  # no merge
_KEPT = 1 << 18  # entries of each table
_SPLIT_ONLY = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space for str.split, not for the pattern
_SLICE = 1 << 22  # characters of text that leave a task at a time


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints in Latin-1, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    letters = {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """One JSON vocabulary with word ends, read once per worker process."""

    def __init__(self, name: str):
        import public_tokenizers

        self.path = public_tokenizers.path(name)
        with open(self.path, encoding="utf-8") as lines:
            made = json.load(lines)
        ids = made["model"]["vocab"]
        end = made["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        # rank and merged id in one number; adjacent ids are one number too
        self.merges = {ids[a] << 32 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.inner = [ids[c] for c in byte_letters()]
        self.last = [ids[c + end] for c in byte_letters()]
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.added).items()}
        longest_first = sorted(self.added, key=lambda t: (-len(t), t))
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        splits = [p["pattern"]["Regex"] for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(splits[0])
        self.table: dict[str, bytes] = {}
        self.merged_words: dict[str, bytes] = {}
        self._own = None

    # merging

    def scanned(self, parts: list[int]) -> list[int]:
        """All merges of a short word, by its rank array."""
        merge = self.merges.get
        ranks = [merge(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            parts[at] = least & 0xFFFFF
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merge(parts[at] << 32 | parts[at + 1], _NONE)
            if at:
                ranks[at - 1] = merge(parts[at - 1] << 32 | parts[at], _NONE)
        return parts

    def heaped(self, parts: list[int]) -> list[int]:
        """The same merges for a long word. A heap entry is rank and place; it is stale if the pair there has another rank now."""
        merge, n = self.merges.get, len(parts)
        after = np.arange(1, n + 1).tolist()
        before = np.arange(-1, n - 1).tolist()
        heap = [(r >> 20) << 32 | i for i in range(n - 1) if (r := merge(parts[i] << 32 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if parts[at] < 0 or right >= n:
                continue
            now = merge(parts[at] << 32 | parts[right], _NONE)
            if now == _NONE or now >> 20 != entry >> 32:
                continue
            parts[at], parts[right] = now & 0xFFFFF, -1
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                if (r := merge(parts[at] << 32 | parts[right], _NONE)) != _NONE:
                    heapq.heappush(heap, (r >> 20) << 32 | at)
            left = before[at]
            if left >= 0 and (r := merge(parts[left] << 32 | parts[at], _NONE)) != _NONE:
                heapq.heappush(heap, (r >> 20) << 32 | left)
        return [p for p in parts if p >= 0]

    def merged(self, word: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit numbers."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        if len(parts) > _SHORT:
            return np.array(self.heaped(parts), dtype="<u4").tobytes()
        parts = self.scanned(parts)
        return struct.pack(f"<{len(parts)}I", *parts)

    def known(self, word: str) -> bytes:
        """`merged`, from the table of words if it has the word."""
        found = self.merged_words.get(word)
        if found is None:
            found = self.merged(word)
            if len(word) <= _SHORT:
                if len(self.merged_words) >= _KEPT:
                    self.merged_words.clear()
                self.merged_words[word] = found
        return found

    # texts

    def runs(self, text: str) -> list[str]:
        """The text in lower case, cut at white space."""
        if not text.isascii():
            # lower case letter by letter: no special form at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return self.word.findall(text) if any(c in text for c in _SPLIT_ONLY) else text.split()

    def _words_as_defined(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self._own is None:
            own, letters = Tokenizer.from_file(self.path), byte_letters()
            self._own = own.normalizer, own.pre_tokenizer, {c: b for b, c in enumerate(letters)}
        normalizer, splitter, byte_of = self._own
        found = splitter.pre_tokenize_str(normalizer.normalize_str(text))
        return [bytes(byte_of[c] for c in word).decode() for word, _ in found]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if self.cut is None or "<" not in text:
            return self._encode_plain(text)
        return b"".join(self.added[part].to_bytes(4, "little") if part in self.added else self._encode_plain(part)
                        for part in self.cut.split(text))

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return b"".join(map(self.merged, self._words_as_defined(text)))
        runs, table = self.runs(text), self.table
        out = list(map(table.get, runs))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    run = runs[i]
                    out[i] = found = table.get(run) or b"".join(map(self.known, self.word.findall(run)))
                    if len(run) <= _SHORT:
                        if len(table) >= _KEPT:
                            table.clear()
                        table[run] = found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in tokens])


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(name)
    return _LOADED[name]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, length) of pieces of about `_SLICE` bytes of a string or binary column; one value is never cut."""
    at, held = 0, 0
    for i, value in enumerate(column):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= _SLICE:
            yield at, i + 1 - at
            at, held = i + 1, 0
    if at < len(column):
        yield at, len(column) - at


def _mapped(rows: DataFrame, name: str, made: list[T.StructField], turn) -> DataFrame:
    """`rows` without its last column, and the columns that turn(values of that column) gives."""
    kept = rows.columns[:-1]
    schema = T.StructType([*rows.select(*kept).schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(name)
        for batch in batches:
            for at, n in _slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *turn(own, part.column(part.num_columns - 1).to_pylist())], names=schema.names)

    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, carry: tuple[str, ...] = (), vocabulary_file: str = "word_bpe_49k.json", decode: bool = False) -> DataFrame:
    """doc_id, `carry` and ids, binary: little-endian unsigned 32-bit numbers. With `decode` also `decoded`, their text."""
    def turn(own: Vocabulary, texts: list[str | None]) -> list[pa.Array]:
        ids = [own.encode(text or "") for text in texts]
        return [pa.array(ids, pa.binary()), *([pa.array([own.decode(i) for i in ids], pa.string())] if decode else [])]

    made = [T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decode else [])]
    return _mapped(docs.select("doc_id", *carry, "text"), vocabulary_file, made, turn)


def decoded(rows: DataFrame, carry: tuple[str, ...] = (), vocabulary_file: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, `carry` and decoded, the text of `ids`."""
    def turn(own: Vocabulary, ids: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([None if i is None else own.decode(i) for i in ids], pa.string())]

    return _mapped(rows.select("doc_id", *carry, "ids"), vocabulary_file, [T.StructField("decoded", T.StringType())], turn)
