"""Cost-balanced packing of token ids into sequences of fixed length.

The cost of a piece of n tokens is linear * n + quadratic * n * n (attention inside the piece). A document's full
`capacity` chunks are sequences of their own. What is left of the documents goes, longest and so costliest first, to the
sequence with the lowest cost that still has room for it; a remainder that fits nowhere whole is cut over the cheapest
sequences with room. The number of sequences is the least possible for a block, so padding is under one sequence a block.

A block is up to `block_tokens` tokens of remainders that follow each other in an input split: tokens are made and
packed in one pass, no ids are shuffled, memory is bounded by the block and the longest document, and a lost
task repeats itself exactly. Sequence ids are (partition, number in it).

Ids: byte-level BPE. The library that reads ranks gives the same ids as the one that reads the JSON file, about five
times faster (the tests compare the two). Added tokens of the JSON file (`<|endoftext|>`) that stand in a text get their own id.
A text that the first library refuses (runs of about a million blanks) is read by the second.

Defined results: null and empty texts are the end id alone; repeated rows are packed each for itself; an empty table gives
an empty result; only the id and the text are read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def encoder(ranks_file: str = "byte_bpe_50k.tiktoken"):
    """text -> ids, in one worker process. The JSON file beside the ranks names the added tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks_file), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    vocabulary = Path(public_tokenizers.path(ranks_file)).with_suffix(".json")
    added = json.loads(vocabulary.read_text(encoding="utf-8"))["added_tokens"]
    special = {token["content"]: token["id"] for token in added}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    named: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(made.encode(text, allowed_special="all"), dtype="<u4")
        except ValueError:
            # a run of about a million blanks is too deep for the pattern of the fast library
            if not named:
                named.append(Tokenizer.from_file(str(vocabulary)))
            return np.array(named[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start in it, length, sequence, offset) for items shorter than `capacity`."""
    total = int(lengths.sum())
    n = -(-total // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, dtype=np.int64)
    pieces, later = [], []

    def put(item: int, start: int, length: int, to: int) -> None:
        pieces.append((item, start, length, to, capacity - int(room[to])))
        room[to] -= length
        cost[to] += linear * length + quadratic * length * length

    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        able = np.where(room >= length, cost, np.inf)
        to = int(able.argmin())
        if able[to] < np.inf:
            put(item, 0, length, to)
        else:
            later.append(item)
    for item in later:
        start, length = 0, int(lengths[item])
        while start < length:
            to = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(length - start, int(room[to]))
            put(item, start, part, to)
            start += part
    return pieces


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024,
         block_tokens: int = 1 << 20, ranks_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file)
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        block: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal sequence, held
            if block:
                lengths = np.array([len(ids) for _, _, _, ids in block])
                for item, start, length, to, offset in assign(lengths, capacity, linear, quadratic):
                    doc_id, before, tokens, ids = block[item]
                    out.append((doc_id, before + start, length, zlib.crc32(ids[start:start + length].tobytes()), tokens,
                                sequence + to, offset))
                sequence += -(-int(lengths.sum()) // capacity)
            block.clear()
            held = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(_COLUMNS))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    out.append((doc_id.as_py(), start, capacity, zlib.crc32(ids[start:start + capacity].tobytes()), len(ids), sequence, 0))
                    sequence += 1
                if full < len(ids):
                    block.append((doc_id.as_py(), full, len(ids), ids[full:].copy()))
                    held += len(ids) - full
                if held >= block_tokens:
                    close()
                if len(out) >= 1 << 16:
                    yield rows()
        close()
        yield rows()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
