"""Toxicity: bags of subword vectors, averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5, with marks at its ends) hashed to `buckets` vectors, so an unseen
misspelling shares most vectors with the word it comes from. A passage of `window` words is the average over its
words of their vectors; a softmax over two classes stands on it. A document is as toxic as its most toxic passage, in
training and in scoring, so a few words in a long text aren't averaged away. Vectors and softmax are trained
jointly by gradient steps in numpy, in the driver, on a bounded sample of labelled rows: `most_rows` rows (smallest hash of the
id) of at most `most_chars` characters; where ids repeat, the first 2 * `most_rows` rows by hash of the id, id and hash of the text.

As everything below the softmax is a mean, a trained model is one number per n-gram bucket. Tasks look up all n-grams
of a batch of texts at once and average by words and passages with running sums.

Defined results: null, empty and blank texts have no passage and get the score of an empty one; without any label every
score is 0.5; repeated rows are scored each; rows with a null label teach nothing; an empty table gives an empty result;
only the id, the text and the columns in `carry` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.quality import first_rows, labelled_sample

_LEAST, _MOST = 3, 5
_PART = 1 << 20  # characters looked up at a time


@dataclass
class Grams:
    """All n-grams of a list of texts: bucket and word of each, words per text, in order."""

    bucket: np.ndarray
    word: np.ndarray
    words_of_text: np.ndarray


def grams(texts: list[str | None], buckets: int) -> Grams:
    """Words are runs of non-blank characters in lower case; each gets a mark at both ends."""
    split = [(t or "").lower().split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for ws in split for w in ws]
    if not words:
        return Grams(np.zeros(0, np.int64), np.zeros(0, np.int64), counts)
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), dtype=np.uint32)
    # from the lengths: a text may hold the marks themselves
    word_at = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    found_bucket, found_word = [], []
    code = np.full(len(codes), 2166136261, dtype=np.uint32)
    for n in range(1, _MOST + 1):
        code = (code[:len(codes) - n + 1] ^ codes[n - 1:]) * np.uint32(16777619)
        if n < _LEAST or not len(code):
            continue
        inside = word_at[:len(code)] == word_at[n - 1:]
        own = code[inside]
        found_bucket.append(((own ^ (own >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(8)).astype(np.int64) % buckets)
        found_word.append(word_at[:len(code)][inside])
    return Grams(np.concatenate(found_bucket), np.concatenate(found_word), counts)


def _means(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Mean per group; an empty group has 0."""
    return np.bincount(of, values, n) / np.maximum(np.bincount(of, minlength=n), 1)


def windows_of(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, text of each passage). Passages follow each other; a rest joins the last whole one."""
    per_text = np.maximum(counts // window, 1)
    first = np.cumsum(per_text) - per_text
    text_of_word = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[text_of_word] + np.minimum(place // window, per_text[text_of_word] - 1), np.repeat(np.arange(len(counts)), per_text)


@dataclass
class Model:
    gram_scores: np.ndarray
    bias: float
    window: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= _PART):
                size += len(texts[end] or "")
                end += 1
            found = grams(texts[at:end], len(self.gram_scores))
            n_words = int(found.words_of_text.sum())
            words = _means(self.gram_scores[found.bucket], found.word, n_words)
            passage, text = windows_of(found.words_of_text, self.window)
            logits = _means(words, passage, len(text))
            best = np.full(end - at, -np.inf)
            np.maximum.at(best, text, logits)
            out[at:end] = best
            at = end
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def _group_sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows per group."""
    return np.stack([np.bincount(of, values[:, d], n) for d in range(values.shape[1])], axis=1).astype(np.float32)


def _distinct(values: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse for small whole numbers, by a table `place` instead of a sort."""
    place[values] = -1
    used = np.flatnonzero(place == -1)
    place[used] = np.arange(len(used))
    inverse = place[values]
    place[used] = 0
    return used, inverse


def fit(texts: list[str], y: np.ndarray, buckets: int = 1 << 18, dims: int = 8, window: int = 8, warm_epochs: int = 2,
        epochs: int = 4, batch: int = 64, rate: float = 0.5, decay: float = 1e-5, seed: int = 5,
        least_steps: int = 300) -> Model:
    """In the first epochs every passage counts as its text is labelled, which sorts out n-grams that clean texts use;
    then a text's loss is that of its most toxic passage (for clean texts its four most toxic ones)."""
    if not any(t.strip() for t in texts):
        return Model(np.zeros(buckets), 0.0, window)
    rng = np.random.default_rng(seed)
    ids: dict[str, int] = {}
    coded = [np.array([ids.setdefault(w, len(ids)) for w in t.lower().split()], dtype=np.int32) for t in texts]
    vocabulary, found, sizes_found = list(ids), [], []
    for at in range(0, len(vocabulary), 1 << 14):  # in pieces: the driver holds little at a time
        part = grams([" ".join(vocabulary[at:at + (1 << 14)])], buckets)
        found.append(part.bucket[np.argsort(part.word, kind="stable")].astype(np.int32))
        sizes_found.append(np.bincount(part.word, minlength=int(part.words_of_text.sum())))
    gram_of, n_grams = np.concatenate(found), np.concatenate(sizes_found)
    del vocabulary, found
    gram_from = np.cumsum(n_grams) - n_grams
    vectors = rng.normal(0, 0.05, (buckets, dims)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (dims, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (softmax, bias)]
    history = np.zeros(buckets, dtype=np.float32)
    class_weight = np.sqrt(0.5 / np.array([max(1 - y.mean(), 1e-3), max(y.mean(), 1e-3)]))
    full = [i for i, c in enumerate(coded) if len(c)]
    step, word_place, gram_place = 0, np.zeros(len(ids), dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    # small samples go round oftener: at least `least_steps` steps in all
    more = max(1, -(-least_steps // ((warm_epochs + epochs) * max(1, -(-len(full) // batch)))))
    warm_epochs, epochs = warm_epochs * more, epochs * more
    for epoch in range(warm_epochs + epochs):
        shuffled = rng.permutation(full)
        speed = rate * (1 - epoch / (warm_epochs + epochs))
        for at in range(0, len(shuffled), batch):
            chosen = shuffled[at:at + batch]
            step += 1
            counts = np.array([len(coded[i]) for i in chosen])
            used_words, word = _distinct(np.concatenate([coded[i] for i in chosen]), word_place)
            sizes = n_grams[used_words]
            own = np.repeat(gram_from[used_words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            used, slot = _distinct(gram_of[own], gram_place)
            gram_word = np.repeat(np.arange(len(used_words)), sizes)
            current = vectors[used]
            word_vectors = np.add.reduceat(current[slot], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            passage, text = windows_of(counts, window)
            size = np.bincount(passage).astype(np.float32)[:, None]
            mean = np.add.reduceat(word_vectors[word], np.searchsorted(passage, np.arange(len(text))), axis=0) / size
            logits = mean @ softmax + bias
            target = y[chosen].astype(int)[text]
            weight = class_weight[target]
            if epoch < warm_epochs:
                weight = weight / np.bincount(text)[text]
            else:
                down = np.lexsort((logits[:, 0] - logits[:, 1], text))
                rank = np.arange(len(text)) - np.searchsorted(text, text)
                place = np.empty(len(text), dtype=np.int64)
                place[down] = rank
                weight = weight * np.where(target == 1, place == 0, (place < 4) / 4)
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(text)), target] -= 1
            error = (prob * weight[:, None] / len(chosen)).astype(np.float32)
            to_word = _group_sums(((error @ softmax.T) / size)[passage], word, len(used_words))
            to_gram = _group_sums((to_word / sizes[:, None])[gram_word], slot, len(used)) + decay * current
            # vectors are sparse: only those seen move, each by its own history of gradients
            history[used] += (to_gram * to_gram).sum(axis=1)
            vectors[used] = current - speed * to_gram / np.sqrt(history[used] + 1e-16)[:, None]
            for value, grad, (m, v) in ((softmax, mean.T @ error + decay * softmax, moments[0]), (bias, error.sum(axis=0), moments[1])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.2 * speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float64), float(bias[1] - bias[0]), window)


def classify(docs: DataFrame, labels: DataFrame, train: Column, carry: tuple[str, ...] = (), label: str = "toxic",
             most_rows: int = 4_000, most_chars: int = 20_000) -> DataFrame:
    """doc_id, `carry`, score for every row of docs. `train` (on doc_id) tells which labels may be used."""
    sample = labelled_sample(labels.where(train), label, most_rows)
    # the sample has a proven size, so it is sent to the documents; what comes back is bounded by both limits
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= most_chars).join(F.broadcast(sample), "doc_id")
    got = first_rows(rows, F.xxhash64("text"), 2 * most_rows)
    model = docs.sparkSession.sparkContext.broadcast(fit(got["text"].to_list(), got["y"].to_numpy(dtype=float)))
    rows = docs.select("doc_id", *carry, "text")
    kept = rows.columns[:-1]
    schema = rows.select(*kept).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores)], names=schema.names)

    return rows.mapInArrow(run, schema)
