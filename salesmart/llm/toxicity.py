"""Toxicity from averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, hashed to rows of an embedding table, so a misspelling
shares most of its rows with the word it comes from. A window of a few words is the average of its
rows, and a linear softmax gives its class. A text counts as its most toxic window: labels are given
to texts, of which a toxic one may have a single toxic word.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.batches import with_columns
from salesmart.llm.steps import column as named
from salesmart.llm.steps import settled

WORD = re.compile(r"[^\W_]+")
#: Distinct words remembered by a task; beyond that the memory starts anew.
CACHED = 1 << 19


@dataclass(frozen=True)
class Settings:
    """``rows``: rows of the embedding table; ``window``: words averaged; ``longest``: n-grams."""

    rows: int = 1 << 16
    width: int = 8
    window: int = 2
    shortest: int = 3
    longest: int = 5
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7
    spread: float = 0.02


def subwords(word: str, settings: Settings) -> list[int]:
    """Rows of a word's n-grams and of the word itself, with its ends marked."""
    marked = f"<{word}>"
    whole = marked.encode("utf-8", "replace")
    size = len(marked)
    spans = [(i, i + n) for n in range(settings.shortest, settings.longest + 1) for i in range(size - n + 1)]
    if len(whole) == size:
        grams = [whole[a:b] for a, b in spans]
    else:  # n-grams are of characters, whose bytes vary
        grams = [marked[a:b].encode("utf-8", "replace") for a, b in spans]
    rows = settings.rows
    return sorted({crc32(g) % rows for g in (*grams, whole)})


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Model:
    settings: Settings
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @cached_property
    def row_scores(self) -> list[float]:
        """What each row adds to the logit of class 1 against 0 before averaging."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).tolist()

    def word_parts(self, word: str) -> tuple[float, int]:
        """The sum of the scores of a word's rows, and their number."""
        rows, scores = subwords(word, self.settings), self.row_scores
        return sum([scores[r] for r in rows]), len(rows)


def _windows(words: Sequence[str], size: int) -> list[tuple[int, int]]:
    """All runs of ``size`` words, or the whole text if it has fewer."""
    if len(words) <= size:
        return [(0, len(words))] if words else []
    return [(i, i + size) for i in range(len(words) - size + 1)]


def train(texts: Sequence[str | None], labels: Sequence[int], settings: Settings = Settings()) -> Model:
    """Fit on labelled texts; the result depends on their order and on nothing else but them.

    In each step the windows of a text are scored, its worst one is taken, and the loss of the
    text's label on that window moves the embeddings and the weights. In the first pass the windows
    of a text that hold the words most typical for its label are taken, since nothing is known yet.
    """
    rng = np.random.default_rng(settings.seed)
    embeddings = rng.uniform(-1, 1, (settings.rows, settings.width)) * settings.spread
    weights = rng.uniform(-1, 1, (settings.width, 2)) / settings.width
    bias = np.array([1.5, -1.5])  # stays: what has no known n-gram is clean
    vocabulary: dict[str, int] = {}
    given: list[tuple[np.ndarray, int]] = []
    for text, label in zip(texts, labels, strict=True):
        own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        if len(own):
            given.append((own, int(label)))
    if not given:
        return Model(settings, embeddings * 0, weights, bias)
    ids = [own for own, _ in given]
    rows = [np.array(subwords(w, settings), np.int32) for w in vocabulary]
    del vocabulary
    sizes = np.array([len(r) for r in rows])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    positive = max(1, sum(y for _, y in given))
    lift = (len(given) - positive) / positive if positive < len(given) else 1.0
    # Texts of each class that have a row, smoothed: where to look first in a toxic text.
    seen = np.zeros((2, settings.rows))
    for (_, y), own in zip(given, ids, strict=True):
        seen[y, np.unique(np.concatenate([rows[i] for i in np.unique(own)]))] += 1
    odds = np.log((seen[1] + 0.1) / positive) - np.log((seen[0] + 0.1) / max(1, len(given) - positive))
    prior = np.zeros(len(rows))
    np.maximum.at(prior, owner, odds[flat])
    squares_e, squares_w = np.full(settings.rows, 1e-6), np.full(2, 1e-6)
    for epoch in range(settings.epochs):
        direction = weights[:, 1] - weights[:, 0]
        per_word = np.bincount(owner, (embeddings @ direction)[flat], len(rows))
        for k in rng.permutation(len(given)):
            label, own = given[k][1], ids[k]
            size = min(settings.window, len(own))
            ones = np.ones(size)
            if epoch == 0:
                judged = np.convolve(prior[own], ones, "valid")
            else:
                judged = np.convolve(per_word[own], ones, "valid") / np.convolve(sizes[own], ones, "valid")
            tries = [int(np.argmax(judged))]
            if label == 0:  # a clean text has no toxic window at all
                tries += list(rng.integers(0, len(judged), 2))
            for start in tries:
                used = np.concatenate([rows[i] for i in own[start : start + size]])
                mean = embeddings[used].mean(axis=0)
                logits = mean @ weights + bias
                chance = np.exp(logits - logits.max())
                chance /= chance.sum()
                error = chance.copy()
                error[label] -= 1.0
                if label:
                    error *= min(lift, 10.0)
                back = weights @ error
                np.add.at(squares_e, used, float(back @ back) / len(used))
                squares_w += error**2
                step = settings.rate / np.sqrt(squares_e[used])
                np.add.at(embeddings, used, -(step[:, None] * back) / np.sqrt(len(used)))
                weights -= settings.rate * np.outer(mean, error / np.sqrt(squares_w))
    return Model(settings, embeddings, weights, bias)


def learn(
    docs: DataFrame,
    labels: DataFrame | None = None,
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "label",
    rows: int = 6000,
    settings: Settings = Settings(),
) -> Model:
    """Train on the ``rows`` labelled texts that come first by a hash of their content.

    The labels stand in ``docs``, or in ``labels`` by ``key``. The bound keeps the training data within the
    driver; it does not depend on the size of the tables. Rows without text or label (0 or 1) teach nothing, nor does a
    null key; equal texts with the same label count once. Texts are used whole. Only hashes of texts are shuffled to choose
    them; the chosen texts are then fetched by at most ``rows`` hashes.
    """
    texts = docs.where(F.length(named(text)) > 0).withColumn("__place", F.xxhash64(named(text)))
    told = named(label).cast("int").alias("label")
    if labels is None:
        marks = texts.select(F.col("__place").alias("place"), told)
    else:
        by_key = labels.select(named(key).alias("key"), told)
        marks = texts.select(named(key).alias("key"), F.col("__place").alias("place")).join(by_key, "key")
    marks = settled(marks.where(F.col("label").isin(0, 1)).select("place", "label").distinct(), "marks")
    # Most are left out before the ordering; few more than needed pass.
    total = max(1, marks.count())
    share = min(1.0, 1.5 * rows / total + 100 / total)
    near = F.pmod("place", F.lit(1_000_000))
    few = marks.withColumn("near", near).where(F.col("near") < int(share * 1_000_000) + 1)
    chosen = {(r["place"], r["label"]) for r in few.orderBy("near", "place", "label").limit(rows).collect()}
    places = docs.sparkSession.createDataFrame(sorted({(p,) for p, _ in chosen}), "place long")
    found = texts.join(F.broadcast(places), F.col("__place") == F.col("place")).select("place", named(text).alias("text"))
    whole = {r["place"]: r["text"] for r in found.dropDuplicates(["place"]).collect()}
    sample = sorted((place % 1_000_000, whole[place], label) for place, label in chosen)
    return train([t for _, t, _ in sample], [y for _, _, y in sample], settings)


def score(
    docs: DataFrame, model: Model, *, text: str = "text", column: str = "score"
) -> DataFrame:
    """``docs`` with the chance of class 1 of the worst window of the whole ``text``.

    Null texts and texts without words get the chance of the bias alone.
    Repeated rows stay, other columns pass through, a column called as ``column`` is replaced. The
    model has a fixed size and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        known = shared.value
        offset = float(known.bias[1] - known.bias[0])
        size = known.settings.window
        index: dict[str, int] = {}
        values, counts = np.zeros(CACHED), np.ones(CACHED)

        def judge(value: str | None) -> float:
            words = words_of(value)
            if not words:
                return _chance(offset)
            worst = -np.inf
            span = min(size, len(words))
            for start in range(0, len(words), CACHED // 4):
                # Windows that begin in this stretch of a very long text.
                stretch = words[start : start + CACHED // 4 + span - 1]
                if len(stretch) < span:
                    break
                if len(index) + len(stretch) > CACHED:
                    index.clear()
                for word in [w for w in stretch if w not in index]:
                    if word not in index:
                        at = index[word] = len(index)
                        values[at], counts[at] = known.word_parts(word)
                own = np.fromiter(map(index.__getitem__, stretch), np.int64, len(stretch))
                sums = np.concatenate([[0.0], np.cumsum(values[own])])
                rows = np.concatenate([[0.0], np.cumsum(counts[own])])
                judged = (sums[span:] - sums[:-span]) / (rows[span:] - rows[:-span])
                worst = max(worst, float(judged.max()))
            return _chance(worst + offset)

        return lambda texts: [pa.array([judge(t) for t in texts.to_pylist()], pa.float64())]

    return with_columns(docs, text, T.StructType([T.StructField(column, T.DoubleType())]), setup)


def _chance(logit: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(logit, -50.0, 50.0))))
