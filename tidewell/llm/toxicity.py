"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is the logistic value of
a bias plus the weights of its distinct words, each the sum of the weights of
the word and of its beginnings; the document's score is the
noisy-or of its sentences, 1 - prod(1 - p).  Only documents carry labels: the
gradient of the noisy-or decides which sentences answer for a toxic document,
so the fitted model also points at them.

The word weights are fitted in numpy on a bounded sample: at most TRAIN_TOXIC
toxic and TRAIN_CLEAN other documents outside the held-out fold, hashed to word
ids on the executors.  Scoring reads every whole text.

Defined results: a null or wordless text is one empty sentence and scores the
bias; without labels every score is small and nothing is predicted; repeated
rows each keep a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sampling import held_out, lowest_hashes, rows_of
from tidewell.llm.words import WordHashes, binary_column

#: Labelled documents that the weights are fitted on, at most.
TRAIN_TOXIC = 1_000
TRAIN_CLEAN = 2_000
#: Words must occur in so many training documents, and their share of toxic and of clean documents must differ by so
#: many standard errors, to get a weight; of the many words seen a few times, chance alone would favour some.
LEAST_DOCUMENTS = 4
LEAST_Z = 4.5
#: Beginnings of so many bytes are features of longer words.
BEGINNINGS = (4, 6, 8)
THRESHOLD = 0.3
PRIOR = -7.0

#: Byte table: folds A-Z, ends of sentences to a line feed, other ASCII that is not a letter or digit to a blank.
_SENTENCES = bytes(
    10 if b in b".!?\n" else (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def sentences(raw: bytes | None) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [words for part in (raw or b"").translate(_SENTENCES).split(b"\n") if (words := part.split())]


def word_features(word: bytes) -> list[bytes]:
    return [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]


class MilModel:
    """Weights by hash of a word's feature, and the bias of a sentence."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias

    def word_weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], 0.0)

    def scores(self, raw: bytes | None, cache: dict[bytes, float]) -> np.ndarray:
        """Score of each sentence."""
        return 1.0 / (1.0 + np.exp(-np.array([self.bias + sum(cache[w] for w in set(s)) for s in sentences(raw)] or [self.bias])))


class _WeightCache(dict):
    def __init__(self, model: MilModel, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: bytes) -> float:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        hashes = np.array([xxhash.xxh3_64_intdigest(f) for f in word_features(word)], np.uint64)
        value = self[word] = float(self.model.word_weights(hashes).sum())
        return value


def _bags(rows: DataFrame) -> DataFrame:
    """doc_id, toxic, words (hashes of features) and sentence (number of each one's sentence) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            hashed, numbers = [], []
            for raw in binary_column(batch, "text"):
                words, at = [], []
                for number, sentence in enumerate(sentences(raw)):
                    own = [f for word in sorted(set(sentence)) for f in word_features(word)]
                    words += own
                    at += [number] * len(own)
                hashed.append(cache.of(words).view(np.int64).tolist())
                numbers.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hashed, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "words", "sentence"],
            )

    return rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, toxic int, words array<long>, sentence array<int>"
    )


def train_bags(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    chosen = lowest_hashes(known.where("toxic = 1"), TRAIN_TOXIC).unionByName(lowest_hashes(known.where("toxic = 0"), TRAIN_CLEAN))
    # the chosen ids are at most TRAIN_TOXIC + TRAIN_CLEAN rows
    rows = rows_of(docs.select("doc_id", "text"), chosen.dropDuplicates(["doc_id"]))
    words, numbers, toxic = [], [], []
    for row in _bags(rows).toLocalIterator():
        words.append(np.array(row["words"], np.int64).view(np.uint64))
        numbers.append(np.array(row["sentence"], np.int32))
        toxic.append((row["doc_id"], row["toxic"]))
    order = sorted(range(len(toxic)), key=lambda i: (toxic[i], len(words[i])))
    return [words[i] for i in order], [numbers[i] for i in order], np.array([toxic[i][1] for i in order], float)


def telling_words(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes of the words whose document shares differ between toxic and clean documents."""
    own = [np.unique(w) for w in words]
    vocabulary, place, in_docs = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(y, [len(w) for w in own]), len(vocabulary))
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    share = in_docs / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    z = (toxic / n1 - (in_docs - toxic) / n0) / error
    return vocabulary[(in_docs >= LEAST_DOCUMENTS) & (np.abs(z) >= LEAST_Z)]


def fit_mil(words: list[np.ndarray], numbers: list[np.ndarray], y: np.ndarray, rounds: int = 300, rate: float = 0.15, penalty: float = 2e-4) -> MilModel:
    """Full-batch Adam on the log loss of the noisy-or."""
    if not len(y) or not y.any():
        return MilModel(np.empty(0, np.uint64), np.empty(0), PRIOR)
    vocabulary = telling_words(words, y)
    if not len(vocabulary):
        return MilModel(np.empty(0, np.uint64), np.empty(0), PRIOR)
    flat = np.concatenate(words)
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    known = vocabulary[at] == flat
    counts = [int(n[-1]) + 1 if len(n) else 1 for n in numbers]
    first = np.concatenate([[0], np.cumsum(counts)])
    sentence = np.concatenate([n + first[i] for i, n in enumerate(numbers)])[known]
    word = at[known]
    doc = np.repeat(np.arange(len(y)), counts)
    weight_of = np.full(len(y), 1.0 / len(y))
    w, bias = np.zeros(len(vocabulary)), PRIOR
    m = np.zeros(len(w) + 1)
    v = np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        logits = bias + np.bincount(sentence, w[word], first[-1])
        p = 1.0 / (1.0 + np.exp(-logits))
        none = np.bincount(doc, -np.logaddexp(0, logits), len(y))  # log of no sentence being toxic
        prob = -np.expm1(np.minimum(none, -1e-9))
        # d loss / d logit of a sentence: p for a clean document, -p (1 - prob) / prob for a toxic one
        pull = np.where(y == 1, -np.exp(none) / prob, 1.0) * weight_of
        grad_s = pull[doc] * p
        grad = np.concatenate([np.bincount(word, grad_s[sentence], len(w)) + penalty * w / len(w), [grad_s.sum()]])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w, bias = w - move[:-1], float(bias - 0.2 * move[-1])
    strong = np.abs(w) > 1e-3
    return MilModel(vocabulary[strong], w[strong], bias)


def score_toxicity(docs: DataFrame, model: MilModel) -> DataFrame:
    """doc_id, score, n_sentences, worst_sentence (its number among sentences with a word) and worst_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WeightCache(model)
        for batch in batches:
            score, n, worst, most = [], [], [], []
            for raw in binary_column(batch, "text"):
                p = model.scores(raw, cache)
                score.append(float(np.clip(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()), 0.0, 1.0)))
                n.append(len(p))
                worst.append(int(np.argmax(p)))
                most.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(worst, pa.int64()), pa.array(most, pa.float64())],
                names=["doc_id", "score", "n_sentences", "worst_sentence", "worst_score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double, n_sentences long, worst_sentence long, worst_score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    model = fit_mil(*train_bags(docs, labels))
    return score_toxicity(docs, model).withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
