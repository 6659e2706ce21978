"""Quality rules: boosted trees over document statistics.

One pass turns every whole text into a row of statistics, written to the shared
folder.  Trees are fitted on the statistics of at most TRAIN_ROWS labelled
documents outside the held-out fold, flattened into node arrays, and score the
statistics in batches.  The score may not rise with the share of symbols,
repeated lines, repeated words or capitals.  Fixed base rules come first: what
they fail is not kept, whatever the trees say.

Defined results: a null text has no words and fails the base rules; without
labels every document that passes the base rules is kept; repeated rows each
keep a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import trees
from tidewell.llm.sampling import held_out, lowest_hashes, rows_of
from tidewell.llm.words import WordHashes, binary_column, rolling, spaced_words
from tidewell.llm.workspace import settled

#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
#: Least score of a kept document.
LEAST_SCORE = 0.3
LEAST_WORDS = 50
#: A repeat is a run of so many words that the text holds twice.
REPEAT_WORDS = 3

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\v\f\r"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_END = bytes(b for b in range(256) if b not in b".!?")
_NOT_SHOUT = bytes(b for b in range(256) if b != 33)
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ends", "n_shouts", "n_digits", "n_distinct")
#: Name, value and monotonic constraint of each column that the trees see.
FEATURES = (
    ("log_words", lambda s: np.log1p(s["n_words"]), 0),
    ("word_length", lambda s: s["word_chars"] / np.maximum(s["n_words"], 1), 0),
    ("symbols", lambda s: s["n_symbols"] / np.maximum(s["word_chars"], 1), -1),
    ("dup_lines", lambda s: s["n_dup_lines"] / np.maximum(s["n_lines"], 1), -1),
    ("repeats", lambda s: s["n_repeat_words"] / np.maximum(s["n_words"], 1), -1),
    ("upper", lambda s: s["n_upper"] / np.maximum(s["word_chars"], 1), -1),
    ("ends", lambda s: s["n_ends"] / np.maximum(s["n_words"], 1), 0),
    ("shouts", lambda s: s["n_shouts"] / np.maximum(s["n_words"], 1), -1),
    ("digits", lambda s: s["n_digits"] / np.maximum(s["word_chars"], 1), 0),
    ("distinct", lambda s: s["n_distinct"] / np.maximum(s["n_words"], 1), 0),
    ("line_words", lambda s: s["n_words"] / np.maximum(s["n_lines"], 1), 0),
)


def text_counts(raw: bytes | None, cache: WordHashes) -> list[int]:
    """The values of COUNTS for one text in UTF-8."""
    raw = raw or b""
    words = spaced_words(raw)
    hashes = cache.of(words)
    repeats = 0
    windows = rolling(hashes, REPEAT_WORDS)
    if len(windows):
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        marks = np.zeros(len(words) + 1, np.int64)
        starts = np.flatnonzero(times[place] > 1)
        marks[starts] += 1
        np.subtract.at(marks, starts + REPEAT_WORDS, 1)
        repeats = int(np.count_nonzero(np.cumsum(marks)[:-1]))
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return [
        len(words),
        len(raw.translate(None, _SPACE + _CONTINUED)),
        len(raw.translate(None, _NOT_SYMBOL)),
        dup,
        repeats,
        lines,
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_END)),
        len(raw.translate(None, _NOT_SHOUT)),
        len(raw.translate(None, _NOT_DIGIT)),
        len(np.unique(hashes)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each whole text."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            table = np.array([text_counts(raw, cache) for raw in binary_column(batch, "text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([value(columns) for _, value, _ in FEATURES]).astype(float)


def fit_quality(statistics: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> trees.Forest:
    """Trees for P(quality = 1), fitted on at most ``train_rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    sample = rows_of(statistics.select("doc_id", *COUNTS), lowest_hashes(known, train_rows)).orderBy("doc_id").toPandas()
    columns = {c: sample[c].to_numpy(float) for c in COUNTS}
    return trees.fit(features(columns), sample["quality"].to_numpy(float), np.array([m for _, _, m in FEATURES]))


def score_quality(statistics: DataFrame, forest: trees.Forest) -> DataFrame:
    """The statistics with a score from 0 to 1."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(j + 1).to_numpy().astype(float) for j, c in enumerate(COUNTS)}
            score = forest.score(features(columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["doc_id", *COUNTS, "score"])

    return statistics.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, least_score: float = LEAST_SCORE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics, score, base_failed and kept for each document."""
    statistics = settled(document_statistics(docs), "statistics")
    scored = score_quality(statistics, fit_quality(statistics, labels, train_rows))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score))
