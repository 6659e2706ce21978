"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of an item (an item of fewer words is one
window).  Of every SPAN words, the rightmost least of their k-gram hashes is
the fingerprint; with SPAN = k + w - 1, w k-grams, two texts that share SPAN
words share that fingerprint at the same place, so a join of fingerprints finds
every shared window.  A document keeps about 2 / (w + 1) of its positions, each
with the hashes of the w windows that may hold it; a join hit is extended to
its window by comparing that window's hash.  Items shorter than SPAN get a
fingerprint of their own length (w = 1), for the few lengths that occur.

Windows are compared by 64-bit hashes of 64-bit word hashes.

Defined results: null or wordless texts have no words and no hits; a null
item_id never counts as an item but its text still marks words; repeated rows
each keep a row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.words import WordHashes, binary_column, folded_words, mix64, rolling, sliding_argmin
from tidewell.llm.workspace import release_memory, settled

SPAN = 10
K = 5
W = SPAN - K + 1
#: Benchmark windows up to this many are broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 400_000
#: Fingerprints of documents that a task holds before they leave as a batch (some 100 bytes each).
FINGERPRINT_ROWS = 16_384
#: Fingerprints of documents are spread over so many salts in that shuffle.
SALTS = 16

_ITEM_SCHEMA = "fp long, shift int, length int, win long, item_id string"
_DOC_SCHEMA = "row_id long, doc_id long, digest long, n_words long, pos int, fp long, " + ", ".join(f"w{j} long" for j in range(W))


def _short_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix64(rolling(hashes, length) + np.uint64(length))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """fp, shift (of the fingerprint in its window), length, win, item_id: one row for each distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for item, raw in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                hashes = cache.of(folded_words(raw))
                if not len(hashes):
                    continue
                if len(hashes) < SPAN:
                    whole = _short_hash(hashes, len(hashes)).view(np.int64)
                    found = (whole, np.zeros(1, np.int32), np.full(1, len(hashes), np.int32), whole)
                else:
                    grams, wins = rolling(hashes, K), rolling(hashes, SPAN)
                    frame = np.lib.stride_tricks.sliding_window_view(grams, W)
                    shift = W - 1 - np.argmin(frame[:, ::-1], axis=1)
                    fps = grams[np.arange(len(wins)) + shift]
                    found = (fps.view(np.int64), shift.astype(np.int32), np.full(len(wins), SPAN, np.int32), wins.view(np.int64))
                for column, values in zip(out, (*found, [item] * len(found[0])), strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["fp", "shift", "length", "win", "item_id"])
        del cache
        release_memory()

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, _ITEM_SCHEMA).distinct()


def document_fingerprints(docs: DataFrame, short: list[int]) -> DataFrame:
    """One head row (fp null) for each document, and one row for each of its fingerprints with the hashes of the windows around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        names = [part.split()[0] for part in _DOC_SCHEMA.split(", ")]

        def rows(own: pa.RecordBatch, n_words: list, which: list, places: list, fps: list, wins: list) -> Iterator[pa.RecordBatch]:
            ids = own.columns[:3]
            nulls = (pa.nulls(len(n_words), k) for k in (pa.int32(), *[pa.int64()] * (W + 1)))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(n_words, pa.int64()), *nulls], names=names)
            if which:
                take, at, fp, hashed = (np.concatenate(parts) for parts in (which, places, fps, wins))
                for start in range(0, len(take), FINGERPRINT_ROWS):
                    part = slice(start, start + FINGERPRINT_ROWS)
                    columns = [c.take(pa.array(take[part])) for c in ids]
                    columns += [pa.nulls(len(columns[0]), pa.int64()), pa.array(at[part].astype(np.int32)), pa.array(fp[part].view(np.int64))]
                    columns += [pa.array(np.ascontiguousarray(hashed[part, j]).view(np.int64)) for j in range(W)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            texts = binary_column(batch, "text")
            begin, held = 0, 0
            n_words, which, places, fps, wins = [], [], [], [], []
            for i, raw in enumerate(texts):
                hashes = cache.of(folded_words(raw))
                n_words.append(len(hashes))
                if len(hashes) >= SPAN:
                    grams = rolling(hashes, K)
                    at = sliding_argmin(grams, W)
                    # window start at - j, for j = 0 .. W-1; a start outside the text gives the nearest one, which then has another hash
                    own = rolling(hashes, SPAN)
                    starts = np.clip(at[:, None] - np.arange(W), 0, len(own) - 1)
                    which.append(np.full(len(at), i - begin))
                    places.append(at)
                    fps.append(grams[at])
                    wins.append(own[starts])
                    held += len(at)
                for length in short:
                    if len(hashes) >= length:
                        own = _short_hash(hashes, length)
                        which.append(np.full(len(own), i - begin))
                        places.append(np.arange(len(own)))
                        fps.append(own)
                        wins.append(np.repeat(own[:, None], W, axis=1))
                        held += len(own)
                if held >= FINGERPRINT_ROWS or i + 1 == len(texts):
                    yield from rows(batch.slice(begin, i + 1 - begin), n_words, which, places, fps, wins)
                    begin, held = i + 1, 0
                    n_words, which, places, fps, wins = [], [], [], [], []
        del cache
        release_memory()

    source = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("digest"),
        F.col("text").cast("string").alias("text"),
    )
    return source.mapInArrow(run, _DOC_SCHEMA)


def window_hits(docs: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """row_id, doc_id, digest, n_words (on head rows), start, length, win: every place where a window of an item stands."""
    distinct = windows.select("fp", "shift", "length", "win").distinct()
    short = [r[0] for r in distinct.where(F.col("length") < SPAN).select("length").distinct().collect()]  # SPAN - 1 at most
    found = document_fingerprints(docs, sorted(short))
    at = F.col("shift")
    near = F.coalesce(*(F.when(at == j, F.col(f"w{j}")) for j in range(W)))
    match = (near == F.col("win")) & (F.col("pos") >= at)
    if distinct.limit(broadcast_windows + 1).count() <= broadcast_windows:
        joined = found.join(F.broadcast(distinct), "fp", "left")
    else:
        salted = distinct.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = found.withColumn("salt", F.pmod(F.xxhash64("row_id", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["fp", "salt"], "left")
    return joined.where(F.col("fp").isNull() | F.coalesce(match, F.lit(False))).select(
        "row_id", "doc_id", "digest", "n_words", (F.col("pos") - at).alias("start"), "length", "win"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """row_id, doc_id, digest (of the text), n_words, n_hit and items (sorted strings) for each document."""
    windows = settled(item_windows(benchmark), "windows")
    hits = settled(window_hits(docs, windows, broadcast_windows), "hits")
    along = Window.partitionBy("row_id").orderBy("start", "length")
    before = F.max(F.col("start") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce(before, F.lit(0)))
    covered = (
        hits.withColumn("fresh", F.when(F.col("start").isNotNull(), F.greatest(fresh, F.lit(0))))
        .groupBy("row_id", "doc_id", "digest")
        .agg(F.max("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"))
    )
    items = (
        hits.where(F.col("start").isNotNull())
        .select("row_id", "win", "length")
        .distinct()
        .join(windows.where("item_id IS NOT NULL").select("win", "length", "item_id").distinct(), ["win", "length"])
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    return covered.join(items, "row_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of an item, with their own columns."""
    hit = decontaminate(docs, benchmark).where("n_hit > 0").select("doc_id", F.col("digest").alias("_digest")).distinct()
    own = docs.withColumn("_digest", F.xxhash64("text"))
    same = own["doc_id"].eqNullSafe(hit["doc_id"]) & (own["_digest"] == hit["_digest"])
    return own.join(hit, same, "left_anti").drop("_digest")
