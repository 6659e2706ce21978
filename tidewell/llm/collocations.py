r"""Phrase collocation mining over position bitmaps.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and
pieces into words at blanks and tabs.  A task lays the words of its rows out as
shards, which are written once: the words of one language as numbers by
position, with an empty position between pieces.  Within a shard each word is a
compressed position bitmap, which lists only the blocks of 16 positions where
the word stands, as (block, mask).
A phrase's bitmap marks its last words.  Shifting it by one position and taking
AND with the bitmap of a word gives the bitmap of the longer phrase; as the
positions between pieces are in no bitmap, phrases end with their piece.
Popcounts give the occurrences in the shard, and their sums over all shards the
occurrences in the corpus.  Phrases are extended depth-first: a group of first
words is carried to the full length before the next group starts, so a task's
memory is bounded by SHARD_WORDS and GROUP_ENTRIES.

A phrase that is frequent consists of frequent phrases, so three passes over the
shards prune what is extended: the first sums words and pairs (as 64-bit
hashes), the second the triples of frequent pairs, the third all phrases, as
words, that may be frequent by then.  What is frequent reaches the tasks as a
bit table of FILTER_BITS bits: a hash with its bit unset is not frequent, one
with its bit set may be; words that are not frequent leave an empty position.
So the tables and clashes of hashes cost work but change nothing: the counts of
the last pass are exact, of words themselves.  The tables have a fixed size;
where the frequent phrases of a corpus fill them, more is counted in vain.

Defined results: null text is empty; a null language is ``und``; repeated rows
each count; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.words import binary_column, mix64
from tidewell.llm.workspace import release_memory, settled

#: A candidate has at least so many occurrences, from two to LONGEST words; so many are returned for each language.
LEAST = 30
LONGEST = 4
TOP = 2_000
#: A candidate goes if a longer one that holds it has this percent of its occurrences.
ABSORBED = 80
#: Scores are whole numbers: this times a / (l + r).
SCALE = 2_000_000
UNKNOWN = "und"

#: Positions of the shards that a task fills at a time, shards of a file, and bitmap entries that are extended together.
SHARD_WORDS = 2_000_000
FILE_SHARDS = 16
GROUP_ENTRIES = 150_000
#: Bits of the table of phrases that may be frequent (16 MB).
FILTER_BITS = 27
#: Parts of a language that are ranked by themselves before the whole.
RANK_PARTS = 64

_GAP = b"."
# Characters that end a piece, and the tab that parts words as a blank does.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(_GAP) if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BITS = 16


class _Numbers(dict):
    """Word to number, in order of first use; the gap between pieces is 0."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def pieces_as_words(raw: bytes) -> list[bytes]:
    """The words of a text, with a gap where a piece ends."""
    return raw.translate(_TABLE).replace(_GAP, b" . ").split() + [_GAP]


class Bitmaps:
    """Compressed bitmaps of (key, block) entries."""

    def __init__(self, keys: np.ndarray, blocks: np.ndarray, masks: np.ndarray):
        self.keys, self.blocks, self.masks = keys, blocks, masks

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, which: np.ndarray) -> Bitmaps:
        return Bitmaps(self.keys[which], self.blocks[which], self.masks[which])

    def shifted(self) -> Bitmaps:
        """Every bit one position on; what leaves a block is an entry of the next one."""
        over = np.flatnonzero(self.masks >> (_BITS - 1))
        stay = np.flatnonzero(self.masks << 1 & 0xFFFF)
        return Bitmaps(
            np.concatenate([self.keys[stay], self.keys[over]]),
            np.concatenate([self.blocks[stay], self.blocks[over] + 1]),
            np.concatenate([self.masks[stay] << 1, np.ones(len(over), np.uint16)]).astype(np.uint16),
        )

    def popcounts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, their popcounts, and the place of each entry's key."""
        keys, place = np.unique(self.keys, return_inverse=True)
        return keys, np.bincount(place, np.bitwise_count(self.masks), len(keys)).astype(np.int64), place


def word_bitmaps(ids: np.ndarray) -> Bitmaps:
    """Bitmaps of all words of a shard, by block and then by word; number 0 has none."""
    padded = np.zeros(-(-len(ids) // _BITS) * _BITS, np.int64)
    padded[: len(ids)] = ids
    keyed = np.sort((padded.reshape(-1, _BITS) << 4) + np.arange(_BITS), axis=1).ravel()
    words, bits = keyed >> 4, (1 << (keyed & 15)).astype(np.uint16)
    blocks = np.repeat(np.arange(len(padded) // _BITS, dtype=np.int32), _BITS)
    starts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (blocks[1:] != blocks[:-1])])) if len(words) else np.empty(0, int)
    masks = np.bitwise_or.reduceat(bits, starts) if len(starts) else bits
    every = Bitmaps(words[starts], blocks[starts], masks)
    return every.take(every.keys > 0)


class MayBeFrequent:
    """A bit table over hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - FILTER_BITS)
        return (self.table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def extended(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return mix64(mix64(head) * np.uint64(0x9E3779B97F4A7C15) + tail)


class Shard:
    """The positions of one language in a task, and the phrases in them; words that ``pruned`` rules out are left empty."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, pruned: list[MayBeFrequent]):
        #: Words of the shard, also those that are ruled out.
        self.size = int(np.count_nonzero(ids))
        if pruned:
            alive = pruned[0](hashes)
            alive[0] = False
            ids = ids * alive[ids]
        self.ids, self.hashes, self.pruned = ids, hashes, pruned
        self.words = word_bitmaps(ids)
        counts = np.bincount(self.words.blocks, minlength=(self.words.blocks[-1] + 3 if len(self.words) else 2))
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """Words, as numbers, and their occurrences."""
        counts = np.bincount(self.ids)
        counts[:1] = 0
        found = np.flatnonzero(counts)
        return found, counts[found]

    def follow(self, prefixes: Bitmaps) -> tuple[Bitmaps, np.ndarray]:
        """AND of the shifted bitmaps with those of the words in the same blocks: entries that are not empty, and their new word."""
        moved = prefixes.shifted()
        n = self.first[moved.blocks + 1] - self.first[moved.blocks]
        of = np.repeat(np.arange(len(moved), dtype=np.int32), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[moved.blocks], n)
        both = moved.masks[of] & self.words.masks[at]
        live = np.flatnonzero(both)
        of, at = of[live], at[live]
        return Bitmaps(moved.keys[of], moved.blocks[of], both[live]), self.words.keys[at]

    def phrases(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(words, hashes, popcounts) of the phrases from two words on that may be frequent.

        Each group of first words is carried to ``longest`` words before the next one starts.
        """
        by_word = self.words.take(np.argsort(self.words.keys, kind="stable"))
        firsts = np.flatnonzero(np.diff(by_word.keys, prepend=0))
        # a group ends with a word; a word has at most one entry for each block
        heads = np.unique(np.searchsorted(firsts, np.arange(0, len(by_word), GROUP_ENTRIES)))
        edges = [*firsts[heads[heads < len(firsts)]], len(by_word)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            group = by_word.take(slice(low, high))
            yield from self._deeper(group, group.keys[:, None], longest)

    def _deeper(self, prefixes: Bitmaps, words: np.ndarray, longest: int) -> Iterator:
        """``words`` has the phrase of each entry; keys of entries number the distinct phrases."""
        depth = words.shape[1] + 1
        distinct, place = np.unique(prefixes.keys, return_index=True)
        phrases = words[place]
        prefixes = Bitmaps(np.searchsorted(distinct, prefixes.keys), prefixes.blocks, prefixes.masks)
        grown, new = self.follow(prefixes)
        pairs = Bitmaps(grown.keys * len(self.hashes) + new, grown.blocks, grown.masks)
        keys, counts, place = pairs.popcounts()
        head, tail = np.divmod(keys, len(self.hashes))
        found = np.concatenate([phrases[head], tail[:, None]], axis=1)
        hashes = self.hashes[found[:, 0]]
        for j in range(1, depth):
            hashes = extended(hashes, self.hashes[found[:, j]])
        keep = np.ones(len(found), bool)
        for size, allowed in enumerate(self.pruned, 2):
            if size == depth:
                keep &= allowed(hashes)
            elif size < depth:
                # the phrase without its first words: those without its last ones have been looked at
                tails = self.hashes[found[:, depth - size]]
                for j in range(depth - size + 1, depth):
                    tails = extended(tails, self.hashes[found[:, j]])
                keep &= allowed(tails)
        yield found[keep], hashes[keep], counts[keep]
        if depth < longest:
            live = np.flatnonzero(keep[place])
            if len(live):
                yield from self._deeper(Bitmaps(place[live], pairs.blocks[live], pairs.masks[live]), found[place[live]], longest)


def shards_of(docs: DataFrame) -> DataFrame:
    """lang, ids (32-bit numbers by position, 0 where a piece ends), words (blank between them, in order of their numbers from 1)."""

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: defaultdict[str, _Numbers] = defaultdict(lambda: _Numbers({_GAP: 0}))
        rows: defaultdict[str, list] = defaultdict(list)
        size = 0

        def filled() -> Iterator[pa.RecordBatch]:
            for lang, parts in rows.items():
                words = b" ".join(list(numbers[lang])[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.array([np.concatenate(parts).tobytes()], pa.binary()), pa.array([words], pa.binary())], names=["lang", "ids", "words"]
                )

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                words = pieces_as_words(raw or b"")
                if len(words) > 1:
                    rows[lang].append(np.fromiter(map(numbers[lang].__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    if size >= SHARD_WORDS:
                        yield from filled()
                        numbers.clear()
                        rows.clear()
                        size = 0
        yield from filled()
        release_memory()

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string"))
    return source.mapInArrow(lay_out, "lang string, ids binary, words binary")


def _opened(batches: Iterator[pa.RecordBatch], pruned: list[Broadcast]) -> Iterator[tuple[str, list[bytes], Shard]]:
    allowed = [MayBeFrequent(table.value) for table in pruned]
    for batch in batches:
        for n in range(batch.num_rows):
            lang, ids, words = (batch.column(c)[n].as_py() for c in range(3))
            words = [_GAP, *words.split(b" ")]
            seed = xxhash.xxh3_64_intdigest(lang.encode())
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))
            yield lang, words, Shard(np.frombuffer(ids, np.int32), hashes, allowed)


def _hashed_counts(shards: DataFrame, size: int, pruned: list[Broadcast]) -> DataFrame:
    """hash, a: occurrences in each shard of the phrases of ``size`` words that may be frequent; with pairs come the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, shard in _opened(batches, pruned):
            if size == 2:
                found, counts = shard.singles()
                yield pa.RecordBatch.from_arrays([pa.array(shard.hashes[found].view(np.int64)), pa.array(counts)], names=["hash", "a"])
            for found, hashes, counts in shard.phrases(size):
                if found.shape[1] == size and len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["hash", "a"])
        release_memory()

    return shards.mapInArrow(count, "hash long, a long")


def _filter_of(counts: DataFrame, least: int) -> Broadcast:
    """The bit table of hashes that occur at least so often; at most 2 ** FILTER_BITS bits reach the driver.

    Rows are distinct within a shard, so they go to their hash's partition before any are summed.
    """
    spark = counts.sparkSession
    frequent = counts.repartition("hash").groupBy("hash").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    bit = F.shiftrightunsigned(F.col("hash"), 64 - FILTER_BITS)
    parts = frequent.select(bit.alias("bit")).selectExpr("cast(bit >> 5 as int) AS word", "shiftleft(1L, cast(bit & 31 as int)) AS mask")
    table = np.zeros(2**FILTER_BITS // 32, "<u4")
    set_bits = parts.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[set_bits["word"].to_numpy()] = set_bits["mask"].to_numpy().astype("<u4")
    return spark.sparkContext.broadcast(table.view(np.uint8))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, words, a: exact occurrences of phrases up to ``longest`` words that occur ``least`` times, and of the words in them.

    A phrase of no words has the number of all words of its language.
    """
    shards = settled(shards_of(docs), "positions", maxRecordsPerFile=str(FILE_SHARDS))
    pruned: list[Broadcast] = []
    for size in range(2, longest):
        pruned.append(_filter_of(_hashed_counts(shards, size, pruned), least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(lang: str, phrases: list[bytes], words: int, counts) -> pa.RecordBatch:
            n = len(phrases)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([words] * n, pa.int32()), pa.array(counts, pa.int64())],
                names=["lang", "phrase", "words", "a"],
            )

        for lang, words, shard in _opened(batches, pruned):
            for found, _, counts in shard.phrases(longest):
                if len(found):
                    yield batch_of(lang, [b" ".join([words[i] for i in row]) for row in found.tolist()], found.shape[1], counts)
            found, counts = shard.singles()
            yield batch_of(lang, [words[i] for i in found], 1, counts)
            yield batch_of(lang, [b""], 0, [shard.size])
        release_memory()

    found = shards.mapInArrow(count, "lang string, phrase string, words int, a long")
    summed = found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    return summed.where((F.col("a") >= least) | (F.col("words") == 0))


def _cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
    cut = cut.withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " "))
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cut = cut.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    exact = cut.withColumn("score", F.expr(f"({SCALE} * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return exact.groupBy("lang", "phrase", "words", "a").agg(lowest.alias("cut")).select("lang", "phrase", "words", "a", "cut.*")


def _absorbed(candidates: DataFrame) -> DataFrame:
    """lang, phrase of candidates that stand inside a longer one with nearly as many occurrences."""
    words = F.split("phrase", " ")
    inner = candidates.where("words > 2").withColumn("size", F.explode(F.expr("sequence(2, words - 1)")))
    inner = inner.withColumn("start", F.explode(F.expr("sequence(1, words - size + 1)")))
    inner = inner.select("lang", F.array_join(F.slice(words, F.col("start"), F.col("size")), " ").alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    of = candidates.select("lang", "phrase", F.col("a").cast("decimal(20, 0)").alias("own"))
    return of.join(most, ["lang", "phrase"]).where(100 * F.col("longer").cast("decimal(20, 0)") >= ABSORBED * F.col("own")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language with the highest scores."""
    counts = settled(phrase_counts(docs, least, longest), "phrases")
    candidates = counts.where("words >= 2")
    scored = _cuts(candidates, counts).join(_absorbed(candidates), ["lang", "phrase"], "left_anti")
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
