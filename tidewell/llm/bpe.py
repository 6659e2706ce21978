"""BPE encoding and decoding through a distinct-word table.

Spark splits every text at ASCII white space, which the tokenizer's own
normaliser and splitter never join across.  Each task turns the words of its
documents into chunks: a chunk holds the distinct words of some CHUNK_BYTES of
text once, and each document as the positions of its words in that dictionary.
The dictionaries go, dealt by a hash of the word, to parts; a part holds its
distinct words of the whole corpus and encodes each of them once.  Decoding
joins every token of a dictionary's words with the id-to-piece table, which has
a fixed number of rows for a tokenizer and is broadcast.  Ids and pieces go back
to their chunk and join the documents there by position.

Texts themselves are never shuffled: what moves are the packed positions, once,
and the dictionaries, there as sorted words and back as ids.  A frequent word
costs one entry for each chunk, whatever its number of places.

A chunk is named by a hash of its content and knows how many words its
dictionary has, so a chunk that a retried task builds in another order is
another chunk, and one whose ids don't come back whole is refused instead of
being decoded wrongly.

Defined results: null is empty and has no tokens; repeated rows each keep a
row; the tokenizer's special strings in a text become their ids, as in the
tokenizers library; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.workspace import release_memory, settled

#: Text of a chunk, and of a part's share, about.
CHUNK_BYTES = 16_000_000
#: Words that the tokenizer gets together.
ENCODE_BATCH = 4_096
#: Documents of a row of positions, at most.
ROW_DOCS = 500

WHITE = r"[ \t\n\x0B\f\r]+"

#: Dealt by slot: a chunk's rows of positions at slot = chunk with part -1, the words of a part at slot = part.
_DEALT = "slot long, chunk long, part int, base int, n int, doc_ids array<long>, sizes array<int>, packed binary"
_CODED = "slot long, base int, n int, lengths binary, ids array<int>"
_IDS = "slot long, base int, n int, packed binary, text binary"


def load_tokenizer(path: str):
    """The tokenizer; a task has one core, so it starts no threads (and no heap for each)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit integers with their bytes of one weight together, which packs best."""
    return np.ascontiguousarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


class Chunk:
    """The words of some documents, until they are enough."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.n_bytes = 0

    def add(self, doc_ids: pa.Array, words: pa.ListArray) -> None:
        self.doc_ids += doc_ids.to_pylist()
        self.sizes.append(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int32))
        self.words.append(words.flatten())
        self.n_bytes += words.nbytes

    def rows(self, n_parts: int, press) -> Iterator[tuple]:
        """Rows of _DEALT: the dictionary by parts, its words sorted, and the documents as positions in it."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        listed = coded.dictionary.cast(pa.binary())
        order = pc.sort_indices(listed).to_numpy()
        words = listed.take(pa.array(order)).to_pylist()
        part = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(n_parts)
        by_part = np.argsort(part, kind="stable")
        place = np.empty(len(words), np.int32)
        place[order[by_part]] = np.arange(len(words), dtype=np.int32)
        positions = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int32)
        sizes = np.concatenate(self.sizes)
        name = xxhash.xxh3_64(positions.tobytes())
        name.update(sizes.tobytes())
        name.update("\n".join(map(str, self.doc_ids)).encode())
        name.update(b"\n".join(words))
        chunk = int(np.uint64(name.intdigest()).view(np.int64)) | -(2**63)  # below any part
        ends = np.cumsum(sizes)
        for start in range(0, len(sizes), ROW_DOCS):
            stop = min(start + ROW_DOCS, len(sizes))
            begin = int(ends[start] - sizes[start])
            yield (chunk, chunk, -1, 0, len(words), self.doc_ids[start:stop], sizes[start:stop], press.compress(_planes(positions[begin : int(ends[stop - 1])])))
        borders = np.searchsorted(part[by_part], np.arange(n_parts + 1))
        for p in np.flatnonzero(np.diff(borders)).tolist():
            base, end = int(borders[p]), int(borders[p + 1])
            yield (p, chunk, p, base, end - base, None, None, press.compress(b"\n".join([words[i] for i in by_part[base:end]])))


def word_chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The rows of _DEALT of all documents in one exchange by slot, and its partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(2, -(-total // chunk_bytes))
    schema = _arrow(_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, chunk = zstandard.ZstdCompressor(level=3), Chunk()
        for batch in batches:
            step = max(1, batch.num_rows * chunk_bytes // (4 * batch.nbytes + 1))
            for start in range(0, batch.num_rows, step):
                chunk.add(batch.column(0).slice(start, step), batch.column(1).slice(start, step))
                if chunk.n_bytes >= chunk_bytes:
                    yield _batch(list(chunk.rows(n_parts, press)), schema)
                    chunk = Chunk()
        if chunk.doc_ids:
            yield _batch(list(chunk.rows(n_parts, press)), schema)
        del chunk
        release_memory()

    words = F.array_remove(F.split(F.col("text").cast("string"), WHITE), "")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).mapInArrow(run, _DEALT)
    return dealt.repartition(int(n_parts), "slot"), int(n_parts)


def encode_words(dealt: DataFrame, path: str) -> DataFrame:
    """Each part's distinct words, encoded once, for each dictionary that holds them.

    slot (the chunk), base, n and either lengths (tokens of each of the n words) or their ids, in this order.
    """
    schema = _arrow(_CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        uses: list[tuple[int, int]] = []
        words: list[pa.Array] = []
        for batch in batches:
            for row in batch.filter(pc.greater_equal(batch.column(2), 0)).select(["chunk", "base", "packed"]).to_pylist():
                uses.append((row["chunk"], row["base"]))
                words.append(pa.array(unpack.decompress(row["packed"]).split(b"\n"), pa.binary()))
        if not uses:
            return
        coded = pa.concat_arrays(words).dictionary_encode()
        distinct = coded.dictionary.cast(pa.string())
        tokenizer = load_tokenizer(path)
        release_memory()  # of reading its file
        found: list[np.ndarray] = []
        for start in range(0, len(distinct), ENCODE_BATCH):
            part = distinct.slice(start, ENCODE_BATCH).to_pylist()
            found += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.concatenate(found)
        del tokenizer, found, distinct
        release_memory()
        begins = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        begin = 0
        for (chunk, base), its in zip(uses, words, strict=True):
            own = which[begin : begin + len(its)]
            begin += len(its)
            sizes = lengths[own]
            ids = flat[_runs(begins[own], sizes)]
            yield _batch([(chunk, base, len(own), press.compress(sizes.tobytes()), None), (chunk, base, len(own), None, ids)], schema)

    return dealt.mapInArrow(run, _CODED)


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """id, piece: the pieces of the tokenizer, each with the blank that joins it to the next one."""
    vocabulary = load_tokenizer(path).get_vocab(with_added_tokens=True)
    return docs.sparkSession.createDataFrame([(number, piece + " ") for piece, number in vocabulary.items()], "id int, piece string")


def with_pieces(coded: DataFrame, path: str) -> DataFrame:
    """slot, base, n, packed (lengths, ids, bytes of each word's pieces), text (the pieces): every token met with its piece.

    The join is a broadcast one, so the tokens of a dictionary's words stay
    together and in order, which is checked.
    """
    schema = _arrow(_IDS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        head, lengths, ids, sizes, texts = None, None, [], [], []

        def closed() -> tuple:
            own, size = np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([np.empty(0, np.int32), *sizes])
            if len(own) != int(lengths.sum()):
                raise RuntimeError("the tokens of a dictionary are not together")
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(lengths)])]
            packed = np.concatenate([lengths, own, np.diff(ends).astype(np.int32)])
            return (*head, press.compress(_planes(packed)), press.compress(b"".join(texts)))

        for batch in batches:
            done = []
            heads = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            places, numbers = batch.column(4).fill_null(-1).to_numpy(), batch.column(5).fill_null(-1).to_numpy()
            pieces = batch.column(6).cast(pa.binary()).fill_null(b"")
            offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
            data = memoryview(pieces.buffers()[2] or b"")
            for start, stop in zip([0, *(heads + 1)], [*heads, batch.num_rows], strict=True):
                # rows from start on are tokens of the head before them
                real = stop - start - int(np.count_nonzero(places[start:stop] < 0))
                if real:
                    if places[start] != sum(map(len, ids)) or places[start + real - 1] != places[start] + real - 1:
                        raise RuntimeError("the tokens of a dictionary are not together")
                    ids.append(numbers[start : start + real])
                    sizes.append(np.diff(offsets[start : start + real + 1]))
                    texts.append(bytes(data[offsets[start] : offsets[start + real]]))
                if stop < batch.num_rows:
                    if head is not None:
                        done.append(closed())
                    head = tuple(batch.column(i)[int(stop)].as_py() for i in range(3))
                    lengths = np.frombuffer(unpack.decompress(batch.column(3)[int(stop)].as_py()), np.int32)
                    ids, sizes, texts = [], [], []
            if done:
                yield _batch(done, schema)
        if head is not None:
            yield _batch([closed()], schema)
        release_memory()

    tokens = coded.select("slot", "base", "n", "lengths", F.posexplode_outer("ids").alias("pos", "id"))
    met = tokens.join(F.broadcast(piece_table(coded, path)), "id", "left").select("slot", "base", "n", "lengths", "pos", "id", "piece")
    return met.mapInArrow(gather, _IDS)


def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of those sizes, one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def joined_by_position(dealt: DataFrame, back: DataFrame, schema: str, finish: Callable) -> DataFrame:
    """What ``finish`` makes of doc_id, ids (numpy) and decoded text (UTF-8) of each document: its positions met with its chunk's dictionary."""
    own = _arrow(schema)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        # an equal chunk gives equal parts again
        parts = {row["base"]: (row["n"], _numbers(unpack.decompress(row["packed"])), unpack.decompress(row["text"])) for row in right.to_pylist()}
        if left.num_rows and left.column("part")[0].as_py() >= 0:
            return own.empty_table()
        if not left.num_rows or sum(n for n, _, _ in parts.values()) != left.column("n")[0].as_py():
            raise RuntimeError("the ids of a chunk's words did not come back whole; the input changed between two reads")
        whole = [both for _, both in sorted(parts.items())]
        empty = np.empty(0, np.int32)
        lengths = np.concatenate([empty, *(x[:n] for n, x, _ in whole)])
        ids = np.concatenate([empty, *(x[n:-n] for n, x, _ in whole)])
        text_ends = np.concatenate([[0], np.cumsum(np.concatenate([empty, *(x[-n:] for n, x, _ in whole)]), dtype=np.int64)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(text_ends), pa.py_buffer(b"".join(t for _, _, t in whole))])
        begins = np.cumsum(lengths) - lengths
        rows = []
        for row in left.select(["doc_ids", "sizes", "packed"]).to_pylist():
            positions = _numbers(unpack.decompress(row["packed"]))
            tokens = ids[_runs(begins[positions], lengths[positions])]
            said = texts.take(pa.array(positions))
            offsets = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1]
            data = memoryview(said.buffers()[2] or b"")
            word_ends = np.concatenate([[0], np.cumsum(row["sizes"])])
            token_ends = np.concatenate([[0], np.cumsum(lengths[positions])])[word_ends]
            for i, doc in enumerate(row["doc_ids"]):
                text = bytes(data[offsets[word_ends[i]] : offsets[word_ends[i + 1]]])[:-1]
                rows.append(finish(doc, tokens[token_ends[i] : token_ends[i + 1]], text))
        found = pa.Table.from_batches([_batch(rows, own)])
        del rows, texts, ids, lengths, begins, whole, parts
        release_memory()
        return found

    return dealt.groupBy("slot").cogroup(back.groupBy("slot")).applyInArrow(join, schema)


def _documents(docs: DataFrame, path: str, chunk_bytes: int, schema: str, finish: Callable) -> DataFrame:
    dealt, n_parts = word_chunks(docs, chunk_bytes)
    back = with_pieces(encode_words(dealt, path), path).repartition(n_parts, "slot")
    return joined_by_position(dealt, back, schema, finish)


def encode_documents(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, ids, decoded: the tokens of every whole text and their decoded text."""
    return _documents(docs, path, chunk_bytes, "doc_id long, ids array<int>, decoded string", lambda doc, ids, text: (doc, ids, text.decode()))


def digest_documents(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode_documents gives, as digests.

    Written to the shared folder, so that Python workers get small batches (see
    ``settled``): the rows of positions are up to a few MB each.
    """
    digests = _documents(
        docs, path, chunk_bytes, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda doc, ids, text: (doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()),
    )
    return settled(digests, "digests")
