r"""Fill-in-middle transformation by an Aho-Corasick scan for events.

A text is cut at two places between its units, where a unit is a run of ASCII
letters or any other single code point, and rewritten so that a model learns to
fill the middle from prefix and suffix.  One automaton reads the UTF-8 bytes of
a text once and reports only events: ASCII characters that are no letters, first
bytes of longer code points, and the sentinels.  Between two events lie ASCII
letters alone (after the known length of a longer code point), so a gap is one
unit if it has any length: the units before every event follow by arithmetic,
and a place is found by looking its rank up among the events.

Places, and whether and how a text is rewritten, are drawn from the SHA-256 of a
seed and the id, so a repeated run gives the same rows.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and
``spm`` (suffix, prefix, middle), with a sentinel before each part.  A text that
holds a sentinel stays plain, so an output is read back without doubt.

Defined results: null text is empty and stays plain with n 0; a null id is drawn
as an empty string; repeated rows each give a row; other columns are ignored.
Batches bound the memory by their bytes; a very long text is one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import binary_column
from tidewell.llm.workspace import release_memory

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are rewritten, and percent of those in the order suffix, prefix, middle.
FIM_PERCENT = 90
SPM_PERCENT = 20
SEED = 1

_SENTINEL = -1
_EVENT = np.dtype([("at", np.int64), ("size", np.int64)])


def event_automaton() -> ahocorasick.Automaton:
    """Events over UTF-8 bytes read as Latin-1: 1 to 4 bytes of a unit that is no letter run, or _SENTINEL."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for byte in range(0xF5):
        if byte < 0x80 and not chr(byte).isalpha():
            found.add_word(chr(byte), 1)
        elif byte >= 0xC2:
            found.add_word(chr(byte), 2 + (byte >= 0xE0) + (byte >= 0xF0))
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """Where the units of a text lie, from its events."""

    def __init__(self, raw: bytes, automaton: ahocorasick.Automaton):
        events = np.fromiter(automaton.iter(raw.decode("latin-1")), _EVENT)
        marks = events["size"] == _SENTINEL
        self.has_sentinel = bool(marks.any())
        events = events[~marks]
        self.starts = events["at"]
        self.ends = self.starts + events["size"]
        self.size = len(raw)
        gap = self.starts > np.concatenate([[0], self.ends[:-1]])
        #: Units up to the start and to the end of each event.
        self.before = np.arange(len(self.starts)) + np.cumsum(gap)
        self.after = self.before + 1
        last = self.ends[-1] if len(self.ends) else 0
        self.count = int(self.after[-1] if len(self.after) else 0) + int(self.size > last)

    def place(self, rank: int) -> int:
        """Bytes taken by the first ``rank`` units."""
        if rank == 0:
            return 0
        at = int(np.searchsorted(self.after, rank))
        if at == len(self.after):
            return self.size
        return int(self.ends[at] if self.after[at] == rank else self.starts[at])


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit integers for an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _transformed(raw: bytes, doc_id: object, automaton, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    units = Units(raw, automaton)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or units.has_sentinel or h3 % 100 >= FIM_PERCENT:
        return units.count, "plain", None, None, raw
    one, two = sorted((h1 % (units.count + 1), h2 % (units.count + 1)))
    a, b = units.place(one), units.place(two)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SPM_PERCENT:
        form, output = "spm", s + suffix + p + prefix + m + middle
    else:
        form, output = "psm", p + prefix + s + suffix + m + middle
    return units.count, form, len(prefix.decode()), len(middle.decode()), output


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain), output."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = event_automaton()
        for batch in batches:
            ids = batch.column(0)
            rows = [_transformed(raw or b"", i, automaton, seed) for i, raw in zip(ids.to_pylist(), binary_column(batch, "text"), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(transform, schema)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no part holds a sentinel, so the sentinels part the output."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.element_at(parts, i) for i in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
