r"""Secret scans: fixed patterns, and Shannon entropy in a sliding window.

Patterns (kinds ``assign``, ``access`` and ``hex``) are leftmost and do not
overlap within a kind.  Beside them, candidate strings are runs of at least
WINDOW characters out of letters, digits and ``+/_=-``.  Within a candidate, the
longest runs over the alphabet of a character class are read by a window of
WINDOW characters.  The window's entropy is held as the sum of c*log2(c) over
the counts c of its characters: a step takes one character out and one in, so it
costs two look-ups, and the sum is kept in whole units of 2**-20 bits, so it
does not depend on the order of steps.  Windows that reach the class's bound are
hot; hot windows that overlap or touch are one span.

A candidate that matches the allow list (words and paths without a digit,
numbers and dates, UUIDs, alphabets in order, labelled checksums, placeholders)
gives no entropy span; the patterns' spans always stay.

Spans are (kind, start, end) in code points, end exclusive.  Defined results:
null text is empty; repeated rows each give a row; other columns are ignored.
Rows are scanned where they lie: no shuffle, no state between rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.words import binary_column
from tidewell.llm.workspace import release_memory


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Patterns of the scan.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Characters of a window.
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes: kind, alphabet, least bits for each character of a window.
CLASSES = (("entropy_hex", "0-9A-Fa-f", 3.0), ("entropy_base64", "A-Za-z0-9+/_-", 4.0))
KINDS = ("assign", "access", "hex", *(kind for kind, _, _ in CLASSES))
# Candidates that are no secrets.
ALLOWED = (
    r"^[A-Za-z/_=+-]+$",
    r"^[0-9/_=+-]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]|0123456789",
    r"^(sha1|sha256|sha384|sha512|md5)[-=_]",
    r"EXAMPLE|example|PLACEHOLDER|placeholder|[Xx]{6}",
)

SCALE = 2**20
#: c * log2(c) in units of 1 / SCALE, for c up to WINDOW.
WEIGHTS = tuple(round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1))


def most_weight(bits: float) -> int:
    """The largest sum of weights with which a window has at least so many bits for each character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def hot_spans(run: bytes, most: int) -> list[tuple[int, int]]:
    """Unions of the windows of a run whose weight is ``most`` at the most."""
    counts, weight, spans = [0] * 256, 0, []
    for end, byte in enumerate(run, 1):
        weight += WEIGHTS[counts[byte] + 1] - WEIGHTS[counts[byte]]
        counts[byte] += 1
        if end >= WINDOW:
            start = end - WINDOW
            if weight <= most:
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
            out = run[start]
            weight += WEIGHTS[counts[out] - 1] - WEIGHTS[counts[out]]
            counts[out] -= 1
    return spans


class Scanner:
    """Spans of UTF-8 texts, in bytes; every pattern is over ASCII, so code points are never cut."""

    def __init__(self):
        self.assign = re.compile(ASSIGN.encode())
        self.access = re.compile(ACCESS.encode())
        # a pattern that can start at any character of a run is tried at the first one only
        self.hex = re.compile(f"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}".encode())
        self.candidate = re.compile(f"(?<![A-Za-z0-9+/_=-]){CANDIDATE}".encode())
        self.allowed = re.compile("|".join(ALLOWED).encode())
        self.classes = [(n, re.compile(f"[{letters}]{{{WINDOW},}}".encode()), most_weight(bits)) for n, (_, letters, bits) in enumerate(CLASSES, 3)]

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end), in order."""
        found = []
        low = raw.lower()
        if any(hint in low for hint in (b"passw", b"secret", b"token", b"api")):
            found += [(m.start(), 0, m.end()) for m in self.assign.finditer(raw) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        if b"AKIA" in raw:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
        for candidate in self.candidate.finditer(raw):
            at, text = candidate.start(), candidate.group()
            found += [(at + m.start(), 2, at + m.end()) for m in self.hex.finditer(text)]
            if self.allowed.search(text):
                continue
            for kind, pattern, most in self.classes:
                for run in pattern.finditer(text):
                    found += [(at + run.start() + a, kind, at + run.start() + b) for a, b in hot_spans(run.group(), most)]
        return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, and spans: an array of (kind, start, end), by start and then in order of KINDS."""
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            rows = []
            for raw in binary_column(batch, "text"):
                spans = scanner.spans(raw) if raw else []
                if spans and not raw.isascii():
                    # code points up to each byte: bytes that do not continue one
                    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    spans = [(int(points[a]), kind, int(points[b])) for a, kind, b in spans]
                rows.append([{"kind": KINDS[kind], "start": a, "end": b} for a, kind, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], names=["doc_id", "spans"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema)


def redacted(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """doc_id, and text with the union of the spans of each text replaced by ``mask``."""
    schema = "doc_id long, text string"

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = []
            for raw in binary_column(batch, "text"):
                parts, done = [], 0
                for start, _, end in scanner.spans(raw) if raw else []:
                    if start >= done:
                        parts += [raw[done:start], mask.encode()]
                    done = max(done, end)
                texts.append(None if raw is None else b"".join([*parts, raw[done:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(replace, schema)
