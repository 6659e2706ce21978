"""Language identification: a bidirectional gated recurrent network over bytes.

Each direction is a gated recurrent unit with one input table row for every
byte value; both states of a position feed a softmax, so every position gets a
label, and a document's probabilities are the mean over its positions.  Trained
in numpy by backpropagation through time on windows cut from at most LANG_DOCS
labelled documents of each language outside the held-out fold.

A whole text is scored: its bytes are cut into windows of WINDOW bytes, which
run through the network side by side, so a long text costs what its bytes cost
and the state of a worker is bounded by BATCH windows.  The states of both
directions start anew in each window, as they did in training.

Only letters weigh in the mean (white space, digits and punctuation look alike
in all languages).  A text that is null or has no letter is ``und`` with score
0.  Without labelled rows every text is ``und``.  Repeated rows each keep a
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sampling import held_out, lowest_hashes_each, rows_of
from tidewell.llm.words import binary_column
from tidewell.llm.workspace import release_memory

#: Labelled documents of each language that the network is fitted on, at most, and windows cut from each.
LANG_DOCS = 500
TRAIN_CUTS = 3
WINDOW = 64
HIDDEN = 8
#: Windows that run side by side.
BATCH = 4_096
UNKNOWN = "und"
#: Least probability of the language of a document that stays in a corpus.
LEAST_SCORE = 0.3

_PAD = 0
#: Weight of a byte's position in the mean: letters of ASCII and all bytes of other code points.
_LETTER = np.array([1.0 if b >= 128 or chr(b).isalpha() else 0.0 for b in range(256)], np.float32)


@dataclass
class Network:
    """Parameters of both directions (first axis) and of the output layer."""

    langs: list[str]
    table: np.ndarray  # 2, 256, 3 H: update gate, reset gate, candidate
    gates: np.ndarray  # 2, H, 2 H
    candidate: np.ndarray  # 2, H, H
    out: np.ndarray  # 2 H, L
    bias: np.ndarray  # L

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.candidate, self.out, self.bias]

    def states(self, codes: np.ndarray, side: int, keep: list | None = None) -> np.ndarray:
        """States of one direction, T, N, H, for codes of shape T, N."""
        steps, n = codes.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        table, gates, candidate = self.table[side], self.gates[side], self.candidate[side]
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            x = table[codes[t]]
            zr = h @ gates
            zr += x[:, : 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1.0
            zr *= 0.5  # the logistic function, by way of tanh
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = (r * h) @ candidate
            c += x[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, z, r, c))
            h = h + z * (c - h)
            states[t] = h
        return states

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of each position, T, N, L."""
        both = np.concatenate([self.states(codes, 0), self.states(codes, 1)], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits


def cut(raw: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one padded."""
    codes = np.frombuffer(raw, np.uint8)
    rows = -(-len(codes) // WINDOW)
    padded = np.full(rows * WINDOW, _PAD, np.uint8)
    padded[: len(codes)] = codes
    return padded.reshape(rows, WINDOW)


def initial(langs: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(
        langs,
        draw(2, 256, 3 * HIDDEN, scale=0.3),
        draw(2, HIDDEN, 2 * HIDDEN, scale=0.3),
        draw(2, HIDDEN, HIDDEN, scale=0.3),
        draw(2 * HIDDEN, len(langs), scale=0.3),
        np.zeros(len(langs), np.float32),
    )


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradients by backpropagation through time; codes T, N; labels N; weights T, N, summing to 1."""
    keeps: list[list] = [[], []]
    both = np.concatenate([net.states(codes, s, keeps[s]) for s in (0, 1)], axis=2)
    logits = both @ net.out + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    rows = np.arange(codes.shape[1])
    loss = float(-(weights * np.log(p[:, rows, labels] + 1e-9)).sum())
    d_logits = p
    d_logits[:, rows, labels] -= 1
    d_logits *= weights[:, :, None]
    grads = [np.zeros_like(q) for q in net.parameters()]
    g_table, g_gates, g_candidate, g_out, g_bias = grads
    g_out += np.einsum("tnh,tnl->hl", both, d_logits, optimize=True)
    g_bias += d_logits.sum((0, 1))
    d_both = d_logits @ net.out.T
    for side in (0, 1):
        d_next = np.zeros((codes.shape[1], HIDDEN), np.float32)
        d_states = d_both[:, :, side * HIDDEN : (side + 1) * HIDDEN]
        for t, h, z, r, c in reversed(keeps[side]):
            d = d_states[t] + d_next
            d_c = d * z * (1 - c * c)
            d_rh = d_c @ net.candidate[side].T
            d_z = d * (c - h) * z * (1 - z)
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], axis=1)
            g_candidate[side] += (r * h).T @ d_c
            g_gates[side] += h.T @ d_zr
            np.add.at(g_table[side], codes[t], np.concatenate([d_zr, d_c], axis=1))
            d_next = d * (1 - z) + d_rh * r + d_zr @ net.gates[side].T
    return loss, grads


def fit(langs: list[str], windows: np.ndarray, labels: np.ndarray, steps: int = 260, batch: int = 192, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam on batches drawn evenly over the languages."""
    net = initial(langs)
    rng = np.random.default_rng(seed)
    by_lang = [np.flatnonzero(labels == i) for i in range(len(langs))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(rows, max(1, batch // len(langs))) for rows in by_lang])
        codes, own = windows[chosen].T, labels[chosen]
        weights = _LETTER[codes]
        weights = weights / max(float(weights.sum()), 1.0)
        _, grads = gradients(net, codes, own, weights)
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * min(1.0, 3 * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def train_windows(docs: DataFrame, lang_docs: int = LANG_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes from at most ``lang_docs`` labelled documents of each language: TRAIN_CUTS of each, at places drawn by its id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = lowest_hashes_each(known.select("doc_id", "lang"), lang_docs, "lang")
    n = F.length("text")
    starts = [F.pmod(F.xxhash64(F.lit(j), "doc_id"), F.greatest(n - WINDOW, F.lit(1))).cast("int") + 1 for j in range(TRAIN_CUTS)]
    pieces = docs.where("text IS NOT NULL").select("doc_id", F.array(*(F.substring("text", s, F.lit(WINDOW)) for s in starts)).alias("cuts"))
    cuts = rows_of(pieces, chosen).toLocalIterator()
    found = sorted((row["doc_id"], row["lang"], piece) for row in cuts for piece in row["cuts"] if any(c.isalpha() for c in piece))
    langs = sorted({lang for _, lang, _ in found})
    windows = np.zeros((len(found), WINDOW), np.uint8)
    for i, (_, _, piece) in enumerate(found):
        raw = piece.encode("utf-8", "surrogatepass")[:WINDOW]
        windows[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    return langs, windows, np.array([langs.index(lang) for _, lang, _ in found], int)


def train(docs: DataFrame, lang_docs: int = LANG_DOCS) -> Network | None:
    langs, windows, labels = train_windows(docs, lang_docs)
    return fit(langs, windows, labels) if langs else None


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over the letters of each text; all texts run side by side, BATCH windows at a time."""
    sums = np.zeros((len(texts), len(net.langs)))
    pieces = [cut(raw) for raw in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
    rows = np.concatenate(pieces) if pieces else np.zeros((0, WINDOW), np.uint8)
    for start in range(0, len(rows), BATCH):
        codes = np.ascontiguousarray(rows[start : start + BATCH].T)
        p = net.positions(codes)
        pooled = np.einsum("tnl,tn->nl", p, _LETTER[codes])
        np.add.at(sums, owner[start : start + BATCH], pooled)
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents' own columns with lang_pred and score."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = docs.select(*(f"`{f.name}`" for f in kept)).schema.add("lang_pred", "string").add("score", "double")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, "text")
            lettered = [i for i, raw in enumerate(texts) if net is not None and raw and _has_letter(raw)]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            begin = 0
            while begin < len(lettered):  # runs of texts of some BATCH windows together
                end, size = begin, 0
                while end < len(lettered) and size < BATCH * WINDOW:
                    size += len(texts[lettered[end]])
                    end += 1
                run_of = lettered[begin:end]
                p = document_probabilities(net, [texts[i] for i in run_of])
                for i, row in zip(run_of, p, strict=True):
                    langs[i], scores[i] = net.langs[int(row.argmax())], min(1.0, float(row.max()))
                begin = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=names)
        release_memory()

    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def _has_letter(raw: bytes) -> bool:
    if raw.isascii():
        return any(map(_LETTER.__getitem__, raw[:64])) or any(65 <= (b & 0xDF) <= 90 for b in raw)
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def keep_identified(docs: DataFrame, net: Network | None, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents whose language is told, with their own columns."""
    found = identify(docs, net)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*(f"`{c}`" for c in docs.columns))
