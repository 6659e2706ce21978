"""Secret scans, collocations and fill-in-middle against brute force and on edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import collocations, fim, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=("en",), extra=False):
    rows = [(i, t, langs[i % len(langs)], "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("spans", "n", "form", "output", "phrase", "words", "a", "hash", "rank", "score")}) if extra else df


ODD = [None, "", "   \n\t ", "...", "Été İstanbul Kelvin K ſecret=abcdefgh", "x" * 5000, "same words here", "same words here", "a b c", "日本語 テキスト\x00nul", "😀a😀bb😀"]


# secrets


def brute_spans(text):
    text = text or ""
    found = []
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
    for kind, pattern, fits in (
        ("assign", assign, lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), secret_scan.KINDS.index(kind), kind, m.end()) for m in pattern.finditer(text) if fits(m)]
    width = secret_scan.WINDOW
    for candidate in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(candidate[0]) < width or any(re.search(p, candidate[0]) for p in secret_scan.ALLOWED):
            continue
        for kind, letters, bits in secret_scan.CLASSES:
            hot = set()
            for run in re.finditer(f"[{letters}]+", candidate[0]):
                for i in range(run.start(), run.end() - width + 1):
                    window = candidate[0][i : i + width]
                    entropy = -sum(c / width * math.log2(c / width) for c in collections.Counter(window).values())
                    if entropy >= bits - 1e-9:
                        hot.update((run.start(), j) for j in range(i, i + width))
            for run in {r for r, _ in hot}:
                places = sorted(j for r, j in hot if r == run)
                for first in (j for j in places if j - 1 not in places):
                    last = first
                    while last in places:
                        last += 1
                    found.append((candidate.start() + first, secret_scan.KINDS.index(kind), kind, candidate.start() + last))
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def secret_texts():
    rnd = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(0, 12)):
            make = rnd.randrange(9)
            size = rnd.choice([3, 5, 6, 19, 20, 23, 24, 30, 60])
            if make == 0:
                parts.append("".join(rnd.choice(letters) for _ in range(size)))
            elif make == 1:
                parts.append("".join(rnd.choice("0123456789abcdef") for _ in range(size)))
            elif make == 2:
                parts.append("AKIA" + "".join(rnd.choice("ABCDEF0189") for _ in range(size)))
            elif make == 3:
                word = rnd.choice(["password", "PassWd", "SECRET", "Token", "api_key", "apikey", "aPi_kEy"])
                parts.append(word + rnd.choice(['"', "'", ""]) + rnd.choice([" ", "  ", ""]) + rnd.choice(":=") + rnd.choice([" ", ""]) + rnd.choice(['"', "'", ""]) + "".join(rnd.choice(letters + "_.-=") for _ in range(size)))
            elif make == 4:
                parts.append(rnd.choice(["é", "日本", "😀", "secret=token=abcdef", "secret=token:abcdef", "token="]))
            elif make == 5:
                parts.append("abcdefghijklmnopqrstuvwxyz0123456789")
            elif make == 6:
                parts.append("0f8fad5b-d9cb-469f-a165-70867728950e")
            else:
                parts.append(rnd.choice(["plain", "words", "documentation/of/the/interface"]))
        texts.append(rnd.choice([" ", "", "\n"]).join(parts))
    return texts


def test_secret_spans_match_brute_force(spark):
    texts = secret_texts() + ODD + ["q9Z" * 20_000 + "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(400))]
    rows = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in secret_scan.scan(docs_of(spark, texts, extra=True)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i] == brute_spans(text), text
    assert {kind for r in rows.values() for kind in (s.split(":")[0] for s in r)} == set(secret_scan.KINDS)


def test_secret_windows_are_counted_step_by_step():
    rnd = random.Random(5)
    for _ in range(200):
        run = bytes(rnd.choice(b"abcdefgh0123") for _ in range(rnd.randrange(1, 80)))
        weights = [sum(secret_scan.WEIGHTS[c] for c in collections.Counter(run[i : i + secret_scan.WINDOW]).values()) for i in range(len(run) - secret_scan.WINDOW + 1)]
        most = secret_scan.most_weight(2.9)
        covered = {j for i, w in enumerate(weights) if w <= most for j in range(i, i + secret_scan.WINDOW)}
        assert {j for a, b in secret_scan.hot_spans(run, most) for j in range(a, b)} == covered


def test_secret_allow_list_and_redaction(spark):
    key = "wJalrXUtnFEMI7K9MDENGbPxRfiCY2sZ"
    texts = [f"key {key} end", "sha256-" + key, f"{key}EXAMPLE", "token: abcdef1 and é secret='zyxwvuts9'", None, "clean"]
    spans = {r.doc_id: r.spans for r in secret_scan.scan(docs_of(spark, texts)).collect()}
    assert [s.kind for s in spans[0]] == ["entropy_base64"]
    assert spans[1] == [] and spans[2] == []
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs_of(spark, texts)).collect()}
    assert re.fullmatch(r"key \w{0,12}\[secret\]\w{0,12} end", clean[0])
    assert clean[3] == "[secret] and é [secret]'" and clean[4] is None and clean[5] == "clean"


# collocations


def brute_collocations(rows, least, longest=4, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in candidates.items():
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * b >= 80 * a for b in longer):
            out.append((lang, -score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]], totals[lang]))
    ranks, found = collections.Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            found.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return found


def phrase_texts(seed=4, size=300):
    rnd = random.Random(seed)
    pool = ["new", "York", "city", "the", "of", "a", "Straße", "naïve", "x\x00y", "-", "日本"]
    texts = []
    for _ in range(size):
        parts = []
        for _ in range(rnd.randrange(0, 60)):
            parts.append(rnd.choice(pool) if rnd.random() < 0.8 else rnd.choice(["New york CITY", "the the the the the", "of\ta", "a.b", "stop,", "end!?\n", "tab\t\tbed", "one\x0bpiece\x0cmore\r\n"]))
        texts.append(" ".join(parts))
    return texts


def test_collocations_match_brute_force(spark):
    texts = phrase_texts() + ODD + ["the " * 5000 + "new york city"]
    langs = ["en", None, "de", "und", "en"]
    docs = docs_of(spark, texts, langs, extra=True).repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, least=7, top=40).collect()]
    want = brute_collocations([(langs[i % len(langs)], t) for i, t in enumerate(texts)], 7, top=40)
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got} == {"en", "de", "und"}


def test_collocations_of_a_large_corpus_of_rare_phrases(spark):
    """Occurrences spread thinly: no shard has many of a phrase, all of them together do."""
    rnd = random.Random(8)
    texts = [" ".join(["red", "planet", "rises"] if rnd.random() < 0.3 else rnd.choices("abcdefghijklmnop", k=3)) for _ in range(400)]
    got = [tuple(r) for r in collocations.collocations(docs_of(spark, texts).repartition(40), least=30).collect()]
    assert sorted(got) == sorted(brute_collocations([("en", t) for t in texts], 30))


def test_bitmaps_extend_across_blocks_in_groups(monkeypatch):
    monkeypatch.setattr(collocations, "GROUP_ENTRIES", 7)
    rnd = random.Random(6)
    for _ in range(20):
        ids = np.array([rnd.randrange(0, 6) for _ in range(rnd.randrange(1, 400))], np.int32)
        hashes = np.arange(6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        want = collections.Counter(tuple(ids[i : i + k]) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if 0 not in ids[i : i + k])
        got = collections.Counter()
        for words, _, counts in collocations.Shard(ids, hashes, []).phrases(4):
            for row, n in zip(words.tolist(), counts.tolist(), strict=True):
                assert tuple(row) not in got
                got[tuple(row)] = n
        assert got == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(docs_of(spark, [None, "", " . "])).collect() == []


def test_scores_pass_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 3), ("en", "b", 1, 4 * big)], "lang string, phrase string, words int, a long")
    row = collocations._cuts(counts.where("words = 2"), counts).first()
    assert row.score == 2_000_000 * big // (5 * big + 3)


# fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_match_brute_force_and_come_back(spark):
    rnd = random.Random(13)
    pool = ["a", "Word", " ", "\n", "é", "日", "😀", "\x00", "1", "<", ">", "<P", "P>", "S>", "À̀", "zz", "\U0010ffff", "߿", "￿"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 40))) for _ in range(400)]
    texts += ODD + ["a <M> b", "<P>", "ab" * 100_000, "é" * 50_000, "<" * 300]
    made = fim.fill_in_middle(docs_of(spark, texts, extra=True))
    rows = {r.doc_id: r for r in made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()}
    for i, text in enumerate(texts):
        row = rows[i]
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute_middle(i, text), text[:50]
        assert row.again == (text or "")
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


def test_middles_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "some text here"), (None, "some text here"), (5, "x y z")], "doc_id long, text string")
    rows = fim.fill_in_middle(docs).collect()
    assert len(rows) == 3 and len({r.output for r in rows if r.doc_id is None}) == 1
    assert rows[0].output == brute_middle(None, "some text here")[4]
    assert fim.fill_in_middle(docs.where("false")).collect() == []


@pytest.mark.parametrize("text", ["", "abc", "é", "aé", "éa", " a", "a ", "日a日", "a1b2", "😀"])
def test_every_rank_has_its_place(text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    found = fim.Units(text.encode(), fim.event_automaton())
    assert found.count == len(units)
    for rank in range(len(units) + 1):
        assert text.encode()[: found.place(rank)].decode() == "".join(units[:rank])
