"""The ten operators against brute force and on edge cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat, decontaminate, jaccard, langid, licenses, linededup, quality, queries, sharding, toxicity, trees

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def hash_of(word):
    return xxhash.xxh3_64_intdigest(word)


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("score", "kept", "node", "key", "block", "words", "n_lines", "labels")}) if extra else df


ODD = [None, "", "   \n\t ", "...", "MIT License", "Été İstanbul Kelvin K", "x" * 5000, "same words here", "same words here", "a b c"]


# licences


def brute_places(text):
    words, found = folded(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, found


def test_license_places_match_brute_force(spark):
    rnd = random.Random(2)
    pool = "gnu general public license apache cc by mit under the licensed version 2 0".split()
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 80))) for _ in range(80)]
    texts += ODD + ["Mit-LICENSE, mit\nlicense" * 200, "CC BY-NC 4.0 and cc  by", "license " * 3000 + "mit license"]
    found = {r.doc_id: r for r in licenses.license_summary(docs_of(spark, texts, extra=True)).collect()}
    for i, text in enumerate(texts):
        words, places = brute_places(text)
        row = found[i]
        assert (row.n_words, row.n_base) == (len(words), len(places)), text
        assert row.first_word == (min(p for p, _ in places) if places else None)
        assert row.last_word == (max(p for p, _ in places) if places else None)
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def test_license_notice_survives_a_lost_and_an_added_word(spark):
    texts = ["licensed under the really apache license version 2 0", "Licensed under the GNU General Public License, version 3", "all rights"]
    rows = {r.doc_id: r for r in licenses.license_summary(docs_of(spark, texts)).collect()}
    assert "apache-2.0" in rows[0].labels.split(",") or rows[0].score >= 0.7
    assert rows[1].labels == "gpl,gpl-3"
    assert rows[2].labels == ""


def test_license_empty_table_and_repeated_rows(spark):
    assert licenses.license_summary(docs_of(spark, []).where("false")).count() == 0
    twice = docs_of(spark, ["mit license"]).unionByName(docs_of(spark, ["mit license"]))
    assert [r.n_base for r in licenses.license_summary(twice).collect()] == [1, 1]


# chat


@pytest.mark.parametrize("text", ["", "plain", "\\", "\\\\", "a\\<b", "</turn>", "<turn user>\nx</turn>\n", "\\</turn>", "\\\\</turn>", "ends \\", "<", "</turn", "\r\n\\n", "é" * 1000, r"\### Assistant: </turn> ok"])
@pytest.mark.parametrize("role", ["user", "", "odd>\n<\\role"])
def test_chat_turn_round_trip(role, text):
    rendered, rounds = chat.render_turn(role, text)
    assert chat.parse(rendered) == [(role, text)]
    assert chat.parse(rendered * 3) == [(role, text)] * 3
    assert rounds in (0, 1)


def test_chat_random_round_trip():
    rnd = random.Random(4)
    parts = ["\\", "<", ">", "/", "turn", "</turn>", "<turn ", "\n", "x", " "]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        assert chat.parse(chat.render_turn("u", text)[0]) == [("u", text)]


def test_chat_parser_refuses_what_is_not_the_grammar():
    for bad in ("x", "<turn user>\nx", "<turn user>x</turn>\n", "<turn a>\n<turn b></turn>\n"):
        assert chat.parse(bad) is None


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "two </turn>"), (1, 0, "user", "one"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\none\nassistant\ntwo </turn>\nassistant\n\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (11, sha("two </turn>"))
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("")
    assert got[None].n_turns == 1
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_chat_offsets_point_at_the_loss(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "bcd"), (1, 2, "assistant", "e")]
    got = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    whole = "".join(r.segment for r in got)
    assert [whole[r.loss_start : r.loss_end] for r in got if r.loss_start is not None] == ["bcd", "e"]


def common_in_order(one, two):
    """Length of the longest common subsequence."""
    row = [0] * (len(two) + 1)
    for x in one:
        last = 0
        for j, y in enumerate(two):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_license_spans_are_verified_in_order(spark):
    rnd = random.Random(3)
    texts, want = [], []
    for label, notice in licenses.NOTICES:
        words = notice.split()
        foreign = lambda n: [f"f{rnd.randrange(999)}" for _ in range(n)]
        scattered = [w for i in range(len(words) - 1) for w in [words[i], words[i + 1], *foreign(2)]]
        backwards = [w for i in reversed(range(0, len(words) - 1, 2)) for w in words[i : i + 2]]
        longer = [*words[: len(words) // 2], *foreign(1), *words[len(words) // 2 :]]
        texts += [" ".join(foreign(20) + x + foreign(20)) for x in (words, scattered, backwards, longer)]
        want += [(label, True), (label, False), (label, False), (label, len(words) > 5)]
    spans = licenses.scan_licenses(docs_of(spark, texts)).where("label IS NOT NULL AND NOT exact").collect()
    found = {(r.doc_id, r.label) for r in spans}
    for i, (label, there) in enumerate(want):
        assert ((i, label) in found) == there, (i, label, there)
    notices = collections.defaultdict(list)
    for label, notice in licenses.NOTICES:
        notices[label].append(notice.split())
    for r in spans:  # every span holds its notice in order, by another measure
        words = folded(texts[r.doc_id])[r.start : r.end]
        assert any(common_in_order(words, n) >= 0.8 * len(n) - 1 and len(words) <= len(n) + licenses.SLACK for n in notices[r.label]), (r, words)



# sharding


def test_shards_keep_every_row_and_versions(spark, tmp_path):
    texts = ["t" * (i * 37 % 900) for i in range(700)]
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "t", "en", "s", 1)], DOCS)
    docs = docs_of(spark, texts).unionByName(odd).withColumns({c: F.lit(f"own {c}") for c in ("run", "_shard", "shard", "arrival", "part", "parts", "old", "folder")})
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    assert store.append(docs) == 1
    late = docs.where("doc_id = 0").withColumn("doc_id", F.lit(10_000).cast("long"))
    assert store.append(late) == 2
    small = store.manifest().count()
    assert store.compact(target_bytes=1_000_000) == 3
    assert store.versions() == [1, 2, 3]
    assert store.manifest().count() < small
    rows = store.rows()
    assert rows.columns == docs.columns and rows.count() == len(texts) + 3
    assert rows.exceptAll(docs).count() == 1 and docs.exceptAll(rows).count() == 0
    assert store.rows(store.manifest(1)).exceptAll(docs).count() == 0  # an old version stays readable
    before = {(r.shard, r.folder) for r in store.manifest().collect()}
    assert store.compact(target_bytes=1_000_000) == 3  # nothing to merge: nothing is written
    assert store.append(late) == 4 and before < {(r.shard, r.folder) for r in store.manifest().collect()}
    assert store.rows(shard="its").select("its").distinct().count() == store.manifest().count()
    with pytest.raises(ValueError):
        store.rows(shard="Run")


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    docs = docs_of(spark, ["a", "b"])
    one, two = (sharding.ShardStore(spark, str(tmp_path / "r")) for _ in range(2))
    one.append(docs)
    added = one.manifest()
    two.commit(added, 2, docs.schema)  # both have read version 1
    with pytest.raises(RuntimeError):
        one.commit(added.where("false"), 2, docs.schema)
    assert one.versions() == [1, 2] and one.rows().count() == 2


def test_full_shards_stay_and_common_arrivals_are_split(spark, tmp_path):
    docs = docs_of(spark, ["x" * 1000] * 300).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    store = sharding.ShardStore(spark, str(tmp_path / "f"))
    store.append(docs, target_bytes=20_000)
    sizes = [r.n_bytes for r in store.manifest().collect()]
    assert len(sizes) > 10 and max(sizes) < 40_000 and sum(sizes) == 300_000
    full = {r.folder + str(r.shard) for r in store.manifest().where("n_bytes >= 10000").collect()}
    store.compact(target_bytes=20_000)
    assert full <= {r.folder + str(r.shard) for r in store.manifest().collect()}
    assert store.rows().exceptAll(docs).count() == 0 and store.rows().count() == 300


def test_shard_tiers(spark):
    sizes = [0, 65_536, 65_537, 65_536 * 4, 65_536 * 4 + 1]
    df = spark.createDataFrame([(s,) for s in sizes], "n long")
    assert [r[0] for r in df.orderBy("n").select(sharding.tier_of(F.col("n"))).collect()] == [0, 0, 1, 1, 2]


def test_sharding_empty_table(spark, tmp_path):
    docs = docs_of(spark, ["x"]).where("false")
    store = sharding.ShardStore(spark, str(tmp_path / "e"))
    store.append(docs)
    assert store.manifest().count() == 0 and store.compact() == 1
    assert store.rows().columns == docs.columns and store.rows().count() == 0
    assert store.append(docs_of(spark, ["x"])) == 2 and store.rows().count() == 1


# decontamination


def brute_contamination(texts, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = folded(text)
        n = min(len(words), 10)
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i : i + n])].add(item)
    out = {}
    for i, text in enumerate(texts):
        words, hit, found = folded(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(words) - n + 1):
                w = tuple(words[s : s + n])
                if w in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[w]
        out[i] = (len(words), len(hit), sorted(str(x) for x in found if x is not None))
    return out


@pytest.mark.parametrize("most", [400_000, 0])
def test_decontamination_matches_brute_force(spark, most):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 9, 10, 11, 30])))) for i in range(25)] + [(99, None), (98, "!!"), (None, "zz yy xx ww vv uu tt ss rr qq pp")]
    texts = list(ODD)
    for _ in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            piece = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(len(piece) + 1)
            at = rnd.randrange(len(words) + 1)
            words[at:at] = piece[a : a + rnd.randrange(15)]
        texts.append(" ".join(words).upper())
    texts.append("zz yy xx ww vv uu tt ss rr qq pp")
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.decontaminate(docs_of(spark, texts, extra=True), benchmark, most).collect()}
    assert got == brute_contamination(texts, items)


def test_decontamination_keeps_clean_rows_and_columns(spark):
    passage = " ".join(f"q{i}" for i in range(12))
    docs = docs_of(spark, [f"a b {passage} c", "clean text", None, "clean text"], extra=True)
    kept = decontaminate.clean_documents(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns
    assert decontaminate.clean_documents(docs, spark.createDataFrame([], "item_id long, text string")).count() == 4


def test_fingerprints_of_a_large_batch_leave_in_bounded_pieces(spark, monkeypatch):
    released = []
    monkeypatch.setattr(decontaminate, "release_memory", lambda: released.append(1), raising=False)
    docs = docs_of(spark, ["a"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = decontaminate.document_fingerprints(docs, [1])
    texts = [None, "", *(" ".join(f"v{(i * j) % 997}" for j in range(300)) for i in range(400)), "lone"]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(range(n)), pa.array(texts, pa.string())], names=["row_id", "doc_id", "digest", "text"])
    whole, single = pa.Table.from_batches(list(run(iter([batch])))), [pa.Table.from_batches(list(run(iter([batch.slice(i, 1)])))) for i in range(n)]
    assert whole.sort_by([("row_id", "ascending"), ("pos", "ascending"), ("fp", "ascending")]).equals(pa.concat_tables(single).sort_by([("row_id", "ascending"), ("pos", "ascending"), ("fp", "ascending")]))
    assert max(len(b) for b in run(iter([batch]))) <= 16_384 < len(whole) // 4
    assert released


# language


def test_language_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.initial(["a", "b"])
    codes = rng.integers(97, 123, (12, 5)).astype(np.uint8)
    weights = np.full((12, 5), 1 / 60)
    labels = np.array([0, 1, 0, 1, 1])
    _, grads = langid.gradients(net, codes, labels, weights)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, values = p[at], []
        for e in (1e-2, -1e-2):
            p[at] = old + e
            values.append(langid.gradients(net, codes, labels, weights)[0])
        p[at] = old
        assert g[at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=2e-2)


def test_language_learns_and_marks_letterless_texts(spark):
    rnd = random.Random(1)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(40))
    rows = [(i, make("abcdefg") if i % 2 else make("tuvwxyz"), "aa" if i % 2 else "zz", "s", 1) for i in range(240)]
    rows += [(900, None, None, None, None), (901, "12 34 ...", "aa", "s", 1), (902, "", "zz", "s", 1), (903, make("abcdefg") * 300, None, "s", 1), (None, make("tuvwxyz"), None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    got = langid.identify(docs, langid.train(docs)).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "aa" and by[None].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.train(docs.where("false")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and kept.count() == 242


# tokens


def test_tokens_equal_the_library(spark):
    path = queries.tokenizer_path()
    tokenizer = bpe.load_tokenizer(path)
    texts = ODD + ["It's THEY're 12３4 ﬁ ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "\x1c\x1d a\x85b", "日本語 テスト 😀😀", "e ́x", "the the the", " ".join(f"word{i % 700}x{i}" for i in range(20_000))]
    docs = docs_of(spark, texts, extra=True)
    for block_bytes in (10**9, 60_000):
        got = {r.doc_id: r for r in bpe.encode_documents(docs, path, block_bytes).collect()}
        for i, text in enumerate(texts):
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids
            assert (got[i].ids, got[i].decoded) == (ids, tokenizer.decode(ids, skip_special_tokens=False)), text
    digests = {r.doc_id: r for r in bpe.digest_documents(docs, path).collect()}
    assert digests[7].ids_sha256 == digests[8].ids_sha256 and digests[0].n_tokens == 0
    assert bpe.encode_documents(docs.where("false"), path).count() == 0


# lines


def test_recurring_templates_go_and_fields_vary(spark):
    own = lambda i: f"only{chr(97 + i)} this document has such words{chr(97 + i)} in it"
    texts = [f"{own(i)}\nPosted on 2024-0{i} by user{i} in news today\n\nshort line" for i in range(8)]
    texts += [None, "", "\n\n", own(1) + "\n" + "long " * 20_000]
    docs = docs_of(spark, texts, extra=True)
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs).collect()}
    assert got[0].text == texts[0] and got[0].n_dropped == 0  # the first document keeps its line
    for i in range(1, 8):
        assert got[i].text == f"{own(i)}\n\nshort line" and got[i].n_dropped == 1
    assert got[8].text is None and got[8].n_lines == 0 and got[9].text == "" and got[10].text == "\n\n"
    assert got[11].text == texts[11]
    assert linededup.without_recurring_lines(docs).columns == docs.columns
    clash = docs.withColumns({c: F.lit("own") for c in ("_gone", "_doc", "_digest", "gone", "Doc", "digest", "line_no", "template")})
    kept = linededup.drop_recurring_lines(clash)
    assert {r.gone + r.Doc + r.digest for r in kept.collect()} == {"own" * 3} and kept.where("n_dropped > 0").count() == 7
    assert linededup.drop_recurring_lines(docs.where("false")).count() == 0


def brute_dropped(texts):
    """The rule of line dedup by plain loops: line numbers that each text loses."""
    enough = lambda n: 2 if n > 50 else 5
    lines = []
    for doc, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            tokens = [t for t in line.split(" ") if t]
            if len(tokens) >= 4:
                lines.append((doc, number, tokens, tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)))
    leaf_of = lambda shape: (len(shape), shape[:3])
    leaves = collections.defaultdict(set)
    for doc, _, _, shape in lines:
        leaves[leaf_of(shape)].add(texts[doc])
    shapes = collections.defaultdict(set)
    for doc, _, _, shape in lines:
        if len(leaves[leaf_of(shape)]) >= enough(len(shape)):
            shapes[shape].add(texts[doc])
    support = collections.Counter()
    for shape, its in shapes.items():
        for at in enumerate(shape):
            support[leaf_of(shape), at] += len(its)
    sets, set_of = collections.Counter(), {}
    for shape, its in shapes.items():
        marks = frozenset(at for at in enumerate(shape) if at[1] != "<*>" and support[leaf_of(shape), at] >= enough(len(shape)))
        if len(marks) >= 0.7 * len(shape):
            set_of[shape] = (leaf_of(shape), marks)
            sets[set_of[shape]] += len(its)
    template_of = {}
    for leaf in {one[0] for one in sets}:
        left = {one: n for one, n in sets.items() if one[0] == leaf}
        while left and sum(left.values()) >= enough(leaf[0]):
            best = max(left, key=lambda one: (left[one], len(one[1])))
            taken = [one for one in left if len(one[1] & best[1]) >= 0.7 * leaf[0]]
            for one in taken:
                template_of[one] = best
                del left[one]
    own = {}
    members = collections.defaultdict(set)
    for doc, number, _, shape in lines:
        if shape in set_of and set_of[shape] in template_of:
            own[doc, number] = template_of[set_of[shape]]
            members[own[doc, number]].add(texts[doc])
    recurring = {one: len(its) for one, its in members.items() if len(its) >= enough(one[0][0])}
    placed = {}
    for doc, number, tokens, _ in lines:
        if own.get((doc, number)) in recurring:
            placed[doc, number] = own[doc, number]
            continue
        agree = [one for one in recurring if one[0][0] == len(tokens) and sum(tokens[p] == t for p, t in one[1]) >= 0.7 * len(tokens)]
        if agree:
            placed[doc, number] = max(agree, key=lambda one: recurring[one])
    first = {}
    for (doc, _), one in placed.items():
        first[one] = min(doc, first.get(one, doc))
    gone = collections.defaultdict(set)
    for (doc, number), one in placed.items():
        if doc != first[one]:
            gone[doc].add(number)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_dropped_lines_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (4, 6, 10, 14, 30, 50, 51, 70)]
    texts = []
    for i in range(70):
        lines = [" ".join(word() for _ in range(12))]
        for _ in range(rnd.randrange(4)):
            line = list(rnd.choice(passages))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                line[rnd.randrange(len(line))] = rnd.choice([word(), f"x{i}"])
            lines.insert(rnd.randrange(len(lines) + 1), " ".join(line))
        texts.append("\n".join(lines))
    texts += [texts[3], None, ""]
    gone = brute_dropped(texts)
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[i])
        assert (got[i].n_dropped, got[i].text) == (len(gone[i]), kept), i
    assert sum(map(len, gone.values())) > 40


def test_many_templates_of_a_leaf_take_few_rounds(spark, monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    lines = [" ".join(["posted", "in", "news", *(word() for _ in range(9))]) for _ in range(200)]
    texts = [f"own{i} text\n{line}" for i, line in enumerate(lines * 5)]
    rounds = []
    settled = linededup.settled
    monkeypatch.setattr(linededup, "settled", lambda df, label, **o: rounds.append(label) or settled(df, label, **o))
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got == {i: int(i >= 200) for i in range(1000)}
    assert rounds.count("round") <= 3


def test_few_sets_of_a_leaf_take_no_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    # a chain: each line agrees with the next one on 8 of 12 tokens, and the first one has most texts
    words = [word() for _ in range(60)]
    lines = [["posted", "in", "news", *words[i : i + 9]] for i in range(0, 20, 2)]
    lines = [" ".join([*x[:3], *(x[3 + (k - i) % 9] for k in range(9))]) for i, x in enumerate(lines)]
    texts = [f"own{i}x{k} text\n{line}" for i, line in enumerate(lines) for k in range(16 - i)]
    settled, labels = linededup.settled, []
    monkeypatch.setattr(linededup, "settled", lambda df, label, **o: labels.append(label) or settled(df, label, **o))
    dropped = lambda: {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    got = dropped()
    assert labels.count("leaders") == labels.count("round") == 1
    assert {i for i, n in got.items() if n} == {i for i, n in brute_dropped(texts).items() if n}
    monkeypatch.setattr(linededup, "FOLDED_SETS", 0)
    monkeypatch.setattr(linededup, "GATHERED_SHAPES", 0)
    assert dropped() == got and labels.count("leaders") > 2


def test_only_lines_with_known_leading_tokens_are_split(spark):
    lines = ["a b c d", "  a   b c d", "a b c  d e", "a b1 c d", "a b22 c  d", "a b x d", "a b c", "a b c ", " a b c", "", "a\tb c d"]
    docs = docs_of(spark, lines)
    every = linededup.document_lines(docs).withColumn("lead", linededup.lead_of_tokens(F.col("tokens")))
    leads = every.where("doc_id IN (0, 3)").select("lead").distinct()
    got = {r.doc_id: r for r in linededup.document_lines(docs, mask=True, leads=leads).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10}
    assert got[3].tokens == got[4].tokens == ["a", "<*>", "c", "d"] and got[1].tokens == ["a", "b", "c", "d"]
    assert {i: r.leaf for i, r in got.items()} == {r.doc_id: r.leaf for r in every.collect() if r.doc_id in got}


def test_tabs_part_the_tokens_of_a_line(spark):
    texts = [f"own{i} words\nHome\tNews\tContact\tAbout" for i in range(20)]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert [got[i].n_dropped for i in range(20)] == [0] + [1] * 19
    assert got[0].text == texts[0] and got[1].text == "own1 words"


def test_copies_of_a_text_are_not_boilerplate(spark):
    texts = ["a whole text that is copied many times over"] * 9
    assert {r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()} == {0}


def test_words_edited_at_different_positions_share_a_template(spark, monkeypatch):
    passage = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    edited = [" ".join([*passage[:i], f"other{chr(97 + i % 26)}{chr(97 + i // 26)}", *passage[i + 1 :]]) for i in range(40)]
    posted = [f"Posted by {who} in news" for who in ["admin"] * 6 + ["bob", "eve"]]
    texts = [f"own{i} start\n{line}" for i, line in enumerate(edited + posted)]
    texts += ["x\nPosted at noon for sale", "y\n" + " ".join(passage[:30] + [f"z{w}" for w in passage[30:]])]
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert {i for i, n in got.items() if not n} == {0, 40, 48, 49}
    # the same where runs and templates are too many to broadcast
    with monkeypatch.context() as patch:
        patch.setattr(linededup, "BROADCAST_RUNS", 0)
        patch.setattr(linededup, "BROADCAST_TEMPLATES", 0)
        assert {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()} == got


def test_runs_of_templates_are_broadcast_in_buckets(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passages = [[word() for _ in range(60)] for _ in range(100)]
    lines = [" ".join([*p[:40], word(), *p[41:]]) for p in passages for _ in range(2)]
    lines += [" ".join([word(), *p[1:]]) for p in passages]  # another leaf
    texts = [f"own{i} start\n{line}" for i, line in enumerate(lines)]
    sent = []
    broadcast = F.broadcast
    monkeypatch.setattr(linededup.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert got == {i: int(i >= 200 or i % 2) for i in range(300)}
    assert max(sent) < 400  # of some 1,800 runs


def test_long_passages_recur_from_two_texts(spark):
    line = lambda n, k: " ".join(f"{k}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
    long, short = line(51, "l"), line(50, "s")
    texts = [f"own{i}\n{x}" for i, x in enumerate([long, short, long.replace("lbb", "edited"), *[short] * 3, line(51, "n")])]
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_of(spark, texts)).collect()}
    assert {i for i, n in got.items() if n} == {2}


# toxicity


def test_toxicity_finds_words_and_sentences(spark):
    rnd = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        said = [[rnd.choice(vocabulary) for _ in range(8)] for _ in range(rnd.randrange(1, 12))]
        toxic = int(i % 4 == 0)
        if toxic:
            said[rnd.randrange(len(said))].append(rnd.choice(["vile", "foul"]))
        rows.append((i, ". ".join(map(" ".join, said)), "en", "s", 1))
        labels.append((i, 1, toxic))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "word1 VILE word2. fine words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [i for i in range(400) if crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    assert got[902].predicted == 1 and got[902].worst_sentence == 0
    assert got[900].predicted == got[901].predicted == 0 and all(got[i].held_out for i in held)
    none = toxicity.toxicity(docs, marks.where("false")).collect()
    assert {r.predicted for r in none} == {0} and all(0 <= r.score <= 1 for r in none)


# quality


def brute_counts(text):
    words = spaced(text)
    places = collections.defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_quality_counts_match_brute_force(spark):
    rnd = random.Random(6)
    texts = ODD + ["".join(rnd.choice(["a ", "b ", "é ", "\n", "## ", "c\t"]) for _ in range(rnd.randrange(200))) for _ in range(60)]
    got = {r.doc_id: r for r in quality.document_statistics(docs_of(spark, texts, extra=True)).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in quality.COUNTS[:5]) == brute_counts(text), text


def test_quality_without_labels_keeps_what_passes_the_base(spark):
    good = " ".join(f"w{i}" for i in range(80))
    got = {r.doc_id: r for r in quality.quality_rules(docs_of(spark, [good, None, "a b c " * 40]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert (got[0].kept, got[1].kept, got[2].kept) == (True, False, False)
    assert got[1].base_failed and got[2].base_failed


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 2))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.1)).astype(float)
    forest = trees.fit(x, y, np.array([-1, 0]))
    assert np.mean((forest.score(x) > 0.5) == y) > 0.85
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3)])
    assert (np.diff(forest.score(line)) <= 1e-12).all()
    assert trees.fit(np.zeros((0, 2)), np.zeros(0), np.array([-1, 0])).score(x).shape == (3000,)


# near duplicates


def brute_components(texts):
    sets = {}
    for i, text in enumerate(texts):
        words = spaced(fold(text))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rounds", [3, 1, 0])
def test_components_match_brute_force(spark, rounds, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", rounds)
    rnd = random.Random(7 + rounds)
    vocabulary = [f"w{k}" for k in range(2000)]
    texts = list(ODD)
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 6, 9, 14, 20, 40, 150]))]
        for _ in range(rnd.choice([1, 3, 8])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, max(1, len(words) // 50)])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    passage = " ".join(rnd.choice(vocabulary) for _ in range(50))
    texts += [f"{passage} {' '.join(rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 30)))}" for _ in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts, extra=True)).collect()}
    assert got == brute_components(texts)


def test_components_of_copies_about_the_threshold(spark):
    """Copies of one text with one to four other words lie on both sides of the threshold; a text of 30,000 words stands beside them."""
    rnd = random.Random(31)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(70)]
    texts = []
    for i in range(160):
        words = list(base)
        for _ in range(1 + i % 4):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words[: rnd.choice([70, 70, 66, 62])]))
    long = [rnd.choice(vocabulary) for _ in range(30_000)]
    texts += [" ".join(long), " ".join([*long[:29_000], "tail"]), " ".join(long[:20_000])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    want = brute_components(texts)
    assert got == want and len(set(c for _, c in want.values())) > 10


def test_first_of_each_keeps_columns_and_clean_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = docs_of(spark, [text, text, text + " tail", "another text with some words", None, ""], extra=True)
    kept = jaccard.first_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5] and kept.columns == docs.columns
    assert jaccard.first_of_each(docs.where("false")).count() == 0


def test_pigeonhole_bands():
    first, differ, spare, segments = jaccard._bands(80)
    for band in range(20):
        low, high = first[band], first[band + 1] - 1
        for small in {low, high}:
            for large in {small, small * 100 // 80}:
                common = -(-80 * (small + large) // 180)
                assert small + large - 2 * common <= differ[band]
        if differ[band] > jaccard.SMALL:
            assert segments[band] - differ[band] == spare[band] + 1


# samples


def test_training_samples_are_bounded_with_repeated_ids(spark):
    texts = [f"some text of number {i} with words. and a sentence" for i in range(600)]
    docs = docs_of(spark, texts)
    same = docs.where("doc_id = 1").crossJoin(spark.range(3000)).drop("id")
    docs = docs.unionByName(same)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    ids = docs.where("doc_id % 4 <> 9").select("doc_id", "lang")
    from tidewell.llm import sampling

    chosen = sampling.lowest_hashes(ids, 200)
    assert chosen.count() == chosen.select("doc_id").distinct().count() == 200
    assert sampling.rows_of(docs.select("doc_id", "text"), chosen).count() == 200
    assert sorted(r[0] for r in sampling.lowest_hashes(ids, 10).collect()) == sorted(r[0] for r in ids.distinct().orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(10).collect())
    _, windows, _ = langid.train_windows(docs, 200)
    assert 0 < len(windows) <= 200 * langid.TRAIN_CUTS
    words, _, y = toxicity.train_bags(docs, labels)
    assert len(words) == len(y) <= 600


def test_noisy_or_and_pooled_probabilities_by_scalar_loops(spark):
    """The document scores of the two trained text models against plain loops over their parameters."""
    texts = ["A bad word here. Nothing there! bad", "clean", "", None, "one. two. three bad bad. worse"]
    vocabulary = np.sort(np.array([hash_of(w) for w in (b"bad", b"worse", b"clean")], np.uint64))
    model = toxicity.MilModel(vocabulary, np.array([1.5, -0.5, 2.5]), -2.0)
    weight = dict(zip(vocabulary.tolist(), [1.5, -0.5, 2.5], strict=True))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        parts = [folded(p) for p in re.split(r"[.!?\n]", text or "")]
        parts = [p for p in parts if p] or [[]]
        none = 1.0
        for part in parts:
            features = {f for w in set(part) for f in toxicity.word_features(w.encode())}
            logit = -2.0 + sum(weight.get(hash_of(f), 0.0) for w in set(part) for f in toxicity.word_features(w.encode()))
            none *= 1 - 1 / (1 + np.exp(-logit))
            assert features or not part
        assert abs(got[i].score - (1 - none)) < 1e-6 and got[i].n_sentences == len(parts), (i, text)
    net = langid.initial(["a", "b", "c"])
    raw = ("Straße und Wörter, x1 " * 12).encode()
    sums = np.zeros(3)
    for start in range(0, len(raw), langid.WINDOW):
        piece = raw[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        states = []
        for side in (0, 1):
            h, found = np.zeros(langid.HIDDEN), {}
            for t in range(langid.WINDOW) if side == 0 else reversed(range(langid.WINDOW)):
                x = net.table[side][piece[t]].astype(float)
                z, r = (1 / (1 + np.exp(-(x[k * langid.HIDDEN : (k + 1) * langid.HIDDEN] + h @ net.gates[side][:, k * langid.HIDDEN : (k + 1) * langid.HIDDEN]))) for k in (0, 1))
                h = h + z * (np.tanh(x[2 * langid.HIDDEN :] + (r * h) @ net.candidate[side]) - h)
                found[t] = h
            states.append(found)
        for t in range(langid.WINDOW):
            if piece[t] >= 128 or chr(piece[t]).isalpha():
                e = np.exp(np.concatenate([states[0][t], states[1][t]]) @ net.out + net.bias)
                sums += e / e.sum()
    assert np.allclose(langid.document_probabilities(net, [raw])[0], sums / sums.sum(), atol=1e-5)


# registered queries


def test_registered_queries_return_their_columns(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    want = {
        "op1_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
        "op4_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op9_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    }
    for name, columns in want.items():
        found = queries.QUERIES[name](spark, SF)
        assert columns <= set(found.columns) and found.count() == n
