"""N-gram Jaccard join by a universe partition and the pigeonhole principle.

A document's set holds its distinct word shingles.  Equal sets share a node;
everything below works on distinct sets.

Sizes fall into bands so that two linked sets lie in one band or in two next to
each other; a set takes part in the scheme of its own band and in that of the
band below.  In a scheme, linked sets differ in at most H shingles.  The
shingle universe is hashed into segments:

* bands of more than SMALL differences have H + 1 + z segments, so linked sets
  agree in at least z + 1 of them.  Of its segment keys, each set may leave out
  the z that cost most, that is those that most sets have (value 0), and still
  shares a key with every set that it links with (value 1): keys are ordered by
  their counts, and two sets with z + 1 common keys have one outside the z most
  frequent of either.  Empty segments and passages that many texts share go
  first; a set with at most z common keys is out at once.
* small bands have half as many segments, of value 2: a set is indexed under
  each whole segment and under each segment less one shingle, so segments that
  differ in one shingle meet.

The sets that still share a key with another one are the survivors; most sets
have no near neighbour and end here.  For survivors the segments are split down
to single shingles, and costs are counted again among them: linked sets of n1
and n2 shingles have a = ceil(0.8 (n1 + n2) / 1.8) in common, so each of them
may leave out its a - 1 costliest shingles, and the rest still share one.  A
copy whose own changes fill that rest meets nobody, however many copies there
are of the text that it was made from.

Sets that share such a key are candidates.  Keys with the same members are taken
once.  In each round, a key's members are verified exactly against one pivot;
what links is merged, and a key whose members are in one component is done: no
group is expanded into its pairs.  After the pivot rounds, the pairs left in
keys with several components are verified one by one, but only where both sets
hold the key outside the a - 1 costliest for their two sizes, as they must in
the rarest key that they share.  That makes the result exact.

Shingles are compared as 64-bit hashes, and a set's node is a 64-bit hash.
Defined results: null, empty or wordless texts have no set and link with
nothing, not even each other; a text of fewer words than a shingle has one
shingle; repeated rows are equal sets; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.words import WordHashes, binary_column, mix64, rolling, spaced_words
from tidewell.llm.workspace import release_memory, settled

SHINGLE = 5
#: Linked: 100 * intersection >= 80 * union.
PERCENT = 80
#: Bands with at most so many differences use one-deletion neighbourhoods.
SMALL = 3
#: Sets that a task remembers, so that copies next to each other give their keys once.
SEEN_NODES = 50_000
#: Rounds with a pivot for each key before the pairs that are left.
PIVOT_ROUNDS = 2


def _bands(percent: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """First size of each band, most differences H, spare segments z, segments m."""
    first, differ, spare, segments = [1], [], [], []
    while first[-1] < 2**31:
        nxt = first[-1] * 100 // percent + 1
        small = nxt - 1
        both = small + small * 100 // percent
        h = both * (100 - percent) // (100 + percent)
        z = 0 if h <= SMALL else max(2, ceil(h / 4))
        first.append(nxt)
        differ.append(h)
        spare.append(z)
        segments.append(-(-(h + 1) // 2) if h <= SMALL else h + 1 + z)
    return first, differ, spare, segments


def shingle_set(raw: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = hashes.of(spaced_words(raw.lower() if raw else raw))  # bytes: lower-cases A-Z only
    if 0 < len(words) < SHINGLE:
        return rolling(words, len(words)) + np.uint64(len(words))
    return np.unique(rolling(words, SHINGLE))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def segment_keys(shingles: np.ndarray, band: int, table) -> np.ndarray:
    """The keys of a set in the scheme of a band."""
    _, differ, _, segments = table
    m = segments[band]
    tokens = mix64(shingles + np.uint64(0x51ED2701))
    place = ((tokens >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
    low = np.bincount(place, (tokens & np.uint64(0xFFFFFFFF)).astype(float), m).astype(np.uint64)
    high = np.bincount(place, (tokens >> np.uint64(32)).astype(float), m).astype(np.uint64)
    sums = (high << np.uint64(32)) + low
    salt = mix64(np.arange(m, dtype=np.uint64) + (np.uint64(band + 1) << np.uint64(40)))
    keys = mix64(sums ^ salt)
    if differ[band] <= SMALL:
        keys = np.unique(np.concatenate([keys, mix64((sums[place] - tokens) ^ salt[place])]))
    return keys


def set_nodes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, node, n_shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(raw, hashes) for raw in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "node", "n_shingles"],
            )
        del hashes
        release_memory()

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, node long, n_shingles long")


def node_keys(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """key, node, band: all keys of all sets (an equal set may come again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bands(percent)
        first, differ = np.array(table[0]), table[1]
        hashes, seen = WordHashes(), set()
        for batch in batches:
            keys, nodes, bands = [], [], []
            for raw in binary_column(batch, "text"):
                shingles = shingle_set(raw, hashes)
                node = node_of(shingles)
                if not len(shingles) or node in seen:
                    continue
                if len(seen) >= SEEN_NODES:
                    seen.clear()  # a set that comes again is made distinct below
                seen.add(node)
                own = int(np.searchsorted(first, len(shingles), "right")) - 1
                for band in (own, own - 1):
                    if band >= 0 and differ[band]:  # linked sets of a band without differences are equal
                        found = segment_keys(shingles, band, table)
                        keys.append(found)
                        nodes.append(np.full(len(found), node))
                        bands.append(np.full(len(found), band, np.int16))
            if keys:
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(bands))],
                    names=["key", "node", "band"],
                )
                for start in range(0, len(whole), 65_536):
                    yield whole.slice(start, 65_536)
        del hashes, seen
        release_memory()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, node long, band short")


def survivors(keys: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node: the sets that share a key, after every set has dropped the keys that cost most."""
    _, _, spare, _ = _bands(percent)
    dealt = keys.where("key IS NOT NULL AND band IS NOT NULL").repartition("key")
    # reads all columns, so that this and the join below share one exchange
    shared = dealt.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("cost"), F.max("band").alias("any_band")
    )
    shared = shared.where("low <> high AND any_band IS NOT NULL").select("key", "cost")
    z = F.element_at(F.array(*(F.lit(x) for x in spare)), F.col("band").cast("int") + 1)
    dear = Window.partitionBy("node", "band").orderBy(F.desc("cost"), "key")
    left = (
        dealt.join(shared, "key")
        .distinct()
        .withColumn("place", F.row_number().over(dear))
        .where(F.col("place") > z)
        .select("key", "node")
    )
    left = settled(left, "keys")
    met = left.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    return settled(left.join(met.select("key"), "key", "left_semi").select("node").distinct(), "survivors")


def candidate_groups(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, node, n, place: the members of each key that is left of the sets' single shingles.

    place counts a set's shingles from the costliest one; a set keeps those from
    the place ceil(percent * n / 100) on, which is the least that linked sets
    have in common with it.  Keys with the same members are one key, at the
    highest place that each of them has there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.full(len(keys), node)), pa.array(np.full(len(keys), len(keys), np.int32))], names=["key", "node", "n"]
                )
        release_memory()

    dealt = sets.select("node", "shingles").mapInArrow(run, "key long, node long, n int").where("key IS NOT NULL").repartition("key")
    shared = dealt.groupBy("key").agg(F.count("node").alias("cost"), F.max("n").alias("most")).where("cost > 1 AND most > 0").select("key", "cost")
    dear = Window.partitionBy("node").orderBy(F.desc("cost"), "key")
    left = dealt.join(shared, "key").withColumn("place", F.row_number().over(dear)).where(F.col("place") * 100 >= F.col("n") * percent)
    left = settled(left.select("key", "node", "n", "place"), "places")
    scrambled = F.xxhash64("node")
    members = left.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(scrambled).alias("mark"), F.bit_xor(F.xxhash64(scrambled, F.lit(1))).alias("mark2"))
    # groups that two marks can't tell apart become one group, which only compares more
    one = left.join(members.where("members > 1"), "key").withColumn("key", F.xxhash64("mark", "mark2"))
    groups = one.groupBy("key", "node").agg(F.max("n").alias("n"), F.max("place").alias("place"))
    # a set that is too far up its key for even the key's smallest set links with nobody there
    least = groups.groupBy("key").agg(F.min("n").alias("least"))
    return settled(groups.join(least, "key").where(_may_link(F.col("n"), F.col("place"), F.col("least"), F.col("place"), percent)).drop("least"), "groups")


def member_sets(docs: DataFrame, nodes: DataFrame, wanted_nodes: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """node, shingles (sorted, packed) of the wanted sets, from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(raw, hashes) for raw in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]
            )
        del hashes
        release_memory()

    wanted = (
        nodes.where("doc_id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(wanted_nodes, "node", "left_semi")
    )
    unnamed = nodes.where("doc_id IS NULL").select("node").join(wanted_nodes, "node", "left_semi").limit(1).count()
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kept = source.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    if unnamed:
        kept = kept.unionByName(source.where("doc_id IS NULL"))
    made = kept.select("text").mapInArrow(run, "node long, shingles binary")
    return settled(made.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "sets")


def compared(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b), compared shingle by shingle: linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "one", "two"))
            linked = []
            for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int(np.count_nonzero(x[at] == y))
                union = len(x) + len(y) - common
                linked.append(100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
        release_memory()

    joined = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "one"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "shingles": "two"}), "b"
    )
    return joined.select("a", "b", "one", "two").mapInArrow(run, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of an edge reaches.  Least neighbour's label and pointer jumping in turns."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("met"))
        jumped = met.join(labels.select(F.col("node").alias("met"), F.col("label").alias("jump")), "met")
        moved = settled(jumped.select("node", "old", F.least("met", "jump").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("old <> label").limit(1).count():
            return labels


def _with_component(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return groups.withColumn("label", F.col("node"))
    return groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _ordered(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _may_link(n: Column, place: Column, other_n: Column, other_place: Column, percent: int) -> Column:
    """Whether a key may be the rarest one that two linked sets share: both hold it at the place of their least overlap or later."""
    return F.least(place, other_place) * (100 + percent) >= (n + other_n) * percent


def _pairs_left(open_rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of a key that may still link two components."""
    other = open_rows.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "place")))
    met = open_rows.join(other, "key").where((F.col("label") < F.col("label2")) & _may_link(F.col("n"), F.col("place"), F.col("n2"), F.col("place2"), percent))
    return met.select(*_ordered(F.col("node"), F.col("node2")))


def linked_components(groups: DataFrame, sets: DataFrame, percent: int, pivot_rounds: int) -> DataFrame | None:
    """node, label for every set that links with another one; None if none does.

    The first pivot of a key is the member with the most common shingles, later
    ones are drawn by a hash.
    """
    labels: DataFrame | None = None
    tested: DataFrame | None = None
    for number in range(pivot_rounds + 1):
        placed = settled(_with_component(groups, labels), "placed")
        order = F.xxhash64("node", F.lit(number)) if number else F.struct(-F.col("place"), F.xxhash64("node"))
        mixed = placed.groupBy("key").agg(
            F.min_by(F.struct("node", "label", "n", "place"), order).alias("pivot"), F.min("label").alias("low"), F.max("label").alias("high")
        ).where("low <> high")
        open_rows = placed.join(mixed, "key")
        if number < pivot_rounds:
            may = _may_link(F.col("n"), F.col("place"), F.col("pivot.n"), F.col("pivot.place"), percent)
            pairs = open_rows.where((F.col("label") != F.col("pivot.label")) & may).select(*_ordered(F.col("node"), F.col("pivot.node")))
        else:
            pairs = _pairs_left(open_rows.select("key", "node", "label", "n", "place"), percent)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settled(pairs, "pairs")
        if not pairs.limit(1).count():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        made = settled(compared(pairs, sets, percent), "links")
        edges = made.where("linked").select("a", "b")
        if not edges.limit(1).count():
            continue
        if labels is None:
            labels = components(edges)
            continue
        known = labels
        ends = {c: known.withColumnsRenamed({"node": c, "label": f"label_{c}"}) for c in ("a", "b")}
        between = edges.join(ends["a"], "a", "left").join(ends["b"], "b", "left")
        between = between.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct()
        above = settled(components(between).select(F.col("node").alias("label"), F.col("label").alias("top")), "above")
        lone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("label"))
        labels = settled(
            known.unionByName(lone).join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels"
        )
    return labels


def jaccard_components(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach from each document."""
    nodes = settled(set_nodes(docs, text, key), "nodes")
    sets = member_sets(docs, nodes, survivors(node_keys(docs, percent, text), percent), text, key)
    labels = linked_components(candidate_groups(sets, percent), sets, percent, PIVOT_ROUNDS)
    own = nodes.withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.where("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the least id, with its own columns.

    Rows that repeat an id are one document and stay or go together; rows with a null id stay.
    """
    found = jaccard_components(docs, percent)
    gone = found.where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
