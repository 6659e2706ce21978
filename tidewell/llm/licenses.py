"""License scans by diagonal voting.

All rolling word 2-grams of a document are hashed and joined to the positions
at which the license templates hold the same 2-gram.  A template that stands in
a text puts its hits on one diagonal (document position minus template
position); words added or lost inside it shift later hits to a neighbouring
diagonal.  Hits are counted by diagonal, and each diagonal is merged with those
up to SLACK above it.  A merged span is verified: its hits, every one compared
word by word, are walked through in the template's order, and only those that
also come later in the text than all before them count.  Of spans of one
template within SLACK of each other the best one stays, and it counts if enough
of the template's 2-grams do.

Defined results: a null or empty text has no words and no spans; repeated rows
and null ids each keep a row of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 2
#: Diagonals of one occurrence of a notice lie at most this far apart, all in all; and at most a quarter of its 2-grams.
SLACK = 3
#: Share of a notice's 2-grams that a span must cover.
COVERAGE = 0.8
#: The templates are broadcast; a longer list is refused.
MOST_GRAMS = 100_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that count only word for word, with their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Wording of public license notices, with their labels.
NOTICES = (
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """The template 2-grams (gram, template, t_pos, t_one, t_two) and the templates (template, label, family, exact, n_grams)."""
    grams, templates = [], []
    for exact, table in ((True, phrases), (False, notices)):
        for label, text in table:
            words = text.split()
            if len(words) < GRAM:
                raise ValueError(f"a template needs {GRAM} words: {text!r}")
            number = len(templates)
            templates.append((number, label, label.split("-")[0], exact, len(words) - 1))
            grams += [(number, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    if len(grams) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} template 2-grams")
    return (
        spark.createDataFrame(grams, "template int, t_pos int, t_one string, t_two string").withColumn("gram", F.xxhash64("t_one", "t_two")),
        spark.createDataFrame(templates, "template int, label string, family string, exact boolean, n_grams int"),
    )


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Spans of license wording.

    Returns row_id, doc_id, n_words and, for each span, label, exact, start and
    end (words, end exclusive) and coverage; a row without any span has nulls
    there.  A phrase's span is one place where it stands word for word.  Of
    notices of one family at one place, the best covered one stays.
    """
    grams, templates = template_grams(docs.sparkSession, phrases, notices)
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")
    # lower() also folds letters beyond ASCII; that moves no word boundary, and no template holds such a letter
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).alias("doc_id"), words.alias("words"))
    n = F.size("words")
    pairs = F.arrays_zip(F.col("words").alias("one"), F.slice("words", 2, n).alias("two"))
    placed = rows.select("row_id", "doc_id", n.cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "pair"))
    placed = placed.select("row_id", "doc_id", "n_words", "pos", *(F.col(f"pair.`{i}`").alias(c) for i, c in zip(_pair_names(placed), ("one", "two"), strict=True)))
    hit = F.coalesce((F.col("one") == F.col("t_one")) & (F.col("two") == F.col("t_two")), F.lit(False))
    hits = (
        placed.withColumn("gram", F.xxhash64("one", "two"))
        .join(F.broadcast(grams), "gram", "left")
        .where(hit | F.col("pos").isNull() | (F.col("pos") == 0))
        .select("row_id", "doc_id", "n_words", F.when(hit, F.col("template")).alias("template"), F.when(hit, F.col("pos") - F.col("t_pos")).alias("diagonal"), F.when(hit, F.col("t_pos")).alias("t_pos"))
    )
    about = hits.repartition("row_id").join(F.broadcast(templates), "template", "left")
    d = F.col("diagonal")
    bands = F.when(F.col("exact"), F.array(d)).when(d.isNotNull(), F.transform(F.sequence(F.lit(0), F.least(F.lit(SLACK), F.floor(F.col("n_grams") / 4).cast("int"))), lambda i: d - i))
    kinds = ("row_id", "doc_id", "n_words", "template", "label", "family", "exact", "n_grams")
    spans = (
        about.withColumn("anchor", F.explode_outer(bands))
        .groupBy(*kinds, "anchor")
        .agg(F.array_sort(F.collect_set(F.struct("t_pos", (d + F.col("t_pos")).alias("pos")))).alias("found"), F.max(d == F.col("anchor")).alias("own"))
        .where("own OR anchor IS NULL")
        .withColumn("walk", F.when(F.col("anchor").isNotNull(), _in_order(F.col("found"))))
        .select(*kinds, "anchor", F.col("walk.n").alias("votes"), F.col("walk.first").alias("start"), (F.col("walk.top") + GRAM).alias("end"))
        .withColumn("coverage", F.coalesce(F.col("votes") / F.col("n_grams"), F.lit(0.0)))
    )
    rank = F.col("votes").cast("long") * 2**40 - F.col("anchor")
    near = Window.partitionBy("row_id", "template").orderBy("anchor").rangeBetween(-SLACK, SLACK)
    merged = spans.withColumn("rank", rank).withColumn("top", F.max("rank").over(near)).where("anchor IS NULL OR exact OR rank = top")
    best = Window.partitionBy("row_id", "exact", "family", "start").orderBy(F.desc("coverage"), "template")
    kept = F.when(F.col("exact"), F.col("votes") == F.col("n_grams")).otherwise((F.col("coverage") >= COVERAGE) & (F.row_number().over(best) == 1))
    return merged.withColumn("kept", kept).select("row_id", "doc_id", "n_words", *(F.when(F.col("kept"), F.col(c)).alias(c) for c in ("label", "exact", "start", "end")), "coverage")


def _in_order(found: Column) -> Column:
    """n, first and top (text positions) of the hits that come later than all before them; found is sorted by template position, then by text position."""
    start = F.struct(F.lit(-1).alias("t"), F.lit(-1).alias("first"), F.lit(-1).alias("top"), F.lit(0).alias("n"))

    def step(state: Column, hit: Column) -> Column:
        later = hit["pos"] > state["top"]
        walked = F.struct(
            hit["t_pos"].alias("t"),
            F.when(state["n"] == 0, hit["pos"]).otherwise(state["first"]).alias("first"),
            F.when(later, hit["pos"]).otherwise(state["top"]).alias("top"),
            (state["n"] + later.cast("int")).alias("n"),
        )
        return F.when(hit["t_pos"] == state["t"], state).otherwise(walked)

    return F.aggregate(found, start, step)


def _pair_names(placed: DataFrame) -> list[str]:
    return placed.schema["pair"].dataType.fieldNames()


def license_summary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: places of the base phrases, the labels, and the best coverage of any template."""
    spans = scan_licenses(docs, text, key)
    base = F.col("exact")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans.groupBy("row_id", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.round(F.max("coverage"), 6).alias("score"),
        F.count(F.when(~base, 1)).alias("n_notices"),
    ).drop("row_id")
