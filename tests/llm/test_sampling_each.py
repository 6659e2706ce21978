"""Samples of each language: bounded, repeatable, and with rare languages whatever the size of the table."""

import collections

from pyspark.sql import functions as F

from tidewell.llm import langid, sampling


def test_every_value_is_sampled_up_to_its_bound(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 600 == 0, "rare").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("lang"))
    rows = rows.unionByName(rows.where("lang = 'rare'"))
    found = sampling.lowest_hashes_each(rows.repartition(7), 50, "lang").collect()
    assert collections.Counter(r.lang for r in found) == {"a": 50, "b": 50, "rare": 10}
    assert len({r.doc_id for r in found}) == len(found)
    for lang in ("a", "b"):
        lowest = rows.where(F.col("lang") == lang).orderBy(F.xxhash64(F.lit("sample"), "doc_id")).limit(50)
        assert {r.doc_id for r in lowest.collect()} == {r.doc_id for r in found if r.lang == lang}
    assert sampling.lowest_hashes_each(rows.where("false"), 50, "lang").collect() == []


def test_a_rare_language_is_learned_beside_a_common_one(spark):
    common = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("plain words of the common tongue here").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(3000, 3012).select(F.col("id").alias("doc_id"), F.lit("ждущий широкий жёлтый дождь").alias("text"), F.lit("ru").alias("lang"))
    langs, windows, labels = langid.train_windows(common.unionByName(rare), lang_docs=40)
    assert langs == ["en", "ru"]
    counts = collections.Counter(labels.tolist())
    assert counts[0] == 40 * langid.TRAIN_CUTS and 0 < counts[1] <= 12 * langid.TRAIN_CUTS and len(windows) == len(labels)
