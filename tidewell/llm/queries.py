"""The registered queries of this subpackage: (spark, sf_dir) to DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat, collocations, decontaminate, fim, jaccard, langid, licenses, linededup, quality, secret_scan, sharding, sql, toxicity
from tidewell.llm.sampling import held_out
from tidewell.llm.workspace import fresh_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(_read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


#: Appends of op3_sharding.
DELIVERIES = 3


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in DELIVERIES appends, each with every third arrival; the store is compacted before the last one and after it."""
    docs = _read(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, fresh_path(spark, "shards"))
    delivery = F.pmod(sharding.arrival_of(), F.lit(DELIVERIES))
    for number in range(DELIVERIES):
        store.append(docs.where(delivery == number))
        if number >= DELIVERIES - 2:
            version = store.compact()
    shards = store.manifest(version).select(F.col("shard").alias("_shard"), "n_docs", "n_bytes")
    rows = store.rows(shard="_shard").join(shards, "_shard")
    return rows.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        "source",
        F.col("_shard").alias("shard"),
        F.col("n_docs").alias("shard_docs"),
        F.col("n_bytes").alias("shard_bytes"),
        F.lit(version).cast("long").alias("version"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_recurring_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", "worst_sentence", "worst_score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def said(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = ("assign", "access", "hex")
    counts = (F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base)
    return found.select("doc_id", *counts, F.sha2(said(of(*base)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_read(spark, sf_dir, "documents"))
    again = fim.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_secret_scan": op11_secret_scan,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
