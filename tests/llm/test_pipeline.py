"""The pipeline against its stages, and each stage on what its predecessor kept."""

import hashlib

import corpus_pipeline
from tidewell.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def test_pipeline_rows_are_the_tokens_of_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before
    tokenizer = bpe.load_tokenizer(queries.tokenizer_path())
    want = {}
    for row in docs.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        want[row.doc_id] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
