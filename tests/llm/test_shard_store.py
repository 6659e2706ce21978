"""The shard store under changing columns, dying writers and one id for everything."""

import collections

import pytest
from pyspark.sql import functions as F

from tidewell.llm import sharding


def rows_of(df):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=repr)


def test_an_append_with_fewer_columns_loses_nothing(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    full = spark.createDataFrame([(i, f"text {i}", "web") for i in range(40)], "doc_id long, text string, source string")
    store.append(full)
    store.append(spark.createDataFrame([(300 + i, f"late {i}") for i in range(40)], "doc_id long, text string"))
    store.append(spark.createDataFrame([(600 + i, f"more {i}", 0.5) for i in range(40)], "doc_id long, text string, score double"))
    want = rows_of(store.rows().select("doc_id", "text", "source", "score"))
    assert collections.Counter(dict(r)["source"] for r in want) == {"web": 40, None: 80}
    assert collections.Counter(dict(r)["score"] for r in want) == {0.5: 40, None: 80}
    assert store.compact() == 4 and store.manifest().count() == 1
    assert rows_of(store.rows().select("doc_id", "text", "source", "score")) == want


def test_a_column_of_another_type_is_refused_before_anything_is_written(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "t"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    before = sorted(p for p in (tmp_path / "t").rglob("*"))
    with pytest.raises(ValueError, match="Doc_ID is string"):
        store.append(spark.createDataFrame([("1", "a")], "Doc_ID string, text string"), key="Doc_ID")
    assert sorted(p for p in (tmp_path / "t").rglob("*")) == before
    assert store.rows().count() == 1 and store.append(spark.createDataFrame([(2, "b")], "doc_id long, text string")) == 2


def test_a_column_that_is_named_like_a_former_folder(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "n"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", "mine")], "doc_id long, text string, shard string"))
    want = {(1, None), (2, "mine")}
    assert {(r.doc_id, r.shard) for r in store.rows().collect()} == want
    store.compact()
    assert {(r.doc_id, r.shard) for r in store.rows(shard="number").collect()} == want


def test_a_writer_that_dies_leaves_a_readable_store(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "d"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    store.append(docs)
    with monkeypatch.context() as m:
        m.setattr(sharding.ShardStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.append(docs)
    (tmp_path / "d" / "versions" / ".v000009.part").write_text("")
    assert store.versions() == [1] and store.rows().count() == 2
    assert store.append(docs) == 2 and store.rows().count() == 4


def test_a_version_is_published_once_and_other_failures_are_told_as_they_are(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "p"))
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(RuntimeError, match="version 1 of the manifest exists"):
        store.commit(store.manifest(), 1, store.schema())
    _, path = store._files()
    with pytest.raises(Exception) as told:
        store._publish(path(str(tmp_path / "p" / "nowhere.json")), path(str(tmp_path / "p" / "versions" / "v000002")), 2)
    assert "exists" not in str(told.value).splitlines()[0] and store.versions() == [1]


def test_an_empty_store_says_so(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "e"))
    for ask in (store.rows, store.compact, store.manifest):
        with pytest.raises(ValueError, match="nothing has been committed"):
            ask()


def test_one_id_for_everything_is_dealt_out_once(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "h"))
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text " * 20).alias("text"), F.col("id").alias("n"))
    store.append(docs.repartition(7), target_bytes=100_000)
    sizes = [r.n_bytes for r in store.manifest().collect()]
    assert len(sizes) == 12 and max(sizes) < 130_000 and sum(sizes) == 4000 * 280
    assert store.rows().select("n").distinct().count() == 4000
