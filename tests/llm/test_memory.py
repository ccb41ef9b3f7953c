"""What a task holds at once, by bytes, whatever the rows; what stays on disk."""

import time
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft import session
from weft.llm import decontaminate as D
from weft.llm import simhash as S


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])


def test_python_gets_bounded_batches(spark):
    before = {k: spark.conf.get(k) for k in session.WRITING}
    rows = spark.range(9000).selectExpr("repeat('some words ', 200) AS text").coalesce(1)
    got = session.materialize(rows.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r.n for r in got) == 9000 and max(r.bytes for r in got) < 5_000_000
    assert {k: spark.conf.get(k) for k in session.WRITING} == before


def test_a_shard_holds_codes_not_words():
    """400,000 words of one shard; held as words they took over 20 MB."""
    texts = [" ".join(f"w{(i * 37 + j * 11) % 5000}" for j in range(200)) for i in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], ["id", "text"]) for i in range(0, 2000, 100)]
    tracemalloc.start()
    try:
        out = list(D._shards(iter(batches), 7, 1_000_000, rows=3000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20_000_000, peak
    table = pa.Table.from_batches(out).to_pylist()
    assert max(b.num_rows for b in out) <= 3000 and len(table) == 2000 + 5000
    assert sum(len(r["steps"]) for r in table) == sum(r["n"] for r in table[:2000]) == 400_000


def on_disk(spark):
    """Shuffle files of this session, and the tables in its folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [str(files.apply(i).getName()) for i in range(files.size())]
    folder = Path(session.run_dir(spark).removeprefix("file://"))
    return {n for n in names if n.startswith("shuffle_")}, {str(p.parent) for p in folder.rglob("*.parquet")}


def test_shuffle_files_go_with_the_write(spark):
    before = on_disk(spark)[0]
    session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not gone_late(lambda: on_disk(spark)[0] - before)


def gone_late(left):
    """What is left after up to ten seconds: Spark deletes shuffle files beside the run."""
    for _ in range(50):
        if not (found := left()):
            break
        time.sleep(0.2)
    return found


def test_only_the_dropped_rows_stay_on_disk(spark):
    texts = [" ".join(f"w{i}" for i in range(j, j + 60)) for j in (0, 0, 1, 500, 900, 901)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(520, 540)))], "item_id long, text string")
    tables = on_disk(spark)[1]
    near = S.drop_near_copies(docs)
    assert sorted(r.doc_id for r in near.collect()) == [0, 3, 4]
    assert len(left := on_disk(spark)[1] - tables) == 1 and "/dropped-" in left.pop()
    tables = on_disk(spark)[1]
    assert sorted(r.doc_id for r in D.drop_contaminated(near, bench).collect()) == [0, 4]
    assert len(left := on_disk(spark)[1] - tables) == 1 and "/contaminated-" in left.pop()


def test_scratch_is_deleted_after_an_error(spark):
    tables = on_disk(spark)[1]
    with pytest.raises(ZeroDivisionError), session.scratch(spark):
        session.materialize(spark.range(3), "kept")
        with session.scratch(spark):
            kept = session.materialize(spark.range(3), "inner", outlives=True)
        assert kept.count() == 3
        1 / 0
    assert on_disk(spark)[1] == tables


def test_batches_are_bounded_from_the_first_stage_on(spark):
    """The caller writes what a stage returns, so the bound must hold outside of our own writes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        docs = spark.createDataFrame([(i, "some words of a text", "en") for i in range(8)], "doc_id long, text string, lang string")
        corpus_pipeline.language(spark, docs, "").count()
        rows = spark.range(9000).selectExpr("repeat('some words ', 200) AS text").coalesce(1)
        assert max(r.bytes for r in rows.mapInArrow(sizes, "n long, bytes long").collect()) < 5_000_000
    finally:
        spark.conf.set(key, before)
