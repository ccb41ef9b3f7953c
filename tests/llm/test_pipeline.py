"""The pipeline's rows against a brute-force version of all stages on the smallest documents table."""

import itertools
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_operators import ascii_lower, brute_hits
from weft.llm.simhash import _shingles

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_pipeline_rows(spark):
    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    items = con.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    docs = [d for d in docs if any(c.isalpha() for c in d[1] or "")]
    last = {}
    for i, t in docs:
        last[ascii_lower(t)] = max(i, last.get(ascii_lower(t), -1))
    left = {i: t for i, t in docs if last[ascii_lower(t)] == i}
    sets, group = {i: _shingles(t, 5) for i, t in left.items()}, {i: i for i in left}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(sorted(left), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):  # near copies by the contract, however far apart in bits
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    left = {i: t for i, t in left.items() if find(i) == i and not brute_hits(t, items, 10)[1]}
    want = {i: len(t.split()) for i, t in left.items()}
    got = Counter()
    for r in corpus_pipeline.run(spark, f"file://{DATA}").collect():
        got[r.doc_id] += r.n_tokens
    assert dict(got) == want


def test_stages_keep_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the water is over the street and all of it", "en", "s", 10), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "THE water is over the street and all of it", "en", "s", 10), (None, "123", "en", None, 3)]
    bench = [(1, "quite other words that nobody in these few rows has ever used before now")]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, schema)
        for (name, stage), n in zip(corpus_pipeline.STAGES[:3], (2, 1, 1)):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() == (n if rows else 0), name
            docs = out
        from weft.llm.decontaminate import drop_contaminated

        clean = drop_contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
        assert clean.columns == docs.columns and clean.count() == docs.count()
