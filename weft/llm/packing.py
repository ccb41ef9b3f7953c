"""Packing by optimal length buckets.

Texts are cut into sequences of at most ``max_tokens`` tokens, so the histogram of sequence lengths has at most that many
entries, whatever the size of the input. A dynamic programme over the whole histogram chooses the ``buckets`` boundaries
that need the least padding. Inside a bucket, sequences are numbered and cut into batches whose padded size stays within
``token_budget``. Numbers come from counts per (bucket, part), where a part is a hash of identifier and text: no bucket is
numbered in one task, and consecutive parts share a batch, so only a bucket's last batch is not full.

Defined results: a text without tokens (null, empty, blank) gives one row with n_tokens 0 and no bucket or batch; a text
longer than ``max_tokens`` gives several sequences, numbered from 0; repeated rows are packed each on their own; an empty
table gives an empty result; other columns are ignored. Tokens are white-space-separated words, or those of a byte-level
BPE vocabulary in tiktoken's format, whose file is a parameter.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.sampling import sized
from weft.llm.text import text_or_empty
from weft.session import materialize


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct lengths, and their padding, which is the least possible."""
    m = len(lengths)
    if not m:
        return [], 0
    top = np.asarray(lengths, np.float64)
    number = np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    tokens = np.concatenate([[0], np.cumsum(top * np.asarray(counts, np.float64))])
    best = top * number[1:] - tokens[1:]  # one bucket up to length j
    choice = []
    for _ in range(1, min(buckets, m)):
        step, origin = np.empty(m), np.zeros(m, np.int64)
        for j in range(m):
            # the last bucket holds lengths i to j, what comes before is best[i - 1]
            before = np.concatenate([[0.0], best[:j]])
            cost = before + top[j] * (number[j + 1] - number[: j + 1]) - (tokens[j + 1] - tokens[: j + 1])
            origin[j] = cost.argmin()
            step[j] = cost[origin[j]]
        best = step
        choice.append(origin)
    ends, j = [], m - 1
    for origin in reversed(choice):
        ends.append(j)
        j = int(origin[j]) - 1
        if j < 0:
            break
    if j >= 0:
        ends.append(j)
    return [int(lengths[e]) for e in reversed(ends)], int(round(best[-1]))


def token_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n, mix): tokens of each text, and a hash of identifier and text. vocabulary: a file of ranks that the driver reads and sends out; pattern: its word rule."""
    mix = F.xxhash64(F.col(id_col), F.col(text_col)).alias("mix")
    if vocabulary is None:
        return docs.select(F.col(id_col).alias("id"), F.regexp_count(text_or_empty(text_col), F.lit(r"\S+")).cast("long").alias("n"), mix)
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    shared = docs.sparkSession.sparkContext.broadcast((pattern, ranks))  # one vocabulary

    def count(batches):
        import tiktoken

        rule, table = shared.value
        coder = tiktoken.Encoding("own", pat_str=rule, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(coder.encode_ordinary(t or "")) for t in batch.column(1).to_pylist()], pa.int64()), batch.column(2)], ["id", "n", "mix"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("mix", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), mix).mapInArrow(count, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, max_tokens: int = 2048, token_budget: int = 16_384, part_rows: int = 2000,
         vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per sequence: ``id_col``, sequence, start, n_tokens, bucket, bucket_tokens, batch, slot."""
    if not 0 < max_tokens <= token_budget:
        raise ValueError("token_budget must hold one sequence of max_tokens")
    spark = docs.sparkSession
    sizes = materialize(token_counts(docs, id_col, text_col, vocabulary, pattern), "lengths")
    most = F.greatest(F.ceil(F.col("n") / max_tokens), F.lit(1)).cast("int")
    cut = sizes.select("id", "n", "mix", F.explode(F.sequence(F.lit(0), most - 1)).alias("sequence"))
    start = F.col("sequence").cast("long") * max_tokens
    cut = cut.select("id", "mix", "sequence", start.alias("start"), F.least(F.col("n") - start, F.lit(max_tokens)).cast("int").alias("n_tokens"))
    histogram = sorted((r.n_tokens, r.c) for r in cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect())  # max_tokens rows
    ends, _ = optimal_boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i in reversed(range(len(ends))):
        bucket = F.when(F.col("n_tokens") <= ends[i], i).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= ends[i], ends[i]).otherwise(size)
    has = F.col("n_tokens") > 0
    parts = max(1, -(-sum(h[1] for h in histogram) // (part_rows * max(1, len(ends)))))
    cut = cut.withColumn("bucket", F.when(has, bucket)).withColumn("bucket_tokens", F.when(has, size))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("mix", "sequence"), F.lit(parts)))
    counts = materialize(cut.where(has).groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c")), "counts")
    # the number of rows before each part of a bucket: a row for about part_rows sequences
    begin = counts.selectExpr("bucket", "part", "sum(c) over (partition by bucket order by part rows between unbounded preceding and 1 preceding) as begin")
    begin = begin.withColumn("begin", F.coalesce("begin", F.lit(0).cast("long")))
    numbered = cut.where(has).selectExpr("*", "row_number() over (partition by bucket, part order by id, mix, sequence) - 1 as own").join(sized(begin, 100_000), ["bucket", "part"])
    place, rows = F.col("begin") + F.col("own"), F.floor(F.lit(token_budget) / F.col("bucket_tokens"))
    columns = [F.col("id").alias(id_col), "sequence", "start", "n_tokens", "bucket", "bucket_tokens"]
    packed = numbered.select(*columns, F.floor(place / rows).alias("batch"), (place % rows).cast("int").alias("slot"))
    none = cut.where(~has).select(*columns, F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return packed.unionByName(none)
