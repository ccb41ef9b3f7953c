"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: its distinct digests, each with the identifier to keep and a count. ``fan_in`` runs meet
a round: they are dealt by run and by a shard (a byte of the digest, which is uniform, so no sampling and no hot task), laid
in one order of (digest, length, check, identifier) and merged in one pass along it, which lets the first entry of each digest
go on, with the sum of the counts. After ``log_fan_in(partitions)`` rounds one run is left, sorted within each shard. A digest
that a third of all rows share enters a round with one entry per run at most.

An entry's key is the SHA-256, the byte length and an independent 64-bit hash of the text, so entries are merged only
where all three agree. Every round verifies what it retains: an entry that would stand before the one retained for its key
stops the job.

Defined results: a null text counts as empty; empty texts equal each other; a null identifier is smaller than any other
and is kept only if its group has no other; rows that repeat one identifier and text give one kept row and dropped ones;
an empty table gives an empty result. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.sampling import sized
from weft.llm.text import lower_ascii, text_or_empty
from weft.session import materialize

KEY = ["_digest", "_bytes", "_check"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _digest, _bytes, _check) of each row."""
    t = docs.select(F.col(id_col).alias("_id"), lower_ascii(text_or_empty(text_col)).alias("_t"))
    return t.select("_id", F.unhex(F.sha2("_t", 256)).alias("_digest"), F.octet_length("_t").alias("_bytes"), F.xxhash64("_t").alias("_check"))


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row per digest: KEY, _keep, _size. rows: KEY and _id."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    if fan_in < 2:
        raise ValueError("a round merges two runs or more")
    best = F.min if keep == "smallest" else F.max
    order = F.asc_nulls_last("_keep") if keep == "smallest" else F.desc_nulls_last("_keep")
    runs = -(-max(1, rows.rdd.getNumPartitions()) // fan_in)
    # a partition's run is what its aggregate combines before the shuffle, and that shuffle brings the first fan_in together
    first_run = F.expr(f"cast(spark_partition_id() div {fan_in} as int)").alias("_run")
    level = rows.select(*KEY, "_id", first_run).groupBy("_run", *KEY).agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    while True:
        level = level.withColumn("_run", F.expr(f"cast(_run div {fan_in} as int)")).withColumn("_shard", F.substring("_digest", 1, 1))
        entries = Window.partitionBy("_run", "_shard", *KEY)
        # one sort lays the runs of a shard in order; both windows are passes along it
        placed = level.repartition("_run", "_shard").withColumn("_nth", F.row_number().over(entries.orderBy(order)))
        merged = placed.withColumn("_sum", F.sum("_size").over(entries)).withColumn("_best", best("_keep").over(entries))
        verified = F.when(F.col("_keep").eqNullSafe(F.col("_best")), F.col("_keep")).otherwise(F.raise_error(F.lit("a run is out of order")))
        level = merged.where("_nth = 1").select("_run", *KEY, verified.alias("_keep"), F.col("_sum").alias("_size"))
        runs = -(-runs // fan_in)
        if runs == 1:
            return level.drop("_run")


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int) -> DataFrame:
    """One row per identifier and text: _id, KEY, _n (rows), _keep, _size, _best."""
    rows = digests(docs, id_col, text_col)
    merged = merge_runs(rows, keep, fan_in)
    alike = rows.groupBy("_id", *KEY).agg(F.count(F.lit(1)).alias("_n"))
    return alike.join(merged, KEY, "left").withColumn("_best", F.col("_id").eqNullSafe(F.col("_keep")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, id_col, text_col, keep, fan_in).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.posexplode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_pos", "_nth"),
        "_best",
        F.lower(F.hex("_digest")).alias("text_sha256"),
    ).select(id_col, "keep_id", "group_size", (F.col("_best") & (F.col("_pos") == 0)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts.

    What goes is decided on digests; texts are read again and filtered, and move only if over ``broadcast_rows`` rows go. Of
    rows that repeat an identifier and a text that stays, any one stays, for they may differ in other columns.
    """
    decided = materialize(_decided(docs, id_col, text_col, keep, fan_in).select("_id", "_digest", "_bytes", "_n", "_best"), "decided")
    names = [F.col("_id").alias("_gone_id"), F.col("_digest").alias("_gone"), F.col("_bytes").alias("_gone_bytes")]
    text = lower_ascii(text_or_empty(text_col))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_own"), F.unhex(F.sha2(text, 256)).alias("_hash"), F.octet_length(text).alias("_length"))
    same = F.col("_own").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone")) & (F.col("_length") == F.col("_gone_bytes"))
    left = rows.join(sized(decided.where("not _best").select(*names), broadcast_rows), same, "left_anti")
    twice = decided.where("_best and _n > 1").select(*names)
    if not twice.isEmpty():
        repeated = sized(twice, broadcast_rows)
        one = left.join(repeated, same, "left_semi").groupBy("_own", "_hash", "_length").agg(F.first("_row").alias("_row"))
        left = left.join(repeated, same, "left_anti").select("_row").unionByName(one.select("_row"))
    return left.select("_row.*")
