"""Change feeds: a stream of file changes folded per micro-batch into revisions of a snapshot.

A batch is applied whole or not at all: its changes are coalesced per path, checked, and the next snapshot is written under
its revision before the pointer moves. A batch that Spark runs again after a failure finds its revision there and does
nothing. Changes that do not alter a file's content do not make a revision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weft.operators.changes import coalesce_changes, expand_moves

CHANGE = "path string, kind string, source string, contents string, seq long"
SNAPSHOT = "path string, contents string"


def next_snapshot(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot (path, contents) after a batch of changes (CHANGE).

    A path's last added or changed contents win; a move takes the contents that its source last had, in the batch or
    before it, unless it brings its own. A move of a path that moved in the same batch must bring them.
    """
    plain = batch.where("kind in ('added', 'changed')").select("path", "contents", "seq")
    moved = batch.where("kind = 'moved'").select("path", "source", "contents", "seq")
    had = plain.unionByName(snapshot.select("path", "contents", F.lit(None).cast("long").alias("seq")))
    had = had.select(F.col("path").alias("source"), F.col("contents").alias("old"), F.col("seq").alias("old_seq"))
    before = moved.join(had, "source", "left").where("old_seq is null or old_seq < seq")
    # the latest comes last: what the snapshot has precedes everything in the batch
    best = before.groupBy("path", "seq", "contents").agg(F.max(F.struct(F.coalesce("old_seq", F.lit(-(1 << 62))).alias("s"), "old")).alias("_b"))
    carried = best.select("path", F.coalesce("contents", F.col("_b.old")).alias("contents"), "seq")
    written = plain.unionByName(carried)
    last = written.groupBy("path").agg(F.max(F.struct("seq", "contents")).alias("_b")).select("path", F.col("_b.contents").alias("contents"))
    folded = coalesce_changes(expand_moves(batch, "path", "kind", "source", "seq"), ["path"], "kind", ["seq"])
    touched = expand_moves(batch, "path", "kind", "source", "seq").select("path").distinct()
    kept = snapshot.join(touched, "path", "left_anti")
    alive = folded.where("kind <> 'removed'").select("path").join(last, "path")
    return kept.select("path", "contents").unionByName(alive.select("path", "contents"))


class RevisionStore:
    """Snapshots by revision in one folder of the shared file system; a pointer file names the newest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.fs_path(self.root))

    def revisions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.fs_path(self.root))]
        return sorted(int(n[9:]) for n in names if n.startswith("revision-"))

    def current(self) -> tuple[int, DataFrame]:
        done = self.revisions()
        if not done:
            return 0, self.spark.createDataFrame([], SNAPSHOT)
        return done[-1], self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/revision-{done[-1]}")

    def commit(self, revision: int, snapshot: DataFrame) -> bool:
        """Writes a revision aside and renames it into place; an obsolete revision is refused."""
        done = self.revisions()
        if done and revision <= done[-1]:
            return False
        aside = f"{self.root}/staged-{revision}"
        snapshot.write.mode("overwrite").parquet(aside)
        return self.fs.rename(self.fs_path(aside), self.fs_path(f"{self.root}/revision-{revision}"))


def apply_batch(store: RevisionStore, validate: Callable[[DataFrame], bool] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. validate: may reject a candidate snapshot; the previous revision then stays."""

    def run(batch: DataFrame, batch_id: int) -> None:
        revision = batch_id + 1
        have, snapshot = store.current()
        if revision <= have:
            return
        candidate = next_snapshot(snapshot, batch)
        changed = candidate.exceptAll(snapshot).limit(1).count() + snapshot.exceptAll(candidate).limit(1).count()
        if changed and (validate is None or validate(candidate)):
            store.commit(revision, candidate)

    return run


def watch(changes: DataFrame, store: RevisionStore, checkpoint: str, validate: Callable[[DataFrame], bool] | None = None) -> DataStreamWriter:
    """The writer that keeps ``store`` up to date with a stream of changes."""
    return changes.writeStream.foreachBatch(apply_batch(store, validate)).option("checkpointLocation", checkpoint)


def debounced(changes: DataFrame, ts: str, gap: str, lateness: str) -> DataFrame:
    """(path, first, last, n) of bursts of a change stream, emitted once a path was quiet for ``gap``."""
    return changes.withWatermark(ts, lateness).groupBy("path", F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("w")
