"""Session helpers: configuration for tests and the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local-mode session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="weft-")
    spark.sparkContext.setCheckpointDir(found)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}"


def drop_run_files(spark: SparkSession) -> None:
    """Deletes what this application has materialized. Only when no result that reads it is needed any more."""
    _delete(spark, run_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_folders: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is materialized inside is deleted at the end, but for what ``outlives`` it: only that may be read afterwards."""
    held = _folders.get()
    folder = f"{held[-1] if held else run_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _folders.set((*held, folder))
    try:
        yield
    finally:
        _folders.reset(token)
        _delete(spark, folder)


#: While a table is written: what goes to Python at once is bounded in bytes, too, not only by the 10,000 rows of a batch; and
#: the shuffle files behind the table go as soon as it is there, not when the driver happens to collect its garbage.
WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python have the bound of ``WRITING``: for results that the caller writes. Large
    buffers are not only large themselves: once freed, they let malloc keep as much in each thread's arena."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, WRITING[key])


@contextlib.contextmanager
def _writing(spark: SparkSession):
    held = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, keys: list[str] | None = None, outlives: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors. A table that
    ``outlives`` the innermost ``scratch`` lies outside it."""
    folders = (run_dir(df.sparkSession), *_folders.get())
    path = f"{folders[-2 if outlives and len(folders) > 1 else -1]}/{name}-{uuid.uuid4().hex}"
    with _writing(df.sparkSession):
        (df.sortWithinPartitions(*keys) if keys else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets of what is dealt by ``tasks_for``.
TASK_ROWS = 500_000


def tasks_for(*tables: DataFrame) -> int:
    """Partitions, for ``repartition`` by a key, that have about ``TASK_ROWS`` rows of ``tables`` each, however large these are.

    Spark's own number is fixed, and of small partitions it makes one a core by their compressed bytes: there, a task's memory
    grows with the input, for short keys take many times those bytes once they are read. A number that is stated stays.
    """
    return max(1, -(-sum(t.count() for t in tables) // TASK_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
