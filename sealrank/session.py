"""Session settings and the shared work folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Rows of an Arrow batch; texts are long, and the batches' memory is outside the heap.
BATCH_ROWS = 2_000
# Shuffle files go when the job that made them is done.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sealrank") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a cluster a
    missing setting is an error, because executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sealrank-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the work folder that no other run uses."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Write ``df`` once to the work folder, or the folder ``under`` in it, and read it back.

    Cuts the lineage, and unlike a checkpoint keeps column pruning and filter pushdown
    for the readers that follow.
    """
    path = new_path(df.sparkSession, name) if under is None else f"{under}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session's settings with ``values``, and as they were afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, freeing the shuffle files of the job once its rows are written."""
    with settings(df.sparkSession, {FREE_SHUFFLES: "true"}):
        return materialize(df, name)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows; the default is 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if getattr(context, "_sealrank_shipped", False):
        return
    package = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="sealrank-zip-")) / "sealrank.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    context._sealrank_shipped = True
