"""Session defaults, and shipping this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(app: str = "siltstone", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BATCH_BYTES = 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers wherever they run; once an application.

    Batches that go to workers are held to 8 MB, unless the session asks for less.
    """
    size_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if not 0 < size_of(spark.conf.get(ARROW_BATCH, "64m")) <= ARROW_BATCH_BYTES:
        spark.conf.set(ARROW_BATCH, str(ARROW_BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltstone-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/siltstone-package", "zip", root.parent, root.name))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, or our own where none is set; without trailing slash."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="siltstone-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Folder:
    """Tables of our own in the shared folder; what is left of them goes with the driver process."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._last)

    def save(self, df: DataFrame, name: str) -> str:
        """Write a table; its path."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return f"{self.path}/{name}"

    def drop(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _last(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            self.drop(self.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
