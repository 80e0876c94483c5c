"""Ship this package to the executors, which needn't have it installed."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Spark's defaults for batches of rows handed to Python, and what whole texts and pages need in their place.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the application, once; keep batches small where the session has no wish of its own."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="recordwell-")) / "recordwell_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(top.rglob("*.py")):
            archive.write(source, Path(top.name) / source.relative_to(top))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of this machine only where all runs on it."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="recordwell-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def ensure_checkpoint(spark: SparkSession) -> None:
    """Use the shared folder for checkpoints, too."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


_tables: list[tuple[SparkSession, str]] = []


def kept(df: DataFrame, label: str = "rows") -> DataFrame:
    """df as a table of the shared folder: its lineage ends there, and lost executors cost a re-read. The folder goes when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recordwell-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_sweep)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _tables:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already  # noqa: BLE001
            return
