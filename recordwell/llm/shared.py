"""What the operators of this folder share: tables, scratch tables and hold-out rows."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import shared_folder, ship

#: Rows and bytes up to which a measured side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 24 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends there.

    Lost executors then cost a re-read, not a recomputation. The folder goes when
    the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recordwell-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if not _written:
        atexit.register(_sweep)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already  # noqa: BLE001
            return


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, and their bytes with those of texts, are measured to stay within the bounds; else df."""
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(reduce(add, long, F.lit(24 + 8 * len(df.columns))).cast("long"))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most_bytes else df


def remainder(key: Column, by: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo by; null for a null id."""
    return F.crc32(key.cast("string")) % by


def held_out(key: Column) -> Column:
    """Rows that no model learns from. A null id is never learned from either."""
    return F.coalesce(remainder(key) == 0, F.lit(True))


def unit_hash(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
