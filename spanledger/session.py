"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that the operators rely on for large inputs.  A wide-text join that meets a
# case holding a large part of all rows must be split even when that costs one more exchange.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # of a repeated JSON key the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # long texts go to Python in batches of bytes, not of 10,000 rows whatever their length
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def ship_packages(spark: SparkSession, *folders: str | Path) -> None:
    """Send source packages to the Python workers, each once per application.

    Not needed where the packages are installed on every node or passed with --py-files.
    """
    context = spark.sparkContext
    shipped = getattr(context, "_spanledger_shipped", set())
    new = [f for f in map(Path, folders) if f not in shipped]
    if not new:
        return
    folder = tempfile.mkdtemp(prefix="spanledger-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / f"packages_{len(shipped)}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for package in new:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spanledger_shipped = shipped | set(new)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder that ``spark.checkpoint.dir`` names in the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def own_scratch(spark: SparkSession) -> None:
    """For tests and timings on one machine: a folder of their own where the session names none.

    It goes when the process ends.  Any other session must name a shared folder itself.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is not None:
        return
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    root = tempfile.mkdtemp(prefix="spanledger-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The steps then share one computation, and a lost executor costs a re-read, not a re-run.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores when it has fewer partitions than there are cores.

    A file with one row group is one task, however much work follows.  A large input has enough
    splits of its own and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
