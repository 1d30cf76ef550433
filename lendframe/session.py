"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "lendframe") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors and returns the archive's path on the driver.

    Kernels are pickled by the name of their module, so workers must be able to import it. Call this once
    where the package is neither installed on the executors nor given with ``--py-files``. The archive is
    read on the driver only; Spark hands it to executors, also to those that start later.
    """
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lendframe-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster a machine-local folder
    would not survive the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return shared or tempfile.mkdtemp(prefix="lendframe-")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path for tables of one run, on storage every executor can reach."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the session, so a lost executor costs no recompute."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def width(spark: SparkSession) -> int:
    """How many buckets an ordered operator splits its key range into."""
    return max(2, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks hold the rows of a stored table at that many each; the count reads the files' footers only."""
    return max(1, -(-df.count() // rows))
