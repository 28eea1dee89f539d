"""Session defaults and the shared folder for checkpoints and exchanged tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the library expects; everything else stays at Spark's defaults so that
# a cluster's own configuration wins.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "bucketwise", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the library defaults; ``conf`` keys override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _configured(spark: SparkSession) -> str | None:
    return (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    The cluster owns the folder and clears it; ``spark.cleaner.referenceTracking.cleanCheckpoints``
    removes checkpoints that are no longer referenced. Without the setting this raises: a folder of
    one machine would lose what other machines write.
    """
    folder = _configured(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def choose_local_dir(spark: SparkSession) -> None:
    """For entry points: give a session on one machine a shared folder if its owner has named none."""
    if not _configured(spark) and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")


def ship_code(spark: SparkSession, *more: str) -> None:
    """Give this package, and modules or packages next to it, with their data files, to the Python workers (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_bucketwise_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="bucketwise-")) / "bucketwise_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for name in (Path(__file__).resolve().parent.name, *more):
            for file in [root / f"{name}.py", *sorted((root / name).rglob("*"))]:
                if file.is_file() and file.suffix != ".pyc":
                    out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._bucketwise_shipped = True


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
