"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", app: str = "tidemark", **extra: str) -> SparkSession:
    """A session with the settings the plans expect; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_CLEANED: set[str] = set()


def _clean_up(spark: SparkSession, folder: str) -> None:
    """Delete the application's settled tables when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            system.delete(path, True)

    atexit.register(drop)


def settle(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: several readers, one computation, no lineage.

    A written table survives the loss of executors and keeps its statistics for the planner. It is
    deleted when the driver ends, as results that are still unread may need it.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}"
    if home not in _CLEANED:
        _CLEANED.add(home)
        _clean_up(spark, home)
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors' Python workers, once per context."""
    import io
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))  # served by the driver, so the path need not be shared
    context._tidemark_shipped = True
