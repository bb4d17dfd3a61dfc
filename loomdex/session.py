"""Session construction and lineage cutting shared by all plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loomdex") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. A folder of this machine is taken only by a local session that names none, as in tests; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loomdex-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; it survives the loss of any executor.

    Spark deletes the shuffle files of a finished query once the driver's collector has found that nothing refers to them; it is asked to look before the
    next step writes its own, or the disks hold the files of all steps at once."""
    checkpoint_dir(df.sparkSession)
    df.sparkSession._jvm.System.gc()
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_loomdex_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomdex-ship-")) / "loomdex.zip"  # read by the driver alone, which serves it to the executors
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._loomdex_shipped = True
