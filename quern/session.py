"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import shared


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "quern") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return importable(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers will find this package where the driver has it. On a cluster
    the package is installed, or passed with --py-files; there this changes nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


#: Temporary folders of local sessions without spark.checkpoint.dir, by application. The setting itself is
#: fixed when a session starts, so it cannot be filled in later.
_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    spark.checkpoint.dir of the session names it. Only a local session without that
    setting gets a temporary folder; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        made = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, made, True)
        _own_dirs[app] = f"file://{made}"
    return _own_dirs[app]


def stash(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut
    and what was computed survives the loss of executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` wrote, when all that was made of them has been written. A table that
    was made otherwise is left alone."""
    for df in tables:
        path = getattr(df, "_stashed_at", None)
        if path:
            shared.delete(df.sparkSession, path)


def bounded(side: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast when it has at most ``rows`` rows."""
    return F.broadcast(side) if side.count() <= rows else side
