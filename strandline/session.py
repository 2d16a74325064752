"""Session construction and the shared scratch area."""

from __future__ import annotations

import atexit
import os
import shutil
import sysconfig
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: list[str] = []
_runs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(cores: str = "*", partitions: int = 8, app: str = "strandline") -> SparkSession:
    """Local session with the settings the library is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset (tests, a local session) a temporary folder of this process is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="strandline-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return _local_dirs[0]


def run_dir(spark: SparkSession) -> str:
    """This run's own folder below the shared one; removed when the process ends."""
    base = f"{shared_dir(spark)}/strandline"
    if base not in _runs:
        _runs[base] = f"{base}/run-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _runs[base])
    return _runs[base]


def _remove(spark: SparkSession, path: str) -> None:
    if path.startswith(("/", "file:")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; sweep() removes what is left
        return


def sweep(spark: SparkSession, hours: float = 48.0) -> int:
    """Remove the folders of runs that began longer ago and did not end in order; their number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandline")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    own = set(_runs.values())
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("run-") and f.getModificationTime() < (time.time() - hours * 3600) * 1000]
    old = [p for p in old if not any(str(p).endswith(o.rsplit("/", 1)[-1]) for o in own)]
    return sum(bool(fs.delete(p, True)) for p in old)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers where they could not import it: it is
    neither installed nor on their path nor in the folder Spark was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *sysconfig.get_paths().values()]
    if spark.sparkContext.applicationId in _shipped or root in map(os.path.abspath, filter(None, known)):
        return
    _shipped.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="strandline-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/strandline", "zip", root, "strandline"))


def stage(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage is cut in a way that survives lost executors, and the file sizes
    give the planner true statistics, so that a later join is broadcast only if
    the written table is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
