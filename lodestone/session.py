"""Session helpers: table loading, intermediate tables in the shared folder and a local session for tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "lodestone", **conf: str) -> SparkSession:
    """A local session with the settings the library assumes (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()
_archives: list[tempfile.TemporaryDirectory] = []


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that Python stages run where it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    folder = tempfile.TemporaryDirectory(prefix=f"{here.name}-")  # the driver's copy, which Spark serves to executors; goes with the process
    _archives.append(folder)
    archive = Path(folder.name) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task should get, at least and at most.
TASK_ROWS = (50_000, 4_000_000)


def rows_per_task(total: int) -> int:
    """Rows of one task where ``total`` rows are spread: their number and their size both grow with its square root, from
    many short tasks on little data to tasks that still fit in memory on very much."""
    return int(min(TASK_ROWS[1], max(TASK_ROWS[0], 32 * total**0.5)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the shared one named in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a temporary folder; on a cluster it is an error, as other
    machines could not read what one of them wrote to its own disk.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and sc._jsc.sc().getCheckpointDir().isDefined():
        given = sc._jsc.sc().getCheckpointDir().get()
    if given is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        given = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return f"{given.rstrip('/')}/lodestone-{sc.applicationId}"


_local: dict[str, str] = {}
_used: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder and cut the lineage (survives executor loss).

    A written table is columnar and compressed, and later readers take only the columns they need. Tables stay until
    :func:`drop`, :func:`release` or the end of the application.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.applicationId not in _used:
        _used[spark.sparkContext.applicationId] = folder
        atexit.register(release, spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Exception:  # the session has ended: what lies on this machine can still go
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`cut` that nothing reads any more."""
    if path := getattr(df, "written_to", None):
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of the application; frames that read them are void then."""
    for folder in _used.values():
        _delete(spark, folder)
