"""Session helpers: how to start Spark here, where to cut lineage, what may be broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have before it is no longer sent whole to every executor.
BROADCAST_ROWS = 200_000


_SHIPPED: set[str] = set()
_OWN: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session, so that their Python workers can import it wherever they run.

    Not needed where the package is installed on the executors or passed by ``--py-files``; harmless then.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="corpuscle-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "corpuscle.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it from its own copy


def local_session(cpus: int = 8, memory: str = "8g", name: str = "corpuscle") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset a temporary one if all runs on this machine (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"corpuscle-{spark.sparkContext.applicationId}")
        named = f"file://{own}"
        if own not in _OWN:
            _OWN.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clean`` removes."""
    _WRITTEN.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def clean(spark: SparkSession) -> None:
    """Remove what this process wrote to the shared folder; results that still read it must have been written elsewhere before."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that lost executors never restart what led to it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as there are cores, for costly work on each row; what has as many already stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it has at most ``most`` rows, with whether it is; else ``df`` for an ordinary join.

    Up to ``most`` + 1 rows come to the driver, from where they are broadcast, so that the source is read once and nothing stays in the executors' memory.
    """
    got = df.limit(most + 1).toArrow()
    if got.num_rows <= most:
        return F.broadcast(df.sparkSession.createDataFrame(got, schema=df.schema)), True
    return df, False
