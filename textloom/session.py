"""Session helpers: the shared folder, cut lineage, table loading."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of a session, once.

    Workers do not share the driver's module path. Spark serves the archive from the driver to every executor, so this
    works whatever folder the driver was started in and needs no ``--py-files``.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="textloom-code-"), "textloom_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("textloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def build_session(app: str = "textloom", cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for.

    On a cluster pass a ready session to the operators instead; nothing below depends on these values.
    """
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; a folder of our own is used only where that is
    unset and the session is local. A cluster that names none is refused: no other machine would see a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _OWN[app]


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if the session still lives."""
    try:
        fs, target = _hadoop_path(spark, path)
        fs.delete(target, True)
    except Exception:  # the session may be gone already
        pass


class Table:
    """A frame written to the shared folder, with its path for early deletion."""

    def __init__(self, spark: SparkSession, frame: DataFrame, path: str):
        self.spark, self.frame, self.path = spark, frame, path

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def write_table(frame: DataFrame, label: str = "t") -> Table:
    """Cut the lineage of ``frame`` by writing it as Parquet into the shared folder.

    Unlike a local checkpoint the files survive the loss of any executor, and unlike an RDD checkpoint the copy is
    columnar, compressed and has statistics for the planner.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = Table(spark, spark.read.schema(frame.schema).parquet(path), path)
    atexit.register(table.drop)
    return table


def spread(frame: DataFrame) -> DataFrame:
    """A freshly read table over at least half as many partitions as there are cores.

    For work that costs far more than moving its input: a table of a single file is one task, however many cores wait.
    A table of many files is left as it is, so nothing is shuffled at scale. Only the plan is asked, no job runs.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame._jdf.queryExecution().toRdd().getNumPartitions() * 2 >= cores:
        return frame
    return frame.repartition(cores)


def load(spark: SparkSession, sf_dir: str, *names: str):
    """Read one table, or several as a tuple, from a data folder."""
    ship(spark)
    frames = tuple(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")) for name in names)
    return frames[0] if len(frames) == 1 else frames
