"""What every operator needs from the session: tables, a shared work folder and checked bounds."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Read one Parquet table; only the named columns reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def work_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a temporary folder of its own; on a cluster that is an
    error, since a machine-local folder would be lost with its executor.
    """
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get(CHECKPOINT_CONF, None) or conf.get(CHECKPOINT_CONF)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="advisorium-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


class Workspace:
    """Tables written to the shared folder to cut lineage between rounds; they survive the loss of executors.

    A query's result may be read from them later, so they stay until ``clean_up`` or the end of the process.
    """

    _made: list["Workspace"] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._written: list[str] = []
        Workspace._made.append(self)

    def store(self, df: DataFrame, label: str, keep: int | None = None) -> DataFrame:
        """Write ``df`` and read it back; with ``keep`` only that many of the latest tables remain."""
        path = f"{self.folder}/{len(self._written):04d}-{label}"
        df.write.mode("overwrite").parquet(path)
        self._written.append(path)
        if keep is not None:
            for old in self._written[:-keep]:
                self.drop(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str) -> None:
        if path.startswith("file:"):  # needs no session, which may have ended
            shutil.rmtree(unquote(urlparse(path).path), ignore_errors=True)
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up() -> None:
    """Remove the folders of all workspaces of this process; frames that read them are then void."""
    while Workspace._made:
        w = Workspace._made.pop()
        if w.folder.startswith("file:") or w.spark.sparkContext._jsc is not None:
            w.drop(w.folder)


def _at_exit() -> None:
    try:
        clean_up()
    except Exception:  # the session may be gone already; what is left lies in a folder meant for it
        pass


atexit.register(_at_exit)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table whose size has a documented bound; more rows are an error and never cut off."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows, which is beyond its documented bound")
    return rows


def small_enough(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; counts no further than that."""
    return df.limit(bound + 1).count() <= bound


def literal_map(pairs: dict) -> "F.Column":
    """A constant lookup inside the expression, so that no join is needed."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package, wherever it lies on the driver.

    Done once per context: the sources go to the executors as a zip file through Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_advisorium_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="advisorium-src-")
    archive = os.path.join(folder, "advisorium.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for where, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(where, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._advisorium_shipped = True
