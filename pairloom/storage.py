"""Where intermediate results live: the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders that this driver made; they go when it ends.
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is named, one of our own in local mode (tests); an error on
    a cluster, whose executors would each write to their own disk."""
    path = spark.conf.get(KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        _made.add(path)
        spark.conf.set(KEY, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def materialise(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_shared(path: str, columns: list[str]) -> pa.Table | None:
    """For tasks: a Parquet folder that was written before they began; None where it has no rows."""
    at = urlparse(path)
    fs, place = (pafs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pafs.FileSystem.from_uri(path)
    if fs.get_file_info(place).type == pafs.FileType.NotFound:
        return None
    rows = pq.read_table(place, columns=columns, filesystem=fs, partitioning=None)
    return rows if rows.num_rows else None


def discard(path: str) -> None:
    """Delete a folder that nothing reads any more."""
    _made.discard(path)
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    elif urlparse(path).scheme in ("", "file"):
        shutil.rmtree(urlparse(path).path, ignore_errors=True)


@atexit.register
def _discard_all() -> None:
    for path in sorted(_made):
        try:
            discard(path)
        except (Py4JError, OSError):  # the JVM, or the store, went first
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for work that takes long with each of its small rows: a small file is read by few tasks."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
