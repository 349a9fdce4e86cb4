"""Where intermediate tables go, and small session helpers."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir; one is made only where it is unset and the master is local."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place and sc._jsc.sc().getCheckpointDir().isDefined():
        place = sc._jsc.sc().getCheckpointDir().get()
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(place)
    return place.rstrip("/")


#: Bytes of an Arrow batch between the JVM and Python; each task holds a few of them on either side. Spark's own default is 64 MB.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> SparkSession:
    """Has the session send small Arrow batches, unless the application has set their size itself."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; its folder is kept as `stored_at`."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def mounted(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared folder, for files that workers open and memory-map; that needs a file:// folder which all machines mount."""
    url = urlparse(checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {url.scheme}://")
    return f"{url.path}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Removes the folder of a table that `stored` gave."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of the columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[Column]:
    """df's columns, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in leave_out]
